"""Structured Streaming forms of the stream-like operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def marks_of(value: Column) -> tuple[Column, Column]:
    """label and phase of a line's marker, anywhere in it; broken JSON is ignored."""
    step = F.get_json_object(F.regexp_extract(value, r"##step (\{.*\})", 1), "$.label")
    phase = F.get_json_object(F.regexp_extract(value, r"##progress (\{.*\})", 1), "$.phase")
    return step.alias("label"), phase.alias("phase")


def token_spend(events: DataFrame, group: str, ts: str, amount: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Tokens spent per group in sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), group).agg(F.sum(amount).alias("spent")).select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent")


def log_marks(lines: DataFrame) -> DataFrame:
    """Step and progress markers out of a streamed text source, anywhere in a line; broken JSON is ignored."""
    return lines.select(*marks_of(F.col("value"))).where("label is not null or phase is not null")


def job_states(lines: DataFrame) -> DataFrame:
    """lines: job, line_no, value, streamed. The state of every job that a trigger brought lines of: step (how many steps
    began), label, phase. A new step clears the phase. Lines of one job are taken in order of line_no within a trigger."""
    schema = "job long, step long, label string, phase string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, label, phase = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values("line_no")
        for new, seen in zip(rows["label"], rows["phase"], strict=True):
            if isinstance(new, str):
                step, label, phase = step + 1, new, None
            elif isinstance(seen, str) and step:
                phase = seen
        state.update((step, label, phase))
        yield pd.DataFrame({"job": [key[0]], "step": [step], "label": [label], "phase": [phase]})

    marks = lines.select("job", "line_no", *marks_of(F.col("value"))).where("label is not null or phase is not null")
    return marks.groupBy("job").applyInPandasWithState(fold, schema, "step long, label string, phase string", "update", "NoTimeout")
