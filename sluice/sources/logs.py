"""Growing logs: what a file gained since the last look, with an unfinished last line held back, folded into a job's state."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

BREAK = re.compile(rb"[\r\n]")
MARKER = re.compile(r"##(step|progress) (\{.*\})")


@dataclass(frozen=True)
class State:
    """offset: bytes read; held: the bytes of an unfinished line; step: how many steps began."""

    offset: int = 0
    held: bytes = b""
    step: int = 0
    label: str = ""
    phase: dict | None = None


def gained(spark: SparkSession, path: str, offset: int, most: int = 8 << 20) -> bytes:
    """At most `most` bytes of the file from the offset on, through Spark's file systems; nothing if there is no file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return b""
    n = min(fs.getFileStatus(at).getLen() - offset, most)
    if n <= 0:
        return b""
    stream = fs.open(at)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def fold(state: State, chunk: bytes) -> tuple[State, list[str]]:
    """The state after a chunk, and the chunk's finished lines. Carriage returns end lines too; a marker may stand anywhere in
    one, broken JSON is ignored, and a new step clears the phase."""
    *lines, held = BREAK.split(state.held + chunk)
    texts = [x.decode("utf-8", "replace") for x in lines]
    step, label, phase = state.step, state.label, state.phase
    for text in texts:
        mark = MARKER.search(text)
        try:
            data = json.loads(mark[2]) if mark else None
        except ValueError:
            continue
        if data is not None and mark[1] == "step":
            step, label, phase = step + 1, str(data.get("label", "")), None
        elif data is not None:
            phase = data
    return replace(state, offset=state.offset + len(chunk), held=held, step=step, label=label, phase=phase), texts


def tail(spark: SparkSession, path: str, state: State | None = None) -> tuple[State, list[str]]:
    """What the log gained since the state: the next state and the finished lines."""
    state = state or State()
    return fold(state, gained(spark, path, state.offset))


def tracked(items: Iterable, phase: str, total: int, write: Callable[[str], None] = print, every: float = 1.0, clock: Callable[[], float] = time.monotonic) -> Iterator:
    """The items, with a progress marker at the start, at the end, and between at most once in `every` seconds."""
    say = lambda done: write("##progress " + json.dumps({"phase": phase, "done": done, "total": total}))
    say(0)
    last = clock()
    for done, item in enumerate(items, 1):
        yield item
        if done == total or clock() - last >= every:
            last = clock()
            say(done)
