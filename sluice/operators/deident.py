"""De-identification: residue cleaning, span detection, merge, rewrite, name vocabulary, audit.

Every text is cleaned and searched once, by one Arrow function that runs the table of rules and merges what they find; the result is staged.
Vocabulary, rewriting and audit are plans over it; no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from sluice.functions import patterns as P
from sluice.sources.shared import spread, staged

Span = tuple[int, int, str, float, str]
SPANS = "array<struct<start: int, end: int, kind: string, source: string>>"
LEAST_SCORE = 0.35


def capitalised_pairs(text: str) -> list[Span]:
    """The default stand-in for a name model: two capitalised words in a row."""
    return [(m.start(), m.end(), "PERSON", 0.5, "ner") for m in re.finditer(r"\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b", text)]


def luhn_ok(digits: Column) -> Column:
    """13 to 19 digits with a valid checksum; other characters are ignored."""
    only = F.regexp_replace(digits, r"[^0-9]", "")
    return F.length(only).between(13, 19) & F.call_function("luhn_check", only)


@F.pandas_udf(StringType())
def cut_disclaimers(texts: pd.Series) -> pd.Series:
    """Cuts at the first line that opens a disclaimer and is confirmed within 400 characters; then at an inline phrase past 35 %."""
    opener, confirm, inline = (re.compile(x) for x in (P.DISCLAIMER_OPEN, P.DISCLAIMER_CONFIRM, P.DISCLAIMER_INLINE))

    def cut(text: str | None) -> str | None:
        if not text:
            return text
        at = next((m.start() for m in opener.finditer(text) if confirm.search(text, m.start(), m.start() + 400)), len(text))
        text = text[:at]
        phrase = inline.search(text)
        if phrase and phrase.start() > 0.35 * len(text):
            head = text[: phrase.start()]
            text = text[: max(head.rfind("\n"), head.rfind(". ") + 1)] if max(head.rfind("\n"), head.rfind(". ") + 1) > 0 else text
        return text

    return texts.map(cut, na_action="ignore")


def clean_residue(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, P.SOFT_BREAK, ""), P.SPLIT_EMAIL, "$1")
    out = F.when(out.rlike(P.HTML_ISH), F.regexp_replace(out, P.HTML_TAG, " ")).otherwise(out)
    out = cut_disclaimers(F.regexp_replace(out, P.ATTACHMENT, " "))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def iban(value: str) -> bool:
    """15 to 34 characters whose number, the first four moved to the end and letters as 10 to 35, leaves 1 modulo 97."""
    only = re.sub(r"[ -]", "", value)
    return 15 <= len(only) <= 34 and int("".join(str(int(c, 36)) for c in only[4:] + only[:4])) % 97 == 1


ACCEPTS: dict[str, Callable[[str], object]] = {"": bool, "luhn": luhn, "iban": iban, "namey": re.compile(P.NAMEY).match, "unlisted": lambda x: x.split()[0].lower() not in P.STOPLIST}


def islands(spans: list[Span]) -> list[dict]:
    """Spans that overlap (touching ones do not) as one, with the kind and source of the highest score; of equal scores the earlier one."""
    start, end, score = (np.array([s[k] for s in spans]) for k in (0, 1, 3))
    order = np.lexsort([-end, start])
    reach = np.maximum.accumulate(end[order])
    number = np.cumsum(np.concatenate([[True], start[order][1:] >= reach[:-1]])) - 1
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    best = np.lexsort([-score[order], number])[first]
    last = np.append(first[1:], len(spans)) - 1
    return [{"start": int(start[order[f]]), "end": int(reach[e]), "kind": spans[order[b]][2], "source": spans[order[b]][4]} for f, b, e in zip(first, best, last, strict=True)]


def detector(ner: Callable[[str], list[Span]] = capitalised_pairs, kinds: tuple[str, ...] | None = None):
    """A column function: the merged spans of a text, in order, rules and name model together."""
    kinds = kinds or P.KINDS
    rules = [(k, re.compile(P.python_dialect(p)), s, group, ACCEPTS[accept], needs) for k, p, s, group, accept, needs in P.RULES if s >= LEAST_SCORE and k in kinds]

    def found(text: str | None) -> list[dict]:
        if not text or not text.strip():
            return []
        low = text.lower()
        out = [s for s in ner(text) if s[2] in kinds]
        for kind, pattern, score, group, accept, needs in rules:
            if needs and not any(x in low for x in needs):
                continue
            for m in pattern.finditer(text):
                value = m.group(group).strip()
                if accept(value):
                    out.append((m.start(group), m.start(group) + (len(value) if group else m.end() - m.start()), kind, score, "rule"))
        return islands(out) if out else []

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return spans


def merge_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """spans: key, seq, start, end, kind, score, source. Overlapping ones (touching ones do not overlap) become one span with the kind and
    source of the highest score; of equal scores the earlier one."""
    order = Window.partitionBy(*key).orderBy("start", F.col("end").desc(), "seq")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__rank", F.row_number().over(order)).withColumn("__new", (F.coalesce(F.col("start") >= reach, F.lit(True))).cast("int"))
    island = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct("score", -F.col("__rank"))
    return island.groupBy(*key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("kind", best).alias("kind"), F.max_by("source", best).alias("source"), F.max("score").alias("score")).drop("__island")


def rewrite(text: Column, spans: Column, vocabulary: list[str] | None = None) -> Column:
    """spans: merged and sorted. Placeholders for spans, then names of the vocabulary; repeated tags are one, <<TAG>> loses a pair of brackets."""
    table = F.create_map(*[F.lit(x) for pair in P.PLACEHOLDER.items() for x in pair])
    tag = lambda s: F.coalesce(F.element_at(table, s["kind"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
    before = lambda i: F.when(i > 0, F.element_at(spans, i)["end"]).otherwise(0)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), tag(s)))
    out = F.concat(F.array_join(pieces, ""), F.substr(text, before(F.size(spans)) + 1))
    for pattern in vocabulary or []:
        out = F.regexp_replace(out, pattern, F.lit("<PERSON>"))
    out = F.regexp_replace(out, r"(?U)(<(?:PERSON|EMAIL|PHONE|LOCATION|DATE|ID_NUMBER|ADDRESS|URL)>)(?:[\s/,&]+\1)+", "$1")
    return F.regexp_replace(out, r"<(<[A-Z_]+>)>", "$1")


def detect(docs: DataFrame, text: str, **options) -> DataFrame:
    """docs with merged: array of merged spans, sorted."""
    return spread(docs).withColumn("merged", detector(**options)(F.col(text)))


def name_vocabulary(detected: DataFrame, text: str, least: int = 3, ratio: float = 0.5) -> DataFrame:
    """token, tagged, seen: words that the name model tagged often, and at least half the times they are capitalised."""
    seen = detected.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?U)(\b[A-Z][\w'-]{2,}\b)"))).alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    person = detected.select(text, F.explode("merged").alias("s")).where("s.kind = 'PERSON' and s.source = 'ner'")
    inside = F.substr(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    tokens = person.select(F.explode(F.regexp_extract_all(inside, F.lit(r"(?U)([A-Z][\w'-]+)"))).alias("token")).where((F.length("token") >= 3) & ~F.lower("token").isin(*sorted(P.STOPLIST)))
    tagged = tokens.groupBy("token").agg(F.count("*").alias("tagged")).where(F.col("tagged") >= least)
    both = tagged.join(seen, "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return both.where(F.col("tagged") / F.greatest("seen", "tagged") >= ratio)


def branch(words: list[str], at: int = 0) -> str:
    """A pattern of the sorted words from place `at` on, common beginnings once; of words that begin alike the longest is tried first."""
    if len(words) == 1:
        return re.escape(words[0][at:])
    rest = [list(group) for _, group in groupby((w for w in words if len(w) > at), key=lambda w: w[at])]
    body = "(?:" + "|".join(re.escape(group[0][at]) + branch(group, at + 1) for group in rest) + ")"
    return body if len(words[0]) > at else body + "?"


def sweeps(names: list[str], each: int = 20_000) -> list[str]:
    """Patterns that cover the names, so many apiece. Names that begin alike stay together where they fit, longest first in any case."""
    ordered = sorted(names)
    return [r"(?U)\b" + branch(ordered[i : i + each]) + r"(?:['’]s)?\b" for i in range(0, len(ordered), each)]


def scrub(docs: DataFrame, text: str, subject: str | None = None, **options) -> DataFrame:
    """docs with scrubbed (and scrubbed_subject): residue cleaned, spans replaced, the pool's name vocabulary swept, and n_names, its size.

    The vocabulary is learned from texts and subjects of the whole pool; subjects are not cleaned. Names reach the driver, texts do not.
    """
    find = detector(**options)
    clean = spread(docs).withColumn("__clean", clean_residue(F.coalesce(F.col(text), F.lit(""))))
    found = clean.withColumn("__spans", find(F.col("__clean")))
    if subject:
        found = found.withColumn("__subject", F.coalesce(F.col(subject), F.lit(""))).withColumn("__subject_spans", find(F.col("__subject")))
    found = staged(found, "scrub")
    pool = found.select(F.col("__clean").alias("t"), F.col("__spans").alias("merged"))
    if subject:
        pool = pool.unionByName(found.select(F.col("__subject").alias("t"), F.col("__subject_spans").alias("merged")))
    names = [r["token"] for r in name_vocabulary(pool, "t").select("token").collect()]
    patterns = sweeps(names)
    out = found.withColumn("scrubbed", rewrite(F.col("__clean"), F.col("__spans"), patterns)).withColumn("n_names", F.lit(len(names)))
    if subject:
        out = out.withColumn("scrubbed_subject", rewrite(F.col("__subject"), F.col("__subject_spans"), patterns))
    return out.drop("__clean", "__spans", "__subject", "__subject_spans")


def audit(docs: DataFrame, text: str, rows: list[tuple[str, str, bool]] = P.AUDIT) -> DataFrame:
    """label, kind, n_rows, n_hits of every pattern: one pass over the texts, card-shaped hits only with a valid checksum."""
    body = F.coalesce(F.col(text), F.lit(""))

    def hits(label: str, pattern: str) -> Column:
        if label.startswith("card"):
            return F.size(F.filter(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), luhn_ok))
        return F.regexp_count(body, F.lit(pattern))

    counted = spread(docs.select(text)).select(*[hits(label, p).alias(f"h{i}") for i, (label, p, _) in enumerate(rows)])
    sums = counted.agg(*[f(f"h{i}").alias(f"{k}{i}") for i in range(len(rows)) for k, f in (("n", lambda c: F.sum((F.col(c) > 0).cast("long"))), ("s", F.sum))])
    listed = [F.struct(F.lit(label).alias("label"), F.lit("identifier" if ident else "residue").alias("kind"), F.coalesce(f"n{i}", F.lit(0)).alias("n_rows"), F.coalesce(f"s{i}", F.lit(0)).alias("n_hits")) for i, (label, _, ident) in enumerate(rows)]
    return sums.select(F.explode(F.array(*listed)).alias("r")).select("r.*")


def placeholder_counts(docs: DataFrame, text: str) -> DataFrame:
    tags = sorted(set(P.PLACEHOLDER.values()))
    sums = docs.agg(*[F.coalesce(F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(re.escape(t)))), F.lit(0)).alias(f"t{i}") for i, t in enumerate(tags)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"t{i}").alias("n")) for i, t in enumerate(tags)])).alias("r")).select("r.*")


def audit_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both audits side by side, each label clear, unchanged or reduced by the rows that hold it."""
    b, a = (x.select("label", "kind", F.col("n_rows").alias(f"rows_{w}"), F.col("n_hits").alias(f"hits_{w}")) for x, w in ((before, "before"), (after, "after")))
    status = F.when(F.col("rows_after") == 0, "clear").when(F.col("rows_after") >= F.col("rows_before"), "unchanged").otherwise("reduced")
    return b.join(F.broadcast(a.drop("kind")), "label").withColumn("status", status)


def audit_totals(docs: DataFrame, text: str, scrubbed: str, report: DataFrame) -> DataFrame:
    """Rows, the share of characters kept, and the sums of rows that still hold identifiers and residue."""
    kept = docs.agg(F.count("*").alias("n_rows"), (F.sum(F.length(scrubbed)) / F.greatest(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))), F.lit(1))).alias("kept"))
    left = report.agg(F.sum(F.when(F.col("kind") == "identifier", F.col("rows_after")).otherwise(0)).alias("leaks"), F.sum(F.when(F.col("kind") == "residue", F.col("rows_after")).otherwise(0)).alias("residue"))
    return kept.crossJoin(F.broadcast(left)).withColumn("kept", F.round("kept", 9))  # one row each


def review_samples(scrubbed: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n scrubbed rows by key, to be read by a person."""
    subject = F.col("scrubbed_subject") if "scrubbed_subject" in scrubbed.columns else F.lit("")
    return scrubbed.orderBy(key).limit(n).select(key, F.concat(F.lit("SUBJECT: "), subject, F.lit("\n"), F.col("scrubbed")).alias("sample"))
