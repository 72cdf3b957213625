"""The training-data operators on small tables, against brute force: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, sharding, suffix_dedup, toxicity, url_filter

PROSE = " ".join(f"word{i * 7919 % 541}" for i in range(300))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE.replace("word5 ", "other "), "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, "  \t ", "fr", None),
    (7, "one two", "fr", "a"), (8, "one\ntwo", None, "c"), (9, "x" * 5000 + " end", "en", "a"), (10, PROSE[:400], "en", "a"), (10, PROSE[:400], "en", "a"), (None, "tail " + PROSE[-300:], "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1) for r in ROWS], "doc_id long, text string, lang string, source string, shard int, total int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sharding(docs, empty):
    rows = sharding.interleave(docs, 4).collect()
    assert len(rows) == len(ROWS) and {r["law"] for r in rows} == {"rows"}
    for s, group in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        group = list(group)
        assert [r["slot"] for r in group] == list(range(len(group))) and len(group) == 3 and 0 <= s < 4
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in ROWS)
    assert sharding.interleave(empty, 4).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).rows.collect()
    assert len(rows) == len(ROWS)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in ROWS]
    assert sorted(r["size"] for r in rows) == sorted(words)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    target = {r["source"]: r["target"] for r in rows}
    assert abs(sum(target.values()) - 1.5 * sum(words)) < 1e-6
    for s, t in target.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - t) <= max(4, 0.02 * t)
    assert mixing.mix(empty).rows.count() == 0 and mixing.resample(empty).columns == empty.columns
    assert rows == mixing.mix(docs).rows.collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).rows.collect()))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = sorted(rng.choice(40, 7, replace=False).tolist())
        counts = rng.integers(1, 9, 7).tolist()
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*b, lengths[-1])) for k in range(3) for b in itertools.combinations(lengths[:-1], k))
        assert cost(packing.boundaries(lengths, counts, 3)) == best


def test_packing(docs, empty):
    rows = packing.pack(docs, buckets=3, budget=400).collect()
    assert len(rows) == len(ROWS)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["slot"])), key=lambda r: (r["bucket"], r["batch"])):
        group = list(group)
        assert [r["slot"] for r in group] == list(range(len(group)))
        assert len(group) == 1 or len(group) * group[0]["padded"] <= 400
        assert all(0 <= r["padding"] == r["padded"] - r["n_tokens"] for r in group)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("lengths", [[1] * 20 + [2, 3, 3, 5, 8, 9, 9, 13, 17, 18] * 2 + [40], list(range(1, 17))])
@pytest.mark.parametrize("buckets", [3, 16])
def test_packing_pads_least(spark, lengths, buckets):
    table = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(table, buckets=buckets).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(lengths) and len({r["padded"] for r in rows}) <= buckets
    distinct = sorted(set(lengths))
    cuts = ((*b, distinct[-1]) for k in range(min(buckets, len(distinct))) for b in itertools.combinations(distinct[:-1], k))
    assert sum(r["padding"] for r in rows) == min(sum(min(x for x in b if x >= n) - n for n in lengths) for b in cuts)


def brute_exact():
    groups = {}
    for i, t, _, _ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return groups


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.DigestIndex.temporary(spark)
    rows = exact_dedup.verdicts(docs, index).collect()
    groups = brute_exact()
    assert len(rows) == len(ROWS) and sum(r["kept"] for r in rows) == len(groups)
    for text, members in groups.items():
        own = [r for r in rows if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert len(own) == len(members) and {r["keep_id"] for r in own} == {min(members)[2]} and {r["group_size"] for r in own} == {len(members)}
    again = exact_dedup.verdicts(docs, index).collect()
    assert not any(r["kept"] for r in again) and index.read().count() == len(groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.keep_first(empty).count() == 0


def test_near_join(docs, empty):
    rows = ngram_join.link(docs, chunk=2).collect()
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) and i is not None else set()) for i, t, _, _ in ROWS]
    want = sorted((i is None, i or 0, sum(bool(a and b) and len(a & b) / len(a | b) >= 0.8 for k, (_, b) in enumerate(sets) if k != j)) for j, (i, a) in enumerate(sets))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_links"]) for r in rows) == want
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[1] == component[2] == component[3] == 1 and component[7] == component[8] == 7
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert ngram_join.link(empty).count() == 0


@pytest.mark.parametrize("crowded", [64, 0])
def test_suffix_dedup(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = suffix_dedup.spans(docs, 50, 600).collect()
    big = 1 << 60
    texts = [(big if i is None else i, (t or "").encode()) for i, t, _, _ in ROWS]
    want = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - 49):
            if any(j < i and t[s : s + 50] in u for j, u in texts):
                gone[s : s + 50] = [True] * 50
        want.append((i, len(t), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert sorted((big if r["doc_id"] is None else r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in rows) == sorted(want)
    assert suffix_dedup.spans(empty).count() == 0


def test_suffix_dedup_scans_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 30_000, dtype=np.uint8).tobytes() + b"ab" * 3000 + b"z" * 3000
    texts = [b"", text[:700], text, b"short", text[5000:9000]]
    fields = ("gram", "region", "doc", "first", "count")
    whole = suffix_dedup.scan(texts, 50)
    monkeypatch.setattr(suffix_dedup, "PLACE", np.uint64((1 << 10) - 1))
    cut = suffix_dedup.scan(texts, 50)
    # Fewer bits of a place leave more bits of the hash: the same windows, each once, and equal classes of equal texts.
    windows = lambda c: sorted((int(d), int(f) + k) for d, f, n in zip(c.doc, c.first, c.count, strict=True) for k in range(n))
    assert windows(cut) == windows(whole) == [(d, k) for d, t in enumerate(texts) for k in range(len(t) - 49)]
    assert all(suffix_dedup.scan([t], 50).gram.tolist() == cut.gram[cut.doc == d].tolist() for d, t in enumerate(texts) if len(t) >= 50)
    inner = {(f - 5000, g, r, n) for d, f, g, r, n in zip(*[getattr(cut, x).tolist() for x in ("doc", "first", "gram", "region", "count")], strict=True) if d == 2 and f >= 5000}
    part = [(f, g, r, n) for d, f, g, r, n in zip(*[getattr(cut, x).tolist() for x in ("doc", "first", "gram", "region", "count")], strict=True) if d == 4]
    assert len(part) > 100 and set(part[1:-1]) <= inner


def test_suffix_dedup_beyond_24_bits_of_places(spark):
    letters = np.random.default_rng(7).integers(97, 123, (1 << 24) + 4000, dtype=np.uint8).tobytes().decode()
    tail, early = letters[-2000:-1000], "early " + "".join(reversed(letters[:600]))
    rows = [(1, early), (2, letters + early), (3, "later " + tail + " end")]
    got = {r["doc_id"]: r for r in suffix_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["removed"] == [] and [tuple(s) for s in got[2]["removed"]] == [(len(letters), len(letters + early))]
    assert bytes(got[2]["kept"]) == letters.encode() and [tuple(s) for s in got[3]["removed"]] == [(6, 1006)] and bytes(got[3]["kept"]) == b"later  end"


def test_suffix_dedup_sends_little(spark, monkeypatch):
    """Repeats shorter than a window send no text, and copies less than a third of their bytes."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    phrases = [letters(26) for _ in range(20)]
    short = ["".join(letters(40) + phrases[k] for k in rng.integers(0, 20, 40)) for _ in range(60)]
    sent, write = {}, suffix_dedup.C.staged

    def staged(df, tag):
        out = write(df, tag)
        sent[tag] = out.agg(F.sum(sum(F.octet_length(c) for c in "abcd"))).first()[0] or 0
        return out

    monkeypatch.setattr(suffix_dedup.C, "staged", staged)
    run = lambda texts: suffix_dedup.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket_bytes=40_000).collect()
    assert not any(r["removed"] for r in run(short)) and sent["passage-grams"] > 0 and sent["passage-regions"] == 0
    texts = [letters(20_000)] * 12
    rows = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in run(texts)}
    assert rows == {i: [(0, 20_000)] if i else [] for i in range(12)} and sum(sent.values()) < 12 * 20_000 / 30


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 16))
    x[60:120] = x[:60] + 0.2 * rng.standard_normal((60, 16))
    x[120:] = x[0] + 0.05 * rng.standard_normal((30, 16))
    rows = [(i, v.tolist(), i % 3 % 2) for i, v in enumerate(x)] + [(200, x[0].tolist(), 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 1), (204, x[1].tolist(), None), (205, [1.0, None], 0), (206, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.link(table).collect()}
    assert len(got) == len(rows)
    good = [(i, np.asarray(v, np.float32).astype(float), k) for i, v, k in rows if i <= 200]
    found = total = 0
    for i, v, k in good:
        n = sum(k == m and i != j and v @ w / np.sqrt(v @ v * (w @ w)) >= 0.93 for j, w, m in good)
        assert got[i]["n_links"] <= n
        found, total = found + got[i]["n_links"], total + n
    assert total > 500 and found >= 0.95 * total
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(201, 207))
    assert embedding_dedup.link(table.limit(0)).count() == 0
    # Without an index all vectors of a length and label meet: exact.
    every = {r["vec_id"]: r for r in embedding_dedup.link(table, most_indexes=0).collect()}
    assert sum(every[i]["n_links"] for i, _, _ in good) == total and all(every[i]["n_links"] >= got[i]["n_links"] for i in got)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        w = rng.choice([f"w{k}" for k in range(80)], 40).tolist()
        if i % 4 == 0:
            w[int(rng.integers(40))] = "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, 1), (0, None)], "doc_id long, toxic int")
    scored = toxicity.add_score(table, marks, "score").withColumn("out", toxicity.held_out(F.col("doc_id"))).where("out").collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored) >= 0.95 * len(scored)
    odd = toxicity.add_score(docs, marks, "score").collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.add_score(empty, marks, "score").count() == 0


def test_language(spark, docs, empty):
    rows = [(i, ("the of and thing with " if i % 2 else "le la des une avec ") * (1 + i % 5), "en" if i % 2 else "fr") for i in range(200)]
    table = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "fr"), (902, "the thing", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.add_language(table).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and got[900] == got[901] == ("und", 0.0) and got[902][0] == "en"
    assert {r["lang_pred"] for r in language_id.add_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.add_language(empty).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q", "http://b.example.com/de", "http://example.com", "http://x.net/es/#t", "http://x.net/en", "nothing", None, "://", "http://notexample.com/en/", "ftp://é.net/es/é"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(table, RULES, first_bits=1.0, bits=1.5).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict)
    assert url_filter.judge(table.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = [f"k{i}" for i in range(3000)]
    listed = universe[::7]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    cascade = url_filter.build(frame(universe), frame(listed), 2.0, 2.0, 10_000)
    assert len(cascade.levels) > 2 and {k for k in universe if k in cascade} == set(listed)
