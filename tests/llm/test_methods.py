"""The operators' inner workings against plain versions: counts, quotas, batches, prefixes; odd vectors, hosts and columns."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import blocks, common, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, sharding, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_kneser_ney_counts(spark, documents):
    """The model's ratios equal those of a plain Kneser-Ney model over the rows that it counts."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels = labels.unionByName(documents.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    args = dict(sample_rows=1000, longest=20_000, key="doc_id", text="text", label="toxic")
    model = toxicity.fit(documents, labels, least_documents=3, **args)
    rows = [(toxicity.words(r["text"]), r["y"]) for r in toxicity.sample(documents, labels, **args).where("part > 0").collect()]
    frequent = Counter(w for words, _ in rows for w in set(words))
    assert set(model.vocabulary) == {w for w, n in frequent.items() if n >= 3}
    pairs = [Counter(), Counter()]
    for words, y in rows:
        ids = [model.vocabulary.get(w, 0) for w in words]
        pairs[y].update(zip([0, *ids[:-1]], ids, strict=True) if ids else [])
    size = len(model.vocabulary) + 1
    types = Counter(b for _, b in set(pairs[0]) | set(pairs[1]))
    both = [(types[w] + 0.5) / (sum(types.values()) + 0.5 * size) for w in range(size)]
    unigram, weight, discount = [], [], []
    for y in (0, 1):
        own = Counter(b for _, b in pairs[y])
        few = [sum(own[w] == k for w in range(1, size)) for k in (1, 2)]
        d = few[0] / (few[0] + 2 * few[1]) if all(few) else 0.5
        left = sum(min(n, d) for n in own.values()) / sum(own.values())
        unigram.append([max(own[w] - d, 0) / sum(own.values()) + left * both[w] for w in range(size)])
        few = [sum(n == k for n in pairs[y].values()) for k in (1, 2)]
        discount.append(few[0] / max(1, few[0] + 2 * few[1]) or 0.5)
        seen, kinds = Counter(), Counter()
        for (a, _), n in pairs[y].items():
            seen[a] += n
            kinds[a] += 1
        weight.append([discount[y] * kinds[a] / seen[a] if seen[a] else 1.0 for a in range(size)])
        pairs[y] = (pairs[y], seen)
    assert np.allclose(model.word, [math.log(unigram[1][w] / unigram[0][w]) for w in range(size)], atol=1e-4)
    assert np.allclose(model.backoff, [math.log(weight[1][w] / weight[0][w]) for w in range(size)], atol=1e-4)
    want = {}
    for key in set(pairs[0][0]) | set(pairs[1][0]):
        if pairs[0][0][key] + pairs[1][0][key] >= 3:
            p = [max(n[key] - discount[y], 0) / max(seen[key[0]], 1) + weight[y][key[0]] * unigram[y][key[1]] for y, (n, seen) in enumerate(pairs)]
            want[key[0] * size + key[1]] = math.log(p[1] / p[0])
    assert model.pairs.tolist() == sorted(want) and np.allclose(model.pair, [want[k] for k in sorted(want)], atol=1e-4)


def test_toxicity_with_one_class_and_clashing_columns(spark, documents):
    only = documents.select("doc_id", F.lit(1).alias("toxic"))
    scored = toxicity.add_score(documents.withColumn("score", F.lit("mine")), only, "score")
    assert scored.columns == [*documents.columns, "score"] and all(r["score"] > 0.99 for r in scored.collect())
    none = toxicity.add_score(documents, only.limit(0), "score").collect()
    assert all(r["score"] < 1e-6 for r in none)


def test_shards_match_the_mixture(documents):
    rows = sharding.interleave(documents, 8).collect()
    texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == texts
    shares, n = Counter(r["source"] for r in rows), Counter((r["shard"], r["source"]) for r in rows)
    assert all(abs(n[k, s] - shares[s] / 8) < 2 for k in range(8) for s in shares)
    assert max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1
    # Any run of the whole order holds every source in its share.
    order = [r["source"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    for s, total in shares.items():
        seen = np.cumsum([x == s for x in order])
        assert np.abs(seen - total * np.arange(1, len(order) + 1) / len(order)).max() <= 2


def test_shards_draw_their_quotas(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), ("a", "a", "a", "a", "b", "c", None)[i % 7]) for i in range(700)]
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4, seats_per_shard=32)
    quota = {(r["source"], r["shard"]): r["blocks"] for r in mix.quotas.collect()}
    blocks = mix.blocks.collect()
    assert Counter((r["source"], s) for r in blocks for s in r["shards"]) == Counter(quota)
    plan = {r["source"]: r for r in mix.targets.collect()}
    # Below the limit: the first j shards hold the apportionment of their seats, by highest quotients.
    weights = {s: w for s, w in zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True) if not plan[s]["capped"]}
    per_shard = max(sum(quota.get((s, k), 0) for s in weights) for k in range(4))
    got, total = Counter(), sum(n for (s, _), n in quota.items() if s in weights)
    seats = sorted(((2 * k + 1) / w, "n" if s is None else "v" + s, s) for s, w in weights.items() for k in range(total))
    for k in range(4):
        got.update({s: quota.get((s, k), 0) for s in weights})
        assert got == Counter(s for _, _, s in seats[: min(total, (k + 1) * per_shard)])
    # At the limit: spread evenly, every block twice.
    for s in set(plan) - set(weights):
        n = [quota.get((s, k), 0) for k in range(4)]
        assert max(n) - min(n) <= 1 and all(len(r["shards"]) == 2 for r in blocks if r["source"] == s)
    # A document's words are those of the blocks it lies in, each as often as shards took it.
    lengths = {(r["source"], r["at"]): (r["length"], len(r["shards"])) for r in blocks}
    found = mix.rows.collect()
    for s in plan:
        assert sum(r["taken"] for r in found if r["source"] == s) == sum(n * times for (t, _), (n, times) in lengths.items() if t == s)
    assert all(r["copies"] == len(r["shards"]) for r in found)


def test_batches_of_the_digest_index(spark):
    index = exact_dedup.DigestIndex.temporary(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.verdicts(frame([(1, "a"), (2, "b"), (3, "a ")]), index, batch="one").collect()
    assert {r["doc_id"]: (r["kept"], r["keep_id"]) for r in first} == {1: (False, 3), 2: (True, 2), 3: (True, 3)}
    # Part old, part new; then the same batch once more, as after a lost job.
    again = frame([(4, "a"), (5, "c"), (6, " c")])
    for _ in range(2):
        second = exact_dedup.verdicts(again, index, batch="two").collect()
        assert {r["doc_id"]: (r["kept"], r["keep_id"], r["group_size"]) for r in second} == {4: (False, 3, 1), 5: (False, 6, 2), 6: (True, 6, 2)}
        assert index.read().count() == 3
    assert [r["doc_id"] for r in exact_dedup.keep_first(frame([(7, "b"), (8, "d"), (8, "d")]), index, batch="three").collect()] == [8]
    plan = index.read().join(frame([(1, "a")]).select(F.sha2("text", 256).alias("digest")).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    index.forget()
    assert index.read() is None


def test_prefix_follows_the_measured_recall():
    always, never = np.array([0, 0, 0, 0, 0, 0, 9]), np.array([0, 5, 4, 0, 0, 0, 0])
    assert ngram_join.shortened([always, np.zeros(7, int)], 6, 0.999) == 6
    assert ngram_join.shortened([always, never], 6, 0.999) == 1 and ngram_join.shortened([always, never], 6, 0.4) == 2
    assert ngram_join.shortened([np.array([5, 0, 0])], 2, 0.9) == 1


def test_measured_recall_is_that_of_all_pairs(spark, documents):
    texts = documents.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    factors = np.random.default_rng(7).integers(0, 1 << 63, 96, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sets = {r["id"]: h for r in texts.collect() if len(h := ngram_join.shingles(r["text"]))}
    probe = ngram_join.Probe.of([sets[i] for i in sorted(sets)[:40]], factors, 16)
    total = np.zeros(7, int)
    for i, j in itertools.product(sorted(sets)[:40], sets):
        a, b = sets[i], sets[j]
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both) > 4 * both:
            s, t = (ngram_join.signature(x, factors).astype(np.uint16).reshape(16, 6) for x in (a, b))
            total[max(next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(s, t, strict=True))] += 1
    paths = {j: ngram_join.signature(h, factors).astype(np.uint16).reshape(16, 6) for j, h in sets.items()}
    assert sum(probe.levels(h, paths[j], (4, 5)) for j, h in sets.items()).tolist() == total.tolist()


def test_rows_sent_to_blocks_grow_with_the_group(spark):
    n = {}
    for size in (1_000, 4_000):
        rows = spark.range(size).select(F.lit(1).cast("long").alias("grp"), "id")
        n[size] = blocks.into_blocks(rows, "grp", None, blocks.LEAST_ROWS, blocks.MOST_ROWS).count()
    assert n[4_000] <= 4.1 * n[1_000]
    cut = blocks.into_blocks(spark.range(500).select(F.lit(1).cast("long").alias("grp"), "id"), "grp", None, 2, 10)
    assert cut.groupBy("a", "b").count().agg(F.max("count")).first()[0] <= 60 and cut.where("a = b").count() == 500


def test_odd_vectors(spark):
    rows = [(1, [2.0], 0), (2, [3.0], 0), (3, [-1.0], 0), (4, [1.0], 1), (5, [1e200, 1e-200], 0), (6, [2e200, 0.0], 0), (7, [1.0, 2.0, 3.0], 0), (8, [1.0, 2.0, 3.1], 0), (9, [1e-300] * 3, 1), (10, [2e-300] * 3, 1), (11, [], 0), (12, [0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    linked = {1: 1, 2: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 9}
    assert got == {i: (int(i in linked), linked.get(i, i)) for i, _, _ in rows}


def test_language_model_is_the_plain_one(spark):
    rows = [(i, " ".join(f"{'abcde'[(i + k) % 5]}{'xyz'[i % 3]}{'uvw'[(i * k) % 3]}" for k in range(12)), "pqr"[i % 3]) for i in range(120)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.languages == ["p", "q", "r"]
    for k, lang in enumerate(model.languages):
        count = np.full(1 << model.bits, 0.5)
        for t, own in learned:
            if own == lang:
                for _, points, _ in language_id.groups([t]):
                    for bucket, some in language_id.hashed(points, model.bits):
                        np.add.at(count, bucket[some], 1)
        assert np.allclose(model.logp[k], np.log(count / count.sum()), atol=1e-4)
        assert abs(model.prior[k] - math.log(sum(own == lang for _, own in learned) / len(learned))) < 1e-9
    # A prediction does not depend on the texts beside it.
    texts = [t for _, t, _ in rows[:20]]
    assert np.allclose(model.predict(texts)[1], [model.predict([t])[1][0] for t in texts], rtol=1e-12)
    # Two texts as likely in every language: the first one in code-point order.
    even = language_id.Model(["a", "b"], np.zeros((2, 1 << 8), np.float32), np.zeros(2), 8)
    assert even.predict(["tie", None, "1"])[0] == ["a", "und", "und"]


def test_many_languages_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_CELLS", 1 << 18)
    rows = [(i, f"{chr(0x4E00 + i % 200)}{chr(0x5E00 + i % 200)} " * 9, f"l{i % 200:03d}", "x", 1) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Lang_Score int")
    got = language_id.add_language(table)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    assert sum(r["lang"] == r["lang_pred"] for r in got.collect()) >= 990


def test_long_hosts(spark):
    urls = ["http://" + "a." * 200_000 + "example.com/en/x", "http://" + "b" * 500_000 + "/en/", "http://.net/es/", "http://" + ".".join(["c"] * 100_000)]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("block", "net", "/es/")]
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {0: ("example.com/en/", "block", 400_011), 1: (None, "allow", 500_000), 2: ("net/es/", "block", 4), 3: (None, "allow", 199_999)}
    assert len(list(url_filter.keys("a." * 200_000 + "example.com", "/en/", url_filter.Shape.of(rules)))) == 4


def test_scratch_deletes_what_was_staged(spark):
    with common.scratch(spark):
        inner = common.staged(spark.range(3), "scratch")
        assert inner.count() == 3
    outer = common.staged(spark.range(3), "scratch")
    assert outer.count() == 3
    assert not spark.sparkContext._jvm.java.io.File(inner.staged_at.removeprefix("file:")).exists()
    common.discard(outer)
