"""The pipeline against a plain Python version of its stages, and on empty tables."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sluice.llm import packing

SMALL = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def fixture_rows():
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(3000)}"
    rows, toxic = [], set()
    for i in range(0, 480):
        words = [word() for _ in range(int(rng.integers(100, 160)))]
        if i % 6 == 0:
            toxic.add(i)
            for at in rng.choice(len(words), 10, replace=False):
                words[at] = ("vile", "scum", "filth")[at % 3]
        rows.append([i, " ".join(words), "en", ("a", "a", "a", "b", "c", None)[i % 6 if i % 7 else 0]])
    for i, j in zip(range(480, 520), range(1, 480, 12), strict=False):
        rows.append([i, rows[j][1].replace(" ", "  ", i % 3), "en", "b"])  # exact but for space
        words = rows[j + 1][1].split()
        words[len(words) // 2] = "changed"
        rows.append([i + 100, " ".join(words), "en", "c"])
        words = rows[j + 2][1].split()
        words[::12] = ["other"] * len(words[::12])
        rows.append([i + 200, " ".join(words), "en", "a"])  # far below 0.8
    words = rows[7][1].split()
    for i in range(800, 830):  # a chain of near copies
        words = [*words]
        words[(i - 800) * 3] = f"link{i}"
        rows.append([i, " ".join(words), "en", "a"])
    rows += [[900, None, None, None], [901, "", "en", "a"], [902, " \t\n", "en", "b"], [903, "one two", "en", "d"], [904, "onetwo", "en", "d"], [905, " ".join(word() for _ in range(9000)), "en", "b"], [-(1 << 63), "three four", "en", None]]
    return [(*r, len(r[1] or "")) for r in rows], toxic


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def seeded(*parts):
    key = hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()
    return int(key[:8], 16), key


def crc(text):
    return zlib.crc32((text or "").encode())


def exact(rows):
    best = {}
    for r in rows:
        k = squeezed(r[1])
        if k not in best or (-len(r[1] or ""), r[0]) < (-len(best[k][1] or ""), best[k][0]):
            best[k] = r
    return list(best.values())


def near(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows, seed=23, shards=16):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    name = {s: "n" if s is None else "v" + s for s in sources}
    size = {s: sum(n_words(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(size.values()), set(sources)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    seats_of = dict.fromkeys(sources, 0)
    words = sum(target[s] for s in free)
    total = sum(weight[s] for s in free)
    block = max(1, math.ceil(words / (max(512, math.ceil(16 * total / min(weight[s] for s in free))) * shards)))
    for _ in range(math.floor(words / block + 0.5)):
        seats_of[min(free, key=lambda s: (-weight[s] / (2 * seats_of[s] + 1), name[s]))] += 1
    out = []
    for s in sources:
        n = math.ceil(size[s] / block)
        quota = min(seats_of[s], 2 * n) if s in free else 2 * n
        order = sorted(range(n), key=lambda at: (seeded(seed, name[s], at)[1], at))
        times = {at: quota // n + (k < quota % n) for k, at in enumerate(order)}
        start = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: seeded(seed, r[0], crc(r[1]), n_words(r[1]))):
            out += [r] * times.get(start // block, quota // n if n else 0)
            start += n_words(r[1])
    return out


def packed(rows, seed=31, budget=16_384, grain=8):
    up = [max(1, math.ceil(n_words(r[1]) / grain)) * grain for r in rows]
    bounds = packing.boundaries(sorted(set(up)), [up.count(u) for u in sorted(set(up))], 16)
    place = lambda r: sum(b < n_words(r[1]) for b in bounds)
    out = []
    for bucket, group in itertools.groupby(sorted(rows, key=place), key=place):
        pad = bounds[bucket]
        for at, r in enumerate(sorted(group, key=lambda r: seeded(seed, r[0], crc(r[1]), n_words(r[1])))):
            room = max(1, budget // pad)
            out.append((r[0], n_words(r[1]), bucket, pad, at // room, at % room, pad - n_words(r[1])))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, toxic = fixture_rows()
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(480)] + [(5000, 0, 1), (1, 0, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic


def test_pipeline_equals_brute_force(spark, made):
    folder, rows, _ = made
    clean = [r for r in rows if not {"vile", "scum", "filth"} & set((r[1] or "").split())]
    want = clean
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (lambda r: clean, exact, near, mixed, packed), strict=True):
        docs = corpus_pipeline.common.staged(stage(spark, docs, folder), "test")
        want = plain(want)
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, want)), name
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")] or name == "packing"
    assert 300 < len(want) and len(clean) < len(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SMALL).cache()
        after = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert kept.columns == columns and set(after) <= before and after
        assert name == "mixing" or len(set(after)) == len(after)
    packed_rows = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert packed_rows.count() == kept.count()
