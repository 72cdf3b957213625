"""Vectors, models, logs, costs and previews, each against what was put in."""

import json

import numpy as np

from sluice.operators import costs, ml
from sluice.sources import files, logs, models, reports, vectors


def test_vectors_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(200)], "row_id long, text string")
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    made = vectors.encoded(rows.coalesce(2), "text", load, batch=7)
    vectors.write_vectors(made.where("row_id < 190"), str(tmp_path), "one", "small")
    back = vectors.read_vectors(spark, str(tmp_path), "one", "small")
    assert loads.value == 2
    assert {r["row_id"]: list(r["vec"]) for r in vectors.of_rows(rows, back).collect()} == {i: [float(len(f"t{i}") if i else 0), 1.0] for i in range(190)}
    assert {(r["side"], r["row_id"]) for r in vectors.lacking(rows.where("row_id > 0"), back).collect()} == {("no row", 0)} | {("no vector", i) for i in range(190, 200)}
    assert [tuple(r) for r in vectors.present(spark, str(tmp_path)).collect()] == [("one", "small")]


def test_models_and_one_score(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) + 4 * (i % 2) for x in rng.normal(size=3)], float(i % 2)) for i in range(80)]
    train = ml.with_vector(spark.createDataFrame(data, "row_id long, a array<double>, label double"), "a")
    model = ml.fit(train, "LogisticRegression")
    for emb in ("small", "strange"):
        reports.save_model(model, models.run_folder(str(tmp_path), 1, "normal"), emb, "LogisticRegression")
    found = models.available(spark, str(tmp_path), ["small"]).collect()
    assert [(r["pipeline"], r["mode"], r["emb"], r["clf"]) for r in found] == [(1, "normal", "small", "LogisticRegression")]
    encode = lambda rows: rows.selectExpr("case when text like '%bad%' then array(4.0, 4.0, 4.0) else array(0.0, 0.0, 0.0) end as vec")
    ask = lambda mode, intent, context: models.live_score(spark, str(tmp_path), (1, mode, "small", "LogisticRegression"), intent, context, encode, ["small"])
    assert ask("normal", "q", "bad")["verdict"] == "malicious" and ask("normal", "q", "good")["verdict"] == "benign"
    assert "error" in ask("context_only", "q", "bad")
    reports.save_model(model, models.run_folder(str(tmp_path), 1, "context_only"), "small", "LogisticRegression")
    assert ask("context_only", "bad", "  ")["error"] == "empty input" and ask("context_only", "bad", "fine")["verdict"] == "benign"


def test_log_from_an_offset(spark, tmp_path):
    path = tmp_path / "job.log"
    state, lines = logs.tail(spark, str(path))
    assert state == logs.State() and lines == []
    whole = 'start\n50%|##\r##step {"label": "föö"}\nnoise ##progress {"phase": "p", "done": 1}\n##step {broken\n##step {"label": "b"}\nrest ##progress {"phase": "q"}\n'.encode()
    want, _ = logs.fold(logs.State(), whole)
    assert (want.step, want.label, want.phase, want.held) == (2, "b", {"phase": "q"}, b"")
    got, seen = logs.State(), []
    for cut in (3, 24, 36, 37, 60, len(whole) - 1, len(whole)):  # inside a line, a marker and a character
        path.write_bytes(whole[:cut])
        got, more = logs.tail(spark, str(path), got)
        seen += more
    assert got == want and seen == whole.decode().replace("\r", "\n").split("\n")[:-1]


def test_progress_is_throttled():
    said, now = [], iter(np.arange(0, 100, 0.4))
    assert list(logs.tracked(range(10), "p", 10, said.append, clock=lambda: next(now))) == list(range(10))
    done = [json.loads(s.split(" ", 1)[1])["done"] for s in said]
    assert done[0] == 0 and done[-1] == 10 and len(done) < 8 and done == sorted(done)


def test_costs(spark):
    with costs.measured() as cost:
        sum(i * i for i in range(400_000))
    assert cost.wall_seconds > 0 and cost.cpu_seconds > 0 and cost.peak_mb >= 0
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, v double")
    asked, ticks = [], iter(range(10_000))
    samples = costs.probe(asked.append, rows, "id", "v", n=30, warm_up=4, clock=lambda: next(ticks))
    assert len(asked) == 34 and set(asked) <= {float(i) for i in range(5)}
    assert [tuple(r) for r in costs.latency(samples).collect()] == [(1000.0, 1000.0, 1000.0, 1000.0, 1000.0, 30)]
    assert costs.probe(asked.append, rows, "id", "v", n=0).count() == 0 and costs.probe(asked.append, rows.limit(0), "id", "v").count() == 0
    assert {"spark", "python", "master"} <= {r["name"] for r in costs.environment(spark).collect()}


def test_components(spark):
    x = np.random.default_rng(5).normal(size=(60, 4)) * [5, 3, 1, 0.1] + 7
    rows = ml.with_vector(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, a array<double>"), "a")
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt = [v if v[abs(v).argmax()] > 0 else -v for v in vt[:2]]
    got = {r["row_id"]: (r["x"], r["y"]) for r in ml.pca_2d(rows).collect()}
    assert all(np.allclose(got[i], [c @ v for v in vt], atol=1e-5) for i, c in enumerate(centred))
    assert np.allclose([r["share"] for r in ml.pca_variance(rows).orderBy("component").collect()], (s**2 / (s**2).sum())[:2], atol=1e-8)


def test_files(spark, tmp_path):
    preds = spark.createDataFrame([(p, m, i) for p in (1, 2) for m in ("normal", "context_only") for i in range(5)], "pipeline int, mode string, row_id long")
    files.write_predictions(preds, f"{tmp_path}/p")
    one = files.read_predictions(spark, f"{tmp_path}/p", 1, "normal")
    assert one.count() == 5 and len(one.inputFiles()) < 20 and files.read_predictions(spark, f"{tmp_path}/p").count() == 20
    assert files.metadata(spark.createDataFrame([("a", 1, "t")], "source string, label int, text string")).columns == ["source", "label"]
    files.write_samples(spark.createDataFrame([(2, "b\nc"), (1, "a")], "id int, sample string"), f"{tmp_path}/s", "id")
    assert "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/s").collect()) == "--- sample 1 ---\na\n--- sample 2 ---\nb\nc"
    for part, n in (("train", 3), ("test", 2)):
        spark.range(n).withColumnRenamed("id", part).write.parquet(f"{tmp_path}/h/{part}")
    files.copy_table(spark, f"{tmp_path}/h", f"{tmp_path}/j", "parquet", ["train", "test"])
    assert spark.read.json(f"{tmp_path}/j").count() == 5
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"k": i, "t": "x" * 900}) for i in range(9)))
    (tmp_path / "a.csv").write_text("a,b\n" + "\n".join(f"{i}," for i in range(20)))
    (tmp_path / "a.md").write_text("y" * 5000)
    (tmp_path / "a.bin").write_bytes(b"0" * 2_345_678)
    look = lambda name: [r["value"] for r in reports.inspect(spark, f"{tmp_path}/{name}").orderBy("line").collect()]
    assert [len(v) for v in look("a.jsonl")] == [600] * 3
    assert look("a.csv") == [json.dumps({"a": i, "b": None}, separators=(",", ":")) for i in range(10)]
    assert look("a.md") == ["y" * 4000 + "\n… (truncated)"] and look("a.bin") == ["2.35 MB"]
    preds.write.parquet(f"{tmp_path}/t.parquet")
    assert look("t.parquet") == ["pipeline int, mode string, row_id bigint · 20 rows"]
    (info,) = reports.file_info(reports.listing(spark, str(tmp_path), "a.bin")).collect()
    assert (info["size"], info["size_mb"]) == (2_345_678, 2.35) and isinstance(info["mtime"], int)
