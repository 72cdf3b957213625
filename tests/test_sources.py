"""Round trips of sources and sinks, requests, streaming state."""

import json

import pytest

from sluice.operators import requests
from sluice.sources import files, reports
from sluice.streaming import jobs


def test_corpus_round_trip(spark, tmp_path):
    rows = [(f"text {i}", None if i % 3 else "intent", i % 2, "s") for i in range(50)]
    frame = spark.createDataFrame(rows, files.CORPUS).coalesce(1)
    files.write_corpus(frame, f"{tmp_path}/c")
    back = files.read_corpus(spark, f"{tmp_path}/c").orderBy("row_id").collect()
    assert [r["row_id"] for r in back] == list(range(50)) and [tuple(r)[1:] for r in back] == rows
    assert files.head(files.read_corpus(spark, f"{tmp_path}/c"), 7).count() == 7


def test_attack_pool(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a": ["x", "y"], "b": ["z"]}))
    got = files.read_attack_pool(spark, f"{tmp_path}/p.json", "text", "train").collect()
    assert sorted((r["category"], r["instruction"]) for r in got) == [("a", "x"), ("a", "y"), ("b", "z")]
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_attack_pool(spark, f"{tmp_path}/e.json", "text", "train")


def test_results_and_summaries(spark, tmp_path):
    one, two = spark.createDataFrame([("a", 0.5)], "clf string, auc double"), spark.createDataFrame([("b\"c", 1)], "clf string, n int")
    files.write_results(one, f"{tmp_path}/1")
    files.write_results(two, f"{tmp_path}/2")
    got = files.read_results(spark, {(1, "normal"): f"{tmp_path}/1", (2, "normal"): f"{tmp_path}/2"})
    assert sorted(map(str, got.columns)) == sorted(["Pipeline", "Mode", "clf", "auc", "n"]) and got.count() == 2
    reports.write_summary(spark.createDataFrame([(float("nan"), 1.0)], "x double, y double"), f"{tmp_path}/s")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/s").collect()] == ['{"x":null,"y":1.0}']
    (tmp_path / "bad.json").write_text("{broken")
    assert [r["x"] for r in reports.read_summary(spark, f"{tmp_path}/bad.json", "x double").collect()] == [None]
    assert "0.5000" in reports.html_table(one)
    assert len(reports.preview(spark, f"{tmp_path}/1", 1, 3).first()["value"]) == 3
    wanted = spark.createDataFrame([("bad.json",), ("none.json",)], "name string")
    assert {r["name"]: r["status"] for r in reports.artifact_grid(wanted, reports.listing(spark, str(tmp_path), "*.json")).collect()} == {"bad.json": "present", "none.json": "missing"}


def test_requests(spark):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer = requests.Pacer(100, lambda: now[0], sleep)
    for n in (60, 40, 10, 500, 1):
        pacer.spend(n)
    assert slept == [60, 60, 60]

    class Busy(Exception):
        retry_after = 3

    tries = []

    def client(texts):
        tries.append(1)
        if len(tries) < 3:
            raise Busy if len(tries) == 1 else ValueError
        return [[float(len(t))] for t in texts]

    slept.clear()
    assert requests.asked(client, ["ab"], requests.Limits(), sleep) == [[2.0]] and slept == [3.0, 2.0]
    with pytest.raises(ValueError):
        requests.asked(lambda t: [float(x) for x in t], ["a"], requests.Limits(tries=2), sleep)
    assert requests.truncated("a b c", 2) == ("a b", 2) and requests.truncated("  ", 5) == (" ", 1) and requests.truncated(None, 5) == (" ", 1)
    rows = spark.createDataFrame([(i, "w " * i) for i in range(30)], "id long, t string")
    got = requests.embed(rows, "id", "t", lambda: lambda texts: [[float(len(t)), float(len(texts))] for t in texts], requests.Limits(request_tokens=40, request_texts=4), 2).collect()
    assert sorted(r["id"] for r in got) == list(range(30)) and all(r["vec"][1] <= 4 for r in got) and {r["id"]: r["vec"][0] for r in got}[5] == 10


def test_streamed_job_state(spark, tmp_path):
    step, phase = '##step {"label": "%s"}', 'noise ##progress {"phase": "%s"}'
    parts = [[(1, 1, step % "a"), (1, 2, phase % "p"), (2, 1, phase % "early"), (1, 3, "##step {broken")], [(1, 4, step % "b"), (2, 2, step % "x"), (2, 3, phase % "q")]]
    source = tmp_path / "in"
    source.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "job long, line_no long, value string").coalesce(1).write.mode("append").json(str(source / str(i)))
    lines = spark.readStream.schema("job long, line_no long, value string").option("maxFilesPerTrigger", 1).json(f"{source}/*")
    query = jobs.job_states(lines).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("job_states").collect():
        last[r["job"]] = max(last.get(r["job"], (0,)), (r["step"], r["label"], r["phase"] or ""))
    assert last == {1: (2, "b", ""), 2: (1, "x", "q")}
