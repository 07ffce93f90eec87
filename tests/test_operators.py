"""Profiling, dataset, source, sink and streaming operators on hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from docaudit.operators import datasets as D
from docaudit.operators import profile as P
from docaudit.sources import jsonl, layouts, sinks


def leaves(spark, values):
    return spark.createDataFrame([(i, "label", t, v) for i, (t, v) in enumerate(values)], "sample_id long, path string, jtype string, value string")


def test_typed_values(spark):
    got = {(r["jtype"], r["value"]): r["occurrences"] for r in P.typed_values(leaves(spark, [("integer", "1"), ("string", "1"), ("integer", "1")])).collect()}
    assert got == {("integer", "1"): 2, ("string", "1"): 1}


def test_distribution(spark):
    data = leaves(spark, [("string", "Granite")] * 70 + [("string", "Granit"), ("string", "908"), ("integer", "908")])
    values = data.where("jtype = 'string'").groupBy(F.col("path").alias("field"), "value").agg(F.count(F.lit(1)).alias("n"))
    assert [(r["value"], r["suggested"], r["distance"]) for r in P.typo_candidates(values).collect()] == [("Granit", "Granite", 1)]
    assert {r["value"] for r in P.rare_values(data).collect()} == {"Granit", "908"}
    assert [r["c"] for r in P.minority(data.withColumnRenamed("jtype", "c"), "path", "c").collect()] == ["integer"]


def test_fd_rules(spark):
    rows = [("berth->pier", "N4", c, i) for i, c in enumerate(["north", "north", "south", "north"])]
    pairs = spark.createDataFrame(rows, "relation string, anchor string, dependent string, ordinal long")
    rules = P.learn_rules(pairs, support=3, confidence=0.7)
    assert [(r["dependent"], r["support"], r["confidence"]) for r in rules.collect()] == [("north", 4, 0.75)]
    assert [r["ordinal"] for r in P.rule_exceptions(pairs, rules).collect()] == [2]


def test_outliers_and_risk(spark):
    rows = spark.createDataFrame([(i, "k", float(i % 5)) for i in range(40)] + [(99, "k", 500.0)], "id long, key string, x double")
    assert [r["id"] for r in P.outliers(rows, "key", "x").collect()] == [99]
    issues = spark.createDataFrame([(1, "a", "f", "m", 50, 1), (1, "a", "f", "m", 60, 2), (1, "b", "f", "m", 25, 3), (2, "a", "f", "m", 90, 4)], "sample_id long, code string, field string, message string, severity int, emit_order int")
    once = P.dedupe_issues(issues)
    assert once.count() == 3
    assert {r["sample_id"]: r["risk"] for r in P.risk(once).collect()} == {1: 63, 2: 90}


def test_nearest_peers_brute_force(spark):
    import random

    r = random.Random(1)
    sets = {i: {f"{k}:{r.randrange(3)}": w for k, w in (("a", 1.0), ("b", 2.0), ("c", 3.0))} for i in range(40)}
    df = spark.createDataFrame([(i, f, w) for i, s in sets.items() for f, w in s.items()], "sample_id long, feature string, weight double")
    got = {}
    for x in P.nearest_peers(df).collect():
        got.setdefault(x["sample_id"], []).append((x["nth"], x["peer"], x["score"]))
    for i, s in sets.items():
        scored = sorted((-round(sh / (12 - sh), 6), j) for j, o in sets.items() if j != i and (sh := sum(w for f, w in s.items() if f in o)) > 0)[:3]
        assert sorted(got.get(i, [])) == [(n + 1, j, -v) for n, (v, j) in enumerate(scored)]


def test_split_counts(spark):
    got = D.split_by_rank(spark.range(103).withColumnRenamed("id", "k"), F.pmod(F.col("k") * 2654435761, F.lit(1 << 32)), (("train", 0.8), ("val", 0.1), ("test", 0.1)), 103)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 82, "val": 10, "test": 11}
    with pytest.raises(ValueError, match="ratios"):
        D.split_by_rank(spark.range(3), F.col("id"), (("a", 0.5), ("b", 0.2)), 3)


def test_ordinals(spark):
    rows = spark.createDataFrame([(x,) for x in (5, -3, 10**12, 7, 8)], "v long")
    assert [r["v"] for r in D.with_ordinal(rows, "v").orderBy("ordinal").collect()] == [-3, 5, 7, 8, 10**12]


def test_as_of_follows_the_log(spark):
    h = spark.createDataFrame([("m", 0, 10, 1.0), ("m", 1, 5, 2.0), ("m", 2, 20, None), ("m", 3, 20, 3.0)], "metric string, ordinal long, step long, value double")
    asked = spark.createDataFrame([("m", s) for s in (4, 5, 10, 12, 20)], "metric string, at long")
    assert {r["at"]: r["value"] for r in D.as_of(h, asked).collect()} == {4: None, 5: 2.0, 10: 1.0, 12: 2.0, 20: 3.0}


def test_jsonl_scans(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "image": "x.png"}\n\n{"id": "a", "image": "y.png"}\nnope\n{"id": "b", "image": "../z.png"}\n')
    got = {r["line"]: r["error"] for r in jsonl.check_lines(jsonl.read_lines(spark, str(tmp_path))).collect()}
    assert got == {1: None, 3: "duplicate id", 4: "malformed", 5: "path escapes"}
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        jsonl.read_strict(spark, str(tmp_path), "id string").collect()


def test_files(spark, tmp_path):
    for p in ("a/x.PNG", "a/x.json", "b/y.jpg", "annotation_audit/x.PNG"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("{}")
    files = jsonl.list_files(spark, str(tmp_path))
    assert {r["stem"] for r in files.collect()} == {"x", "y"}
    root = files.where("stem = 'y'").first()["path"].rsplit("/", 2)[0]
    wanted = spark.createDataFrame([(f"{root}/gone/x.PNG",)], "path string")
    assert jsonl.relocate(files.select("path"), wanted).first()["found"].endswith("/a/x.PNG")
    assert jsonl.hash_files(spark, str(tmp_path)).select("sha256").distinct().count() == 1
    assert jsonl.read_documents(spark, str(tmp_path)).count() == 1


def test_layouts(spark, tmp_path):
    assert layouts.detect(str(tmp_path)) == "flat" and layouts.validation_split(str(tmp_path)) is None
    (tmp_path / "train").mkdir()
    (tmp_path / "val").mkdir()
    (tmp_path / "train" / "metadata.jsonl").write_text("")
    assert layouts.detect(str(tmp_path)) == "project" and layouts.validation_split(str(tmp_path)) == "val"
    rows = spark.createDataFrame([('{"images": ["a", "b"]}',), ('{"image": "c"}',), ('{"x": 1}',)], "j string").select(layouts.image_list(F.parse_json("j")).alias("i")).collect()
    assert [r["i"] for r in rows] == [["a", "b"], ["c"], None]
    paths = spark.createDataFrame([("r/checkpoint-10",), ("r/checkpoint-9",), ("r/other",)], "path string")
    assert [r["step"] for r in layouts.checkpoints(paths).collect()] == [9, 10]
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"format_version": 1, "name": "ok", "training": {}}))
    assert layouts.load_config(str(config), ["training"])["name"] == "ok"
    with pytest.raises(ValueError, match="keys"):
        layouts.load_config(str(config), ["missing"])
    assert layouts.queue_from([{"config": "a"}, {"config": "b", "enabled": False}, {"config": "c"}], "c") == ["c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "</b>")], "id int, t string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert sorted(x for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()) == ['{"id":1,"t":null}', '{"id":2,"t":"</b>"}']
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), ["t", "id"])
    assert jsonl.read_csv(spark, str(tmp_path / "c")).columns == ["t", "id"]
    assert sinks.write_review_page(df, str(tmp_path / "r.html")) == 2 and "<\\/b>" in (tmp_path / "r.html").read_text()
    values = spark.createDataFrame([(1, "f", "a"), (2, "f", "b")], "sample_id int, field string, value string")
    changes = spark.createDataFrame([(1, "f", "a", "z")], "sample_id int, field string, old string, new string")
    assert {r["value"] for r in sinks.apply_changes(values, changes, str(tmp_path / "v")).collect()} == {"z", "b"}
    with pytest.raises(Exception, match="stale"):
        sinks.apply_changes(values, changes.withColumn("old", F.lit("q")), str(tmp_path / "w"))
    assert sinks.merge_manifests([changes, changes]).count() == 1
    status = sinks.RunStatus(str(tmp_path / "s.json"), "run")
    assert status.write("completed", rows=1)["status"] == "completed" and json.loads((tmp_path / "s.json").read_text())["metrics"] == {"rows": 1}


def test_streaming(spark, tmp_path):
    from docaudit import streaming as ST

    src = tmp_path / "in"
    for n in range(2):
        spark.createDataFrame([(n, "a", 1.0, f"2024-01-0{1 + n}"), (n, "a", 1.0, f"2024-01-0{1 + n}")], "k int, event_type string, value double, d string").select("k", "event_type", "value", F.to_timestamp("d").alias("ts")).coalesce(1).write.parquet(f"{src}/{n}")
    schema = "k int, event_type string, value double, ts timestamp"
    stream = ST.stream_table(spark, f"{src}/*", schema)
    q = ST.write_previews(ST.first_seen(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out" / "*")).count() == 2
    agg = ST.windowed_metrics(ST.stream_table(spark, f"{src}/*", schema)).writeStream.format("memory").queryName("agg").outputMode("complete").trigger(availableNow=True).start()
    agg.awaitTermination()
    assert {r["n"] for r in spark.table("agg").collect()} == {2}
