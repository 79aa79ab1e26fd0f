import json

import pytest
from pyspark.sql.types import StructType

from anchorline.operators.skew import plan_load
from anchorline.plans import evaluate, split
from anchorline.sources import io
from anchorline.streaming.resume import process_new



def test_jsonl_round_trip_and_policies(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("é", 2)], "k string, n int")
    io.write_jsonl(df, str(tmp_path / "x"))
    assert sorted(map(str, io.read_jsonl(spark, str(tmp_path / "x"), "k string, n int").collect())) == sorted(map(str, df.collect()))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"k": "a", "n": 1}\n\nnot json\n')
    assert io.read_jsonl(spark, str(bad), "k string, n int", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(bad), "k string, n int").collect()


def test_maps_optional_and_required(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"Q1": {"name": "x"}, "Q2": null}')
    rows = {r.key: r.value and r.value.name for r in io.read_json_map(spark, str(p), "struct<name:string>").collect()}
    assert rows == {"Q1": "x", "Q2": None}
    assert io.optional(spark, str(tmp_path / "none.jsonl"), "k string").count() == 0
    with pytest.raises(FileNotFoundError):
        io.require(spark, str(tmp_path / "none"))


def test_dataset_fallback_and_states(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"k": "a"}, {"k": "b"}]')
    assert io.read_dataset(spark, str(tmp_path / "d"), "k string").count() == 2
    (tmp_path / "d.jsonl").write_text('{"k": "a"}\n')
    assert io.read_dataset(spark, str(tmp_path / "d"), "k string").count() == 1
    (tmp_path / "ann" / "eva").mkdir(parents=True)
    (tmp_path / "ann" / "eva" / "user_state.json").write_text('{"user_id": null}')
    assert io.read_user_states(spark, str(tmp_path / "ann"), "user_id string").first().folder == "eva"


def test_zip_lines(spark, tmp_path):
    from pyspark.sql.types import StructType

    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"x": 1}\n{"x": 2}\n')
    b.write_text('{"y": 3}\n{"y": 4}\n')
    sa, sb = StructType.fromDDL("x int"), StructType.fromDDL("y int")
    assert [(r.a.x, r.b.y) for r in io.zip_lines(spark, str(a), str(b), sa, sb).collect()] == [(1, 3), (2, 4)]
    b.write_text('{"y": 3}\n')
    with pytest.raises(ValueError):
        io.zip_lines(spark, str(a), str(b), sa, sb)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("ä", 2)], "k string, v int")
    io.write_map(df, str(tmp_path / "m.json"), "k", "v")
    assert json.loads((tmp_path / "m.json").read_text()) == {"b": 1, "ä": 2}
    with pytest.raises(ValueError):
        io.write_map(df, str(tmp_path / "m.json"), "k", "v", most=1)
    io.write_manifest(spark, str(tmp_path / "manifest.json"), "1", {"a": 1}, {"n": 2})
    assert json.loads((tmp_path / "manifest.json").read_text())["counts"] == {"n": 2}
    many = spark.range(100).selectExpr("'<r' || id || '>' as k")
    io.write_viewer(many, str(tmp_path / "v.html"), "<t>", "k", most=10)
    page = (tmp_path / "v.html").read_text()
    assert "&lt;t&gt;" in page and page.count("&lt;r") == 10 and "oninput" in page
    io.write_viewer(many, str(tmp_path / "w.html"), "<t>", "k", most=10)
    assert (tmp_path / "w.html").read_text() == page
    io.write_table(df.orderBy("v"), str(tmp_path / "t.txt"))
    assert (tmp_path / "t.txt").read_text().splitlines() == ["k  v", "----", "b  1", "ä  2"]
    io.write_tsv(df, str(tmp_path / "t"))


def test_completed_items(spark, tmp_path):
    store = io.Completed(spark, str(tmp_path / "done"))
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    assert store.pending("s", items, "k").count() == 2
    store.mark("s", items.filter("k = 'a'"), "k")
    assert [r.k for r in store.pending("s", items, "k").collect()] == ["b"]
    assert store.pending("other", items, "k").count() == 2


def test_new_files_are_processed_once(spark, tmp_path):
    src, sink, at = (str(tmp_path / x) for x in ("src", "sink", "check"))
    for i in range(2):
        spark.createDataFrame([(i,)], "n int").write.mode("append").parquet(src)
        process_new(spark, src, "n int", lambda df: df.selectExpr("n * 10 as n"), sink, at)
    assert sorted(r.n for r in spark.read.parquet(sink).select("n").collect()) == [0, 10]


def test_plan_of_one_task(spark):
    assert plan_load(spark.createDataFrame([("a",)] * 10, "k string"), "k", 1).tasks == 1


def test_split_and_predictions(spark, tmp_path):
    kb = spark.createDataFrame([("Q1", None)], "qid string, name string")
    rows = spark.createDataFrame([("m", "Q1"), ("n", "Q1")], "mention string, answer string")
    assert io.write_split(kb, rows, str(tmp_path / "s")) == {"kb": 1, "instances": 2}
    assert spark.read.json(str(tmp_path / "s" / "instances")).count() == 2
    preds = spark.createDataFrame([(1, 1, 2), (None, 1, 4)], "number int, label int, pool_size int")
    out = io.write_predictions(preds, evaluate.accuracy(preds), str(tmp_path / "p"), {"model": "none", "limit": 2})
    kept = json.loads((tmp_path / "p" / "metrics.json").read_text())
    assert kept == out and kept["accuracy"] == 0.5 and kept["n_unparsed"] == 1 and kept["meta"]["config"]["limit"] == 2
    assert spark.read.json(str(tmp_path / "p" / "predictions")).count() == 2


def test_config_gives_rules(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"min_side": 100, "types": ["PERS"], "max_visual": 3}')
    rules = split.SplitRules.of(io.read_config(spark, str(tmp_path / "c.json")))
    assert (rules.min_side, rules.types, rules.max_visual, rules.min_pool) == (100, ("PERS",), 3, 2)
    with pytest.raises(TypeError):
        split.SplitRules.of({"no_such_rule": 1})


def test_lines_of_several_parts_are_zipped_in_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f'{{"x": {i}}}\n' + "\n" * (name == "a" and i % 7 == 0) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = io.zip_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"), StructType.fromDDL("x int"), StructType.fromDDL("x int")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.n, r.a.x, r.b.x) for r in got] == [(i, i, i) for i in range(5000)]
