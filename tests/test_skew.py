from collections import defaultdict

from pyspark.sql import functions as F

from anchorline.operators.skew import TASK, balanced_distinct_counts, pack, plan_load, plan_pairs, safe_join, skew_join
from anchorline.operators.usage import usage_by_url

SCHEMA = "url string, qid string, n_used_by int"


def brute(rows):
    out = defaultdict(lambda: [0, set(), None])
    for u, q, n in rows:
        if u is None:
            continue
        o = out[u]
        o[0] += 1
        if q is not None:
            o[1].add(q)
        if n is not None:
            o[2] = n if o[2] is None else max(n, o[2])
    return {u: (o[0], len(o[1]), o[2]) for u, o in out.items()}


def hot_rows():
    rows = [("hot", f"Q{i % 700}", 700 if i % 3 else None) for i in range(3000)]
    rows += [(f"u{i % 200}", f"Q{i % 7}", i % 5) for i in range(3000)]
    rows += [("copies", "Q1", 2)] * 1500 + [("unresolved", None, None)] * 900 + [(None, "Q1", 1)] * 50
    return rows


def test_counts_equal_brute_force(spark):
    rows = hot_rows()
    got = balanced_distinct_counts(spark.createDataFrame(rows, SCHEMA), "url", "qid", ["n_used_by"])
    assert {r.url: (r.n_rows, r.n_distinct, r.max_n_used_by) for r in got.collect()} == brute(rows)


def test_hot_key_is_split_and_load_is_even(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA)
    plan = plan_load(df, "url", 8)
    assert "hot" in plan.heavy and len(plan.heavy["hot"]) > 1
    by = df.filter("url is not null").withColumn("salt", F.monotonically_increasing_id())
    loads = [r["count"] for r in plan.route(by, "url", F.col("salt")).groupBy(TASK).count().collect()]
    assert max(loads) < 2 * sum(loads) / len(loads)


def test_join_equals_plain_join(spark):
    left = spark.createDataFrame(hot_rows(), SCHEMA).select("url", "qid")
    right = spark.createDataFrame([("hot", 1), ("u1", 2), ("none", 3), (None, 4)], "url string, x int")
    for how in ("inner", "left"):
        a = sorted(map(str, skew_join(left, right, "url", how).select("url", "qid", "x").collect()))
        b = sorted(map(str, left.join(right, "url", how).select("url", "qid", "x").collect()))
        assert a == b


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert usage_by_url(empty).count() == 0
    assert skew_join(empty.select("url"), empty.select("url"), "url").count() == 0
    extra = spark.createDataFrame([("a", "Q1", 2, "x", 1)], "url string, qid string, n_used_by int, URL string, __task int")
    row = usage_by_url(extra).first()
    assert (row.url, row.n_rows, row.n_entities, row.n_reported, row.differs) == ("a", 1, 1, 2, True)


def test_nothing_reported_is_no_case(spark):
    row = usage_by_url(spark.createDataFrame([("a", "Q1", None)], SCHEMA)).first()
    assert row.differs is None


def test_pack_puts_the_longest_first():
    at = pack({"a": 6, "b": 3, "c": 3}, 2)
    assert at["b"] == at["c"] != at["a"]


def test_null_keys_are_spread(spark):
    df = spark.createDataFrame([(None, i) for i in range(4000)] + [("a", 1)], "k string, i int")
    plan = plan_load(df, "k", 8)
    loads = [r["count"] for r in plan.route(df, "k", F.col("i")).groupBy(TASK).count().collect()]
    assert len(loads) == 8 and max(loads) < 1000
    assert skew_join(df, spark.createDataFrame([("a", 5)], "k string, x int"), "k", "left").count() == 4001


def test_plan_follows_the_pairs_that_are_routed(spark):
    """A key with very many rows of few values has little to route; one with many values is split."""
    rows = [("copies", f"Q{i % 30}", 1) for i in range(7000)] + [("wide", f"Q{i}", 1) for i in range(3000)] + [(f"u{i}", "Q1", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = plan_pairs(df, "url", "qid")
    assert "wide" in plan.heavy and "copies" not in plan.heavy
    got = balanced_distinct_counts(df, "url", "qid", ["n_used_by"], plan)
    assert {r.url: (r.n_rows, r.n_distinct, r.max_n_used_by) for r in got.collect()} == brute(rows)


def test_given_total_gives_the_same_plan(spark):
    df = spark.createDataFrame(hot_rows(), SCHEMA).filter("url is not null")
    a, b = plan_load(df, "url", 8), plan_load(df, "url", 8, total=df.count())
    assert a.heavy.keys() == b.heavy.keys() and a.bins == b.bins


def test_safe_join_equals_plain_join(spark):
    left = spark.createDataFrame(hot_rows(), SCHEMA).select("url", "qid")
    right = spark.createDataFrame([("hot", 1), ("u1", 2)], "url string, x int")
    assert safe_join(left, right, "url").count() == left.join(right, "url").count()
