import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorline.llm import splits

SCHEMA = "instance_id bigint, mention string, answer string"


def brute(rows):
    import re

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, m, a in rows:
        if i is None:
            continue
        find(("i", i))
        m = re.sub(r"\s+", "", re.sub(r"\s*\([^()]*\)\s*$", "", m)).lower() if m is not None else ""
        for k in [("m", m)] * bool(m) + [("a", a)] * (a is not None):
            parent[find(k)] = find(("i", i))
    groups = {}
    for i in {r[0] for r in rows} - {None}:
        groups.setdefault(find(("i", i)), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def found(spark, rows):
    return {r.instance_id: (r.group_id, r.group_size) for r in splits.groups(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_keys(spark):
    texts = ["Port  Resud (river) ", "port\xa0resud", "PORT RESUD [band]", "portresud", "(x)", " ", None, "A (b) c"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(splits.mention_key(F.col("t"))).collect()]
    assert got == ["portresud"] * 4 + [None] * 3 + ["a(b)c"]


def test_chain_and_hot_mention(spark):
    rows = [(i, f"m{i // 2}", f"a{(i + 1) // 2}") for i in range(40)] + [(100 + i, "hot", f"b{i}") for i in range(60)] + [(200, None, None), (201, None, None), (202, "", "z"), (None, "hot", "z")]
    rows += rows[:3] + [(300, "m0", None), (300, None, "c"), (301, "x", "c")]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(60), f"m{rnd.randrange(50)}" if rnd.random() < 0.9 else None, f"a{rnd.randrange(50)}" if rnd.random() < 0.9 else None) for _ in range(60)]
    assert found(spark, rows) == brute(rows)


def test_rendezvous_proportions_and_stability(spark):
    keys = spark.range(20000).withColumnRenamed("id", "group_id")
    a = {r.group_id: r.split for r in splits.assign(keys).collect()}
    n = Counter(a.values())
    assert abs(n["train"] / 20000 - 0.8) < 0.02 and abs(n["test"] / 20000 - 0.1) < 0.02
    b = {r.group_id: r.split for r in splits.assign(keys, splits.SPLITS | {"extra": 0.2}).collect()}
    assert all(b[k] in (v, "extra") for k, v in a.items())


def test_empty_and_clashing(spark):
    assert splits.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", "x"), (2, "A", "y")], SCHEMA).selectExpr("*", "1 as INSTANCE_ID", "2 as a", "'q' as m")
    assert {(r.instance_id, r.group_id) for r in splits.groups(df).collect()} == {(1, 1), (2, 1)}
