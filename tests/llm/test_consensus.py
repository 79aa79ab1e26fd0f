import random
from datetime import datetime

import pytest

from anchorline.llm import consensus

SCHEMA = "user_id string, folder string, exported_at timestamp_ntz, instance_id_to_label_to_value map<string,array<array<struct<name:string,value:string>>>>"


def state(user, labels, day=1, folder=None):
    return (user, folder or f"f_{user}", datetime(2025, 1, day) if day else None, {k: v if v is None or isinstance(v, list) else [[(v, "true")]] for k, v in labels.items()})


def run(spark, rows):
    items, people = consensus.discover(spark.createDataFrame(rows, SCHEMA))
    return {r.instance_id: r for r in items.collect()}, {r.user_id: r for r in people.collect()}, people


def test_labels(spark):
    rows = [state("a", {"1": " yes ", "2": "NO", "x": "YES", "3": None, "4": [], "5": [[]], "6": [[(" ", "t")]]}, 2), state("a", {"1": "NO"}, 1), state("a", {"1": "NO"}, None), state("", {"1": "YES"}, folder="dir"), state(None, {"1": "YES"}, folder="dir2")]
    got = sorted((r.user_id, r.instance_id, r.label) for r in consensus.annotator_labels(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("a", 1, "YES"), ("a", 2, "NO"), ("dir", 1, "YES"), ("dir2", 1, "YES")]


def test_majority_needs_three_labels_and_no_tie(spark):
    rows = [state(u, x) for u, x in (("a", {"1": "Y", "2": "Y", "3": "Y"}), ("b", {"1": "Y", "2": "N", "3": "Y"}), ("c", {"1": "N", "2": "U"}))]
    items, people, _ = run(spark, rows)
    assert items[1].majority == "Y" and items[2].majority is None and items[3].majority is None
    assert (people["c"].n_judged, people["c"].n_agree) == (1, 0) and items[1].pair_agreement == pytest.approx(1 / 3)


def test_unreliable_annotator_is_found_and_outweighed(spark):
    truth = {str(i): "Y" if i % 2 else "N" for i in range(40)}
    flip = {k: "N" if v == "Y" else "Y" for k, v in truth.items()}
    rows = [state(u, truth) for u in "abc"] + [state("bad", flip), state("few", {"0": "N"})]
    items, people, df = run(spark, rows)
    assert [r.user_id for r in consensus.unreliable(df).collect()] == ["bad"]
    assert people["a"].weight > 10 * people["bad"].weight and people["few"].weight < people["a"].weight
    assert all(items[int(k)].label == v for k, v in truth.items())


def test_weights_beat_the_majority(spark):
    """Two sound annotators against three poor ones: the poor ones are found out by the items on which they disagree among themselves."""
    truth = {str(i): "Y" if i % 3 else "N" for i in range(60)}
    poor = [{k: ("Y" if (int(k) * 7 + s * 5) % 4 else "N") if int(k) < 50 else "U" for k in truth} for s in range(3)]
    items, people, _ = run(spark, [state("a", truth), state("b", truth), state("c", truth), *[state(f"p{s}", p) for s, p in enumerate(poor)]])
    assert min(people[u].weight for u in "abc") > max(people[f"p{s}"].weight for s in range(3))
    assert sum(items[int(k)].label == v for k, v in truth.items()) == 60


def test_sixty_percent_is_enough(spark):
    truth = {str(i): "Y" for i in range(5)}
    rows = [state(u, truth) for u in "abc"] + [state("d", truth | {"0": "N", "1": "N"}), state("e", truth | {"0": "N", "1": "N", "2": "N"})]
    assert [r.user_id for r in consensus.unreliable(run(spark, rows)[2]).collect()] == ["e"]


def test_end_of_the_iteration(spark):
    """Labels stay the same from round to round, and weights are those of the labels that are returned."""
    rnd = random.Random(4)
    rows = [state(f"u{k}", {str(i): "YNU"[(i + (rnd.random() < k / 12) * rnd.randrange(3)) % 3] for i in range(50) if rnd.random() < 0.5}) for k in range(12)]
    items, people, _ = run(spark, rows)
    assert all(r.settled for r in items.values())
    flat = [(u, int(i), v[0][0][0]) for u, _, _, m in rows for i, v in m.items()]
    for u, p in people.items():
        assert p.errors == sum(x == u and items[i].label != v for x, i, v in flat)
    df = spark.createDataFrame(rows, SCHEMA)
    stopped = consensus.discover(df, max_rounds=1)[0].collect()
    assert any(not r.settled for r in stopped) or all(items[r.instance_id].label == r.label for r in stopped)


def test_large_sides_are_joined_alike(spark, monkeypatch):
    rows = [state(u, {str(i): "Y" if i % k else "N" for i in range(30)}) for k, u in enumerate("abcd", 2)]
    want = run(spark, rows)[:2]
    monkeypatch.setattr(consensus, "bounded", lambda df: False)
    assert run(spark, rows)[:2] == want


def test_empty_and_clashing(spark):
    items, people = consensus.discover(spark.createDataFrame([], SCHEMA))
    assert items.count() == 0 and people.count() == 0
    assert consensus.annotator_labels(spark.createDataFrame([("a", "f", None, None)], SCHEMA)).count() == 0
    df = spark.createDataFrame([state("a", {"1": "Y"})], SCHEMA).selectExpr("*", "'z' as USER_ID", "'q' as label")
    assert consensus.annotator_labels(df).first().user_id == "a"


def test_chi_square_quantile(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(consensus._chi_square_low(F.lit(10)).alias("a"), consensus._chi_square_low(F.lit(100)).alias("b"), consensus._chi_square_low(F.lit(1)).alias("c")).first()
    assert r.a == pytest.approx(3.247, rel=0.03) and r.b == pytest.approx(74.22, rel=0.01) and 0 < r.c < 0.1
