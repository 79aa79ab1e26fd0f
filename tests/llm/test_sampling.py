import hashlib
from collections import Counter

from anchorline.llm import sampling

INSTANCES, KB = "instance_id bigint, answer string", "qid string, type string"
TARGETS = "sample_id int, type string, target_share double, sample_frac double, min_rows int"


def data(spark, n=6000):
    kb = spark.createDataFrame([("Q1", "pers "), ("Q1", "pers "), ("Q2", "ORG"), ("Q3", " "), ("Q4", None), (None, "LOC")], KB)
    answers = ["Q1"] * 5 + ["Q2"] * 3 + ["Q3", "Q4", None, "Q9"]
    rows = [(i, answers[i % len(answers)]) for i in range(n)]
    return spark.createDataFrame(rows + rows[: n // 10] + [(None, "Q1")], INSTANCES), kb


def test_types_and_exact_quotas(spark):
    instances, kb = data(spark)
    targets = spark.createDataFrame([(1, "PERS", 0.5, 0.5, 1), (1, "ORG", 0.3, 0.5, 1), (1, "OTHER", 0.2, 0.5, 1), (2, "ORG", 1.0, 0.9, 1), (2, "LOC", 0.0, 0.9, 1)], TARGETS)
    sample, report = sampling.matched_sample(instances, kb, targets)
    r = {(x.sample_id, x.type): x for x in report.collect()}
    assert r[1, "PERS"].available == 2500 and r[1, "ORG"].available == 1500 and r[1, "OTHER"].available == 2000
    assert {k for k, x in r.items() if x.exhausted} == {(2, "ORG"), (2, "LOC")}
    rows = sample.collect()
    assert Counter((x.sample_id, x.type) for x in rows) == {(1, "PERS"): 1500, (1, "ORG"): 900, (1, "OTHER"): 600, (2, "ORG"): 1500}
    assert len({(x.sample_id, x.instance_id) for x in rows}) == len(rows)


def test_repeatable_and_uniform(spark):
    instances, kb = data(spark, 4000)
    targets = spark.createDataFrame([(1, "PERS", 1.0, 0.2, 0)], TARGETS)
    a, b = (sorted(map(tuple, sampling.matched_sample(instances, kb, targets)[0].collect())) for _ in range(2))
    assert a == b
    half = sum(x[1] < 2000 for x in a) / len(a)
    assert 0.4 < half < 0.6


def test_edges(spark):
    instances, kb = data(spark, 120)
    none = spark.createDataFrame([], TARGETS)
    assert sampling.matched_sample(instances, kb, none)[0].count() == 0
    odd = spark.createDataFrame([(None, "PERS", 0.5, 0.5, 1), (3, None, 0.1, 0.5, None), (4, "ORG", None, None, None), (4, "ORG", None, None, None)], TARGETS)
    report = sampling.matched_sample(instances, kb, odd)[1].collect()
    assert len(report) == 3
    empty = spark.createDataFrame([], INSTANCES)
    got = sampling.matched_sample(empty, kb.limit(0), spark.createDataFrame([(1, "ORG", 1.0, 0.5, 2)], TARGETS))
    assert got[0].count() == 0 and got[1].first().exhausted
    clash = instances.selectExpr("*", "'x' as TYPE", "'y' as ANSWER", "1 as __task")
    assert sampling.typed_instances(clash, kb).count() == sampling.typed_instances(instances, kb).count()


def test_unlucky_reservoirs_are_filled_again(spark, monkeypatch):
    """Bounds that are far too low, and rows marked as sure that aren't: the sample stays the same."""
    instances, kb = data(spark, 3000)
    targets = spark.createDataFrame([(1, "PERS", 0.5, 0.5, 1), (1, "ORG", 0.3, 0.5, 1), (2, "OTHER", 1.0, 0.3, 1)], TARGETS)
    want = sorted(map(tuple, sampling.matched_sample(instances, kb, targets)[0].collect()))
    for sigmas, spare in ((0.0, -200.0), (6.0, 30.0), (-20.0, 0.0)):
        monkeypatch.setattr(sampling, "SIGMAS", sigmas)
        monkeypatch.setattr(sampling, "SPARE", spare)
        assert sorted(map(tuple, sampling.matched_sample(instances, kb, targets)[0].collect())) == want


def test_least_priorities_by_brute_force(spark):
    instances, kb = data(spark, 5000)
    targets = spark.createDataFrame([(1, "PERS", 0.5, 0.5, 1), (2, "ORG", 1.0, 0.1, 1)], TARGETS)
    got = sampling.matched_sample(instances, kb, targets)[0].collect()
    of = {"PERS": [i for i in range(5000) if i % 12 < 5], "ORG": [i for i in range(5000) if 5 <= i % 12 < 8]}
    for sample, kind, n in ((1, "PERS", 1250), (2, "ORG", 500)):
        want = sorted(of[kind], key=lambda i: hashlib.md5(f"{sample}:{i}:{sampling.SEED}".encode()).hexdigest())[:n]
        assert {x.instance_id for x in got if x.sample_id == sample} == set(want)
