import pytest

from anchorline.llm import mixing

DOCS = "doc_id bigint, text string, source string"
TARGETS = "mix_id int, source string, target_share double, max_repeats int, budget_frac double"


def data(spark):
    rows = [(i, "word " * (1 + i % 7), ("Big ", "big", "mid", "small")[0 if i < 500 else 1 if i < 900 else 2 if i < 1000 else 3]) for i in range(1020)]
    return spark.createDataFrame([*rows, (2000, "lost " * 900, None), (2001, None, "mid"), (2002, "", "mid")], DOCS)


def test_prefix_sums_cover_each_source(spark):
    tokens = mixing.token_counts(data(spark))
    places = mixing.prefix_sums(tokens).collect()
    assert len(places) == 1022
    by = {}
    for r in places:
        by.setdefault(r.source, []).append((r.upto, r.n_tokens))
    assert set(by) == {"big", "mid", "small"}
    for rows in by.values():
        rows.sort(key=lambda x: (x[0], -x[1]))
        total = 0
        for upto, n in rows:
            total += n
            assert upto == total


def test_budgets_and_report(spark):
    from anchorline.session import cut

    tokens = cut(mixing.token_counts(data(spark)))
    targets = spark.createDataFrame([(1, "BIG", 0.6, 1, 0.5), (1, "mid", 0.3, 4, 0.5), (1, "small", 0.09, 2, 0.5), (1, "absent", 0.01, 9, 0.5), (2, "big", 1.0, 1, 0.25)], TARGETS)
    plan = cut(mixing.plan_mix(tokens, targets))
    p = {(r.mix_id, r.source): r for r in plan.collect()}
    corpus = mixing.compose(mixing.prefix_sums(tokens), plan).collect()
    got = {}
    for r in corpus:
        got[r.mix_id, r.source] = got.get((r.mix_id, r.source), 0) + r.n_tokens * r.n_repeats
        assert 1 <= r.n_repeats <= {"big": 1, "mid": 4, "small": 2}[r.source]
    big = p[1, "BIG"]
    assert big.budget - 12 < got[1, "big"] <= big.budget and not big.short
    mid = p[1, "mid"]
    assert not mid.short and mid.passes >= 1 and mid.budget - 12 * 4 < got[1, "mid"] <= mid.budget
    small = p[1, "small"]
    assert small.short and got[1, "small"] == small.source_tokens * 2
    assert p[1, "absent"].short and p[1, "absent"].source_tokens == 0
    report = mixing.mix_report(mixing.compose(mixing.prefix_sums(tokens), plan), plan).collect()
    assert sum(r.reached_share for r in report if r.mix_id == 1) == pytest.approx(1)


def test_edges(spark):
    tokens = mixing.token_counts(data(spark).limit(0))
    targets = spark.createDataFrame([(1, "a", None, None, None), (None, None, 0.5, 2, 0.5)], TARGETS)
    plan = mixing.plan_mix(tokens, targets)
    assert plan.count() == 2 and plan.filter("short").count() == 0
    assert mixing.compose(mixing.prefix_sums(tokens), plan).count() == 0
    assert mixing.plan_mix(tokens, targets.limit(0)).count() == 0
    wide = data(spark).selectExpr("*", "'q' as SOURCE", "1 as upto")
    assert mixing.token_counts(wide).count() == 1022


def test_long_text(spark):
    assert mixing.token_counts(spark.createDataFrame([(1, "a b " * 200_000, "s")], DOCS)).first().n_tokens >= 200_000


def test_totals_of_the_places(spark):
    tokens = mixing.token_counts(data(spark))
    targets = spark.createDataFrame([(1, "BIG", 0.6, 1, 0.5), (1, "mid", 0.3, 4, 0.5), (1, "small", 0.09, 2, 0.5), (1, "absent", 0.01, 9, 0.5)], TARGETS)
    plan = mixing.plan_mix(tokens, targets, mixing.source_totals(mixing.prefix_sums(tokens)))
    assert sorted(plan.collect()) == sorted(mixing.plan_mix(tokens, targets).collect())
    assert mixing.source_totals(mixing.prefix_sums(tokens.limit(0))).count() == 0


def test_p8_found_takes_the_prefix_sums(spark, monkeypatch):
    from anchorline.llm.queries import QUERIES
    from tests.test_queries import DATA

    calls, whole = [], mixing.prefix_sums
    monkeypatch.setattr(mixing, "prefix_sums", lambda *a: calls.append(a) or whole(*a))
    assert QUERIES["p8_found"](spark, DATA).count() and len(calls) == 1
