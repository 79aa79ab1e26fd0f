import math

import pytest
from pyspark.sql import functions as F

from anchorline.operators import closure, incremental
from anchorline.plans import annotate, assemble, evaluate, split, stats
from tests.test_nested import SCHEMA

RULES = split.SplitRules(min_mention=1, min_side=0, min_uses=0, max_uses=99)


def page(i, mention, entities, portrait=None):
    def image(u):
        return (u, [], 3, False, 300, 300, "image/jpeg", "CC0")

    es = [(q, f"name {q}", None, "intro", "PERS", (portrait or {}).get(q, f"File:face {q}.jpg"), "", [image(u) for u in us], None) for q, us in entities]
    return (i, mention, [], es, 0, 0, 0)


PAGES = [page(1, "Alpha", [("Q1", ["i1", "i2"]), ("Q2", ["i2", "i3"])]), page(2, "Beta", [("Q3", ["i1", "i4"]), ("Q4", ["i5"])]), page(3, "Alpha", [("Q5", ["i1"]), ("Q6", ["i4"])])]


def test_instance_rule(spark):
    s = split.scan(spark.createDataFrame(PAGES, SCHEMA), RULES)
    got = {(r.image.url, r.mention): r.answer for r in split.instances(s, RULES).collect()}
    assert got == {("i1", "Alpha"): "Q1", ("i1", "Beta"): "Q3", ("i4", "Beta"): "Q3", ("i4", "Alpha"): "Q6"}
    assert {r.reason: r.n for r in split.cascade(split.judged_pairs(s, RULES)).collect()} == {"written": 4, "visual_pool": 2, "intersection": 1}


def test_instances_keep_their_invariants(spark):
    s = split.scan(spark.createDataFrame(PAGES, SCHEMA), RULES)
    for r in split.instances(s, RULES).collect():
        assert set(r.text_candidates) & set(r.visual_candidates) == {r.answer}
        assert r.text_candidates == sorted(set(r.text_candidates)) and r.visual_candidates == sorted(set(r.visual_candidates))


def test_portraits_and_exclusion(spark):
    alike = [page(1, "Alpha", [("Q1", ["i1"]), ("Q2", ["i2"])], {"Q1": "File:A_b.jpg", "Q2": "http://x/wiki/Special:FilePath/A%20b.jpg"})]
    s = split.scan(spark.createDataFrame(alike, SCHEMA), RULES)
    assert [r.entry_id for r in split.shared_portrait_entries(s).collect()] == [1]
    gone = spark.createDataFrame([("Q1",)], "qid string")
    s = split.scan(spark.createDataFrame(PAGES, SCHEMA), RULES, gone)
    assert s.kb.filter("qid = 'Q1'").isEmpty() and s.pool.filter("entry_id = 1").isEmpty() and not s.kb.filter("qid = 'Q2'").isEmpty()


def test_forbidden_pairs(spark):
    pool = spark.createDataFrame([(1, 0, "Q1"), (1, 1, "Q2"), (2, 0, "Q1"), (2, 1, "Q3")], "entry_id bigint, entity_idx int, qid string")
    edges = spark.createDataFrame([("Q2", "P131", "Q1"), ("Q1", "P131", "Q1"), ("Q1", "P5", "Q3")], "src string, prop string, dst string")
    assert [r.entry_id for r in split.forbidden_entries(pool, edges, ("P131",)).collect()] == [1]


@pytest.mark.parametrize(("mention", "ok"), [("Romeo and Juliet", False), ("Anderson", True), ("55th Foot", False), ("!!!", False), ("ÉTÉ", True), (None, False)])
def test_mentions(spark, mention, ok):
    assert spark.createDataFrame([(mention,)], "m string").select(split.mention_ok(F.col("m"), split.SplitRules())).first()[0] == ok


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "src string, dst string")
    got = {r.node: r.depth for r in closure.reachable(spark.createDataFrame([("a",), (None,)], "seed string"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_kappa_by_hand(spark):
    rows = [("A", str(i), x) for i, x in enumerate("YYNN")] + [("B", str(i), x) for i, x in enumerate("YNNN")] + [("C", "0", "Y")]
    long = spark.createDataFrame(rows, "annotator string, instance_id string, label string")
    got = {(r.a, r.b): r.kappa for r in annotate.kappa(annotate.shared(long), ["a", "b"]).collect()}
    assert got[("A", "B")] == pytest.approx(0.5) and got[("A", "C")] is None


def test_votes_without_yes_or_no(spark):
    long = spark.createDataFrame([("A", "1", "UNCERTAIN"), ("B", "1", "UNCERTAIN")], "annotator string, instance_id string, label string")
    v = annotate.votes(long).first()
    assert (v.n_votes, v.majority, v.unanimous, v.margin) == (2, "TIE", True, 0)


def test_ranking_scores_by_hand(spark):
    r = evaluate.ranking_scores(spark.createDataFrame([(1,), (3,), (None,), (2,)], "rank bigint")).first()
    assert r.mrr == pytest.approx(0.458333, abs=1e-6) and (r.hit_1, r.hit_3, r.precision_3, r.n_unparsed) == (0.25, 0.75, 0.25, 1)
    assert r.ndcg_3 == pytest.approx((1 + 0.5 + 1 / math.log2(3)) / 4)
    assert evaluate.ranking_scores(spark.createDataFrame([], "rank bigint")).first().mrr == 0.0


def test_none_prediction_for_missing_answer_is_right(spark):
    p = spark.createDataFrame([(-1, -1, 2), (1, 1, 4), (None, 1, 4)], "number int, label int, pool_size int")
    r = evaluate.accuracy(p).first()
    assert (r.n_correct, r.n_unparsed, r.n_none) == (2, 1, 1) and r.random_baseline == pytest.approx(1 / 3)


def test_generate_calls_the_model_on_batches(spark):
    out = evaluate.generate(spark.createDataFrame([(1, "p")], "id int, prompt string"), lambda: lambda ps: [p.upper() for p in ps])
    assert out.first().response == "P"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (2.1,), (None,)], "v double")
    assert {r.bin: r.n for r in stats.histogram(df, "v", 0, 2, 2).collect()} == {0: 2, 1: 2}


def test_ecdf_counts_rows(spark):
    got = sorted((r.y, r.value) for r in stats.ecdf(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double"), "v", "k").collect())
    assert got == [(pytest.approx(1 / 3), 1.0), (pytest.approx(2 / 3), 5.0), (pytest.approx(1.0), 5.0)]


def test_cap(spark):
    t = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100)], "t_raw double")
    assert max(r.t for r in annotate.cap(t).collect()) == pytest.approx(27.25 + 1.5 * (27.25 - 1.75))
    assert max(r.t for r in annotate.cap(t, "none").collect()) == 100


def test_merge_and_pending(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3)], "k string, v int")
    assert sorted(map(tuple, incremental.merge_last(old, new, "k").collect())) == [("a", 1), ("b", 3)]
    assert [r.k for r in incremental.pending(old, new, "k").collect()] == ["a"]


def test_assembled_lists_keep_order(spark):
    kb = spark.createDataFrame([("Q1",), ("Q2",)], "qid string")
    files = spark.createDataFrame([("Q1", ["b.jpg", "x.jpg", "A_a.jpg"])], "qid string, files array<string>")
    images = spark.createDataFrame([("A_a.jpg", "ua", ["Q1"], 1, 1, None, None), ("b.jpg", "ub", [], 1, 1, "m", "l")], "filename string, url string, used_by array<string>, width int, height int, mime string, license string")
    rows = assemble.image_lists(files, images, spark.createDataFrame([("Q1", "File:a a.jpg")], "qid string, infobox_img string"))
    got = {r.qid: [(i.url, i.is_infobox) for i in r.page_imglist] for r in assemble.nested_entities(kb, rows, rows.limit(0)).collect()}
    assert got == {"Q1": [("ub", False), ("ua", True)], "Q2": []}
