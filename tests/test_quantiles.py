import random

import numpy as np
import pytest

from anchorline.operators.quantiles import quantiles
from anchorline.plans import annotate, split

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


def test_against_numpy(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "y", None]), float(rnd.randrange(50)) if rnd.random() < 0.9 else None) for _ in range(2000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [r[c] for c in QS] for r in quantiles(df, "v", QS, ["g"]).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert got == {g: pytest.approx(np.quantile(v, list(QS.values())).tolist()) for g, v in groups.items() if v}
    every = [v for _, v in rows if v is not None]
    assert list(quantiles(df, "v", QS).first()) == pytest.approx(np.quantile(every, list(QS.values())).tolist())


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert list(quantiles(df, "v", QS).first()) == [None] * 5 and quantiles(df, "v", QS, ["g"]).count() == 0
    times = spark.createDataFrame([], "annotator string, instance_id string, t_raw double, category string")
    assert annotate.timing_summary(annotate.cap(times)).first().n == 0 and annotate.box_stats(annotate.cap(times), ["category"]).count() == 0


def test_a_label_of_no_item_raises(spark):
    long = spark.createDataFrame([("a", "1", "YES"), ("a", "2", "NO")], "annotator string, instance_id string, label string")
    items = spark.createDataFrame([("1", "m")], "instance_id string, mention string")
    with pytest.raises(KeyError, match="2"):
        annotate.to_items(long, items)
    assert annotate.to_items(long.filter("instance_id = '1'"), items).first().mention == "m"


def test_rates_are_signed(spark):
    long = spark.createDataFrame([("a", "1", "YES"), ("a", "2", "YES"), ("b", "1", "NO"), ("b", "2", "YES")], "annotator string, instance_id string, label string")
    got = {r.annotator: (r.yes_rate, r.bias_yes, r.bias_no) for r in annotate.rates(long).collect()}
    assert got == {"a": (100.0, 25.0, -25.0), "b": (50.0, -25.0, 25.0)}


def test_an_image_that_everybody_uses_is_never_put_together(spark):
    """20,000 entities list one image: it has too many uses, or the pools have a limit."""
    image = "struct<url:string,used_by:array<string>,n_used_by:int,is_infobox:boolean,width:int,height:int,mime:string,license:string>"
    entity = f"struct<qid:string,name:string,desc:string,intro:string,type:string,infobox_img:string,url_wikipedia:string,page_imglist:array<{image}>,commons_imglist:array<{image}>>"

    def entry(i, uses):
        def one(q, urls):
            return (q, f"name {q}", "d", "intro", "PERS", f"File:{q}.jpg", "u", [(u, [], n, False, 300, 300, "image/jpeg", "") for u, n in urls], [])

        return (i, f"mention {i}", ["c"], [one(f"Q{2 * i}", [("flag.jpg", uses), ("own.jpg", 2)] if i == 1 else [("flag.jpg", uses)]), one(f"Q{2 * i + 1}", [("own.jpg", 2)] if i == 2 else [])], 2, 0, 0)

    schema = f"entry_id bigint, mention string, categories array<string>, ambiguities array<{entity}>, n_entities int, n_visual_ambiguities int, n_grounded_entities int"
    rules = split.SplitRules(max_visual=5)
    for uses, flagged in ((20_000, 0), (5, 10_000)):
        df = spark.createDataFrame([entry(i, uses) for i in range(10_000)], schema)
        pairs = split.judged_pairs(split.scan(df, rules), rules)
        rows = pairs.filter("url = 'flag.jpg'")
        assert rows.count() == flagged and rows.filter("reason <> 'visual_pool' or visual_candidates is not null").count() == 0
        assert {(r.mention, r.answer) for r in pairs.filter("url = 'own.jpg'").collect()} == {("mention 1", "Q2"), ("mention 2", "Q5")}
