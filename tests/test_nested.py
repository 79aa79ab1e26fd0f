from anchorline.operators import nested

IMAGE = "struct<url:string,used_by:array<string>,n_used_by:int,is_infobox:boolean,width:int,height:int,mime:string,license:string>"
SCHEMA = f"entry_id bigint, mention string, categories array<string>, ambiguities array<struct<qid:string,name:string,desc:string,intro:string,type:string,infobox_img:string,url_wikipedia:string,page_imglist:array<{IMAGE}>,commons_imglist:array<{IMAGE}>>>, n_entities int, n_visual_ambiguities int, n_grounded_entities int"


def image(url, used_by):
    return (url, used_by, None, None, None, None, None, None)


def entity(qid, page, commons):
    return (qid, "n", None, "x" * 5, None, None, None, page, commons)


ROWS = [
    (1, "A", ["c"], [entity("Q1", [image("u1", ["Q1", None, "Q2"]), None, image("u2", None)], None), None, entity("Q2", [], [image("u1", []), image("", ["Q9"])])], 2, 0, 0),
    (2, "B", None, None, None, None, None),
    (3, None, [], [], 0, 0, 0),
    (4, "D", ["c"], [entity(None, [image("u3", ["Q7"])], None), entity("Q5", None, [image("u5", ["Q5"]), image(None, ["Q5"])])], 0, 0, 0),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_keys_and_positions(spark):
    df = table(spark)
    assert nested.entries(df).count() == 4
    assert sorted((r.entry_id, r.entity_idx, r.qid or "") for r in nested.entities(df).collect()) == [(1, 0, "Q1"), (1, 2, "Q2"), (4, 0, ""), (4, 1, "Q5")]
    images = sorted((r.entry_id, r.entity_idx, r.img_list, r.image_idx, r.url or "") for r in nested.images(df).collect())
    assert images == [(1, 0, "page_imglist", 0, "u1"), (1, 0, "page_imglist", 2, "u2"), (1, 2, "commons_imglist", 0, "u1"), (1, 2, "commons_imglist", 1, ""), (4, 0, "page_imglist", 0, "u3"), (4, 1, "commons_imglist", 0, "u5"), (4, 1, "commons_imglist", 1, "")]
    users = sorted((r.entry_id, r.entity_idx, r.image_idx, r.user_idx, r.user_qid) for r in nested.image_users(df).collect())
    assert users == [(1, 0, 0, 0, "Q1"), (1, 0, 0, 2, "Q2"), (1, 2, 1, 0, "Q9"), (4, 0, 0, 0, "Q7"), (4, 1, 0, 0, "Q5"), (4, 1, 1, 0, "Q5")]


def test_unnamed(spark):
    got = sorted(map(tuple, nested.unnamed_images(table(spark)).collect()))
    assert got == [(1, "Q1", "page_imglist", "u2"), (1, "Q2", "commons_imglist", "u1")]


def test_copies_count_once_and_empty_tables(spark):
    for f in (nested.entries, nested.entities, nested.images, nested.image_users, nested.unnamed_images):
        assert f(table(spark, ROWS + ROWS[:1])).count() == f(table(spark)).count()
        assert f(table(spark, [])).count() == 0


def test_clashing_columns(spark):
    df = table(spark).selectExpr("*", "'x' as ENTRY_ID", "1 as entity_idx")
    assert nested.images(df).count() == nested.images(table(spark)).count()


def test_long_text(spark):
    rows = [(9, "L", None, [("Q1", "n", "y" * 1_000_000, None, None, None, None, None, None)], 1, 0, 0)]
    assert len(nested.entities(table(spark, rows)).first()["desc"]) == 1_000_000
