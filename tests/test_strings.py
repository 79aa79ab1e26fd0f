import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorline.functions import strings as S


def over(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


@pytest.mark.parametrize(
    ("text", "links"),
    [("* [[A]], a town", ["A"]), ("* [[B]]", []), ("** [[C]]", ["C"]), ("* [[File:x]] y", []), ("* [[D#s]] y", []), ("* ''[[E|e]]'' film", ["E"]), ("* [[F]]: z", []), ("* [[G]] x\n== See also ==\n* [[H]] y", ["G"]), ("", [])],
)
def test_entity_links(spark, text, links):
    assert over(spark, S.entity_links, [text]) == [links]


def test_mention_and_image_names(spark):
    assert over(spark, S.clean_mention, ["Barack (disambiguation)", "Mercury (planet) ", None]) == ["Barack", "Mercury", None]
    names = ["File:A_b.jpg", "http://x/wiki/Special:FilePath/A%20b.jpg", "https://x/wikipedia/commons/a/ab/A_b.jpg"]
    assert set(over(spark, S.image_name, names)) == {"a b.jpg"}
    assert over(spark, S.image_name, ["https://x/wikipedia/en/a/A_b.jpg"]) == ["https://x/wikipedia/en/a/a b.jpg"]


def test_answers(spark):
    assert over(spark, S.parse_number, ['{"number": 3}', "I say 2 or 3", "-1", "none", None]) == [3, 2, -1, None, None]
    assert over(spark, S.parse_ranking, ['{"ranking": [2, 1]}', "[3 1]", '{"ranking": [a]}', "no"]) == [[2, 1], [3, 1], None, None]


def test_small_ones(spark):
    assert over(spark, lambda c: S.short_count(c.cast("double")), ["7", "1500", "2000000"]) == ["7", "1.5k", "2M"]
    assert over(spark, lambda c: S.kappa_band(c.cast("double")), ["0.8", "0.5", "-0.1", None]) == ["Almost perfect", "Moderate", "Poor", None]
    assert over(spark, S.root_type, ["Q5", "Q43229", "Q1"]) == ["PERS", "ORG", None]
    assert over(spark, S.is_photo, ["a.JPG", "b.SVG", "svg"]) == [True, False, True]
    assert over(spark, S.last_segment, ["http://x/y/Q5"]) == ["Q5"]
    assert over(spark, lambda c: S.first_sentence(c, F.lit("d")), ["A b. C", "", None]) == ["A b", "d", "d"]
    assert over(spark, S.first_paragraph, [" a \n\nb"]) == ["a"]


TEXTS = st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=12), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_percent_coding_round_trip(spark, texts):
    assert over(spark, S.percent_encode, texts) == [urllib.parse.quote(t) for t in texts]
    assert over(spark, lambda c: S.percent_decode(S.percent_encode(c)), texts) == texts


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_strip_and_word_count(spark, texts):
    assert over(spark, S.strip, texts) == [t.strip() for t in texts]
    assert over(spark, S.word_count, texts) == [len(t.split()) for t in texts]
