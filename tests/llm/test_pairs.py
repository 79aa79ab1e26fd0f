import itertools
import random
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorline.llm import pairs

SCHEMA = "record string, item string"


def brute(rows, least=1, lift=0.0):
    records = defaultdict(set)
    for r, i in rows:
        if r is not None:
            records[r] |= {i} - {None}
    n, single, both = len(records), Counter(), Counter()
    for items in records.values():
        single.update(items)
        both.update(itertools.combinations(sorted(items), 2))
    return {p: (single[p[0]], single[p[1]], k) for p, k in both.items() if k >= least and k * n >= lift * single[p[0]] * single[p[1]]}


def found(spark, rows, *args):
    out = pairs.count_pairs(spark.createDataFrame(rows, SCHEMA), *args)
    return {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_together) for r in out.collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, *"abcdef"]), st.sampled_from([None, "", *"uvwxyz"])), max_size=60))
def test_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_long_records_and_hot_items(spark):
    rnd = random.Random(1)
    rows = [("long", f"Q{i}") for i in range(400)] + [(f"r{k}", f"Q{rnd.randrange(30)}") for k in range(600) for _ in range(4)] + [(f"r{k}", "hot") for k in range(600)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, 6, 1.5) == brute(rows, 6, 1.5)


def test_odds_ratio(spark):
    r = pairs.count_pairs(spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("3", "c")], SCHEMA)).first()
    assert (r.n_records, r.lift, r.odds_ratio) == (3, 1.5, (1.5 * 1.5) / (1.5 * 0.5))


def test_runs_merge_over_batches():
    def batch(codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

    out = list(pairs._merge_runs(iter([batch([1, 1, 2], [1, 2, 3]), batch([], []), batch([2, 2, 5], [1, 1, 1]), batch([5], [4])])))
    assert [x for b in out for x in zip(b[0].to_pylist(), b[1].to_pylist())] == [(1, 3), (2, 5), (5, 5)]


def test_records_of_the_tables(spark):
    images = spark.createDataFrame([("u", ["b", "a", None, "a"]), ("u", ["c"]), ("", ["a"]), (None, ["a"]), ("v", []), ("w", None), ("x", [None])], "url string, used_by array<string>")
    got = pairs.count_pairs(pairs.image_members(images)).collect()
    assert {(r.item_a, r.item_b) for r in got} == {("a", "b"), ("a", "c"), ("b", "c")} and got[0].n_records == 2
    instances = spark.createDataFrame([(("u",), ["a", "b"]), (("v",), None), (None, ["a", "b"])], "image struct<url:string>, visual_candidates array<string>")
    assert pairs.count_pairs(pairs.candidate_members(instances)).first().n_records == 2


def test_empty(spark):
    assert found(spark, []) == {} and found(spark, [], 6, 3.0) == {}


def test_no_row_of_a_long_record_is_long(spark):
    """Ten thousand items in one record: every job row holds two blocks."""
    numbered = spark.range(10_000).selectExpr("'r' as record", "cast(id as int) as id").union(spark.range(50).selectExpr("'s' as record", "cast(id as int) as id"))
    long = pairs._long_records(numbered)
    jobs = pairs._long_jobs(numbered, long)
    assert jobs.selectExpr("max(greatest(size(a), size(b)))").first()[0] < 2 * pairs.BLOCK
    made = jobs.selectExpr("sum(if(same, size(a) * (size(a) - 1) / 2, size(a) * size(b)))").first()[0]
    assert made == 10_000 * 9_999 / 2
    assert [len(r.a) for r in pairs._short_jobs(numbered, long).collect()] == [50]
