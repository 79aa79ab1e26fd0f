"""Every query of the subpackage against its SQL on the smallest data."""

import pytest

from anchorline.llm.queries import ORACLE, QUERIES
from tests.test_queries import DATA, db, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):  # noqa: F811
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*cols).collect())
    if name not in ORACLE:
        assert rows
        return
    rel = db.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_all_pairs_hold_rare_and_hot_items(spark):
    every, frequent = (QUERIES[n](spark, DATA).select("field", "qid_a", "qid_b", "n_together", "lift").collect() for n in ("p2_all_pairs", "p2_pairs"))
    assert set(frequent) < set(every) and min(r.n_together for r in every) == 1 and min(r.lift for r in every) < 3
