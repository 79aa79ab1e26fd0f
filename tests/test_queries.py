"""Every core query against its SQL on the smallest data."""

import math
import os

import duckdb
import pytest

from anchorline.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
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


def test_clean_mention_keeps_every_mention(spark, tmp_path):
    rows = ["A\xa0(b)\xa0", "\xa0C", "D (e)", None]
    spark.createDataFrame([(m,) for m in rows], "mention string").write.parquet(str(tmp_path / "instances.parquet"))
    got = {(r.mention, r.cleaned) for r in QUERIES["clean_mention"](spark, str(tmp_path)).collect()}
    assert got == {("A\xa0(b)\xa0", "A"), ("\xa0C", "C"), ("D (e)", "D"), (None, None)}
