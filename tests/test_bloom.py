import xxhash
from pyspark.sql import functions as F

from anchorline.operators.bloom import as_bytes, bits_of, may_contain


def test_members_stay_and_most_others_go(spark):
    inside, outside = [f"w{i}é" for i in range(500)], [f"x{i}" for i in range(5000)]
    df = spark.createDataFrame([(w,) for w in inside], "w string")
    bits = bits_of(df, F.xxhash64("w"), 500)
    every = spark.createDataFrame([(w,) for w in inside + outside], "w string")
    kept = {r.w for r in every.filter(may_contain(bits, F.xxhash64("w"))).collect()}
    assert set(inside) <= kept and len(kept) < 500 + 500
    raw = as_bytes(bits)
    mask = len(raw) * 8 - 1
    in_python = {w for w in inside + outside if raw[(h := xxhash.xxh64_intdigest(w.encode(), 42) & mask) >> 3] >> (h & 7) & 1}
    assert in_python == kept


def test_a_full_filter_drops_nothing_it_holds(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = bits_of(df, F.col("h"), 3000, most=1 << 10)
    assert bits.size == 16 and df.filter(may_contain(bits, F.col("h"))).count() == 3000
    assert bits_of(df.limit(0), F.col("h"), 0).sum() == 0
