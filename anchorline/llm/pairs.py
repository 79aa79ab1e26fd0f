"""How often two items occur in the same record, and how far that exceeds chance.

An external sort of packed 64-bit pair codes: items get dense 32-bit numbers in string order, a pair is one long, each task sorts its runs of
codes and counts equal neighbours, the runs' counts are shuffled, sorted (spilling) and merged by the same run-length count.
Odds ratios with a continuity correction follow from the counts.

Two exact bounds keep hot items and long records from exploding. A pair can occur in min_records records only if both its items do, and it can reach
min_lift only if neither item is in more than records / min_lift records, since a pair is in no more records than its rarer item. Items beyond either bound are taken
out before pairs are made. Long records are divided into blocks before they are put together, and each pair of blocks is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.skew import safe_join, skew_join
from anchorline.session import bounded, broadcast_if_bounded, cut, parallelism, pick

#: Items in a block of a record.
BLOCK = 128


def dense_ids(items: DataFrame, item: str) -> DataFrame:
    """(item, id): numbers from 0 without gaps in string order; items must be distinct and not null. The result is cut, so that numbers never change."""
    parts = parallelism(items.sparkSession)
    placed = cut(items.repartitionByRange(parts, item).sortWithinPartitions(item).withColumn("pid", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "pid").select(*items.columns, (F.col("pos") + F.col("before")).alias("id"))


def _runs(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes to distinct codes and their counts."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, codes.size)) if counts is None else np.add.reduceat(counts, starts)


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (a, b, same) to sorted runs of pair codes with counts; of same blocks only a is read."""
    limit, held, size = 1 << 20, [], 0

    def flush() -> pa.RecordBatch:
        codes, counts = _runs(np.sort(np.concatenate(held)), None)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    for batch in batches:
        for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            x, y = (v.values.to_numpy(zero_copy_only=False).astype(np.int64) for v in (a, b))
            if same:
                x, y = x[(at := np.triu_indices(x.size, 1))[0]], x[at[1]]
            else:
                x, y = np.repeat(x, y.size), np.tile(y, x.size)
            codes = (np.minimum(x, y) << 32) | np.maximum(x, y)
            if codes.size:
                held.append(codes)
                size += codes.size
            if size >= limit:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (code, n) to one row a code; the last code of a batch waits for the next batch."""
    last, carry = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = _runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        counts = counts.copy()
        if last is not None:
            if codes[0] == last:
                counts[0] += carry
            else:
                codes, counts = np.insert(codes, 0, last), np.insert(counts, 0, carry)
        last, carry = codes[-1], counts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(counts[:-1])], names=["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([carry], pa.int64())], names=["code", "n"])


def _long_records(numbered: DataFrame) -> DataFrame:
    """(record, blocks) of the records with more than a block of items; there are at most items / BLOCK of them."""
    sizes = numbered.groupBy("record").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    return sizes.select("record", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def _short_jobs(numbered: DataFrame, long: DataFrame | None) -> DataFrame:
    """(a, b, same): the items of each record that is no long one, against themselves."""
    rows = numbered if long is None else numbered.join(broadcast_if_bounded(long), "record", "left_anti")
    lists = rows.groupBy("record").agg(F.array_sort(F.collect_list("id")).alias("a")).filter(F.size("a") > 1)
    return lists.select("a", F.array().cast("array<int>").alias("b"), F.lit(True).alias("same"))


def _long_jobs(numbered: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b, same) for each pair of blocks of the long records. A hash deals a record's items into blocks, so no row holds more than about a block.

    Each block is sent to the pairs it belongs to, whose keys are spread over all tasks, so no task sees a whole record either.
    """
    rows = safe_join(numbered, cut(long), "record")
    blocks = rows.groupBy("record", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k")).agg(F.collect_list("id").alias("ids"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    sent = blocks.select("record", "k", "ids", other).select("record", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.struct("k", "ids").alias("block"))
    met = sent.groupBy("record", "i", "j").agg(F.array_sort(F.collect_list("block")).alias("m"))
    same = F.col("i") == F.col("j")
    # the pair of a block with one that got no items has one member and no pairs of its own
    kept = met.filter(same | (F.size("m") == 2))
    return kept.select(F.array_sort(F.col("m")[0]["ids"]).alias("a"), F.when(same, F.array().cast("array<int>")).otherwise(F.try_element_at("m", F.lit(2))["ids"]).alias("b"), same.alias("same"))


def count_pairs(members: DataFrame, min_records: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items that occur together in at least min_records records with a lift of at least min_lift.

    members: (record, item), one row per item of a record, in any order and repeated at will; a null item counts for nothing but makes its
    record count, a null record is left out. Result: item_a < item_b, n_records, n_a, n_b, n_together, lift = n_together * n_records / (n_a * n_b), and
    odds_ratio, each cell of its 2x2 table raised by 0.5. An empty table gives no pairs.
    """
    members = cut(pick(members, "record", "item").filter(F.col("record").isNotNull()).distinct())
    lengths = members.groupBy("record").agg(F.count("item").alias("n"))
    n_records, longest = lengths.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    singles = members.filter(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    useful = singles.filter(F.col("n_item") >= min_records)
    if min_lift > 0:
        useful = useful.filter(F.col("n_item") * F.lit(float(min_lift)) <= F.lit(float(n_records)))
    ids = cut(dense_ids(useful, "item"))
    small = bounded(ids)
    numbered = members.join(F.broadcast(ids.select("item", "id")), "item") if small else skew_join(members, ids.select("item", "id"), "item")
    numbered = numbered.select("record", F.col("id").cast("int").alias("id"))
    if longest > BLOCK:
        numbered = cut(numbered)
        jobs = _short_jobs(numbered, _long_records(numbered)).unionByName(_long_jobs(numbered, _long_records(numbered)))
    else:
        jobs = _short_jobs(numbered, None)
    runs = jobs.mapInArrow(_pair_runs, "code bigint, n bigint")
    merged = runs.repartition(parallelism(members.sparkSession), "code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code bigint, n bigint")
    together = merged.filter(F.col("n") >= min_records).select(F.shiftrightunsigned("code", 32).alias("ia"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ib"), F.col("n").alias("n_together"))
    a = ids.select(F.col("id").alias("ia"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = ids.select(F.col("id").alias("ib"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    named = together.join(F.broadcast(a), "ia").join(F.broadcast(b), "ib") if small else skew_join(skew_join(together, a, "ia"), b, "ib")
    n11, n10, n01 = F.col("n_together"), F.col("n_a") - F.col("n_together"), F.col("n_b") - F.col("n_together")
    n00 = F.lit(n_records) - F.col("n_a") - F.col("n_b") + F.col("n_together")
    out = named.select(
        "item_a", "item_b", F.lit(n_records).cast("long").alias("n_records"), "n_a", "n_b", "n_together",
        (n11 * F.lit(n_records) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        ((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))).alias("odds_ratio"),
    )
    if min_lift > 0:
        out = out.filter(F.col("n_together") * F.lit(n_records) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return out


def image_members(images: DataFrame) -> DataFrame:
    """One record per distinct non-empty url with a non-empty used_by; the lists of rows with the same url are united."""
    return pick(images, "url", "used_by").filter((F.col("url") != "") & (F.size("used_by") > 0)).select(F.col("url").alias("record"), F.explode("used_by").alias("item"))


def candidate_members(instances: DataFrame) -> DataFrame:
    """One record per distinct image.url of the instances, also without candidates."""
    return pick(instances, "image", "visual_candidates").select(F.col("image.url").alias("record"), F.explode_outer("visual_candidates").alias("item"))


def frequent_pairs(images: DataFrame, instances: DataFrame, min_records: int = 6, min_lift: float = 3.0) -> DataFrame:
    """count_pairs of both fields: (field, qid_a, qid_b, ...)."""
    parts = [("used_by", image_members(images)), ("visual_candidates", candidate_members(instances))]
    found = [count_pairs(r, min_records, min_lift).withColumn("field", F.lit(name)) for name, r in parts]
    return found[0].unionByName(found[1]).withColumnsRenamed({"item_a": "qid_a", "item_b": "qid_b"})
