"""Files in and out: JSON Lines, JSON maps, exports of annotators, manifests, tables for people."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.plans.evaluate import seeded_sample
from anchorline.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob leads to anything, on any file system that the session knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def require(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One record a line under a fixed schema; blank lines don't count. A malformed line raises, or is dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A file that holds one object, as rows (key, value); value is the DDL type of the object's values. A null value is kept."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias(key, "value"))


def optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON Lines file, or no rows if it is missing; malformed lines are dropped."""
    return read_jsonl(spark, path, schema, strict=False) if exists(spark, path) else empty(spark, schema)


def read_dataset(spark: SparkSession, base: str, schema: T.StructType | str) -> DataFrame:
    """base.jsonl if it is there, else base.json as one array."""
    if exists(spark, f"{base}.jsonl"):
        return read_jsonl(spark, f"{base}.jsonl", schema)
    require(spark, f"{base}.json")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{base}.json")


def read_user_states(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All folder/*/user_state.json, each with the name of its own folder."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/user_state.json")
    return rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def zip_lines(spark: SparkSession, left: str, right: str, left_schema: T.StructType, right_schema: T.StructType) -> DataFrame:
    """Two JSON Lines files side by side by line number; raises if they differ in length. Columns of both are structs a and b."""

    def numbered(path: str, schema: T.StructType, name: str) -> DataFrame:
        lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
        # a file's parts are read in order; each line's place in its part and the sizes of the parts before give its number
        placed = cut(lines.select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "value"))
        sizes = placed.groupBy("pid").agg(F.max("pos").alias("last"))  # one row a part
        before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = placed.join(F.broadcast(sizes.select("pid", before.alias("before"))), "pid")
        return rows.select((F.col("pos") + F.col("before")).alias("n"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias(name))

    both = cut(numbered(left, left_schema, "a").join(numbered(right, right_schema, "b"), "n", "full"))
    if not both.filter(F.col("a").isNull() | F.col("b").isNull()).isEmpty():
        raise ValueError(f"{left} and {right} differ in length")
    return both.orderBy("n")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; the committer puts the files in place only when all are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_map(df: DataFrame, path: str, key: str, value: str, most: int = 1_000_000) -> None:
    """An export of (key, value) rows as one JSON object for other programs; refuses more rows than fit into one file."""
    rows = df.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a table instead")
    _write_text(df.sparkSession, path, json.dumps({r[key]: r[value] for r in sorted(rows)}, ensure_ascii=False, indent=2))


def write_manifest(spark: SparkSession, path: str, version: str, config: dict, counts: dict[str, int], note: str = "") -> dict:
    """What was built, when, with which settings and how much of it."""
    m = {"version": version, "assembled_at": datetime.now(UTC).isoformat(), "note": note, "config": config, "counts": counts}
    _write_text(spark, path, json.dumps(m, ensure_ascii=False, indent=2))
    return m


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader never sees half a file."""
    jvm = spark.sparkContext._jvm
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    fs.rename(beside, to)


def write_table(df: DataFrame, path: str, most: int = 1000) -> None:
    """An aligned plain-text table of at most so many rows, in the order of df."""
    rows = [list(map(str, df.columns)), *[["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    _write_text(df.sparkSession, path, "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]]) + "\n")


def write_split(kb: DataFrame, instances: DataFrame, folder: str) -> dict[str, int]:
    """The two tables of a split as JSON Lines, kb and instances, with their row counts."""
    write_jsonl(kb, f"{folder}/kb")
    write_jsonl(instances, f"{folder}/instances")
    return {n: kb.sparkSession.read.text(f"{folder}/{n}").count() for n in ("kb", "instances")}


def write_predictions(rows: DataFrame, metrics: DataFrame, folder: str, config: dict) -> dict:
    """A run of a model: predictions as JSON Lines, and beside them one object of its settings, time and metrics (the one row of metrics)."""
    write_jsonl(rows, f"{folder}/predictions")
    out = {"meta": {"timestamp": datetime.now(UTC).isoformat(), "config": config}, **metrics.first().asDict(recursive=True)}
    _write_text(rows.sparkSession, f"{folder}/metrics.json", json.dumps(out, ensure_ascii=False, indent=2))
    return out


_SEARCH = """<input id=q placeholder=search><script>document.getElementById("q").oninput=e=>{const t=e.target.value.toLowerCase();
for(const r of document.querySelectorAll("tbody tr"))r.hidden=!r.textContent.toLowerCase().includes(t)}</script>"""


def write_viewer(df: DataFrame, path: str, title: str, key: str, most: int = 5000, seed: int = 42) -> None:
    """An HTML page for looking at a seeded sample of at most so many rows (0 for all), with a field that searches them."""
    rows = seeded_sample(df, key, most, seed).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{_SEARCH}<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
    _write_text(df.sparkSession, path, page)


def read_config(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


class Completed:
    """Which items of which stage are done: an append-only table (stage, item_id); an absent table means none."""

    SCHEMA = "stage string, item_id string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def done(self, stage: str) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else empty(self.spark, self.SCHEMA)
        return rows.filter(F.col("stage") == stage).select("item_id").distinct()

    def mark(self, stage: str, items: DataFrame, key: str) -> None:
        items.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("item_id")).write.mode("append").parquet(self.path)

    def pending(self, stage: str, items: DataFrame, key: str) -> DataFrame:
        return items.join(self.done(stage).select(F.col("item_id").alias(key)), key, "left_anti")
