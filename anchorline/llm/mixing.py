"""Corpora in which each source has a target share of all tokens.

Documents get hash-random keys and are range-sorted by source and key, so that a large source spans many partitions. A running sum of token counts
inside each partition plus the sums of the partitions before it is each document's place in its source's order; a source's budget is met
by whole passes over it and a last pass that is cut at the exact budget.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.skew import safe_join
from anchorline.session import broadcast_if_bounded, cut, parallelism, pick

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits text before merging; fixed with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def clean_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a source; a null or empty text has 0 tokens.

    tokenizer: a vocabulary of lines "base64 token, rank" under a megabyte; it is read once here and sent to the workers.
    """
    with open(tokenizer, "rb") as f:
        lines = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(lines)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in frames:
            texts = pdf["text"].fillna("")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(enc.encode_ordinary(t)) for t in texts]})

    rows = pick(docs, "doc_id", "source", "text").filter(F.col("source").isNotNull()).select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def char_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) as token_counts, each character being a token."""
    rows = pick(docs, "doc_id", "source", "text").filter(F.col("source").isNotNull())
    return rows.select("doc_id", clean_source(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))


def prefix_sums(tokens: DataFrame, seed: int = 8) -> DataFrame:
    """(doc_id, source, n_tokens, upto): upto is the number of tokens of the source up to and with the document, in hash order.

    The rows are written once (cut), because a range shuffle that is recomputed may draw other bounds.
    """
    parts = parallelism(tokens.sparkSession)
    keyed = tokens.withColumn("key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))))
    ordered = keyed.repartitionByRange(parts, "source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id").withColumn("pid", F.spark_partition_id())

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry = None, 0
        for pdf in frames:
            if pdf.empty:
                continue
            upto = pdf.groupby("source", sort=False)["n_tokens"].cumsum()
            upto = upto + (pdf["source"] == last) * carry
            last, carry = pdf["source"].iloc[-1], int(upto.iloc[-1])
            yield pdf.assign(upto=upto)[["doc_id", "source", "n_tokens", "pid", "upto"]]

    local = cut(ordered.mapInPandas(running, "doc_id bigint, source string, n_tokens bigint, pid int, upto bigint"))
    sums = local.groupBy("source", "pid").agg(F.max("upto").alias("sum"))  # at most sources + partitions rows
    w = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "pid", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("before"))
    return local.join(broadcast_if_bounded(before), ["source", "pid"]).select("doc_id", "source", "n_tokens", (F.col("upto") + F.col("before")).alias("upto"))


def source_totals(places: DataFrame) -> DataFrame:
    """(source, source_tokens): the largest running sum of each source is its size."""
    return places.groupBy("source").agg(F.max("upto").alias("source_tokens"))


def plan_mix(tokens: DataFrame, targets: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per row of targets: the budget, the whole passes over the source and the tokens left for the last pass; tokens should be cut.

    totals: source_totals where the places are known, else the tokens are added up.

    short: the source's tokens times max_repeats are fewer than its budget. A source without documents has 0 tokens. A null share or fraction
    asks for nothing, a null max_repeats allows one pass.
    """
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")) if totals is None else totals
    all_tokens = sums.agg(F.sum("source_tokens")).first()[0] or 0
    sums = sums.withColumnRenamed("source", "__source")
    want = pick(targets, "mix_id", "source", "target_share", "max_repeats", "budget_frac").distinct().withColumn("all_tokens", F.lit(all_tokens).cast("long"))
    joined = want.join(broadcast_if_bounded(sums), clean_source(F.col("source")) == F.col("__source"), "left").drop("__source")
    budget = F.coalesce(F.col("target_share") * F.col("budget_frac") * F.col("all_tokens"), F.lit(0.0))
    have = F.coalesce("source_tokens", F.lit(0))
    repeats = F.coalesce("max_repeats", F.lit(1))
    short = have * repeats < budget
    passes = F.when(have == 0, 0).when(short, repeats).otherwise(F.least(repeats, F.floor(budget / have))).cast("int")
    rest = F.when((have == 0) | short | (passes >= repeats), 0).otherwise(F.floor(budget - passes * have)).cast("long")
    return joined.select("mix_id", "source", "target_share", repeats.alias("max_repeats"), "all_tokens", have.alias("source_tokens"), budget.alias("budget"), short.alias("short"), passes.alias("passes"), rest.alias("rest"))


def compose(places: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, n_repeats) of the documents that a mix takes; n_repeats never exceeds max_repeats."""
    by = plan.select("mix_id", clean_source(F.col("source")).alias("source"), "passes", "rest").filter("passes > 0 or rest > 0")
    taken = safe_join(places, by, "source").withColumn("n_repeats", F.col("passes") + (F.col("upto") <= F.col("rest")).cast("int"))
    return taken.filter("n_repeats > 0").select("mix_id", "doc_id", "source", "n_tokens", "n_repeats")


def mix_report(corpus: DataFrame, plan: DataFrame) -> DataFrame:
    """Per row of targets the tokens and the share that its source reached in the mix."""
    got = corpus.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("tokens")).withColumnRenamed("source", "__source")
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    got = got.withColumnRenamed("mix_id", "__mix")
    rows = plan.join(broadcast_if_bounded(got), (F.col("mix_id") == F.col("__mix")) & (clean_source(F.col("source")) == F.col("__source")), "left").join(broadcast_if_bounded(whole), "mix_id", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("mix_id", "source", "target_share", "budget", tokens.alias("tokens"), F.coalesce(F.try_divide(tokens, F.col("mix_tokens")), F.lit(0.0)).alias("reached_share"), "short")
