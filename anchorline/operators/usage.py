"""Uses of each image against the use count that was reported for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.operators.skew import balanced_distinct_counts
from anchorline.session import pick


def usage_by_url(usage: DataFrame) -> DataFrame:
    """Per url: rows, distinct using entities, the largest reported n_used_by and whether it differs from the entities.

    A null url gives no row, a null qid counts as a row but not as an entity, and differs is null where nothing was reported. Rows
    recorded several times count each as a row and once as an entity. An empty table gives an empty result.
    """
    counts = balanced_distinct_counts(pick(usage, "url", "qid", "n_used_by"), "url", "qid", ["n_used_by"])
    return counts.select("url", "n_rows", F.col("n_distinct").alias("n_entities"), F.col("max_n_used_by").alias("n_reported"), (F.col("max_n_used_by") != F.col("n_distinct")).alias("differs"))
