"""Prompts for a model, its answers read back, and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions import strings as S

KS = (1, 3, 5, 10)


def random_key(seed: int, *keys: Column) -> Column:
    """32 hexadecimal digits that order rows at random, the same on every run and in any engine."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed))))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of key and seed; all rows for n = 0. The same rows on every run."""
    order = random_key(seed, F.col(key))
    return df.orderBy(order, key).limit(n) if n else df


def candidate_lines(instances: DataFrame, kb: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """(instance_id, mention, prompt, options, label): numbered lines "number. name - description" of the known candidates.

    The answer comes first unless a seed shuffles them; label is its number, -1 if it isn't among them. kb: unique qid, name, desc, intro.
    """
    rows = instances.select("instance_id", "mention", "answer", F.posexplode("text_candidates").alias("pos", "qid")).join(kb.select("qid", "name", "desc", "intro"), "qid")
    text = S.first_sentence(F.col("intro"), F.col("desc"))
    line = F.concat(F.coalesce("name", F.lit("")), F.when(S.filled(text), F.concat(F.lit(" - "), text)).otherwise(""))
    # qid <> answer sorts the answer to the front; ties keep the candidates' order
    first = F.coalesce((F.col("qid") != F.col("answer")).cast("long"), F.lit(1)) if shuffle_seed is None else random_key(shuffle_seed, F.col("instance_id"), F.col("qid"))
    grouped = rows.groupBy("instance_id").agg(F.first("mention").alias("mention"), F.first("answer").alias("answer"), F.array_sort(F.collect_list(F.struct(first.alias("k"), "pos", "qid", line.alias("line")))).alias("c"))
    options = F.transform("c", lambda x: x["qid"])
    prompt = F.array_join(F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    at = F.array_position(options, F.col("answer"))
    return grouped.select("instance_id", "mention", prompt.alias("prompt"), options.alias("options"), F.when(at > 0, at).otherwise(-1).cast("int").alias("label"))


@dataclass(frozen=True)
class Template:
    """The wording of a prompt. {mention} stands for the mention in header, {fields} for what each candidate is described by in intro, {n} for the
    number of candidates in footer; none_hint follows where an answer outside of the candidates is allowed."""

    header: str = "Which entity does the picture show under the name {mention}?"
    intro: str = "Each candidate is given by {fields}."
    footer: str = "Answer with one number from 1 to {n}."
    none_hint: str = "Answer -1 if no candidate fits."
    ranking: bool = False


def fields_sentence(description: bool, image: bool) -> str:
    names = ["its name", *["a description"] * description, *["a picture"] * image]
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}"


def prompts(instances: DataFrame, kb: DataFrame, template: Template = Template(), description: bool = True, image: bool = False, allow_none: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """(instance_id, mention, prompt, options, label): whole prompts of header, fields sentence, candidate lines, footer and, if asked for, the hint.

    Without description the lines hold names only. An instance without known candidates has no prompt; a null mention reads as an empty one.
    """
    known = kb if description else kb.withColumn("desc", F.lit(None).cast("string")).withColumn("intro", F.lit(None).cast("string"))
    rows = candidate_lines(instances, known, shuffle_seed)
    fill = lambda text, name, value: F.replace(F.lit(text), F.lit("{" + name + "}"), value)
    parts = [
        fill(template.header, "mention", F.coalesce("mention", F.lit(""))),
        F.lit(template.intro.replace("{fields}", fields_sentence(description, image))),
        F.col("prompt"),
        fill(template.footer, "n", F.size("options").cast("string")),
        *[F.lit(template.none_hint)] * allow_none,
    ]
    return rows.select("instance_id", "mention", F.concat_ws("\n", *parts).alias("prompt"), "options", "label")


def answerable(rows: DataFrame, image: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows with an image, and those without one with the column error; the latter don't count in any score."""
    has = S.filled(image)
    return rows.filter(has), rows.filter(~has).withColumn("error", F.lit("no image"))


def generate(prompts: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """prompts with response. model makes the function that answers a batch; it is called once in each worker task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = model()
        for pdf in frames:
            yield pdf.assign(response=answer(pdf["prompt"].tolist()))

    return prompts.mapInPandas(run, prompts.withColumn("response", F.lit("")).schema)


def predicted_qid(options: Column, number: Column) -> Column:
    return F.when(number.between(1, F.size(options)), F.try_element_at(options, number))


def gold_rank(ranking: Column, label: Column) -> Column:
    """1-based place of the label in a ranking, null if it isn't there."""
    return F.nullif(F.array_position(ranking, label), F.lit(0).cast("long"))


def free_choice(response: Column, name: Column) -> Column:
    """Whether the answer holds the name, in any letter case; never for an empty name."""
    return F.coalesce(S.filled(name) & F.contains(F.lower(response), F.lower(name)), F.lit(False))


def accuracy(preds: DataFrame) -> DataFrame:
    """One row over (number, label, pool_size); answers that couldn't be read are wrong."""
    n = F.count(F.lit(1))
    right = F.count_if(F.coalesce(F.col("number") == F.col("label"), F.lit(False)))
    return preds.agg(n.alias("n"), right.alias("n_correct"), F.count_if(F.col("number").isNull()).alias("n_unparsed"), F.count_if(F.col("number") == -1).alias("n_none"), F.coalesce(F.try_divide(right, n), F.lit(0.0)).alias("accuracy"), F.avg(F.try_divide(F.lit(1.0), F.col("pool_size"))).alias("random_baseline"))


def ranking_scores(ranks: DataFrame) -> DataFrame:
    """One row over (rank): mean reciprocal rank, and hit, precision, recall and nDCG at each k; null ranks score nothing."""
    n, r = F.count(F.lit(1)), F.col("rank")
    over = lambda c: F.coalesce(F.try_divide(F.sum(c), n), F.lit(0.0))
    out = [n.alias("n"), F.count_if(r.isNull()).alias("n_unparsed"), over(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr")]
    for k in KS:
        hit = over(F.when(r <= k, 1.0).otherwise(0.0))
        out += [hit.alias(f"hit_{k}"), (hit / k).alias(f"precision_{k}"), hit.alias(f"recall_{k}"), over(F.when(r <= k, 1.0 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{k}")]
    return ranks.agg(*out)
