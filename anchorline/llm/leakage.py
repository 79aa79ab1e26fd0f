"""Passages of held-out test items in training documents.

Rare n-grams of the items are the seeds that join documents to items; local alignment of the word sequences (Smith and Waterman) then scores each
candidate, also if the copy was edited, moved about or parted.

Seeds lose nothing. An n-gram that many items share is no seed of theirs, but what such n-grams can cover of an item is known from the item alone: an item that they
could carry over the threshold by themselves keeps them as seeds, and for the others it is added to what the rare seeds cover, so that a candidate is
given up only if its upper bound stays below the threshold.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.bloom import bits_of, may_contain
from anchorline.operators.skew import safe_join, skew_join
from anchorline.session import bounded, cut, parallelism, pick

#: Words of an n-gram, the shortest stretch that counts as copied.
N = 4
#: An n-gram in more items than this is common.
RARE_ITEMS = 8
#: Share of an item's words that a leak holds. Leaks hold half or more, quotations less than a third; single words that were changed inside
#: a leak aren't counted, so the line lies between.
MIN_SHARE = 0.45
#: Words of an item that are aligned at once; longer items go in pieces that overlap by 2 N words, so that no stretch of N words is cut.
PIECE = 256
#: Items that are sent to every task as they are, and their words all together.
SENT_ITEMS, SENT_WORDS = 20_000, 2_000_000

_TAG = re.compile(r"<[^<>\n]{1,200}>")
_REF = re.compile(r"\[\d{1,4}\]")
_INNER = re.compile(r"(?<=\w)['’‘`´ʼ\-‐‑­​](?=\w)|[­​-‍﻿]")
#: Letters that no decomposition maps to their base, fixed.
_BASE = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"}


class _Fold(dict):
    """Each character as it counts in a word: without case and accents, a space where it is no letter or digit. Filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        whole = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold())
        out = "".join(_BASE.get(c, c) if c.isalnum() else " " for c in whole if not unicodedata.combining(c))
        self[code] = out
        return out


_FOLD = _Fold()


def normal_words(text: str | None) -> list[str]:
    """Words without regard to letter case, accents, punctuation, spacing, tags, entities and reference marks."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub("", t)
    if "[" in t:
        t = _REF.sub(" ", t)
    if t.isascii():
        return (_INNER.sub("", t) if "'" in t or "-" in t or "`" in t else t).translate(_FOLD).split()
    return _INNER.sub("", t).translate(_FOLD).split()


def _normal() -> Column:
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(normal_words(t)))

    return normal


def _grams(words: Column) -> Column:
    """Array of (hash, position) of the word n-grams."""
    n = F.size(words) - (N - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(F.slice(words, i, N)).alias("h"), (i - 1).alias("pos"))))


def prepared(df: DataFrame, key: str) -> DataFrame:
    """(key, words) of the rows with a key and at least one word."""
    rows = pick(df, key, "text").filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, _normal()(F.col("text")).alias("normal")).filter(F.col("normal") != "")
    return rows.select(key, F.split("normal", " ").alias("words"))


def _covered(positions: Column) -> Column:
    """Number of words in the n-grams that start at the positions."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(p, p + (N - 1))))))


def seeds_of(items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(h, item_id, pos, n_words, spare): spare is the number of words that the item's other, common n-grams may add to a candidate."""
    grams = items.select("item_id", F.size("words").alias("n_words"), F.explode(_grams(F.col("words"))).alias("g")).select("item_id", "n_words", "g.h", "g.pos")
    sharing = grams.select("h", "item_id").distinct().groupBy("h").agg((F.count(F.lit(1)) > RARE_ITEMS).alias("common"))
    marked = grams.join(sharing, "h")
    spare = marked.groupBy("item_id").agg(_covered(F.collect_set(F.when(F.col("common"), F.col("pos")))).alias("common_words"))
    rows = marked.join(spare, "item_id")
    by_common = F.col("common_words") >= F.lit(min_share) * F.col("n_words")
    return rows.filter(~F.col("common") | by_common).select("h", "item_id", "pos", "n_words", F.when(by_common, 0).otherwise(F.col("common_words")).alias("spare"))


def candidates(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id) whose seeds leave it possible that the share is reached; docs and items as from prepared."""
    seeds = cut(seeds_of(items, min_share))
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.transform(_grams(F.col("words")), lambda g: g["h"]))).alias("h"))
    if bounded(seeds):
        hits = grams.join(F.broadcast(seeds), "h")
    else:  # what no item has goes before the shuffle, and an n-gram of an item that very many documents have is split over tasks
        n = seeds.count()
        hits = skew_join(grams.filter(may_contain(bits_of(seeds, F.col("h"), n), F.col("h"))), seeds, "h")
    both = hits.groupBy("doc_id", "item_id").agg(F.collect_set("pos").alias("positions"), F.first("n_words").alias("n_words"), F.first("spare").alias("spare"))
    return both.filter(_covered(F.col("positions")) + F.col("spare") >= F.lit(min_share) * F.col("n_words")).select("doc_id", "item_id")


def _aligned(a: np.ndarray, free: np.ndarray, b: np.ndarray) -> tuple[int, list[int]]:
    """Score and matched item positions of the best local alignment that holds N matches in a row; (0, []) if there is none.

    A match of a free item word scores 1, a change, an extra or a missing word costs 1. best is the table of Smith and Waterman, held that
    of the alignments that have their N matches in a row already, so that what scattered words score never stands in the way of a stretch.
    """
    m, n = a.size, b.size
    best, held = np.zeros((m + 1, n + 1), np.int32), np.full((m + 1, n + 1), -(1 << 20), np.int32)
    steps, run = np.arange(n + 1, dtype=np.int32), np.zeros(n + 1, np.int32)
    for i in range(1, m + 1):
        same = (b == a[i - 1]) if free[i - 1] else np.zeros(n, bool)
        score = np.where(same, 1, -1).astype(np.int32)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        run[0] = 0
        x = best[i - 1] - 1
        np.maximum(x[1:], best[i - 1, :-1] + score, out=x[1:])
        best[i] = np.maximum(np.maximum.accumulate(x + steps) - steps, 0)
        y = held[i - 1] - 1
        np.maximum(y[1:], held[i - 1, :-1] + score, out=y[1:])
        at = np.flatnonzero(run >= N)
        if at.size:
            y[at] = np.maximum(y[at], best[i - N, at - N] + N)
        held[i] = np.maximum.accumulate(y + steps) - steps
    i, j = map(int, np.unravel_index(int(held.argmax()), held.shape))
    top, path, table = int(held[i, j]), [], held
    if top < N:
        return 0, []
    while i > 0 and j > 0 and (table is held or best[i, j] > 0):
        if table is held and i >= N and j >= N and held[i, j] == best[i - N, j - N] + N and free[i - N : i].all() and (a[i - N : i] == b[j - N : j]).all():
            path += range(i - N, i)
            i, j, table = i - N, j - N, best
            continue
        same = free[i - 1] and a[i - 1] == b[j - 1]
        if same and table[i, j] == table[i - 1, j - 1] + 1:
            path.append(i - 1)
            i, j = i - 1, j - 1
        elif not same and table[i, j] == table[i - 1, j - 1] - 1:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return top, path


def _blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the document that together hold every alignment with N matches in a row whole.

    An alignment with a positive score spans fewer than twice as many words of the document as the item has, so only the words that near an n-gram
    of the item are looked at, and long stretches are cut into blocks that overlap by that span.
    """
    if b.size < N or a.size < N:
        return []
    base = np.int64(min(int(a.max()) + 2, 1 << 15))
    code = lambda x: sum((x[k : x.size - N + 1 + k].astype(np.int64) + 1) * base ** (N - 1 - k) for k in range(N))
    hits = np.flatnonzero(np.isin(code(b), code(a)))
    if not hits.size:
        return []
    span = 2 * a.size
    low, high = np.maximum(hits - span, 0), np.minimum(hits + N + span, b.size)
    new = np.concatenate(([True], low[1:] > high[:-1]))
    starts, ends = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, hits.size - 1)]
    out = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        out += [(s, e)] if e - s <= 4 * span else [(x, min(x + 2 * span, e)) for x in range(s, e - span, span)]
    return out


def align_share(item: list[str], doc: list[str]) -> float:
    """Share of the item's words that best local alignments with the document match.

    Alignments are taken one after another, best first, on the item words not matched yet, so a copy whose stretches were moved or parted is
    pieced together. One counts if it has N or more words in a row; its single words on the far side of an edit count as well. Time and memory grow with
    the document's stretches that share n-grams with the item, not with its length.
    """
    if len(item) < N or len(doc) < N:
        return 0.0
    if f" {' '.join(item)} " in f" {' '.join(doc)} ":
        return 1.0
    whole = np.ones(len(item), bool)
    step = PIECE - 2 * N
    for s in range(0, max(1, len(item) - 2 * N), step):
        codes: dict[str, int] = {}
        a = np.array([codes.setdefault(w, len(codes)) for w in item[s : s + PIECE]], np.int32)
        b = np.fromiter((codes.get(w, -1) for w in doc), np.int32, len(doc))
        free = whole[s : s + PIECE]  # a view: what one piece matched is taken for the next
        parts = [b[x:y] for x, y in _blocks(a, b)]
        found = [_aligned(a, free, p) for p in parts]
        while found and free.any():
            k = max(range(len(found)), key=lambda i: found[i][0])
            if found[k][0] < N:
                break
            taken = set(found[k][1])
            free[found[k][1]] = False
            # the other blocks' best alignments stay the best as long as all their words are free
            found = [_aligned(a, free, p) if not taken.isdisjoint(f[1]) else f for p, f in zip(parts, found, strict=True)]
    return float((~whole).sum()) / len(item)


def leaks(documents: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, share) of the documents that hold at least min_share of an item's words.

    Rows with a null key or a text that is null or has no words are no case; items shorter than N words never are. Repeated rows with one
    key count as one row each and give one result row. Very long texts are read as a whole.
    """
    docs, tests = prepared(documents, "doc_id"), cut(prepared(items, "item_id"))
    pairs = cut(candidates(docs, tests, min_share))
    n, words = tests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    scored = _scored_by_document(documents, pairs, tests, min_share) if n <= SENT_ITEMS and words <= SENT_WORDS else _scored_by_pair(documents, pairs, tests)
    return scored.filter(F.col("share") >= min_share).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _scored_by_document(documents: DataFrame, pairs: DataFrame, tests: DataFrame, min_share: float) -> DataFrame:
    """The items, which are few, go to every task; each document is read once and aligned with its candidates."""
    sent = documents.sparkSession.sparkContext.broadcast([(r["item_id"], list(r["words"])) for r in tests.select("item_id", "words").collect()])
    asked = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    rows = pick(documents, "doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for item, words in sent.value:
            known.setdefault(item, []).append(words)
        for pdf in frames:
            out = []
            for doc, text, wanted in zip(pdf["doc_id"], pdf["text"], pdf["items"], strict=True):
                words = normal_words(text)
                out += [(doc, i, share) for i in wanted for item in known[i] if (share := align_share(item, words)) >= min_share]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

    # hits are spread anew, as a source that holds most of them may lie in a few files
    hits = safe_join(rows, cut(asked), "doc_id").repartition(parallelism(documents.sparkSession))
    return hits.mapInPandas(score, "doc_id bigint, item_id bigint, share double")


def _scored_by_pair(documents: DataFrame, pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """Many items: each candidate is a row of its own; an item that is in very many documents is split over tasks."""
    hit = cut(pairs.select("doc_id").distinct())
    texts = prepared(safe_join(pick(documents, "doc_id", "text"), hit, "doc_id"), "doc_id").withColumnRenamed("words", "doc_words")
    both = skew_join(pairs, tests.withColumnRenamed("words", "item_words"), "item_id").join(texts, "doc_id")

    @F.pandas_udf("double")
    def share(item_words: pd.Series, doc_words: pd.Series) -> pd.Series:
        return pd.Series([align_share(list(a), list(b)) for a, b in zip(item_words, doc_words, strict=True)], dtype="float64")

    return both.select("doc_id", "item_id", share("item_words", "doc_words").alias("share"))
