"""Text that was decoded with the wrong character encoding, and what it was before.

Every distinct word of the corpus is put through all chains of wrong decodings; the documents' words are hash-joined
against this table of garbled forms. Which hits count is decided afterwards, by evidence: if the original is in so many documents or distinct texts beside the garbled form that the latter can't be a
word of its own, or if several words of the document are forms with foreign signs by one chain, however frequent the forms are. Nothing is guessed from
single characters, so rare but correct signs stay.

Two kinds of words are compared: words between white space without ASCII punctuation at their ends, and runs of non-ASCII characters, which
UTF-8 read in a one-byte encoding turns into runs again, so that a new word is found by its accented part.
"""

from __future__ import annotations

import codecs
import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.bloom import as_bytes, bits_of
from anchorline.operators.skew import safe_join
from anchorline.session import broadcast_if_bounded, cut, pick

#: One-byte encodings and multi-byte ones that texts are mistaken for, fixed.
ONE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-r", "mac_roman", "mac_cyrillic", "cp437", "cp737", "cp850", "cp852", "cp866")
MULTI_BYTE = ("cp932", "euc_jp", "gbk", "big5")
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman")

#: How many times as frequent as its garbled form a word must be for the form to count by its frequency: as frequent where UTF-8 was read as another
#: encoding and left signs among letters, which chance doesn't, more where the form could be a word of its own.
MIN_RATIO, MIN_RATIO_OTHER = 1, 6
#: A form that looks like a word (letters of one script) counts only in documents with so many of them, or if it has so many characters.
MIN_WORDLIKE, MIN_LONE = 2, 5
#: Words of a document that one chain must explain where the forms are too frequent for these ratios: forms with signs that no word has, and forms like words.
MIN_SHARED, MIN_SHARED_OTHER = 2, 3
#: Documents in which a word counts as attested when a text is read back.
ATTESTED = 2
#: Longer words, as runs of scripts without spaces are, are joined by their digests.
LONG = 100
#: Bits of the filter of all words that garbled forms are held against, 16 megabytes.
WORD_BITS = 1 << 27

_SPLIT = re.compile(r"[^ \t\r\n]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ENDS = ".,;:()[]'\"*|{}=<>!?"
#: What no word holds, however read: control characters (but for the one that ends a line) and drawing characters between letters.
_NEVER = re.compile(r"[\x80-\x84\x86-\x9f]|(?<=[^\W\d_])[\u2320\u2321\u2500-\u259f](?=[^\W\d_])")
_CONTROLS = dict.fromkeys(range(0x80, 0xA0))


def _table(encoding: str, hole: str) -> str:
    """How each byte reads in a one-byte encoding. hole: what a byte without a meaning becomes; U+FFFE stands for nothing."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append({"kept": chr(b), "marked": "�", "lost": "\ufffe"}[hole])
    return "".join(out)


_TABLES = {(e, h): _table(e, h) for e in ONE_BYTE for h in ("kept", "marked", "lost")}
#: The bytes without a meaning in an encoding.
_HOLES = {e: frozenset(b for b, c in enumerate(_TABLES[e, "lost"]) if c == "\ufffe") for e in ONE_BYTE}
_BACK = {e: {v: chr(b) for b, v in enumerate(_TABLES[e, "kept"])} for e in ONE_BYTE}


def _read(data: bytes, encoding: str, hole: str) -> str:
    return codecs.charmap_decode(data, "ignore", _TABLES[encoding, hole])[0]


def _wordlike(form: str) -> bool:
    """Letters of one script only; ª and º, which are letters for Unicode, are signs here."""
    if not form.isalpha() or "ª" in form or "º" in form:
        return False
    latin = [c < "\u0250" for c in form]
    return all(latin) or not any(latin)


def _readings(data: bytes, encoding: str) -> list[tuple[str, str]]:
    """(text, hole): how data reads in a one-byte encoding, three ways if it has bytes without a meaning there."""
    return [(_read(data, encoding, h), h) for h in (("kept",) if _HOLES[encoding].isdisjoint(data) else ("kept", "marked", "lost"))]


def readings(word: str) -> Iterator[tuple[str, str, bool]]:
    """(form, chain, whether nothing was lost but what a sign marks) of a word under all chains of wrong decodings.

    The chains: UTF-8 read as another encoding once or twice, with bytes that have no meaning there kept, marked or lost; with control characters or no-break
    spaces lost afterwards; another encoding read as UTF-8; and one encoding read as another.
    """
    data = word.encode("utf-8", "surrogatepass")
    once = set()
    for e in ONE_BYTE:
        for g, hole in _readings(data, e):
            yield g, f"utf-8>{e}", hole != "lost"
            again = g.encode("utf-8", "surrogatepass")
            second = (e,) if g in once else dict.fromkeys((*TWICE, e))  # encodings that read the word alike
            once.add(g)
            for e2 in second:
                yield _read(again, e2, hole), f"utf-8>{e}>{e2}", hole != "lost"
    for e in ONE_BYTE:
        g = _read(data, e, "kept")
        yield g.translate(_CONTROLS), f"utf-8>{e}, controls lost", False
        yield g.replace("\xa0", ""), f"utf-8>{e}, spaces lost", False
    written = set()
    for source in (*ONE_BYTE, *MULTI_BYTE):
        try:
            own = word.encode(source)
        except UnicodeEncodeError:
            continue
        if own in written:  # encodings that write the word alike
            continue
        written.add(own)
        g = own.decode("utf-8", "replace")
        if "�" in g:  # what UTF-8 can read without loss is the original, and word its garbled form
            yield g, f"{source}>utf-8", len(word) > 2
            yield own.decode("utf-8", "ignore"), f"{source}>utf-8", False
        for e in ONE_BYTE:
            if e != source:
                for g, _ in _readings(own, e):
                    yield g, f"{source}>{e}", False
    for e in MULTI_BYTE:
        for errors in ("replace", "ignore"):
            yield data.decode(e, errors), f"utf-8>{e}", False


def _odd_case(word: str) -> bool:
    """Whether a capital follows a small letter and none starts the word, as where the cases of two encodings are swapped."""
    return word[:1].islower() and any(c.isupper() for c in word)


def _judged(word: str, g: str, chain: str, certain: bool) -> tuple[str, int, bool, bool] | None:
    """(chain, times that the original must be as frequent, whether it is a sign by itself, whether only the original looks like a word), if g can count at all."""
    wordlike, letters = _wordlike(g), _wordlike(word)
    if _NEVER.search(g) and not _NEVER.search(word):
        return chain, MIN_RATIO, True, True
    certain = certain and not wordlike
    if len(g) < (2 if certain else 3) or g.isascii() or g == word or not g.strip("�"):
        return None
    grown = chain.startswith("utf-8>") and len(word) > 2 and len(g) > len(word)
    strong = letters and (not wordlike or (_odd_case(g) and not _odd_case(word)))
    return chain, MIN_RATIO if certain else MIN_RATIO_OTHER, grown or not wordlike or len(g) >= MIN_LONE, strong


def garbled_forms(word: str) -> dict[str, tuple[str, int, bool, bool]]:
    """Garbled form -> (chain, times that the original must be as frequent, whether it is a sign by itself, whether only the original looks like a word)."""
    first: dict[str, tuple[str, bool]] = {}
    for g, chain, certain in readings(word):
        first.setdefault(g, (chain, certain))
    judged = {g: _judged(word, g, *how) for g, how in first.items()}
    return {g: how for g, how in judged.items() if how}


def join_key(word: str) -> str:
    """What words are joined by: the word, or its digest if it is long, so that no form of a long word is stored."""
    return word if len(word) <= LONG else "\0" + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def _key(word: Column) -> Column:
    return F.when(F.length(word) <= LONG, word).otherwise(F.concat(F.lit("\0"), F.md5(word)))


def unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def words_of(text: str | None) -> list[str]:
    """Distinct words with non-ASCII characters, and the runs of such characters in them."""
    found: dict[str, None] = {}
    for w in _SPLIT.findall(unescaped(text or "")):
        if w.isascii():
            continue
        w = w.strip(_ENDS)
        found[w] = None
        found.update(dict.fromkeys(_RUN.findall(w)))
    return list(found)


def document_words(docs: DataFrame, among: bytes | None = None) -> DataFrame:
    """(doc_id, text_key, word), distinct for each row; rows without a text or without non-ASCII characters have none. Equal texts have the same text_key.

    among: a filter of join keys; words that certainly aren't among them are left out before they become rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(among) if among else None

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        if held is None:
            return texts.map(words_of)
        bits = held.value
        return texts.map(lambda t: [w for w in words_of(t) if _may_be(join_key(w), bits)])

    marked = pick(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]|&[#A-Za-z]")).select("doc_id", "text")
    return marked.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(words("text")).alias("word"))


def _may_be(key: str, bits: bytes) -> bool:
    """Whether the filter may hold the key; the hash is that of xxhash64 in SQL."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42) & (len(bits) * 8 - 1)
    return bits[h >> 3] >> (h & 7) & 1 == 1


def _filter_of(df: DataFrame, key: str, n: int) -> bytes:
    return as_bytes(bits_of(df, F.xxhash64(key), n, WORD_BITS))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n_docs, n_texts, n_folded, n_folded_texts): documents and distinct texts with the word, copies of a text counting once in the latter.

    The folded counts are those of all spellings that differ in letter case only.
    """
    of_text = words.groupBy("word", "text_key").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(of_text.groupBy("word").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts")))
    folded = counts.groupBy(F.lower("word").alias("fold")).agg(F.sum("n_docs").alias("n_folded"), F.sum("n_texts").alias("n_folded_texts"))
    return counts.withColumn("fold", F.lower("word")).join(folded, "fold").drop("fold")


def garble_table(vocab: DataFrame) -> DataFrame:
    """(key, origin, chain, alone, shared) of the words of vocab that are or can be a garbled form of another word; vocab should be cut.

    All words are put through all chains. A form goes on only if the filter of all words of the corpus may hold it, so that the thousand forms of a
    word are tested where they are made and hardly more rows leave the task than are joined.

    shared: how many words of a document its chain must explain for the form to count, 0 if its frequency tells already. A form that looks like a word
    and is more than half as frequent as its original is left out, as the original could as well be the garbled one. Of several originals one that needs no
    further words is taken first, then the most frequent one, then the least.
    """
    vocab = vocab.withColumn("key", _key(F.col("word")))
    sc = vocab.sparkSession.sparkContext
    held = sc.broadcast(_filter_of(vocab, "key", vocab.count()))

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        mask, hashed = len(bits) * 8 - 1, xxhash.xxh64_intdigest
        columns = ["key", "origin", "n_origin", "n_origin_texts", "chain", "ratio", "alone", "strong"]
        for pdf in frames:
            rows = []
            for word, n, m in zip(pdf["word"], pdf["n_docs"], pdf["n_texts"], strict=True):
                seen = set()
                for g, chain, certain in readings(word):
                    if g in seen or g.isascii():
                        continue
                    if len(g) <= LONG:  # forms of longer words aren't held together
                        seen.add(g)
                    key = join_key(g)
                    h = hashed(key.encode("utf-8", "surrogatepass"), 42) & mask  # as in _may_be
                    if bits[h >> 3] >> (h & 7) & 1 and (how := _judged(word, g, chain, certain)):
                        rows.append((key, word, n, m, *how))
            yield pd.DataFrame(rows, columns=columns)

    # words are handed out evenly: one word has a thousand forms
    spread = vocab.select("word", "n_docs", "n_texts").repartition(sc.defaultParallelism * 4)
    made = cut(spread.mapInPandas(forms, "key string, origin string, n_origin bigint, n_origin_texts bigint, chain string, ratio int, alone boolean, strong boolean"))
    hits = safe_join(vocab.select("key", "word", "n_folded", "n_folded_texts"), made, "key")
    ratio = F.col("ratio")
    rare = (F.col("n_origin") >= ratio * F.col("n_folded")) | (F.col("n_origin_texts") >= ratio * F.col("n_folded_texts"))
    twice = (F.col("n_origin") >= 2 * F.col("n_folded")) | (F.col("n_origin_texts") >= 2 * F.col("n_folded_texts"))
    sign = F.col("alone") & (ratio == MIN_RATIO) & (F.col("chain").rlike("^utf-8>[^,]+$") | F.col("word").contains("�"))
    one_byte = F.col("chain").rlike("^[^,>]+>[^,>]+$") & ~F.col("chain").rlike("utf-8")
    shared = F.when(rare, 0).when(sign | (one_byte & F.col("strong")), MIN_SHARED).when(one_byte & twice & F.col("origin").rlike(r"^[\p{L}&&[^ªº]]+$"), MIN_SHARED_OTHER)
    kept = hits.withColumn("shared", shared).filter("shared is not null")
    best = kept.groupBy("key").agg(F.min(F.struct((F.col("shared") > 0).alias("more"), (-F.col("n_origin")).alias("n"), "origin", "chain", "alone", "shared")).alias("best"))
    return best.select("key", "best.origin", "best.chain", "best.alone", "best.shared")


def _by_shared_chain(hits: Column) -> Column:
    """The hits that count by themselves or because enough words of the document have the same chain; a word and a run in it are no two."""
    run = r"^[^\x00-\x7f]+$"

    def explained(chain: Column) -> Column:
        of = F.filter(hits, lambda h: h["chain"] == chain)
        whole = F.filter(of, lambda h: ~h["word"].rlike(run))
        return F.size(whole) + F.size(F.filter(of, lambda h: h["word"].rlike(run) & ~F.exists(whole, lambda w: w["word"].contains(h["word"]))))

    chains = F.array_distinct(F.transform(hits, lambda h: h["chain"]))
    counts = F.map_from_arrays(chains, F.transform(chains, explained))
    return F.filter(hits, lambda h: (h["shared"] == 0) | (counts[h["chain"]] >= h["shared"]))


def garbled_words(docs: DataFrame) -> DataFrame:
    """(doc_id, hits): each garbled document with the array of its garbled words (word, origin, chain).

    A document with a null key or text has none. The words are taken from the texts twice rather than stored, as the texts are read
    faster than they would be written.
    """
    return _hits(docs, cut(vocabulary(document_words(docs))))


def _hits(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    table = cut(garble_table(vocab))
    words = document_words(docs, _filter_of(table, "key", table.count())).withColumn("key", _key(F.col("word")))
    found = safe_join(words, table, "key").groupBy("doc_id").agg(F.collect_set(F.struct("word", "origin", "chain", "alone", "shared")).alias("hits"))
    found = found.select("doc_id", _by_shared_chain(F.col("hits")).alias("hits"))
    return found.filter(F.exists("hits", lambda h: h["alone"]) | (F.size("hits") >= MIN_WORDLIKE))


def garbled_documents(docs: DataFrame) -> DataFrame:
    """(doc_id) with at least one garbled word."""
    return garbled_words(docs).select("doc_id")


def reversal(form: str, chain: str) -> str | None:
    """What form was before it went through chain, None if that can't be told without loss."""
    own, *read = chain.split(">")
    try:
        for e in reversed(read):
            back = _BACK.get(e)
            data = form.encode(e) if back is None else "".join([back[c] for c in form]).encode("latin-1")
            form = data.decode(own)
    except (UnicodeError, KeyError, LookupError):
        return None
    return form


def _chains(hits: list[tuple[str, str, str]]) -> tuple[list[str], list[str]]:
    """The reversible chains of a document's hits, those with most steps and hits first: from UTF-8, where valid bytes prove themselves, and others."""
    n: dict[str, int] = {}
    for _, _, c in hits:
        if "," not in c and not c.endswith(">utf-8"):
            n[c] = n.get(c, 0) + 1
    order = sorted(n, key=lambda c: (-c.count(">"), -n[c], c))
    return [c for c in order if c.startswith("utf-8>")], [c for c in order if not c.startswith("utf-8>")]


def reversible_words(text: str, hits: list[tuple[str, str, str]]) -> dict[str, str]:
    """Word -> what it was, of the words outside of hits that a chain other than from UTF-8 changes without loss."""
    origin, others, out = {w for w, _, _ in hits}, _chains(hits)[1], {}
    for w in _SPLIT.findall(unescaped(text)) if others else ():
        core = w.strip(_ENDS)
        if not w.isascii() and core not in origin and core not in out:
            was = next((r for c in others if (r := reversal(core, c)) not in (None, core)), None)
            if was is not None:
                out[core] = was
    return out


#: A character reference, fixed with the grammar of HTML.
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def replaced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """text after edits (start, end, new) of its unescaped form, in order; what no edit touches keeps its character references."""
    if not edits:
        return text
    # stretches (start in the unescaped text, start in text) between which both run alike or one reference stands
    marks, at, last = [], 0, 0
    for m in _ENTITY.finditer(text) if "&" in text else ():
        marks += [(at, last, 1), (at + m.start() - last, m.start(), 0)]
        at, last = at + m.start() - last + len(html.unescape(m[0])), m.end()
    marks.append((at, last, 1))
    starts = [m[0] for m in marks]

    def place(i: int, end: bool) -> int:
        """The place in text of place i of the unescaped text; inside a reference, its start or end."""
        k = bisect_right(starts, i) - 1
        while end and k and starts[k] == i:  # an end belongs to the stretch before
            k -= 1
        u, t, alike = marks[k]
        if alike:
            return t + i - u
        return marks[k + 1][1] if end and i > u else t

    out, done = [], 0
    for start, end, new in edits:
        a = place(start, False)
        if a < done:  # both edits are inside of one reference
            continue
        out += [text[done:a], new]
        done = place(end, True)
    return "".join(out) + text[done:]


def restore(text: str, hits: list[tuple[str, str, str]], known: dict[str, tuple[str, int, int]] | None = None) -> tuple[str, int, int]:
    """The text with garbled words replaced, the number of replacements, and of stretches that stayed garbled.

    Words that aren't among hits are read back by the document's own chains where that is possible without loss. Valid UTF-8 proves itself; for other chains
    known has for each such word what it was and the documents with either. The word is read back if its earlier form is more frequent or alone looks like
    a word, kept if only it is attested, and else read back where the nearest decided words on both sides are garbled. Undecided ones count as left.
    Everything outside of the replaced stretches stays as it is, character references too.
    """
    t, edits, open_left = unescaped(text), [], 0
    known = known or {}
    origin = {w: o for w, o, _ in hits}
    runs = {w: o for w, o in origin.items() if _RUN.fullmatch(w)}
    whole = sorted((w for w in origin if w not in runs or len(w) > 1), key=len, reverse=True)
    utf8, others = _chains(hits)

    def by_chain(run: str) -> str | None:
        return next((r for c in utf8 if (r := reversal(run, c)) is not None), None)

    def state(w: str) -> bool | None:
        """Whether the word is garbled, None if that is open."""
        core = w.strip(_ENDS)
        if w.isascii():
            return None
        if core in origin:
            return True
        if core not in known:
            return None if any(reversal(core, c) == core for c in others) else any(r in runs or by_chain(r) is not None for r in _RUN.findall(w))
        was, n_was, n = known[core]
        if (n_was > n and n_was >= ATTESTED) or (_wordlike(was) and not _wordlike(core) and (n < ATTESTED or n <= n_was)):
            return True
        return False if n >= ATTESTED > n_was else None

    words = _SPLIT.findall(t) if known else []
    judged = dict(zip(words, map(state, words), strict=True)) if known else {}
    before, after, last = [], [], None
    for w in words:
        before.append(last)
        last = last if judged[w] is None else judged[w]
    last = None
    for w in reversed(words):
        after.append(last)
        last = last if judged[w] is None else judged[w]
    around = iter(zip(before, reversed(after), strict=True))
    for m in _SPLIT.finditer(t):
        w = m[0]
        sides = next(around) if known else ()
        if w.isascii():
            continue
        core = w.strip(_ENDS)
        at = m.start() + w.index(core)
        if core in origin:
            edits.append((at, at + len(core), origin[core]))
            continue
        if core in known and judged[w] is not False:
            if judged[w] or (True in sides and False not in sides):
                edits.append((at, at + len(core), known[core][0]))
                continue
            open_left += 1
        for r in _RUN.finditer(w):
            new = runs.get(r[0]) or by_chain(r[0])
            if new is not None:
                edits.append((m.start() + r.start(), m.start() + r.end(), new))
    out = replaced(text, edits)
    now = unescaped(out)
    still = set(_SPLIT.findall(now))
    return out, len(edits), now.count("�") + sum(w in still for w in whole) + open_left


def restored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_restored, n_left): the garbled documents with their originals put back where they can be known."""
    vocab = cut(vocabulary(document_words(docs)))
    rows = safe_join(pick(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull()), cut(_hits(docs, vocab)), "doc_id")

    def plain(hits: list) -> list[tuple[str, str, str]]:
        return [(h["word"], h["origin"], h["chain"]) for h in sorted(hits, key=lambda h: h["word"])]

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(i, w, was) for i, t, hs in zip(pdf["doc_id"], pdf["text"], pdf["hits"], strict=True) for w, was in reversible_words(t, plain(hs)).items()]
            yield pd.DataFrame(out, columns=["doc_id", "word", "was"])

    # few documents have hits, and fewer by a chain that isn't from UTF-8
    asked = cut(rows.mapInPandas(candidates, "doc_id bigint, word string, was string"))
    counts = cut(vocab.join(broadcast_if_bounded(asked.select("word").union(asked.select("was")).distinct()), "word", "semi").select("word", "n_docs", "n_folded"))
    by_was = broadcast_if_bounded(counts.select(F.col("word").alias("was"), F.col("n_docs").alias("n_was")))
    both = asked.join(broadcast_if_bounded(counts.select("word", "n_folded")), "word", "left").join(by_was, "was", "left")
    pair = F.struct("word", "was", F.coalesce("n_was", F.lit(0)).alias("n_was"), F.coalesce("n_folded", F.lit(0)).alias("n"))
    known = cut(both.groupBy("doc_id").agg(F.collect_set(pair).alias("known")))
    rows = rows.join(broadcast_if_bounded(known), "doc_id", "left").select("doc_id", "text", "hits", F.coalesce("known", F.array().cast(known.schema["known"].dataType)).alias("known"))

    def fix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            given = zip(pdf["text"], pdf["hits"], pdf["known"], strict=True)
            out = [restore(t, plain(hs), {k["word"]: (k["was"], k["n_was"], k["n"]) for k in ks}) for t, hs, ks in given]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [x[0] for x in out], "n_restored": [x[1] for x in out], "n_left": [x[2] for x in out]})

    return rows.mapInPandas(fix, "doc_id bigint, text string, n_restored bigint, n_left bigint")
