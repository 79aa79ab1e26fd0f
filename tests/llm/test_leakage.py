import random
import tracemalloc

import numpy as np
import pytest

from anchorline.llm import leakage

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
RND = random.Random(5)
WORDS = [f"w{i}é" for i in range(3000)]


def passage(n):
    return RND.sample(WORDS, n)


ITEM = passage(60)
NOISE = lambda n: " ".join(passage(n))


def pieces(*cuts):
    return f" {NOISE(30)} ".join(" ".join(ITEM[a:b]) for a, b in cuts)


CASES = {
    1: (" ".join(ITEM), True),
    2: (f"{NOISE(50)} {' '.join(ITEM[10:45])} {NOISE(50)}", True),
    3: (pieces((40, 60), (0, 20)), True),
    4: (" ".join(ITEM).upper().replace(" ", " \xa0\n"), True),
    5: (" ".join(w.replace("é", "e") for w in ITEM), True),
    6: (" ".join(f"<b>{w}</b>[{i}]," if i % 5 == 0 else f"''{w}''" for i, w in enumerate(ITEM)), True),
    7: (" ".join(w if i % 6 else "other" for i, w in enumerate(ITEM)), True),
    8: (" ".join(f"{w} extra" if i % 5 == 4 else w for i, w in enumerate(ITEM)), True),
    9: (" ".join(ITEM[:18]), False),
    10: (" ".join(ITEM[i] for i in RND.sample(range(60), 60)), False),
    11: (NOISE(200), False),
    12: (None, False),
    13: ("", False),
    14: (f"{NOISE(20000 // 10)} {' '.join(ITEM)} {NOISE(2000)}", True),
    15: ("&eacute; " + " ".join(ITEM).replace("é", "&eacute;"), True),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [(None, " ".join(ITEM))], DOCS)
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, NOISE(60)), (9, None), (10, "too short"), (None, " ".join(ITEM))], ITEMS)
    return {(r.doc_id, r.item_id): r.share for r in leakage.leaks(docs, items).collect()}


@pytest.mark.parametrize("k", CASES)
def test_case(found, k):
    assert ((k, 7) in found) == CASES[k][1]


def test_nothing_else(found):
    assert {i for _, i in found} == {7}


def test_common_seeds_lose_nothing(spark):
    """An item made of n-grams that many items share is still found."""
    shared = " ".join(passage(40))
    items = [(i, shared) for i in range(20)] + [(100, shared + " " + NOISE(20))]
    docs = spark.createDataFrame([(1, shared), (2, NOISE(40))], DOCS)
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, i) for i, _ in items}


def test_words():
    assert leakage.normal_words("Ångmar’s «Žluť» <i>printing-house</i>[12] a&nbsp;b​") == ["angmars", "zlut", "printinghouse", "a", "b"]
    assert leakage.normal_words("が ガ ß Łø") == ["か", "カ", "ss", "lo"]
    assert leakage.normal_words(None) == []


def test_share_by_hand():
    item = list("abcdefghij")
    assert leakage.align_share(item, list("abcde") + ["x"] + list("fghij")) == 1.0
    assert leakage.align_share(item, list("ghij") + ["x"] * 9 + list("abcd")) == pytest.approx(0.8)
    assert leakage.align_share(item, list("abc") + ["x"] * 9 + list("efg")) == 0.0
    assert leakage.align_share([], item) == leakage.align_share(item, []) == 0.0


def test_empty_and_clashing(spark):
    docs, items = spark.createDataFrame([(1, " ".join(ITEM))], DOCS), spark.createDataFrame([(7, " ".join(ITEM))], ITEMS)
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0
    wide = docs.selectExpr("*", "'x' as TEXT", "1 as item_id", "'y' as words")
    assert leakage.leaks(wide.union(wide), items).count() == 1


def test_scattered_words_before_a_copy_hide_nothing():
    item = list("abcdefghijkl")
    copy = list("abcdef")
    assert leakage.align_share(item, copy) == pytest.approx(0.5)
    triples = list("ghi") + ["x"] + list("jkl") + ["x"] + list("abc") + ["y"] + list("def")
    assert leakage.align_share(item, [*triples, *["z"] * 3, *copy]) >= 0.5
    for k in range(6):
        assert leakage.align_share(item, [*triples, *["z"] * k, *copy, *["z"] * k, *triples]) >= 0.5


def held_by_brute_force(item, doc):
    """Best score over all alignments with N matches in a row, cell by cell with the length of the run as part of the state."""
    n, none = leakage.N, -(10**6)
    rows = [[[none] * (n + 1) for _ in range(len(doc) + 1)] for _ in range(len(item) + 1)]
    best = none
    for i in range(len(item) + 1):
        for j in range(len(doc) + 1):
            cell = rows[i][j]
            cell[0] = max(cell[0], 0)
            if i and j:
                before = rows[i - 1][j - 1]
                if item[i - 1] == doc[j - 1]:
                    for r in range(n):
                        cell[r + 1] = max(cell[r + 1], before[r] + 1)
                    cell[n] = max(cell[n], before[n] + 1)
                else:
                    cell[0] = max(cell[0], max(before[:n]) - 1)
                    cell[n] = max(cell[n], before[n] - 1)
            for prev in ([rows[i - 1][j]] if i else []) + ([rows[i][j - 1]] if j else []):
                cell[0] = max(cell[0], max(prev[:n]) - 1)
                cell[n] = max(cell[n], prev[n] - 1)
            best = max(best, cell[n])
    return best if best >= n else 0


def test_alignment_against_brute_force():
    rnd = random.Random(11)
    for _ in range(300):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randrange(4, 14))] for _ in range(2))
        if rnd.random() < 0.5:
            b[2:2] = a[1:7]
        codes = {w: i for i, w in enumerate("abcdef")}
        x, y = (np.array([codes[w] for w in v], np.int32) for v in (a, b))
        score, path = leakage._aligned(x, np.ones(x.size, bool), y)
        assert score == held_by_brute_force(a, b)
        assert len(path) == len(set(path)) and len(path) >= score


def test_long_document_takes_little_memory():
    """300,000 words with two copies far apart; also an item longer than what is aligned at once."""
    rnd = random.Random(3)
    item = [f"i{k}" for k in range(100)]
    doc = [f"d{rnd.randrange(5000)}" for _ in range(300_000)]
    doc[1000:1000], doc[250_000:250_000] = item[:40], item[40:80]
    tracemalloc.start()
    assert leakage.align_share(item, doc) == pytest.approx(0.8)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    long = [f"l{k}" for k in range(3000)]
    assert leakage.align_share(long, ["x", *long[500:2500], "y"]) == pytest.approx(2 / 3, abs=0.01)


def test_many_items_go_by_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], DOCS)
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, NOISE(60))], ITEMS)
    few = {(r.doc_id, r.item_id, round(r.share, 9)) for r in leakage.leaks(docs, items).collect()}
    monkeypatch.setattr(leakage, "SENT_ITEMS", 0)
    monkeypatch.setattr(leakage, "bounded", lambda df: False)
    assert {(r.doc_id, r.item_id, round(r.share, 9)) for r in leakage.leaks(docs, items).collect()} == few
