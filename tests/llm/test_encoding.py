import html

import pytest

from anchorline.llm import encoding

DOCS = "doc_id bigint, text string"
#: Correct texts; each word is in many documents.
CLEAN = ["Brânto crossed the gärten near Łuskar — “Vêloz” sold Çamdir’s façade", "зелёный щавель ёжик вьюга", "πάπώ μεθόν κίσσα", "żółć gęś źdźbło", "RELAÇÃO CORAÇÃO √2 × 3 ≈ 4.24 µm ± 0.1 °C 12 € — 15 £ ™ ©", "řeřicha kůň žlutý"]
PART = CLEAN[0]


def wrong(text, *steps):
    for a, b in steps:
        text = "".join(bytes([x]).decode(b, "ignore") or chr(x) for x in text.encode(a)) if b not in ("utf-8",) else text.encode(a).decode(b, "replace")
    return text


GARBLED = {
    "utf-8 as cp1252": wrong(PART, ("utf-8", "cp1252")),
    "utf-8 as latin-1": wrong(PART, ("utf-8", "latin-1")),
    "utf-8 as cp1250": wrong(PART, ("utf-8", "cp1250")),
    "utf-8 as cp437": wrong(PART, ("utf-8", "cp437")),
    "utf-8 as mac_roman": wrong(PART, ("utf-8", "mac_roman")),
    "twice": wrong(wrong("Vêloz sold a façade", ("utf-8", "cp1252")), ("utf-8", "cp1252")),
    "escaped": html.escape(wrong(PART, ("utf-8", "cp1252"))).encode("ascii", "xmlcharrefreplace").decode(),
    "lost": "the gärten Brânto façade".encode("cp1252").decode("utf-8", "replace"),
    "koi8 as cp1251": wrong(CLEAN[1], ("koi8-r", "cp1251")),
    "cp1251 as latin-1": wrong(CLEAN[1], ("cp1251", "latin-1")),
    "greek as cp1252": wrong(CLEAN[2], ("cp1253", "cp1252")),
    "polish as cp1252": wrong(CLEAN[3], ("cp1250", "cp1252")),
    "utf-8 as cp1251": wrong(CLEAN[1], ("utf-8", "cp1251")),
    "czech as cp1252": wrong(CLEAN[5], ("cp1250", "cp1252")),
}


@pytest.fixture(scope="module")
def tables(spark):
    clean = [(i, f"{CLEAN[i % len(CLEAN)]} plain") for i in range(240)]
    bad = [(1000 + i, f"Some words before. {t} And after.") for i, t in enumerate(GARBLED.values())]
    odd = [(2000, None), (2001, ""), (2002, "plain ascii &amp; &eacute;"), (2003, "x" * 1_000_000 + " é"), (None, bad[0][1])]
    docs = spark.createDataFrame(clean + bad + odd, DOCS)
    return {r.doc_id for r in encoding.garbled_documents(docs).collect()}, {r.doc_id: r for r in encoding.restored_documents(docs).collect()}


@pytest.mark.parametrize("name", GARBLED)
def test_found(tables, name):
    assert 1000 + list(GARBLED).index(name) in tables[0]


def test_nothing_else(tables):
    assert all(1000 <= i < 1000 + len(GARBLED) for i in tables[0])


@pytest.mark.parametrize("name", ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp437", "utf-8 as mac_roman", "escaped", "koi8 as cp1251", "polish as cp1252"])
def test_restored(tables, name):
    original = CLEAN[1] if name.startswith("koi8") else CLEAN[3] if name.startswith("polish") else PART
    assert original in tables[1][1000 + list(GARBLED).index(name)].text


def test_forms_never_hold_the_word_itself():
    for w in ("Brânto", "щавель", "—", "plain"):
        assert w not in encoding.garbled_forms(w)
    assert encoding.garbled_forms("plain") == {}


def test_empty_and_clashing(spark):
    assert encoding.garbled_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert encoding.restored_documents(spark.createDataFrame([], DOCS)).count() == 0
    wide = spark.createDataFrame([(1, "é"), (1, "é")], DOCS).selectExpr("*", "'q' as TEXT", "'z' as word")
    assert encoding.garbled_documents(wide).count() == 0


def test_copies_of_a_garbled_text_count_once(spark):
    """A third of all rows is one garbled text: its words are in more rows than half of their originals'."""
    clean = [(i, f"{PART} number {i}") for i in range(20)]
    copies = [(1000 + i, f"Copied. {GARBLED['utf-8 as cp1252']} {GARBLED['koi8 as cp1251']} end") for i in range(15)]
    words = [(500 + i, f"{CLEAN[1]} number {i}") for i in range(20)]
    docs = spark.createDataFrame(clean + words + copies, DOCS)
    assert {r.doc_id for r in encoding.garbled_documents(docs).collect()} == {i for i, _ in copies}


def test_forms_more_frequent_than_their_originals(spark):
    """More distinct texts are garbled in one way than there are correct ones."""
    clean = [(i, f"{t} number {i}") for i in range(10) for t in CLEAN[:1]] + [(100 + i, f"{CLEAN[3]} number {i}") for i in range(10)]
    bad = [(1000 + i, f"{GARBLED[k]} number {i}") for k, at in (("utf-8 as cp1252", 0), ("polish as cp1252", 30)) for i in range(at, at + 30)]
    docs = spark.createDataFrame(clean + bad, DOCS)
    assert {r.doc_id for r in encoding.garbled_documents(docs).collect()} == {i for i, _ in bad}


def test_reversal():
    for chain, steps in {"cp1251>koi8-r": [("cp1251", "koi8-r")], "cp866>cp1251": [("cp866", "cp1251")], "utf-8>cp1252>cp1252": [("utf-8", "cp1252")] * 2, "utf-8>mac_roman": [("utf-8", "mac_roman")]}.items():
        assert encoding.reversal(wrong(CLEAN[1], *steps), chain) == CLEAN[1]
    assert encoding.reversal("щавель", "cp1250>cp1252") is None and encoding.reversal("plain é", "utf-8>cp1252") is None


def test_short_and_new_words_of_the_own_chain_are_restored(spark):
    """Words under three characters and words in no other document, in a text garbled by one one-byte encoding read as another."""
    text = "зелёный щавель ёжик вьюга мы ещё неведомка щавель"
    clean = [(i, f"{CLEAN[1]} мы number {i}") for i in range(20)]
    half = "мы вьюга. " + wrong("зелёный щавель мы ёжик", ("cp1251", "koi8-r")) + " мы вьюга ЩУКИН"
    docs = spark.createDataFrame([*clean, (100, wrong(text, ("cp1251", "koi8-r"))), (101, wrong(text, ("cp866", "cp1251"))), (102, half)], DOCS)
    got = {r.doc_id: r for r in encoding.restored_documents(docs).collect()}
    assert got[100].text == text and got[101].text == text and got[100].n_left == got[101].n_left == 0
    assert got[102].text == "мы вьюга. зелёный щавель мы ёжик мы вьюга ЩУКИН" and got[102].n_left == 1


def test_originals_in_one_document_and_long_runs(spark):
    """A word attested once; runs of a script without spaces, longer than words are."""
    thai = "".join(chr(0x0E01 + i * 7 % 46) for i in range(120))
    runs = {n: thai[: n // 2] + thai[-(n - n // 2) :] for n in (40, 99, 101, 120)}
    clean = [(i, f"{runs[n]} number {i}") for i, n in enumerate([*runs] * 10)] + [(100, "einmal würzig gesagt"), (101, "plain words only")]
    bad = [(1000 + n, f"before {wrong(r, ('utf-8', 'cp1252'))} after") for n, r in runs.items()] + [(2000, "gar " + wrong("würzig", ("utf-8", "cp1252")))]
    docs = spark.createDataFrame(clean + bad, DOCS)
    assert {r.doc_id for r in encoding.garbled_documents(docs).collect()} == {i for i, _ in bad}
    got = {r.doc_id: r.text for r in encoding.restored_documents(docs).collect()}
    assert got == {1000 + n: f"before {r} after" for n, r in runs.items()} | {2000: "gar würzig"}


def test_correct_references_stay(spark):
    bad = wrong("façade", ("utf-8", "cp1252"))
    escaped = bad.encode("ascii", "xmlcharrefreplace").decode()
    docs = spark.createDataFrame([(i, f"a façade {i}") for i in range(5)] + [(10, f"AT&amp;T &lt;code&gt; {bad} &eacute;&nbsp;x"), (11, f"&quot;{escaped}&quot; &amp;c. {bad}")], DOCS)
    got = {r.doc_id: r.text for r in encoding.restored_documents(docs).collect()}
    assert got == {10: "AT&amp;T &lt;code&gt; façade &eacute;&nbsp;x", 11: "&quot;façade&quot; &amp;c. façade"}


def test_replaced_keeps_what_it_does_not_touch():
    assert encoding.replaced("a&amp;b&eacute;c", [(2, 4, "X")]) == "a&amp;Xc"
    assert encoding.replaced("&eacute;&eacute;", [(0, 1, "X"), (1, 2, "Y")]) == "XY"
    assert encoding.replaced("plain", []) == "plain" and encoding.replaced("plain", [(0, 5, "")]) == ""
    assert encoding.replaced("&lt;xy&gt;", [(1, 3, "Z")]) == "&lt;Z&gt;"


def test_every_form_passes_the_filter_of_its_words(spark):
    forms = [g for w in ("façade", "щавель") for g in encoding.garbled_forms(w)]
    df = spark.createDataFrame([(encoding.join_key(g),) for g in forms], "key string")
    bits = encoding._filter_of(df, "key", len(forms))
    assert all(encoding._may_be(encoding.join_key(g), bits) for g in forms)


def test_controls_are_signs_by_themselves(spark):
    """One dash that became a control character; a next-line character is correct."""
    docs = spark.createDataFrame([(1, "a — b"), (2, "c — d…"), (3, "x \x97 y"), (4, "line\x85next é"), (5, "é")], DOCS)
    assert [r.doc_id for r in encoding.garbled_documents(docs).collect()] == [3]
    assert encoding.restored_documents(docs).first().text == "x — y"
