"""Recall, precision and restored texts of problem 9 on texts garbled here: python -m tests.llm.measure_encoding [folder].

Every twentieth text with non-ASCII words that isn't found as it is goes through a wrong decoding that loses nothing, as a whole or in one to three words.
Each threshold is then varied by itself.
"""

import random
import re
import sys

from anchorline.llm import encoding
from anchorline.session import build_session, cut, read_table

CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1"), ("cp1250", "cp1252"), ("cp1252", "cp850"), ("cp1253", "cp1252")]
VARIED = [("MIN_RATIO", 2), ("MIN_RATIO_OTHER", 3), ("MIN_RATIO_OTHER", 12), ("MIN_WORDLIKE", 1), ("MIN_LONE", 5), ("MIN_LONE", 99), ("MIN_SHARED_OTHER", 2)]


def garbled(text: str, rnd: random.Random) -> str | None:
    words = re.findall(r"\S+|\s+", text)
    odd = [i for i, w in enumerate(words) if not w.isascii()]
    if not odd:
        return None
    start = rnd.choice(odd)
    part = range(len(words)) if rnd.random() < 0.5 else range(start, min(len(words), start + rnd.choice((1, 3, 5))))
    chains = CHAINS[:]
    rnd.shuffle(chains)
    for source, read in chains:
        try:
            new = [w.encode(source).decode(read) if i in part else w for i, w in enumerate(words)]
            if new != words and all(a.encode(read).decode(source) == b for i, (a, b) in enumerate(zip(new, words)) if i in part):
                return "".join(new)
        except UnicodeError:
            continue
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    before = {r.doc_id for r in encoding.garbled_documents(docs).collect()}
    rnd, rows, original = random.Random(9), [], {}
    for r in docs.collect():
        text = r.text
        if text and r.doc_id not in before and not text.isascii() and rnd.random() < 0.05 and (bad := garbled(text, rnd)):
            original[r.doc_id], text = text, bad
        rows.append((r.doc_id, text))
    mixed = cut(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    for name, value in [("as it is", None), *VARIED]:
        kept = getattr(encoding, name, None)
        if value is not None:
            setattr(encoding, name, value)
        found = {r.doc_id for r in encoding.garbled_documents(mixed).collect()}
        extra = found - set(original) - before
        print(f"{name} {'' if value is None else value}: {len(original)} garbled, recall {len(found & set(original)) / len(original):.4f}, others found {len(extra)}, found before and lost {len(before - found)}", flush=True)
        if value is not None:
            setattr(encoding, name, kept)
    got = {r.doc_id: r for r in encoding.restored_documents(mixed).filter("doc_id is not null").collect()}
    same = sum(i in got and got[i].text == t for i, t in original.items())
    clean = sum(got[i].n_left == 0 for i in original if i in got)
    print(f"restored: {same / len(original):.4f} of all equal the original, {clean} of {sum(i in got for i in original)} found ones have nothing left")
    wrong = [(i, got[i].text[:150], t[:150]) for i, t in original.items() if i in got and got[i].text != t][:6]
    for w in wrong:
        print("  differs:", w)
    new = dict(rows)
    for i, t in original.items():
        if i not in got:
            print("  not found:", i, [(a, b) for a, b in zip(t.split(), new[i].split()) if a != b][:4])


if __name__ == "__main__":
    main()
