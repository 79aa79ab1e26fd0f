"""Text functions as Column expressions, with Unicode-aware classes throughout. A null gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text processing outside the JVM sees it: the JVM's class lacks the four separators.
SPACE = r"[\s\x1C-\x1F]"
#: Media that are no photographs, fixed.
NON_PHOTO = ("svg", "gif", "ogg", "ogv", "webm", "midi", "mp3", "wav")
#: Line ends, fixed.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Coarse type of a root class, fixed.
ROOT_TYPES = {"Q5": "PERS", "Q43229": "ORG", "Q618123": "LOC"}
TYPE_PRIORITY = {"PERS": 0, "ORG": 1, "LOC": 2}


#: The grammar of a list item that opens with a link, fixed: bullets, marks of style, a link with its target and perhaps a label.
ITEM_MARK, ITEM_STYLE, ITEM_LINK = r"([*#]+)", r"['`_~]*", r"\[\[([^\]|#]+)(?:\|[^\]]+)?\]\]"
#: The forms in which models answer, fixed: a named number or the first one, a named list or the first one of digits.
ANSWER_NUMBER, ANY_NUMBER = r'(?U)"number"\s*:\s*(-?\d+)', r"-?\d+"
ANSWER_RANKING, ANY_RANKING = r'(?U)"ranking"\s*:\s*\[([^\]]*)\]', r"(?U)\[([\d\s,]+)\]"
#: Landis and Koch's bands of agreement, fixed.
KAPPA_BANDS = ((0.8, "Almost perfect"), (0.6, "Substantial"), (0.4, "Moderate"), (0.2, "Fair"), (0.0, "Slight"))


def filled(c: Column) -> Column:
    """Whether a text is neither null nor empty; never null."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def or_else(c: Column, other: Column) -> Column:
    """c, or other where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def title_to_url(title: Column, base: str = "https://en.enc.example/wiki/") -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def title_from_url(url: Column) -> Column:
    """What follows the first /wiki/, with spaces for underscores; escapes stay."""
    return F.replace(F.regexp_replace(url, r"^.*?/wiki/", ""), F.lit("_"), F.lit(" "))


def clean_mention(title: Column) -> Column:
    """A page title without a trailing bracketed qualifier."""
    return strip(F.regexp_replace(title, rf"(?U){SPACE}*\([^)]*\){SPACE}*$", ""))


def percent_decode(c: Column) -> Column:
    """Escapes become UTF-8 text; a plus sign and malformed escapes stay as they are."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def percent_encode(c: Column) -> Column:
    """As in a URL path: slashes stay, a space becomes %20."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def image_name(c: Column) -> Column:
    """One name for the spellings of an image: a File: title, a Special:FilePath address or an address in the commons tree.

    Escapes are decoded, underscores are spaces, letter case and outer white space don't count. Any other address is kept whole.
    """
    bare = (
        F.when(c.startswith("File:"), F.substring(c, 6, 1 << 30))
        .when(c.contains("Special:FilePath/"), F.regexp_replace(c, r"^.*?Special:FilePath/", ""))
        .when(c.contains("/wikipedia/commons/"), F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1))
        .otherwise(c)
    )
    return F.lower(strip(F.replace(percent_decode(bare), F.lit("_"), F.lit(" "))))


def file_path_url(name: Column, base: str = "http://commons.files.example/wiki/Special:FilePath/") -> Column:
    return F.concat(F.lit(base), percent_encode(name))


def is_photo(filename: Column) -> Column:
    return ~F.lower(filename).rlike(rf"\.({'|'.join(NON_PHOTO)})$")


def is_number_title(title: Column) -> Column:
    return title.rlike(r"(?U)^\d+$")


def first_paragraph(c: Column) -> Column:
    return strip(F.element_at(F.split(c, "\n\n"), 1))


def first_sentence(intro: Column, desc: Column) -> Column:
    """The intro up to its first full stop and space, or desc where there is none."""
    return or_else(strip(F.element_at(F.split(F.coalesce(intro, F.lit("")), r"\. "), 1)), desc)


def word_tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of letters of two or more characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    kept = F.filter(words, lambda w: F.length(w) >= 2)
    return F.filter(kept, lambda w: ~w.isin(*stopwords)) if stopwords else kept


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: F.length(w) > 0))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def entity_links(wikitext: Column) -> Column:
    """Targets of the links that open the list items of a page.

    Reading stops at a See also heading. An item of the first level counts only if something follows that holds a letter or digit and doesn't
    start with a colon; deeper items always count. Targets with a colon or a section mark are no entities.
    """
    body = F.element_at(F.split(wikitext, r"==\s*[Ss]ee also\s*==", 2), 1)
    item = rf"(?U)^{ITEM_MARK}\s*{ITEM_STYLE}{ITEM_LINK}(.*)$"
    parsed = F.transform(lines(body), lambda x: strip(x))
    hits = F.filter(parsed, lambda x: x.rlike(item))
    fields = F.transform(hits, lambda x: F.struct(F.length(F.regexp_extract(x, item, 1)).alias("level"), strip(F.regexp_extract(x, item, 2)).alias("target"), strip(F.regexp_extract(x, item, 3)).alias("rest")))
    described = lambda x: (x["level"] > 1) | (x["rest"].rlike(r"[\p{L}\p{N}]") & ~x["rest"].startswith(":"))
    return F.transform(F.filter(fields, lambda x: ~x["target"].contains(":") & described(x)), lambda x: x["target"])


def whole_word(words: tuple[str, ...]) -> str:
    return rf"(?iU)\b(?:{'|'.join(map(re.escape, words))})\b"


def parse_number(response: Column) -> Column:
    """The option number of an answer: the value of "number", else the first integer; null if there is none or it is too long."""
    named = F.nullif(F.regexp_extract(response, ANSWER_NUMBER, 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(response, ANY_NUMBER, 0), F.lit(""))).try_cast("int")


def parse_ranking(response: Column) -> Column:
    """The ranking of an answer: the list of "ranking", else the first list of digits; null if there is none or a member is no integer."""
    body = F.when(response.rlike(ANSWER_RANKING), F.regexp_extract(response, ANSWER_RANKING, 1)).when(response.rlike(ANY_RANKING), F.regexp_extract(response, ANY_RANKING, 1))
    members = F.filter(F.split(F.replace(body, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda x: x != "")
    numbers = F.transform(members, lambda x: x.try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def strip_category_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^Category:", "")


def kappa_band(kappa: Column) -> Column:
    """Landis and Koch's name for an agreement."""
    out = F.when(kappa.isNull(), F.lit(None).cast("string"))
    for least, name in KAPPA_BANDS:
        out = out.when(kappa >= least, name)
    return out.otherwise("Poor")


def short_count(n: Column) -> Column:
    """1500 as 1.5k, 2000000 as 2M; a half is rounded up."""

    def scaled(unit: float, sign: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", n / unit), r"\.0$", ""), F.lit(sign))

    return F.when(n >= 1e6, scaled(1e6, "M")).when(n >= 1e3, scaled(1e3, "k")).otherwise(n.cast("long").cast("string"))


def root_type(qid: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for root, name in ROOT_TYPES.items():
        out = out.when(qid == root, name)
    return out


def thumb_url(url: Column, width: int = 320) -> Column:
    """The address of a smaller rendering of an image in the commons tree; other addresses stay."""
    name = last_segment(url)
    small = F.concat(F.replace(url, F.lit("/wikipedia/commons/"), F.lit("/wikipedia/commons/thumb/")), F.lit(f"/{width}px-"), name)
    return F.when(url.contains("/wikipedia/commons/") & ~url.contains("/wikipedia/commons/thumb/"), small).otherwise(url)


def candidate_role(qid: Column, answer: Column, text: Column, visual: Column) -> Column:
    """Whether an entity is the answer, a candidate of both lists, of one, or none."""
    in_text, in_visual = F.coalesce(F.array_contains(text, qid), F.lit(False)), F.coalesce(F.array_contains(visual, qid), F.lit(False))
    return F.when(qid == answer, "answer").when(in_text & in_visual, "both").when(in_text, "text").when(in_visual, "visual").otherwise("none")


def found_in(needle: str, *texts: Column) -> Column:
    """Whether a search text, in any letter case, is in one of the texts; an empty one is in every row."""
    hit = F.lit(needle == "")
    for t in texts:
        hit = hit | F.coalesce(F.contains(F.lower(t), F.lower(F.lit(needle))), F.lit(False))
    return hit


def license_of(short: Column, long: Column) -> Column:
    return or_else(short, or_else(long, F.lit("")))
