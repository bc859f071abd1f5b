"""Normalisation and text scalars as column expressions.

Everything but NFKC stays in the JVM: Spark has no NFKC built in, so `nfkc` sends the texts that it may change
through one Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the comparison rules.
CLAUSE = r"^(第[一二三四五六七八九十百千万0-9]+条|\d+(?:\.\d+)*(?:、|\.(?!\d)))"
CLAUSE_START = r"(?=(?:第[一二三四五六七八九十百千万0-9]+条|(?<!\S)\d+(?:\.\d+)*(?:、|\.(?!\d))))"
MARKER = r"^(?:第[一二三四五六七八九十百千万0-9]+条|\d+(?:\.\d+)*(?:、|\.(?!\d))|[（(][一二三四五六七八九十百千万0-9]+[）)])\s*"
NUMBER = r"(?:\d{4}[年./-]\d{1,2}(?:[月./-]\d{1,2}日?)?|\d[\d,]*(?:\.\d+)?%?|[一二三四五六七八九十百千万]+(?:年|个月|月|日))"
IGNORED = "，,。；;：:“”\"‘’'（）()【】[]、 *|~"
TERMS = r"[\u3400-\u9fff]{2,8}|[A-Za-z]{2,}|\p{Nd}+"
CHAPTER = r"^(?:第[一二三四五六七八九十百千万0-9]+[章节条]\s*[^。；;]{0,70}|附件[一二三四五六七八九十百千万0-9]+\s*[^。；;]{0,50}|通用条款|租赁附表)$"
CLAUSE_NUMBER = r"^(?:第[一二三四五六七八九十百千万0-9]+条|[0-9]+(?:\.[0-9]+)*[、.])"
LISTED = r"^[0-9一二三四五六七八九十百千万]+[、.．]"
#: What is taken out of a text to show it, in order.
DISPLAY = (
    (r"(?i)<br\s*/?>", "\n"),
    (r"\\mathrm\s*\{([^{}]*)\}", "$1"),
    (r"\\sim", "~"),
    (r"\$", ""),
    (r"\*{2,}", ""),
    (r"\r\n?", "\n"),
    (r"[\t\f\x0B ]+", " "),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _stable() -> str:
    """Latin characters and ideographs that composition leaves alone, whatever stands beside them, as a character class."""
    out: list[list[int]] = []
    for i in [*range(0x250), *range(0x3001, 0x3004), *range(0x4E00, 0xA000)]:
        c = chr(i)
        if unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c):
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in out)


UNSTABLE = f"[^{_stable()}]"


def nfkc(text: Column) -> Column:
    """Compatibility composition of each text; only texts with a character that it may change leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(UNSTABLE), text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's too, become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    return collapse(nfkc(text))


def display_text(text: Column) -> Column:
    """Text as shown beside a difference: markup dropped, lines kept, two line ends in a row at most."""
    t = F.translate(nfkc(text), "\u200b\u00ad", "")
    for pattern, to in DISPLAY:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def comparable_text(text: Column) -> Column:
    """One line of display text with blanks between ideographs dropped and colons and commas unified."""
    t = F.regexp_replace(display_text(text), r"(?<=[\u3400-\u9fff])\s+(?=[\u3400-\u9fff])", "")
    return F.translate(collapse(t), "：，", ":,")


def match_text(comparable: Column) -> Column:
    """The part of a comparable text that decides equality: without punctuation and blanks."""
    return F.translate(comparable, IGNORED, "")


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clause_key(text: Column) -> Column:
    """The clause number that a text begins with, or null."""
    return _empty_to_null(F.regexp_extract(text, CLAUSE, 1))


def without_marker(comparable: Column) -> Column:
    """Text without one leading clause or list marker."""
    return F.trim(F.regexp_replace(comparable, MARKER, ""))


def semantic_key(comparable: Column) -> Column:
    """Match text of the body, or null if it has fewer than six characters."""
    key = match_text(without_marker(comparable))
    return F.when(F.length(key) >= 6, key)


def clause_pieces(comparable: Column) -> Column:
    """The clauses of a paragraph, cut before each clause marker."""
    return F.filter(F.transform(F.split(comparable, CLAUSE_START), lambda p: F.trim(p)), lambda p: p != "")


def number_tokens(text: Column) -> Column:
    """Dates, numbers and durations in order of appearance."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def value_tokens(text: Column) -> Column:
    """The same as a sorted bag."""
    return F.array_sort(number_tokens(text))


def numbers_changed(before: Column, after: Column) -> Column:
    """Both texts have numbers and their lists differ."""
    b, a = number_tokens(before), number_tokens(after)
    return (b != a) & (F.size(b) > 0) & (F.size(a) > 0)


def number_skeleton(text: Column) -> Column:
    """Text with a # for each number."""
    return F.regexp_replace(text, NUMBER, "#")


def earliest_alias(text: Column, aliases: dict[str, str]) -> Column:
    """Canonical name of the alias found first in the text; the longest of those at one place; null if none."""
    hits = F.array(*[F.struct(F.locate(a, text).alias("at"), F.lit(-len(a)).alias("n"), F.lit(c).alias("name")) for a, c in aliases.items()])
    return F.array_min(F.filter(hits, lambda h: h["at"] > 0))["name"]


def casefold(text: Column) -> Column:
    """Lower case, with ß as ss."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def candidate_value(text: Column, kind: Column) -> Column:
    """A value for exact comparison: no blanks or commas, one case; a percentage without 百分之 and with its sign."""
    v = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)[\s,，]+", "")
    share = F.concat(F.regexp_replace(v, "百分之", ""), F.when(v.contains("%"), F.lit("")).otherwise(F.lit("%")))
    return casefold(F.when(kind == "PERCENTAGE", share).otherwise(v))


def context_terms(text: Column, stop_words: list[str]) -> Column:
    """Distinct ideograph runs of 2 to 8, Latin words and digit runs without the stop words, in one case."""
    found = F.regexp_extract_all(text, F.lit(TERMS), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found
    return F.array_distinct(F.transform(kept, casefold))


def retrieval_tokens(text: Column) -> Column:
    """Distinct Latin runs and two-ideograph chunks."""
    t = F.lower(text)
    return F.array_union(F.regexp_extract_all(t, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"[\u4e00-\u9fff]{2}"), F.lit(0)))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def summary(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A content id: the prefix and a cut SHA-256 of the parts (nulls told apart from empty texts)."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *marked), 256), 1, length))


def strict_chapter(text: Column) -> Column:
    """What a document-level heading says, without the number of its clause, which versions do not share; null for other texts. text is a match text."""
    return F.when((F.length(text).between(1, 100)) & text.rlike(CHAPTER), F.regexp_replace(text, CLAUSE_NUMBER, ""))


def chapter_heading(text: Column) -> Column:
    """strict_chapter, or a short section label that is no sentence and no list entry. text is a match text."""
    label = (F.length(text).between(1, 40)) & ~text.rlike("[，。；;：:]") & ~text.rlike(LISTED)
    return F.coalesce(strict_chapter(text), F.when(label, F.regexp_replace(text, CLAUSE_NUMBER, "")))


def least_confidence(places: Column) -> Column:
    """The lowest confidence of an array of places that have one; 1 if none has."""
    return F.coalesce(F.array_min(F.transform(places, lambda x: x["confidence"])), F.lit(1.0))


PLACE_KEYS = ("page", "paragraph_index", "table_index", "row", "column")


def compact_place(place: Column) -> Column:
    """A place as JSON, with those of the five keys that it has."""
    return F.to_json(F.struct(*[place[k].alias(k) for k in PLACE_KEYS]))


def place_key(place: Column) -> Column:
    """A place for comparing, null for null."""
    return F.struct(*[place[k].alias(k) for k in PLACE_KEYS])


def place_order(place: Column, item: Column) -> list[Column]:
    """The order of candidates: page, table, row, column and paragraph (0 if unknown), then the id."""
    return [F.coalesce(place[k], F.lit(0)) for k in ("page", "table_index", "row", "column", "paragraph_index")] + [item]


def cache_key(*parts: Column) -> Column:
    """The key of what was made from these settings: their JSON, hashed."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def sanitize_url(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.regexp_replace(url, r"[?#].*$", "")


def url_allowed(url: Column, hosts: list[str] | None = None) -> Column:
    """http or https, a host of the list if there is one, and no private or loopback address."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?(\[[^\]]+\]|[^/:?#]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[)")
    ok = (host != "") & ~private & ~url.rlike(r"^https?://[^/?#]*@")
    return F.coalesce(ok & host.isin(hosts) if hosts else ok, F.lit(False))


def single_sentence(text: Column) -> Column:
    """Advice as one sentence without markup: inner sentence ends become commas, one full stop at the end."""
    t = F.regexp_replace(collapse(text), r"[*_`#>]+", "")
    t = F.regexp_replace(t, r"[。！？!?；;.]+$", "")
    return F.when(t != "", F.concat(F.regexp_replace(t, r"[。！？!?；;]+\s*", "，"), F.lit("。")))
