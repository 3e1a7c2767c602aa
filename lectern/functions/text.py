"""Scalar functions on text, in Spark's own expressions wherever they can say it."""

from __future__ import annotations

import html
import os.path
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from lectern.functions.fixed import ONES, PART_WORDS, QUOTE_WORDS, SETTLED, TENS

#: The two kinds of month names, English and German.
MONTHS = (
    "january february march april may june july august september october november december".split(),
    "januar februar märz april mai juni juli august september oktober november dezember".split(),
)
#: Number words from zero to ninety-nine, in order.
NUMBER_WORDS = [*ONES, *(f"{ten}-{one}" if one else ten for ten in TENS for one in ("", *ONES[1:10]))]
#: How letters are spelt out in a file name.
TRANSLITERATION = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


@F.pandas_udf(StringType())
def nfc_path(paths: pd.Series) -> pd.Series:
    """M3, M4: normalised NFC path."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", os.path.normpath(p)))


@F.pandas_udf(StringType())
def fold_ascii(texts: pd.Series) -> pd.Series:
    """P25: umlauts spelt out, then ASCII letters of the NFKD form, lower case."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = t.lower()
        for a, b in TRANSLITERATION:
            t = t.replace(a, b)
        return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()

    return texts.map(one)


@F.pandas_udf(StringType())
def sort_key(texts: pd.Series) -> pd.Series:
    """A key without case and accents."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).casefold())


_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_TAG = re.compile(r"<[^>]{1,200}>")
_QUOTES = str.maketrans({**dict.fromkeys("“”„«»", '"'), **dict.fromkeys("‘’‚", "'"), **dict.fromkeys("–—−", "-"), "­": None})


@F.pandas_udf(StringType())
def comparison_form(texts: pd.Series) -> pd.Series:
    """NFKC, links as their text, tags and entities resolved, one kind of quote, dash and space."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = html.unescape(_TAG.sub("", _LINK.sub(r"\1", unicodedata.normalize("NFKC", t)))).translate(_QUOTES)
        return " ".join(re.sub(r"[*_`]", "", t).split())

    return texts.map(one)


@F.pandas_udf(StringType())
def blank_inline_code(texts: pd.Series) -> pd.Series:
    """Inline code as spaces of the same length."""
    return texts.map(lambda t: None if t is None else re.sub(r"`[^`\n]+`", lambda m: " " * len(m.group()), t))


def words(text: Column) -> Column:
    """P25: the words of a folded text."""
    return F.regexp_extract_all(fold_ascii(text), F.lit("([a-z0-9]+)"), 1)


def strip_fences(text: Column) -> Column:
    """Fenced stretches out, by pattern (an unclosed fence stays)."""
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def frontmatter(text: Column) -> Column:
    """The frontmatter block, or null."""
    return F.when(text.rlike(r"(?s)\A---\n.*?\n---\n"), F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1))


def body(text: Column) -> Column:
    """What follows the frontmatter."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def paragraphs(text: Column) -> Column:
    """P5: prose paragraphs: neither headings, rows, lists, quotes, definitions nor fences."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^(#|\||[-*+]\s|[0-9]+[.)]\s|>|\[\^|```|~~~|<)"))


def first_table(section: Column) -> Column:
    """The lines of the first table in a text, header and separator out."""
    block = F.regexp_extract(section, r"(?m)((?:^\s*\|.*\|\s*$\n?)+)", 1)
    return F.filter(F.split(block, "\n"), lambda r: (F.trim(r) != "") & ~r.rlike(r"^\s*\|(\s*:?-{3,}:?\s*\|)+\s*$"))


def quote_parts(quote: Column, whole: int = QUOTE_WORDS, part: int = PART_WORDS) -> Column:
    """A quotation's parts between ellipses and brackets, with words enough to look for: more if it isn't cut."""
    cut = F.transform(F.split(quote, r"\s*(?:\.\.\.|…|\[[^\]]*\])\s*"), lambda p: F.regexp_replace(p, r"^[\s.,;:!?-]+|[\s.,;:!?-]+$", ""))
    least = F.when(F.size(cut) == 1, F.lit(whole)).otherwise(F.lit(part))
    return F.filter(cut, lambda p: F.size(F.regexp_extract_all(p, F.lit(r"(\S+)"), 1)) >= least)


def quotations(text: Column) -> Column:
    """Stretches between straight double quotes; null where the marks are odd."""
    pieces = F.split(text, '"', -1)
    return F.when(F.size(pieces) % 2 == 1, F.filter(pieces, lambda p, i: i % 2 == 1))


def citing_sentences(text: Column, most: int = 280) -> Column:
    """Sentences and rows with a footnote reference, cut at `most` characters."""
    parts = F.split(text, r"(?<=[.!?\]])\s+(?=[A-Z*\"(\[])|\n")
    return F.transform(F.filter(parts, lambda p: p.rlike(r"\[\^[^\]]+\](?!:)")), lambda p: F.substring(F.trim(p), 1, most))


def squeeze(text: Column, boilerplate: str) -> Column:
    """Lines that are boilerplate out, runs of blank lines to one."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(boilerplate)), "\n")
    return F.regexp_replace(kept, "\n{3,}", "\n\n")


def page_identity(text: Column) -> Column:
    """A page's identity for packing, taken before links are shortened, so pages that differ in a link differ."""
    return F.md5(F.regexp_replace(F.trim(text), r"[ \t]+", " "))


def packed_body(text: Column) -> Column:
    """Link targets out, spaces and blank runs squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\]\([^)]*\)", "]"), r"[ \t]+", " "), "\n{3,}", "\n\n")


def dates_in(text: Column) -> Column:
    """Valid dates in a text (ISO or day.month.year), as sorted distinct YYYYMMDD strings."""
    iso = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"), 1)
    dotted = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"), 1),
        lambda d: F.concat_ws("-", F.split_part(d, F.lit("."), F.lit(3)), F.lpad(F.split_part(d, F.lit("."), F.lit(2)), 2, "0"), F.lpad(F.split_part(d, F.lit("."), F.lit(1)), 2, "0")),
    )
    valid = F.filter(F.concat(iso, dotted), lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())
    return F.array_sort(F.array_distinct(F.transform(valid, lambda d: F.replace(d, F.lit("-"), F.lit("")))))


def number(text: Column) -> Column:
    """A number, written in digits (with separators) or as a word up to ninety-nine; else null."""
    plain = F.lower(F.trim(text))
    words_map = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(i))])
    digits = F.regexp_replace(plain, "['’,]", "")
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), digits.cast("int")), F.try_element_at(words_map, plain))


def open_bullets(section: Column) -> Column:
    """P20: bullets that aren't struck out."""
    lines = F.filter(F.split(section, "\n"), lambda x: x.rlike(r"^\s*[-*+]\s+(?!~~)\S"))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*[-*+]\s+", ""))


def held_rows(text: Column) -> Column:
    """Rows and numbered items of the sections *Held by* and *Held from* that aren't settled."""
    sections = F.filter(F.split(text, r"(?m)^(?=#{1,2} )"), lambda s: s.rlike(r"^## Held (?:by|from)"))
    lines = F.flatten(F.transform(sections, lambda s: F.split(s, "\n")))
    return F.filter(lines, lambda x: x.rlike(r"^(\| \[|[0-9]+\. )") & ~x.rlike(SETTLED))


def page_actors(text: Column) -> Column:
    """People that a page presents: senders, recipients, organisers."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*\**(?:from|to|cc|organi[sz]er|von|an)\**\s*:\**\s*(.+)$"), 1), lambda x: F.trim(x)))


def name_words(text: Column) -> Column:
    """Words of a name, lower case, apostrophes folded, two letters or more."""
    return F.regexp_extract_all(F.lower(F.translate(text, "’‘ʼ", "'''")), F.lit(r"((?U)[\w']{2,})"), 1)


def slug(text: Column) -> Column:
    """Transliterated lower-case kebab name."""
    out = F.lower(text)
    for a, b in TRANSLITERATION:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trust(concept: Column, today: str, inclusive: bool = False) -> Column:
    """Status, tier, written, stale and sources of a concept struct."""
    verified = F.coalesce(F.size(concept["verified"]), F.lit(0)) > 0
    past = concept["stale_after"] <= today if inclusive else concept["stale_after"] < today
    return F.struct(
        F.coalesce(concept["status"], F.lit("draft")).alias("status"),
        F.when(verified, "verified").when(F.size(concept["sources"]) > 0, "sourced").otherwise("unsourced").alias("tier"),
        concept["generated"]["at"].alias("written"),
        F.coalesce(past, F.lit(False)).alias("stale"),
        F.greatest(F.size(concept["sources"]), F.lit(0)).alias("n_sources"),
    )


def credential_shape(text: Column) -> Column:
    """The first token of 16 to 40 letters and digits with both cases and a digit, that is no lower-case
    hex digest, holds no run of six lower-case letters and doesn't begin with a year; else null."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])([A-Za-z0-9]{16,40})(?![A-Za-z0-9])"), 1)
    ok = lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]") & ~t.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40})$") & ~t.rlike("[a-z]{6}") & ~t.rlike("^(19|20)[0-9]{2}")
    return F.try_element_at(F.filter(tokens, ok), F.lit(1))


def message_shape(message: Column) -> Column:
    """A message with its numbers as N."""
    return F.regexp_replace(message, "[0-9]+", "N")


def thousands(n: Column) -> Column:
    """Digits in groups of three, parted by apostrophes."""
    return F.regexp_replace(n.cast("string"), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", "'")
