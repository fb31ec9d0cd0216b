"""Text normalisers, identifiers and tokens as column expressions.

Six normalisers are kept apart because their callers differ on purpose: ``normalize_text``, ``strip_accents`` (keeps case,
folds đ), ``search_text`` (stored side), ``query_text`` (query side), ``strip_diacritics`` (leaves đ) and ``match_text``.
Accents are folded by ``translate`` with a table made by rule from the Unicode data, so all stays inside the JVM; only
compatibility normalisation (NFKC) needs an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache
def _fold_pairs() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and non-spacing marks, and that character."""
    source, target = [], []
    for point in range(0xC0, 0x10000):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") if not 0xD800 <= point < 0xE000 else c
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, white space collapsed; null gives ''."""
    return collapse(nfkc(F.coalesce(text, F.lit(""))))


def strip_diacritics(text: Column) -> Column:
    """Accents removed, đ kept."""
    source, target = _fold_pairs()
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")


def strip_accents(text: Column) -> Column:
    """Accents removed, đ becomes d; case stays."""
    return strip_diacritics(F.translate(text, "đĐ", "dD"))


def search_text(text: Column) -> Column:
    return collapse(strip_accents(F.lower(collapse(F.coalesce(text, F.lit(""))))))


def query_text(text: Column) -> Column:
    spaced = F.regexp_replace(search_text(text), r"[_\-/\\.]+", " ")
    return collapse(F.regexp_replace(spaced, r"(?U)[^\w\s]", " "))


def match_text(text: Column) -> Column:
    """Lower-case ASCII with only letters, digits and @./:+- kept."""
    plain = F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.translate(F.lower(plain), "_", " "), r"[^a-z0-9@./:+\-]+", " "))


def canonical_id(name: Column) -> Column:
    """``node_`` and the name in a-z, 0-9, _ and -, at most 200 characters of it; empty names give node_unknown."""
    plain = F.translate(F.lower(strip_accents(nfkc(F.coalesce(name, F.lit(""))))), " ", "_")
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\-]+", "_"), "_+", "_")
    kept = F.regexp_replace(F.substring(F.regexp_replace(kept, "^_+|_+$", ""), 1, 200), "_+$", "")
    return F.when(kept == "", "node_unknown").otherwise(F.concat(F.lit("node_"), kept))


#: Academic titles before a person's name.
TITLES = ("GS.TSKH", "GS.TS", "PGS.TS", "TS", "ThS", "CN", "KS")


def person_name(name: Column) -> Column:
    """The name without one leading academic title."""
    pattern = "|".join(t.replace(".", r"\.") for t in TITLES)
    return F.trim(F.regexp_replace(F.trim(name), rf"(?i)^(?:{pattern})\.?\s+", ""))


def primary_type(labels: Column) -> Column:
    """PERSON before ORGANIZATION before the first label, in upper case; UNKNOWN without labels."""
    upper = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.upper(x))
    return F.when(F.array_contains(upper, "PERSON"), "PERSON").when(F.array_contains(upper, "ORGANIZATION"), "ORGANIZATION").otherwise(F.coalesce(F.get(upper, F.lit(0)), F.lit("UNKNOWN")))


def embedding_text(name: Column, labels: Column) -> Column:
    return F.when(primary_type(labels) == "PERSON", person_name(name)).otherwise(collapse(F.coalesce(name, F.lit(""))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_by(items: Column, key=F.lower) -> Column:
    """The first of the items that share a key, in order; those with a null key go. Each key is computed once, and equal ones meet by sorting."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
    first = lambda rows: F.filter(rows, lambda e, i: e["key"].isNotNull() & ~F.get(rows, i - 1)["key"].eqNullSafe(e["key"]))
    kept = F.sort_array(F.transform(let(keyed, first), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(kept, lambda e: e["x"])


def aliases(items: Column) -> Column:
    """Collapsed, without blanks, the first of those that differ in case only."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: collapse(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return distinct_by(clean)


def sanitize_label(label: Column, empty: str = "Label") -> Column:
    plain = F.regexp_replace(F.coalesce(label, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.when(plain == "", empty).when(plain.rlike("^[0-9]"), F.concat(F.lit("L_"), plain)).otherwise(plain)


def identifier_variants(text: Column, ignore_case: bool = False) -> Column:
    """The text, its form with separators as spaces, and its parts of two characters and more; distinct in order."""
    t = collapse(F.coalesce(text, F.lit("")))
    spaced = collapse(F.regexp_replace(t, r"[_\-/\\.]+", " "))
    parts = F.filter(F.split(spaced, " "), lambda x: F.length(x) >= 2)
    every = F.filter(F.concat(F.array(t, spaced), parts), lambda x: x != "")
    return distinct_by(every) if ignore_case else F.array_distinct(every)


def tokens(text: Column) -> Column:
    """Words and single other marks: the token contract of chunking."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\]]+)\]"), F.lit(1)))


def url_filename(title: Column, url: Column) -> Column:
    safe = F.regexp_replace(collapse(F.coalesce(title, F.lit(""))), r"(?U)[^\w\-]+", "_")
    safe = F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, 120)
    return F.concat(F.when(safe == "", "page").otherwise(safe), F.lit("_"), F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 10), F.lit(".md"))


def fingerprint(text: Column, size: int = 1500) -> Column:
    return F.sha1(F.substring(match_text(text), 1, size).cast("binary"))


def relational_text(query: Column) -> Column:
    return collapse(F.translate(F.regexp_replace(query, r"Entity#[0-9]+|#[0-9]+", ""), ";", " "))


def looks_negative(text: Column) -> Column:
    return query_text(text).rlike("(^| )no")


def looks_vietnamese(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]")


def name_key(name: Column) -> Column:
    return F.replace(F.lower(collapse(name)), F.lit("ß"), F.lit("ss"))


def name_tokens(name: Column) -> Column:
    return F.filter(F.regexp_extract_all(name_key(name), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda x: F.length(x) > 1)


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name (RFC 9562); ``namespace``: 32 hexadecimal digits, by default that of addresses."""
    d = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.coalesce(name, F.lit("")).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(d, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("5"), F.substring(d, 14, 3)), F.concat(variant, F.substring(d, 18, 3)), F.substring(d, 21, 12))


#: Fixed value: the URL namespace of name-based ids (RFC 9562).
URLS = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URLS) -> Column:
    """The name-based id (version 5) of a text; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("string").cast("binary")))
    # Version 5 in the 13th digit; the two highest bits of the 17th are 10.
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(h.isNotNull(), made)
