"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with those of reference languages
by the Jensen-Shannon distance (base 2, 0 to 1); the closest language counts, so the ``lang`` column isn't needed.
Native: one pass, no shuffle, DataFrame functions only; every document is judged inside its own row.

Defined results: a null text is an empty text, which has no words and fails the base rule; a text mostly of letters
outside a-z (other scripts) has no reference and is judged by the base rule alone; texts under the minimum lengths
skip the test concerned. Repeated rows are judged alike, row by row. Windows of three words are compared by 64-bit
hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.llm.common import filter_after, let, total, words

#: Relative frequencies of frequent words in general text of four languages (rounded, public word counts).
WORD_REFERENCES = {
    "en": {"the": 0.0615, "of": 0.0309, "and": 0.0284, "to": 0.0261, "a": 0.0211, "in": 0.0195, "is": 0.0114, "that": 0.0110, "was": 0.0097, "it": 0.0091, "for": 0.0090, "on": 0.0069},
    "de": {"der": 0.034, "die": 0.033, "und": 0.028, "in": 0.019, "den": 0.013, "von": 0.012, "zu": 0.011, "das": 0.010, "mit": 0.010, "sich": 0.008, "des": 0.008, "auf": 0.008},
    "fr": {"de": 0.048, "la": 0.032, "le": 0.027, "et": 0.024, "les": 0.022, "des": 0.018, "en": 0.016, "un": 0.013, "du": 0.012, "une": 0.012, "que": 0.012, "est": 0.011},
    "es": {"de": 0.062, "la": 0.037, "que": 0.030, "el": 0.029, "en": 0.026, "y": 0.024, "a": 0.020, "los": 0.017, "se": 0.012, "del": 0.012, "las": 0.011, "un": 0.010},
}
#: Shares of a-z, A-Z, 0-9, other letters, common punctuation and the rest among non-blank characters.
CLASS_REFERENCES = {
    "en": [0.930, 0.025, 0.010, 0.001, 0.032, 0.002],
    "de": [0.890, 0.055, 0.010, 0.013, 0.030, 0.002],
    "fr": [0.900, 0.025, 0.010, 0.033, 0.030, 0.002],
    "es": [0.912, 0.025, 0.010, 0.023, 0.028, 0.002],
}
COMMON_WORDS = sorted({w for ref in WORD_REFERENCES.values() for w in ref})

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_CHARS = 100
MIN_WORDS_BOTH = 100
MAX_CLASS_DISTANCE = 0.235
MAX_SUM_DISTANCE = 0.50
MAX_FOREIGN_SHARE = 0.5


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts (all zero: 1) from a reference that sums to 1."""
    ref = F.array(*[F.lit(float(q)) for q in reference])

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2.0 * x / (x + y))).otherwise(0.0)

    def apart(size: Column) -> Column:
        shares = F.transform(counts, lambda c: c / size)
        parts = F.zip_with(shares, ref, lambda p, q: part(p, q) + part(q, p))
        both = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2.0
        return F.when(size > 0, F.sqrt(F.greatest(both, F.lit(0.0)))).otherwise(1.0)

    return let(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c), apart)


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more; ``hashes``: the windows' hashes in text order."""

    def covered(pairs: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(pairs, at)["h"] == e["h"], F.lit(False))
        found = F.filter(pairs, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered))


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one struct ``_q`` of the figures that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", words(F.col(text)).alias("_words"), F.split(t, "\n").alias("_lines"))
    w = F.col("_words")
    grams = F.when(
        F.size(w) >= 3,
        let(w, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *docs.columns,
        F.size(w).alias("_n"),
        F.array_join(w, "").alias("_chars"),
        F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        grams.alias("_grams"),
        F.filter(w, lambda x: x.isin(COMMON_WORDS)).alias("_common"),
    )
    df = df.select(
        *docs.columns, "_n", "_grams", "_common",
        F.length("_chars").alias("_size"),
        F.regexp_replace("_chars", "[a-z]+", "").alias("_rest"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"),
    )
    count = lambda regex: F.regexp_count(F.col("_rest"), F.lit(regex))
    df = df.select(
        *docs.columns, "_n", "_size", "_dup",
        F.length("_rest").alias("_rest_size"),
        count("[A-Z]").alias("_upper"), count("[0-9]").alias("_digit"), count(r"[\p{L}&&[^A-Za-z]]").alias("_other"), count(r"[.,;:!?'\"()\-]").alias("_punct"), count(r"[#*$%&|<>]").alias("_symbols"),
        repeated_words(F.col("_grams")).alias("_repeated"),
        F.size("_common").alias("_n_common"),
        F.array(*[F.size("_common") - F.size(F.array_remove("_common", x)) for x in COMMON_WORDS]).alias("_counts"),
    )
    known = [F.col("_size") - F.col("_rest_size"), F.col("_upper"), F.col("_digit"), F.col("_other"), F.col("_punct")]
    classes = [*known, F.col("_size") - total(known)]
    seen = {lang: [F.get("_counts", F.lit(COMMON_WORDS.index(x))) for x in ref] for lang, ref in WORD_REFERENCES.items()}
    df = df.select(
        *docs.columns, "_n", "_size", "_symbols", "_dup", "_repeated", "_other",
        F.array(*classes).cast("array<double>").alias("_classes"),
        *[F.array(*x, F.col("_n") - total(x)).cast("array<double>").alias(f"_words_{lang}") for lang, x in seen.items()],
    )
    by_class = {lang: js_distance(F.col("_classes"), ref) for lang, ref in CLASS_REFERENCES.items()}
    by_word = {lang: js_distance(F.col(f"_words_{lang}"), [*ref.values(), 1 - sum(ref.values())]) for lang, ref in WORD_REFERENCES.items()}
    df = df.select(
        *docs.columns, "_n", "_size", "_symbols", "_dup", "_repeated", "_other",
        F.array(*by_class.values()).alias("_by_class"),
        F.zip_with(F.array(*by_class.values()), F.array(*by_word.values()), lambda a, b: a + b).alias("_by_both"),
    )
    return df.select(
        *docs.columns,
        F.struct(
            F.col("_n").cast("long").alias("n_words"), F.col("_size").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
            F.col("_dup").cast("long").alias("n_dup_lines"), F.col("_repeated").cast("long").alias("n_repeat_words"),
            (F.col("_other") > F.lit(MAX_FOREIGN_SHARE) * F.col("_size")).alias("foreign"),
            F.array_min("_by_class").alias("class_distance"), F.array_min("_by_both").alias("sum_distance"),
        ).alias("_q"),
    )


def base_failed(q: str = "_q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEATED_PERCENT * n)


def diverges(q: str = "_q") -> Column:
    """True if the text is long enough to tell and no reference language is near."""
    far = (F.col(f"{q}.word_chars") >= MIN_CHARS) & (F.col(f"{q}.class_distance") >= MAX_CLASS_DISTANCE)
    both = (F.col(f"{q}.n_words") >= MIN_WORDS_BOTH) & (F.col(f"{q}.sum_distance") >= MAX_SUM_DISTANCE)
    return ~F.col(f"{q}.foreign") & (far | both)


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """(_all: the row, _q: its figures); packing keeps names from clashing."""
    return with_figures(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(f"`{text}`").alias("_text")), "_text")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the struct ``_q`` and booleans ``base_failed`` and ``kept`` (columns of these names are replaced)."""
    old = [F.col(f"_all.`{c}`").alias(c) for c in docs.columns if c not in ("_q", "base_failed", "kept")]
    return _packed(docs, text).select(*old, "_q", base_failed().alias("base_failed"), (~(base_failed() | diverges())).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return filter_after(_packed(docs, text), ~(base_failed() | diverges())).select("_all.*")
