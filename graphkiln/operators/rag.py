"""Question answering and model-driven steps: a provider function with a deterministic default, JSON repair, keywords, contexts, modes.

A provider is ``prompt -> text``; it is called on executors, one Arrow batch at a time. Whatever it returns is parsed and
checked, and the step's rule-based default stands in when that fails.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.functions.ship import ship

Provider = Callable[[str], str]
MODES = ("direct", "semantic_search", "naive_grag", "graph_search", "hybrid")
LABELS = ("supported", "contradicted", "not_enough_info")


def balanced(text: str, start: str = "{") -> str | None:
    """The first balanced JSON object or array in a text."""
    ends = {"{": "}", "[": "]"}
    at = text.find(start)
    while at >= 0:
        stack, quoted, k = [], False, at
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in ends:
                stack.append(ends[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack:
                    return text[at : k + 1]
            k += 1
        at = text.find(start, at + 1)
    return None


def parse_json(text: str | None, start: str = "{"):
    """What a model meant as JSON: thoughts and fences removed, the first balanced value, Python literals allowed; None if nothing parses."""
    plain = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    plain = re.sub(r"```(?:json)?", "", plain)
    found = balanced(plain, start)
    if found is None:
        return None
    for fixed in (found, re.sub(r",\s*([}\]])", r"\1", found), re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", found.replace("'", '"'))))):
        try:
            return json.loads(fixed)
        except ValueError:
            continue
    return None


def ask(df: DataFrame, prompt: str, provider: Provider, answer: str = "answer", tries: int = 3, check: Callable[[str], bool] | None = None, wait: float = 1.0) -> DataFrame:
    """``df`` plus the provider's answer (null after ``tries`` failures, with growing pauses) and the number of tries."""
    ship(df.sparkSession)

    def once(text: str) -> tuple[str | None, int]:
        for k in range(1, tries + 1):
            try:
                got = provider(text)
                if check is None or check(got):
                    return got, k
            except Exception:  # noqa: BLE001  a failed call counts as a try
                pass
            if k < tries:
                time.sleep(wait * 2**k)
        return None, tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [once(p) for p in pdf[prompt]]
            yield pdf.assign(**{answer: [a for a, _ in got], "tries": [n for _, n in got]})

    kept = [f"`{n}` {kind}" for n, kind in df.dtypes if n not in (answer, "tries")]
    return df.mapInPandas(run, ", ".join([*kept, f"`{answer}` string", "tries int"]))


def judgement(answer: Column) -> Column:
    """struct(label, confidence, valid): a judge's JSON; legacy names are mapped, anything else is an invalid response."""
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "label string, confidence double, reason string")
    legacy = {"correct": "supported", "incorrect": "contradicted", "unsupported": "not_enough_info"}
    label = F.lower(F.trim(parsed["label"]))
    for old, new in legacy.items():
        label = F.when(label == old, new).otherwise(label)
    valid = F.coalesce(label.isin(*LABELS), F.lit(False)) & consistent(label, F.coalesce(parsed["reason"], F.lit("")))
    return F.struct(F.when(valid, label).otherwise("invalid_response").alias("label"), F.when(valid, parsed["confidence"]).alias("confidence"), valid.alias("valid"))


#: How a reason says what it concludes.
CONCLUSIONS = {"contradicted": r"\bcontradict", "not_enough_info": r"not enough (?:info|evidence)|insufficient"}


def consistent(label: Column, reason: Column) -> Column:
    """False if the end of the reason concludes another label."""
    tail = F.right(F.lower(reason), F.lit(600))
    clash = F.lit(False)
    for other, pattern in CONCLUSIONS.items():
        clash = clash | ((label != other) & tail.rlike(pattern))
    return ~clash


def keywords(question: Column, most: int = 16) -> Column:
    """Acronyms, quoted phrases, then longer and shorter word groups, distinct without case."""
    q = F.coalesce(question, F.lit(""))
    acronyms = F.regexp_extract_all(q, F.lit(r"\b([A-Z]{2,}[A-Z0-9]*)\b"), F.lit(1))
    quoted = F.regexp_extract_all(q, F.lit(r'"([^"]+)"'), F.lit(1))
    words = F.array_remove(F.split(t.query_text(q), " "), "")
    groups = [F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i, n=n: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")) for n in (4, 3, 2, 1)]
    return F.slice(t.distinct_by(F.filter(F.concat(acronyms, quoted, *groups), lambda x: F.length(x) > 1)), 1, most)


#: Words that no keyword starts or ends with.
STOPWORDS = "ai bao bi bị boi bởi cai cái cac các cho cua của de duoc được em hoi hỏi khi la là nao nào o ở tai tại thi thì toi tôi trong va và ve về".split()
#: Fixed value: what a keyword is: an address, a run of capitalised words, a word.
KEYWORD = r"(?U)https?://\S+|[A-ZÀ-ỴĐ][\wÀ-ỹĐđ]*(?:\s+[A-ZÀ-ỴĐ0-9][\wÀ-ỹĐđ]*)+|[\wÀ-ỹĐđ]+"


def fallback_keywords(question: Column) -> Column:
    """struct(phrases, words, more) without a model: addresses and capitalised runs, single words, the addresses' hosts.

    Stop words at their ends go; each is listed once without case, in the first list that has it. Words need three characters
    or a digit. Without phrases and words, the question itself is the word; null is empty.
    """
    q = F.coalesce(question, F.lit(""))
    stop = "|".join(STOPWORDS)

    def cleaned(x: Column) -> Column:
        x = t.collapse(F.regexp_replace(x, r"^[ .,;:!?()\[\]{}\"'`]+|[ .,;:!?()\[\]{}\"'`]+$", ""))
        x = F.regexp_replace(x, rf"(?iU)^(?:(?:{stop})(?: |$))+", "")
        return F.regexp_replace(x, rf"(?iU)(?:(?:^| )(?:{stop}))+$", "")

    def entry(kind: str, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), cleaned(x).alias("value"))

    def entries(m: Column) -> Column:
        url = m.startswith("http") & m.contains("://")
        host = F.regexp_extract(m, r"^https?://([^/?#]*)", 1)
        word = (F.length(m) > 2) | m.rlike(r"(?U)\d")
        none = F.array().cast("array<struct<kind:string,value:string>>")
        return F.when(url, F.array(entry("phrases", F.regexp_replace(m, r"[/.,;]+$", "")), entry("more", host))).when(m.rlike(r"\s"), F.array(entry("phrases", m))).when(word, F.array(entry("words", m))).otherwise(none)

    long = lambda rows: t.distinct_by(F.filter(rows, lambda e: F.length(e["value"]) > 1), lambda e: F.lower(e["value"]))
    found = long(F.flatten(F.transform(F.regexp_extract_all(q, F.lit(KEYWORD), F.lit(0)), entries)))
    found = t.let(found, lambda rows: F.when(F.exists(rows, lambda e: e["kind"] != "more"), rows).otherwise(long(F.concat(rows, F.array(entry("words", q))))))
    of = lambda rows, kind: F.transform(F.filter(rows, lambda e: e["kind"] == kind), lambda e: e["value"]).alias(kind)
    return t.let(found, lambda rows: F.struct(of(rows, "phrases"), of(rows, "words"), of(rows, "more")))


def merge_keywords(groups: list[Column], most: int) -> Column:
    """Groups in order of precedence, variants added, distinct without case, at most ``most``."""
    every = F.flatten(F.transform(F.flatten(F.array(*groups)), lambda x: t.identifier_variants(x)))
    return F.slice(t.distinct_by(every), 1, most)


def lucene(terms: Column) -> Column:
    """A full-text query: escaped phrases, single words also as prefixes."""
    escaped = lambda x: F.regexp_replace(x, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")
    clause = lambda x: F.when(x.contains(" "), F.concat(F.lit('"'), escaped(x), F.lit('"'))).otherwise(F.concat(escaped(x), F.lit(" OR "), escaped(x), F.lit("*")))
    return F.array_join(F.transform(F.filter(terms, lambda x: F.trim(x) != ""), clause), " OR ")


def context_text(entities: Column, relations: Column, chunks: Column, sources: Column) -> Column:
    """Four named sections of JSON, in this order."""
    part = lambda name, x: F.concat(F.lit(f"-----{name}-----\n"), F.to_json(x))
    return F.concat_ws("\n\n", part("Entities", entities), part("Relationships", relations), part("Chunks", chunks), part("Sources", sources))


def context_section(context: Column, name: str) -> Column:
    return F.regexp_extract(context, rf"(?s)-----{name}-----\n(.*?)(?:\n\n-----|$)", 1)


def evidence_mode(mode: Column, chunks: Column, facts: Column) -> Column:
    """struct(chunks, facts) that a mode may use; null for what it doesn't retrieve."""
    return F.struct(F.when(mode.isin("semantic_search", "hybrid"), chunks).alias("chunks"), F.when(mode.isin("naive_grag", "graph_search", "hybrid"), facts).alias("facts"))


def reasoning_steps(reasoning: Column, details: int = 8) -> Column:
    """array<struct<title, details>> from numbered or bulleted lines of a reasoning text."""
    lines = F.filter(F.split(F.coalesce(reasoning, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.slice(F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("Step "), (i + 1).cast("string")).alias("title"), F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*])\s*", "")).alias("details"))), 1, details)
