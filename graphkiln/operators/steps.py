"""Steps around a model or a page: splitting clusters that don't hold, evidence texts, checked model answers, metadata and main content."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions.cut import cut
from graphkiln.functions.ship import ship
from graphkiln.operators import rag, resolution, vectors

#: The least similarities of names and aliases in a cluster of persons, of names in one of units.
PERSON_NAME, PERSON_ALIAS, UNIT_NAME = 0.80, 0.50, 0.90
#: Items and characters that an evidence text holds.
ITEMS, ITEM_CHARS, TEXT_CHARS = 8, 600, 4000
#: Where a page's main content is looked for, first wins.
CONTENT = (".entry-content", "article", ".content", "main", "#content", "body")
#: The fields of a metadata section, with their names, in order.
METADATA = {"id": "ID", "type": "Type", "status": "Status", "date": "Published", "modified": "Modified", "author_name": "Author", "author": "Author ID", "slug": "Slug", "parent": "Parent ID", "template": "Template", "featured_media": "Featured Media ID", "featured_image": "Featured Image", "categories": "Categories", "tags": "Tags"}


def similar_names(members: DataFrame, least: float, alias_least: float | None = None) -> DataFrame:
    """(cluster, a, b, name_sim, alias_sim) of the pairs a < b of a cluster that are alike. members: cluster, id, name, aliases.

    Names whose lengths alone rule out the similarity aren't compared.
    """
    ship(members.sparkSession)
    clean = F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    rows = members.select("cluster", F.col("id").alias("a"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("x"), clean.alias("s"))
    other = rows.select("cluster", F.col("a").alias("b"), F.col("x").alias("y"), F.col("s").alias("t"))
    pairs = rows.join(other, "cluster").filter("a < b")
    both = F.size(F.array_union("s", "t"))
    pairs = pairs.withColumn("alias_sim", F.when((F.size("s") > 0) & (F.size("t") > 0), F.size(F.array_intersect("s", "t")) / both).otherwise(0.0))
    # The similarity is rounded to whole percents, so half a percent is left.
    possible = 2 * F.least(F.length("x"), F.length("y")) >= (least - 0.005) * (F.length("x") + F.length("y"))
    pairs = pairs.withColumn("name_sim", F.when(possible, resolution.name_similarity("x", "y")).otherwise(0.0))
    alike = F.col("name_sim") >= least
    return pairs.filter(alike if alias_least is None else alike | (F.col("alias_sim") >= alias_least)).select("cluster", "a", "b", "name_sim", "alias_sim")


def split_persons(members: DataFrame) -> DataFrame:
    """(cluster, id, part): a cluster's components of alike persons, each named by its smallest id. members: cluster, id (unique), name, aliases."""
    pairs = similar_names(members, PERSON_NAME, PERSON_ALIAS)
    roots = vectors.components(pairs.select("a", "b"), members.select("id"))
    return members.select("cluster", "id").join(roots, "id").select("cluster", "id", F.col("root").alias("part"))


def units_hold(members: DataFrame) -> DataFrame:
    """(cluster, unit_ok): whether all pairs of a cluster of units have very similar names; a cluster of one holds."""
    alike = similar_names(members, UNIT_NAME).groupBy("cluster").agg(F.count("*").alias("n_alike"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.join(alike, "cluster", "left").select("cluster", (F.coalesce("n_alike", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2).alias("unit_ok"))


def split_units(members: DataFrame) -> DataFrame:
    """(cluster, id, part): clusters of units that don't hold become single units."""
    first = members.groupBy("cluster").agg(F.min("id").alias("first"))
    rows = members.select("cluster", "id").join(units_hold(members), "cluster").join(first, "cluster")
    return rows.select("cluster", "id", F.when(F.col("unit_ok"), F.col("first")).otherwise(F.col("id")).alias("part"))


def shortened(text: Column, limit: int) -> Column:
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.regexp_replace(F.left(plain, F.lit(limit - 1)), r"\s+$", ""), F.lit("…")))


def evidence_list(values: Column, size: Column | None = None) -> Column:
    """The first items of a list as one text; how many more there are is said. ``size``: the list's, if ``values`` holds only its start."""
    size = F.size(values) if size is None else size
    shown = F.transform(F.filter(F.slice(values, 1, ITEMS), lambda x: F.coalesce(F.regexp_replace(x, r"\s+", ""), F.lit("")) != ""), lambda x: shortened(x, ITEM_CHARS))
    more = F.when(size > ITEMS, F.array(F.concat(F.lit("... ("), (size - ITEMS).cast("string"), F.lit(" more items omitted)")))).otherwise(F.array().cast("array<string>"))
    return F.when(values.isNull(), "").otherwise(shortened(F.array_join(F.concat(shown, more), ", "), TEXT_CHARS))


def evidence_text(value: Column) -> Column:
    return F.coalesce(shortened(value.cast("string"), TEXT_CHARS), F.lit(""))


def metadata_section(fields: dict[str, Column]) -> Column:
    """Markdown lines of the fields that are given (by the keys of ``METADATA``); an author's name stands for the id, 0 is no parent or media."""
    lines = []
    for key, name in METADATA.items():
        if key in fields:
            value = fields[key].cast("string")
            shown = value.isNotNull()
            if key in ("parent", "featured_media"):
                shown &= value != "0"
            if key in ("template", "featured_image", "categories", "tags"):
                shown &= value != ""
            if key == "author" and "author_name" in fields:
                shown &= fields["author_name"].isNull()
            lines.append(F.when(shown, F.concat(F.lit(f"- **{name}**: "), value)))
    return F.concat_ws("\n", *lines)


class _Finder(HTMLParser):
    """Where the first element of each selector starts and ends."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list] = {}
        self.lines = [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for spot in self.found.values():
            if spot[2] == tag and spot[1] is None:
                spot[3] += 1
        given = dict(attrs)
        names = {tag, f"#{given.get('id')}", *(f".{c}" for c in (given.get("class") or "").split())}
        for selector in CONTENT:
            if selector in names:
                self.found.setdefault(selector, [self.at(), None, tag, 1])

    def handle_endtag(self, tag: str) -> None:
        for spot in self.found.values():
            if spot[2] == tag and spot[1] is None:
                spot[3] -= 1
                if not spot[3]:
                    spot[1] = self.at()


def main_content(page: str | None) -> str | None:
    """The markup inside a page's main content (from its start tag to its end tag, or to the page's end); null without any."""
    found = _Finder(page or "").found
    for selector in CONTENT:
        if selector in found:
            start, end = found[selector][:2]
            return (page or "")[start:end]
    return None


def select_main_content(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, content)"""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "content": [main_content(x) for x in pdf["html"]]})

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, content string").withColumnRenamed("key", key)


def graph_answer(answer: str | None) -> bool:
    """Whether a model's answer is a graph: JSON with nodes and relationships."""
    found = rag.parse_json(answer)
    return isinstance(found, dict) and isinstance(found.get("nodes"), list) and isinstance(found.get("relationships"), list)


def extract_graph(texts: DataFrame, key: str, text: str, provider: rag.Provider, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, tries, nodes: array of ids, relationships: array<struct<source, type, target>>): what a provider finds in each text.

    An answer that isn't a graph is asked for again; after the last try both lists are null. Entries without an id or an end go.
    """
    prompt = F.concat(F.lit("Return JSON with nodes and relationships of this text.\n"), F.coalesce(F.col(text), F.lit("")))
    asked = rag.ask(texts.select(F.col(key).alias("key"), prompt.alias("prompt")), "prompt", provider, tries=tries, check=graph_answer, wait=wait)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rag.parse_json(a) if a else None for a in pdf["answer"]]
            ends = lambda g: [tuple(str(r.get(k) or "") for k in ("source", "type", "target")) for r in g["relationships"] if r.get("source") and r.get("target")]
            yield pd.DataFrame({"key": pdf["key"], "tries": pdf["tries"], "nodes": [[str(n["id"]) for n in g["nodes"] if n.get("id")] if g else None for g in found], "relationships": [[dict(zip(("source", "type", "target"), e, strict=True)) for e in ends(g)] if g else None for g in found]})

    kind = dict(texts.dtypes)[key]
    return asked.mapInPandas(run, f"key {kind}, tries int, nodes array<string>, relationships array<struct<source:string,type:string,target:string>>").withColumnRenamed("key", key)


def comparison(answer: Column, a: Column, b: Column) -> Column:
    """struct(decision, confidence, canonical_id): a checked comparison of two entities; null if the answer isn't JSON.

    Unknown decisions are "do_not_merge", confidences are kept within 0 and 1 (0.5 if none), the canonical id is one of the two.
    """
    found = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "decision string, confidence double, canonical_entity_id string, reasoning string")
    decision = F.when(found["decision"] == "merge", "merge").otherwise("do_not_merge")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(found["confidence"], F.lit(0.5))))
    canonical = F.when(found["canonical_entity_id"].isin(a, b), found["canonical_entity_id"]).otherwise(a)
    made = F.struct(decision.alias("decision"), confidence.alias("confidence"), canonical.alias("canonical_id"))
    return F.when(F.coalesce(answer.rlike(r"(?s)\{.*\}"), F.lit(False)), made)


def two_pass(members: DataFrame, decide: Callable[[list], list[list]], batch: int = 20) -> DataFrame:
    """(cluster, id, part): clusters resolved by a decision that gets records and returns groups of their ids; a part is named by its least id.

    First every batch of at most ``batch`` records is decided; then, for records that agree in ``hint`` across batches, one record for
    each group found is. A task never holds more than a batch. Ids that an answer leaves out or repeats are put right: each is in
    one group, by itself if need be. members: cluster, id, hint (what alike records share), record (a struct with the id).
    """
    ship(members.sparkSession)
    kind = dict(members.dtypes)["id"]

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        first: dict = {}
        for group in decide([json.loads(r) for r in pdf["record"]]):
            known = [x for x in pdf["id"] if x in set(group) and x not in first]
            first |= dict.fromkeys(known, known[0] if known else None)
        return pd.DataFrame({"part": pdf["id"], "to": [first.get(x, x) for x in pdf["id"]]})

    rows = cut(members.select("cluster", "id", "hint", F.to_json("record").alias("record"), F.col("id").alias("part")))
    for keys in (["cluster"], ["cluster", "hint"]):
        heads = rows.filter("id = part")
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1
        heads = heads.withColumn("batch", F.floor(number / batch))
        moved = heads.groupBy(*keys, "batch").applyInPandas(lambda pdf: groups(pdf[["id", "record"]]), f"part {kind}, to {kind}")
        rows = cut(rows.join(moved, "part").select("cluster", "id", "hint", "record", F.col("to").alias("part")))
    return rows.select("cluster", "id", "part")
