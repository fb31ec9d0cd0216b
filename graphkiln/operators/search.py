"""Entity search: lexical, fragment, term and hybrid scores as column expressions over nodes (id, name, aliases, description)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.functions import text as t


def _folded(x: Column) -> Column:
    return t.strip_diacritics(F.lower(F.coalesce(x, F.lit(""))))


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _overlap(query: Column, name: Column) -> Column:
    """Share of the query's tokens that the name has."""
    words = lambda x: F.array_distinct(F.array_remove(F.split(x, r"\s+"), ""))
    return F.when(F.size(words(query)) > 0, F.size(F.array_intersect(words(query), words(name))) / F.size(words(query))).otherwise(0.0)


def _ladder(query: Column, name: Column, folded: Column) -> Column:
    best_alias = F.when(_any(folded, lambda a: a == query), 0.95).when(_any(folded, lambda a: a.contains(query)), 0.85).otherwise(0.0)
    return F.when(name == query, 1.0).when(name.contains(query), 0.9).otherwise(best_alias)


def lexical_score(query: str, name: Column, aliases: Column) -> Column:
    """Equal names before contained ones, then aliases; else the share of query tokens."""
    q, n = _folded(F.lit(query.strip())), _folded(name)
    found = _ladder(q, n, F.transform(aliases, _folded))
    return F.when(found > 0, found).otherwise(_overlap(q, n))


def hybrid_score(query: str, name: Column, aliases: Column, vector_score: Column) -> Column:
    """Lexical and vector score mixed, the lexical one weighing more when it is strong."""
    q, n = _folded(F.lit(query)), _folded(name)
    lexical = F.greatest(_ladder(q, n, F.transform(aliases, _folded)), _overlap(q, n) * 0.7)
    return F.when(lexical >= 0.8, 0.4 * vector_score + 0.6 * lexical).otherwise(0.6 * vector_score + 0.4 * lexical)


#: Points of a term's best kind of hit, and the least length of a term that is looked up in descriptions.
POINTS = {"exact_name": 100.0, "exact_alias": 95.0, "partial_alias": 90.0, "partial_name": 80.0, "search_text": 70.0, "description": 60.0}
DESCRIPTION_TERM = 5


def entity_score(terms: Column, name: Column, aliases: Column, search_text: Column, descriptions: Column, floor: Column) -> Column:
    """The best hit of any term, at least ``floor``; all in query form."""

    def points(x: Column) -> Column:
        term = t.query_text(x)
        n, a, d = t.query_text(name), F.transform(aliases, t.query_text), F.transform(descriptions, t.query_text)
        hit = lambda ok, kind: F.when(ok, POINTS[kind]).otherwise(0.0)
        best = F.greatest(
            hit(n == term, "exact_name"), hit(_any(a, lambda y: y == term), "exact_alias"), hit(_any(a, lambda y: y.contains(term)), "partial_alias"),
            hit(n.contains(term), "partial_name"), hit(search_text.contains(term), "search_text"), hit((F.length(term) >= DESCRIPTION_TERM) & _any(d, lambda y: y.contains(term)), "description"),
        )
        return F.when(term == "", 0.0).otherwise(best)

    return F.greatest(floor, F.coalesce(F.array_max(F.transform(terms, points)), F.lit(0.0)))


def fragment_entity_score(fragment: str, name: Column, aliases: Column, descriptions: Column) -> Column:
    """Null if the fragment is nowhere."""
    q = F.lit(fragment.lower())
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda items, test: _any(F.transform(items, F.lower), test)
    equal, within = (lambda y: y == q), (lambda y: y.contains(q))
    return F.when(n == q, 100).when(has(aliases, equal), 95).when(has(aliases, within), 90).when(n.contains(q), 80).when(has(descriptions, within), 60)


def fragment_edge_score(fragment: str, kind: Column, descriptions: Column, source: Column, source_aliases: Column, target: Column, target_aliases: Column) -> Column:
    q = F.lit(fragment.lower())
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    within = lambda items: _any(F.transform(items, F.lower), lambda y: y.contains(q))
    return F.when(low(kind) == q, 100).when(within(descriptions), 90).when(within(source_aliases) | within(target_aliases), 80).when(low(source).contains(q) | low(target).contains(q), 70).when(low(kind).contains(q), 50)


def top(df: DataFrame, score: Column, k: int, *ties: str) -> DataFrame:
    """The k best rows with a positive score."""
    return df.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), *ties).limit(k)
