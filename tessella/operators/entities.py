"""Synonym merge, and resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.fuzzy import matching_ratio


def valid_synonym(name: Column) -> Column:
    """Three characters at least, and no parentheses."""
    return (F.length(T.strip(name)) >= 3) & ~name.rlike(r"[()]")


def flat_synonyms(groups: DataFrame) -> DataFrame:
    """``groups(ord, synonyms)`` -> ``(ord, pos, sub, canonical, surface)``; the canonical is its first surface."""
    items = groups.select("ord", F.posexplode("synonyms").alias("pos", "g")).select("ord", "pos", F.col("g.canonical").alias("canonical"), F.col("g.synonyms").alias("names"))
    names = F.concat(F.array("canonical"), F.filter("names", valid_synonym))
    return items.select("ord", "pos", "canonical", F.posexplode(names).alias("sub", "surface"))


def reverse_map(flat: DataFrame) -> DataFrame:
    """``(key, canonical)``: the last group that claims a surface has it."""
    return flat.groupBy(F.lower("surface").alias("key")).agg(F.max_by("canonical", F.struct("ord", "pos", "sub")).alias("canonical"))


def alias_sets(flat: DataFrame) -> DataFrame:
    return flat.groupBy("canonical").agg(F.collect_set("surface").alias("names"))


def merge_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """``entities(ord, text, type, source_url)`` -> merged entities with sorted aliases.

    A name of a group becomes its canonical, with the first type and the first
    URL that isn't empty; others stand under their exact text, first wins.
    Canonicals that no entity names become CONCEPT rows without URL.
    """
    flat = flat_synonyms(groups)
    hit = entities.join(reverse_map(flat), F.lower("text") == F.col("key"), "left")
    kept = hit.groupBy(F.coalesce("canonical", "text").alias("text"), F.col("canonical").isNotNull().alias("known")).agg(
        F.min_by("type", "ord").alias("type"),
        F.coalesce(F.min_by("source_url", "ord"), F.lit("")).alias("first_url"),
        F.min(F.when(F.col("source_url") != "", F.struct("ord", "source_url")))["source_url"].alias("url"),
    )
    # A text that isn't a surface and equals a canonical's spelling would be a surface, so texts are unique.
    aliases = alias_sets(flat).withColumnRenamed("canonical", "c")
    rows = kept.join(aliases, (F.col("text") == F.col("c")) & F.col("known"), "full")
    text = F.coalesce("text", "c")
    return rows.select(
        text.alias("text"),
        F.coalesce("type", F.lit("CONCEPT")).alias("type"),
        F.coalesce(F.when(F.col("known"), F.col("url")).otherwise(F.col("first_url")), F.lit("")).alias("source_url"),
        F.coalesce(F.array_sort(F.array_remove("names", text)), F.array().cast("array<string>")).alias("aliases"),
    )


def canonical_map(entities: DataFrame) -> DataFrame:
    """``entities(ord, text, aliases)`` -> ``(key, canonical)``, last wins."""
    names = F.concat(F.array("text"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("ord", F.col("text").alias("canonical"), F.posexplode(names).alias("pos", "surface"))
    return rows.groupBy(F.lower(T.strip(F.col("surface"))).alias("key")).agg(F.max_by("canonical", F.struct("ord", "pos")).alias("canonical"))


def _bag(name: str) -> Column:
    """A string's characters, numbered by occurrence."""
    chars = F.split(F.col(name), "")
    counted = F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.size(F.filter(chars, lambda x: x == c)).alias("n")))
    return F.flatten(F.transform(counted, lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.concat(x["c"], F.lit("#"), i.cast("string")))))


def _grams(name: str) -> Column:
    """A string's distinct substrings of one, two and three characters."""
    text = F.col(name)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(of(1), F.when(F.length(text) >= 2, of(2)).otherwise(none), F.when(F.length(text) >= 3, of(3)).otherwise(none)))


def fuzzy_matches(queries: DataFrame, keys: DataFrame, least: float = 0.85) -> DataFrame:
    """``queries(q)``, ``keys(key)`` -> the best key of ratio >= ``least``; ties take the largest key.

    With lengths that sum to T, a ratio of r has M = rT/2 matched characters
    and T - 2M others, so at most (1 - r)T + 1 matching blocks: the longest has
    at least M / ((1 - r)T + 1) characters.  Pairs are joined on a shared
    substring of three, two or one characters, as many as their T guarantees
    (three for T > 16 at 0.85).  Bounds by length and by common characters are
    then verified, and the ratio itself only on what is left.
    """
    queries = queries.select("q").where(F.length("q") > 0).distinct().withColumn("bag", _bag("q"))
    keys = keys.select("key").where(F.length("key") > 0).distinct().withColumn("kbag", _bag("key"))
    left = queries.select("q", F.length("q").alias("nq"), F.explode(_grams("q")).alias("g"))
    right = keys.select("key", F.length("key").alias("nk"), F.explode(_grams("key")).alias("g"))
    total = F.col("nq") + F.col("nk")
    matched, blocks = least / 2 * total - 1e-9, (1 - least) * total + 1
    size = F.when(matched > 2 * blocks, 3).when(matched > blocks, 2).otherwise(1)
    near = 2 * F.least("nq", "nk") >= least * total - 1e-9
    pairs = left.join(right, "g").where(near & (F.length("g") == size)).select("q", "key").distinct()
    both = pairs.join(queries, "q").join(keys, "key")
    shared = F.size(F.array_intersect("bag", "kbag"))
    likely = both.where(2 * shared >= least * (F.length("q") + F.length("key")) - 1e-9)
    scored = likely.select("q", "key", matching_ratio(F.col("key"), F.col("q")).alias("ratio")).where(F.col("ratio") >= least)
    return scored.groupBy("q").agg(F.max(F.struct("ratio", "key")).alias("best")).select("q", F.col("best.key").alias("key"), F.col("best.ratio").alias("ratio"))


def resolve_names(names: DataFrame, mapping: DataFrame, least_length: int = 6, least: float = 0.85) -> DataFrame:
    """``names(name)`` -> ``(name, canonical)``: exact, else fuzzy, else as it is."""
    asked = names.select("name", T.strip(F.col("name")).alias("bare")).distinct().withColumn("q", F.lower("bare"))
    exact = asked.join(mapping, asked.q == mapping.key, "left").select("name", "bare", "q", "canonical")
    open_names = exact.where(F.col("canonical").isNull() & (F.length("q") >= least_length))
    found = fuzzy_matches(open_names.select("q"), mapping.select("key"), least).join(mapping, "key").select("q", F.col("canonical").alias("fuzzy"))
    return exact.join(found, "q", "left").select("name", F.coalesce("canonical", "fuzzy", "bare").alias("canonical"))
