"""Relations: answers, validation, merge, canonical form, quality filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella import schemas, vocab
from tessella.functions import text as T

_RELATIONS = f"ARRAY<{schemas.RELATION}>"


def entity_prompts(entities: DataFrame, most: int = 60) -> DataFrame:
    """``(url, prompt)``: the first ``most`` entities of each page as "name (type)"."""
    item = F.struct("ord", F.concat("text", F.lit(" ("), "type", F.lit(")")).alias("s"))
    # Ranked before they are gathered: a page with many entities passes on ``most`` of each task.
    place = F.row_number().over(W.partitionBy("source_url").orderBy("ord", "text", "type"))
    first = entities.withColumn("__place", place).where(F.col("__place") <= most)
    return first.groupBy(F.col("source_url").alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ", ").alias("prompt"))


def parse_relations(raw: Column) -> Column:
    """An answer's array of relations: tagged, else fenced, else bracketed; null if unreadable."""
    tagged = F.regexp_extract(raw, r"(?s)<json_answer>(.*?)</json_answer>", 1)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.from_json(F.when(tagged != "", tagged).when(fenced != "", fenced).otherwise(bare), _RELATIONS)


def valid_relations(rows: DataFrame, codes: list[str] = list(vocab.RELATION_PROPERTIES)) -> DataFrame:
    """Stripped, the code in upper case; no part empty, the code known."""
    clean = rows.withColumns({"source": T.strip(F.coalesce("source", F.lit(""))), "relation": F.upper(T.strip(F.coalesce("relation", F.lit("")))), "target": T.strip(F.coalesce("target", F.lit("")))})
    return clean.where((F.col("source") != "") & (F.col("target") != "") & F.col("relation").isin(codes))


def doc_relations(answers: DataFrame) -> DataFrame:
    """``answers(url, chunk, raw)`` -> ``(url, chunk, pos, source, relation, target)``, deduplicated by page."""
    items = answers.select("url", "chunk", F.posexplode(parse_relations(F.col("raw"))).alias("pos", "r")).select("url", "chunk", "pos", "r.*")
    key = ["url", F.lower("source").alias("ls"), "relation", F.lower("target").alias("lt")]
    first = valid_relations(items).groupBy(*key).agg(F.min(F.struct("chunk", "pos", "source", "target")).alias("r"))
    return first.select("url", "r.chunk", "r.pos", "r.source", "relation", "r.target")


def gathered_relations(relations: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page's relations in one row, pages without any included."""
    item = F.struct("chunk", "pos", "source", "relation", "target")
    lists = relations.groupBy("url").agg(F.array_sort(F.collect_list(item)).alias("r"))
    found = F.coalesce(F.transform("r", lambda x: F.struct(x["source"].alias("source"), x["relation"].alias("relation"), x["target"].alias("target"))), F.array().cast(_RELATIONS))
    return pages.select("url", "title").join(lists, "url", "left").select("url", "title", found.alias("relations"), F.struct(F.size(found).alias("relations_found")).alias("stats"))


def relation_histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation")


def known_names(entities: DataFrame) -> DataFrame:
    return entities.select(F.lower(T.strip(F.col("text"))).alias("name")).where("name <> ''").distinct()


def merge_relations(mentions: DataFrame) -> DataFrame:
    """``mentions(ord, source, relation, target, url)`` -> one row for each lower-cased key.

    The first mention's spelling, the number of mentions, and the distinct
    non-empty URLs in the order of their first mention.  Mentions are reduced to
    one row for each key and URL before lists are made, so a hot key's list is
    as long as its URLs.
    """
    key = [F.lower("source").alias("ls"), F.col("relation").alias("relation"), F.lower("target").alias("lt")]
    by_url = mentions.groupBy(*key, "url").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "source", "target")).alias("first"))
    urls = F.filter(F.array_sort(F.collect_list(F.struct(F.col("first.ord").alias("ord"), "url"))), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    merged = by_url.groupBy("ls", "relation", "lt").agg(F.min("first").alias("first"), F.sum("n").alias("frequency"), F.transform(urls, lambda x: x["url"]).alias("source_urls"))
    return merged.select("first.source", "relation", "first.target", "source_urls", "frequency", F.col("first.ord").alias("ord"))


def confirm(relations: DataFrame, names: DataFrame) -> DataFrame:
    """``confirmed_by_ner``: both ends are known names."""
    left, right = names.select(F.col("name").alias("__s")), names.select(F.col("name").alias("__t"))
    rows = relations.join(left, F.lower(T.strip(F.col("source"))) == F.col("__s"), "left").join(right, F.lower(T.strip(F.col("target"))) == F.col("__t"), "left")
    return rows.withColumn("confirmed_by_ner", F.col("__s").isNotNull() & F.col("__t").isNotNull()).drop("__s", "__t")


def by_frequency(relations: DataFrame) -> DataFrame:
    return relations.orderBy(F.desc("frequency"), "ord")


def merge_report(relations: DataFrame) -> DataFrame:
    """The number of relations, the confirmed share in percent, and those seen more than once."""
    return relations.agg(F.count(F.lit(1)).alias("relations"), F.round(100 * F.avg(F.col("confirmed_by_ner").cast("double")), 2).alias("confirmed_percent"), F.sum((F.col("frequency") > 1).cast("long")).alias("repeated"))


def canonicalize(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """``relations(ord, ...)`` with resolved ends, merged again: frequencies summed, URLs united and sorted."""
    rows = relations.join(resolved.toDF("source", "s"), "source").join(resolved.toDF("target", "t"), "target")
    key = [F.lower("s").alias("ls"), "relation", F.lower("t").alias("lt")]
    # URLs are made distinct before they are gathered, one row each.
    merged = rows.groupBy(*key).agg(F.min(F.struct("ord", "s", "t")).alias("first"), F.sum("frequency").alias("frequency"))
    each = rows.select(*key, F.explode("source_urls").alias("url")).distinct()
    urls = each.groupBy("ls", "relation", "lt").agg(F.array_sort(F.collect_list("url")).alias("source_urls"))
    merged = merged.join(urls, ["ls", "relation", "lt"], "left").withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))
    return merged.select(F.col("first.s").alias("source"), "relation", F.col("first.t").alias("target"), "source_urls", "frequency", F.col("first.ord").alias("ord"))


def project_entities(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that relations use; names without an entity become placeholders."""
    used = relations.select(F.col("source").alias("text")).union(relations.select("target")).distinct()
    known = entities.select("text", "type", "description", "source_urls", "aliases", F.lit(True).alias("__known"))
    none = F.array().cast("array<string>")
    return used.join(known, "text", "left").select(
        "text",
        F.coalesce("type", F.lit("CONCEPT")).alias("type"),
        F.when(F.col("__known"), F.coalesce("description", F.lit(""))).otherwise(vocab.PLACEHOLDER_DESCRIPTION).alias("description"),
        F.coalesce("source_urls", none).alias("source_urls"),
        F.coalesce("aliases", none).alias("aliases"),
    )


def name_support(relations: DataFrame) -> DataFrame:
    """``(name, mentions, sources)``: relation rows that touch a name (both ends count), and distinct URLs."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("name"), "source_urls")
    mentions = ends.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    urls = ends.select("name", F.explode("source_urls").alias("url")).groupBy("name").agg(F.countDistinct("url").alias("sources"))
    return mentions.join(urls, "name", "left").select("name", "mentions", F.coalesce("sources", F.lit(0)).alias("sources"))


def enough_support(thresholds: dict[str, tuple[int, int]] | None = None, default: tuple[int, int] = vocab.DEFAULT_THRESHOLD) -> Column:
    """Whether mentions and sources reach the type's thresholds."""
    mentions, sources = F, F
    for kind, (m, s) in (thresholds or vocab.THRESHOLDS).items():
        mentions, sources = mentions.when(F.col("type") == kind, m), sources.when(F.col("type") == kind, s)
    return (F.col("mentions") >= mentions.otherwise(default[0])) & (F.col("sources") >= sources.otherwise(default[1]))


def filter_quality(entities: DataFrame, relations: DataFrame, thresholds: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities with enough support, and relations between two of them; one pass."""
    types = entities.groupBy(F.col("text").alias("name")).agg(F.max("type").alias("type"))
    support = name_support(relations).join(types, "name", "left")
    valid = support.where(enough_support(thresholds)).select("name")
    kept = entities.join(valid, F.col("text") == F.col("name"), "left_semi")
    both = relations.join(valid, F.col("source") == F.col("name"), "left_semi").join(valid, F.col("target") == F.col("name"), "left_semi")
    return kept, both


def type_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities by type before and after the filter."""
    old = before.groupBy("type").agg(F.count(F.lit(1)).alias("before"))
    new = after.groupBy("type").agg(F.count(F.lit(1)).alias("after"))
    return old.join(new, "type", "left").select("type", "before", F.coalesce("after", F.lit(0)).alias("after"))
