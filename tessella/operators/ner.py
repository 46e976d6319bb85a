"""Entities from titles, and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella import schemas, vocab
from tessella.functions import text as T


def title_entities(pages: DataFrame) -> DataFrame:
    """``(ord, text, type, source_url)``: the first page of each title, regardless of case."""
    titled = pages.where("title is not null").select("ord", T.strip(F.col("title")).alias("text"), F.col("url").alias("source_url"))
    titled = titled.where(~T.ignored_title(F.col("text")))
    # A struct's minimum is reduced before the shuffle; a window is not.
    first = titled.groupBy(F.lower("text").alias("key")).agg(F.min(F.struct("ord", "text", "source_url")).alias("r")).select("r.*")
    return first.select("ord", "text", T.infer_type(F.col("text")).alias("type"), "source_url")


def count_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def sample_unknown(entities: DataFrame, size: int = 15) -> DataFrame:
    """The first entities without a type: a report."""
    return entities.where(F.col("type") == vocab.UNKNOWN).orderBy("ord").limit(size)


def batches(entities: DataFrame, size: int = 30, order: str = "ord") -> DataFrame:
    """Untyped entities in numbered batches, in order.

    Ranks come from the sizes of the range partitions, so no task orders all.
    """
    unknown = entities.where(F.col("type") == vocab.UNKNOWN)
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = unknown.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__m")
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(before, "__p").withColumn("batch", F.floor((F.col("__before") + F.col("__i")) / size).cast("long")).drop("__p", "__i", "__before")


def with_snippets(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """The snippet of the last page of each entity's URL; empty without one."""
    last = pages.groupBy(F.col("url").alias("source_url")).agg(F.max_by("text", "ord").alias("__t"))
    return entities.join(last, "source_url", "left").withColumn("snippet", T.snippet(F.col("__t"))).drop("__t")


def parse_classes(raw: Column) -> Column:
    """An answer's array of (name, type); null if it can't be read."""
    tagged = F.regexp_extract(raw, r"(?s)<json_answer>(.*?)</json_answer>", 1)
    bare = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.from_json(F.when(tagged != "", tagged).otherwise(bare), schemas.CLASS_ANSWER)


def answered_types(answers: DataFrame, types: tuple[str, ...] = vocab.ENTITY_TYPES) -> DataFrame:
    """``answers(batch, raw)`` -> ``(key, type)``: the last valid answer of each name."""
    items = answers.select("batch", F.posexplode(parse_classes(F.col("raw"))).alias("pos", "item"))
    rows = items.select("batch", "pos", F.lower(T.strip(F.col("item.name"))).alias("key"), F.upper(T.strip(F.col("item.type"))).alias("type"))
    valid = rows.where((F.col("key") != "") & F.col("type").isin(list(types)))
    return valid.groupBy("key").agg(F.max_by("type", F.struct("batch", "pos")).alias("type"))


def accepted_batches(answers: DataFrame, least: float = 0.8) -> DataFrame:
    """``answers(batch, size, raw)`` whose readable names are enough of the batch."""
    named = F.size(F.filter(parse_classes(F.col("raw")), lambda x: x["name"] != ""))
    return answers.withColumn("accepted", F.coalesce(named >= least * F.col("size"), F.lit(False)))


def fill_types(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """Untyped entities take an answer other than UNKNOWN."""
    given = answers.where(F.col("type") != vocab.UNKNOWN).select(F.col("key").alias("__k"), F.col("type").alias("__t"))
    joined = entities.join(given, F.lower(T.strip(F.col("text"))) == F.col("__k"), "left")
    filled = F.when(F.col("type") == vocab.UNKNOWN, F.coalesce("__t", "type")).otherwise(F.col("type"))
    return joined.withColumn("type", filled).drop("__k", "__t")
