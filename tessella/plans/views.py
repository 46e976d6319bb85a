"""The supplied tables as the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import vocab


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the title is what comes before the first full stop."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.substring_index("text", ".", 1).alias("title"), "text")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relation mentions: a supplier, a code by return flag, a part."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    code = F.when(F.col("l_returnflag") == "A", "CONTROLE").when(F.col("l_returnflag") == "R", "MANIE").otherwise("a_cree ")
    joined = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("s_name").alias("source"), code.alias("relation"), F.col("p_name").alias("target"), F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("url"))


def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts' names as entities ``(ord, text, type, source_url)``."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("ord"), F.col("s_name").alias("text"), F.lit("ORGANIZATION").alias("type"))
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min(F.col("p_partkey") * 2 + 1).alias("ord")).select("ord", "text", F.lit("ARTIFACT").alias("type"))
    return s.unionByName(p).select("ord", "text", "type", F.concat(F.lit("entity/"), F.col("ord").cast("string")).alias("source_url"))


def star_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as triples between IRIs; it exercises each rule.

    Customers are members of their nation's organization, nations subgroups of
    their region, the richest customer of a nation leads it, customers take
    part in their orders, orders take place at their suppliers' nations,
    neighbours in key of a nation's suppliers are allies, suppliers of a part
    are enemies of the part's first supplier, and control the part.
    """
    c, n, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    s, l = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")  # noqa: E741

    def edge(df: DataFrame, a: str, key_a: str, prop: str, b: str, key_b: str) -> DataFrame:
        return df.select(F.concat(F.lit(vocab.DATA + a + "_"), F.col(key_a).cast("string")).alias("s"), F.lit(vocab.ONTOLOGY + prop).alias("p"), F.concat(F.lit(vocab.DATA + b + "_"), F.col(key_b).cast("string")).alias("o"))

    richest = c.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey"))["c_custkey"].alias("c_custkey"))
    places = l.select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    allies = s.select("s_nationkey", "s_suppkey").join(s.select(F.col("s_nationkey").alias("n2"), F.col("s_suppkey").alias("k2")), (F.col("s_nationkey") == F.col("n2")) & (F.expr("s_suppkey div 8") == F.expr("k2 div 8")) & (F.col("s_suppkey") < F.col("k2")))
    supplied = l.select("l_partkey", "l_suppkey").distinct()
    firsts = supplied.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first"))
    rivals = supplied.join(firsts, "l_partkey").where("l_suppkey <> first")
    edges = [
        edge(c, "character_customer", "c_custkey", "memberOf", "organization_nation", "c_nationkey"),
        edge(n, "organization_nation", "n_nationkey", "subgroupOf", "faction_region", "n_regionkey"),
        edge(richest, "character_customer", "c_custkey", "leads", "organization_nation", "c_nationkey"),
        edge(o, "character_customer", "o_custkey", "participatedIn", "event_order", "o_orderkey"),
        edge(places, "event_order", "l_orderkey", "tookPlaceAt", "location_nation", "s_nationkey"),
        edge(allies, "organization_supplier", "s_suppkey", "allyOf", "organization_supplier", "k2"),
        edge(rivals, "organization_supplier", "l_suppkey", "enemyOf", "organization_supplier", "first"),
        edge(supplied, "organization_supplier", "l_suppkey", "controls", "artifact_part", "l_partkey"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    none = F.lit(None).cast("string")
    return out.distinct().select("s", "p", "o", F.lit("iri").alias("o_kind"), none.alias("o_lang"), none.alias("o_dtype"))


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and names of nations and regions, to be joined to the star graph."""
    from tessella.operators.graph import _iri, _literal

    n = table(spark, sf_dir, "nation").select(F.concat(F.lit(vocab.DATA + "organization_nation_"), F.col("n_nationkey").cast("string")).alias("s"), F.lit(vocab.ONTOLOGY + "Organization").alias("c"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit(vocab.DATA + "faction_region_"), F.col("r_regionkey").cast("string")).alias("s"), F.lit(vocab.ONTOLOGY + "Faction").alias("c"), F.col("r_name").alias("name"))
    rows = n.union(r)
    return rows.select(*_iri(F.col("s"), F.lit(vocab.RDF_TYPE), F.col("c"))).union(rows.select(*_literal(F.col("s"), F.lit(vocab.ONTOLOGY + "name"), F.col("name"), "fr")))
