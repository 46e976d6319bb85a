"""The graph: triples ``(s, p, o, o_kind, o_lang, o_dtype)``, a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas, vocab
from tessella.functions import text as T
from tessella.plans.materialize import checkpointed


def _none() -> Column:
    return F.lit(None).cast("string")


def entity_id(text: Column, kind: Column) -> Column:
    return F.concat(F.lower(kind), F.lit("_"), T.slug(text))


def entity_mapping(entities: DataFrame) -> DataFrame:
    """``entities(ord, text, type, aliases)`` -> ``(key, eid)`` of names and aliases, last wins."""
    names = F.concat(F.array("text"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("ord", entity_id(F.col("text"), F.col("type")).alias("eid"), F.posexplode(names).alias("pos", "name"))
    return rows.groupBy(F.lower("name").alias("key")).agg(F.max_by("eid", F.struct("ord", "pos")).alias("eid"))


def _iri(s: Column, p: Column, o: Column) -> list[Column]:
    return [s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), _none().alias("o_lang"), _none().alias("o_dtype")]


def _literal(s: Column, p: Column, o: Column, lang: str | None = None, dtype: str | None = None) -> list[Column]:
    return [s.alias("s"), p.alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"), F.lit(dtype).cast("string").alias("o_dtype")]


def ontology(spark: SparkSession, namespace: str = vocab.ONTOLOGY) -> DataFrame:
    """Classes and datatype properties that the graph declares."""
    n, t, iri = namespace, vocab.RDF_TYPE, ("iri", None, None)
    rows = [(n + "Entity", t, vocab.OWL + "Class", *iri)]
    for name, label in (("Character", "Personnage"), ("Faction", "Faction"), ("Location", "Lieu")):
        rows += [(n + name, t, vocab.OWL + "Class", *iri), (n + name, vocab.RDFS + "subClassOf", n + "Entity", *iri), (n + name, vocab.RDFS + "label", label, "literal", "fr", None)]
    rows += [(n + name, t, vocab.OWL + "DatatypeProperty", *iri) for name in ("name", "description")]
    return spark.createDataFrame(rows, schemas.TRIPLE)


def entity_triples(entities: DataFrame, namespace: str = vocab.ONTOLOGY, data: str = vocab.DATA) -> DataFrame:
    """Type, name and, if there is one, description of each entity."""
    kind = F
    for t, c in vocab.TYPE_CLASSES.items():
        kind = kind.when(F.col("type") == t, namespace + c)
    rows = entities.select(F.concat(F.lit(data), entity_id(F.col("text"), F.col("type"))).alias("s"), kind.otherwise(namespace + "UnknownEntity").alias("c"), "text", F.coalesce("description", F.lit("")).alias("d"))
    s = F.col("s")
    one = rows.select(*_iri(s, F.lit(vocab.RDF_TYPE), F.col("c")))
    two = rows.select(*_literal(s, F.lit(namespace + "name"), F.col("text"), "fr"))
    three = rows.where("d <> ''").select(*_literal(s, F.lit(namespace + "description"), F.col("d"), "fr"))
    return one.union(two).union(three).distinct()




def resolve_ends(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names(name)``, ``entities(ord, text, type)`` -> ``(name, eid)``.

    Exact, else the first entity whose name contains the name or is contained
    in it.  A name's substrings of the lengths that entities' names have are
    looked up among these; the substrings of entities' names of the lengths
    that open names have are reduced to the first entity each, before any name
    is joined.  So the work grows with the lengths of the names, and what many
    names share makes no pairs.
    """
    index = entities.groupBy(F.lower("text").alias("key")).agg(F.min("ord").alias("ord"), F.max_by(entity_id(F.col("text"), F.col("type")), "ord").alias("eid")).where("key <> ''")
    index = checkpointed(index)
    asked = names.select("name", F.lower("name").alias("q")).where("name is not null").distinct()
    exact = checkpointed(asked.join(index.select("key", "eid"), asked.q == index.key, "left").select("name", "q", "eid"))
    rest = exact.where("eid is null").select("q").where("q <> ''").distinct()

    def parts(df: DataFrame, c: str, of: DataFrame, d: str) -> DataFrame:
        """``df`` with the distinct substrings ``g`` of ``c`` that are as long as any ``d``."""
        lengths = of.agg(F.array_sort(F.collect_set(F.length(d))).alias("sizes"))  # one row: as many as there are lengths
        size = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))
        found = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length(c)), size))
        return df.crossJoin(F.broadcast(lengths)).withColumn("g", F.explode(F.array_distinct(found))).drop("sizes")

    first = F.min_by("eid", "ord").alias("eid"), F.min("ord").alias("ord")
    within = parts(rest, "q", index, "key").join(index.select(F.col("key").alias("g"), "ord", "eid"), "g").select("q", "ord", "eid")
    around = parts(index, "key", rest, "q").groupBy("g").agg(*first).join(rest, F.col("g") == F.col("q")).select("q", "ord", "eid")
    near = within.union(around).groupBy("q").agg(F.min_by("eid", "ord").alias("near"))
    return exact.join(near, "q", "left").select("name", F.coalesce("eid", "near").alias("eid")).where("eid is not null")


def relation_triples(relations: DataFrame, resolved: DataFrame, namespace: str = vocab.ONTOLOGY, data: str = vocab.DATA) -> DataFrame:
    """Relations with a known property and two resolved ends."""
    prop = F
    for code, name in vocab.RELATION_PROPERTIES.items():
        prop = prop.when(F.col("relation") == code, namespace + name)
    rows = relations.withColumn("p", prop).where("p is not null")
    rows = rows.join(resolved.toDF("source", "se"), "source").join(resolved.toDF("target", "te"), "target")
    return rows.select(*_iri(F.concat(F.lit(data), "se"), F.col("p"), F.concat(F.lit(data), "te"))).distinct()


def build_graph(entities: DataFrame, relations: DataFrame) -> DataFrame:
    names = relations.select(F.col("source").alias("name")).union(relations.select("target")).distinct()
    return entity_triples(entities).union(relation_triples(relations, resolve_ends(names, entities))).distinct()


def slug_collisions(entities: DataFrame) -> DataFrame:
    """Ids that several names share."""
    return entities.groupBy(entity_id(F.col("text"), F.col("type")).alias("eid")).agg(F.countDistinct("text").alias("names")).where("names > 1")


def node_frequency(triples: DataFrame, data: str = vocab.DATA) -> DataFrame:
    """How often each data node is a subject or an object."""
    objects = triples.where("o_kind = 'iri'").select(F.col("o").alias("uri"))
    return triples.select(F.col("s").alias("uri")).union(objects).where(F.col("uri").startswith(data)).groupBy("uri").agg(F.count(F.lit(1)).alias("freq"))


def alignment_queue(triples: DataFrame, least: int = 3, most: int = 1500, namespace: str = vocab.ONTOLOGY, data: str = vocab.DATA) -> DataFrame:
    """``(uri, name, type, freq)`` of the nodes to align: by type, then by frequency; a top list."""
    names = triples.where(F.col("p") == namespace + "name").groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("name"))
    types = triples.where(F.col("p") == vocab.RDF_TYPE).groupBy(F.col("s").alias("uri")).agg(F.min(F.upper(F.substring_index("o", "#", -1))).alias("type"))
    rank = F
    for i, t in enumerate(vocab.ALIGN_PRIORITY):
        rank = rank.when(F.col("type") == t, i)
    rows = node_frequency(triples, data).where(F.col("freq") >= least).join(names, "uri").join(types, "uri", "left").withColumn("type", F.coalesce("type", F.lit("CONCEPT")))
    return rows.orderBy(rank.otherwise(99), F.desc("freq"), "uri").limit(most).select("uri", "name", "type", "freq")


def candidates_with_fallback(queue: DataFrame, candidates: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """Candidates of each node's name in the first language that has any."""
    found = queue.join(candidates, F.col("name") == F.col("label"))
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    found = found.withColumn("rank", rank).where("rank > 0")
    best = found.groupBy("uri").agg(F.min("rank").alias("rank"))
    return found.join(best, ["uri", "rank"]).drop("rank", "label")


def confidence(name: Column, label: Column, description: Column, keywords: tuple[str, ...] = vocab.ALIGN_KEYWORDS) -> Column:
    """0.5 for an equal label, else 0.3 if it contains the name; 0.4 more for a keyword; 1 at most."""
    name, label = F.lower(name), F.lower(F.coalesce(label, F.lit("")))
    told = F.lower(F.coalesce(description, F.lit("")))
    keyword = F.lit(False)
    for k in keywords:
        keyword = keyword | F.contains(told, F.lit(k))
    points = F.when(name == label, 5).when(F.contains(label, name), 3).otherwise(0) + F.when(keyword, 4).otherwise(0)
    return F.least(points / F.lit(10.0), F.lit(1.0))


def best_candidates(candidates: DataFrame, least: float = 0.75) -> DataFrame:
    """The best candidate of each node, the first of equals, if it reaches ``least``."""
    scored = candidates.withColumn("score", confidence(F.col("name"), F.col("cand_label"), F.col("description")))
    best = scored.groupBy("uri").agg(F.max_by(F.struct("qid", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("uri", "b.qid", "b.score").where(F.col("score") >= least)


def alignment_triples(best: DataFrame, namespace: str = vocab.ONTOLOGY, external: str = vocab.WIKIDATA) -> DataFrame:
    s = F.col("uri")
    same = best.select(*_iri(s, F.lit(vocab.OWL + "sameAs"), F.concat(F.lit(external), "qid")))
    ids = best.select(*_literal(s, F.lit(namespace + "wikidataId"), F.col("qid")))
    scores = best.select(*_literal(s, F.lit(namespace + "alignmentScore"), F.col("score").cast("string"), None, vocab.XSD_FLOAT))
    return same.union(ids).union(scores)


def label_lookup(candidates: DataFrame, label: str, lang: str, most: int = 3) -> DataFrame:
    """Up to ``most`` distinct candidates of a label; a lookup's shape."""
    return candidates.where((F.col("label") == label) & (F.col("lang") == lang)).select("qid", "cand_label", "description").distinct().orderBy("qid").limit(most)


def cache_key(label: Column, lang: Column) -> Column:
    return F.md5(F.concat(label, F.lit("_"), lang))
