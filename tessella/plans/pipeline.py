"""From pages to an expanded graph, as one composition of lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import cleaning, entities, graph, ner, relations, rules
from tessella.plans.materialize import checkpointed


def merged_entities(pages: DataFrame, groups: DataFrame, class_answers: DataFrame | None = None) -> DataFrame:
    titles = ner.title_entities(pages)
    if class_answers is not None:
        titles = ner.fill_types(titles, ner.answered_types(class_answers))
    return entities.merge_entities(titles, groups)


def merged_relations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """``answers(url, chunk, raw)`` and entities -> merged, confirmed relations."""
    found = relations.doc_relations(answers)
    mentions = found.select(F.struct("url", "chunk", "pos").alias("ord"), "source", "relation", "target", "url")
    return relations.confirm(relations.merge_relations(mentions), relations.known_names(known))


def knowledge_graph(known: DataFrame, merged: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Canonical relations and entities, filtered by support, as an expanded graph.

    ``known(text, type, source_url, aliases)`` carries its URL as a list and an
    empty description; ``merged`` is of :func:`merged_relations`.
    """
    listed = checkpointed(known.select(F.col("text").alias("ord"), "text", "type", F.lit("").alias("description"), F.filter(F.array("source_url"), lambda u: u != "").alias("source_urls"), "aliases"))
    names = merged.select(F.col("source").alias("name")).union(merged.select("target")).distinct()
    canonical = checkpointed(relations.canonicalize(merged, entities.resolve_names(names, entities.canonical_map(listed))))
    used = relations.project_entities(canonical, listed)
    kept, links = relations.filter_quality(used, canonical)
    return rules.expand(checkpointed(graph.build_graph(kept.withColumn("ord", F.col("text")), links)))


def build(raw_pages: DataFrame, groups: DataFrame, relation_answers: DataFrame, class_answers: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    pages = checkpointed(cleaning.clean_corpus(raw_pages))
    known = checkpointed(merged_entities(pages, groups, class_answers))
    return knowledge_graph(known, checkpointed(merged_relations(relation_answers, known)))
