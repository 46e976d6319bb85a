"""Inference rules over triples between IRIs, and the graph's statistics.

Joins are equi-joins on nodes, so hot nodes are left to adaptive skew joins.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import vocab
from tessella.plans.materialize import checkpointed


def _none() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Rule:
    """``find`` gives ``(s, o)`` of the property ``result`` that a graph implies."""

    result: str
    find: Callable[[DataFrame], DataFrame]


def _edges(graph: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return graph.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias(s), F.col("o").alias(o))


def symmetric(prop: str) -> Rule:
    """x p y gives y p x."""
    return Rule(prop, lambda g: _edges(g, prop, "o", "s").select("s", "o").where("s <> o"))


def chain(first: str, second: str, result: str, loops: bool = True) -> Rule:
    """x first y and y second z give x result z."""

    def find(g: DataFrame) -> DataFrame:
        found = _edges(g, first, "s", "y").join(_edges(g, second, "y", "o"), "y")
        return (found if loops else found.where("s <> o")).select("s", "o")

    return Rule(result, find)


def implies(prop: str, result: str) -> Rule:
    return Rule(result, lambda g: _edges(g, prop, "s", "o"))


def from_common_subject(first: str, second: str, result: str) -> Rule:
    """x first y and x second z give y result z."""
    return Rule(result, lambda g: _edges(g, first, "x", "s").join(_edges(g, second, "x", "o"), "x").select("s", "o"))


def standard_rules(namespace: str = vocab.ONTOLOGY) -> dict[str, Rule]:
    """The seven rules in their order."""
    n = namespace
    return {
        "symmetric_enemy": symmetric(n + "enemyOf"),
        "symmetric_ally": symmetric(n + "allyOf"),
        "participant_place": chain(n + "participatedIn", n + "tookPlaceAt", n + "wasAt"),
        "member_of_parent": chain(n + "memberOf", n + "subgroupOf", n + "memberOf"),
        "leader_member": implies(n + "leads", n + "memberOf"),
        "ally_enemy": chain(n + "allyOf", n + "enemyOf", n + "enemyOf", loops=False),
        "leader_place": from_common_subject(n + "leads", n + "wasAt", n + "locatedIn"),
    }


def new_triples(graph: DataFrame, rule: Rule) -> DataFrame:
    """What a rule derives and the graph lacks; only the result's own property is compared."""
    found = rule.find(graph).distinct().join(_edges(graph, rule.result, "s", "o"), ["s", "o"], "left_anti")
    return found.select("s", F.lit(rule.result).alias("p"), "o", F.lit("iri").alias("o_kind"), _none().alias("o_lang"), _none().alias("o_dtype"))


def expand(graph: DataFrame, rules: dict[str, Rule] | None = None, fixpoint: bool = False) -> tuple[DataFrame, list[dict]]:
    """Apply the rules in order, each to what the earlier ones left; once, or until nothing is new.

    Returns the graph and, for each rule applied, its name, added triples and ms.
    """
    stats = []
    while True:
        added = 0
        for name, rule in (rules or standard_rules()).items():
            start = time.monotonic()
            new = checkpointed(new_triples(graph, rule))
            n = new.count()
            stats.append({"rule": name, "added": n, "ms": round(1000 * (time.monotonic() - start), 1)})
            graph, added = (graph.unionByName(new), added + n) if n else (graph, added)
        if not fixpoint or not added:
            return graph, stats


def union_graphs(graph: DataFrame, other: DataFrame | None) -> DataFrame:
    return graph if other is None else graph.unionByName(other).distinct()


def class_histogram(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p") == vocab.RDF_TYPE).groupBy(F.substring_index("o", "#", -1).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def property_histogram(graph: DataFrame, most: int | None = None) -> DataFrame:
    counts = graph.groupBy(F.substring_index("p", "#", -1).alias("property")).agg(F.count(F.lit(1)).alias("n"))
    return counts if most is None else counts.orderBy(F.desc("n"), "property").limit(most)


def graph_stats(graph: DataFrame, namespace: str = vocab.ONTOLOGY) -> DataFrame:
    """Triples, typed entities, their mean out-degree, and the one of most triples (ties: least IRI)."""
    entities = graph.where(F.col("p") == vocab.RDF_TYPE).select("s").distinct()
    out = graph.join(entities, "s", "left_semi").groupBy("s").agg(F.count(F.lit(1)).alias("d"), F.min(F.when(F.col("p") == namespace + "name", F.col("o"))).alias("name"))
    degree = out.agg(F.count(F.lit(1)).alias("total_entities"), F.round(F.avg("d"), 2).alias("avg_degree"), F.min(F.struct((-F.col("d")).alias("d"), "s", "name")).alias("top"))
    total = graph.agg(F.count(F.lit(1)).alias("total_triples"))
    return total.join(degree).select("total_triples", "total_entities", F.coalesce("avg_degree", F.lit(0.0)).alias("avg_degree"), F.col("top.name").alias("most_connected"), F.coalesce(-F.col("top.d"), F.lit(0)).alias("most_connected_degree"))  # one row by one row
