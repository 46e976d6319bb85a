"""Questions over the graph, in batches, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.fuzzy import link_score
from tessella.operators import kge
from tessella.plans.blocks import in_blocks


def link_entities(questions: DataFrame, mapping: DataFrame, least: float = 65.0, most: int = 3) -> DataFrame:
    """``questions(id, name)``, a bounded set -> ``(id, status, rank, key, eid, score)``.

    An exact key is CONFIRMED.  Else the best ``most`` keys by the weighted
    ratio that reach ``least`` are AMBIGUOUS, one for each entity; without any
    the row is FAILED.
    """
    asked = questions.select("id", F.lower(T.strip(F.col("name"))).alias("q"))
    exact = asked.join(mapping, asked.q == mapping.key).select("id", F.lit("CONFIRMED").alias("status"), F.lit(1).alias("rank"), "key", "eid", F.lit(100.0).alias("score"))
    rest = asked.join(exact, "id", "left_anti")
    scored = in_blocks(rest, ["id"], lambda block: mapping.join(block).withColumn("score", link_score(F.col("q"), F.col("key"), least)).where(F.col("score") >= least))
    top = scored.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "key"))).where(F.col("place") <= most)
    each = top.withColumn("n", F.row_number().over(W.partitionBy("id", "eid").orderBy("place"))).where("n = 1")
    near = each.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("place"))).select("id", F.lit("AMBIGUOUS").alias("status"), "rank", "key", "eid", "score")
    found = exact.unionByName(near)
    none = asked.join(found, "id", "left_anti").select("id", F.lit("FAILED").alias("status"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("eid"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(none)


def relation_tails(questions: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10, shown: int = 5) -> DataFrame:
    """``questions(id, entity, relation)`` by label -> ``(id, status, tails)``.

    The best ``k`` tails without the entity itself, the first ``shown`` of them.
    """
    h, r = entities.select(F.col("id").alias("h"), F.col("label").alias("entity")), relations.select(F.col("id").alias("r"), F.col("label").alias("relation"))
    asked = questions.join(h, "entity", "left").join(r, "relation", "left")
    found = kge.predict_tails(asked.where("h is not null and r is not null").select("h", "r"), entities, relations, k).where("h <> t")
    lists = found.groupBy("h", "r").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "tail_label"))), 1, shown).alias("l"))
    status = F.when(F.col("entity").isNull() | F.col("h").isNull(), "ENTITY_NOT_FOUND").when(F.col("r").isNull(), "TYPE_MISMATCH").when(F.col("l").isNull(), "NULL_PREDICTION").otherwise("SUCCESS")
    tails = F.coalesce(F.transform("l", lambda x: x["tail_label"]), F.array().cast("array<string>"))
    return asked.join(lists, ["h", "r"], "left").select("id", status.alias("status"), tails.alias("tails"))


def answer(questions: DataFrame, mapping: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``questions(id, name, relation)`` -> link, then predict: the tools' order of a rule-based planner."""
    best = link_entities(questions, mapping).where("rank = 1").select("id", F.col("status").alias("link_status"), F.col("eid").alias("entity"))
    asked = questions.select("id", "relation").join(best, "id", "left")
    return asked.select("id", "link_status").join(relation_tails(asked.select("id", "entity", "relation"), entities, relations), "id").withColumn("tools", F.array(F.lit("get_entity_id"), F.lit("predict_relation_tail")))


def tool_score(observed: Column, expected: Column) -> Column:
    """The share of expected names found in order; with none expected 1 if none was called."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"))

    def step(acc: Column, name: Column) -> Column:
        at = F.array_position(F.slice(observed, acc["at"] + 1, F.greatest(F.size(observed), F.lit(1))), name).cast("int")
        return F.when(at > 0, F.struct((acc["at"] + at).alias("at"), (acc["hits"] + 1).alias("hits"))).otherwise(acc)

    hits = F.aggregate(expected, zero, step, lambda a: a["hits"].cast("double"))
    return F.when(F.size(expected) == 0, F.when(F.size(observed) == 0, 1.0).otherwise(0.0)).otherwise(hits / F.size(expected))


def keyword_score(response: Column, keywords: Column) -> Column:
    """The share of keywords that the response holds, regardless of case; 1 without keywords."""
    said = F.lower(F.coalesce(response, F.lit("")))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: F.contains(said, F.lower(k)))) / F.size(keywords))


def forbidden_score(response: Column, keywords: Column) -> Column:
    """The share of forbidden words that the response lacks."""
    said = F.lower(F.coalesce(response, F.lit("")))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: ~F.contains(said, F.lower(k)))) / F.size(keywords))


def evaluate(runs: DataFrame, least_keywords: float = 0.6) -> DataFrame:
    """``runs(case_id, observed, response, latency_s, errors, expected_tools, expected_keywords, forbidden_keywords)`` -> scores and verdict."""
    rows = runs.withColumns(
        {
            "tool_call_score": tool_score(F.col("observed"), F.col("expected_tools")),
            "keyword_score": keyword_score(F.col("response"), F.col("expected_keywords")),
            "forbidden_keyword_score": forbidden_score(F.col("response"), F.col("forbidden_keywords")),
        }
    )
    passed = (F.col("tool_call_score") >= 1) & (F.col("keyword_score") >= least_keywords) & (F.col("forbidden_keyword_score") >= 1) & (F.size("errors") == 0)
    return rows.select("case_id", passed.alias("passed"), "tool_call_score", "keyword_score", "forbidden_keyword_score", "latency_s", "errors")


def summarize(results: DataFrame) -> DataFrame:
    names = ("tool_call_score", "keyword_score", "forbidden_keyword_score", "latency_s")
    return results.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("passed").cast("long")).alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in names])


def select_cases(cases: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return cases if not ids else cases.where(F.col("id").isin(ids))


def collect_stream(events: DataFrame) -> DataFrame:
    """``events(case_id, seq, type, name, text)`` -> the calls' names in order and the messages joined."""
    calls = F.array_sort(F.collect_list(F.when(F.col("type") == "function_call", F.struct("seq", "name"))))
    texts = F.array_sort(F.collect_list(F.when(F.col("type") == "message", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    return events.groupBy("case_id").agg(F.transform(calls, lambda x: x["name"]).alias("observed"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("response"))


def shown_output(output: Column, lines: int = 25) -> Column:
    """The first lines of a tool's output."""
    return F.array_join(F.slice(F.split(output, "\n"), 1, lines), "\n")


def shown_call(name: Column, arguments: Column) -> Column:
    return F.concat(name, F.lit("("), arguments, F.lit(")"))


def flatten_items(messages: list[dict]) -> list[dict]:
    """Chat messages as output items: ``message``, ``function_call``, ``function_call_output``."""
    items: list[dict] = []
    for m in messages:
        content = m.get("content")
        text = "".join(c.get("text", "") if isinstance(c, dict) else str(c) for c in content) if isinstance(content, list) else str(content or "")
        if m.get("role") == "tool":
            items.append({"type": "function_call_output", "call_id": m.get("tool_call_id"), "output": text})
            continue
        for call in m.get("tool_calls") or []:
            function = call.get("function") or call
            items.append({"type": "function_call", "call_id": call.get("id"), "name": function.get("name"), "arguments": function.get("arguments") or function.get("args") or {}})
        if text:
            items.append({"type": "message", "role": m.get("role", "assistant"), "text": text})
    return items


def to_messages(items: list[dict]) -> list[dict]:
    """The reverse of :func:`flatten_items`."""
    out: list[dict] = []
    for x in items:
        kind = x.get("type", "message")
        if kind == "message":
            out.append({"role": x.get("role", "user"), "content": x.get("text", x.get("content", ""))})
        elif kind == "function_call":
            out.append({"role": "assistant", "content": "", "tool_calls": [{"id": x.get("call_id"), "function": {"name": x.get("name"), "arguments": x.get("arguments") or {}}}]})
        elif kind == "function_call_output":
            out.append({"role": "tool", "tool_call_id": x.get("call_id"), "content": x.get("output", "")})
    return out


def stream_items(messages: Iterator[dict]) -> Iterator[dict]:
    """Items one by one, as messages arrive."""
    for m in messages:
        yield from flatten_items([m])
