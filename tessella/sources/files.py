"""Readers and writers: JSON lines, N-Triples, Turtle, tab-separated triples, Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas, vocab


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Lines of JSON objects; blank lines are skipped; a missing file may count as empty."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8, unescaped; fields that are null are written, so that readers find each."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, schema: str, key: str = "url", work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append ``work`` of the rows whose key ``path`` doesn't hold: a run that stopped goes on."""
    done = read_jsonl(df.sparkSession, path, schema, missing_ok=True).select(key).distinct()
    todo = df.join(done, key, "left_anti")
    write_jsonl(work(todo) if work else todo, path, "append")


def write_json_object(spark: SparkSession, value: dict | list, path: str) -> None:
    """One small JSON document."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def report(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A small table as dictionaries; a larger one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    return [r.asDict(recursive=True) for r in rows]


def _escaped(c: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _unescaped(c: Column) -> Column:
    marks = (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\"))
    for written, plain in marks:
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def write_ntriples(triples: DataFrame, path: str) -> None:
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail))
    line = F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" ."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


_TERM = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A set of triples; comments, blank lines and lines that aren't triples are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(_TERM))
    part = lambda i: F.regexp_extract("value", _TERM, i)
    is_iri = F.col("value").rlike(r"^\s*<[^>]*>\s+<[^>]*>\s+<")
    return lines.select(
        part(1).alias("s"),
        part(2).alias("p"),
        F.when(is_iri, part(3)).otherwise(_unescaped(part(4))).alias("o"),
        F.when(is_iri, "iri").otherwise("literal").alias("o_kind"),
        F.nullif(part(5), F.lit("")).alias("o_lang"),
        F.nullif(part(6), F.lit("")).alias("o_dtype"),
    ).distinct()


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Turtle, one subject a statement: its predicate-object lists are gathered in a row."""
    prefixes = {"": vocab.ONTOLOGY, "d": vocab.DATA} if prefixes is None else prefixes

    def short(c: str) -> Column:
        out = F
        for name, iri in prefixes.items():
            out = out.when(F.col(c).rlike("^\\Q" + iri + "\\E[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit(name + ":"), F.substring(F.col(c), F.lit(len(iri) + 1), F.length(c))))
        return out.otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "iri", short("o")).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail))
    rows = triples.select("s", short("s").alias("subject"), F.concat(short("p"), F.lit(" "), obj).alias("po"))
    statement = F.concat("subject", F.lit(" "), F.array_join(F.array_sort(F.collect_list("po")), " ;\n    "), F.lit(" ."))
    head = "".join(f"@prefix {n}: <{iri}> .\n" for n, iri in prefixes.items())
    body = rows.groupBy("s", "subject").agg(statement.alias("value")).select("value", F.lit(1).alias("k"))
    first = triples.sparkSession.createDataFrame([(head, 0)], "value string, k int")
    first.unionByName(body).select("value").write.mode("overwrite").text(path)


_PREFIX = r"(?m)^\s*@prefix\s+([A-Za-z0-9_-]*):\s*<([^>]*)>\s*\.\s*$"
_POBJ = r'^\s*(\S+)\s+(?:"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?|(\S+))\s*$'


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The Turtle that :func:`write_turtle` writes: a subject's statement is a block of lines.

    Reads ``@prefix`` lines, ``subject predicate object ;`` lists and ``a``;
    not blank nodes, collections or object lists.
    """
    prefix_lines = spark.read.text(path).where(F.col("value").rlike(_PREFIX))
    # A file's vocabulary: names that its author wrote by hand.
    prefixes = {r.n: r.iri for r in prefix_lines.select(F.regexp_extract("value", _PREFIX, 1).alias("n"), F.regexp_extract("value", _PREFIX, 2).alias("iri")).distinct().collect()}
    blocks = spark.read.option("lineSep", " .\n").text(path)
    body = F.regexp_replace(F.regexp_replace("value", _PREFIX, ""), r"^\s*(@prefix[^\n]*\n?\s*)*", "")
    split = blocks.select(body.alias("b")).where("b rlike '\\\\S'").select(F.regexp_extract("b", r"^\s*(\S+)\s", 1).alias("s"), F.regexp_replace("b", r"^\s*\S+\s+", "").alias("rest"))
    rows = split.where("s <> ''").select("s", F.explode(F.split("rest", r" ;\n\s*")).alias("po"))

    def full(c: Column) -> Column:
        out = F.when(c == "a", vocab.RDF_TYPE).when(c.startswith("<"), F.regexp_replace(c, "^<|>$", ""))
        for name, iri in prefixes.items():
            out = out.when(c.startswith(name + ":"), F.concat(F.lit(iri), F.substring(c, F.lit(len(name) + 2), F.length(c))))
        return out.otherwise(c)

    po = lambda i: F.regexp_extract("po", _POBJ, i)
    is_iri = po(5) != ""
    return rows.select(
        full(F.col("s")).alias("s"),
        full(po(1)).alias("p"),
        F.when(is_iri, full(po(5))).otherwise(_unescaped(po(2))).alias("o"),
        F.when(is_iri, "iri").otherwise("literal").alias("o_kind"),
        F.nullif(po(3), F.lit("")).alias("o_lang"),
        F.nullif(po(4), F.lit("")).alias("o_dtype"),
    ).distinct()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return read_ntriples(spark, path) if path.rstrip("/").endswith(".nt") else read_turtle(spark, path)


def write_graph(triples: DataFrame, path: str) -> None:
    """Parquet by property, so that a rule reads its own properties only."""
    triples.withColumn("property", F.regexp_replace(F.substring_index("p", "#", -1), "[^A-Za-z0-9_-]", "_")).write.mode("overwrite").partitionBy("property").parquet(path)


def write_split(dataset: DataFrame, path: str) -> None:
    dataset.select("head", "relation", "tail").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.KGE_TRIPLE).option("sep", "\t").option("quote", "").csv(path)


def write_dataset(dataset: DataFrame, folder: str) -> dict[str, int]:
    """``dataset(head, relation, tail, split)`` as three files of triples; their sizes."""
    for name in ("train", "valid", "test"):
        write_split(dataset.where(F.col("split") == name), f"{folder}/{name}")
    counts = {r["split"]: r["n"] for r in dataset.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: counts.get(name, 0) for name in ("train", "valid", "test")}


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """Vectors, or None where a run left none."""
    return spark.read.schema(schemas.KGE_VECTOR).parquet(path) if exists(spark, path) else None
