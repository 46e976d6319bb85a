"""Readers, writers, providers, the stream and the whole composition."""

import pytest
from pyspark.sql import functions as F

from tessella import schemas, vocab
from tessella.operators import graph
from tessella.plans import pipeline
from tessella.sources import files, providers
from tessella.streaming import ingest


def graph_of(spark):
    rows = [("http://x/a", "http://x/p", "http://x/b", "iri", None, None), ("http://x/a", "http://x/p", 'say "é"\n\\n', "literal", "fr", None), ("http://x/a", "http://x/q", "0.9", "literal", None, vocab.XSD_FLOAT), (vocab.DATA + "a", vocab.ONTOLOGY + "name", "x ; y", "literal", None, None)]
    return spark.createDataFrame(rows, schemas.TRIPLE)


def test_triples_round_trip(spark, tmp_path):
    g = graph_of(spark)
    want = sorted(map(tuple, g.collect()), key=str)
    files.write_ntriples(g, str(tmp_path / "g.nt"))
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g.nt")).collect()), key=str) == want
    files.write_turtle(g, str(tmp_path / "g.ttl"))
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g.ttl")).collect()), key=str) == want
    files.write_graph(g, str(tmp_path / "g.parquet"))
    assert spark.read.parquet(str(tmp_path / "g.parquet")).count() == 4


def test_jsonl_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    assert files.read_jsonl(spark, path, schemas.RAW_PAGE, missing_ok=True).count() == 0
    rows = spark.createDataFrame([("u1", "é", None), ("u2", "b", "y")], schemas.RAW_PAGE)
    files.append_new(rows.limit(1), path, schemas.RAW_PAGE)
    files.append_new(rows, path, schemas.RAW_PAGE)
    files.append_new(rows, path, schemas.RAW_PAGE)
    assert sorted(r.url for r in files.read_jsonl(spark, path, schemas.RAW_PAGE).collect()) == ["u1", "u2"]
    files.write_json_object(spark, {"a": "é"}, str(tmp_path / "o"))
    assert "é" in "".join(r.value for r in spark.read.text(str(tmp_path / "o")).collect())


def test_splits_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("a", "r", 'b"c', "train"), ("d", "r", "e", "test")], "head string, relation string, tail string, split string")
    assert files.write_dataset(data, str(tmp_path)) == {"train": 1, "valid": 0, "test": 1}
    assert files.read_split(spark, str(tmp_path / "train")).first().tail == 'b"c'
    assert files.read_vectors(spark, str(tmp_path / "none")) is None


def test_providers(spark):
    def complete(prompt):
        if prompt.startswith("limited"):
            raise providers.RateLimited
        if prompt.startswith("broken"):
            raise OSError
        return [{"text": "good" if "could not" in prompt else "bad"}]

    asked = spark.createDataFrame([("hello",), ("limited",), ("broken",)], "prompt string")
    got = {r.prompt: r.raw for r in providers.completions(asked, complete, lambda raw: raw == "good").collect()}
    assert got == {"hello": "good", "limited": "", "broken": ""}
    pool = providers.ModelPool(["m1", "m2"])
    assert pool.choose(1, 0.0) == "m2"
    pool.quarantine("m2", 0.0)
    assert pool.choose(1, 1.0) == "m1" and pool.choose(1, 301.0) == "m2"
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert [r.url for r in providers.fetched(urls, lambda u: (200 if u == "a" else 404, u)).collect()] == ["a"]
    cache = spark.createDataFrame([("N", "fr", ["q"])], "label string, lang string, found array<string>")
    hit, ask = providers.cached_candidates(spark.createDataFrame([("N",)], "name string"), cache)
    assert hit.count() == 1 and [r.lang for r in ask.collect()] == ["en"]


def test_stream_takes_files_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([("u1", "t", "x")], schemas.RAW_PAGE)
    for _ in range(2):
        files.write_jsonl(rows, source, "append")
        ingest.ingest_jsonl(spark, source, schemas.RAW_PAGE, out, mark, lambda d: d.withColumn("text", F.upper("text"))).awaitTermination()
    assert [r.text for r in spark.read.parquet(out).collect()] == ["X", "X"]


def test_pipeline(spark):
    long = "Some words of a page that goes on and on about things. " * 8
    pages = spark.createDataFrame([(1, "u1", "Siège de Terra", long + "one"), (2, "u2", "Monde Rouge", "Red dunes lie under quiet skies while slow caravans cross them at night. " * 6), (3, "u3", "Siège de Terra", "short")], schemas.PAGE)
    groups = spark.createDataFrame([(1, [("Terra", ["Terra Sacrée"])])], "ord long, synonyms array<struct<canonical: string, synonyms: array<string>>>")
    said = '[{"source": "Siège de Terra", "relation": "S_EST_DEROULE_A", "target": "Monde Rouge"}, {"source": "Monde Rouge", "relation": "EST_SITUE_A", "target": "Terra Sacrée"}, {"source": "Siège de Terra", "relation": "EST_ENNEMI_DE", "target": "Monde Rouge"}]'
    answers = spark.createDataFrame([(u, 0, said) for u in ("u1", "u2", "u3", "u4", "u5")], "url string, chunk int, raw string")
    built, stats = pipeline.build(pages, groups, answers)
    found = {(r.s.split("#")[-1], r.p.split("#")[-1], r.o.split("#")[-1]) for r in built.collect()}
    assert ("event_siege_de_terra", "tookPlaceAt", "location_monde_rouge") in found
    assert ("location_monde_rouge", "enemyOf", "event_siege_de_terra") in found
    assert not any(s.startswith("concept_terra") for s, _, _ in found)
    assert len(stats) == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ord long, text string, type string, description string, aliases array<string>")
    links = spark.createDataFrame([], "source string, relation string, target string")
    assert graph.build_graph(none, links).count() == 0
    assert graph.entity_mapping(none).count() == 0


@pytest.mark.parametrize("write, suffix", [(files.write_ntriples, ".nt"), (files.write_turtle, ".ttl")])
def test_whole_graph_is_written_and_read(spark, sf, write, suffix):
    from tessella import catalog

    got = catalog._described(catalog._reread(spark, sf, write, suffix)).collect()
    want = catalog._described(catalog._whole(spark, sf)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {"participatedIn", "tookPlaceAt", "controls", "memberOf"} <= {r.property for r in got}
