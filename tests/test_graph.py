"""Entities, relations, graph, rules, datasets and questions on small cases."""

import difflib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import vocab
from tessella.functions import fuzzy
from tessella.operators import entities, graph, kge, ner, qa, relations, rules, sampling

N, D = vocab.ONTOLOGY, vocab.DATA


def triples(spark, rows):
    return spark.createDataFrame([(D + s, N + p, D + o, "iri", None, None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_lang string, o_dtype string")


def short(df):
    return {tuple(x.split("#")[-1] for x in (r.s, r.p, r.o)) for r in df.collect()}


def test_synonyms(spark):
    names = spark.createDataFrame([("ab",), ("abc",), ("a (b)",)], "n string")
    assert [r.n for r in names.where(entities.valid_synonym(F.col("n"))).collect()] == ["abc"]
    groups = spark.createDataFrame([(1, [("X", ["foo"])]), (2, [("Y", ["Foo"])])], "ord long, synonyms array<struct<canonical: string, synonyms: array<string>>>")
    flat = entities.flat_synonyms(groups)
    assert {r.key: r.canonical for r in entities.reverse_map(flat).collect()}["foo"] == "Y"
    rows = spark.createDataFrame([(1, "foo", "EVENT", ""), (2, "FOO", "LOCATION", "u"), (3, "zed", "EVENT", "v"), (4, "zed", "LOCATION", "w")], "ord long, text string, type string, source_url string")
    got = {r.text: (r.type, r.source_url, r.aliases) for r in entities.merge_entities(rows, groups).collect()}
    assert got == {"Y": ("EVENT", "u", ["Foo"]), "zed": ("EVENT", "v", []), "X": ("CONCEPT", "", ["foo"])}


def test_class_answers(spark):
    raw = '[{"name":"A","type":"event"},{"name":"B","type":"zzz"},{"name":"A ","type":"location"}]'
    answers = spark.createDataFrame([(0, raw), (1, "nothing"), (2, "<json_answer>[broken</json_answer>")], "batch int, raw string")
    assert [tuple(r) for r in ner.answered_types(answers).collect()] == [("a", "LOCATION")]


def test_relations(spark):
    rows = spark.createDataFrame([("a", " dirige ", "b"), ("a", "AIME", "b"), ("a", "DIRIGE", "  ")], "source string, relation string, target string")
    assert [tuple(r) for r in relations.valid_relations(rows).collect()] == [("a", "DIRIGE", "b")]
    mentions = spark.createDataFrame([(1, "A", "R", "B", "u1"), (2, "a", "R", "b", "u2"), (3, "A", "R", "B", "u1"), (4, "A", "R", "B", "")], "ord long, source string, relation string, target string, url string")
    assert relations.merge_relations(mentions).select("source", "relation", "target", "source_urls", "frequency").first() == ("A", "R", "B", ["u1", "u2"], 4)
    loop = spark.createDataFrame([("A", "R", "A", ["u"])], "source string, relation string, target string, source_urls array<string>")
    assert tuple(relations.name_support(loop).first()) == ("A", 2, 1)
    support = spark.createDataFrame([("CHARACTER", 3, 2), ("CONCEPT", 9, 5), ("OTHER", 5, 4)], "type string, mentions long, sources long")
    assert [r.ok for r in support.select(relations.enough_support().alias("ok")).collect()] == [True, False, True]


def test_answer_forms(spark):
    body = '[{"source":"a","relation":"DIRIGE","target":"b"}]'
    raws = [f"x <json_answer>{body}</json_answer>", f"```json\n{body}\n```", f"see {body}.", "no"]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(relations.parse_relations(F.col("raw")).alias("r")).collect()
    assert [bool(r.r) for r in got] == [True, True, True, False]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcdé-", min_size=1, max_size=9), min_size=1, max_size=8, unique=True), st.lists(st.text(alphabet="abcdé-", min_size=1, max_size=9), min_size=1, max_size=8, unique=True))
def test_fuzzy_matches_equal_difflib(spark, queries, keys):
    got = {r.q: r.key for r in entities.fuzzy_matches(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(k,) for k in keys], "key string"), 0.7).collect()}
    want = {}
    for q in queries:
        scored = [(difflib.SequenceMatcher(None, k, q).ratio(), k) for k in keys]
        if max(scored)[0] >= 0.7:
            want[q] = max(scored)[1]
    assert got == want


def test_resolution(spark):
    known = spark.createDataFrame([("1", "abcdefgx", []), ("2", "abcdefgy", []), ("3", "abcdefgz", ["other one"]), ("4", "short", [])], "ord string, text string, aliases array<string>")
    names = spark.createDataFrame([("abcdefgh",), ("Other One ",), ("shorx",), (" new ",)], "name string")
    got = {r.name: r.canonical for r in entities.resolve_names(names, entities.canonical_map(known)).collect()}
    assert got == {"abcdefgh": "abcdefgz", "Other One ": "abcdefgz", "shorx": "shorx", " new ": "new"}


def test_weighted_ratio():
    assert fuzzy.indel_ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert fuzzy.weighted_ratio("horus", "horus") == 100
    assert fuzzy.weighted_ratio("horus lupercal", "lupercal horus") == 95
    assert fuzzy.weighted_ratio("lupercal", "horus lupercal of cthonia") == 90
    assert fuzzy.weighted_ratio("abc", "xyz") == 0


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab c", max_size=20), st.text(alphabet="ab c", max_size=20))
def test_best_possible(a, b):
    assert fuzzy.weighted_ratio(a, b) <= fuzzy.best_possible(a, b) + 1e-9


def test_ends(spark):
    known = spark.createDataFrame([(1, "Horus", "CHARACTER"), (2, "Horus Lupercal", "CHARACTER"), (3, "X", "CHARACTER")], "ord long, text string, type string")
    names = spark.createDataFrame([("lupercal",), ("HORUS",), ("no",), ("ax",), ("zzz",)], "name string")
    got = {r.name: r.eid for r in graph.resolve_ends(names, known).collect()}
    assert got == {"lupercal": "character_horus_lupercal", "HORUS": "character_horus", "ax": "character_x"}


def test_ends_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    text = lambda: "".join(rng.choices("abC é", k=rng.randint(0, 7)))
    known = [(i, text(), "ARTIFACT") for i in range(60)]
    names = [text() for _ in range(120)] + [k + "x" for _, k, _ in known]
    got = {r.name: r.eid for r in graph.resolve_ends(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame(known, "ord long, text string, type string")).collect()}
    rows = {n: k for k, n in spark.createDataFrame(known, "ord long, text string, type string").select(graph.entity_id(F.col("text"), F.col("type")), "ord").collect()}
    want, last, first = {}, {}, {}
    for i, k, _ in known:
        last[k.lower()] = i
        first.setdefault(k.lower(), i)
    for n in names:
        q = n.lower()
        held = [first[k] for k in first if k and q and (k in q or q in k)]
        if q and q in last:
            want[n] = rows[last[q]]
        elif held:
            want[n] = rows[last[known[min(held)][1].lower()]]
    assert got == want and len(want) > 50


def test_ends_of_names_that_share_their_words(spark):
    """4,000 names of one pattern: joined on what all share, they made hundreds of millions of pairs."""
    import time

    known = spark.range(4000).select(F.col("id").alias("ord"), F.format_string("organization of number %09d", "id").alias("text"), F.lit("FACTION").alias("type"))
    names = known.select(F.concat("text", F.lit(" and others")).alias("name")).union(known.select(F.right("text", F.lit(9))))
    start = time.monotonic()
    got = graph.resolve_ends(names, known).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("eid").alias("e")).first()
    assert tuple(got) == (8000, 4000) and time.monotonic() - start < 30


def test_candidates(spark):
    rows = spark.createDataFrame([("u", "Horus", "Q1", 1, "horus", "of the Imperium"), ("v", "Horus", "Q2", 1, "Horus x", "fictif"), ("w", "Horus", "Q3", 1, "Horus", "a town")], "uri string, name string, qid string, pos int, cand_label string, description string")
    assert [(r.uri, r.score) for r in graph.best_candidates(rows).collect()] == [("u", 0.9)]


def test_rules(spark):
    one = rules.standard_rules()
    assert short(rules.new_triples(triples(spark, [("a", "enemyOf", "b"), ("c", "enemyOf", "c")]), one["symmetric_enemy"])) == {("b", "enemyOf", "a")}
    assert short(rules.new_triples(triples(spark, [("x", "memberOf", "s"), ("s", "subgroupOf", "p"), ("p", "subgroupOf", "q")]), one["member_of_parent"])) == {("x", "memberOf", "p")}
    assert short(rules.new_triples(triples(spark, [("x", "allyOf", "y"), ("y", "enemyOf", "x"), ("y", "enemyOf", "z")]), one["ally_enemy"])) == {("x", "enemyOf", "z")}


def test_rule_driver(spark):
    base = triples(spark, [("l", "leads", "o"), ("l", "participatedIn", "e"), ("e", "tookPlaceAt", "p")])
    got, stats = rules.expand(base)
    assert short(got) - short(base) == {("l", "wasAt", "p"), ("l", "memberOf", "o"), ("o", "locatedIn", "p")}
    assert sum(s["added"] for s in stats) == 3 and len(stats) == 7


def test_splits(spark):
    rows = [(f"h{i}", f"r{n}", "t") for n in (1, 2, 3, 10, 20) for i in range(n)]
    got = sampling.stratified_split(spark.createDataFrame(rows, "head string, relation string, tail string"))
    counts = {(r.relation, r.split): r["count"] for r in got.groupBy("relation", "split").count().collect()}
    for n, want in {1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 10: (8, 1, 1), 20: (16, 2, 2)}.items():
        assert tuple(counts.get((f"r{n}", s), 0) for s in ("train", "valid", "test")) == want
    assert sampling.id_map(got.select(F.col("head").alias("label"))).agg(F.max("id")).first()[0] == 19


def test_subset_keeps_each_quota(spark):
    """Shares under one triple count as one: 9 + 1 + 1 of a subset of 10, none cut again."""
    rows = [(f"h{i}", r, "t") for r, n in (("big", 98), ("a", 1), ("b", 1)) for i in range(n)]
    data = spark.createDataFrame(rows, "head string, relation string, tail string")
    counts = {r.relation: r["count"] for r in sampling.stratified_subset(data, 10).groupBy("relation").count().collect()}
    assert counts == {"big": 9, "a": 1, "b": 1}
    assert sampling.stratified_subset(data, 100).count() == 100


def test_training(spark):
    rows = [(f"e{i}", "next", f"e{(i + 1) % 12}", "train") for i in range(12)] + [(f"e{i}", "same", f"e{i}", "train") for i in range(12)]
    data = spark.createDataFrame(rows, "head string, relation string, tail string, split string")
    for config in (kge.Config(dim=16, epochs=60, rate=0.05), kge.Config("rotate", dim=16, epochs=60, rate=0.05, margin=3.0, negatives=4)):
        e, r, facts = kge.train(data, config)
        assert facts["losses"][-1] < facts["losses"][0]
        ids = sampling.numbered(data, e.select("id", "label"), r.select("id", "label"))
        metrics = kge.ranking_metrics(kge.tail_ranks(ids, ids, e, r)).first()
        heads = kge.ranking_metrics(kge.head_ranks(ids, ids, e, r)).first()
        assert metrics.mrr > 0.4 and heads.mrr > 0.4


def test_training_holds_no_python_rows(spark, monkeypatch):
    """Triples and vectors pass the driver as arrays: a row object or list for each takes many times their size."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(f"e{i}", "next", f"e{(i + 1) % 50}", "train") for i in range(50)]
    data = spark.createDataFrame(rows, "head string, relation string, tail string, split string")
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected") if {"h", "head"} & set(self.columns) else collect(self))
    for model, parts in (("transe", 0), ("rotate", 4)):
        e, _, facts = kge.train(data, kge.Config(model, dim=4, epochs=2))
        assert facts["n_entities"] == 50
        assert [(r.id, r.label, len(r.re), len(r.im)) for r in e.orderBy("id").collect()] == [(i, x, 4, parts) for i, x in enumerate(sorted(r[0] for r in rows))]


@pytest.mark.parametrize("model", ["transe", "rotate"])
def test_training_in_parts(spark, model):
    """Any number of triples is trained: tasks hold bounded parts of them, and Spark's partitions don't change the vectors."""
    rows = [(f"e{i}", "next", f"e{(i + 1) % 90}", "train") for i in range(90)] + [(f"e{i}", "of", f"hub{i % 3}", "train") for i in range(90)]
    data = spark.createDataFrame(rows, "head string, relation string, tail string, split string")
    config = kge.Config(model, dim=8, epochs=6, rate=0.05, batch=16, margin=3.0, negatives=4 if model == "rotate" else 1, part_floats=400)
    got = []
    for n in (4, 3):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            e, r, facts = kge.train(data, config)
            got.append([[tuple(x) for x in v.orderBy("id").collect()] for v in (e, r)])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and [len(x) for x in got[0]] == [93, 2]
    assert facts["parts"] == (8 if model == "rotate" else 4) and len(facts["losses"]) == 6 and facts["losses"][-1] < facts["losses"][0]


def test_a_head_of_most_triples_is_spread(spark):
    triples = spark.range(50_000).selectExpr("if(id % 10 = 0, id, -1L) h", "0L r", "id t")
    sizes = {x.part: x["count"] for x in kge._dealt(triples, 8).groupBy("part").count().collect()}
    assert sum(sizes.values()) == 50_000 and len(sizes) > 1 and max(sizes.values()) < 30_000


def test_counts_of_nearer_tails_equal_brute_force():
    """Boxes that are wholly nearer or farther, groups of many test triples, ties, and distances within the error of single precision."""
    rng = np.random.default_rng(1)
    for parts, scale in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 1e-3), (2, 50)):
        rows = lambda m: rng.integers(-1, 2, (m, 8)) * 1.0 if not scale else (rng.normal(size=(m, 8)) * scale).astype(np.float32).astype(float)  # noqa: E731,B023
        tails, asked = ([rows(m) for _ in range(parts)] for m in (2000, 70))
        tails[0][:500] = tails[0][0]
        tails[-1][500:600] = tails[-1][600:700] * (1 + 1e-9)
        group = np.sort(np.r_[np.arange(70), np.full(40, 7), rng.integers(0, 70, 60)])
        own = rng.integers(0, 2000, len(group))
        true = kge._far([a[group] for a in asked], [x[own] for x in tails])
        true = true[np.lexsort((true, group))]
        ask = kge._Asked(asked, group, true, group, own)
        found = sum(ask.counted([x[j : j + 500] for x in tails]) for j in range(0, 2000, 500))
        far = kge._far([a[group][:, None] for a in asked], [x[None] for x in tails])
        assert (found == np.stack([(far < true[:, None]).sum(axis=1), (far == true[:, None]).sum(axis=1)])).all()
        known = kge._far([a[group] for a in asked], [x[own] for x in tails])
        assert (ask.known(np.arange(2000), tails) == np.array([[(known[group == g] < x).sum(), (known[group == g] == x).sum()] for g, x in zip(group, true)]).T).all()


def test_tails_without_self(spark):
    e = spark.createDataFrame([(i, f"e{i}", [float(i)], []) for i in range(12)], "id int, label string, re array<float>, im array<float>")
    r = spark.createDataFrame([(0, "r", [0.0], [])], "id int, label string, re array<float>, im array<float>")
    asked = spark.createDataFrame([(1, "e0", "r"), (2, "no", "r"), (3, "e1", "none")], "id int, entity string, relation string")
    got = {x.id: (x.status, x.tails) for x in qa.relation_tails(asked, e, r).collect()}
    assert got == {1: ("SUCCESS", ["e1", "e2", "e3", "e4", "e5"]), 2: ("ENTITY_NOT_FOUND", []), 3: ("TYPE_MISMATCH", [])}


def test_links(spark):
    mapping = spark.createDataFrame([("horus", "c_horus"), ("horus lupercal", "c_horus"), ("terra", "l_terra")], "key string, eid string")
    got = {(r.id, r.status, r.eid) for r in qa.link_entities(spark.createDataFrame([(1, " Terra "), (2, "horas"), (3, "qqqq")], "id int, name string"), mapping).collect()}
    assert got == {(1, "CONFIRMED", "l_terra"), (2, "AMBIGUOUS", "c_horus"), (3, "FAILED", None)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=5), st.lists(st.sampled_from("abc"), max_size=4))
def test_tool_score(spark, observed, expected):
    at = hits = 0
    for name in expected:
        if name in observed[at:]:
            at = observed.index(name, at) + 1
            hits += 1
    want = hits / len(expected) if expected else float(not observed)
    row = spark.createDataFrame([(observed, expected)], "o array<string>, e array<string>")
    assert row.select(qa.tool_score(F.col("o"), F.col("e"))).first()[0] == pytest.approx(want)


def test_verdict(spark):
    rows = [("a", ["x"], "k1 K2", 1.0, [], ["x"], ["k1", "k2", "k3"], []), ("b", [], "k1", 1.0, [], [], ["k1", "k2"], ["bad"])]
    runs = spark.createDataFrame(rows, "case_id string, observed array<string>, response string, latency_s double, errors array<string>, expected_tools array<string>, expected_keywords array<string>, forbidden_keywords array<string>")
    assert {r.case_id: r.passed for r in qa.evaluate(runs).collect()} == {"a": True, "b": False}
    assert qa.flatten_items(qa.to_messages([{"type": "message", "role": "user", "text": "q"}, {"type": "function_call", "call_id": "1", "name": "f"}])) == [{"type": "message", "role": "user", "text": "q"}, {"type": "function_call", "call_id": "1", "name": "f", "arguments": {}}]


def test_trained_metrics_take_the_whole_graph(spark, sf, monkeypatch):
    from tessella import catalog

    train, seen = kge.train, []

    def short_training(dataset, config=kge.TRANSE):
        seen.append((dataset.count(), config.model, config.negatives, config.margin))
        return train(dataset, kge.Config(config.model, dim=4, epochs=1))

    monkeypatch.setattr(kge, "train", short_training)
    rows = catalog.trained_metrics(spark, sf).collect()
    n = catalog._dataset(spark, sf).count()
    assert seen == [(n, c.model, c.negatives, c.margin) for c in (kge.TRANSE, kge.ROTATE)] and n > 2000
    assert [r.model for r in rows] == ["transe", "rotate"] and all(0 < r.mrr <= 1 and r.n_entities > 1000 for r in rows)


@pytest.mark.parametrize("model", ["transe", "rotate"])
def test_ranks_equal_brute_force(spark, model):
    rng = np.random.default_rng(6)
    n, k = 40, 6
    parts = [rng.integers(-2, 3, (n, k)).astype(float) for _ in range(2)]  # whole numbers: many ties
    rel = [rng.integers(-2, 3, (3, k)).astype(float) for _ in range(2)]
    rows = lambda re, im: [(i, f"x{i}", a.tolist(), b.tolist() if model == "rotate" else []) for i, (a, b) in enumerate(zip(re, im))]
    schema = "id int, label string, re array<float>, im array<float>"
    e, r = spark.createDataFrame(rows(*parts), schema), spark.createDataFrame(rows(*rel), schema)
    known = sorted({tuple(map(int, x)) for x in np.stack([rng.integers(0, n, 120), rng.integers(0, 3, 120), rng.integers(0, n, 120)], axis=1)})
    test = known[::3]
    frame = lambda x: spark.createDataFrame(x, "h int, r int, t int")
    got = {(x.h, x.r, x.t): x["rank"] for x in kge.tail_ranks(frame(test), frame(known), e, r, block_rows=9).collect()}

    def distance(h, q, t):
        if model == "transe":
            return np.abs(parts[0][h] + rel[0][q] - parts[0][t]).sum()
        z = (parts[0][h] + 1j * parts[1][h]) * (rel[0][q] + 1j * rel[1][q]) - (parts[0][t] + 1j * parts[1][t])
        return round(float(np.sqrt(z.real**2 + z.imag**2).sum()), 9)

    for h, q, t in test:
        others = [distance(h, q, x) for x in range(n) if x != t and (h, q, x) not in known]
        own = distance(h, q, t)
        assert got[h, q, t] == 1 + sum(o < own for o in others) + sum(o == own for o in others) / 2
