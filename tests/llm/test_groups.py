"""Operators on many rows against brute force: near duplicates, mixing, chat, classifier, pipeline."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import chat, components, embed_dedup, mixing, quality_classifier, quality_rules, ranks, registry, shared, simhash


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [tuple(map(int, p)) for p in rng.integers(200, 260, (45, 2))] + [(5, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    want = roots(260, pairs)
    assert got == {i: want[i] for i in {x for a, b in pairs if a != b for x in (a, b)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(sf):
    texts = [r[0] for r in duckdb.connect().execute(f"select text from '{sf}/documents.parquet' limit 60").fetchall()]
    for t in [*texts, None, "", "One", "One two", "É one TWO three"]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_fingerprint(t)


@pytest.mark.parametrize("chunk", [4096, 8])
def test_fingerprint_links(spark, chunk):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64)
    values = [*base, *(base ^ np.int64(-(1 << 63))), *(base ^ np.int64(-(1 << 63) | 5))]
    for v in base[:10]:
        for _ in range(12):
            flip = np.bitwise_or.reduce(np.int64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.int64))
            values.append(v ^ flip)
    values = np.unique(np.array(values, dtype=np.int64))
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in values], "fp long"), chunk=chunk)
    at = {int(v): i for i, v in enumerate(values)}
    got = roots(len(values), [(at[r.a], at[r.b]) for r in links.collect()])
    bits = values.view(np.uint64)
    near = np.argwhere(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    assert got == roots(len(values), [tuple(p) for p in near.tolist() if p[0] != p[1]])
    assert len(set(got)) > 10


def test_the_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    counts = lambda v: np.stack([np.bitwise_count(v.view(np.uint64) >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b)) == manhattan).all()
    assert (manhattan <= (hamming := np.bitwise_count((a ^ b).view(np.uint64)))).all() and (manhattan < hamming).any()


def test_edges_of_a_dense_cell_of_fingerprints_are_linear():
    values = np.unique([(1 << i | 1 << j) for i in range(36) for j in range(i)])[:600].astype(np.int64)
    part = np.arange(600) % 6
    edges = []
    for i in range(6):
        for j in range(i + 1, 6):
            rows = np.flatnonzero((part == i) | (part == j))
            edges += simhash.task_forest(values[rows], part[rows], i, j, 3).tolist()
    at = {v: k for k, v in enumerate(values.tolist())}
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3).tolist()
    assert len(edges) < 650 and roots(600, [(at[x], at[y]) for x, y in edges]) == roots(600, [p for p in near if p[0] != p[1]])


def test_simhash_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = np.array([brute_fingerprint(r.text) for r in rows], dtype=np.uint64)
    group = roots(len(rows), [p for p in np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3).tolist() if p[0] != p[1]])
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{int(f):016x}", least[g]) for r, f, g in zip(rows, prints, group))
    assert sorted(map(tuple, registry.op7_simhash_dedup(spark, sf).collect())) == want


def test_simhash_rows(spark):
    text = "a clear enough text about some things that go on for a while in this place"
    rows = [(4, text, "x"), (2, text.upper(), "x"), (None, text, "x"), (9, None, "x"), (8, "", "x"), (8, "", "x"), (None, "other words entirely here", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.simhash_groups(table)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got.collect() if r.component_id is not None) == [(-1, 2), (2, 2), (4, 2), (8, 8), (8, 8), (9, 8)]
    assert got.where("component_id is null").count() == 1
    assert simhash.simhash_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 16])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    near = np.repeat(base[:8], 12, axis=0) + 0.035 * rng.standard_normal((96, 16))
    vectors = [list(map(float, v)) for v in np.vstack([base, near, near[:3]])]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, vectors[0], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(table, chunk=chunk).collect()}
    n = len(vectors)
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None] % 2) & ~np.eye(n, dtype=bool)
    assert [got[i].n_links for i in range(n)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == roots(n, [tuple(p) for p in np.argwhere(link).tolist()])
    assert link.sum() > 100
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904))
    assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False)
    assert embed_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_at_the_threshold_extremes_and_text_labels(spark):
    tie, below = [49.0, 9.0, 3.0, 3.0], [48.9, 9.0, 3.0, 3.0]
    rows = [(1, [50.0, 0.0, 0.0, 0.0], "x"), (2, tie, "x"), (3, tie, "y"), (4, [-50.0, 0.0, 0.0, 0.0], "y"), (5, below, "y"), (6, [50.0, 0.0, 0.0, 0.0], "y")]
    rows += [(10, [1e-200, 2e-200, 0.0, 0.0], "e"), (11, [1e200, 2e200, 0.0, 0.0], "e"), (12, [2e200, -1e200, 0.0, 0.0], "e"), (13, [1e-300, 2e-300, 0.0, 0.0], "e")]
    rows += [(20, [1.0, 0.0, 0.0, 1e-7], "n"), (21, [1.0, 0.0, 1e-7, 0.0], "n"), (22, [1.0, 1e-7, 0.0, 0.0], "n")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [got[i] for i in range(1, 7)] == [(1, 1), (1, 1), (2, 3), (0, 4), (1, 3), (1, 3)]
    assert [got[i] for i in range(10, 14)] == [(2, 10), (2, 10), (0, 12), (2, 10)]
    assert [got[i] for i in range(20, 23)] == [(2, 20)] * 3
    # Radii near zero: each key still names one cell.
    close = {r.vec_id: r.n_links for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows[-3:], "vec_id long, embedding array<double>, label string"), cosine=1 - 1e-15).collect()}
    assert set(close.values()) <= {0, 2} and len(close) == 3


def test_the_grid_compares_few_pairs():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    labels, vectors = table.column("label").to_numpy(), np.array(table.column("embedding").to_pylist(), dtype=float)
    done = ordered = 0
    for label in np.unique(labels):
        unit = embed_dedup._unit(vectors[labels == label])
        space = embed_dedup.Subspaces(unit.shape[1], 0.98, embed_dedup.choose_grid(unit.shape[1], 0.98, 220))
        rotated = space.rotated(unit)
        ordered += len(unit) * (len(unit) - 1)
        for block, dims in enumerate(space.blocks):
            cells = {}
            for rows, keys, home in space.cells(rotated, block):
                for row, key in zip(rows.tolist(), keys.tolist()):
                    cells.setdefault(key, ([], []))[0 if home else 1].append(row)
            args = rotated[:, dims], rotated[:, space.sort[block]], space.budgets[block]
            for homes, visitors in cells.values():
                for two in (None, np.array(visitors, dtype=int)):
                    done += sum(n for _, _, n in embed_dedup.near_in_block(*args, np.array(homes, dtype=int), two)) if homes else 0
    assert done < 0.4 * ordered


def test_edges_of_a_dense_cell_are_linear():
    rng = np.random.default_rng(2)
    vectors = 1 + 1e-3 * rng.standard_normal((600, 16))
    space = embed_dedup.Subspaces(16, 0.98, embed_dedup.Grid(2, 2, 4.0))
    part = rng.integers(0, 6, 600)
    edges, counts = [], np.zeros(600, dtype=int)
    for i in range(6):
        for j in range(i, 6):
            for block in range(2):
                rows = np.flatnonzero((part == i) | (part == j))
                links = embed_dedup._Links(space, block, 0.98, vectors[rows], rows, np.ones(len(rows), dtype=int))
                embed_dedup.task_links(links, np.ones(len(rows), dtype=bool), part[rows], i, j)
                edges += [tuple(e) for x in links.edges for e in x.T.tolist()]
                counts[rows] += links.counts
    assert (counts == 599).all() and len(edges) <= 599 + 15 and len(set(roots(600, edges))) == 1


def test_ranks(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("g"))
    got = ranks.ranked(df, F.col("g"), F.md5(F.col("id").cast("string")), [F.col("id")])
    rows = got.collect()
    for g in (None, "0", "1"):
        mine = sorted((r["rank"], r.id) for r in rows if r.g == g)
        import hashlib

        assert [i for _, i in mine] == sorted((i for _, i in mine), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [k for k, _ in mine] == list(range(1, len(mine) + 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_edf(parts):
    period, slots = sum(parts), mixing.edf_slots(parts)
    assert sorted(t for s in slots for t in s) == list(range(period))
    for p, own in zip(parts, slots):
        for k, t in enumerate(own):
            assert k * period // p <= t < -(-(k + 1) * period // p)
        for now in range(period + 1):
            assert abs(sum(t < now for t in own) - now * p / period) < 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=5))
def test_phases(sources):
    blocks, parts = [b for b, _ in sources], [p for _, p in sources]
    slots = {}
    for s in mixing.phases(blocks, parts):
        for k in range(s.n_blocks):
            slot = s.first_slot + k // len(s.slots) * s.length + int(s.slots[k % len(s.slots)])
            assert slot not in slots
            assert s.first_slot + k * s.period // s.part <= slot < s.first_slot - (-(k + 1) * s.period // s.part)
            slots[slot] = (s.source, s.first_block + k)
    assert sorted(slots) == list(range(sum(blocks)))
    assert sorted(slots.values()) == [(i, k) for i, b in enumerate(blocks) for k in range(b)]


def brute_schedule(blocks, parts):
    """Slot by slot over whole blocks; who runs out leaves, and the rest start anew."""
    left, out, done = list(blocks), [], [0] * len(blocks)
    while any(left):
        active = [s for s in range(len(blocks)) if left[s]]
        period, taken, now = sum(parts[s] for s in active), {s: 0 for s in active}, 0
        while all(left[s] for s in active):
            free = [(-(-(taken[s] + 1) * period // parts[s]), s) for s in active if taken[s] * period // parts[s] <= now]
            s = min(free)[1]
            out.append((s, done[s]))
            taken[s], done[s], left[s], now = taken[s] + 1, done[s] + 1, left[s] - 1, now + 1
            for t in active:  # less than one block from its share, in every phase
                assert abs(taken[t] - now * parts[t] / period) < 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=6))
def test_phases_equal_brute_force(sources):
    blocks, parts = [b for b, _ in sources], [p for _, p in sources]
    slots = {}
    for s in mixing.phases(blocks, parts):
        slots |= {s.first_slot + k // len(s.slots) * s.length + int(s.slots[k % len(s.slots)]): (s.source, s.first_block + k) for k in range(s.n_blocks)}
    assert [slots[i] for i in range(sum(blocks))] == brute_schedule(blocks, parts)


def test_many_sources_are_planned_in_seconds():
    import time

    rng = np.random.default_rng(4)
    blocks, start = rng.integers(1, 3000, 1000).tolist(), time.perf_counter()
    plan = mixing.phases(blocks, mixing.smoothed_parts(blocks))
    assert sum(p.n_blocks for p in plan) == sum(blocks) and time.perf_counter() - start < 30


def brute_positions(rows, weights, block_rows):
    import hashlib

    groups = {}
    for i, source in rows:
        groups.setdefault(source, []).append(i)
    keys = sorted(groups, key=lambda k: "" if k is None else f"={k}")
    for k in keys:
        groups[k].sort(key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    order = brute_schedule([-(-len(groups[k]) // block_rows) for k in keys], [weights.get(k, 1) for k in keys])
    return {i: slot * block_rows + n for slot, (s, b) in enumerate(order) for n, i in enumerate(groups[keys[s]][b * block_rows : (b + 1) * block_rows])}


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_positions_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_STRETCHES", broadcast)
    rows = [(i, "hot" if i % 3 else None if i % 4 == 0 else f"s{i % 5}") for i in range(700)]
    weights = {"hot": 3, "s1": 2, None: 2}
    got = {r.doc_id: r.mix_position for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).collect()}
    assert got == brute_positions(rows, weights, 4)


def test_more_sources_than_one_plan_holds(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i * i % 97}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, {"hot": 40}, block_rows=2, max_sources=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500)) and len({r.mix_position for r in got}) == 1500
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert len({r.mix_slot for r in got}) == max(r.mix_slot for r in got) + 1
    assert mixing.mix(docs, block_rows=2, max_sources=10).count() == 1500


def test_mix(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "t") for i in range(900)] + [(None, None, "t"), (5, "hot", "t"), (5, "hot", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"hot": 2, "s0": 1, "s1": 1, "s2": 1, "s3": 1, None: 1}
    got = mixing.mix(docs, weights, block_rows=5).collect()
    assert len(got) == 903 and len({r.mix_position for r in got}) == 903
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    blocks = sorted({(r.mix_slot, r.source, r.mix_phase) for r in got}, key=lambda b: b[0])
    first = [b for b in blocks if b[2] == 0]
    for now in range(len(first) + 1):
        assert abs(sum(b[1] == "hot" for b in first[:now]) - now * 2 / 7) < 1
    assert mixing.in_mixed_order(docs, weights=weights).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(docs, {"hot": 0})


def test_files_follow_the_mix(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    mixing.in_mixed_order(docs, block_rows=4).write.parquet(str(tmp_path / "out"))
    position = {r.doc_id: r.mix_position for r in mixing.mix(docs, block_rows=4).collect()}
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    order = [position[i] for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert len(files) > 1 and len(order) == 500 and order == sorted(order)


def test_preferences(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "more"), (1, 3, "assistant", "good answer"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (2, 2, "user", "else"), (3, 0, "user", "lone"), (3, 1, "assistant", "hi"), (None, 0, None, None)]
    got = {r.chosen_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    pair = got[1]
    assert (pair.rejected_id, pair.n_prompt_turns) == (2, 2)
    assert pair.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nsame<|im_end|>\n"
    assert pair.chosen.startswith("<|im_start|>user\nmore") and pair.rejected_mask == ""
    start, stop = map(int, pair.chosen_mask.split(":"))
    assert pair.chosen[start:stop] == "good answer<|im_end|>"
    assert (got[3].rejected_id, got[3].rejected, got[3].n_prompt_turns) == (None, None, 1)
    assert got[None].chosen == "<|im_start|>\n<|im_end|>\n"


def test_preferences_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from (select conv_id, turn, role, case when conv_id % 3 < 2 and turn < 2 then 'shared' || turn else text end as text from '{sf}/conversations.parquet')")
    rows = con.execute("select * from conversations").fetchall()
    want = sorted(con.execute(registry.oracle_sql()["op6_chat_preferences"]).fetchall(), key=str)
    got = chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] is not None for r in want)


def test_isotonic():
    y = quality_classifier.pool_adjacent_violators(np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.ones(5))
    assert np.allclose(y, [0.1, 0.4, 0.4, 0.85, 0.85])


def test_classifier(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 90_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in quality_classifier.score_quality(odd, none).collect()} == {(0.5, 1)}
    assert quality_classifier.score_quality(odd.limit(0), labels).count() == 0


def brute_pipeline(rows):
    rules = quality_rules.LineRules(fail_short=False)
    kept = [(i, quality_rules.cleaned(t)) for i, t in rows if quality_rules.measure(t, rules)["kept"]]
    prints = np.array([brute_fingerprint(r[1]) for r in kept], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    group = roots(len(kept), [tuple(p) for p in near.tolist() if p[0] != p[1]])
    least = {}
    for g, r in zip(group, kept):
        least[g] = min(least.get(g, r[0]), r[0])
    return sorted(least.values())


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == brute_pipeline(rows)
    assert all(len(r.token_ids) == r.n_tokens for r in got)


def test_pipeline_follows_the_mix(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}x{j * j % (17 + i)}y{j}" for j in range(60 + 40 * (i % 9))) + " end.", "en", f"src{i % 3 * 7 if i % 4 else 0}", 5) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    order = [(r.doc_id, r.mix_position) for r in got.collect()]
    want = {r.doc_id: r.mix_position for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), registry.TARGET_PARTS).collect()}
    assert len(order) == 120 and order == sorted(want.items(), key=lambda x: x[1])
    got.write.parquet(f"{tmp_path}/out")
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()] == [i for i, _ in order]
    # The last stage's own files too, as they are named.
    corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").write.parquet(f"{tmp_path}/encoded")
    files = sorted((tmp_path / "encoded").glob("part-*.parquet"))
    assert [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()] == [i for i, _ in order]


def test_stages_keep_columns_and_odd_rows(spark, sf):
    import corpus_pipeline

    many = "".join(f"A{i} tells b{i} of c{i}, and d{i} ends with plain e{i}.\n" for i in range(12))
    rows = [(1, many, "en", "a", 5), (1, many, "en", "a", 5), (None, many, None, None, None), (2, None, "en", "b", 0), (3, "", "en", "b", 0), (None, many.replace("tells", "never saw").replace("ends", "began").replace("plain", "some other").replace("of", "from"), None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, 1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs.schema), sf).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé", max_size=30)), max_size=30), st.integers(1, 5), st.integers(1, 40))
def test_slices_are_whole_and_bounded(texts, most_rows, most_bytes):
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    parts = list(shared.slices(batch, 0, most_rows, most_bytes))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    for p in parts:
        size = sum(len((t or "").encode()) for t in p.column(0).to_pylist())
        assert 1 <= p.num_rows <= most_rows and (size <= most_bytes or p.num_rows == 1)
