"""Queries that SQL can't express, against brute force over the smallest supplied tables."""

from difflib import SequenceMatcher
from urllib.parse import unquote, urljoin, urlsplit

import duckdb
import numpy as np

from tessella import catalog, vocab
from tessella.functions.fuzzy import weighted_ratio


def table(sf, sql):
    return duckdb.connect().execute(sql.replace("{sf}", sf)).fetchall()


def test_vector_plane(spark, sf):
    rows = table(sf, "select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id")
    got = {r.id: (r.x, r.y) for r in catalog.vector_plane(spark, sf).collect()}
    vectors = np.array([v for _, v in rows], dtype=float)
    _, _, axes = np.linalg.svd(vectors - vectors.mean(axis=0), full_matrices=False)
    want, mine = vectors @ axes[:2].T, np.array([got[i] for i, _ in rows])
    for k in range(2):  # an axis may point either way
        assert np.allclose(mine[:, k], want[:, k], atol=1e-6) or np.allclose(mine[:, k], -want[:, k], atol=1e-6)


def test_resolved_names(spark, sf):
    names = [n for (n,) in table(sf, "select distinct p_name from '{sf}/part.parquet'")]
    got = {r.name: r.canonical for r in catalog.resolved_names(spark, sf).collect()}
    keys = {n.strip().lower(): n for n in names}
    for asked in {n[:-1] + "x" for n in names} | {n.upper() for n in names}:
        q = asked.strip().lower()
        want = keys.get(q)
        if want is None and len(q) >= 6:
            best = max((SequenceMatcher(None, k, q).ratio(), k) for k in keys)
            want = keys[best[1]] if best[0] >= 0.85 else None
        assert got[asked] == (want or asked.strip())


def test_linked_entities(spark, sf):
    mapping = {r.key: r.eid for r in catalog.entity_mapping(spark, sf).collect()}
    got = {}
    for r in catalog.linked_entities(spark, sf).collect():
        got.setdefault(r.id, []).append((r["rank"], r.status, r.key, r.eid))
    for i, name in table(sf, "select n_nationkey, n_name from '{sf}/nation.parquet'"):
        q = (name if i % 2 == 0 else name[:-1] + "#").strip().lower()
        if q in mapping:
            assert got[i] == [(1, "CONFIRMED", q, mapping[q])]
            continue
        near = sorted((-s, k) for k in mapping if (s := weighted_ratio(q, k)) >= 65)[:3]
        want, seen = [], set()
        for _, k in near:
            if mapping[k] not in seen:
                seen.add(mapping[k])
                want.append((len(seen), "AMBIGUOUS", k, mapping[k]))
        assert sorted(got[i], key=lambda x: x[0]) == (want or [(0, "FAILED", None, None)])


def test_normalized_urls(spark, sf):
    urls = dict(table(sf, "select page_id, url from '{sf}/pages.parquet'"))
    for r in catalog.normalized_urls(spark, sf).collect():
        assert r.decoded == unquote(urls[r.page_id])
        parts = urlsplit(r.decoded)
        assert r.url == f"{parts.scheme}://{parts.netloc}{parts.path}" + (f"?{parts.query}" if parts.query else "")


def test_crawl_frontier(spark, sf):
    pages = {}
    for url, source in table(sf, "select url, html from '{sf}/pages.parquet'"):
        pages.setdefault(unquote(url), source)
    html = lambda u: not urlsplit(u).path.lower().endswith(tuple(f".{s}" for s in vocab.NOT_HTML))
    seeds = {}
    for (url,) in table(sf, "select url from '{sf}/pages.parquet'"):
        if html(url):
            host = urlsplit(url).netloc
            seeds[host] = min(seeds.get(host, url), url)
    front, want, depth = {unquote(u) for u in seeds.values()}, {}, 0
    while front:
        fetched = front & set(pages)
        want |= {u: depth for u in fetched}
        found = {unquote(urljoin(u, part.split('"', 1)[0])) for u in fetched for part in pages[u].split('<a href="')[1:]}
        front = {u for u in found if html(u) and urlsplit(u).netloc in seeds} - set(want)
        depth += 1
    assert {r.url: r.depth for r in catalog.crawl_frontier(spark, sf).collect()} == want and want
