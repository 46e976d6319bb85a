"""Cleaning, text and URL functions on small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import urls as U
from tessella.operators import cleaning, crawl


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t="a\n| b [1] COOKIE POLICY x") == "a\nb"
    assert one(spark, T.clean_text(F.col("t")), t=None) == ""
    assert one(spark, T.clean_text(F.col("t")), t="ﬁn ©x y\nz ") == "fin \nz".replace(" \n", " \n")


def test_cut_off(spark):
    assert one(spark, T.cut_off(F.col("t"), ("Source",)), t="aSourcebSource\nc") == "aSourceb"
    assert one(spark, T.cut_off(F.col("t")), t="x Sources y Source z") == "x "


def test_cut_off_is_the_last_occurrence(spark):
    texts = ["", "ab", "abab\nab c", "x.y", "a\\Eb ab\\E"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("ab", ".", "\\E"):
        got = [r[0] for r in rows.select(T.cut_off(F.col("t"), (word,))).collect()]
        assert got == [t.rsplit(word, 1)[0] for t in texts]


def test_length_and_titles(spark):
    pages = spark.createDataFrame([(1, "x" * 299), (2, "y" * 300)], "ord long, text string")
    assert [r.ord for r in cleaning.long_enough(pages).collect()] == [2]
    titles = spark.createDataFrame([("Catégorie:A — Site",), ("B",), (None,)], "title string")
    assert [r.title for r in cleaning.clean_titles(titles, " — Site").collect()] == ["A", "B", ""]
    assert cleaning.title_change_share(titles.limit(0)).first()[0] is None


def test_chunks():
    sizes = {6000: 1, 6001: 2, 11451: 3}
    for n, k in sizes.items():
        assert len(T.chunks_of("x" * n, 6000, 300, 400, 50)) == k


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab. ", max_size=300))
def test_chunks_cover(text):
    found = T.chunks_of(text, 60, 10, 20, 0)
    assert "".join(text.split()) == "" or all(p in text for p in found)


def test_slug(spark):
    for text, slug in (("Abaddon le Fléau", "abaddon_le_fleau"), ("Cœur", "c_ur"), ("--", "")):
        assert one(spark, T.slug(F.col("t")), t=text) == slug


def test_titles_and_types(spark):
    cases = {"Siège de Terra": "EVENT", "Hérésie d'Horus": "UNKNOWN", "Monde Ork": "LOCATION", "Le cité": "LOCATION", "citeé": "UNKNOWN", "Space Marine": "FACTION", "espace des marine": "FACTION", "t'au x": "FACTION"}
    for title, kind in cases.items():
        assert one(spark, T.infer_type(F.col("t")), t=title) == kind
    for title, ignored in {"Liste des mondes": True, "A": True, "Listeur": False, "x" * 201: True}.items():
        assert one(spark, T.ignored_title(F.col("t")), t=title) is ignored


def test_snippet(spark):
    text = "a" * 600 + ". " + "b" * 600
    assert one(spark, T.snippet(F.col("t")), t=text) == "a" * 600 + "."
    assert one(spark, T.snippet(F.col("t")), t="a. " + "b" * 2000) == "a. " + "b" * 997


def test_urls(spark):
    assert U.normal_url("https://h/a b?x=1#f") == "https://h/a%20b?x=1"
    for url, html in {"http://h/a.PDF": False, "http://h/a.html": True, "http://h/js": True}.items():
        assert one(spark, U.is_html(F.col("u")), u=url) is html
    page = spark.createDataFrame([("https://h/p/", "<a href='q#z'>x</a><A class=c HREF=\"mailto:a@b\">y</A><a href=//o/x>z</a><a href='q'>again</a>")], "url string, html string")
    assert sorted(r.link for r in crawl.links(page).collect()) == ["https://h/p/q", "https://o/x"]


def test_robots(spark):
    rules = spark.createDataFrame([("User-agent: *\nDisallow: /x", "http://h/x/1"), ("User-agent: *\nDisallow: /x", "http://h/y"), (None, "http://h/y")], "rules string, u string")
    assert [r[0] for r in rules.select(U.robots_allow(F.col("rules"), "bot", F.col("u"))).collect()] == [False, True, False]


def test_crawl(spark):
    pages = {"http://h/": '<a href="/a">a</a><a href="/b.pdf">b</a><a href="http://o/">o</a>', "http://h/a": '<a href="/c">c</a><a href="/">r</a><a href="/ban/x">n</a>', "http://h/c": "", "http://h/ban/x": "", "http://o/": ""}
    table = spark.createDataFrame(list(pages.items()), "url string, html string")
    assert sorted(map(tuple, crawl.crawl(table, ["http://h/"], ["http://h/ban"]).collect())) == [("http://h/", 0), ("http://h/a", 1), ("http://h/c", 2)]
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /c")], "domain string, rules string")
    assert crawl.crawl(table, ["http://h/"], ["http://h/ban"], robots).count() == 2


def test_exact_duplicates(spark):
    pages = spark.createDataFrame([(3, "y"), (2, "x"), (1, "x")], "ord long, text string")
    assert sorted(r.ord for r in cleaning.drop_exact_duplicates(pages).collect()) == [1, 3]


def greedy(n, pairs):
    gone = set()
    for i in range(n):
        if i not in gone:
            gone |= {b for a, b in pairs if a == i}
    return set(range(n)) - gone


def test_greedy_removal(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        pairs = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)})
        pages = spark.createDataFrame([(i,) for i in range(25)], "ord long")
        kept = cleaning.keep_first_of_similar(pages, spark.createDataFrame(pairs, "a long, b long"))
        assert {r.ord for r in kept.collect()} == greedy(25, pairs)


def test_similar_pairs_equal_brute_force(spark):
    import random
    from collections import defaultdict

    rng = random.Random(1)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi"], k=30)) for _ in range(12)]
    texts = base + [t + " alpha" for t in base[:6]] + ["", "zz"]
    weights = cleaning.term_weights(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"))
    vectors = defaultdict(dict)
    for r in weights.collect():
        vectors[r.ord][r.term] = r.w
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) >= 0.8}
    assert {(r.a, r.b) for r in cleaning.similar_pairs(weights, 0.8).collect()} == want
    assert want


def test_frontier_equals_a_breadth_first_search(spark, sf, tmp_path):
    import re
    from urllib.parse import unquote, urldefrag, urljoin, urlsplit

    from tessella import catalog, vocab

    chain = [(i, f"http://chain.org/{i:02}", f'<a href="/{i + 1:02}#x">next</a><a href="http://else.net?q">other</a>') for i in range(14)]
    given = [*chain, (50, "http://else.net?q", '<a href="/doc.pdf">file</a>'), (51, "http://else.net/doc.pdf", ""), (52, "http://lone.com/%C3%A9", None)]
    small = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(given, "page_id long, url string, html string").write.parquet(small)
    for folder in (sf, str(tmp_path)):
        rows = [(r.url, r.html or "") for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
        stored = {}
        for url, html in rows:
            stored.setdefault(unquote(url), html)
        html_page = lambda u: not re.search(r"\.(?:" + "|".join(vocab.NOT_HTML) + r")$", urlsplit(u).path.lower())
        least = {}
        for url, _ in rows:
            if html_page(url):
                least[urlsplit(url).netloc] = min(least.get(urlsplit(url).netloc, url), url)
        level, want = {unquote(u) for u in least.values()}, {}
        for depth in range(11):
            fetched = {u for u in level if u in stored}
            want |= dict.fromkeys(fetched, depth)
            found = {unquote(urldefrag(urljoin(u, x)).url) for u in fetched for x in re.findall(r'<a href="([^"]*)"', stored[u])}
            level = {u for u in found if u not in want and html_page(u) and urlsplit(u).netloc in least}
        got = catalog.crawl_frontier(spark, folder).collect()
        assert len(got) >= len(least) > 0 and sorted(map(tuple, got)) == sorted(want.items())
    assert max(want.values()) == 10


def near_copies(seed, n, words, vocabulary):
    import random

    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]
    return texts + [t + f" more{i % 3}" for i, t in enumerate(texts[: n // 3])] + ["", "w1", "w1 W1", None]


@pytest.mark.parametrize("most_terms", [10**6, 150])
def test_similar_pages_equal_similar_pairs(spark, most_terms):
    """Read in passes, with or without room for all counts, the pages give the pairs of their weights."""
    pages = spark.createDataFrame(list(enumerate(near_copies(2, 40, 40, 60))), "ord long, text string")
    want = {(r.a, r.b): r.cosine for r in cleaning.similar_pairs(cleaning.term_weights(pages), 0.8).collect()}
    got = {(r.a, r.b): r.cosine for r in cleaning.similar_pages(pages, 0.8, most_terms=most_terms).collect()}
    assert len(want) > 10 and got == pytest.approx(want)


@pytest.mark.parametrize("step", ["similar_pages", "drop_similar", "clean_corpus"])
def test_similar_pages_write_less_than_their_texts(spark, tmp_path, monkeypatch, step):
    """No table of all terms of all pages: what stays in the checkpoint folder is under three times the texts."""
    from tessella.plans import materialize

    texts = near_copies(3, 300, 300, 3000)
    rows = [(i, "u", "t", t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "ord long, url string, title string, text string")
    folder = spark.sparkContext.getCheckpointDir() or materialize.checkpoint_dir(spark.sparkContext)
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    try:
        assert getattr(cleaning, step)(pages).count() > 0
    finally:
        spark.sparkContext.setCheckpointDir(folder)
    stays = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert stays < 3 * sum(len(t or "") for t in texts)


def test_similar_pages_send_no_terms_of_pages_for_more_tables(spark):
    """Counts that need many tables are looked up where the texts are read: as few bytes are shuffled as for one."""
    texts = near_copies(5, 300, 300, 2500)
    pages = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    sent, pairs = [], []
    for most_terms in (10**6, 3000):
        before = sum(x.totalShuffleWrite() for x in shuffled(spark))
        pairs.append({(r.a, r.b): r.cosine for r in cleaning.similar_pages(pages, most_terms=most_terms).collect()})
        sent.append(sum(x.totalShuffleWrite() for x in shuffled(spark)) - before)
    assert len(pairs[0]) > 10 and pairs[0] == pytest.approx(pairs[1])
    assert 0 < sent[1] < 1.2 * sent[0]


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_terms_are_counted_and_looked_up_as_in_plain_python(monkeypatch):
    """Stop words go before pairs are formed, pairs stay within a row; rows that wait for others and rows without words are there too."""
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from tessella.functions import vectors

    rng = random.Random(4)
    words = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(18)]
    stop = set(words[:2])
    rows = [rng.choices(words, k=rng.randrange(30)) for _ in range(40)] + [[], words[:2], words[2:3]]
    pair = lambda a, b: (a * int(vectors.PAIR) + b + (1 << 63)) % (1 << 64) - (1 << 63)
    kept = [[w for w in r if w not in stop] for r in rows]
    want = [Counter(r + [pair(a, b) for a, b in zip(r, r[1:])]) for r in kept]
    df = Counter(t for c in want for t in c)
    batches = [pa.RecordBatch.from_pydict({"ord": pa.array(range(i, min(i + 7, len(rows))), pa.int64()), "words": pa.array(rows[i : i + 7], pa.list_(pa.int64()))}) for i in range(0, len(rows), 7)]
    given = np.array(sorted(stop), dtype=np.int64)

    class Table:
        def __init__(self, own):
            self.value = [(np.array(own, dtype=np.int64), np.array([df[t] for t in own], dtype=np.int32))] if own else []

    known = sorted(t for t in df if df[t] > 1)
    for held in (1, 200, 10**6):
        monkeypatch.setattr(vectors, "HELD_TERMS", held)
        monkeypatch.setattr(vectors, "SLICE_TERMS", 40)
        got = Counter()
        for out in vectors.counted_terms(given, 4)(iter(batches)):
            for r, t, n in zip(*(out.column(c).to_pylist() for c in "rtn")):
                assert t == sorted(set(t)) and {(x + (1 << 63)) >> 62 for x in t} == {r}
                got.update(dict(zip(t, n)))
        assert got == df
        for tables in ([Table(known)], [Table(known[:20]), Table([]), Table(known[20:])]):
            found = {}

            def finish(rest, row, t, tf, n):
                for i, o in enumerate(rest.column("ord").to_pylist()):
                    assert list(n[row == i]) == [df[x] for x in t[row == i]]
                    found[o] = dict(zip(t[row == i].tolist(), tf[row == i].tolist()))
                yield from ()

            assert list(vectors.known_terms(tables, given, finish)(iter(batches))) == []
            assert found == {o: {t: k for t, k in c.items() if df[t] > 1} for o, c in enumerate(want)}
