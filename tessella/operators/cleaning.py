"""Cleaning and deduplication of pages ``(ord, url, title, text)``.

``ord`` totally orders pages; "first" always means its smallest value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella import vocab
from tessella.functions import text as T
from tessella.functions.vectors import broadcast_counts, counted_terms, known_terms, merged_counts, prefixes, products, unit_vectors
from tessella.plans.materialize import batches_of, checkpointed, discarded, joined_by_key, written

#: Terms with their counts, 12 bytes each, that a task's process holds at once.
MOST_TERMS = 4_000_000
#: Pages whose words are handed to a task's process at once.
ROWS_OF_TERMS = 500
#: Pages for each range of digests whose terms are counted at once.
PAGES_OF_RANGE = 1_000


def format_texts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", T.clean_text(F.col("text")))


def drop_exact_duplicates(pages: DataFrame) -> DataFrame:
    """The first page of each text.

    Digests are reduced before the shuffle, and pages are left out by ``ord``:
    a text with many copies is a hot key of neither, and no text is moved.
    """
    digests = written(pages.where("ord is not null").select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("k"), "ord"))
    first = digests.groupBy("k").agg(F.min("ord").alias("ord")).select("ord")
    later = checkpointed(digests.select("ord").distinct().join(first, "ord", "left_anti"))
    return joined_by_key(pages.where("ord is not null"), later, "ord", "left_anti")


def cut_texts(pages: DataFrame, keywords: tuple[str, ...] = vocab.CUTOFFS) -> DataFrame:
    return pages.withColumn("text", T.cut_off(F.col("text"), keywords))


def long_enough(pages: DataFrame, least: int = 300) -> DataFrame:
    return pages.where(F.length("text") >= least)


def clean_titles(pages: DataFrame, suffix: str = "", prefix: str = "Catégorie:") -> DataFrame:
    return pages.withColumn("title", T.clean_title(F.col("title"), suffix, prefix))


def title_change_share(pages: DataFrame, suffix: str = "", prefix: str = "Catégorie:") -> DataFrame:
    """The share, in percent, of titles that cleaning changes (null on no pages)."""
    changed = ~F.coalesce("title", F.lit("")).eqNullSafe(T.clean_title(F.col("title"), suffix, prefix))
    return pages.agg(F.round(100 * F.avg(changed.cast("double")), 2).alias("changed_percent"))


def _all_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def _words(text: Column, stop_words: list[str]) -> Column:
    return F.filter(_all_words(text), lambda w: ~w.isin(stop_words))


def _idf(n: Column | float, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def term_weights(pages: DataFrame, stop_words: list[str] = vocab.STOP_WORDS, least_df: int = 2) -> DataFrame:
    """``(ord, term, w, df)``: unit TF-IDF vectors of words and word pairs.

    Words have two characters at least; stop words go before pairs are formed;
    idf = ln((1 + n) / (1 + df)) + 1; terms of fewer than ``least_df`` documents
    are dropped.
    """
    # Dealt by page once: counts, norms and suffixes of a page then need no exchange of terms.
    pages = pages.repartition("ord").select("ord", _words(F.col("text"), stop_words).alias("words"))
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    # Written once: the terms' counts and the weights both read them.
    terms = checkpointed(pages.select("ord", F.explode(F.concat("words", pairs)).alias("term")).groupBy("ord", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    raw = terms.join(df, "term").join(F.broadcast(n)).select("ord", "term", "df", (F.col("tf") * _idf(F.col("n"), F.col("df"))).alias("raw"))  # n: one row
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("ord")))
    return raw.select("ord", "term", (F.col("raw") / norm).alias("w"), "df")


def hashed_words(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` but the text, and ``words``: 64-bit digests of all words, stop words too."""
    kept = [c for c in pages.columns if c not in ("text", "url", "title")]
    return pages.select(*kept, F.transform(_all_words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("words"))


def _digests(spark: SparkSession, words: list[str]) -> np.ndarray:
    """What :func:`hashed_words` has for these words."""
    row = spark.range(1).select(F.lit(0), *[F.xxhash64(F.lit(w)) for w in words]).first()
    return np.array(row[1:], dtype=np.int64)


def _reach(least: float) -> float:
    """Terms are joined from the rarest on until the norm of the rest is below this: far enough that one common term is not enough."""
    return max(0.0, least * least - 0.03) ** 0.5


def _candidates(prefix: DataFrame, least: float) -> DataFrame:
    """``prefix(t, ord, w, after)`` -> pairs a < b that may be similar; terms until the norm of the rest is below :func:`_reach`.

    ``after`` is what a page's squared norm has left behind the term.  At the
    first common term of a similar pair nothing is common before it, so the
    product of the two weights and the norms behind it must reach ``least``.
    All common terms up to the end of the shorter prefix are joined, so their
    products, and the rest of that page (below the reach) by what the other has
    left behind the last common term, must reach it too.  Both are summed in
    parts rounded up, which take a few bytes of a row; the slack is for floats.
    """
    a, b = (prefix.select("t", *[F.col(c).alias(f"{c}_{x}") for c in ("ord", "w", "after")]) for x in "ab")
    both = a.join(b, "t").where(F.col("ord_a") < F.col("ord_b"))
    product = F.col("w_a").cast("double") * F.col("w_b")
    first = product + F.sqrt(F.col("after_a").cast("double") * F.col("after_b")) >= least - 1e-5
    left = F.greatest("after_a", "after_b").cast("double")
    rows = both.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), F.ceil(product * 100_000).alias("common"), F.ceil(left * 1_000).cast("int").alias("left"), first.alias("first"))
    found = rows.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("left").alias("left"), F.max("first").alias("first"))
    bound = F.col("common") / 100_000 + _reach(least) * F.sqrt(F.col("left") / 1_000)
    return found.where(F.col("first") & (bound >= least - 1e-5)).select("a", "b")


def _verified(pairs: DataFrame, vectors: Callable[[DataFrame], DataFrame], least: float, block: int = 500) -> DataFrame:
    """Pairs with their cosines, of those that reach ``least``.

    ``vectors(need)`` gives rows ``(key, ord, t, w)`` for ``need(ord, keys)``.
    Pages are dealt to blocks of about ``block`` by their smallest partner, so
    partners mostly share a block, and large groups are cut; a task holds the
    vectors of two blocks.  A page is sent once to each pair of blocks that it
    has a candidate in, not once for each candidate.
    """
    ends = pairs.select(F.col("a").alias("ord"), F.col("a").alias("x")).union(pairs.select("b", "a"))
    labels = ends.groupBy("ord").agg(F.min("x").alias("label"))
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    docs = labels.join(sizes, "label")
    blocks = max(1, -(-labels.count() // block))
    docs = checkpointed(docs.select("ord", F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("ord"), F.col("parts"))), F.lit(blocks)).alias("block")))
    one, two = docs.toDF("a", "i"), docs.toDF("b", "j")
    key = F.least("i", "j") * blocks + F.greatest("i", "j")
    pairs = written(pairs.join(one, "a").join(two, "b").select(key.alias("key"), "a", "b"))
    need = pairs.select("key", F.col("a").alias("ord")).union(pairs.select("key", "b")).distinct().groupBy("ord").agg(F.collect_list("key").alias("keys"))
    return vectors(checkpointed(need)).groupBy("key").cogroup(pairs.groupBy("key")).applyInArrow(products(least), "a long, b long, cosine double")


def similar_pairs(weights: DataFrame, least: float = 0.95) -> DataFrame:
    """``(a, b, cosine)`` of all pairs a < b with cosine >= ``least``, exactly, of given ``weights(ord, term, w, df)``.

    Terms are ordered from rare to frequent.  A document's suffix that has a
    norm under ``least`` can't alone reach it with a unit vector, so each pair
    shares a term before that suffix; only such terms, and some behind them,
    are joined.  Candidates are then verified on their whole vectors.
    """
    weights = checkpointed(weights.select("ord", F.xxhash64("term").alias("t"), "w", "df"))
    order = W.partitionBy("ord").orderBy(F.desc("df"), F.desc("t"))
    tail = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(W.unboundedPreceding, 0))
    prefix = weights.withColumn("tail", tail).where(F.sqrt("tail") >= _reach(least) - 1e-9)
    after = F.greatest(F.col("tail") - F.col("w") * F.col("w"), F.lit(0.0))
    prefix = prefix.select("t", "ord", F.col("w").cast("float").alias("w"), after.cast("float").alias("after"))

    def vectors(need: DataFrame) -> DataFrame:
        whole = weights.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("v")).join(need, "ord")
        return whole.select(F.explode("keys").alias("key"), "ord", F.col("v.t").alias("t"), F.col("v.w").alias("w"))

    return _verified(written(_candidates(prefix, least)), vectors, least)


def similar_pages(pages: DataFrame, least: float = 0.95, stop_words: list[str] = vocab.STOP_WORDS, least_df: int = 2, most_terms: int = MOST_TERMS) -> DataFrame:
    """:func:`similar_pairs` of the pages' :func:`term_weights`, without a table of all terms of all pages.

    Terms are 64-bit digests.  How many pages have a term is counted first, in
    ranges of digests, which tasks send on as arrays; terms of ``least_df``
    pages and more are sent to the tasks, sorted, in tables of ``most_terms``.
    The texts are then read again, however many tables there are: once for the
    few terms of each page that candidates must share, once for the whole
    vectors of the pages that have a candidate.
    """
    n, stop = pages.count(), _digests(pages.sparkSession, stop_words)
    with batches_of(pages.sparkSession, ROWS_OF_TERMS):
        counts = hashed_words(pages).select("words").mapInArrow(counted_terms(stop, max(1, -(-n // PAGES_OF_RANGE))), "r int, t array<long>, n array<int>")
        known = written(counts.groupBy("r").applyInArrow(merged_counts(least_df), "t long, df int"))
    size = known.count()
    some = max(1, -(-size // most_terms))
    tables = [broadcast_counts(known, i, some, size) for i in range(some)]
    discarded(known)

    with batches_of(pages.sparkSession, ROWS_OF_TERMS):
        prefix = written(hashed_words(pages).mapInArrow(known_terms(tables, stop, prefixes(n, _reach(least))), "t long, ord long, w float, after float"))
    pairs = written(_candidates(prefix, least))
    discarded(prefix)

    def vectors(need: DataFrame) -> DataFrame:
        asked = hashed_words(joined_by_key(pages.select("ord", "text"), need, "ord", "inner"))
        return asked.mapInArrow(known_terms(tables, stop, unit_vectors(n)), "key long, ord long, t array<long>, w array<double>")

    with batches_of(pages.sparkSession, ROWS_OF_TERMS):
        found = written(_verified(pairs, vectors, least))
    for table in tables:
        table.destroy()
    return found


def keep_first_of_similar(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy removal: a page goes if an earlier page that stays is similar.

    Rounds over the pairs: pages without an undecided earlier neighbour stay,
    their later neighbours go, until no pair is left.  This is not the same as
    one page of each component.
    """
    left = checkpointed(pairs.select("a", "b"))
    removed = None
    while not left.isEmpty():
        later = left.select("b").distinct()
        stay = left.select("a").distinct().join(later, F.col("a") == F.col("b"), "left_anti")
        gone = checkpointed(left.join(stay, "a").select("b").distinct())
        removed = gone if removed is None else checkpointed(removed.union(gone))
        names = gone.select(F.col("b").alias("x"))
        left = checkpointed(left.join(stay, "a", "left_anti").join(names, F.col("b") == F.col("x"), "left_anti").join(names, F.col("a") == F.col("x"), "left_anti"))
    return pages if removed is None else joined_by_key(pages, removed.select(F.col("b").alias("ord")), "ord", "left_anti")


def drop_similar(pages: DataFrame, least: float = 0.95, stop_words: list[str] = vocab.STOP_WORDS) -> DataFrame:
    return keep_first_of_similar(pages, similar_pages(pages, least, stop_words))


def clean_corpus(pages: DataFrame, least_length: int = 300, least_similarity: float = 0.95, suffix: str = "") -> DataFrame:
    """All cleaning steps in their order."""
    pages = drop_exact_duplicates(written(format_texts(pages)))
    pages = long_enough(cut_texts(drop_similar(pages, least_similarity)), least_length)
    return clean_titles(pages, suffix).select("ord", "url", "title", "text")
