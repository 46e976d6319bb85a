"""The queries over the supplied tables, and the same in DuckDB's SQL.

Each query applies one operator, or a few, to whole tables.  Where SQL can't
express an operator (iteration, similarity of strings, hash order), the tests
hold it against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import vocab
from tessella.functions import text as T
from tessella.functions import urls as U
from tessella.operators import cleaning, crawl, entities, graph, kge, ner, qa, relations, rules, sampling
from tessella.plans import views
from tessella.plans.materialize import checkpointed, written
from tessella.sources import files, providers
from tessella.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Texts and pages

_PAGES = "pages_ AS (SELECT doc_id AS ord, source || '/' || doc_id AS url, split_part(text, '.', 1) AS title, text FROM documents)"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _clean_sql(text: str) -> str:
    for p in vocab.BOILERPLATE:
        text = f"regexp_replace({text}, '(?im){p}', '', 'g')"
    return _STRIP.format(text)


_CLEAN = f"clean AS (SELECT ord, url, title, {_clean_sql('text')} AS text FROM pages_)"
_FIRSTS = "firsts AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY text ORDER BY ord) = 1)"


@query(f"WITH {_PAGES}, {_CLEAN} SELECT ord, text FROM clean")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.format_texts(views.pages(spark, sf_dir)).select("ord", "text")


@query(f"WITH {_PAGES}, {_CLEAN}, {_FIRSTS} SELECT ord, url FROM firsts")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_exact_duplicates(cleaning.format_texts(views.pages(spark, sf_dir))).select("ord", "url")


@query(f"WITH {_PAGES}, {_CLEAN}, {_FIRSTS} SELECT d.lang AS lang, count(*) AS n, round(avg(length(f.text)), 4) AS avg_length FROM firsts f JOIN documents d ON f.ord = d.doc_id WHERE length(f.text) >= 300 GROUP BY d.lang")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: boilerplate, exact duplicates, least length, then figures by language."""
    # Cleaned once: the digests, the filter and the lengths would each clean again.
    cleaned = checkpointed(cleaning.format_texts(views.pages(spark, sf_dir)).select("ord", "text"))
    kept = cleaning.long_enough(cleaning.drop_exact_duplicates(cleaned))
    langs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    return kept.join(langs, "ord").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("avg_length"))


def _cut_sql(text: str, keywords: tuple[str, ...]) -> str:
    for k in keywords:
        text = f"regexp_replace({text}, '(?s)^(.*){k}.*$', '\\1')"
    return text


_CUT_WORDS = (*vocab.CUTOFFS, "tion", " and ")


@query(f"SELECT doc_id AS ord, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_cut_sql('text', _CUT_WORDS)} AS t FROM documents)")
def text_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = cleaning.cut_texts(views.pages(spark, sf_dir), _CUT_WORDS)
    return pages.select("ord", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("SELECT doc_id AS ord FROM documents WHERE length(text) >= 300")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.long_enough(views.pages(spark, sf_dir)).select("ord")


_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_UNESCAPED = f"replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, {_UNESCAPED} AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(f"WITH t AS (SELECT page_id, {_UNESCAPED} AS t FROM pages), u AS (SELECT page_id, t, CASE WHEN t LIKE '%.' THEN left(t, length(t) - 1) ELSE t END AS s FROM t) SELECT page_id, CASE WHEN s LIKE 'The %' THEN right(s, length(s) - 4) ELSE s END AS title FROM u")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))
    return cleaning.clean_titles(pages, suffix=".", prefix="The ")


@query(f"WITH t AS (SELECT {_UNESCAPED} AS t FROM pages) SELECT round(100 * avg(CASE WHEN t LIKE '%.' OR t LIKE 'The %' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS changed_percent FROM t")
def title_change_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select(T.html_title(F.col("html")).alias("title"))
    return cleaning.title_change_share(pages, ".", "The ")


@query(f"WITH h AS (SELECT doc_id, {_STRIP.format('left(text, 1000)')} AS h FROM documents), i AS (SELECT doc_id, h, CASE WHEN instr(reverse(h), ' .') = 0 THEN -1 ELSE length(h) - instr(reverse(h), ' .') - 1 END AS stop FROM h) SELECT doc_id AS ord, CASE WHEN stop > 500 THEN left(h, stop + 1) ELSE h END AS snippet FROM i")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pages(spark, sf_dir).select("ord", T.snippet(F.col("text")).alias("snippet"))


@query(
    r"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS s, 0 AS k, CASE WHEN length(text) <= 6000 THEN length(text) END AS e FROM documents),
b AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (
  SELECT doc_id, text, n, 0::BIGINT AS s, CASE WHEN n <= 6000 THEN n WHEN n > 6000 THEN
     CASE WHEN instr(reverse(text[5601:6000]), ' .') > 0 THEN 5600 + 400 - instr(reverse(text[5601:6000]), ' .') ELSE 6000 END END AS e FROM b
  UNION ALL
  SELECT doc_id, text, n, e - 300, CASE WHEN e - 300 + 6000 < n THEN
     CASE WHEN instr(reverse(text[e - 300 + 5601:e - 300 + 6000]), ' .') > 0 THEN e - 300 + 6000 - instr(reverse(text[e - 300 + 5601:e - 300 + 6000]), ' .') ELSE e - 300 + 6000 END ELSE e - 300 + 6000 END
  FROM w WHERE n > 6000 AND e - 300 < n
),
p AS (SELECT doc_id, s, CASE WHEN n <= 6000 THEN text ELSE """
    + _STRIP.format("text[s + 1:least(e, n)]")
    + r""" END AS piece, n FROM w)
SELECT doc_id AS ord, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk, length(piece) AS n, md5(piece) AS digest FROM p WHERE n <= 6000 OR length(piece) > 50"""
)
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pages(spark, sf_dir).select("ord", F.posexplode(T.chunks(F.coalesce("text", F.lit("")))).alias("chunk", "piece"))
    return rows.select("ord", F.col("chunk").cast("long").alias("chunk"), F.length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in vocab.STOP_WORDS)
_TEXTS = "f AS (SELECT doc_id AS ord, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"
_VECTORS = rf"""tok AS (SELECT ord, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM f),
term AS (SELECT ord, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tok),
tf AS (SELECT ord, term, count(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT ord, tf.term, df, tf * (ln((1 + (SELECT count(*) FROM f)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term)),
wt AS (SELECT ord, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY ord)) AS w FROM raw)"""
_WEIGHTS = f"{_TEXTS}, {_VECTORS}"


@query(f"WITH {_WEIGHTS} SELECT ord, count(*) AS terms, round(sum(w), 4) AS weight, round(max(w), 4) AS heaviest FROM wt GROUP BY ord")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = cleaning.term_weights(cleaning.drop_exact_duplicates(views.pages(spark, sf_dir)))
    return weights.groupBy("ord").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.max("w"), 4).alias("heaviest"))


_PAIRS = """t AS (SELECT ord, term, w, sqrt(sum(w * w) OVER (PARTITION BY ord ORDER BY df DESC, term DESC ROWS UNBOUNDED PRECEDING)) AS tail FROM wt),
c AS (SELECT DISTINCT x.ord AS a, y.ord AS b FROM t x JOIN t y ON x.term = y.term AND x.ord < y.ord WHERE x.tail >= 0.95 - 1e-9 AND y.tail >= 0.95 - 1e-9),
pairs AS MATERIALIZED (SELECT a, b, sum(x.w * y.w) AS cosine FROM c JOIN wt x ON x.ord = a JOIN wt y ON y.ord = b AND x.term = y.term GROUP BY a, b HAVING sum(x.w * y.w) >= 0.95)"""
#: Page by page: one goes if an earlier one that stays is similar.
_GREEDY = """later AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM pairs GROUP BY b),
steps AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT later.k, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END FROM steps JOIN later ON later.k = steps.k + 1),
gone AS (SELECT unnest(arg_max(gone, k)) AS ord FROM steps)"""


@query(f"WITH {_WEIGHTS}, {_PAIRS} SELECT a, b, round(cosine, 4) AS cosine FROM pairs")
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = cleaning.drop_exact_duplicates(views.pages(spark, sf_dir))
    return cleaning.similar_pages(pages).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query(f"WITH RECURSIVE {_WEIGHTS}, {_PAIRS}, {_GREEDY} SELECT ord FROM f WHERE ord NOT IN (SELECT ord FROM gone)")
def similar_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_similar(cleaning.drop_exact_duplicates(views.pages(spark, sf_dir))).select("ord")


@query(
    f"""WITH RECURSIVE {_PAGES}, {_CLEAN}, {_FIRSTS}, f AS (SELECT ord, text FROM firsts), {_VECTORS}, {_PAIRS}, {_GREEDY},
kept AS (SELECT ord, url, title, {_cut_sql('text', vocab.CUTOFFS)} AS text FROM firsts WHERE ord NOT IN (SELECT ord FROM gone))
SELECT ord, url, CASE WHEN starts_with(title, 'Catégorie:') THEN right(title, length(title) - 10) ELSE title END AS title, length(text) AS n FROM kept WHERE length(text) >= 300"""
)
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_corpus(views.pages(spark, sf_dir)).select("ord", "url", "title", F.length("text").alias("n"))


# Crawl

_DOMAIN = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n, sum(CASE WHEN regexp_matches(lower({_PATH}), '\\.({'|'.join(vocab.NOT_HTML)})$') THEN 0 ELSE 1 END)::BIGINT AS html FROM pages GROUP BY ALL")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.sum(U.is_html(F.col("url")).cast("long")).alias("html"))


@query()
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", U.normalized(F.col("url")).alias("url"), U.decoded(F.col("url")).alias("decoded"))


@query(f"SELECT page_id, url FROM pages WHERE {_DOMAIN} LIKE '%.example.com' AND url NOT LIKE 'https://blog.%' AND NOT regexp_matches(lower({_PATH}), '\\.({'|'.join(vocab.NOT_HTML)})$')")
def admissible_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return crawl.admissible(pages.where(U.domain(F.col("url")).endswith(".example.com")), None, ["https://blog."])


@query(f"""SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || link AS link FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a href="(/[^"]*)"', 1)) AS link FROM pages)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(views.table(spark, sf_dir, "pages"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = crawl.parsed(views.table(spark, sf_dir, "pages"), T.main_text)
    return parsed.select("url", "title", F.length("text").alias("n"))


@query()
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from each host's smallest URL that the filter admits, over a table of pages."""
    pages = views.table(spark, sf_dir, "pages").select("url", "html")
    hosts = crawl.admissible(pages).groupBy(U.domain(F.col("url")).alias("host")).agg(F.min("url").alias("url")).where("host <> ''")
    return crawl.crawl(pages, [r.url for r in hosts.select("url").collect()])


# Entities


def _type_sql(title: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({title}), '{T.words_pattern(words)}') THEN '{kind}'" for kind, words in vocab.TYPE_RULES.items())
    return f"CASE {whens} ELSE 'UNKNOWN' END"


_IGNORED = r"regexp_matches(lower(text), '^(?:" + "|".join(vocab.IGNORED_OPENINGS) + r")(?:$|[^\p{L}\p{N}_])')"
_ENTITIES = f"""{_PAGES}, bare AS (SELECT ord, {_STRIP.format('title')} AS text, url AS source_url FROM pages_),
ent AS (SELECT ord, text, {_type_sql('text')} AS type, source_url FROM bare WHERE NOT {_IGNORED} AND length(text) BETWEEN 2 AND 200 QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY ord) = 1)"""


@query(f"WITH {_ENTITIES} SELECT ord, text, type, source_url FROM ent")
def title_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.title_entities(views.pages(spark, sf_dir))


#: Orders' keys turned into titles that every type's rules meet.
_NAMES = [w.replace("{b}.*{b}", " de la ") for words in vocab.TYPE_RULES.values() for w in words] + ["liste", "terra", "orks"]


@query(f"WITH t AS (SELECT o_orderkey, ([{', '.join(repr(n) for n in _NAMES)}])[(o_orderkey % {len(_NAMES)}) + 1] || ' ' || o_orderstatus || o_orderkey AS text FROM orders) SELECT type, count(*) AS n FROM (SELECT {_type_sql('text')} AS type FROM t WHERE NOT {_IGNORED}) GROUP BY type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % len(_NAMES) + 1).cast("int"))
    titles = views.table(spark, sf_dir, "orders").select(F.concat(name, F.lit(" "), "o_orderstatus", F.col("o_orderkey").cast("string")).alias("text"))
    typed = titles.where(~T.ignored_title(F.col("text"))).select(T.infer_type(F.col("text")).alias("type"))
    return ner.count_by_type(typed)


@query(f"WITH {_ENTITIES} SELECT ord, text FROM ent WHERE type = 'UNKNOWN' ORDER BY ord LIMIT 15")
def unknown_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.sample_unknown(ner.title_entities(views.pages(spark, sf_dir))).select("ord", "text")


@query(f"WITH {_ENTITIES} SELECT ord, ((row_number() OVER (ORDER BY ord) - 1) // 30)::BIGINT AS batch FROM ent WHERE type = 'UNKNOWN'")
def unknown_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.batches(checkpointed(ner.title_entities(views.pages(spark, sf_dir)))).select("ord", "batch")


@query(f"WITH {_ENTITIES}, h AS (SELECT url, {_STRIP.format('left(text, 1000)')} AS h FROM pages_), i AS (SELECT url, h, CASE WHEN instr(reverse(h), ' .') = 0 THEN -1 ELSE length(h) - instr(reverse(h), ' .') - 1 END AS stop FROM h) SELECT ord, text, md5(CASE WHEN stop > 500 THEN left(h, stop + 1) ELSE h END) AS digest FROM ent JOIN i ON source_url = url")
def entity_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.pages(spark, sf_dir)
    return ner.with_snippets(ner.title_entities(pages), pages).select("ord", "text", F.md5("snippet").alias("digest"))


_ANSWERS = """answers AS (SELECT (p_partkey // 10)::BIGINT AS batch, CASE WHEN p_partkey // 10 % 3 = 0 THEN 'Sure: <json_answer>' ELSE 'Here ' END || '[' || string_agg('{"name": "' || p_name || '", "type": "' || CASE p_size % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'Location' WHEN 2 THEN 'nothing' ELSE 'UNKNOWN' END || '"}', ', ' ORDER BY p_partkey) || ']' || CASE WHEN p_partkey // 10 % 3 = 0 THEN '</json_answer>' ELSE ' done' END AS raw FROM part GROUP BY p_partkey // 10)"""
_ANSWERED = f"""{_ANSWERS}, items AS (SELECT batch, unnest(from_json(regexp_extract(raw, '(?s)(\\[.*\\])', 1), '[{{"name": "VARCHAR", "type": "VARCHAR"}}]')) AS x, generate_subscripts(from_json(regexp_extract(raw, '(?s)(\\[.*\\])', 1), '[{{"name": "VARCHAR", "type": "VARCHAR"}}]'), 1) AS pos FROM answers),
given AS (SELECT lower(x.name) AS key, max_by(upper(x.type), (batch, pos)) AS type FROM items WHERE upper(x.type) IN ({', '.join(repr(t) for t in vocab.ENTITY_TYPES)}) GROUP BY 1)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers, recorded from the parts table: ten parts a batch."""
    kind = F.when(F.col("p_size") % 4 == 0, "event").when(F.col("p_size") % 4 == 1, "Location").when(F.col("p_size") % 4 == 2, "nothing").otherwise("UNKNOWN")
    item = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "type": "'), kind, F.lit('"}'))
    rows = views.table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("s")))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["s"]), ", "), F.lit("]"))
    tagged = F.col("batch") % 3 == 0
    return rows.select("batch", F.size("l").alias("size"), F.when(tagged, F.concat(F.lit("Sure: <json_answer>"), body, F.lit("</json_answer>"))).otherwise(F.concat(F.lit("Here "), body, F.lit(" done"))).alias("raw"))


@query(f"WITH {_ANSWERED} SELECT key, type FROM given")
def answered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.answered_types(_answers(spark, sf_dir))


@query(f"WITH {_ANSWERED} SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 AND coalesce(g.type, 'UNKNOWN') <> 'UNKNOWN' THEN g.type WHEN p_partkey % 2 = 0 THEN 'UNKNOWN' ELSE 'ARTIFACT' END AS type FROM part LEFT JOIN given g ON lower(p_name) = g.key")
def filled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 2 == 0, vocab.UNKNOWN).otherwise("ARTIFACT").alias("type"))
    return ner.fill_types(parts, ner.answered_types(_answers(spark, sf_dir))).select("ord", "type")


@query(f"WITH {_ANSWERS}, s AS (SELECT p_partkey // 10 AS batch, count(*) AS n FROM part GROUP BY 1) SELECT answers.batch AS batch, len(from_json(regexp_extract(raw, '(?s)(\\[.*\\])', 1), '[{{\"name\": \"VARCHAR\"}}]')) >= 0.8 * n AS accepted FROM answers JOIN s ON answers.batch = s.batch")
def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.accepted_batches(_answers(spark, sf_dir)).select("batch", "accepted")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonym groups: each nation names its customers."""
    rows = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    listed = rows.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("l"))
    return listed.select(F.col("n_nationkey").cast("long").alias("ord"), F.array(F.struct(F.col("n_name").alias("canonical"), F.concat(F.transform("l", lambda x: x["c_name"]), F.array(F.lit("Customer shared"), F.lit("no (x)"), F.lit("ab"))).alias("synonyms"))).alias("synonyms"))


_FLAT = """flat AS (SELECT n_nationkey::BIGINT AS ord, 0 AS sub, n_name AS canonical, n_name AS surface FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT n_nationkey, c_custkey + 1, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey, 1000000000, n_name, 'Customer shared' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
rev AS (SELECT lower(surface) AS key, arg_max(canonical, (ord, sub)) AS canonical FROM flat GROUP BY 1),
al AS (SELECT canonical, list_sort(list_distinct(list(surface))) AS names FROM flat GROUP BY 1)"""


@query(f"WITH {_FLAT} SELECT key, canonical FROM rev")
def synonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.reverse_map(entities.flat_synonyms(_groups(spark, sf_dir)))


@query(
    f"""WITH {_FLAT}, e AS (SELECT c_custkey AS ord, c_name AS text, CASE WHEN c_custkey % 3 = 0 THEN 'EVENT' ELSE 'CHARACTER' END AS type, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'u/' || c_custkey END AS source_url FROM customer UNION ALL SELECT 1000000000 + s_suppkey, s_name, 'ORGANIZATION', 's/' || s_suppkey FROM supplier),
h AS (SELECT e.*, canonical FROM e LEFT JOIN rev ON lower(text) = key),
k AS (SELECT coalesce(canonical, text) AS text, canonical IS NOT NULL AS known, arg_min(type, ord) AS type, arg_min(source_url, ord) AS fu, arg_min(source_url, ord) FILTER (source_url <> '') AS u FROM h GROUP BY 1, 2)
SELECT coalesce(k.text, al.canonical) AS text, coalesce(type, 'CONCEPT') AS type, coalesce(CASE WHEN known THEN u ELSE fu END, '') AS source_url,
       len(coalesce(list_filter(names, lambda x: x <> coalesce(k.text, al.canonical)), [])) AS n_aliases, array_to_string(coalesce(list_filter(names, lambda x: x <> coalesce(k.text, al.canonical)), []), '|') AS aliases
FROM k FULL JOIN al ON k.text = al.canonical AND known"""
)
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    named = c.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 3 == 0, "EVENT").otherwise("CHARACTER").alias("type"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("u/"), F.col("c_custkey").cast("string"))).alias("source_url"))
    others = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000000).alias("ord"), F.col("s_name").alias("text"), F.lit("ORGANIZATION").alias("type"), F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("source_url"))
    merged = entities.merge_entities(named.unionByName(others), _groups(spark, sf_dir))
    return merged.select("text", "type", "source_url", F.size("aliases").cast("long").alias("n_aliases"), F.array_join("aliases", "|").alias("aliases"))


@query()
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with their last letter changed, resolved against the right ones."""
    names = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    mapping = entities.canonical_map(names.select(F.col("text").alias("ord"), "text", F.array().cast("array<string>").alias("aliases")))
    asked = names.select(F.concat(F.left("text", F.length("text") - 1), F.lit("x")).alias("name")).union(names.select(F.upper("text")))
    return entities.resolve_names(asked, mapping)


# Relations

_MENTIONS = """m AS (SELECT l_orderkey * 10 + l_linenumber AS ord, s_name AS source, CASE l_returnflag WHEN 'A' THEN 'CONTROLE' WHEN 'R' THEN 'MANIE' ELSE 'A_CREE' END AS relation, p_name AS target, 'order/' || l_orderkey AS url
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
_MERGED = f"{_MENTIONS}, merged AS (SELECT arg_min(source, ord) AS source, relation, arg_min(target, ord) AS target, count(*) AS frequency, list_distinct(list(url)) AS urls, min(ord) AS ord FROM m GROUP BY lower(source), relation, lower(target))"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.merge_relations(relations.valid_relations(views.mentions(spark, sf_dir)))


@query(f"WITH {_MENTIONS} SELECT ord, source, relation, target FROM m")
def valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.valid_relations(views.mentions(spark, sf_dir)).select("ord", "source", "relation", "target")


@query(f"WITH {_MENTIONS} SELECT relation, count(*) AS n FROM m GROUP BY relation")
def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relation_histogram(relations.valid_relations(views.mentions(spark, sf_dir)))


@query(
    """WITH a AS (SELECT 'order/' || l_orderkey AS url, l_linenumber::BIGINT AS chunk, s_name AS source, CASE l_returnflag WHEN 'A' THEN 'CONTROLE' WHEN 'R' THEN 'MANIE' ELSE 'A_CREE' END AS relation, p_brand AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT url, min(chunk) AS chunk, source, relation, target FROM a GROUP BY url, source, relation, target"""
)
def parsed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers recorded from line items in each of the three forms, parsed and deduplicated by page."""
    l, s, p = (views.table(spark, sf_dir, n) for n in ("lineitem", "supplier", "part"))  # noqa: E741
    code = F.when(F.col("l_returnflag") == "A", "CONTROLE").when(F.col("l_returnflag") == "R", "manie ").otherwise("A_CREE")
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    body = F.concat(F.lit('[{"source": "'), "s_name", F.lit('", "relation": "'), code, F.lit('", "target": " '), "p_brand", F.lit(' "}, {"source": "x", "relation": "AIME", "target": "y"}]'))
    form = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("ok <json_answer>"), body, F.lit("</json_answer> bye"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Found: "), body, F.lit(".")))
    answers = rows.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("url"), F.col("l_linenumber").cast("long").alias("chunk"), form.alias("raw"))
    return relations.doc_relations(answers).select("url", "chunk", "source", "relation", "target")


@query(f"WITH {_MERGED} SELECT source, relation, target, frequency, ord, len(urls) AS n_urls FROM merged")
def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("source", "relation", "target", "frequency", "ord", F.size("source_urls").cast("long").alias("n_urls"))


_KNOWN = "known AS (SELECT lower(s_name) AS name FROM supplier UNION SELECT DISTINCT lower(p_name) FROM part)"


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("text")).union(views.table(spark, sf_dir, "part").select("p_name"))
    return relations.confirm(_merged(spark, sf_dir), relations.known_names(names))


@query(f"WITH {_MERGED}, {_KNOWN} SELECT ord, frequency, lower(source) IN (SELECT name FROM known) AND lower(target) IN (SELECT name FROM known) AS confirmed_by_ner FROM merged")
def confirmed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.by_frequency(_confirmed(spark, sf_dir)).select("ord", "frequency", "confirmed_by_ner")


@query(f"WITH {_MERGED}, {_KNOWN} SELECT count(*) AS relations, round(100 * avg((lower(source) IN (SELECT name FROM known) AND lower(target) IN (SELECT name FROM known))::INT), 2) AS confirmed_percent, sum((frequency > 1)::INT)::BIGINT AS repeated FROM merged")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.merge_report(_confirmed(spark, sf_dir))


_CANON = f"""{_MERGED}, canon AS (SELECT arg_min(source, ord) AS source, relation, arg_min(target, ord) AS target, sum(frequency)::BIGINT AS frequency, list_distinct(flatten(list(urls))) AS urls, min(ord) AS ord
  FROM (SELECT 'Nation ' || s_nationkey AS source, relation, target, frequency, urls, ord FROM merged JOIN supplier ON merged.source = s_name) GROUP BY lower(source), relation, lower(target))"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged relations whose suppliers are resolved to their nation."""
    merged = _merged(spark, sf_dir)
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("canonical"))
    p = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("canonical")).distinct()
    return relations.canonicalize(merged, s.union(p))


@query(f"WITH {_CANON} SELECT source, relation, target, frequency, len(urls) AS n_urls, list_min(urls) AS first_url FROM canon")
def canonical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("source", "relation", "target", "frequency", F.size("source_urls").cast("long").alias("n_urls"), F.element_at("source_urls", 1).alias("first_url"))


_NAMED = "named AS (SELECT DISTINCT p_name AS text, CASE WHEN length(p_name) % 2 = 0 THEN 'ARTIFACT' ELSE 'EVENT' END AS type FROM part)"
_PROJECT = f"{_CANON}, {_NAMED}, used AS (SELECT source AS text FROM canon UNION SELECT target FROM canon), proj AS (SELECT u.text, coalesce(n.type, 'CONCEPT') AS type, CASE WHEN n.text IS NULL THEN '{vocab.PLACEHOLDER_DESCRIPTION}' ELSE '' END AS description FROM used u LEFT JOIN named n USING (text))"


def _projected(spark: SparkSession, sf_dir: str, canonical: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    named = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct().select("text", F.when(F.length("text") % 2 == 0, "ARTIFACT").otherwise("EVENT").alias("type"), F.lit("").alias("description"), none.alias("source_urls"), none.alias("aliases"))
    return relations.project_entities(canonical, named)


@query(f"WITH {_PROJECT} SELECT text, type, description FROM proj")
def projected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, _canonical(spark, sf_dir)).select("text", "type", "description")


_SUPPORT = """ends AS (SELECT source AS name, urls FROM canon UNION ALL SELECT target, urls FROM canon),
support AS (SELECT a.name, mentions, sources FROM (SELECT name, count(*) AS mentions FROM ends GROUP BY 1) a JOIN (SELECT name, count(DISTINCT url) AS sources FROM (SELECT name, unnest(urls) AS url FROM ends) GROUP BY 1) b USING (name))"""


@query(f"WITH {_CANON}, {_SUPPORT} SELECT name, mentions, sources FROM support")
def name_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.name_support(_canonical(spark, sf_dir))


_VALID = f"{_PROJECT}, {_SUPPORT}, valid AS (SELECT name FROM support JOIN proj ON name = text WHERE mentions >= CASE type WHEN 'EVENT' THEN 2 WHEN 'ARTIFACT' THEN 4 ELSE 10 END * 10 AND sources >= CASE type WHEN 'EVENT' THEN 2 WHEN 'ARTIFACT' THEN 3 ELSE 5 END)"
#: The thresholds, with mentions ten times as high: the supplied relations are dense.
_RAISED = {t: (10 * m, s) for t, (m, s) in vocab.THRESHOLDS.items()}


def _filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    canonical = checkpointed(_canonical(spark, sf_dir))
    before = _projected(spark, sf_dir, canonical)
    return before, *relations.filter_quality(before, canonical, _RAISED)


@query(f"WITH {_VALID} SELECT text, type FROM proj WHERE text IN (SELECT name FROM valid)")
def quality_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)[1].select("text", "type")


@query(f"WITH {_VALID} SELECT source, relation, target, frequency FROM canon WHERE source IN (SELECT name FROM valid) AND target IN (SELECT name FROM valid)")
def quality_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)[2].select("source", "relation", "target", "frequency")


@query(f"WITH {_VALID} SELECT type, count(*) AS before, sum((text IN (SELECT name FROM valid))::INT)::BIGINT AS after FROM proj GROUP BY type")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, _ = _filtered(spark, sf_dir)
    return relations.type_counts(before, after)


# The graph

_SLUG = r"regexp_replace(regexp_replace(translate(lower({0}), 'éèêëàâäùûüôöîïç', 'eeeeaaauuuooiic'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT doc_id AS ord, {_SLUG.format(_STRIP.format('split_part(text, chr(46), 1)'))} AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pages(spark, sf_dir).select("ord", T.slug(F.col("title")).alias("slug"))


_MAPPED = f"SELECT n_nationkey AS ord, 'location_' || {_SLUG.format('n_name')} AS eid, n_name, c FROM nation LEFT JOIN (SELECT c_nationkey, list(c_name ORDER BY c_custkey) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"


@query(f"WITH e AS ({_MAPPED}), k AS (SELECT ord, eid, 0 AS pos, lower(n_name) AS key FROM e UNION ALL SELECT ord, eid, 1, lower(unnest(c)) FROM e UNION ALL SELECT ord, eid, 2, 'shared' FROM e) SELECT key, arg_max(eid, (ord, pos)) AS eid FROM k GROUP BY key")
def entity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("c"))
    n = views.table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    aliases = F.concat(F.coalesce("c", F.array().cast("array<string>")), F.array(F.lit("Shared")))
    return graph.entity_mapping(n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text"), F.lit("LOCATION").alias("type"), aliases.alias("aliases")))


@query(f"SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT DISTINCT s, p, o FROM (SELECT '{vocab.DATA}artifact_' || {_SLUG.format('p_name')} AS s, unnest(['type', 'name', 'description']) AS p, unnest(['Artifact', p_name, p_type]) AS o FROM part) ) GROUP BY p")
def entity_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.lit("ARTIFACT").alias("type"), F.col("p_type").alias("description"))
    return graph.entity_triples(parts).groupBy(F.substring_index("p", "#", -1).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


@query("SELECT 12::BIGINT AS n, 5::BIGINT AS classes_and_properties, 3::BIGINT AS labels")
def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = graph.ontology(spark)
    return o.agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("s") - 1).alias("classes_and_properties"), F.sum((F.col("o_kind") == "literal").cast("long")).alias("labels"))


@query(
    """WITH e AS (SELECT s_suppkey AS ord, lower(s_name) AS key, 'organization_' || regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS eid FROM supplier),
q AS (SELECT DISTINCT name, lower(name) AS q FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT right(s_name, 4) FROM supplier UNION ALL SELECT s_name || ' of ' || s_nationkey FROM supplier UNION ALL SELECT n_name FROM nation))
SELECT name, coalesce(any_value(x.eid), arg_min(y.eid, y.ord)) AS eid FROM q LEFT JOIN e x ON x.key = q LEFT JOIN e y ON contains(y.key, q) OR contains(q, y.key) GROUP BY name HAVING coalesce(any_value(x.eid), arg_min(y.eid, y.ord)) IS NOT NULL"""
)
def resolved_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier")
    names = s.select(F.col("s_name").alias("name")).union(s.select(F.right("s_name", F.lit(4)))).union(s.select(F.concat("s_name", F.lit(" of "), F.col("s_nationkey").cast("string")))).union(views.table(spark, sf_dir, "nation").select("n_name"))
    return graph.resolve_ends(names, s.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text"), F.lit("ORGANIZATION").alias("type")))


@query(f"WITH {_MERGED} SELECT DISTINCT 'organization_' || {_SLUG.format('source')} AS s, CASE relation WHEN 'CONTROLE' THEN 'controls' WHEN 'MANIE' THEN 'wields' ELSE 'createdBy' END AS p, 'artifact_' || {_SLUG.format('target')} AS o FROM merged")
def relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.named_entities(spark, sf_dir)
    resolved = known.select(F.col("text").alias("name"), graph.entity_id(F.col("text"), F.col("type")).alias("eid"))
    return graph.relation_triples(_merged(spark, sf_dir), resolved, "", "").select("s", "p", "o")


@query(f"WITH x AS (SELECT 'artifact_' || {_SLUG.format('replace(p_name, p_name[1:2], chr(45))')} AS eid, p_name FROM part) SELECT eid, count(DISTINCT p_name) AS names FROM x GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select("p_name", F.replace(F.col("p_name"), F.left("p_name", F.lit(2)), F.lit("-")).alias("text"), F.lit("ARTIFACT").alias("type"))
    return parts.groupBy(graph.entity_id(F.col("text"), F.col("type")).alias("eid")).agg(F.countDistinct("p_name").alias("names")).where("names > 1")


def _edge_sql(source: str, a: str, ka: str, p: str, b: str, kb: str) -> str:
    return f"SELECT '{a}_' || {ka} AS s, '{p}' AS p, '{b}_' || {kb} AS o FROM {source}"


_STAR = (
    "sup AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), fst AS (SELECT l_partkey, min(l_suppkey) AS first FROM sup GROUP BY 1), g0 AS ("
    + " UNION ".join(
        [
            _edge_sql("customer", "character_customer", "c_custkey", "memberOf", "organization_nation", "c_nationkey"),
            _edge_sql("nation", "organization_nation", "n_nationkey", "subgroupOf", "faction_region", "n_regionkey"),
            _edge_sql("(SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1)", "character_customer", "c_custkey", "leads", "organization_nation", "c_nationkey"),
            _edge_sql("orders", "character_customer", "o_custkey", "participatedIn", "event_order", "o_orderkey"),
            _edge_sql("lineitem JOIN supplier ON l_suppkey = s_suppkey", "event_order", "l_orderkey", "tookPlaceAt", "location_nation", "s_nationkey"),
            _edge_sql("(SELECT x.s_suppkey AS k1, y.s_suppkey AS k2 FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey // 8 = y.s_suppkey // 8 AND x.s_suppkey < y.s_suppkey)", "organization_supplier", "k1", "allyOf", "organization_supplier", "k2"),
            _edge_sql("sup JOIN fst USING (l_partkey) WHERE l_suppkey <> first", "organization_supplier", "l_suppkey", "enemyOf", "organization_supplier", "first"),
            _edge_sql("sup", "organization_supplier", "l_suppkey", "controls", "artifact_part", "l_partkey"),
        ]
    )
    + ")"
)
_RULE_SQL = {
    "symmetric_enemy": "SELECT o AS s, 'enemyOf' AS p, s AS o FROM {g} WHERE p = 'enemyOf' AND s <> o",
    "symmetric_ally": "SELECT o AS s, 'allyOf' AS p, s AS o FROM {g} WHERE p = 'allyOf' AND s <> o",
    "participant_place": "SELECT a.s, 'wasAt' AS p, b.o FROM {g} a JOIN {g} b ON a.o = b.s WHERE a.p = 'participatedIn' AND b.p = 'tookPlaceAt'",
    "member_of_parent": "SELECT a.s, 'memberOf' AS p, b.o FROM {g} a JOIN {g} b ON a.o = b.s WHERE a.p = 'memberOf' AND b.p = 'subgroupOf'",
    "leader_member": "SELECT s, 'memberOf' AS p, o FROM {g} WHERE p = 'leads'",
    "ally_enemy": "SELECT a.s, 'enemyOf' AS p, b.o FROM {g} a JOIN {g} b ON a.o = b.s WHERE a.p = 'allyOf' AND b.p = 'enemyOf' AND a.s <> b.o",
    "leader_place": "SELECT a.o AS s, 'locatedIn' AS p, b.o FROM {g} a JOIN {g} b ON a.s = b.s WHERE a.p = 'leads' AND b.p = 'wasAt'",
}
_EXPANDED = _STAR + "".join(f", g{i} AS MATERIALIZED (SELECT * FROM g{i - 1} UNION ({sql.format(g=f'g{i - 1}')}))" for i, sql in enumerate(_RULE_SQL.values(), 1))


def _rule_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = views.star_graph(spark, sf_dir)
        if name == "leader_place":
            star = rules.union_graphs(star, rules.new_triples(star, rules.standard_rules()["participant_place"]))
        found = rules.new_triples(star, rules.standard_rules()[name])
        return found.select(*[F.substring_index(c, "#", -1).alias(c) for c in ("s", "p", "o")])

    run.__name__ = f"rule_{name}"
    base = _STAR + (f", g1 AS (SELECT * FROM g0 UNION ({_RULE_SQL['participant_place'].format(g='g0')}))" if name == "leader_place" else ", g1 AS (SELECT * FROM g0)")
    query(f"WITH {base} {_RULE_SQL[name].format(g='g1')} EXCEPT SELECT * FROM g1")(run)


for _name in _RULE_SQL:
    _rule_query(_name)


@query(f"WITH {_STAR} SELECT p AS property, count(*) AS n FROM g0 GROUP BY p")
def graph_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.property_histogram(views.star_graph(spark, sf_dir))


@query(f"WITH {_EXPANDED} SELECT p AS property, count(*) AS n FROM g7 GROUP BY p")
def expanded_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded, _ = rules.expand(checkpointed(views.star_graph(spark, sf_dir)))
    return rules.property_histogram(expanded)


_WHOLE = f"{_STAR}, tn AS (SELECT 'organization_nation_' || n_nationkey AS s, 'Organization' AS c, n_name AS name FROM nation UNION ALL SELECT 'faction_region_' || r_regionkey, 'Faction', r_name FROM region), g AS (SELECT * FROM g0 UNION ALL SELECT s, 'type', c FROM tn UNION ALL SELECT s, 'name', name FROM tn)"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.union_graphs(views.star_graph(spark, sf_dir), views.typed_names(spark, sf_dir))


@query(f"WITH {_WHOLE}, d AS (SELECT s, count(*) AS d FROM g WHERE s IN (SELECT s FROM tn) GROUP BY s), t AS (SELECT s, d FROM d ORDER BY d DESC, s LIMIT 1) SELECT (SELECT count(*) FROM g) AS total_triples, (SELECT count(*) FROM d) AS total_entities, (SELECT round(avg(d), 2) FROM d) AS avg_degree, (SELECT name FROM tn JOIN t USING (s)) AS most_connected, (SELECT d FROM t) AS most_connected_degree")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.graph_stats(_whole(spark, sf_dir))


@query("SELECT 'Organization' AS class, count(*) AS n FROM nation UNION ALL SELECT 'Faction', count(*) FROM region")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.class_histogram(_whole(spark, sf_dir))


@query(f"WITH {_STAR}, n AS (SELECT s AS uri FROM g0 UNION ALL SELECT o FROM g0) SELECT uri, count(*) AS freq FROM n GROUP BY uri")
def node_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_frequency(views.star_graph(spark, sf_dir)).select(F.substring_index("uri", "#", -1).alias("uri"), "freq")


_QUEUE = f"{_WHOLE}, n AS (SELECT s AS uri FROM g UNION ALL SELECT o FROM g WHERE p NOT IN ('type', 'name')), queue AS (SELECT uri, name, upper(c) AS type, count(*) AS freq FROM n JOIN tn ON uri = s GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {_QUEUE} SELECT uri, name, type, freq FROM queue ORDER BY CASE type WHEN 'FACTION' THEN 1 ELSE 99 END, freq DESC, uri LIMIT 20")
def alignment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.alignment_queue(_whole(spark, sf_dir), most=20)
    return found.select(F.substring_index("uri", "#", -1).alias("uri"), "name", "type", "freq")


_CANDIDATES = """cand AS (SELECT n_name AS label, CASE WHEN n_nationkey % 3 = 0 THEN 'en' ELSE l END AS lang, pos, 'Q' || (n_nationkey * 10 + pos) AS qid, CASE WHEN pos = 1 THEN 'Old ' || n_name ELSE lower(n_name) END AS cand_label, CASE (n_nationkey + pos) % 3 WHEN 0 THEN 'A world of the Imperium' WHEN 1 THEN 'A town' ELSE NULL END AS description
  FROM nation, (VALUES ('fr', 1), ('fr', 2), ('en', 3)) v(l, pos))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates recorded from the nations."""
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.inline(F.array(*[F.struct(F.lit(lang).alias("l"), F.lit(pos).alias("pos")) for lang, pos in (("fr", 1), ("fr", 2), ("en", 3))])))
    told = (F.col("n_nationkey") + F.col("pos")) % 3
    return n.select(
        F.col("n_name").alias("label"),
        F.when(F.col("n_nationkey") % 3 == 0, "en").otherwise(F.col("l")).alias("lang"),
        "pos",
        F.concat(F.lit("Q"), (F.col("n_nationkey") * 10 + F.col("pos")).cast("string")).alias("qid"),
        F.when(F.col("pos") == 1, F.concat(F.lit("Old "), "n_name")).otherwise(F.lower("n_name")).alias("cand_label"),
        F.when(told == 0, "A world of the Imperium").when(told == 1, "A town").alias("description"),
    )


_BEST = f"""{_QUEUE}, {_CANDIDATES}, f AS (SELECT uri, name, cand.*, CASE lang WHEN 'fr' THEN 1 ELSE 2 END AS r FROM queue JOIN cand ON name = label),
k AS (SELECT * FROM f QUALIFY r = min(r) OVER (PARTITION BY uri)),
sc AS (SELECT uri, qid, pos, least((CASE WHEN lower(name) = lower(cand_label) THEN 5 WHEN contains(lower(cand_label), lower(name)) THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(description, '')), 'imperium') THEN 4 ELSE 0 END) / 10.0, 1.0)::DOUBLE AS score FROM k)"""


@query(f"WITH {_BEST} SELECT uri, qid, round(score, 2) AS score FROM sc")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.candidates_with_fallback(graph.alignment_queue(_whole(spark, sf_dir)), _candidates(spark, sf_dir))
    score = graph.confidence(F.col("name"), F.col("cand_label"), F.col("description"))
    return found.select(F.substring_index("uri", "#", -1).alias("uri"), "qid", F.round(score, 2).alias("score"))


@query(f"WITH {_BEST}, b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY uri ORDER BY score DESC, pos) = 1) SELECT uri, unnest(['sameAs', 'wikidataId', 'alignmentScore']) AS p, unnest(['{vocab.WIKIDATA}' || qid, qid, score::VARCHAR]) AS o FROM b WHERE score >= 0.75")
def alignment_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.candidates_with_fallback(graph.alignment_queue(_whole(spark, sf_dir)), _candidates(spark, sf_dir))
    made = graph.alignment_triples(graph.best_candidates(found))
    return made.select(F.substring_index("s", "#", -1).alias("uri"), F.substring_index("p", "#", -1).alias("p"), "o")


# Datasets and vectors


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.learnable(views.star_graph(spark, sf_dir))


@query(f"WITH {_STAR} SELECT s AS head, p AS relation, o AS tail FROM g0")
def kge_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir)


@query(f"WITH {_WHOLE} SELECT sum((p IN ('type', 'name'))::INT)::BIGINT AS other_property, 0::BIGINT AS other_end, sum((p NOT IN ('type', 'name'))::INT)::BIGINT AS kept FROM g")
def kge_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.skipped(_whole(spark, sf_dir))


@query(f"WITH {_STAR}, e AS (SELECT s FROM g0 UNION SELECT o FROM g0) SELECT (SELECT count(*) FROM g0) AS triples, (SELECT count(DISTINCT p) FROM g0) AS relations, (SELECT count(*) FROM e) AS entities")
def kge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dataset_stats(_dataset(spark, sf_dir))


@query(f"WITH {_STAR} SELECT p AS relation, count(*) AS n FROM g0 GROUP BY p ORDER BY n DESC, relation LIMIT 10")
def kge_top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_relations(_dataset(spark, sf_dir))


@query(f"WITH {_STAR}, r AS (SELECT p, count(*) AS n, (SELECT count(*) FROM g0) AS t FROM g0 GROUP BY p) SELECT p AS relation, CASE WHEN t <= 5000 THEN n ELSE least(n, greatest(1, floor(n * 5000 / t)))::BIGINT END AS n FROM r")
def kge_subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of each relation in a subset of 5,000: quotas, as the hash order is the engine's own."""
    return sampling.stratified_subset(_dataset(spark, sf_dir), 5000).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STAR}, r AS (SELECT p, count(*) AS n FROM g0 GROUP BY p), q AS (SELECT p, n, CASE WHEN n < 3 THEN 0 ELSE greatest(1, n // 10) END AS k FROM r) SELECT p AS relation, split, c AS n FROM (SELECT p, unnest(['train', 'valid', 'test']) AS split, unnest([n - 2 * k, k, k])::BIGINT AS c FROM q) WHERE c > 0")
def kge_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_dataset(spark, sf_dir)).groupBy("relation", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STAR}, e AS (SELECT s AS label FROM g0 UNION SELECT o FROM g0) SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS id, label FROM e")
def kge_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.id_map(sampling.entity_labels(checkpointed(_dataset(spark, sf_dir))))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The supplied vectors as entities, the first of each label as its relation."""
    v = views.table(spark, sf_dir, "embeddings").where("embedding is not null")
    e = v.select(F.col("vec_id").cast("int").alias("id"), F.concat(F.lit("entity_"), F.col("vec_id").cast("string")).alias("label"), F.col("embedding").cast("array<float>").alias("re"), F.array().cast("array<float>").alias("im"))
    r = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("re")).select(F.col("label").cast("int").alias("id"), F.concat(F.lit("relation_"), F.col("label").cast("string")).alias("label"), F.col("re").cast("array<float>").alias("re"), F.array().cast("array<float>").alias("im"))
    return e, r


_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"WITH v AS (SELECT vec_id, embedding AS e, sqrt({_COS.format('embedding', 'embedding')}) + 1e-8 AS n FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, {_COS.format('q.e', 'v.e')} / (q.n * v.n) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) SELECT query, id, round(cosine, 4) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)::INT AS rank FROM s) WHERE rank <= 5")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return kge.nearest(v.where("id % 100 = 0").select("id"), v).select("query", "id", F.round("cosine", 4).alias("cosine"), "rank")


_L1 = "-list_sum(list_transform(list_zip(a.e, r.e, b.e), lambda x: abs(x[1]::DOUBLE + x[2]::DOUBLE - x[3]::DOUBLE)))"
_SCORED = f"""v AS (SELECT vec_id AS id, label, embedding AS e FROM embeddings), rel AS (SELECT label AS id, arg_min(e, id) AS e FROM v GROUP BY label),
q AS (SELECT id AS h, label AS r FROM v WHERE id % 100 = 0), sc AS (SELECT h, r, b.id AS t, {_L1} AS score FROM q JOIN v a ON a.id = h JOIN rel r ON r.id = q.r, v b)"""


def _tail_queries(entities_: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0 and label is not null")
    return v.select(F.col("vec_id").cast("int").alias("h"), F.col("label").cast("int").alias("r"))


@query(f"WITH {_SCORED} SELECT h::INT AS h, r::INT AS r, rank, t::INT AS t, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY h, r ORDER BY score DESC, t)::INT AS rank FROM sc) WHERE rank <= 5")
def predicted_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = _vectors(spark, sf_dir)
    return kge.predict_tails(_tail_queries(e, spark, sf_dir), e, r).select("h", "r", "rank", "t", F.round("score", 4).alias("score"))


@query(f"WITH {_SCORED}, t AS (SELECT h, r, t, score FROM sc WHERE t = (h + 7) % (SELECT count(*) FROM v)), rk AS (SELECT x.h, 1 + sum((y.score > x.score)::INT) + sum((y.score = x.score AND y.t <> x.t)::INT) / 2 AS rank FROM t x JOIN sc y ON x.h = y.h AND x.r = y.r WHERE y.t = x.t OR y.t <> (x.h + 1) % (SELECT count(*) FROM v) GROUP BY x.h) SELECT round(avg(1 / rank), 6) AS mrr, avg((rank <= 1)::INT)::DOUBLE AS hits1, avg((rank <= 3)::INT)::DOUBLE AS hits3, avg((rank <= 10)::INT)::DOUBLE AS hits10 FROM rk")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = _vectors(spark, sf_dir)
    asked, n = _tail_queries(e, spark, sf_dir), e.count()
    test, known = (asked.select("h", "r", ((F.col("h") + d) % n).cast("int").alias("t")) for d in (7, 1))
    found = kge.ranking_metrics(kge.tail_ranks(test, test.union(known), e, r))
    return found.select(F.round("mrr", 6).alias("mrr"), "hits1", "hits3", "hits10")


_ROTATED = "-list_sum(list_transform(range(1, 33), lambda i: sqrt(pow(a.e[i]::DOUBLE * r.e[i] - a.e[i + 32]::DOUBLE * r.e[i + 32] - b.e[i], 2) + pow(a.e[i]::DOUBLE * r.e[i + 32] + a.e[i + 32]::DOUBLE * r.e[i] - b.e[i + 32], 2))))"


@query(f"WITH {_SCORED.replace(_L1, _ROTATED)} SELECT h::INT AS h, r::INT AS r, rank, t::INT AS t, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY h, r ORDER BY score DESC, t)::INT AS rank FROM sc) WHERE rank <= 5")
def rotation_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' halves as real and imaginary parts."""
    e, r = _vectors(spark, sf_dir)
    halves = lambda df: df.select("id", "label", F.slice("re", 1, 32).alias("re"), F.slice("re", 33, 32).alias("im"))
    return kge.predict_tails(_tail_queries(e, spark, sf_dir), halves(e), halves(r)).select("h", "r", "rank", "t", F.round("score", 4).alias("score"))


@query()
def vector_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kge.plane(views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


#: The trainer's settings for the queries; rows are not cut, dimensions and epochs are parameters.
_QUICK = {"dim": 32, "epochs": 8, "rate": 0.02, "batch": 1024}


def _trained(spark: SparkSession, sf_dir: str, config: kge.Config) -> DataFrame:
    edges = written(sampling.stratified_split(_dataset(spark, sf_dir)))
    e, r, facts = kge.train(edges, config)
    ids = e.select("id", "label"), r.select("id", "label")
    known = sampling.numbered(edges, *ids)
    test = sampling.numbered(edges.where("split = 'test'"), *ids)
    metrics = kge.ranking_metrics(kge.tail_ranks(test, known, e, r))
    return metrics.select(F.lit(config.model).alias("model"), "mrr", "hits1", "hits3", "hits10", F.lit(facts["n_entities"]).alias("n_entities"), F.lit(facts["n_relations"]).alias("n_relations"))


@query()
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models of the whole star graph, ranked against all known triples."""
    one, two = (_trained(spark, sf_dir, replace(config, **_QUICK)) for config in (kge.TRANSE, kge.ROTATE))
    return one.unionByName(two)


# Questions

_WORDS = ["the", "tion", "er"]


@query(f"WITH c AS (SELECT conv_id, turn, lower(text) AS t, role FROM conversations) SELECT conv_id, turn, (contains(t, 'the')::INT + contains(t, 'tion')::INT + contains(t, 'er')::INT) / 3.0::DOUBLE AS keyword_score, 1 - contains(t, 'password')::INT::DOUBLE AS forbidden_score FROM c WHERE role = 'assistant'")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = views.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", qa.keyword_score(F.col("text"), F.array(*map(F.lit, _WORDS))).alias("keyword_score"), qa.forbidden_score(F.col("text"), F.array(F.lit("password"))).alias("forbidden_score"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs: their roles as calls, their texts as the response."""
    c = views.table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    events = c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "function_call").otherwise("message").alias("type"), F.when(F.col("turn") % 4 == 0, "link").otherwise("predict").alias("name"), "text")
    runs = qa.collect_stream(events)
    return runs.select("case_id", "observed", "response", (F.col("case_id") % 7).cast("double").alias("latency_s"), none.alias("errors"), F.array(F.lit("link"), F.lit("predict")).alias("expected_tools"), F.array(*map(F.lit, _WORDS)).alias("expected_keywords"), F.array(F.lit("password")).alias("forbidden_keywords"))


_RUN_SQL = """e AS (SELECT conv_id AS case_id, list(CASE WHEN turn % 4 = 0 THEN 'link' ELSE 'predict' END ORDER BY turn) FILTER (role = 'user') AS obs, lower(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '')) AS t FROM conversations GROUP BY 1),
s AS (SELECT case_id, (case_id % 7)::DOUBLE AS latency_s, CASE WHEN list_position(obs, 'link') IS NULL THEN (CASE WHEN list_contains(obs, 'predict') THEN 0.5 ELSE 0 END) WHEN list_contains(obs[list_position(obs, 'link') + 1:], 'predict') THEN 1 ELSE 0.5 END::DOUBLE AS tool_call_score,
 (contains(t, 'the')::INT + contains(t, 'tion')::INT + contains(t, 'er')::INT) / 3.0::DOUBLE AS keyword_score, 1 - contains(t, 'password')::INT::DOUBLE AS forbidden_keyword_score FROM e),
v AS (SELECT *, tool_call_score >= 1 AND keyword_score >= 0.6 AND forbidden_keyword_score >= 1 AS passed FROM s)"""


@query(f"WITH {_RUN_SQL} SELECT case_id, passed, tool_call_score, round(keyword_score, 6) AS keyword_score, forbidden_keyword_score FROM v")
def evaluated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.evaluate(_runs(spark, sf_dir)).select("case_id", "passed", "tool_call_score", F.round("keyword_score", 6).alias("keyword_score"), "forbidden_keyword_score")


@query(f"WITH {_RUN_SQL} SELECT count(*) AS cases, sum(passed::INT)::BIGINT AS passed, round(avg(passed::INT), 4) AS pass_rate, round(avg(tool_call_score), 4) AS mean_tool_call_score, round(avg(keyword_score), 4) AS mean_keyword_score, round(avg(forbidden_keyword_score), 4) AS mean_forbidden_keyword_score, round(avg(latency_s), 4) AS mean_latency_s FROM v")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.summarize(qa.evaluate(_runs(spark, sf_dir)))


@query()
def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names, one letter wrong in some, linked to the mapping of customers and nations."""
    asked = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.left("n_name", F.length("n_name") - 1), F.lit("#"))).alias("name"))
    return qa.link_entities(asked, entity_mapping(spark, sf_dir))


@query()
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each hundredth vector's entity, linked by name and answered by tails."""
    e, r = _vectors(spark, sf_dir)
    mapping = e.select(F.replace(F.col("label"), F.lit("_"), F.lit(" ")).alias("key"), F.col("label").alias("eid"))
    asked = views.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit(" Entity "), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("relation_"), F.col("label").cast("string")).alias("relation"))
    return qa.answer(asked, mapping, e, r)


@query(f"WITH {_RUN_SQL} SELECT case_id, len(coalesce(obs, [])) AS calls, length(t) AS n, tool_call_score FROM s JOIN e USING (case_id)")
def tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return runs.select("case_id", F.size("observed").cast("long").alias("calls"), F.length(F.lower("response")).cast("long").alias("n"), qa.tool_score(F.col("observed"), F.col("expected_tools")).alias("tool_call_score"))


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:25], chr(10))) AS digest, 'show(' || lang || ')' AS call FROM documents")
def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(qa.shown_output(F.col("text"))).alias("digest"), qa.shown_call(F.lit("show"), F.col("lang")).alias("call"))


@query("SELECT model, CASE WHEN model = 'm1' THEN printf('%.4f', 0.25) ELSE 'N/A' END AS small, printf('%.4f', CASE WHEN model = 'm1' THEN 0.5 ELSE 0.125 END) AS whole FROM (VALUES ('m1'), ('m2')) v(model)")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([("m1", "small", 0.25), ("m1", "whole", 0.5), ("m2", "whole", 0.125)], "model string, size string, mrr double")
    return kge.comparison(runs, ["small", "whole"])


@query(f"WITH {_STAR}, e AS (SELECT s AS x FROM g0 UNION SELECT o FROM g0) SELECT CASE WHEN split_part(x, '_', 1) IN ('character', 'faction', 'location', 'event') THEN split_part(x, '_', 1) ELSE 'concept' END AS type, count(*) AS n FROM e GROUP BY 1")
def slug_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = sampling.entity_labels(_dataset(spark, sf_dir)).distinct()
    return labels.groupBy(kge.type_of_slug(F.col("label"), ("character", "faction", "location", "event")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id::INT AS id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def real_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _vectors(spark, sf_dir)
    halves = e.select("id", F.slice("re", 1, 32).alias("re"), F.slice("re", 33, 32).alias("im"))
    return kge.as_real(halves).select("id", F.size("re").cast("long").alias("n"), F.round(F.aggregate("re", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# Names, prompts and candidates


@query("SELECT c_custkey FROM customer WHERE length(trim(n)) >= 3 AND NOT regexp_matches(n, '[()]') ORDER BY 1".replace("FROM customer", "FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (x)' WHEN c_custkey % 3 = 1 THEN ' ' || right(c_name, 2) ELSE c_name END AS n FROM customer)"))
def valid_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" (x)"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.right("c_name", F.lit(2)))).otherwise(F.col("c_name"))
    return views.table(spark, sf_dir, "customer").where(entities.valid_synonym(name)).select("c_custkey")


@query(f"WITH {_FLAT} SELECT canonical, len(names) AS n, names[1] AS first FROM al")
def alias_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = entities.alias_sets(entities.flat_synonyms(_groups(spark, sf_dir)))
    return sets.select("canonical", F.size("names").cast("long").alias("n"), F.element_at(F.array_sort("names"), 1).alias("first"))


@query(
    """WITH e AS (SELECT p_partkey AS ord, p_name AS text, p_brand AS url FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS k FROM e)
SELECT url, string_agg(text || ' (ARTIFACT)', ', ' ORDER BY ord, text) AS prompt FROM r WHERE k <= 60 GROUP BY url"""
)
def entity_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.lit("ARTIFACT").alias("type"), F.col("p_brand").alias("source_url"))
    return relations.entity_prompts(parts)


@query("SELECT DISTINCT lower(p_name) AS name FROM part")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.known_names(views.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("text")))


@query("WITH a AS (SELECT o_orderkey, count(DISTINCT (l_suppkey, l_returnflag, p_brand)) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT 'order/' || o_orderkey AS url, o_orderstatus AS title, coalesce(n, 0)::INT AS relations_found FROM orders LEFT JOIN a USING (o_orderkey)")
def gathered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("title"))
    found = parsed_relations(spark, sf_dir).withColumn("pos", F.lit(0))
    return relations.gathered_relations(found, pages).select("url", "title", "stats.relations_found")


@query("SELECT n AS name, n2 AS canonical FROM (SELECT p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' END AS n, min(p_name) AS n2 FROM part GROUP BY 1)")
def exact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.table(spark, sf_dir, "part")
    mapping = entities.canonical_map(parts.select("p_partkey", "p_name").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.array().cast("array<string>").alias("aliases")))
    asked = parts.select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise(" ")).alias("name"))
    return entities.resolve_names(asked, mapping)


@query(f"WITH {_CANDIDATES} SELECT DISTINCT qid, cand_label, description FROM cand WHERE label = 'NATION_7' AND lang = 'fr' ORDER BY qid LIMIT 3")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_lookup(_candidates(spark, sf_dir), "NATION_7", "fr")


@query("SELECT n_name AS label, lang, md5(n_name || '_' || lang) AS key FROM nation, (VALUES ('fr'), ('en')) v(lang) WHERE NOT (n_nationkey % 2 = 0 AND lang = 'fr')")
def candidates_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of every other nation's French candidates leaves to ask."""
    n = views.table(spark, sf_dir, "nation")
    cache = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("label"), F.lit("fr").alias("lang"), F.array().cast("array<string>").alias("found"))
    _, ask = providers.cached_candidates(n.select(F.col("n_name").alias("name")), cache)
    return ask.select("label", "lang", graph.cache_key(F.col("label"), F.col("lang")).alias("key"))


@query()
def completed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each brand's parts, completed by a deterministic offline answer and parsed."""
    prompts = entity_prompts(spark, sf_dir).withColumn("batch", F.xxhash64("url"))
    answers = providers.completions(prompts, _offline_answer)
    return ner.answered_types(answers)


def _offline_answer(prompt: str) -> str:
    import json

    names = [n.rsplit(" (", 1)[0] for n in prompt.split(", ")]
    return json.dumps([{"name": n, "type": "ARTIFACT" if len(n) % 2 else "CONCEPT"} for n in names])


@query(f"SELECT page_id, CASE WHEN {_DOMAIN} LIKE '%.org' THEN NOT starts_with({_PATH}, '/en/') ELSE {_DOMAIN} LIKE '%.com' END AS allowed FROM pages")
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    rules_text = F.when(U.domain(F.col("url")).endswith(".org"), "User-agent: *\nDisallow: /en/").when(U.domain(F.col("url")).endswith(".com"), "User-agent: *\nAllow: /")
    return pages.select("page_id", U.robots_allow(rules_text, "tessella", F.col("url")).alias("allowed"))


# Files


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    sc = spark.sparkContext
    checkpointed(spark.range(1))
    return f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_WHOLE} SELECT p AS property, count(*) AS n, sum(length(o))::BIGINT AS size FROM g GROUP BY p")
def ntriples_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph written as N-Triples and read again; all its properties are described."""
    return _described(_reread(spark, sf_dir, files.write_ntriples, ".nt"))


@query(f"WITH {_WHOLE} SELECT p AS property, count(*) AS n, sum(length(o))::BIGINT AS size FROM g GROUP BY p")
def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph written as Turtle and read again; all its properties are described."""
    return _described(_reread(spark, sf_dir, files.write_turtle, ".ttl"))


def _reread(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], None], suffix: str) -> DataFrame:
    """The whole graph, as written to files and read from them."""
    path = _folder(spark, "graph") + suffix
    write(_whole(spark, sf_dir), path)
    return files.read_graph(spark, path)


def _described(triples: DataFrame) -> DataFrame:
    size = F.length(F.when(F.col("o_kind") == "iri", F.substring_index("o", "#", -1)).otherwise(F.col("o")))
    return triples.groupBy(F.substring_index("p", "#", -1).alias("property")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("size"))


@query(f"WITH {_STAR} SELECT p AS property, count(*) AS n FROM g0 WHERE p = 'memberOf' GROUP BY p")
def partitioned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as Parquet by property; one property's files are read."""
    path = _folder(spark, "graph")
    files.write_graph(views.star_graph(spark, sf_dir), path)
    return rules.property_histogram(spark.read.parquet(path).where("property = 'memberOf'"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents GROUP BY lang")
def jsonl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines in two runs, the second of which finds the first's rows done."""
    path = _folder(spark, "pages")
    schema = "url STRING, title STRING, text STRING"
    pages = views.pages(spark, sf_dir).join(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang"), "ord").select("url", F.col("lang").alias("title"), "text")
    files.append_new(pages.where("title = 'en'"), path, schema)
    files.append_new(pages, path, schema)
    return files.read_jsonl(spark, path, schema).groupBy(F.col("title").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("size"))


@query(f"WITH {_STAR}, r AS (SELECT p, count(*) AS n FROM g0 GROUP BY p), q AS (SELECT p, n, CASE WHEN n < 3 THEN 0 ELSE greatest(1, n // 10) END AS k FROM r) SELECT unnest(['train', 'valid', 'test']) AS split, unnest([sum(n - 2 * k), sum(k), sum(k)])::BIGINT AS n FROM q")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "splits")
    files.write_dataset(checkpointed(sampling.stratified_split(_dataset(spark, sf_dir))), folder)
    parts = [files.read_split(spark, f"{folder}/{name}").withColumn("split", F.lit(name)) for name in ("train", "valid", "test")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, taken by a stream that ends when all files are done; twice, to no effect."""
    source, out, mark = (_folder(spark, n) for n in ("source", "out", "mark"))
    files.write_jsonl(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), source)
    for _ in range(2):
        ingest.ingest_jsonl(spark, source, "doc_id BIGINT, lang STRING", out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the star graph expanded by all rules, as a histogram of properties."""
    return expanded_properties(spark, sf_dir)
