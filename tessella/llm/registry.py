"""The operators' queries over the supplied tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, html_extract, mixing, quality_classifier, quality_rules, secret_scan, simhash, token_files


#: The parts of the mix that each source is to have; a source that isn't named has one part.
TARGET_PARTS = {f"src{i}": 6 if i < 4 else 3 if i < 10 else 2 for i in range(20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("lost_share")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.read_token_files(folder, manifest)


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(_table(spark, sf_dir, "conversations"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), TARGET_PARTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_quality_rules, op3_byte_bpe, op4_quality_classifier, op5_token_files]
    found += [op6_chat_preferences, op7_simhash_dedup, op8_embedding_dedup, op9_secret_scan, op10_source_mix]
    return {f.__name__: f for f in found}


_RENDER = "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)"


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    side = lambda c: f"array_to_string(list_transform({c}[n + 1:], lambda t: {_RENDER}), '')"
    size = "(length(t.role) + length(t.text) + 24)"
    start = lambda c: f"(coalesce(list_sum(list_transform({c}[n + 1:n + i], lambda t: {size})), 0)::BIGINT)"
    mask = lambda c: f"array_to_string(list_transform(list_filter(range(1, len({c}) - n + 1), lambda i: {c}[n + i].role = 'assistant'), lambda i: ({start(c)} - length({c}[n + i].text) - 11)::VARCHAR || ':' || ({start(c)} - 1)::VARCHAR), ',')"
    chat_sql = f"""
WITH g AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, turns, md5(turns[1].role || chr(10) || turns[1].text) AS k,
             coalesce(list_sum(list_transform(turns, lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) ELSE 0 END)), 0) AS said FROM g),
p AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY md5(conv_id::VARCHAR), conv_id) - 1) // 2 AS pair FROM r),
q AS (SELECT list(conv_id ORDER BY said DESC, conv_id) AS ids, list(turns ORDER BY said DESC, conv_id) AS sides FROM p GROUP BY k, pair),
c AS (SELECT ids[1] AS chosen_id, ids[2] AS rejected_id, sides[1] AS a, sides[2] AS b FROM q),
l AS (SELECT *, CASE WHEN b IS NULL THEN len(a) - 1 ELSE coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) END AS n FROM c)
SELECT chosen_id, rejected_id, n::BIGINT AS n_prompt_turns, array_to_string(list_transform(a[:n], lambda t: {_RENDER}), '') AS prompt,
       {side('a')} AS chosen, {mask('a')} AS chosen_mask,
       CASE WHEN b IS NOT NULL THEN {side('b')} END AS rejected, CASE WHEN b IS NOT NULL THEN {mask('b')} END AS rejected_mask
FROM l
"""
    return {"op2_quality_rules": _rules_sql(), "op6_chat_preferences": chat_sql, "op8_embedding_dedup": _VECTORS_SQL, "op9_secret_scan": _secrets_sql()}


_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""


def _rules_sql() -> str:
    rules = quality_rules.LineRules()
    words = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    symbol = "[#*$%&|<>]"
    told = " OR ".join(f"(n <= {2 * n} AND regexp_matches(lower(joined), '{p}'))" for n, p in quality_rules.BOILERPLATE_BY_WORDS.items())
    told += f" OR regexp_matches(lower(joined), '^(?:{'|'.join(quality_rules.BOILERPLATE_OPENINGS)})') OR regexp_matches(lower(joined), '{quality_rules.BOILERPLATE_END}[.]*$')"
    ends = quality_rules.SENTENCE_END.replace("'", "''")
    separators = ", ".join(f"'{x.decode()}'" for x in sorted(quality_rules._SEPARATORS))
    symbols_of = lambda c: f"length(regexp_replace({c}, '[^#*$%&|<>]', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, {words.format("text")} AS ws FROM d),
win AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w),
often AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY k),
ln AS (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
lw AS (SELECT k, pos, line, {words.format("line")} AS ws FROM ln),
m AS (SELECT k, pos, line, array_to_string(ws, ' ') AS joined, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda x: strlen(x))), 0) AS size,
  len(list_filter(ws, lambda x: x IN ({separators}))) AS seps, {symbols_of("line")} AS syms, len(list_filter(ws, lambda x: regexp_matches(x, '{symbol}'))) AS sw,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS same, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS cased FROM lw WHERE len(ws) > 0),
f AS (SELECT k, pos, line, size, (n >= 2 AND seps >= greatest(2, {rules.separators} * n)) OR (n <= {rules.boilerplate_words} AND ({told}))
  OR (syms >= {rules.symbol_words} * n AND sw >= greatest(3, {rules.symbol_words} * n))
  OR (n >= {rules.least_words} AND (same >= {rules.repeats} * n OR (cased > 0 AND up / cased >= {rules.capitals}) OR NOT regexp_matches(line, '{ends}|{quality_rules.UNMARKED}'))) AS fails FROM m),
s AS (SELECT k, count(*) - count(DISTINCT line) AS dup, sum(size) AS total, sum(CASE WHEN fails THEN size ELSE 0 END) AS lost FROM f GROUP BY k),
c AS (SELECT lw.k, string_agg(lw.line, chr(10) ORDER BY lw.pos) AS cleaned FROM lw LEFT JOIN f ON f.k = lw.k AND f.pos = lw.pos WHERE f.fails IS NOT TRUE GROUP BY lw.k),
b AS (SELECT w.k, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {symbols_of("text")} AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total, coalesce(cleaned, '') AS cleaned FROM w LEFT JOIN c ON c.k = w.k LEFT JOIN s ON s.k = w.k LEFT JOIN rep ON rep.k = w.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {rules.lost} * total AS kept,
  length(cleaned) AS cleaned_chars, sha256(cleaned) AS cleaned_sha256
FROM b
"""


def _secrets_sql() -> str:
    """Spans from the pieces between matches, whose lengths add up to positions."""
    base, steps, lists = len(secret_scan.BASE_RULES), [], []
    for i, rule in enumerate(secret_scan.RULES):
        pattern = ("(?i)" if rule.flags & re.IGNORECASE else "") + rule.pattern.replace("'", "''")
        at = f"(coalesce(list_sum(list_transform(p{i}[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: length(x))), 0))::BIGINT"
        steps.append(f"regexp_split_to_array(t, '{pattern}') AS p{i}, regexp_extract_all(t, '{pattern}') AS m{i}, regexp_extract_all(t, '{pattern}', {rule.group}) AS g{i}")
        lists.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: length(g{i}[j]) >= {rule.shortest}), lambda j: {{'s': {at}, 'r': {i}, 'w': '{rule.kind}:' || {at} || ':' || ({at} + length(m{i}[j]))}})")
    counts = ", ".join(f"len(list_filter(f, lambda x: x.r = {i})) AS n_{rule.kind}" for i, rule in enumerate(secret_scan.BASE_RULES))
    written = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: x.w), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {", ".join(steps)} FROM d), f AS (SELECT doc_id, flatten([{", ".join(lists)}]) AS f FROM m)
SELECT doc_id, {counts}, sha256({written(f"list_filter(f, lambda x: x.r < {base})")}) AS base_sha256, {written("f")} AS spans FROM f
"""
