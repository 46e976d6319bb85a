"""Schemas of the tables between stages."""

PAGE = "ord BIGINT, url STRING, title STRING, text STRING"
RAW_PAGE = "url STRING, title STRING, text STRING"
TITLE_ENTITY = "text STRING, type STRING, source_url STRING"
SYNONYM_GROUP = "synonyms ARRAY<STRUCT<canonical: STRING, synonyms: ARRAY<STRING>>>"
MERGED_ENTITY = "text STRING, type STRING, source_url STRING, aliases ARRAY<STRING>"
RELATION = "STRUCT<source: STRING, relation: STRING, target: STRING>"
DOC_RELATIONS = f"url STRING, title STRING, relations ARRAY<{RELATION}>, stats STRUCT<relations_found: INT>"
MERGED_RELATION = "source STRING, relation STRING, target STRING, source_urls ARRAY<STRING>, frequency BIGINT, confirmed_by_ner BOOLEAN"
CANONICAL_ENTITY = "text STRING, type STRING, description STRING, source_urls ARRAY<STRING>, aliases ARRAY<STRING>"
CANONICAL_RELATION = "source STRING, relation STRING, target STRING, source_urls ARRAY<STRING>, frequency BIGINT"
MAPPING = "key STRING, eid STRING"
TRIPLE = "s STRING, p STRING, o STRING, o_kind STRING, o_lang STRING, o_dtype STRING"
CANDIDATE = "label STRING, lang STRING, pos INT, qid STRING, cand_label STRING, description STRING"
KGE_TRIPLE = "head STRING, relation STRING, tail STRING"
KGE_VECTOR = "id INT, label STRING, re ARRAY<FLOAT>, im ARRAY<FLOAT>"
METRICS = "run STRING, model STRING, size STRING, mrr DOUBLE, hits1 DOUBLE, hits3 DOUBLE, hits10 DOUBLE, elapsed_s DOUBLE, n_entities INT, n_relations INT"
EVAL_CASE = "id STRING, question STRING, expected_tools ARRAY<STRING>, expected_keywords ARRAY<STRING>, forbidden_keywords ARRAY<STRING>, description STRING"
CLASS_ANSWER = "ARRAY<STRUCT<name: STRING, type: STRING>>"
