"""Derived input views, in the SQL of both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TURN = "concat(upper(substr(role,1,1)), substr(role,2), ': ', text)"
_DOSSIER = "concat('# Section ', cast(doc_id AS STRING), chr(10), CASE WHEN doc_id % 3 = 0 THEN '- ' WHEN doc_id % 3 = 1 THEN '1. ' ELSE '' END, text)"
_CALLS = """SELECT d.doc_id, cast(floor(d.doc_id / 5) AS BIGINT) AS collection_id,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat(upper(substr(n.n_name,1,1)), lower(substr(n.n_name,2))) END AS company,
 CASE d.doc_id % 4 WHEN 0 THEN concat('2024-0', cast(1 + d.doc_id % 9 AS STRING), '-15') WHEN 1 THEN concat(cast(1 + d.doc_id % 9 AS STRING), '/15/2024')
   WHEN 2 THEN concat('March ', cast(1 + d.doc_id % 9 AS STRING), ', 2024') ELSE 'undated' END AS date,
 CASE WHEN d.doc_id % 5 = 0 THEN concat('Report ', cast(d.doc_id AS STRING)) END AS title,
 concat(upper(substr(n.n_name,1,1)), lower(substr(n.n_name,2)), ' Inc. Q', cast(1 + d.doc_id % 4 AS STRING), ' 2024 Earnings Call', chr(10),
   CASE WHEN d.doc_id % 2 = 0 THEN 'Quarter revenue and guidance. ' ELSE '' END, d.text) AS text
FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25"""
_CLEAN = "regexp_replace(text, '[^A-Za-z ]', ''{g})"
_RESPONSES = """SELECT conv_id AS doc_id, turn AS chunk_index, CASE (conv_id + turn) % 5 WHEN 0 THEN 'no usable reply'
 WHEN 1 THEN concat('Summary: ', clean, chr(10), 'keywords: alpha, beta', chr(10), 'speakers: ', role, chr(10), 'importance: 4', chr(10), 'action_items: [send report]', chr(10), 'key_quotes: none')
 ELSE concat('{"summary":"', clean, '","keywords":["', substr(clean,1,6), '","shared"],"speakers":["', role, '"],"importance":', cast(1 + turn % 5 AS STRING), ',"action_items":["send report ', cast(turn AS STRING), '"],"key_quotes":[]}') END AS response
FROM (SELECT conv_id, turn, role, @ AS clean FROM conversations) t"""
_ITEMS = """SELECT cast(floor(doc_id / 100) AS BIGINT) AS doc_id, doc_id AS item_id, @first AS title, text AS description,
 CASE doc_id % 6 WHEN 0 THEN 'Strategy' WHEN 1 THEN 'People' WHEN 2 THEN 'Platforms' WHEN 3 THEN 'Infrastructure' WHEN 4 THEN 'Data' ELSE 'Adoption' END AS category,
 CASE doc_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' WHEN 3 THEN 'low' END AS severity,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('Speaker ', cast(doc_id % 4 AS STRING)) END AS speaker FROM documents"""
_ANNOTATIONS = """SELECT conv_id AS doc_id, turn AS chunk_index,
 CASE WHEN turn = 0 THEN 'beginning' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'end' ELSE 'middle' END AS position, text AS summary,
 @keywords AS keywords, CASE WHEN role = 'system' THEN @none ELSE @role END AS speakers, 1 + (conv_id + turn) % 5 AS importance, @items AS action_items FROM conversations"""
_VALIDATION = """SELECT doc_id, chunk_index AS idx, 1 + (doc_id * 7 + chunk_index * 3) % 5 AS score, concat('reason ', cast(chunk_index AS STRING)) AS reason FROM annotations
 UNION ALL SELECT doc_id, 99 AS idx, 5 AS score, 'no such candidate' AS reason FROM annotations WHERE chunk_index = 0"""
#: Every second candidate comes again with its first word changed, assigned and dated where the first is not.
_CANDIDATES = """SELECT doc_id, chunk_index AS idx, summary AS text, CASE WHEN chunk_index % 3 = 0 THEN NULL ELSE concat('Owner ', cast(chunk_index AS STRING)) END AS assignee,
 CASE WHEN chunk_index % 2 = 0 THEN NULL ELSE concat('2024-05-', lpad(cast(1 + chunk_index AS STRING), 2, '0')) END AS due, importance, 1 + (doc_id + 2 * chunk_index) % 5 AS score FROM annotations
 UNION ALL SELECT doc_id, 1000000 + chunk_index AS idx, regexp_replace(summary, '^[^ ]+', 'Again'), CASE WHEN chunk_index % 3 = 0 THEN 'Owner again' END AS assignee,
 CASE WHEN chunk_index % 2 = 0 THEN '2024-06-01' END AS due, 3 AS importance, 1 AS score FROM annotations WHERE (doc_id + chunk_index) % 2 = 0"""
_ASSESSMENTS = """SELECT cast(floor(doc_id / 20) AS BIGINT) AS doc_id, doc_id AS item_id,
 CASE doc_id % 5 WHEN 0 THEN 'Strategy' WHEN 1 THEN 'Policy' WHEN 2 THEN 'Quality' WHEN 3 THEN 'Security' ELSE 'Roles' END AS dimension,
 1 + cast(floor(doc_id / 5) AS BIGINT) % 3 + doc_id % 2 AS level, text AS evidence FROM documents"""
#: Turns as the commitments of a company in four periods; some come again in the next period, or the one after, as they are or changed.
_COMMITMENTS = """SELECT cast(floor(conv_id / 4) AS BIGINT) AS company_id, conv_id % 4 AS period, turn AS item, text FROM conversations
 UNION ALL SELECT cast(floor(conv_id / 4) AS BIGINT), conv_id % 4 + 1, 1000000 + turn, CASE WHEN turn % 2 = 0 THEN text ELSE regexp_replace(text, '^[^ ]+', 'Still') END FROM conversations WHERE conv_id % 4 < 3 AND (conv_id + turn) % 3 = 0
 UNION ALL SELECT cast(floor(conv_id / 4) AS BIGINT), conv_id % 4 + 2, 2000000 + turn, regexp_replace(text, '^[^ ]+', 'Even') FROM conversations WHERE conv_id % 4 < 2 AND (conv_id + turn) % 6 = 0"""
_SECTIONS = "SELECT doc_id, chunk_index, summary FROM annotations"

SPARK = {
    "transcripts": f"SELECT conv_id AS doc_id, listagg({_TURN}, chr(10)) WITHIN GROUP (ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "teams_transcripts": f"SELECT conv_id AS doc_id, listagg(concat('9:', lpad(cast(turn % 60 AS STRING),2,'0'), ':', lpad(cast(conv_id % 60 AS STRING),2,'0'), ' AM From ', {_TURN[7:]}, chr(10)) WITHIN GROUP (ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "dossiers": f"SELECT cast(floor(doc_id / 10) AS BIGINT) AS doc_id, listagg({_DOSSIER}, concat(chr(10), chr(10))) WITHIN GROUP (ORDER BY doc_id) AS text FROM documents GROUP BY cast(floor(doc_id / 10) AS BIGINT)",
    "binders": f"SELECT cast(floor(doc_id / 50) AS BIGINT) AS doc_id, listagg({_DOSSIER}, concat(chr(10), chr(10))) WITHIN GROUP (ORDER BY doc_id) AS text FROM documents GROUP BY cast(floor(doc_id / 50) AS BIGINT)",
    "calls": _CALLS,
    "paragraph_vectors": "SELECT cast(floor(vec_id / 20) AS BIGINT) AS doc_id, cast(vec_id % 20 AS INT) AS para_index, embedding FROM embeddings",
    "annotations": _ANNOTATIONS.replace("@keywords", "slice(regexp_extract_all(lower(text), '[a-z]{3,}', 0), 1, 8)").replace("@none", "array()").replace("@role", "array(role)").replace("@items", "slice(split(text, chr(10)), 1, 3)"),
    "items": _ITEMS.replace("@first", "split(text, '[.!?]')[0]"),
    "responses": _RESPONSES.replace("@", _CLEAN.replace("{g}", "")),
    "validation": _VALIDATION,
    "candidates": _CANDIDATES,
    "assessments": _ASSESSMENTS,
    "sections": _SECTIONS,
    "commitments": _COMMITMENTS,
}


def _duck(sql: str) -> str:
    sql = re.sub(r"listagg\((.*), (concat\(chr\(10\), chr\(10\)\)|chr\(10\))\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, \2 ORDER BY \3)", sql)
    return re.sub(r"\bSTRING\b", "VARCHAR", sql)


DUCK = {k: _duck(v) for k, v in SPARK.items()}
DUCK["annotations"] = _ANNOTATIONS.replace("@keywords", "regexp_extract_all(lower(text), '[a-z]{3,}')[1:8]").replace("@none", "[]").replace("@role", "[role]").replace("@items", "string_split(text, chr(10))[1:3]")
DUCK["items"] = _duck(_ITEMS.replace("@first", "string_split_regex(text, '[.!?]')[1]"))
DUCK["responses"] = _duck(_RESPONSES.replace("@", _CLEAN.replace("{g}", ", 'g'")))
#: Views that stand on other views.
NEEDS = {"validation": ["annotations"], "candidates": ["annotations"], "sections": ["annotations"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view of a data folder."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    sql = SPARK[name]
    for t in [*BASE, *NEEDS.get(name, [])]:
        if re.search(rf"(FROM|JOIN) {t}\b", sql):
            alias = f"{t}_{abs(hash(sf_dir)):x}"
            load(spark, sf_dir, t).createOrReplaceTempView(alias)
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {alias}", sql)
    return spark.sql(sql)
