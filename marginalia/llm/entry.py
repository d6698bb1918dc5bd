"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rank, merkle, turn_trie
from .byte_bpe import byte_bpe
from .common import table
from .lang_bigru import languages
from .packing import packed
from .partenum import jaccard_groups
from .pivot_topk import top_k
from .quality_mcd import BASE, quality
from .quality_sql import quality_sql
from .template_extract import main_text
from .token_counts import token_counts
from .toxicity_ssk import toxicity
from .warc_index import capture_index


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back and merged to one capture index."""
    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th embedding."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the byte-level BPE file, over 512 or not."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the template that pages of its host share."""
    return main_text(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a Jaccard similarity of 0.85."""
    return jaccard_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document, base rules and robust outliers."""
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents concatenated and cut into sequences of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return turn_trie.trie(table(spark, sf_dir, "conversations"))


def op12_host_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules, else by trust and distrust over the graph of hosts."""
    return host_rank.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its received copy, which has lost its
    line ends where the CRC-32 of its id is even, still leads to the root."""
    received = F.when(merkle.even_id(), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), received={"text": received})
    proof, end = F.sha2(merkle.proof_text(F.col("path")), 256), merkle.folded(F.col("received_leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), end.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_exact_topk, op3_token_counts, op4_template_text, op5_language, op6_jaccard_join, op7_quality, op8_packing, op9_toxicity, op10_byte_bpe, op11_turn_trie, op12_host_rank, op13_merkle)}
SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, max(page_id) AS stored FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < stored THEN stored END AS refers_to
FROM p LEFT JOIN kept USING (payload_digest)""",
    "op2_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank", vec_id, score FROM s)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM r WHERE "rank" <= 5""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT t.b, r.root FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) t ON t.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL""",
    "op7_quality": quality_sql(),
    "op11_turn_trie": turn_trie.SQL,
    "op12_host_rank": host_rank.SQL,
    "op13_merkle": merkle.SQL,
}
