"""Registered queries of the training-data operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from ebbtide.llm import bitpack, decontaminate, langid, merkle, minhash, packing, pii, prefix_trie, quality, secret_scan, sql, suffixes, vptree, warc
from ebbtide.llm.store import parquet


def op1_warc(spark, sf_dir):
    return warc.round_trip(parquet(spark, sf_dir, "pages"))


def op2_pii(spark, sf_dir):
    return pii.digest(parquet(spark, sf_dir, "documents"))


def op3_langid(spark, sf_dir):
    return langid.predictions(parquet(spark, sf_dir, "documents"))


def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(parquet(spark, sf_dir, "documents"))


def op5_suffixes(spark, sf_dir):
    return suffixes.digest(parquet(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.verdicts(parquet(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.packed_digest(parquet(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    return bitpack.token_files(parquet(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contaminated(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


def op10_secrets(spark, sf_dir):
    return secret_scan.findings(parquet(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return merkle.digest(parquet(spark, sf_dir, "documents"))


def op12_vptree(spark, sf_dir):
    return vptree.search(parquet(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(parquet(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_pii, op3_langid, op4_minhash, op5_suffixes, op6_quality, op7_packing, op8_token_files, op9_decontamination,
                                  op10_secrets, op11_merkle, op12_vptree, op13_prefix_trie)}
SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (payload_digest)""",
    "op11_merkle": sql.MERKLE,
    "op12_vptree": sql.NEAREST,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}
