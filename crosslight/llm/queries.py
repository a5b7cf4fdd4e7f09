"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, langid, minhash, mixing, negatives, neighbours, quality, sentencepieces, sharding, substrings, tiff, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_nn_descent": neighbours.op2_nn_descent,
    "op3_minhash": minhash.op3_minhash,
    "op4_tiff": tiff.op4_tiff,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_substrings": substrings.op7_substrings,
    "op8_sharding": sharding.op8_sharding,
    "op9_bpe": bpe.op9_bpe,
    "op10_langid": langid.op10_langid,
    "op11_sentencepiece": sentencepieces.op11_sentencepiece,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
    "shards_by_bytes": lambda spark, sf_dir: sharding.op8_sharding(spark, sf_dir).select("doc_id", "size", "shard", "slot"),
}

#: Equal byte targets along doc_id, for op8 without its digests: DuckDB has no CRC-32, so op8 itself has
#: no counterpart, and its other columns stand as a query of their own.
SHARDS_SQL = """
    WITH d AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
    p AS (
        SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id NULLS FIRST) AS e, sum(size) OVER () AS total FROM d),
    s AS (
        SELECT doc_id, size, least(7, floor((e - size / 2.0) * 8 / total))::INT AS shard FROM p)
    SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot FROM s
"""

ORACLE_SQL: dict[str, str] = {"shards_by_bytes": SHARDS_SQL, "op12_hard_negatives": negatives.ORACLE_SQL}
