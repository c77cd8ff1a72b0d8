"""The queries of the training-data operators: each applies its operator to the whole table.

All give one row for each row of the table (op7: for each piece of one), read whole texts of any
length, count null as empty, take other columns under any name, and give no rows for no rows. Null and
repeated ids are carried; what becomes of them, and of ties, is said with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binfile, embeddup, exactdup, lm, minhash, mixing, packing, secrets, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    """Bytes and tokens of each text; repeated rows are counted each."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    """Scores of each text; repeated rows are learnt and scored each, null ids are never held out."""
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    """Scores of each text; equal texts have equal scores, labels of null ids are not learnt."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_token_files(spark, sf_dir):
    """Places in the token files; repeated ids follow each other, by a hash of their text; null ids come last."""
    return binfile.token_files(_table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    """Counts and places of secrets in each text, by itself."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_embedding_dedup(spark, sf_dir):
    """Links among vectors of a label; ties at the threshold count, unfit vectors link with nothing."""
    return embeddup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark, sf_dir):
    """Pieces of documents in bins; repeated rows conflict, ties in size go by id."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    """Groups of texts equal but for white space; ties go by id, nulls last."""
    return exactdup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark, sf_dir):
    """Components of near copies; ties at the threshold count, null ids and empty texts link with nothing."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


def op10_mix(spark, sf_dir):
    """Words taken of each document; repeated rows are documents of their own, ties go by size, id and row hash."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_lm_score, op3_toxicity, op4_token_files, op5_secrets, op6_embedding_dedup, op7_packing, op8_exact_dedup, op9_minhash_dedup, op10_mix)}


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

OP8_SQL = f"""
WITH base AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents),
best AS (SELECT norm, count(*) AS group_size, max(n) AS most FROM base GROUP BY norm),
keep AS (SELECT b.norm, min(b.doc_id) AS keep_id FROM base b JOIN best USING (norm) WHERE b.n = best.most GROUP BY b.norm)
SELECT base.doc_id, keep.keep_id, CAST(best.group_size AS BIGINT) AS group_size, base.doc_id IS NOT DISTINCT FROM keep.keep_id AS kept, sha256(norm) AS text_sha256
FROM base JOIN best USING (norm) JOIN keep USING (norm)
"""


def oracle_sql() -> dict[str, str]:
    """The others learn, draw, encode or link along chains; small fixtures test those by brute force."""
    return {"op8_exact_dedup": OP8_SQL}
