"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, centroids, decontaminate, divergence, minhash, ngram_join, oracles, packing, pii, quality, secret_scan, sharding, substring_dedup, tool_calls
from folioforge.llm.common import load


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file is; the same installation on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.class_ids(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def _of_rank(k: int):
    return lambda s: s["rank"] == k


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, secret_scan.train_on(docs)).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    count = [F.size(F.filter("secret_spans", _of_rank(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *count, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secret_spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("row_id", "n_segments", "n_tokens", "doc_ids", "seg_starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(load(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.ANSWER)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, least_score double"

    def digest(batches):
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "least_score")}
            for found in b.column("pii_spans").to_pylist():
                found = [(x["kind"], x["start"], x["end"], x["score"]) for x in found]
                base = [x for x in found if x[0] in pii.BASE_KINDS]
                for k in pii.BASE_KINDS:
                    rows[f"n_{k}"].append(sum(x[0] == k for x in base))
                rows["base_sha256"].append(pii.digest(pii.listed(base)))
                rows["spans"].append(pii.listed(found))
                rows["least_score"].append(min((x[3] for x in found), default=None))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names=["doc_id", *rows])

    return pii.scan_pii(docs).select("doc_id", "pii_spans").mapInArrow(digest, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_cascade(docs, stats=True).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(load(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group_near_copies(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: SQL of the queries that SQL can express; the others use samples, models, tokenizers or searches.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": oracles.OP1,
    "op8_quality": oracles.OP8,
    "op11_minhash": oracles.OP11,
    "op12_divergence": divergence.ORACLE,
    "op13_centroids": centroids.oracle(),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_tool_calls": op6_tool_calls,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_minhash": op11_minhash,
    "op12_divergence": op12_divergence,
    "op13_centroids": op13_centroids,
}
