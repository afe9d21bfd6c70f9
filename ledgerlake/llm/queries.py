"""Registered queries of this subpackage and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import ann, decontam, itq, lang_id, license_scan, merkle, mixing, part_codes, pii, simhash, suffix_dedup, token_files, toxicity
from ledgerlake.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = lang_id.train(docs, usable=~held_out)
    found = lang_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.range_sorted(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    """The public byte-level vocabulary; installed on every machine, not shipped."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    lexicon = toxicity.learn(docs, labels, usable=~held_out)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "density", "n_matches")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    named = F.transform(F.concat("base", "terms"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *counts, "base_sha256", F.array_join(named, ",").alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.proofs(merkle.build(docs, carry={"shown": merkle.tampered_fields()}))
    found = found.withColumn("folded_root", merkle.folded(F.col("shown"), F.col("steps")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = part_codes.encode(table(spark, sf_dir, "embeddings"))
    digest = F.lit(part_codes.books_digest(codes.books)).alias("codebooks_sha256")
    return part_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", digest)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_mixing": (op2_mixing, mixing.oracle_sql()),
    "op3_license_scan": (op3_license_scan, license_scan.oracle_sql()),
    "op4_nearest": (op4_nearest, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_token_files": (op6_token_files, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_pii": (op8_pii, None),
    "op9_suffix_dedup": (op9_suffix_dedup, suffix_dedup.oracle_sql()),
    "op10_simhash": (op10_simhash, None),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle.oracle_sql()),
    "op12_part_codes": (op12_part_codes, part_codes.oracle_sql()),
    "op13_embedding_dedup": (op13_embedding_dedup, itq.oracle_sql()),
}
