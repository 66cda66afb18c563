"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    conversation_repair,
    decontamination,
    license_scan,
    line_dedup,
    merkle_manifest,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    substring_dedup,
    toxicity,
)
from .common import ascii_lower, table
from .sql import ORACLES

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def toxicity_learn() -> Column:
    """The rows whose toxicity labels may be learned; a condition over doc_id."""
    return _fold(3) != 1


def quality_learn() -> Column:
    """The rows whose quality labels may be learned; a condition over doc_id."""
    return _fold(5) != 0


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_documents(spark, sf_dir))
    return kept.select(
        "doc_id", F.col("kept_lines").alias("n_lines"), F.col("kept_dropped").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_documents(spark, sf_dir))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_chats(turns)
    out = out.select("conv_id", "valid", chat_format.formatted_text(F.col("segments")).alias("formatted"), chat_format.loss_text(F.col("segments")).alias("loss"))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.confirmed(labels), toxicity_learn(), prior=toxicity.label_prior(labels, toxicity_learn()))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_paragraphs(_documents(spark, sf_dir))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("similarity", 4).alias("similarity"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    out = quality_classifier.scored(docs, quality_classifier.train(docs, labels, quality_learn()))
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(_documents(spark, sf_dir))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS))
    return out.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_classes(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_reports(conversation_repair.repair_edits(turns, here=turns["here"]))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(_documents(spark, sf_dir))
    return kept.select("doc_id", F.col("kept_words").alias("n_words"), F.col("kept_removed").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the id's checksum, the text is tampered with after the tree was built: its A-Z are lower-cased."""
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.when(_fold(3) == 0, merkle_manifest.leaf_hash(*fields(ascii_lower(F.col("text")))))
    out = merkle_manifest.manifest(table(spark, sf_dir, "documents"), merkle_manifest.leaf_hash(*fields(F.col("text"))), replaced=tampered)
    return out.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_rules,
        op3_chat_format,
        op4_best_fit_packing,
        op5_toxicity,
        op6_license_scan,
        op7_quality_classifier,
        op8_secret_scan,
        op9_simhash,
        op10_decontamination,
        op11_conversation_repair,
        op12_substring_dedup,
        op13_merkle_manifest,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
