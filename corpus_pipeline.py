"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's rows as Parquet to the shared folder and reads them again for the next.

Defined cases: a null text is scored like an empty one, becomes the empty text in line dedup, and so a copy of all other empty ones;
rows without a doc_id are scored, deduplicated by line and checked for items like others, and stay in near-dedup; of rows that repeat
id and text one stays; very long texts are read whole; an empty table gives no rows; other columns of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import decontamination, line_dedup, near_copies, packing, toxicity
from evidence_engine.llm.common import stored, table
from evidence_engine.llm.queries import tokenizer_path, toxicity_learn


def _free(docs: DataFrame, name: str, suffixes: tuple[str, ...] = ("",)) -> str:
    """A name, with none of whose suffixes docs has a column."""
    taken = {c.lower() for c in docs.columns}
    while any((name + x).lower() in taken for x in suffixes):
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels, score = table(spark, sf_dir, "labels"), _free(docs, "__toxicity")
    model = toxicity.train(docs, toxicity.confirmed(labels), toxicity_learn(), prior=toxicity.label_prior(labels, toxicity_learn()))
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document before holds; n_chars follows the text."""
    own = _free(docs, "__kept", ("_text", "_lines", "_dropped"))
    kept = line_dedup.line_dedup(docs, prefix=own)
    changed = F.col(f"{own}_dropped") > 0
    kept = kept.withColumn("text", F.when(changed, F.col(f"{own}_text")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class that SimHash links or a similarity of 0.8 over 5-word shingles connect."""
    return near_copies.one_per_class(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor XXH64 fingerprints, CGK embeddings or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
