"""A corpus pipeline over documents: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each
stage's rows to the shared folder and reads them back.

All stages keep rows with null columns (a null text counts as empty), extra columns whatever their names, and texts of
any length whole. Rows that repeat doc_id and text stay through the first two stages; near-dedup makes one of them. Of
texts that tie for a group the one with the smallest doc_id stays, nulls last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, packing, queries, simhash, toxicity
from millrace.llm._common import fresh, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the labelled rows among docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "__score", "__spans")
    scored = toxicity.score(docs, model, names=tuple(names))
    return scored.where(F.col(names[0]) < 0.5).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of the lines that ten or more of them share only the first stays, in order of doc_id, so that no
    text leaves the corpus altogether. A document may end up empty; the next stage makes one of all such."""
    (dropped,) = fresh(docs, "__dropped")
    kept = line_dedup.line_keep(docs, min_docs=10, min_chars=1, keep_first=True, name=dropped)
    text = F.when(F.size(dropped) == 0, F.col("text")).otherwise(line_dedup.apply_keep(F.col("text"), F.col(dropped)))
    changed = F.when(F.size(dropped) == 0, F.col("n_chars")).otherwise(F.length(text))
    return kept.withColumns({"text": text, "n_chars": changed.cast("long")}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by fingerprints of five-word shingles or by 0.8 Jaccard
    similarity of the shingles themselves."""
    return simhash.drop_near_copies(docs, shingle=5, most=3, jaccard=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_common_lines), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]

#: The model, the fingerprints' bits, latent retrieval and the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
