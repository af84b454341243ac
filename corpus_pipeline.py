"""A training corpus from raw documents: quality rules, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs.

Defined results for the stages together: a document with a null or empty text fails the
quality rules, so no later stage sees one (called by itself, each has its own defined result for
it); texts of any length pass every stage whole; rows with a null doc_id are kept or dropped
like others, but never as copies, since nothing names their group; of repeated rows and copies
that with the smallest doc_id stays, and rows that repeat one doc_id stay or go together;
columns besides doc_id, text and source keep their values and names, whatever they are, up to
the last stage, which returns pieces; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import _shared, decontam, line_dedup, packing, quality, simhash

STAGES = [
    ("quality_rules", quality.keep_stage),
    ("line_dedup", line_dedup.clean_stage),
    ("simhash_near_dedup", simhash.keep_one_stage),
    ("decontamination", decontam.clean_stage),
    ("best_fit_packing", packing.pack_stage),
]

#: SQL can't express tokenizers, SimHash components or the configuration program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the surviving documents and their places in sequences."""
    docs, uri = _shared.table(spark, sf_dir, "documents"), _shared.shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = _shared.written(stage(spark, docs, sf_dir), f"{uri}/{k}-{name}")
    return docs
