"""A corpus pipeline of five operators; each stage's table is written as Parquet and read again by the next."""

from millrace.llm import bm25_pack, line_dedup, mixing, near_copies, queries, repetition
from millrace.llm.common import store


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the repetition rules go."""
    return repetition.keep_good(docs)


def line_dedup_stage(spark, docs, sf_dir):
    """Lines that stand earlier in the corpus go, and documents that have nothing else."""
    return line_dedup.clean_documents(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word Jaccard of 0.8 or more) stays."""
    return near_copies.keep_one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents are drawn to the target weights, none twice."""
    return mixing.keep_mixture(docs, queries.domain(), queries.WEIGHTS, queries.MIXED_PART)


def pack(spark, docs, sf_dir):
    return bm25_pack.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Packing has no SQL form. tests/llm holds each stage against brute force, but not the rows of run() as a whole.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
