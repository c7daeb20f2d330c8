"""A MinHash index of texts that are already there: new texts are looked up by bands, within a batch and across batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import shingles, words

N_HASHES, BANDS = 64, 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of XXH64 on unsigned 64-bit numbers, in place."""
    for shift, prime in ((33, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(prime)
    x ^= x >> np.uint64(32)
    return x


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _least(hashes: np.ndarray) -> list[int]:
    """What text.least_hashes gives: the least of xxhash64(hash, seed) for each seed; the numbers are Spark's."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    start = p5 + np.uint64(42 + 8)
    own = _mixed(_turned((_turned(hashes.view(np.uint64) * p2, 31) * p1) ^ start, 27) * p1 + p4) + (p5 + np.uint64(4))
    seeds = [np.uint64(k * int(p1) & (1 << 64) - 1) for k in range(N_HASHES)]
    return [int(_mixed(_turned(own ^ seed, 23) * p2 + p3).view(np.int64).min()) for seed in seeds]


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig): 64 least hashes of the five-word shingles. Rows of null text have none."""
    # explode keeps the word split and the shingles out of the lambdas, where they would be made anew for every seed
    tokens = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(words(F.col(text)))).alias("w"))
    hashes = tokens.select("key", F.explode(F.array(F.transform(shingles(F.col("w")), lambda s: F.xxhash64(s)))).alias("h"))

    def make(batches):
        for batch in batches:
            sigs = [_least(s.values.to_numpy()) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], names=["key", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    return hashes.mapInArrow(make, f"key {kind}, sig array<bigint>")


def build_index(sigs: DataFrame) -> DataFrame:
    """One row for each distinct signature: the least key that has it. Copies so meet once, not once a band."""
    return sigs.groupBy("sig").agg(F.min("key").alias("key"))


def _banded(index: DataFrame, name: str) -> DataFrame:
    rows = N_HASHES // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))
    return index.select(F.col("key").alias(name), F.col("sig").alias(f"{name}_sig"), F.explode(bands).alias("band"))


def alike(asked: DataFrame, index: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(asked, found, similarity): pairs of distinct signatures that share a band and that share of their hashes.

    Sixteen bands of four find a pair at 0.8 with a probability of 0.9998."""
    pairs = _banded(asked, "asked").join(_banded(index, "found"), "band").drop("band")
    same = F.size(F.filter(F.zip_with("asked_sig", "found_sig", lambda a, b: a == b), lambda x: x)).cast("double") / N_HASHES
    return pairs.select("asked", "found", same.alias("similarity")).where(F.col("similarity") >= threshold).distinct()


def nearest(new: DataFrame, index: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, found, similarity) for each row of new signatures that the index has something near; the most similar, of equals the least key."""
    asked = build_index(new)
    best = alike(asked, index, threshold).groupBy("asked").agg(F.min_by(F.struct("found", "similarity"), F.struct(-F.col("similarity"), F.col("found"))).alias("b"))
    hits = asked.join(best, F.col("key") == F.col("asked")).select("sig", "b.found", "b.similarity")
    return new.join(hits, "sig").select("key", "found", "similarity")


def add_batch(index: DataFrame | None, batch: DataFrame, key: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(decisions, index with the kept ones): keys of a batch with what they are too near to, or null where kept.

    Within the batch the first come is kept, as decided in rounds by `greedy_keep`; what an earlier batch kept comes before.
    """
    from millrace.operators.build import greedy_keep

    sigs = signatures(batch, key, text)
    near = nearest(sigs, index, threshold) if index is not None else sigs.select("key", F.col("key").alias("found"), F.lit(1.0).alias("similarity")).limit(0)
    left = sigs.join(near, "key", "left_anti")
    own = build_index(left)
    pairs = alike(own, own, threshold).where("asked < found").select(F.col("asked").alias("a"), F.col("found").alias("b"))
    dropped = greedy_keep(pairs).where("not kept").select(F.col("doc_id").alias("key"))
    kept = own.join(dropped, "key", "left_anti")
    over = left.join(kept.select("key"), "key", "left_anti").select("key")
    reasons = near.select("key", "found").unionByName(nearest(left.join(over, "key"), kept, threshold).select("key", "found"))
    decisions = batch.select(F.col(key).alias("key")).join(reasons, "key", "left").withColumn("kept", F.col("found").isNull())
    return decisions, kept if index is None else index.unionByName(kept.select(index.columns))
