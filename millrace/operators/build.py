"""Dataset building: splits by content, leaks, duplicates, rejects, samples."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import clean_prose, hash_split, shingles, stable_hash, state_key, words

#: Documents that the order of shingles is learned from, and the most shingles that it sets back.
ORDER_DOCS, ORDER_SHINGLES = 4_000, 100_000
#: Documents of a block of pairs; hashes that texts are first looked for by; room for the rounding of thresholds.
BLOCK, MARKS, SLACK = 128, 1 << 21, 1e-6


def reject_reasons(docs: DataFrame) -> DataFrame:
    """One row per document: split, and the first reason to reject it (null: it is kept)."""
    base = docs.select("doc_id", "source", hash_split(F.col("text")).alias("split"), state_key(F.col("text")).alias("k"), clean_prose(F.col("text")).alias("clean"))
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    first_split = F.min("r").over(W.partitionBy("k"))
    nth = F.row_number().over(W.partitionBy("k", "split").orderBy("doc_id"))
    marked = base.withColumn("r", rank).withColumn("first", first_split).withColumn("n", nth)
    reason = F.when(F.col("first") < F.col("r"), "leak").when(F.col("n") > 1, "duplicate").when(~F.col("clean"), "not_prose")
    return marked.select("doc_id", "source", "split", reason.alias("reason"))


def manifest(docs: DataFrame) -> DataFrame:
    rows = reject_reasons(docs).select("source", "split", F.coalesce("reason", F.lit("kept")).alias("reason"))
    return rows.groupBy("source", "split", "reason").agg(F.count("*").alias("n"))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def without_states_of(df: DataFrame, other: DataFrame, text_col: str = "text") -> DataFrame:
    """Left anti join on the state key."""
    seen = other.select(state_key(F.col(text_col)).alias("__k")).distinct()
    return df.withColumn("__k", state_key(F.col(text_col))).join(seen, "__k", "left_anti").drop("__k")


def hash_sample(df: DataFrame, group: list, key: Column, seed, n: int) -> DataFrame:
    """n rows of each group in the order of a seeded hash, whatever the partitioning."""
    spot = F.row_number().over(W.partitionBy(*group).orderBy(stable_hash(seed, key), key))
    return df.withColumn("__n", spot).where(F.col("__n") <= n).drop("__n")


def round_robin(df: DataFrame, label: str, key: Column, seed, n: int) -> DataFrame:
    """The i-th row of each label in turn until there are n."""
    spot = F.row_number().over(W.partitionBy(label).orderBy(stable_hash(seed, key), key))
    return df.withColumn("turn", spot).where(F.col("turn") <= n).orderBy("turn", label).limit(n)


def quota(df: DataFrame, cell: list, hard: Column, key: Column, seed, share: float) -> DataFrame:
    """All hard rows and a rounded share of the easy ones of each cell."""
    w = W.partitionBy(*cell, "__hard")
    marked = df.withColumn("__hard", hard).withColumn("__size", F.count("*").over(w))
    marked = marked.withColumn("__n", F.row_number().over(w.orderBy(stable_hash(seed, key), key)))
    return marked.where(F.col("__hard") | (F.col("__n") <= F.bround(F.col("__size") * share))).drop("__hard", "__size", "__n")


def weighted_sample(df: DataFrame, weight: Column, u: Column, key: Column, n: int) -> DataFrame:
    """Without replacement: the largest u ** (1 / weight)."""
    return df.withColumn("__k", F.log(F.greatest(u, F.lit(1e-12))) / weight).orderBy(F.desc("__k"), key).limit(n).drop("__k")


def fill_budget(groups: DataFrame, order: list, size: str, budget: int) -> DataFrame:
    """Whole groups in order until the budget is reached; the last one gives what is missing.

    groups: one row per group, not per item. The running sum is over groups.
    """
    before = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    taken = F.least(F.col(size), F.greatest(F.lit(0), budget - F.coalesce(before, F.lit(0))))
    return groups.withColumn("taken", taken).where("taken > 0")


def temperature_weights(sizes: DataFrame, size: str, exponent: float = 0.3) -> DataFrame:
    """p proportional to size ** exponent; sizes has one row per source."""
    p = F.pow(F.col(size).cast("double"), exponent)
    return sizes.withColumn("p", p / F.sum(p).over(W.partitionBy()))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, s): hashes of the shingles, ascending."""
    # explode keeps the optimizer from moving the word split into the lambda, where it would run for every shingle
    tokens = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    sets = tokens.select("doc_id", F.array_sort(F.transform(shingles(F.col("w"), width), lambda s: F.xxhash64(s))).alias("s"))
    return sets.select("doc_id", F.explode(F.array("s")).alias("s"))


def _stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        import tempfile

        context.setCheckpointDir(tempfile.gettempdir() + "/checkpoints")
    return df.checkpoint()


def _shingle_order(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three sampled documents or more, ascending, and of how many. It sets frequent ones back and never decides a result."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, ORDER_DOCS / max(docs.count(), 1))))
    often = shingle_sets(some, width).select(F.explode("s").alias("k")).groupBy("k").count().where("count >= 3")
    found = sorted((r["k"], r["count"]) for r in often.orderBy(F.desc("count"), "k").limit(ORDER_SHINGLES).collect())
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def shingle_prints(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, c, n, keys, sk), written once: class of the shingle set (128 bits of hash; null for a null text) and its size,
    the shingles that a similar set must share one of (rare ones first), and a parity sketch: each shingle flips one bit."""
    order = docs.sparkSession.sparkContext.broadcast(_shingle_order(docs, width))

    def ordered(s):
        often, times = order.value
        if len(often):
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            s = s[np.argsort(np.where(often[at] == s, times[at], 0), kind="stable")]
        return s[: len(s) - math.ceil(threshold * len(s) - SLACK) + 1]

    def sketched(s):
        bits = max(64, 1 << (len(s) - 1).bit_length())
        return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)

    def make(batches):
        for batch in batches:
            sets = [s.values.to_numpy() if s.is_valid else None for s in batch.column(1)]
            keys, sk = ([None if s is None else f(s) for s in sets] for f in (ordered, sketched))
            n = [None if s is None else len(s) for s in sets]
            arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sk, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "c", "n", "keys", "sk"])

    named = F.when(F.col("s").isNotNull(), F.struct(F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("i")))
    sets = shingle_sets(docs, width).select("doc_id", "s", named.alias("c"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _stored(sets.mapInArrow(make, f"doc_id {kind}, c struct<h: bigint, i: bigint>, n int, keys array<bigint>, sk array<bigint>"))


def shingle_classes(prints: DataFrame) -> DataFrame:
    """(doc_id, representative): the first document with an equal shingle set. A null text has itself."""
    rep = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.min("doc_id").over(W.partitionBy("c")))
    alone = prints.where("c is null").select("doc_id", F.col("doc_id").alias("representative"))
    return prints.where("c is not null").select("doc_id", "c").select("doc_id", rep.alias("representative")).unionAll(alone)


def _sketches_fit(threshold: float):
    """May the sets of a row's sketches (ska, skb) and sizes (na, nb) be similar? A shingle that one set alone holds flips one bit."""

    def sized(own, other):
        """A sketch at the other's size: its halves' difference is the sketch of half the bits."""
        half = F.floor(F.size(own) / 2).cast("int")
        halved = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halved).otherwise(F.col(own))

    differing = F.zip_with(sized("ska", "skb"), sized("skb", "ska"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    flipped = F.aggregate(differing, F.lit(0), lambda n, x: n + x)
    return flipped <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + SLACK


def jaccard_pairs(docs: DataFrame, prints: DataFrame | None = None, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Pairs of distinct texts whose shingle sets have at least that Jaccard similarity.

    Of documents with equal sets only the first is in a pair; shingle_classes tells the others. Nothing is lost: of a set's
    shingles in one order, two similar sets share one of the first n - ceil(threshold * n) + 1, and the first that they share
    leaves room for the rest (positions); sketches leave room too. Only for what then is left are the sets made again and compared.
    """
    prints = shingle_prints(docs, threshold, width) if prints is None else prints
    firsts = first_per_key(prints.where("c is not null"), ["c"], "doc_id")
    keys = firsts.select("doc_id", "n", F.posexplode("keys").alias("p", "k"))
    a, b = keys.toDF("a", "na", "pa", "k"), keys.toDF("b", "nb", "pb", "k")
    close = (F.col("na") >= threshold * F.col("nb") - SLACK) & (F.col("nb") >= threshold * F.col("na") - SLACK)
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    room = most >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - SLACK
    met = a.join(b, "k").where((F.col("a") < F.col("b")) & close & room).select("a", "b").distinct()
    sketches = prints.select("doc_id", "n", "sk")
    both = met.join(sketches.toDF("a", "na", "ska"), "a").join(sketches.toDF("b", "nb", "skb"), "b")
    return _compared(_stored(both.where(_sketches_fit(threshold)).select("a", "b")), docs, threshold, width)


def _compared(pairs: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b, jaccard) of those pairs that are similar. A set goes to each cell that it has pairs in, not to each pair.

    A cell has the pairs between two blocks of documents; a block has at most about BLOCK documents with the same least partner.
    """
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(pairs.select("b", "a"))
    leads = ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("lead"))
    sizes = leads.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.xxhash64("lead", F.pmod(F.xxhash64("x"), "blocks"))
    blocks = _stored(leads.join(sizes, "lead").select("x", block.alias("block")))
    placed = pairs.join(blocks.toDF("a", "ba"), "a").join(blocks.toDF("b", "bb"), "b")
    cells = _stored(placed.select("a", "b", F.xxhash64("ba", "bb").alias("cell")))
    needs = cells.select("cell", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    marks = F.broadcast(blocks.select(F.pmod(F.xxhash64("x"), F.lit(MARKS)).alias("mark")).distinct())
    texts = docs.join(marks, F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) == F.col("mark"), "left_semi")
    texts = texts.select("doc_id", "text").join(blocks.select(F.col("x").alias("doc_id")), "doc_id")
    sets = needs.join(shingle_sets(texts, width), "doc_id")
    given = sets.groupBy("cell").agg(F.collect_list(F.struct("doc_id", "s")).alias("sets"))
    asked = cells.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def make(batches):
        for batch in batches:
            out = [], [], []
            for sets, pairs in zip(batch.column(0), batch.column(1)):
                flat, lists = sets.values.field("doc_id").to_pylist(), sets.values.field("s")
                of = dict(zip(flat, (x.values.to_numpy() for x in lists)))
                for a, b in zip(*(pairs.values.field(c).to_pylist() for c in "ab")):
                    c = len(np.intersect1d(of[a], of[b], assume_unique=True))
                    j = c / (len(of[a]) + len(of[b]) - c)
                    if j >= threshold:
                        for column, x in zip(out, (a, b, j)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[batch.schema.field(1).type.value_type.field("a").type] * 2, pa.float64()))], names=["a", "b", "j"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = given.join(asked, "cell").select("sets", "pairs").mapInArrow(make, f"a {kind}, b {kind}, j double")
    return held.select("a", "b", F.round("j", 6).alias("jaccard"))


def greedy_keep(pairs: DataFrame) -> DataFrame:
    """First come, first kept: of pairs (a < b), the items dropped because an earlier kept item is near.

    Rounds until all are decided; an item is kept when no earlier neighbour can still be kept, and dropped when
    one is kept. Chains a~b~c so keep a and c. State is checkpointed between rounds.
    """
    edges = _stored(pairs.select("a", "b").distinct())
    nodes = _stored(edges.select(F.col("a").alias("x")).union(edges.select("b")).distinct().withColumn("state", F.lit(0)))
    while nodes.where("state = 0").limit(1).count():
        earlier = edges.join(nodes.toDF("a", "sa"), "a").groupBy(F.col("b").alias("x")).agg(
            F.max(F.expr("sa = 1")).alias("near_kept"), F.min(F.expr("sa = 2")).alias("all_dropped")
        )
        state = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("near_kept", F.lit(False)), 2).when(F.coalesce("all_dropped", F.lit(True)), 1).otherwise(0)
        nodes = nodes.join(earlier, "x", "left").select("x", state.alias("state")).checkpoint()
    return nodes.select(F.col("x").alias("doc_id"), (F.col("state") == 1).alias("kept"))


def near_members(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per document: its representative in pairs, how many documents that stands for, and how many pairs it is in."""
    ends = pairs.select(F.col("a").alias("representative")).unionAll(pairs.select("b")).groupBy("representative").agg(F.count("*").alias("n"))
    found = shingle_classes(prints).withColumn("n_members", F.count("*").over(W.partitionBy("representative")))
    return found.join(ends, "representative", "left").select("doc_id", "representative", "n_members", F.coalesce("n", F.lit(0)).alias("n_links"))


def greedy_near(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, kept) for every document: a folded copy is similar to whatever kept its representative or dropped it, so it goes."""
    decided = greedy_keep(pairs).withColumnRenamed("doc_id", "representative")
    kept = (F.col("doc_id") == F.col("representative")) & F.coalesce("kept", F.lit(True))
    return shingle_classes(prints).join(decided, "representative", "left").select("doc_id", kept.alias("kept"))
