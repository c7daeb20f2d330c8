"""Exact dedup against history through a sharded minimal perfect hash.

An index shard holds the distinct SHA-256 digests whose first bytes fall to it. A perfect hash of several bit
levels gives each of its n digests its own slot of n; slots hold the full digest, the winner (largest id) and the
row count. An arriving digest is looked up in its shard and believed only if all 32 bytes of the slot agree;
digests that are no members form groups of their own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import store

#: Digests that a shard should hold, bits for each key in a level, and levels before the rest is listed outright.
SHARD_ROWS, GAMMA, LEVELS = 65536, 2, 24
INDEX = "shard int, sizes array<long>, bits binary, digests binary, winners binary, counts binary"
CLASSES = "d binary, winner long, n long, member boolean"


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """keys: (n, 4) uint64 words of digests."""
    x = keys[:, 1] ^ (keys[:, 2] + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """digests: (n, 32) uint8, distinct -> level sizes, packed bits, slot of each digest (those left over come last)."""
    keys = np.ascontiguousarray(digests).view(np.uint64)
    slot = np.full(len(keys), -1, np.int64)
    rest, sizes, levels, placed = np.arange(len(keys)), [], [], 0
    while len(rest) and len(sizes) < LEVELS:
        size = max(64, GAMMA * len(rest))
        at = _slots(keys[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        slot[rest[won]] = placed + (np.cumsum(alone) - 1)[at[won]]
        placed += int(won.sum())
        sizes.append(size)
        levels.append(alone)
        rest = rest[~won]
    slot[rest] = placed + np.arange(len(rest))
    bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    return sizes, bits, slot


def find(digests: np.ndarray, sizes, bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Slot of each digest whose 32 bytes are in held (n, 32), else -1."""
    out = np.full(len(digests), -1, np.int64)
    keys = np.ascontiguousarray(digests).view(np.uint64)
    flags = np.unpackbits(bits)[: sum(sizes)]
    rank = np.cumsum(flags, dtype=np.int64)
    rest, base = np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _slots(keys[rest], level, size)
        hit = flags[at] == 1
        out[rest[hit]] = rank[at[hit]] - 1
        rest, base = rest[~hit], base + size
    first_listed = int(rank[-1]) if len(rank) else 0
    if len(rest) and first_listed < len(held):
        listed = {bytes(r): first_listed + i for i, r in enumerate(held[first_listed:])}
        out[rest] = [listed.get(bytes(digests[i]), -1) for i in rest]
    asked = np.nonzero(out >= 0)[0]
    wrong = (held[out[asked]] != digests[asked]).any(1)
    out[asked[wrong]] = -1
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build_shard(table: pa.Table) -> pa.Table:
    digests = _matrix(table["d"])
    sizes, bits, slot = build(digests)
    order = np.argsort(slot)
    winners = np.array([-(1 << 63) if w is None else w for w in table["winner"].to_pylist()], np.int64)
    counts = table["n"].to_numpy()
    row = [[table["shard"][0].as_py()], [sizes], [bits.tobytes()], [digests[order].tobytes()], [winners[order].tobytes()], [counts[order].astype(np.int64).tobytes()]]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(r, k) for r, k in zip(row, kinds)], names=["shard", "sizes", "bits", "digests", "winners", "counts"])


def _look_up_shard(arriving: pa.Table, index: pa.Table) -> pa.Table:
    digests, winner = _matrix(arriving["d"]), arriving["winner"].to_pylist()
    n = arriving["n"].to_pylist()
    member = [False] * len(digests)
    spare: list = []
    if index.num_rows:
        held = np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        winners, counts = (np.frombuffer(index[c][0].as_py(), np.int64) for c in ("winners", "counts"))
        slot = find(digests, index["sizes"][0].as_py(), np.frombuffer(index["bits"][0].as_py(), np.uint8), held)
        for i in np.nonzero(slot >= 0)[0]:
            old = int(winners[slot[i]])
            member[i] = True
            n[i] += int(counts[slot[i]])
            winner[i] = max([x for x in (winner[i], old) if x is not None and x != -(1 << 63)], default=None)
        spare = np.setdiff1d(np.arange(len(held)), slot[slot >= 0]).tolist()
        digests = np.concatenate([digests, held[spare]])
        winner += [None if (w := int(winners[s])) == -(1 << 63) else w for s in spare]
        n += [int(counts[s]) for s in spare]
        member += [True] * len(spare)
    return pa.table(
        [pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(winner, pa.int64()), pa.array(n, pa.int64()), pa.array(member, pa.bool_())],
        names=["d", "winner", "n", "member"],
    )


def _shard(n: int):
    return F.pmod(F.xxhash64("d"), F.lit(max(1, -(-n // SHARD_ROWS)))).cast("int").alias("shard")


def digest_rows(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, d): SHA-256 of the whole text, a null text counting as empty; texts themselves move no further."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("d"))


def build_index(rows: DataFrame, shards_for: int) -> DataFrame:
    """rows (id, d) of history -> one row for each shard of the index, a written table."""
    groups = rows.groupBy("d").agg(F.max("id").alias("winner"), F.count("*").alias("n"))
    return store(groups.select("*", _shard(shards_for)).groupBy("shard").applyInArrow(_build_shard, INDEX), "mph")


def look_up(rows: DataFrame, index: DataFrame, shards_for: int) -> DataFrame:
    """All classes (d, winner, n, member): of arriving rows (id, d), merged with history's, and history's others."""
    groups = rows.groupBy("d").agg(F.max("id").alias("winner"), F.count("*").alias("n"))
    return (
        groups.select("*", _shard(shards_for))
        .groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInArrow(_look_up_shard, CLASSES)
    )


def exact_duplicates(df: DataFrame, id_col="doc_id", text_col="text", is_history=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for every row of df.

    is_history: a condition on the column id that says which rows are already indexed; by default a fixed half of
    the ids. It never changes the result, only which rows meet the index as members. The largest id of equal
    texts stays; of repeated rows with that id one is kept. Null ids never win over others: in a group of null ids
    alone keep_id is null and one row is kept.
    """
    if is_history is None:
        is_history = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    rows = store(digest_rows(df, id_col, text_col), "digests")
    past = F.coalesce(is_history, F.lit(False))
    size = rows.count()
    index = build_index(rows.where(past), size)
    classes = look_up(rows.where(~past), index, size).where("n > 1").select("d", "winner", F.col("n").alias("size"))
    same = rows.groupBy("d", "id").agg(F.count("*").alias("copies"))
    joined = same.join(classes, "d", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("winner")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("d")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
