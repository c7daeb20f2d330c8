"""SimHash near-duplicates, linked by vantage-point trees over Hamming distance.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one 32-bit half. So there is a
tree for each half, searched with radius 1, and every pair that meets is checked on all 64 bits. A tree is
grown on a bounded sample (its shape never decides a result), shipped to the executors, and deals every
distinct fingerprint to a shard: inside a node's ball, outside it, or to both when the triangle inequality
leaves room for a partner on the other side. Shards go on splitting by the same rule in memory.
"""

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, map_rows, store
from millrace.llm.components import connected_components

#: Distinct fingerprints that a shard should own, sample points for each shard, and the sample's bound.
SHARD_ROWS, SAMPLE_PER_SHARD, SAMPLE_BOUND = 4096, 8, 65536
#: Sets up to this size are compared outright.
BLOCK = 512


def shingle_fingerprint(body: bytes | None, width: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles; 0 where there is no word."""
    words = body.lower().split() if body else []
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, starts[width:])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col="doc_id", text_col="text", width: int = 3) -> DataFrame:
    """(id, fp) for every row of df."""
    return map_rows(
        id_and_text(df, id_col, text_col),
        lambda cols: [cols[0], [shingle_fingerprint(b, width) for b in cols[1]]],
        "id long, fp long",
    )


def hamming(values: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(values ^ vantage)


def grow_tree(points: np.ndarray, radius: float, leaf: int, distance=hamming, worth: float = np.inf) -> list[tuple]:
    """Nodes (vantage, mu, inside, outside) or (None, shard, 0, 0), the root first.

    worth: a node splits only if the squares of its two parts, what stands in both included, come to less than that
    part of its own square.
    """
    nodes: list = []
    shards = 0
    todo = [(np.asarray(points), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        best = None
        if len(own) > leaf:
            for v in own[:: max(1, len(own) // 8)][:8]:
                d = distance(own, v)
                mu = int(np.median(d))
                inside = float((d <= mu).mean())
                spare = float(((d > mu) & (d <= mu + radius)).mean())
                if 0 < inside < 0.95 and (inside + spare) ** 2 + (1 - inside) ** 2 < worth and (best is None or abs(inside - 0.5) + spare < best[0]):
                    best = (abs(inside - 0.5) + spare, v, mu, d)
        if best is None:
            nodes.append([None, shards, 0, 0])
            shards += 1
        else:
            nodes.append([best[1], best[2], 0, 0])
            todo += [(own[best[3] <= best[2]], len(nodes) - 1, 0), (own[best[3] > best[2]], len(nodes) - 1, 1)]
    return [tuple(n) for n in nodes]


def route(values: np.ndarray, nodes: list[tuple], radius: float, distance=hamming):
    """Yield (shard, indexes): where one of a pair within radius is, the other is in one common shard too."""
    todo = [(0, np.arange(len(values)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        vantage, mu, inside, outside = nodes[at]
        if vantage is None:
            yield mu, rows
            continue
        d = distance(values[rows], vantage)
        todo += [(inside, rows[d <= mu + radius]), (outside, rows[d > mu])]


def _blocks(fps: np.ndarray, rows: np.ndarray, radius: int):
    """Sets of indexes such that every pair within radius is in one of them, split while splitting pays."""
    todo = [(rows, 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= BLOCK or depth > 40:
            yield rows
            continue
        best = None
        for v in fps[rows[:: max(1, len(rows) // 4)][:4]]:
            d = np.bitwise_count(fps[rows] ^ v)
            mu = int(np.median(d))
            a, b = int((d <= mu + radius).sum()), int((d > mu).sum())
            if best is None or a * a + b * b < best[0]:
                best = (a * a + b * b, d, mu)
        cost, d, mu = best
        if cost > 0.85 * len(rows) ** 2:
            yield rows
        else:
            todo += [(rows[d <= mu + radius], depth + 1), (rows[d > mu], depth + 1)]


def _flatten(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n points over the edges u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def local_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (not all pairs) of the links within radius among distinct fingerprints: two index arrays."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in _blocks(fps, np.arange(len(fps)), radius):
        own = fps[rows]
        label = np.arange(len(rows))
        while True:
            before = label.copy()
            for at in range(0, len(rows), BLOCK):
                for to in range(0, len(rows), 8 * BLOCK):
                    near = np.bitwise_count(own[at : at + BLOCK, None] ^ own[None, to : to + 8 * BLOCK]) <= radius
                    low = np.where(near, label[None, to : to + 8 * BLOCK], len(rows)).min(1)
                    label[at : at + BLOCK] = np.minimum(label[at : at + BLOCK], low)
            label = label[label]
            if np.array_equal(label, before):
                break
        moved = label != np.arange(len(rows))
        us.append(rows[moved])
        vs.append(rows[label[moved]])
    label = _flatten(len(fps), np.concatenate(us), np.concatenate(vs))
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return moved, label[moved]


def _halves(fps: np.ndarray) -> list[np.ndarray]:
    raw = fps.astype(np.int64).view(np.uint64)
    return [(raw >> np.uint64(32)).astype(np.uint32), (raw & np.uint64(0xFFFFFFFF)).astype(np.uint32)]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """distinct (fp): edges (a, b) that connect just the fingerprints connected by steps of at most radius bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = min(SAMPLE_BOUND, max(1, n * SAMPLE_PER_SHARD // SHARD_ROWS))
    rate = 1 << 30
    drawn = distinct.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(rate)) < int(rate * min(1.0, wanted / max(n, 1))))
    sample = np.array(sorted(r[0] for r in drawn.collect()), np.int64)
    half_radius = radius // 2
    trees = [grow_tree(h, half_radius, SAMPLE_PER_SHARD) for h in _halves(sample)]

    def deal(frames):
        for pdf in frames:
            fps = pdf["fp"].to_numpy(np.int64)
            for k, half in enumerate(_halves(fps)):
                for shard, rows in route(half, trees[k], half_radius):
                    yield pd.DataFrame({"tree": k, "shard": shard, "fp": fps[rows]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy(np.int64))
        u, v = local_links(fps.view(np.uint64), radius)
        return pd.DataFrame({"a": fps[u], "b": fps[v]})

    dealt = distinct.mapInPandas(deal, "tree int, shard int, fp long")
    return dealt.groupBy("tree", "shard").applyInPandas(join, "a long, b long")


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of df, repeated rows and null ids too.

    Null or empty texts have fingerprint zero and are linked like any other. component_id is the least id among
    the documents reachable by links of at most radius bits (null if all of those have a null id).
    """
    prints = store(fingerprints(df, id_col, text_col, width), "prints")
    classes = store(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    roots = connected_components(links(classes.select("fp"), radius))
    whole = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    whole = store(whole, "roots")
    least = whole.where("root <> fp").select("root").distinct()
    grouped = (
        whole.join(least, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("low")).withColumnRenamed("root", "r")
    )
    member = whole.join(grouped, whole.root == grouped.r, "left").select("fp", F.coalesce("low", "rep").alias("component"))
    return prints.join(member, "fp").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
