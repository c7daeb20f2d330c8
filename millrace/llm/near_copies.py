"""Near-duplicates by the Jaccard similarity of five-word shingle sets, at least 0.8: SimHash and a vantage-point tree, then an exact check.

Two sets that similar differ in any bit of a SimHash with a chance of at most 0.16 (0.1875 for sets of under SMALL shingles),
so a pair's distance is binomial: beyond CLOSE, in the first 128 bits or in all 256, it is in less than 2 of 10^9
cases even at 0.8 itself. Their sizes are within a factor of 5/4 of each other. One vantage-point tree over both (the larger
one of the Hamming distance and the scaled difference of the sizes' logarithms is a metric) deals every distinct set to
shards by the triangle inequality. At this radius Hamming balls of unrelated texts all overlap, so it is the sizes by
which the tree prunes, and within a shard sets of sizes that fit are compared all with all, in cells of two parts: the work grows
with the square of the texts, at a few nanoseconds a pair. Parts are ranges of sizes, so a set is dealt only to cells where a size fits.

Every set that has others within the radius is first checked against the least of them; only those that are then still in
different components are checked with each other, so a large group of near copies costs no square of exact checks. A pair is
checked by its sets only if parity sketches leave room for it: a shingle that one set alone holds flips one bit, so two sets
that similar differ in no more bits than (n + m) / 9. That loses nothing.
"""

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import freed, id_and_text, named, packed, store, unpacked
from millrace.llm.components import connected_components
from millrace.llm.line_dedup import _in_mask
from millrace.llm.simhash import grow_tree, route

WIDTH = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
NUM, DEN = 4, 5
#: 64-bit words of a fingerprint; sets under SMALL shingles have a wider radius.
WORDS, SMALL = 4, 16
#: Most bits that differ in the first two words and in all, for pairs with a set under SMALL shingles and for the others.
CLOSE = ((54, 90), (50, 80))
#: The tree's radius; points it is grown on; those of a leaf; the part of a node's square below which a split pays.
RADIUS, SAMPLE, LEAF, WORTH = 90, 4096, 16, 0.85
#: Sets of a part of a shard, and parts of a shard (parts grow beyond them, so that a set goes to no more cells).
PART, MOST_PARTS = 1 << 14, 32
#: Rows and columns that are compared at once.
ROWS, COLS = 64, 2048
#: Least bits of a set's parity sketch; it has as many as the set has shingles, rounded up to a power of two.
SKETCH = 1024
_ADDED = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)
_NONE = np.iinfo(np.int64).max


def shingle_set(body: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the lower-cased word shingles, ascending; a shorter text is one shingle."""
    words = body.lower().split() if body else []
    if not words:
        return np.zeros(0, np.int64)
    width = min(width, len(words))
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s : e - 1], 42) for s, e in zip(starts, starts[width:])]), np.int64))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


def simprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits: a bit is 1 if it is set in over half of the hashes (or of their mixtures, from the second word on)."""
    h = shingles.view(np.uint64)
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(h), 255):
        x = h[at : at + 255, None] + _ADDED
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).view(np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits in 64-bit numbers: the parity of the set's hashes that fall on each. Its halves' difference is the sketch of half the bits."""
    bits = max(SKETCH, 1 << (max(1, len(shingles)) - 1).bit_length())
    parity = (np.bincount(shingles & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def points_of(n: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The points of the tree's metric: fingerprints, and the logarithms of sizes in such steps that RADIUS is a factor of 5/4."""
    out = np.empty(len(n), [("fp", np.uint64, (WORDS,)), ("size", np.float64)])
    out["fp"], out["size"] = prints, np.log(n) * (RADIUS / np.log(DEN / NUM))
    return out


def apart(points: np.ndarray, vantage) -> np.ndarray:
    """The larger one of the bits and of the size steps that differ, a metric."""
    return np.maximum(np.bitwise_count(points["fp"] ^ vantage["fp"]).sum(1), np.abs(points["size"] - vantage["size"]))


def near_blocks(n, prints, n2, prints2, same):
    """Yield (i, j), indexes of pairs within the radius and within sizes that fit, by blocks; n and n2 ascend.

    same: both are one list, of which every pair comes once.
    """
    low, high = np.searchsorted(n2 * DEN, n * NUM), np.searchsorted(n2 * NUM, n * DEN, "right")
    columns = np.ascontiguousarray(prints2[:, :2].T)
    for at in range(0, len(n), ROWS):
        own = prints[at : at + ROWS]
        end = high[min(len(n), at + ROWS) - 1]
        for to in range(max(low[at], at) if same else low[at], end, COLS):
            bound = CLOSE[int(min(n[at], n2[to]) >= SMALL)]
            upto = min(end, to + COLS)
            bits = np.bitwise_count(own[:, :1] ^ columns[0, to:upto])
            bits += np.bitwise_count(own[:, 1:2] ^ columns[1, to:upto])
            i, j = np.divmod(np.flatnonzero(bits <= bound[0]), upto - to)
            i, j = i + at, j + to
            fit = (j > i if same else j >= low[i]) & (j < high[i])
            i, j = i[fit], j[fit]
            held = np.bitwise_count(prints[i] ^ prints2[j]).sum(1) <= bound[1]
            yield i[held], j[held]


def by_size(steps: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of a shard: ranges of size steps of at most PART sets each (or an even share for MOST_PARTS); a step of more has several parts.

    steps ascend; m: sets of a step; low and high: its sizes. Returns steps, the first part of each and how many it has; low and high of each part.
    """
    most = max(PART, -(-int(m.sum()) // MOST_PARTS))
    first, among, lows, highs, room = [], [], [], [], 0
    for own, least, largest in zip(m.tolist(), low.tolist(), high.tolist()):
        if own <= room:
            room -= own
            highs[-1] = largest
            first.append(len(lows) - 1)
            among.append(1)
        else:
            among.append(-(-own // most))
            first.append(len(lows))
            lows += [least] * among[-1]
            highs += [largest] * among[-1]
            room = most - own if own <= most else 0
    return steps, *[np.array(x, np.int64) for x in (first, among, lows, highs)]


def fitting(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first part that has a size that fits n, and the one after the last; low and high of the parts ascend."""
    return np.searchsorted(high * DEN, n * NUM), np.searchsorted(low * NUM, n * DEN, "right")


class Forest:
    """A vantage-point tree over sets' fingerprints and sizes; its shards are compared in cells of two parts of a shard."""

    def __init__(self, nodes: DataFrame):
        """nodes: (node, n, fp, ...). The tree is grown on a bounded sample, its shape never decides a result."""
        rate, n = 1 << 30, nodes.count()
        drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(rate)) < int(rate * min(1.0, SAMPLE / max(n, 1))))
        drawn = sorted((r["n"], bytes(r["fp"])) for r in drawn.select("n", "fp").collect())
        sample = points_of(np.array([x[0] for x in drawn], np.int64), np.frombuffer(b"".join(x[1] for x in drawn), np.uint64).reshape(-1, WORDS))
        self.tree = grow_tree(sample, RADIUS + 1e-6, LEAF, apart, WORTH)

    def _cells(self, nodes: DataFrame) -> DataFrame:
        """A row of nodes for each cell (shard, i, j) that it belongs to, with its part. Any two within RADIUS whose sizes fit meet in a cell of a shard.

        A shard's parts are ranges of sizes, and a set goes only to the cells of its part with parts that have a size that fits its own.
        """
        tree, names = self.tree, nodes.columns

        def routed(batch):
            """Sizes, their steps, and the shards with their rows."""
            n, prints = batch.column("n").to_numpy(), np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64)
            points = points_of(n, prints.reshape(-1, WORDS))
            return n.astype(np.int64), points["size"].astype(np.int64), route(points, tree, RADIUS + 1e-6, apart)

        def count(batches):
            for batch in batches:
                n, step, shards = routed(batch)
                for shard, rows in shards:
                    rows = rows[np.argsort(n[rows])]
                    steps, first, m = np.unique(step[rows], return_index=True, return_counts=True)
                    columns = [np.full(len(steps), shard), steps, m, n[rows][first], n[rows][first + m - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "step", "m", "low", "high"])

        counted = nodes.select("n", "fp").mapInArrow(freed(count), "shard long, step long, m long, low long, high long")
        held: dict[int, list] = {}
        for shard, *row in sorted(map(tuple, counted.groupBy("shard", "step").agg(F.sum("m"), F.min("low"), F.max("high")).collect())):
            held.setdefault(shard, []).append(row)
        parts = {shard: by_size(*np.array(rows, np.int64).T) for shard, rows in held.items()}

        def deal(batches):
            for batch in batches:
                node, (n, step, shards) = batch.column("node").to_numpy(), routed(batch)
                for shard, rows in shards:
                    steps, first, among, low, high = parts[shard]
                    at = np.searchsorted(steps, step[rows])
                    part = first[at] + ((node[rows].view(np.uint64) >> np.uint64(20)) % among[at].astype(np.uint64)).astype(np.int64)
                    least, end = fitting(n[rows], low, high)
                    for k in range(int((end - least).max())):
                        own = np.nonzero(least + k < end)[0]
                        other = least[own] + k
                        cell = [np.full(len(own), shard), np.minimum(part[own], other), np.maximum(part[own], other), part[own]]
                        columns = batch.take(pa.array(rows[own])).columns
                        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cell], *columns], names=["shard", "i", "j", "part", *names])

        dealt = nodes.mapInArrow(freed(deal), "shard int, i int, j int, part int, " + ", ".join(f"{c} {t}" for c, t in nodes.dtypes))
        cells = sum(int((fitting(high, low, high)[1] - np.arange(len(high))).sum()) for *_, low, high in parts.values())
        return dealt.repartition(max(1, min(4096, cells)), "shard", "i", "j").groupBy("shard", "i", "j")

    def leads(self, nodes: DataFrame) -> DataFrame:
        """nodes (node, n, fp) -> (node, lead): of every node that has another one within the radius, the least such."""

        def find(table: pa.Table) -> pa.Table:
            (node, n, prints), (node2, n2, prints2), same = _sides(table, _core)
            least, least2 = np.full(len(node), _NONE), np.full(len(node2), _NONE)
            for i, j in near_blocks(n, prints, n2, prints2, same):
                np.minimum.at(least, i, node2[j])
                np.minimum.at(least2, j, node[i])
            node, least = np.concatenate([node, node2]), np.concatenate([least, least2])
            return pa.table([node[least < _NONE], least[least < _NONE]], names=["node", "lead"])

        found = self._cells(nodes.select("node", "n", "fp")).applyInArrow(find, "node long, lead long")
        return store(found.groupBy("node").agg(F.min("lead").alias("lead")), "leads")

    def pairs(self, nodes: DataFrame) -> DataFrame:
        """nodes (node, n, fp, sk, c) -> (a, b): all pairs within the radius whose c differ and whose sketches leave room."""

        def fold(batches):
            for batch in batches:
                *columns, sk, c = batch.columns
                folded = [np.bitwise_xor.reduce(np.array(x, np.int64).reshape(-1, SKETCH // 64), axis=0).tobytes() for x in sk.to_pylist()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(folded, pa.binary()), c], names=["node", "n", "fp", "sk", "c"])

        def find(table: pa.Table) -> pa.Table:
            (node, n, prints, sk, c), (node2, n2, prints2, sk2, c2), same = _sides(table, lambda t: (*_core(t), _numbers(t["sk"], SKETCH // 64), t["c"].to_numpy()))
            out = [np.zeros((2, 0), np.int64)]
            for i, j in near_blocks(n, prints, n2, prints2, same):
                other = c[i] != c2[j]
                i, j = i[other], j[other]
                for at in range(0, len(i), 1 << 14):
                    x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    held = np.bitwise_count(sk[x] ^ sk2[y]).sum(1) * (NUM + DEN) <= (n[x] + n2[y]) * (DEN - NUM)
                    out.append(np.stack([np.minimum(node[x], node2[y]), np.maximum(node[x], node2[y])])[:, held])
            return pa.table(list(np.unique(np.concatenate(out, axis=1), axis=1)), names=["a", "b"])

        folded = nodes.select("node", "n", "fp", "sk", "c").mapInArrow(freed(fold), "node long, n int, fp binary, sk binary, c long")
        return self._cells(folded).applyInArrow(find, "a long, b long").distinct()


def _numbers(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _core(table: pa.Table) -> tuple[np.ndarray, ...]:
    return table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64), _numbers(table["fp"], WORDS)


def _sides(table: pa.Table, read):
    """The columns of a cell's two parts, sizes ascending, and whether they are one part."""
    table = table.sort_by([("n", "ascending"), ("node", "ascending")])
    first, part = table["i"][0].as_py(), table["part"].to_numpy()
    if first == table["j"][0].as_py():
        return read(table), read(table), True
    return read(table.filter(pa.array(part == first))), read(table.filter(pa.array(part != first))), False


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sizes and sketches allow for a similar set; nodes: (node, n, sk)."""
    both = pairs.join(nodes.select("node", "n", "sk").toDF("a", "na", "ska"), "a").join(nodes.select("node", "n", "sk").toDF("b", "nb", "skb"), "b")
    return both.where(_fits()).select("a", "b")


def _fits():
    def sized(own, other):
        """A sketch at the other's size: sets of sizes that fit each other are at most one halving apart."""
        half = F.floor(F.size(own) / 2).cast("int")
        halved = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halved).otherwise(F.col(own))

    differing = F.zip_with(sized("ska", "skb"), sized("skb", "ska"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    flipped = F.aggregate(differing, F.lit(0), lambda n, x: n + x)
    sizes = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    return sizes & (flipped * (NUM + DEN) <= (F.col("na") + F.col("nb")) * (DEN - NUM))


def _links(pairs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are similar; sets are made again from one text of each node in them."""
    pairs = store(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = prints.join(wanted, "node").groupBy("node").agg(F.min(F.struct("di", "dh")).alias("d"))
    wanted = store(wanted.select("d.di", "d.dh"), "wanted")

    def make(batches):
        for batch in batches:
            sets = [shingle_set(body) for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "s"])

    def check(batches):
        for batch in batches:
            a, b, sa, sb = [c.to_pylist() for c in batch.columns]
            held = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[held] if c else c, pa.int64()) for c in (a, b)], names=["a", "b"])

    texts = _in_mask(rows, wanted, ["di", "dh"])[0].join(wanted, ["di", "dh"]).dropDuplicates(["di", "dh"]).select("body")
    sets = store(texts.mapInArrow(freed(make), "node long, s binary"), "sets")
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return store(full.mapInArrow(freed(check), "a long, b long"), "links")


def near_copies(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, component) for every row of df; component is the least id reachable by links of Jaccard 0.8 or more."""
    rows = id_and_text(df, id_col, text_col, F.coalesce(named(id_col).cast("long"), F.lit(-(1 << 63))).alias("di"), F.xxhash64(named(text_col)).alias("dh"))

    def make(batches):
        for batch in batches:
            ids, bodies, di, dh = batch.columns
            sets = [shingle_set(body) for body in bodies.to_pylist()]
            parts = [ids, di, dh, pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            parts += [pa.array([simprint(s).tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(parts, names=["id", "di", "dh", "node", "n", "fp", "sk"])

    prints = store(rows.mapInArrow(freed(make), "id long, di long, dh long, node long, n int, fp binary, sk array<long>"), "prints")
    nodes = store(prints.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "sk")]), "nodes")
    forest = Forest(nodes)
    leads = forest.leads(nodes)
    led = store(leads.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "led")
    links = _links(_plausible(led, nodes), prints, rows)
    label = connected_components(links)
    marked = nodes.join(leads.select("node"), "node").join(label, "node", "left").withColumn("c", F.coalesce("root", "node"))
    rest = forest.pairs(store(marked, "marked")).join(led, ["a", "b"], "left_anti")
    roots = connected_components(links.unionAll(_links(_plausible(rest, nodes), prints, rows)))
    whole = store(prints.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")), "roots")
    return whole.join(whole.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def keep_one_of_each(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of df without near-duplicates: of each group the one with the least id, once. Columns stay.

    Rows with a null id cannot be told apart by their decision, so they stay.
    """
    stays = near_copies(df, id_col, text_col).where("id = component").select("id").distinct()
    rows = packed(df, named(id_col).cast("long").alias("id"))
    once = W.partitionBy("id").orderBy(F.lit(0))
    kept = rows.where("id is not null").join(stays, "id").withColumn("n", F.row_number().over(once)).where("n = 1")
    return kept.select(*unpacked(df.columns)).unionAll(df.where(named(id_col).isNull()).select(*map(named, df.columns)))
