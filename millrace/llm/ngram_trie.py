"""Language-model scoring with a sharded Elias-Fano bigram trie.

Model: absolute discounting with back-off. A pair that training holds has (c - D) / c(context); any other pair has
D * (distinct successors of the context) / c(context) times the add-one probability of its word (just that
probability where training lacks the context). Sums over words stay at most 1.

Every batch of documents deals its (context, word, document) counts to shards by the context's hash, the pairs of
very frequent contexts also by the word's, so no shard is larger than its share. A shard builds its part of the
trie from the training counts: an Elias-Fano level of contexts, a level of monotone pointers and a level of
successors relative to their context, each with a two-byte quantised probability, in a memory-mapped file; then it
answers the pairs of all documents by successor search and returns sums for each document. So nothing grows on
one machine, and all traffic is in proportion to the text.
"""

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, id_and_text, store

DISCOUNT = 0.75
#: UTF-8 bytes of text for each shard; bytes and documents of a batch; share from which a context counts as frequent.
SHARD_BYTES, BATCH_BYTES, BATCH_DOCS, FREQUENT = 6 << 20, 8 << 20, 16384, 1e-3
_START, _END = 0x1234567812345678, 0x8765432187654321
_SHORT = np.uint64(24)  # a successor is known within its context by the high 40 bits of its hash
_HELD = 1 << 15
ROWS = "kind int, key long, a long, b long, blob binary"
HEADER, PARTIAL, UNSEEN, WORD, HOT, DISTINCT = range(6)
COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

#: Quantised numerators c - D in two bytes: exact up to 4096 occurrences, then rounded down by less than 0.05 %.
_STEPS = np.unique(np.concatenate([np.arange(1, 4097), np.floor(4096 * 1.0005 ** np.arange(1, 60000))]))
_LOGS = np.log10(_STEPS - DISCOUNT)


class EliasFano:
    """An ascending sequence below a universe: low bytes as they are, high parts in unary with a directory of zeros."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        ratio = max(1, universe // max(1, self.n))
        self.low_bytes = min(7, -(-(ratio.bit_length() - 1) // 8))
        self.shift = np.uint64(8 * self.low_bytes)
        values = np.asarray(values, np.uint64)
        self.low = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, : self.low_bytes].copy()
        high = (values >> self.shift).astype(np.int64)
        self.top = int((universe - 1) >> int(self.shift)) + 1
        bits = np.zeros(-(-(self.n + self.top + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.bits = np.packbits(bits).reshape(-1, 8)
        ones = bits.reshape(-1, 64).sum(1, dtype=np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    def to_file(self, file) -> "EliasFano":
        """The same with its large parts memory-mapped from an open file."""
        for name in ("low", "bits"):
            part = getattr(self, name)
            at = file.seek(0, 2)
            file.write(part.tobytes())
            file.flush()
            if part.size:
                setattr(self, name, np.memmap(file, part.dtype, "r", at, part.shape))
        return self

    def _first(self, high: np.ndarray) -> np.ndarray:
        """Place of the first value whose high part is at least this one."""
        k = high - 1  # after the k-th zero
        word = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        lanes = np.unpackbits(self.bits[word], axis=1) == 0
        nth = np.maximum(k, 0) - self.zeros[word] + 1
        inside = (np.cumsum(lanes, axis=1, dtype=np.int8) >= nth[:, None]).argmax(1)
        return np.where(high > 0, word * 64 + inside - k, 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: successor search among those with its high part."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> self.shift).astype(np.int64)
        low = values & ((np.uint64(1) << self.shift) - np.uint64(1))
        inside = high < self.top
        high = np.minimum(high, self.top - 1)
        at, end = self._first(high), self._first(high + 1)
        size = end - at
        while (size > 0).any():
            half = size // 2
            middle = np.minimum(at + half, self.n - 1)
            less = (self._low(middle) < low) & (size > 0)
            at = np.where(less, at + half + 1, at)
            size = np.where(less, size - half - 1, half)
        hit = inside & (at < end)
        hit[hit] = self._low(at[hit]) == low[hit]
        return np.where(hit, at, -1)

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.low_bytes] = self.low[at]
        return out.view(np.uint64)[:, 0]

    def values(self) -> np.ndarray:
        """The whole sequence (for tests)."""
        ones = np.nonzero(np.unpackbits(self.bits.reshape(-1)))[0]
        return ((ones - np.arange(self.n)).astype(np.uint64) << self.shift) | self._low(np.arange(self.n))


class Trie:
    """contexts and pairs ascending, counts of the pairs -> lookups of (context, word) in memory-mapped levels."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        self.file = tempfile.TemporaryFile()
        names, starts = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(names), dtype=np.uint64), np.diff(np.append(starts, len(context))))
        self.contexts = EliasFano(names, 1 << 64).to_file(self.file)
        self.pointers = EliasFano(starts, max(1, len(context) + 1)).to_file(self.file)
        self.successors = EliasFano((rank << np.uint64(40)) | word, max(1, len(names)) << 40).to_file(self.file)
        self.code = (np.searchsorted(_STEPS, count, side="right") - 1).astype(np.uint16)

    def log_numerator(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10(c - D) of each pair, NaN where training lacks it."""
        rank = self.contexts.find(context)
        at = self.successors.find((np.maximum(rank, 0).astype(np.uint64) << np.uint64(40)) | word)
        at = np.where(rank >= 0, at, -1)
        out = np.full(len(at), np.nan)
        out[at >= 0] = _LOGS[self.code[at[at >= 0]]]
        return out


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def _chunks(batches):
    """Lists of (id, body, held out) of bounded size."""
    out, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if out and (size + len(row[1] or b"") > BATCH_BYTES or len(out) == BATCH_DOCS):
                yield out
                out, size = [], 0
            out.append(row)
            size += len(row[1] or b"")
    if out:
        yield out


def frequent_words(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of all words with a share of at least FREQUENT (at most 2 / FREQUENT of them), and bytes of text.

    A word that frequent has half its occurrences in chunks where its share is at least half of that.
    """

    def count(batches):
        for chunk in _chunks(batches):
            times: dict[bytes, int] = {}
            total = 0
            for _, body, _ in chunk:
                words = (body or b"").lower().split()
                total += len(words)
                for w in words:
                    times[w] = times.get(w, 0) + 1
            many = [(w, n) for w, n in times.items() if n >= FREQUENT / 2 * total]
            n_bytes = sum(len(b or b"") for _, b, _ in chunk)
            names = [b""] + [w for w, _ in many]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([total] + [n for _, n in many], pa.int64()), pa.array([n_bytes] + [0] * len(many), pa.int64())],
                names=["word", "n", "n_bytes"],
            )

    counts = rows.mapInArrow(count, "word binary, n long, n_bytes long").groupBy("word")
    found = store(counts.agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("b")), "frequent")
    total = found.where(F.octet_length("word") == 0).first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    hot = found.where((F.octet_length("word") > 0) & (F.col("n") >= FREQUENT / 2 * total["n"])).collect()
    return _hashes(sorted(bytes(r["word"]) for r in hot)), total["b"]


def _place(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "key", "a", "b", "blob"])


def _deal_chunk(chunk: list, batch: int, hot: np.ndarray, shards: int):
    """Rows (kind, key = shard or -1 - batch, batch, 0, blob)."""
    index: dict[bytes, int] = {}
    parts = []
    for _, body, _ in chunk:
        words = (body or b"").lower().split()
        parts.append(np.array([-2] + [index.setdefault(w, len(index)) for w in words] + [-1], np.int64))
    n_words = len(index)
    hashes = np.concatenate([_hashes(list(index)) if index else np.zeros(0, np.uint64), np.array([_START, _END], np.uint64)])
    sizes = np.array([len(p) for p in parts])
    full = np.concatenate(parts)
    full[full < 0] += n_words + 2
    doc = np.repeat(np.arange(len(chunk)), sizes)
    inner = doc[1:] == doc[:-1]
    context, word, doc = full[:-1][inner], full[1:][inner], doc[:-1][inner]
    width, docs = n_words + 2, len(chunk)
    key, times = np.unique((context * width + word) * docs + doc, return_counts=True)
    doc, pair = key % docs, key // docs
    context, word = pair // width, pair % width
    more = (times - 1) // 255  # a count has one byte: larger ones are dealt in parts
    if more.any():
        again = np.repeat(np.arange(len(times)), more + 1)
        first = np.concatenate([[True], again[1:] != again[:-1]])
        times = np.where(first, (times - 255 * more)[again], 255)
        doc, context, word = doc[again], context[again], word[again]
    is_hot = _place(hot, hashes) >= 0
    short = hashes >> _SHORT
    shard = (short % np.uint64(shards)).astype(np.int64)[context]
    spread = is_hot[context]
    shard[spread] = ((short[context[spread]] * np.uint64(31) + short[word[spread]] * np.uint64(0x9E3779B1)) % np.uint64(shards)).astype(np.int64)
    held = np.array([bool(r[2]) for r in chunk])
    marked = (doc + _HELD * held[doc]).astype(np.uint16)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        rows = order[edges[s] : edges[s + 1]]
        if len(rows):
            own = context[rows]
            new = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
            runs = np.diff(np.append(new, len(rows))).astype(np.uint32)
            successors = short[word[rows]].view(np.uint8).reshape(-1, 8)[:, :5]
            head = np.array([len(new), len(rows)], np.uint32)
            blob = b"".join(x.tobytes() for x in (head, hashes[own[new]], runs, successors, marked[rows], times[rows].astype(np.uint8)))
            yield PARTIAL, s, batch, 0, blob
    hot_doc, hot_word = np.repeat(np.arange(docs), sizes), _place(hot, hashes)[full]
    seen = hot_word >= 0
    pairs, times = np.unique(hot_doc[seen] * len(hot) + hot_word[seen], return_counts=True)
    ids = np.array([0 if r[0] is None else r[0] for r in chunk], np.int64)
    null = np.array([r[0] is None for r in chunk])
    head = np.array([docs, len(pairs)], np.int64)
    blob = b"".join(x.tobytes() for x in (head, ids, sizes - 1, pairs, times.astype(np.int64), null, held))
    yield HEADER, -1 - batch, batch, 0, blob


def _read(blob: bytes, *kinds):
    """Consecutive arrays of (dtype, length) from a blob."""
    out, at = [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _shard(table: pa.Table, hot: np.ndarray):
    """Build the shard's trie from its training counts, answer its pairs, return sums for each document."""
    context, word, marked, times, of = [], [], [], [], []
    batches = table["a"].to_pylist()
    for k, blob in enumerate(table["blob"].to_pylist()):
        n_contexts, n = _read(blob, ("<u4", 2))[0].tolist()
        _, names, runs, successors, docs, counts = _read(blob, ("<u4", 2), ("<u8", n_contexts), ("<u4", n_contexts), ("u1", 5 * n), ("<u2", n), ("u1", n))
        context.append(np.repeat(names, runs))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = successors.reshape(-1, 5)
        word.append(wide.view(np.uint64)[:, 0])
        marked.append(docs)
        times.append(counts)
        of.append(np.full(n, k, np.int32))
    context, word, marked, times, of = map(np.concatenate, (context, word, marked, times, of))
    order = np.lexsort((word, context))
    context, word, marked, times, of = context[order], word[order], marked[order], times[order].astype(np.int64), of[order]
    trained = (marked & _HELD) == 0
    new_context = np.concatenate([[True], context[1:] != context[:-1]])
    new = new_context | np.concatenate([[True], word[1:] != word[:-1]])
    which = np.cumsum(new) - 1  # pair of each entry
    count = np.bincount(which, times * trained).astype(np.int64)
    pair_context, pair_word = context[new], word[new]
    context_of = (np.cumsum(new_context) - 1)[new]
    c = np.bincount(context_of, count).astype(np.int64)
    successors = np.bincount(context_of, count > 0).astype(np.int64)
    held = count > 0
    trie = Trie(pair_context[held], pair_word[held], count[held])
    names = context[new_context]
    rank = _place(hot, names)
    is_hot = rank >= 0
    log = np.empty(len(pair_word))
    for at in range(0, len(log), 1 << 18):
        log[at : at + (1 << 18)] = trie.log_numerator(pair_context[at : at + (1 << 18)], pair_word[at : at + (1 << 18)])
    trie.file.close()
    unseen = np.isnan(log)
    known = (c > 0) & ~is_hot
    with np.errstate(divide="ignore"):
        log_c = np.where(known, np.log10(np.maximum(c, 1)), 0.0)
        log_back = np.where(known, np.log10(DISCOUNT * np.maximum(successors, 1)), 0.0)
    value = np.where(unseen, log_back[context_of], log) - log_c[context_of]
    base = np.where(is_hot, 0.0, np.log10(c + 1.0))[context_of]
    is_known = known[context_of]
    doc = (marked & (_HELD - 1)).astype(np.int64)
    flat = of.astype(np.int64) * _HELD + doc
    docs, place = np.unique(flat, return_inverse=True)
    score_sum = np.bincount(place, value[which] * times)
    base_sum = np.bincount(place, base[which] * times)
    known_sum = np.bincount(place, is_known[which] * times).astype(np.int64)
    out = []
    edges = np.searchsorted(docs, np.arange(len(batches) + 1) * _HELD)
    for k, batch in enumerate(batches):
        a, b = edges[k], edges[k + 1]
        head = np.array([b - a], np.int64)
        blob = b"".join(x.tobytes() for x in (head, score_sum[a:b], base_sum[a:b], known_sum[a:b], (docs[a:b] % _HELD).astype(np.uint16)))
        out.append((PARTIAL, batch, 0, 0, blob))
    for k in np.nonzero(is_hot)[0]:
        out.append((HOT, int(rank[k]), int(c[k]), int(successors[k]), None))
    out.append((DISTINCT, 0, int(known.sum()), 0, None))
    yield _record(out)

    def plain(kind, key, a, b):
        none = pa.nulls(len(key), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b), none], names=["kind", "key", "a", "b", "blob"])

    yield plain(WORD, (names[known] >> _SHORT).astype(np.int64), c[known], np.zeros(int(known.sum()), np.int64))
    entry = np.nonzero(unseen[which])[0]
    numbers = np.array(batches, np.int64)
    yield plain(
        UNSEEN, word[entry].astype(np.int64), (numbers[of[entry]] << 16) | doc[entry],
        ((rank[context_of[which[entry]]] + 1) << 16) | times[entry],
    )


def score(df: DataFrame, id_col="doc_id", text_col="text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """The scores of every row of df; those whose crc32(id) mod modulus is remainder are not learned from.

    A null text is empty: its only token is the end. Rows with a null id are learned from. Without any training
    text all counts are 0 and every token has the same probability, 1 / (0 + 0 + 1).
    """
    rows = id_and_text(df, id_col, text_col, held_out(F.col(id_col).cast("long"), modulus, remainder).alias("held"))
    frequent, n_bytes = frequent_words(rows)
    hot = np.unique(np.concatenate([frequent, np.array([_START, _END], np.uint64)]))
    shards = max(1, -(-n_bytes // SHARD_BYTES))

    def deal(batches):
        number = TaskContext.get().partitionId() << 20
        for k, chunk in enumerate(_chunks(batches)):
            for row in _deal_chunk(chunk, number + k, hot, shards):
                yield _record([row])

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a batch's header goes on as it is
            parts = [_record([(HEADER, b, 0, 0, x) for b, x in zip(table["a"].to_pylist(), table["blob"].to_pylist())])]
        else:
            parts = _shard(table, hot)
        return pa.Table.from_batches(list(parts))

    dealt = rows.mapInArrow(deal, ROWS)
    out = store(dealt.groupBy("key").applyInArrow(work, ROWS), "ngrams")
    totals = {r["key"]: (r["c"], r["s"]) for r in out.where(F.col("kind") == HOT).groupBy("key").agg(F.sum("a").alias("c"), F.sum("b").alias("s")).collect()}
    hot_c = np.array([totals.get(k, (0, 0))[0] for k in range(len(hot))], np.int64)
    hot_successors = np.array([totals.get(k, (0, 0))[1] for k in range(len(hot))], np.int64)
    start, end = int(np.searchsorted(hot, np.uint64(_START))), int(np.searchsorted(hot, np.uint64(_END)))
    train_docs = int(hot_c[start])
    hot_c[end] = train_docs  # every training text has one end
    is_word = np.arange(len(hot)) != start
    distinct = out.where(F.col("kind") == DISTINCT).agg(F.sum("a")).first()[0] or 0
    vocabulary = int(distinct) + int(((hot_c > 0) & is_word).sum())
    in_words = out.where(F.col("kind") == WORD).agg(F.sum("a")).first()[0] or 0
    train_tokens = int(in_words) + int(hot_c[is_word].sum())
    log_all = float(np.log10(train_tokens + vocabulary + 1))
    spark = df.sparkSession
    words = out.where(F.col("kind") == WORD).groupBy("key").agg(F.max("a").alias("c"))
    few = [(int(h >> _SHORT), int(n)) for k, (h, n) in enumerate(zip(hot, hot_c)) if k != start]
    words = words.unionAll(spark.createDataFrame(few, "key long, c long")).groupBy("key").agg(F.max("c").alias("c"))
    back = np.where(hot_c > 0, np.log10(DISCOUNT * np.maximum(hot_successors, 1)), 0.0)
    backs = F.broadcast(spark.createDataFrame([(0, 0.0)] + [(k + 1, float(x)) for k, x in enumerate(back)], "h long, back double"))
    unseen = (
        out.where(F.col("kind") == UNSEEN)
        .select("key", "a", F.shiftright("b", 16).alias("h"), F.col("b").bitwiseAND(0xFFFF).alias("n"))
        .join(words, "key", "left")
        .join(backs, "h")
        .groupBy("a")
        .agg(F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) + F.col("back"))).alias("x"), F.sum("n").cast("double").alias("y"))
        .select(F.lit(UNSEEN).alias("kind"), F.shiftright("a", 16).alias("key"), F.col("a").bitwiseAND(0xFFFF).alias("a"), "x", "y", F.lit(None).cast("binary").alias("blob"))
    )
    sums = out.where(F.col("kind").isin(HEADER, PARTIAL)).select("kind", "key", F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "blob")
    hot_base, hot_log = np.log10(hot_c + 1.0), np.where(hot_c > 0, np.log10(np.maximum(hot_c, 1)), 0.0)

    def finish(table: pa.Table) -> pa.Table:
        kinds, blobs = table["kind"].to_numpy(), table["blob"].to_pylist()
        header = blobs[int(np.nonzero(kinds == HEADER)[0][0])]
        docs, n_pairs = _read(header, ("<i8", 2))[0].tolist()
        _, ids, n_tokens, pairs, times, null, held = _read(header, ("<i8", 2), ("<i8", docs), ("<i8", docs), ("<i8", n_pairs), ("<i8", n_pairs), ("?", docs), ("?", docs))
        doc, k = pairs // len(hot), pairs % len(hot)
        word = k != start
        base = np.bincount(doc, hot_base[k] * times * word, docs) - n_tokens * log_all
        known = np.bincount(doc, (hot_c[k] > 0) * word * times, docs).astype(np.int64)
        total = -np.bincount(doc, hot_log[k] * times * (k != end), docs)
        for i in np.nonzero(kinds == PARTIAL)[0]:
            n = int(_read(blobs[i], ("<i8", 1))[0][0])
            _, s, b, m, at = _read(blobs[i], ("<i8", 1), ("<f8", n), ("<f8", n), ("<i8", n), ("<u2", n))
            total[at] += s
            base[at] += b
            known[at] += m
        rest = kinds == UNSEEN
        at = table["a"].to_numpy()[rest]
        total[at] += table["x"].to_numpy()[rest] - table["y"].to_numpy()[rest] * log_all
        columns = [pa.array(ids, mask=null), pa.array(held), pa.array(n_tokens), pa.array(known), pa.array(np.full(docs, train_tokens)), pa.array(base), pa.array(total)]
        return pa.table(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    return sums.unionByName(unseen).groupBy("key").applyInArrow(finish, COLUMNS)
