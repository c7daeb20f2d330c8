"""Packing by lexical retrieval: a sharded BM25 inverted index fills the windows of seeds with unused neighbours.

Seeds are the texts of rows whose id is divisible by SEED_EVERY (the stated query set); all other texts are placed by what
the index answers. In a pass every seed is scored by all of its terms against every unused text of every shard and
has its NEIGHBOURS best ones. Seeds take them in turns: the r-th best in turn r, unless another seed has it already, the
lesser seed first. Texts that no seed has taken are asked for again in the next pass, until none is left that shares a term
with a seed; those few follow each other. A seed and what it took, in the order taken, are cut into windows of 1024 tokens;
the last tokens of a chain become sequences whose lengths are powers of two, so nothing is padded.

A map over the input writes the index: a row for each shard of bounded size with its postings and token ids, so texts are
read once; equal words of some MB of texts are encoded once. Shards hold texts of one lexical cluster (centres are learned from a bounded sample, every text is dealt). A seed
asks the shards of all clusters whose centre is at least NEAR_CENTRE times as near as the nearest one (recall against all
shards is measured in the tests); texts that no seed takes so are asked for everywhere. A task scores its shards of a cluster together, frequent terms by a matrix product, the others by their postings.
Equal texts are one text in the index, and its copies follow it, or, where they are many, form chains of their own by shard.

The scored pairs are at most the square of the texts divided by SEED_EVERY.
"""

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import freed, id_and_text, release, store

WINDOW, SEED_EVERY = 1024, 20
TERMS = 1 << 18
K1, B = 1.2, 0.75
#: UTF-8 bytes and documents that a shard holds at most (a longer text is a shard of its own).
SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 14
#: Best unused texts that a seed is told in a pass.
NEIGHBOURS = 128
#: Terms of seeds, and seeds, that are broadcast at once; documents whose marks are broadcast at once (a bit each).
BLOCK_TERMS, BLOCK_SEEDS, BLOCK_DOCS = 1 << 22, 1 << 15, 1 << 26
#: One shard in so many is asked first for a bound of each seed's NEIGHBOURS-th best score.
SAMPLED_SHARDS = 8
#: Clusters, and the sampled texts (and the longest one) that they are learned from.
CLUSTERS, SAMPLE_DOCS, SAMPLE_BYTES = 16, 2048, 1 << 16
#: A seed asks the clusters whose centre is at least this part as near as the nearest.
NEAR_CENTRE = 0.3
#: Copies of a text up to which they follow it; of more, each shard's are a chain.
FEW_COPIES = 32
#: Scores are compared in steps of one part in so many.
STEPS = 64
#: Seeds that one group of the merged answers holds, scores in memory at once, answers held before they are cut (or half as many again as the last cut left).
SEED_GROUP, CELLS, HELD = 512, 1 << 20, 1 << 20
#: Unused texts of a cluster that are scored together, postings that wait for that in a task, partitions of the index that a task reads.
JOINED, WAITING, READ_AT_ONCE = 4096, 1 << 21, 2
#: A term is frequent if one text in so many has it; postings that are added to scores at once.
HOT_PART, TOUCHED = 25, 1 << 15
#: Bytes of texts whose equal segments are encoded once; bytes of texts whose ids are put together at once.
CHUNK_BYTES, PART_BYTES = 1 << 21, 1 << 19
#: Fixed value: the pattern that cuts a text before byte-pair merging in this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOCAL, _WINDOWS = 14, 19  # bits of a document's number in its shard, and of a sequence's in its chain
_INDEX = {"sizes": np.int32, "tokens": np.uint16, "lengths": np.int32, "terms": np.int32, "first": np.int32, "docs": np.uint16, "times": np.uint16}
_ENTRY = "k1 long, k2 long, low long, n int, is_seed boolean, size int, docs array<long>"
_loaded: dict = {}


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def vocabulary_of(name: str) -> tuple:
    """Of a vocabulary file: tiktoken's encoding, one for texts whose white space stands alone between other characters, and the bytes of each id."""
    if name not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte, vocabulary = _byte_of(), model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):  # ids serve as ranks, which is right only in this order
            raise ValueError(f"{name}: token ids do not follow the order of merges")
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if all(c in byte for c in word) and i != 50256}
        width = np.zeros(1 << 16, np.int64)
        width[list(ranks.values())] = list(map(len, ranks))
        of = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, PATTERN.replace(r"|\s+(?!\S)", ""))]
        _loaded[name] = (*of, width)
    return _loaded[name]


def encoder(name: str):
    """text -> uint16 token ids, as tokenizers gives them for the vocabulary file name."""
    whole = vocabulary_of(name)[0]

    def encode(text: str) -> np.ndarray:
        return whole.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    return encode


def terms_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of the lower-cased words, distinct and ascending, and how often each stands there."""
    words = body.lower().split()
    found = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(TERMS - 1)
    found.sort()
    new = np.flatnonzero(found[1:] != found[:-1]) + 1
    edges = np.concatenate([[0], new, [len(found)]]) if len(found) else np.zeros(1, np.int64)
    return found[edges[:-1]].astype(np.int32), np.diff(edges)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from starts[k] on, sizes[k] (1 or more) of them, for each k in turn."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    end = np.cumsum(sizes)
    out = np.ones(end[-1], np.int64)
    out[0] = starts[0]
    out[end[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out, out=out)


def _solid() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that surely end, or begin, a character that is no white space, in Unicode's sense."""
    last, first = np.arange(256) > 32, np.arange(256) > 32
    for c in _WIDE:
        last[c[-1]] = first[c[0]] = False
    return last, first


_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]  # white space of two or three bytes
_LAST, _FIRST = _solid()


def _is_wide(data: np.ndarray) -> np.ndarray:
    """Bytes that begin one of _WIDE."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xC2)
    at = at[~_FIRST[data[at]]]
    one, two, three = (np.take(data, at + k, mode="clip").astype(np.int32) if len(data) else at for k in range(3))
    out[at] = np.isin(one << 8 | two, [int.from_bytes(c) for c in _WIDE if len(c) == 2]) | np.isin(one << 16 | two << 8 | three, [int.from_bytes(c) for c in _WIDE if len(c) == 3])
    return out


def segments(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Edges of segments of the texts that lie between edges in data; an empty segment ends each text.

    A text is cut before single spaces and line ends between other characters. PATTERN cuts there whatever stands around, and words end
    there, so ids and terms of a text are those of its segments, one after the other.
    """
    space = np.flatnonzero((data == 32) | (data == 10))
    begins = np.zeros(len(data) + 1, bool)
    begins[edges] = True
    space = space[~begins[space]]
    space = space[_LAST[data[space - 1]] & _FIRST[data[np.minimum(space + 1, len(data) - 1)]]]
    ends = edges[1:]
    out = np.concatenate([edges[:1], space, ends, ends[np.diff(edges) > 0]])
    out.sort()
    return out


def _learned(data: np.ndarray, edges: np.ndarray, vocabulary: str) -> tuple[np.ndarray, ...]:
    """Tokens of the distinct segments between edges, where those of each begin and how many there are; the same of terms."""
    whole, plain, width = vocabulary_of(vocabulary)
    sizes = np.diff(edges)
    white = np.append(0, np.cumsum((data <= 32) | _is_wide(data)))[edges]
    regular = (sizes > 1) & (np.diff(white) == 1)  # white space, then none: these can be encoded one after the other
    at = edges[:-1][regular]
    regular[regular] = ((data[at] == 32) | (data[at] == 10)) & _FIRST[data[at + 1]] & _LAST[data[at + sizes[regular] - 1]]
    joined = data[np.repeat(regular, sizes)].tobytes()
    try:
        text = joined.decode()
    except UnicodeDecodeError:
        regular[:], joined, text = False, b"", ""
    tokens = plain.encode_to_numpy(text, disallowed_special=()).astype(np.uint16) if text else np.zeros(0, np.uint16)
    words = joined.lower().split()
    terms = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(TERMS - 1)
    token_at, term_at = (np.zeros(len(sizes), np.int64) for _ in range(2))
    n_tokens, n_terms = (np.zeros(len(sizes), np.int64) for _ in range(2))
    ends = np.append(0, np.searchsorted(np.cumsum(width[tokens]), np.cumsum(sizes[regular]), "right"))
    token_at[regular], n_tokens[regular] = ends[:-1], np.diff(ends)
    term_at[regular], n_terms[regular] = np.arange(len(terms)), 1
    others = np.flatnonzero(~regular)
    bodies = [data[edges[k] : edges[k + 1]].tobytes() for k in others.tolist()]
    ids = [whole.encode_ordinary(b.decode("utf-8", "replace")) if b else [0] for b in bodies]
    words = [b.lower().split() for b in bodies]
    for at, n, own, flat in ((token_at, n_tokens, ids, tokens), (term_at, n_terms, words, terms)):
        n[others] = np.fromiter(map(len, own), np.int64, len(own))
        at[others] = len(flat) + np.cumsum(n[others]) - n[others]
    tokens = np.append(tokens, np.array([i for x in ids for i in x], np.uint16))
    terms = np.append(terms, np.array([zlib.crc32(w) & (TERMS - 1) for x in words for w in x], np.uint32))
    return tokens, token_at, n_tokens, terms, term_at, n_terms


def encoded(data: np.ndarray, edges: np.ndarray, vocabulary: str):
    """For some of the texts between edges at a time, their tokens and their edges; terms (distinct and ascending within a text), how often each
    stands there, and their edges."""
    at = segments(data, edges)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    last = np.flatnonzero(np.diff(at) == 0)  # one for each text
    number, (_, offsets, values) = found.indices.to_numpy(), found.dictionary.buffers()
    del at
    known = _learned(np.frombuffer(values or b"", np.uint8), np.frombuffer(offsets, np.int64)[: len(found.dictionary) + 1], vocabulary)
    a = 0
    while a < len(last):
        b = min(max(a + 1, int(np.searchsorted(edges, edges[a] + PART_BYTES, "right")) - 1), a + SHARD_DOCS, len(last))
        own = number[last[a - 1] + 1 if a else 0 : last[b - 1] + 1]
        text_at, out = last[a:b] - (last[a - 1] + 1 if a else 0), []
        for flat, first, sizes in (known[:3], known[3:]):
            n = sizes[own]
            some = n > 0
            out += [flat[ranges(first[own[some]], n[some])], np.append(0, np.cumsum(n)[text_at])]
        tokens, token_at, terms, term_at = out
        keys = terms | np.repeat(np.arange(b - a, dtype=np.uint32) << np.uint32(18), np.diff(term_at))
        keys.sort()
        new = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
        times, keys = np.diff(np.append(new, len(keys))), keys[new]
        yield tokens, token_at, (keys & np.uint32(TERMS - 1)).astype(np.int32), times, np.searchsorted(keys >> np.uint32(18), np.arange(b - a + 1))
        a = b


class Router:
    """Lexical clusters of texts: unit vectors of the sample's most frequent terms, grouped by their nearest centre."""

    def __init__(self, bodies: list[bytes], near: float = NEAR_CENTRE, width: int = 1024, rounds: int = 12):
        self.near = near
        found = [terms_of(b)[0] for b in bodies]
        df = np.bincount(np.concatenate(found) if found else np.zeros(0, int), minlength=TERMS)
        common = np.argsort(-df, kind="stable")[:width]
        idf = np.log1p(len(found) / (df[common] + 0.5)).astype(np.float32)
        self.column = np.full(TERMS, -1, np.int16)
        self.column[common] = np.arange(width)
        x = np.zeros((len(found), width), np.float32)
        for k, terms in enumerate(found):
            own = self.column[terms]
            x[k, own[own >= 0]] = idf[own[own >= 0]]
        x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
        rng = np.random.default_rng(4)
        centres = x[rng.permutation(len(x))[:CLUSTERS]] if len(x) else np.zeros((1, width), np.float32)
        for _ in range(rounds if len(x) else 0):
            own = (x @ centres.T).argmax(1)
            sums = np.array([x[own == k].sum(0) for k in range(len(centres))])
            centres = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
        self.weights = np.ascontiguousarray((centres * idf).T)  # a text's length does not change its nearest centre

    def nearness(self, terms: np.ndarray) -> np.ndarray:
        own = self.column[terms]
        return self.weights[own[own >= 0]].sum(0)

    def nearest(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cluster of each text; at: edges of their terms."""
        out = np.zeros(len(at) - 1, np.int64)
        for a in range(0, len(out), 256):
            edges = at[a : a + 257]
            own = self.column[terms[edges[0] : edges[-1]]]
            text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            x = np.zeros((len(edges) - 1, len(self.weights)), np.float32)
            x[text[own >= 0], own[own >= 0]] = 1
            out[a : a + 256] = (x @ self.weights).argmax(1)
        return out

    def asked(self, terms: np.ndarray) -> int:
        """The clusters that a seed asks, a bit each."""
        near = self.nearness(terms)
        return sum(1 << k for k in np.nonzero(near >= self.near * near.max())[0].tolist())


def make_shard(rows: list[tuple]) -> dict[str, np.ndarray]:
    """rows (tokens, terms, times) -> the arrays of a shard (_INDEX): postings by term, then by document."""
    tokens, terms, times = zip(*rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(t) for t in terms])
    keys = np.concatenate(terms).astype(np.uint64) << np.uint64(30) | doc << np.uint64(16) | np.minimum(np.concatenate(times), 65535).astype(np.uint64)
    keys.sort()
    term = (keys >> np.uint64(30)).astype(np.int32)
    terms, first = np.unique(term, return_index=True)
    parts = {"sizes": [len(t) for t in tokens], "tokens": np.concatenate(tokens), "lengths": [t.sum() for t in times]}
    parts |= {"terms": terms, "first": np.append(first, len(term)), "docs": keys >> np.uint64(16) & np.uint64(SHARD_DOCS - 1), "times": keys & np.uint64(65535)}
    return {k: np.asarray(parts[k]).astype(kind) for k, kind in _INDEX.items()}


def saturated(times: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / max(mean, 1e-9)))


def squeezed(tokens: bytes) -> bytes:
    """Token ids as they stand in the index: entropy-coded, which neither the table's nor the shuffle's own compression does."""
    return pa.Codec("zstd", compression_level=3).compress(tokens, asbytes=True)


def unsqueezed(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 2 * n, codec="zstd"), np.uint16)


def best_of(number: np.ndarray, seed: np.ndarray, doc: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the best answers of each seed, most at most (number: its document), best first, and their ranks.

    Equal scores stand in the order of a hash, another one for each seed, so that equal answers do not go to one seed.
    One number holds what is sorted by: 18 bits of the seed's place, 26 of its score, 20 of the hash.
    """
    x = (number[seed].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(44)
    top = (1 << 26) - 1
    order = np.argsort((seed.astype(np.uint64) << np.uint64(46)) | ((top - np.minimum(score, top)).astype(np.uint64) << np.uint64(20)) | x)
    sorted_ = seed[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    return order[rank < most], rank[rank < most]


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: those that hardly change lie together and are compressed in a shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def of_planes(blobs: list[bytes], kind) -> np.ndarray:
    kind = np.dtype(kind)
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1) for b in blobs]
    return np.concatenate([np.zeros(0, kind), *parts])


class Search:
    """Answers of shards to a block of seeds, cut to the best ones of each seed; shards of a cluster are scored together."""

    def __init__(self, number: np.ndarray, clusters: np.ndarray, at: np.ndarray, terms: np.ndarray, bound: np.ndarray, idf: np.ndarray, mean: float, most: int):
        self.number, self.clusters, self.at, self.terms, self.idf, self.mean, self.most = number, clusters, at, terms, idf, mean, most
        self.bound = bound.copy()  # a seed's answers below it are no longer asked for
        self.wanted = np.zeros(TERMS, bool)
        self.wanted[terms] = True
        self.found: list = []
        self.size = self.left = 0
        self.waiting: dict[int, list] = {}

    def add(self, shard: int, cluster: int, live: np.ndarray, lengths, terms, first, docs, times) -> None:
        """live: which documents of the shard are unused."""
        if not live.any() or not (self.clusters >> cluster & 1).any():
            return
        counts = np.diff(first)
        use = live[docs] & np.repeat(self.wanted[terms], counts)
        term, docs = np.repeat(terms, counts)[use].astype(np.uint64), docs[use]
        weights = (saturated(times[use].astype(np.float32), lengths[docs], self.mean) * self.idf[term]).astype(np.float32)
        own = self.waiting.setdefault(cluster, [])
        base = sum(len(back) for back, _ in own)
        place = (np.cumsum(live) - 1 + base).astype(np.uint64)
        own.append(((shard << _LOCAL) + np.nonzero(live)[0], term << np.uint64(46) | place[docs] << np.uint64(31) | weights.view(np.uint32)))
        if base + len(own[-1][0]) >= JOINED:
            self._join(cluster)
        elif sum(len(keys) for own in self.waiting.values() for _, keys in own) > WAITING:
            self._join(max(self.waiting, key=lambda c: sum(len(keys) for _, keys in self.waiting[c])))

    def _join(self, cluster: int) -> None:
        """Score what waits of a cluster: documents, and 18 bits of the term, 15 of the document's place, 31 of the weight for each posting."""
        own, asked = self.waiting.pop(cluster), np.nonzero(self.clusters >> cluster & 1)[0]
        back, keys = np.concatenate([b for b, _ in own]), np.concatenate([k for _, k in own])
        n = len(back)
        keys.sort()
        term = (keys >> np.uint64(46)).astype(np.int32)
        docs = (keys >> np.uint64(31) & np.uint64((1 << 15) - 1)).astype(np.int64)
        weights = (keys & np.uint64((1 << 31) - 1)).astype(np.uint32).view(np.float32)
        del own, keys
        first = np.flatnonzero(np.diff(term, prepend=-1))
        terms, sizes = term[first], np.diff(np.append(first, len(term)))
        hot = sizes > max(8, n // HOT_PART)
        place = np.full(TERMS, -1, np.int32)  # rows of the matrix, then the other terms
        n_hot = int(hot.sum())
        place[terms[hot]] = np.arange(n_hot)
        place[terms[~hot]] = np.arange(n_hot, len(terms))
        dense = np.zeros((n_hot, n), np.float32)
        is_hot = np.repeat(hot, sizes)
        dense[np.repeat(np.arange(n_hot), sizes[hot]), docs[is_hot]] = weights[is_hot]
        step = max(1, CELLS // n)
        for a in range(0, len(asked), step):
            self._score(asked[a : a + step], back, place, dense, first[~hot], sizes[~hot], docs, weights)
        if self.size > max(HELD, self.left + self.left // 2):
            self.cut()

    def _score(self, seeds, back, place, dense, first, sizes, docs, weights) -> None:
        n, counts = len(back), np.diff(self.at)[seeds]
        some = counts > 0
        term = place[self.terms[ranges(self.at[seeds[some]], counts[some])]]
        row = np.repeat(np.arange(len(seeds)), counts)
        query = np.zeros((len(seeds), len(dense)), np.float32)
        is_hot = (term >= 0) & (term < len(dense))
        query[row[is_hot], term[is_hot]] = 1
        scores = query @ dense
        rest = term >= len(dense)
        row, term = row[rest], term[rest] - len(dense)
        start, size, cell = first[term], sizes[term], scores.reshape(-1)
        edges = np.append(0, np.cumsum(size))
        cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, edges[-1], TOUCHED)), len(size)))
        for a, b in zip(cuts, cuts[1:]):
            where = ranges(start[a:b], size[a:b])
            new = np.append(a, a + 1 + np.flatnonzero(np.diff(row[a:b])))
            at = np.repeat(row[new] * n, np.diff(np.append(edges[new], edges[b])))
            at += docs.take(where)
            np.add.at(cell, at, weights.take(where))
        least = np.maximum(1e-6, (self.bound[seeds] - 0.5) / STEPS).astype(np.float32)
        flat = np.flatnonzero(scores >= least[:, None])
        if n > self.most and len(flat) > 4 * self.most * len(seeds):  # no bound yet: only the best ones of these shards
            worst = np.partition(scores, n - self.most, axis=1)[:, n - self.most] - 1 / STEPS
            flat = np.flatnonzero(scores >= np.maximum(least, worst)[:, None])
        i, j = np.divmod(flat, n)
        steps = np.floor(cell[flat] * STEPS + 0.5).astype(np.int32)
        self.found.append((seeds[i].astype(np.int32), back[j], steps))
        self.size += len(i)

    def best(self) -> tuple[np.ndarray, ...]:
        """What cut() gives when all shards are in."""
        for cluster in sorted(self.waiting):
            self._join(cluster)
        return self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """The best answers so far (seed, document, score); raises the bounds."""
        seed, doc, score = [np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.int64) for k in range(3)]
        best, rank = best_of(self.number, seed, doc, score, self.most)
        seed, doc, score = seed[best], doc[best], score[best]
        last = rank == self.most - 1
        self.bound[seed[last]] = np.maximum(self.bound[seed[last]], score[last])
        self.found, self.size, self.left = [(seed, doc, score)], len(seed), len(seed)
        return seed, doc, score


def cut_chain(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes of documents in order -> pieces: document's place, start, length, sequence in the chain, offset."""
    end = np.cumsum(sizes)
    total = int(end[-1])
    rest, cuts = total % WINDOW, [np.arange(0, total - total % WINDOW + 1, WINDOW)]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            cuts.append(cuts[-1][-1:] + (1 << bit))
    cuts = np.concatenate(cuts)
    edges = np.unique(np.concatenate([cuts, end]))
    at, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(end, at, "right")
    sequence = np.searchsorted(cuts, at, "right") - 1
    return doc, at - (end - sizes)[doc], length, sequence, at - cuts[sequence]


def _chunks(batch: pa.RecordBatch):
    """(ids, bytes of texts, edges of each) of some rows of a batch (id, body) at a time; a null body is empty."""
    ids, body = batch.column(0).to_pylist(), batch.column(1).fill_null(b"").cast(pa.large_binary())
    edges = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(ids):
        b = min(max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK_BYTES, "right")) - 1), len(ids))
        yield ids[a:b], data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        a = b


def _write_index(rows: DataFrame, router, vocabulary: str, shard_bytes: int) -> DataFrame:
    """rows (id, body) -> a written table with a row for each shard."""
    kinds = "shard long, ids array<long>, keys binary, " + ", ".join(f"{c} binary" for c in _INDEX) + ", cluster int, seeds binary, seed_at binary, seed_terms binary, seed_asks binary"

    def build(batches):
        number = TaskContext.get().partitionId() << 10
        open_: dict[int, list] = {}
        held: Counter = Counter()
        made = 0

        def flush(cluster):
            nonlocal made
            own = open_.pop(cluster)
            held[cluster] = 0
            if made >> 10:
                raise ValueError("a partition of the input has more than 1024 shards: read it in smaller ones")
            keys = b"".join(r[1] for r in own)
            seeds = [k for k, r in enumerate(own) if r[0] is not None and r[0] % SEED_EVERY == 0]
            at = np.cumsum([0] + [len(own[k][3]) for k in seeds])
            told = np.concatenate([own[k][3] for k in seeds]) if seeds else np.zeros(0)
            arrays = {c: x.tobytes() for c, x in make_shard([r[2:] for r in own]).items()}
            arrays["tokens"] = squeezed(arrays["tokens"])
            values = [[number + made], [[r[0] for r in own]], [keys], *[[x] for x in arrays.values()]]
            asks = [router.value.asked(own[k][3]) for k in seeds]
            values += [[cluster], *[[np.array(x, np.int32).tobytes()] for x in (seeds, at, told, asks)]]
            made += 1
            types = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * (len(_INDEX) + 1) + [pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in kinds.split(", ")])

        for batch in batches:
            for ids, data, edges in _chunks(batch):
                place = 0
                for tokens, token_at, terms, times, term_at in encoded(data, edges, vocabulary):
                    for d, k in enumerate(router.value.nearest(terms, term_at).tolist()):
                        body = data[edges[place] : edges[place + 1]]
                        if k in open_ and (held[k] + len(body) > shard_bytes or len(open_[k]) == SHARD_DOCS):
                            yield flush(k)
                        a, b = term_at[d], term_at[d + 1]
                        own = (tokens[token_at[d] : token_at[d + 1]].copy(), terms[a:b].copy(), times[a:b].astype(np.int32))
                        open_.setdefault(k, []).append((ids[place], xxhash.xxh3_128_digest(body), *own))
                        held[k] += len(body)
                        place += 1
        for k in sorted(open_):
            yield flush(k)

    return store(rows.mapInArrow(freed(build), kinds), "index")


def _statistics(index: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each term, documents and words, over all rows."""
    step = 4096

    def count(batches):
        df, docs, n_words = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for terms, first, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                lengths = np.frombuffer(lengths, np.int32)
                df[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(first, np.int32))
                docs, n_words = docs + len(lengths), n_words + int(lengths.sum(dtype=np.int64))
        blocks = [df[at : at + step].tobytes() for at in range(0, TERMS, step)]
        blocks.append(np.array([docs, n_words], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table([table["block"].slice(0, 1), pa.array([counts.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    found = index.select("terms", "first", "lengths").mapInArrow(freed(count), schema).groupBy("block").applyInArrow(total, schema).collect()
    blocks = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in found}  # TERMS numbers, whatever the corpus
    if not blocks:
        return np.zeros(TERMS, np.int64), 0, 0
    last = max(blocks)
    return np.concatenate([blocks[k] for k in range(last)]), *map(int, blocks[last])


def _entries(index: DataFrame) -> DataFrame:
    """A row for each text and shard (_ENTRY): its copies there, the least first; low: that one."""

    def each(batches):
        for batch in batches:
            for shard, ids, keys, sizes in zip(*[c.to_pylist() for c in batch.columns]):
                keys, sizes = np.frombuffer(keys, ">u8").reshape(-1, 2).astype(np.int64), np.frombuffer(sizes, np.int32)
                order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
                new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(1)])
                start = np.append(np.nonzero(new)[0], len(order))
                seed = np.array([i is not None and i % SEED_EVERY == 0 for i in ids])
                least = order[start[:-1]]
                docs = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array((shard << _LOCAL) + order))
                parts = [keys[least, 0], keys[least, 1], (shard << _LOCAL) + least, np.diff(start).astype(np.int32), np.logical_or.reduceat(seed[order], start[:-1]), sizes[least]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, parts), docs], names=[c.split()[0] for c in _ENTRY.split(", ")])

    return store(index.select("shard", "ids", "keys", "sizes").mapInArrow(freed(each), _ENTRY), "entries")


class Library:
    """The index of a corpus, and what its seeds may ask of it."""

    def __init__(self, rows: DataFrame, vocabulary: str, neighbours: int = NEIGHBOURS, near: float = NEAR_CENTRE, shard_bytes: int = SHARD_BYTES):
        self.spark, self.neighbours = rows.sparkSession, neighbours
        context = self.spark.sparkContext
        short = rows.where(F.octet_length("body") <= SAMPLE_BYTES)
        n = short.count()
        rate = int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, n)))
        drawn = short.where(F.pmod(F.xxhash64("id", "body", F.lit(11)), F.lit(1 << 30)) < rate).limit(2 * SAMPLE_DOCS).collect()
        router = Router(sorted(bytes(r["body"]) for r in drawn), near)
        self.index = _write_index(rows, context.broadcast(router), vocabulary, shard_bytes)
        frequency, self.docs, n_words = _statistics(self.index)
        self.mean = n_words / max(1, self.docs)
        self.idf = context.broadcast(np.log1p((self.docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32))
        self.entries = _entries(self.index)
        n = self.index.rdd.getNumPartitions()
        self.tasks = max(context.defaultParallelism, -(-n // READ_AT_ONCE))  # of a search: a task that has more shards of a cluster scores them for less
        grouped = self.entries.groupBy("k1", "k2").agg(F.min("low").alias("doc"), F.sum("n").alias("n"), F.max("is_seed").alias("is_seed"), F.first("size").alias("size"))
        self.texts = store(grouped, "texts")  # a text is known by its least document

    def seeds(self) -> DataFrame:
        """(doc, block, terms, asks): a row for each seed; a block has about BLOCK_TERMS terms."""

        def each(batches):
            for batch in batches:
                for shard, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                    own, at, terms, asks = (np.frombuffer(x, np.int32) for x in parts)
                    columns = [pa.array((shard << _LOCAL) + own.astype(np.int64)), pa.array([terms[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array(asks)]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "terms", "asks"])

        told = self.index.select("shard", "seeds", "seed_at", "seed_terms", "seed_asks").mapInArrow(freed(each), "row long, terms binary, asks int")
        of = self.entries.where("is_seed").select("k1", "k2", F.explode("docs").alias("row"))
        named = of.join(self.texts.where("is_seed").select("k1", "k2", "doc"), ["k1", "k2"]).select("row", "doc")
        one = told.join(named, "row").groupBy("doc").agg(F.first("terms").alias("terms"), F.first("asks").alias("asks"))  # equal for copies
        one = store(one, "seeds")
        n, size = one.agg(F.count("*"), F.sum(F.octet_length("terms"))).first()
        self.blocks = max(1, -(-(size or 0) // (4 * BLOCK_TERMS)), -(-n // BLOCK_SEEDS))
        return one.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(self.blocks)))

    def marks(self, open_: DataFrame) -> list:
        """Broadcast bit masks {shard: unused documents}, each with the condition that says which shards it covers."""
        parts = max(1, -(-self.docs // BLOCK_DOCS))

        def mask(table: pa.Table) -> pa.Table:
            local = table["doc"].to_numpy() & ((1 << _LOCAL) - 1)
            bits = np.zeros(int(local.max()) + 1, bool)
            bits[local] = True
            return pa.table([table["shard"].slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["shard", "bits"])

        rows = open_.select("doc", F.shiftright("doc", _LOCAL).alias("shard")).groupBy("shard").applyInArrow(mask, "shard long, bits binary")
        rows = store(rows, "marks") if parts > 1 else rows
        out = []
        for k in range(parts):
            covered = F.pmod(F.xxhash64("shard", F.lit(9)), F.lit(parts)) == k
            out.append((covered, self.spark.sparkContext.broadcast({r["shard"]: r["bits"] for r in rows.where(covered).collect()})))
        return out

    def answers(self, seeds: DataFrame, block: int, marks: list, everywhere: bool) -> DataFrame:
        """(seed, doc, rank, score): the best unused texts of each seed of a block, in the clusters that it asks or everywhere."""
        context, idf, mean, most = self.spark.sparkContext, self.idf, self.mean, self.neighbours
        held = seeds.where(F.col("block") == block).orderBy("doc").toArrow()
        terms = held["terms"].to_pylist()
        number, at = held["doc"].to_numpy(), np.cumsum([0] + [len(t) // 4 for t in terms])
        asks = held["asks"].to_numpy() if not everywhere else np.full(len(number), -1, np.int32)
        asked = context.broadcast((number, asks, at, np.frombuffer(b"".join(terms), np.int32)))
        columns = ["lengths", "terms", "first", "docs", "times"]
        kinds = {"seed": np.int32, "doc": np.int64, "score": np.int32}

        def search(index, unused, bounds, told):
            """told: which of kinds are wanted, in blobs for each group of seeds."""

            def run(batches):
                work = Search(*asked.value, bounds.value, idf.value, mean, most)
                for batch in batches:
                    for k, (shard, cluster) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                        if shard in unused.value:
                            arrays = [np.frombuffer(batch.column(c)[k].as_buffer(), _INDEX[c]) for c in columns]
                            live = np.unpackbits(np.frombuffer(unused.value[shard], np.uint8), count=len(arrays[0])).astype(bool)
                            work.add(shard, cluster, live, *arrays)
                answers = dict(zip(kinds, work.best()))
                part = answers["seed"] // SEED_GROUP
                edges = np.searchsorted(part, np.arange(int(part.max(initial=-1)) + 2))
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        blobs = [planes(answers[c][a:b].astype(kinds[c])) for c in told]
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["part", *told])

            return index.select("shard", "cluster", *columns).coalesce(self.tasks).mapInArrow(freed(run), "part int, " + ", ".join(f"{c} binary" for c in told))

        def last(table: pa.Table) -> pa.Table:
            """The score of each seed's most-th best answer, where there are so many."""
            seed, score = [of_planes(table[c].to_pylist(), kinds[c]) for c in ("seed", "score")]
            order = np.lexsort((-score, seed))
            seed, score = seed[order], score[order]
            at = np.nonzero(np.arange(len(seed)) - np.searchsorted(seed, seed) == most - 1)[0]
            return pa.table([pa.array(asked.value[0][seed[at]], pa.int64()), pa.array(score[at], pa.int32())], names=["seed", "score"])

        def merge(table: pa.Table) -> pa.Table:
            seed, doc, score = [of_planes(table[c].to_pylist(), t) for c, t in kinds.items()]
            best, rank = best_of(asked.value[0], seed, doc, score, most)
            told = pa.table([pa.array(asked.value[0][seed[best]]), pa.array(doc[best]), pa.array(rank.astype(np.int32)), pa.array(score[best])], names=["seed", "doc", "rank", "score"])
            del seed, doc, score, best, rank
            release()
            return told

        merged = "seed long, doc long, rank int, score int"
        bound = np.zeros(len(number), np.int32)
        few = F.pmod(F.xxhash64("shard", F.lit(13)), F.lit(SAMPLED_SHARDS)) == 0
        free = context.broadcast(bound)
        first = [search(self.index.where(c & few), u, free, ["seed", "score"]) for c, u in marks]
        least = first[0]
        for other in first[1:]:
            least = least.unionAll(other)
        least = least.groupBy("part").applyInArrow(last, "seed long, score int").toArrow()
        bound[np.searchsorted(number, least["seed"].to_numpy())] = least["score"].to_numpy()
        bounds = context.broadcast(bound)
        whole = [search(self.index.where(c), u, bounds, list(kinds)) for c, u in marks]
        out = whole[0]
        for other in whole[1:]:
            out = out.unionAll(other)
        out = store(out.groupBy("part").applyInArrow(merge, merged), "answers")
        for x in (asked, free, bounds):
            x.unpersist()
        return out


def claims(library: Library) -> DataFrame:
    """(doc, chain, pass_no, rank) for every text that a seed took, and for the seeds themselves (pass -1)."""
    texts = library.texts
    seeds = library.seeds()
    taken = texts.where("is_seed").select("doc", F.col("doc").alias("chain"), F.lit(-1).alias("pass_no"), F.lit(0).alias("rank"))
    open_ = texts.where("not is_seed").select("doc")
    number, everywhere = 0, False
    while open_.limit(1).count():
        marks = library.marks(open_)
        told = [library.answers(seeds, k, marks, everywhere) for k in range(library.blocks)]
        for _, m in marks:
            m.unpersist()
        heard = told[0]
        for other in told[1:]:
            heard = heard.unionAll(other)
        won = heard.groupBy("doc").agg(F.min(F.struct("rank", "seed")).alias("w"))
        won = store(won.select("doc", F.col("w.seed").alias("chain"), F.lit(number).alias("pass_no"), F.col("w.rank").alias("rank")), "claims")
        if not won.limit(1).count():
            if everywhere:
                break  # what is left shares no term with any seed
            everywhere = True
            continue
        taken = taken.unionAll(won)
        open_ = store(open_.join(won.select("doc"), "doc", "left_anti"), "open")
        number += 1
    return taken


def _members(library: Library) -> DataFrame:
    """(chain, pass_no, rank, lead, doc, size) for every document."""
    texts = library.texts.join(claims(library), "doc", "left")
    shard = F.shiftright("doc", _LOCAL)
    left = texts.where("chain is null").groupBy(shard.alias("s")).agg(F.min("doc").alias("alone"))  # a chain for each shard
    texts = texts.withColumn("s", shard).join(left, "s", "left").withColumn("chain", F.coalesce("chain", "alone"))
    texts = texts.select("k1", "k2", "doc", F.col("n").alias("copies"), "chain", F.coalesce("pass_no", F.lit(0)).alias("pass_no"), F.coalesce("rank", F.lit(0)).alias("rank"))
    both = library.entries.join(texts, ["k1", "k2"])
    few = F.col("copies") <= FEW_COPIES
    others = F.array_remove("docs", F.col("doc"))  # of many copies the first alone follows its seed
    first = both.where(few | (F.col("low") == F.col("doc")))
    place = ["pass_no", "rank", F.col("doc").alias("lead")]
    along = first.select("chain", *place, F.explode(F.when(few, F.col("docs")).otherwise(F.array("doc"))).alias("one"), "size")
    apart = both.where(~few).select(F.array_min(others).alias("chain"), *place, F.explode(others).alias("one"), "size")
    return along.unionAll(apart).withColumnRenamed("one", "doc")


def pack(df: DataFrame, id_col="doc_id", text_col="text", vocabulary="byte_bpe_50k.json", **limits) -> DataFrame:
    """A row for each piece of every document. A null text is empty: its document is the end token alone.

    Rows with equal ids are packed each for itself. Without any seed each shard's texts are a chain in order. A term's
    count in a text is held up to 65,535. sequence_id has the number of its chain's first document in its high bits.
    limits: neighbours, near and shard_bytes of Library.
    """
    library = Library(id_and_text(df, id_col, text_col), vocabulary, **limits)
    spark = library.spark
    if not library.docs:
        return spark.createDataFrame([], COLUMNS)
    names = ["shard", "doc", "start", "length", "sequence", "offset"]
    members = store(_members(library), "members")
    groups = max(1, -(-library.docs // 20000))

    def lay(table: pa.Table) -> pa.Table:
        chain, *place, doc, size = [table[c].to_numpy() for c in ("chain", "pass_no", "rank", "lead", "doc", "size")]
        order = np.lexsort((doc, *reversed(place), chain))
        chain, doc, size = chain[order], doc[order], size[order].astype(np.int64)
        edges = np.append(np.nonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))[0], len(chain))
        out = []
        for a, b in zip(edges, edges[1:]):
            k, start, length, sequence, offset = cut_chain(size[a:b])
            own = doc[a:b][k]
            out.append((own >> _LOCAL, own & ((1 << _LOCAL) - 1), start, length, (chain[a] << _WINDOWS) + sequence, offset))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    laid = members.withColumn("g", F.pmod(F.xxhash64("chain"), F.lit(groups))).groupBy("g").applyInArrow(lay, ", ".join(f"{c} long" for c in names))

    def emit(places: pa.Table, texts: pa.Table) -> pa.Table:
        ids = texts["ids"][0].as_py()
        sizes = np.frombuffer(texts["sizes"][0].as_py(), np.int32)
        tokens = unsqueezed(texts["tokens"][0].as_py(), int(sizes.sum(dtype=np.int64)))
        start_of = np.cumsum(sizes, dtype=np.int64) - sizes
        doc, start, length = [places[c].to_numpy() for c in ("doc", "start", "length")]
        wide = tokens.astype("<u4").tobytes()
        crc = [zlib.crc32(wide[4 * a : 4 * (a + n)]) for a, n in zip((start_of[doc] + start).tolist(), length.tolist())]
        columns = ([ids[d] for d in doc], start, length, crc, sizes[doc], places["sequence"].to_numpy(), places["offset"].to_numpy())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in COLUMNS.split(", ")])

    held = library.index.select("shard", "ids", "sizes", "tokens")
    return laid.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(emit, COLUMNS)
