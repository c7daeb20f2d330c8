"""The corpus operators against brute force, on small tables with nulls, empties, ties and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import bm25_pack, byte_cnn, langid, license_scan, line_dedup, mixing, mph_dedup, ngram_trie, queries, repetition, simhash
from millrace.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, id long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += texts[:10] + [t + " end" for t in texts[10:20]] + [t[:30] + "x" + t[30:] for t in texts[20:30]]
    texts += [None, "", " \n ", "one", "É ü ß", "1 2 3", "word " * 3000, "The MIT License. Released under the MIT License!\n" * 3]
    rows = [(k, t, rng.choice(["en", "fr"]) if k % 7 else None, f"src{k % 5}", len(t or ""), "x", k) for k, t in enumerate(texts)]
    rows += [rows[4], (None, texts[3], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, near):
    left, groups = set(nodes), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            found = {y for y in left if near(x, y)}
            left -= found
            todo += found
        groups.append(group)
    return groups


def test_simhash_matches_brute_force(docs, plain):
    prints = [brute_fingerprint(t, 3) for _, t in plain]
    want = []
    for group in reach(set(prints), lambda a, b: (a ^ b).bit_count() <= 3):
        ids = [i for (i, _), p in zip(plain, prints) if p in group]
        low = min((i for i in ids if i is not None), default=None)
        want += [(i, f"{p:016x}", low) for (i, _), p in zip(plain, prints) if p in group]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    u, v = simhash.local_links(fps, 3)
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = simhash._flatten(len(fps), u, v)
    a, b = np.nonzero(close)
    assert (np.bitwise_count(fps[u] ^ fps[v]).max() >= 0) and (label[a] == label[b]).all()
    assert np.array_equal(label, simhash._flatten(len(fps), a, b))
    half = (fps >> np.uint64(32)).astype(np.uint32)
    nodes = simhash.grow_tree(half[::5], 1, 8)
    together = np.zeros((len(fps), len(fps)), bool)
    for _, rows in simhash.route(half, nodes, 1):
        together[np.ix_(rows, rows)] = True
    assert together[np.bitwise_count(half[:, None] ^ half[None]) <= 1].all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_exact_dedup_matches_brute_force(docs, plain):
    size, top = Counter(t or "" for _, t in plain), {}
    for i, t in plain:
        top[t or ""] = max([x for x in (i, top.get(t or "")) if x is not None], default=None)
    got = mph_dedup.exact_duplicates(docs).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert len(got) == len(plain)
    for r in got:
        t = sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (top[t], size[t]) and (not r["kept"] or r["doc_id"] == top[t])
    assert sum(r["kept"] for r in got) == len(size)


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(2)
    held, other = rng.integers(0, 256, (2, 5000, 32), dtype=np.uint8)
    sizes, bits, slot = mph_dedup.build(held)
    assert sorted(slot) == list(range(5000))
    table = held[np.argsort(slot)]
    assert np.array_equal(mph_dedup.find(held, sizes, bits, table), slot)
    assert (mph_dedup.find(other, sizes, bits, table) == -1).all()


def test_quality_network_learns_and_covers_whole_texts(docs, spark):
    good, bad = b"plain words in a row " * 12, b"WORDS!! IN!! A!! ROW!! " * 12
    net = byte_cnn.fit([good[k:] for k in range(40)] + [bad[k:] for k in range(40)], [1] * 40 + [0] * 40)
    p = byte_cnn.score([good, bad, b""], net)
    assert p[0] > 0.7 > 0.3 > p[1] and 0 <= p[2] <= 1
    long = good * 400 + bad + good * 400
    want = byte_cnn.chunk_responses([long], net)[0].max(0)
    raw, _ = byte_cnn._laid_out([long])
    full = np.maximum((byte_cnn._windows(raw, net) @ net["filters"]).max(0) + net["bias"], 0)
    assert np.allclose(want, full, atol=1e-4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    rows = byte_cnn.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_repetition_matches_brute_force(docs, plain):
    got = repetition.quality(docs).collect()
    by = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    want = Counter()
    for i, t in plain:
        w = (t or "").encode().split()
        runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside), failed] += 1
    assert by == want
    w = b" ".join(b"%d" % k for k in range(100)) + b" " + b" ".join(b"%d" % k for k in range(20))
    shares = repetition.measure(w)[5]
    assert shares[5] == pytest.approx(sum(len(str(k)) for k in range(20)) / sum(len(x) for x in w.split()))
    assert {tuple(r) for r in repetition.keep_good(docs).select("doc_id").collect()} == {(r["doc_id"],) for r in got if r["kept"]}


def test_languages(spark, docs):
    rng = random.Random(1)
    letters = {"en": "theandof", "de": "undersch", "fr": "ouléeaux", "es": "ciónasjo"}
    rows = [(k, " ".join("".join(rng.choices(letters[g], k=5)) for _ in range(30)), g, "s", 0, "", 0) for k, g in enumerate(list(letters) * 40)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean(right) > 0.9 and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    mixed = langid.identify(docs).collect()
    assert {r["lang_pred"] for r in mixed} <= {"en", "fr", "und"} and sum(r["lang_pred"] == "und" for r in mixed) == 5


def test_tokens_equal_the_vocabularys_own(plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = bm25_pack.encoder("byte_bpe_50k.json")
    for text in [t or "" for _, t in plain] + ["a  b", " x\n y\t z ", "it's 12 ,, é  b", "\n\n q", "a b.\nc 'd\n", "a\tb \tc\n", "\u00a0b \u00a0c\n\x1cd ", "a b ", "\nq", " "]:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_holds_every_token_once(docs, plain):
    rows = bm25_pack.pack(docs).collect()
    encode = bm25_pack.encoder("byte_bpe_50k.json")
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    once = Counter(i for i, _ in plain)
    for i, t in plain:
        if once[i] == 1:
            ids, at = [*encode(t or "").tolist(), 0], 0
            for start, length, crc, n in sorted(pieces[i]):
                assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
                at += length
            assert at == len(ids)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(5)
    for n, universe in ((1, 10), (1000, 1001), (5000, 1 << 64), (3000, 1 << 40)):
        values = np.unique(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
        code = ngram_trie.EliasFano(values, universe)
        assert np.array_equal(code.values(), values) and np.array_equal(code.find(values), np.arange(len(values)))
        other = rng.integers(0, universe - 1, 2000, dtype=np.uint64, endpoint=True)
        assert np.array_equal(code.find(other) >= 0, np.isin(other, values))


def test_scores_match_brute_force(docs, plain):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [(i, (t or "").encode().lower().split()) for i, t in plain]
    one, two = Counter(), Counter()
    for i, w in texts:
        if not held(i):
            one.update([0, *w, 1])
            two.update(zip([0, *w], [*w, 1]))
    n, v = sum(one.values()) - one[0], len(one) - 1
    after = Counter(a for a, _ in two)
    want = []
    for i, w in texts:
        add = [math.log10((one[x] + 1) / (n + v + 1)) for x in [*w, 1]]
        total = 0.0
        for (a, b), p in zip(zip([0, *w], [*w, 1]), add):
            c = two[a, b]
            total += math.log10((c - 0.75) / one[a]) if c else p + (math.log10(0.75 * after[a] / one[a]) if one[a] else 0)
        want.append((i, held(i), len(w) + 1, sum(one[x] > 0 for x in [*w, 1]), n, round(sum(add), 5), round(total, 1)))
    got = [(*r[:5], round(r[5], 5), round(r[6], 1)) for r in ngram_trie.score(docs).collect()]
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-3, abs=0.2)


def levenshtein_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def test_lines_match_brute_force(spark, empty):
    line = "a line of some length, to be edited %d"
    texts = [line % 1, f"{line % 1}\nshort\nother text", f"{line % 23}\nshirt\nshort\n\n", (line % 23).replace("some", "sme") + "\nnew", None, "", f"\n{line % 23}"]
    texts += ["x" + "abcdefghij" * 400, "abcdefghij" * 400, "abcdefghij" * 399 + "abcdefghi"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, gone string")
    seen, want = [], {}
    for k, t in enumerate(texts):
        kept = []
        for x in t.split("\n") if t is not None else []:
            near = any(x == y or min(len(x), len(y)) >= 20 and levenshtein_at_most_one(x, y) for y in seen)
            if not x.strip() or not near:
                kept.append(x)
            if x.strip():
                seen.append(x)
        want[k] = None if t is None else "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_report(df).collect()} == want
    assert line_dedup.clean_documents(df).columns == df.columns and line_dedup.line_report(empty).count() == 0


def test_budgets_and_prefixes(docs):
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 100, ("b", "x", "1"): 1000}
    given = mixing.budgets(supply, 300, {}, 1)
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 65, ("a", "y", "1"): 75, ("b", "x", "1"): 150}
    assert sum(mixing.budgets(supply, 9999, {}, 2).values()) == 2420
    rows = mixing.mixture_report(docs, queries.domain(), queries.WEIGHTS, 0.5, 3).collect()
    total = sum(r["n_tokens"] * r["epochs"] for r in rows)
    everything = sum(len((t or "").encode().split()) for (t,) in docs.select("text").collect())
    assert total <= 0.5 * everything and rows
    assert mixing.keep_mixture(docs, queries.domain(), queries.WEIGHTS, 0.5).columns == docs.columns


def test_licenses(docs):
    scan = lambda s: license_scan.scan(s.encode(), [(k.encode(), v) for k, v in license_scan.PHRASES.items()], license_scan.Automaton(license_scan.TEMPLATES))
    assert scan("This work is licensed under the GNU General Public License, version 3.")[1:6] == (1, 7, 7, "gpl", "gpl,gpl-3.0-notice")
    assert scan("licensed under CC BY-NC 4.0")[5] == "cc-by-nc-4.0-notice"
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy of this fine program, to deal in the software without restriction")[5] == "mit-notice"
    assert scan("Licensed under the Apache Licence, Version 2.0")[1:] == (0, None, None, "", "", 0.0, 0)
    rows = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert (rows[97]["n_base"], rows[97]["first_word"], rows[97]["last_word"], rows[97]["labels"]) == (6, 1, 22, "mit,mit-notice")


@pytest.mark.parametrize("name", queries.queries())
def test_empty_tables(spark, empty, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        at = spark.createDataFrame(out.collect(), docs.schema)
        assert at.count()
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() >= at.count()
