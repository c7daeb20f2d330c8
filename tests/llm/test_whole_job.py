"""What the operators once left out, against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from millrace.llm import bm25_pack, byte_cnn, license_scan, line_dedup, mixing, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five_words(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def least_of_groups(rows):
    """The ids that stay: the least of each group connected by similar sets."""
    sets, label = {i: five_words(t) for i, t in rows}, {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and near(sets[a], sets[b]):
                    label[b], changed = label[a], True
    return {i for i in label if label[i] == i}


def near_texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    texts = []
    for size, edits in ((100, 1), (250, 2), (600, 6), (100, 2), (100, 4), (12, 1), (60, 1)):
        for _ in range(8):
            base = rng.choices(words, k=size)
            texts.append(" ".join(base))
            for _ in range(2):
                copy = list(base)
                for at in rng.sample(range(size), edits):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    for size in (1100, 1025):  # sketches of two sizes
        base = rng.choices(words, k=size)
        texts += [" ".join(base), " ".join(base[: size - 90]), " ".join(base[:-90] + rng.choices(words, k=90)), " ".join(rng.choices(words, k=size))]
    passage = " ".join(rng.choices(words, k=40))
    texts += [passage + " " + " ".join(rng.choices(words, k=30)) for _ in range(30)]
    return texts + [texts[0], texts[0].upper(), "", None, " ", "one two", "One two"]


def test_near_dedup_stage_drops_what_brute_force_drops(spark):
    rows = list(enumerate(near_texts()))
    docs = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], SCHEMA)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == least_of_groups(rows)
    assert near(five_words("a b c d e f"), five_words("A b c d e f")) and near_copies.NUM / near_copies.DEN == 0.8


def topical(n, size, seed=5):
    """Texts of 20 topics, dealt in an order that has nothing to do with them."""
    rng = random.Random(seed)
    topics = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)] for _ in range(20)]
    common = ["".join(rng.choices("klmnop", k=4)) for _ in range(50)]
    return [" ".join(rng.choices(common, k=size // 2) + rng.choices(rng.choice(topics), k=size - size // 2)) for _ in range(n)]


def bm25(texts):
    """score(seed, other) over all of the seed's terms."""
    bags = [Counter(zlib.crc32(w) & (bm25_pack.TERMS - 1) for w in t.encode().lower().split()) for t in texts]
    df, mean = Counter(x for b in bags for x in b), sum(sum(b.values()) for b in bags) / len(bags)
    idf = {x: math.log1p((len(bags) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    long = [0.25 * 1.2 + 0.75 * 1.2 * sum(b.values()) / mean for b in bags]
    return lambda asked, d: sum(idf[x] * bags[d][x] * 2.2 / (bags[d][x] + long[d]) for x in asked if x in bags[d]), bags


def packed_order(spark, texts, **limits):
    """Whether windows are whole, and {document: (chain, place)} by what pack() returns."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(bm25_pack.pack(docs, **limits).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order, chains = {}, {}
    for r in rows:
        chain = r["sequence_id"] >> bm25_pack._WINDOWS
        if r["start"] == 0:
            order[r["doc_id"]] = (chain, chains.setdefault(chain, len(order)))
    lists = {}
    for d, (chain, _) in order.items():
        lists.setdefault(chain, []).append(d)
    return sorted(lists.values()), rows


def brute_order(texts, neighbours):
    """Seeds and what they take in turns, pass after pass, over all terms and all documents."""
    score, bags = bm25(texts)
    seeds = [i for i in range(len(texts)) if i % bm25_pack.SEED_EVERY == 0]
    chains, unused = {s: [s] for s in seeds}, set(range(len(texts))) - set(seeds)
    while unused:
        told = {s: sorted((-round(score(bags[s], d), 3), d) for d in unused if score(bags[s], d) > 0)[:neighbours] for s in seeds}
        turns = {}
        for s in seeds:
            for rank, (_, d) in enumerate(told[s]):
                turns.setdefault(d, []).append((rank, s))
        if not turns:
            break
        for d, (rank, s) in sorted(((d, min(t)) for d, t in turns.items()), key=lambda x: x[1]):
            chains[s].append(d)
        unused -= set(turns)
    return sorted(chains.values()), unused


def test_seeds_take_the_best_of_the_whole_corpus(spark):
    texts = [t + f" own{i} more{i % 7} some{i % 11}" * (1 + i % 3) for i, t in enumerate(topical(90, 60))]
    want, left = brute_order(texts, 8)
    got, _ = packed_order(spark, texts, neighbours=8, near=0.0, shard_bytes=sum(map(len, texts)) // 5)  # every shard is asked
    taken = {d: k for k, chain in enumerate(want) for d in chain}
    same = sum(taken[d] == k for k, chain in enumerate(got) for d in chain)
    assert not left and [c[0] for c in got] == [c[0] for c in want]
    assert same >= 0.95 * len(texts)  # scores are compared in steps, so a near tie may fall to another seed


def test_recall_of_the_clusters_that_a_seed_asks():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    bodies = sorted({t.encode() for t in table["text"].to_pylist()})
    router = bm25_pack.Router(bodies)
    found = [bm25_pack.terms_of(b) for b in bodies]
    clusters = [int(router.nearness(t).argmax()) for t, _ in found]
    score, bags = bm25([b.decode() for b in bodies])
    hits = asked = 0
    for s in range(0, len(bodies), 20):
        best = sorted((-score(bags[s], d), d) for d in range(len(bodies)) if d != s)[:10]
        mask = router.asked(found[s][0])
        hits += sum(mask >> clusters[d] & 1 for _, d in best)
        asked += len(best)
    assert hits >= 0.9 * asked


def test_answers_are_shuffled_by_planes():
    rng = np.random.default_rng(2)
    for kind in (np.int32, np.int64):
        parts = [rng.integers(-(1 << 31), 1 << 31, n).astype(kind) for n in (0, 1, 300)]
        assert np.array_equal(bm25_pack.of_planes([bm25_pack.planes(x) for x in parts], kind), np.concatenate(parts))
    docs = (np.int64(5) << 24) + rng.integers(0, 1 << 14, 4000)
    assert bm25_pack.planes(docs)[8000:] == bytes(4000) + bytes([5]) * 4000 + bytes(16000)


def test_windows_of_copies_and_of_texts_that_share_nothing(spark):
    texts = ["same words here"] * 50 + [f"alone{i}" for i in range(30)] + [""] * 5 + ["two of these", "two of these"]
    _, rows = packed_order(spark, texts)
    held = Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
    encode = bm25_pack.encoder("byte_bpe_50k.json")
    assert held == {i: len(encode(t)) + 1 for i, t in enumerate(texts)}


def test_no_column_name_clashes(spark):
    extra = ["row", "id", "__id", "__tokens", "__domain", "__h", "a.b", "domain", "gone", "left", "hit", "p", "tokens", "h", "epochs", "n", "di"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"{words} {k} {k * 7}\nline {k}", "en" if k % 3 else None, f"src{k}", 9, *["x"] * len(extra)) for k in range(12)]
    rows += [rows[3], (None, words, None, None, None, *["y"] * len(extra)), (40, None, "en", "src1", 0, *[None] * len(extra)), (41, "", "en", "src1", 0, *[None] * len(extra))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            found = out.collect()
            assert all(r["a.b"] in ("x", "y", None) and r["__id"] in ("x", "y", None) for r in found), name
        assert corpus_pipeline.STAGES[-1][1](spark, given, "").count() == 0


def test_mixture_is_each_leafs_prefix(spark):
    """Against plain Python: epochs, the order of each, prefixes and hash ties."""
    import pyspark.sql.functions as F

    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), f"src{k % 4}", 0) for k in range(120)]
    docs = spark.createDataFrame(rows + [rows[5], rows[5]], SCHEMA)
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}}
    domain = F.when(F.col("source").isin("src0", "src1"), "a").otherwise("b")
    got = Counter((r["doc_id"], r["epochs"]) for r in mixing.mixture_report(docs, domain, weights, 0.7, 3).collect())
    hashes = docs.select("*", *[F.xxhash64(F.lit("mix"), F.lit(e), F.col("doc_id"), F.xxhash64("text")).alias(f"h{e}") for e in range(3)]).collect()
    leaves = {}
    for r in hashes:
        leaf = ("a" if r["source"] in ("src0", "src1") else "b", r["lang"] or "unknown", r["source"])
        leaves.setdefault(leaf, []).append((len(r["text"].split()), r))
    supply = {k: sum(n for n, _ in v) for k, v in leaves.items()}
    want = Counter()
    for leaf, budget in mixing.budgets(supply, 0.7 * sum(supply.values()), weights, 3).items():
        whole, total = int(budget // supply[leaf]), 0
        for n, r in sorted(leaves[leaf], key=lambda x: x[1][f"h{whole}"]):
            total += n
            times = whole + (total <= int(budget - whole * supply[leaf]))
            if times:
                want[r["doc_id"], times] += 1
    assert got == want


def test_licence_texts_and_many_places():
    automaton = license_scan.Automaton(license_scan.TEMPLATES)
    pairs = [(k.encode(), v) for k, v in license_scan.PHRASES.items()]
    full = license_scan.TEMPLATES["mit-text"][0].replace("[[", "").replace("]]", "").replace("{{1..12}}", "2020 Some One").replace("{{1..8}}", "the authors")
    labels = license_scan.scan(full.encode(), pairs, automaton)[5].split(",")
    assert "mit-text" in labels
    assert "mit-text" not in license_scan.scan(full.replace("sublicense", "lend").replace("MIT license", "").encode(), pairs, automaton)[5].split(",")
    got = license_scan.scan(b"mit license " * 50000, pairs, automaton)
    assert got[:4] == (100000, 50000, 0, 99998)


def test_scores_do_not_depend_on_neighbours():
    rng = random.Random(9)
    bodies = ["".join(rng.choices("abc XYZ.", k=rng.randint(0, 700))).encode() for _ in range(40)]
    net = byte_cnn.fit(bodies[:20], [k % 2 for k in range(20)], epochs=2)
    together = byte_cnn.score(bodies, net)
    assert max(abs(together[k] - byte_cnn.score([b], net)[0]) for k, b in enumerate(bodies)) < 1e-6
    assert max(abs(together[::-1][k] - x) for k, x in enumerate(byte_cnn.score(bodies[::-1], net))) < 1e-6


def test_long_lines_meet(spark):
    line = "".join(random.Random(1).choices("abcdefgh ", k=20000))
    texts = [line, line[:500] + "Z" + line[500:], line[:-1], line[:7000] + "Q" + line[7001:], line[:7000] + "QQ" + line[7002:], line[::-1]]
    texts += ["x" * 64 + "y" * 64, "x" * 64 + "y" * 63, "x" * 63 + "y" * 64, "x" * 65 + "y" * 65]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup.line_report(docs).where("n_removed = 1").collect()) == [1, 2, 3, 4, 7, 8]


def test_near_dedup_links_come_from_the_tree(spark, monkeypatch):
    grown = []

    def grow(points, *more):
        grown.append(len(points))
        return simhash.grow_tree(points, *more)

    monkeypatch.setattr(near_copies, "grow_tree", grow)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base[1:]), " ".join(base[:40] + base[:40]), "", " ".join(f"v{k}" for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert grown == [4]  # distinct sets with a shingle


def test_recall_of_the_radius_and_the_tree():
    """Every pair of the table's sets at 0.8 or more is within the radius, and meets in a shard."""
    import pyarrow.parquet as pq

    bodies = [t.encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    sets = sorted({near_copies.shingle_set(b).tobytes(): near_copies.shingle_set(b) for b in bodies + [" ".join(t.split()[:-2]).encode() for t in map(bytes.decode, bodies)]}.values(), key=len)
    sets = [s for s in sets if len(s)]
    n, prints = np.array([len(s) for s in sets]), np.array([near_copies.simprint(s) for s in sets])
    holders = {}
    for k, s in enumerate(sets):
        for x in s.tolist():
            holders.setdefault(x, []).append(k)
    want = {(a, b) for b, s in enumerate(sets) for a in set().union(*[holders[x] for x in s.tolist()]) if a < b and near_copies.similar(sets[a], s)}
    found = {(a, b) for i, j in near_copies.near_blocks(n, prints, n, prints, True) for a, b in zip(i.tolist(), j.tolist())}
    points = near_copies.points_of(n, prints)
    tree = simhash.grow_tree(points[::3], near_copies.RADIUS + 1e-6, 16, near_copies.apart, near_copies.WORTH)
    shards = [set() for _ in sets]
    for shard, rows in simhash.route(points, tree, near_copies.RADIUS + 1e-6, near_copies.apart):
        for k in rows.tolist():
            shards[k].add(shard)
    assert len(want) > 300 and want <= found and len(tree) > 3
    assert all(shards[a] & shards[b] for a, b in want)


def test_python_tasks_give_their_memory_back():
    from millrace.llm.common import freed

    def held_mb():
        with open("/proc/self/smaps_rollup") as file:
            return next(int(x.split()[1]) for x in file if x.startswith("Pss_Anon")) / 1024

    after = []

    def run(batches):
        kept = [b"x" * 100_000 for _ in range(3000)]  # from the heap, not mapped
        after.append(b"y" * 100_000)  # lies above them, so the heap cannot shrink by itself
        after.append(held_mb())
        yield from batches
        del kept

    assert list(freed(run)([1, 2])) == [1, 2]
    assert held_mb() < after[1] - 200


def test_near_dedup_deals_sets_only_where_a_size_fits(spark, monkeypatch):
    """Any two sets of a shard whose sizes fit meet in one cell, others' cells are not dealt to; sizes that very many have are dealt by hash."""
    monkeypatch.setattr(near_copies, "PART", 64)
    rng = np.random.default_rng(3)
    n = np.concatenate([np.exp(rng.uniform(2, 6, 900)).astype(int), np.full(300, 40), [1, 1, 2]])
    rows = [(int(x), int(k), rng.bytes(32)) for x, k in zip(rng.integers(-(1 << 62), 1 << 62, len(n)), n)]
    nodes = spark.createDataFrame(rows, "node long, n int, fp binary")
    forest = near_copies.Forest(nodes)
    size, cells, shards, dealt = {x: k for x, k, _ in rows}, {}, {}, 0
    told = forest._cells(nodes).applyInArrow(lambda t: t.select(["shard", "i", "j", "part", "node"]), "shard int, i int, j int, part int, node long")
    for shard, i, j, part, node in told.collect():
        assert part in (i, j)
        cells.setdefault((shard, i, j), ([], []))[part != i].append(node)
        shards.setdefault(shard, set()).add(node)
        dealt += 1
    met = {}
    for (shard, i, j), (one, two) in cells.items():
        assert max(len(one), len(two)) <= 96  # 64, but for the hash
        for a, b in ((a, b) for a in one for b in (two if i != j else one) if a != b):
            met.setdefault((shard, min(a, b), max(a, b)), set()).add((i, j))
    fit = {(s, a, b) for s, own in shards.items() for a in own for b in own if a < b and 5 * size[a] >= 4 * size[b] and 5 * size[b] >= 4 * size[a]}
    assert len(fit) > 50_000 and fit <= met.keys() and all(len(met[x]) == 1 for x in fit)
    assert dealt < 0.75 * sum(len(own) * -(-len(own) // 64) for own in shards.values())  # every part of the shard, as before


def test_packing_ships_no_more_than_it_needs(spark, monkeypatch):
    """The search for bounds sends scores without documents, and token ids are entropy-coded; what is packed stays the same."""
    frame = type(spark.range(0))
    sent, run = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema, *more: (sent.append(schema), run(df, f, schema, *more))[1])
    texts = topical(300, 40)
    library = bm25_pack.Library(bm25_pack.id_and_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"), "byte_bpe_50k.json", neighbours=8, shard_bytes=2000)
    seeds = library.seeds()
    marks = library.marks(library.texts.where("not is_seed").select("doc"))
    told = library.answers(seeds, 0, marks, True).toPandas()
    assert [x for x in sent if "score" in x] == ["part int, seed binary, score binary", "part int, seed binary, doc binary, score binary"]
    of = told.sort_values(["seed", "rank"]).groupby("seed")["score"].apply(list)
    assert len(of) == 15 and all(len(x) == 8 and x == sorted(x, reverse=True) for x in of)
    monkeypatch.setattr(bm25_pack, "SAMPLED_SHARDS", 1 << 30)  # no bound
    assert set(map(tuple, library.answers(seeds, 0, marks, True).toPandas().values)) == set(map(tuple, told.values))
    for row in library.index.select("sizes", "tokens").collect():
        n = int(np.frombuffer(row["sizes"], np.int32).sum())
        assert len(bm25_pack.unsqueezed(row["tokens"], n)) == n
    assert sum(len(r["tokens"]) for r in library.index.select("tokens").collect()) < 2 * library.texts.groupBy().sum("size").first()[0]


def test_equal_words_are_encoded_once():
    """Ids and terms are those of whole texts, though only distinct words go through the tokenizer."""
    import pyarrow as pa

    rng = random.Random(6)
    odd = ["", " ", "  a", "a ", "a  b ", "it's 'he 's 12 ,, é  b", "\n\n q\n r", "A a\tA", "à  x　 　y 日本 語", "x\u0085 \u0085y", "a\x1cb c\r\nd"]
    odd += ["".join(rng.choices([*"   ab'1!\n\r", "'s", "é", "à", "日", " ", "\u0085", " ", "　", "​", "﻿"], k=rng.randrange(40))) for _ in range(2000)]
    bodies = [t.encode() for t in odd] + [None, b"a \xff b", b"\xc2 \xa0 \xe3\x80", b"\xe2\x80 b"] + [b" ".join(rng.choices([b"some", b"words,", b"again."], k=500)) for _ in range(100)]
    encode, at = bm25_pack.encoder("byte_bpe_50k.json"), 0
    whole, plain, width = bm25_pack.vocabulary_of("byte_bpe_50k.json")
    for ids, data, edges in bm25_pack._chunks(pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies, pa.binary())], names=["id", "body"])):
        for tokens, token_at, terms, times, term_at in bm25_pack.encoded(data, edges, "byte_bpe_50k.json"):
            for d in range(len(token_at) - 1):
                body = bodies[at] or b""
                assert tokens[token_at[d] : token_at[d + 1]].tolist() == [*encode(body.decode("utf-8", "replace")).tolist(), 0]
                for got, want in zip((terms, times), bm25_pack.terms_of(body)):
                    assert np.array_equal(got[term_at[d] : term_at[d + 1]], want)
                at += 1
    assert at == len(bodies)
    data, sent = np.frombuffer(b" ".join([b"some words again"] * 1000), np.uint8), []

    class Counted:
        def encode_to_numpy(self, text, **more):
            sent.append(text)
            return plain.encode_to_numpy(text, **more)

        def encode_ordinary(self, text):
            sent.append(text)
            return whole.encode_ordinary(text)

    bm25_pack._loaded["counted"] = (Counted(), Counted(), width)
    assert sum(len(x[0]) for x in bm25_pack.encoded(data, np.array([0, len(data)]), "counted")) == 1 + len(encode(data.tobytes().decode()))
    assert sum(map(len, sent)) < 100


def test_shards_of_a_cluster_are_scored_together(monkeypatch):
    texts = topical(240, 40)
    found = [bm25_pack.terms_of(t.encode()) for t in texts]
    df = np.bincount(np.concatenate([t for t, _ in found]), minlength=bm25_pack.TERMS)
    idf, mean = np.log1p((len(texts) - df + 0.5) / (df + 0.5)).astype(np.float32), sum(n.sum() for _, n in found) / len(found)
    seeds, live = range(0, 240, 20), np.arange(40) % 3 > 0
    asked = (np.array(seeds), np.ones(12, np.int32), np.cumsum([0] + [len(found[s][0]) for s in seeds]), np.concatenate([found[s][0] for s in seeds]))
    calls, score = [], bm25_pack.Search._score
    monkeypatch.setattr(bm25_pack.Search, "_score", lambda self, *a: (calls.append(1), score(self, *a))[1])

    def told():
        search = bm25_pack.Search(*asked, np.zeros(12, np.int32), idf, mean, 10)
        for k in range(6):
            arrays = bm25_pack.make_shard([(np.zeros(1, np.uint16), *found[i]) for i in range(40 * k, 40 * k + 40)])
            search.add(k, 0, live, *[arrays[c] for c in ("lengths", "terms", "first", "docs", "times")])
        return {(int(s), int(d)): int(x) for s, d, x in zip(*search.best())}

    together, n = told(), len(calls)
    monkeypatch.setattr(bm25_pack, "JOINED", 1)
    apart = told()
    assert n == 1 and len(calls) == 7 and together.keys() == apart.keys() and len(together) == 120
    assert all(abs(together[k] - apart[k]) <= 1 for k in apart)
    brute, bags = bm25(texts)
    for (s, d), x in together.items():
        assert live[d & 16383] and abs(x / bm25_pack.STEPS - brute(bags[20 * s], 40 * (d >> 14) + (d & 16383))) < 0.02
