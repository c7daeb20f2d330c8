"""Audits, fragments, gates and the MinHash index against hand-worked cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audits, near_index
from millrace.plans.audits import near_train_copies


def words_of(text):
    import re

    w = re.findall(r"\w+", text.lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def jaccard(a, b):
    a, b = words_of(a), words_of(b)
    return len(a & b) / max(1, len(a | b))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(pool) for _ in range(300)] for _ in range(40)]
    out = []
    for i, w in enumerate(base):
        near = list(w)
        near[rng.randrange(300)] = "changed"
        out += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(w).upper())]
    return [*out, (1000, None), (1001, ""), (1002, "two words"), (1003, "Two, words!")]


def test_index_finds_what_brute_force_finds(spark, texts):
    docs = spark.createDataFrame(texts, "id long, text string")
    sigs = near_index.signatures(docs, "id", "text")
    old, new = sigs.where("key % 3 = 0"), sigs.where("key % 3 <> 0")
    got = {r["key"]: r["found"] for r in near_index.nearest(new, near_index.build_index(old)).collect()}
    known = [(k, t) for k, t in texts if k % 3 == 0 and t is not None]
    for k, t in texts:
        if k % 3 and t is not None:
            best = max(known, key=lambda o: (jaccard(t, o[1]), -o[0]))
            if jaccard(t, best[1]) >= 0.95:
                assert got[k] == best[0]
            elif jaccard(t, best[1]) < 0.6:
                assert k not in got


def test_batches_keep_the_first_come(spark, texts):
    rows = [r for r in texts if r[0] < 60]
    docs = spark.createDataFrame(rows, "id long, text string")
    first, index = near_index.add_batch(None, docs.where("id < 31"), "id", "text")
    kept = {r["key"] for r in first.where("kept").collect()}
    assert kept == {k for k, _ in rows if k < 31 and k % 3 == 0}
    index = index.cache()
    second, index = near_index.add_batch(index, docs.where("id >= 31"), "id", "text")
    got = {r["key"]: (r["kept"], r["found"]) for r in second.collect()}
    assert got[31] == (False, 30) and got[32] == (False, 30) and {k for k, v in got.items() if v[0]} == {k for k, _ in rows if k > 32 and k % 3 == 0}
    assert index.count() == 20


def test_near_train_copies(spark, tmp_path):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(pool) for _ in range(100))
        rows += [(2 * i, text), (2 * i + 1, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = {r["doc_id"]: r["s"] for r in docs.select("doc_id", tx.hash_split(F.col("text")).alias("s")).collect()}
    expected = {k: k ^ 1 for k in split if split[k] != "train" and split[k ^ 1] == "train"}
    got = {r["key"]: r["found"] for r in near_train_copies(lambda name: docs).collect()}
    assert expected and got == expected


def test_text_forms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(tx.normalised(F.lit('“A—b”: {"C": 1}… Straße'))) == "a-b c 1 ... strasse"
    assert value(tx.cleaned_name(F.lit("  a \n b.. "))) == "a b"
    assert value(tx.plain_words(F.lit(" It's, fine! "))) == "it s fine"
    assert value(tx.without_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(tx.without_fences(F.lit('{"a": 1}'))) == '{"a": 1}'


def test_evidence_and_fragments(spark):
    state = 'The parcel {"status":"done"} reached Berlin on 12 May, signed by Jane Doe.'
    cases = {
        '"status": "done"': True, "parcel … reached Berlin": True, "xy": False, "": False, "Jane Doe signed Berlin parcel": True,
        "Paris London Rome Madrid": False, "Berlin": True, "Hamburg": False, None: False,
    }
    rows = spark.createDataFrame([(i, e, state) for i, e in enumerate(cases)], "id int, e string, s string")
    got = rows.select("id", audits.evidence_holds(tx.normalised(F.col("e")), tx.normalised(F.col("s"))).alias("ok")).orderBy("id").collect()
    assert [r["ok"] for r in got] == list(cases.values())
    quoted = [("nothing like that here ... 'reached Berlin on 12 May'; invented words again", "reached Berlin on 12 May"), ("all of it made up; wholly", "all of it made up; wholly"), ("Jane Doe", "Jane Doe"), (None, None)]
    rows = spark.createDataFrame([(i, e, state) for i, (e, _) in enumerate(quoted)], "id int, e string, s string")
    got = audits.best_fragment(rows, ["id"], "e", "s").orderBy("id").collect()
    assert [r["fragment"] for r in got] == [want for _, want in quoted]


def test_sentences_pairs_and_gates(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    said = F.array(*map(F.lit, ["It is red.", "It is very blue.", "Nothing else."]))
    assert value(audits.sentence_of(said, F.lit("it is very BLUE"))) == 2
    assert value(audits.sentence_of(said, F.lit("it is"))) is None and value(audits.sentence_of(said, F.lit("?"))) is None
    assert value(audits.moved(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.5), F.lit(4.0)), 0, 5)) is True
    pairs = spark.createDataFrame([("abcd", "abce", "x", "x"), ("abcd", "wxyz", "x", "x"), ("abcd", "abce", "x", "y"), ("same", "same", None, None)], "a_t string, b_t string, a_f string, b_f string")
    assert [r["b_t"] for r in audits.minimal_pairs(pairs, ["t", "f"], "t").collect()] == ["abce"]
    rules = [("number", r"E\d+"), ("line", r"(?i)kill line")]
    assert value(audits.gate(F.lit("E7 cites E1 and E2, kill line 3"), rules, ["E1", "E2", "E3"])) == []
    assert value(audits.gate(F.lit("cites E1"), rules, ["E1", "E2"])) == ["line", "citations"]
    for shown, unknown in {"not_stated": True, "N/A": True, "other": True, "another": False, "blue": False, "none of these": True}.items():
        assert value(audits.unknown_option(F.lit(shown))) is unknown
    shapes = {("list", '["a", " "]'): "bad_list", ("list", '["a", "b"]'): None, ("json", "{}"): "bad_json", ("json", '{"a": 1}'): None, ("json", "x"): "bad_json", ("text", "w " * 15): None, ("text", "w"): "bad_text"}
    for (kind, text), want in shapes.items():
        assert value(audits.state_shape(F.lit(text), kind)) == want, (kind, text)


def test_forced_ece_adds_exactly(spark):
    from fractions import Fraction

    from millrace.operators.metrics import build_records, sliced

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    records = build_records(read("documents"), read("labels"), "a")
    groups = {}
    for r in sliced(records.where("gold <> '__NULL__'")).collect():
        c = max(r["p_good"], r["p_bad"]) / (r["p_good"] + r["p_bad"])
        groups.setdefault(r["slice"], []).append((c, r["doc_id"], Fraction(round(c * 10**12), 10**12) - (r["forced"] == r["gold"])))
    want = {}
    for name, rows in groups.items():
        rows.sort()
        size, more = divmod(len(rows), 15)
        ends = [size * k + min(k, more) for k in range(16)]
        gap = sum(abs(sum(x[2] for x in rows[a:b])) for a, b in zip(ends, ends[1:])) / len(rows)
        want[name] = (gap * 10**6 + Fraction(1, 2)).__floor__() / 10**6
    assert {r[0]: r[1] for r in audits.forced_ece(records).collect()} == want


def test_signatures_make_shingles_once_a_text(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 997}" for j in range(4000))) for k in range(1, 9)], "doc_id long, text string").repartition(1)
    tokens = docs.select("doc_id", F.explode(F.array(tx.words(F.col("text")))).alias("w"))
    plain = {r[0]: list(r[1]) for r in tokens.limit(1).select("doc_id", tx.min_hashes(F.col("w"))).collect()}
    made = {r["key"]: list(r["sig"]) for r in near_index.signatures(docs, "doc_id", "text").collect()}
    assert len(made) == 8 and all(made[k] == sig for k, sig in plain.items())
    plan = near_index.signatures(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    seeded = [line for line in plan.splitlines() if "sequence(0, 63" in line or "array_min" in line]
    assert not any("array_join" in line for line in seeded)
