"""Rows that the catalogue's queries once left out."""

import pytest

from millrace.plans import audits, examples  # noqa: F401  add to the catalogue
from millrace.plans.catalogue import QUERIES


def test_folded_copies_are_told(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [long, long.upper(), long + " end", "some other words that stand alone", "Some other words, that stand alone!", None, None, "single"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    members = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["near_duplicate_members"](spark, str(tmp_path)).collect()}
    assert members == {0: (0, 2, 1), 1: (0, 2, 1), 2: (2, 1, 1), 3: (3, 2, 0), 4: (3, 2, 0), 5: (5, 1, 0), 6: (6, 1, 0), 7: (7, 1, 0)}
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["near_duplicate_greedy"](spark, str(tmp_path)).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_short_items_are_looked_for_in_short_documents(spark, tmp_path):
    docs = [(0, "a short item"), (1, "here is a short item in a text of more than nine words"), (2, "nothing"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["benchmark_leaks"](spark, str(tmp_path)).collect()] == [(7, 2, 0)]


def test_rules_of_splits_states_and_agreement(spark):
    from pyspark.sql import functions as F

    from millrace.functions.text import clean_prose, hash_split, stable_hash, state_key
    from millrace.operators import examples

    one = spark.range(1)
    assert one.select(stable_hash("split", F.lit("héllo"))).first()[0] == 6768968585743494535
    keys = spark.range(20000).select(hash_split(F.col("id")).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20000 for r in keys}
    assert 0.04 < share["test"] < 0.06 and 0.02 < share["val"] < 0.04
    states = spark.createDataFrame([(" Straße\n",), ("\tSTRASSE",), ("strasse ",)], "t string").select(state_key(F.col("t"))).distinct()
    assert states.count() == 1
    agreed = [examples.agreed_score(F.lit(a), F.lit(b), low, high, step) for a, b, low, high, step in [(6.0, 7.0, 0, 10, False), (2.0, 7.0, 0, 10, False), (3.0, 4.0, 1, 5, False), (3.0, 4.0, 1, 5, True)]]
    assert list(one.select(*[c.alias(f"c{k}") for k, c in enumerate(agreed)]).first()) == [6.5, None, None, 3.5]
    prose = " ".join(["word"] * 14)
    rows = spark.createDataFrame([(prose,), (prose + "\none two three",), (prose + " | x",), ("",), (prose + "\n\n" + prose + "\nmenu",)], "t string")
    assert [r[0] for r in rows.select(clean_prose(F.col("t"))).collect()] == [True, False, False, False, False]


def test_scores_that_differ_by_just_the_room_agree(spark, tmp_path):
    spark.createDataFrame([(20826, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["agreed_scores"](spark, str(tmp_path)).collect()] == [(20826, 5.45)]


def _texts(rng):
    """Near copies of several texts, more of the first than a block holds, and others that share only a frequent passage."""
    shared = " ".join(f"common{k}" for k in range(30))
    texts = []
    for copies in (150, 20, 6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(copies):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy[rng.randrange(9) :]))
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 90))) + " " + shared for _ in range(200)]
    rng.shuffle(texts)
    return [*texts, None, "", "one two", "One two!"]


def test_pairs_are_all_found_and_few_are_compared(spark, monkeypatch):
    import random

    from millrace.operators import build

    texts = _texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets, first = {}, {}
    for i, text in enumerate(texts):
        if text is not None:
            words = text.lower().replace("!", "").split()
            found = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
            sets.setdefault(first.setdefault(found, i), found)
    want = {}
    for a, sa in sets.items():
        for b, sb in sets.items():
            if a < b and 5 * len(sa & sb) >= 4 * len(sa | sb):
                want[a, b] = round(len(sa & sb) / len(sa | sb), 6)
    compared = []
    whole = build._compared
    monkeypatch.setattr(build, "_compared", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    got = {(r["a"], r["b"]): r["jaccard"] for r in build.jaccard_pairs(docs).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(want) > 500
    assert compared[0] < 2 * len(want)
    assert build.jaccard_pairs(docs.limit(0)).count() == 0
