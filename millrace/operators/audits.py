"""Audits of systems, critics and generators: changed answers, bake-offs, disagreement, score questions, gates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import SPACED, folded, normalised, plain_words, stripped
from millrace.operators.metrics import NULL

#: How an option says that something is not known; the ends and flags of an audit.
UNKNOWN = (
    r"(?i)\b(unknown|not (yet )?(known|stated|mentioned|specified|provided|given|determined|available|clear|enough)"
    r"|cannot be (determined|known)|can't (tell|say)|unclear|none of (the|these)|n/?a|insufficient)\b|^other$"
)
SURE, READS, MOVES_SOME, MOVES = 0.9, 0.2, 0.1, 0.2


def _mean(x: Column) -> Column:
    return F.round(F.avg(x.cast("double")), 6)


def change_rates(rows: DataFrame, keys: list[str], kind: str, mirror: dict[str, str]) -> DataFrame:
    """Per kind and variant: n, share of answers that differ from the original's, and a flag.

    rows: keys, kind, variant (orig, without:<field>, reorder, filler, swap), top. Under swap an answer should be mirrored.
    """
    orig = rows.where("variant = 'orig'").select(*keys, F.col("top").alias("__orig"))
    table = F.create_map(*[F.lit(x) for pair in mirror.items() for x in pair])
    expected = F.when(F.col("variant") == "swap", F.coalesce(table[F.col("__orig")], F.col("__orig"))).otherwise(F.col("__orig"))
    both = rows.where("variant <> 'orig'").join(orig, keys)
    per = both.groupBy(kind, "variant").agg(F.count("*").alias("n"), F.avg((F.col("top") != expected).cast("double")).alias("changed"))
    dropped = F.col("variant").startswith("without:")
    flag = F.when(dropped & (F.col("changed") < READS), "barely_reads").when(~dropped & (F.col("changed") > MOVES), "moves").when(~dropped & (F.col("changed") > MOVES_SOME), "moves_some")
    return per.withColumn("flag", F.coalesce(flag, F.lit("fine"))).withColumn("changed", F.round("changed", 6))


def sure_mistakes(rows: DataFrame, kind: str) -> DataFrame:
    """Per kind: n, accuracy, number of mistakes and the share of them made with a confidence of 0.9 or more. rows: top, gold, confidence."""
    wrong = F.col("top") != F.col("gold")
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), _mean(~wrong).alias("accuracy"), F.count_if(wrong).alias("mistakes"), _mean(F.when(wrong, F.col("confidence") >= SURE)).alias("sure")
    )


def critic_bakeoff(rows: DataFrame, model: str, human_ok: Column, flagged: Column) -> DataFrame:
    """Per model: what a critic catches of what people reject, what it flags of what they accept, precision before and after."""
    marked = rows.select(model, human_ok.alias("ok"), flagged.alias("f"))
    kept = ~F.col("f")
    return marked.groupBy(model).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("ok")).alias("n_bad"),
        F.count_if(F.col("ok")).alias("n_good"),
        F.count_if(~F.col("ok") & F.col("f")).alias("caught"),
        F.count_if(F.col("ok") & F.col("f")).alias("false_flags"),
        _mean(F.col("ok")).alias("precision_before"),
        F.coalesce(_mean(F.when(kept, F.col("ok"))), F.lit(0.0)).alias("precision_after"),
        _mean(kept).alias("kept_share"),
    )


def verifier_bakeoff(rows: DataFrame, model: str, human_ok: Column, agrees: Column, seconds: Column) -> DataFrame:
    """Per model: share of good questions kept, of bad ones rejected (0 where there are none), seconds an example."""
    marked = rows.select(model, human_ok.alias("ok"), agrees.alias("a"), seconds.alias("s"))
    share = lambda where, x: F.coalesce(_mean(F.when(where, x)), F.lit(0.0))
    return marked.groupBy(model).agg(
        share(F.col("ok"), F.col("a")).alias("keeps_good"), share(~F.col("ok"), ~F.col("a")).alias("rejects_bad"), _mean(F.col("s")).alias("sec_per_example")
    )


def disagreement(rows: DataFrame, cell: list[str], disputed: Column) -> DataFrame:
    """Per cell: asked, disputed and their ratio, over every checked question."""
    per = rows.groupBy(*cell).agg(F.count("*").alias("asked"), F.count_if(disputed).alias("disputed"))
    return per.withColumn("rate", F.round(F.col("disputed") / F.col("asked"), 6))


def score_summary(records: DataFrame, group: str) -> DataFrame:
    """Score questions with a gold value: n, share that got a value, mean error of those, and share of gold values inside the interval.

    records: gold_unit, pred_unit (null: none given), low and high (null: no distribution). Gold is squeezed off 0 and 1.
    """
    from millrace.operators.calibrate import squeeze

    y = squeeze(F.col("gold_unit"))
    inside = F.when(F.col("low").isNotNull(), (F.col("low") <= y) & (y <= F.col("high")))
    return records.where("gold_unit is not null").groupBy(group).agg(
        F.count("*").alias("n"), _mean(F.col("pred_unit").isNotNull()).alias("answered"), _mean(F.abs(F.col("gold_unit") - F.col("pred_unit"))).alias("mae"), _mean(inside).alias("coverage")
    )


def loss_statistics(records: DataFrame) -> DataFrame:
    """Cross entropies of the null answer and of the labels of answerable questions, and both accuracies. One row."""
    floor, null = F.lit(1e-12), F.col("gold") == NULL
    bce = F.when(null, -F.log(F.greatest("p_null", floor))).otherwise(-F.log(F.greatest(1 - F.col("p_null"), floor)))
    given = F.when(F.col("gold") == "good", F.col("p_good")).otherwise(F.col("p_bad")) / F.greatest(1 - F.col("p_null"), floor)
    return records.agg(
        F.count("*").alias("n"), _mean(bce).alias("null_bce"), _mean(F.when(~null, -F.log(F.greatest(given, floor)))).alias("choice_ce"),
        _mean((F.col("p_null") >= 0.5) == null).alias("null_accuracy"), _mean(F.when(~null, F.col("forced") == F.col("gold"))).alias("choice_accuracy"),
    )


def forced_ece(records: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-mass ECE of the best label among the labels alone, over answerable questions, per slice."""
    from pyspark.sql import Window as W

    from millrace.operators.metrics import sliced

    best = F.greatest("p_good", "p_bad") / F.coalesce(F.nullif(F.col("p_good") + F.col("p_bad"), F.lit(0.0)), F.lit(1.0))
    rows = sliced(records.where(F.col("gold") != NULL)).withColumn("c", best)
    rows = rows.withColumn("bin", F.ntile(bins).over(W.partitionBy("slice").orderBy("c", "doc_id")))
    # n times the gap of the means is the gap of the sums; in decimals, so that a half in the seventh place does not hang on the order of adding
    exact = "decimal(24,12)"
    gap = F.abs(F.sum(F.col("c").cast(exact)) - F.sum((F.col("forced") == F.col("gold")).cast("int")))
    per = rows.groupBy("slice", "bin").agg(F.count("*").alias("n"), gap.alias("gap"))
    share = F.sum("gap").cast(exact) / F.sum("n").cast("decimal(12,0)")
    return per.groupBy("slice").agg(F.round(share, 6).cast("double").alias("forced_ece"))


def unknown_option(text: Column) -> Column:
    """Does an option's id or text say that the answer is not known?"""
    return F.trim(F.translate(text, "_", " ")).rlike(UNKNOWN)


def state_shape(text: Column, kind: str) -> Column:
    """Null where a state has the shape of its kind: a text of 15 words, a JSON list of two texts, a JSON object with a field."""
    if kind == "text":
        good = F.regexp_count(text, F.lit(SPACED)) >= 15
    elif kind == "list":
        good = F.size(F.filter(F.from_json(text, "array<string>"), lambda x: F.length(stripped(x)) > 0)) >= 2
    else:
        good = F.size(F.json_object_keys(text)) > 0
    return F.when(~F.coalesce(good, F.lit(False)), f"bad_{kind}")


def _telling(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9.@%$/-]*)"))
    return F.filter(found, lambda w: (F.length(w) > 2) | w.rlike(r"^\d+$"))


def evidence_holds(evidence: Column, state: Column, share: float = 0.8) -> Column:
    """The normalised state holds the normalised evidence, or that share of its telling words (two at least, repeats counted).

    Both sides given are normalised texts; evidence under three characters never holds."""
    wanted = _telling(evidence)
    have = F.regexp_extract_all(state, F.lit(r"([a-z0-9][a-z0-9.@%$/-]*)"))
    found = F.size(F.filter(wanted, lambda w: F.array_contains(have, w))).cast("double")
    return F.coalesce((F.length(evidence) >= 3) & (F.contains(state, evidence) | ((F.size(wanted) >= 2) & (found >= F.size(wanted) * share))), F.lit(False))


def best_fragment(rows: DataFrame, key: list[str], evidence: str, state: str) -> DataFrame:
    """Evidence as it is where the state holds it, else its longest fragment (8 characters or more) that holds, else as it is."""
    long = F.filter(F.split(evidence, r"\.\.\.|\x{2026}|;|\|"), lambda p: F.length(stripped(p)) >= 8)
    parts = F.transform(long, lambda p: F.btrim(p, F.lit(" \"'")))
    whole = evidence_holds(normalised(F.col(evidence)), normalised(F.col(state)))
    each = rows.select(*key, F.col(evidence).alias("__e"), F.col(state).alias("__s"), whole.alias("__whole"), F.posexplode_outer(parts).alias("__pos", "__part"))
    holds = evidence_holds(normalised(F.col("__part")), normalised(F.col("__s")))
    each = each.withColumn("__size", F.when(holds, F.length("__part")))
    per = each.groupBy(*key, "__e", "__whole").agg(F.max_by("__part", F.struct("__size", -F.col("__pos"))).alias("__best"), F.max("__size").alias("__size"))
    return per.select(*key, F.when(F.col("__whole") | F.col("__size").isNull(), F.col("__e")).otherwise(F.col("__best")).alias("fragment"))


def sentence_of(sentences: Column, quote: Column) -> Column:
    """The place (from 1) of the one sentence that equals, holds or lies in the quote, words alone compared; null if none or several."""
    said = plain_words(quote)
    hit = F.transform(sentences, lambda s: (plain_words(s) == said) | F.contains(said, plain_words(s)) | F.contains(plain_words(s), said))
    return F.when((F.length(said) > 0) & (F.size(F.filter(hit, lambda x: x)) == 1), F.array_position(hit, F.lit(True)))


def moved(a: Column, b: Column, low: float, high: float, least: float = 0.3) -> Column:
    """Does some score of b differ from its twin's in a by that share of the range?"""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y) / (high - low))) >= least


def minimal_pairs(pairs: DataFrame, fields: list[str], varied: str, least: float = 0.6) -> DataFrame:
    """Pairs (a_<field>, b_<field>) that differ in one field alone, and there by little."""
    from millrace.operators.questions import similarity_ratio

    same = [F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields if f != varied]
    rows = pairs.where(F.col(f"a_{varied}") != F.col(f"b_{varied}"))
    for s in same:
        rows = rows.where(s)
    return rows.withColumn("ratio", similarity_ratio(f"a_{varied}", f"b_{varied}")).where(F.col("ratio") >= least)


def taxonomy(rows: DataFrame, formats: list[str], least: int = 2) -> DataFrame:
    """(sector, domain, n_types): domains with enough distinct document types of a known format; a name (case folded) that an
    earlier sector has kept is dropped. rows: sector, domain, doc_type, format, cleaned."""
    known = rows.where(F.col("format").isin(formats) & (F.length("domain") > 0) & (F.length("doc_type") > 0))
    per = known.groupBy("sector", folded(F.col("domain")).alias("__d")).agg(F.min("domain").alias("domain"), F.countDistinct(folded(F.col("doc_type"))).alias("n_types"))
    from millrace.operators.build import first_per_key

    return first_per_key(per.where(F.col("n_types") >= least), ["__d"], "sector").drop("__d")


def option_sets(rows: DataFrame, question: list[str], label: str, least: int) -> DataFrame:
    """Sets of labels that at least so many questions offer."""
    sets = rows.groupBy(*question).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))
    return sets.groupBy("labels").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def verdicts(means: DataFrame, value: str, target: float, guard: float) -> DataFrame:
    """Each row's verdict: target reached, guard broken, or between."""
    verdict = F.when(F.col(value) >= target, "reached").when(F.col(value) < guard, "broken").otherwise("between")
    return means.withColumn("verdict", verdict)


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """A decision table: the action of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(a)) for c, a in rules], F.lit(otherwise))


def gate(text: Column, required: list[tuple[str, str]], known: list[str], least: int = 2) -> Column:
    """Names of the required patterns that a text lacks, and `citations` where it names fewer than `least` known ids."""
    lacking = [F.when(~text.rlike(p), F.lit(n)) for n, p in required]
    named = [text.rlike(rf"\b{k}\b").cast("int") for k in known]
    lacking.append(F.when(sum(named[1:], named[0]) < least if named else F.lit(least > 0), F.lit("citations")))
    return F.array_compact(F.array(*lacking))
