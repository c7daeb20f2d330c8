"""Questions about a state: constructors, validation by the first broken rule, and the decision on a model's raw output.

A question is a struct (id, type, text, labels, min, max, step, allow_null), type `choice` or `score`; an answer a struct
(label, value, is_null); an example has a state, an array of questions and a map of answers by question id.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.text import stripped
from millrace.operators.calibrate import beta_interval

LABEL = "struct<id: string, text: string>"
QUESTION = f"struct<id: string, type: string, text: string, labels: array<{LABEL}>, min: double, max: double, step: double, allow_null: boolean>"
ANSWER = "struct<label: string, value: double, is_null: boolean>"
#: Limits of an example.
MAX_QUESTIONS, MAX_LABELS, MAX_QUESTION_CHARS, MAX_LABEL_CHARS, MAX_ID_CHARS = 32, 32, 500, 200, 64
ID = r"^[A-Za-z0-9_.:\-]+$"


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def label(name, text=None) -> Column:
    return F.struct(_text(name).alias("id"), _text(name if text is None else text).alias("text"))


def choice(name: str, text, labels: Column, allow_null: bool = True) -> Column:
    """labels: an array of label structs."""
    none = F.lit(None).cast("double")
    parts = [F.lit(name), F.lit("choice"), _text(text), labels, none, none, none, F.lit(allow_null)]
    return F.struct(*parts).cast(QUESTION)


def score(name: str, text, low: float, high: float, step: float | None = None, allow_null: bool = True) -> Column:
    none = F.lit(None).cast(f"array<{LABEL}>")
    parts = [F.lit(name), F.lit("score"), _text(text), none, F.lit(float(low)), F.lit(float(high)), F.lit(step).cast("double"), F.lit(allow_null)]
    return F.struct(*parts).cast(QUESTION)


def answer(label=None, value=None, null: Column | bool | None = None) -> Column:
    """A label, a value, or the null answer; without null given, the answer is null where both others are."""
    name, number = _text(label).cast("string"), _text(value).cast("double")
    is_null = name.isNull() & number.isNull() if null is None else _text(null)
    return F.struct(name.alias("label"), number.alias("value"), is_null.alias("is_null")).cast(ANSWER)


def example(key: Column, source: str, state: Column, questions: list[Column], answers: dict[str, Column], tags: list | Column = ()) -> list[Column]:
    """Columns of an example; tags may be plain names or an array column."""
    marks = tags if isinstance(tags, Column) else F.array(*map(_text, tags)).cast("array<string>")
    pairs = [x for name, a in answers.items() for x in (F.lit(name), a)]
    return [
        key.cast("string").alias("key"), F.lit(source).alias("source"), state.alias("state"), F.array(*questions).alias("questions"),
        F.create_map(*pairs).alias("answers"), marks.alias("tags"),
    ]


def question_text(q: Column, low_label: Column, high_label: Column) -> Column:
    """The text of a score question with what its ends mean, where one of them is told."""
    told = F.concat(F.lit(" (min: "), F.coalesce(low_label, F.lit("")), F.lit("; max: "), F.coalesce(high_label, F.lit("")), F.lit(")"))
    some = low_label.isNotNull() | high_label.isNotNull()
    return F.when(some, F.concat(q, told)).otherwise(q)


def short_number(x: Column) -> Column:
    """A number without a fraction of zeros."""
    whole = F.when(x == F.floor(x), F.floor(x).cast("string"))
    return F.coalesce(whole, F.regexp_replace(F.round(x, 6).cast("string"), r"0+$", ""))


def anchored_text(text: Column, low: Column, high: Column, anchors: list[str]) -> Column:
    """A score question's text with what the low end, the middle and the high end of its scale mean."""
    points = [low, (low + high) / 2, high]
    told = [F.concat(short_number(p.cast("double")), F.lit(f" = {a}")) for p, a in zip(points, anchors)]
    return F.concat(F.rtrim(text), F.lit(" ("), F.concat_ws("; ", *told), F.lit(")"))


def _folded(text: Column) -> Column:
    return F.lower(stripped(text))


def _few(items: Column, least: int, most: int) -> Column:
    return F.coalesce(F.size(items).between(least, most), F.lit(False))


def _within(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text).between(1, most), F.lit(False))


def _bad_question(q: Column) -> Column:
    """The first rule that a question breaks by itself, or null."""
    labels = q["labels"]
    ids, texts = F.transform(labels, lambda x: x["id"]), F.transform(labels, lambda x: _folded(x["text"]))
    whole = F.forall(labels, lambda x: _within(x["id"], MAX_LABEL_CHARS) & _within(x["text"], MAX_LABEL_CHARS))
    is_choice, is_score = q["type"] == "choice", q["type"] == "score"
    inf = float("inf")
    finite = ~F.isnan(q["min"]) & ~F.isnan(q["max"]) & (F.abs(q["min"]) < inf) & (F.abs(q["max"]) < inf) & (q["min"] < q["max"])
    return (
        F.when(~F.coalesce(is_choice | is_score, F.lit(False)), "question_type")
        .when(~_within(q["id"], MAX_ID_CHARS) | ~F.coalesce(q["id"].rlike(ID), F.lit(False)), "question_id")
        .when(~_within(q["text"], MAX_QUESTION_CHARS), "question_text")
        .when(is_choice & ~_few(labels, 2, MAX_LABELS), "label_count")
        .when(is_choice & ~F.coalesce(whole, F.lit(False)), "label_text")
        .when(is_choice & (F.size(F.array_distinct(ids)) < F.size(ids)), "label_ids_repeat")
        .when(is_choice & (F.size(F.array_distinct(texts)) < F.size(texts)), "label_texts_repeat")
        .when(is_score & ~F.coalesce(finite, F.lit(False)), "score_range")
        .when(is_score & (q["step"] <= 0), "score_step")
    )


def _bad_answer(q: Column, a: Column) -> Column:
    """The first rule that an answer breaks for its question, or null."""
    null, is_choice = F.coalesce(a["is_null"], F.lit(False)), q["type"] == "choice"
    offered = F.exists(q["labels"], lambda x: x["id"] == a["label"])
    return (
        F.when(null & ~F.coalesce(q["allow_null"], F.lit(True)), "null_not_allowed")
        .when(null, F.lit(None).cast("string"))
        .when(is_choice & a["label"].isNull(), "label_missing")
        .when(is_choice & ~F.coalesce(offered, F.lit(False)), "label_not_offered")
        .when(~is_choice & a["value"].isNull(), "value_missing")
        .when(~is_choice & ~F.coalesce(a["value"].between(q["min"], q["max"]), F.lit(False)), "value_out_of_range")
    )


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def broken_rule(questions: Column, answers: Column) -> Column:
    """The first rule that an example breaks, or null where it is valid. A missing list or map breaks its rule."""
    ids = F.transform(questions, lambda q: q["id"])
    covers = (F.size(answers) == F.size(ids)) & F.forall(ids, lambda x: F.array_contains(F.map_keys(answers), x))
    return (
        F.when(~_few(questions, 1, MAX_QUESTIONS), F.lit("question_count"))
        .when(_first(F.transform(questions, _bad_question)).isNotNull(), _first(F.transform(questions, _bad_question)))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "question_ids_repeat")
        .when(~F.coalesce(covers, F.lit(False)), "answers_do_not_cover")
        .otherwise(_first(F.transform(questions, lambda q: _bad_answer(q, answers[q["id"]]))))
    )


def soft_target_rule(probs: Column, labels: Column, allow_null: Column, null_name: str = "__null__") -> Column:
    """What is wrong with a map of probabilities over the labels (and the null answer where allowed), or null."""
    allowed = F.concat(F.transform(labels, lambda x: x["id"]), F.when(allow_null, F.array(F.lit(null_name))).otherwise(F.array().cast("array<string>")))
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda s, p: s + p)
    return F.when(~F.forall(F.map_keys(probs), lambda k: F.array_contains(allowed, k)), "soft_keys").when(F.abs(total - 1) > 1e-3, "soft_sum")


def validated(examples: DataFrame, most: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Examples with `reject_reason` (null: valid). most: in each group only that many valid ones, by a hash order of
    the key, stay valid; the others get the reason `over_cap`."""
    marked = examples.withColumn("reject_reason", broken_rule(F.col("questions"), F.col("answers")))
    if most is None:
        return marked
    from pyspark.sql import Window as W

    from millrace.functions.text import stable_hash

    w = W.partitionBy(*group, F.col("reject_reason").isNull()).orderBy(stable_hash("cap", F.col("key")), "key")
    over = F.col("reject_reason").isNull() & (F.col("__n") > most)
    return marked.withColumn("__n", F.row_number().over(w)).withColumn("reject_reason", F.when(over, "over_cap").otherwise(F.col("reject_reason"))).drop("__n")


def flat_answers(examples: DataFrame, keep: list[str] = ("key", "source")) -> DataFrame:
    """A row for each question with its gold answer."""
    rows = examples.select(*keep, "answers", F.posexplode("questions").alias("place", "q"))
    gold = F.col("answers")[F.col("q.id")]
    return rows.select(*keep, "place", F.col("q.id").alias("qid"), "q.type", gold["label"].alias("label"), gold["value"].alias("value"), gold["is_null"].alias("is_null"))


def premises(examples: DataFrame) -> DataFrame:
    """A row for each label of each choice question: the state as premise, question and label text as hypothesis."""
    rows = examples.select("key", "state", F.explode("questions").alias("q")).where("q.type = 'choice'")
    return rows.select("key", F.col("q.id").alias("qid"), F.col("state").alias("premise"), F.col("q.text").alias("asked"), F.inline("q.labels")).select(
        "key", "qid", F.col("id").alias("label"), "premise", F.concat_ws(" ", "asked", "text").alias("hypothesis")
    )


def softmax(z: Column, temperature: float = 1.0) -> Column:
    """Of an array of logits divided by the temperature."""
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def calibrated(raw: DataFrame, t_null: float = 1.0, t_choice: float = 1.0, kappa_scale: float = 1.0) -> DataFrame:
    """Raw outputs (type, z, z_null, p_null, cond_probs, kappa, allow_null) with the three scalars applied."""
    null = F.when(F.col("allow_null"), 1 / (1 + F.exp(-F.col("z_null") / t_null))).otherwise(F.col("p_null"))
    probs = F.when(F.col("type") == "choice", softmax(F.col("z"), t_choice)).otherwise(F.col("cond_probs"))
    return raw.withColumns({"p_null": null, "cond_probs": probs, "kappa": F.col("kappa") * kappa_scale})


def decided(raw: DataFrame, null_threshold: float = 0.5, min_confidence: float = 0.0, interval: float = 0.9) -> DataFrame:
    """The answer to each question: raw outputs (type, labels, cond_probs, mu, kappa, min, max, step, p_null, allow_null) with

    answer_label, answer_value, confidence, abstain_reason (unanswerable, low_confidence or null), mean, std, interval.
    The first of equally probable labels counts. A score's value goes to its nearest step, halves to the even one.
    """
    p = F.transform("cond_probs", lambda c: (1 - F.col("p_null")) * c)
    rows = raw.withColumn("__p", p).withColumn("__top", F.array_max("__p"))
    is_choice, nullable = F.col("type") == "choice", F.coalesce("allow_null", F.lit(True))
    reason = F.when(nullable & (F.col("p_null") >= null_threshold), "unanswerable").when(is_choice & nullable & (F.col("__top") < min_confidence), "low_confidence")
    rows = rows.withColumn("abstain_reason", reason)
    given = F.col("abstain_reason").isNull()
    best = F.element_at("labels", F.array_position("__p", F.col("__top")).cast("int"))
    low, width = F.coalesce("min", F.lit(0.0)), F.coalesce("max", F.lit(1.0)) - F.coalesce("min", F.lit(0.0))
    a, b = F.col("mu") * F.col("kappa"), (1 - F.col("mu")) * F.col("kappa")
    stepped = F.when(F.col("step") > 0, low + F.bround(F.col("mu") * width / F.col("step")) * F.col("step")).otherwise(low + F.col("mu") * width)
    ends = [F.when(~is_choice, low + e * width) for e in beta_interval(F.col("mu"), F.col("kappa"), interval)]
    return rows.select(
        *raw.columns,
        F.when(is_choice & given, best).alias("answer_label"),
        F.when(~is_choice & given, stepped).alias("answer_value"),
        F.when(is_choice, F.when(F.col("abstain_reason") == "unanswerable", F.col("p_null")).otherwise(F.col("__top"))).alias("confidence"),
        "abstain_reason",
        F.when(~is_choice, low + F.col("mu") * width).alias("mean"),
        F.when(~is_choice, F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * width).alias("std"),
        F.when(~is_choice, F.array(*ends)).alias("interval"),
    )


def raw_outputs(questions: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Outputs beside the questions they answer, by place: both have key and an array (questions, outputs)."""
    q = questions.select(key, F.posexplode("questions").alias("place", "q"))
    o = outputs.select(key, F.posexplode("outputs").alias("place", "o"))
    return q.join(o, [key, "place"])


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters of two texts over their length, by longest matching blocks; null for a null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
