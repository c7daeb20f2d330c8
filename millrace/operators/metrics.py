"""Prediction records and what is computed from them. The null answer is a class of its own, never SQL NULL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import unit_draw

NULL = "__NULL__"


def build_records(docs: DataFrame, labels: DataFrame, system: str) -> DataFrame:
    """Deterministic stand-ins for a system's predictions, one row per labelled document."""
    u = [unit_draw(system, k, F.col("doc_id")) for k in (1, 2, 9)]
    base = docs.join(labels, "doc_id").select("doc_id", "source", "lang", "quality", "toxic", *[x.alias(f"u{k}") for k, x in zip((1, 2, 9), u)])
    base = base.where("u9 >= 0.1")
    p_null = F.col("u1") * 0.6
    rows = base.select(
        "doc_id", "source", "lang",
        F.when(F.col("toxic") == 1, NULL).when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"),
        p_null.alias("p_null"), ((1 - p_null) * F.col("u2")).alias("p_good"), ((1 - p_null) * (1 - F.col("u2"))).alias("p_bad"),
    )
    forced = F.when(F.col("p_good") >= F.col("p_bad"), "good").otherwise("bad")
    rows = rows.withColumn("forced", forced).withColumn("decision", F.when(F.col("p_null") >= 0.5, NULL).otherwise(forced))
    best = F.greatest("p_good", "p_bad")
    return rows.withColumn("confidence", F.when(F.col("decision") == NULL, F.col("p_null")).otherwise(best))


def sliced(records: DataFrame) -> DataFrame:
    """A row for each slice that a record is in: all, its language, its source, null when gold is null."""
    null = F.when(F.col("gold") == NULL, F.array(F.lit("null:toxic"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.lit("overall"), F.concat(F.lit("eval:"), "lang"), F.concat(F.lit("source:"), "source")), null)
    return records.withColumn("slice", F.explode(names))


def _mean(x: Column, where: Column | None = None) -> Column:
    x = x.cast("double")
    return F.round(F.avg(x if where is None else F.when(where, x)), 6)


def summary(records: DataFrame) -> DataFrame:
    right = F.col("decision") == F.col("gold")
    answerable = F.col("gold") != NULL
    gold_p = F.when(F.col("gold") == NULL, F.col("p_null")).when(F.col("gold") == "good", F.col("p_good")).otherwise(F.col("p_bad"))
    squares = F.pow("p_null", F.lit(2.0)) + F.pow("p_good", F.lit(2.0)) + F.pow("p_bad", F.lit(2.0))
    abstained = F.col("decision") == NULL
    return sliced(records).groupBy("slice").agg(
        F.count("*").alias("n"),
        _mean(right).alias("accuracy"),
        _mean(right, answerable).alias("answerable_accuracy"),
        _mean(F.col("forced") == F.col("gold"), answerable).alias("forced_accuracy"),
        _mean(squares - 2 * gold_p + 1).alias("brier"),
        _mean(-F.log(F.greatest(gold_p, F.lit(1e-12)))).alias("nll"),
        _mean(~answerable, abstained).alias("abstain_precision"),
        _mean(abstained, ~answerable).alias("abstain_recall"),
        _mean(abstained).alias("abstain_rate"),
    )


def macro_f1(records: DataFrame) -> DataFrame:
    """Per slice: the mean over classes, in gold or predicted, of 2 tp / (2 tp + fp + fn)."""
    counts = sliced(records).groupBy("slice", "gold", "decision").agg(F.count("*").alias("n"))
    sides = counts.select("slice", "n", (F.col("gold") == F.col("decision")).alias("hit"), F.explode(F.array("gold", "decision")).alias("cls"))
    per = sides.groupBy("slice", "cls").agg((F.sum(F.expr("if(hit, n, 0)")) / F.sum("n")).alias("f1"))
    return per.groupBy("slice").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def ece_equal_mass(records: DataFrame, bins: int = 15) -> DataFrame:
    binned = sliced(records).withColumn("bin", F.ntile(bins).over(W.partitionBy("slice").orderBy("confidence", "doc_id")))
    return _ece(binned)


def ece_equal_width(records: DataFrame, bins: int = 10) -> DataFrame:
    """Bins (lo, hi]; a confidence of exactly 0 is in none, but counts in the total."""
    return _ece(sliced(records).withColumn("bin", F.ceil(F.col("confidence") * bins)))


def _ece(binned: DataFrame) -> DataFrame:
    right = (F.col("decision") == F.col("gold")).cast("double")
    per = binned.groupBy("slice", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg(right)).alias("gap"))
    gap = F.sum(F.when(F.col("bin") > 0, F.col("n") * F.col("gap")).otherwise(0.0))
    return per.groupBy("slice").agg(F.round(gap / F.sum("n"), 6).alias("ece"))


def aurc(records: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve, and the share closed of the gap from a random to the best order."""
    w = W.partitionBy("slice").orderBy(F.desc("confidence"), "doc_id")
    best = W.partitionBy("slice").orderBy("wrong", "doc_id")
    run = W.unboundedPreceding, 0
    rows = sliced(records).withColumn("wrong", (F.col("decision") != F.col("gold")).cast("double"))
    rows = rows.withColumn("risk", F.sum("wrong").over(w.rowsBetween(*run)) / F.row_number().over(w))
    rows = rows.withColumn("least", F.sum("wrong").over(best.rowsBetween(*run)) / F.row_number().over(best))
    out = rows.groupBy("slice").agg(F.avg("risk").alias("r"), F.avg("least").alias("l"), F.avg("wrong").alias("w"))
    gap = F.when(F.col("w") > F.col("l"), (F.col("w") - F.col("r")) / (F.col("w") - F.col("l")))
    return out.select("slice", F.round("r", 6).alias("aurc"), F.round(gap, 6).alias("gap_closed"))


def cascade(small: DataFrame, large: DataFrame, thresholds: list[float]) -> DataFrame:
    """Questions with a gold label whose best label small gives less than a threshold go to large: share sent, accuracy of the best labels."""
    asked = small.where(F.col("gold") != NULL).select("doc_id", "gold", F.greatest("p_good", "p_bad").alias("top"), F.col("forced").alias("s"))
    both = asked.join(large.select("doc_id", F.col("forced").alias("l")), "doc_id")
    sent = F.col("top") < F.col("t")
    rows = both.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.groupBy("t").agg(
        F.count("*").alias("n"), _mean(sent).alias("sent"), _mean(F.when(sent, F.col("l")).otherwise(F.col("s")) == F.col("gold")).alias("accuracy")
    )


def fit_null_threshold(sweep: DataFrame, least: float = 0.9) -> DataFrame:
    """The row of a sweep to use: among those precise enough the most accurate, then the nearest to one half; else the most precise."""
    enough = F.col("precision") >= least
    order = [enough.desc(), F.when(enough, 0.0).otherwise(F.col("precision")).desc(), F.desc("accuracy"), F.when(enough, F.round(F.abs(F.col("t") - 0.5), 6)).otherwise(0.0), "t"]
    return sweep.orderBy(*order).limit(1)


def threshold_sweep(records: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each null threshold the decision accuracy and abstention precision (1 when nobody abstains)."""
    rows = records.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    out = F.col("p_null") >= F.col("t")
    right = F.when(out, F.col("gold") == NULL).otherwise((F.col("gold") != NULL) & (F.col("forced") == F.col("gold")))
    precision = F.avg(F.when(out, (F.col("gold") == NULL).cast("double")))
    return rows.groupBy("t").agg(_mean(right).alias("accuracy"), F.round(F.coalesce(precision, F.lit(1.0)), 6).alias("precision"))


def group_agreement(records: DataFrame, group: Column, size: int) -> DataFrame:
    """Groups that have all size members: share with every one right, share with one distinct answer."""
    per = records.groupBy(group.alias("g")).agg(
        F.count("*").alias("n"), F.min((F.col("decision") == F.col("gold")).cast("int")).alias("right"), F.countDistinct("decision").alias("k")
    )
    return per.where(F.col("n") == size).agg(F.count("*").alias("n_groups"), _mean(F.col("right")).alias("all_right"), _mean(F.col("k") == 1).alias("same_answer"))
