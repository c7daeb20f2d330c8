"""Job logs: last record of a job, totals, costs; and counts that feed audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.build import first_per_key


def job_log(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "retry").otherwise("ok")
    return events.select("event_id", "ts", F.col("user_id").alias("job"), F.col("event_type").alias("role"), status.alias("status"), F.col("value").alias("tokens"))


def last_per_job(log: DataFrame) -> DataFrame:
    return first_per_key(log, ["job"], F.desc("ts"), F.desc("event_id")).select("job", "event_id", "role", "status")


def cost_by_role(log: DataFrame, prices: list[tuple[str, float]]) -> DataFrame:
    """A role that has no price costs nothing."""
    table = F.broadcast(log.sparkSession.createDataFrame(prices, "role string, price double"))  # a fixed list
    cost = F.col("tokens") / 1e6 * F.coalesce("price", F.lit(0.0))
    return log.join(table, "role", "left").groupBy("role").agg(
        F.count("*").alias("n"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.sum(cost), 8).alias("cost")
    )


def job_totals(log: DataFrame) -> DataFrame:
    return last_per_job(log).groupBy("role").agg(
        F.count("*").alias("jobs"), F.sum((F.col("status") == "ok").cast("long")).alias("ok"), F.sum((F.col("status") == "retry").cast("long")).alias("retry")
    )


def axis_counts(df: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n) over several axes in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.axis", "p.value").agg(F.count("*").alias("n"))


def cue_words(rows: DataFrame, words: str, label: str, least: int = 5) -> DataFrame:
    """Words with their count and the share of their commonest label, each word once per row."""
    each = rows.select(F.explode(F.array_distinct(words)).alias("word"), F.col(label).alias("label"))
    per = each.groupBy("word", "label").agg(F.count("*").alias("n"))
    total = per.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return total.where(F.col("n") >= least).select("word", "n", F.round(F.col("most") / F.col("n"), 6).alias("purity"))


def run_energy(samples: DataFrame, run: str, ts: str, watts: str) -> DataFrame:
    """(run, hours, kwh): wall time from a run's first to its last sample, times its mean power."""
    seconds = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    hours = seconds / 3600
    return samples.groupBy(run).agg(F.round(hours, 6).alias("hours"), F.round(hours * F.avg(watts) / 1000, 6).alias("kwh"))


def cost_sets(log: DataFrame) -> DataFrame:
    """Jobs and tokens by role, by day, and in all."""
    days = log.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return days.groupingSets([["role"], ["day"], []], "role", "day").agg(F.count("*").alias("n"), F.round(F.sum("tokens"), 4).alias("tokens"))
