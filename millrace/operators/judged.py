"""Records of other kinds of systems, and audits of questions: word overlap, traps, cue balance, vocabularies, gates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.metrics import NULL

#: Words that say nothing about an option.
STOP = "the a an and or of to in on for with is are be it this that not no yes by as at from about".split()


def verbalised(answer: Column, confidence: Column, outcomes: list[str]) -> dict[str, Column]:
    """Probabilities of a system that names one outcome and how sure it is: that share, the rest spread evenly.

    An answer that is no outcome counts as the null answer; a missing confidence as one half. outcomes holds NULL
    where the question allows it.
    """
    chosen = F.when(answer.isin(outcomes), answer).otherwise(NULL)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5))))
    rest = (1 - sure) / max(1, len(outcomes) - 1)
    return {o: F.when(chosen == o, sure).otherwise(rest) for o in outcomes} | {"decision": chosen, "confidence": sure}


def zero_shot(scores: dict[str, Column]) -> dict[str, Column]:
    """Probabilities from independent scores of labels: what the best one lacks to 1 is the null answer's.

    The first of equal best labels counts.
    """
    best = F.greatest(*scores.values())
    total = sum(scores.values())
    p_null = 1 - best
    share = {k: F.when(total == 0, F.lit(0.0)).otherwise(best * s / total) for k, s in scores.items()}
    first = F.coalesce(*[F.when(s == best, F.lit(k)) for k, s in scores.items()])
    top = F.coalesce(*[F.when(s == best, share[k]) for k, s in scores.items()])
    abstains = p_null >= 0.5
    decision = F.when(abstains, NULL).otherwise(first)
    return share | {NULL: p_null, "decision": decision, "confidence": F.when(abstains, p_null).otherwise(top)}


def telling_words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least that length, without those that say nothing."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(STOP)))


def overlap(option_words: Column, state_words: Column) -> Column:
    """Share of an option's distinct words that the state holds."""
    both = F.size(F.array_intersect(option_words, state_words)).cast("double")
    return both / F.greatest(F.lit(1), F.size(option_words))


def overlap_rule(options: DataFrame, key: str, share: str, is_gold: str) -> DataFrame:
    """What a rule that picks the option with the most overlap would reach. options: one row an option.

    (n_questions, n_fires, accuracy, chance, lift): the rule fires where some option has overlap; it is right where
    the gold option alone has the most.
    """
    best = F.max(share)
    questions = options.groupBy(key).agg(
        F.count("*").alias("n"),
        best.alias("best"),
        F.max_by(F.struct(share, is_gold), share).alias("top"),
        F.sort_array(F.collect_list(share), asc=False).alias("shares"),  # a question has few options
    )
    questions = questions.where("n >= 2")
    alone = F.col("shares")[0] > F.col("shares")[1]
    fires = F.col("best") > 0
    right = F.when(fires, (alone & F.col("top")[is_gold]).cast("double"))
    chance = F.when(fires, 1.0 / F.col("n"))
    return questions.agg(
        F.count("*").alias("n_questions"),
        F.count_if(fires).alias("n_fires"),
        F.round(F.avg(right), 6).alias("accuracy"),
        F.round(F.avg(chance), 6).alias("chance"),
        F.round(F.avg(right) - F.avg(chance), 6).alias("lift"),
    )


def cue_balanced(rows: DataFrame, group: Column, words: str, cues: list[str]) -> DataFrame:
    """Groups of several rows that all hold the same of the cue words."""
    held = F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, cues)))), " ")
    per = rows.groupBy(group.alias("group_id")).agg(F.count("*").alias("n"), F.countDistinct(held).alias("k"), F.min(held).alias("cues"))
    return per.where("n >= 2 and k = 1").select("group_id", "n", "cues")


def option_vocabulary(labels: DataFrame, task: str, label: str, min_count: int, min_coverage: float = 0.8) -> DataFrame:
    """Recurring labels of each task, for tasks where they cover enough of all uses. (task, labels, coverage)"""
    per = labels.groupBy(task, label).agg(F.count("*").alias("n"))
    often = F.col("n") >= min_count
    kept = F.array_sort(F.collect_list(F.when(often, F.col(label))))
    share = F.sum(F.when(often, F.col("n")).otherwise(0)) / F.sum("n")
    tasks = per.groupBy(task).agg(F.array_join(kept, ",").alias("labels"), share.alias("coverage"))
    return tasks.where(F.col("coverage") >= min_coverage).withColumn("coverage", F.round("coverage", 6))


def smoke_gate(new: DataFrame, base: DataFrame, task: str, right: Column, tolerance: float = 0.02) -> DataFrame:
    """Is the mean accuracy over the tasks of both no more than the tolerance behind? One row."""
    per = lambda df, name: df.groupBy(task).agg(F.avg(right.cast("double")).alias(name))
    both = per(new, "new").join(per(base, "base"), task)
    means = both.agg(F.count("*").alias("n_tasks"), F.avg("new").alias("new"), F.avg("base").alias("base"))
    passed = F.col("new") >= F.col("base") - tolerance
    return means.select("n_tasks", F.round("new", 6).alias("new"), F.round("base", 6).alias("base"), passed.alias("passed"))
