"""Queries of the catalogue on records of other systems and on audits of questions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import stable_hash, unit_draw, words
from millrace.operators import judged
from millrace.operators.metrics import NULL
from millrace.plans.catalogue import _h, _rec, _records, _u, query

OUTCOMES = ["good", "bad", NULL]
SAID = ["good", "bad", NULL, "neither"]
CUES = ["and", "in", "is", "of", "the", "to"]
_CHOSEN = f"CASE WHEN said IN ('good', 'bad') THEN said ELSE '{NULL}' END"
_TELLING = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({judged.STOP}, w)))"


@query(f"""SELECT doc_id, {', '.join(f"round(CASE WHEN chosen = '{o}' THEN sure ELSE (1 - sure) / 2 END, 6) AS {n}" for o, n in zip(OUTCOMES, ('p_good', 'p_bad', 'p_null')))},
  chosen AS decision, round(sure, 6) AS confidence FROM (SELECT doc_id, {_CHOSEN} AS chosen, least(1, greatest(0, sure * 1.4e0 - 0.2e0)) AS sure FROM (
    SELECT doc_id, {SAID}[({_h("'said'", 'doc_id')} % 4)::INT + 1] AS said, {_u("'sure'", 'doc_id')} AS sure FROM documents) a) b""")
def verbalised_records(t):
    said = F.element_at(F.array(*map(F.lit, SAID)), (stable_hash("said", F.col("doc_id")) % 4 + 1).cast("int"))
    rows = t("documents").select("doc_id", said.alias("said"), (unit_draw("sure", F.col("doc_id")) * 1.4 - 0.2).alias("sure"))
    p = judged.verbalised(F.col("said"), F.col("sure"), OUTCOMES)
    shares = [F.round(p[o], 6).alias(n) for o, n in zip(OUTCOMES, ("p_good", "p_bad", "p_null"))]
    return rows.select("doc_id", *shares, p["decision"].alias("decision"), F.round(p["confidence"], 6).alias("confidence"))


@query(f"""SELECT doc_id, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round(1 - best, 6) AS p_null, CASE WHEN 1 - best >= 0.5e0 THEN '{NULL}' WHEN a = best THEN 'a' ELSE 'b' END AS decision,
  round(CASE WHEN 1 - best >= 0.5e0 THEN 1 - best WHEN a = best THEN pa ELSE pb END, 6) AS confidence FROM (SELECT *, CASE WHEN a + b = 0 THEN 0 ELSE best * a / (a + b) END AS pa,
    CASE WHEN a + b = 0 THEN 0 ELSE best * b / (a + b) END AS pb FROM (SELECT *, greatest(a, b) AS best FROM (SELECT doc_id, {_u("'za'", 'doc_id')} AS a, {_u("'zb'", 'doc_id')} AS b FROM documents) x) y) z""")
def zero_shot_records(t):
    rows = t("documents").select("doc_id", unit_draw("za", F.col("doc_id")).alias("a"), unit_draw("zb", F.col("doc_id")).alias("b"))
    p = judged.zero_shot({"a": F.col("a"), "b": F.col("b")})
    shares = [F.round(p[k], 6).alias(n) for k, n in (("a", "p_a"), ("b", "p_b"), (NULL, "p_null"))]
    return rows.select("doc_id", *shares, p["decision"].alias("decision"), F.round(p["confidence"], 6).alias("confidence"))


_OPTIONS = f"""turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_TELLING.format('text')} AS w FROM conversations),
  options AS (SELECT s.conv_id, o.n, o.n = 2 AS is_gold, len(list_intersect(o.w, s.w))::DOUBLE / greatest(1, len(o.w)) AS share
    FROM turns s JOIN turns o ON s.conv_id = o.conv_id WHERE s.n = 1 AND o.n BETWEEN 2 AND 4)"""


def _options(t):
    """First turns as states, the next three turns as options; the second turn is gold."""
    spot = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    turns = t("conversations").select("conv_id", spot.alias("n"), judged.telling_words(F.col("text")).alias("w"))
    states = turns.where("n = 1").select("conv_id", F.col("w").alias("state"))
    share = judged.overlap(F.col("w"), F.col("state"))
    return turns.where("n between 2 and 4").join(states, "conv_id").select("conv_id", "n", (F.col("n") == 2).alias("is_gold"), share.alias("share"))


@query(f"""WITH {_OPTIONS}, q AS (SELECT conv_id, count(*) AS n, max(share) AS best FROM options GROUP BY 1 HAVING count(*) >= 2),
  r AS (SELECT q.conv_id, q.n, q.best, count(*) FILTER (share = best) AS tops, bool_or(share = best AND is_gold) AS gold_top FROM q JOIN options USING (conv_id) GROUP BY ALL),
  s AS (SELECT best > 0 AS fires, CASE WHEN best > 0 THEN (tops = 1 AND gold_top)::INT::DOUBLE END AS ok, CASE WHEN best > 0 THEN 1e0 / n END AS chance FROM r)
  SELECT count(*) AS n_questions, count(*) FILTER (fires) AS n_fires, round(avg(ok), 6) AS accuracy, round(avg(chance), 6) AS chance, round(avg(ok) - avg(chance), 6) AS lift FROM s""")
def overlap_rule(t):
    return judged.overlap_rule(_options(t), "conv_id", "share", "is_gold")


@query(f"WITH {_OPTIONS} SELECT conv_id, n, round(share, 6) AS share FROM options WHERE NOT is_gold AND share >= 0.6e0")
def trap_options(t):
    return _options(t).where("not is_gold and share >= 0.6").select("conv_id", F.col("n").cast("long").alias("n"), F.round("share", 6).alias("share"))


@query(rf"""SELECT g AS group_id, count(*) AS n, min(c) AS cues FROM (SELECT doc_id // 2 AS g, array_to_string(list_filter({CUES}, lambda x: list_contains(w, x)), ' ') AS c
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents) a) b GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT c) = 1""")
def cue_balanced_groups(t):
    rows = t("documents").select("doc_id", words(F.col("text")).alias("w"))
    return judged.cue_balanced(rows, F.floor(F.col("doc_id") / 2), "w", CUES)


@query("""SELECT source, string_agg(lang, ',' ORDER BY lang) FILTER (n >= 5) AS labels, round(coalesce(sum(n) FILTER (n >= 5), 0)::DOUBLE / sum(n), 6) AS coverage
  FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) t GROUP BY 1 HAVING coalesce(sum(n) FILTER (n >= 5), 0)::DOUBLE / sum(n) >= 0.8e0""")
def option_vocabulary(t):
    return judged.option_vocabulary(t("documents"), "source", "lang", 5)


def _accuracy(system):
    return f"(SELECT lang, avg((decision = gold)::INT::DOUBLE) AS acc FROM {_records(system)} r GROUP BY 1)"


@query(f"""SELECT count(*) AS n_tasks, round(avg(n.acc), 6) AS new, round(avg(b.acc), 6) AS base, avg(n.acc) >= avg(b.acc) - 0.02e0 AS passed
  FROM {_accuracy('b')} n JOIN {_accuracy('a')} b USING (lang)""")
def smoke_gate(t):
    return judged.smoke_gate(_rec(t, "b"), _rec(t), "lang", F.col("decision") == F.col("gold"))
