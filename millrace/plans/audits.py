"""Queries of the catalogue on audits, bake-offs, score questions, text forms and composites."""

from pyspark.sql import functions as F

from millrace.functions.text import SPACED, cleaned_name, hash_split, normalised, plain_words, unit_draw
from millrace.operators import audits, build, jobs, near_index, questions
from millrace.operators.metrics import NULL
from millrace.plans.catalogue import _KEY, _LOG, _SLICED, _SPLIT, _h, _rec, _records, _u, normalised_sql, query
from millrace.sources import converters

FORMATS = ["x", "y"]
UNKNOWN_SQL = audits.UNKNOWN.replace("'", "''")
SPACED_SQL = f"'{SPACED}'"


@query(f"""SELECT doc_id, md5({normalised_sql('text')}) AS normal, md5(trim(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))) AS plain,
  substr(trim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '.'), 1, 120) AS name FROM documents""")
def text_forms(t):
    """Texts for quotes (normal), for comparing words (plain), and as names."""
    text = F.col("text")
    return t("documents").select("doc_id", F.md5(normalised(text).cast("binary")).alias("normal"), F.md5(plain_words(text).cast("binary")).alias("plain"), cleaned_name(text).alias("name"))


@query(f"""WITH {_SLICED}, f AS (SELECT *, greatest(p_good, p_bad) / coalesce(nullif(p_good + p_bad, 0), 1) AS c FROM sliced WHERE gold <> '{NULL}'),
  b AS (SELECT *, ntile(15) OVER (PARTITION BY slice ORDER BY c, doc_id) AS bin FROM f)
  SELECT slice, round(sum(n * gap) / sum(n), 6) AS forced_ece FROM (SELECT slice, bin, count(*) AS n, abs(avg(c) - avg((forced = gold)::INT::DOUBLE)) AS gap FROM b GROUP BY 1, 2) x GROUP BY 1""")
def metric_forced_ece(t):
    return audits.forced_ece(_rec(t))


@query(f"""SELECT count(*) AS n, round(avg(CASE WHEN gold = '{NULL}' THEN -ln(greatest(p_null, 1e-12)) ELSE -ln(greatest(1 - p_null, 1e-12)) END), 6) AS null_bce,
  round(avg(-ln(greatest(CASE WHEN gold = 'good' THEN p_good ELSE p_bad END / greatest(1 - p_null, 1e-12), 1e-12))) FILTER (gold <> '{NULL}'), 6) AS choice_ce,
  round(avg(((p_null >= 0.5e0) = (gold = '{NULL}'))::INT::DOUBLE), 6) AS null_accuracy, round(avg((forced = gold)::INT::DOUBLE) FILTER (gold <> '{NULL}'), 6) AS choice_accuracy FROM {_records('a')} r""")
def loss_statistics(t):
    return audits.loss_statistics(_rec(t))


_SCORED = f"""(SELECT lang, CASE WHEN {_u("'gn'", 'doc_id')} >= 0.1e0 THEN {_u("'g'", 'doc_id')} END AS gold_unit, CASE WHEN {_u("'pn'", 'doc_id')} >= 0.2e0 THEN {_u("'p'", 'doc_id')} END AS pred_unit,
  {_u("'p'", 'doc_id')} - 0.3e0 AS low, {_u("'p'", 'doc_id')} + 0.3e0 AS high FROM documents)"""


@query(f"""SELECT lang, count(*) AS n, round(avg((pred_unit IS NOT NULL)::INT::DOUBLE), 6) AS answered, round(avg(abs(gold_unit - pred_unit)), 6) AS mae,
  round(avg((low <= y AND y <= high)::INT::DOUBLE), 6) AS coverage FROM (SELECT *, (gold_unit * 99 + 0.5e0) / 100 AS y FROM {_SCORED} s WHERE gold_unit IS NOT NULL) z GROUP BY 1""")
def score_metrics(t):
    """Stand-in scores: gold values, predictions and intervals drawn by hash."""
    u = lambda s: unit_draw(s, F.col("doc_id"))
    drawn = t("documents").select("lang", *[u(s).alias(s) for s in ("gn", "g", "pn", "p")])
    rows = drawn.select(
        "lang", F.when(F.col("gn") >= 0.1, F.col("g")).alias("gold_unit"), F.when(F.col("pn") >= 0.2, F.col("p")).alias("pred_unit"), (F.col("p") - 0.3).alias("low"), (F.col("p") + 0.3).alias("high")
    )
    return audits.score_summary(rows, "lang")


VARIANTS = {"orig": "a", "without:text": "b", "swap": "c"}


@query(f"""WITH v AS ({' UNION ALL '.join(f"SELECT doc_id, lang, '{v}' AS variant, forced AS top FROM {_records(s)} r" for v, s in VARIANTS.items())}),
  c AS (SELECT v.lang, v.variant, count(*) AS n, avg((v.top <> CASE WHEN v.variant <> 'swap' THEN o.top WHEN o.top = 'good' THEN 'bad' ELSE 'good' END)::INT::DOUBLE) AS changed
    FROM v JOIN v o USING (doc_id) WHERE o.variant = 'orig' AND v.variant <> 'orig' GROUP BY 1, 2)
  SELECT lang, variant, n, CASE WHEN variant LIKE 'without:%' THEN CASE WHEN changed < 0.2e0 THEN 'barely_reads' ELSE 'fine' END
    WHEN changed > 0.2e0 THEN 'moves' WHEN changed > 0.1e0 THEN 'moves_some' ELSE 'fine' END AS flag, round(changed, 6) AS changed FROM c""")
def audit_change_rates(t):
    """Answers of three systems stand for answers to an example and to its variants."""
    rows = [_rec(t, s).select("doc_id", "lang", F.lit(v).alias("variant"), F.col("forced").alias("top")) for v, s in VARIANTS.items()]
    return audits.change_rates(rows[0].unionAll(rows[1]).unionAll(rows[2]), ["doc_id"], "lang", {"good": "bad", "bad": "good"}).select("lang", "variant", "n", "flag", "changed")


@query(f"""SELECT lang, count(*) AS n, round(avg((decision = gold)::INT::DOUBLE), 6) AS accuracy, count(*) FILTER (decision <> gold) AS mistakes,
  round(avg((confidence >= 0.9e0)::INT::DOUBLE) FILTER (decision <> gold), 6) AS sure FROM {_records('a')} r GROUP BY 1""")
def sure_mistakes(t):
    return audits.sure_mistakes(_rec(t).withColumn("top", F.col("decision")), "lang")


_JUDGED = " UNION ALL ".join(f"SELECT '{s}' AS model, gold = 'good' AS ok, forced = 'bad' AS f, p_null AS s FROM {_records(s)} r WHERE gold <> '{NULL}'" for s in "ab")


def _judged(t):
    each = [_rec(t, s).where(F.col("gold") != NULL).select(F.lit(s).alias("model"), "gold", "forced", "p_null") for s in "ab"]
    return each[0].unionAll(each[1])


@query(f"""SELECT model, count(*) AS n, count(*) FILTER (NOT ok) AS n_bad, count(*) FILTER (ok) AS n_good, count(*) FILTER (NOT ok AND f) AS caught, count(*) FILTER (ok AND f) AS false_flags,
  round(avg(ok::INT::DOUBLE), 6) AS precision_before, coalesce(round(avg(ok::INT::DOUBLE) FILTER (NOT f), 6), 0) AS precision_after, round(avg((NOT f)::INT::DOUBLE), 6) AS kept_share FROM ({_JUDGED}) j GROUP BY 1""")
def critic_bakeoff(t):
    return audits.critic_bakeoff(_judged(t), "model", F.col("gold") == "good", F.col("forced") == "bad")


@query(f"""SELECT model, coalesce(round(avg((NOT f)::INT::DOUBLE) FILTER (ok), 6), 0) AS keeps_good, coalesce(round(avg(f::INT::DOUBLE) FILTER (NOT ok), 6), 0) AS rejects_bad,
  round(avg(s), 6) AS sec_per_example FROM ({_JUDGED}) j GROUP BY 1""")
def verifier_bakeoff(t):
    return audits.verifier_bakeoff(_judged(t), "model", F.col("gold") == "good", F.col("forced") == "good", F.col("p_null"))


@query(f"""SELECT lang, source, count(*) AS asked, count(*) FILTER (a.decision <> b.decision) AS disputed, round((count(*) FILTER (a.decision <> b.decision))::DOUBLE / count(*), 6) AS rate
  FROM {_records('a')} a JOIN (SELECT doc_id, decision FROM {_records('b')} x) b USING (doc_id) GROUP BY 1, 2""")
def disagreement_rates(t):
    both = _rec(t).join(_rec(t, "b").select("doc_id", F.col("decision").alias("other")), "doc_id")
    return audits.disagreement(both, ["lang", "source"], F.col("decision") != F.col("other"))


@query(f"SELECT conv_id, turn, regexp_matches(trim(translate(text, '_', ' ')), '{UNKNOWN_SQL}') AS unknown FROM conversations")
def unknown_options(t):
    return t("conversations").select("conv_id", "turn", audits.unknown_option(F.col("text")).alias("unknown"))


@query(f"""SELECT 'text' AS kind, count(*) AS n, count(*) FILTER (len(regexp_extract_all(text, {SPACED_SQL})) < 15) AS bad FROM documents
  UNION ALL SELECT 'json', count(*), count(*) FILTER (coalesce(len(json_keys(props)), 0) = 0) FROM events""")
def state_shapes(t):
    count = lambda df, c, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.count_if(audits.state_shape(F.col(c), k).isNotNull()).alias("bad"))
    return count(t("documents"), "text", "text").unionAll(count(t("events"), "props", "json"))


_TWINS = f"(SELECT doc_id // 2 AS pair, count(*) AS n, max({_u(repr('ts'), 'doc_id')}) - min({_u(repr('ts'), 'doc_id')}) AS d FROM documents GROUP BY 1)"


@query(f"SELECT pair, round(d, 6) >= 0.3e0 AS moved FROM {_TWINS} t WHERE n = 2")
def twins_moved(t):
    rows = t("documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.round(unit_draw("ts", F.col("doc_id")), 6).alias("s"))
    both = rows.groupBy("pair").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).where("n = 2")
    return both.select("pair", audits.moved(F.array(F.round("a", 6)), F.array(F.round("b", 6)), 0, 1, 0.3 - 1e-9).alias("moved"))


_DOMAIN = "CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END"


@query(f"""WITH k AS (SELECT lang AS sector, lower({_DOMAIN}) AS d, min({_DOMAIN}) AS domain, count(DISTINCT lower('t' || (n_chars % 3))) AS n_types FROM documents
  WHERE {FORMATS!r}[(n_chars % 3 + 1)::INT] IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY sector) AS n FROM k WHERE n_types >= 2)
  SELECT sector, domain, n_types FROM r WHERE n = 1""")
def taxonomy(t):
    """Languages stand for sectors, sources for domains; a third of the types has no known format."""
    domain = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    kind = F.col("n_chars") % 3
    rows = t("documents").select(F.col("lang").alias("sector"), domain.alias("domain"), F.concat(F.lit("t"), kind).alias("doc_type"), F.try_element_at(F.array(*map(F.lit, FORMATS)), (kind + 1).cast("int")).alias("format"))
    return audits.taxonomy(rows, FORMATS)


@query("SELECT labels, count(*) AS n FROM (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS labels FROM conversations GROUP BY 1) s GROUP BY 1 HAVING count(*) >= 3")
def option_sets(t):
    return audits.option_sets(t("conversations"), ["conv_id"], "role", 3)


@query(f"""SELECT lang, round(acc, 6) AS acc, CASE WHEN acc >= 0.5e0 THEN 'reached' WHEN acc < 0.4e0 THEN 'broken' ELSE 'between' END AS verdict FROM (
  SELECT lang, avg(acc) AS acc FROM ({' UNION ALL '.join(f"SELECT lang, avg((decision = gold)::INT::DOUBLE) AS acc FROM {_records(x)} r GROUP BY 1" for x in 'abc')}) s GROUP BY 1) m""")
def verdict_lines(t):
    """The mean over three runs of each task against its target and guard lines."""
    right = (F.col("decision") == F.col("gold")).cast("double")
    runs = [_rec(t, x).groupBy("lang").agg(F.avg(right).alias("acc")) for x in "abc"]
    means = runs[0].unionAll(runs[1]).unionAll(runs[2]).groupBy("lang").agg(F.avg("acc").alias("acc"))
    return audits.verdicts(means, "acc", 0.5, 0.4).withColumn("acc", F.round("acc", 6))


@query(f"""SELECT doc_id, decision FROM {_records('a')} r WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_h("'di'", 'doc_id')}, doc_id) AS n FROM documents) s WHERE n <= 50)""")
def sampled_results(t):
    """Results of a system for a sample of 50 examples a language."""
    sample = build.hash_sample(t("documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), "di", 50)
    return _rec(t).select("doc_id", "decision").join(sample, "doc_id", "left_semi")


@query(f"""SELECT lang, round(acc - coalesce(c.chance, 0), 6) AS above FROM (SELECT lang, avg((decision = gold)::INT::DOUBLE) AS acc FROM {_records('a')} r GROUP BY 1) a
  LEFT JOIN (VALUES ('en', 0.5e0), ('de', 0.25e0)) c(lang, chance) USING (lang)""")
def above_chance(t):
    """Scores over their task's chance level; a task without one has none."""
    records = _rec(t)
    chance = records.sparkSession.createDataFrame([("en", 0.5), ("de", 0.25)], "lang string, chance double")  # a fixed list
    scores = records.groupBy("lang").agg(F.avg((F.col("decision") == F.col("gold")).cast("double")).alias("acc"))
    return scores.join(F.broadcast(chance), "lang", "left").select("lang", F.round(F.col("acc") - F.coalesce("chance", F.lit(0.0)), 6).alias("above"))


_PAIR = "CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR END"


@query(f"SELECT conv_id, turn, {_SPLIT.replace(', text)', f', coalesce({_PAIR}, text))')} AS split FROM conversations")
def pair_splits(t):
    """A twin falls to its pair's split, whatever its own text."""
    pair = F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string"))
    return t("conversations").select("conv_id", "turn", hash_split(F.coalesce(pair, F.col("text"))).alias("split"))


@query("""SELECT user_id, round(epoch(max(ts) - min(ts)) / 3600, 6) AS hours, round(epoch(max(ts) - min(ts)) / 3600 * avg(value) / 1000, 6) AS kwh FROM events GROUP BY 1""")
def run_energy(t):
    """Wall hours of each run times its mean power."""
    return jobs.run_energy(t("events"), "user_id", "ts", "value")


@query(f"""SELECT role, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(tokens), 4) AS tokens FROM {_LOG} l GROUP BY GROUPING SETS ((role), (2), ())""")
def cost_sets(t):
    """Jobs and tokens by role, by day and in all, in one pass."""
    return jobs.cost_sets(jobs.job_log(t("events")))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS age, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'review'
  WHEN date_diff('day', o_orderdate::DATE, DATE '1998-12-31') > 365 THEN 'refuse' WHEN o_orderstatus = 'O' THEN 'refund' ELSE 'ask' END AS action FROM orders""")
def order_actions(t):
    """A decision table over dates and fields: the first rule that holds."""
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    rules = [((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), "review"), (age > 365, "refuse"), (F.col("o_orderstatus") == "O", "refund")]
    return t("orders").select("o_orderkey", age.cast("long").alias("age"), audits.first_rule(rules, "ask").alias("action"))


@query("SELECT source, array_to_string(list_sort(list_distinct(flatten(list([lang, 'len:' || (n_chars % 3)])))), ',') AS tags FROM documents GROUP BY 1")
def tag_union(t):
    tags = F.array(F.col("lang"), F.concat(F.lit("len:"), F.col("n_chars") % 3))
    return t("documents").select("source", F.explode(tags).alias("x")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("tags"))


_EVAL = f"""SELECT source, lang, quality FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_h("'eval'", 'doc_id')}, doc_id) AS n FROM (
  SELECT d.doc_id, source, lang, quality FROM (SELECT *, {_KEY} AS k, {_SPLIT} AS split FROM documents) d LEFT JOIN labels USING (doc_id)
  WHERE split = 'test' AND len(regexp_extract_all(text, {SPACED_SQL})) <= 2048 AND k NOT IN (SELECT {_KEY} FROM documents WHERE {_SPLIT} = 'train')) x) y WHERE n <= 40"""


@query(f"""SELECT slice, count(*) AS n FROM (SELECT unnest(list_concat(['source:' || source, 'lang:' || lang], CASE WHEN quality IS NULL THEN ['null:unlabelled'] ELSE [] END)) AS slice FROM ({_EVAL}) e) s GROUP BY 1""")
def frozen_eval_stats(t):
    """A frozen test set's sidecar: test rows whose state no training row has, within the length budget, 40 a source; counts by slice."""
    docs = t("documents").withColumn("split", hash_split(F.col("text")))
    test = docs.where("split = 'test'").where(F.regexp_count("text", F.lit(SPACED)) <= 2048)
    test = build.without_states_of(test, docs.where("split = 'train'")).join(t("labels"), "doc_id", "left")
    chosen = build.hash_sample(test.select("doc_id", "source", "lang", "quality"), ["source"], F.col("doc_id"), "eval", 40)
    null = F.when(F.col("quality").isNull(), F.array(F.lit("null:unlabelled"))).otherwise(F.array().cast("array<string>"))
    slices = F.concat(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")), null)
    return chosen.select(F.explode(slices).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id::VARCHAR AS key, quality::DOUBLE AS insult_or_threat, tox AS toxicity FROM (SELECT doc_id, quality, toxic::DOUBLE AS tox, length(text) AS n, {_h("'civil'", 'doc_id')} AS h
  FROM documents JOIN labels USING (doc_id)) x WHERE n <= 3000 AND (tox >= 0.3e0 OR h % 10 = 0)""")
def converted_scores(t):
    """The converter of toxicity scores over documents and their labels, valid examples only."""
    rows = t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").cast("string").alias("key"), "text", F.col("toxic").cast("double").alias("toxicity"), *[F.col("quality").cast("double").alias(c) for c in ("insult", "threat")])
    made = questions.validated(converters.civil_comments(rows, ["insult", "threat"]).where(F.length("state") > 0)).where("reject_reason is null")
    flat = questions.flat_answers(made)
    second = F.max(F.when(F.col("qid") != "toxicity", F.col("value")))
    return flat.groupBy("key").agg(second.alias("insult_or_threat"), F.max(F.when(F.col("qid") == "toxicity", F.col("value"))).alias("toxicity"))


@query()
def near_train_copies(t):
    """Validation and test documents that are near to a training document, by the MinHash index: key, found, similarity."""
    docs = t("documents").withColumn("split", hash_split(F.col("text")))
    # the split is chosen before signatures are made, so each text's is made for its own side only
    train, others = (near_index.signatures(docs.where(side), "doc_id", "text") for side in ("split = 'train'", "split <> 'train'"))
    return near_index.nearest(others, near_index.build_index(train))
