"""Queries by name over the tables of a folder, each with a SQL statement that gives the same rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import ELLIPSIS, SPACE, SPACED, TYPOGRAPHY, hash_split, stable_hash, unit_draw, words
from millrace.operators import build, jobs, metrics

QUERIES, SQL = {}, {}
#: Thresholds of the null answer, and of the confidence from which a cascade does not ask on.
THRESHOLDS = [round(0.05 * k, 2) for k in range(6, 20)]
CASCADE = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.01]
PRICES = [("click", 0.5), ("view", 0.1), ("purchase", 2.0), ("error", 1.0)]


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _h(*parts):
    inner = ", ".join(p if p.startswith("=") is False else p[1:] for p in parts)
    return f"('0x' || substr(sha1(concat_ws(chr(31), {inner})), 1, 16))::UBIGINT"


def _u(*parts):
    return f"({_h(*parts)} % 10000)::DOUBLE / 10000"


def normalised_sql(text):
    marks = "".join(TYPOGRAPHY.values())
    plain = "".join(k * len(v) for k, v in TYPOGRAPHY.items()).replace("'", "''")
    spaced = f"""regexp_replace(replace(translate({text}, '{marks}', '{plain}'), '{ELLIPSIS}', '...'), '[{{}}\\[\\]":,]', ' ', 'g')"""
    return f"replace(replace(lower(trim(regexp_replace({spaced}, '[{SPACE}]+', ' ', 'g'), '{SPACE}')), 'ß', 'ss'), 'ς', 'σ')"


_SPLIT = f"CASE WHEN {_u(repr('split'), 'text')} < 0.05 THEN 'test' WHEN {_u(repr('split'), 'text')} < 0.08 THEN 'val' ELSE 'train' END"
_KEY = f"replace(replace(lower(trim(text, '{SPACE}')), 'ß', 'ss'), 'ς', 'σ')"
_CLEAN = rf"""(len(ls) > 0 AND length(j) - length(regexp_replace(j, '\p{{L}}', '', 'g')) > length(j) * 0.72
  AND len(list_filter(ls, lambda x: len(regexp_extract_all(x, '{SPACED}')) < 4)) < len(ls) * 0.4 AND len(regexp_extract_all(j, 'http')) < 2
  AND NOT contains(j, '|') AND len(regexp_extract_all(j, '{SPACED}')) >= len(ls) * 12.0)"""
_REASONS = f"""base AS (SELECT *, {_CLEAN} AS clean FROM (SELECT *, array_to_string(ls, ' ') AS j FROM (SELECT doc_id, source, text, {_SPLIT} AS split, sha1({_KEY}) AS k,
    list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '[ \t]+', ' ', 'g'), '{SPACE}')), lambda x: length(x) > 0) AS ls FROM documents) s) t),
  ranked AS (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS r FROM base),
  marked AS (SELECT *, min(r) OVER (PARTITION BY k) AS f, row_number() OVER (PARTITION BY k, split ORDER BY doc_id) AS n FROM ranked),
  reasons AS (SELECT doc_id, source, split, CASE WHEN f < r THEN 'leak' WHEN n > 1 THEN 'duplicate' WHEN NOT clean THEN 'not_prose' END AS reason FROM marked)"""


def _records(system):
    return f"""(SELECT *, CASE WHEN decision = '__NULL__' THEN p_null ELSE greatest(p_good, p_bad) END AS confidence FROM (
      SELECT *, CASE WHEN p_null >= 0.5e0 THEN '__NULL__' ELSE forced END AS decision FROM (
      SELECT *, CASE WHEN p_good >= p_bad THEN 'good' ELSE 'bad' END AS forced FROM (
      SELECT doc_id, source, lang, CASE WHEN toxic = 1 THEN '__NULL__' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold,
        u1 * 0.6e0 AS p_null, (1 - u1 * 0.6e0) * u2 AS p_good, (1 - u1 * 0.6e0) * (1 - u2) AS p_bad FROM (
      SELECT d.doc_id, source, lang, quality, toxic, {_u(repr(system), "'1'", 'd.doc_id')} AS u1, {_u(repr(system), "'2'", 'd.doc_id')} AS u2,
        {_u(repr(system), "'9'", 'd.doc_id')} AS u9 FROM documents d JOIN labels USING (doc_id)) a WHERE u9 >= 0.1e0) b) c) e)"""


_SLICED = f"""rec AS {_records('a')}, sliced AS (SELECT *, unnest(list_concat(['overall', 'eval:' || lang, 'source:' || source],
    CASE WHEN gold = '__NULL__' THEN ['null:toxic'] ELSE [] END)) AS slice FROM rec)"""


def _rec(t, system="a"):
    return metrics.build_records(t("documents"), t("labels"), system)


@query(f"WITH {_REASONS} SELECT source, split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY ALL")
def build_manifest(t):
    return build.manifest(t("documents"))


@query(f"WITH {_REASONS} SELECT * FROM reasons")
def reject_reasons(t):
    return build.reject_reasons(t("documents"))


@query(f"SELECT {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL")
def hash_split_counts(t):
    return t("documents").groupBy(hash_split(F.col("text")).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) t WHERE n = 1")
def exact_dedupe(t):
    return build.first_per_key(t("documents").select("doc_id", F.sha2("text", 256).alias("k")), ["k"], "doc_id").select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, {_SPLIT} AS split, {_KEY} AS k FROM documents)
  SELECT doc_id FROM d WHERE split = 'train' AND k NOT IN (SELECT k FROM d WHERE split <> 'train')""")
def leak_anti_join(t):
    """Training documents whose state is in no other split."""
    docs = t("documents").withColumn("split", hash_split(F.col("text")))
    return build.without_states_of(docs.where("split = 'train'"), docs.where("split <> 'train'")).select("doc_id")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h(repr('s'), 'doc_id')}, doc_id) AS n FROM documents) t WHERE n <= 20")
def hash_ordered_sample(t):
    return build.hash_sample(t("documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), "s", 20)


@query(f"""SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h(repr('rr'), 'doc_id')}, doc_id) AS turn
    FROM documents) t ORDER BY turn, lang LIMIT 50""")
def round_robin_balance(t):
    return build.round_robin(t("documents").select("doc_id", "lang"), "lang", F.col("doc_id"), "rr", 50).withColumn("turn", F.col("turn").cast("long"))


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, quality, count(*) OVER w AS size, row_number() OVER (w ORDER BY {_h(repr('q'), 'doc_id')}, doc_id) AS n
    FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source, quality)) t WHERE quality = 0 OR n <= round_even(size * 0.3e0, 0)""")
def stratified_quota(t):
    rows = t("documents").join(t("labels"), "doc_id").select("doc_id", "source", "quality")
    return build.quota(rows, ["source"], F.col("quality") == 0, F.col("doc_id"), "q", 0.3).select("doc_id", "source")


@query(f"""SELECT doc_id FROM (SELECT doc_id, ln(greatest({_u(repr('w'), 'doc_id')}, 1e-12)) / n_chars AS k FROM documents) t ORDER BY k DESC, doc_id LIMIT 40""")
def weighted_sample(t):
    u = unit_draw("w", F.col("doc_id"))
    return build.weighted_sample(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), u, F.col("doc_id"), 40).select("doc_id")


@query("""SELECT source, n, CAST(least(n, greatest(0, 170 - before)) AS BIGINT) AS taken FROM (SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) g) t WHERE least(n, greatest(0, 170 - before)) > 0""")
def group_budget_fill(t):
    return build.fill_budget(t("documents").groupBy("source").agg(F.count("*").alias("n")), ["source"], "n", 170)


@query("SELECT lang, round(pow(n, 0.3e0) / sum(pow(n, 0.3e0)) OVER (), 6) AS p FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) t")
def temperature_mixture(t):
    sizes = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    return build.temperature_weights(sizes, "n").select("lang", F.round("p", 6).alias("p"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_values(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) t WHERE n <= 5""")
def cap_per_group(t):
    spot = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t("documents").select("source", "doc_id", spot.alias("n")).where("n <= 5").drop("n")


@query("""SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def benchmark_leaks(t):
    """Items and documents meet on the item's first eight words, then the whole item is looked for."""
    key = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, 8), " "))
    cut = lambda x: F.split(x, r"\s+")
    items = t("benchmark").select("item_id", F.col("text").alias("item"), cut(F.col("text")).alias("w"))
    items = items.select("item_id", "item", F.size("w").alias("n"), key(F.col("w"), F.lit(2)).alias("k"))
    docs = t("documents").select("doc_id", "text", F.explode(F.array(cut(F.col("text")))).alias("w")).where(F.size("w") >= 9)
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: key(F.col("w"), i)))).alias("k"))
    near = grams.join(items.where("n >= 10"), "k").select("doc_id", "item_id", "item")
    near = near.unionByName(t("documents").crossJoin(F.broadcast(items.where("n < 10"))).select("doc_id", "item_id", "item"))
    hits = near.join(t("documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "item"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_SETS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w)"""


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
  f AS (SELECT min(doc_id) AS doc_id, s, len(s) AS n FROM s GROUP BY s), e AS (SELECT doc_id, n, unnest(s) AS k FROM f),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL)
  SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS jaccard FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8""")
def near_duplicate_pairs(t):
    return build.jaccard_pairs(t("documents"))


@query()
def near_duplicate_greedy(t):
    prints = build.shingle_prints(t("documents"))
    return build.greedy_near(prints, build.jaccard_pairs(t("documents"), prints))


@query(rf"""WITH {_SETS}, c AS (SELECT s, min(doc_id) AS representative, count(*) AS n_members FROM s WHERE s IS NOT NULL GROUP BY s),
  e AS (SELECT representative, len(s) AS n, unnest(s) AS k FROM c),
  p AS (SELECT a.representative AS a, b.representative AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.representative < b.representative GROUP BY ALL),
  q AS (SELECT unnest([a, b]) AS representative FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8), l AS (SELECT representative, count(*) AS n FROM q GROUP BY 1)
  SELECT doc_id, coalesce(representative, doc_id) AS representative, coalesce(n_members, 1) AS n_members, coalesce(l.n, 0) AS n_links
  FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN l USING (representative)""")
def near_duplicate_members(t):
    prints = build.shingle_prints(t("documents"))
    return build.near_members(prints, build.jaccard_pairs(t("documents"), prints))


@query(f"SELECT doc_id, gold, forced, decision, round(confidence, 6) AS confidence FROM {_records('a')} r")
def prediction_records(t):
    return _rec(t).select("doc_id", "gold", "forced", "decision", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_SLICED}, g AS (SELECT *, CASE gold WHEN '__NULL__' THEN p_null WHEN 'good' THEN p_good ELSE p_bad END AS gp FROM sliced)
  SELECT slice, count(*) AS n, round(avg((decision = gold)::INT::DOUBLE), 6) AS accuracy,
    round(avg((decision = gold)::INT::DOUBLE) FILTER (gold <> '__NULL__'), 6) AS answerable_accuracy,
    round(avg((forced = gold)::INT::DOUBLE) FILTER (gold <> '__NULL__'), 6) AS forced_accuracy,
    round(avg(p_null * p_null + p_good * p_good + p_bad * p_bad - 2 * gp + 1), 6) AS brier, round(avg(-ln(greatest(gp, 1e-12))), 6) AS nll,
    round(avg((gold = '__NULL__')::INT::DOUBLE) FILTER (decision = '__NULL__'), 6) AS abstain_precision,
    round(avg((decision = '__NULL__')::INT::DOUBLE) FILTER (gold = '__NULL__'), 6) AS abstain_recall,
    round(avg((decision = '__NULL__')::INT::DOUBLE), 6) AS abstain_rate FROM g GROUP BY slice""")
def metric_summary(t):
    return metrics.summary(_rec(t))


@query(f"""WITH {_SLICED}, c AS (SELECT slice, gold AS cls, gold = decision AS hit FROM sliced UNION ALL SELECT slice, decision, gold = decision FROM sliced)
  SELECT slice, round(avg(f), 6) AS macro_f1 FROM (SELECT slice, cls, count(*) FILTER (hit)::DOUBLE / count(*) AS f FROM c GROUP BY 1, 2) x GROUP BY 1""")
def metric_macro_f1(t):
    return metrics.macro_f1(_rec(t))


@query(f"""WITH {_SLICED}, b AS (SELECT *, ntile(15) OVER (PARTITION BY slice ORDER BY confidence, doc_id) AS bin FROM sliced)
  SELECT slice, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT slice, bin, count(*) AS n, abs(avg(confidence) - avg((decision = gold)::INT::DOUBLE)) AS gap FROM b GROUP BY 1, 2) x GROUP BY 1""")
def metric_ece_equal_mass(t):
    return metrics.ece_equal_mass(_rec(t))


@query(f"""WITH {_SLICED}, b AS (SELECT *, ceil(confidence * 10) AS bin FROM sliced) SELECT slice, round(sum(CASE WHEN bin > 0 THEN n * gap ELSE 0 END) / sum(n), 6) AS ece FROM (
  SELECT slice, bin, count(*) AS n, abs(avg(confidence) - avg((decision = gold)::INT::DOUBLE)) AS gap FROM b GROUP BY 1, 2) x GROUP BY 1""")
def metric_ece_equal_width(t):
    return metrics.ece_equal_width(_rec(t))


@query(f"""WITH {_SLICED}, e AS (SELECT *, (decision <> gold)::INT::DOUBLE AS wrong FROM sliced), r AS (SELECT slice, wrong,
    avg(wrong) OVER (PARTITION BY slice ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING) AS risk,
    avg(wrong) OVER (PARTITION BY slice ORDER BY wrong, doc_id ROWS UNBOUNDED PRECEDING) AS least FROM e)
  SELECT slice, round(avg(risk), 6) AS aurc, CASE WHEN avg(wrong) > avg(least) THEN round((avg(wrong) - avg(risk)) / (avg(wrong) - avg(least)), 6) END AS gap_closed FROM r GROUP BY 1""")
def metric_aurc(t):
    return metrics.aurc(_rec(t))


@query(f"""WITH a AS {_records('a')}, b AS {_records('b')}, t AS (SELECT unnest({CASCADE}::DOUBLE[]) AS t)
  SELECT t, count(*) AS n, round(avg((greatest(a.p_good, a.p_bad) < t)::INT::DOUBLE), 6) AS sent,
    round(avg((CASE WHEN greatest(a.p_good, a.p_bad) < t THEN b.forced ELSE a.forced END = a.gold)::INT::DOUBLE), 6) AS accuracy
  FROM a JOIN b USING (doc_id), t WHERE a.gold <> '__NULL__' GROUP BY t""")
def cascade_curve(t):
    return metrics.cascade(_rec(t), _rec(t, "b"), CASCADE)


_SWEEP = f"""SELECT t, avg((CASE WHEN p_null >= t THEN gold = '__NULL__' ELSE gold <> '__NULL__' AND forced = gold END)::INT::DOUBLE) AS accuracy,
  coalesce(avg((gold = '__NULL__')::INT::DOUBLE) FILTER (p_null >= t), 1) AS precision FROM {_records('a')} a, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) g GROUP BY t"""


@query(f"SELECT t, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision FROM ({_SWEEP}) s")
def threshold_sweep(t):
    return metrics.threshold_sweep(_rec(t), THRESHOLDS)


@query(f"""SELECT t, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision FROM ({_SWEEP}) s ORDER BY round(precision, 6) >= 0.9e0 DESC,
  CASE WHEN round(precision, 6) >= 0.9e0 THEN 0 ELSE round(precision, 6) END DESC, round(accuracy, 6) DESC,
  CASE WHEN round(precision, 6) >= 0.9e0 THEN round(abs(t - 0.5e0), 6) ELSE 0 END, t LIMIT 1""")
def null_threshold_fit(t):
    return metrics.fit_null_threshold(metrics.threshold_sweep(_rec(t), THRESHOLDS))


def _agreement_sql(size):
    return f"""SELECT count(*) AS n_groups, round(avg(r::DOUBLE), 6) AS all_right, round(avg((k = 1)::INT::DOUBLE), 6) AS same_answer FROM (
      SELECT doc_id // {size} AS g, count(*) AS n, min((decision = gold)::INT) AS r, count(DISTINCT decision) AS k FROM {_records('a')} x GROUP BY 1) y WHERE n = {size}"""


@query(_agreement_sql(2))
def pair_accuracy(t):
    return metrics.group_agreement(_rec(t), F.floor(F.col("doc_id") / 2), 2)


@query(_agreement_sql(3))
def wording_consistency(t):
    return metrics.group_agreement(_rec(t), F.floor(F.col("doc_id") / 3), 3)


@query(f"SELECT doc_id FROM {_records('a')} a INTERSECT SELECT doc_id FROM {_records('b')} b INTERSECT SELECT doc_id FROM {_records('c')} c")
def common_examples(t):
    return _rec(t).select("doc_id").intersect(_rec(t, "b").select("doc_id")).intersect(_rec(t, "c").select("doc_id"))


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT lang, avg((decision = gold)::INT::DOUBLE) AS acc FROM {_records(x)} r GROUP BY 1" for x in "abc") + ") SELECT lang, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd FROM s GROUP BY 1")
def seed_summary(t):
    right = (F.col("decision") == F.col("gold")).cast("double")
    runs = [_rec(t, x).groupBy("lang").agg(F.avg(right).alias("acc")) for x in "abc"]
    return runs[0].unionAll(runs[1]).unionAll(runs[2]).groupBy("lang").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd"))


_LOG = "(SELECT event_id, ts, user_id AS job, event_type AS role, CASE WHEN event_type = 'error' THEN 'retry' ELSE 'ok' END AS status, value AS tokens FROM events)"
_LAST = f"(SELECT job, event_id, role, status FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS n FROM {_LOG} l) x WHERE n = 1)"


@query(f"SELECT * FROM {_LAST} y")
def last_record_per_job(t):
    return jobs.last_per_job(jobs.job_log(t("events")))


@query(f"SELECT job, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM {_LOG} l) x WHERE n = 1")
def first_record_per_job(t):
    return build.first_per_key(jobs.job_log(t("events")), ["job"], "ts", "event_id").select("job", "event_id", "status")


@query(f"SELECT role, count(*) AS jobs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'retry') AS retry FROM {_LAST} y GROUP BY 1")
def job_totals(t):
    return jobs.job_totals(jobs.job_log(t("events")))


@query(f"""SELECT role, count(*) AS n, round(sum(tokens), 4) AS tokens, round(sum(tokens / 1e6 * coalesce(price, 0)), 8) AS cost FROM {_LOG} l
  LEFT JOIN (VALUES {', '.join(f"('{r}', {p}::DOUBLE)" for r, p in PRICES)}) p(role, price) USING (role) GROUP BY 1""")
def job_costs(t):
    return jobs.cost_by_role(jobs.job_log(t("events")), PRICES)


@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, {a}::VARCHAR AS value, count(*) AS n FROM events GROUP BY 2" for a in ("event_type", "user_id")))
def coverage_counts(t):
    return jobs.axis_counts(t("events"), ["event_type", "user_id"])


@query("SELECT event_type, quantile_cont(value::DOUBLE, 0.5) AS p50, quantile_cont(value::DOUBLE, 0.95) AS p95 FROM events GROUP BY 1".replace("quantile_cont(value::DOUBLE, 0.5)", "round(quantile_cont(value::DOUBLE, 0.5), 6)").replace("quantile_cont(value::DOUBLE, 0.95)", "round(quantile_cont(value::DOUBLE, 0.95), 6)"))
def latency_percentiles(t):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return t("events").groupBy("event_type").agg(p.alias("p")).select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


@query("SELECT source, round(max(n)::DOUBLE / sum(n), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) t GROUP BY 1")
def majority_share(t):
    per = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query(r"""WITH w AS (SELECT quality, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS word FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT word, quality, count(*) AS n FROM w GROUP BY 1, 2) SELECT word, sum(n)::BIGINT AS n, round(max(n)::DOUBLE / sum(n), 6) AS purity FROM c GROUP BY 1 HAVING sum(n) >= 5""")
def cue_words(t):
    rows = t("documents").join(t("labels"), "doc_id").select(words(F.col("text")).alias("w"), "quality")
    return jobs.cue_words(rows, "w", "quality")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS state FROM conversations GROUP BY 1")
def chat_state(t):
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s"))
    per = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return per.select("conv_id", F.size("l").cast("long").alias("n_turns"), F.array_join(F.col("l.s"), "\n").alias("state"))


@query(f"SELECT user_id, CAST((dense_rank() OVER (ORDER BY {_h(repr('fold'), 'user_id')}) - 1) % 5 AS BIGINT) AS fold FROM (SELECT DISTINCT user_id FROM events) t")
def fold_by_group(t):
    users = t("events").select("user_id").distinct()
    rank = F.dense_rank().over(W.orderBy(stable_hash("fold", F.col("user_id"))))
    return users.select("user_id", ((rank - 1) % 5).cast("long").alias("fold"))


@query("""SELECT vec_id, d, round(exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM (
  SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS z FROM embeddings) a) b""")
def grouped_softmax(t):
    w = W.partitionBy("vec_id")
    rows = t("embeddings").select("vec_id", F.posexplode("embedding").alias("d", "z")).withColumn("z", F.col("z").cast("double"))
    e = F.exp(F.col("z") - F.max("z").over(w))
    return rows.withColumn("e", e).select("vec_id", F.col("d").cast("long").alias("d"), F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT n_name, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def revenue_by_nation(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n"), revenue.alias("revenue"))
