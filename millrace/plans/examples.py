"""More queries of the catalogue: examples, calibration, text and event functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import normalised, stable_hash, unit_draw, words
from millrace.operators import audits, calibrate, examples
from millrace.plans.catalogue import _h, _rec, _records, _u, normalised_sql, query
from millrace.streaming import logs

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAMES = {"BRASS": "brass", "STEEL": "steel", "TIN": "tin (metal)"}
WORDINGS = [(x, "plain", f"a {x}") for x in ("click", "view", "purchase", "error", "signup")] + [(x, "short", x[:2]) for x in ("click", "view", "purchase")]
PATTERNS = [("brass", "BRASS$"), ("early", "^[A-F]"), ("steel", "STEEL")]
FIELDS = ["c_name", "c_mktsegment", "c_nationkey"]
TRIALS = [0.25, 0.5, 1.0, 2.0, 4.0]
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', '_'), '_'), lambda w:
    CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items())} ELSE w END), ' ') AS name FROM part""")
def pretty_names(t):
    return t("part").select("p_partkey", examples.pretty(F.translate("p_type", " ", "_"), NAMES).alias("name"))


_SAMPLED = f"""base AS (SELECT c_custkey, c_mktsegment AS gold, 2 + {_h("'ls'", "'n'", 'c_custkey')} % 3 AS n FROM customer),
  others AS (SELECT c_custkey, l, n, row_number() OVER (PARTITION BY c_custkey ORDER BY {_h("'ls'", "'pick'", 'c_custkey', 'l')}, l) AS r
    FROM base, (SELECT unnest({SEGMENTS}) AS l) p WHERE l <> gold),
  taken AS (SELECT c_custkey, l, false AS is_gold FROM others WHERE r < n UNION ALL SELECT c_custkey, gold, true FROM base)"""
_ORDER = _h("'ls'", "'order'", "c_custkey", "l")


def _sampled(t):
    pool = F.array(*map(F.lit, SEGMENTS))
    return t("customer").select("c_custkey", F.col("c_mktsegment").alias("gold"), examples.sample_labels(pool, F.col("c_mktsegment"), F.col("c_custkey"), "ls", 2, 4).alias("labels"))


@query(f"WITH {_SAMPLED} SELECT c_custkey, string_agg(l, ',' ORDER BY {_ORDER}) AS labels FROM taken GROUP BY 1")
def sampled_labels(t):
    return _sampled(t).select("c_custkey", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_SAMPLED} SELECT c_custkey, string_agg(l, ',' ORDER BY {_ORDER}) FILTER (NOT is_gold) AS labels, '__NULL__' AS target FROM taken GROUP BY 1 HAVING count(*) >= 3")
def gold_removed(t):
    left = F.array_remove("labels", F.col("gold"))
    return _sampled(t).where(F.size("labels") >= 3).select("c_custkey", F.array_join(left, ",").alias("labels"), F.lit("__NULL__").alias("target"))


@query(f"""WITH d AS (SELECT doc_id AS donor_doc_id, lang AS donor_lang, row_number() OVER (ORDER BY {_h("'dn'", 'doc_id')} % 4096, {_h("'dn'", 'doc_id')}, doc_id) - 1 AS place FROM documents)
  SELECT doc_id, donor_doc_id, donor_lang FROM documents JOIN d ON place = {_h("'dn'", "'host'", 'doc_id')} % (SELECT count(*) FROM documents)
  WHERE donor_doc_id <> doc_id""")
def mismatch_donors(t):
    docs = t("documents").select("doc_id", "lang")
    return examples.with_donor(docs.select("doc_id"), docs, "doc_id", "dn", ["lang"]).where("donor_doc_id <> doc_id")


@query(f"""SELECT doc_id, CASE WHEN f > 0 THEN '... ' ELSE '' END || array_to_string(w[f + 1:f + 9], ' ') || CASE WHEN f + 9 < len(w) THEN ' ...' ELSE '' END AS part
  FROM (SELECT doc_id, w, greatest(0, least(len(w) // 2 - 4, len(w) - 9)) AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents) a) b""")
def word_windows(t):
    rows = t("documents").select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", examples.word_window(F.col("w"), F.floor(F.size("w") / 2).cast("int"), 9).alias("part"))


@query(r"""WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS par FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a),
  n AS (SELECT doc_id, pos, len(regexp_extract_all(par, '[^\x20\x09-\x0D]+')) AS n FROM p), u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n WHERE n > 0)
  SELECT doc_id, count(*) AS n_paragraphs, sum(n)::BIGINT AS n_words FROM u WHERE upto - n < 60 AND upto <= 120 GROUP BY 1""")
def passages(t):
    return examples.passage(t("documents"), "doc_id", "text", 60, 120)


@query(f"""SELECT user_id, style, string_agg(DISTINCT event_type || '=' || txt, '; ' ORDER BY event_type || '=' || txt) AS texts
  FROM (SELECT DISTINCT user_id, event_type FROM events) e JOIN (VALUES {', '.join(map(str, WORDINGS))}) v(label, style, txt) ON label = event_type
  JOIN (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1) s USING (user_id) GROUP BY user_id, style, k HAVING count(DISTINCT event_type) = k""")
def reworded_labels(t):
    table = t("events").sparkSession.createDataFrame(WORDINGS, "label string, style string, text string")
    return examples.reworded(t("events").select("user_id", F.col("event_type").alias("label")), table, ["user_id"])


def _state(fields):
    return "concat_ws(chr(10), " + ", ".join(f"'{f}: ' || coalesce({f}::VARCHAR, '')" for f in fields) + ")"


@query(" UNION ALL ".join([f"SELECT c_custkey, 'orig' AS variant, {_state(FIELDS)} AS state FROM customer"] + [f"SELECT c_custkey, 'without:{f}', {_state([g for g in FIELDS if g != f])} FROM customer" for f in FIELDS]))
def audit_variants(t):
    return examples.variants(t("customer"), ["c_custkey"], FIELDS)


_TOLD = "regexp_extract_all({}, '[a-z0-9][a-z0-9.@%$/-]*')"


@query(f"""SELECT conv_id, turn, length(b) >= 3 AND (contains(a, b) OR (len(wb) >= 2 AND len(list_filter(wb, lambda x: list_contains(wa, x))) >= len(wb) * 0.8e0)) AS ok FROM (
  SELECT *, {_TOLD.format('a')} AS wa, list_filter({_TOLD.format('b')}, lambda w: length(w) > 2 OR regexp_full_match(w, '[0-9]+')) AS wb FROM (
  SELECT x.conv_id, x.turn, {normalised_sql('x.text')} AS a, {normalised_sql('y.text')} AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn) s) z""")
def evidence_supported(t):
    """Is each turn's text supported by the turn before it?"""
    rows = t("conversations").select("conv_id", "turn", normalised(F.col("text")).alias("a"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", audits.evidence_holds(F.col("b"), F.col("a")).alias("ok"))


@query(f"SELECT doc_id, CASE WHEN abs(a - b) <= 1.5e0 THEN round((a + b) / 2, 6) END AS score FROM (SELECT doc_id, 10 * {_u(repr('r1'), 'doc_id')} AS a, 10 * {_u(repr('r2'), 'doc_id')} AS b FROM documents) x")
def agreed_scores(t):
    a, b = (unit_draw(r, F.col("doc_id"), times=10) for r in ("r1", "r2"))
    return t("documents").select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", F.round(examples.agreed_score(F.col("a"), F.col("b"), 0, 10), 6).alias("score"))


@query(f"SELECT doc_id FROM {_records('a')} r WHERE decision <> gold OR CASE WHEN gold = '__NULL__' THEN p_null ELSE confidence END < 0.6e0")
def hard_questions(t):
    wrong = F.col("decision") != F.col("gold")
    sure = F.when(F.col("gold") == "__NULL__", F.col("p_null")).otherwise(F.col("confidence"))
    return _rec(t).where(wrong | (sure < 0.6)).select("doc_id")


@query("""WITH RECURSIVE o AS (SELECT doc_id, doc_id // 64 AS block, n_chars AS s, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS n FROM documents),
  g AS (SELECT doc_id, block, n, s AS used, 0::BIGINT AS row_no FROM o WHERE n = 1 UNION ALL
    SELECT o.doc_id, o.block, o.n, CASE WHEN g.used > 0 AND g.used + o.s > 4000 THEN o.s ELSE g.used + o.s END, g.row_no + (g.used > 0 AND g.used + o.s > 4000)::BIGINT
    FROM g JOIN o ON o.block = g.block AND o.n = g.n + 1) SELECT doc_id, block, row_no FROM g""")
def greedy_rows(t):
    return examples.greedy_rows(t("documents"), F.floor(F.col("doc_id") / 64), "doc_id", "n_chars", 4000).withColumnRenamed("row", "row_no")


@query("SELECT * FROM (SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{n}'" for n, p in PATTERNS) + " END AS match FROM part) t WHERE match IS NOT NULL")
def first_pattern(t):
    return examples.first_match(t("part"), "p_type", "p_partkey", PATTERNS)


@query("""WITH r AS (SELECT user_id, value, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS spot FROM events), p AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS latest FROM r)
  SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round((arg_min(value, spot) - arg_max(value, spot)) / (count(*) - 1), 6) END AS rate FROM p WHERE run = latest AND spot <= 10 GROUP BY 1""")
def rate_since_reset(t):
    return examples.rate_since_reset(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "value")


@query("SELECT event_type, n, round(1 / (0.1e0 + n / avg(n) OVER ()), 6) AS weight FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) t")
def balance_weights(t):
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", "n", F.round(1 / (0.1 + F.col("n") / F.avg("n").over(W.partitionBy())), 6).alias("weight"))


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h("'kb'", 'doc_id')}, doc_id) AS n FROM documents) t
  WHERE n <= 200 // (SELECT count(DISTINCT source) FROM documents)""")
def kind_budget(t):
    docs = t("documents").select("doc_id", "source")
    kinds = F.broadcast(docs.agg(F.countDistinct("source").alias("k")))  # one row
    spot = F.row_number().over(W.partitionBy("source").orderBy(stable_hash("kb", F.col("doc_id")), "doc_id"))
    return docs.withColumn("n", spot).join(kinds, F.col("n") <= F.floor(F.lit(200) / F.col("k"))).select("doc_id", "source")


def _ens(x):
    return f"SELECT doc_id, p_null, p_good, p_bad FROM {_records(x)} r"


@query(f"SELECT doc_id, round(avg(p_null), 6) AS p_null, round(avg(p_good), 6) AS p_good, round(avg(p_bad), 6) AS p_bad FROM ({_ens('a')} UNION ALL {_ens('b')} UNION ALL {_ens('c')}) u GROUP BY 1 HAVING count(*) = 3")
def ensemble_mean(t):
    kinds = ["p_null", "p_good", "p_bad"]
    return calibrate.ensemble([_rec(t, x) for x in "abc"], "doc_id", kinds).select("doc_id", *[F.round(k, 6).alias(k) for k in kinds])


@query(f"SELECT doc_id, round({' + '.join(f'(a.{k} - b.{k}) * (ln(greatest(a.{k}, 1e-12)) - ln(greatest(b.{k}, 1e-12)))' for k in ('p_null', 'p_good', 'p_bad'))}, 5) AS kl FROM {_records('a')} a JOIN {_records('b')} b USING (doc_id)")
def twin_divergence(t):
    kinds = ["p_null", "p_good", "p_bad"]
    both = _rec(t).select("doc_id", *kinds).join(_rec(t, "b").select("doc_id", *[F.col(k).alias(f"b_{k}") for k in kinds]), "doc_id")
    kl = calibrate.symmetric_divergence([F.col(k) for k in kinds], [F.col(f"b_{k}") for k in kinds])
    return both.select("doc_id", F.round(kl, 5).alias("kl"))


_SQ = "((least(1e0, greatest(0e0, {})) * 99 + 0.5e0) / 100)"


@query(f"""SELECT doc_id, round(lgamma(a) + lgamma(b) - lgamma(a + b) - (a - 1) * ln(x) - (b - 1) * ln(1 - x), 4) AS nll, 1 + round_even(mu * 4, 0) AS answer FROM (
  SELECT *, mu * kappa AS a, (1 - mu) * kappa AS b FROM (SELECT doc_id, {_SQ.format(_u(repr('mu'), 'doc_id'))} AS mu, 2 + 28 * {_u(repr('ka'), 'doc_id')} AS kappa, {_SQ.format(_u(repr('x'), 'doc_id'))} AS x FROM documents) s) y""")
def beta_scores(t):
    mu, x = (calibrate.squeeze(unit_draw(k, F.col("doc_id"))) for k in ("mu", "x"))
    rows = t("documents").select("doc_id", mu.alias("mu"), (2 + 28 * unit_draw("ka", F.col("doc_id"))).alias("kappa"), x.alias("x"))
    nll = calibrate.beta_nll(F.col("x"), F.col("mu"), F.col("kappa"))
    return rows.select("doc_id", F.round(nll, 4).alias("nll"), calibrate.to_step(F.col("mu"), 1.0, 5.0, 1.0).alias("answer"))


@query(f"""SELECT t, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / t)))) - z[g + 1] / t), 6) AS nll FROM (SELECT embedding[1:4]::DOUBLE[] AS z, label % 4 AS g FROM embeddings) e,
  (SELECT unnest({TRIALS}::DOUBLE[]) AS t) g GROUP BY 1""")
def temperature_grid(t):
    rows = t("embeddings").select(F.slice("embedding", 1, 4).cast("array<double>").alias("z"), (F.col("label") % 4).alias("g"), F.explode(F.array(*map(F.lit, TRIALS))).alias("t"))
    return rows.groupBy("t").agg(F.round(F.avg(calibrate.negative_log_likelihood(F.col("z"), F.col("g"), F.col("t"))), 6).alias("nll"))


@query(f"SELECT lang, decision = '__NULL__' OR confidence < 0.6e0 AS needs_review, count(*) AS n FROM {_records('a')} r GROUP BY 1, 2")
def triage(t):
    review = (F.col("decision") == "__NULL__") | (F.col("confidence") < 0.6)
    return _rec(t).groupBy("lang", review.alias("needs_review")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, round((avg((forced = gold)::INT::DOUBLE) - 0.5e0) / 0.5e0, 6) AS skill FROM {_records('a')} r WHERE gold <> '__NULL__' GROUP BY 1")
def chance_corrected(t):
    right = F.avg((F.col("forced") == F.col("gold")).cast("double"))
    return _rec(t).where("gold <> '__NULL__'").groupBy("lang").agg(F.round((right - 0.5) / 0.5, 6).alias("skill"))


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_fields(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(text, '[^A-Za-z0-9_.:-]+', '_', 'g'), '_'), 64) AS slug, CAST(len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS BIGINT) AS n_sentences,
  TRY_CAST(nullif(regexp_extract(text, '-?[0-9]+(\.[0-9]+)?', 0), '') AS DOUBLE) AS first_number FROM documents""")
def text_scalars(t):
    slug = F.substring(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9_.:-]+", "_"), "^_+|_+$", ""), 1, 64)
    number = F.nullif(F.regexp_extract("text", r"-?[0-9]+(\.[0-9]+)?", 0), F.lit(""))
    sentences = (F.regexp_count("text", F.lit(r"[.!?]\s+")) + 1).cast("long")
    return t("documents").select("doc_id", slug.alias("slug"), sentences.alias("n_sentences"), number.try_cast("double").alias("first_number"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS by, count(*) AS n FROM events GROUP BY 1, 2".replace("AS by", "AS kind"))
def event_windows(t):
    per = logs.windowed_counts(t("events"), "ts", F.col("event_type"), "6 hours", "1 hour")
    return per.select(F.col("start").cast("string").alias("start"), F.col("by").alias("kind"), "n")
