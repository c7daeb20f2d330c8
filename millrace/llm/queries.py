"""One query for each operator, over its whole table with production parameters."""

from pyspark.sql import functions as F

from millrace.llm import (
    bm25_pack,
    byte_cnn,
    langid,
    license_scan,
    line_dedup,
    mixing,
    mph_dedup,
    ngram_trie,
    repetition,
    simhash,
)

#: The mixture: which domain a source belongs to, and the target weights of each level.
DOMAIN_OF = {"web": range(0, 8), "reference": range(8, 14), "forum": range(14, 20)}
WEIGHTS = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIXED_PART = 0.5


def domain():
    out = F
    for name, numbers in DOMAIN_OF.items():
        out = out.when(F.col("source").isin([f"src{n}" for n in numbers]), F.lit(name))
    return out.otherwise(F.lit("other"))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_vptree(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup_mph(spark, sf_dir):
    return mph_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_byte_cnn(spark, sf_dir):
    return byte_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_repetition_rules(spark, sf_dir):
    return repetition.quality(_table(spark, sf_dir, "documents"))


def op5_langid_hierarchy(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_bm25_packing(spark, sf_dir):
    return bm25_pack.pack(_table(spark, sf_dir, "documents"))


def op7_ngram_trie(spark, sf_dir):
    return ngram_trie.score(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mixture_report(_table(spark, sf_dir, "documents"), domain(), WEIGHTS, MIXED_PART, max_epochs=4)


def op10_license_templates(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {
        "op8_line_dedup": r"""
            WITH pieces AS (
                SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
            ), lines AS (
                SELECT doc_id, u.pos, u.line FROM (
                    SELECT doc_id, unnest(list_zip(range(len(p)), p)) AS z FROM pieces) t,
                    LATERAL (SELECT z[1] AS pos, z[2] AS line) u
            ), filled AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
            firsts AS (
                SELECT line, length(line) AS n, row_number() OVER (ORDER BY d, p) AS r, d, p FROM (
                    SELECT line, min({'d': doc_id, 'p': pos}).d AS d, min({'d': doc_id, 'p': pos}).p AS p
                    FROM filled GROUP BY line) f
            ), near AS (
                SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.n = b.n AND a.r < b.r
                WHERE a.n >= 20 AND (left(a.line, a.n // 2) = left(b.line, b.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, b.n - b.n // 2))
                  AND levenshtein(a.line, b.line) <= 1
                UNION
                SELECT DISTINCT CASE WHEN a.r < b.r THEN b.line ELSE a.line END FROM firsts a JOIN firsts b ON a.n + 1 = b.n
                WHERE a.n >= 20 AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2))
                  AND levenshtein(a.line, b.line) <= 1
            ), marked AS (
                SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AS is_filled,
                       f.line IS NOT NULL AND (n.line IS NOT NULL OR f.d <> l.doc_id OR f.p <> l.pos) AS gone
                FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line
            )
            SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text,
                   coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed
            FROM documents d LEFT JOIN (
                SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
                       CAST(count(*) FILTER (is_filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
                FROM marked GROUP BY doc_id) m USING (doc_id)""",
        "op2_exact_dedup_mph": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
