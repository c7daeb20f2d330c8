"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are counts of hashed byte trigrams over the whole text, square-rooted and scaled to length one. Both
steps vote among pairwise linear support vector machines (squared hinge, full-batch accelerated descent).
"""

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, id_and_text, map_rows

#: Families of languages by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is",
    "romance": "fr es it pt ca ro gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 4096
#: Rows that are learned from, drawn evenly over the languages by a hash of the id.
SAMPLE_ROWS = 1600


def features(body: bytes) -> np.ndarray:
    raw = np.frombuffer(b"  " + body.lower() + b" ", np.uint8).astype(np.uint32)
    grams = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    counts = np.bincount((grams ^ (grams >> np.uint32(15))) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.float32(np.sqrt(x @ x))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights with a bias at the end; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - 0.2 * (penalty * ahead - x.T @ (2 * share * y * slack))
        ahead, w = step + k / (k + 3) * (step - w), step
    return w


def fit_pairs(x: np.ndarray, names: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for a, b in combinations(sorted(set(names)), 2):
        rows = (names == a) | (names == b)
        out[a, b] = fit_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0)).astype(np.float32)
    return out


def vote(x: np.ndarray, names: list[str], pairs: dict) -> tuple[str, float]:
    """The name with most won pairs (ties: larger sum of margins, then the lesser name) and its mean confidence."""
    wins, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for (a, b), w in pairs.items():
        margin = float(x @ w[:-1] + w[-1])
        wins[a if margin >= 0 else b] += 1
        p = 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
        sure[a] += p
        sure[b] += 1 - p
    best = min(names, key=lambda n: (-wins[n], -sure[n], n))
    return best, sure[best] / (len(names) - 1) if len(names) > 1 else 1.0


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, dtype=object)
        family = np.array([FAMILY_OF.get(n, n) for n in langs], dtype=object)
        self.members = {f: sorted(set(langs[family == f])) for f in sorted(set(family))}
        self.between = fit_pairs(x, family)
        self.within = {f: fit_pairs(x[family == f], langs[family == f]) for f in self.members}

    def predict(self, body: bytes | None) -> tuple[str, float]:
        if not body or not self.members or not any(map(str.isalpha, body.decode("utf-8", "replace"))):
            return "und", 0.0
        x = features(body)
        family, p = vote(x, list(self.members), self.between)
        lang, q = vote(x, self.members[family], self.within[family])
        return lang, float(p * q)


def fit(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Learn from a bounded sample of the rows that are not held out and have a language and a text."""
    usable = id_and_text(df, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where(
        ~held_out(F.col("id"), 5, 0) & F.col("lang").isNotNull() & F.col("body").isNotNull()
    )
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    each = SAMPLE_ROWS / max(1, len(sizes))
    span = 1 << 30
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(span))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < int(span * min(1.0, each / n))))
    rows = map_rows(
        usable.where(chosen),
        lambda cols: [cols[0], [features(b).astype(np.float16).tobytes() for b in cols[1]], cols[2]],
        "id long, x binary, lang string",
    ).collect()
    rows.sort(key=lambda r: (r["lang"], r["id"] is None, r["id"] or 0, r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return Model(x, [r["lang"] for r in rows])


def identify(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; und and 0 for a text that is null or has no letter."""
    model = fit(df, id_col, text_col, lang_col)

    def run(cols):
        found = [model.predict(b) for b in cols[1]]
        return [cols[0], cols[2], [f[0] for f in found], [f[1] for f in found]]

    rows = id_and_text(df, id_col, text_col, held_out(F.col(id_col).cast("long"), 5, 0).alias("out"))
    return map_rows(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
