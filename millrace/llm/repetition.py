"""Quality rules from repetition coverage: how many characters lie in duplicated n-grams and duplicated lines.

Each document is one numpy problem: words become numbers, a prefix sum of number * base**place (wrapping at
64 bits) gives the rolling hash of every window of any length by one subtraction and one multiplication, and
equal hashes mark the words that the windows cover.
"""

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.common import freed, id_and_text, map_rows

#: Largest share of word characters inside n-grams that stood earlier in the text, for each length, and of line
#: characters in lines that stood earlier.
NGRAM_SHARES = {5: 0.30, 7: 0.30, 9: 0.30}
LINE_SHARE = 0.30
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_share double, dup_line_share double"


def _covered(windows: np.ndarray, width: int, n: int, first: bool) -> np.ndarray | None:
    """Which of n words lie in a window that stood earlier (first: or stands again later); None if no window does."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return None
    twice = np.zeros(len(windows) + 1, bool)
    twice[order[1:][same]] = True
    if first:
        twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _triples(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """A number for each 3-word window, equal just where the windows are."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if n_ids < 1 << 21:
        return (a << 42) | (b << 21) | c
    pair = np.unique(a * n_ids + b, return_inverse=True)[1]
    return pair * n_ids + c


def measure(body: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {n: share}, line share of one text."""
    body = body or b""
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    word_chars = len(body.translate(None, _NOT_COUNTED))
    n_symbols = len(body) - len(body.translate(None, SYMBOLS))
    distinct = set(lines)
    n_dup_lines = len(lines) - len(distinct)
    line_share = 0.0
    if n_dup_lines:
        line_share = 1 - sum(len(x.decode("utf-8", "replace")) for x in distinct) / sum(len(x.decode("utf-8", "replace")) for x in lines)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n, n_repeat, shares = len(words), 0, dict.fromkeys(NGRAM_SHARES, 0.0)
    if n > 3 and len(known) < n:
        covered = _covered(_triples(ids, len(known)), 3, n, True)
        if covered is not None:
            n_repeat = int(covered.sum())
            # only words that a duplicated triple covers can lie in a longer duplicated window
            sizes = np.array([len(w.translate(None, _NOT_COUNTED)) for w in words])
            one = np.ones(1, np.uint64)
            powers = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]))
            back = np.cumprod(np.concatenate([one, np.full(n, _BACK, np.uint64)]))
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:n], dtype=np.uint64)])
            for width in NGRAM_SHARES:
                if n > width:
                    windows = (prefix[width:] - prefix[:-width]) * back[: n - width + 1]
                    inside = _covered(windows, width, n, False)
                    if inside is None:
                        break  # longer windows cannot repeat either
                    shares[width] = float(sizes[inside].sum() / max(1, word_chars))
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, shares, line_share


def judge(body: bytes | None) -> tuple:
    n, chars, symbols, dup_lines, repeat, shares, line_share = measure(body)
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and line_share <= LINE_SHARE and all(shares[w] <= most for w, most in NGRAM_SHARES.items())
    return n, chars, symbols, dup_lines, repeat, failed, kept, max(shares.values()), line_share


def quality(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The measures and the verdict for every row of df; a null text has no words, so it fails the base rule."""

    def run(cols):
        return [cols[0], *map(list, zip(*[judge(b) for b in cols[1]]))]

    return map_rows(id_and_text(df, id_col, text_col), run, COLUMNS)


def keep_good(df: DataFrame, text_col="text") -> DataFrame:
    """The rows of df whose text passes; columns stay, also clashing ones. Each row is judged by its own text."""
    names, place = df.columns, df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([judge(None if x is None else x.encode())[6] for x in batch.column(place).to_pylist()], pa.bool_()))

    plain = df.toDF(*[f"c{k}" for k in range(len(names))])  # Arrow maps take no names with dots
    return plain.mapInArrow(freed(run), plain.schema).toDF(*names)
