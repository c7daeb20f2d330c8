"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over every position, and each filter's response is max-pooled within
chunks that overlap by the filter width less one, so no window of the text is lost. A document's largest and
mean chunk responses give one probability by logistic regression; all weights are learned together (Adam).
"""

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, id_and_text, map_rows

EMBED, WIDTH, FILTERS, CHUNK = 8, 8, 16, 128
#: Positions that are convolved at once.
BLOCK = 1 << 16
#: Labelled rows of each class that are learned from, the longest text among them, and passes over them.
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS = 600, 1 << 15, 10
THRESHOLD = 0.3


def start(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (EMBED * WIDTH) ** -0.5, (EMBED * WIDTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "head": np.zeros(2 * FILTERS, np.float32),
        "shift": np.zeros(1, np.float32),
    }


def _windows(raw: np.ndarray, net: dict) -> np.ndarray:
    """raw: bytes, a multiple of CHUNK positions and WIDTH - 1 more -> (positions, EMBED * WIDTH)."""
    embedded = np.ascontiguousarray(net["embed"][raw]).reshape(-1)
    return sliding_window_view(embedded, EMBED * WIDTH)[::EMBED]


def _responses(raw: np.ndarray, net: dict, last: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK, FILTERS); last: chunks that end a text. Their last windows would reach into the next text, so they do not count."""
    response = (np.ascontiguousarray(_windows(raw, net)) @ net["filters"]).reshape(-1, CHUNK, FILTERS)
    response[last, CHUNK - WIDTH + 1 :] = -1e9
    return response


def _laid_out(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with WIDTH - 1 spaces at least and filled with spaces to whole chunks; chunks of each.

    So every byte is in windows that end before the next text, and a score depends on its own text alone.
    """
    chunks = np.array([-(-(len(b) + WIDTH - 1) // CHUNK) for b in bodies])
    raw = b"".join([b.ljust(int(c) * CHUNK) for b, c in zip(bodies, chunks)]) + b" " * (WIDTH - 1)
    return np.frombuffer(raw, np.uint8), chunks


def chunk_responses(bodies: list[bytes], net: dict) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, FILTERS) rectified pooled responses, in blocks of bounded size, and chunks of each text."""
    raw, chunks = _laid_out(bodies)
    ends, out = np.cumsum(chunks) - 1, []
    for at in range(0, len(raw) - WIDTH + 1, BLOCK):
        own = ends[(ends >= at // CHUNK) & (ends < (at + BLOCK) // CHUNK)] - at // CHUNK
        out.append(_responses(raw[at : at + BLOCK + WIDTH - 1], net, own).max(1))
    return np.maximum(np.concatenate(out) + net["bias"], 0), chunks


def _document(responses: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    return np.hstack([np.maximum.reduceat(responses, first), np.add.reduceat(responses, first) / chunks[:, None]])


def score(bodies: list[bytes], net: dict) -> np.ndarray:
    z = _document(*chunk_responses(bodies, net)) @ net["head"] + net["shift"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _gradient(bodies: list[bytes], y: np.ndarray, net: dict) -> dict[str, np.ndarray]:
    raw, chunks = _laid_out(bodies)
    response = _responses(raw, net, np.cumsum(chunks) - 1)
    place = response.argmax(1)
    top = np.take_along_axis(response, place[:, None], 1)[:, 0] + net["bias"]
    pooled = np.maximum(top, 0)
    doc = _document(pooled, chunks)
    z = doc @ net["head"] + net["shift"]
    error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
    owner = np.repeat(np.arange(len(chunks)), chunks)
    back = error[:, None] * net["head"]
    is_top = pooled >= doc[owner, :FILTERS]
    g = back[owner, FILTERS:] / chunks[owner, None] + back[owner, :FILTERS] * is_top
    g *= top > 0
    at = (np.arange(len(place))[:, None] * CHUNK + place).reshape(-1)
    chosen = np.ascontiguousarray(_windows(raw, net)[at]).reshape(len(place), FILTERS, -1)
    out = {
        "head": error @ doc + 1e-4 * net["head"],
        "shift": np.array([error.sum()]),
        "bias": g.sum(0),
        "filters": np.einsum("cfx,cf->xf", chosen, g),
    }
    spread = (g[:, :, None] * net["filters"].T[None]).reshape(-1, WIDTH, EMBED)
    out["embed"] = np.zeros_like(net["embed"])
    np.add.at(out["embed"], raw[at[:, None] + np.arange(WIDTH)], spread)
    return out


def fit(bodies: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 24) -> dict[str, np.ndarray]:
    net, y = start(), np.array(labels, np.float32)
    first, second, t = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2)), None, 0
    first, second = first
    rng = np.random.default_rng(7)
    for epoch in range(epochs if bodies else 0):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            t += 1
            for k, g in _gradient([bodies[i] for i in rows], y[rows], net).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * (1 - 0.8 * epoch / epochs)
                net[k] = (net[k] - rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def sample(documents: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> tuple[list[bytes], list[int]]:
    """About SAMPLE_ROWS texts of each class, none held out, drawn by a hash of the id; the rest is not read."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & ~held_out(F.col("id"), 5, 0))
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    span = 1 << 30
    chosen = F.lit(False)
    for label, n in sizes.items():
        rate = int(span * min(1.0, SAMPLE_ROWS / n))
        chosen = chosen | ((F.col("quality") == label) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(span)) < rate))
    few = marked.where(chosen).groupBy("id").agg(F.min("quality").alias("quality"))
    texts = id_and_text(documents, id_col, text_col).where(F.octet_length("body").between(1, SAMPLE_BYTES))
    rows = texts.join(F.broadcast(few), "id").collect()  # few: at most about 2 * SAMPLE_ROWS rows
    rows.sort(key=lambda r: (r["id"], bytes(r["body"])))
    return [bytes(r["body"]) for r in rows], [r["quality"] for r in rows]


def classify(documents: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text counts as empty and gets a score too.

    Texts may have any length. A document that several labels mark counts as its least label.

    Without any label the network stays as it starts and every score is 0.5.
    """
    net = fit(*sample(documents, labels, id_col, text_col))

    def run(cols):
        p, bodies, at = np.zeros(len(cols[0])), [b or b"" for b in cols[1]], 0
        while at < len(bodies):  # so many texts as fill some blocks
            to, size = at, 0
            while to < len(bodies) and (to == at or size + len(bodies[to]) <= 4 * BLOCK):
                size += len(bodies[to])
                to += 1
            p[at:to] = score(bodies[at:to], net)
            at = to
        return [cols[0], cols[2], p.tolist(), (p >= THRESHOLD).astype(int).tolist()]

    rows = id_and_text(documents, id_col, text_col, held_out(F.col(id_col).cast("long"), 5, 0).alias("out"))
    return map_rows(rows, run, "doc_id long, held_out boolean, score double, predicted int")
