"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree (domain, language, source). A node that cannot use its share, even by repeating
its documents max_epochs times, leaves the rest to its siblings; only what they cannot take either reaches the
siblings of its parent. A leaf reads whole epochs of its documents and of the last one the token-prefix, in an
order drawn anew for each epoch by a seeded hash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import named, packed, store, unpacked

LEVELS = ("domain", "lang", "source")
#: Leaves are cut into 2 ** BUCKET_BITS ranges of the hash; a prefix is counted in ranges and only its last range sorted.
BUCKET_BITS = 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share(budget: float, weights: dict, capacity: dict) -> dict:
    """Weighted shares of budget, none above its capacity; what one cannot take goes to the others by weight."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if weights[k] > 0 and capacity[k] > 0}
    left = min(budget, sum(capacity[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= capacity[k]}
        if not full:
            for k in open_:
                given[k] = left * weights[k] / total
            break
        for k in full:
            given[k] = float(capacity[k])
            left -= capacity[k]
        open_ -= full
    return given


def budgets(supply: dict[tuple, int], total: float, weights: dict[str, dict], max_epochs: int) -> dict[tuple, float]:
    """supply: leaf path -> tokens. weights: level -> {name: weight}; names that a level does not list weigh 1."""

    def weight(path):
        return weights.get(LEVELS[len(path) - 1], {}).get(path[-1], 1)

    below: dict[tuple, list] = {}
    room = {leaf: tokens * max_epochs for leaf, tokens in supply.items()}  # what a subtree can use: none under a weight of 0
    for level in range(len(LEVELS), 0, -1):
        for path in sorted(p for p in room if len(p) == level):
            below.setdefault(path[:-1], []).append(path)
            room[path[:-1]] = room.get(path[:-1], 0) + (room[path] if weight(path) > 0 else 0)
    given = {(): total}
    for level in range(len(LEVELS)):
        for path in [p for p in given if len(p) == level]:
            names = below.get(path, [])
            given |= share(given.pop(path), {c: weight(c) for c in names}, {c: room[c] for c in names})
    return {leaf: given[leaf] for leaf in supply}


def mix(
    df: DataFrame, domain: Column, weights: dict[str, dict], part: float, max_epochs: int = 1, seed: str = "mix",
    id_col="doc_id", text_col="text", lang_col="lang", source_col="source",
) -> DataFrame:
    """(row, domain, lang, source, tokens, epochs): the chosen rows of df, packed, and the times that each is read.

    The budget is part of all tokens (words). Null languages, sources and domains are leaves named unknown; a null text has
    no tokens. Rows are ordered by a hash of seed, epoch, id and text, so repeated rows tie and stand next to each other. A leaf
    gets at most its budget, and less than it only by a part of the next document. The tree's leaves, not the
    documents, are planned on the driver: a row for each source of a language.
    """
    path = list(LEVELS)
    names = {"domain": domain, "lang": named(lang_col).cast("string"), "source": named(source_col).cast("string")}
    leaf = [F.coalesce(c, F.lit("unknown")).alias(k) for k, c in names.items()]
    rows = packed(df, *leaf, words(named(text_col)).alias("tokens"), named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("content"))

    def place() -> list[Column]:
        h = F.xxhash64(F.lit(seed), "whole", "id", "content")
        return ["*", h.alias("h"), F.shiftright(h, 64 - BUCKET_BITS).cast("int").alias("bucket")]

    sizes = rows.groupBy(*path).agg(F.sum("tokens").alias("t")).collect()
    supply = {tuple(r[p] for p in path): int(r["t"]) for r in sizes}
    given = budgets(supply, part * sum(supply.values()), weights, max_epochs)
    plan = []
    for p, b in sorted(given.items()):
        whole = int(b // supply[p]) if supply[p] else 0
        plan.append((*p, whole, int(b - whole * supply[p]) if supply[p] else 0))
    spark = df.sparkSession
    kinds = ", ".join(f"{p} string" for p in path)
    table = F.broadcast(spark.createDataFrame(plan, f"{kinds}, whole int, rest long"))  # a row for each leaf
    ranged = rows.drop("row").join(table, path).select(*place())
    held = store(ranged.groupBy(*path, "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("r")), "buckets")
    upto = W.partitionBy(*path).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # at most 2 ** BUCKET_BITS rows a leaf
    edges = (  # the first range that does not fit whole
        held.withColumn("before", F.sum("t").over(upto) - F.col("t"))
        .where("before + t > r")
        .groupBy(*path)
        .agg(F.min(F.struct("bucket", (F.col("r") - F.col("before")).alias("room"))).alias("e"))
    )
    found = {tuple(r[p] for p in path): (r["e"]["bucket"], r["e"]["room"]) for r in edges.collect()}
    beyond = 1 << BUCKET_BITS
    cut = [(*p, whole, *found.get(tuple(p), (beyond, 0))) for *p, whole, _ in plan]
    cuts = F.broadcast(spark.createDataFrame(cut, f"{kinds}, whole int, edge int, room long"))
    placed = rows.join(cuts, path).select(*place())
    inside = placed.where("bucket < edge").withColumn("epochs", F.col("whole") + 1)
    outside = placed.where("bucket > edge and whole > 0").withColumn("epochs", F.col("whole"))
    running = W.partitionBy(*path).orderBy("h", "id").rowsBetween(W.unboundedPreceding, 0)
    at_edge = placed.where("bucket = edge").withColumn("total", F.sum("tokens").over(running))
    at_edge = at_edge.withColumn("epochs", F.col("whole") + (F.col("total") <= F.col("room")).cast("int")).where("epochs > 0").drop("total")
    chosen = inside.unionByName(outside).unionByName(at_edge)
    return chosen.select("row", *path, "tokens", "epochs")


def mixture_report(df: DataFrame, domain: Column, weights: dict, part: float, max_epochs: int, seed="mix") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs) of the chosen rows."""
    own = [F.col("row").getField(c).alias(c) for c in ("doc_id", "lang", "source")]
    chosen = mix(df, domain, weights, part, max_epochs, seed)
    return chosen.select(own[0], "domain", *own[1:], F.col("tokens").alias("n_tokens"), F.col("epochs").cast("long").alias("epochs"))


def keep_mixture(df: DataFrame, domain: Column, weights: dict, part: float, seed="mix") -> DataFrame:
    """The chosen rows of df, each once, with df's columns, whatever their names."""
    return mix(df, domain, weights, part, 1, seed).select(*unpacked(df.columns))
