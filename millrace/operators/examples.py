"""Examples made from rows: label samples, donors, windows, wordings, variants, agreement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import stable_hash

#: Ranges of the hash that rows are numbered in; a range is sorted by one task.
RANGES = 4096


def pretty(name: Column, names: dict[str, str]) -> Column:
    """Parts between underscores, each by its entry in names if it has one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.coalesce(table[w], w)), " ")


def in_hash_order(items: Column, *seed) -> Column:
    """The array's distinct items in the order of a seeded hash."""
    hashed = F.transform(F.array_distinct(items), lambda x: F.struct(stable_hash(*seed, x).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(hashed), lambda s: s["x"])


def sample_labels(pool: Column, gold: Column, key: Column, seed, least: int, most: int) -> Column:
    """least to most labels of the pool, gold among them, in an order that depends on seed and key alone."""
    n = (least + stable_hash(seed, "n", key) % (most - least + 1)).cast("int")
    others = F.slice(in_hash_order(F.array_remove(pool, gold), seed, "pick", key), F.lit(1), n - 1)
    return in_hash_order(F.concat(others, F.array(gold)), seed, "order", key)


def numbered(df: DataFrame, key: str, seed, name: str = "place") -> DataFrame:
    """Places from 0 in a hash order without sorting all rows in one task: by range, then within the range."""
    ranged = df.withColumn("__h", stable_hash(seed, F.col(key))).withColumn("__range", (F.col("__h") % RANGES).cast("int"))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(W.orderBy("__range")) - F.col("__size")  # at most RANGES rows
    starts = F.broadcast(sizes.select("__range", before.alias("__before")))
    spot = F.row_number().over(W.partitionBy("__range").orderBy("__h", key)) - 1
    return ranged.join(starts, "__range").withColumn(name, F.col("__before") + spot).drop("__h", "__range", "__before")


def with_donor(hosts: DataFrame, donors: DataFrame, key: str, seed, columns: list[str]) -> DataFrame:
    """One donor for each host, drawn by the host's hash; an equi-join on the donor's place."""
    n = donors.agg(F.count("*").alias("__n"))
    at = (stable_hash(seed, "host", F.col(key)) % F.col("__n")).cast("long")
    asked = hosts.join(F.broadcast(n), F.col("__n") > 0).withColumn("__place", at).drop("__n")
    given = numbered(donors.select(key, *columns), key, seed, "__place")
    given = given.select("__place", F.col(key).alias(f"donor_{key}"), *[F.col(c).alias(f"donor_{c}") for c in columns])
    return asked.join(given, "__place").drop("__place")


def word_window(words: Column, at: Column, n: int) -> Column:
    """n words around place at (from 0), with an ellipsis where words are left out."""
    first = F.greatest(F.lit(0), F.least(at - n // 2, F.size(words) - n))
    text = F.array_join(F.slice(words, first + 1, n), " ")
    return F.concat(F.when(first > 0, "... ").otherwise(""), text, F.when(first + n < F.size(words), " ...").otherwise(""))


def passage(docs: DataFrame, key: str, text: str, enough: int, most: int) -> DataFrame:
    """Whole paragraphs from the first until there are enough words; one that would lead beyond most ends it before."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "par"))
    n = F.regexp_count("par", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    upto = F.sum("n").over(W.partitionBy(key).orderBy("pos"))
    parts = parts.withColumn("n", n).where("n > 0").withColumn("upto", upto)
    taken = parts.where((F.col("upto") - F.col("n") < enough) & (F.col("upto") <= most))
    return taken.groupBy(key).agg(F.count("*").alias("n_paragraphs"), F.sum("n").alias("n_words"))


def reworded(questions: DataFrame, wordings: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each question (keys) and style that has a text for every label of the question.

    questions: keys, label, one row a label. wordings: label, style, text, a short table made by hand.
    """
    size = questions.groupBy(*keys).agg(F.countDistinct("label").alias("__size"))
    hit = questions.join(F.broadcast(wordings), "label")
    whole = hit.groupBy(*keys, "style").agg(F.countDistinct("label").alias("__n"), F.array_sort(F.collect_set(F.concat("label", F.lit("="), "text"))).alias("texts"))
    return whole.join(size, keys).where("__n = __size").select(*keys, "style", F.array_join("texts", "; ").alias("texts"))


def variants(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row as it is, and once without each of its fields; states are lines of name and value."""
    line = {f: F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields}
    made = [F.struct(F.lit("orig").alias("variant"), F.concat_ws("\n", *line.values()).alias("state"))]
    made += [F.struct(F.lit(f"without:{f}").alias("variant"), F.concat_ws("\n", *[x for g, x in line.items() if g != f]).alias("state")) for f in fields]
    return df.select(*keys, F.inline(F.array(*made)))


def agreed_score(a: Column, b: Column, low: float, high: float, one_step: bool = False) -> Column:
    """The mean of two scores within 15 % of the range, kept inside it; null if they differ by more.

    one_step: on ranges up to 10 a difference of 1 agrees too.
    """
    room = max(0.15 * (high - low), 1.0 if one_step and high - low <= 10 else 0.0)
    return F.when(F.abs(a - b) <= room, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), (a + b) / 2)))


def greedy_rows(df: DataFrame, block: Column, order: str, size: str, room: int) -> DataFrame:
    """Items of a block in order, each in the open row if it fits, else in a new one. (order, block, row)

    A block must be of bounded size (such as a range of ids): it becomes one array, folded inside generated code.
    """
    item = F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    blocks = df.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.expr("named_struct('row', 0L, 'used', 0L, 'out', cast(array() as array<struct<o: bigint, row: bigint>>))")

    def add(state, x):
        new = (state["used"] > 0) & (state["used"] + x["s"] > room)
        row = F.when(new, state["row"] + 1).otherwise(state["row"])
        used = F.when(new, x["s"]).otherwise(state["used"] + x["s"])
        out = F.concat(state["out"], F.array(F.struct(x["o"].alias("o"), row.alias("row"))))
        return F.struct(row.alias("row"), used.alias("used"), out.alias("out"))

    folded = blocks.select("block", F.explode(F.aggregate("items", none, add)["out"]).alias("p"))
    return folded.select(F.col("p.o").alias(order), "block", F.col("p.row").alias("row"))


def first_match(df: DataFrame, text: str, key: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """The first pattern of a short list that a text matches; rows that match none go."""
    name = F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns])
    return df.select(key, name.alias("match")).where("match is not null")


def rate_since_reset(df: DataFrame, key: str, order: list[str], reset: Column, value: str, last: int = 10) -> DataFrame:
    """Mean change between the last points of a key; points before its last reset do not count."""
    w = W.partitionBy(key).orderBy(*order)
    runs = df.withColumn("__run", F.sum(reset.cast("int")).over(w))
    back = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    runs = runs.withColumn("__n", F.row_number().over(back)).withColumn("__last", F.first("__run").over(back))
    points = runs.where((F.col("__run") == F.col("__last")) & (F.col("__n") <= last))
    newest, oldest = F.min_by(value, "__n"), F.max_by(value, "__n")
    rate = F.when(F.count("*") > 1, (newest - oldest) / (F.count("*") - 1))
    return points.groupBy(key).agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate"))
