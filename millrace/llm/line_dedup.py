"""Line dedup over a corpus by a deletion-neighbourhood join; DataFrame functions only.

A line is a nonblank piece of a text between newlines. Its first place is the least (doc id, line number). A line
goes if an equal line stands earlier, or if a different line whose first place is earlier lies within one edit
(insertion, deletion or replacement of a character; both lines of NEAR_CHARS characters or more).

Near lines meet by hashed variants: the line itself and the line without each one of its characters. A variant is hashed
in three parts, a block of about sqrt(n) characters (BLOCK at least) and what stands before and behind it, so that a line
of n characters costs some n * sqrt(n) steps. Lines that lack the same place of an equal variant are all within one edit of each other, and a
line is within one edit of all that have it as a variant: so each meets the earliest one alone, and no pairs within a
group are made. Every such pair is checked: two lines are within one edit if they are equal without those places.

Lines that could meet are found first: one edit leaves the first or the second half of the shorter line as it is, so only
lines that share such a half with a different line need variants. That loses nothing. Texts that hold a wanted line are
found by a bit mask of fixed size, whatever the corpus: others pass by without a shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, packed, store, unpacked

#: Least characters of lines that go for a near one; shorter lines go for equal ones alone.
NEAR_CHARS = 20
#: Least characters of a block of a variant.
BLOCK = 64
_NO_ID = -(1 << 63)
#: Bits of the mask of texts that a join concerns (8 MB), and of each of its rows (as bitmap_construct_agg makes them).
MASK_BITS, MASK_ROW = 1 << 26, 32768


def _doc_key(id_col: str, text_col: str) -> list[Column]:
    """What names a row: its id (null: the least long) and a hash of its text, for ids that repeat."""
    return [F.coalesce(named(id_col).cast("long"), F.lit(_NO_ID)).alias("di"), F.xxhash64(named(text_col)).alias("dh")]


def _pieces(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2")]


def _halves(line: Column, n: Column, least: int) -> Column:
    """Hashes of the halves that one edit cannot both change, as the shorter or equal line and as the longer one."""
    keys = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        rest = (size - half).cast("int")
        keys += [
            F.xxhash64(F.lit("head"), size, F.substr(line, F.lit(1), half)),
            F.xxhash64(F.lit("tail"), size, F.substr(line, n - rest + 1, rest)),
        ]
    return F.when(n >= least, F.array(*keys))


def _variants(line: Column, n: Column) -> Column:
    """(v, at) for each variant: at is the place of the missing character, 0 where none is missing.

    The variant of m characters is known by m, a block's number, the hashes of what is before and behind the block, and
    the block's characters but one; the line itself is known so for every block that a longer line could have.
    """

    def around(m: Column, skipped: int) -> Column:
        """A struct for each block of a variant of m characters, so that what is around a block is hashed once."""
        block = F.greatest(F.lit(BLOCK), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(m, F.lit(1))) / 2)).cast("int"))
        sized = F.transform(F.sequence(F.lit(0), F.floor(m / block).cast("int")), lambda b: F.struct((b * block).alias("start"), block.alias("block")))
        return F.transform(
            sized,
            lambda x: F.struct(
                x["start"].alias("start"),
                m.alias("m"),
                F.xxhash64(F.substr(line, F.lit(1), x["start"])).alias("before"),
                F.substr(line, x["start"] + 1, x["block"] - 1 + skipped).alias("inside"),
                F.xxhash64(F.substr(line, x["start"] + x["block"] + skipped, n)).alias("behind"),
            ),
        )

    def key(s: Column, inside: Column) -> Column:
        return F.xxhash64(s["m"], s["start"], s["before"], inside, s["behind"])

    itself = F.transform(around(n, 0), lambda s: F.struct(key(s, s["inside"]).alias("v"), F.lit(0).alias("at")))
    without = F.transform(
        F.filter(around(n - 1, 1), lambda s: F.length(s["inside"]) > 0),
        lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s["inside"])),
            lambda i: F.struct(
                key(s, F.concat(F.substr(s["inside"], F.lit(1), i - 1), F.substr(s["inside"], i + 1, F.length(s["inside"])))).alias("v"),
                (s["start"] + i).cast("int").alias("at"),
            ),
        ),
    )
    return F.concat(itself, F.flatten(without))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands with two or more different k1."""
    many = rows.groupBy(key).agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select(key)
    return rows.join(many, key, "left_semi")


def _in_mask(docs: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs that may be in wanted (all that are, and a few more), and the others. The mask has MASK_BITS bits at most."""

    def bit() -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(MASK_BITS))

    rows = wanted.select(bit().alias("p")).groupBy(F.floor(F.col("p") / MASK_ROW).alias("mask_row"))
    masks = F.broadcast(rows.agg(F.bitmap_construct_agg(F.pmod("p", F.lit(MASK_ROW))).alias("mask")))
    at = F.pmod(F.col("p"), F.lit(MASK_ROW)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("mask"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), at % 8 + 1)) % 2 == 1, F.lit(False))
    marked = docs.withColumn("p", bit()).withColumn("mask_row", F.floor(F.col("p") / MASK_ROW)).join(masks, "mask_row", "left")
    marked = marked.withColumn("hit", found).drop("mask", "mask_row", "p")
    return marked.where("hit").drop("hit"), marked.where("not hit").drop("hit")


def near_pairs(lines: DataFrame, least: int = NEAR_CHARS) -> DataFrame:
    """lines (k1, ord, line, n: its length), distinct, a written table: (earlier, later) k1, for every line that has an earlier one within one edit."""
    long_enough = lines.where(F.col("n") >= least)  # n is stored: computed in place, it would be counted for every variant
    variants = long_enough.select("k1", "ord", F.explode(_variants(F.col("line"), F.col("n"))).alias("s"))
    meeting = store(_shared(store(variants.select("k1", "ord", "s.v", "s.at"), "all-variants"), "v"), "variants")
    place = F.min(F.struct("ord", "k1", "at")).alias("first")
    replaced, whole = meeting.where("at > 0"), meeting.where("at = 0")
    earliest = replaced.groupBy("v", "at").agg(place)
    longer = replaced.groupBy("v").agg(place)
    names = ["earlier", "at_a", "later", "at_b"]
    same = replaced.join(earliest, ["v", "at"]).where("k1 <> first.k1").select("first.k1", "at", F.col("k1").alias("other"), "at")
    shorter = whole.select("v", F.col("ord").alias("o"), F.col("k1").alias("k"))
    after = replaced.join(shorter, "v").where("o < ord").select("k", F.lit(0), "k1", "at")
    before = shorter.join(longer, "v").where("first.ord < o").select("first.k1", "first.at", "k", F.lit(0))
    pairs = same.toDF(*names).unionAll(after.toDF(*names)).unionAll(before.toDF(*names)).distinct()

    def variant(line: str, at: str) -> Column:
        at = F.col(at)
        return F.when(at == 0, F.col(line)).otherwise(F.concat(F.substr(F.col(line), F.lit(1), at - 1), F.substr(F.col(line), at + 1, F.length(line))))

    left = long_enough.select(F.col("k1").alias("earlier"), F.col("line").alias("a"))
    right = long_enough.select(F.col("k1").alias("later"), F.col("line").alias("b"))
    both = pairs.join(left, "earlier").join(right, "later")
    return both.where(variant("a", "at_a") == variant("b", "at_b")).select("earlier", "later")


def removed_lines(df: DataFrame, id_col="doc_id", text_col="text", least: int = NEAR_CHARS) -> DataFrame:
    """(di, dh, gone): for each document that loses lines, the places of those lines from 0; a written table."""
    docs = df.select(*_doc_key(id_col, text_col), named(text_col).alias("body")).where("body is not null")
    line = F.col("line")
    lines = docs.select("di", "dh", F.posexplode(_pieces(F.col("body"))).alias("pos", "line")).where(line.rlike(r"[^\x20\x09-\x0D]"))
    keyed = store(lines.select("di", "dh", "pos", *_line_key(line), _halves(line, F.length(line), least).alias("halves")), "lines")
    place = F.struct("di", "dh", "pos")
    firsts = keyed.groupBy("k1", "k2").agg(F.min(place).alias("ord"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    firsts = store(firsts, "firsts")
    halves = firsts.where("halves is not null").select("k1", F.explode("halves").alias("half"))
    candidates = _shared(halves, "half").select("k1").distinct()
    at = firsts.join(candidates, "k1", "left_semi").groupBy("ord.di", "ord.dh").agg(F.collect_list("ord.pos").alias("at"))
    at = store(at, "at")
    found = _in_mask(docs, at, ["di", "dh"])[0].join(at, ["di", "dh"]).dropDuplicates(["di", "dh"])
    found = found.select("di", "dh", _pieces(F.col("body")).alias("p"), F.explode("at").alias("pos"))
    texts = found.select(place.alias("ord"), F.col("p")[F.col("pos")].alias("line")).select(*_line_key(line), "ord", "line", F.length("line").alias("n"))
    near = near_pairs(store(texts, "candidates"), least).select(F.col("later").alias("k1"), F.lit(True).alias("near")).distinct()
    verdict = firsts.select("k1", "k2", "ord", "n").join(near, "k1", "left").where("n > 1 or near")
    gone = keyed.select("k1", "k2", "di", "dh", "pos").join(verdict, ["k1", "k2"]).where(F.col("near") | (place != F.col("ord")))
    return store(gone.groupBy("di", "dh").agg(F.collect_set("pos").alias("gone")), "gone")


def _deduped(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(row, left, n_lines, n_gone): the rows of df packed, the text that is left, counts of nonblank lines."""
    gone = removed_lines(df, id_col, text_col, least)
    touched, others = _in_mask(packed(df, *_doc_key(id_col, text_col)), gone, ["di", "dh"])
    joined = touched.join(gone, ["di", "dh"], "left").unionByName(others.withColumn("gone", F.lit(None).cast("array<int>")))
    body = F.col("row").getField(text_col)
    parts = _pieces(body)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    filled = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), body).otherwise(rebuilt).alias("left"),
        F.coalesce(F.when(body.isNotNull(), filled), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"),
    )


def line_report(df: DataFrame, id_col="doc_id", text_col="text", least: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): for every row the text that is left and the counts of nonblank lines.

    A null text stays null, an empty one empty; blank lines always stay. Rows with equal id and text share one
    place, so both keep their first lines; null ids come before all others. Lines may have any length.
    """
    rows = _deduped(df, id_col, text_col, least)
    return rows.select(F.col("row").getField(id_col).alias("doc_id"), F.col("left").alias("text"), "n_lines", F.col("n_gone").alias("n_removed"))


def clean_documents(df: DataFrame, id_col="doc_id", text_col="text", chars_col="n_chars", least: int = NEAR_CHARS) -> DataFrame:
    """df with cleaned texts and the matching chars_col, if df has it; documents all of whose lines went are left out.

    Other columns stay as they are, whatever their names.
    """
    rows = _deduped(df, id_col, text_col, least).where("n_gone = 0 or n_gone < n_lines")
    instead = {text_col: F.col("left")}
    if chars_col in df.columns:
        instead[chars_col] = F.length("left").cast(df.schema[chars_col].dataType)
    return rows.select(*unpacked(df.columns, **instead))
