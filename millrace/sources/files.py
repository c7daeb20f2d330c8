"""Readers and writers for example files, logs, tables in text, and archives."""

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines end at \\n alone (not at Unicode separators); .gz is read as it is; half-written lines go.

    A gzip file cannot be split: write many files, as write_jsonl does.
    """
    broken = "__broken"
    rows = spark.read.schema(f"{schema}, {broken} string").option("columnNameOfCorruptRecord", broken).option("lineSep", "\n").json(path)
    return rows.where(F.col(broken).isNull()).drop(broken)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Prediction files: the line of metadata, which has no ex, goes."""
    return read_jsonl(spark, path, schema).where(F.col("ex").isNotNull())


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header row."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a user's CSV: trimmed, rows with an empty side dropped."""
    rows = read_delimited(spark, path, "text string, label string").select(F.trim("text").alias("text"), F.trim("label").alias("label"))
    return rows.where("length(text) > 0 AND length(label) > 0")


def read_zip_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, member, line_no, line) of the members that end in suffix, read as a stream, split at \\n alone."""

    def run(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if n.endswith(suffix)):
                        with archive.open(name) as member:
                            rows = []
                            for k, line in enumerate(member):
                                rows.append((source, name, k, line.rstrip(b"\n").decode("utf-8", "replace")))
                                if len(rows) == 10_000:
                                    yield _batch(rows)
                                    rows = []
                            if rows:
                                yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, line_no long, line string")


def read_markdown_table(spark: SparkSession, path: str, first_cell: str) -> DataFrame:
    """(cells) of the table rows whose first cell matches a pattern."""
    cells = F.transform(F.split(F.trim("value"), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\|.*\|$")).select(F.slice(cells, F.lit(2), F.size(cells) - 2).alias("cells"))
    return rows.where(F.col("cells")[0].rlike(f"^(?:{first_cell})$"))


def read_log_matches(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, groups) of the lines that a pattern matches."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(pattern))
    n = pattern.replace(r"\(", "").replace("(?", "").count("(")
    return rows.select("file", F.array(*[F.regexp_extract("value", pattern, k) for k in range(1, n + 1)]).alias("groups"))


def registry(spark: SparkSession, sources: list[tuple[str, str, str, bool]]) -> DataFrame:
    """The short table of sources: id, family, license, held out."""
    return spark.createDataFrame(sources, "source string, family string, license string, heldout boolean")


def allowed_splits(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Held-out sources give test rows only."""
    known = F.broadcast(sources.select("source", "heldout"))
    return rows.join(known, "source").where("NOT heldout OR split = 'test'").drop("heldout")


def write_jsonl(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Gzip JSON lines in a folder for each value of by. errorifexists freezes a set, append makes a log."""
    df.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", False).partitionBy(*by).json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def stats(rows: DataFrame, axes: list[str]) -> str:
    """Counts of each value of each axis, as JSON. Axes are short lists of names, such as slices or sources."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.axis", "p.value").count().collect()
    out: dict[str, dict] = {a: {} for a in axes}
    for r in sorted(counts, key=lambda r: (r["axis"], r["value"] is None, r["value"])):
        out[r["axis"]][r["value"]] = r["count"]
    return json.dumps(out, ensure_ascii=False)


def report(summary: DataFrame) -> str:
    """A Markdown table of a summary (a row for each slice)."""
    lines = [summary.columns, ["-"] * len(summary.columns)]
    lines += [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in summary.collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
