"""File sources and sinks: JSON lines, quoted CSV, whole files, credentials, manifests, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def usable_texts(rows: DataFrame, least: int = 2000) -> DataFrame:
    """Rows (text, label, kind) that are long enough, personal, or of a named kind."""
    return rows.where((F.length("text") > least) | (F.col("label") == 1) | F.col("kind").isNotNull())


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header line and RFC 4180 quotes, line breaks of either kind inside them too; rows without any value are dropped."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.options(**options).schema(schema).csv(path).na.drop("all")


def labelled_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, url, label, notes, source, hostname, protocol, path of a table of labelled pages; the source is `synthetic` where none is given."""
    rows = quoted_csv(spark, path, "file string, url string, label string, notes string, source string")
    protocol = F.concat(F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(":"))
    return rows.select(
        "file", "url", "label", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce(F.nullif("source", F.lit("")), F.lit("synthetic")).alias("source"),
        U.host(F.col("url")).alias("hostname"), protocol.alias("protocol"), U.path(F.col("url")).alias("path"),
    )


def without_demo(pages: DataFrame, collected_only: bool = False) -> DataFrame:
    return pages.where(F.col("source") == "collected" if collected_only else F.col("source") != "demo")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name) and html of each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("html"))


def credentials(spark: SparkSession, path: str) -> DataFrame:
    """user, hash of lines `user:hash`, split at the first colon; # comments and lines without both are skipped, of repeated users the last line stands."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split("value", "\n")).alias("_n", "_line"))
    line = F.btrim("_line", F.lit(" \t\r\n"))
    parts = lines.where(~line.startswith("#")).select("_f", "_n", F.btrim(F.split(line, ":", 2)[0]).alias("user"), F.btrim(F.get(F.split(line, ":", 2), 1)).alias("hash"))
    return parts.where("user <> '' and hash <> ''").groupBy("user").agg(F.max_by("hash", F.struct("_f", "_n")).alias("hash"))


def write_credentials(users: DataFrame, path: str) -> None:
    users.select(F.concat_ws(":", "user", "hash")).write.text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """bundle (the folder under `path`), file, bytes, sha256 of each file below; a file that several bundles share has shared = true but for one of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("bundle"), F.element_at(parts, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    first = rows.groupBy("sha256").agg(F.min(F.struct("bundle", "file")).alias("_first"))
    return rows.join(first, "sha256").select("bundle", "file", "bytes", "sha256", (F.struct("bundle", "file") != F.col("_first")).alias("shared"))


def bundle_sizes(files: DataFrame) -> DataFrame:
    """bundle, files, bytes: what each bundle needs, shared files included."""
    return files.groupBy("bundle").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def markdown(arms: DataFrame) -> str:
    """A table of evaluation arms (arm, tp, fp, tn, fn, precision, recall, f1, fpr), one row each: a report, few rows by nature."""
    percent = lambda x: F.concat(F.format_string("%.1f", F.col(x) * 100), F.lit("%"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "arm", "tp", "fp", "tn", "fn", *[percent(x) for x in ("precision", "recall", "f1", "fpr")]), F.lit(" |"))
    head = ["| Arm | TP | FP | TN | FN | Precision | Recall | F1 | FP rate |", "|---|---:|---:|---:|---:|---:|---:|---:|---:|"]
    return "\n".join([*head, *(r["x"] for r in arms.select(cells.alias("x")).collect())])
