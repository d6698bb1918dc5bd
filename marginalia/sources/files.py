"""Files in and out: text documents, saved results, pass configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from .reports import write_files

#: Saved results, read with this schema: what is missing is null.
RESULT = "doc_id long, summary string, topics array<string>, action_items array<string>, metadata struct<model: string, chunks: int, processing_time: double>"


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1, which fits any bytes."""
    plain = content.cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1"))


def load_text_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """One row a file of the accepted kinds: path, file_name, modified, length, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(kinds)).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.col("modificationTime").alias("modified"), "length", decode_text(F.col("content")).alias("text"))


def title_of(file_name: Column) -> Column:
    """Title from a file name: what stands before the first dot, blanks for underscores."""
    return F.initcap(F.replace(F.split(file_name, "\\.")[0], F.lit("_"), F.lit(" ")))


def file_profile(files: DataFrame) -> DataFrame:
    """Add title, characters, words and speakers to rows of file_name and text."""
    found = X.speakers(F.col("text"))
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return files.withColumns({"title": title_of(F.col("file_name")), "chars": F.length("text"), "words": words, "speakers": found, "speaker_count": F.size(found)})


def clean_name(base: Column) -> Column:
    return F.regexp_replace(base, "[^A-Za-z0-9]+", "_")


def write_reports(reports: DataFrame, path: str, suffix: str = "notes") -> None:
    """Markdown and JSON files of a table with doc_id, name, report and any result columns, one of each
    a document, named by its cleaned name, the suffix and its id; a folder a task holds them."""
    named = reports.withColumn("document", F.concat_ws("_", clean_name(F.col("name")), F.lit(suffix), F.col("doc_id").cast("string")))
    write_files(named.select(F.concat("document", F.lit(".md")).alias("name"), F.col("report").alias("content")), f"{path}/md")
    result = F.to_json(F.struct(*[c for c in reports.columns if c != "report"]))
    write_files(named.select(F.concat("document", F.lit(".json")).alias("name"), result.alias("content")), f"{path}/json")


def read_results(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """Saved results, one JSON object a line or a file, with a fixed schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def list_outputs(spark: SparkSession, path: str, latest: int = 3) -> DataFrame:
    """The newest saved outputs: file, title (first heading, else the stem), date, size."""
    files = load_text_files(spark, path, ("md", "txt", "json"))
    title = F.coalesce(X.first_match(X.first_line(F.col("text")), r"^# (.*)"), F.split("file_name", "\\.")[0])
    return files.select("path", title.alias("title"), F.col("modified").alias("date"), F.col("length").alias("size")).orderBy(F.desc("date"), "path").limit(latest)


def pass_catalog(built_in: DataFrame, configs: DataFrame) -> DataFrame:
    """Built-in passes and those of files whose type is new; the name defaults to the type."""
    new = configs.where("pass_type is not null").join(built_in.select("pass_type"), "pass_type", "left_anti")
    first = F.row_number().over(W.Window.partitionBy("pass_type").orderBy("purpose"))
    new = new.withColumn("n", first).where("n = 1").drop("n")
    name = F.coalesce("name", F.initcap(F.replace("pass_type", F.lit("_"), F.lit(" "))))
    return built_in.unionByName(new, allowMissingColumns=True).withColumn("name", name)


def save_pass_config(configs: DataFrame, path: str) -> None:
    """Persist configurations by type; those without a type are rejected."""
    configs.where("pass_type is not null").write.partitionBy("pass_type").mode("append").json(path)
