"""User functions over items and over groups of a level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Arrow bytes of items that a user function gets at once.
PART_BYTES = 4 << 20


def map_items(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user function over batches of items; Spark's cores bound the parallelism. A batch becomes pandas in parts of about
    ``PART_BYTES``, so that what a task holds follows neither the number of rows nor the length of texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                made = f(batch.slice(at, step).to_pandas())
                yield from pa.Table.from_pandas(made[kind.names], schema=arrow, preserve_index=False).to_batches()

    return df.mapInArrow(run, kind)


def _merged(size: int, f: Callable[[pd.DataFrame], str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("item")
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]], "item": [g["item"].iloc[0] // size], "text": [f(g)]})

    return run


def level_functions(df: DataFrame, levels: list[tuple[int, Callable[[pd.DataFrame], str]]], text: str = "text") -> DataFrame:
    """Per level a group size and a function of a group's rows (in order) to one text; each
    level works on the texts of the one before. A group holds ``size`` rows."""
    now = df.select("doc_id", F.col("chunk_index").cast("long").alias("item"), F.col(text).alias("text"))
    found = None
    for level, (size, f) in enumerate(levels, 1):
        now = now.groupBy("doc_id", F.floor(F.col("item") / size)).applyInPandas(_merged(size, f), "doc_id long, item long, text string")
        tagged = now.select("doc_id", F.lit(level).alias("level"), "item", "text")
        found = tagged if found is None else found.union(tagged)
    return found


def sql_function(f: Callable[..., Iterator[tuple] | tuple], schema: str, column: str) -> type:
    """A Python table function that gives, for each row of its table argument, the rows of ``f(value of column)``:
    the columns of the table, then those of ``schema``. Its result type is found when a query is analysed, so it serves any table
    that has the column; names of ``schema`` that the table has too are an error."""
    added = StructType.fromDDL(schema)

    class Items:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            known = _table(rows, column)
            clash = sorted(set(known.names) & set(added.names))
            if clash:
                raise ValueError(f"the table has columns {clash} already")
            return AnalyzeResult(StructType([*known.fields, *added.fields]))

        def eval(self, row: Row) -> Iterator[tuple]:
            for out in f(row[column]):
                yield (*row, *out)

    return Items


def sql_level(f: Callable[[list[str]], str]) -> type:
    """A Python table function ``(TABLE(rows), size)`` over rows of (doc_id, item, text) and any other columns: the texts of each
    ``size`` successive items of a document, in order, become one by ``f``: (doc_id, item, items, text).

    The function asks for its own partitions, a group of ``size`` items each, and their order, so a document of any length is
    dealt over tasks and one call holds ``size`` texts. Null texts reach ``f`` as empty ones; null items form a group of their own, by text.
    ``size`` has to be a constant of at least 1."""

    class Level:
        @staticmethod
        def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
            known = _table(rows, "doc_id", "item", "text")
            if not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1:
                raise ValueError("size has to be a constant whole number of at least 1")
            out = StructType([known["doc_id"], StructField("item", LongType()), StructField("items", LongType()), StructField("text", StringType())])
            group = PartitioningColumn(f"floor(item / {size.value})")
            return AnalyzeResult(out, partitionBy=[PartitioningColumn("doc_id"), group], orderBy=[OrderingColumn("item"), OrderingColumn("text")])

        def __init__(self) -> None:
            self.texts: list[str] = []
            self.first: Row | None = None

        def eval(self, row: Row, size: int) -> None:
            self.size = size
            self.first = self.first or row
            self.texts.append(row["text"] or "")

        def terminate(self) -> Iterator[tuple]:
            if self.first is not None:
                at = self.first["item"]
                yield self.first["doc_id"], None if at is None else at // self.size, len(self.texts), f(self.texts)

    return Level


def _table(rows: AnalyzeArgument, *columns: str) -> StructType:
    if not rows.isTable:
        raise ValueError("the first argument has to be a table")
    missing = sorted(set(columns) - set(rows.dataType.names))
    if missing:
        raise ValueError(f"the table lacks columns {missing}")
    return rows.dataType


def register(spark: SparkSession, name: str, function: type) -> None:
    """Make a table function of ``sql_function`` or ``sql_level`` known to SQL under a name."""
    spark.udtf.register(name, udtf(function))
