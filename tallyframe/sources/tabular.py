"""Tabular sources: CSV, JSON, TOML; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import filled
from ..plans.errors import RequestError
from .delimited import read_csv

#: Cells that state nothing.
PLACEHOLDERS = ("", "-", "--", "---", "—", "–", "n/a", "n.a.", "na", "nil", "null", "none", "nan", "tbd", "待填", "無", "无", "未測", "未测")


def drop_blank(df: DataFrame, blank: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """Rows with at least one cell that is none of the blank ones; by default placeholders are blank."""
    states = F.lit(False)
    for c in df.columns:
        states = states | ~F.lower(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).isin(*blank)
    return df.where(states)


def union_tagged(frames: dict[str, DataFrame], tag: str = "sheet") -> DataFrame:
    """Several tables as one, with the union of their columns and the name of each in a column, if there is more than one."""
    out: DataFrame | None = None
    for name, df in frames.items():
        one = df.withColumn(tag, F.lit(name)) if len(frames) > 1 else df
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise RequestError("there is no table")
    return out


def find_frame(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """A table by its name, its name without extension, or either in any case; an error names those there are."""
    for key in (lambda x: x, lambda x: x.rpartition(".")[0] or x, str.lower, lambda x: (x.rpartition(".")[0] or x).lower()):
        hits = [df for k, df in frames.items() if key(k) == key(name)]
        if len(hits) == 1:
            return hits[0]
    raise RequestError(f"{name!r} is none of {', '.join(sorted(frames))}")


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A list as rows, or an object as one row; JSON lines if told so (these split, a list does not)."""
    return spark.read.json(path, multiLine=not lines)


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    """A TOML document as one row of text; nested tables are JSON."""
    import json
    import tomllib

    body = spark.read.text(path, wholetext=True).first()
    record = tomllib.loads(body.value if body else "")
    cells = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in record.items()}
    return spark.createDataFrame([cells]) if cells else spark.createDataFrame([], "value string")


READERS = {"csv": read_csv, "json": read_json, "toml": read_toml}


def file_type(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def read_source(spark: SparkSession, path: str) -> DataFrame:
    kind = file_type(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in READERS:
        raise RequestError(f"there is no reader for {kind!r} files")
    return READERS[kind](spark, path)


def row_blocks(df: DataFrame, key: str, source_id: str, file_type: str) -> DataFrame:
    """Ledger blocks of a table: a JSON record for each row, blank cells left out; rows of placeholders alone go."""
    df = drop_blank(df)
    cells = F.struct(*[filled(c).alias(c) for c in df.columns])
    return df.select(F.lit(source_id).alias("source_id"), F.lit(file_type).alias("file_type"), F.lit("csv_row").alias("block_type"), F.col(key).cast("long").alias("line_start"), F.to_json(cells).alias("content"))


def read_ledger(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_ledger(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    ledger.write.mode(mode).json(path)
