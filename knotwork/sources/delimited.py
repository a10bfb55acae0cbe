"""Delimited text: all-string readers with ``""`` for missing, line parsing, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = "\t", header: bool = True, comment: str | None = None, quote: str = '"') -> DataFrame:
    """Every column a string, blanks as ``""``; gzip by its extension.  ``quote=""`` reads lines as they are."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", quote).option("escape", quote or "\x00").option("emptyValue", "").option("nullValue", "\x00")
    if comment:
        reader = reader.option("comment", comment)
    if columns:
        reader = reader.schema(strings(columns))
    return reader.csv(path).na.fill("")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Comma separated, otherwise as ``read_tsv``."""
    return read_tsv(spark, path, columns, ",", header)


def read_optional(spark: SparkSession, path: str, columns: list[str], **how) -> DataFrame:
    """As ``read_tsv``; an empty table of these columns where the path does not exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], strings(columns))
    return read_tsv(spark, path, columns, **how)


def read_all_but(spark: SparkSession, glob: str, excluded: str, columns: list[str]) -> DataFrame:
    """All files of a glob but those of one name."""
    return read_tsv(spark, glob, columns).filter(F.col("_metadata.file_name") != excluded)


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """JSON result documents, one per file, with the file's name."""
    return spark.read.option("multiLine", True).json(glob).withColumn("file_name", F.col("_metadata.file_name"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Elements of an XML file as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def parse_lines(lines: DataFrame, column: str, sep: str, least: int, comment: str = "#") -> DataFrame:
    """Lines cut at a separator (``fields``); comments and lines with fewer than ``least`` fields are left out.  Null lines too."""
    cut = F.split(F.col(column), sep if sep.isalnum() or sep == " " else "\\" + sep)
    return lines.filter(F.col(column).isNotNull() & ~F.col(column).startswith(comment)).withColumn("fields", cut).filter(F.size("fields") >= least)


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of tab-separated files with header, replacing what is there."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("escape", "\"").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in the given order, comma separated."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", "\"").csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """One id per line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an output is already there, for jobs that resume."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A small table (a report of at most ``limit`` rows, more are an error) as Markdown; ``-`` for null."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def report(sections: dict[str, dict]) -> str:
    """A text report of sectioned counts."""
    return "\n".join(line for name, counts in sections.items() for line in [f"[{name}]", *[f"{k}\t{v if isinstance(v, str) else json.dumps(v)}" for k, v in counts.items()], ""])


def write_raw(df: DataFrame, path: str) -> None:
    """The rows behind a report, compressed, for later analysis."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_raw(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """What ``write_raw`` wrote, by the first of several column names each; rows with a NaN or null in a number are left out."""
    df = spark.read.parquet(path)
    found = {k: next((n for n in names if n in df.columns), None) for k, names in aliases.items()}
    out = df.select(*[F.col(n).alias(k) for k, n in found.items() if n])
    for f in out.schema.fields:
        if f.dataType in (T.DoubleType(), T.FloatType()):
            out = out.filter(F.col(f.name).isNotNull() & ~F.isnan(f.name))
    return out
