"""Text sources: whole files or tables, cut between marks and with white space collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: characters that count as white space when a corpus is collapsed, beside Unicode's own.
EXTRA_SPACES = "\\x1c-\\x1f\\x85"


def collapsed(text: Column) -> Column:
    """All runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[\\s{EXTRA_SPACES}]+", " "))


def between(text: Column, start: str | None, end: str | None) -> Column:
    """What lies after the line with ``start`` and before the line with ``end``; a mark that is missing cuts nothing."""
    if start:
        at = F.locate(start, text)
        after = F.substring(text, at, F.length(text))
        line = F.locate("\n", after)
        text = F.when(at > 0, F.when(line > 0, F.substring(after, line + 1, F.length(text))).otherwise(F.lit(""))).otherwise(text)
    if end:
        at = F.locate(end, text)
        head = F.substring(text, F.lit(1), at - 1)
        text = F.when(at > 0, F.regexp_replace(head, "[^\\n]*\\z", "")).otherwise(text)
    return text


def load_corpus(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, n_chars: int | None = None, lower: bool = False) -> DataFrame:
    """(path, text): each file as one text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    text = collapsed(between(F.col("text"), start, end))
    if n_chars is not None:
        text = F.substring(text, 1, n_chars)
    return raw.withColumn("text", F.lower(text) if lower else text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table of fewer files than cores to all cores; tables of many files stay as they are.

    Encoding is work for the processor, so one small file would otherwise keep one core busy and leave the others idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def layers(df: DataFrame, layout: str) -> DataFrame:
    """Key-value caches of three layouts as (layer, head, kv, pos, vec).

    ``flat`` has those columns; ``pairs`` has (layer, head, pos, key, value); ``nested`` has (layer, cache) with
    cache of (kv, heads) and heads an array by head of arrays by position.
    """
    names = ["layer", "head", "kv", "pos", "vec"]
    if layout == "flat":
        return df.select(names)
    if layout == "pairs":
        kv = F.explode(F.array(F.struct(F.lit("k").alias("kv"), F.col("key").alias("vec")), F.struct(F.lit("v").alias("kv"), F.col("value").alias("vec"))))
        return df.select("layer", "head", "pos", kv.alias("e")).select("layer", "head", "e.kv", "pos", "e.vec")
    if layout == "nested":
        d = df.select("layer", F.explode("cache").alias("c")).select("layer", "c.kv", F.posexplode("c.heads").alias("head", "h"))
        return d.select("layer", "head", "kv", F.posexplode("h").alias("pos", "vec")).select(names)
    raise ValueError(layout)
