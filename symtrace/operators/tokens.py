"""Token histories: tokens joined by U+001F into one text, with each token's offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def tokens(df: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """(key, tok_no, token): white-space tokens of a key's rows in their order, numbered from 0."""
    words = df.select(key, *order, F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda x: x != "")).alias("_i", "token"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order, "_i")) - 1
    return words.select(key, n.alias("tok_no"), "token")


def offsets(toks: DataFrame, key: str) -> DataFrame:
    """Adds start_off and end_off: a token follows its predecessor and one separator."""
    before = Window.partitionBy(key).orderBy("tok_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0))
    return toks.withColumn("start_off", start).withColumn("end_off", F.col("start_off") + F.length("token"))


def history(toks: DataFrame, key: str) -> DataFrame:
    """(key, text, n_tokens): the joined text of each key; a key's history is one row by definition."""
    g = toks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tok_no", "token"))).alias("t"), F.count("*").alias("n_tokens"))
    return g.select(key, F.array_join(F.transform("t", lambda x: x["token"]), SEPARATOR).alias("text"), "n_tokens")


def token_at(histories: DataFrame, offs: DataFrame, key: str) -> DataFrame:
    """(key, tok_no, token): tokens cut out of the history by their offsets."""
    j = offs.join(histories.select(key, "text"), key)
    return j.select(key, "tok_no", F.expr("substring(text, cast(start_off as int) + 1, cast(end_off - start_off as int))").alias("token"))


def all_tokens(histories: DataFrame, key: str) -> DataFrame:
    """(key, tok_no, token): the history split at separators."""
    return histories.select(key, F.posexplode(F.split("text", SEPARATOR)).alias("tok_no", "token"))


def memory(histories: DataFrame, archive_bytes: str, key: str) -> DataFrame:
    """(key, raw_chars, stored_bytes): characters of the history; payload and 4 bytes for each offset."""
    return histories.select(key, F.length("text").alias("raw_chars"), (F.col(archive_bytes) + 4 * F.col("n_tokens")).alias("stored_bytes"))
