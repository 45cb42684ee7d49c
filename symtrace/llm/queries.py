"""The registered queries: one thin query for each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.llm.common import table
from symtrace.llm.decontaminate import decontaminate
from symtrace.llm.exact_dedup import exact_dedup
from symtrace.llm.licenses import licenses
from symtrace.llm.mixing import mixture
from symtrace.llm.ngram_join import ngram_join
from symtrace.llm.quality import quality_scores
from symtrace.llm.secrets import KINDS, secrets
from symtrace.llm.substring_dedup import repeats
from symtrace.llm.toxicity import toxicity_scores
from symtrace.llm.warc import round_trip


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=(3, 1))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    # a phrase alone is worth a half, a notice what it covers
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(best, F.when(F.size("places") > 0, 0.5).otherwise(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), score.alias("score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line", "first", "last", "n_words", "cluster", "occurrences", "keep_doc_id", "removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=(4, 2))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"), least=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_mixing, op4_secrets, op5_exact_dedup, op6_licenses, op7_substring_dedup, op8_toxicity, op9_ngram_join, op10_warc)}

#: DuckDB SQL. White space and words are cut by the same patterns; A-Z alone are lower-cased.
ORACLE_SQL = {
    "op2_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS key
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT place, p, size, array_to_string(w[p : p + size - 1], ' ') AS key
       FROM (SELECT place, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT place, p, dw.size, item_id FROM dw JOIN bw ON dw.key = bw.key AND dw.size = bw.size),
h AS (SELECT place, count(DISTINCT q) AS n_hit FROM (SELECT place, unnest(range(p, p + size)) AS q FROM m) GROUP BY place),
i AS (SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT place, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (place) LEFT JOIN i USING (place)""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, place)""",
    "op9_ngram_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT place, array_to_string(w[p : p + 4], ' ') AS shingle FROM (SELECT place, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT place, count(*) AS n FROM s GROUP BY place),
b AS (SELECT x.place AS a, y.place AS b, count(*) AS m FROM s x JOIN s y USING (shingle) WHERE x.place <> y.place GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.place = a JOIN n y ON y.place = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r(place, seen) AS (SELECT place, place FROM n UNION SELECT r.place, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT r.place, min(d.doc_id) AS component_id FROM r JOIN d ON d.place = r.seen GROUP BY r.place)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (place) LEFT JOIN c USING (place)""",
    "op10_warc": r"""
WITH p AS (SELECT row_number() OVER () AS place, page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT place, array_to_string(list_transform(range(1, 41), lambda j: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', h[j])]), '') AS bits FROM p),
e AS (SELECT place, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1)), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN row_number() OVER g = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN row_number() OVER g > 1 THEN first_value(page_id) OVER g END AS refers_to
FROM p JOIN e USING (place) WINDOW g AS (PARTITION BY h ORDER BY page_id NULLS LAST, p.place)""",
}
