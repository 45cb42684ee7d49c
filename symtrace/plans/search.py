"""Queries over stored points: walks, substrings, radius joins, nearest points, decay with common suffixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.functions.symbols import grid_side, kissing_ratio
from symtrace.operators import retrieval as R
from symtrace.sources.corpus import spread, table

long = "bigint"
LENGTHS = R.LENGTHS


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _queries(spark: SparkSession, sf_dir: str, lengths=LENGTHS) -> DataFrame:
    """One substring of each benchmark item and length."""
    b = table(spark, sf_dir, "benchmark").withColumn("q", F.explode(F.array(*map(F.lit, lengths)))).where("length(text) >= q")
    return b.select((F.col("item_id") * 100 + F.col("q")).alias("query_id"), F.expr("substring(text, cast((item_id * 13) % (length(text) - q + 1) as int) + 1, q)").alias("query"))


def walk_points(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    w = R.walk_index(docs, R.corpus_alphabet(docs), "ring")
    return w.groupBy("doc_id").agg(F.count("*").alias("points"), (F.round(F.sum("x"), 4) + 0.0).alias("sum_x"), (F.round(F.sum("y"), 4) + 0.0).alias("sum_y"))


def _counted(q, pairs, n: str):
    """Sums and numbers of documents of (query_id, doc_id, n)."""
    c = pairs.groupBy("query_id").agg(F.sum(n).alias(n), F.countDistinct("doc_id").alias("n_docs"))
    return q.join(c, "query_id", "left").na.fill(0, [n, "n_docs"])


def substring_truth(spark, sf_dir):
    q = _queries(spark, sf_dir)
    return _counted(q, R.occurrence_counts(_docs(spark, sf_dir), q), "n_true").select("query_id", "query", "n_true", "n_docs")


def _radius_search(spark, sf_dir, kind: str):
    docs = _docs(spark, sf_dir)
    alphabet = R.corpus_alphabet(docs)
    q = _queries(spark, sf_dir)
    found = R.radius_counts(docs, R.query_points(q, alphabet, kind), alphabet, kind)
    return _counted(q, found, "n_found").select("query_id", "n_found", "n_docs")


def radius_search_ring(spark, sf_dir):
    return _radius_search(spark, sf_dir, "ring")


def radius_search_grid(spark, sf_dir):
    return _radius_search(spark, sf_dir, "grid")


def _precision(spark, sf_dir, kind: str, precision: str = "f64"):
    docs = _docs(spark, sf_dir)
    return R.precision_counts(docs, _queries(spark, sf_dir), R.corpus_alphabet(docs), kind, precision)


def index_precision_f32(spark, sf_dir):
    """Recall of substrings when points are kept at 32 bits."""
    r = _precision(spark, sf_dir, "ring", "f32")
    return r.groupBy(F.col("q").cast(long).alias("q")).agg(F.sum("n_true").cast(long).alias("n_true"), F.sum("n_both").cast(long).alias("n_both"))


def index_precision_f16(spark, sf_dir):
    """As at 32 bits, with 16; what a radius this wide finds is not exact, so there is no SQL for it."""
    r = _precision(spark, sf_dir, "ring", "f16")
    return r.groupBy(F.col("q").cast(long).alias("q")).agg(F.sum("n_found").cast(long).alias("n_found"), F.sum("n_true").cast(long).alias("n_true"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def retrieval_pr(spark, sf_dir):
    out = None
    for kind in ("ring", "grid"):
        r = _precision(spark, sf_dir, kind)
        one = r.groupBy("q").agg(F.count("*").alias("queries"), F.sum("n_true").cast(long).alias("n_true"), F.avg("recall").alias("recall"))
        one = one.select(F.lit(kind).alias("kind"), F.col("q").cast(long).alias("q"), "queries", "n_true", F.round("recall", 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def nearest_point(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    alphabet = R.corpus_alphabet(docs)
    got = R.nearest_in_texts(docs, R.query_points(_queries(spark, sf_dir, (12,)), alphabet, "ring"), alphabet, "ring")
    return got.select("query_id", F.round(F.sqrt("d2"), 9).alias("distance"))


def decay_law(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    alphabet = R.corpus_alphabet(docs)
    r = kissing_ratio(max(len(alphabet), 1))
    got = R.decay(docs, alphabet, "ring", 2 * F.pow(F.lit(r), F.col("suffix")))
    # the median of distances near rounding says nothing, so distances are given in ratios of the bound
    return got.select(F.col("suffix").cast(long).alias("suffix"), "n", F.round(F.col("median_distance") / F.col("theory"), 4).alias("of_bound"))


def hop_context(spark, sf_dir):
    """Up to 40 symbols before the first occurrence of each 12-symbol query, decoded from stored points."""
    docs = _docs(spark, sf_dir)
    alphabet = R.corpus_alphabet(docs)
    q = _queries(spark, sf_dir, (12,))
    hits = R.occurrences(docs, q).groupBy("query_id").agg(F.min(F.struct("doc_id", "pos")).alias("h")).select("query_id", "h.doc_id", "h.pos")
    own = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return R.contexts(hits, own, alphabet, max(1, int(40 / math.log2(1 / kissing_ratio(len(alphabet))))))


def decay_grid(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    alphabet = R.corpus_alphabet(docs)
    k = grid_side(len(alphabet))
    got = R.decay(docs, alphabet, "grid", math.sqrt(2) * F.pow(F.lit(1.0 / k), F.col("suffix")), cap=24, keep_zero=True)
    return got.select(F.col("suffix").cast(long).alias("suffix"), "n", (F.col("median_distance") <= F.col("theory")).alias("within_bound"))


QUERIES = {f.__name__: f for f in (walk_points, substring_truth, radius_search_ring, radius_search_grid, retrieval_pr, index_precision_f32, index_precision_f16, nearest_point, decay_law, decay_grid, hop_context)}

_CORPUS = """sy AS (SELECT doc_id, unnest(s) AS sym, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS s FROM documents)),
al AS (SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT sym FROM sy)),
g AS (SELECT n, CASE WHEN n <= 4 THEN 0.5::DOUBLE ELSE 1 / (2 * (1 + (SELECT sum(cos(2 * pi() * j / n)) FROM unnest(range(1, n // 4 + 1)) t(j)))) END AS r, CASE WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 64 THEN 8 WHEN n <= 256 THEN 16 WHEN n <= 1024 THEN 32 ELSE 64 END AS k FROM (SELECT DISTINCT n FROM al)),
v AS (SELECT al.id, sym, cos(pi() / 2 - 2 * pi() * id / al.n) AS vx, sin(pi() / 2 - 2 * pi() * id / al.n) AS vy, id % k AS gx, id // k AS gy, r, k FROM al, g),
c AS (SELECT doc_id, pos, v.* FROM sy JOIN v USING (sym))"""
_QUERIES = "q AS (SELECT item_id * 100 + l AS query_id, l AS q, substring(text, ((item_id * 13) % (length(text) - l + 1) + 1)::BIGINT, l) AS query FROM benchmark, unnest([3, 4, 6, 8, 12]) t(l) WHERE length(text) >= l)"
_WINDOWED = """ring AS (SELECT doc_id, pos, {x} AS x, {y} AS y FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_BACK = 14
_LAGS = lambda v: " + ".join(f"(1 - r) * pow(r, {j}) * coalesce(lag({v}, {j}) OVER w, 0)" for j in range(_BACK))
_RING = _WINDOWED.format(x=_LAGS("vx"), y=_LAGS("vy"))
_LEADS = lambda l: " || ".join(["sym", *(f"lead(sym, {j}) OVER w" for j in range(1, l))])
_GRAMS = "ss AS (SELECT doc_id, unnest(s) AS sym, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS s FROM documents)), gr AS (SELECT doc_id, pos, " + ", ".join(f"{_LEADS(l)} AS g{l}" for l in LENGTHS) + " FROM ss WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), oc AS (" + " UNION ALL ".join(f"SELECT query_id, doc_id, pos + {l - 1} AS pos FROM gr JOIN q ON q.q = {l} AND q.query = g{l}" for l in LENGTHS) + ")"
_RQ = "rq AS (SELECT query_id, q, sum((1 - r) * pow(r, q - j) * vx) AS qx, sum((1 - r) * pow(r, q - j) * vy) AS qy, 2 * pow(max(r), q) + 1e-12 AS tau, count(*) AS m FROM (SELECT query_id, q, unnest(range(1, q + 1)) AS j, query FROM q) e JOIN v ON v.sym = substring(query, j::BIGINT, 1) GROUP BY query_id, q HAVING count(*) = q)"

ORACLE_SQL = {
    "walk_points": f"WITH {_CORPUS}, {_RING} SELECT doc_id, count(*)::BIGINT AS points, round(sum(x), 4) + 0.0::DOUBLE AS sum_x, round(sum(y), 4) + 0.0::DOUBLE AS sum_y FROM ring GROUP BY doc_id",
    "substring_truth": f"WITH {_QUERIES}, {_GRAMS} SELECT query_id::BIGINT AS query_id, query, count(doc_id)::BIGINT AS n_true, count(DISTINCT doc_id)::BIGINT AS n_docs FROM q LEFT JOIN oc USING (query_id) GROUP BY query_id, query",
    "radius_search_ring": f"WITH {_CORPUS}, {_QUERIES}, {_RING}, {_RQ}, f AS (SELECT query_id, doc_id, pos FROM ring, rq WHERE x BETWEEN qx - tau AND qx + tau AND (x - qx) * (x - qx) + (y - qy) * (y - qy) <= tau * tau) SELECT q.query_id::BIGINT AS query_id, count(doc_id)::BIGINT AS n_found, count(DISTINCT doc_id)::BIGINT AS n_docs FROM q LEFT JOIN f USING (query_id) GROUP BY q.query_id",
    "retrieval_pr": f"WITH {_QUERIES}, {_GRAMS}, t AS (SELECT q.query_id, q, count(doc_id) AS n FROM q LEFT JOIN oc USING (query_id) GROUP BY q.query_id, q) SELECT kind, q::BIGINT AS q, count(*)::BIGINT AS queries, sum(n)::BIGINT AS n_true, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM t, unnest(['ring', 'grid']) k(kind) GROUP BY kind, q",
    "index_precision_f32": f"WITH {_QUERIES}, {_GRAMS} SELECT q::BIGINT AS q, count(doc_id)::BIGINT AS n_true, count(doc_id)::BIGINT AS n_both FROM q LEFT JOIN oc USING (query_id) GROUP BY q",
    "nearest_point": f"WITH {_CORPUS}, {_QUERIES}, {_RING}, {_RQ} SELECT query_id::BIGINT AS query_id, round(sqrt(min((x - qx) * (x - qx) + (y - qy) * (y - qy))), 9) AS distance FROM ring, rq WHERE q = 12 GROUP BY query_id",
}
