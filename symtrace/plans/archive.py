"""Queries over archives: alphabets, codecs, round trips, random access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.functions.symbols import ring_sizes, with_ids, with_sizes
from symtrace.operators import grid, pack, ring
from symtrace.operators.reports import memory_bytes
from symtrace.sources.corpus import spread, table

long, double = "bigint", "double"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _some(docs: DataFrame) -> DataFrame:
    """Texts with symbols; the others have no rate."""
    return docs.where("length(text) > 0")


def alphabet_stats(spark, sf_dir):
    d = with_ids(_docs(spark, sf_dir))
    return d.select("doc_id", F.col("length").cast(long).alias("length"), F.col("n").cast(long).alias("n"), F.array_join("alphabet", "").alias("alphabet"))


def kissing_ratio(spark, sf_dir):
    d = with_ids(_docs(spark, sf_dir)).where("n > 0").groupBy("n").agg(F.count("*").alias("docs"))
    g = with_sizes(d).withColumn("ring", ring_sizes("n"))
    return g.select(F.col("n").cast(long).alias("n"), "docs", F.round("ring.ratio", 9).alias("ratio"), F.col("ring.span").cast(long).alias("span"), *(F.col(c).cast(long).alias(c) for c in ("cpv", "k", "grid_span")))


def grid_archive(spark, sf_dir):
    r = grid.rows(grid.encode(_docs(spark, sf_dir)))
    return r.select("doc_id", F.col("span_no").cast(long).alias("span_no"), F.col("c").cast(long).alias("c"), "ix", "iy")


def grid_roundtrip(spark, sf_dir):
    docs = _some(_docs(spark, sf_dir))
    # the text travels with its archive, so the comparison needs no join
    d = grid.decode(with_text(grid.encode, docs))
    n = F.size("spans").cast(long)
    return d.select("doc_id", F.col("length").cast(long).alias("length"), F.col("n").cast(long).alias("n"), F.col("k").cast(long).alias("k"), F.col("grid_span").cast(long).alias("grid_span"), n.alias("n_spans"), (n * 16).alias("bytes"), F.round(n * 128 / F.col("length"), 9).alias("bits_per_char"), (F.col("decoded") == F.col("_key.text")).alias("lossless"))


def with_text(encode, docs: DataFrame) -> DataFrame:
    """An archive whose key carries the id and the text."""
    d = encode(docs.select(F.struct("doc_id", "text").alias("_key"), "text"), key="_key")
    return d.withColumn("doc_id", F.col("_key.doc_id"))


def _somewhere(docs: DataFrame) -> DataFrame:
    """A position inside each text."""
    return docs.where("length(text) > 0").select(F.struct("doc_id", F.expr("cast((doc_id * 7919) % length(text) as int)").alias("pos")).alias("_key"), "text")


def _char_at(module, spark, sf_dir):
    a = module.encode(_somewhere(_docs(spark, sf_dir)), key="_key").withColumn("pos", F.col("_key.pos"))
    return module.char_at(a, "pos").select(F.col("_key.doc_id").alias("doc_id"), F.col("pos").cast(long).alias("pos"), "symbol")


def grid_char_at(spark, sf_dir):
    return _char_at(grid, spark, sf_dir)


def pack_archive(spark, sf_dir):
    r = pack.rows(pack.encode(_docs(spark, sf_dir)))
    return r.select("doc_id", F.col("vec_no").cast(long).alias("vec_no"), F.col("c").cast(long).alias("c"), "xi", "yi")


def pack_roundtrip(spark, sf_dir):
    d = pack.decode(with_text(pack.encode, _some(_docs(spark, sf_dir))))
    n = F.size("vectors").cast(long)
    return d.select("doc_id", F.col("n").cast(long).alias("n"), F.col("cpv").cast(long).alias("cpv"), n.alias("n_vectors"), memory_bytes(n, F.col("n")).cast(long).alias("bytes"), F.round(n * 128 / F.col("length"), 9).alias("bits_per_char"), (F.col("decoded") == F.col("_key.text")).alias("lossless"))


def pack_char_at(spark, sf_dir):
    return _char_at(pack, spark, sf_dir)


def pack_append(spark, sf_dir):
    """Each text's second half appended to its first gives the archive of the whole."""
    docs = _docs(spark, sf_dir).withColumn("cut", F.expr("cast(length(text) div 2 as int)"))
    key = F.struct("doc_id", "text", F.expr("substring(text, cut + 1)").alias("more"))
    a = pack.encode(docs.select(key.alias("_key"), F.expr("substring(text, 1, cut)").alias("text")), key="_key").withColumn("more", F.col("_key.more"))
    grown = pack.decode(pack.append(a, "more", key="_key"))
    return grown.select(F.col("_key.doc_id").alias("doc_id"), F.col("length").cast(long).alias("length"), (F.col("decoded") == F.col("_key.text")).alias("lossless"))


def ring_anchors(spark, sf_dir):
    r = ring.anchors(ring.encode(_docs(spark, sf_dir)))
    return r.select("doc_id", F.col("span_no").cast(long).alias("span_no"), F.col("c").cast(long).alias("c"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def ring_roundtrip(spark, sf_dir):
    # the text travels with its archive, so the comparison needs no join
    archive = ring.encode(_docs(spark, sf_dir).select(F.struct("doc_id", "text").alias("_key"), "text"), key="_key")
    got = ring.decode(archive, "_key")
    return got.select("_key.doc_id", F.length("_key.text").cast(long).alias("length"), F.col("n_spans").cast(long).alias("n_spans"), (F.col("decoded") == F.col("_key.text")).alias("lossless"))


def ring_char_at(spark, sf_dir):
    a = ring.encode(_somewhere(_docs(spark, sf_dir)), key="_key").withColumn("pos", F.col("_key.pos"))
    return ring.char_at(a, "pos", key="_key").select(F.col("_key.doc_id").alias("doc_id"), F.col("pos").cast(long).alias("pos"), "symbol")


QUERIES = {f.__name__: f for f in (alphabet_stats, kissing_ratio, grid_archive, grid_roundtrip, grid_char_at, pack_archive, pack_roundtrip, pack_char_at, pack_append, ring_anchors, ring_roundtrip, ring_char_at)}

#: Symbols by position, alphabets and sizes, for DuckDB.
SYMBOLS = """sy AS (SELECT doc_id, unnest(s) AS sym, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS s FROM documents)),
al AS (SELECT doc_id, sym, row_number() OVER (PARTITION BY doc_id ORDER BY sym) - 1 AS id, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, sym FROM sy)),
nn AS (SELECT DISTINCT doc_id, n FROM al),
ge AS (SELECT n, CASE WHEN n <= 4 THEN 0.5::DOUBLE ELSE 1 / (2 * (1 + (SELECT sum(cos(2 * pi() * j / n)) FROM unnest(range(1, n // 4 + 1)) t(j)))) END AS r,
  floor(104 / log2(greatest(n, 2)) + 1e-12)::BIGINT AS cpv, CASE WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 64 THEN 8 WHEN n <= 256 THEN 16 WHEN n <= 1024 THEN 32 ELSE 64 END::BIGINT AS k FROM (SELECT DISTINCT n FROM nn)),
g AS (SELECT n, r, cpv, k, log2(k)::INT AS lg, 51 // log2(k)::BIGINT AS gm, greatest(1, floor(44 / log2(1 / r) + 1e-12))::BIGINT AS m, ceil(80 / log2(1 / r) - 1e-12)::BIGINT AS hist FROM ge),
s AS (SELECT sy.doc_id, pos, sy.sym, id, al.n FROM sy JOIN al USING (doc_id, sym))"""

_CHAR_AT = "SELECT doc_id, ((doc_id * 7919) % length(text))::BIGINT AS pos, substring(text, ((doc_id * 7919) % length(text) + 1)::BIGINT, 1) AS symbol FROM documents WHERE length(text) > 0"

ORACLE_SQL = {
    "alphabet_stats": f"WITH {SYMBOLS} SELECT doc_id, length(text)::BIGINT AS length, coalesce(max(n), 0)::BIGINT AS n, coalesce(string_agg(sym, '' ORDER BY sym), '') AS alphabet FROM documents LEFT JOIN al USING (doc_id) GROUP BY doc_id, text",
    "kissing_ratio": f"WITH {SYMBOLS} SELECT n::BIGINT AS n, count(*)::BIGINT AS docs, round(max(r), 9) AS ratio, max(m)::BIGINT AS span, max(cpv)::BIGINT AS cpv, max(k)::BIGINT AS k, max(gm)::BIGINT AS grid_span FROM nn JOIN g USING (n) GROUP BY n",
    "grid_archive": f"WITH {SYMBOLS} SELECT doc_id, (pos // gm)::BIGINT AS span_no, count(*)::BIGINT AS c, sum((id % k)::BIGINT << (lg * (pos % gm))::BIGINT)::BIGINT AS ix, sum((id // k)::BIGINT << (lg * (pos % gm))::BIGINT)::BIGINT AS iy FROM s JOIN g USING (n) GROUP BY doc_id, pos // gm",
    "grid_roundtrip": f"WITH {SYMBOLS} SELECT doc_id, length(text)::BIGINT AS length, n::BIGINT AS n, k::BIGINT AS k, gm::BIGINT AS grid_span, ceil(length(text) / gm)::BIGINT AS n_spans, (16 * ceil(length(text) / gm))::BIGINT AS bytes, round(128 * ceil(length(text) / gm) / length(text), 9) AS bits_per_char, true AS lossless FROM documents JOIN nn USING (doc_id) JOIN g USING (n)",
    "grid_char_at": _CHAR_AT,
    "pack_archive": f"WITH {SYMBOLS}, v AS (SELECT doc_id, pos // cpv AS vec_no, count(*) AS c, list_reduce(list(id::HUGEINT ORDER BY pos DESC), lambda a, x: a * greatest(max(n), 2)::HUGEINT + x) AS v FROM s JOIN g USING (n) GROUP BY doc_id, pos // cpv) SELECT doc_id, vec_no::BIGINT AS vec_no, c::BIGINT AS c, (v % 4503599627370496)::BIGINT AS xi, (v // 4503599627370496)::BIGINT AS yi FROM v",
    "pack_roundtrip": f"WITH {SYMBOLS} SELECT doc_id, n::BIGINT AS n, cpv::BIGINT AS cpv, ceil(length(text) / cpv)::BIGINT AS n_vectors, (16 * ceil(length(text) / cpv) + 8 + n)::BIGINT AS bytes, round(128 * ceil(length(text) / cpv) / length(text), 9) AS bits_per_char, true AS lossless FROM documents JOIN nn USING (doc_id) JOIN g USING (n)",
    "pack_char_at": _CHAR_AT,
    "pack_append": "SELECT doc_id, length(text)::BIGINT AS length, true AS lossless FROM documents",
    "ring_anchors": f"""WITH {SYMBOLS}, e AS (SELECT doc_id, n, pos // m AS span_no, count(*) AS c, max(pos) AS last FROM s JOIN g USING (n) GROUP BY doc_id, n, pos // m),
t AS (SELECT e.doc_id, span_no, c, n, last, unnest(range(0, least(last + 1, hist))) AS j, r FROM e JOIN g USING (n))
SELECT t.doc_id, span_no::BIGINT AS span_no, c::BIGINT AS c, round(sum((1 - r) * pow(r, j) * cos(pi() / 2 - 2 * pi() * id / t.n)), 6) + 0.0::DOUBLE AS x, round(sum((1 - r) * pow(r, j) * sin(pi() / 2 - 2 * pi() * id / t.n)), 6) + 0.0::DOUBLE AS y
FROM t JOIN s ON s.doc_id = t.doc_id AND s.pos = t.last - t.j GROUP BY t.doc_id, span_no, c""",
    "ring_roundtrip": f"WITH {SYMBOLS} SELECT doc_id, length(text)::BIGINT AS length, ceil(length(text) / m)::BIGINT AS n_spans, true AS lossless FROM documents JOIN nn USING (doc_id) JOIN g USING (n)",
    "ring_char_at": _CHAR_AT,
}
