"""Queries over code lengths, damage, vectors, token histories and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.operators import damage, pack, quantize, rates, reports, tokens
from symtrace.plans.archive import SYMBOLS
from symtrace.sources.corpus import spread, table

long = "bigint"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def ngram_rate(spark, sf_dir):
    r = rates.ngram_rate(_docs(spark, sf_dir))
    return r.select("doc_id", F.col("ord").cast(long).alias("ord"), "symbols", F.round("bits", 4).alias("bits"), F.round("bpc", 6).alias("bpc"))


def order0_model(spark, sf_dir):
    return rates.order0_model(_docs(spark, sf_dir)).select("doc_id", "sym", "cnt", "cum_lo", "cum_hi", "total")


def ideal_bits(spark, sf_dir):
    b = rates.ideal_bits(rates.order0_model(_docs(spark, sf_dir)))
    return b.select("doc_id", F.col("symbols").cast(long).alias("symbols"), F.round("bits", 4).alias("bits"), F.round("uniform_bits", 4).alias("uniform_bits"))


def perplexity_halves(spark, sf_dir):
    nll = rates.ngram_bits(_docs(spark, sf_dir), orders=(1,)).withColumn("nll", F.col("bits") * math.log(2))
    p = rates.perplexities(nll)
    return p.select("doc_id", "n", *(F.round(c, 4).alias(c) for c in ("ppl", "first_ppl", "last_ppl")))


def _damaged(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.translate("text", "aeiou", "*****").alias("recovered"))


def damage_regions(spark, sf_dir):
    r = damage.regions(damage.compared(_damaged(spark, sf_dir)))
    return r.select("doc_id", "symbols", "wrong", "regions", F.col("first_bad").cast(long).alias("first_bad"), F.col("last_bad").cast(long).alias("last_bad"))


def damage_map(spark, sf_dir):
    return damage.damage_map(damage.compared(_damaged(spark, sf_dir)))


def bit_allocation(spark, sf_dir):
    s = _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", F.explode(F.expr("sequence(0, cast((length(text) - 1) div 240 as int))")).alias("span_no"))
    for p in ("uniform", "ramp", "window"):
        s = damage.allocation(s, p).withColumnRenamed("bits", p)
    return s.select("doc_id", *(F.col(c).cast(long).alias(c) for c in ("span_no", "uniform", "ramp", "window")))


def interval_coder_lossy(spark, sf_dir):
    """Errors of exact points cut to some bits; unbounded rationals have no SQL."""
    return rates.interval_sweep(_docs(spark, sf_dir)).groupBy("reverse", "bits").agg(F.count("*").alias("blocks"), F.sum("wrong").alias("wrong"), F.bool_and("lossless").alias("lossless"))


def zlib_size(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rates.zlib_size("text").alias("bytes"), F.round(rates.zlib_size("text") * 8 / F.length("text"), 6).alias("bits_per_char"))


def lzma_size(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rates.lzma_size("text").alias("bytes"))


# ------------------------------------------------------------------ vectors


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast(long).alias("label"), F.expr("transform(embedding, x -> cast(x as double))").alias("vec"))


def _books(v: DataFrame, stages: int = 2, k: int = 8) -> DataFrame:
    """Fixed books: the first k vectors of a label, and for later stages the next k, scaled down."""
    all_ = quantize.first_books(v, ["label"], k * stages, "vec_id")
    stage = (F.col("cid") / k).cast("int") + 1
    return all_.withColumn("stage", stage).withColumn("centroid", F.expr(f"transform(centroid, x -> x / cast(pow(4, cast(cid / {k} as int)) as double))")).withColumn("cid", (F.col("cid") % k).cast("int"))


def vq_assign(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = quantize.assign(v, _books(v, 1).drop("stage"), ["label"])
    return got.select("vec_id", "label", F.col("cid").cast(long).alias("cid"), F.round(quantize.squared_error("vec", "centroid"), 6).alias("error"))


def rvq_reconstruct(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    books = _books(v)
    out = None
    for stages in (1, 2):
        q = quantize.quantize(v, books, ["label"], stages).withColumn("e", quantize.squared_error())
        one = q.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mse")).select(F.lit(stages).cast(long).alias("stages"), "label", "n", "mse")
        out = one if out is None else out.unionByName(one)
    return out


def rvq_hybrid(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("kv", F.when(F.col("vec_id") % 2 == 0, "k").otherwise("v"))
    q = quantize.quantize(v, _books(v), ["label"], F.when(F.col("kv") == "k", 2).otherwise(1)).withColumn("e", quantize.squared_error())
    return q.groupBy("kv").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mse"), F.sum(F.size("ids")).cast(long).alias("ids"))


def _placed(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    v = _vectors(spark, sf_dir)
    return v.withColumn("pos", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("last", F.count("*").over(w) - 2)


def exact_window(spark, sf_dir):
    p = _placed(spark, sf_dir).withColumn("archived", quantize.archived(4, 32))
    return p.select("vec_id", "label", F.col("pos").cast(long).alias("pos"), "archived")


def storage_report(spark, sf_dir):
    p = _placed(spark, sf_dir).where(quantize.archived(4, 32))
    ids = quantize.quantize(p, _books(_vectors(spark, sf_dir)), ["label"], 2).select("label", "pos", F.posexplode("ids").alias("stage", "id"))
    s = quantize.storage(ids, 8, 35, ["label"], "pos")
    return s.select("label", *(F.col(c).cast(long).alias(c) for c in ("ids", "tokens", "walk_bytes", "packed_bytes")), F.round("walk_bpt", 6).alias("walk_bpt"), F.round("packed_bpt", 6).alias("packed_bpt"))


def kmeans_train(spark, sf_dir):
    """Trained books, and what they make of all vectors: distortion of each stage; seeding is random, so there is no SQL."""
    v = _vectors(spark, sf_dir)
    books = quantize.train(v, ["label"], 8, stages=2)
    out = None
    for stages in (1, 2):
        one = quantize.quantize(v, books, ["label"], stages).withColumn("e", quantize.squared_error()).groupBy("label").agg(F.count("*").alias("n"), F.avg("e").alias("mse")).withColumn("stages", F.lit(stages))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ tokens and reports


def _tokens(spark, sf_dir):
    return tokens.tokens(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])


def token_offsets(spark, sf_dir):
    o = tokens.offsets(_tokens(spark, sf_dir), "conv_id")
    return o.select("conv_id", F.col("tok_no").cast(long).alias("tok_no"), "token", F.col("start_off").cast(long).alias("start_off"), F.col("end_off").cast(long).alias("end_off"))


def token_at(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    h = tokens.history(t, "conv_id")
    got = tokens.token_at(h, tokens.offsets(t, "conv_id"), "conv_id")
    return got.select("conv_id", F.col("tok_no").cast(long).alias("tok_no"), "token")


def history_memory(spark, sf_dir):
    h = tokens.history(_tokens(spark, sf_dir), "conv_id")
    a = pack.encode(h, key="conv_id").select("conv_id", reports.memory_bytes(F.size("vectors"), F.col("n")).alias("payload"))
    m = tokens.memory(h.join(a, "conv_id"), "payload", "conv_id")
    return m.select("conv_id", F.col("raw_chars").cast(long).alias("raw_chars"), F.col("stored_bytes").cast(long).alias("stored_bytes"))


def semantic_separation(spark, sf_dir):
    """First vectors of benchmark items, grouped by id; items don't mean more than their symbols, so groups don't separate."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    first = pack.rows(pack.encode(b)).where("vec_no = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("grp"), "x", "y")
    return reports.separation(first)


def kv_footprint(spark, sf_dir):
    return reports.kv_footprint(spark).select("model", "bytes_per_token")


def pareto_ratio(spark, sf_dir):
    return reports.pareto(spark).select("label", F.col("bytes_per_token").cast(long).alias("bytes_per_token"), "ppl_pct", "family", F.round("ratio", 6).alias("ratio"))


def cell_geometry(spark, sf_dir):
    c = reports.cells(spark)
    return c.select(F.col("n").cast(long).alias("n"), "kind", F.col("cell").cast(long).alias("cell"), F.col("corner").cast(long).alias("corner"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), F.round("coverage", 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (ngram_rate, order0_model, ideal_bits, perplexity_halves, damage_regions, damage_map, bit_allocation, interval_coder_lossy, zlib_size, lzma_size, vq_assign, rvq_reconstruct, rvq_hybrid, exact_window, storage_report, kmeans_train, token_offsets, token_at, history_memory, semantic_separation, kv_footprint, pareto_ratio, cell_geometry)}

_BITS = """b AS (SELECT doc_id, pos, ord, -log2(row_number() OVER (PARTITION BY doc_id, ord, ctx, sym ORDER BY pos) / (row_number() OVER (PARTITION BY doc_id, ord, ctx ORDER BY pos) - 1 + n)) AS bits
FROM (SELECT doc_id, pos, sym, n, ord, concat(CASE WHEN ord > 5 THEN p6 END, CASE WHEN ord > 4 THEN p5 END, CASE WHEN ord > 3 THEN p4 END, CASE WHEN ord > 2 THEN p3 END, CASE WHEN ord > 1 THEN p2 END, CASE WHEN ord > 0 THEN p1 END) AS ctx
FROM (SELECT doc_id, pos, sym, n, lag(sym, 1) OVER w AS p1, lag(sym, 2) OVER w AS p2, lag(sym, 3) OVER w AS p3, lag(sym, 4) OVER w AS p4, lag(sym, 5) OVER w AS p5, lag(sym, 6) OVER w AS p6 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), unnest([0, 1, 2, 3, 4, 5, 6]) t(ord)))"""
_MARKS = "mk AS (SELECT doc_id, pos, sym IN ('a', 'e', 'i', 'o', 'u') AS bad FROM sy)"
_VEC = """v AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) - 2 AS last FROM embeddings),
b1 AS (SELECT label, pos AS cid, vec AS c FROM v WHERE pos < 8), b2 AS (SELECT label, pos - 8 AS cid, list_transform(vec, lambda x: x / 4) AS c FROM v WHERE pos >= 8 AND pos < 16),
q1 AS (SELECT vec_id, v.label, pos, last, vec, arg_min(cid, (d, cid)) AS cid, arg_min(c, (d, cid)) AS c FROM (SELECT v.*, cid, c, list_dot_product(c, c) - 2 * list_dot_product(c, vec) AS d FROM v JOIN b1 USING (label)) v GROUP BY ALL),
r1 AS (SELECT vec_id, label, pos, last, vec, cid, c AS rec1, list_transform(list_zip(vec, c), lambda z: z[1] - z[2]) AS rest FROM q1),
q2 AS (SELECT vec_id, label, pos, last, vec, rec1, rest, arg_min(c, (d, cid2)) AS c FROM (SELECT r1.vec_id, r1.label, pos, last, vec, rec1, rest, b2.cid AS cid2, c, list_dot_product(c, c) - 2 * list_dot_product(c, rest) AS d FROM r1 JOIN b2 USING (label)) GROUP BY ALL),
e AS (SELECT vec_id, label, pos, last, list_dot_product(rest, rest) AS e1, list_sum(list_transform(list_zip(rest, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS e2 FROM q2)"""
_TOKENS = r"tk AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS tok_no, token FROM (SELECT conv_id, turn, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS t FROM conversations)))"

ORACLE_SQL = {
    "ngram_rate": f"WITH {SYMBOLS}, {_BITS} SELECT doc_id, ord::BIGINT AS ord, count(*)::BIGINT AS symbols, round(sum(bits), 4) AS bits, round(sum(bits) / count(*), 6) AS bpc FROM b GROUP BY doc_id, ord",
    "order0_model": f"WITH {SYMBOLS} SELECT doc_id, sym, cnt::BIGINT AS cnt, (sum(cnt) OVER w - cnt)::BIGINT AS cum_lo, (sum(cnt) OVER w)::BIGINT AS cum_hi, (sum(cnt) OVER (PARTITION BY doc_id))::BIGINT AS total FROM (SELECT doc_id, sym, count(*) AS cnt FROM sy GROUP BY doc_id, sym) WINDOW w AS (PARTITION BY doc_id ORDER BY sym)",
    "ideal_bits": f"WITH {SYMBOLS}, c AS (SELECT doc_id, sym, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM sy GROUP BY doc_id, sym) SELECT doc_id, sum(cnt)::BIGINT AS symbols, round(sum(cnt * -log2(cnt / total)), 4) + 0.0::DOUBLE AS bits, round(sum(cnt) * log2(count(*)), 4) AS uniform_bits FROM c GROUP BY doc_id",
    "perplexity_halves": f"WITH {SYMBOLS}, {_BITS}, l AS (SELECT doc_id, pos, bits * ln(2) AS nll, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE ord = 1) SELECT doc_id, n::BIGINT AS n, round(exp(avg(nll)), 4) AS ppl, round(exp(avg(nll) FILTER (pos < n // 2)), 4) AS first_ppl, round(exp(avg(nll) FILTER (pos >= n // 2)), 4) AS last_ppl FROM l GROUP BY doc_id, n",
    "damage_regions": f"WITH {SYMBOLS}, {_MARKS}, st AS (SELECT doc_id, pos, bad, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY doc_id ORDER BY pos), false) AS first FROM mk) SELECT doc_id, count(*)::BIGINT AS symbols, count(*) FILTER (bad)::BIGINT AS wrong, count(*) FILTER (first)::BIGINT AS regions, coalesce(min(pos) FILTER (bad), -1)::BIGINT AS first_bad, coalesce(max(pos) FILTER (bad), -1)::BIGINT AS last_bad FROM st GROUP BY doc_id",
    "damage_map": f"WITH {SYMBOLS}, {_MARKS}, bk AS (SELECT doc_id, pos // greatest(1, count(*) OVER (PARTITION BY doc_id) // 72) AS bucket, bad FROM mk), cc AS (SELECT doc_id, bucket, CASE WHEN count(*) FILTER (bad) > count(*) // 2 THEN 'X' WHEN count(*) FILTER (bad) > 0 THEN 'x' ELSE '.' END AS c FROM bk GROUP BY doc_id, bucket) SELECT doc_id, string_agg(c, '' ORDER BY bucket) AS map FROM cc GROUP BY doc_id",
    "bit_allocation": "WITH sp AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // 240 + 1)) AS span_no FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, span_no, count(*) OVER (PARTITION BY doc_id) AS n FROM sp) SELECT doc_id, span_no::BIGINT AS span_no, (1400 // n)::BIGINT AS uniform, greatest(8, (1400 * (span_no + 1)) // (n * (n + 1) // 2))::BIGINT AS ramp, CASE WHEN span_no >= n - 3 THEN 900 ELSE 60 END::BIGINT AS window FROM w",
    "vq_assign": f"WITH {_VEC} SELECT vec_id, label, cid::BIGINT AS cid, round(e1, 6) AS error FROM r1 JOIN e USING (vec_id, label)",
    "rvq_reconstruct": f"WITH {_VEC} SELECT 1::BIGINT AS stages, label, count(*)::BIGINT AS n, round(avg(e1), 6) AS mse FROM e GROUP BY label UNION ALL SELECT 2, label, count(*), round(avg(e2), 6) FROM e GROUP BY label",
    "rvq_hybrid": f"WITH {_VEC} SELECT CASE WHEN vec_id % 2 = 0 THEN 'k' ELSE 'v' END AS kv, count(*)::BIGINT AS n, round(avg(CASE WHEN vec_id % 2 = 0 THEN e2 ELSE e1 END), 6) AS mse, sum(CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS ids FROM e GROUP BY 1",
    "exact_window": f"WITH {_VEC} SELECT vec_id, label, pos::BIGINT AS pos, pos >= 4 AND pos <= last - 32 AS archived FROM v",
    "storage_report": f"WITH {_VEC}, a AS (SELECT label, count(*) AS t FROM v WHERE pos >= 4 AND pos <= last - 32 GROUP BY label) SELECT label, (2 * t)::BIGINT AS ids, t::BIGINT AS tokens, (ceil(2 * t / 35) * 16)::BIGINT AS walk_bytes, ceil(2 * t * 3 / 8)::BIGINT AS packed_bytes, round(ceil(2 * t / 35) * 16 / t, 6) AS walk_bpt, round(ceil(2 * t * 3 / 8) / t, 6) AS packed_bpt FROM a",
    "token_offsets": f"WITH {_TOKENS} SELECT conv_id, tok_no::BIGINT AS tok_no, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY conv_id ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_off, (sum(length(token) + 1) OVER (PARTITION BY conv_id ORDER BY tok_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS end_off FROM tk",
    "token_at": f"WITH {_TOKENS} SELECT conv_id, tok_no::BIGINT AS tok_no, token FROM tk",
    "history_memory": f"WITH {_TOKENS}, h AS (SELECT conv_id, string_agg(token, chr(31) ORDER BY tok_no) AS text, count(*) AS t FROM tk GROUP BY conv_id), a AS (SELECT conv_id, length(text) AS len, t, len(list_distinct(regexp_extract_all(text, '(?s).'))) AS n FROM h) SELECT conv_id, len::BIGINT AS raw_chars, (16 * ceil(len / floor(104 / log2(greatest(n, 2)) + 1e-12)) + 8 + n + 4 * t)::BIGINT AS stored_bytes FROM a",
    "semantic_separation": f"WITH {SYMBOLS.replace('doc_id, regexp_extract_all(text', 'item_id AS doc_id, regexp_extract_all(text').replace('FROM documents', 'FROM benchmark')}, f AS (SELECT doc_id AS id, doc_id % 3 AS grp, list_reduce(list(id::HUGEINT ORDER BY pos DESC), lambda a, x: a * greatest(max(n), 2)::HUGEINT + x) AS v FROM s JOIN g USING (n) WHERE pos < cpv GROUP BY doc_id), p AS (SELECT id, grp, (v % 4503599627370496)::DOUBLE / 4503599627370496::DOUBLE AS x, (v // 4503599627370496)::DOUBLE / 4503599627370496::DOUBLE AS y FROM f), d AS (SELECT a.grp = b.grp AS same, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id < b.id), m AS (SELECT avg(d) FILTER (same) AS intra, avg(d) FILTER (NOT same) AS inter FROM d) SELECT round(intra, 4) AS intra, round(inter, 4) AS inter, round(inter / intra, 2) AS ratio, inter / intra > 2 AS separates FROM m",
    "kv_footprint": "SELECT model, (l * h * d * 4)::BIGINT AS bytes_per_token FROM (VALUES ('gpt2', 12, 12, 64), ('llama-3.1-8b', 32, 8, 128), ('llama-3.1-70b', 80, 8, 128)) t(model, l, h, d)",
    "pareto_ratio": "SELECT label, b::BIGINT AS bytes_per_token, p::DOUBLE AS ppl_pct, family, round(36864::DOUBLE / b, 6) AS ratio FROM (VALUES ('pooled VQ k=256', 342, 51.0, 'pooled'), ('pooled VQ k=1024', 445, 38.1, 'pooled'), ('pooled RVQ 256x2', 684, 37.2, 'pooled'), ('pooled RVQ 1024x2', 889, 29.2, 'pooled'), ('per-head VQ k=256', 342, 23.7, 'per-head'), ('per-head RVQ 256x2', 684, 15.0, 'per-head'), ('hybrid K x4, V x2', 1025, 11.2, 'hybrid')) t(label, b, p, family)",
    "cell_geometry": "WITH c AS (SELECT n, kind, CASE WHEN kind = 'given' THEN 0.5::DOUBLE ELSE 1 / (2 * (1 + (SELECT sum(cos(2 * pi() * j / 24)) FROM unnest(range(1, 7)) t(j)))) END AS r FROM (VALUES (3, 'given'), (4, 'given'), (6, 'given'), (24, 'given'), (24, 'kissing')) t(n, kind)) SELECT n::BIGINT AS n, kind, i::BIGINT AS cell, j::BIGINT AS corner, round(cos(pi() / 2 - 2 * pi() * i / n) + r * (cos(pi() / 2 - 2 * pi() * j / n) - cos(pi() / 2 - 2 * pi() * i / n)), 6) + 0.0::DOUBLE AS x, round(sin(pi() / 2 - 2 * pi() * i / n) + r * (sin(pi() / 2 - 2 * pi() * j / n) - sin(pi() / 2 - 2 * pi() * i / n)), 6) + 0.0::DOUBLE AS y, round(n * r * r, 6) AS coverage FROM c, unnest(range(0, 24)) a(i), unnest(range(0, 24)) b(j) WHERE i < n AND j < n",
}
