from pyspark.sql import Window
from pyspark.sql import functions as F

from symtrace.operators import ring
from symtrace.streaming.append import age_out, append_tokens


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "ck"))
    words = {1: ["alpha", "be", "gamma", "delta", "eps"] * 3, 2: ["x", "yy"]}
    rows = [(k, i, w) for k, ws in words.items() for i, w in enumerate(ws)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 15 // 5 == part] or rows[:0], "conv_id long, tok_no long, token string").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    whole = {k: "\x1f".join(v) for k, v in words.items()}
    alphabet = "".join(sorted(set("".join(whole.values()))))
    stream = spark.readStream.schema("conv_id long, tok_no long, token string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = _run(append_tokens(stream, alphabet), "grown", "update")
    last = got.groupBy("conv_id", "span_no").agg(F.max(F.struct("version", "c", "x", "y")).alias("v")).select("conv_id", "span_no", "v.c", "v.x", "v.y")
    assert last.agg(F.sum("c")).first()[0] == sum(map(len, whole.values()))
    # all histories share the alphabet that was fixed up front, so they share its size
    parts = ring.previous_point(last, "conv_id").withColumn("n", F.lit(len(alphabet)))
    texts = {}
    for r in ring.decode_spans(parts).orderBy("conv_id", "span_no").collect():
        texts[r.conv_id] = texts.get(r.conv_id, "") + "".join(alphabet[i] for i in r.out)
    assert texts == whole


def test_age_out(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "ck"))
    for part in range(2):
        spark.createDataFrame([(1, p, [float(p)]) for p in range(part * 5, part * 5 + 5)], "key long, pos long, vec array<double>").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema("key long, pos long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = _run(age_out(stream, recent=3, sink=2, key="key"), "aged", "append")
    assert sorted(r.pos for r in got.collect()) == [2, 3, 4, 5, 6]
