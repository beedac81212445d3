from pyspark.sql import functions as F

from penumbra.operators.prototypes import FCM
from penumbra.streaming.scoring import each_batch, score_stream, window_moments


def test_a_stream_is_scored_as_a_table_is(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "array(double(id % 3 * 5), double(id % 7) / 10) as features", "timestamp_seconds(id) as at")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    m = FCM(k=3).fit(df)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    each_batch(score_stream(m, stream), lambda b, i: got.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination()
    want = {(r["id"], r["k"]): r["u"] for r in m.transform(df).collect()}
    assert len(got) == 180 and all(abs(want[i, k] - u) < 1e-12 for i, k, u in got)


def test_windows(spark):
    s = spark.range(6).select(F.timestamp_seconds(F.col("id") * 30).alias("at"), (F.col("id") % 2).cast("int").alias("k"), F.lit(0.5).alias("u"))
    assert {(r["window"].start.minute, r["k"], r["n"], r["mass"]) for r in window_moments(s, "at", "1 minute", "1 minute").collect()} == {(m, k, 1, 0.5) for m in range(3) for k in range(2)}
