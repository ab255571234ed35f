"""The decision rules run unchanged on a stream and equal the batch result."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from respondo.plans.customers import customers
from respondo.session import scratch_path
from respondo.streaming.scoring import decide_columns, score_stream


def test_stream_scoring_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    batch = customers(spark, SF_SMALL)
    batch.write.parquet(src)
    q, sink = score_stream(spark, src, batch.schema, threshold=0.5)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    expected = decide_columns(batch, 0.5)
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "auto_rule", "approved",
            "band", "recommendation"]
    assert streamed.count() == expected.count()
    assert streamed.select(*cols).exceptAll(expected.select(*cols)).count() == 0
    assert streamed.where(F.col("auto_approved")).count() == \
        expected.where(F.col("auto_approved")).count()
