"""Decision rules on a stream of contacts.

The scoring and decision operators are stateless projections, so the same
expressions run on a streaming DataFrame: new contact rows arriving as
files are scored, auto-approved, banded and decided, and each micro-batch
is appended to a parquet sink. Progress and output live under the shared
folder (``spark.checkpoint.dir``), so a restarted query resumes where it
stopped and a lost executor only re-runs its micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from respondo.operators import rules
from respondo.session import scratch_path


def decide_columns(df: DataFrame, threshold: float, prob: str = "p") -> DataFrame:
    """Auto-approval, decision, probability band and recommendation tier for
    every row (batch or streaming)."""
    d = rules.decide(rules.auto_approval(df), threshold, prob)
    return d.withColumn("band", rules.probability_band(F.col("display_p"))) \
        .withColumn("recommendation", rules.recommendation_band(F.col(prob), threshold))


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, threshold: float,
                 sink_dir: str | None = None, checkpoint: str | None = None,
                 available_now: bool = True) -> tuple[StreamingQuery, str]:
    """Start scoring parquet files that appear in ``source_dir``.

    ``schema`` must carry the customer columns used by the rules and a
    probability column ``p``. Returns the running query and the sink path.
    """
    sink_dir = sink_dir or scratch_path(spark, "scored-stream")
    checkpoint = checkpoint or scratch_path(spark, "scored-stream-ckpt")
    src = spark.readStream.schema(schema).parquet(source_dir)
    scored = decide_columns(src, threshold)
    writer = scored.writeStream.format("parquet").option("path", sink_dir) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start(), sink_dir
