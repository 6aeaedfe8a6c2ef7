"""Log queries over a growing folder: each micro-batch is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators import traffic


def stream_results(spark: SparkSession, path: str, output: str, checkpoint: str) -> StreamingQuery:
    """Append the results of each micro-batch of new files below ``path`` to ``output``, under its own batch id.

    A micro-batch writes a folder named after its id, so one that runs again replaces what it wrote.
    """

    def store(lines: DataFrame, batch: int) -> None:
        numbered = lines.select(F.col("value").alias("line"), F.lit(batch + 1).alias("batch_id"))
        traffic.results(traffic.records(numbered)).write.mode("overwrite").parquet(f"{output}/batch={batch + 1}")

    return spark.readStream.text(path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
