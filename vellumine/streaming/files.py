"""Files that arrive in a folder, extracted as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import run_diff
from ..sources.extract import extract, list_files


def watch(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of files as they arrive; one row a file that failed."""
    return extract(list_files(spark, path, stream=True).select("path", "content"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append blocks to a Parquet table; a restart goes on where the checkpoint ends, exactly once."""
    writer = watch(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def gate(scores: DataFrame, baseline: DataFrame, out: str, checkpoint: str, epsilon: float = 0.005) -> StreamingQuery:
    """A regression gate over arriving scores (id, metric, score): each batch is compared with the baseline
    and appended to `out` with its verdicts and whether it passes (no score of it fell by over epsilon).
    A batch that is run again after a failure replaces its own folder."""

    def compare(batch: DataFrame, number: int) -> None:
        found = run_diff(baseline, batch, epsilon).where("side <> 'only_in_baseline'")
        fell = F.coalesce(F.col("verdict") == "regressed", F.lit(False))
        passed = found.agg((F.count_if(fell) == 0).alias("passed"), F.count_if(fell).alias("regressions")).first()
        shown = found.withColumn("passed", F.lit(passed["passed"])).withColumn("regressions", F.lit(passed["regressions"]))
        shown.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scores.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
