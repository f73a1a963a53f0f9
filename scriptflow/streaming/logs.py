"""Live views over process output that arrives as Parquet files.

Both jobs keep their results as Parquet in shared storage, one directory per
micro-batch. A batch that is run again after a failure replaces its own directory,
so a line counts once. Neither job keeps streaming state, which would grow with every
attempt that was ever seen.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.runlog import ATTEMPT, PART_LINES, log_full_output
from ..sources.storage import exists, file_system, fresh_dir

STREAM = [*ATTEMPT, "stream"]


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at ``path``, a directory or one file.

    The schema is that of the files present at the start.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    fs, hadoop_path = file_system(spark, path)
    if fs.getFileStatus(hadoop_path).isFile():
        name = hadoop_path.getName()
        return reader.option("pathGlobFilter", name).parquet(
            hadoop_path.getParent().toString()
        )
    return reader.parquet(path)


@dataclass(frozen=True)
class LiveTable:
    """A table that a stream fills batch by batch.

    ``of_batch`` makes the rows that a micro-batch of lines adds.
    """

    path: str
    of_batch: Callable[[DataFrame], DataFrame]

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    def fill(self, lines: DataFrame) -> None:
        """Process what has arrived, then stop. A later call goes on from there."""

        def store(batch: DataFrame, batch_id: int) -> None:
            self.of_batch(batch).write.mode("overwrite").parquet(
                f"{self.rows_path}/batch_id={batch_id}"
            )

        query = (
            lines.writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def rows(self, lines: DataFrame) -> DataFrame:
        """What all batches added so far."""
        spark, schema = lines.sparkSession, self.of_batch(lines).schema
        if not exists(spark, self.rows_path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.rows_path)


def _count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*STREAM).agg(F.count("*").alias("n"))


def _keep_lines(lines: DataFrame) -> DataFrame:
    return lines.select(*ATTEMPT, "seq", "stream", "line")


def log_stream_totals(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Lines per run, attempt and stream, counted as they arrive.

    Each batch stores its own counts, and the view adds them up. Call again with the
    same ``path`` to go on.
    """
    table = LiveTable(path or fresh_dir(lines.sparkSession, "log_totals"), _count_lines)
    table.fill(lines)
    return table.rows(lines).groupBy(*STREAM).agg(F.sum("n").alias("n"))


def log_stream_output(
    lines: DataFrame, path: str | None = None, part_lines: int = PART_LINES
) -> DataFrame:
    """The output of every attempt, from the lines that have arrived.

    Each batch stores its lines; the texts are put together when they are read.
    """
    table = LiveTable(path or fresh_dir(lines.sparkSession, "log_lines"), _keep_lines)
    table.fill(lines)
    return log_full_output(table.rows(lines), part_lines)
