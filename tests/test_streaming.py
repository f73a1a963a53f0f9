"""The live views equal the batch answer, batch by batch and across restarts."""

import pytest

from scriptflow.operators.runlog import log_full_output
from scriptflow.streaming import logs as streaming

LOG = "run_id long, attempt int, seq long, stream string, line string"


@pytest.fixture
def arriving(spark, tmp_path):
    """A folder of log files, and a function that adds another one."""
    folder = tmp_path / "in"

    def add(start):
        rows = [
            (n % 3, n % 2 + 1, n, "stderr" if n % 5 == 0 else "stdout", f"line {n}\n")
            for n in range(start, start + 40)
        ]
        frame = spark.createDataFrame(rows, LOG)
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    add(0)
    add(40)
    add(80)
    return str(folder), add


def sorted_rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def expected_totals(spark, folder):
    return sorted_rows(
        spark.read.parquet(folder)
        .groupBy("run_id", "attempt", "stream")
        .count()
        .withColumnRenamed("count", "n")
    )


def test_totals_over_many_batches_and_a_restart(spark, arriving, tmp_path):
    folder, add = arriving
    path = str(tmp_path / "totals")

    def totals():
        lines = streaming.file_stream(spark, folder, files_per_batch=1)
        return streaming.log_stream_totals(lines, path)

    assert sorted_rows(totals()) == expected_totals(spark, folder)
    assert len(list((tmp_path / "totals" / "rows").glob("batch_id=*"))) == 3
    add(120)
    assert sorted_rows(totals()) == expected_totals(spark, folder)
    assert sorted_rows(totals()) == expected_totals(spark, folder)
    assert not spark.streams.active


def test_output_over_many_batches_and_a_restart(spark, arriving, tmp_path):
    folder, add = arriving
    path = str(tmp_path / "lines")

    def output():
        lines = streaming.file_stream(spark, folder, files_per_batch=1)
        return sorted_rows(streaming.log_stream_output(lines, path))

    def batch():
        return sorted_rows(log_full_output(spark.read.parquet(folder)))

    assert output() == batch()
    add(120)
    assert output() == batch()
    assert not spark.streams.active


def test_a_batch_that_runs_again_counts_once(spark, arriving, tmp_path):
    folder, _ = arriving
    stored = streaming.LiveTable(str(tmp_path / "t"), lambda batch: batch.select("line"))
    lines = streaming.file_stream(spark, folder, files_per_batch=1)
    stored.fill(lines)
    # As after a crash between the write of a batch and its commit.
    commits = tmp_path / "t" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    stored.fill(lines)
    assert stored.rows(lines).count() == 120


def test_a_single_file_is_a_stream_too(spark, arriving, tmp_path):
    folder, _ = arriving
    file = next((tmp_path / "in").glob("*.parquet"))
    lines = streaming.file_stream(spark, str(file))
    assert sorted_rows(streaming.log_stream_totals(lines)) == expected_totals(spark, str(file))


def test_nothing_has_arrived(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], LOG).write.parquet(folder)
    lines = streaming.file_stream(spark, folder)
    assert streaming.log_stream_totals(lines).count() == 0
    assert streaming.log_stream_output(lines).count() == 0
