"""Event-time views: windows, attempts and joins that close, against the batch answers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptflow.operators import runlog
from scriptflow.streaming import logs as streaming, outputs, verdicts, windows

START = datetime(2024, 5, 1)
LOG = "run_id long, attempt int, seq long, ts timestamp_ntz, stream string, line string"
EVENTS = "run_id long, attempt int, ts timestamp_ntz, kind string, exit_code int"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Folder:
    """A folder of Parquet files that grows."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        frame = self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return streaming.file_stream(self.spark, self.path)

    def batch(self):
        return self.spark.read.parquet(self.path)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return ordered(df.collect())


def line(n, minutes, stream="stdout"):
    return (1, 1, n, None if minutes is None else at(minutes), stream, f"line {n}\n")


def test_windows_close_and_count_late_lines(spark, tmp_path):
    log = Folder(spark, tmp_path / "in", LOG)
    totals = windows.WindowTotals(str(tmp_path / "w"), "1 hour", "10 minutes")

    def now():
        nonlocal totals
        totals = totals.fill(log.stream())
        return rows_of(totals.rows(log.stream()))

    log.add([line(1, 0), line(2, 59), line(3, 61, "stderr")])
    assert now() == ordered([(at(0), "stdout", 2, 0, False), (at(60), "stderr", 1, 0, False)])
    log.add([line(4, 5), line(5, 75)])  # not late yet: the first hour closes by this batch
    assert now() == ordered([
        (at(0), "stdout", 3, 0, True),
        (at(60), "stderr", 1, 0, False),
        (at(60), "stdout", 1, 0, False),
    ])
    log.add([line(6, 200)])
    log.add([line(7, 190)])
    now()
    log.add([line(8, 10), line(9, 11, "stderr"), line(10, 195), line(11, None)])
    assert now() == ordered([
        (at(0), "stderr", 0, 1, True),
        (at(0), "stdout", 3, 1, True),
        (at(180), "stdout", 3, 0, False),
        (at(60), "stderr", 1, 0, True),
        (at(60), "stdout", 1, 0, True),
        (None, "stdout", 0, 1, True),
    ])
    assert now() == now()


def test_window_state_stays_bounded(spark, tmp_path):
    log = Folder(spark, tmp_path / "in", LOG)
    totals = windows.WindowTotals(str(tmp_path / "w"), "1 hour", "10 minutes")
    states = []
    for k in range(8):
        log.add([line(10 * k + j, 240 * k + 20 * j, ("stdout", "stderr")[j % 2]) for j in range(10)])
        totals = totals.fill(log.stream())
        states.append(totals.state)
    assert max(states) <= 4
    got = totals.rows(log.stream())
    assert got.agg(F.sum("n"), F.sum("late")).first() == (80, 0)
    assert got.filter("closed").count() == 7 * 8 - 3


def test_windows_of_an_empty_log(spark, tmp_path):
    log = Folder(spark, tmp_path / "in", LOG)
    log.add([])
    assert windows.log_window_totals(log.stream()).collect() == []


def random_events(rng, n):
    """Events of attempts, and their verdicts: some never report a status."""
    events, want = [], {}
    for run in range(n):
        start = rng.randrange(600)
        code = rng.choice([0, 0, 1, 137, None])
        lines = [(run, 1, at(start + rng.randrange(30)), "line", None) for _ in range(rng.randrange(1, 4))]
        ends = rng.random() < 0.7
        if ends:
            lines.append((run, 1, at(start + 30), "status", code))
        code = code if ends and code is not None else -99
        want[run] = (run, 1, code, code == 0, "status" if ends else "timeout")
        events += lines
    return events, sorted(want.values(), key=str)


@pytest.mark.parametrize("order", ["shuffled", "reversed", "by time", "status first"])
def test_verdicts_in_any_order(spark, tmp_path, order):
    rng = random.Random(order)
    events, want = random_events(rng, 40)
    if order == "shuffled":
        rng.shuffle(events)
    elif order == "reversed":
        events.sort(key=lambda e: e[2], reverse=True)
    elif order == "by time":
        events.sort(key=lambda e: e[2])
    else:
        events.sort(key=lambda e: e[3] != "status")
    log = Folder(spark, tmp_path / "in", EVENTS)
    path = str(tmp_path / "v")
    # Arrival may be up to the delay out of order.
    how = ("1 hour", "12 hours")
    for k in range(3):
        log.add(events[k::3] if order == "shuffled" else events[len(events) * k // 3 : len(events) * (k + 1) // 3])
        verdicts.close_attempts(log.stream(), path, *how)
    assert verdicts.close_attempts(log.stream(), path, *how, upto=at(3000)) == 0
    got = verdicts.attempt_closed(log.stream(), path, *how)
    assert rows_of(got) == want


def test_an_attempt_closes_as_it_ends(spark, tmp_path):
    log = Folder(spark, tmp_path / "in", EVENTS)
    path = str(tmp_path / "v")
    view = lambda **k: rows_of(verdicts.attempt_closed(log.stream(), path, "1 hour", "1 minute", **k))
    log.add([(1, 1, at(0), "line", None), (2, 1, at(0), "line", None), (3, 1, None, "line", None)])
    log.add([(1, 1, at(5), "status", 0), (4, 1, at(6), "status", None)])
    ended = [(1, 1, 0, True, "status"), (4, 1, -99, False, "status")]
    untimed = (3, 1, -99, False, "timeout")  # of a time before all others
    assert view() == ordered([*ended, untimed])
    log.add([(1, 1, at(4), "line", None)])  # after its status
    assert ended[0] in view()
    silent = (2, 1, -99, False, "timeout")
    assert view(upto=at(70)) == ordered([*ended, untimed, silent])
    log.add([(2, 1, at(100), "status", 0)])  # long after the time-out
    assert (2, 1, 0, True, "status") in view()


ATTEMPTS = "run_id long, attempt int, started timestamp_ntz, exit_code int"


def test_outputs_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    tries = Folder(spark, tmp_path / "a", ATTEMPTS)
    log = Folder(spark, tmp_path / "l", LOG)
    path = str(tmp_path / "o")
    states = []

    def live(upto=None):
        states.append(outputs.join_outputs(tries.stream(), log.stream(), path, "2 hours", "1 hour", upto))
        return outputs.live_output_or_note(
            tries.stream(), log.stream(), path, "2 hours", "1 hour", part_lines=5
        )

    texts = ["a\n", "  \n", "b", "", "c d\n", "\t"]
    attempts, lines, seq = [], [], 0
    for run in range(60):
        start = 10 * run
        attempts.append((run, 1, at(start), rng.choice([0, 1, None])))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            seq += 1
            stream = rng.choice(["stdout", "stderr"])
            lines.append((run, 1, seq, at(start + rng.randrange(100)), stream, rng.choice(texts)))
    lines.append((999, 1, 0, at(3), "stdout", "of no attempt\n"))
    lines.sort(key=lambda r: r[3])
    for k in range(3):
        tries.add(attempts[20 * k : 20 * k + 20])
        log.add([r for r in lines if at(200 * k) <= r[3] < at(200 * k + 200) or (k == 2 and r[3] >= at(600))])
        early = live()
    assert 0 < early.count()
    got = live(upto=at(10_000))
    assert states[0] > 0 and states[-1] == 0
    want = runlog.output_or_note(tries.batch(), log.batch(), 5)
    assert rows_of(got) == rows_of(want)
    assert got.filter("output LIKE '[note]%'").count()
