"""Run-log jobs against the same steps in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptflow.operators import runlog

LOG = "run_id long, attempt int, seq long, stream string, line string"
# Every output in many parts, in a few, in one.
PARTS = [1, 3, 25, runlog.PART_LINES]
PIECES = [
    "ok\n",
    "  SUCESSO\n",
    "SUCESSO then more\n",
    "\n",
    " \t\n",
    "a\x0bSUCESSO\n",
    "SUCESSO\x0btail\n",
    "x\r\n",
    "SUC",
    "ESSO",
    "no end",
    "",
    "ValueError: bad\n",
    "　\n",
]


def random_log(seed, attempts=60, longest=9):
    """Lines with sparse, shuffled seq; most of them with their line end."""
    rng = random.Random(seed)
    rows = []
    for key in range(attempts):
        pieces = PIECES if key % 3 else [p for p in PIECES if p.endswith("\n")]
        seqs = rng.sample(range(40), rng.randint(1, longest))
        for seq in seqs:
            stream = rng.choice(["stdout", "stderr"])
            rows.append((key // 2, key % 2 + 1, seq, stream, rng.choice(pieces)))
    rng.shuffle(rows)
    return rows


def texts(rows, stream=None):
    found = {}
    for run, attempt, _, of, line in sorted(rows, key=lambda r: r[2]):
        text = found.setdefault((run, attempt), [])
        if stream in (None, of):
            text.append(line)
    return {key: "".join(lines) for key, lines in found.items()}


def whole(df, *columns):
    """Values per attempt, parts put together in order."""
    found = {}
    for row in sorted(df.collect(), key=lambda r: r.part):
        parts = found.setdefault((row.run_id, row.attempt), [])
        parts.append([row[c] for c in columns])
    return {key: tuple(map(sum_up, zip(*parts))) for key, parts in found.items()}


def sum_up(values):
    return "".join(values) if isinstance(values[0], str) else sum(values)


def attempts_of(rows, spark, exit_codes=(0, 1, None)):
    keys = sorted({(r[0], r[1]) for r in rows} | {(1_000, 1), (1_001, 1), (1_002, 1)})
    return spark.createDataFrame(
        [(run, n, exit_codes[(run + n) % 3]) for run, n in keys],
        "run_id long, attempt int, exit_code int",
    )


@pytest.mark.parametrize("part_lines", PARTS)
@pytest.mark.parametrize("seed", [1, 2])
def test_full_output(spark, part_lines, seed):
    rows = random_log(seed)
    logs = spark.createDataFrame(rows, LOG)
    result = whole(runlog.log_full_output(logs, part_lines), "full_output")
    assert result == {key: (text.strip(),) for key, text in texts(rows).items()}


@pytest.mark.parametrize("part_lines", PARTS)
def test_by_stream(spark, part_lines):
    rows = random_log(3)
    logs = spark.createDataFrame(rows, LOG)
    columns = ["stdout", "stderr", "stdout_lines", "stderr_lines"]
    counts = {
        key: tuple(
            sum(1 for r in rows if (r[0], r[1]) == key and r[3] == stream)
            for stream in ("stdout", "stderr")
        )
        for key in texts(rows)
    }
    out, err = texts(rows, "stdout"), texts(rows, "stderr")
    assert whole(runlog.log_by_stream(logs, part_lines), *columns) == {
        key: (out[key], err[key], *counts[key]) for key in counts
    }


def shown(text, out, err, code):
    """What is kept of an attempt's output."""
    if text.strip():
        return text.strip()
    if out or err:
        return f"STDOUT:\n{out}\n\nSTDERR:\n{err}".strip()
    code = -99 if code is None else code
    return runlog.NO_OUTPUT_NOTE % code if code else ""


@pytest.mark.parametrize("part_lines", PARTS)
def test_output_or_note(spark, part_lines):
    rows = random_log(4, longest=3)
    logs = spark.createDataFrame(rows, LOG)
    attempts = attempts_of(rows, spark)
    all_, out, err = texts(rows), texts(rows, "stdout"), texts(rows, "stderr")
    expected = {}
    for run, n, code in map(tuple, attempts.collect()):
        key = run, n
        found = (d.get(key, "") for d in (all_, out, err))
        expected[key] = (shown(*found, code),)
    assert any(v[0].startswith("STDOUT:") for v in expected.values())
    result = runlog.output_or_note(attempts, logs, part_lines)
    assert whole(result, "output") == expected


def test_no_note_inside_an_output(spark):
    lines = ["a\n", "", "", "", "", "b\n"]
    logs = spark.createDataFrame(
        [(1, 1, seq, "stdout", line) for seq, line in enumerate(lines)], LOG
    )
    attempts = spark.createDataFrame([(1, 1, 3)], "run_id long, attempt int, exit_code int")
    result = runlog.output_or_note(attempts, logs, 2)
    assert result.count() == 3
    assert whole(result, "output") == {(1, 1): ("a\nb",)}


@pytest.mark.parametrize("part_lines", PARTS)
@pytest.mark.parametrize("seed", [5, 6])
def test_success_marker(spark, part_lines, seed):
    rows = random_log(seed, attempts=150)
    logs = spark.createDataFrame(rows, LOG)
    expected = {}
    for key, text in texts(rows).items():
        text = text.strip()
        expected[key] = (
            bool(text) and "SUCESSO" in text.splitlines()[-1],
            "SUCESSO" in text,
        )
    result = runlog.success_marker(logs, part_lines=part_lines).collect()
    assert len(result) == len(expected)
    found = {(r.run_id, r.attempt): (r.marker_last_line, r.marker_any_line) for r in result}
    assert found == expected


def test_marker_across_parts(spark):
    pieces = ["SUC", "ES", "SO", " a", "b\n", "SUC", "\n", "ESSO", "SUC", "ESSO"]
    rows = [
        (run, 1, seq * 3, "stdout", line)
        for run in range(len(pieces))
        for seq, line in enumerate(pieces[run:] + pieces[:run])
    ]
    logs = spark.createDataFrame(rows, LOG)
    expected = {run: t.strip() for (run, _), t in texts(rows).items()}
    for part_lines in PARTS:
        result = runlog.success_marker(logs, part_lines=part_lines).collect()
        assert {r.run_id: (r.marker_last_line, r.marker_any_line) for r in result} == {
            run: ("SUCESSO" in t.splitlines()[-1], "SUCESSO" in t) for run, t in expected.items()
        }


def test_shipped_scripts_end_without_the_marker_in_their_last_line(spark):
    outputs = [
        ["Mensagem Final: concluída com SUCESSO.\n", "=" * 40 + "\n"],
        ["Script executado com SUCESSO.\n", "PySpark: SparkSession parada.\n"],
        ["working\n", "done with SUCESSO\n", "\n"],
        ["sucesso\n"],
    ]
    rows = [
        (run, 1, seq, "stdout", line)
        for run, lines in enumerate(outputs)
        for seq, line in enumerate(lines)
    ]
    logs = spark.createDataFrame(rows, LOG)
    result = runlog.success_marker(logs).orderBy("run_id").collect()
    assert [tuple(r)[2:] for r in result] == [
        (False, True),
        (False, True),
        (True, True),
        (False, False),
    ]


def test_result_does_not_depend_on_partitioning(spark):
    logs = spark.createDataFrame(random_log(8), LOG)
    for job in (
        lambda df: runlog.log_full_output(df, 5),
        runlog.log_by_stream,
        runlog.success_marker,
        runlog.error_type,
    ):
        once = sorted(map(str, job(logs.repartition(1)).collect()))
        assert once == sorted(map(str, job(logs.repartition(13, "line")).collect()))


@pytest.mark.parametrize("part_lines", PARTS)
def test_one_attempt_with_a_third_of_all_lines(spark, part_lines):
    logs = spark.range(9_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS run_id",
        "1 AS attempt",
        "id AS seq",
        "'stdout' AS stream",
        "concat('line ', id, '\n') AS line",
    )
    result = whole(runlog.log_full_output(logs, part_lines), "full_output")
    assert len(result) == 6_001
    assert result[0, 1][0] == "".join(f"line {i}\n" for i in range(0, 9_000, 3)).strip()
    sizes = runlog.log_full_output(logs, part_lines).select(F.length("full_output")).collect()
    assert max(s[0] for s in sizes) <= part_lines * 10


def test_jobs_start_none_and_scan_what_they_must(spark, tmp_path):
    spark.createDataFrame(random_log(9), LOG).write.parquet(str(tmp_path / "log"))
    logs = spark.read.parquet(str(tmp_path / "log"))
    attempts = attempts_of(random_log(9), spark)
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup(None)
    frames = [
        runlog.log_full_output(logs),
        runlog.log_by_stream(logs),
        runlog.output_or_note(attempts, logs),
        runlog.success_marker(logs),
        runlog.error_type(logs),
    ]
    assert tracker.getJobIdsForGroup(None) == before
    # The lines, and the few numbers that tell where an output begins and ends.
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8kb",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_joins_on_a_frequent_attempt_are_split(spark):
    tuned = spark.newSession()
    for key, value in SMALL_SKEW.items():
        tuned.conf.set(key, value)
    logs = tuned.range(0, 30_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 1000 END AS run_id",
        "int(CASE WHEN id % 3 = 0 THEN 1 ELSE 1 + id % 2 END) AS attempt",
        "id AS seq",
        "'stdout' AS stream",
        "concat(md5(string(id)), '\n') AS line",
    )
    attempts = tuned.range(2_000).selectExpr(
        "id div 2 AS run_id", "int(1 + id % 2) AS attempt", "1 AS exit_code"
    )
    only = attempts.select("run_id", "attempt")
    result = runlog.with_output(attempts, logs, 200, only)
    rows = result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # The lines with their places, and the attempts with their outputs.
    assert final.count("SortMergeJoin(skew=true)") >= 2
    hot = [r for r in rows if (r.run_id, r.attempt) == (0, 1)]
    assert len(hot) > 100 and sum(len(r.output) for r in hot) == 33 * (10_000 + 20) - 1
    assert {(r.run_id, r.attempt) for r in rows} == {(i // 2, i % 2 + 1) for i in range(2_000)}


def test_blank_outputs_stay(spark):
    rows = [(1, 1, s, "stdout", " \n") for s in range(50)] + [(2, 1, 1, "stderr", "")]
    logs = spark.createDataFrame(rows, LOG)
    for part_lines in PARTS:
        result = whole(runlog.log_full_output(logs, part_lines), "full_output")
        assert result == {(1, 1): ("",), (2, 1): ("",)}


@pytest.mark.parametrize("part_lines", [3, runlog.PART_LINES])
def test_a_repeated_seq_is_an_error(spark, part_lines):
    rows = [(1, 1, 1, "stdout", "a\n"), (1, 1, 1, "stderr", "b\n"), (1, 1, 2, "stdout", "c\n")]
    logs = spark.createDataFrame(rows, LOG)
    with pytest.raises(Exception, match="seq is not unique"):
        runlog.log_full_output(logs, part_lines).collect()


def test_display(spark):
    rows = [(1, 1, 1, "stdout", "a\n"), (1, 1, 2, "stderr", "b\n")]
    logs = spark.createDataFrame(rows, LOG)
    result = runlog.log_display(logs).orderBy("seq").collect()
    assert [r.text for r in result] == ["a\n", "[STDERR] b\n"]


def test_frames(spark):
    attempts = spark.createDataFrame(
        [(1, 1, 0), (1, 2, None)], "run_id long, attempt int, exit_code int"
    )
    result = runlog.log_frames(attempts).orderBy("attempt", F.desc("place")).collect()
    assert [r.text for r in result] == [
        "--- Iniciando execução da Tentativa 1 ---\n",
        "\n--- Fim da execução (Tentativa 1) --- Código de Saída: 0 ---\n",
        "--- Iniciando execução da Tentativa 2 ---\n",
        "\n--- Fim da execução (Tentativa 2) --- Código de Saída: -99 ---\n",
    ]


ERRORS = [
    ("ValueError: bad value\n", ("ValueError", "bad value")),
    ("Traceback (most recent call last):\n  File x\nKeyError\n", ("KeyError", None)),
    (
        "ValueError: first\n\nDuring handling\npkg.sub.CustomException: a: b\n",
        ("pkg.sub.CustomException", "a: b"),
    ),
    ("KeyboardInterrupt\n", (None, None)),
    ("an Error: inside a line\n", (None, None)),
    ("SyntaxError: '(' was never closed (<unknown>, line 2)\n",
     ("SyntaxError", "'(' was never closed (<unknown>, line 2)")),
    ("Error: \n", ("Error", None)),
]


def test_error_of_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in ERRORS], "t string")
    rows = df.select(runlog.error_of(F.col("t")).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in rows] == [e for _, e in ERRORS]


def test_error_type_of_lines(spark):
    rows = []
    for run, (text, _) in enumerate(ERRORS):
        for seq, line in enumerate(re.findall(r".*\n", text)):
            rows.append((run, 1, seq, "stderr", line))
    rows.append((100, 1, 1, "stdout", "fine\n"))
    logs = spark.createDataFrame(rows, LOG)
    result = runlog.error_type(logs).orderBy("run_id").collect()
    assert [tuple(r)[2:] for r in result] == [e for _, e in ERRORS] + [(None, None)]


@pytest.mark.parametrize("part_lines", PARTS)
@pytest.mark.parametrize(
    "lines,error",
    [
        (["foo ", "ValueError: x\n"], (None, None)),
        (["ValueError: x", " more\n"], ("ValueError", "x more")),
        (["Value", "Error: y\n"], ("ValueError", "y")),
        (["KeyError: a\n", "x", "y\n", "z\n"], ("KeyError", "a")),
        (["KeyError: a\n", "Type", "Error\n", "z"], ("TypeError", None)),
    ],
)
def test_error_type_of_joined_lines(spark, lines, error, part_lines):
    logs = spark.createDataFrame(
        [(1, 1, 2 * k, "stderr", line) for k, line in enumerate(lines)], LOG
    )
    (row,) = runlog.error_type(logs, part_lines).collect()
    assert tuple(row)[2:] == error


@pytest.mark.parametrize("seed", [11, 12])
def test_error_type_equals_the_text(spark, seed):
    rows = random_log(seed, attempts=120)
    logs = spark.createDataFrame(rows, LOG)
    pattern = re.compile(r"^([\w.]*(?:Error|Exception))(?:: (.*))?$", re.M)
    expected = {}
    for key, text in texts(rows).items():
        # Lines end as in the pattern of the job.
        found = pattern.findall(re.sub("[\r\x85\u2028\u2029]", "\n", text.strip()))
        expected[key] = found[-1][0] if found else None
    for part_lines in PARTS:
        got = runlog.error_type(logs, part_lines).collect()
        assert {(r.run_id, r.attempt): r.error_type for r in got} == expected


def test_markers_and_errors_read_the_log_once(spark, tmp_path):
    spark.createDataFrame(random_log(10), LOG).write.parquet(str(tmp_path / "log"))
    logs = spark.read.parquet(str(tmp_path / "log"))
    for result in (runlog.success_marker(logs), runlog.error_type(logs)):
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Scan parquet") == 1
        # The lines by attempt and part, and a row for each part by attempt.
        assert final.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("part_lines", PARTS)
@pytest.mark.parametrize(
    "lines,error",
    [
        (["ValueError: x\n", "KeyError y\n"], ("ValueError", "x")),
        (["\n", " \n", "ValueError\n", "\n", " \n"], ("ValueError", None)),
        (["\tValueError\n", "ok\n", "  ValueError: x\n"], (None, None)),
        (["KeyError: a\n", "ok\n", "ValueError: \n", "\n"], ("ValueError", None)),
        (["ok\n", "ValueError: x", "  \n", "\n", "\n", "  y"], ("ValueError", "x  ")),
        (["ok", "\n", "Value", "Error", ": x", "\n\n", " ", "\n"], ("ValueError", "x")),
        (["\n", " \n", ""], (None, None)),
    ],
)
def test_error_type_at_the_edges_of_the_output(spark, lines, error, part_lines):
    logs = spark.createDataFrame(
        [(1, 1, 3 * k, "stderr", line) for k, line in enumerate(lines)], LOG
    )
    (row,) = runlog.error_type(logs, part_lines).collect()
    assert tuple(row)[2:] == error


def test_a_huge_line(spark):
    lines = ["short\n"] * 20 + ["x" * 5_000_000 + "\n"] + ["short\n"] * 20
    logs = spark.createDataFrame(
        [(1, 1, k, "stdout", line) for k, line in enumerate(lines)], LOG
    )
    result = runlog.log_full_output(logs, 10).collect()
    assert len(result) == 5
    assert "".join(r.full_output for r in sorted(result, key=lambda r: r.part)) == "".join(lines).strip()


@pytest.mark.parametrize("part_lines", PARTS)
def test_blank_lines_are_shown_at_any_size(spark, part_lines):
    logs = spark.createDataFrame(
        [(1, 1, k, ("stdout", "stderr")[k % 2], " \t\n") for k in range(6)]
        + [(2, 1, k, "stdout", "") for k in range(6)],
        LOG,
    )
    attempts = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 1), (3, 1, 0)], "run_id long, attempt int, exit_code int"
    )
    result = whole(runlog.output_or_note(attempts, logs, part_lines), "output")
    assert result == {
        (1, 1): ("STDOUT:\n" + " \t\n" * 3 + "\n\nSTDERR:",),
        (2, 1): (runlog.NO_OUTPUT_NOTE % 1,),
        (3, 1): ("",),
    }


def test_verdict(spark):
    attempts = spark.createDataFrame(
        [(1, 1, 0), (1, 2, 1), (1, 3, None), (1, 4, -15)],
        "run_id long, attempt int, exit_code int",
    )
    result = runlog.attempt_verdict(attempts).orderBy("attempt").collect()
    assert [r.exit_ok for r in result] == [True, False, False, False]
