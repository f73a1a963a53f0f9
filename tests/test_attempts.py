"""Every branch of the attempt rules, and how runs end."""

import pytest

from scriptflow.operators import attempts as at, runlog

SCHEMA = (
    "run_id long, attempt int, exit_code int, code string, suggestion string, stage_error string"
)
LOG = "run_id long, attempt int, seq long, stream string, line string"

# attempt, exit code, code, suggestion, stage error, action with three attempts
BRANCHES = [
    (1, 0, "x", "y", "analysis", "analysis_error"),
    (3, 1, "x", None, "save", "save_error"),
    (1, None, "x", "y", "other", "analysis_error"),
    (1, 0, "x", None, None, "success"),
    (3, 0, "x", "y", None, "success"),
    (3, 1, "x", "y", None, "max_attempts"),
    (4, 1, "x", "y", None, "max_attempts"),
    (1, 1, "x", None, None, "no_suggestion"),
    (1, 1, "x", "", None, "no_suggestion"),
    (1, None, "x", None, None, "no_suggestion"),
    (1, 1, "x", "x", None, "same_code"),
    (2, 1, "x\n", " \t x　", None, "same_code"),
    (1, 1, "x", "y", None, "retry"),
    (2, None, None, "y", None, "retry"),
    (1, -15, "x", " ", None, "retry"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def outcomes(spark, rows, **options):
    result = at.run_outcome(frame(spark, rows), **options).orderBy("run_id").collect()
    return [tuple(r)[1:] for r in result]


def test_action(spark):
    rows = [(i, *b[:5]) for i, b in enumerate(BRANCHES)]
    result = at.attempt_action(frame(spark, rows)).orderBy("run_id").collect()
    assert [r.action for r in result] == [b[5] for b in BRANCHES]
    assert {r.action for r in result} == set(at.ACTIONS)


def test_max_attempts_is_one_to_ten(spark):
    df = frame(spark, [(1, 10, 1, "x", "y", None)])
    assert at.attempt_action(df, 10).first().action == "max_attempts"
    assert at.attempt_action(df.withColumn("attempt", df.attempt - 9), 1).first().action == (
        "max_attempts"
    )
    for wrong in (0, 11):
        with pytest.raises(ValueError, match="1 to 10"):
            at.attempt_action(df, wrong)


def test_suggestion_changed(spark):
    pairs = [("x", None), ("x", ""), ("x", " x\n"), ("x", "y"), (None, "y"), (None, None)]
    rows = [(i, 1, 1, code, reply, None) for i, (code, reply) in enumerate(pairs)]
    result = at.suggestion_changed(frame(spark, rows)).orderBy("run_id").collect()
    assert [tuple(r)[2:] for r in result] == [
        (False, False),
        (False, False),
        (True, False),
        (True, True),
        (True, True),
        (False, False),
    ]


def test_outcome(spark):
    retry = (1, "x", "y", None)
    rows = [
        # Succeeds at the second attempt; what follows does not count.
        (1, 3, 1, "x", "y", None),
        (1, 2, 0, "x", None, None),
        (1, 1, *retry),
        # Stops at the first.
        (2, 1, 1, "x", "x", None),
        (2, 2, 0, "x", None, None),
        # Runs out of attempts.
        *[(3, n, *retry) for n in range(1, 6)],
        # Still going on.
        (4, 1, *retry),
        (4, 2, *retry),
        (5, 1, None, "x", None, "save"),
    ]
    assert outcomes(spark, rows) == [
        ("success", 2, 2),
        ("same_code", 1, 1),
        ("max_attempts", 3, 3),
        ("incomplete", None, 2),
        ("save_error", 1, 1),
    ]
    assert outcomes(spark, rows, max_attempts=2)[3] == ("max_attempts", 2, 2)
    assert outcomes(spark, rows, max_attempts=10)[2] == ("incomplete", None, 5)


def test_outcome_of_one_run_with_most_attempts_is_combined_before_the_shuffle(spark):
    df = frame(spark, [(1, n, 1, "x", "y", None) for n in range(1, 500)])
    result = at.run_outcome(df.repartition(4))
    assert [tuple(r) for r in result.collect()] == [(1, "max_attempts", 3, 3)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Sort" not in plan


def test_summary(spark):
    rows = [
        (1, 1, 0, "x", None, None),
        (2, 1, 1, "x", "y", None),
        (2, 2, 0, "x", None, None),
        (3, 1, 1, "x", None, None),
        (4, 1, 1, "x", "y", None),
    ]
    result = at.run_summary(at.run_outcome(frame(spark, rows))).orderBy("outcome").collect()
    assert [tuple(r) for r in result] == [
        ("incomplete", 1, 0.25, 1.0),
        ("no_suggestion", 1, 0.25, 1.0),
        ("success", 2, 0.5, 1.5),
    ]


@pytest.mark.parametrize("part_lines", [runlog.PART_LINES, 2])
def test_failure_report(spark, part_lines):
    rows = [
        (1, 1, 1, "x", "x", None),
        (2, 1, 1, "x", "y", None),
        (2, 2, 1, "x", None, None),
        (3, 1, 0, "x", None, None),
        (4, 3, 7, "x", "y", None),
        (5, 1, None, "x", None, "analysis"),
        (6, 1, 1, "x", "y", None),
        (7, 1, 0, "x", None, "stream"),
    ]
    lines = [
        (7, 1, 1, "stdout", "begun\n"),
        (1, 1, 1, "stdout", "\n"),
        (1, 1, 2, "stdout", "one\n"),
        (1, 1, 3, "stderr", "two\n"),
        (1, 1, 9, "stderr", "three\n"),
        (2, 1, 1, "stdout", "not shown\n"),
        (2, 2, 1, "stdout", " shown \n"),
        (3, 1, 1, "stdout", "fine\n"),
        (5, 1, 1, "stdout", "never ran\n"),
    ]
    logs = spark.createDataFrame(lines, LOG)
    result = at.failure_report(frame(spark, rows), logs, part_lines=part_lines)
    found = {}
    for r in sorted(result.collect(), key=lambda r: r.part):
        found.setdefault((r.run_id, r.outcome, r.attempt), []).append(r.report)
    assert {key: "".join(parts) for key, parts in found.items()} == {
        (1, "same_code", 1): "one\ntwo\nthree" + at.SAME_CODE_NOTE,
        (2, "no_suggestion", 2): "shown" + at.NO_SUGGESTION_NOTE,
        (4, "max_attempts", 3): runlog.NO_OUTPUT_NOTE % 7,
        (5, "analysis_error", 1): at.STAGE_ERROR_NOTE % "analysis_error",
        (7, "no_suggestion", 1): "begun" + at.STREAM_ERROR_NOTE + at.NO_SUGGESTION_NOTE,
    }
    if part_lines == 2:
        assert len(found[1, "same_code", 1]) == 2
