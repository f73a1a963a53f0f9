"""Prompts, replies, and the batch corrector."""

import pytest
from pyspark.sql import functions as F

from scriptflow.operators import correction as co


def expected_prompt(code, output):
    return co.INSTRUCTION + co.CODE_HEAD + code + co.OUTPUT_HEAD + output + co.END


def test_prompt_text(spark):
    df = spark.createDataFrame(
        [("x", " out\n"), ("x", " \n　"), ("x", ""), ("x", None)], "code string, output string"
    )
    rows = df.select(co.prompt_text(F.col("code"), F.col("output"))).collect()
    assert [r[0] for r in rows] == [
        expected_prompt("x", "out"),
        *[expected_prompt("x", co.EMPTY_OUTPUT_NOTE)] * 3,
    ]


@pytest.mark.parametrize("part_lines", [10_000, 2])
def test_prompts_of_failed_attempts(spark, part_lines):
    attempts = spark.createDataFrame(
        [
            (1, 1, 1, "a", None),
            (1, 2, 0, "b", None),
            (2, 1, None, "c", None),
            (2, 3, 1, "d", None),
            (3, 1, 1, "e", "analysis"),
            (4, 1, 0, None, "stream"),
        ],
        "run_id long, attempt int, exit_code int, code string, stage_error string",
    )
    logs = spark.createDataFrame(
        [(1, 1, s, "stdout", line) for s, line in enumerate([" \n", "p\n", "\n", "q\n", "r\n"])]
        + [(1, 2, 1, "stdout", "fine\n"), (3, 1, 1, "stdout", "no\n")],
        "run_id long, attempt int, seq long, stream string, line string",
    )
    found = {}
    for r in sorted(co.prompts(attempts, logs, part_lines=part_lines).collect(), key=lambda r: r.part):
        found.setdefault((r.run_id, r.attempt), []).append(r.prompt)
    assert {key: "".join(parts) for key, parts in found.items()} == {
        (1, 1): expected_prompt("a", "p\n\nq\nr"),
        (2, 1): expected_prompt(
            "c", "[note] the script ended with exit code -99 and printed nothing"
        ),
        (4, 1): expected_prompt(
            co.NO_CODE_NOTE, "STREAMING ERROR: the output could not be read to its end"
        ),
    }


def test_clean_response_cases(spark):
    cases = [
        ("```python\nx = 1\n```", "x = 1"),
        ("```\nx = 1\n```", "x = 1"),
        ("  \nx = 1  ", "x = 1"),
        ("```python\n```", None),
        ("```py\nx = 1\n```", "py\nx = 1"),
        ("```Python\nx = 1\n```", "Python\nx = 1"),
        ("Here:\n```python\nx = 1\n```", "Here:\n```python\nx = 1"),
        ("   ", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(1, i, raw) for i, (raw, _) in enumerate(cases)],
                               "conv_id long, turn long, raw string")
    rows = co.clean_responses(df).orderBy("turn").collect()
    assert [r.code for r in rows] == [code for _, code in cases]


def test_map_corrector(spark):
    def answer(prompt):
        if "<fail>" in prompt:
            raise RuntimeError("no answer")
        if "<nothing>" in prompt:
            return None
        if "<number>" in prompt:
            return 7
        if "<blank>" in prompt:
            return " ``` "
        return "```python\nfixed\n```" if co.EMPTY_OUTPUT_NOTE in prompt else "other"

    rows = [
        (1, "<fail>", "o"),
        (2, "<nothing>", "o"),
        (3, "<number>", "o"),
        (4, "<blank>", "o"),
        (5, "x", "o"),
        (6, "x", " "),
    ]
    df = spark.createDataFrame(rows, "script_id long, code string, output string")
    result = co.map_corrector(df.repartition(3), answer).orderBy("script_id").collect()
    assert [tuple(r) for r in result] == [
        (*row, suggestion)
        for row, suggestion in zip(rows, [None, None, None, None, "other", "fixed"])
    ]


def test_corrector_is_asked_once_per_row(spark):
    asked = spark.sparkContext.accumulator(0)

    def count(prompt):
        asked.add(1)
        return "```\nx\n```"

    df = spark.range(50).selectExpr("id AS script_id", "'c' AS code", "'o' AS output")
    result = co.map_corrector(df, count).filter("suggestion IS NOT NULL AND suggestion <> 'y'")
    assert len(result.collect()) == 50
    assert asked.value == 50
