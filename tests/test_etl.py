"""The ETL on a few known transactions, and the plans it must have."""

import datetime

import pytest

from scriptflow.functions.dates import year_is
from scriptflow.operators import etl
from scriptflow.plans.etl import REPORT, STAGED, report_rows, run_etl
from scriptflow.sources import rows
from scriptflow.sources.workspace import Workspace

D = datetime.date
TRANSACTIONS = [
    (11, "mill north", D(2022, 12, 31), 10.5),
    (12, "mill south", D(2023, 1, 1), 20.25),
    (13, "depot é", D(2023, 7, 9), 0.0),
    (14, None, D(2023, 12, 31), -3.75),
    (15, "late", D(2024, 1, 1), 99.0),
    (16, "no date", None, 1.0),
    (17, "no value", D(2023, 3, 3), None),
]
REPORT_2023 = [
    (12, "MILL SOUTH", D(2023, 1, 1), 20.25, 2023, 1, "Sistema_B"),
    (13, "DEPOT É", D(2023, 7, 9), 0.0, 2023, 7, "Sistema_B"),
    (14, None, D(2023, 12, 31), -3.75, 2023, 12, "Sistema_B"),
    (17, "NO VALUE", D(2023, 3, 3), None, 2023, 3, "Sistema_B"),
]


@pytest.fixture
def raw(spark):
    return rows.from_rows(spark, TRANSACTIONS, rows.TRANSACTION_SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report(spark, raw):
    with Workspace.fresh(spark) as workspace:
        workspace.write(raw, "dados_entrada_raw.parquet")
        report = run_etl(workspace, workspace.read("dados_entrada_raw.parquet"), 2023)
        assert report.columns == [
            "id_registro",
            "cliente_final",
            "data_transacao",
            "valor_final",
            "ano_transacao",
            "mes_transacao",
            "source_system",
        ]
        assert sorted(map(tuple, report.collect())) == REPORT_2023
        assert list(workspace.mapping) == ["dados_entrada_raw.parquet", STAGED, REPORT]
    assert sorted(map(tuple, report_rows(raw, 2023).collect())) == REPORT_2023


def test_report_parameters(raw):
    report = report_rows(raw, 2024, "Other").collect()
    assert [(r.id_registro, r.source_system) for r in report] == [(15, "Other")]
    assert report_rows(raw, 1999).count() == 0


def test_year_is_the_year(spark):
    dates = [D(1, 1, 1), D(2022, 12, 31), D(2023, 1, 1), D(2023, 12, 31), D(2024, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    assert [r.d for r in df.filter(year_is("d", 2023)).collect()] == dates[2:4]
    assert df.filter(year_is("d", 9999)).count() == 0


def test_year_reaches_the_scan(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "t"))
    report = plan(report_rows(spark.read.parquet(str(tmp_path / "t")), 2023))
    pushed = report.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(data_transacao,2023-01-01)" in pushed
    assert "LessThan(data_transacao,2024-01-01)" in pushed
    assert "Exchange" not in report


def test_columns_are_pruned(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    used = plan(df.transform(etl.enrich).select("id_registro", "ano_transacao"))
    assert used.split("ReadSchema: ")[1].startswith(
        "struct<id_registro:int,data_transacao:date>"
    )


def test_count_and_preview(raw):
    assert etl.row_count(raw).first().n == 7
    assert [r.id_registro for r in etl.preview(raw, "id_registro", 2).collect()] == [11, 12]
    assert etl.preview(raw, "id_registro").count() == 5


def test_schema_report(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in etl.schema_report(df).collect()] == [
        (0, "a", "int", True, 2, 0),
        (1, "b", "string", True, 2, 1),
    ]


# Literal rows


PEOPLE = [(k, f"person {k}", age) for k, age in enumerate((18, 64, 17, 0, 33), 1)]


def test_people(spark):
    people = rows.from_rows(spark, PEOPLE, ["id", "name", "age"])
    assert people.dtypes == [("id", "bigint"), ("name", "string"), ("age", "bigint")]
    adults = etl.filter_ge(people, "age", 18).collect()
    assert sorted(r.id for r in adults) == [1, 2, 5]


def test_inferred_types(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.5, None), (2, None, 2.5, True)], "a int, b string, c double, d boolean"
    )
    result = rows.inferred(df, ["p", "q", "r", "s"])
    assert result.dtypes == [
        ("p", "bigint"),
        ("q", "string"),
        ("r", "double"),
        ("s", "boolean"),
    ]
    assert sorted(map(tuple, result.collect())) == [(1, "x", 1.5, None), (2, None, 2.5, True)]


def test_inferred_needs_a_type_and_matching_names(spark):
    df = spark.createDataFrame([(1, None)], "a int, b void")
    with pytest.raises(ValueError, match="no single type for column 'q'"):
        rows.inferred(df, ["p", "q"])
    with pytest.raises(ValueError, match="1 names for 2 columns"):
        rows.inferred(df, ["p"])


def test_typed_reorders_and_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame(
        [(1.5, "x", datetime.datetime(2023, 5, 1, 12), 7)],
        "valor_transacao double, nome_cliente string, data_transacao timestamp_ntz,"
        " id_registro bigint",
    )
    row = rows.typed(df, rows.TRANSACTION_SCHEMA).first()
    assert tuple(row) == (7, "x", D(2023, 5, 1), 1.5)
    too_big = df.selectExpr("* EXCEPT (id_registro)", "3000000000 AS id_registro")
    with pytest.raises(Exception, match="OVERFLOW"):
        rows.typed(too_big, rows.TRANSACTION_SCHEMA).collect()
