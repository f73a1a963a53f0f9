"""Rows to tables: with a declared schema, or with types inferred."""

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The transaction schema and the columns of a prepared input.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("id_registro", T.IntegerType()),
        T.StructField("nome_cliente", T.StringType()),
        T.StructField("data_transacao", T.DateType()),
        T.StructField("valor_transacao", T.DoubleType()),
    ]
)
INPUT_SCHEMA = T.StructType(
    [
        T.StructField("coluna_a", T.LongType()),
        T.StructField("coluna_b", T.StringType()),
        T.StructField("data_evento", T.TimestampNTZType()),
    ]
)


def from_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A few literal rows, with a ``StructType`` or with names only."""
    return spark.createDataFrame(rows, schema)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of a table under a declared schema.

    Columns are matched by name, reordered and cast as on a table insert; a value
    that does not fit its column is an error.
    """
    return df.to(schema)


def inferred(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a table under new names, each column as a Python reader of its
    values would type it: integers are ``bigint`` whatever their width, ``float``
    becomes ``double``, and all else stays.

    The types follow from the schema, so nothing is read before the result is. A
    column of NULL type has no values to tell its type and is an error.
    """
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    wider = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    for (_, kind), name in zip(df.dtypes, names):
        if kind in ("void", "variant"):
            raise ValueError(f"no single type for column {name!r}: {kind}")
    return df.select(
        *(
            F.col(f"`{old}`").cast(wider.get(kind, kind)).alias(new)
            for (old, kind), new in zip(df.dtypes, names)
        )
    )


def default_input(spark: SparkSession) -> DataFrame:
    """The prepared input: three rows, timestamps in microseconds."""
    # Fixed values.
    rows = [
        (15, "exemplo1", datetime.datetime(2022, 3, 10)),
        (25, "exemplo2", datetime.datetime(2023, 7, 22)),
        (35, "exemplo3", datetime.datetime(2024, 12, 5)),
    ]
    return from_rows(spark, rows, INPUT_SCHEMA)
