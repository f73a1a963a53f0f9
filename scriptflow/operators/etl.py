"""The steps of the transaction ETL."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import year_is

# Fixed value: the label of the source system.
SOURCE_LABEL = "Sistema_B"


def date_parts(df: DataFrame, date_col: str = "data_transacao") -> DataFrame:
    return df.select(
        "*",
        F.year(date_col).alias("ano_transacao"),
        F.month(date_col).alias("mes_transacao"),
    )


def upper_name(df: DataFrame, name_col: str = "nome_cliente") -> DataFrame:
    return df.select("*", F.upper(name_col).alias(f"{name_col}_upper"))


def constant_column(df: DataFrame, label: str = SOURCE_LABEL) -> DataFrame:
    return df.select("*", F.lit(label).alias("source_system"))


def enrich(df: DataFrame, label: str = SOURCE_LABEL) -> DataFrame:
    """Year, month, upper-case name and source label, in the order of the report."""
    return (
        df.transform(date_parts)
        .transform(upper_name)
        .transform(constant_column, label)
        .select(
            "id_registro",
            "nome_cliente_upper",
            "data_transacao",
            "valor_transacao",
            "ano_transacao",
            "mes_transacao",
            "source_system",
        )
    )


def filter_year(
    df: DataFrame, year: int, date_col: str = "data_transacao"
) -> DataFrame:
    return df.filter(year_is(date_col, year))


def filter_ge(df: DataFrame, column: str, low) -> DataFrame:
    return df.filter(F.col(column) >= low)


def finalize(df: DataFrame) -> DataFrame:
    """Report names for the customer and the value."""
    return df.select(
        "id_registro",
        F.col("nome_cliente_upper").alias("cliente_final"),
        "data_transacao",
        F.col("valor_transacao").alias("valor_final"),
        "ano_transacao",
        "mes_transacao",
        "source_system",
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key``; every task keeps at most ``n`` of them."""
    return df.orderBy(key).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullable, and how many rows and
    NULLs it holds. One pass over the table."""
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *(F.count(name).alias(f"n_{i}") for i, name in enumerate(df.columns)),
    )
    lines = F.array(
        *(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(field.name).alias("name"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(field.nullable).alias("nullable"),
                F.col("n_rows"),
                (F.col("n_rows") - F.col(f"n_{i}")).alias("n_null"),
            )
            for i, field in enumerate(df.schema.fields)
        )
    )
    return counts.select(F.inline(lines))
