"""The transaction ETL as one flow."""

from pyspark.sql import DataFrame

from ..operators.etl import SOURCE_LABEL, enrich, filter_year, finalize
from ..sources.workspace import Workspace

# Where the flow keeps its tables, relative to the run.
STAGED = "intermediate_data/transactions_filtered.parquet"
REPORT = "output_data/final_report.parquet"


def report_rows(raw: DataFrame, year: int, label: str = SOURCE_LABEL) -> DataFrame:
    """The report of one year, with no table written on the way.

    The year is filtered before the enrichment, as a range on the raw date, so it
    reaches the scan.
    """
    return (
        raw.transform(filter_year, year).transform(enrich, label).transform(finalize)
    )


def stage_years(
    workspace: Workspace, raw: DataFrame, label: str = SOURCE_LABEL, staged: str = STAGED
) -> None:
    """Enrich and stage by year; years that ``raw`` has no rows for stay as they are."""
    workspace.write_partitions(raw.transform(enrich, label), staged, "ano_transacao")


def report_of_years(workspace: Workspace, *years: int, staged: str = STAGED) -> DataFrame:
    """The report of some staged years; the folders of the others are not read."""
    rows = workspace.read(staged)
    return rows.filter(rows["ano_transacao"].isin(*years)).transform(finalize)


def run_etl(
    workspace: Workspace,
    raw: DataFrame,
    year: int,
    label: str = SOURCE_LABEL,
    staged: str = STAGED,
    report: str = REPORT,
) -> DataFrame:
    """Filter and enrich, stage, rename, write; returns the written report.

    Staging cuts the plan: what follows reads the staged table and survives the
    loss of the executors that made it.
    """
    filtered = raw.transform(filter_year, year).transform(enrich, label)
    return workspace.stage(
        workspace.stage(filtered, staged).transform(finalize), report
    )
