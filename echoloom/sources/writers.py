"""Writing the layers. Parquet is the table format; JSON and CSV are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom import schemas
from echoloom.operators.clean import CLEAN_COLUMNS
from echoloom.operators.insight import with_run_key

CSV_OPTIONS = {
    "header": True, "quoteAll": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
RECORDS_PER_DOCUMENT = 1000


def write_clean(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The clean layer, one folder per week, so a window of weeks reads only its folders.

    Rows are first brought together by week; the rebalance hint lets adaptive execution split a
    large week over many tasks and join small ones, so files come out at the advisory size.
    """
    clean.hint("rebalance", "week_start_date").write.mode(mode).partitionBy("week_start_date").parquet(path)


def write_clean_json(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The clean layer as documents ``{"records": [...]}`` of bounded size, one per line."""
    write_records_json(clean.select(*CLEAN_COLUMNS), path, mode)


def write_records_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as documents ``{"records": [...]}`` of at most a thousand records each.

    Each task numbers its rows and closes a document after so many, so none grows with the table and the input is
    read once.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    task, row = F.shiftrightunsigned("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    grouped = numbered.groupBy(task.alias("_task"), F.floor(row / RECORDS_PER_DOCUMENT).alias("_document")).agg(
        F.collect_list(F.struct(*df.columns)).alias("records")
    )
    grouped.select("records").write.mode(mode).json(path)


def write_clean_csv(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The eight report columns of the clean layer as CSV; the week columns are left out."""
    clean.select(*schemas.CLEAN_CSV_COLUMNS).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any report table as JSON lines."""
    report.write.mode(mode).json(path)


def write_classified(
    classified: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite"
) -> tuple[str, str]:
    """Classified rows and their summary as two tables below ``path``; returns both paths."""
    records, totals = f"{path}/records", f"{path}/summary"
    classified.write.mode(mode).parquet(records)
    summary.write.mode(mode).json(totals)
    return records, totals


def write_classified_csv(classified: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The twelve report columns of the classified layer as CSV."""
    classified.select(*schemas.CLASSIFIED_CSV_COLUMNS).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_theme_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Theme summaries as a table, one folder per run where the table names its run."""
    by_run = ["run_key"] if "run_key" in summaries.columns else []
    summaries.write.mode(mode).partitionBy(*by_run).parquet(path)


def write_pulse(pulses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pulses as JSON lines. A period without a pulse has no row and writes nothing."""
    pulses.select(*schemas.PULSE.fieldNames()).write.mode(mode).json(path)


def write_pulse_runs(pulses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pulses as a table with one folder per run key."""
    with_run_key(pulses).select(*schemas.PULSE.fieldNames(), "run_key").write.mode(mode).partitionBy(
        "run_key"
    ).parquet(path)


def write_pulse_table(pulses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pulses of one run as a table."""
    pulses.select(*schemas.PULSE.fieldNames()).write.mode(mode).parquet(path)


def append_run_log(stages: DataFrame, path: str) -> None:
    """Append stage rows of one run."""
    stages.write.mode("append").parquet(path)
