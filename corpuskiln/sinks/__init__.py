"""Where results go: tables, JSON artifacts, reports; all can be rehearsed without writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A report is read by people: a table of more rows than this is refused, not cut.
REPORT_ROWS = 10_000


def write_table(df: DataFrame, path: str, partition_by: str | None = None, dry_run: bool = False) -> None:
    """Writes Parquet; with a partition column only the partitions that occur are replaced.  A dry run executes without writing."""
    if dry_run:
        df.write.format("noop").mode("overwrite").save()
        return
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Every row as one JSON text, null fields left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def item_line(title: Column, url: Column, source: Column, note: Column) -> Column:
    """A line of a brief: the linked title, its source, and a note if there is one."""
    return F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(") — "), F.coalesce(source, F.lit("?")), F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(": "), note)).otherwise(""))


def markdown(title: str, df: DataFrame) -> str:
    """A small frame as a Markdown table; give the few rows that are to be read."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
