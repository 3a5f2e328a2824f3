"""Reports and manifests as files, through Spark's committer."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_suite(summary: DataFrame, path: str) -> None:
    """A report as one JSON document: the summary is small, one row for each group."""
    rows = summary.agg(F.sort_array(F.collect_list(F.struct(*summary.columns))).alias("results"), F.count("*").alias("count"))
    rows.withColumn("kind", F.lit("eval-suite")).coalesce(1).write.mode("overwrite").json(path)


def merged(host: DataFrame, browser: DataFrame) -> DataFrame:
    """Both harnesses' summaries; what one doesn't measure is null."""
    return host.withColumn("harness", F.lit("host")).unionByName(browser.withColumn("harness", F.lit("browser")), allowMissingColumns=True)


def markdown(ranked: DataFrame, columns: list[str], most: int = 200) -> str:
    """A ranking as a table, at most ``most`` rows: a report for people, in order of rank."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    show = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in ranked.orderBy("rank").limit(most).collect())])


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rows by label and domain as folders, so a reader of one label prunes the others, and their counts beside them."""
    rows.write.mode("overwrite").partitionBy("label", "domain").parquet(f"{path}/rows")
    rows.groupBy("label").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def html(summary: DataFrame, columns: list[str], order: str, title: str, most: int = 200) -> str:
    """The same as a page: a summary for people, at most ``most`` rows in the order of a column."""
    cell = lambda tag, v: f"<{tag}>{escape('—' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in columns)
    body = "".join("<tr>" + "".join(cell("td", r[c]) for c in columns) + "</tr>" for r in summary.orderBy(order).limit(most).collect())
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
