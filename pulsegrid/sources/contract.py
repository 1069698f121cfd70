"""Checks that a message source keeps its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.messages import MESSAGE


class ContractError(ValueError):
    """A source that does not keep its contract."""


def report(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: lines read, shares of lines that are no message or have no sent_at, and the ingest lag in ms."""
    m = lines.select(F.from_json(line, MESSAGE).alias("m")).select("m.*")
    lag = F.col("timestamp") - F.col("sent_at")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0))
    return m.agg(
        F.count("*").alias("rows_read"),
        share(F.col("broadcaster_id").isNull()).alias("unparsed_share"),
        share(F.col("sent_at").isNull()).alias("no_sent_at_share"),
        F.min(lag).alias("lag_min"),
        F.percentile(lag, F.lit(0.5)).alias("lag_p50"),
        F.max(lag).alias("lag_max"),
    )


def check(lines: DataFrame, line: str = "line", warn_only: bool = False) -> list[str]:
    """What is wrong with a sample of lines; raises ContractError unless warn_only."""
    r = report(lines, line).first()
    wrong = [
        text for bad,
        text in (
            (r["rows_read"] == 0, "there are no messages"),
            (r["unparsed_share"] > 0, "some lines are no messages"),
            (r["no_sent_at_share"] > 0, "some messages have no sent_at"),
        ) if bad
    ]
    if wrong and not warn_only:
        raise ContractError("; ".join(wrong))
    return wrong
