"""Verdicts of golden cases and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx


def case_verdicts(cases: DataFrame) -> DataFrame:
    """Checks of each case against its response, and a list of what failed.

    ``cases`` carries ``expected_…`` and actual ``intent``, ``tool``, ``action``, ``status``, the arrays
    ``must_include`` and ``must_not_include``, ``answer`` and ``evidence_count``.
    """
    same = {part: F.col(part).eqNullSafe(F.col(f"expected_{part}")) for part in ("intent", "tool", "action")}
    expects_status = tx.blank_to_null("expected_status").isNotNull()
    status_ok = ~expects_status | F.col("status").eqNullSafe(F.col("expected_status"))
    missing = F.filter("must_include", lambda w: ~F.contains(F.col("answer"), w))
    present = F.filter("must_not_include", lambda w: F.contains(F.col("answer"), w))
    evidence_ok = (
        F.when(F.coalesce(F.col("expected_status"), F.lit("")) == "insufficient_evidence", F.col("evidence_count") == 0)
        .when(F.col("tool") == "regulation_tool", F.col("evidence_count") > 0)
        .otherwise(True)
    )

    def expected(part: str, ok: Column) -> Column:
        shown = F.format_string(
            f"{part} expected=%s actual=%s",
            F.coalesce(f"expected_{part.removeprefix('answer_')}", F.lit("None")),
            F.coalesce(part.removeprefix("answer_"), F.lit("None")),
        )
        return F.when(~ok, shown)

    listed = cases.withColumn("_missing", missing).withColumn("_present", present)
    failures = F.array_compact(
        F.array(
            *[expected(part, ok) for part, ok in same.items()],
            expected("answer_status", status_ok),
            F.when(F.size("_missing") > 0, F.concat(F.lit("missing="), F.array_join("_missing", ","))),
            F.when(F.size("_present") > 0, F.concat(F.lit("forbidden_present="), F.array_join("_present", ","))),
            F.when(~evidence_ok, F.format_string("evidence_count=%d", F.col("evidence_count"))),
        )
    )
    return listed.select(
        "name",
        *[ok.alias(f"{part}_ok") for part, ok in same.items()],
        (status_ok & (F.size("_missing") == 0) & (F.size("_present") == 0)).alias("answer_ok"),
        evidence_ok.alias("evidence_ok"),
        "latency_ms",
        failures.alias("failures"),
    )


def pass_rate(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))


def interpolated_percentile(value: str, fraction: float) -> Column:
    """Linear between neighbours; zero for no values.

    The aggregate keeps a count per distinct value, so values should come from a bounded range.
    """
    return F.coalesce(F.percentile(value, fraction), F.lit(0.0))


def evaluation_report(verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pass rates and latency percentiles of verdicts, over all or per key.

    The percentiles are exact and keep a count per distinct latency.
    """
    return verdicts.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("cases"),
        *[pass_rate(f"{part}_ok").alias(f"{part}_rate") for part in ("intent", "tool", "action", "answer", "evidence")],
        F.coalesce(F.median("latency_ms"), F.lit(0.0)).alias("p50_latency_ms"),
        interpolated_percentile("latency_ms", 0.95).alias("p95_latency_ms"),
        F.bool_and(F.size("failures") == 0).alias("all_passed"),
    )
