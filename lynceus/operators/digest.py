"""Tier-ranked digests and operational metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.filters import added_within, in_window, not_rejected, optional_since
from lynceus.operators.merge import first_by_key, insert_only

REASONS = {1: "KEV + known ransomware use", 2: "KEV added this week", 3: "public exploit reference + CVSS >= 9", 4: "CRITICAL severity with HIGH confidentiality impact", 5: "modified in window"}


def window_dates(today: dt.date, days: int = 7, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Half-open window, by default the ``days`` days before today."""
    end = end or today
    start = start or end - dt.timedelta(days=days)
    if start >= end:
        raise ValueError("the window must start before it ends")
    return start, end


def window_rows(cves: DataFrame, start: str, end: str, ingested_after: str | None = None, any_case: bool = False) -> DataFrame:
    return cves.where(not_rejected(any_case=any_case) & optional_since("ingested_at", ingested_after) & in_window(start, end))


def tier(start: str, end: str) -> Column:
    return (
        F.when(F.col("is_kev") & (F.col("kev_ransomware_use") == "Known"), 1)
        .when(added_within(start, end), 2)
        .when(F.col("has_exploit_ref") & (F.col("cvss_score") >= 9), 3)
        .when((F.col("cvss_severity") == "CRITICAL") & (F.col("confidentiality_impact") == "HIGH"), 4)
        .otherwise(5)
    )


def with_reason(rows: DataFrame) -> DataFrame:
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return rows.withColumn("tier_reason", F.element_at(reasons, F.col("tier")))


def _down(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def top(cves: DataFrame, start: str, end: str, *, max_tier: int = 4, limit: int = 10, ingested_after: str | None = None) -> DataFrame:
    """The most dangerous rows of the window; ties by id."""
    rows = window_rows(cves, start, end, ingested_after).withColumn("tier", tier(start, end)).where(F.col("tier") <= max_tier)
    return with_reason(rows.orderBy("tier", *_down("kev_date_added", "cvss_score", "exploitability_score", "impact_score", "last_modified"), "cve_id").limit(limit))


def newly_added(cves: DataFrame, start: str, end: str, *, limit: int = 5, ingested_after: str | None = None) -> DataFrame:
    """Rows that joined the exploited list in the window, those of ransomware first; all of tier 2."""
    rows = cves.where(not_rejected() & optional_since("ingested_at", ingested_after) & added_within(start, end)).withColumn("tier", F.lit(2))
    ransomware = F.when(F.col("kev_ransomware_use") == "Known", 0).otherwise(1)
    return with_reason(rows.orderBy(*_down("kev_date_added"), ransomware, *_down("cvss_score", "exploitability_score", "impact_score"), "cve_id").limit(limit))


def summary(cves: DataFrame, start: str, end: str, ingested_after: str | None = None) -> DataFrame:
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return window_rows(cves, start, end, ingested_after).agg(
        F.count("*").alias("total_modified"),
        F.count_if((F.col("published_date") >= first) & (F.col("published_date") < last)).alias("newly_published"),
        F.count_if(F.col("cvss_severity") == "CRITICAL").alias("critical_count"),
        F.count_if(added_within(start, end)).alias("kev_added_count"),
        F.count_if(F.col("is_kev") & (F.col("kev_ransomware_use") == "Known")).alias("kev_ransomware_count"),
        F.count_if("has_exploit_ref").alias("has_exploit_ref_count"),
    )


def brief_items(top_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Both lists, each id once; the first list wins."""
    both = top_rows.select("cve_id", "tier", F.lit(0).alias("list")).unionByName(new_rows.select("cve_id", "tier", F.lit(1).alias("list")))
    return first_by_key(both, ["cve_id"], [F.col("list")])


def overview(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of every table."""
    counts = [t.agg(F.count("*").alias(name)) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def severity_distribution(cves: DataFrame, column: str = "cvss_severity") -> DataFrame:
    """Counts by severity, ``UNKNOWN`` for none, worst first."""
    level = F.upper(F.coalesce(F.col(column), F.lit("UNKNOWN")))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN")]), F.col("severity")), F.lit(0)), F.lit(99))
    return cves.groupBy(level.alias("severity")).agg(F.count("*").alias("n")).orderBy(order, "severity")


def freshness(runs: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: for each output name the last completion of any of its sources."""
    done = F.col("completed_at")
    return runs.agg(*[F.max(F.when(F.col("source").isin(*sources), done)).alias(name) for name, sources in keys.items()])


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Latest runs with their length in seconds, by second boundaries crossed."""
    seconds = F.unix_timestamp(F.date_trunc("second", "completed_at")) - F.unix_timestamp(F.date_trunc("second", "started_at"))
    return runs.withColumn("duration_s", seconds).orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(limit)


def top_exploited(cves: DataFrame, limit: int = 5) -> DataFrame:
    return cves.where("is_kev").orderBy(*_down("cvss_score", "kev_date_added"), "cve_id").limit(limit)


def cost_by_stage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("estimated_cost_usd").alias("cost_usd"), F.min("created_at").alias("first_call"), F.max("created_at").alias("last_call"),
    )


def estimated_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``estimated_cost_usd``; null for a model that has no price (dollars a million tokens)."""
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    return usage.join(F.broadcast(prices), "model", "left").withColumn("estimated_cost_usd", F.round(cost, 6).cast("decimal(14,6)")).drop("input_price", "output_price")  # a price list is small


def spent_by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("estimated_cost_usd").alias("spent"))


def within_budget(usage: DataFrame, day: str, budget: float) -> DataFrame:
    """One row: what a day has cost, and whether more may be spent."""
    spent = F.coalesce(F.sum("estimated_cost_usd"), F.lit(0))
    return usage.where(F.to_date("created_at") == F.lit(day).cast("date")).agg(spent.alias("spent"), (spent < budget).alias("allowed"))


def cold_start(cves: DataFrame, column: str = "last_modified") -> DataFrame:
    return cves.agg(F.coalesce(F.max(column).cast("date"), F.lit("2000-01-01").cast("date")).alias("start"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Token statistics by document type, and how many chunks have a sub-section."""
    return chunks.groupBy("document_type").agg(
        F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.median("token_count").alias("median_tokens"), F.max("token_count").alias("max_tokens"),
        F.round(F.avg(F.when(F.col("sub_section").isNotNull(), 1.0).otherwise(0.0)), 6).alias("sub_section_rate"),
    )


def joined_text(chunks: DataFrame, parent: str, text: str, order: str, separator: str = "\n\n") -> DataFrame:
    """Texts of each parent in order, as one string; null texts are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return chunks.groupBy(parent).agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias("text"))


def log_usage(log: DataFrame, calls: DataFrame, prices: DataFrame) -> DataFrame:
    """The log with a batch of calls appended at their estimated cost; a call that is logged already is left out."""
    return insert_only(log, estimated_cost(calls, prices), ["log_id"])


def run_usage(evidence: DataFrame, synthesis: DataFrame, run: str = "run_id") -> DataFrame:
    """Calls, tokens and cost of each run: over its pieces of evidence, and the one call that wrote the text.

    Both have ``run, calls, input_tokens, output_tokens, cost_usd``; a synthesis that used no tokens is no call.
    """
    names = ("calls", "input_tokens", "output_tokens", "cost_usd")
    written = synthesis.select(run, F.when(F.coalesce("input_tokens", F.lit(0)) > 0, 1).otherwise(0).alias("calls"), *names[1:])
    return evidence.select(run, *names).unionByName(written).groupBy(run).agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names])
