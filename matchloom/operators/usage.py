"""Usage metrics over an attempt ledger (A1-A8).  Missing metadata is counted apart and never read as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MINUTES = 15
TREND_DAYS = 90
PERIODS = {"7": 7, "30": 30, "90": 90, "all": None}
# labels shown for workflows, failure stages and failure codes; fixed values
WORKFLOW_LABELS = {
    "vacancy_requirements": "Vacancy requirements",
    "candidate_profile": "Candidate profile",
    "match_assessment": "Match assessment",
    "outreach_draft": "Outreach draft",
}
STAGE_LABELS = {
    "gateway": "Gateway",
    "application": "Application validation",
}
FAILURE_LABELS = {
    "ai_configuration_error": "AI configuration unavailable",
    "ai_invalid_response": "Structured response invalid",
    "ai_request_failed": "AI request failed",
    "ai_service_unavailable": "AI service unavailable",
    "ai_application_validation": "Application safety validation",
}
_SUMS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "total_tokens": "total_tokens", "estimated_cost_usd": "cost_usd"}


def success_rate(succeeded: Column, failed: Column) -> Column:
    """A2: percent with one digit, ties up; null where nothing has completed."""
    done = succeeded + failed
    return F.round(F.when(done > 0, (succeeded * 100).cast("decimal(20,4)") / done.cast("decimal(20,0)")), 1).cast("decimal(5,1)")


def metrics(columns: list[str]) -> list[Column]:
    """A1, A3: one-pass aggregates for the ledger columns that are there."""
    with_id = F.col("provider_request_id") != ""
    status = lambda s: F.count_if(F.col("status") == s)
    out = [F.count("*").alias("attempts"), status("succeeded").alias("succeeded"), status("failed").alias("failed"), status("pending").alias("pending")]
    out.append(success_rate(status("succeeded"), status("failed")).alias("success_rate"))
    for name, short in _SUMS.items():
        if name in columns:
            out += [F.coalesce(F.sum(name), F.lit(0)).alias(short), F.count(name).alias(f"{short}_known"), (F.count("*") - F.count(name)).alias(f"{short}_missing")]
    if "duration_ms" in columns:
        out += [F.avg(F.col("duration_ms").cast("decimal(16,3)")).cast("decimal(16,3)").alias("average_duration_ms"), F.count("duration_ms").alias("duration_known"), (F.count("*") - F.count("duration_ms")).alias("duration_missing")]
    return out + [
        F.coalesce(F.sum(F.when(with_id, F.col("retries_used"))), F.lit(0)).alias("retries_used"), F.count_if(with_id & (F.col("retries_used") > 0)).alias("retried_attempts"),
        F.count_if(with_id).alias("retries_known"), F.count_if(~F.coalesce(with_id, F.lit(False))).alias("retries_missing"),
        F.count_if(F.col("model") != "").alias("model_known"), F.count_if(F.coalesce(F.col("model"), F.lit("")) == "").alias("model_missing"),
    ]


def within(ledger: DataFrame, now: str, period: str = "30", workflow: str = "all") -> DataFrame:
    """An unknown period counts as 30 days, an unknown workflow as all."""
    days = PERIODS.get(period, 30)
    if days is not None:
        ledger = ledger.filter(F.col("started_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return ledger.filter(F.col("workflow") == workflow) if workflow in WORKFLOW_LABELS else ledger


def _label(labels: dict[str, str], code: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code), other)


def overall(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("org_id").agg(*metrics(ledger.columns))


def by_dimension(ledger: DataFrame) -> DataFrame:
    """A4: all, each workflow and each named model of every tenant, in one pass over grouping sets; with labels, and positions by label in any case."""
    rows = ledger.groupingSets([["org_id"], ["org_id", "workflow"], ["org_id", "model"]], "org_id", "workflow", "model").agg(F.grouping_id().alias("g"), *metrics(ledger.columns))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "workflow").otherwise("model")
    rows = rows.withColumn("dimension", kind).withColumn("value", F.coalesce(F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("workflow")).otherwise(F.col("model")), F.lit("")))
    rows = rows.filter("dimension = 'all' or value <> ''").drop("workflow", "model", "g").withColumn("label", F.when(F.col("dimension") == "workflow", _label(WORKFLOW_LABELS, F.col("value"), F.col("value"))).otherwise(F.col("value")))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("org_id", "dimension").orderBy(F.lower("label"), "value")))


def failures(ledger: DataFrame) -> DataFrame:
    """A5: failed attempts by stage and code, with their labels."""
    rows = ledger.filter("status = 'failed'").groupBy("org_id", "failure_stage", "failure_code").agg(F.count("*").alias("n"))
    return rows.withColumns({"stage_label": _label(STAGE_LABELS, F.col("failure_stage"), F.lit("Recorded failure")), "label": _label(FAILURE_LABELS, F.col("failure_code"), F.lit("Other recorded failure"))})


def daily(ledger: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """The last ``days`` days that have rows, for each tenant."""
    rows = ledger.groupBy("org_id", F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.count("total_tokens").alias("tokens_known"),
    )
    last = Window.partitionBy("org_id").orderBy(F.desc("day"))
    return rows.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= days).drop("n")


def stale_pending(ledger: DataFrame, now: str, minutes: int = STALE_MINUTES) -> DataFrame:
    """Pending attempts begun over ``minutes`` before now; tenants without any are kept with zero."""
    old = (F.col("status") == "pending") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return ledger.groupBy("org_id").agg(F.count_if(old).alias("stale_pending"))


def completions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """K9: starts(event_id, ..., pending) joined with ends(event_id, ok, from_gateway, failure_code): status, stage and code.

    Unknown gateway codes become the generic one; other failures are application
    validation.  Starts without an end stay pending.
    """
    rows = starts.drop("status", "failure_stage", "failure_code").join(ends, "event_id", "left")
    known = F.col("failure_code").isin(*[c for c in FAILURE_LABELS if c != "ai_application_validation"])
    failed = F.col("ok") == F.lit(False)
    status = F.when(F.col("ok").isNull(), "pending").when(failed, "failed").otherwise("succeeded")
    code = F.when(~failed | F.col("ok").isNull(), "").when(F.col("from_gateway"), F.when(known, F.col("failure_code")).otherwise("ai_request_failed")).otherwise("ai_application_validation")
    stage = F.when(~failed | F.col("ok").isNull(), "").when(F.col("from_gateway"), "gateway").otherwise("application")
    return rows.withColumns({"status": status, "failure_stage": stage, "failure_code": code}).drop("ok", "from_gateway")
