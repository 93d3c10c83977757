"""Streaming operators run to the end over the given tables (availableNow), with the batch result as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir
from ..operators import scoring, signatures
from ..streaming import ledgers as T
from .fixtures import VIEWS, oracle, view
from .matching_queries import told


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a glob reads a table of one file and one of many alike
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")
    times = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"}
    return rows.withColumns(times) if times else rows


def _drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """All rows that the stream puts out, written to the shared folder and read again."""
    out, state = _folder(spark, name), _folder(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _batches(stream: DataFrame, spark: SparkSession, name: str, run, state: str = "") -> None:
    """All that the stream has; runs with the same state folder go on where the last one ended."""
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", state or _folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VIEWS["fx_usage"], events=_stream(spark, sf_dir, "events"))


def stream_usage(spark, sf_dir):
    """T1; windows that the watermark hasn't closed are not out yet, so the last days stay behind."""
    rows = _drain(T.usage_windows(_ledger(spark, sf_dir)), spark, "usage")
    return rows.select("org_id", "workflow", "window_start", "attempts", "succeeded", "failed", "pending", "total_tokens", "total_tokens_known")


def stream_sessions(spark, sf_dir):
    """T5."""
    return _drain(T.sessions(_stream(spark, sf_dir, "events"), "6 hours"), spark, "sessions")


def stream_new_documents(spark, sf_dir):
    """The first document of each content and tenant, against a registry of every tenth document."""
    docs = _stream(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5).cast("int").alias("org_id"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), F.lit("2024-01-01").cast("timestamp").alias("seen_at")
    )
    out = _folder(spark, "new-documents")
    held = view(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select((F.col("doc_id") % 5).cast("int").alias("org_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    _batches(T.new_documents(docs), spark, "new-documents", T.against_registry(lambda: held, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")))
    return spark.read.parquet(out).select("org_id", "sha256").distinct()


def stream_stale_starts(spark, sf_dir):
    """Pending events have no end, others end after a minute; out come those whose time the watermark has passed."""
    u = _ledger(spark, sf_dir)
    ends = _ledger(spark, sf_dir).filter("status <> 'pending'").select("event_id", (F.col("started_at") + F.expr("INTERVAL 1 MINUTE")).alias("completed_at"))
    return _drain(T.stale_starts(u, ends), spark, "stale").groupBy("org_id").agg(F.count("*").alias("stale"), F.sum("event_id").alias("id_sum"), F.max("started_at").alias("last"))


def stream_refresh(spark, sf_dir):
    """T4: two batches of candidate hashes; in the second some of one organisation are new, and its shortlists alone are rebuilt."""
    v = lambda n: view(spark, sf_dir, n)
    skills, feed, out = v("fx_candidate_skill"), _folder(spark, "snapshots"), _folder(spark, "refresh")
    now = signatures.candidate_hashes(v("fx_candidate"), skills)
    then = signatures.candidate_hashes(v("fx_candidate").filter("not (org_id = 1 and candidate_id % 31 = 5)"), skills)

    def rebuild(orgs: DataFrame) -> DataFrame:
        req = v("fx_requirements").join(orgs, "org_id", "left_semi")
        mine = lambda n: v(n).join(req, "requirements_id", "left_semi")
        return scoring.shortlist(req, mine("fx_requirement_skill"), mine("fx_rule"), v("fx_candidate"), skills, **told(spark, sf_dir))

    def write(df: DataFrame, epoch: int) -> None:
        if epoch:  # the first batch, which only fills the state, needs no rebuilt lists here
            df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    state = _folder(spark, "refresh-state")
    for epoch, rows in enumerate((then, now)):  # what comes in between two runs, in however many files, is one batch
        rows.select("org_id", F.col("candidate_id").cast("long").alias("candidate_id"), F.lit(epoch).cast("long").alias("version"), "hash").write.mode("append").parquet(feed)
        snapshots = spark.readStream.schema("org_id int, candidate_id long, version long, hash string").parquet(feed)
        _batches(T.changed_in_stream(snapshots), spark, "refresh", T.refresh_shortlists(rebuild, write), state)
    return spark.read.parquet(out).select("requirements_id", "rank", "candidate_id", "score_cents")


def sql() -> dict[str, str]:
    from .matching_queries import _ALL, _POINTS, _RANKED, _over

    return {
        "stream_usage": oracle("""
            SELECT org_id, workflow, date_trunc('day', started_at)::TIMESTAMP AS window_start, count(*) AS attempts, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
              count(*) FILTER (status = 'pending') AS pending, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(total_tokens) AS total_tokens_known
            FROM {fx_usage} WHERE date_trunc('day', started_at) + INTERVAL 1 DAY <= (SELECT max(started_at) - INTERVAL 1 DAY FROM {fx_usage}) GROUP BY 1, 2, 3"""),
        "stream_new_documents": oracle("""
            WITH d AS (SELECT DISTINCT CAST(doc_id % 5 AS INT) AS org_id, coalesce(text, '') AS x FROM {documents})
            SELECT org_id, sha256(x) AS sha256 FROM d WHERE NOT EXISTS (SELECT 1 FROM {documents} r WHERE r.doc_id % 10 = 0 AND r.doc_id % 5 = d.org_id AND coalesce(r.text, '') = d.x)"""),
        "stream_sessions": oracle("""
            WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM {events}),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS n FROM e),
            w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end_, count(*) AS events FROM s GROUP BY user_id, n)
            SELECT user_id, start, end_ AS "end", events FROM w WHERE end_ <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events})"""),
        "stream_stale_starts": oracle("""
            WITH w AS (SELECT least(max(started_at), max(CASE WHEN status <> 'pending' THEN started_at + INTERVAL 1 MINUTE END)) - INTERVAL 1 MINUTE AS passed FROM {fx_usage})
            SELECT org_id, count(*) AS stale, CAST(sum(event_id) AS BIGINT) AS id_sum, max(started_at) AS last FROM {fx_usage} CROSS JOIN w WHERE status = 'pending' AND started_at + INTERVAL 15 MINUTE < passed GROUP BY 1"""),
        "stream_refresh": _over(f"WITH {_POINTS}, {_ALL}, {_RANKED} SELECT k.requirements_id, rank, candidate_id, score_cents FROM ranked k JOIN {{fx_requirements}} r ON r.requirements_id = k.requirements_id WHERE rank <= 20 AND r.org_id = 1"),
    }


QUERIES = (stream_usage, stream_sessions, stream_new_documents, stream_stale_starts, stream_refresh)
