"""Review queue, contact permission, status transitions, roll-ups (O, F, A9-A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import strip
from .versions import first_failing, latest

TRANSITIONS = (("draft", "open"), ("open", "paused"), ("open", "closed"), ("paused", "open"), ("paused", "closed"), ("closed", "open"))


def category() -> Column:
    """O1: changed inputs first, then gaps, uncertainty, ambiguity, and last what is routine."""
    return F.when(F.col("changed"), 0).when(F.col("gaps") > 0, 1).when(F.col("uncertain") > 0, 2).when(F.col("ambiguities") > 0, 3).otherwise(4)


def queue(assessments: DataFrame) -> DataFrame:
    """O1, O2: the latest assessment of each entry with its category."""
    return latest(assessments, ["entry_id"], [F.desc("version")]).withColumn("category", category())


def page(items: DataFrame, number: int, size: int = 25) -> DataFrame:
    """One page in priority order; the sort is cut off at the page's last row."""
    order = [F.col("category"), F.desc("gaps"), F.desc("uncertain"), F.desc("ambiguities"), F.desc("version"), F.col("entry_id")]
    upto = items.orderBy(*order).limit(number * size)
    ranked = upto.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("position") > (number - 1) * size)


def scope(items: DataFrame, name: str) -> DataFrame:
    """O3: pending, changed, focus or all; an unknown name counts as pending."""
    rules = {"changed": F.col("changed"), "focus": F.col("category") < 4, "all": F.lit(True)}
    return items.filter(rules.get(name, F.col("changed") | (F.col("decision") == "pending")))


def queue_counts(items: DataFrame) -> DataFrame:
    """O2: total, focus, changed, routine, and decisions; those of changed items don't stand any more."""
    stands = lambda d: F.count_if(~F.col("changed") & (F.col("decision") == d)).alias(d)
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.col("category") < 4).alias("focus"), F.count_if("changed").alias("changed"), F.count_if(F.col("category") == 4).alias("routine"),
        F.count_if(F.col("changed") | (F.col("decision") == "pending")).alias("pending"), stands("approved"), stands("rejected"), stands("revisit"),
    )


def contact_gate(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """the first reason against contacting each candidate, else ok."""
    any_ = lambda c, v: F.bool_or(F.col(c) == v)
    flags = sources.groupBy("candidate_id").agg(
        any_("consent_status", "withdrawn").alias("a"), any_("contact_permission", "withdrawn").alias("b"), any_("contact_permission", "restricted").alias("c"), any_("contact_permission", "permitted").alias("d"),
    )
    rows = candidates.select("candidate_id").join(flags, "candidate_id", "left")
    gate = first_failing([(F.col("d").isNull(), "no_provenance"), (F.col("a"), "consent_withdrawn"), (F.col("b"), "permission_withdrawn"), (F.col("c"), "permission_restricted"), (~F.col("d"), "not_permitted")])
    return rows.select("candidate_id", gate.alias("contact_gate"))


def transition_issues(log: DataFrame, vacancies: DataFrame) -> DataFrame:
    """logged changes of vacancies that were not allowed, with the reason."""
    allowed = F.concat_ws(">", "from_status", "to_status").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    rows = log.join(vacancies.select("vacancy_id", "is_deleted"), "vacancy_id")
    reason = F.when(F.col("is_deleted"), "vacancy_deleted").when(~allowed, "transition_not_allowed").when((F.col("to_status") == "open") & ~F.col("requirements_confirmed"), "requirements_not_confirmed")
    return rows.withColumn("reason", reason).filter("reason is not null")


def has_requirements(columns: dict[str, str]) -> Column:
    """any structured field is there; columns maps names to 'text', 'array' or 'number'."""
    tests = {"text": lambda c: strip(F.coalesce(F.col(c), F.lit(""))) != "", "array": lambda c: F.coalesce(F.size(c), F.lit(0)) > 0, "number": lambda c: F.col(c).isNotNull()}
    out = F.lit(False)
    for name, kind in columns.items():
        out = out | tests[kind](name)
    return out


def profile_gate(documents: DataFrame, limit: int = 60_000) -> DataFrame:
    """the first reason against reading a profile from each document, else ok."""
    return documents.withColumn("profile_gate", first_failing([
        (F.col("is_deleted"), "document_deleted"), (F.col("document_type") != "cv", "not_a_cv"), (F.col("extraction_status") != "succeeded", "not_extracted"),
        (strip(F.coalesce("text", F.lit(""))) == "", "no_text"), (F.length("text") > limit, "text_too_long"),
    ]))


def job_rollup(tasks: DataFrame) -> DataFrame:
    """Counts by status; unfinished jobs run on, skipped or failed tasks are errors."""
    of = lambda s: F.count_if(F.col("status") == s)
    rows = tasks.groupBy("job_id").agg(F.count("*").alias("tasks"), *[of(s).alias(s) for s in ("succeeded", "skipped", "failed", "queued")])
    status = F.when(F.col("queued") > 0, "running").when(F.col("skipped") + F.col("failed") > 0, "completed_with_errors").otherwise("succeeded")
    return rows.withColumn("job_status", status)


def dashboard(organizations: DataFrame, candidates: DataFrame, vacancies: DataFrame, clients: DataFrame) -> DataFrame:
    """Active clients, active candidates and open vacancies of each organisation."""
    n = lambda df, cond, name: df.filter(cond).groupBy("org_id").agg(F.count("*").alias(name))
    rows = organizations.select("org_id")
    for part in (n(clients, "is_active", "active_clients"), n(candidates, "status = 'active'", "active_candidates"), n(vacancies, "status = 'open' and not is_deleted", "open_vacancies")):
        rows = rows.join(part, "org_id", "left")
    return rows.fillna(0)


def listing(rows: DataFrame, kind: str, after: tuple | None = None, size: int = 20) -> DataFrame:
    """Candidates by name and id, vacancies newest first; pages by keyset, so a later page doesn't sort the earlier ones.

    ``after`` is the sort key of the last row seen.
    """
    first, second = ("full_name", "candidate_id") if kind == "candidate" else ("created_at", "vacancy_id")
    up = kind == "candidate"
    if after is not None:
        a, b = F.lit(after[0]), F.lit(after[1])
        past = (F.col(first) > a) if up else (F.col(first) < a)
        rows = rows.filter(past | ((F.col(first) == a) & ((F.col(second) > b) if up else (F.col(second) < b))))
    return rows.orderBy(*[F.col(c) if up else F.desc(c) for c in (first, second)]).limit(size)


def minimised(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """F8: only the allowed columns, whatever else rows holds."""
    return rows.select(*[c for c in allowed if c in rows.columns])


#: Rows of one key that a task joins at most.
MOST_OF_KEY = 200_000


def _with_parent(rows: DataFrame, parent: DataFrame, reference: str, key: str, most: int = MOST_OF_KEY) -> DataFrame:
    """rows with the columns of their parent; a key of more than ``most`` rows, null among them, is dealt to several tasks, its parent to each."""
    # one row for each ``most`` rows at most, so small enough to be broadcast
    hot = rows.groupBy(F.col(reference).alias("_key")).count().filter(F.col("count") > most).select("_key", F.ceil(F.col("count") / most).cast("int").alias("_tasks"))
    parts = lambda df, c: df.join(F.broadcast(hot), F.col(c).eqNullSafe(F.col("_key")), "left").drop("_key")
    told = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    left = parts(rows, reference).withColumn("_part", F.pmod(F.xxhash64(*told), F.coalesce("_tasks", F.lit(1)))).drop("_tasks")
    right = parts(parent, key).withColumn("_of", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
    return left.hint("merge").join(right.hint("merge"), (F.col(reference) == F.col(key)) & (F.col("_part") == F.col("_of")), "left").drop("_part", "_of")


def denormalise(rows: DataFrame, parents: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows with the columns of their parents, prefixed by the parent's name.

    parents gives for each name its table, the column of rows that refers to it, which
    may come from an earlier parent, and its id, which is unique.  Rows without a
    parent keep nulls.  A parent of a parent is joined to the latter, not to the rows.
    """
    named = {name: df.toDF(*[f"{name}_{c}" for c in df.columns]) for name, (df, _, _) in parents.items()}
    shown = [*rows.columns, *[c for df in named.values() for c in df.columns]]
    own = {name: set(df.columns) for name, df in named.items()}
    names = list(parents)
    for i, name in reversed(list(enumerate(names))):
        _, reference, key = parents[name]
        if child := next((n for n in names[:i] if reference in own[n] and reference not in rows.columns), None):
            named[child] = _with_parent(named[child], named.pop(name), reference, f"{name}_{key}")
    for name, df in named.items():
        rows = _with_parent(rows, df, parents[name][1], f"{name}_{parents[name][2]}")
    return rows.select(*[F.col(f"`{c}`") for c in shown])


def attach(parents: DataFrame, children: DataFrame, key: str, order: str, most: int = 1000) -> DataFrame:
    """Parents with their children as ordered arrays of at most ``most``: one row a parent, further blocks as further rows."""
    place = Window.partitionBy(key).orderBy(order)
    rest = [order, *[c for c in children.columns if c not in (key, order)]]
    rows = children.withColumn("block", ((F.row_number().over(place) - 1) / most).cast("int"))
    arrays = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("children"))
    n = children.groupBy(key).agg(F.count("*").alias("n_children"))
    return parents.join(n, key, "left").join(arrays, key, "left").fillna({"n_children": 0, "block": 0})
