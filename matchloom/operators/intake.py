"""Entity resolution, import triage and identity proposals (I, J7, J8, S2, X1-X5, U5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.normalize import email_key, phone_key, strip, taxonomy

KINDS = ("email", "phone", "source reference")


def keys(rows: DataFrame, id_column: str) -> DataFrame:
    """(org_id, kind, key, id) in long form, so that matching on any key is one equi-join.  Blank keys are left out."""
    listed = F.array(
        F.struct(F.lit(0).alias("kind"), email_key(F.coalesce("email", F.lit(""))).alias("key")),
        F.struct(F.lit(1).alias("kind"), phone_key(F.col("phone")).alias("key")),
        F.struct(F.lit(2).alias("kind"), strip(F.coalesce("source_reference", F.lit(""))).alias("key")),
    )
    long = rows.select("org_id", F.col(id_column).alias("id"), F.explode(listed).alias("x"))
    return long.select("org_id", "id", "x.kind", "x.key").filter("key <> ''")


def identity_matches(rows: DataFrame, pool: DataFrame, row_id: str = "row_number") -> DataFrame:
    """For each row with a match its candidate (the smallest if several), whether several match, and by what.

    One candidate gives the kinds that lead to it; several give the kinds that
    lead to any and the note conflicting.  Names are never identity.  The
    candidates of a key are reduced to the first and the last before any row
    meets them, so a number that very many share makes no pairs.
    """
    left = keys(rows, row_id)
    right = keys(pool, "candidate_id").groupBy("org_id", "kind", "key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    hits = left.hint("merge").join(right.hint("merge"), ["org_id", "kind", "key"]).groupBy("org_id", "id").agg(
        F.min("first").alias("candidate_id"), F.max("last").alias("last"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    reasons = F.array_join(F.transform("kinds", lambda k: F.element_at(names, k + 1)), ", ")
    return hits.select("org_id", F.col("id").alias(row_id), "candidate_id", (F.col("candidate_id") < F.col("last")).alias("conflicting"), reasons.alias("reasons"))


_KEY, _ROW = ["org_id", "kind", "key"], ["org_id", "id"]


def _semi(left: DataFrame, right: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on, how)


def _leaders(open_: DataFrame) -> DataFrame:
    """Rows that come first for all their keys."""
    first = open_.groupBy(*_KEY).agg(F.min("id").alias("low"))
    return _semi(open_, first, _KEY, "inner").groupBy(*_ROW).agg(F.bool_and(F.col("id") == F.col("low")).alias("leads")).filter("leads").select(*_ROW)


def _chains(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are created, and rows that are duplicates for certain, by following chains of single blockers.

    A row whose only earlier open row is p has the opposite status of p.  Pointers to
    p are doubled, with their parity, until they end at a row of another kind; if
    that one leads all its keys, everything behind it is known.  Of a key whose
    second row has the first as its only blocker one of the two is created, so all
    later rows of the key are duplicates, whichever it is.
    """
    first = open_.groupBy(*_KEY).agg(F.min("id").alias("low"))
    held = cut(_semi(open_, first, _KEY, "inner"))
    second = held.filter("id > low").groupBy(*_KEY).agg(F.min("id").alias("second"))
    placed = cut(_semi(held, second, _KEY, "left"))
    blocker = F.when(F.col("id") == F.col("second"), F.col("low"))
    rows = placed.groupBy(*_ROW).agg(F.coalesce(F.bool_or(F.col("id") > F.col("second")), F.lit(False)).alias("later"), F.min(blocker).alias("b"), F.max(blocker).alias("c"))
    rows = cut(rows)
    leads = rows.filter("not later and b is null").select(*_ROW)
    active = cut(rows.filter("not later and b = c").select("org_id", "id", F.col("b").alias("to"), F.lit(True).alias("odd")))
    decided = _semi(placed.filter("id = second"), active.select(*_ROW), _ROW).select(*_KEY, F.col("second").alias("_second"))
    certain = _semi(placed.select(*_KEY, "id"), decided, _KEY, "inner").filter("id > _second").select(*_ROW).distinct()
    while True:
        ahead = active.select("org_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        moved = cut(_semi(active, ahead, ["org_id", "to"], "left"))
        if moved.filter("_to is not null").isEmpty():
            break
        active = moved.select("org_id", "id", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"))
    known = _semi(active.filter("not odd"), leads.withColumnRenamed("id", "to"), ["org_id", "to"]).select(*_ROW)
    return leads.unionByName(known), certain


#: Rounds that take only leading rows; inputs without long chains end in them.
PLAIN_ROUNDS = 2


def triage(rows: DataFrame, pool: DataFrame, valid: Column | None = None, row_id: str = "row_number", plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """Rows with status created, duplicate or invalid, as if taken one after another.

    A row is created if it shares no key with the pool or with an earlier
    created row; duplicates and invalid rows are not remembered.  A round decides
    the rows that come first for all their keys, and those that meet a created one;
    after a few such rounds chains of rows are followed by pointer doubling, so n
    rows that each share a key with the next take log n steps.  Rows with several
    open blockers each wait for them, and a maze of those may take many rounds: the
    rule itself is sequential (it is the first maximal independent set).
    """
    rows = rows.withColumn("_valid", valid if valid is not None else F.lit(True))
    known = keys(rows.filter("_valid"), row_id)
    existing = keys(pool, "candidate_id").select(*_KEY).distinct()
    in_pool = _semi(known, existing, _KEY).select(*_ROW).distinct()
    open_ = cut(_semi(known, in_pool, _ROW, "left_anti"))
    created, n = None, 0
    while True:
        new, certain = (_leaders(open_), None) if n < plain_rounds else _chains(open_)
        new, n = cut(new), n + 1
        if new.isEmpty():
            break
        created = new if created is None else created.unionByName(new)
        taken = _semi(open_, new, _ROW).select(*_KEY).distinct()
        met = _semi(open_, taken, _KEY).select(*_ROW)
        met = (met if certain is None else met.unionByName(certain)).distinct()
        open_ = cut(_semi(open_, met, _ROW, "left_anti"))
    free = _semi(rows.filter("_valid").select("org_id", F.col(row_id).alias("id")), known.select(*_ROW).distinct(), _ROW, "left_anti")
    created = free if created is None else created.unionByName(free)
    made = created.distinct().select("org_id", F.col("id").alias(row_id), F.lit(True).alias("_made"))
    status = F.when(~F.col("_valid"), "invalid").when(F.col("_made"), "created").otherwise("duplicate")
    return _semi(rows, made, ["org_id", row_id], "left").withColumn("status", status).drop("_valid", "_made")


def import_counts(triaged: DataFrame) -> DataFrame:
    """A12."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return triaged.groupBy("org_id").agg(of("created"), of("duplicate"), of("invalid"), F.count("*").alias("total"))


def content_duplicates(documents: DataFrame, content: str = "text") -> DataFrame:
    """Live documents whose content an earlier document of the organisation has: its copy number and the first one."""
    hashed = documents.filter("not is_deleted").select("org_id", "document_id", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("sha256"))
    # sizes first, so that only copies are sorted
    many = hashed.groupBy("org_id", "sha256").agg(F.count("*").alias("n"), F.min("document_id").alias("first_id")).filter("n > 1").drop("n")
    copy = Window.partitionBy("org_id", "sha256").orderBy("document_id")
    return hashed.join(many, ["org_id", "sha256"]).withColumn("copy", F.row_number().over(copy) - 1).filter("copy > 0").select("org_id", "document_id", "first_id", "copy")


def validate(rows: DataFrame) -> DataFrame:
    """Rows with trimmed fields and the reasons for which they are invalid."""
    text = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("full_name", "email", "phone", "location", "source_reference", "retention_until")}
    rows = rows.withColumns(text)
    long = [(F.length(c) > n, f"{c}_too_long") for c, n in (("full_name", 200), ("phone", 50), ("location", 200), ("source_reference", 500))]
    email = F.col("email").rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$")
    checks = [(F.col("full_name") == "", "full_name_required"), *long, ((F.col("email") != "") & ~email, "email_invalid"), ((F.col("retention_until") != "") & F.try_to_date("retention_until", "yyyy-MM-dd").isNull(), "retention_until_invalid")]
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, name) for c, name in checks])))


def resolve_skills(labels: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I8: labels(org_id, label, pos) with their normalised name, and the names new to vocabulary(org_id, normalized_name), first label kept."""
    rows = labels.withColumn("normalized_name", taxonomy(F.col("label"))).filter("normalized_name is not null")
    fresh = rows.hint("merge").join(vocabulary.select("org_id", "normalized_name").distinct().hint("merge"), ["org_id", "normalized_name"], "left_anti")
    return rows, fresh.groupBy("org_id", "normalized_name").agg(F.min_by("label", "pos").alias("label"))


def sync_requirement_skills(requirements: DataFrame) -> DataFrame:
    """requirements(requirements_id, must array, nice array): must before nice, each name once over both, positions from 1 in each group."""
    listed = F.concat(
        F.transform(F.coalesce("must", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("must_have").alias("importance"), i.alias("at"), x.alias("label"))),
        F.transform(F.coalesce("nice", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("nice_to_have").alias("importance"), i.alias("at"), x.alias("label"))),
    )
    rows = requirements.select("requirements_id", F.explode(listed).alias("x")).select("requirements_id", "x.*").withColumn("normalized_name", taxonomy(F.col("label"))).filter("normalized_name is not null")
    first = Window.partitionBy("requirements_id", "normalized_name").orderBy("importance", "at")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("requirements_id", "importance").orderBy("at"))).drop("at")


def publish_skills(profiles: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of held published earlier from the same document, to delete, and skills of the profile that the candidate lacks, to add."""
    gone = held.join(profiles.select("candidate_id", "document_id"), ["candidate_id", "document_id"], "left_semi")
    kept = held.join(profiles.select("candidate_id", "document_id"), ["candidate_id", "document_id"], "left_anti")
    rows = profiles.select("candidate_id", "document_id", F.posexplode("skills").alias("pos", "s")).select("candidate_id", "document_id", "pos", "s.*").withColumn("normalized_name", taxonomy(F.col("name"))).filter("normalized_name is not null")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id", "normalized_name").orderBy("pos"))).filter("n = 1").drop("n")
    return gone, rows.hint("merge").join(kept.select("candidate_id", "normalized_name").distinct().hint("merge"), ["candidate_id", "normalized_name"], "left_anti")


def batch_counts(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Items, pending and created of each batch, empty ones too; complete once nothing of an open batch is pending."""
    n = items.groupBy("batch_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "created").alias("created"))
    rows = batches.join(n, "batch_id", "left").fillna({"items": 0, "pending": 0, "created": 0})
    return rows.withColumn("batch_status", F.when((F.col("batch_status") == "open") & (F.col("pending") == 0), "completed").otherwise(F.col("batch_status")))


PRIVATE = ("full_name", "email", "phone", "location", "extracted_text", "review_flags", "file_name", "sha256", "notes", "content_type", "error", "source_reference")


# labels shown for review flags; fixed values
FLAG_LABELS = {
    "name_missing": "Name needs entry",
    "name_from_filename": "Name came from filename",
    "email_missing": "Email not found",
    "multiple_emails": "Multiple emails found",
    "phone_missing": "Phone not found",
    "multiple_phones": "Multiple phone numbers found",
    "location_missing": "Location not found",
}


def review_rows(items: DataFrame, pool: DataFrame) -> DataFrame:
    """Pending items(item_id, batch_id, org_id, email, phone, source_reference, status, review_flags) with position in their batch, match and flag labels."""
    pending = items.filter("status = 'pending'")
    match = identity_matches(pending, pool, "item_id").withColumnRenamed("reasons", "match_reasons")
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id"))
    known = F.create_map(*[F.lit(x) for pair in FLAG_LABELS.items() for x in pair])
    labels = F.transform(F.coalesce("review_flags", F.array().cast("array<string>")), lambda f: F.coalesce(F.try_element_at(known, f), F.lit("Needs review")))
    rows = pending.select("org_id", "batch_id", "item_id", place.alias("position"), labels.alias("flag_labels"))
    return rows.hint("merge").join(match.hint("merge"), ["org_id", "item_id"], "left").fillna({"conflicting": False, "match_reasons": ""})


def clear_payload(items: DataFrame) -> DataFrame:
    """Private fields of items that are no longer pending are blanked."""
    done = F.col("status") != "pending"
    return items.withColumns({c: F.when(done, F.lit(None).cast(items.schema[c].dataType) if items.schema[c].dataType.simpleString() != "string" else F.lit("")).otherwise(F.col(c)) for c in PRIVATE if c in items.columns})


def integrity(registry: DataFrame, files: DataFrame) -> DataFrame:
    """registry(path, size_bytes, sha256, is_deleted) against files(path, content): a reason code for each, 'ok' if none."""
    found = files.select("path", F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    rows = registry.join(found, "path", "full")
    reason = (
        F.when(F.col("size_bytes").isNull() & F.col("_sha").isNotNull(), "unregistered_file").when(F.col("is_deleted") & F.col("_sha").isNotNull(), "deleted_but_present")
        .when(~F.col("is_deleted") & F.col("_sha").isNull(), "file_missing").when(F.col("_size") != F.col("size_bytes"), "size_mismatch").when(F.col("_sha") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    )
    return rows.select("path", reason.alias("reason"))


# fixed values: the content types of stored documents
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def safe_filename(name: Column) -> Column:
    """The last part of a path, trimmed; null if that is empty, longer than 255 characters or holds control or format characters."""
    last = strip(F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1), -1))
    return F.when((last != "") & (F.length(last) <= 255) & ~last.rlike(r"[\p{Cc}\p{Cf}]"), last)


def delivery(registry: DataFrame, files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """A row for each registered document with path, filename and reason: may its stored bytes be handed out?

    registry(path, original_filename, document_type, content_type, extraction_status,
    size_bytes, sha256, is_deleted, candidate_status) against files(path, content).
    In this order: deleted, of a deleted candidate or not extracted
    (document_unavailable); not a CV of a known type with a safe name
    (invalid_document_metadata); no stored bytes (document_unavailable); empty,
    over ``max_bytes``, or of another size or hash (document_integrity_failed);
    else ok.  Nulls count as values that no rule allows.  Only sizes and hashes of
    files are shuffled.
    """
    found = files.select("path", F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    rows = registry.withColumn("filename", safe_filename(F.col("original_filename"))).hint("merge").join(found.hint("merge"), "path", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(no(~F.col("is_deleted")) | no(F.col("candidate_status") != "deleted") | no(F.col("extraction_status") == "succeeded"), "document_unavailable")
        .when(no(F.col("document_type") == "cv") | no(F.col("content_type").isin(PDF, DOCX)) | F.col("filename").isNull(), "invalid_document_metadata")
        .when(F.col("_size").isNull(), "document_unavailable")
        .when(~F.col("_size").between(1, max_bytes) | no(F.col("_size") == F.col("size_bytes")) | no(F.col("_sha") == F.col("sha256")), "document_integrity_failed").otherwise("ok")
    )
    return rows.select("path", "filename", reason.alias("reason"))


# identity proposals; the word lists and patterns are fixed values
NAME_STOPS = ("candidate", "contact", "curriculum", "cv", "developer", "engineer", "experience", "details", "profile", "resume", "skills", "synthetic", "supplied", "vitae")
FILE_STOPS = (*NAME_STOPS, "document", "final", "test", "fixture")
PARTICLES = ("al", "bin", "da", "de", "der", "van", "von")
EMAIL = r"(?i)(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?![\w.-])"
PHONE = r"(?<!\w)(?:\+\d{1,3}[\s().-]*)?(?:\d[\s().-]*){6,14}\d(?!\w)"
_TRIM = r"^[\s\-–—|•·]+|[\s\-–—|•·]+$"


def _unique(values: Column, key) -> Column:
    """The first of each key in order, blank keys left out; sorted by key, so it takes n log n steps."""
    listed = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    before = F.concat(F.array(F.lit("")), F.transform(listed, lambda e: e["k"]))
    pairs = F.zip_with(listed, before, lambda e, p: F.struct(e["i"].alias("i"), e["x"].alias("x"), ((e["k"] != "") & (e["k"] != p)).alias("new")))
    return F.transform(F.array_sort(F.filter(pairs, lambda e: e["new"])), lambda e: e["x"])


def emails(text: Column) -> Column:
    """Addresses in order, each once."""
    return _unique(F.regexp_extract_all(text, F.lit(EMAIL), 1), F.lower)


def looks_like_name(value: Column) -> Column:
    words = F.split(value, " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,:;()\[\]]+|[.,:;()\[\]]+$", ""))
    fine = F.forall(bare, lambda w: w.rlike(r"(?U)^[\p{L}'’-]+$") & (F.lower(w).isin(*PARTICLES) | w.rlike(r"^(?:\p{Lu}|\P{Ll}+$)")))
    return F.size(words).between(2, 6) & fine & ~F.exists(bare, lambda w: F.lower(w).isin(*NAME_STOPS))


def propose(rows: DataFrame, text: str = "text", filename: str | None = None) -> DataFrame:
    """Rows with proposal: full_name, email, phone, location and review flags, from text and file name."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(body, r"\R|[\x1C-\x1E]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.withColumn("_lines", lines).withColumn("_emails", emails(body))
    # Phones of the first 30 lines; lines that speak of contact come first
    def of_line(line: Column, i: Column) -> Column:
        bare = F.aggregate(F.col("_emails"), line, lambda acc, e: F.replace(acc, e, F.lit(" ")))
        preferred = bare.rlike(r"(?i)\+|phone|mobile|tel|contact") | line.contains("@")
        found = F.transform(F.regexp_extract_all(bare, F.lit(PHONE), 0), lambda v: F.regexp_replace(v, r"^[ .,()-]+|[ .,()-]+$", ""))
        digits = lambda v: F.length(F.regexp_replace(v, r"\D", ""))
        right = F.filter(found, lambda v: digits(v).between(7, 15) & (preferred | ~v.rlike(r"^\d{4}\s*[-–—]\s*\d{4}$")))
        return F.transform(right, lambda v: F.struct(F.when(preferred, i).otherwise(i + 100).alias("rank"), v.alias("value")))

    ranked = F.array_sort(F.flatten(F.transform(F.slice("_lines", 1, 30), of_line)))
    rows = rows.withColumn("_phones", _unique(F.transform(ranked, lambda x: x["value"]), lambda v: F.regexp_replace(v, r"\D", "")))
    # The first of 12 lines that reads like a name, else the file name
    tidy = F.transform(F.slice("_lines", 1, 12), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), _TRIM, ""))
    from_text = F.coalesce(F.try_element_at(F.filter(tidy, lambda x: ~x.contains("@") & looks_like_name(x)), F.lit(1)), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(filename), F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "") if filename else F.lit("")
    parts = F.filter(F.split(stem, r"[_\-\s]+"), lambda w: (w != "") & ~F.lower(w).isin(*FILE_STOPS) & ~w.rlike(r"^\d+$"))
    titled = F.initcap(F.array_join(parts, " "))
    from_file = F.when((titled != "") & looks_like_name(titled), titled).otherwise("")
    rows = rows.withColumn("_by_text", from_text).withColumn("_name", F.when(F.col("_by_text") != "", F.col("_by_text")).otherwise(from_file))
    # The last eligible segment of the first header line that has one
    with_phone = lambda s: F.exists(F.col("_phones"), lambda p: s.contains(p))

    def place(line: Column) -> Column:
        segments = F.reverse(F.transform(F.split(line, r"\s*[|•·]\s*"), lambda s: strip(s)))
        fine = F.filter(segments, lambda s: (s != "") & (s != F.col("_name")) & ~s.contains("@") & ~with_phone(s) & ~s.rlike(r"\d") & (F.length(s) <= 200) & F.size(F.split(s, r"\s+")).between(1, 5))
        return F.coalesce(F.try_element_at(fine, F.lit(1)), F.lit(""))

    heads = F.filter(F.slice("_lines", 1, 20), lambda x: x.contains("@") | with_phone(x))
    rows = rows.withColumn("_place", F.coalesce(F.try_element_at(F.filter(F.transform(heads, place), lambda x: x != ""), F.lit(1)), F.lit("")))
    n_mail, n_phone = F.size("_emails"), F.size("_phones")
    flags = F.array_compact(F.array(
        F.when(F.col("_name") == "", "name_missing").when(F.col("_by_text") == "", "name_from_filename"), F.when(n_mail == 0, "email_missing").when(n_mail > 1, "multiple_emails"),
        F.when(n_phone == 0, "phone_missing").when(n_phone > 1, "multiple_phones"), F.when(F.col("_place") == "", "location_missing"),
    ))
    first = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit(""))
    proposal = F.struct(F.col("_name").alias("full_name"), first("_emails").alias("email"), first("_phones").alias("phone"), F.col("_place").alias("location"), flags.alias("review_flags"))
    return rows.withColumn("proposal", proposal).drop("_lines", "_emails", "_phones", "_by_text", "_name", "_place")
