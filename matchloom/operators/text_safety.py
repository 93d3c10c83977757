"""Redaction, claims and wording checks over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import explanation, strip

# fixed values: patterns, word lists and labels that results depend on
REDACTED = "[CONTACT REDACTED]"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)\b(?:https?://|www\.)\S+"
PHONE = r"(?U)(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)"
CONTACT_LINE = r"(?i)^\s*(?:e-?mail|phone|telephone|tel|mobile|linkedin|github|website)\s*:"
SENSITIVE_LINE = r"(?i)^\s*(?:date of birth|dob|age|gender|sex|marital status|religion|ethnicity|disability|health|political views?|family status)(?:\s*:|\s+-|\s+|$)"
PROTECTED = (
    r"(?i)\b(?:age|aged|date\s+of\s+birth|dob|sex|gender|pregnan(?:t|cy)|sexual\s+orientation|race|racial|ethnicity|ethnic|nationality|citizenship|"
    r"religion|religious|political\s+(?:view|views|belief|beliefs)|disability|disabled|health|medical\s+(?:condition|conditions)|marital\s+status|family\s+status)\b"
)
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
MEASURED = r"(?i)\b(\d+(?:[.,]\d+)?|" + "|".join(NUMBERS) + r")\s*\+?\s*(years?|yrs?|months?|percent|%)(?!\w)"
QUOTED = r'["“”]([^"“”]{2,200})["“”]'
TOKEN = r"(?U)\b[\w+#.]{2,}\b"
STOP_WORDS = ("and", "at", "candidate", "experience", "for", "has", "have", "least", "must", "of", "required", "requires", "skill", "the", "with", "year", "years")
DECISION = r"(?i)\b(?:should|recommend(?:ed|s)?)\s+(?:hir(?:e|ing)|reject|approve|contact|outreach)\b"
DRAFT_CONTACT = r"(?i)(?:https?://|www\.|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\+?\d[\d ()-]{6,}\d)"
OFFER = r"(?i)\b(?:you(?:'re| are) hired|we (?:are )?offering you|job offer|guaranteed (?:job|role|position)|automatically approved)\b"
PLACEHOLDER = "[Candidate name]"


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\R\z", ""), r"\R")


def _conditional(text: Column, pattern: str, keep) -> Column:
    """text with every match of pattern replaced unless keep(match): the parts between matches and the matches are joined again."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    new = F.transform(found, lambda m: F.when(keep(m), m).otherwise(REDACTED))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def redact(text: Column, *known: Column, values: Column | None = None) -> Column:
    """Contact and sensitive lines, known values in any case, addresses, links, and phone numbers with a plus or ten digits.

    Whole lines go by one multi-line pattern; only texts with a number that long
    pay for looking at each match.  ``values`` is an array of further known values
    (`redact_values`), taken after those of ``known``.
    """
    out = F.regexp_replace(_even_lines(text), _LINE, REDACTED)
    for value in known:
        out = _replace_value(out, strip(F.coalesce(value, F.lit(""))))
    if values is not None:
        out = redact_values(out, values)
    out = F.regexp_replace(F.regexp_replace(out, EMAIL, REDACTED), URL, REDACTED)
    short = lambda m: ~m.startswith("+") & (F.length(F.regexp_replace(m, r"\D", "")) < 10)
    # a lambda's variable is evaluated once, however often it is used
    return F.transform(F.array(out), lambda t: F.when(~t.rlike(PHONE), t).otherwise(_conditional(t, PHONE, short)))[0]


def redact_values(text: Column, values: Column) -> Column:
    """Text with the values of an array replaced one after the other, in any case; nulls and blanks are left out.

    A value is replaced by a pattern of its own only if it can occur: if its
    skeleton (ASCII without i, k and s, the letters that others fold to) is
    part of the text's, or if it may match what an earlier one was replaced by.
    So many values cost little more than one look at the text each.
    """

    def replaced(row: Column) -> Column:
        may = lambda v: row["bare"].contains(_skeleton(v)) | v.rlike(r"[\[\]]") | F.lit(REDACTED.lower()).contains(F.lower(v))
        held = F.filter(F.transform(values, lambda v: strip(F.coalesce(v, F.lit("")))), lambda v: (v != "") & may(v))
        return F.aggregate(held, row["text"], _replace_value)

    text = F.coalesce(text, F.lit(""))
    return F.when(F.size(values) > 0, F.transform(F.array(F.struct(text.alias("text"), _skeleton(text).alias("bare"))), replaced)[0]).otherwise(text)


def _replace_value(text: Column, value: Column) -> Column:
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_replace(text, F.when(value == "", _NEVER).otherwise(literal), F.lit(REDACTED))


def _skeleton(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?:[^\x00-\x7F]|[iIkKsS])+", ""))


def sensitive(text: Column) -> Column:
    """X7."""
    return _even_lines(text).rlike(_SENSITIVE)


def _even_lines(text: Column) -> Column:
    """text with every line end as a line feed and none at the very end."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(_ODD_END), F.regexp_replace(text, r"\R", "\n")).otherwise(text)
    return F.regexp_replace(plain, r"\n\z", "")


def _multiline(pattern: str) -> str:
    """A pattern for the start of one line as a pattern for lines of a text: its white space can't run over a line's end."""
    body = pattern.removeprefix("(?i)^").replace(r"\s", r"[^\S\n]").replace("|$)", r"|(?=\n|\z))")
    return rf"(?:^|(?<=\n)){body}"


_NEVER = "(?!)"
_ODD_END = r"[\r\x0B\x0C\x85\u2028\u2029]"
_SENSITIVE = "(?i)" + _multiline(SENSITIVE_LINE)
_LINE = "(?i)(?:" + _multiline(CONTACT_LINE) + "|" + _multiline(SENSITIVE_LINE) + r")[^\n]*"


def protected(text: Column) -> Column:
    """X8."""
    return F.coalesce(text, F.lit("")).rlike(PROTECTED)


def measured_claims(text: Column) -> Column:
    """Number and unit of each claim, the number without trailing zeros, as 'number unit'."""
    text = F.coalesce(text, F.lit(""))
    words = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBERS) for x in (w, str(i))])
    number = F.transform(F.regexp_extract_all(text, F.lit(MEASURED), 1), lambda n: F.coalesce(F.try_element_at(words, F.lower(n)), F.replace(n, F.lit(","), F.lit("."))))
    plain = F.transform(number, lambda n: F.regexp_replace(F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n), r"^0+(?=\d)", ""))
    unit = F.transform(F.regexp_extract_all(text, F.lit(MEASURED), 2), lambda u: F.when(F.lower(u).startswith("y"), "years").when(F.lower(u).startswith("m"), "months").otherwise("percent"))
    return F.zip_with(plain, unit, lambda n, u: F.concat_ws(" ", n, u))


def quoted_claims(text: Column, ascii_only: bool = False) -> Column:
    """Quotations of 2 to 200 characters, of normalised text."""
    return F.transform(F.regexp_extract_all(F.coalesce(explanation(text, ascii_only), F.lit("")), F.lit(QUOTED), 1), lambda x: strip(x))


def meaningful_tokens(text: Column, ascii_only: bool = False) -> Column:
    """X11: distinct tokens without stop words and plain numbers."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(explanation(text, ascii_only), F.lit("")), F.lit(TOKEN), 0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS) & ~t.rlike(r"(?U)^\d+$"))


def decision_language(text: Column) -> Column:
    """X12."""
    return F.coalesce(text, F.lit("")).rlike(DECISION)


def draft_issues(drafts: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """drafts(subject, body) with issues: contact data or links, offer wording, and the name placeholder once in the body, never in the subject."""
    both = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    times = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), r"\Q" + placeholder + r"\E", -1)) - 1
    checks = [
        (both.rlike(DRAFT_CONTACT), "contact_data"), (both.rlike(OFFER), "offer_wording"),
        (times(F.col("body")) != 1, "placeholder_not_once"), (times(F.col("subject")) > 0, "placeholder_in_subject"),
    ]
    return drafts.withColumn("issues", F.array_compact(F.array(*[F.when(c, name) for c, name in checks])))
