"""Secret scan with multipart credential linking.

Three strict patterns report by themselves.  Weak candidates - account
identifiers, secret-looking tokens, endpoints - are common in clean text, so
they are joined by intervals within scopes: a part is reported only if a part of
a complementary kind lies in the same paragraph within ``GAP`` code points.  A
secret needs an identifier or an endpoint; those need a secret.  Strict finds
take part in the join, as secrets (assign, hex) or identifiers (access).

A document is one row, so its parts are joined inside its task by bisection over
sorted starts; nothing is shuffled and a long document costs n log n: no pattern
can look at one stretch of text again and again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import by_position, ensure
from .textkit import text_slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
GAP = 300
MASK = "<secret>"

# strict patterns and the least lengths of what they must hold
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# weak parts
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PHRASE = re.compile(r"""\b(?:pwd|passphrase|bearer|auth|credential|private_?key)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([A-Za-z0-9+/_.=!@#$%^&*-]{8,})""", re.I | re.A)
_ACCOUNT = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|app_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.I | re.A)
#: What an endpoint is.  Searched for as it stands it reads long runs of labels again and again; `endpoints` finds the same in one pass.
_ENDPOINT = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{4,}|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}\b|\b(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}\b""", re.A)
_ADDRESS = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{4,}|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}\b""", re.A)
#: A host's name ends at its port, so ports are found first and names, of 253 characters and labels of 63 at most, before them.
_PORT = re.compile(r":[0-9]{2,5}\b", re.A)
_HOST = re.compile(r"\b(?:[a-z0-9-]{1,63}\.)+[a-z]{2,63}:[0-9]{2,5}\b", re.A)
_HOST_BACK = re.compile(r"[a-z]{2,63}(?:\.[a-z0-9-]{1,63})+")
_LONGEST_HOST = 253
_BREAK = re.compile(r"\n[ \t]*\n")

_SPANS = "array<struct<kind:string,start:long,end:long,mask_from:long>>"
Span = tuple[str, int, int, int]


def strict(text: str) -> list[Span]:
    """Base finds: (kind, start, end, where the part to mask begins), leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return out


def _mixed(token: str) -> bool:
    return any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)


def weak_secrets(text: str) -> list[Span]:
    out = [("secret", m.start(), m.end(), m.start()) for m in _TOKEN.finditer(text) if _mixed(m.group())]
    return out + [("secret", m.start(), m.end(), m.start(1)) for m in _PHRASE.finditer(text) if any(c.isdigit() for c in m.group(1))]


def endpoints(text: str) -> list[Span]:
    """Addresses with a scheme, numbers with a port, and host names with a port, leftmost first; time grows with the text alone."""
    found, at = [], 0
    plain = [m.span() for m in _ADDRESS.finditer(text)]
    before = plain[::-1]
    for m in _PORT.finditer(text):
        while before and before[-1][0] < m.start() - _LONGEST_HOST:
            at = max(at, before.pop()[1])
        if back := _HOST_BACK.match(text[max(0, m.start() - _LONGEST_HOST) : m.start()][::-1]):
            low = max(m.start() - back.end(), at)
            while host := _HOST.search(text, low, m.end()):
                # an address that begins earlier takes its words
                if over := next((e for s, e in takewhile(lambda x: x[0] <= host.start(), reversed(before)) if host.start() < e), None):
                    low = over
                    continue
                found.append(host.span())
                at = max(at, host.end())
                break
    out, at = [], 0
    for s, e in sorted([*plain, *found], key=lambda x: (x[0], -x[1])):
        if s >= at:
            out.append(("endpoint", s, e, s))
            at = e
    return out


def _index(parts: list[Span], breaks: list[int]) -> tuple[list[int], list[int]]:
    """Starts of parts, sorted, and for each the furthest end of the parts of its paragraph up to it."""
    starts, reach, paragraph = [], [], -1
    for _, s, e, _ in sorted(parts, key=lambda p: p[1]):
        at = bisect_right(breaks, s)
        reach.append(e if at != paragraph else max(reach[-1], e))
        starts.append(s)
        paragraph = at
    return starts, reach


def _near(part: Span, starts: list[int], reach: list[int], breaks: list[int]) -> bool:
    """Interval join of one part: whether any indexed part lies in its paragraph within GAP."""
    at = bisect_right(breaks, part[1])
    last = part[2] + GAP if at == len(breaks) else min(part[2] + GAP, breaks[at] - 1)
    i = bisect_right(starts, last) - 1
    return i >= 0 and starts[i] >= (breaks[at - 1] if at else 0) and reach[i] >= part[1] - GAP


def scan_text(text: str) -> list[Span]:
    """All spans of a text: strict ones, then linked weak ones that overlap no strict one; by start, then kind."""
    base = strict(text)
    taken = sorted((s, e) for _, s, e, _ in base)
    starts = [s for s, _ in taken]
    reach = [0]
    for _, e in taken:
        reach.append(max(reach[-1], e))

    def free(parts: list[Span]) -> list[Span]:
        return [p for p in parts if reach[bisect_left(starts, p[2])] <= p[1]]

    weak = free(weak_secrets(text))
    secrets = [b for b in base if b[0] != "access"] + weak
    found = list(base)
    if secrets or base:
        ids = free([("identifier", m.start(), m.end(), m.start(1)) for m in _ACCOUNT.finditer(text)])
        ends = free(endpoints(text))
        if weak or ids or ends:
            breaks = [m.end() for m in _BREAK.finditer(text)]
            sides = {"s": secrets, "o": [b for b in base if b[0] == "access"] + ids + ends}
            index = {k: _index(parts, breaks) for k, parts in sides.items()}
            found += [p for p in weak if _near(p, *index["o"], breaks)]
            found += [p for p in ids + ends if _near(p, *index["s"], breaks)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda p: (p[1], order[p[0]], p[2]))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with spans: kind, start, end (code points, end exclusive), mask_from.

    One row for each row, repeated ones too; null and empty texts have no spans.
    Extra columns are ignored.
    """
    docs = ensure(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                spans = [[{"kind": k, "start": s, "end": e, "mask_from": m} for k, s, e, m in scan_text(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _ARROW)], ["doc_id", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("mask_from", pa.int64())]))


def masked(text: str) -> str:
    """text with each secret's value in place of MASK; overlapping values give one mask."""
    out, at = [], 0
    for _, _, e, m in sorted((p for p in scan_text(text) if p[0] not in ("identifier", "endpoint")), key=lambda p: p[3]):
        if m >= at:
            out += [text[at:m], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and n_chars counted anew; all rows and columns stay, null texts stay null."""
    with_chars = "n_chars" in docs.columns
    docs, restored = by_position(docs, "text", *(["n_chars"] if with_chars else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t if t is None else masked(t) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if with_chars:
                    at = part.schema.get_field_index("n_chars")
                    old = part.column(at).to_pylist()
                    part = part.set_column(at, part.schema.field(at), pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], part.schema.field(at).type))
                yield part

    return restored(docs.mapInArrow(run, docs.schema))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
    )
