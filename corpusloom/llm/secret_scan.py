"""Secret scanning with multipart credential linking.

Base patterns are always reported.  Weak candidates (account identifiers,
random-looking blobs, endpoints) mean little alone.  An interval join of their
positions links each to its nearest complement within a scope: identifiers and
secrets make pairs, endpoints join pairs, and only what is linked is reported.
The links connect the parts of a credential, which share a number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, parts, short_batches

#: Code points between parts of one credential at most.
SCOPE = 400
#: Bits per character that a blob has at least.
LEAST_ENTROPY = 3.5

# The base patterns, and the kinds in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "id", "blob", "endpoint")

# Weak candidates.  Names may follow a prefix and its _, blobs an =, as in GCP_CLIENT_ID=...
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(client_?id|(?:access_)?key_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]{3,})""", re.IGNORECASE | re.ASCII)
BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.IGNORECASE | re.ASCII)

Span = tuple[str, int, int]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def near(spans: list[Span], others: list[Span], scope: int = SCOPE) -> list[bool]:
    """Interval join: whether a span widened by ``scope`` meets one of ``others``."""
    return [j is not None for j in nearest(spans, others, scope)]


def nearest(spans: list[Span], others: list[Span], scope: int = SCOPE) -> list[int | None]:
    """Interval join: for each span the place of the one of ``others`` with the
    fewest code points between them, at most ``scope``; null without one."""
    if not spans or not others:
        return [None] * len(spans)
    order = sorted(range(len(others)), key=lambda j: others[j][1:])
    start = np.array([others[j][1] for j in order])
    end = np.array([others[j][2] for j in order])
    # Of those that begin up to a place, the one that ends last.
    furthest = np.maximum.accumulate(end)
    holder = np.maximum.accumulate(np.where(end == furthest, np.arange(len(end)), 0))
    out: list[int | None] = []
    for (_, a, b), after in zip(spans, np.searchsorted(start, [s[2] for s in spans], "right"), strict=True):
        gaps = []
        if after:  # begins before the span's end
            gaps.append((max(0, a - int(furthest[after - 1])), order[holder[after - 1]]))
        if after < len(order):
            gaps.append((int(start[after]) - b, order[after]))
        gap, j = min(gaps)
        out.append(j if gap <= scope else None)
    return out


def linked_spans(text: str, base: list[Span]) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """Weak candidates whose complements co-occur, and the pairs that prove them.

    A scope is what lies within SCOPE code points.  An identifier and a secret
    make a pair if one is the nearest of its kind in the other's scope; an
    endpoint needs such a pair in its own scope, and joins the nearest.  A pair
    is (part, part) in order of their kinds.
    """
    taken = [(s[1], s[2]) for s in base]
    blobs = [("blob", *m.span()) for m in BLOB.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and entropy(m[0]) >= LEAST_ENTROPY]
    blobs = _apart(blobs, taken)
    secrets = [s for s in base if s[0] in ("assign", "hex")] + blobs
    if not secrets:
        return [], []
    ids = _apart([("id", *m.span()) for m in IDENTIFIER.finditer(text)], taken)
    keys = [s for s in base if s[0] == "access"] + ids
    pairs = {(k, secrets[j]) for k, j in zip(keys, nearest(keys, secrets), strict=True) if j is not None}
    pairs |= {(keys[j], s) for s, j in zip(secrets, nearest(secrets, keys), strict=True) if j is not None}
    if not pairs:
        return [], []
    proven = sorted(pairs, key=lambda p: (min(p[0][1], p[1][1]), p))
    whole = [("pair", min(k[1], s[1]), max(k[2], s[2])) for k, s in proven]
    ends = _apart([("endpoint", *m.span()) for m in ENDPOINT.finditer(text)], taken)
    joined = [(proven[j][0], e) for e, j in zip(ends, nearest(ends, whole), strict=True) if j is not None]
    parts_ = {x for p in (*proven, *joined) for x in p}
    return [s for s in (*ids, *blobs, *ends) if s in parts_], proven + joined


def _apart(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that no base span overlaps; base spans stay as they are."""
    return [s for s, hit in zip(spans, near(spans, [("", a + 1, b - 1) for a, b in taken], 0), strict=True) if not hit] if taken else spans


def credentials(spans: list[Span], pairs: list[tuple[Span, Span]]) -> list[int | None]:
    """For each span the number of the credential that it is part of: the first
    of the spans, in order, that pairs connect it with."""
    place = {s: i for i, s in enumerate(spans)}
    first = list(range(len(spans)))

    def find(i: int) -> int:
        while first[i] != i:
            first[i] = first[first[i]]
            i = first[i]
        return i

    paired = {place[x] for p in pairs for x in p}
    for a, b in pairs:
        i, j = find(place[a]), find(place[b])
        first[max(i, j)] = min(i, j)
    return [find(i) if i in paired else None for i in range(len(spans))]


def scan_credentials(text: str) -> tuple[list[Span], list[int | None]]:
    """All spans of a text by start, then kind (code points, end exclusive), and
    the credential of each."""
    base = base_spans(text)
    weak, pairs = linked_spans(text, base)
    spans = sorted(base + weak, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans, credentials(spans, pairs)


def scan(text: str) -> list[Span]:
    return scan_credentials(text)[0]


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Find the secrets of every whole text.

    Returns doc_id and spans, an array of (kind, start, end, credential) by
    start, then kind; the parts of one credential have the same number, others
    none.  Null and empty texts have no spans; very long texts are read whole,
    one at a time; repeated rows each get their own; a null doc_id stays null;
    an empty table gives no rows; other columns are not read.
    """
    fields = ("kind", "start", "end", "credential")
    kind = pa.struct([("kind", pa.string()), *((f, pa.int64()) for f in fields[1:])])

    @lean("secrets")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                found = [scan_credentials(t or "") for t in part.column(1).to_pylist()]
                spans = pa.array([[dict(zip(fields, (*s, c), strict=True)) for s, c in zip(*x, strict=True)] for x in found], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), spans], ["doc_id", "spans"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, credential long>>")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with the secrets in text masked and
    n_chars, if there, counted anew where text changed.  Nulls, empty texts,
    repeated rows and an empty table stay as they are; very long texts are
    scanned whole."""
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @lean("secrets")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, place):
                columns, old = list(part.columns), part.column(place).to_pylist()
                new = [t and redact(t, scan(t)) for t in old]
                columns[place] = pa.array(new, part.schema.field(place).type)
                if size is not None:
                    counts = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new, strict=True)]
                    columns[size] = pa.array(counts, part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
