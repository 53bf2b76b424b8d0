"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base findings stand on their own.  Weak candidates do not: an identifier (``user=...``, ``client_id: ...``),
a bare high-entropy string or an endpoint (URL or host:port) is reported only where complementary parts
meet in one scope.  A scope is a blank-line separated block of the text, and two parts are joined when
their intervals, widened by ``reach`` characters, overlap within it.  Rules of the link:

* a bare string is a ``link_secret`` if an identifier or an access key is joined to it;
* an identifier is a ``link_id`` if a secret (bare or assigned) is joined to it;
* an endpoint is a ``link_endpoint`` if an identifier and a secret are both joined to it.

A part never counts as its own complement: intervals that overlap a candidate's are no partners of it.
The join runs inside each document over the ends of all parts, sorted (two searches for each candidate, never all
pairs), so a text of any length costs its parts and its own memory only, and every pattern is linear in it.

Edge cases: null and empty texts have no findings; repeated rows are each scanned; parts of one kind at one place
are one; no row, no result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
REACH = 160

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.A)
#: A run of name characters, tried at its first one only, and a port; what stands before the port must be a dotted name.
PORT = re.compile(r"(?<![\w.-])[a-z0-9.-]++:\d{2,5}\b", re.A)
_NAME = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}:\d+", re.A)
SCOPE_END = re.compile(r"\n[ \t]*\n")
_MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those too short are dropped after matching."""
    out: list[Span] = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


class Parts:
    """Intervals of one side of the join, by their starts and by their ends."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def near(self, start: int, end: int, reach: int) -> bool:
        """Does one end at most ``reach`` before ``start``, or begin at most ``reach`` behind ``end``?"""
        before = bisect.bisect_right(self.ends, start) > bisect.bisect_left(self.ends, start - reach)
        return before or bisect.bisect_right(self.starts, end + reach) > bisect.bisect_left(self.starts, end)


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, as intervals that do not touch."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _outside(union: tuple[list[int], list[int]], m: re.Match) -> bool:
    k = bisect.bisect_left(union[0], m.end()) - 1  # the last interval that begins before the match ends
    return k < 0 or union[1][k] <= m.start()


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates whose complementary parts lie in the same scope and reach."""
    ids = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    strong_ids = [s for s in base if s[1] == 1]
    assigned = [s for s in base if s[1] == 0]
    if not ids and not strong_ids:
        return []  # without an identifier no rule can hold
    taken = _covered(base)
    bare = [(m.start(), 4, m.end()) for m in BARE.finditer(text) if all(c.search(m[0]) for c in _MIXED) and _outside(taken, m)]
    hosts = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    covered = _covered(hosts)
    hosts += [(m.start(), 5, m.end()) for m in PORT.finditer(text) if _NAME.fullmatch(m[0]) and _outside(covered, m)]
    breaks = [m.start() for m in SCOPE_END.finditer(text)]

    def by_scope(spans: list[Span]) -> dict[int, Parts]:
        out: dict[int, list[tuple[int, int]]] = {}
        for a, _, b in spans:
            out.setdefault(bisect.bisect_right(breaks, a), []).append((a, b))
        return {k: Parts(v) for k, v in out.items()}

    identities, secrets = by_scope([*ids, *strong_ids]), by_scope([*bare, *assigned])

    def met(s: Span, parts: dict[int, Parts]) -> bool:
        found = parts.get(bisect.bisect_right(breaks, s[0]))
        return found is not None and found.near(s[0], s[2], reach)

    out = [s for s in ids if met(s, secrets)]
    out += [s for s in bare if met(s, identities)]
    out += [s for s in hosts if met(s, identities) and met(s, secrets)]
    return sorted(set(out))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """key, base (array of kind, start, end), linked (the same): places in code points, end exclusive."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]
        for batch in batches:
            base, linked = [], []
            for t in batch.column(1):
                value = t.as_py() or ""
                found = base_spans(value)
                base.append(as_rows(found))
                linked.append(as_rows(linked_spans(value, found, reach)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(linked, pa.list_(span))], names=[key, "base", "linked"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(run, f"{key} long, base {kind}, linked {kind}")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans, and all spans as one string."""
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    shown = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(every).alias("spans"))
