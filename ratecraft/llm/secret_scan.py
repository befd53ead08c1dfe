"""Secret scans: base patterns plus linking of multipart credentials.

Three base patterns (assignments, access key identifiers, long hex runs) are
reported wherever they match.  Three weaker ones are only candidates:

* ``key_id``: an assigned id, or a word with a known prefix or of capitals and
  digits;
* ``key_secret``: a random-looking run of base64 or base32 characters, of any length;
* ``endpoint``: a URL, or a host name with a port of any length.

Candidates and base matches are parts of a credential: an identifier, a secret
or an endpoint.  The parts of a document are interval-joined within scopes
(at most ``scope`` code points between two parts), and a weak candidate is
reported only if a part that complements it lies in its scope: an identifier
needs a secret, an endpoint needs a secret, a secret needs an identifier or an
endpoint.  Candidates that overlap are all linked first; of those that are
confirmed, the first of each overlap is reported, as long as the overlap is.
A URL is a scope of its own: a user (or an id among the segments behind the host),
a secret (a password, or a random segment) and the host are parts beside each
other and complement one another where an identifier and a secret co-occur.
Scopes never cross documents, and a document is one row, so the
join runs beside the scan, on sorted positions, and nothing is shuffled.

Defined results: null and empty texts have no spans; repeated rows each get
their own row; documents of any length are scanned whole; an empty table gives
an empty result; other columns are ignored unless asked for.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, sheltered

# Fixed patterns and least lengths of the base kinds; of an assignment, its second
# group is measured.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "key_id", "key_secret", "endpoint"]
BASE_KINDS = KINDS[:3]
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Weak candidates, none of them with white space but a blank beside a separator.
NAMED_ID = re.compile(r"[iI][dD][\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9._@-]{4,}")
PREFIXED_ID = r"(?:ASIA|AROA|AIDA|SK|AC|sk|pk|ghp|xox[abp])[_-]?(?=[A-Za-z]*[0-9])[A-Za-z0-9]{12,}"
KEY_ID = re.compile(rf"(?<![A-Za-z0-9_-])(?:{PREFIXED_ID}"
                    r"|(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{15,})(?![A-Za-z0-9])")
KEY_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,6}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp)://[^\x20\x09-\x0D\"'<>]{4,}"
                      r"|(?<![A-Za-z0-9.@-])(?:[a-z0-9-]{1,63}\.)+[a-z]{2,24}:[0-9]{2,5}(?![0-9])", re.A)
# A URL's user and password, host with port, and the rest; segments of the rest.
URL = re.compile(r"[a-z][a-z0-9+.-]*://(?:([^\x20\x09-\x0D\"'<>/?#:@]+):([^\x20\x09-\x0D\"'<>/?#@]+)@)?"
                 r"([^\x20\x09-\x0D\"'<>/?#@]+)([^\x20\x09-\x0D\"'<>]*)", re.A)
SEGMENT = re.compile(r"[A-Za-z0-9]+")
URL_ID = re.compile(r"(?=[A-Z]*[0-9])[A-Z][A-Z0-9]{2,}")
LEAST_PASSWORD, LEAST_SEGMENT = 6, 20
PORT = re.compile(r":[0-9]{2}")
MIN_ENTROPY = 3.5
SCOPE = 200
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "key_secret": "secret", "endpoint": "endpoint"}
COMPLEMENTS = {"id": ["secret"], "endpoint": ["secret"], "secret": ["id", "endpoint"]}


def entropy(word: str) -> float:
    """Bits per character of a word's own character distribution."""
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def looks_random(word: str) -> bool:
    """Two kinds of characters are enough for a run of letters and digits that
    is no identifier with a known prefix; with other characters in it, it may be
    a path or a slug, and needs all three."""
    kinds = sum(bool(re.search(p, word)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    plain = kinds == 2 and word.rstrip("=").isalnum() and not re.fullmatch(PREFIXED_ID, word)
    return (kinds == 3 or plain) and entropy(word) >= MIN_ENTROPY


def base_spans(text: str, words: list[str]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, in order.  A match that is
    too short is dropped and still consumes what it matched.  (For hex runs,
    the maximal runs of 24 or more are exactly the matches that stay.)  A
    pattern is run only if the text has a part that each match must hold."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if HEX.search(" ".join(w for w in words if len(w) >= LEAST["hex"])):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str, words: list[str], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that overlap no base span of the text; they may overlap
    each other."""
    odd = " ".join(w for w in words if len(w) >= 14 and not (w.isalpha() and (w[1:].islower() or w.isupper())))
    found = []
    if NAMED_ID.search(text):
        found += [(m.start(), m.end(), "key_id") for m in NAMED_ID.finditer(text)]
    if KEY_ID.search(odd):
        found += [(m.start(), m.end(), "key_id") for m in KEY_ID.finditer(text)]
    if PORT.search(text) or "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if KEY_SECRET.search(odd):
        found += [(m.start(), m.end(), "key_secret") for m in KEY_SECRET.finditer(text) if looks_random(m[0])]
    return free(found, base)


def free(spans, base) -> list[tuple[int, int, str]]:
    """Those of ``spans`` that overlap no base span, in order."""
    out, taken, k = [], merged((s, e, "") for s, e, _ in base), 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((s, e, kind))
    return out


def url_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Parts of the URLs that hold an identifier and a secret (a base span counts
    as what it is): the identifiers, the secrets and the host."""
    if "://" not in text:
        return []
    out = []
    for m in URL.finditer(text):
        parts = [(*m.span(3), "endpoint")]
        if m[2] is not None and len(m[2]) >= LEAST_PASSWORD:
            parts += [(*m.span(1), "key_id"), (*m.span(2), "key_secret")]
        if len(m[4]) >= LEAST_SEGMENT:
            for g in SEGMENT.finditer(text, *m.span(4)):
                if len(g[0]) >= LEAST_SEGMENT and looks_random(g[0]):
                    parts.append((*g.span(), "key_secret"))
                elif URL_ID.fullmatch(g[0]):
                    parts.append((*g.span(), "key_id"))
        roles = {ROLE[kind] for _, _, kind in parts}
        if len(parts) > 1 and base:
            roles |= {ROLE[kind] for s, e, kind in base if m.start() <= s and e <= m.end()}
        if {"id", "secret"} <= roles:
            out += parts
    return free(out, base)


def merged(spans) -> list[tuple[int, int, str]]:
    """Overlapping spans as one, named after the first."""
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] else 0)):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, kind))
    return out


def confirmed(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE,
              apart: bool = False) -> list[tuple[int, int, str]]:
    """The weak candidates with a complementary part in scope (``apart``: one
    that does not overlap the candidate): the interval join of a document's
    parts.  Per role the parts are sorted by start and carry the largest end so
    far, so each candidate takes one binary search."""
    if not weak:
        return []
    starts: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    ends: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    stops: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    for s, e, kind in sorted(base + weak):
        role = ROLE[kind]
        starts[role].append(s)
        ends[role].append(max(e, ends[role][-1]) if ends[role] else e)
        stops[role].append(e)
    for own in stops.values():
        own.sort()

    def near(span, role):
        if apart:  # the last one that ends before the span, or the first that starts after it
            left, right = bisect_right(stops[role], span[0]), bisect_left(starts[role], span[1])
            return (left > 0 and stops[role][left - 1] >= span[0] - scope
                    or right < len(starts[role]) and starts[role][right] <= span[1] + scope)
        before = bisect_right(starts[role], span[1] + scope)
        return before > 0 and ends[role][before - 1] >= span[0] - scope

    return [w for w in weak if any(near(w, role) for role in COMPLEMENTS[ROLE[w[2]]])]


def find(text: str | None, scope: int = SCOPE) -> tuple[list, list]:
    """Base spans of a text, and all spans that are reported."""
    text = text or ""
    words = text.split()
    base = base_spans(text, words)
    more = merged(confirmed(base, weak_spans(text, words, base), scope, apart=True) + url_spans(text, base))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def scan(docs: DataFrame, *, scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default ``doc_id``), ``base`` and ``spans``:
    arrays of ``start, stop, kind`` in code points, ``stop`` exclusive."""

    def spans(texts):
        found = [find(t, scope) for t in texts]
        return [[[{"start": s, "stop": e, "kind": k} for s, e, k in f[i]] for f in found] for i in range(2)]

    span = "array<struct<start: long, stop: long, kind: string>>"
    return beside(docs, keep or ["doc_id"], ["text"], f"base {span}, spans {span}", spans)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with its spans replaced by their kind in brackets; spans that
    overlap are replaced as one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span masked in ``text`` and, where there is
    a column ``n_chars``, the new length of such texts in it.  Texts without a
    span and all other columns stay as they are."""
    rows, back = sheltered(docs, "text", "n_chars")
    counted = "n_chars" in docs.columns

    def replace(texts):
        found = [find(t, scope)[1] for t in texts]
        new = [mask(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
        return new, [len(t) if spans else None for t, spans in zip(new, found, strict=True)]

    rows = rows.withColumnRenamed("text", "_text")
    done = beside(rows, [c for c in rows.columns if c != "_text"], ["_text"], "text string, _length long", replace)
    if counted:
        done = done.withColumn("n_chars", F.coalesce(F.col("_length").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return back(done)
