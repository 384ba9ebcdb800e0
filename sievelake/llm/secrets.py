"""Secret scans with structural confirmation.

Base kinds are plain patterns. The other kinds are reported only if a candidate decodes and
its structure holds: DER key encodings whose nested lengths add up, SSH blobs made of
length-prefixed fields, PEM blocks around such bodies, and signed tokens whose header and
payload are JSON objects with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Type, header lines (as of encrypted keys), body; lines may also end in a written-out \\n.
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*?(?:PRIVATE|PUBLIC) KEY|CERTIFICATE)-----(?:\s|\\[nr])*((?:[A-Z][A-Za-z0-9-]*: [^\r\n\\]*(?:\r?\n|(?:\\r)?\\n))*)"
    r"([A-Za-z0-9+/=\s\\]+)-----END \1-----"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: How the base64 of a DER sequence, of SSH public fields and of an SSH private key starts.
_STARTS = re.compile(r"M[A-P]|AAAA[A-P]|b3BlbnNza")
#: A key nests two or three levels; what goes deeper than this is none.
_DEEPEST = 16


def base64_bytes(text: str) -> bytes | None:
    """Decode standard or URL-safe base64 without regard to padding; None if it isn't any."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(b: bytes | memoryview, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the DER value at a place; None if its length does not fit."""
    if at + 2 > len(b):
        return None
    length, begin = b[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or begin + n > len(b):
            return None
        length, begin = int.from_bytes(b[begin : begin + n], "big"), begin + n
        if length < 0x80:  # DER has the short form for these
            return None
    return (b[at], begin, begin + length) if begin + length <= len(b) else None


def _nested(b: bytes | memoryview, begin: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The values between two places, if they fill them exactly, and those inside too."""
    out = []
    while begin < end:
        h = _header(b, begin)
        if h is None or h[2] > end or depth > _DEEPEST or h[0] & 0x1F == 0x1F:
            return None
        if h[0] & 0x20 and _nested(b, h[1], h[2], depth + 1) is None:
            return None
        out.append(h)
        begin = h[2]
    return out


def der_key_length(b: bytes | memoryview) -> int:
    """Length of the DER key at the start of the bytes, or 0: a sequence that starts with a version or an algorithm, and holds key material."""
    top = _header(b, 0)
    if top is None or top[0] != 0x30:
        return 0
    first = _header(b, top[1])
    if first is None or first[0] not in (0x02, 0x30):  # before the whole length is walked
        return 0
    parts = _nested(b, top[1], top[2])
    if not parts or len(parts) < 2:
        return 0
    tag, begin, end = parts[0]
    inner = _nested(b, begin, end) if tag == 0x30 else None
    starts = tag == 0x02 or bool(inner and inner[0][0] == 0x06)
    material = any(t in (0x02, 0x03, 0x04) and e - s >= 16 for t, s, e in parts)
    return top[2] if starts and material else 0


def ssh_key_length(b: bytes | memoryview) -> int:
    """Length of the SSH key at the start of the bytes, or 0: named, then length-prefixed fields.

    A private key goes on with a cipher's, a key derivation's name and its options, the number of
    keys, the public and the private part.
    """
    if bytes(b[:15]) == b"openssh-key-v1\0":
        at, fields = 15, (0, 0, 0, None, 0, 0)
    else:
        n = int.from_bytes(b[:4], "big")
        name = bytes(b[4 : 4 + n]) if n <= 64 else b""
        if n < 7 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", name):
            return 0
        at, fields = 4 + n, (0,) * {b"ssh-ed25519": 1, b"ssh-rsa": 2, b"ssh-dss": 4}.get(name, 2)
    for field in fields:
        n = int.from_bytes(b[at : at + 4], "big") if field is not None else 0
        if at + 4 > len(b) or at + 4 + n > len(b):
            return 0
        at += 4 + n
    return at


def _json_object(part: str) -> dict | None:
    raw = base64_bytes(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _pem(headers: str, body: str, kind: str) -> bool:
    raw = base64_bytes(re.sub(r"\\[nr]|\s", "", body))
    if not raw:
        return False
    if "ENCRYPTED" in headers:  # the body is a cipher's blocks, with no structure of its own
        return "DEK-Info:" in headers and len(raw) >= 16 and len(raw) % 8 == 0
    top = _header(raw, 0)
    return der_key_length(raw) == len(raw) or ssh_key_length(raw) > 0 or (kind == "CERTIFICATE" and top is not None and top[2] == len(raw))


def _base64_keys(run: str) -> Iterator[tuple[str, int, int]]:
    """Keys in a run of base64 characters: each alignment is decoded once, candidates are views of it, so the work is linear."""
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    decoded: dict[int, memoryview] = {}
    at = 0
    while s := _STARTS.search(plain, at):
        odd = s.start() % 4
        if odd not in decoded:
            decoded[odd] = memoryview(base64_bytes(plain[odd:]) or b"")
        raw = decoded[odd][(s.start() - odd) // 4 * 3 :]
        kind, n = ("der", der_key_length(raw)) if s[0][0] == "M" else ("ssh", ssh_key_length(raw))
        if n >= 24:
            at = min(len(run), s.start() + -(-n // 3) * 4)
            yield kind, s.start(), at
        else:
            at = s.start() + 1


def _hex_keys(run: str) -> Iterator[tuple[int, int]]:
    """DER keys in a run of hex digits; both alignments are decoded once."""
    raw = [memoryview(bytes.fromhex(run[odd : len(run) - (len(run) - odd) % 2])) for odd in (0, 1)]
    at = run.find("30")
    while at >= 0:
        n = der_key_length(raw[at % 2][at // 2 :])
        if n >= 24:
            yield at, at + 2 * n
        at = run.find("30", at + 2 * n if n >= 24 else at + 1)


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose structure was parsed."""
    for m in _PEM.finditer(text):
        if _pem(m[2], m[3], m[1]):
            yield "pem", m.start(), m.end()
    for m in _BASE64.finditer(text):
        for kind, start, end in _base64_keys(m[0]):
            yield kind, m.start() + start, m.start() + end
    for m in _ANY_HEX.finditer(text):
        for start, end in _hex_keys(m[0]):
            yield "der", m.start() + start, m.start() + end
    at = 0
    while m := _JWT.search(text, at):  # the parts of a chain of dotted names may start a token each
        head = _json_object(m[1])
        if head and isinstance(head.get("alg"), str) and _json_object(m[2]) is not None:
            yield "jwt", m.start(), m.end()
            at = m.end()
        else:
            at = m.end(1) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds: leftmost and not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, digest of the base spans, all spans."""
    base = base_spans(text or "")
    count = {k: sum(x[0] == k for x in base) for k in KINDS[:3]}
    return *count.values(), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + list(confirmed(text or "")))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = pd.DataFrame([scan_text(t) for t in b["text"]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        found.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy() if b["doc_id"].isna().any() else b["doc_id"].to_numpy())
        yield found


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every text of (doc_id, text); other columns are ignored.

    Spans are kind:start:end in code points, by start then kind; equal ones count once. Defined
    cases: a null text is empty; each row gives a row whatever its doc_id and however often it is
    repeated; an empty table gives no rows; a very long text is scanned whole, in time linear in
    its length (a run is decoded once an alignment, structures of more than 16 levels are no keys).
    The scan is a map over rows: nothing is shuffled.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan, _SCHEMA)
