"""Secret scans with structural confirmation of encoded candidates."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from matchspark.llm.text import per_row, small

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n(?!-----)[A-Za-z0-9+/_-]+)*={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]{64,}")
#: Where a key can start within a candidate: at its first character, a line's, or after a separator of paths.
START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=[/_+-]))(?=M[A-Z]|b3BlbnNzaC1rZXktdjEA)")
SSH = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 2, 4, 6
KINDS = ["assign", "access", "hex", "token", "key"]


def decoded(text: str) -> bytes | None:
    data = re.sub(r"\s|=", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(data + "=" * (-len(data) % 4), validate=True)
    except ValueError:
        return None


def values(data: bytes, depth: int = 0) -> list | None:
    """The DER values that fill the bytes exactly, as (tag, content, inner values or None); None if they do not."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data) or depth > 8:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        content, at = data[at : at + n], at + n
        inner = values(content, depth + 1) if tag & 32 else None
        if tag & 32 and inner is None:
            return None
        out.append((tag, content, inner))
    return out


def der(data: bytes) -> bool:
    """Whether the bytes are a private key: PKCS#1, DSA, PKCS#8 (plain or encrypted) or SEC1.

    Certificates and public keys are sequences too, but are no secrets.
    """
    top = values(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    parts = top[0][2]
    tags = [tag for tag, _, _ in parts]
    algorithm = lambda x: bool(x[2]) and x[2][0][0] == OBJECT_ID
    if tags[:1] == [INTEGER] and len(parts[0][1]) == 1 and parts[0][1][0] <= 1:
        if set(tags) == {INTEGER} and len(tags) in (6, 9):  # PKCS#1 with two primes, or DSA
            return True
        if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8
            return algorithm(parts[1])
        return tags[1:2] == [OCTETS] and set(tags[2:]) <= {0xA0, 0xA1}  # SEC1
    return tags == [SEQUENCE, OCTETS] and algorithm(parts[0])  # PKCS#8, encrypted


def key_bytes(data: bytes | None) -> bool:
    """A DER private key, or an OpenSSH private key whose length-prefixed fields fill it."""
    return bool(data) and (extent(data) == len(data) if data.startswith(SSH) else der(data))


def extent(data: bytes) -> int | None:
    """The bytes that a DER value or an OpenSSH private key at the start of ``data`` takes, by its own lengths."""
    if data.startswith(SSH):
        at = len(SSH)
        for part in range(4):  # cipher, key derivation and its options; then public keys and the private part
            if part < 3:
                at += 4 + int.from_bytes(data[at : at + 4], "big")
            else:
                keys = int.from_bytes(data[at : at + 4], "big")
                at += 4
                for _ in range(keys + 1):
                    if at + 4 > len(data):
                        return None
                    at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else None
    if len(data) < 6 or data[0] != SEQUENCE:
        return None
    n, k = data[1], data[1] & 127
    head = 2 + k if n & 128 else 2
    if k > 4 and n & 128 or not (data[head : head + 3] in (b"\x02\x01\x00", b"\x02\x01\x01") or data[head : head + 1] == b"\x30"):
        return None  # private keys begin with a version or an algorithm
    return head + int.from_bytes(data[2:head], "big") if n & 128 else 2 + n


def key_end(text: str, start: int, end: int) -> int | None:
    """Where the key ends that fills the first lines of an encoded candidate; None for no key.

    A candidate without padding runs on into lines that follow a key, so the key's own
    lengths say how many characters belong to it; they must end with a line. No more than
    those characters are decoded.
    """
    if text[start] == "b":
        taken = extent(decoded_start(text[start:end])) if text.startswith("b3BlbnNzaC1rZXktdjEA", start) else 0
    else:
        taken = extent(decoded_start(text[start : start + 24])) if text[start] == "M" else 0
    left = need = -(-(taken or 0) * 4 // 3)
    if not 0 < need <= end - start:
        return None
    for line in re.finditer(r"[^\s=]+", text[start : min(end, start + 3 * need + 4)]):
        if left <= len(line[0]):
            at = start + line.start() + left
            stop = at
            while stop < end and text[stop] == "=":
                stop += 1
            last = stop == end or text[stop] in "\r\n"
            return stop if last and key_bytes(decoded(text[start:stop])) else None
        left -= len(line[0])
    return None


def decoded_start(text: str) -> bytes:
    """The bytes of an encoded text that may have been cut anywhere, filled up with zero bits."""
    run = re.sub(r"\s|=", "", text)
    return decoded(run + "A" * (-len(run) % 4)) or b""


def keys_of(text: str) -> set[tuple[int, int]]:
    """Spans of encoded keys; one may start at any line of a candidate, and after a separator in it."""
    spans, done = set(), 0
    for m in ENCODED.finditer(text):
        for start in START.finditer(text, m.start(), m.end()):
            at = start.start()
            stop = key_end(text, at, m.end()) if at >= done and RUN.match(text, at) else None
            if stop is not None:
                spans.add((at, stop))
                done = stop
    return spans


def signed(text: str) -> bool:
    """A token whose header is JSON with an algorithm and whose claims are a JSON object."""
    try:
        head, claims = (json.loads(decoded(x) or b"") for x in text.split(".")[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start and then kind; code points, end exclusive."""
    text = text or ""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if signed(m[0])]
    spans = keys_of(text)
    spans |= {(m.start(), m.end()) for m in HEXADECIMAL.finditer(text) if len(m[0]) % 2 == 0 and key_bytes(bytes.fromhex(m[0]))}
    out += [(s, e, "key") for s, e in spans]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def report(doc_id: int, text: str | None) -> tuple:
    spans = scan(text)
    said = [f"{k}:{s}:{e}" for s, e, k in spans]
    base = ",".join(x for x, (_, _, k) in zip(said, spans, strict=True) if k in KINDS[:3])
    return doc_id, *(sum(k == kind for _, _, k in spans) for kind in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans and all spans.

    Null and empty texts have no span; repeated rows are reported each, also without
    doc_id; other columns are not read; an empty table gives no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, report), schema)


def masked(text: str) -> str:
    out, at = [], 0
    for s, e, kind in scan(text):
        if e > at:
            out += [text[at : max(s, at)], f"[{kind}]" if s >= at else ""]
            at = e
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets.

    Every row and column stays; null and empty texts stay as they are; repeated rows are
    masked each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            texts = pa.array([None if x is None else masked(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
