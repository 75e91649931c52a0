"""Secret scans against a plain search by characters, and keys and their look-alikes."""

import base64
import hashlib
import random
import struct

from matchspark.llm import secret_scan

SAFE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain(text):
    """Base spans, found character by character."""
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(w, i)), None)
        at = i + len(word or "")
        if word:
            at += at < len(text) and text[at] in "\"'"
            while at < len(text) and text[at] == " ":
                at += 1
            if at < len(text) and text[at] in ":=":
                at += 1
                while at < len(text) and text[at] == " ":
                    at += 1
                at += at < len(text) and text[at] in "\"'"
                end = at
                while end < len(text) and text[end] in SAFE:
                    end += 1
                if end > at:
                    out += [(i, end, "assign")] if end - at >= 8 else []
                    i = end
                    continue
        i += 1
    for kind, first, rest, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("hex", "", "0123456789abcdef", 32)):
        i = 0
        while i < len(text):
            end = i + len(first)
            while text.startswith(first, i) and end < len(text) and text[end] in rest:
                end += 1
            if end > i + len(first):
                out += [(i, end, kind)] if end - i >= least else []
                i = end
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "0123456789abcdef", " ", ":", "=", "'", '"', "é", "\n", "x9+/_.=-", "ABCDEFGH", "ſecret", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for text in texts:
        assert [x for x in secret_scan.scan(text) if x[2] in secret_scan.KINDS[:3]] == plain(text), text
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (5000, None), (5001, "")]
    got = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        spans = plain(t or "")
        assert (r.doc_id, r.n_assign + r.n_access + r.n_hex) == (i, len(spans))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def tlv(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + struct.pack(">H", n)) + content


OID = tlv(6, bytes([42, 134, 72, 134, 247, 13, 1, 1, 1]))
VERSION = tlv(2, b"\0")
BODY = bytes(range(1, 250))
PRIVATE = {
    "pkcs1": tlv(0x30, VERSION + b"".join(tlv(2, BODY[:60]) for _ in range(8))),
    "pkcs8": tlv(0x30, VERSION + tlv(0x30, OID) + tlv(4, BODY)),
    "encrypted": tlv(0x30, tlv(0x30, OID) + tlv(4, BODY)),
    "sec1": tlv(0x30, tlv(2, b"\1") + tlv(4, BODY[:32]) + tlv(0xA0, OID)),
}
PUBLIC = {
    "certificate": tlv(0x30, tlv(0x30, VERSION + tlv(0x30, OID) + tlv(4, BODY)) + tlv(0x30, OID) + tlv(3, BODY)),
    "public key": tlv(0x30, tlv(0x30, OID) + tlv(3, BODY)),
    "garbage": b"openssh-key-v1\0" + BODY,
}


def keys(text):
    return [text[s:e] for s, e, k in secret_scan.scan(text) if k == "key"]


def test_private_keys_and_look_alikes():
    for data in PRIVATE.values():
        run = base64.b64encode(data).decode()
        assert keys(f"key: {run} and more") == [run]
        assert keys(f"see path/{run}\nnext line") == [run]
        assert keys("hexadecimal " + data.hex()) == [data.hex()]
    for data in PUBLIC.values():
        assert keys(base64.b64encode(data).decode()) == []


def test_masking_keeps_rows_and_columns(spark):
    key = base64.b64encode(PRIVATE["pkcs8"]).decode()
    rows = [(1, f"a {key} b", "x"), (1, f"a {key} b", "x"), (None, None, None), (2, "", "y"), (3, "plain " * 50_000 + "password=abcdefgh", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_scan.mask_secrets(docs).collect()
    assert [tuple(r) for r in got][:4] == [(1, "a [key] b", "x"), (1, "a [key] b", "x"), (None, None, None), (2, "", "y")]
    assert got[4].text.endswith("plain [assign]") and len(got) == 5
    assert secret_scan.mask_secrets(docs.limit(0)).count() == secret_scan.find_secrets(docs.limit(0)).count() == 0
