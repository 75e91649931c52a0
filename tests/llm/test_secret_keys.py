import base64
import random
import struct
import time

import pytest

from matchspark.llm import secret_scan


def der(n):
    """A DER sequence of n bytes in all."""
    inner = b"\x02\x01\x00" + b"\x04\x82" + struct.pack(">H", n - 11) + bytes(i * 37 % 256 for i in range(n - 11))
    return b"\x30\x82" + struct.pack(">H", n - 4) + inner


def ssh():
    def part(x):
        return struct.pack(">I", len(x)) + x

    return b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + struct.pack(">I", 1) + part(bytes(range(51))) + part(bytes(range(150)))


def lines(data):
    text = base64.b64encode(data).decode()
    return "\n".join(text[i : i + 64] for i in range(0, len(text), 64))


@pytest.mark.parametrize("data", [der(300), der(301), der(302), der(288), ssh()])
@pytest.mark.parametrize("before, after", [("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\n"), ("Key:\n", "\nHello world, more text"), ("Key:\n", "\nand so on"), ("a" * 40 + "x\n", "\r\nprose"), ("", "")])
def test_keys_in_lines(data, before, after):
    text = before + lines(data) + after
    keys = [(s, e) for s, e, k in secret_scan.scan(text) if k == "key"]
    assert keys == [(len(before), len(before) + len(lines(data)))]


def test_two_keys_and_no_key():
    text = lines(der(300)) + "\nword\n" + lines(der(303))
    assert [text[s:e] for s, e, k in secret_scan.scan(text) if k == "key"] == [lines(der(300)), lines(der(303))]
    cut = base64.b64encode(der(300)).decode()
    assert not [k for _, _, k in secret_scan.scan(cut + "QUJD") if k == "key"]
    assert not [k for _, _, k in secret_scan.scan(cut[:200]) if k == "key"]


def test_long_encoded_text_is_read_in_linear_time():
    rng = random.Random(2)
    text = lines(bytes(rng.randrange(256) for _ in range(1_000_000)))
    start = time.process_time()
    assert not [k for _, _, k in secret_scan.scan(text) if k == "key"]
    assert time.process_time() - start < 5
