"""Texts of a megabyte that are made to be slow, and the in-place key test against plain parsing."""

from __future__ import annotations

import base64
import json
import random
import time

import pytest

from surveyspan.llm import structural_secrets as secrets
from tests.llm.test_documents import der
from tests.llm.test_hidden_secrets import B64, RSA, SSH, part

SIZE = 1_000_000
HEAD = b"\x30\x82\x7f\xff\x02\x01\x00"
UNIT = der(4, HEAD + der(2, b"\0") * 9)


def encoded(data):
    return base64.b64encode(data).decode()


HOSTILE = {
    "openssh magics": secrets._OPENSSH_BASE64 * (SIZE // 20),
    "openssh hex": secrets._OPENSSH.hex() * (SIZE // 30),
    "heads": encoded(HEAD * (SIZE * 3 // 28)),
    "heads at every place": "MI" * (SIZE // 2),
    "hex heads": "30820fff0201" * (SIZE // 12),
    "hex heads only": "3082" * (SIZE // 4),
    "chains that merge": encoded(UNIT * (SIZE * 3 // 4 // len(UNIT))),
    "small keys": encoded(der(0x30, der(2, b"\0"), *[der(2, b"\1")] * 8) * 20_000),
    "letters": "a" * SIZE,
    "dots": "abcdefghijklmnop." * (SIZE // 17),
    "openers": "eyJh" * (SIZE // 4) + "." + part({"a": 1}) + ".sig",
    "blanks": encoded(b" " * (SIZE * 3 // 4)) + "." + part({"a": 1}) + ".sig",
    "braces": encoded(b'{"x' * (SIZE // 4)) + "." + part({"a": 1}) + ".sig",
    "nested objects": encoded(b'{"a":' * (SIZE * 3 // 20)) + "." + part({"a": 1}) + ".sig",
    "pem heads": "-----BEGIN PRIVATE KEY-----" * (SIZE // 27),
    "pem head and words": "-----BEGIN " + "PRIVATE KEY " * (SIZE // 12),
    "assignments": "password" * (SIZE // 8),
    "assignments and blanks": "token" + " " * SIZE,
    "backslashes": "\\" * SIZE,
    "blanks and breaks": " \t" * (SIZE // 4) + "\n" * (SIZE // 4) + "\\n" * (SIZE // 4),
    "many pems": ("-----BEGIN PRIVATE KEY-----\n" + B64["small"] + "\n-----END PRIVATE KEY-----\n") * 6000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_a_megabyte_takes_seconds(name):
    start = time.process_time()
    secrets.find_secrets(HOSTILE[name])
    assert time.process_time() - start < 20


def plain_items(data, start, end):
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or start + width > end:
                return None
            length = int.from_bytes(data[start : start + width], "big")
            start += width
        if start + length > end:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def plain_is_key(data):
    whole = plain_items(data, 0, len(data))
    if whole is None or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = plain_items(data, *whole[0][1:])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    size = [b - a for _, a, b in parts]
    if tags == [0x30, 4] and size[1] >= 16:
        inner = plain_items(data, *parts[0][1:])
        return inner is not None and [t for t, _, _ in inner] == [6, 0x30]
    if tags[0] != 2 or size[0] != 1:
        return False
    rsa = len(tags) >= 9 and set(tags[:9]) == {2}
    curve = len(tags) >= 2 and tags[1] == 4 and size[1] >= 16
    wrapped = len(tags) >= 3 and tags[1:3] == [0x30, 4] and plain_items(data, *parts[1][1:]) is not None
    return rsa or curve or wrapped


def some_der(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.5:
        return der(rng.choice([0x30, 0x30, 4]), *[some_der(rng, depth + 1) for _ in range(rng.randint(0, 10 if kind < 0.1 else 4))])
    if kind < 0.8:
        return der(2, rng.choice([b"\0", b"\0", bytes(rng.randint(0, 40))]))
    return der(rng.choice([4, 6, 5]), bytes(rng.randrange(256) for _ in range(rng.choice([0, 9, 16, 200]))))


def test_keys_in_place_are_those_of_plain_parsing():
    rng = random.Random(1)
    found = 0
    for _ in range(3000):
        data = der(0x30, *[some_der(rng) for _ in range(rng.choice([1, 2, 3, 9, 10]))])
        if rng.random() < 0.5:
            data = der(0x30, der(2, b"\0"), *[some_der(rng, 2) for _ in range(rng.choice([1, 2, 3, 8]))])
        if rng.random() < 0.2:
            data = bytearray(data)
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            data = bytes(data)
        before, after = (bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))) for _ in range(2))
        view = secrets._Der(before + data + after)
        found += (want := plain_is_key(data))
        assert view.is_key(len(before), len(before) + len(data)) == want
        for at in range(len(data)):
            for end in (len(data), rng.randint(at, len(data))):
                assert view.fills(len(before) + at, len(before) + end) == (plain_items(data, at, end) is not None)
        if found > 200 and _ > 400:
            break
    assert found > 50


def test_many_keys_in_one_run_are_each_found():
    run = "".join([B64["rsa"].rstrip("="), B64["small"].rstrip("="), B64["ssh"].rstrip("=")])
    spans = [(a, b) for a, k, b in secrets.find_secrets(run + " end") if k == "key"]
    starts = {0, len(B64["rsa"].rstrip("=")), len(B64["rsa"].rstrip("=")) + len(B64["small"].rstrip("="))}
    assert starts <= {a for a, _ in spans}
    data = RSA + RSA + SSH
    hexes = [a for a, k, _ in secrets.find_secrets(data.hex().upper()) if k == "key"]
    assert {0, 2 * len(RSA), 4 * len(RSA)} <= set(hexes)


def test_a_token_behind_many_openers():
    token = f"{part({'alg': 'none', 'typ': 'JWT'})}.{part({'sub': 'x'})}.c2ln"
    lead = "eyJ" * 40 + "e"
    got = [(a, k) for a, k, _ in secrets.find_secrets(lead + token)]
    assert got == [(len(lead), "jwt")]
    wide = base64.urlsafe_b64encode(json.dumps({"alg": "x", "n": 1}).encode("utf-16-le")).decode().rstrip("=")
    assert [k for _, k, _ in secrets.find_secrets(f"{wide}.{part({'sub': 'x'})}.c2ln")] == (
        ["jwt"] if secrets._is_json_object(wide, "alg") else []
    )
