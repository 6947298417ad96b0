"""Keys and tokens that are wrapped, escaped, glued, encrypted or encoded twice."""

from __future__ import annotations

import base64
import json

import pytest

from surveyspan.llm.structural_secrets import find_secrets
from tests.llm.test_documents import der

RSA = der(0x30, *([der(2, b"\0")] + [der(2, bytes(range(1, 40)))] * 8))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes(9)), b"\x05\0"), der(4, RSA))
ENCRYPTED = der(0x30, der(0x30, der(6, bytes(9)), der(0x30, der(6, bytes(9)))), der(4, bytes(range(64))))
SMALL = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))


def field(data):
    return len(data).to_bytes(4, "big") + data


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"q" * 90)
B64 = {n: base64.b64encode(d).decode() for n, d in (("rsa", RSA), ("pkcs8", PKCS8), ("enc", ENCRYPTED), ("small", SMALL), ("ssh", SSH))}


def lines(text, width, end="\n"):
    return "".join(text[i : i + width] + end for i in range(0, len(text), width))


def pem(text, label="", end="\n", headers=""):
    return f"-----BEGIN {label}PRIVATE KEY-----{end}{headers}{lines(text, 64, end)}-----END {label}PRIVATE KEY-----{end}"


def part(value, before=""):
    return base64.urlsafe_b64encode((before + json.dumps(value)).encode()).decode().rstrip("=")


@pytest.mark.parametrize("end", ["\\n", "\\\\n", "\\r\\n", "\r\n", "\n"])
@pytest.mark.parametrize("name", sorted(B64))
def test_pem_in_quoted_text(name, end):
    text = f'x: "{pem(B64[name], "", end)}", y'
    assert [(k, a) for a, k, _ in find_secrets(text)] == [("pem", 4)]


def test_pem_with_headers():
    secret = base64.b64encode(bytes(range(160))).decode()
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    assert [k for _, k, _ in find_secrets(pem(secret, "RSA ", headers=headers))] == ["pem"]
    assert [k for _, k, _ in find_secrets(pem(secret, "RSA "))] == []


@pytest.mark.parametrize("name", sorted(B64))
@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\\n"])
def test_wrapped_bare_keys(name, width, end):
    text = "see " + lines(B64[name], width, end).removesuffix(end) + " here"
    assert [(a, k, b) for a, k, b in find_secrets(text)] == [(4, "key", len(text) - 5)]


@pytest.mark.parametrize("name", sorted(B64))
@pytest.mark.parametrize("glue", ["key_", "my-", "/srv/keys/", "Mb", "id="])
def test_glued_keys(name, glue):
    got = find_secrets(f"{glue}{B64[name]} tail")
    assert (len(glue), "key", len(glue) + len(B64[name])) in got


def test_hex_keys():
    for data in (SSH, RSA, ENCRYPTED):
        for text in (data.hex().upper(), lines(data.hex().upper(), 64), "AB" + data.hex().upper()):
            assert "key" in [k for _, k, _ in find_secrets(text)]


def test_keys_encoded_twice():
    for inner in (pem(B64["rsa"]), pem(B64["enc"], "ENCRYPTED "), B64["pkcs8"], "name: x\nkey: " + B64["ssh"]):
        twice = base64.b64encode(inner.encode()).decode()
        for text in (f"a {twice} b", "data_" + twice, lines(twice, 76), inner.encode().hex().upper()):
            assert "key" in [k for _, k, _ in find_secrets(text)], inner
    assert find_secrets(base64.b64encode(b"plain words, no key in them. " * 9).decode()) == []


@pytest.mark.parametrize("before", ["", " ", "\n", "\t", "\r\n", "\n\n  "])
def test_tokens(before):
    token = f"{part({'typ': 'JWT', 'alg': 'HS256'}, before)}.{part({'sub': '1'}, before)}.c2ln"
    for lead in ("", "id.token.", "a-long-name-of-a-token.", "name_", "x."):
        assert [(a, k) for a, k, _ in find_secrets(lead + token)] == [(len(lead), "jwt")]
    wrapped = token[:20] + "\n" + token[20:]
    assert [(a, k, b) for a, k, b in find_secrets(wrapped)] == [(0, "jwt", len(wrapped))]
    unsigned = f"{part({'typ': 'JWT', 'kid': 'abc'}, before)}.{part({'sub': '1'}, before)}.c2ln"
    assert find_secrets(unsigned) == []
