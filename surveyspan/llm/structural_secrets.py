"""Secret scan with structural confirmation, over whole texts.

Three base patterns report on sight. Further candidates (PEM bodies, dotted tokens, runs of base64 or
hex) are decoded and reported only if what comes out has the structure of a secret:

* ``jwt``: a dotted token whose first part decodes to a JSON object that names an algorithm
  and whose second part decodes to a JSON object;
* ``pem``: the body between private-key markers decodes to a key encoding, or its headers say that it is encrypted;
* ``key``: base64 or hex decodes to a key encoding, or to text that holds one in turn.

A key encoding is a DER sequence whose lengths nest exactly and that holds a private-key layout
(version, then integers, an octet string, or an algorithm sequence and an octet string; or, encrypted, an algorithm sequence
and an octet string alone), or OpenSSH's format, a magic string followed by length-prefixed fields.

Candidates are looked for in the text without its line breaks, real or written as backslash and letter, so wrapped and
escaped keys are whole. A key may start anywhere in a run: every place whose first bytes read as the head of a key
is tested as far as its own length goes. A run is decoded once per alignment and the tests read it in place, so the work
grows with the text and not with the number of heads times their lengths.

Spans are code-point positions, end exclusive. Defined cases: a NULL or empty text has no
spans; a text of any length is scanned whole; repeated rows are reported each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspan.llm.tools import text_of

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_LEAST = 8
# A run that is long enough is the same run whether the length is asked for before or after matching.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# Both begin where a run of their characters begins, so a run is read once and not from each of its places.
_CHAIN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++\.?")
_PART = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{14,}+\.[A-Za-z0-9_-]{3}")
# First characters of base64 that decodes to JSON's white space or an opening brace.
_OPENS = re.compile(r"(?=e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----")
_PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
# Line breaks with the blanks around them, and the backslash of an escaped slash.
_BREAK = re.compile(r"(?<![ \t])[ \t]++(?=[\r\n])|(?<!\\)\\++(?:[rn][ \t]*+|(?=/))|[\r\n]++[ \t]*+")
_ESCAPED = re.compile(r"(?<!\\)\\++[rn]")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+")
_LONG_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{64,}={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]+")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{96,}")
# A DER sequence is 0x30 and a length: M and A to I (short or up to four bytes) in base64.
_BASE64_HEAD = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{14})")
_HEX_HEAD = re.compile(r"30(?=(?:[0-7][0-9A-Fa-f]|8[1-4])[0-9A-Fa-f]{28})")
_OPENSSH = b"openssh-key-v1\x00"
_OPENSSH_BASE64 = base64.b64encode(_OPENSSH).decode()
_OPENSSH_HEX = re.compile(_OPENSSH.hex(), re.IGNORECASE)

_SEQUENCE, _INTEGER, _OCTETS, _OBJECT = 0x30, 0x02, 0x04, 0x06


class _Der:
    """Items of DER inside some bytes, read in place.

    Where an item ends the next one begins, so items form a forest that grows to the right. ``fills`` asks whether a chain of
    items that starts at one place ends exactly at another. Every place is parsed once and has one
    more pointer far up its chain, so a question takes logarithmic time however long the chain is.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.next: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.far: dict[int, int] = {}

    def item(self, start: int, end: int) -> tuple[int, int, int] | None:
        """(tag, content start, content end) of the item at ``start``, if it ends by ``end``."""
        data = self.data
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or start + width > end:
                return None
            length = int.from_bytes(data[start : start + width], "big")
            start += width
        return (tag, start, start + length) if start + length <= end else None

    def _chain(self, start: int) -> None:
        path, at = [], start
        while at not in self.depth:
            found = self.item(at, len(self.data))
            if found is None:
                self.next[at], self.depth[at], self.far[at] = -1, 0, -1
                break
            path.append(at)
            self.next[at] = at = found[2]
        for at in reversed(path):
            up = self.next[at]
            self.depth[at] = self.depth[up] + 1
            far = self.far[up]
            equal = far >= 0 and self.far[far] >= 0 and self.depth[up] - self.depth[far] == self.depth[far] - self.depth[self.far[far]]
            self.far[at] = self.far[far] if equal else up

    def fills(self, start: int, end: int) -> bool:
        if start > end:
            return False
        self._chain(start)
        at = start
        while 0 <= at < end:
            far = self.far[at]
            at = far if 0 <= far <= end else self.next[at]
        return at == end

    def items(self, start: int, end: int, most: int) -> list[tuple[int, int, int]]:
        """The first items up to ``end``."""
        out = []
        while start < end and len(out) < most:
            found = self.item(start, end)
            if found is None:
                break
            out.append(found)
            start = found[2]
        return out

    def is_key(self, start: int, end: int) -> bool:
        """A private key, plain or encrypted, stands at exactly this place."""
        whole = self.item(start, end)
        if whole is None or whole[0] != _SEQUENCE or whole[2] != end:
            return False
        parts = self.items(whole[1], end, 9)
        tags = [tag for tag, _, _ in parts]
        if len(tags) < 2 or not (self._plain(tags, parts) or self._encrypted(tags, parts, end)):
            return False
        return self.fills(whole[1], end)

    def _plain(self, tags: list[int], parts: list[tuple[int, int, int]]) -> bool:
        if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
            return False
        if len(tags) == 9 and all(t == _INTEGER for t in tags):  # RSA: version and eight numbers
            return True
        if tags[1] == _OCTETS and parts[1][2] - parts[1][1] >= 16:  # elliptic curve
            return True
        # any algorithm, wrapped
        return len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS and self.fills(parts[1][1], parts[1][2])

    def _encrypted(self, tags: list[int], parts: list[tuple[int, int, int]], end: int) -> bool:
        """PKCS#8 under a password: an algorithm with parameters, then an octet string of whole cipher blocks."""
        if tags != [_SEQUENCE, _OCTETS] or parts[1][2] != end or parts[1][2] - parts[1][1] < 16:
            return False
        algorithm = self.items(parts[0][1], parts[0][2], 3)
        return [tag for tag, _, _ in algorithm] == [_OBJECT, _SEQUENCE] and algorithm[1][2] == parts[0][2]


def _der_size(head: bytes) -> int:
    """Size of the sequence that these first bytes may begin, 0 if they begin no key."""
    if len(head) < 9 or head[0] != _SEQUENCE:
        return 0
    at, length = 2, head[1]
    if length & 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4:
            return 0
        at, length = 2 + width, int.from_bytes(head[2 : 2 + width], "big")
    if head[at : at + 2] != b"\x02\x01" and head[at] != _SEQUENCE:
        return 0
    return at + length


def _openssh_size(data: bytes, start: int = 0) -> int:
    """Size of the key that starts there, all of the rest where the parts after the options do not fit."""
    at, fields, count, end = start + len(_OPENSSH), 0, 3, len(data)
    while fields < count:
        if at + 4 > end:
            return end - start
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
        if fields == 3 and at + 4 <= end:  # the number of public keys, those, and the private part
            count = 3 + min(int.from_bytes(data[at : at + 4], "big"), 1 << 10) + 1
            at += 4
    return at - start if at <= end else end - start


def _is_openssh_key(data: bytes, start: int = 0) -> bool:
    if not data.startswith(_OPENSSH, start):
        return False
    at, fields = start + len(_OPENSSH), 0
    while at + 4 <= len(data) and fields < 3:  # cipher, derivation, options
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return fields == 3 and at <= len(data)


def _is_key(data: bytes | None) -> bool:
    return data is not None and (_Der(data).is_key(0, len(data)) or _is_openssh_key(data))


def _unbase64(text: str) -> bytes | None:
    bare = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _is_json_object(part: str, *needed: str) -> bool:
    data = _unbase64(part)
    try:
        value = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and all(isinstance(value.get(n), str) for n in needed)


_BLANK = b" \t\n\r"
_STRUCTURE = re.compile(rb"(\\*)([\"{}\[\]])")


def _last_object(data: bytes) -> int | None:
    """Where the brace stands that the data's last one closes.

    Read from the end, where no string is open, so each quote tells whether what lies before it is
    text; one pass, and no other place can begin an object that runs to the end.
    """
    if not data.rstrip(b" \t\n\r\0").endswith(b"}"):
        return None
    depth, text = 0, False
    for m in reversed(list(_STRUCTURE.finditer(data))):
        sign = m[2]
        if sign == b'"':
            if len(m[1]) % 2 == 0:
                text = not text
        elif not text:
            depth += 1 if sign in b"}]" else -1
            if depth == 0:
                return m.start(2) if sign == b"{" else None
    return None


def _header_start(head: str) -> int | None:
    """Where in a token's first part the base64 of a JSON object with an algorithm starts, running to the part's end.

    The part is decoded once for each of its four alignments; in each at most one object can end with the part.
    """
    starts = []
    for shift in range(4):
        data = _unbase64(head[shift:]) if (len(head) - shift) % 4 != 1 else None
        brace = _last_object(data) if data else None
        if brace is None:
            continue
        first = brace
        while first and data[first - 1] in _BLANK:
            first -= 1
        at = -(-first // 3) * 3  # the object, or the blanks before it, begin with a character
        if at <= brace:
            starts.append(shift + at // 3 * 4)
    return next((x for x in sorted(starts) if _OPENS.match(head, x) and _is_json_object(head[x:], "alg")), None)


def _tokens(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, start of the signature, end) of signed tokens, also behind other dotted or glued words."""
    if not _PART.search(text):
        return
    for m in _CHAIN.finditer(text):
        if not _PART.search(m.group()):
            continue
        parts, at = m.group().split("."), m.start()
        for k, head in enumerate(parts[:-2]):
            if len(head) >= 14 and _is_json_object(parts[k + 1]):
                start = _header_start(head)
                if start is not None:
                    body = at + len(head) + 1 + len(parts[k + 1]) + 1
                    yield at + start, body, body + len(parts[k + 2])
            at += len(head) + 1


def _pem_holds_key(body: str) -> bool:
    lines = [x.strip() for x in _ESCAPED.sub("\n", body).splitlines()]
    while lines and not lines[0]:
        del lines[0]
    headers = []
    if lines and _PEM_HEADER.match(lines[0]):
        cut = lines.index("") if "" in lines else max(i for i, x in enumerate(lines) if ":" in x) + 1
        headers, lines = lines[:cut], lines[cut:]
    data = _unbase64("".join(lines).replace("\\", ""))
    if any(h.startswith("Proc-Type:") and h.endswith("ENCRYPTED") for h in headers):
        return data is not None and len(data) >= 16
    return _is_key(data)


def _pems(text: str) -> Iterator[tuple[int, int]]:
    for m in _PEM.finditer(text):
        end = f"-----END {m.group(1)}PRIVATE KEY-----"
        stop = text.find("-----", m.end())
        if stop >= 0 and text.startswith(end, stop) and _pem_holds_key(text[m.end() : stop]):
            yield m.start(), stop + len(end)


class _Runs:
    """Decoded bytes from places of a text on, each run decoded once per alignment.

    ``unit`` characters stand for ``size`` bytes. Places are asked for from left to right.
    """

    def __init__(self, text: str, run: re.Pattern, unit: int, size: int) -> None:
        self.text, self.run, self.unit, self.size = text, run, unit, size
        self.base = self.end = 0
        self.views: dict[int, _Der] = {}

    def at(self, place: int) -> tuple[_Der, int, int]:
        """(decoded bytes, where in them the place lies, end of the run)."""
        if place >= self.end:
            self.base, self.end, self.views = place, self.run.match(self.text, place).end(), {}
        shift = (place - self.base) % self.unit
        if shift not in self.views:
            self.views[shift] = _Der(self._decoded(self.text[self.base + shift : self.end]))
        return self.views[shift], (place - self.base - shift) // self.unit * self.size, self.end

    def _decoded(self, run: str) -> bytes:
        if self.unit == 2:
            return bytes.fromhex(run[: len(run) // 2 * 2])
        return _unbase64(run if len(run) % 4 != 1 else run[:-1]) or b""


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of base64 and hex key encodings in a text without line breaks."""
    runs = _Runs(text, _BASE64, 4, 3)
    for m in _BASE64_HEAD.finditer(text):
        at = m.start()
        size = _der_size(_unbase64(text[at : at + 16]) or b"")
        chars = -(-size * 4 // 3)
        if size and at + chars <= len(text):
            view, offset, end = runs.at(at)
            if at + chars <= end and view.is_key(offset, offset + size):
                yield at, _padded(text, at + chars)
    runs = _Runs(text, _BASE64, 4, 3)
    at = text.find(_OPENSSH_BASE64)
    while at >= 0:
        view, offset, end = runs.at(at)
        if _is_openssh_key(view.data, offset):
            size = _openssh_size(view.data, offset)
            yield at, _padded(text, at + min(end - at, -(-size * 4 // 3)))
        at = text.find(_OPENSSH_BASE64, at + 1)
    runs = _Runs(text, _ANY_HEX, 2, 1)
    for m in _HEX_HEAD.finditer(text):
        at = m.start()
        size = _der_size(bytes.fromhex(text[at : at + 32]))
        if size and at + 2 * size <= len(text):
            view, offset, end = runs.at(at)
            if at + 2 * size <= end and view.is_key(offset, offset + size):
                yield at, at + 2 * size
    runs = _Runs(text, _ANY_HEX, 2, 1)
    for m in _OPENSSH_HEX.finditer(text):
        view, offset, _ = runs.at(m.start())
        if _is_openssh_key(view.data, offset):
            yield m.start(), m.start() + 2 * _openssh_size(view.data, offset)


def _padded(text: str, end: int) -> int:
    for _ in range(2):
        end += text.startswith("=", end)
    return end


def _nested(text: str) -> Iterator[tuple[int, int]]:
    """Spans of runs that decode to text with a key or a PEM block in it."""
    for m in _LONG_BASE64.finditer(text):
        run = m.group().rstrip("=")
        for shift in range(4):
            part = run[shift:]
            if _holds_key(_unbase64(part if len(part) % 4 != 1 else part[:-1])):
                yield m.span()
                break
    for m in _LONG_HEX.finditer(text):
        run = m.group()
        if any(_holds_key(bytes.fromhex(run[k : k + (len(run) - k) // 2 * 2])) for k in (0, 1)):
            yield m.span()


def _holds_key(data: bytes | None) -> bool:
    if data is None:
        return False
    inner = data.decode("latin-1")
    return any(True for _ in _pems(inner)) or any(True for _ in _keys(_BREAK.sub("", inner)))


class _Unbroken:
    """A text without its line breaks, and where its places lie in the text."""

    def __init__(self, text: str) -> None:
        self.cuts, self.gone = [], []
        parts, at, kept, gone = [], 0, 0, 0
        for m in _BREAK.finditer(text):
            a, b = m.span()
            parts.append(text[at:a])
            kept, gone, at = kept + a - at, gone + b - a, b
            self.cuts.append(kept)
            self.gone.append(gone)
        parts.append(text[at:])
        self.text = "".join(parts)

    def place(self, i: int) -> int:
        k = bisect_right(self.cuts, i)
        return i + (self.gone[k - 1] if k else 0)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start), self.place(end - 1) + 1


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that do not overlap, in order, covering the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _meets(merged: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of some merged spans shares a place with this one."""
    k = bisect_right(merged, start, key=lambda s: s[1])
    return k < len(merged) and merged[k][0] < end


def find_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start, then kind as listed."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    unbroken = _Unbroken(text)
    tokens = {a: b for a, _, b in _tokens(text)}
    if unbroken.cuts:
        for a, signature, b in _tokens(unbroken.text):
            start, last = unbroken.span(a, signature)
            # a token over a line break; one that was found in the text itself keeps its end
            if last - start > signature - a and start not in tokens:
                tokens[start] = unbroken.span(a, b)[1]
    found += [(a, 3, b) for a, b in tokens.items()]
    pems = list(_pems(text)) if "PRIVATE KEY-----" in text else []
    found += [(a, 4, b) for a, b in pems]
    blocks = _merged(pems)
    direct = [unbroken.span(*s) for s in _keys(unbroken.text)]
    direct = [s for s in direct if not _meets(blocks, s[0], s[0] + 1)]
    nested = [unbroken.span(*s) for s in _nested(unbroken.text)]
    # a run that holds a key as it stands is not reported again
    known = _merged([*blocks, *direct])
    nested = [s for s in nested if not _meets(known, *s)]
    found += [(a, 5, b) for a, b in direct + nested]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(set(found))]


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.arrow_udf(_FOUND)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        columns: list[list] = [[] for _ in _FOUND.fields]
        for item in batch:  # one text at a time: the batch itself is the only copy
            spans = find_secrets(item.as_py())
            for i, kind in enumerate(KINDS):
                columns[i].append(sum(s[1] == kind for s in spans))
            base = _joined([s for s in spans if s[1] in KINDS[:3]])
            columns[-2].append(hashlib.sha256(base.encode()).hexdigest())
            columns[-1].append(_joined(spans))
        arrays = [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.string()) for c in columns[-2:]]
        yield pa.StructArray.from_arrays(arrays, [f.name for f in _FOUND.fields])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_jwt, n_pem, n_key``."""
    found = docs.select("doc_id", _scan(text_of()).alias("f"))
    return found.select(
        "doc_id", "f.n_assign", "f.n_access", "f.n_hex", "f.base_sha256", "f.spans", "f.n_jwt", "f.n_pem", "f.n_key"
    )
