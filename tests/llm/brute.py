"""Plain versions of the operators, for tables that fit in memory."""

from __future__ import annotations

import numpy as np
import xxhash
from tokenizers import Tokenizer

from surveyspan.llm.token_ids import default_tokenizer


def token_ids(texts, end):
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, pairs):
    """Smallest reachable position of each of n."""
    to = list(range(n))

    def find(i):
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        to[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_groups(prints):
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    return roots(len(prints), zip(*np.nonzero(np.triu(near, 1)), strict=True))
