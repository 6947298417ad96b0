"""Exact and near deduplication, shards, mixing, language, secrets, licences."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspan.llm import (
    byte_shards,
    exact_dedup,
    language_id,
    license_classifier,
    mixing,
    pivot_simhash,
    structural_secrets,
)
from surveyspan.llm.components import components
from tests.llm import brute


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.lit(b"one digest for all")])
def test_exact_marks(edge, documents, empty, digest):
    for docs in (edge, documents):
        rows, groups = rows_of(docs), defaultdict(list)
        for key, text in rows:
            groups[text].append(key)
        got = exact_dedup.mark_duplicates(docs, digest=digest).collect()
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): keys for t, keys in groups.items()}
        for r in got:
            keys = by_sha[r["text_sha256"]]
            known = [k for k in keys if k is not None]
            assert r["group_size"] == len(keys) and r["keep_id"] == (max(known) if known else None)
        assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.mark_duplicates(empty, digest=digest).count() == 0


def test_exact_rows_that_stay(edge, empty):
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    got = kept.collect()
    assert sorted((r["text"] or "") for r in got) == sorted({t for _, t in rows_of(edge)})
    assert {r["doc_id"] for r in got} == {2, 3, 5, 6, 7, 8, None, 9}
    assert all(r["row"] == "r" and r["n"] == 7 for r in got)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_shards(edge, documents, empty):
    for docs, shards in ((documents, 40), (edge, 3), (documents.limit(2), 40)):
        got = sorted(byte_shards.shard_plan(docs, shards).collect(), key=lambda r: (r["shard"], r["slot"]))
        rows = rows_of(docs)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
            (k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in rows
        )
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert keys == sorted(keys)
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        for s in {r["shard"] for r in got}:
            own = [r for r in got if r["shard"] == s]
            assert [r["slot"] for r in own] == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest
    assert byte_shards.shard_plan(empty).count() == 0


def test_written_shards(edge, spark, tmp_path):
    byte_shards.write_shards(edge, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(rows_of(back)) == Counter(rows_of(edge))


def test_mix(documents, edge, empty):
    plan = mixing.mix_plan(documents).collect()
    text = dict(rows_of(documents))
    for r in plan:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["taken"] - r["size"] * r["target"] / r["source_size"]) < r["size"] + 1e-6
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_plan(documents).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in plan}
    copies = Counter(r["doc_id"] for r in mixing.mix_documents(documents).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    mixed = mixing.mix_documents(edge)
    assert mixed.columns == edge.columns
    assert len(mixing.mix_plan(edge).collect()) == edge.count()
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "_source string, source_size long")
    got = {r["_source"]: r for r in mixing.source_targets(sizes).collect()}
    assert [got[s]["weight"] for s in ("a", "b", "c", None)] == [5, 2, 1, 5]
    assert got["a"]["target"] == 30 and got[None]["target"] == 0
    assert got["b"]["target"] == pytest.approx(1480 * 2 / 3) and got["c"]["target"] == pytest.approx(1480 / 3)


def test_simhash(edge, documents, empty):
    for docs in (edge, documents):
        rows = rows_of(docs)
        prints = [brute.simhash(t) for _, t in rows]
        to = brute.simhash_groups(prints)
        first = {}
        for (key, _), root in zip(rows, to, strict=True):
            first[root] = key if first.get(root) is None else first[root] if key is None else min(key, first[root])
        want = Counter((k, f"{p:016x}", first[r]) for (k, _), p, r in zip(rows, prints, to, strict=True))
        assert Counter(tuple(r) for r in pivot_simhash.near_duplicates(docs).collect()) == want
        kept = pivot_simhash.one_per_group(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(first.values())
    assert pivot_simhash.near_duplicates(empty).count() == 0 and pivot_simhash.one_per_group(empty).count() == 0


def test_simhash_pairs_at_every_distance(spark):
    base = 0x0123456789ABCDEF
    spots = [(0,), (63,), (1, 40), (5, 20, 60), (0, 11, 22, 33)]
    values = [base, *(base ^ sum(1 << b for b in s) for s in spots)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in pivot_simhash.close_pairs(df).collect()}
    want = {frozenset((a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        pivot_simhash.close_pairs(df, 4)


def test_a_dense_family_gives_a_forest(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    while len(values) < 5000:
        values.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    far = [base ^ 0xFFFF << 4, base ^ 0xFFFF << 40]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in [*values, *far]], "fp long")
    for chunk in (300, 4096):
        links, fared = pivot_simhash.close_links(df, chunk=chunk)
        rows = links.collect()
        # one row per fingerprint and tile at most, where pairs would be hundreds of thousands
        assert len(rows) < 20 * len(values) * (10 if chunk == 300 else 1)
        roots = components(links, "a", "b").collect()
        assert len({r["root"] for r in roots}) == 1 and len(roots) == len(values) - 1
        seen = fared.first()
        assert 0 < seen["verified"] <= seen["formed"] - seen["discarded"] and 0 < seen["discarded"]
        assert seen["formed"] < seen["pairs"]


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_large_buckets_lose_no_pair(spark, chunk):
    rng = np.random.default_rng(chunk)
    low = rng.integers(0, 1 << 14, 150).tolist()  # the upper 50 bits agree: all meet in large buckets
    values = sorted({(0xABCDEF << 40) | v for v in low})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in pivot_simhash.close_pairs(df, chunk=chunk).collect()}
    assert got == want
    links, _ = pivot_simhash.close_links(df, chunk=chunk)
    to = brute.simhash_groups(values)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links, "a", "b").collect()}
    groups = {}
    for v, r in zip(values, to, strict=True):
        groups.setdefault(r, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_language(documents, edge, empty):
    got = {r["doc_id"]: r for r in language_id.identify(documents).collect()}
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in lang)
    assert sum(got[k]["lang_pred"] == v for k, v in lang.items()) >= 0.97 * len(lang)
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)
    for r in language_id.identify(edge).collect():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 9))
    kept = language_id.accepted(edge)
    assert kept.columns == edge.columns
    assert not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(empty).count() == 0 and language_id.accepted(empty).count() == 0


def test_language_ignores_lang_of_held_out_rows(documents):
    hidden = documents.withColumn(
        "lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0, F.col("lang"))
    )
    assert sorted(map(tuple, language_id.identify(hidden).collect())) == sorted(map(tuple, language_id.identify(documents).collect()))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structure_of_secrets():
    rsa = der(0x30, *([der(2, b"\0")] + [der(2, bytes(range(1, 40)))] * 8))
    assert structural_secrets.find_secrets(f"x {base64.b64encode(rsa).decode()} y")[0][1] == "key"
    assert [k for _, k, _ in structural_secrets.find_secrets(rsa.hex().upper())].count("key") == 1
    broken = rsa[:3] + bytes([rsa[3] ^ 1]) + rsa[4:]
    assert structural_secrets.find_secrets(base64.b64encode(broken).decode()) == []
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(rsa).decode()}-----END RSA PRIVATE KEY-----"
    assert structural_secrets.find_secrets(f"é {pem}") == [(2, "pem", 2 + len(pem))]

    def part(value):
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")

    good = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    assert [k for _, k, _ in structural_secrets.find_secrets(good)] == ["jwt"]
    assert structural_secrets.find_secrets(f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln") == []


def base_spans(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end(), "assign")] if len(m.group(2)) >= 8 else []
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(documents, edge, empty, spark):
    tricky = spark.createDataFrame(
        [(1, "é secret: token: abcdefgh ſecret=abcdefgh AKIAAKIA12345678901 " + "ab12" * 10), (2, "API_KEY='12345678' passwd=\"short\" pass")],
        "doc_id long, text string",
    )
    for docs in (documents, edge, tricky):
        text = Counter((k, hashlib.sha256(base_spans(t).encode()).hexdigest()) for k, t in rows_of(docs))
        got = structural_secrets.scan_secrets(docs).collect()
        assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == text
        for r in got:
            kinds = Counter(s.split(":")[0] for s in r["spans"].split(",") if s)
            assert [r[f"n_{k}"] for k in structural_secrets.KINDS] == [kinds[k] for k in structural_secrets.KINDS]
    assert structural_secrets.scan_secrets(empty).count() == 0


def test_licenses(documents, edge, empty, spark):
    model = license_classifier.train()
    lines = [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("The zoo needs a license for its lions and permission for the rest.", ""),
        ("He was licensed to drive.", ""),
        (None, ""),
        ("first line\nThis work is licensed under the GNU General Public License, version 3.\nlast", "gpl"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_classifier.scan_licenses(df).collect()}
    assert [got[i]["families"] for i in range(len(lines))] == [f for _, f in lines]
    assert got[6]["matches"] == "gpl:1"
    # the projection gives the probabilities of the plain model
    for r in df.select("text", license_classifier.paragraph_matches(F.coalesce("text", F.lit("")), model).alias("m")).collect():
        for m in r["m"]:
            p = model.probabilities(r["text"].split("\n")[m["line"]])
            assert m["probability"] == pytest.approx(max(p), abs=1e-3)
    phrases = ("GNU General Public License", "CC BY-NC", "MIT License", "Apache License")
    found = {r["doc_id"]: r["n_confirmed"] for r in license_classifier.scan_licenses(documents).collect()}
    for key, text in rows_of(documents):
        if any(p in text for p in phrases):
            assert found[key] >= 1
    assert license_classifier.scan_licenses(edge).count() == edge.count()
    assert license_classifier.scan_licenses(empty).count() == 0
    plan = license_classifier.scan_licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
