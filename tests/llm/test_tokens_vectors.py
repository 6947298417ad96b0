"""Token ids, coded files, packing, embeddings, the registered queries and the pipeline."""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
import corpus_pipeline
from surveyspan.llm import packing, queries, range_coder, subspace_join, token_files, token_ids
from surveyspan.llm.components import components
from tests.llm import brute
from tests.oracle_check import compare, connect


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0abAB'é1²漢.,!<|>", max_size=40), max_size=6))
def test_cached_ids_are_the_tokenizers_ids(texts):
    got = [x.tolist() for x in token_ids.encoded(texts, token_ids.default_tokenizer())]
    assert got == [ids[:-1] for ids in brute.token_ids(texts, 0)]


def test_long_texts_are_cut_where_no_token_is(monkeypatch):
    monkeypatch.setattr(token_ids, "SECTION", 20)
    texts = ["some words  and\n\nlines of a text that is longer than a section " * 3, "x" * 100, ""]
    got = [x.tolist() for x in token_ids.encoded(texts, token_ids.default_tokenizer())]
    assert got == [ids[:-1] for ids in brute.token_ids(texts, 0)]


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    other = path("word_bpe_49k.json")
    texts = ["one two, three's (four)\n\n  five.Six\xa0 7", "", "été 漢字 \x1c\x1d\xa0x. 12,345 don't  "]
    plain = Tokenizer.from_file(other)
    plain.encode_special_tokens = True
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in token_ids.encoded(texts, other)] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 900), st.sampled_from([2, 300, 65536]), st.integers(1, 200), st.integers(0, 99))
def test_coder_round_trip(n, kinds, block, seed):
    ids = np.random.default_rng(seed).integers(0, kinds, n).astype(np.uint16)
    assert np.array_equal(range_coder.unpack_blocks([range_coder.pack_blocks(ids, block)])[0], ids)


def test_coder_learns_and_checks():
    ids = np.tile(np.arange(50, dtype=np.uint16) * 37, 400)
    frame = range_coder.pack_blocks(ids)
    assert len(frame) < 0.25 * ids.nbytes
    broken = bytearray(frame)
    broken[-40] ^= 0x55
    with pytest.raises(ValueError):
        range_coder.unpack_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        range_coder.unpack_blocks([b"else" + frame])


def test_files_hold_whole_documents(documents, edge, empty, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 5000)
    for i, docs in enumerate((documents, edge)):
        path = str(tmp_path / f"ids{i}")
        token_files.write_ids(docs, path)
        got = sorted(token_files.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        rows = docs.select("doc_id", "text").collect()
        want = Counter(
            (r["doc_id"], np.array(ids, "<u4").tobytes())
            for r, ids in zip(rows, brute.token_ids([r["text"] for r in rows], 0), strict=True)
        )
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert keys == sorted(keys)
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
            at += r["n_tokens"]
    assert token_files.round_trip(empty).count() == 0


def test_files_of_ids_beyond_two_bytes(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 60)
    with open(token_ids.default_tokenizer(), encoding="utf-8") as f:
        known = json.load(f)
    for token, far in (("\u0120the", 70001), ("\u0120a", 4_000_000_000), ("x", 1 << 16)):
        known["model"]["vocab"][token] = far
    vocabulary = tmp_path / "wide.json"
    vocabulary.write_text(json.dumps(known), encoding="utf-8")
    tokenizer = tokenizers.Tokenizer.from_file(str(vocabulary))
    tokenizer.encode_special_tokens = True
    texts = ["in the town a man saw the x", "no far id here. " * 40, "", None, "x the a " * 30, "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, str(vocabulary))
    got = sorted(token_files.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert max(map(max, want)) == 4_000_000_000
    frames = spark.read.parquet(path)
    assert frames.filter("upper IS NULL").count() and frames.filter("upper IS NOT NULL").count()


def check_packing(docs, pieces):
    """Every id in one piece, sequences gapless; returns the padding."""
    rows = docs.select("doc_id", "text").collect()
    texts = {(r["doc_id"], r["text"]) for r in rows}
    ids = {k: np.array(v, "<u4") for k, v in zip(texts, brute.token_ids([t for _, t in texts], packing.END), strict=True)}
    repeats = Counter((r["doc_id"], r["text"]) for r in rows)
    owners = Counter(k for k, _ in texts)
    assert sum(r["length"] for r in pieces) == sum(len(ids[k]) * n for k, n in repeats.items())
    for r in pieces:
        if owners[r["doc_id"]] == 1:
            own = next(v for (k, _), v in ids.items() if k == r["doc_id"])
            cut = own[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(own) and len(cut) == r["length"] and r["ids_crc32"] == zlib.crc32(cut.tobytes())
    covered = Counter()
    for r in pieces:
        for t in range(r["start"], r["start"] + r["length"]):
            covered[(r["doc_id"], t)] += 1
    for key, n in repeats.items():
        if owners[key[0]] == 1:
            assert all(covered[(key[0], t)] == n for t in range(len(ids[key])))
    sequences = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values(), default=0) <= packing.WINDOW
    return sum(packing.WINDOW - n for n in sequences.values() if n & (n - 1))


def test_packing(documents, edge, empty):
    for docs in (documents, edge, documents.filter("length(text) < 900"), documents.filter("length(text) > 5000")):
        pieces = packing.pack(docs, step_tokens=20_000).collect()
        assert check_packing(docs, pieces) < packing.WINDOW
        loads = Counter()
        for r in pieces:
            loads[r["step"]] += r["length"]
        assert max(loads.values()) - min(loads.values()) <= 4 * packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_packed_sequences(documents):
    some = documents.limit(30)
    whole = packing.sequences(packing.pack(some, with_ids=True)).collect()
    ids = brute.token_ids([r["text"] for r in some.collect()], packing.END)
    assert all(r["n"] * 4 == len(r["ids"]) and r["n"] <= packing.WINDOW for r in whole)
    got = Counter(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in whole]).tolist())
    assert got == Counter(i for d in ids for i in d)


def vector_answer(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([rows[i][1] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    to = brute.roots(len(good), zip(*np.nonzero(np.triu(near)), strict=True))
    out = {i: (rows[i][0], 0, rows[i][0]) for i in range(len(rows))}
    first = {}
    for p, i in enumerate(good):
        first[to[p]] = min(first.get(to[p], rows[i][0]), rows[i][0])
    for p, i in enumerate(good):
        out[i] = (rows[i][0], int(near[p].sum()), first[to[p]])
    return Counter((k, n, c, k == c) for k, n, c in out.values())


@pytest.mark.parametrize("chunk", [8192, 7])
def test_vectors(spark, chunk):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(40, 160):  # chains of near copies around a few centres
        rows.append((i, (np.array(rows[int(r.integers(0, 4)) if i < 120 else i - 30][1]) * 3 + r.normal(size=8) * 0.4).tolist()))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [0.0] * 8), (203, None), (204, [float("nan")] * 8), (205, [None] * 8), (206, [1e-200] * 8), (207, [1e200] * 8)]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, rid string, copies int")
    got = Counter(tuple(x) for x in subspace_join.link_vectors(df, chunk=chunk).collect())
    scaled = [(k, [c / max(abs(c) for c in v) for c in v] if k in (206, 207) else v) for k, v in rows]
    assert got == vector_answer(scaled)
    assert subspace_join.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_another_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in subspace_join.link_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 900 + i) for i in range(50)] + [(3, 3), (901, 950)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{900 + i: 7 for i in range(51)}}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name) == []


def test_registry():
    names = entry_module.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, documents, sf_dir):
    """Each stage against its plain meaning, on what the one before it kept."""
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns
        rows = [tuple(r) for r in out.collect()]
        kept[name] = rows
        docs = spark.createDataFrame(rows, documents.schema)
    start = {tuple(r) for r in documents.collect()}
    assert set(kept["language"]) <= start and len(kept["language"]) >= 0.97 * len(start)
    best = {}
    for r in kept["language"]:
        best[r[1]] = max(best.get(r[1], r), r)
    assert sorted(kept["exact"]) == sorted(best.values())
    to = brute.simhash_groups([brute.simhash(r[1]) for r in kept["exact"]])
    first = {}
    for r, root in zip(kept["exact"], to, strict=True):
        first[root] = min(first.get(root, r), r)
    assert sorted(kept["near"]) == sorted(first.values())
    times = Counter(kept["mix"])
    assert set(times) <= set(kept["near"]) and max(times.values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert check_packing(docs, pieces) < packing.WINDOW
    whole = corpus_pipeline.run(spark, sf_dir)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = Counter()
    for r in whole.collect():
        total[r["doc_id"]] += r["length"]
    again = Counter()
    for r in pieces:
        again[r["doc_id"]] += r["length"]
    assert total == again and set(fields) <= set(whole.columns)
