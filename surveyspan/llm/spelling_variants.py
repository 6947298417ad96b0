"""Spelling variants of a corpus: words one edit apart, found among permuterm rotations.

A word with a terminator has one rotation for each of its characters at the end. What stands before that character
is the word without it, cut open where it stood, so words that differ in one place agree in a prefix:

* replaced character: both words have the rotation that ends with it, equal but for that last character;
* inserted or deleted character: the longer word's rotation without its last character is a whole rotation of the shorter word.

All rotations are sorted by that prefix and each group of equal prefixes is scanned once. A group holds the words of one
prefix and a last character, so it has at most one row per character of the alphabet and one whole rotation;
no pairs are formed: a row takes its number of neighbours and the best of them from the group's counts and leading rows.
Two words meet in exactly one group: a prefix tells the place of the edit, and of equal neighbouring
characters only the first counts as the deleted one.

Counting words is one partial aggregation over the exploded texts; a hot word is combined before the shuffle.
A word's form occurs at least ``ratio`` times as often, so chains of forms are short and are followed by joins
with the words that still have a form.

Defined cases: a NULL or empty text has no words; a NULL id counts as the empty id; rows that
repeat count as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspan.llm.tools import prefix_sums, text_of, written

RUN = r"[a-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
#: Stands in no word.
TERMINATOR = "\u0001"
#: Longest prefix that is kept as text; beyond it a fingerprint modulo a prime of 127 bits stands for it. Some 10**12
#: prefixes of 10**6 characters hold two different ones that agree with a chance below 10**-8.
WRITTEN_OUT = 64
_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D1B54A32D192ED03A4F25B17
_ROTATION = ["prefix", "whole", "first", "wid", "n"]
_ROWS = 4096


def _slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one character when the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % SLIP == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` over all whole texts."""
    runs = docs.select(
        "doc_id",
        F.explode(F.regexp_extract_all(F.translate(text_of(), CAPITALS, SMALL), F.lit(RUN), F.lit(0))).alias("run"),
    )
    words = runs.filter(F.char_length("run") >= least_length).select(_slipped(F.col("doc_id"), F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rotations of long words, their prefixes as polynomial fingerprints: one step per character."""
    for batch in batches:
        for word, wid, n in zip(*(batch[c].to_pylist() for c in ("word", "wid", "n")), strict=True):
            points = list(map(ord, word))
            size, powers, upto = len(points), [1], [0]
            for c in points:
                powers.append(powers[-1] * _BASE % _PRIME)
                upto.append((upto[-1] * _BASE + c) % _PRIME)

            def turned(start: int, end: int) -> str:
                """The characters from ``start``, the terminator, and those before ``end``."""
                tail = upto[size] - upto[start] * powers[size - start]
                value = ((tail * _BASE + ord(TERMINATOR)) * powers[end] + upto[end]) % _PRIME
                return f"{size - start + 1 + end} {value:x}"

            for at in range(0, size + 1, _ROWS):
                places = range(at, min(size + 1, at + _ROWS))
                cut = [i for i in places if i < size] if size > WRITTEN_OUT else []
                prefixes = [turned(i + 1, i) for i in cut] + [turned(i, i) for i in places]
                first = [i == 0 or points[i] != points[i - 1] for i in cut] + [False] * len(places)
                whole = np.arange(len(prefixes)) >= len(cut)
                same = [pa.array(np.full(len(prefixes), x, np.int64)) for x in (wid, n)]
                yield pa.RecordBatch.from_arrays([pa.array(prefixes), pa.array(whole), pa.array(first), *same], _ROTATION)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, whole, first, wid, n``: every rotation of every word of ``word, wid, n``.

    ``whole`` rows hold the full rotation; the others lack their last character, and ``first`` says that
    this character differs from the one before it in the word. A prefix of more than ``WRITTEN_OUT``
    characters is replaced by its length and fingerprint, so a long word costs no more than its length.
    """
    word, size = F.col("word"), F.char_length("word")

    def without(i: Column) -> Column:
        own, before = F.substr(word, i, F.lit(1)), F.substr(word, i - 1, F.lit(1))
        cut = F.concat(F.substr(word, i + 1), F.lit(TERMINATOR), F.substr(word, F.lit(1), i - 1))
        return F.struct(cut.alias("prefix"), F.lit(False).alias("whole"), ((i == 1) | (own != before)).alias("first"))

    def full(i: Column) -> Column:
        cut = F.concat(F.substr(word, i), F.lit(TERMINATOR), F.substr(word, F.lit(1), i - 1))
        return F.struct(cut.alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))

    cuts = F.transform(F.sequence(F.lit(1), size), without)
    wholes = F.transform(F.sequence(F.lit(1), size + 1), full)
    # a whole rotation is one character longer than the word, a cut one as long
    turned = F.when(size < WRITTEN_OUT, F.concat(cuts, wholes)).otherwise(cuts)
    short = words.filter((size > 0) & (size <= WRITTEN_OUT)).select(F.explode(turned).alias("t"), "wid", "n")
    long = words.filter(size >= WRITTEN_OUT).mapInArrow(
        _fingerprints, "prefix string, whole boolean, first boolean, wid long, n long"
    )
    return short.select("t.*", "wid", "n").unionByName(long)


def neighbours(words: DataFrame) -> DataFrame:
    """``wid, n_near, best`` for the words with neighbours; ``best`` is (-n, wid) of the commonest.

    ``wid`` numbers the words in code-point order.
    """
    group = Window.partitionBy("prefix")
    placed = group.orderBy("whole", F.col("n").desc(), "wid")
    here, edited = F.struct((-F.col("n")).alias("m"), F.col("wid").alias("w")), ~F.col("whole")
    scanned = rotations(words).select(
        "whole",
        "first",
        "wid",
        F.row_number().over(placed).alias("place"),
        F.lead(F.when(edited, here)).over(placed).alias("next"),
        F.count_if(edited).over(group).alias("edits"),
        F.min(F.when(edited, here)).over(group).alias("top"),
        F.count_if(F.col("first")).over(group).alias("firsts"),
        F.min(F.when(F.col("first"), here)).over(group).alias("top_first"),
        F.min(F.when(F.col("whole"), here)).over(group).alias("short"),
    )
    # a longer word sees the others of its length and, through its first characters only, the shorter one
    others = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    shorter = F.when(F.col("first"), F.col("short"))
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(
        F.col("edits") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
    )
    best = F.when(F.col("whole"), F.col("top_first")).otherwise(F.least(others, shorter))
    found = scanned.select("wid", near.alias("near"), best.alias("best")).filter(F.col("near") > 0)
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """``wid, root`` for the rows (wid, form) of ``links``: the end of the chain of forms.

    Pointers are doubled: after t rounds every row has followed up to 2**t forms. Each form is commoner
    than its word by a factor, so a chain has at most log(corpus) members.
    """
    chains = written(links.select("wid", F.col("form").alias("root"), F.lit(True).alias("open")), "variant-chains")
    while not chains.filter("open").isEmpty():
        ahead = chains.select(F.col("wid").alias("_w"), F.col("root").alias("_r"))
        open_, done = chains.filter("open"), chains.filter("not open")
        moved = open_.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "wid", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("open")
        )
        chains = written(done.unionByName(moved), "variant-chains")
    return chains.select("wid", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table ``word, n`` of distinct words."""
    counted = words.select("word", F.col("n").cast("long").alias("n"), F.lit(1).alias("one"))
    numbered = prefix_sums(counted, ["word"], ["one"], "variant-words")
    words = numbered.select("word", "n", F.col("before_one").alias("wid"))
    common = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    near = written(
        words.select("wid", "n")
        .join(neighbours(words).withColumnRenamed("wid", "_w"), F.col("wid") == F.col("_w"))
        .select("wid", "n_near", F.when(common, F.col("best.w")).alias("form"), F.when(common, -F.col("best.m")).alias("form_n")),
        "variant-forms",
    )
    ends = last_forms(near.filter(F.col("form").isNotNull()))
    chained = (
        near.join(ends.withColumnRenamed("wid", "_e"), F.col("wid") == F.col("_e"), "left")
        .select(F.col("wid").alias("_w"), "n_near", "form", "form_n", "root")
    )
    names = words.select(F.col("wid").alias("_i"), F.col("word").alias("_name"))
    formed = (
        words.join(chained, F.col("wid") == F.col("_w"), "left")
        .join(names.toDF("_f", "form_word"), F.col("form") == F.col("_f"), "left")
        .join(names.toDF("_r", "root_word"), F.col("root") == F.col("_r"), "left")
    )
    return formed.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``doc_id, text`` rows."""
    return variants(word_counts(docs))
