"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is a bag of byte trigrams and four-grams (ASCII letters folded, other ASCII bytes as
blanks), each hashed to one of ``BUCKETS`` embeddings. The mean embedding goes through a
linear softmax. Embeddings and weights are trained together by mini-batch gradient descent in numpy
on the driver, on short segments of about ``PER_LANGUAGE`` rows of each language, ``SEGMENTS`` a row. Every language takes
part, however many rows it has: shares are drawn with 62 bits, and a language whose share met no row gives the row with the
smallest draw. Beyond ``ROWS / PER_LANGUAGE`` languages each has about ``ROWS / languages`` rows. The segments start
at bytes drawn by hash from anywhere in a text, blanks in it or not.

Prediction averages the embeddings over the whole text inside an Arrow function and multiplies by the weights; with no more
languages than ``DIMENSIONS`` the product of both is a table, made once. A language costs the driver and the model
``DIMENSIONS`` numbers and its sample rows, nothing that grows with the rows. A fifth of the sample sets the
softmax temperature and the rejection threshold: the score below which only ``LOST`` of the
correctly recognised segments lie.

Learned from: text and lang of rows with a language whose crc32(doc_id) mod 5 is not 0. Defined cases:
a NULL text or one without a letter is ``und`` with score 0 and rejected; without any row to
learn from every text is ``und``; a NULL id is not held out and not learned from; repeated rows
count as often as they occur; an empty table gives no rows; further columns are ignored or carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 14
DIMENSIONS = 16
PER_LANGUAGE = 1000
SEGMENTS = 4
SEGMENT_WORDS = 30
SEGMENT_BYTES = 64 * SEGMENT_WORDS
#: Rows of all languages together.
ROWS = 64_000
#: Draws lie in [0, 2**DRAW_BITS).
DRAW_BITS = 62
EPOCHS = 6
RATE = 30.0
LOST = 0.001
#: Bytes that are looked at in one go.
PIECE = 1 << 20
UNKNOWN = "und"
_PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SHIFT = np.uint32(32 - 14)


def _buckets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram and of the four-gram that start at each byte (the last ones run into blanks)."""
    b = np.concatenate([_FOLD[raw], np.full(3, 32, np.uint32)])
    three = b[:-3] * np.uint32(2654435761) + b[1:-2] * np.uint32(2246822519) + b[2:-1] * np.uint32(3266489917)
    four = three * np.uint32(668265263) + b[3:] * np.uint32(374761393) + np.uint32(1)
    return ((three ^ (three >> 15)) * np.uint32(2654435761)) >> _SHIFT, ((four ^ (four >> 15)) * np.uint32(2654435761)) >> _SHIFT


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # a row per bucket, added up over a text
    weights: np.ndarray | None  # from the sums to the languages; None where the table holds their scores
    bias: np.ndarray
    temperature: float
    threshold: float

    @staticmethod
    def of(languages: tuple[str, ...], emb: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
        table, left = emb.astype(np.float64), weights.astype(np.float64)
        if len(languages) <= DIMENSIONS:
            table, left = table @ left, None
        return Model(languages, table, left, bias.astype(np.float64), 1.0, 0.0)

    def mean_scores(self, raw: np.ndarray) -> np.ndarray:
        """Logits of one whole text given as bytes, piece by piece."""
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(raw), PIECE):
            # a piece also sees the three bytes after it, so that no n-gram is lost at the cut
            n = min(PIECE, len(raw) - at)
            for ids in _buckets(raw[at : at + n + 3]):
                if n < BUCKETS:
                    total += self.table.take(ids[:n], axis=0).sum(0)
                else:
                    total += np.bincount(ids[:n], minlength=BUCKETS) @ self.table
        mean = total / max(1, 2 * len(raw))
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        logits = np.stack([self.mean_scores(t) for t in texts]) / self.temperature
        odds = np.exp(logits - logits.max(1, keepdims=True))
        best = logits.argmax(1)
        return best, 1.0 / odds.sum(1)


def _counts(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(BUCKETS, np.float32)
    for ids in _buckets(raw):
        total += np.bincount(ids, minlength=BUCKETS)
    return total / (2 * len(raw))


def train(rows: list[tuple[str, bytes, bool]]) -> Model:
    """Fit on (language, segment, for calibration) rows; the same rows in the same order give the same model."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), None, np.zeros(0), 1.0, 0.0)
    code = {c: i for i, c in enumerate(languages)}
    raws = [np.frombuffer(r[1], np.uint8) for r in rows]
    target = np.array([code[r[0]] for r in rows])
    held = np.array([r[2] for r in rows])
    if not held.any() or held.all():
        held = np.zeros(len(rows), bool)
    random = np.random.default_rng(7)
    emb = random.normal(0, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    share = np.bincount(target, minlength=len(languages)).clip(1)
    importance = (len(rows) / len(languages) / share).astype(np.float32)
    used = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        order = random.permutation(used)
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            x = np.stack([_counts(raws[i]) for i in some])
            h = x @ emb
            z = h @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            p *= (importance[target[some]] / len(some))[:, None]
            back = p @ weights.T
            weights -= rate * (h.T @ p)
            bias -= np.float32(0.1) * p.sum(0)
            emb -= rate * (x.T @ back)
    model = Model.of(languages, emb, weights, bias)
    check = np.flatnonzero(held) if held.any() else used
    logits = np.stack([model.mean_scores(raws[i]) for i in check])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(check)), target[check]]))

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    model = replace(model, temperature=float(temperature))
    best, score = model.predict([raws[i] for i in check])
    right = np.sort(score[best == target[check]])
    threshold = float(right[int(LOST * len(right))]) if len(right) else 0.0
    # never so strict that a language likelier than all others together counts as unsure
    return replace(model, threshold=min(threshold, 0.5))


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def has_letter() -> Column:
    return F.coalesce(F.regexp_like(F.col("text"), F.lit(r"\p{L}")), F.lit(False))


def segments(key: object, text: str) -> list[bytes]:
    """Up to SEGMENTS runs of words from bytes of the whole text that the key's hash chooses.

    A run begins at a word, or inside one that is longer than 64 bytes, and ends with a whole character.
    """
    raw = text.encode()
    out = {}
    last = max(1, len(raw) - 6 * SEGMENT_WORDS)  # not so near the end that next to nothing follows
    for i in range(SEGMENTS):
        start = zlib.crc32(f"{key}/{i}".encode()) % last
        if start:
            blank = raw.find(b" ", start, start + 64)
            start = blank + 1 if blank >= 0 else start
        out[start] = _run(raw, start)
    found = [out[s] for s in sorted(out) if out[s]]
    # blanks at all chosen places: the first words instead
    return found or [x for x in (_run(raw, len(raw) - len(raw.lstrip())),) if x]


def _run(raw: bytes, start: int) -> bytes:
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    piece = raw[start : start + SEGMENT_BYTES]
    if start + SEGMENT_BYTES < len(raw):
        piece = piece.decode(errors="ignore").encode()
    return b" ".join(piece.split()[:SEGMENT_WORDS])


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _segments(key: pa.Array, text: pa.Array) -> pa.Array:
    pairs = zip(key.to_pylist(), text.to_pylist(), strict=True)
    return pa.array([segments(k, t or "") for k, t in pairs], pa.list_(pa.binary()))


def shares(sizes: dict[str, int]) -> list[tuple[str, int]]:
    """(language, bound): a row takes part if its draw lies below the bound, never 0 and whole for small languages."""
    rows = max(1, min(PER_LANGUAGE, ROWS // max(1, len(sizes))))
    return [(lang, max(1, min(1 << DRAW_BITS, (rows << DRAW_BITS) // n))) for lang, n in sizes.items()]


def fit(docs: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    usable = docs.filter(F.col("lang").isNotNull() & (_remainder() != 0)).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().collect()  # one row per language, as in the model
    if not sizes:
        return train([])
    # one draw per row; a language takes the rows below its share
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language sample")), 64 - DRAW_BITS)
    below = shares({r["lang"]: r["count"] for r in sizes})
    bounds = docs.sparkSession.createDataFrame(below, "_lang string, _below long")
    lettered = usable.filter(has_letter())
    chosen = lettered.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).filter(draw < F.col("_below"))

    def sampled(rows: DataFrame) -> set[tuple[str, int, bytes]]:
        cut = rows.select("doc_id", "lang", F.explode(_segments(F.col("doc_id"), F.col("text"))).alias("segment"))
        return {(r["lang"], r["doc_id"], bytes(r["segment"])) for r in cut.collect()}

    found = sampled(chosen)
    missing = sorted({lang for lang, _ in below} - {lang for lang, _, _ in found})
    if missing:  # a share that met no row, or a language without a letter
        names = docs.sparkSession.createDataFrame([(x,) for x in missing], "_lang string")
        left = lettered.join(F.broadcast(names), F.col("lang") == F.col("_lang"))
        first = left.groupBy("lang").agg(F.min_by("doc_id", draw).alias("_first"))
        ids = first.select(F.col("lang").alias("_l"), "_first")
        found |= sampled(left.join(ids, (F.col("lang") == F.col("_l")) & (F.col("doc_id") == F.col("_first"))))
    rows = sorted(found)
    return train([(lang, segment, zlib.crc32(f"calibrate {key}".encode()) % 5 == 0) for lang, key, segment in rows])


def predictor(model: Model):
    """An Arrow function text -> (lang, score); the caller masks texts without letters."""

    @F.arrow_udf(_PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.cast(pa.large_string())
            n = len(texts)
            best, score = np.full(n, len(model.languages)), np.zeros(n)
            if model.languages and n:
                texts = texts.fill_null("")
                _, offsets, data = texts.buffers()
                cut = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
                raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
                best, score = model.predict([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
            yield pa.StructArray.from_arrays(
                [pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang", "score"]
            )

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score, rejected``."""
    model = fit(docs) if model is None else model
    known = has_letter() & F.lit(bool(model.languages))
    found = docs.select(
        "doc_id",
        F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"),
        known.alias("known"),
        predictor(model)(F.col("text")).alias("p"),
    )
    return found.select(
        "doc_id",
        "held_out",
        F.when(F.col("known"), F.col("p.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("known"), F.col("p.score")).otherwise(F.lit(0.0)).alias("score"),
        (~F.col("known") | (F.col("p.score") < F.lit(model.threshold))).alias("rejected"),
    )


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows whose language is recognised with enough confidence, columns unchanged."""
    model = fit(docs) if model is None else model
    if not model.languages:
        return docs.filter(F.lit(False))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        has_letter().alias("_known"),
        predictor(model)(F.col("text")).alias("_p"),
    )
    return row.filter(F.col("_known") & (F.col("_p.score") >= F.lit(model.threshold))).select("_row.*")
