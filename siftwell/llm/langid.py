"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

A text is the set of its byte n-grams, n = 1 to 4 (blended spectrum, presence only), hashed to
``BINS`` bins after folding: ASCII letters lower-cased, other ASCII as space, bytes from 0x80 on
as they are. The kernel is ``|x & y| / sqrt(|x| |y|)``. Landmark texts give the Nystroem map;
one-versus-rest ridge regression on it is folded into one matrix, so scoring a batch is two
matrix products: presence by landmarks, kernel values by weights.

Learning reads at most ``PER_LANGUAGE`` labelled texts of each language (those with the smallest
id hashes), whole, of the ``MOST_LANGUAGES`` that have most texts, and ``SAMPLE`` texts in all. The
model is ``LANDMARKS`` texts of ``BINS`` bits, and a weight for each landmark and language.
Prediction reads the whole of every text and only the text.

Defined cases: null, empty or letterless texts are ``und`` with score 0, as is everything when
there is no labelled text; an equal vote takes the first language by code point; texts with equal
id hashes are ordered by their bins; a null id is not held out; a text of any length is read in
pieces; extra columns may be carried along and clash with nothing.

``accepted`` is what a pipeline keeps: texts of which the kernel finds ``LEAST_SHARED`` of the n-grams
in one landmark, beyond the share that a random set has there. Votes alone tell short texts badly
from foreign ones; a text in no learned language has hardly more n-grams in common than chance.
Where nothing is labelled there is no kernel, and texts with a letter are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import carried, small_batches
from siftwell.llm.tokens import slices, text_bytes

BINS = 1 << 14
PER_LANGUAGE = 250
SAMPLE = 8000
MOST_LANGUAGES = 1000
LANDMARKS = 128
#: What a pipeline's text shares with a landmark at least. Foreign scripts have 0.14 at most in these tables, documents 0.36 at least.
LEAST_SHARED = 0.2
RIDGE = 1e-3
UNKNOWN = "und"
BLOCK = 128
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SPREAD = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - 14)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to 4, the bin of the n-gram that starts at each byte."""
    b = _FOLD[data]
    out, code = [], b
    for n in range(1, 5):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        out.append(((code + np.uint32(n * 0x51ED27)) * _SPREAD >> _SHIFT).astype(np.int32))
    return out


def presence(column: pa.Array) -> np.ndarray:
    """One row of 0/1 bins per text."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    for i in range(len(out)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        row = out[i]
        # Overlapping pieces bound the memory of a very long text.
        for at in range(lo, hi, 1 << 20):
            for bins in _grams(data[at : min(hi, at + (1 << 20) + 3)]):
                row[bins] = 1
    return out


@dataclass
class Model:
    """Languages, packed landmark rows, their sizes, and kernel values -> scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _kernel(rows, np.unpackbits(self.landmarks, axis=1)) @ self.weights + self.bias


def _kernel(a: np.ndarray, b: np.ndarray, b_float: np.ndarray | None = None) -> np.ndarray:
    b_float = b.astype(np.float32).T if b_float is None else b_float
    both = a.astype(np.float32) @ b_float
    size = np.maximum(a.sum(1, dtype=np.float32), 1)
    return both / np.sqrt(size)[:, None] / np.sqrt(np.maximum(b_float.sum(0), 1))[None, :]


def fit(languages: list[str], rows: np.ndarray) -> Model:
    """Nystroem features of the training rows, then one ridge regression for all languages."""
    names = sorted(set(languages))
    own = np.searchsorted(names, languages)
    y = np.full((len(rows), len(names)), -1.0)
    y[np.arange(len(rows)), own] = 1.0
    # The languages take turns, so with more of them than landmarks some have none, and none has many.
    turn = np.zeros(len(rows), int)
    for k in range(len(names)):
        at = np.flatnonzero(own == k)
        turn[at] = np.arange(len(at))
    chosen = np.sort(np.lexsort((own, turn))[:LANDMARKS])
    marks = rows[chosen]
    k_mm = _kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = _kernel(rows, marks).astype(float) @ root
    # Every language weighs the same, however many examples it has.
    weight = 1.0 / np.bincount(own)[own][:, None]
    weight /= weight.mean()
    mean_y = (weight * y).sum(0) / weight.sum()
    mean_phi = (weight * phi).sum(0) / weight.sum()
    centred = phi - mean_phi
    gram = centred.T @ (weight * centred) + RIDGE * len(rows) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, centred.T @ (weight * (y - mean_y)))
    return Model(names, np.packbits(marks, axis=1), (root @ w).astype(np.float32), (mean_y - mean_phi @ w).astype(np.float32))


def train(labelled: DataFrame) -> Model | None:
    """A model from rows ``doc_id, text, lang``; nulls teach nothing."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang", F.xxhash64(F.lit(23), "doc_id").alias("order"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    per = PER_LANGUAGE
    if (languages := counts.count()) == 0:
        return None
    per = max(1, min(PER_LANGUAGE, SAMPLE // languages))
    # Read only texts that can be among the first: a hash bound with room to spare.
    bounds = counts.select(F.col("lang").alias("l_lang"), F.least(F.lit(1.0), F.lit(2 * per + 50) / F.col("count")).alias("share"))
    near = known.join(F.broadcast(bounds), F.col("lang") == F.col("l_lang"))
    near = near.where((F.col("order") / F.lit(float(1 << 63)) + 1) / 2 <= F.col("share")).where(F.col("text").rlike(r"\p{L}"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, BLOCK):
                    few = part.slice(at, BLOCK)
                    packed = np.packbits(presence(few.column("text")), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [few.column("lang"), few.column("order"), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "order", "bits"]
                    )

    packed = near.select("lang", "order", "text").mapInArrow(run, "lang string, order long, bits binary")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("order", "bits"))
    rows = packed.withColumn("n", number).where(F.col("n") <= per).orderBy("lang", "n").collect()
    if not rows:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return fit([r["lang"] for r in rows], bits)


NAMES = ("lang_pred", "score", "shared")


def predict(docs: DataFrame, model: Model | None, carry: list[str], names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The ``carry`` columns of every row, the predicted language, its score, and the share of the text's
    n-grams that its nearest landmark has beyond chance.
    """
    small_batches(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    inputs, schema = carried(docs, carry, F.col("text").alias("text"), letters)
    schema += "lang_pred string, score double, shared double"
    width = len(carry)

    def run(batches):
        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32).T.copy() if model else None
        chance = marks.mean(0) if model else None
        for batch in batches:
            for part in slices(batch, "text"):
                best = np.full(part.num_rows, UNKNOWN, object)
                score, shared = np.zeros(part.num_rows), np.zeros(part.num_rows)
                letters = part.column(width + 1).to_numpy(zero_copy_only=False).astype(bool)
                if model:
                    for at in range(0, part.num_rows, BLOCK):
                        rows = presence(part.column(width).slice(at, BLOCK))
                        kernel = _kernel(rows, None, marks)
                        votes = kernel @ model.weights + model.bias
                        top = votes.argmax(1)
                        best[at : at + BLOCK] = np.array(model.languages, object)[top]
                        score[at : at + BLOCK] = np.clip((votes[np.arange(len(votes)), top].astype(float) + 1) / 2, 0, 1)
                        size = np.maximum(rows.sum(1, dtype=np.float32), 1)
                        inside = kernel * np.sqrt(np.maximum(chance * BINS, 1)) / np.sqrt(size)[:, None]
                        shared[at : at + BLOCK] = ((inside - chance) / np.maximum(1 - chance, 1e-6)).max(1)
                best[~letters] = UNKNOWN
                score[~letters] = shared[~letters] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(width)), pa.array(best, pa.string()), pa.array(score), pa.array(shared)],
                    [*(part.schema.names[:width]), *NAMES],
                )

    return inputs.mapInArrow(run, schema).toDF(*carry, *names)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with their own columns."""
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = "predicted", "predicted_score", "predicted_shared"
    while set(names) & set(docs.columns):
        names = tuple(f"{n}_" for n in names)
    found = predict(docs, model, docs.columns, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= LEAST_SHARED)).select(*docs.columns)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
