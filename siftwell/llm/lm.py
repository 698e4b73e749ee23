"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, scored from mapped arrays.

Counting. Words are 48-bit hashes. Each task reduces its texts to distinct n-grams with counts and
packs them as one binary row per bucket, so the shuffle moves few bytes a distinct n-gram. A
bucket holds whole contexts, which makes context totals local, and is written to the shared folder
as sorted arrays: n-gram keys and counts, contexts and their statistics. What it holds is passed
on to the next lower order as continuation counts, down to single words.

Buckets grow with the input, rows in proportion to it: a task deals to at most ``1 << FAN`` buckets
at a time, and beyond that rows are merged and dealt again, ``FAN`` bits deeper each time.

A context of words that each occur more than ``OFTEN`` times (the start of a text is one) is dealt
over several buckets by its next word; the parts of its statistics meet in its home bucket. The
list of such words is a sorted file; the driver sees only sums.

Scoring. Workers memory-map the arrays and look up each slice's distinct n-grams by binary search.
Nothing of the model is broadcast but discounts and totals.

``order`` is a parameter. The query uses two: the figures of three are in the README.

Limits. Two words of one 48-bit hash count as one: of ten million distinct words about 0.2 pairs.
The start is ``order - 1`` context words. Every order below the highest counts distinct contexts.

Defined cases: a null text is empty and scores its end alone; repeated rows are rows; with no
training rows every word is unknown and the base is uniform; a null id is trained on; texts of any
length are read in whole. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import BLOB, blob_batch, carried, deal, input_bytes, map_array, put_array, runs, shared_folder, small_batches
from siftwell.llm.tokens import STEP, hash_words, mix, slices, text_bytes

LOW = np.uint64((1 << 48) - 1)
END = np.uint64(1)
START = np.uint64(2)
BUCKET_BYTES = 8 << 20
#: Text bytes that a worker counts at once.
SLICE = 8 << 20
#: Occurrences beyond which a word's contexts are dealt over several buckets: a fifth of a bucket's tokens.
OFTEN = 1 << 18
#: Bits of a bucket number that one shuffle deals by.
FAN = 11

def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and its end, one after another, and the row bounds."""
    data, offsets = text_bytes(column)
    words = hash_words(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(words.hashes) + n, END, np.uint64)
    place = np.arange(len(words.hashes)) + words.rows
    out[place] = np.maximum(words.hashes & LOW, np.uint64(3))
    return out, words.bounds + np.arange(n + 1)


def _before(tokens: np.ndarray, bounds: np.ndarray, most: int) -> list[np.ndarray]:
    """The ``most`` tokens before each token, oldest first; the start where the text begins."""
    out, last = [], tokens
    for _ in range(most):
        shifted = np.empty_like(last)
        shifted[1:] = last[:-1]
        shifted[bounds[:-1]] = START
        out.insert(0, shifted)
        last = shifted
    return out


def _context(words: list[np.ndarray]) -> np.ndarray:
    """A hash of a context; a context of one word is that word."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * STEP + w)
    return out


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _gram_key(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(context * STEP + w)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, first index of each distinct key in that order, and the sorted keys."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return order, first, keys


def _pack(h: np.ndarray) -> bytes:
    return (h >> np.uint64(16)).astype(np.uint32).tobytes() + (h & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(raw, n: int, at: int = 0) -> np.ndarray:
    high = np.frombuffer(raw, np.uint32, n, at).astype(np.uint64)
    return (high << np.uint64(16)) | np.frombuffer(raw, np.uint16, n, at + 4 * n)


@dataclass
class Layout:
    """Where the arrays are, how many buckets there are, the length of the n-grams, and how rows are dealt."""

    folder: str
    bits: int
    order: int
    often: int = OFTEN
    fan: int = FAN

    @property
    def first(self) -> int:
        """Bits of the first deal."""
        return min(self.fan, self.bits)


class Words:
    """Distinct words with counts, as rows of one bucket each."""

    width = 1

    def __init__(self, layout: Layout) -> None:
        self.layout = layout

    def bucket(self, words, bits: int) -> np.ndarray:
        return _bucket(words[-1], bits)

    def merged(self, words, counts):
        order, first, keys = _grouped(words[-1])
        return [keys[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]

    def packed(self, words, counts) -> bytes:
        return _pack(words[-1]) + counts.astype(np.uint32).tobytes()

    def unpacked(self, raw, n: int):
        return [_unpack(raw, n)], np.frombuffer(raw, np.uint32, n, 6 * n).astype(np.int64)


class Grams(Words):
    """Distinct n-grams (the words of the context, then the word) with counts.

    The bucket is the context's, or for a context of words that are all often one of a few from
    there on, by the word.
    """

    def __init__(self, layout: Layout, width: int) -> None:
        super().__init__(layout)
        self.width = width
        self.often = None

    def spread(self, context: list[np.ndarray]) -> np.ndarray:
        """Over how many buckets each context is dealt; zero for one that is whole."""
        if self.often is None:
            self.often = map_array(f"{self.layout.folder}/often", np.uint64), map_array(f"{self.layout.folder}/often-count", np.int64)
        words, counts = self.often
        out = np.full(len(context[0]), 1 << self.layout.bits, np.int64)
        for w in context:
            at = np.minimum(np.searchsorted(words, w), len(words) - 1)
            out = np.minimum(out, np.where(words[at] == w, counts[at] // self.layout.often + 1, 0))
        return out

    def bucket(self, words, bits: int) -> np.ndarray:
        top = self.layout.bits
        out = _bucket(_context(words[:-1]), top)
        spread = self.spread(words[:-1])
        dealt = np.flatnonzero(spread)
        out[dealt] = (out[dealt] + (mix(words[-1][dealt]) >> np.uint64(32)).astype(np.int64) % spread[dealt]) & ((1 << top) - 1)
        return out >> (top - bits)

    def merged(self, words, counts):
        order, first, _ = _grouped(_gram_key(_context(words[:-1]), words[-1]))
        if not len(first):
            return words, counts
        return [w[order[first]] for w in words], np.add.reduceat(counts[order], first)

    def packed(self, words, counts) -> bytes:
        """Each distinct context once, with the length of its run."""
        context = _context(words[:-1])
        order = np.argsort(context, kind="stable")
        starts = np.flatnonzero(np.append(True, context[order][1:] != context[order][:-1]))
        lengths = np.diff(np.append(starts, len(order))).astype(np.uint32)
        head = np.array([len(starts)], np.uint32).tobytes() + lengths.tobytes() + b"".join(_pack(w[order[starts]]) for w in words[:-1])
        return head + _pack(words[-1][order]) + counts[order].astype(np.uint32).tobytes()

    def unpacked(self, raw, n: int):
        k = int(np.frombuffer(raw, np.uint32, 1)[0])
        lengths = np.frombuffer(raw, np.uint32, k, 4)
        at = 4 + 4 * k
        context = [np.repeat(_unpack(raw, k, at + 6 * k * i), lengths) for i in range(self.width - 1)]
        at += 6 * k * (self.width - 1)
        return [*context, _unpack(raw, n, at)], np.frombuffer(raw, np.uint32, n, at + 6 * n).astype(np.int64)


def _blobs(kind: Words, words, counts, bits: int) -> list[tuple[int, int, bytes]]:
    """One row per bucket of ``bits``."""
    bucket = kind.bucket(words, bits)
    order = np.argsort(bucket, kind="stable")
    words, counts = [w[order] for w in words], counts[order]
    return [(b, s.stop - s.start, kind.packed([w[s] for w in words], counts[s])) for b, s in runs(bucket[order])]


def _joined(kind: Words, ns, raws):
    """The merged entries of several rows."""
    parts = [kind.unpacked(raw, n) for n, raw in zip(ns, raws, strict=True)]
    words = [np.concatenate([p[0][i] for p in parts]) for i in range(len(parts[0][0]))]
    return kind.merged(words, np.concatenate([p[1] for p in parts]))


def _dealt(found: DataFrame, kind: Words) -> DataFrame:
    """Rows by the first bits of their bucket to rows by all bits."""
    layout = kind.layout
    return deal(found, layout.first, layout.bits, layout.fan, lambda ns, raws, bits: _blobs(kind, *_joined(kind, ns, raws), bits))


@dataclass
class Model:
    """What scoring needs besides the arrays; ``discounts`` by order, from single words on."""

    layout: Layout
    tokens: int
    distinct: int
    bigrams: int
    discounts: list[np.ndarray]
    unseen: float


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) from how many counts are 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


def _classes(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _put(uri: str, array: np.ndarray) -> None:
    """An array that is missing reads as empty."""
    if len(array):
        put_array(uri, array)


def _summaries(train: DataFrame, layout: Layout, name: str, width: int) -> list[int]:
    """The sums over all buckets of the small arrays that reducers left."""
    buckets = train.sparkSession.range(0, 1 << layout.bits, 1, max(1, (1 << layout.bits) >> 8))

    def run(batches):
        for batch in batches:
            found = [map_array(f"{layout.folder}/{name}-{b}", np.int64) for b in batch.column(0).to_pylist()]
            total = np.sum([f for f in found if len(f)] or [np.zeros(width, np.int64)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.tolist()], [f"s{i}" for i in range(width)])

    row = buckets.mapInArrow(run, ", ".join(f"s{i} long" for i in range(width))).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).first()
    return [v or 0 for v in row]


def _count_words(train: DataFrame, layout: Layout) -> None:
    """Write word counts, and the words that occur often."""
    kind = Words(layout)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, counts = np.unique(_sequences(part.column(0))[0], return_counts=True)
                yield blob_batch(_blobs(kind, [words], counts, layout.first))

    def reduce(key, table):
        b = key[0].as_py()
        (words,), counts = _joined(kind, table["n"].to_pylist(), table["data"].to_pylist())
        _put(f"{layout.folder}/word-{b}", words)
        _put(f"{layout.folder}/count-{b}", counts)
        _put(f"{layout.folder}/sum-1-{b}", np.array([counts.sum(), len(words)], np.int64))
        often = np.flatnonzero((counts > layout.often) & (words != END))
        return pa.table({"word": words[often].view(np.int64), "count": counts[often]})

    blobs = _dealt(train.select("text").mapInArrow(run, BLOB), kind)
    often = blobs.groupBy("bucket").applyInArrow(reduce, "word long, count long")
    # The start is a context of every text. Words are below 2**48, so LONG order is their order.
    start = train.sparkSession.createDataFrame([(int(START), layout.often << layout.bits)], "word long, count long")

    def write(batches):
        found = [b for b in batches if b.num_rows]
        for name, i, kind_ in (("often", 0, np.uint64), ("often-count", 1, np.int64)):
            _put(f"{layout.folder}/{name}", np.concatenate([b.column(i).to_numpy() for b in found]).astype(kind_))
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in found)])], ["n"])

    often.unionByName(start).repartition(1).sortWithinPartitions("word").mapInArrow(write, "n long").collect()


def _count_grams(blobs: DataFrame, layout: Layout, width: int) -> DataFrame:
    """Write the arrays of the n-grams of ``width`` words; rows of the next lower order."""
    kind = Grams(layout, width)
    lower = Grams(layout, width - 1) if width > 2 else Words(layout)
    folder = layout.folder

    def reduce(key, table):
        b = key[0].as_py()
        words, c = _joined(kind, table["n"].to_pylist(), table["data"].to_pylist())
        context = _context(words[:-1])
        keys = _gram_key(context, words[-1])
        order = np.argsort(keys)
        keys, sorted_counts = keys[order], c[order]
        _put(f"{folder}/gram{width}-{b}", keys)
        _put(f"{folder}/n{width}-{b}", np.minimum(sorted_counts, 255).astype(np.uint8))
        large = sorted_counts >= 255
        _put(f"{folder}/large{width}-{b}", keys[large])
        _put(f"{folder}/largen{width}-{b}", sorted_counts[large])
        order, first, contexts = _grouped(context)
        c_v, contexts = c[order], contexts[first]
        stats = np.stack([np.add.reduceat(x, first) for x in (c_v, *((c_v == k).astype(np.int64) for k in (1, 2)), (c_v > 2).astype(np.int64))], 1)
        dealt = kind.spread([w[order[first]] for w in words[:-1]]) > 0
        _put(f"{folder}/context{width}-{b}", contexts[~dealt])
        _put(f"{folder}/stats{width}-{b}", stats[~dealt].astype(np.uint32))
        _put(f"{folder}/part{width}-{b}", contexts[dealt])
        _put(f"{folder}/partstats{width}-{b}", stats[dealt])
        _put(f"{folder}/sum-{width}-{b}", np.array([*_classes(c), len(c)], np.int64))
        # Each n-gram is one context of the shorter one without its first word.
        rows = _blobs(lower, *lower.merged(words[1:], np.ones(len(c), np.int64)), layout.first)
        return pa.Table.from_batches([blob_batch(rows)])

    return blobs.groupBy("bucket").applyInArrow(reduce, BLOB)


def _meet(train: DataFrame, layout: Layout, width: int) -> None:
    """Sum the parts of dealt contexts' statistics in their home buckets."""
    folder, bits = layout.folder, layout.bits
    buckets = train.sparkSession.range(0, 1 << bits, 1, max(1, (1 << bits) >> 8))
    names = [f"s{i}" for i in range(4)]

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                contexts = map_array(f"{folder}/part{width}-{b}", np.uint64)
                stats = map_array(f"{folder}/partstats{width}-{b}", np.int64).reshape(-1, 4)
                columns = [pa.array(_bucket(contexts, bits)), pa.array(contexts.view(np.int64)), *(pa.array(stats[:, i]) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "context", *names])

    def reduce(key, table):
        b = key[0].as_py()
        order, first, contexts = _grouped(table["context"].to_numpy().view(np.uint64))
        stats = np.stack([np.add.reduceat(table[s].to_numpy()[order], first) for s in names], 1)
        _put(f"{folder}/dealt{width}-{b}", contexts[first])
        _put(f"{folder}/dealtstats{width}-{b}", stats)
        return pa.table({"n": [len(first)]})

    parts = buckets.mapInArrow(run, "bucket long, context long, s0 long, s1 long, s2 long, s3 long")
    # Parts of one context are summed on the way, so a context of many parts is few rows.
    parts = parts.groupBy("bucket", "context").agg(*(F.sum(s).alias(s) for s in names))
    parts.groupBy("bucket").applyInArrow(reduce, "n long").agg(F.sum("n")).collect()


def _continuations(blobs: DataFrame, layout: Layout) -> None:
    """Write, beside the words, in how many contexts each occurs."""
    folder, kind = layout.folder, Words(layout)

    def reduce(key, table):
        b = key[0].as_py()
        (words,), counts = _joined(kind, table["n"].to_pylist(), table["data"].to_pylist())
        known = map_array(f"{folder}/word-{b}", np.uint64)
        out = np.zeros(len(known), np.int64)
        out[np.searchsorted(known, words)] = counts
        _put(f"{folder}/contexts-{b}", out)
        _put(f"{folder}/sum-0-{b}", np.array(_classes(counts), np.int64))
        return pa.table({"n": [len(counts)]})

    blobs.groupBy("bucket").applyInArrow(reduce, "n long").agg(F.sum("n")).collect()


def train_model(train: DataFrame, bucket_bytes: int = BUCKET_BYTES, order: int = 2, often: int = OFTEN, fan: int = FAN) -> Model:
    """Count the texts of ``train`` into a fresh shared folder; ``order`` is two at least."""
    small_batches(train.sparkSession, SLICE)
    buckets = max(16, -(-input_bytes(train) // bucket_bytes))
    layout = Layout(shared_folder(train.sparkSession, "lm"), (buckets - 1).bit_length(), order, often, fan)
    _count_words(train, layout)
    kind = Grams(layout, order)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w, bounds = _sequences(part.column(0))
                words = [*_before(w, bounds, order - 1), w]
                yield blob_batch(_blobs(kind, *kind.merged(words, np.ones(len(w), np.int64)), layout.first))

    blobs = _dealt(train.select("text").mapInArrow(run, BLOB), kind)
    for width in range(order, 1, -1):
        blobs = _dealt(_count_grams(blobs, layout, width), Grams(layout, width - 1) if width > 2 else Words(layout))
    _continuations(blobs, layout)
    for width in range(order, 1, -1):
        _meet(train, layout, width)
    tokens, distinct = _summaries(train, layout, "sum-1", 2)
    word_classes = _summaries(train, layout, "sum-0", 4)
    found = [_summaries(train, layout, f"sum-{width}", 5) for width in range(2, order + 1)]
    pairs = found[0][4]
    d = discounts(word_classes)
    # Mass that the word level leaves for unknown words: what its discounts take from all words.
    taken = d[1] * word_classes[0] + d[2] * word_classes[1] + d[3] * (distinct - word_classes[0] - word_classes[1])
    unseen = (taken / pairs if pairs else 1.0) / (distinct + 1)
    return Model(layout, tokens, distinct, pairs, [d, *(discounts(f[:4]) for f in found)], float(unseen))


class _Arrays:
    """A worker's mapped arrays."""

    def __init__(self, model: Model) -> None:
        self.m, self.folder, self.bits, self.maps = model, model.layout.folder, model.layout.bits, {}
        self.grams = {n: Grams(model.layout, n) for n in range(2, model.layout.order + 1)}

    def get(self, kind: str, b: int, dtype) -> np.ndarray:
        if (kind, b) not in self.maps:
            self.maps[kind, b] = map_array(f"{self.folder}/{kind}-{b}", dtype)
        return self.maps[kind, b]

    def _each(self, keys: np.ndarray, bucket: np.ndarray, kind: str):
        """(bucket, rows of ``keys`` that are in its array, where they are)."""
        order = np.argsort(bucket, kind="stable")
        for b, s in runs(bucket[order]):
            rows = order[s]
            held = self.get(kind, b, np.uint64)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
                hit = held[at] == keys[rows]
                yield b, rows[hit], at[hit]

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and word-level probabilities of distinct words."""
        counts, more = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for b, rows, at in self._each(words, _bucket(words, self.bits), "word"):
            counts[rows] = self.get("count", b, np.int64)[at]
            held = self.get("contexts", b, np.int64)
            more[rows] = held[at] if len(held) else 0
        p = (more - self.m.discounts[0][np.minimum(more, 3)]) / max(1, self.m.bigrams) + self.m.unseen
        return counts, p

    def contexts(self, width: int, words: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """Total, ones, twos, more of distinct contexts."""
        out = np.zeros((len(hashes), 4), np.int64)
        home = _bucket(hashes, self.bits)
        dealt = self.grams[width].spread(words) > 0
        for kind, stats, dtype, those in (("context", "stats", np.uint32, ~dealt), ("dealt", "dealtstats", np.int64, dealt)):
            which = np.flatnonzero(those)
            for b, rows, at in self._each(hashes[which], home[which], f"{kind}{width}"):
                out[which[rows]] = self.get(f"{stats}{width}", b, dtype).reshape(-1, 4)[at]
        return out

    def counts(self, width: int, words: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Counts of distinct n-grams."""
        out = np.zeros(len(keys), np.int64)
        for b, rows, at in self._each(keys, self.grams[width].bucket(words, self.bits), f"gram{width}"):
            found = self.get(f"n{width}", b, np.uint8)[at].astype(np.int64)
            full = np.flatnonzero(found == 255)
            if len(full):
                large = self.get(f"large{width}", b, np.uint64)
                found[full] = self.get(f"largen{width}", b, np.int64)[np.searchsorted(large, keys[rows[full]])]
            out[rows] = found
        return out

    def raised(self, width: int, words: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """The probability of each word after its context, from that after the next shorter one."""
        context = _context(words[:-1])
        order, first, keys = _grouped(_gram_key(context, words[-1]))
        lengths = np.diff(np.append(first, len(order)))
        at = order[first]
        c = self.counts(width, [w[at] for w in words], keys[first])
        seen, one, which = np.unique(context[at], return_index=True, return_inverse=True)
        s = self.contexts(width, [w[at[one]] for w in words[:-1]], seen)
        d = self.m.discounts[width - 1]
        total = np.maximum(1, s[:, 0])
        back = (s[:, 1:] * d[1:]).sum(1) / total
        back[s[:, 0] == 0] = 1.0
        p = (c - d[np.minimum(c, 3)]) / total[which] + back[which] * lower[at]
        out = np.empty(len(lower))
        out[order] = np.repeat(p, lengths)
        return out


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The ``carry`` columns with token counts, base score and model score of each whole text."""
    small_batches(docs.sparkSession, SLICE)
    inputs, schema = carried(docs, carry, F.col("text").alias("text"))
    schema += "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    width, order = len(carry), model.layout.order

    def run(batches):
        arrays = _Arrays(model)
        total = model.tokens + 1 * (model.distinct + 1)
        for batch in batches:
            for part in slices(batch, "text", SLICE // 2):
                w, bounds = _sequences(part.column(width))
                words, which = np.unique(w, return_inverse=True)
                counts, p = arrays.words(words)
                p, known = p[which], counts[which]
                before = _before(w, bounds, order - 1)
                for n in range(2, order + 1):
                    p = arrays.raised(n, [*before[order - n :], w], p)
                base = np.log10((known + 1) / total)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(width)),
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat((known > 0).astype(np.int64), bounds[:-1])),
                        pa.array(np.full(part.num_rows, model.tokens)),
                        pa.array(np.add.reduceat(base, bounds[:-1])),
                        pa.array(np.add.reduceat(np.log10(p), bounds[:-1])),
                    ],
                    [*part.schema.names[:width], "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return inputs.mapInArrow(run, schema).toDF(*carry, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
