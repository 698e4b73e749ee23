"""Quality rules: text statistics and a learned decision list.

One Arrow pass computes the statistics of every whole text. A sequential-covering learner grows
threshold conjunctions against the labelled bad documents on two thirds of the labelled rows,
prunes each on the rest, and keeps it while its precision there holds; the ordered rules become
one Spark conditional expression, so applying them is plain SQL on the statistics.

Learning reads at most ``SAMPLE`` labelled rows (those with the smallest id hashes). All else
covers every row.

Defined cases: a null text has no words and fails the base rules; a null label teaches nothing;
an id that occurs in several label rows is several examples; with no labels the list is empty
and keeps what passes the base rules; examples that tie in a feature lie on one side of a bound;
texts of any length are measured in whole; repeated rows are rows; columns besides ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import hash_sample, materialize, small_batches
from siftwell.llm.tokens import SPACE, STEP, hash_words, mix, slices, text_bytes, windows

WINDOW = 8
SAMPLE = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_letters", "n_distinct")
SYMBOLS = b"#*$%&|<>"
# Ratios the rules are learned on: name -> (numerator, denominator).
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "marks_per_word": ("n_marks", "n_words"),
    "letter_share": ("n_letters", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
}

_BYTE = np.arange(256)
_POINT = ((_BYTE & 0xC0) != 0x80) & ~SPACE
_SYMBOL = np.isin(_BYTE, np.frombuffer(SYMBOLS, np.uint8))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_MARK = np.isin(_BYTE, np.frombuffer(b"!?", np.uint8))
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0xC0)
_PACKED = [
    (a.astype(np.uint64) | (b.astype(np.uint64) << np.uint64(32))) for a, b in ((_POINT, _SYMBOL), (_UPPER, _MARK))
]
_LETTERS = _LETTER.astype(np.uint32)


def _per_row(values: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values[data[offsets[0] : offsets[-1]]], dtype=values.dtype)))
    return np.diff(sums[offsets - offsets[0]])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text as LONG arrays."""
    data, offsets = text_bytes(column)
    words = hash_words(data, offsets, fold=False)
    rows = words.rows.astype(np.uint64) * STEP
    out = {"n_words": words.counts}
    low = np.uint64(0xFFFFFFFF)
    points, upper = (_per_row(t, data, offsets) for t in _PACKED)
    out |= {"word_chars": points & low, "n_symbols": points >> np.uint64(32), "n_upper": upper & low, "n_marks": upper >> np.uint64(32)}
    out["n_letters"] = _per_row(_LETTERS, data, offsets)
    hashes, at = windows(words, WINDOW)
    again = at[_repeated(mix(hashes + rows[at]))] if len(at) else at
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(cover[:-1]) > 0)))
    out["n_repeat_words"] = np.diff(covered[words.bounds])
    keys = mix(words.hashes + rows)
    order = np.argsort(keys)
    first = np.ones(len(keys), np.int64)
    first[order[1:][keys[order][1:] == keys[order][:-1]]] = 0
    out["n_distinct"] = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(first)))[words.bounds])
    n = len(offsets) - 1
    lines, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.data
    for i in range(n):
        found = [line for line in bytes(raw[offsets[i] : offsets[i + 1]]).split(b"\n") if line.strip()]
        lines[i], copies[i] = len(found), len(found) - len(set(found))
    out |= {"n_lines": lines, "n_dup_lines": copies}
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row."""
    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                stats = text_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(stats[s]) for s in STATS)], ["doc_id", *STATS]
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    """``feature >= bound`` if ``above`` else ``feature <= bound``."""

    feature: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.above else x[self.feature] <= self.bound

    def column(self) -> Column:
        value = feature_column(self.feature)
        return value >= self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.bound:.6g}"


def feature_column(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _best(x, y, inside, names) -> tuple[float, Condition | None]:
    """The condition with the largest information gain among the rows inside the rule so far."""
    p0, n0 = (y & inside).sum(), (~y & inside).sum()
    base = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name in names:
        v = x[name][inside]
        t = y[inside]
        order = np.argsort(v, kind="stable")
        v, t = v[order], t[order]
        ends = np.flatnonzero(np.append(v[1:] != v[:-1], False))
        if not len(ends):
            continue
        p = np.cumsum(t)[ends]
        n = ends + 1 - p
        for above, pos, neg in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - base), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return best, found


def learn(x: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, precision: float = 0.95, most_conditions: int = 4, least: int = 5) -> list[list[Condition]]:
    """Ordered rules for ``y``; ``fold`` marks the rows that prune."""
    rules, left = [], np.ones(len(y), bool)
    while (y & left & ~fold).sum() >= least:
        inside, rule = left & ~fold, []
        while len(rule) < most_conditions and (~y & inside).any():
            _, c = _best(x, y, inside, x)
            if c is None:
                break
            rule.append(c)
            inside = inside & c.holds(x)

        def measured(k, rule=rule, left=left):
            rows = left & fold
            for c in rule[:k]:
                rows = rows & c.holds(x)
            p, n = int((y & rows).sum()), int((~y & rows).sum())
            return (p - n) / max(1, p + n), p, n

        scores = [measured(k) for k in range(1, len(rule) + 1)]
        if not scores:
            break
        k = max(range(len(scores)), key=lambda i: scores[i][0])
        _, p, n = scores[k]
        rule = rule[: k + 1]
        hit = left.copy()
        for c in rule:
            hit &= c.holds(x)
        if p == 0 or p / (p + n) < precision or (y & hit).sum() < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_from(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules against ``quality = 0`` among the rows that pass the base rules."""
    features = [feature_column(f).alias(f) for f in FEATURES]
    known = labels.where("quality is not null").select(F.col("doc_id").alias("l_id"), (F.col("quality") == 0).alias("bad"))
    examples = (
        stats.where(~base_failed())
        .join(known, stats["doc_id"] == known["l_id"])
        .select(F.xxhash64(F.lit(7), "doc_id").alias("order"), "doc_id", "bad", *features)
    )
    rows = hash_sample(examples, "order", SAMPLE, "doc_id", "bad").collect()
    if not rows:
        return []
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    fold = np.array([r["order"] % 3 == 0 for r in rows])
    return learn(x, np.array([r["bad"] for r in rows]), fold)


def verdict(rules: list[list[Condition]]) -> Column:
    """The index of the first rule that holds, null if none does."""
    out = None
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def assess(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Condition]]]:
    """Every row's statistics, ``base_failed``, ``rule`` and ``kept``; and the rules."""
    small_batches(docs.sparkSession)
    stats = materialize(with_stats(docs))
    rules = learn_from(stats, labels)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
