"""Benchmark decontamination by template canonicalisation.

Both sides become template tokens: punctuation goes, ASCII letters are lower-cased, numbers,
names and units (right after a number) become typed placeholders with their values as slots.
Names are tried as placeholders and as words, and so are capitals at a sentence's start.
Windows of five template tokens of the benchmark set bits in a bitmap of bounded size, a file that
workers map; one Arrow pass over the documents emits the few windows whose bit is set, a hash join with the
benchmark's windows makes that exact, and slot consistency keeps the windows in which each slot
value of the item maps to its most frequent value in the document. A document is
contaminated by an item when such windows cover ``COVER`` of the item's windows, so a question
with other numbers or names is caught, and unrelated text that shares a template is not.

Windows that are mostly numbers have their own words as hash instead and match literally. They
count in a second coverage over all windows; the greater of the two decides, so a question with
other numbers needs only the windows that can show it. An item under five template tokens is one
whole window of its own words.

A run of ``RUN`` template tokens of an item is a hit by itself, whatever its share: it is one
window too, of nine windows of five in order, with slots that are consistent within the run. A
run can only start or end where a window of five is the benchmark's, so few are hashed.

Defined cases: null texts and texts without a word have no windows; repeated document rows are
judged alone; repeated items are one item per row; texts of any length are read in whole, a few
megabytes of texts at once or one text; of equally frequent slot values the smallest hash counts;
empty tables give no hits. Columns besides the ids and texts are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import map_array, materialize, put_array, row_key as bits_of, shared_folder, small_batches, without
from siftwell.llm.tokens import STEP, Words, hash_words, mix, slices, text_bytes, windows

WIDTH = 5
COVER = 0.5
#: So many tokens of an item in a row are a hit.
RUN = 13
#: A run with more placeholders, or with too many in its first and in its last window, matches literally.
RUN_SLOTS = 6
#: A window with more placeholders than this says too little.
MOST_SLOTS = 2
#: With the words at sentences' starts.
MOST_OPENING = 3
MOST_BITS = 1 << 29
#: Text bytes that a worker reads at once.
TEXT_BYTES = 2 << 20
#: Bytes of the bitmap that one task sets.
BLOCK_BYTES = 1 << 13
#: The kinds of windows with a name at a sentence's start and of literal ones; 0 and 1 are words and names.
OPENING, EXACT = 2, 3
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))

# Units that become placeholders after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams lb lbs oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees"
).split()

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_KEEP = _DIGIT | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128) | np.isin(_BYTE, [32, 9, 10, 11, 12, 13])
_STOP = np.isin(_BYTE, np.frombuffer(b".!?\n", np.uint8))


def _known_units() -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(UNITS)]))
    return np.unique(hash_words(data, offsets).hashes)


def templates(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens with names as words, which are numbers or units, names, sentence-initial capitals, own hashes."""
    raw, offsets = text_bytes(column)
    base = int(offsets[0])
    raw, offsets = raw[base : int(offsets[-1])], offsets - base
    keep = _KEEP[raw]
    origin = np.flatnonzero(keep).astype(np.int32)
    data = raw[origin]
    plain = data
    # Fold the two-byte capitals of Latin-1 as well.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)] + 1
    if len(lead):
        data = data.copy()
        data[lead] += 0x20
    bounds = np.searchsorted(origin, offsets)
    words = hash_words(data, bounds)
    own = words.hashes
    token = own.copy()
    head = data[words.starts] if len(own) else data[:0]
    number = _DIGIT[head]
    # A name starts with a capital (ASCII or Latin-1) and is not all capitals; at a sentence's start it may be any word.
    wide = head == 0xC3
    second = np.minimum(words.starts + 1, max(0, len(data) - 1))
    follow = np.minimum(words.starts + 1 + wide, max(0, len(data) - 1))
    if len(own):
        initial = _UPPER[head] | (wide & (plain[second] >= 0x80) & (plain[second] <= 0x9E))
        shout = _UPPER[plain[follow]] | ((plain[follow] == 0xC3) & (plain[np.minimum(follow + 1, len(data) - 1)] <= 0x9E))
        capital = np.flatnonzero(initial & ~shout)
    else:
        capital = np.empty(0, np.int64)
    name, opening = np.zeros(len(own), bool), np.zeros(len(own), bool)
    if len(capital):
        stops = np.concatenate((np.zeros(1, np.int32), np.cumsum(_STOP[raw], dtype=np.int32)))
        first = np.zeros(len(own) + 1, bool)
        first[words.bounds] = True
        before = np.maximum(capital - 1, 0)
        quiet = stops[origin[words.starts[capital]]] == stops[origin[words.ends[before] - 1] + 1]
        name[capital] = quiet & ~first[capital]
        opening[capital] = ~name[capital]
    unit = np.zeros(len(own), bool)
    after = np.flatnonzero(number[:-1]) + 1 if len(own) > 1 else np.empty(0, np.int64)
    unit[after] = np.isin(own[after], _UNIT_HASHES) & ~np.isin(after, words.bounds)
    token[number], token[unit] = NUMBER, UNIT
    return Words(token, words.starts, words.ends, words.bounds), number | unit, name, opening, own


_UNIT_HASHES = _known_units()


def _windows(column: pa.Array, short: list[int] | None = None) -> tuple[Words, np.ndarray, np.ndarray, tuple]:
    """The words, window hashes, first tokens and what tells their slots.

    ``short`` are the lengths below ``WIDTH`` at which runs of words are windows as well; None
    takes each row below ``WIDTH`` as one.

    A window with a name occurs twice, with the name as a placeholder and as a word: capitals
    tell names only in ordinary prose, not in headlines or shouted copies. A window with a capital
    at a sentence's start occurs once more, with that word as a name too. A window with more
    numbers than ``MOST_SLOTS`` occurs once, as it is (kind ``EXACT``), and so does a short one.
    """
    words, values, name, opening, own = templates(column)
    hashes, firsts, kinds = [], [], []
    masks = (values, values | name, values | name | opening)
    for kind, (slot, needed) in enumerate(zip(masks, (None, name, opening), strict=True)):
        if needed is not None and not needed.any():
            continue
        tokens = Words(np.where(slot & ~values, NAME, words.hashes), words.starts, words.ends, words.bounds)
        h, at = windows(tokens, WIDTH)
        good = (_counts(slot & ~opening, at) <= MOST_SLOTS) & (_counts(slot, at) <= (MOST_SLOTS if needed is not opening else MOST_OPENING))
        if needed is not None:
            good &= _counts(needed, at) > 0
        hashes.append(h[good])
        firsts.append(at[good])
        kinds.append(np.full(int(good.sum()), kind))
    literal = Words(own, words.starts, words.ends, words.bounds)
    h, at = windows(literal, WIDTH)
    exact = [(h[rich], at[rich])] if (rich := _counts(values, at) > MOST_SLOTS).any() else []
    for n in range(1, WIDTH) if short is None else short:
        h, at = windows(literal, n)
        whole = slice(None)
        if short is None:
            whole = words.counts[np.searchsorted(words.bounds, at, side="right") - 1] == n
        exact.append((h[whole], at[whole]))
    for h, at in exact:
        hashes.append(h)
        firsts.append(at)
        kinds.append(np.full(len(h), EXACT))
    return words, np.concatenate(hashes), np.concatenate(firsts), (masks, own, np.concatenate(kinds))


def _runs(words: Words, parts, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first tokens and kinds of the runs whose first or last window begins at one of ``near``."""
    (values, names, opening), own, _ = parts
    at = np.unique(np.concatenate((near, near - (RUN - WIDTH))))
    at = at[at >= 0]
    at = at[at + RUN <= words.bounds[np.searchsorted(words.bounds, at, side="right").clip(max=len(words.bounds) - 1)]]
    sums = [np.concatenate((np.zeros(1, np.int32), np.cumsum(m, dtype=np.int32))) for m in (values, names, opening)]
    n = [x[at + RUN] - x[at] for x in sums]
    ends = (np.minimum(x[at + WIDTH] - x[at], x[at + RUN] - x[at + RUN - WIDTH]) for x in sums)
    fit = [(x <= RUN_SLOTS) & (e <= MOST_SLOTS) for x, e in zip(n, ends, strict=True)]
    found = []
    for kind, good in enumerate((fit[0], fit[1] & (n[1] > n[0]), fit[2] & (n[2] > n[1]), ~fit[0])):
        first = at[good]
        tokens = own if kind == EXACT else np.where(parts[0][kind] & ~values, NAME, words.hashes)
        h = np.zeros(len(first), np.uint64)
        for k in range(RUN):
            h = h * STEP + tokens[first + k]
        found.append((mix(h), first, np.full(len(first), kind)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags each window has."""
    sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)))
    return sums[at + WIDTH] - sums[at]


def _slots(at: np.ndarray, kinds: np.ndarray, parts, width: int = WIDTH) -> list[list[int]]:
    """The slot values of windows."""
    masks, own, _ = parts
    signed = own.view(np.int64)
    return [[] if k == EXACT else [int(signed[i]) for i in range(a, a + width) if masks[k][i]] for a, k in zip(at, kinds, strict=True)]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, pos, n_windows, n_open, n_words, exact, run, opening, h, slots`` for each window and run of each item.

    ``n_open`` of the ``n_windows`` are not exact; runs are not among them.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, h, at, parts = _windows(part.column("text"))
                exact = parts[2] == EXACT
                per_row, open_row = (np.bincount(np.searchsorted(words.bounds, np.unique(x), side="right") - 1, minlength=part.num_rows) for x in (at, at[~exact]))
                run_h, run_at, run_kinds = _runs(words, parts, at)
                slots = _slots(at, parts[2], parts) + _slots(run_at, run_kinds, parts, RUN)
                run = np.repeat([False, True], [len(at), len(run_at)])
                h, at, exact = np.concatenate((h, run_h)), np.concatenate((at, run_at)), np.concatenate((exact, run_kinds == EXACT))
                row = np.searchsorted(words.bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item").take(pa.array(row)),
                        part.column("item_id").cast(pa.int64()).take(pa.array(row)),
                        pa.array((at - words.bounds[row]).astype(np.int32)),
                        pa.array(per_row[row].astype(np.int32)),
                        pa.array(open_row[row].astype(np.int32)),
                        pa.array(words.counts[row].astype(np.int32)),
                        pa.array(exact),
                        pa.array(run),
                        pa.array(np.concatenate((parts[2], run_kinds)) == OPENING),
                        pa.array(h.view(np.int64)),
                        pa.array(slots, pa.list_(pa.int64())),
                    ],
                    ["item", "item_id", "pos", "n_windows", "n_open", "n_words", "exact", "run", "opening", "h", "slots"],
                )

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return rows.mapInArrow(run, "item long, item_id long, pos int, n_windows int, n_open int, n_words int, exact boolean, run boolean, opening boolean, h long, slots array<long>")


def _bitmap(wanted: DataFrame) -> tuple[str, int]:
    """A bitmap over the top bits of the window hashes, as a file, and how many top bits.

    It has 512 bits a window, ``MOST_BITS`` at most. Tasks set the bits of a block each; what the
    driver joins is at most ``MOST_BITS // 8`` bytes.
    """
    n = wanted.count()
    top = min(MOST_BITS.bit_length() - 1, max(16, (512 * max(1, n)).bit_length()))
    block_bits = BLOCK_BYTES * 8

    def run(key, table):
        out = np.zeros(block_bits, np.uint8)
        out[table["at"].to_numpy()] = 1
        return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    place = wanted.select(F.shiftrightunsigned("h", 64 - top).alias("place")).selectExpr(f"place div {block_bits} as block", f"cast(place % {block_bits} as int) as at")
    out = np.zeros(max(BLOCK_BYTES, (1 << top) // 8), np.uint8)
    for r in place.distinct().groupBy("block").applyInArrow(run, "block long, bits binary").collect():
        out[r["block"] * BLOCK_BYTES : (r["block"] + 1) * BLOCK_BYTES] = np.frombuffer(r["bits"], np.uint8)
    uri = f"{shared_folder(wanted.sparkSession, 'benchmark')}/bitmap"
    put_array(uri, out)
    return uri, top


def hits(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """Contaminated rows: ``key, doc_id, item_id, matched, n_windows, coverage, changed_slots``; a run is a hit below ``cover``.

    ``docs`` needs ``key``, which identifies a row, besides ``doc_id`` and ``text``.
    """
    small_batches(docs.sparkSession)
    wanted = materialize(benchmark_windows(benchmark))
    uri, top = _bitmap(wanted.where(~F.col("run")))
    short = sorted(r["n_words"] for r in wanted.where(F.col("n_words") < WIDTH).select("n_words").distinct().collect())
    key_type = docs.schema["key"].dataType.simpleString()
    shift = np.uint64(64 - top)

    def run(batches):
        bitmap = map_array(uri, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words, h, at, parts = _windows(part.column("text"), short)
                place = h >> shift
                some = (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                kept = np.flatnonzero(some)
                h, at = h[kept], at[kept]
                run_h, run_at, run_kinds = _runs(words, parts, at)
                slots = _slots(at, parts[2][kept], parts) + _slots(run_at, run_kinds, parts, RUN)
                row = pa.array(np.searchsorted(words.bounds, np.concatenate((at, run_at)), side="right") - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(row),
                        part.column("doc_id").cast(pa.int64()).take(row),
                        pa.array(np.concatenate((h, run_h)).view(np.int64)),
                        pa.array(np.concatenate((parts[2][kept], run_kinds)) == OPENING),
                        pa.array(slots, pa.list_(pa.int64())),
                    ],
                    ["key", "doc_id", "h", "d_opening", "slots"],
                )

    found = docs.select("key", "doc_id", "text").mapInArrow(run, f"key {key_type}, doc_id long, h long, d_opening boolean, d_slots array<long>")
    same = found.distinct().join(wanted, "h")
    # Few rows by now; what follows reads them three times, and the texts once.
    same = materialize(same.withColumn("pairs", F.arrays_zip(F.col("slots").alias("i"), F.col("d_slots").alias("d"))))
    # The most frequent document value of each item value; ties go to the smallest. Windows with a
    # name at a sentence's start only tell the values that no other window tells.
    sure = F.count(F.when(~(F.col("opening") | F.col("d_opening")), 1))
    pairs = same.where(~F.col("run")).select("key", "item", "opening", "d_opening", F.explode("pairs").alias("p"))
    value = pairs.groupBy("key", "item", F.col("p.i").alias("i"), F.col("p.d").alias("d")).agg(sure.alias("sure"), F.count("*").alias("count"))
    rank = F.struct("sure", F.when(F.col("sure") == 0, F.col("count")).otherwise(0).alias("count"), (-F.col("d")).alias("neg"), "d")
    best = value.groupBy("key", "item", "i").agg(F.max(rank).alias("b"))
    maps = best.groupBy("key", "item").agg(F.map_from_entries(F.collect_list(F.struct("i", "b.d"))).alias("map"))
    # Slots of a run are consistent if none of its values has two values in the document.
    one_each = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("slots"))
    mapped = F.forall("pairs", lambda p: F.col("map")[p["i"]] == p["d"]) | (F.size("pairs") == 0)
    checked = same.join(maps, ["key", "item"], "left").where(F.when(F.col("run"), one_each).otherwise(mapped))
    per_item = checked.groupBy("key", "doc_id", "item", "item_id").agg(
        F.countDistinct(F.when(~F.col("run"), F.col("pos"))).alias("of_all"),
        F.countDistinct(F.when(~F.col("run") & ~F.col("exact"), F.col("pos"))).alias("of_open"),
        F.first("n_windows").alias("n_all"),
        F.first("n_open").alias("n_open"),
        F.max("run").alias("run"),
        F.max(F.size(F.filter("pairs", lambda p: p["i"] != p["d"]))).alias("changed_slots"),
    )
    # The greater coverage; of equal ones that over all windows.
    share = F.greatest(*(F.struct(F.try_divide(f"of_{x}", f"n_{x}").alias("coverage"), F.col(f"n_{x}").alias("n_windows"), F.col(f"of_{x}").alias("matched")) for x in ("all", "open")))
    found = per_item.select("key", "doc_id", "item_id", "changed_slots", "run", share.alias("s")).where((F.col("s.coverage") >= cover) | F.col("run"))
    return found.select("key", "doc_id", "item_id", "s.matched", "s.n_windows", "changed_slots", "s.coverage")


def row_key():
    """128 bits of a document row."""
    return bits_of("doc_id", "text")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = hits(docs.select(row_key().alias("key"), "doc_id", "text"), benchmark)
    # Whole rows travel as one struct, so no column of theirs can clash.
    return without(docs.select(row_key().alias("key"), F.struct("*").alias("row")), bad, "key").select("row.*")
