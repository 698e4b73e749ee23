"""Language model, mixing, language ID, sharding, quality: brute force and odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import kdshard, langid, lm, mixing, quality, queries, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "s", 4), (3, " \n\t ", "en", "s", 4), (4, "one two three", None, "s", 13), (None, "null id words here", "en", None, 18),
    (5, "w " * 40_000, "en", "s", 80_000), (6, "x" * 300_000, "de", "t", 300_000), (7, "Ünï cödé wörds äre hére too", "de", "t", 27), (8, "one two three", "en", "u", 13),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"rank": F.lit(1), "words": F.lit("x"), "node": F.lit(2), "_text": F.lit("y"), "score": F.lit("z")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_words_and_windows_match_python(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 64)
    texts = [None, "", "a", " The\x0bthe  THE\n", "é" * 50 + " x", "a b c d e f g h " * 40, "no-space" * 30]
    column = pa.array(texts)
    data, offsets = tokens.text_bytes(column)
    found = tokens.hash_words(data, offsets)
    names = [w for t in texts for w in words_of(t)]
    assert list(found.counts) == [len(words_of(t)) for t in texts]
    assert len(set(found.hashes.tolist())) == len(set(names))
    assert len(set(zip(names, found.hashes.tolist(), strict=True))) == len(set(names))
    h, at = tokens.windows(found, 3)
    spans = [tuple(ws[i : i + 3]) for ws in map(words_of, texts) for i in range(len(ws) - 2)]
    assert len(at) == len(spans) and len(set(h.tolist())) == len(set(spans))
    sliced = column.slice(3, 3)
    data, offsets = tokens.text_bytes(sliced)
    assert list(tokens.hash_words(data, offsets).counts) == [len(words_of(t)) for t in texts[3:6]]


def kneser_ney(train, order=2):
    """Counts, and the probability of a word after a context, from dictionaries."""
    uni = Counter(w for x in train for w in x)
    total, distinct = sum(uni.values()), len(uni)
    counts = {order: Counter(tuple(p[i : i + order]) for x in train for p in [["<s>"] * (order - 1) + x] for i in range(len(x)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: lm.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    stats = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in range(2, order + 1)}
    for n in stats:
        for g, c in counts[n].items():
            stats[n][g[:-1]][0] += c
            stats[n][g[:-1]][min(c, 3)] += 1
    pairs = len(counts[2])
    unseen = sum(d[1][min(c, 3)] for c in counts[1].values()) / max(1, pairs) / (distinct + 1) if pairs else 1 / (distinct + 1)

    def word(w):
        c = counts[1][w,]
        return (c - d[1][min(c, 3)]) / max(1, pairs) + unseen

    def after(context, w):
        if not context:
            return word(w)
        lower = after(context[1:], w)
        n = len(context) + 1
        if context not in stats[n]:
            return lower
        z, c, e = stats[n][context], counts[n].get((*context, w), 0), d[n]
        return (c - e[min(c, 3)]) / z[0] + (z[1] * e[1] + z[2] * e[2] + z[3] * e[3]) / z[0] * lower

    def text(x):
        padded = ["<s>"] * (order - 1) + x
        return sum(math.log10(after(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(x))

    return uni, total, distinct, after, text


def test_lm_matches_brute_force_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    train = [[*words_of(r.text), "</s>"] for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    uni, total, distinct, _, text = kneser_ney(train)
    for r in rows:
        x = [*words_of(r.text), "</s>"]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(x), sum(uni[w] > 0 for w in x), total)
        assert math.isclose(g.score, text(x), rel_tol=1e-9)
        assert math.isclose(g.base_score, sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in x), rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


@pytest.mark.parametrize(("order", "often", "fan", "bucket_bytes"), [(2, 3, 2, 400), (3, 20, 3, 1000), (3, 1 << 18, 11, 8 << 20), (4, 2, 2, 500)])
def test_lm_of_any_order_and_dealing(spark, order, often, fan, bucket_bytes):
    """Contexts dealt over several buckets and rows dealt several times change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    docs = docs.unionByName(spark.createDataFrame([(1000, "a b " * 400), (1001, "A b a c"), (1002, None), (1003, "b")], "doc_id long, text string")).repartition(3)
    rows = docs.collect()
    model = lm.train_model(docs, bucket_bytes, order, often, fan)
    assert model.layout.bits > fan or fan == 11
    _, total, distinct, _, text = kneser_ney([[*words_of(r.text), "</s>"] for r in rows], order)
    assert (model.tokens, model.distinct) == (total, distinct)
    new = spark.createDataFrame([(2000, "a new b a b word"), (2001, "")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in [*rows, *new.collect()]}
    for g in lm.score(docs.unionByName(new), model, ["doc_id"]).collect():
        assert math.isclose(g.score, text([*words_of(texts[g.doc_id]), "</s>"]), rel_tol=1e-9), g.doc_id


def test_lm_word_probabilities_sum_to_one():
    train = [["a", "b", "a", "</s>"], ["b", "c", "</s>"], ["a", "b", "</s>"]]
    for order, contexts in ((2, ["a", "b", "<s>", "new"]), (3, [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("new", "b")])):
        uni, _, _, after, _ = kneser_ney(train, order)
        for context in contexts:
            c = context if isinstance(context, tuple) else (context,)
            assert math.isclose(sum(after(c, w) for w in uni) + after(c, "unknown"), 1.0, rel_tol=1e-9)


def test_lm_odd_tables(odd, empty):
    model = lm.train_model(odd)
    got = lm.score(odd, model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(empty, model, ["doc_id"]).count() == 0
    nothing = lm.train_model(empty)
    assert all(r.n_known == 0 and r.score == 0 for r in lm.score(odd, nothing, ["doc_id"]).collect())


def test_targets():
    sizes = {"a": 100, "b": 10, None: 5, "c": 1000}
    got = mixing.targets(sizes)
    assert math.isclose(sum(got.values()), 1115) and all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert got["a"] == 300 and got["b"] == 30 and got[None] == 15
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 7}) == {"a": 0.0, "b": 7.0}


def test_splitting_tree_keeps_quotas():
    shares = mixing.splitting_tree([1000, 10, 0, 333], 7, 5)
    assert [sum(v[i] for v in shares) for i in range(4)] == [1000, 10, 0, 333]
    assert max(map(sum, shares)) - min(map(sum, shares)) <= 7
    assert shares == mixing.splitting_tree([1000, 10, 0, 333], 7, 5)
    assert 0 <= mixing._drawn(np.random.default_rng(1), 10**9, 10**9, 10**6) <= 10**6


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(taken[s] == round(target[s]) for s in target)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())


def test_blocks_are_disjoint(spark):
    rows = mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))
    drawn, _ = mixing.draw(rows, 4, 32)
    assert drawn.groupBy("rid", "block", "epoch").count().where("count > 1").count() == 0


def test_mixed_documents_come_from_the_tree(spark):
    """Passes, the last one's end, and each shard's share, against a plain walk over the permutation."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("clash"))
    got = mixing.drawn_documents(docs, 5).select("row.doc_id", "row.source", "shard", "order").collect()
    rows = mixing.sized(docs.drop("shard")).select("doc_id", "source", "size").collect()
    hashed = docs.select("doc_id", F.xxhash64(F.lit(17), F.xxhash64("doc_id", "text", F.col("source").isNull(), "source"), F.lit(0).cast("long")).alias("k"))
    place = {r.doc_id: r.k for r in hashed.collect()}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    goal = mixing.targets(dict(sizes))
    order = sorted(sizes)
    drawn = {}
    for s in order:
        passes, rest = divmod(round(goal[s]), sizes[s])
        passes, rest = (3, 0) if passes >= 3 else (passes, rest)
        line = sorted((r for r in rows if r.source == s and r.size), key=lambda r: place[r.doc_id])
        before = np.cumsum([0] + [r.size for r in line])[:-1]
        drawn[s] = [r.doc_id for r in line] * passes + [r.doc_id for r, b in zip(line, before, strict=True) if b + r.size / 2 <= rest]
    shares = mixing.splitting_tree([len(drawn[s]) for s in order], 5, 17)
    expected = Counter()
    for i, s in enumerate(order):
        ends = np.cumsum([v[i] for v in shares])
        expected.update((d, int(np.searchsorted(ends, at, side="right"))) for at, d in enumerate(drawn[s]))
    assert Counter((r.doc_id, r.shard) for r in got) == expected
    assert len({r.order for r in got}) == len(got)
    out = mixing.mixed_documents(docs, 5)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got)
    again = mixing.mixed_documents(docs.repartition(7), 5)
    assert Counter(map(str, again.collect())) == Counter(map(str, out.collect()))


def test_mixed_documents_with_many_sources_and_equal_rows(spark):
    rows = [(i % 400, f"text {i % 400} " * (1 + i % 7), "en", None if i % 11 == 0 else f"s{i % 200}", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed_documents(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    for r in got:
        taken[r.source] += len(words_of(r.text))
    goal = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 3 * 14 for s in sizes)
    assert sum(r.taken for r in mixing.mix(docs).collect()) == sum(round(g) for g in goal.values())


def test_mix_odd_tables(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len(words_of(r[1])) for r in ODD)
    assert mixing.mix(empty).count() == 0
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)
    assert mixing.mixed_documents(empty).count() == 0


def test_language_id(spark):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_ignores_other_columns(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    plain = langid.predict(docs, model, ["doc_id"]).collect()
    other = langid.predict(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), model, ["doc_id"]).collect()
    assert sorted(map(str, plain)) == sorted(map(str, other))
    got = langid.predict(odd, model, ["doc_id", "_text", "rank"]).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_a_text_in_no_learned_language_is_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Привет как дела друзья мои", "这是一个中文句子没有英文", "مرحبا بالعالم كيف حالك", "12 34 !!", "", None]
    known = ["The and of that.", "Der die das und.", "A.", "x"]
    new = spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(foreign + known)], docs.schema)
    both = docs.unionByName(new).withColumns({"predicted": F.lit("clash"), "predicted_shared_": F.lit(1)})
    kept = langid.accepted(both, langid.train(docs))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == both.columns and ids == {r.doc_id for r in docs.collect()} | {-7, -8, -9, -10}
    # Another model, another result; without any, letters decide.
    russian = langid.train(spark.createDataFrame([(i, foreign[0] + " и это другой текст"[: 5 + i], "ru") for i in range(12)], docs.schema))
    assert {r.doc_id for r in langid.accepted(both, russian).collect()} & {-1, -2, -3, -7, -8} == {-1}
    assert {r.doc_id for r in langid.accepted(both, None).collect()} == ids | {-1, -2, -3}


def test_language_id_of_many_languages(spark):
    """More languages than landmarks, and than a plan could name one by one."""
    rows = [(i, f"{chr(0x400 + i % 700)}{chr(0x4E00 + i % 700)}{chr(0x61 + i % 26)} " * 5, f"l{i % 700:03d}") for i in range(1400)]
    model = langid.train(spark.createDataFrame(rows + [(5000 + i, "rare", f"z{i}") for i in range(2300)], "doc_id long, text string, lang string"))
    assert len(model.languages) <= langid.MOST_LANGUAGES and len(model.landmarks) == langid.LANDMARKS
    assert set(model.languages) > {f"l{i:03d}" for i in range(700)}


def test_language_id_ties(spark):
    """Equal texts under two languages: the first by code point; rows in any order."""
    rows = [(i, "one and the same text", lang) for i, lang in enumerate(["b", "a"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for d in (docs, docs.repartition(5)) for r in langid.predict(d, langid.train(d), ["doc_id"]).collect()]
    assert {r.lang_pred for r in got} == {"a"} and len({round(r.score, 6) for r in got}) == 1


def test_presence_is_the_gram_set():
    row = langid.presence(pa.array(["Ab1 é", "ab! é", ""]))
    assert (row[0] == row[1]).all() and row[2].sum() == 0 and row[0].sum() > 8


def test_shards(spark):
    got = kdshard.kd_shards(spark.read.parquet(f"{SF}/documents.parquet"), 5).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 200 and set(size) == set(range(5))
    assert max(size.values()) / min(size.values()) < 1.3
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_equal_texts_stay_together_unless_heavy(spark):
    rows = [(i, f"text number {i // 2} " * 20, "en", f"s{i % 3}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    crcs = defaultdict(set)
    for r in kdshard.kd_shards(docs, 4).collect():
        crcs[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in crcs.values())
    hot = spark.createDataFrame([(i, "same " * 50, "en", "s", 0) for i in range(300)] + rows[:100], DOCS)
    size = Counter()
    for r in kdshard.kd_shards(hot, 4).collect():
        size[r.shard] += r.size
    assert max(size.values()) < 1.4 * min(size.values())


def test_shards_odd_tables(odd, empty):
    got = kdshard.kd_shards(odd, 3).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id == 1} == {16}
    assert next(r for r in got if r.doc_id == 2).text_crc32 == 0 and next(r for r in got if r.doc_id == 1).text_crc32 is None
    assert kdshard.kd_shards(empty, 3).count() == 0
    assert {r.shard for r in kdshard.kd_shards(odd, 1).collect()} == {0}


def brute_stats(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = defaultdict(list)
    for i in range(len(found) - 7):
        where[tuple(found[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = Counter(tuple(r) for r in quality.with_stats(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r.doc_id, *brute_stats(r.text)) for r in docs.collect())


def test_rules_are_learned_and_applied(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    judged, rules = quality.assess(spark.read.parquet(f"{big}/documents.parquet"), labels)
    rows = judged.join(labels, "doc_id").where("not base_failed").collect()
    assert rules and all(str(c) for rule in rules for c in rule)
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in rows)


def test_rules_catch_bad_documents_that_they_were_not_taught(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    judged, _ = quality.assess(spark.read.parquet(f"{big}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    rows = judged.join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed").collect()
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) > 100
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 1000


def test_rule_verdict_matches_a_walk_over_the_list(spark):
    """The conditional expression of a list says what its rules say one after another."""
    rules = [[quality.Condition("words", False, 30.0), quality.Condition("upper_share", True, 0.02)], [quality.Condition("symbols_per_word", True, 0.05)], [quality.Condition("distinct_share", False, 0.5)]]
    stats = quality.with_stats(spark.read.parquet(f"{SF}/documents.parquet"))
    features = [quality.feature_column(f).alias(f) for f in quality.FEATURES]
    rows = stats.select(quality.verdict(rules).alias("rule"), *features).collect()
    for r in rows:
        x = {f: np.array([r[f]]) for f in quality.FEATURES}
        assert r.rule == next((i for i, rule in enumerate(rules) if all(c.holds(x)[0] for c in rule)), None)
    assert len({r.rule for r in rows}) > 1


def test_rule_learner_finds_a_conjunction():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    y = (x["a"] > 0.7) & (x["b"] < 0.2)
    (rule, *_) = quality.learn(x, y, np.arange(3000) % 3 == 0)
    hit = np.logical_and.reduce([c.holds(x) for c in rule])
    assert (hit & y).sum() > 0.9 * y.sum() and (hit & ~y).sum() <= 0.05 * hit.sum()
    assert quality.learn(x, np.zeros(3000, bool), np.zeros(3000, bool)) == []


def test_quality_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality.assess(odd, none)
    assert rules == [] and judged.count() == len(ODD)
    assert not any(r.kept for r in judged.collect() if r.doc_id in (1, 2, 3, 4))
    assert quality.assess(empty, none)[0].count() == 0
