"""Jaccard join, secrets, chat, WARC, decontamination and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import chat, components, decontam, jaccard, queries, secrets, shared, tokens, warc
from siftwell.llm.shared import lookup, map_array, materialize, put_array, shared_folder

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        body = rng.choices(vocabulary, k=rng.choice([3, 6, 8, 11, 14, 40, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(body)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy + (passage if base % 3 == 0 else [])))
    return list(enumerate(rows))


def test_jaccard_matches_brute_force(spark):
    rows = near_copies(1)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


@pytest.mark.parametrize("boundary", [0, 9])
def test_every_boundary_gives_the_same_links(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes, mean: boundary)
    rng = random.Random(boundary)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(3)}" for _ in range(rng.randrange(1, 18))]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t + " tail") for i, t in rows]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_with_rows_dealt_several_times(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 1)
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(docs, fan=3, bucket_bytes=64).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (5, "c d e f g"), (6, "c d e f g"), (None, "q r"), (7, "z " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit("x"), "_key": F.lit(0)})
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 1): 3, (4, 1): 3, (5, 1): 5, (6, 1): 5, (None, 1): None, (7, 1): 7}
    kept = jaccard.representatives(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect() if r.doc_id != 7) == sorted(
        [("1", None), ("2", ""), ("3", "a b"), ("5", "b a"), ("5", "c d e f g"), ("None", "q r")], key=str
    )
    assert jaccard.jaccard_components(docs.where("false")).count() == 0


def test_representatives_keep_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.representatives(docs).collect()] == [(1, "a b c d e f")]


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({}, 1.0) in range(jaccard.MOST_LIGHT + 1)
    assert jaccard.choose_boundary({3: 100, 12: 1000}, 1.0) < 12
    assert jaccard.choose_boundary({12: 1000}, 1e9) == 12


def test_components_with_hubs(spark):
    """A hub with more edges than a key may have in one task, linked to a chain."""
    edges = [(0, i) for i in range(10, 3000)] + [(i, i + 10_000) for i in range(500, 1500)] + [(20_000 + i, 20_001 + i) for i in range(30)] + [(-5, 2999)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), plain=100).collect()}
    assert {got[x] for e in edges for x in e if abs(x) < 20_000} == {-5} and {got[20_000 + i] for i in range(31)} == {20_000}


@pytest.mark.parametrize("few", [0, 100_000])
def test_lookup_of_hot_and_missing_keys(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_ROWS", few)
    rows = materialize(spark.createDataFrame([(1, i) for i in range(2500)] + [(2, 0), (3, 0), (None, 7)], "k long, v long"))
    table = spark.createDataFrame([(1, "one"), (2, None), (9, "nine")], "k long, name string")
    got = {}
    for r in lookup(rows, "k", table).collect():
        got.setdefault((r.k, r.name), []).append(r.v)
    assert {k: len(v) for k, v in got.items()} == {(1, "one"): 2500, (2, None): 1, (3, None): 1, (None, None): 1}


def test_shared_files_by_either_way(spark, monkeypatch):
    """Arrays read back by ``pyarrow.fs`` as by a mount; a folder of one machine is not taken for a shared one."""
    uri = f"{shared_folder(spark, 'files')}/a"
    put_array(uri, np.arange(5))
    assert map_array(uri, np.int64).tolist() == [0, 1, 2, 3, 4] and len(map_array(uri + "x", np.int64)) == 0
    monkeypatch.setattr(shared, "local_path", lambda uri: None)
    put_array(uri + "2", np.arange(3))
    assert map_array(uri + "2", np.int64).tolist() == [0, 1, 2] and map_array(uri, np.int64).tolist() == [0, 1, 2, 3, 4]
    assert len(map_array(uri + "x", np.int64)) == 0

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session, "x")


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (5, 5), (-3, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100], got[90], got[-3]} == {-3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


KEY = "AKIA" + "SJDZWJNP6ZRYWK44"
DOC = [
    (1, "src/app", f"use {KEY} here"), (2, "t", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" x'), (3, "t", "mail abc.42@mail8.example.com or 4994226020900891"), (4, None, None), (5, "t", ""),
    (6, "t", "nothing to see"), (7, "t", f"{KEY} {KEY}"), (8, "t", "password=b7db7aa4a5fcc78305"), (9, "t", "word " * 20_000 + "https://www2.example.com/a-long-path-1"),
]


def brute_candidates(text):
    return [m[0] for m in re.finditer(r"(?<![A-Za-z0-9+/_.\-])(?=[^0-9\s]*[0-9])[A-Za-z0-9+/_.\-]{16,}={0,2}", text or "")]


def test_secret_candidates_match_python(spark):
    docs = spark.createDataFrame(DOC, "doc_id long, source string, text string").withColumn("label", F.lit("clash"))
    got = {}
    for r in secrets.candidates(docs).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.candidate)
    assert got == {i: c for i, _, t in DOC if (c := brute_candidates(t))}
    (first, *_) = secrets.candidates(docs).where("doc_id = 1").collect()
    assert (first.before, first.after) == ("use ", " here")


def test_secret_scan_learns(spark):
    found = secrets.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for r in found:
        real = r.before.rstrip().endswith(('token = "', "password=")) or r.candidate.startswith("AKIA")
        assert r.is_secret == real, (r.before, r.candidate, r.score)
    assert any(r.is_secret for r in found)


SHORT = {
    "password=hunter2secret": "hunter2secret", 'password = "Tr0ub4dor&3!x"': "Tr0ub4dor&3!x", "db at postgres://admin:hunter2@db now": "hunter2",
    "-----BEGIN RSA PRIVATE KEY-----\nabc": "-----BEGIN RSA PRIVATE KEY-----", "{'client_secret': 'correct horse battery'}": "correct horse battery",
    "Server=x;Pwd=ab;c=d": "ab", "SECRET_KEY: qwertzuiop.": "qwertzuiop", "Authorization: Bearer abcXYZ": "abcXYZ", 'x = "no-digits-Here"': "no-digits-Here",
}


def test_secrets_that_are_short_or_have_no_digit(spark):
    plain = ["the token is here", "a secret of theirs: none", "see https://example.com/a", "mail me@host", "say: 'it' and = 'that'"]
    rows = [(i, "src/app", t) for i, t in enumerate([*SHORT, *plain])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.candidate for r in secrets.candidates(docs).collect()}
    assert got == dict(enumerate(SHORT.values()))
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    found = secrets.scan(corpus.unionByName(docs.withColumn("doc_id", -1 - F.col("doc_id")))).where("doc_id < 0").collect()
    assert len(found) == len(SHORT)
    assert {-1 - r.doc_id for r in found if r.is_secret} >= {0, 1, 2, 3}, [(r.candidate, r.score) for r in found]


def brute_features(candidate, before, after, path):
    """The forest's columns by plain loops."""
    c, low, n = candidate, candidate.lower(), len(candidate)
    pairs = list(zip(c, c[1:]))
    vowel, consonant = set("aeiou"), set("bcdfghjklmnpqrstvwxyz")
    rest, words = low, sorted(secrets.WORDS, key=len, reverse=True)
    rest = re.sub("|".join(words), "", rest)
    near = re.search(rf"(?:{secrets.KEYWORDS})[\"']?\s{{0,3}}(?:[:=]|=>|is)?\s{{0,3}}[\"']?\Z", before.lower())
    assignment = re.search(r"[A-Za-z0-9_.-]*[\"'`]?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"'`]?\Z", before)
    return {
        "length": n, "digits": sum(x in "0123456789" for x in c) / n, "uppers": sum("A" <= x <= "Z" for x in c) / n, "lowers": sum("a" <= x <= "z" for x in c) / n,
        "marks": sum(not re.match("[A-Za-z0-9]", x) for x in c) / n, "distinct": len(set(c)) / n,
        "to_digit": sum(bool(re.match("[A-Za-z][0-9]", a + b)) for a, b in pairs) / n, "to_letter": sum(bool(re.match("[0-9][A-Za-z]", a + b)) for a, b in pairs) / n,
        "case_turns": sum(bool(re.match("[a-z][A-Z]|[A-Z][a-z]", a + b)) for a, b in pairs) / n,
        "vowel_turns": sum((a in vowel and b in consonant) or (a in consonant and b in vowel) for a, b in zip(low, low[1:])) / n,
        "longest_letters": max(map(len, re.findall("[A-Za-z]+", c)), default=0) / n, "dictionary": 1 - len(rest) / n, "dots": c.count("."),
        "dummy": bool(re.search(secrets.PLACEHOLDERS, low)), "issued": bool(re.fullmatch(f"(?:{secrets.ISSUERS}|{secrets.PEM})", c)),
        "path_test": bool(re.search("test|example|sample|fixture|mock|docs?/", path.lower())), "path_depth": path.count("/"),
        "keyword_near": bool(near), "keyword_far": bool(re.search(secrets.KEYWORDS, before.lower())), "assigned": bool(re.search(r"[:=]\s{0,3}[\"'`]?\Z", before)),
        "quoted": bool(re.search("[\"'`]\\Z", before) and re.match("[\"'`]", after)), "at_sign": before.endswith("@") or after.startswith("@"),
        "in_url": bool(re.search(r"://\S*\Z", before) or c.startswith("www.")), "dummy_key": bool(assignment and re.search(secrets.PLACEHOLDERS, assignment[0].lower())),
        "words_before": len(before.split()), "keyed": bool(re.search(rf"(?i)(?:{secrets.KEYWORDS}){secrets.ASSIGN}[\"'`]?\Z", before)),
        "user_info": bool(re.search(rf"{secrets.USER_INFO}\Z", before) and after.startswith("@")),
    }


def test_secret_features_match_python(spark):
    rows = [(i, "docs/test/a" if i % 2 else None, t) for i, t in enumerate([*SHORT, *(t for _, _, t in DOC if t and len(t) < 500), "example_key = 'your-key-of-the-day-1'", "test: sample-value-12345678 x"])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text"))
    found = secrets.features(secrets.candidates(docs)).collect()
    for r in found:
        expected = brute_features(r.candidate, r.before, r.after, r.path)
        assert set(expected) == set(secrets.FEATURES)
        for name, value in expected.items():
            assert abs(r[name] - float(value)) < 1e-9, (name, r.candidate, r.before)
    assert len(found) > 25


def test_no_forest_sees_what_its_labels_were_made_from(spark):
    found = secrets.features(secrets.candidates(spark.createDataFrame(DOC, "doc_id long, source string, text string")))
    around = secrets.labels_by_context(found)
    inside = secrets.labels_by_content(found)
    assert not set(secrets.CONTENT) & set(secrets.CONTEXT)
    changed = found.withColumns({c: F.lit(0.5) for c in secrets.CONTENT}).withColumn("candidate", F.lit("other"))
    assert sorted(r.label for r in secrets.labels_by_context(changed).collect()) == sorted(r.label for r in around.collect())
    changed = found.withColumns({c: F.lit(0.5) for c in secrets.CONTEXT}).withColumns({"before": F.lit(""), "after": F.lit(""), "path": F.lit("")})
    assert sorted(r.label for r in secrets.labels_by_content(changed).collect()) == sorted(r.label for r in inside.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_planted_secrets_are_found_and_numbers_are_not(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {(r.doc_id, r.candidate): r.is_secret for r in secrets.scan(docs).collect()}
    planted, plain = set(), set()
    for r in docs.select("doc_id", "text").collect():
        planted |= {(r.doc_id, m) for m in re.findall(r'(?i)(?:token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|\b(AKIA[0-9A-Z]{16})\b)', r.text or "") for m in m if m}
        plain |= {(r.doc_id, m) for m in re.findall(r"(?<![^\s])[0-9]{16}(?![^\s])|@(mail[0-9]+\.example\.com)", r.text or "") if m}
    assert planted and all(found.get(k) for k in planted)
    assert not any(found.get(k) for k in plain)


def test_secret_scan_of_labelled_findings(spark):
    """Reviewed labels decide, even against the rules."""
    rows = [(i, "src/a", f"order {10**15 + i} and key = {'ab' * 9}{i:02d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = secrets.features(secrets.candidates(docs))
    labelled = found.withColumn("label", F.when(F.col("candidate").rlike("^[0-9]+$"), 1.0).otherwise(0.0))
    got = secrets.scan(docs, labelled).collect()
    assert len(got) == 80 and all(r.is_secret == r.candidate.isdigit() for r in got)


def test_secret_scan_repeats_clashes_and_keeps_no_plain_secret(spark, tmp_path):
    docs = spark.createDataFrame([*DOC, *DOC], "doc_id long, source string, text string").withColumns({c: F.lit("clash") for c in ("label", "candidate", "score", "length", "path", "before", "x")})
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(f"file://{tmp_path}")
    got = secrets.scan(docs).collect()
    sc.setCheckpointDir(before) if before else None
    assert len(got) == 2 * sum(len(brute_candidates(t)) for _, _, t in DOC)
    assert {r.candidate for r in got} >= {KEY}
    files = [p.read_bytes() for p in tmp_path.rglob("part-*")]
    assert files and not any(KEY.encode() in f or b"1beb58b8af68854f" in f for f in files)


def test_secret_scan_odd_tables(spark):
    docs = spark.createDataFrame(DOC, "doc_id long, source string, text string")
    assert secrets.scan(docs).count() == sum(len(brute_candidates(t)) for _, _, t in DOC)
    assert secrets.scan(docs.where("false")).count() == 0
    only = secrets.scan(docs.where("doc_id = 1")).collect()
    assert [r.score for r in only] == [1.0]
    assert secrets.redact(F.lit(KEY)) is not None


def test_chat_collapse(spark):
    a, b = ("user", "hi"), ("assistant", "yo")
    talks = {1: [a], 2: [a, b], 3: [a, b], 4: [b, a], 5: [a, b, a], 6: [("user", None)], 7: [("user", "")], 8: [(None, "x")], None: [b]}
    rows = [(c, t, r, x, "extra") for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: r for r in chat.collapse_and_render(turns).collect()}
    assert set(got) == {4, 5, 6, 7, 8}
    assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert got[8].rendered.startswith("<|im_start|>unknown\n")
    assert chat.collapse_and_render(turns.where("false")).count() == 0


def test_chat_equal_conversations_and_repeated_turns(spark):
    rows = [(3, 0, "user", "x"), (2, 0, "user", "x"), (9, 0, "user", "x"), (9, 0, "user", "x")]
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {9: (2, 1)}


PAGES = [(1, "http://e/1", "same"), (2, "http://e/2\r\nX: y", "same"), (3, None, "ünï" * 5000), (None, "http://e/n", "same"), (5, "http://e/5", None), (6, "http://e/6", ""), (7, "u", "\r\n\r\nWARC/1.1")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    folder = shared_folder(spark, "warc-test")
    warc.write_pages(pages, folder, file_bytes="2000")
    full = {r.page_id: r for r in warc.read_archive(spark, folder, payload=True).collect()}
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for i, r in full.items():
        assert r.payload_bytes == len(html[i]) and r.payload_digest == base64.b32encode(hashlib.sha1(html[i]).digest()).decode()  # noqa: S324
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload in (None, html[i]))
    assert {i: r.refers_to for i, r in full.items() if r.record_type == "revisit"} == {1: 2, None: 2, 5: 6}
    assert full[2].target_uri == "http://e/2%0D%0AX:%20y"
    heads = warc.read_archive(spark, folder)
    assert sorted(map(str, (r.page_id for r in heads.collect()))) == sorted(map(str, full))


def test_warc_pushdown(spark):
    folder = shared_folder(spark, "warc-push")
    warc.write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    df = warc.read_archive(spark, folder, payload=True).where("record_type = 'response' and page_id in (2, 7)")
    assert {r.page_id: bytes(r.payload) for r in df.collect()} == {2: b"same", 7: b"\r\n\r\nWARC/1.1"}
    assert warc.read_archive(spark, folder).where("refers_to is null").count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_warc_min_bytes_ties_and_empty(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb"), (4, "u", "bbbb")]
    got = [(r.page_id, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 3).collect()]
    assert sorted(got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_record(page, body, length=True, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Type: application/http; msgtype=response\r\n".encode()
    return head + (b"Content-Length: %d\r\n" % len(http) if length else b"") + b"\r\n" + http + b"\r\n\r\n"


def test_warc_archives_of_others(spark, tmp_path):
    import gzip

    a, b, c, d = (plain_record(i, f"body {i}".encode() * 40_000) for i in range(4))
    open_end, damaged = plain_record(9, b"open end", length=False), bytearray(gzip.compress(plain_record(7, random.Random(1).randbytes(50_000))))
    damaged[2000:2010] = b"0123456789"
    files = {
        "plain.warc": (a + b + open_end, {0: b"body 0" * 40_000, 1: b"body 1" * 40_000, 9: b"open end"}),
        "members.warc.gz": (gzip.compress(a) + gzip.compress(b), {0: b"body 0" * 40_000, 1: b"body 1" * 40_000}),
        "several.warc.gz": (gzip.compress(a + b + c) + gzip.compress(d), {i: f"body {i}".encode() * 40_000 for i in range(4)}),
        "open.warc.gz": (gzip.compress(open_end) + gzip.compress(d), {9: b"open end", 3: b"body 3" * 40_000}),
        "cut.warc.gz": (gzip.compress(a) + gzip.compress(b)[:-30], {0: b"body 0" * 40_000}),
        "damaged.warc.gz": (gzip.compress(a) + bytes(damaged) + b"junk" + gzip.compress(c), {0: b"body 0" * 40_000, 2: b"body 2" * 40_000}),
        "empty.warc": (b"", {}),
        "junk.warc.gz": (b"no archive", {}),
    }
    for name, (raw, expected) in files.items():
        folder = tmp_path / name.replace(".", "-")
        folder.mkdir()
        (folder / name).write_bytes(raw)
        uri = f"file://{folder}"
        full = warc.read_archive(spark, uri, payload=True).collect()
        got = {r.page_id: bytes(r.payload) for r in full if r.payload is not None}
        assert got == expected, name
        assert sorted(r.page_id for r in warc.read_archive(spark, uri).collect()) == sorted(r.page_id for r in full), name
        assert warc.read_archive(spark, uri).where("page_id = 2").count() == (2 in expected)


def test_warc_of_a_shared_payload(spark):
    rows = [(i, f"http://e/{i}", "hot " * 500 if i % 3 else f"own {i}") for i in range(300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum(r.record_type == "revisit" for r in got) == 199 and {r.refers_to for r in got} == {None, 299}


ITEM = "A train leaves Boston at 9 and travels 120 km in 3 hours while Alice counts 17 red apples"


def contaminated(spark, texts, items=(ITEM,)):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.hits(docs.withColumn("key", decontam.row_key()), bench).collect()}


def test_decontamination_cases(spark):
    texts = [
        f"before it. {ITEM} and after", "So. A train leaves Chicago at 8 and travels 250 miles in 5 hours while Bob counts 99 red apples now", "a clean text about trains that leave at 9 and travel",
        None, "", ITEM.upper(), "word " * 50_000 + ITEM, "A train leaves", ITEM.replace(" ", "!! "), f"{ITEM} {ITEM}",
    ]
    got = contaminated(spark, texts)
    assert {d for d, _ in got} == {0, 1, 5, 6, 8, 9}
    assert got[0, 0].changed_slots == 0 and got[1, 0].changed_slots > 0


def test_slots_must_be_consistent(spark):
    item = "move 5 red boxes then move 5 blue boxes then carry 5 green boxes back home"
    same = item.replace("5", "8")
    mixed = "move 1 red boxes then move 2 blue boxes then carry 3 green boxes back home"
    got = contaminated(spark, [same, mixed], [item])
    assert got[0, 0].coverage == 1.0
    assert (1, 0) not in got or got[1, 0].coverage < 1.0


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more. Tom eats 2. How many apples are left?"
    other = item.replace("Tom", "Anna").replace("5", "8").replace("3", "4")
    mixed = item.replace("Tom has", "Anna has").replace("Tom buys", "Ben buys").replace("Tom eats", "Carl eats")
    got = contaminated(spark, [other, f"Now: {other}", mixed, "Anna has 8 pears. How many pears does Anna have now?"], [item])
    assert {(0, 0), (1, 0)} <= set(got) and (3, 0) not in got
    assert got[0, 0].coverage == 1.0 and got[0, 0].changed_slots > 0
    assert (2, 0) not in got or got[2, 0].coverage < got[0, 0].coverage


def test_items_of_numbers_and_short_items(spark):
    items = ["What is 12 + 34 + 56 + 78 + 90?", "Name the capital", "sum 3 and 4 and 5 and add 6 7 8 9 to it"]
    texts = [f"Quiz. {items[0]} Say it.", "What is 13 + 35 + 57 + 79 + 91?", "now name the Capital of it", "name the new capital", items[1], "name the", items[2].replace("3", "33")]
    got = contaminated(spark, texts, items)
    assert set(got) == {(0, 0), (2, 1), (4, 1), (6, 2)}
    assert (got[0, 0].matched, got[0, 0].n_windows, got[0, 0].changed_slots) == (3, 3, 0)


def test_a_long_run_is_a_hit(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(250)]
    noise = ["".join(rng.choices("qrstuvwxyz", k=6)) for _ in range(200)]
    numbers = [str(rng.randrange(100, 999)) for _ in range(100)]
    items = [" ".join(words), " ".join(f"{w} {n}" for w, n in zip(words[:100], numbers, strict=True))]

    def quote(text, start, n):
        return " ".join(noise[:50] + text.split()[start : start + n] + noise[50:])

    # Scattered pieces of twelve words, numbers changed in a run of less than half numbers, and of more.
    pieces = " ".join(" ".join(words[i : i + 12] + noise[i : i + 1]) for i in range(0, 100, 20))
    changed = items[1].replace(numbers[30], "7")
    got = contaminated(spark, [quote(items[0], 70, 100), quote(items[0], 10, 13), quote(items[0], 10, 12), pieces, quote(items[1], 50, 40), quote(changed, 58, 9)], items)
    assert set(got) == {(0, 0), (1, 0), (4, 1)}
    assert (got[0, 0].matched, got[0, 0].n_windows) == (96, 246)


class Template:
    """A text's windows and runs by plain loops: {(pos, width): [(tokens, opening, slots, exact)]}."""

    def __init__(self, text, short):
        words = [(re.sub(r"[!-/:-@\[-`{-~]", "", m[0]), m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text or "")]
        words = [w for w in words if w[0]]
        own = [w.lower() for w, _, _ in words]
        number = [w[0] in "0123456789" for w in own]
        unit = [i > 0 and number[i - 1] and w in decontam.UNITS for i, w in enumerate(own)]
        values = [n or u for n, u in zip(number, unit, strict=True)]
        token = ["#N" if n and not u else "#U" if u else w for n, u, w in zip(number, unit, own, strict=True)]
        capital = [w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not w[1:2].isupper() for w, _, _ in words]
        raw = text or ""
        last = [max((k for k in range(words[i - 1][1], words[i - 1][2]) if re.match(r"[^!-/:-@\[-`{-~]", raw[k])), default=0) + 1 for i in range(1, len(words))]
        first = [i == 0 or any(c in ".!?\n" for c in raw[last[i - 1] : words[i][1]]) for i in range(len(words))]
        name = [c and not f for c, f in zip(capital, first, strict=True)]
        opening = [c and f for c, f in zip(capital, first, strict=True)]
        masks = [values, [a or b for a, b in zip(values, name, strict=True)], [a or b or c for a, b, c in zip(values, name, opening, strict=True)]]
        n = len(own)
        self.n, self.windows, self.runs = n, {}, {}
        for at in range(n - 4):
            s = slice(at, at + 5)
            for kind, mask in enumerate(masks):
                slots = [i for i in range(at, at + 5) if mask[i]]
                sure = [i for i in slots if not opening[i]]
                if len(sure) > 2 or len(slots) > (3 if kind == 2 else 2) or (kind == 1 and not any(name[s])) or (kind == 2 and not any(opening[s])):
                    continue
                tokens = tuple("#A" if mask[i] and not values[i] else token[i] for i in range(at, at + 5))
                self.windows.setdefault(at, []).append((tokens, kind == 2, [own[i] for i in slots], False))
            if sum(values[s]) > 2:
                self.windows.setdefault(at, []).append((tuple(own[s]), False, [], True))
        for width in short if short is not None else ([n] if 0 < n < 5 else []):
            for at in range(n - width + 1):
                self.windows.setdefault(at, []).append((tuple(own[at : at + width]), False, [], True))
        for at in range(n - 12):
            fits = []
            for kind, mask in enumerate(masks):
                ends = min(sum(mask[at : at + 5]), sum(mask[at + 8 : at + 13]))
                fits.append(sum(mask[at : at + 13]) <= 6 and ends <= 2 and (kind == 0 or sum(mask[at : at + 13]) > sum(masks[kind - 1][at : at + 13])))
            for kind, mask in enumerate(masks):
                if fits[kind]:
                    tokens = tuple("#A" if mask[i] and not values[i] else token[i] for i in range(at, at + 13))
                    self.runs.setdefault(at, []).append((tokens, kind == 2, [own[i] for i in range(at, at + 13) if mask[i]], False))
            if not fits[0]:
                self.runs.setdefault(at, []).append((tuple(own[at : at + 13]), False, [], True))


def word_hash(word):
    return int(tokens.hash_words(*tokens.text_bytes(pa.array([word]))).hashes.view("int64")[0])


def brute_hits(texts, items):
    """(document, item) -> (matched, n_windows, coverage), by the definitions and nothing else."""
    built = [Template(t, None) for t in items]
    short = sorted({b.n for b in built if 0 < b.n < 5})
    out = {}
    for d, text in enumerate(texts):
        doc = Template(text, short)
        seen, runs = {}, {}
        for found, into in ((doc.windows, seen), (doc.runs, runs)):
            for entries in found.values():
                for tokens_, opening, slots, _ in entries:
                    into.setdefault(tokens_, set()).add((opening, tuple(slots)))
        for i, item in enumerate(built):
            same = [(pos, exact, o or p, list(zip(slots, other, strict=True))) for pos, entries in item.windows.items() for t, o, slots, exact in entries for p, other in seen.get(t, ())]
            votes = {}
            for _, _, opening, pairs in same:
                for a, b in pairs:
                    vote = votes.setdefault(a, {}).setdefault(b, [0, 0])
                    vote[0] += not opening
                    vote[1] += 1
            best = {a: max(v, key=lambda b, v=v: (v[b][0], v[b][1] if not v[b][0] else 0, -word_hash(b))) for a, v in votes.items()}
            good = [(pos, exact) for pos, exact, _, pairs in same if all(best[a] == b for a, b in pairs)]
            run = any(
                len(set(zip(slots, other, strict=True))) == len(set(slots)) for entries in item.runs.values() for t, _, slots, _ in entries for _, other in runs.get(t, ())
            )
            n_open = len({pos for pos, entries in item.windows.items() if not all(e[3] for e in entries)})
            shares = [(len({p for p, _ in good}) / len(item.windows), len(item.windows), len({p for p, _ in good}))] if item.windows else []
            if n_open:
                matched = len({p for p, exact in good if not exact})
                shares.append((matched / n_open, n_open, matched))
            if (good or run) and (run or max(shares)[0] >= decontam.COVER):
                out[d, i] = (max(shares)[2], max(shares)[1], max(shares)[0])
    return out


def test_decontamination_matches_brute_force(spark):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(11)
    story = "Tom has {a} apples. Tom buys {b} more from Ann at 3 km. Ann sells {c} red apples to Tom. How many apples has Tom now?"
    made = [story.format(a=rng.randrange(9), b=rng.randrange(9), c=rng.randrange(9)).replace("Tom", rng.choice(["Tom", "Bob", "tom"])).replace("Ann", rng.choice(["Ann", "Tom", "Eva"])) for _ in range(25)]
    made += [" ".join(t.split()[rng.randrange(4) : rng.randrange(8, 30)]) for t in rng.choices(bench, k=25)] + ["1 2 3 4 5 6 7 8", "one word", "3 m 4 km 5 kg 6 s 7 h", None, ""]
    items = [*bench, story.format(a=5, b=3, c=2), "1 2 3 4 5 6 7 8", "one word", "Anna runs 3 m and 4 km and 5 kg in 6 s"]
    texts = [t for t in texts if t.isascii()][:60] + made
    items = [t for t in items if t.isascii()]
    got = {k: (r.matched, r.n_windows, r.coverage) for k, r in contaminated(spark, texts, items).items()}
    assert got == brute_hits(texts, items) and len(got) > 20


def test_decontamination_empty_and_clean(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, "clean words stay in place here", "y"), (2, "clean words stay in place here", "y"), (None, None, None)], "doc_id long, text string, _key string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontam.clean(docs.drop("_key").withColumn("h", F.lit(1)), bench).collect()) == ["2", "2", "None"]
    assert decontam.clean(docs.drop("_key"), bench.where("false")).count() == 4
    assert decontam.clean(docs.drop("_key").where("false"), bench).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text.isascii()]
    leaks = [(9100 + i, f"the note number {i} of that day says {t} and that was it", "en", "src0", 0) for i, t in enumerate(items[:3])]
    extra = spark.createDataFrame([(9001, "12 34 !!", None, "s", 8), (9002, None, None, None, 0), *leaks], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == {9001, 9002}
        if name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
            rows = [(r.doc_id, r.text) for r in docs.collect() if (r.text or "").isascii()]
            hit = {rows[d][0] for d, _ in brute_hits([t for _, t in rows], bench)}
            gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()}
            assert hit == gone & {i for i, _ in rows} and hit >= {9100, 9101, 9102}
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            expected = {c for _, c in brute_components(rows).values()}
            assert {r.doc_id for r in out.collect()} == expected
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count()
    assert 3 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def test_registered_queries():
    assert [k.split("_")[0] for k in queries.QUERIES] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
