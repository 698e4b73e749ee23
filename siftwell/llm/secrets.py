"""Secret scan with a random forest that removes false positives (native).

Candidates are maximal runs of 16 or more token characters with a digit, and where the context is
strong also values without either: whole values that are assigned to a key that names a secret,
quoted values of eight characters or more that are assigned to any key, user info in URLs, and
PEM headers of private keys. Splitting the text at
the same pattern gives each candidate's neighbourhood without positions, and only short
neighbourhoods are exploded. The forest reads the candidate's length and character mix, its
character transitions, how much of it dictionary words cover, its path (the source), and the
words next to it. Everything is Catalyst expressions and ``pyspark.ml``; no Python runs on
executors.

The forest learns from labelled findings: ``label`` 1 or 0 on rows of ``candidates``. Where no
reviewed findings exist, two rules label what is clear, and no forest sees what its labels were made
from: ``labels_by_context`` reads only what stands around a candidate and teaches a forest of the
candidate's own features (``CONTENT``); ``labels_by_content`` reads only the candidate and teaches a
forest of its path and neighbouring words (``CONTEXT``). A finding's score is the mean of the two, so
a value in a strong place counts by its look, and a value that looks like a secret by its place.
Issuers' formats and PEM headers score 1 by themselves, unless they call themselves examples.
Learning reads at most ``SAMPLE`` findings (smallest hashes); all else covers every text.

Between its two passes the scan keeps findings in the shared folder, with their texts encrypted under
a key that only the plan holds.

Defined cases: a null text has no candidates; a null source is an empty path; a candidate that
repeats in a text is a finding each time; with findings of one class only (or none) every score
is that class's share, 0 if none; texts of any length are searched in whole; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import hash_sample, materialize

CHARS = "A-Za-z0-9+/_.\\-"
RUN = f"(?<![{CHARS}])(?=[^0-9\\s]*+[0-9])[{CHARS}]{{16,}}+={{0,2}}"
BEFORE, AFTER = 64, 32
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 6, 29

# Words that introduce secrets, words of placeholders, issuer formats, and common words.
KEYWORDS = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credential|private[_-]?key|client[_-]?secret"
# What may stand between such a word and its value.
ASSIGN = "(?:[_-][A-Za-z0-9]{1,16})?[0-9]{0,2}[\"'`]?\\s{0,3}(?::=|=>|[:=])\\s{0,3}"
PLACEHOLDERS = "(?<![a-z])(?:example|sample|dummy|test|fake|changeme|placeholder|your(?=[_-])|x{4,})(?![a-z])"
ISSUERS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|glpat-[0-9A-Za-z_\-]{20}|xox[abprs]-[0-9A-Za-z\-]{10,}|"
    r"AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]+"
)
WORDS = (
    "account admin agent article backup branch build cache client cloud code com common config connect content count data "
    "database default dev dist document domain download email error event example export file form group home host html http "
    "image import index info install item key lib library link list local login mail main master media member message model "
    "module name net network node number object order org package page path post prod product profile project public query "
    "read release report request resource response result role root route sample schema script search section server service "
    "session setting site source src staff state static status store string style system table task template test text the "
    "time title type update upload url user value version view web window work"
).split()

_URL = "[A-Za-z][A-Za-z0-9+.\\-]{0,15}://"
_SCHEME = "(?:bearer|basic|token)\\s{1,3}"
# Cheap looks behind first: only starts of values get to the long one.
_VALUE = f"(?<=[:=>\\s\"'`])(?<=[:=>]\\s{{0,3}}[\"'`]?)(?!{_URL})(?!(?i:{_SCHEME}))"
_KEYED = f"(?<=(?i:{KEYWORDS}){ASSIGN}"
_BARE = "(?:(?![&;,][A-Za-z0-9_. \\-]{1,64}[:=])[^\\s\"'`])+(?<![,;.)\\]}>])"
PEM = "-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
USER_INFO = "://[^\\s/@:]{0,64}:"
CANDIDATE = "|".join(
    [
        PEM,
        *(f"{_VALUE}{_KEYED}{q})[^{q}\\r\\n]{{1,512}}+(?={q})" for q in "\"'`"),
        f"{_VALUE}{_KEYED})(?![\"'`]){_BARE}",
        f"(?<=\\s)(?<=(?i:authorization)[\"']?\\s{{0,3}}[:=]\\s{{0,3}}[\"']?(?i:{_SCHEME})){_BARE}",
        RUN,
        *(f"(?<={q})(?<=[:=]\\s{{0,3}}{q})(?!{_URL})[^{q}\\s]{{8,512}}+(?={q})" for q in "\"'`"),
        f"(?<=:)(?<={USER_INFO})[^\\s/@]{{1,256}}+(?=@)",
        "(?<=//)(?<=https?://)[^\\s/@:]{4,256}+(?=@)",
    ]
)

#: What a candidate looks like, and what stands around it.
CONTENT = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "to_digit", "to_letter", "case_turns", "vowel_turns",
    "longest_letters", "dictionary", "dots", "dummy", "issued",
)
CONTEXT = (
    "path_test", "path_depth", "keyword_near", "keyword_far", "assigned", "quoted", "at_sign", "in_url", "dummy_key", "words_before",
    "keyed", "user_info",
)
FEATURES = (*CONTENT, *CONTEXT)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, path, ordinal, candidate, before, after`` for every candidate of every text."""
    found = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    pieces = found.where(F.size("found") > 0).withColumn("pieces", F.split("text", CANDIDATE, -1))
    rows = F.transform(
        "found",
        lambda c, i: F.struct(
            i.alias("ordinal"),
            c.alias("candidate"),
            F.right(F.get("pieces", i), F.lit(BEFORE)).alias("before"),
            F.substring(F.get("pieces", i + 1), 1, AFTER).alias("after"),
        ),
    )
    return pieces.select("doc_id", "path", F.inline(rows))


def features(found: DataFrame) -> DataFrame:
    """Add the forest's columns."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length("candidate").cast("double")

    def count(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    def flag(x: Column) -> Column:
        return F.coalesce(x, F.lit(False)).cast("double")

    letters = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    return found.withColumns(
        {
            "length": n,
            "digits": count("[0-9]") / n,
            "uppers": count("[A-Z]") / n,
            "lowers": count("[a-z]") / n,
            "marks": count("[^A-Za-z0-9]") / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "to_digit": count("[A-Za-z](?=[0-9])") / n,
            "to_letter": count("[0-9](?=[A-Za-z])") / n,
            "case_turns": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
            "vowel_turns": count("[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])", low) / n,
            "longest_letters": F.coalesce(F.array_max(F.transform(letters, F.length)), F.lit(0)) / n,
            "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=len, reverse=True)), "")) / n,
            "dots": count("\\."),
            "path_test": flag(F.lower("path").rlike("test|example|sample|fixture|mock|docs?/")),
            "path_depth": count("/", F.col("path")),
            "keyword_near": flag(F.lower("before").rlike(f"(?:{KEYWORDS})[\"']?\\s{{0,3}}(?:[:=]|=>|is)?\\s{{0,3}}[\"']?$")),
            "keyword_far": flag(F.lower("before").rlike(KEYWORDS)),
            "assigned": flag(F.col("before").rlike("[:=]\\s{0,3}[\"'`]?$")),
            "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
            "at_sign": flag(F.col("before").rlike("@$") | F.col("after").rlike("^@")),
            "in_url": flag(F.col("before").rlike("://\\S*$") | c.rlike("^www\\.")),
            "dummy": flag(low.rlike(PLACEHOLDERS)),
            "dummy_key": flag(F.lower(F.regexp_extract("before", "[A-Za-z0-9_.-]*[\"'`]?\\s{0,3}(?::=|=>|[:=])\\s{0,3}[\"'`]?$", 0)).rlike(PLACEHOLDERS)),
            "keyed": flag(F.col("before").rlike(f"(?i)(?:{KEYWORDS}){ASSIGN}[\"'`]?$")),
            "user_info": flag(F.col("before").rlike(f"{USER_INFO}$") & F.col("after").rlike("^@")),
            "issued": flag(c.rlike(f"^(?:{ISSUERS}|{PEM})$")),
            "words_before": count("\\S+", F.col("before")),
        }
    )


def labels_by_context(found: DataFrame) -> DataFrame:
    """``label`` from the words around a candidate: assigned to a word for secrets, or plain prose and addresses."""
    c = {name: F.col(name) == 1 for name in CONTEXT}
    secret = (c["keyed"] | c["user_info"] | (c["keyword_near"] & c["assigned"])) & ~c["dummy_key"]
    plain = (c["at_sign"] & ~c["user_info"]) | c["in_url"] | c["dummy_key"] | ~(c["keyword_near"] | c["keyword_far"] | c["assigned"] | c["user_info"])
    label = F.when(secret, 1.0).when(plain, 0.0)
    return found.withColumn("label", label).where("label is not null")


def labels_by_content(found: DataFrame) -> DataFrame:
    """``label`` from the candidate alone: an issuer's format or a random look, or numbers, hosts and words."""
    c = F.col("candidate")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    random = mixed & (F.col("length") >= 16) & (F.col("dictionary") < 0.3) & (F.col("longest_letters") < 0.4) & (F.col("to_digit") + F.col("to_letter") >= 0.2) & (F.col("dots") == 0)
    plain = c.rlike("^[0-9.+/_-]+$") | c.rlike("^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,6}$") | (F.col("dictionary") > 0.6) | (F.col("dummy") == 1) | ~c.rlike("[0-9]")
    label = F.when(F.col("issued") == 1, 1.0).when(plain, 0.0).when(random, 1.0)
    return found.withColumn("label", label).where("label is not null")


def fit(labelled: DataFrame, names: tuple[str, ...] = FEATURES):
    """A forest of the features ``names``, or the share of secrets where only one class (or none) is known."""
    known = labelled.where("label is not null").select(F.xxhash64("candidate", "before").alias("order"), "label", *names)
    rows = materialize(hash_sample(known, "order", SAMPLE, "label"))
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        return float(max(classes, default=0.0))
    # Both classes weigh the same.
    weight = reduce(lambda w, kv: F.when(F.col("label") == kv[0], sum(classes.values()) / (2 * kv[1])).otherwise(w), classes.items(), F.lit(1.0))
    vectors = VectorAssembler(inputCols=list(names), outputCol="x").transform(rows.withColumn("weight", weight))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="x", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p", rawPredictionCol="raw", predictionCol="guess"
    )
    return forest.fit(vectors.select("x", "label", "weight"))


def judge(found: DataFrame, model, names: tuple[str, ...] = FEATURES, threshold: float = 0.5) -> DataFrame:
    """Candidates with features, ``score`` and ``is_secret``."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=list(names), outputCol="x").transform(found)
        scored = model.transform(vectors).withColumn("score", vector_to_array("p")[1]).drop("x", "p", "raw", "guess")
    return scored.withColumn("is_secret", F.col("score") >= threshold)


SECRET_COLUMNS = ("candidate", "before", "after")


def _kept(found: DataFrame) -> DataFrame:
    """``found``, computed once; what it holds of the texts is encrypted where it lies."""
    key = F.lit(os.urandom(16))
    hidden = materialize(found.withColumns({c: F.aes_encrypt(F.encode(c, "UTF-8"), key) for c in SECRET_COLUMNS}))
    return hidden.withColumns({c: F.decode(F.aes_decrypt(c, key), "UTF-8") for c in SECRET_COLUMNS})


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate with its score; ``labelled`` are reviewed findings, if there are any."""
    found = _kept(features(candidates(docs)))
    if labelled is not None:
        return judge(found, fit(labelled), FEATURES, threshold)
    looks = judge(found, fit(labels_by_context(found), CONTENT), CONTENT).withColumnRenamed("score", "by_content").drop("is_secret")
    places = judge(looks, fit(labels_by_content(found), CONTEXT), CONTEXT).withColumnRenamed("score", "by_context").drop("is_secret")
    # A key's header or an issuer's format is what it is, wherever it stands; too rare for a forest to learn.
    sure = (F.col("issued") == 1) & (F.col("dummy") == 0)
    scored = places.withColumn("score", F.when(sure, 1.0).otherwise((F.col("by_content") + F.col("by_context")) / 2))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def redact(candidate: Column) -> Column:
    """Enough of a finding to recognise it, not to use it."""
    return F.concat(F.substring(candidate, 1, 4), F.lit("..."), F.length(candidate).cast("string"))
