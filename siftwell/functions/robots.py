"""robots.txt: files to a rules table, and the longest-match decision as a join."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from siftwell.functions.types import of, struct

# Fixed value: what stays literal in compared paths.
SAFE = "/?=&*$:@!,;+~%-._"
RULES = ArrayType(struct(group="int", agent="string", allow="boolean", pattern="string"))


def comparable_path(path: str) -> str:
    return quote(unquote(path), safe=SAFE)


def url_path(url: str) -> str:
    """The path and query that rules are matched against."""
    parts = urlsplit(url)
    return comparable_path((parts.path or "/") + ("?" + parts.query if parts.query else ""))


def parse(text: str) -> list[tuple[int, str, bool, str]]:
    """Rows (group, agent, allow, pattern); a group without rules has one row with a null pattern."""
    agents: list[str] = []
    rules: list[tuple[bool, str]] = []
    rows: list[tuple[int, str, bool, str]] = []
    group, open_agents = -1, False

    def close() -> None:
        for agent in agents:
            rows.extend((group, agent, allow, pattern) for allow, pattern in rules or [(True, None)])

    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_agents:
                close()
                agents, rules, group = [], [], group + 1
            agents.append(value.lower())
            open_agents = True
        else:
            open_agents = False
            if agents and value and key in ("allow", "disallow"):
                rules.append((key == "allow", comparable_path(value)))
    close()
    return rows


def _struct(rows):
    return [{"group": g, "agent": a, "allow": w, "pattern": p} for g, a, w, p in rows]


@F.pandas_udf(RULES)
def parse_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _struct(parse(t or "")))


@F.pandas_udf(of("string"))
def path_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: url_path(u), na_action="ignore")


def rules_table(files: DataFrame) -> DataFrame:
    """``origin, agent, allow, pattern`` of robots files ``origin, text``."""
    return files.select("origin", F.explode(parse_udf("text")).alias("r")).select("origin", "r.agent", "r.allow", "r.pattern")


def pattern_regex(pattern: Column) -> Column:
    """A regex for the start of a path: ``*`` is any run, a final ``$`` the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|\-])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), F.lit(r"\z")).otherwise(""))


def decide(targets: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``targets`` (``origin, path``) with ``allowed``: the longest pattern wins, allow wins ties.

    Rules of the agent's own groups hold; an origin without any uses those for ``*``.
    """
    named = rules.where(F.col("agent").isin(agent.lower(), "*")).withColumn("own", F.col("agent") == agent.lower())
    has_own = named.groupBy("origin").agg(F.max("own").alias("has_own"))
    used = named.join(has_own, "origin").where(F.col("own") == F.col("has_own")).where("pattern is not null")
    used = used.select("origin", "allow", "pattern", pattern_regex(F.col("pattern")).alias("regex")).distinct()
    paths = targets.select("origin", "path").distinct()
    best = (
        paths.join(used, "origin")
        .where(F.expr("path rlike regex"))
        .groupBy("origin", "path")
        .agg(F.max_by("allow", F.struct(F.char_length("pattern"), "allow")).alias("found"))
    )
    return targets.join(best, ["origin", "path"], "left").withColumn("allowed", F.coalesce("found", F.lit(True))).drop("found")


def is_allowed(text: str, agent: str, url: str) -> bool:
    """The same decision for one file and URL."""
    rows = parse(text)
    own = [r for r in rows if r[1] == agent.lower()] or [r for r in rows if r[1] == "*"]
    path = url_path(url)
    hits = []
    for _, _, allow, pattern in own:
        if pattern is not None:
            body = pattern.removesuffix("$")
            regex = ".*".join(map(re.escape, body.split("*"))) + ("$" if body != pattern else "")
            if re.match(regex, path):
                hits.append((len(pattern), allow))
    return max(hits)[1] if hits else True
