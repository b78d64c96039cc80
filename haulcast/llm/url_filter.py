"""URL judgements: host and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton.

Edge cases: a null URL, or one without ``://``, has an empty host and an empty
path; no rule fits it, and the vocabulary is still matched on what there is. An
empty path does not start with ``/``, so no rule fits it either. Repeated rows are
judged alike; an empty table gives an empty result. Columns besides page_id and
url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.text import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

# The vocabulary. One strict term rejects, soft terms count once each.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "roulette", "sexcam", "spam",
          "viagra", "warez", "xxx")
SOFT = ("ads", "banner", "bet", "bets", "bonus", "cheap", "click", "cracked", "dating", "deal", "farm", "free", "jackpot",
        "keygen", "loan", "meds", "odds", "payday", "pharmacy", "pills", "poker", "popup", "promo", "slots", "torrent",
        "track", "tracker", "win", "winner")
SOFT_LIMIT = 2
_TERM_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(term, (k, len(term)))
    found.make_automaton()
    return found


def bounded_terms(text: str, terms: tuple[str, ...]) -> set[int]:
    """Positions in ``terms`` of those that occur with no letter a-z or digit on either side."""
    hits = set()
    for end, (k, length) in _automaton(terms).iter(text):
        before, after = end - length, end + 1
        if (before < 0 or text[before] not in _TERM_CHARACTERS) and (
            after == len(text) or text[after] not in _TERM_CHARACTERS
        ):
            hits.add(k)
    return hits


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> Column:
    """Struct of the distinct strict and soft terms in a lower-cased URL."""
    terms = (*strict, *soft)

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            hits = [bounded_terms(u, terms) if u else set() for u in urls]
            strict_hits = [sum(k < len(strict) for k in h) for h in hits]
            yield pd.DataFrame({"strict": strict_hits, "soft": [len(h) - n for h, n in zip(hits, strict_hits)]},
                               dtype="int32")

    return count(url)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    same_host = (host == rule.host) | host.endswith("." + rule.host)
    return same_host & path.startswith(rule.path)


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits.

    The longest rule that fits decides. Without one a URL is blocked on a strict
    term or on ``soft_limit`` distinct soft terms, and allowed otherwise.
    """
    host, path = host_and_path(F.col("url"))
    hits = vocabulary_hits(F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER), strict, soft)
    found = pages.select("page_id", host.alias("host"), path.alias("path"), hits.alias("_hits"))
    longest = sorted(rules, key=lambda r: -len(r.name))
    fits = [(rule_fits(r, F.col("host"), F.col("path")), r) for r in longest]
    by_terms = F.when((F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit), "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path",
        F.coalesce(*[F.when(f, r.name) for f, r in fits], F.lit(None).cast("string")).alias("rule"),
        F.coalesce(*[F.when(f, r.verdict) for f, r in fits], by_terms).alias("verdict"),
        F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"))


def judge_urls_sql(table: str = "pages") -> str:
    """The same judgement in DuckDB SQL, for the default rules and vocabulary."""
    count = lambda terms: " + ".join(f"(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::int" for t in terms)
    longest = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in longest]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, longest))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, longest))
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    return f"""
WITH rests AS (
  SELECT page_id, {lower("coalesce(url, '')")} AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM {table}),
parts AS (
  SELECT page_id, low, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
counted AS (SELECT *, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits
FROM counted"""
