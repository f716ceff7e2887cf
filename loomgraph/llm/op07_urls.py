"""URL filters: pattern rules indexed by their rarest literal token.

A rule names literal tokens that every url it fits must hold. The index keeps a
rule under the one of its tokens that is rarest among the urls at hand; the
tokens of a url fetch candidate rules, and only those run their expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
_TOKEN = re.compile(TOKEN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Rules travel to every task, so their number is bounded.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path of a site rule, on the whole folded url of a pattern rule."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    bounded = path[: max(path.rfind("/"), path.rfind(".")) + 1]  # a last part without an end may go on in a url
    tokens = (*_TOKEN.findall(host), *_TOKEN.findall(bounded if bounded == bounded.translate(_FOLD) else ""))
    return Rule(host + path, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(pattern, verdict, pattern, tokens, False)


SITES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: Judge urls that no site rule fits; the first in this order wins, none: allow.
PATTERNS = (
    pattern_rule("allow", r"://[^/?#]*\.example\.org/[^?#]*\.html(?:[?#]|$)", "example", "org", "html"),
    pattern_rule("block", r"[?&]utm_source=", "utm", "source"),
    pattern_rule("block", r"://ads\.", "ads"),
    pattern_rule("block", r"/casino/", "casino"),
    pattern_rule("block", r"/betting/", "betting"),
    pattern_rule("block", r"[?&]page=\d+&ref=", "page", "ref"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lowered, path); both empty for null or without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_FOLD), re.match(r"[^?#]*", rest[len(host) :]).group()


class RuleIndex:
    """Rules by their rarest token; those without a token are tried for every url."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the index is made for {MAX_RULES} at most")
        self.by_token: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        for n, rule in enumerate(rules):
            key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
            self.by_token.setdefault(key, []).append((n, rule, re.compile(rule.pattern)))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        folded = (url or "").translate(_FOLD)
        site = other = None
        for token in {"", *_TOKEN.findall(folded)}:
            for n, rule, pattern in self.by_token.get(token, ()):
                if rule.site:
                    if (site is None or (len(rule.name), -n) > (len(site[1].name), -site[0])) and host and pattern.match(host + path):
                        site = (n, rule)
                elif (other is None or n < other[0]) and pattern.search(folded):
                    other = (n, rule)
        if site is not None:
            return host, path, site[1].name, site[1].verdict
        return host, path, None, other[1].verdict if other else "allow"


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: one row a token reaches the driver."""
    found = F.array_distinct(F.regexp_extract_all(F.translate("url", UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1)))
    wanted = F.array_intersect(found, F.array(*map(F.lit, sorted(tokens))))
    return dict(urls.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()) if tokens else {}


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITES + PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages(page_id, url)``.

    A null, empty or other url without :// has an empty host and path and no site
    rule. Longest site rule wins, of equally long ones the first; else the first
    pattern rule; else allow. Urls of any length are read whole. Repeated rows and
    null ids are judged row by row; an empty table gives none. Other columns are not read.
    """
    index = RuleIndex(rules, token_counts(pages, {t for r in rules for t in r.tokens}))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [index.judge(u if isinstance(u, str) else None) for u in b["url"]]
            out = pd.DataFrame(got, columns=["host", "path", "rule", "verdict"], dtype=object)
            out.insert(0, "page_id", b["page_id"].to_numpy())
            yield out

    # pandas would turn whole numbers beside nulls into floats, so ids pass as text
    judged = pages.select(F.col("page_id").cast("string").alias("page_id"), "url").mapInPandas(judge, "page_id string, host string, path string, rule string, verdict string")
    return judged.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


SQL = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, url, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), urls AS (
  SELECT page_id,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(low, '://[^/?#]*\.example\.org/[^?#]*\.html([?#]|$)') THEN 'allow'
    WHEN regexp_matches(low, '[?&]utm_source=') THEN 'block'
    WHEN regexp_matches(low, '://ads\.') THEN 'block'
    WHEN regexp_matches(low, '/(casino|betting)/') THEN 'block'
    WHEN regexp_matches(low, '[?&]page=\d+&ref=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""
