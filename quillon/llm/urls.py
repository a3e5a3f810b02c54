"""URL filters: site and pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, prepare

_TOKEN = re.compile(r"[a-z0-9]+")
_URL_TOKEN = "[a-z0-9]+"

# The site rules (verdict, host, path).
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Patterns of the method for URLs that no site rule fits: `^` is a separator or an end, `*` any run.
PATTERNS = (
    ("block", "^ads-track^"),
    ("block", "^free-bets^"),
    ("block", "^cheap-pills^"),
    ("block", "^spam-farm^"),
    ("block", "^casino-win^"),
    ("block", "^adult-x^"),
    ("block", "^doubleclick.net^"),
    ("block", "/banner/*.swf"),
    ("block", "^popunder^"),
)


#: Rule tokens up to this many are broadcast when their frequencies are counted; more are met in a join.
BROADCAST_TOKENS = 100_000
#: More rules (about 500 bytes each) are an error.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits host and its subdomains where the path starts with `path`. Matched against host + path, case kept in paths."""
    whole = host + path
    tokens = _TOKEN.findall(host.lower())
    bounded = path if path.endswith("/") else path[: path.rfind("/") + 1]
    # only whole lower-case path tokens can be looked up, since paths keep their case
    tokens += [t for t in re.findall(r"[A-Za-z0-9]+", bounded) if t == t.lower()]
    return UrlRule(verdict, whole, rf"(?:[^/]*\.)?{re.escape(whole)}", tuple(tokens), True)


def pattern_rule(verdict: str, pattern: str) -> UrlRule:
    """Searched in the lower-cased url. Tokens next to an open end or a `*` may be parts of longer ones: not indexed."""
    sep = r"(?:[^a-z0-9_.%-]|[./]|^|$)"
    regex = "".join({"^": sep, "*": ".*"}.get(c) or re.escape(c) for c in pattern.lower())
    tokens = [
        m[0]
        for m in _TOKEN.finditer(pattern.lower())
        if m.start() and m.end() < len(pattern) and pattern[m.start() - 1] != "*" and pattern[m.end()] != "*"
    ]
    return UrlRule(verdict, pattern, regex, tuple(tokens))


class RuleIndex:
    """Rules by their rarest token. Rules without one that can be looked up are tried on every url."""

    def __init__(self, rules: list[UrlRule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, UrlRule]]] = defaultdict(list)
        self.always: list[tuple[int, UrlRule]] = []
        for k, rule in enumerate(rules):
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t))
                self.by_token[rarest].append((k, rule))
            else:
                self.always.append((k, rule))
        self._compiled: dict[str, re.Pattern] = {}

    def __getstate__(self):
        return self.by_token, self.always  # patterns are compiled where a url fetches their rules

    def __setstate__(self, state):
        (self.by_token, self.always), self._compiled = state, {}

    def _regex(self, rule: UrlRule) -> re.Pattern:
        if rule.regex not in self._compiled:
            self._compiled[rule.regex] = re.compile(rule.regex, re.S)
        return self._compiled[rule.regex]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """host, path, rule and verdict of one url."""
        host, path = split_url(url)
        lower = (url or "").lower()
        found = list(self.always)
        for token in set(_TOKEN.findall(lower)):
            found += self.by_token.get(token, ())
        where = host + path
        best: tuple[int, int] | None = None
        named, verdict, blocked, allowed = None, "allow", False, False
        for k, rule in found:
            if rule.site:
                if path and self._regex(rule).match(where) and (best is None or (len(rule.name), -k) > best):
                    best, named, verdict = (len(rule.name), -k), rule.name, rule.verdict
            elif self._regex(rule).search(lower):
                blocked |= rule.verdict == "block"
                allowed |= rule.verdict == "allow"
        if best is None and blocked and not allowed:
            verdict = "block"
        return host, path, named, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null and for a url without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    path = re.match(r"[^?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def token_frequency(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """In how many urls each rule token occurs: a row per rule token at most comes back."""
    if not tokens:
        return {}
    seen = pages.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(f"`{url_col}`"), F.lit(_URL_TOKEN), F.lit(0)))).alias("t")
    )
    names = pages.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    if len(tokens) <= BROADCAST_TOKENS:
        names = F.broadcast(names)
    return {r["t"]: r["n"] for r in seen.join(names, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n")).collect()}


def _rows(rules, *columns: str) -> list[tuple]:
    """Rules as a list; a table of them has MAX_RULES rows at most, without nulls, repeated rows once, in their own order."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    rows = rules.select(*columns).dropna().distinct().orderBy(*columns).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [tuple(r) for r in rows]


def filter_urls(
    pages: DataFrame,
    site_rules=SITE_RULES,
    patterns=PATTERNS,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict per row of pages.

    site_rules and patterns are lists, or tables (verdict, host, path) and (verdict, pattern) of MAX_RULES rows at most,
    without null entries; the index of all of them is broadcast.
    The longest site rule that fits decides; else a url that a block pattern and no allow pattern matches is blocked,
    and all others are allowed. Null and malformed urls have an empty host and path, which no site rule fits. Repeated
    rows and null ids each give their own row; further columns are not read.
    """
    prepare(pages.sparkSession)
    site_rules, patterns = _rows(site_rules, "verdict", "host", "path"), _rows(patterns, "verdict", "pattern")
    rules = [site_rule(*r) for r in site_rules] + [pattern_rule(*p) for p in patterns]
    some = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    held = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_frequency(some, {t for r in rules for t in r.tokens})))

    def judged(batch: pa.RecordBatch) -> dict:
        got = [held.value.judge(u) for u in batch.column("url").to_pylist()]
        cols = list(zip(*got, strict=True))
        return {"page_id": batch.column("page_id")} | {
            n: pa.array(c, pa.string()) for n, c in zip(("host", "path", "rule", "verdict"), cols, strict=True)
        }

    kind = some.schema["page_id"].dataType.simpleString()
    return map_arrow(some, f"page_id {kind}, host string, path string, rule string, verdict string", judged)
