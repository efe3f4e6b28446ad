"""URL filters: host and path rules over a weighted vocabulary matched with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stemmata.llm.common import LOWER, UPPER, in_arrow, table

#: One of these rejects a url.
STRICT = ("adult", "bets", "casino", "escort", "gambling", "jackpot", "nude", "pills", "poker", "porn", "sex", "viagra", "xxx")
#: Distinct hits of these add up to their weights; REJECT_AT rejects.
SOFT = {"ads": 1, "bonus": 1, "cheap": 1, "click": 1, "discount": 1, "farm": 1, "free": 1, "loan": 1, "prize": 1, "promo": 1, "spam": 1, "track": 1, "win": 1}
REJECT_AT = 2
#: (action, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path from there up to '?', '#' or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


class UrlJudge:
    """Verdicts on urls. The longest fitting rule decides; without one, the vocabulary does.

    A rule fits its host and every subdomain of it if the path starts with the rule's path.
    A term counts where no ASCII letter or digit stands directly before or after it; each distinct term counts once.
    """

    def __init__(self, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, reject_at: int = REJECT_AT, rules: Sequence[tuple[str, str, str]] = RULES):
        self.reject_at = reject_at
        self.terms = ahocorasick.Automaton()
        for term, weight in {**soft, **dict.fromkeys(strict, reject_at)}.items():
            self.terms.add_word(term, (term, weight))
        if len(self.terms):
            self.terms.make_automaton()
        self.rules: dict[str, list[tuple[int, str, str, str]]] = {}
        for action, host, path in rules:
            self.rules.setdefault(host, []).append((len(host + path), host + path, path, action))

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while self.rules and at <= len(host):
            for size, name, start, action in self.rules.get(host[at:], ()):
                if path.startswith(start) and (best is None or (size, name) > best[:2]):
                    best = (size, name, action)
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best and best[1:]

    def weight(self, url: str | None) -> int:
        low = (url or "").translate(_FOLD)
        hits = {}
        if len(self.terms) and low:
            for end, (term, weight) in self.terms.iter(low):
                start = end + 1 - len(term)
                if (start == 0 or low[start - 1] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
                    hits[term] = weight
        return sum(hits.values())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        host, path = split_url(url)
        fits, weight = self.rule(host, path), self.weight(url)
        if fits:
            return host, path, fits[0], fits[1], weight
        return host, path, None, "block" if weight >= self.reject_at else "allow", weight


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **vocabulary) -> DataFrame:
    """One row a page: (id_col, host, path, rule, verdict, weight).

    A null url, or one without '://', has empty host and path; a null url holds no terms and is allowed unless a rule with an
    empty path and host says otherwise. Repeated rows are judged each; an empty table gives an empty result. Of the input only
    id_col and url_col are read, so other columns may have any name. keywords: strict, soft, reject_at, rules of UrlJudge.
    """
    found = UrlJudge(**vocabulary)  # bad vocabularies fail here, on the driver
    kind = pages.schema[id_col].dataType.simpleString()
    judges: list[UrlJudge] = []

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not judges:
            judges.append(UrlJudge(**vocabulary))
        out = [judges[0].judge(u) for u in batch.column(1).to_pylist()]
        host, path, rule, verdict, weight = zip(*out, strict=True)
        columns = [batch.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), pa.array(weight, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [id_col, "host", "path", "rule", "verdict", "weight"])

    del found
    return in_arrow(pages.select(pages[id_col], pages[url_col].cast("string").alias("__url")), judged, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, weight bigint")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each row of pages; a null url or one without :// has an empty host and path and no rule, so that the method judges it."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op2_sql() -> str:
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    fits = "\n      UNION ALL ".join(f"SELECT '{host}' AS h, '{path}' AS p, '{action}' AS a" for action, host, path in RULES)
    weights = " + ".join([f"{REJECT_AT} * {hit(t)}::BIGINT" for t in STRICT] + [f"{w} * {hit(t)}::BIGINT" for t, w in SOFT.items()])
    return f"""
WITH parts AS (
  SELECT page_id, {fold("coalesce(url, '')")} AS low,
         {fold("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules AS ({fits}),
fitting AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM parts) d
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path),
scored AS (SELECT *, CAST({weights} AS BIGINT) AS weight FROM parts)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.action, CASE WHEN s.weight >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, s.weight
FROM scored s LEFT JOIN fitting f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.host = f.host AND s.path = f.path"""
