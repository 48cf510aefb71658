"""URL rules: a trie over reversed host labels, each host with a trie over path segments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.common import checkpointed, with_python_columns, without

#: The most rules that are sent to all executors; addresses are joined with a longer list.
MAX_RULES = 1_000_000

_LOWER = {i: i + 32 for i in range(65, 91)}
_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_SEGMENT = re.compile(r"[^/]*/|[^/]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of an address; both empty for null or where ``://`` is missing."""
    found = _HOST.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def _precedes(rule: Rule, other: Rule | None) -> bool:
    """Of two rules of one host and path, block counts."""
    return other is None or rule.verdict == "block"


class RuleTrie:
    """Longest match: the deepest host node that has a fitting path, there the longest path.

    A node is ``[children by label, path root or None]``; a path node is
    ``[children by segment, rule, {unfinished last segment: rule}, length of the longest of these]``.
    A segment keeps its slash, so a walk over whole segments compares string prefixes. Of rules that are
    equal but for their verdict, block comes before allow, in whatever order they are given.
    """

    def __init__(self, rules: list[Rule]):
        self.root: list = [{}, None]
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, None, {}, 0]
            at = node[1]
            for segment in _SEGMENT.findall(rule.path):
                if segment.endswith("/"):
                    at = at[0].setdefault(segment, [{}, None, {}, 0])
                else:
                    if _precedes(rule, at[2].get(segment)):
                        at[2][segment] = rule
                    at[3] = max(at[3], len(segment))
                    break
            else:
                if _precedes(rule, at[1]):
                    at[1] = rule

    def match(self, host: str, path: str) -> Rule | None:
        if not host:
            return None
        node, best, segments = self.root, None, _SEGMENT.findall(path)
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                best = self._longest(node[1], segments) or best
        return best

    @staticmethod
    def _longest(at: list, segments: list[str]) -> Rule | None:
        best = at[1]
        for segment in [*segments, ""]:
            for size in range(min(at[3], len(segment)), 0, -1):
                if (rule := at[2].get(segment[:size])) is not None:
                    best = rule
                    break
            at = at[0].get(segment)
            if at is None:
                break
            best = at[1] or best
        return best


def _by_join(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """As the trie judges, for more rules than can be sent to all executors.

    Each distinct address meets the rules by the suffixes of its host and the parts of its path that end with
    a slash; no list of a host's rules is gathered, and an address that many rows have is judged once.
    """
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    upper = "".join(map(chr, _LOWER))
    host, path = F.translate(F.regexp_extract(address, _HOST.pattern, 1), upper, upper.lower()), F.regexp_extract(address, _HOST.pattern, 2)
    named = without(df, ["host", "path", "rule", "verdict"]).withColumns({"host": host, "path": path})

    split = F.regexp_extract("path", "(?s)^(.*/)?[^/]*$", 1)
    known = rules.select(F.translate("host", upper, upper.lower()).alias("r_host"), split.alias("r_head"), F.col("path").alias("r_path"), F.concat("host", "path").alias("rule"), "verdict")
    one = known.groupBy("r_host", "r_head", "r_path").agg(F.max(F.struct(F.col("verdict") == "block", "rule")).alias("last"), F.max("verdict").alias("verdict"))
    one = checkpointed(one.select("r_host", "r_head", "r_path", "last.rule", "verdict"))
    longest = one.agg(F.coalesce(F.max(F.length("r_head")), F.lit(0))).first()[0]

    labels, pieces = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    urls = named.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"))
    met = urls.join(one.select(F.col("r_host").alias("suffix")).distinct(), "suffix", "left_semi")
    heads = F.transform(pieces, lambda _, i: F.when(i > 0, F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/"))).otherwise(""))
    parts = met.select("host", "path", "suffix", F.explode(heads).alias("head")).where(F.length("head") <= longest)
    fits = parts.join(one, (F.col("suffix") == F.col("r_host")) & (F.col("head") == F.col("r_head"))).where(F.startswith("path", "r_path"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("r_host"), F.length("r_path"), "rule", "verdict")).alias("best"))
    found = best.select("host", "path", "best.rule", "best.verdict")
    return named.join(found, ["host", "path"], "left").select(*[f"`{c}`" for c in named.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each address.

    The longest host, and then the longest path, decides; of rules that are equal but for their verdict,
    block. Null or malformed addresses have an empty host and path, no rule and the default verdict. Whole
    addresses of any length are judged, repeated rows alike; an empty table gives an empty one, columns of
    ``df`` named like a result are replaced. The trie is broadcast; of rules in a table (host, path, verdict),
    or in a list, beyond MAX_RULES the addresses are joined with the rules instead.
    """
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        rows = rules.select("host", "path", "verdict").limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            return _by_join(df, rules, url, default)
        rules = [Rule(*r) for r in rows]
    elif len(rules) > MAX_RULES:
        return _by_join(df, spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string"), url, default)
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def compute(urls):
        rows = []
        for u in urls:
            host, path = split_url(u)
            rule = trie.value.match(host, path)
            rows.append((host, path, rule.text if rule else None, rule.verdict if rule else default))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    return with_python_columns(df, [url], compute, fields)
