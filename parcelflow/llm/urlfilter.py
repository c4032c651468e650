"""URL rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, fresh, table

#: Rules that go to every task as one trie (some 300 bytes a rule); more come in several blocks.
BLOCK_RULES = 200_000
_MATCH = "struct<host:string,path:string,verdict:string>"

#: The rules of the production query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


class Trie:
    """Host nodes by reversed labels; at each, path nodes by segments.

    The last segment of a rule's path need only begin the URL's segment
    there: each node has its ends by length, and a segment's beginnings of
    these lengths are looked up. The deepest host wins, then the longest
    path; of an allow and a block entry for one host and path, block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        nodes = []
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("label", label), {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("segment", segment), {})
            if "ends" not in node:
                node["ends"] = {}
                nodes.append(node)
            if verdict == "block" or last not in node["ends"]:
                node["ends"][last] = (host, path, verdict)
        for node in nodes:
            node["lengths"] = sorted({len(end) for end in node["ends"]}, reverse=True)

    @staticmethod
    def _by_path(node: dict, path: str):
        found = None
        for segment in path.split("/"):
            if ends := node.get("ends"):
                found = next((ends[segment[:n]] for n in node["lengths"] if n <= len(segment) and segment[:n] in ends), found)
            node = node.get(("segment", segment))
            if node is None:
                break
        return found

    def find(self, host: str, path: str) -> tuple[str, str, str] | None:
        """Host, path and verdict of the longest match."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            found = self._by_path(node, path) or found
        return found


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, block_rules: int = BLOCK_RULES) -> DataFrame:
    """``urls`` with host, path, rule (null without a match) and verdict.

    ``rules`` has verdict, host and path; rows with a null are ignored. All
    rows stay, repeated ones and very long URLs too; null, empty or relative
    URLs have an empty host and path, which no rule with a host fits, and
    get ``default``. Columns of ``urls`` that are named as one of the four
    are replaced. The rules come in blocks of about ``block_rules``, by
    their hosts: each block is a trie that is broadcast and asked with all
    URLs. Of several blocks each answer is a table before the next comes, so
    that one trie is held at a time, and the longest match of all wins.
    """
    rules = rules.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path").na.drop().distinct()
    n, rounds = rules.count() // block_rules + 1, Rounds(urls.sparkSession, "matched")
    host, path = url_parts(F.col(f"`{url_col}`"))
    h, p, m, best = (fresh(urls, f"_{x}") for x in ("host", "path", "match", "best"))
    own = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    found = urls.withColumns({h: host, p: path, best: F.lit(None).cast(_MATCH)})
    for b in range(n):
        found = found.withColumn(m, _asked(rules.where(F.pmod(F.xxhash64("host"), F.lit(n)) == b), F.col(h), F.col(p)))
        # The longer host of two that fit has more labels; no two blocks have rules of one host.
        length = lambda x: F.coalesce(F.length(f"`{x}`.host"), F.lit(-1))
        found = found.withColumn(best, F.when(length(m) > length(best), F.col(m)).otherwise(F.col(best))).drop(m)
        if b < n - 1:
            found = rounds.put(found)
    x = F.col(f"`{best}`")
    return found.select(*own, F.col(f"`{h}`").alias("host"), F.col(f"`{p}`").alias("path"), F.concat(x["host"], x["path"]).alias("rule"), F.coalesce(x["verdict"], F.lit(default)).alias("verdict"))


def _asked(rules: DataFrame, host: Column, path: Column) -> Column:
    held = rules.sparkSession.sparkContext.broadcast(Trie(sorted(map(tuple, rules.collect()))))

    @F.pandas_udf(_MATCH)
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = held.value.find
        return pd.DataFrame([find(a, b) or (None, None, None) for a, b in zip(hosts, paths, strict=True)], columns=["host", "path", "verdict"])

    return match(host, path)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rest AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT rid, page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
rules(verdict, rhost, rpath) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + r"""),
fits AS (SELECT rid, rhost || rpath AS rule, verdict FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rhost) DESC, length(rpath) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, '""" + DEFAULT + """') AS verdict FROM parts LEFT JOIN fits USING (rid)"""

QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {"op6_url_filter": OP6_SQL}
