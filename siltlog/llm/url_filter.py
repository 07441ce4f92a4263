"""URL allow/block rules in a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and all subdomains, when the url's path starts with the rule's
path. The longest wins, as the trie has it: the rule with the most host labels, and of these the one with the longest path (so
that a rule for a subdomain goes before one for its domain, however long that one's path is); of equal rules, block.
An url without a fitting rule gets the default verdict.

Cases: a null url, or one without ``://``, has an empty host and path and gets the default; empty labels are labels;
repeated rows are judged each; an empty table gives an empty result; further columns are dropped by name, so clashes
with ``host``, ``path``, ``rule`` or ``verdict`` can't occur. Texts of any length are judged whole.

The trie is broadcast only up to MAX_TRIE_RULES rules; beyond, the same rules are equi-joined on host suffixes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

MAX_TRIE_RULES = 200_000
RESULT = "host string, path string, rule string, verdict string"
_END = re.compile("[/?#]")
_QUERY = re.compile("[?#]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the rules see them."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = _END.search(rest)
    if not cut:
        return rest.translate(_LOWER), ""
    tail = rest[cut.start() :]
    end = _QUERY.search(tail)
    return rest[: cut.start()].translate(_LOWER), tail[: end.start()] if end else tail


class UrlTrie:
    """Host nodes by label from the right; in each, path nodes by whole segment with the beginnings of a further one."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
                raise ValueError(f"bad rule: {(verdict, host, path)}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("kids", {}).setdefault(label, {})
            if not path:
                self._put(node, "bare", verdict, host)
                continue
            *whole, tail = path[1:].split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("kids", {}).setdefault(segment, {})
            self._put(node.setdefault("tails", {}), tail, verdict, host + path)
            if len(tail) not in node.setdefault("sizes", []):
                node["sizes"] = sorted([*node["sizes"], len(tail)], reverse=True)

    @staticmethod
    def _put(at: dict, key: str, verdict: str, name: str) -> None:
        if at.get(key, ("allow",))[0] != "block":
            at[key] = (verdict, name)

    @staticmethod
    def _deepest(host_node: dict, path: str) -> tuple[str, str] | None:
        found = host_node.get("bare")
        node = host_node.get("paths")
        if node is None or not path.startswith("/"):
            return found
        segments, k = path[1:].split("/"), 0
        while node is not None:
            tails = node.get("tails")
            if tails:
                for size in node["sizes"]:
                    if (hit := tails.get(segments[k][:size])) and len(segments[k]) >= size:
                        found = hit
                        break
            # a segment is whole only if a further one, perhaps empty, follows it
            node = node.get("kids", {}).get(segments[k]) if k + 1 < len(segments) else None
            k += 1
        return found

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("kids", {}).get(label)
            if node is None:
                break
            found = self._deepest(node, path) or found
        return found


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """id_col with host, path, rule and verdict, one row for each of df."""
    if len(rules) > MAX_TRIE_RULES:
        return filter_urls_joined(df, rules, id_col, url_col, default)
    spark, rows = df.sparkSession, df.select(id_col, url_col)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches):
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                verdict, name = trie.value.find(host, path) or (default, None)
                hosts.append(host), paths.append(path), names.append(name), verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=[id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(tidy(judge), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {RESULT}")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls_joined(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """The same result for rule lists too large to broadcast: host suffixes are equi-joined to the rules' hosts."""
    spark: SparkSession = df.sparkSession
    UrlTrie(rules)
    rule = spark.createDataFrame([(h.translate(_LOWER), h, p, v) for v, h, p in rules], "suffix string, r_host string, r_path string, r_verdict string")
    rows = df.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    each = rows.select("_row", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("depth", "suffix"))
    best = (
        each.join(rule, "suffix")
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("_row")
        .agg(F.max(F.struct("depth", F.length("r_path").alias("n"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("name"))).alias("m"))
    )
    return rows.join(best, "_row", "left").select(id_col, "host", "path", F.col("m.name").alias("rule"), F.when(F.col("m.b"), "block").when(F.col("m.b").isNotNull(), "allow").otherwise(default).alias("verdict"))
