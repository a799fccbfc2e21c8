"""URL filters: block and allow rules on hosts and path prefixes, the longest match wins.

Rules are a trie over reversed host labels; the node of a rule's host holds a trie over path segments. A rule of host and
path fits that host and all its subdomains where the path of the url starts with the rule's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES, BROADCAST_BYTES = 200_000, 16 << 20
RULES = "host string, path string, verdict string"


def _rest(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substr(url, place + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def build(rules: list[tuple[str, str, str]]) -> dict:
    """The trie: ``{"next": {label: node}, "paths": path node}``; a path node has ``next`` and ``tails``.

    A path is cut after each slash; its last part (often empty) is a tail, which any continuation may follow.
    """
    root: dict = {"next": {}}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}})
        node = node.setdefault("paths", {"next": {}, "tails": []})
        *folders, tail = path.split("/")
        for folder in folders:
            node = node["next"].setdefault(folder, {"next": {}, "tails": []})
        node["tails"].append((tail, host + path, len(host), verdict))
    return root


def find(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest fitting rule, of equally long ones that of the longer host; else (None, None)."""
    best: tuple = (-1, 0, None, None)
    node: dict | None = trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        at, branch = 0, node.get("paths")
        while branch is not None:
            for tail, rule, size, verdict in branch["tails"]:
                if path.startswith(tail, at):
                    best = max(best, (len(rule), size, rule, verdict), key=lambda x: x[:2])
            slash = path.find("/", at)
            branch = branch["next"].get(path[at:slash]) if slash >= 0 else None
            at = slash + 1
    return best[2:]


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(trie.value, h, p) for h, p in zip(host, path)], columns=["rule", "verdict"])

    return pages.withColumn("_found", judge("host", "path"))


def _by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answer for rules of any number: every (host suffix, folder) of an url is looked up by an equi-join."""
    keyed = rules.select("host", F.regexp_extract("path", "^(.*/)?", 0).alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("tail"), "path", "verdict")
    urls = pages.select("host", "path").distinct().withColumnRenamed("path", "url_path").withColumnRenamed("host", "url_host")
    labels, parts = F.split("url_host", "\\."), F.split("url_path", "/")
    asked = (urls.withColumn("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
             .withColumn("n", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
             .withColumn("folder", F.when(F.col("n") > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"), F.lit("/"))).otherwise("")))
    fits = asked.join(keyed, ["host", "folder"]).where(F.startswith("url_path", "path"))
    best = fits.groupBy("url_host", "url_path").agg(F.max_by(
        F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(F.length("host") + F.length("path"), F.length("host"))).alias("_found"))
    same = (pages.host == best.url_host) & (pages.path == best.url_path)
    return pages.join(best, same, "left").drop("url_host", "url_path")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (``host`` + ``path`` of the rule, else null) and verdict (the rule's, else ``default``).

    ``rules`` are (host, path, verdict); rows with a null are ignored. Of rules of one host and path
    the last verdict by name holds, so that block goes before allow. Rules that a count shows
    to be few and small are broadcast as a trie; more of them are joined by host suffix and folder, with equal results.
    Null urls and urls without ``://`` have an empty host and path. Other columns of ``pages`` are not carried.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("b")).first()
    narrow = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if size.n <= BROADCAST_RULES and size.b <= BROADCAST_BYTES:
        judged = _by_trie(narrow, [tuple(r) for r in rules.collect()])
    else:
        judged = _by_join(narrow, rules)
    return judged.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))
