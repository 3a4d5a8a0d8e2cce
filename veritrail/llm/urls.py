"""URL filters: sorted 64-bit digests, memory-mapped, probed by binary search, confirmed on the stored strings.

A rule is a host with a path prefix and a verdict. All rules are stored as one folder of two files: the sorted xxhash
digests of their strings, and the strings in the same order. Spark hands the folder's files to the executors, which map
them. A URL's candidate strings are its host and every parent domain joined with its path cut to each length that
occurs among the rules' paths; a candidate counts only if the string stored beside its digest is equal, so colliding
digests never decide. The longest fitting rule wins; between two of a length, the longer host.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end. A null
URL or one without "://" has both empty and fits no rule.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict), looked up first.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The method's own list, of hosts with all their subdomains, for URLs that no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Rules and hosts that go to every executor as files, about 60 bytes each; a table of more is joined.
MOST_RULES = 20_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _digests(keys: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


class DigestArray:
    """Sorted digests in a file, with each key's string and value in another; open() maps them."""

    def __init__(self, folder: str | Path, name: str):
        self.digests = np.load(f"{folder}/{name}.digests.npy", mmap_mode="r")
        self.bytes = np.memmap(f"{folder}/{name}.strings", np.uint8, "r") if len(self.digests) else np.zeros(0, np.uint8)
        self.ends = np.load(f"{folder}/{name}.ends.npy", mmap_mode="r")

    @staticmethod
    def write(values: dict[str, str], folder: str | Path, name: str) -> list[str]:
        keys = list(values)
        digests = _digests(keys)
        order = np.argsort(digests, kind="stable")
        rows = [f"{keys[k]}\n{values[keys[k]]}".encode() for k in order]
        np.save(f"{folder}/{name}.digests.npy", digests[order])
        np.save(f"{folder}/{name}.ends.npy", np.cumsum([0, *map(len, rows)]))
        Path(f"{folder}/{name}.strings").write_bytes(b"".join(rows))
        return [f"{folder}/{name}.{x}" for x in ("digests.npy", "ends.npy", "strings")]

    def find(self, keys: list[str]) -> list[str | None]:
        """The value of each key, None where it isn't stored."""
        digests = _digests(keys)
        at, stop = (np.searchsorted(self.digests, digests, side) for side in ("left", "right"))
        out: list[str | None] = [None] * len(keys)
        for k in np.nonzero(at < stop)[0]:
            for row in range(at[k], stop[k]):  # several only where digests collide
                key, _, value = bytes(self.bytes[self.ends[row] : self.ends[row + 1]]).decode().rpartition("\n")
                if key == keys[k]:
                    out[k] = value
        return out


def _candidates(host: str, path: str, lengths: list[int]) -> Iterator[tuple[str, str]]:
    """(host, path prefix) that a rule may name, the longest strings first."""
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))] if host else []
    yield from sorted(((h, path[:n]) for h in hosts for n in lengths if n <= len(path)), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> DataFrame:
    """pages with columns host, path, rule (host and path of the deciding rule or null) and verdict ("allow" or "block").

    URLs that no rule fits are blocked if the host or a parent domain is among blocked_hosts. Rows, ties and repeated URLs
    stay as they are; columns of these names are replaced. rules are (host, path, verdict) and blocked_hosts names, or both are tables
    with columns of these names (host, path, verdict; host), of any size: what has more rows than MOST_RULES is joined.
    """
    if isinstance(rules, DataFrame) or isinstance(blocked_hosts, DataFrame):
        spark = pages.sparkSession
        rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
        blocked_hosts = blocked_hosts if isinstance(blocked_hosts, DataFrame) else spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
        if rules.count() + blocked_hosts.count() > MOST_RULES:
            return _judged_by_joins(pages, url, rules, blocked_hosts)
        rules, blocked_hosts = [tuple(r) for r in rules.select("host", "path", "verdict").collect()], [r.host for r in blocked_hosts.collect()]
    context = pages.sparkSession.sparkContext
    folder = tempfile.mkdtemp(prefix="urlrules")
    name = Path(folder).name
    stored = {h + p: v for h, p, v in rules}
    if len(stored) < len({(h, p) for h, p, _ in rules}):
        raise ValueError("two rules make one string")
    files = [*DigestArray.write(stored, folder, f"{name}-rules"), *DigestArray.write(dict.fromkeys(blocked_hosts, "block"), folder, f"{name}-hosts")]
    for file in files:
        context.addFile(file)
    lengths = sorted({len(p) for _, p, _ in rules})

    @F.arrow_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        at = SparkFiles.getRootDirectory()
        own, listed = DigestArray(at, f"{name}-rules"), DigestArray(at, f"{name}-hosts")
        for hosts, paths in batches:
            rule, verdict = judged(hosts.to_pylist(), paths.to_pylist(), own, listed, lengths)
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumn("verdict", judge("host", "path"))
    return out.withColumn("rule", F.col("verdict.rule")).withColumn("verdict", F.col("verdict.verdict"))


def judged(hosts: list[str], paths: list[str], own: DigestArray, listed: DigestArray, lengths: list[int]) -> tuple[list[str | None], list[str]]:
    owner, keys = [], []
    parents_owner, parents = [], []
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for h, p in _candidates(host, path, lengths):
            owner.append(k)
            keys.append(h + p)
        labels = host.split(".")
        for j in range(len(labels) if host else 0):
            parents_owner.append(k)
            parents.append(".".join(labels[j:]))
    rule: list[str | None] = [None] * len(hosts)
    verdict: list[str | None] = [None] * len(hosts)
    for k, key, value in zip(owner, keys, own.find(keys), strict=True):
        if value and verdict[k] is None:
            rule[k], verdict[k] = key, value
    bad = {k for k, value in zip(parents_owner, listed.find(parents), strict=True) if value}
    return rule, [v or ("block" if k in bad else "allow") for k, v in enumerate(verdict)]


def _judged_by_joins(pages: DataFrame, url: str, rules: DataFrame, blocked_hosts: DataFrame) -> DataFrame:
    """judge_urls by equi-joins of the rules that each distinct host and path may meet."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    places = out.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = F.when(F.col("host") != "", parents).otherwise(F.array().cast("array<string>"))
    lengths = rules.select(F.length("path").alias("n")).distinct().groupBy().agg(F.sort_array(F.collect_set("n")).alias("lengths"))  # one row of path lengths
    may = places.join(F.broadcast(lengths)).withColumn("h", F.explode(hosts))
    may = may.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p"))
    named = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("ruled"))
    size = F.struct(F.length("h") + F.length("p"), F.length("h"))
    best = may.join(named, ["h", "p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "ruled"), size).alias("best"))
    listed = places.select("host").distinct().withColumn("h", F.explode(hosts)).join(blocked_hosts.select(F.col("host").alias("h")).distinct(), "h", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
    judged_places = places.join(best, ["host", "path"], "left").join(listed, "host", "left")
    verdict = F.coalesce("best.ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    judged_places = judged_places.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"))
    return out.join(judged_places, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))).drop("__host", "__path")
