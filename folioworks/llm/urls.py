"""URL filters by a sort-merge range join.

A url's host is what stands between its first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
its path goes on to ``?``, ``#`` or the end. Turned round by label, ``blog.example.org`` becomes the key
``org.example.blog.``, so that a rule's host and all its subdomains are one interval of keys, and intervals of rules
nest. Urls are range-partitioned and sorted by key (and id, so that one host fills many partitions); each partition
sweeps its urls and the rules together, with a stack of the rules whose intervals are open. Of the open rules whose
path the url's path starts with, the one with the longest host wins, then the longest path.

Rules reach the executors in sorted blocks of at most ``BLOCK_RULES``; more rules mean more sweeps, and the longest of
all sweeps wins.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule. Where no rule fits,
the verdict is the method's own: ``block`` for an empty host, else ``allow``. Rules with a null host or path, or with
a verdict other than allow or block, are ignored; of equal rules the blocking one holds. Repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import conf_int

BLOCK_RULES = 200_000
# The rules of the registered query, as host, path and verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return lower_ascii(host), path


def _key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


class Rules:
    """Host keys in order, each with its path rules, longest path first."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            own = by_host.setdefault(_key(host), {})
            if own.get(path, ("", "allow"))[1] == "allow":
                own[path] = (host + path, verdict)
        self.keys = sorted(by_host)
        self.paths = [sorted(((p, *r) for p, r in by_host[k].items()), key=lambda x: -len(x[0])) for k in self.keys]


class Sweep:
    """The state of one pass over urls in order of key: the rules come in as their intervals open."""

    def __init__(self, rules: Rules):
        self.rules, self.stack, self.ahead = rules, [], 0

    def fit(self, key: str, path: str) -> tuple[str | None, str | None, int, int]:
        """The longest fitting rule, its verdict, and the lengths it is ranked by."""
        keys, stack = self.rules.keys, self.stack
        while self.ahead < len(keys) and keys[self.ahead] <= key:
            while stack and not keys[self.ahead].startswith(keys[stack[-1]]):
                stack.pop()
            stack.append(self.ahead)
            self.ahead += 1
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        for k in reversed(stack):
            for prefix, rule, verdict in self.rules.paths[k]:
                if path.startswith(prefix):
                    return rule, verdict, len(keys[k]), len(prefix)
        return None, None, -1, -1


def _blocks(rules: DataFrame, most: int) -> Iterator[Rules]:
    held: list[tuple[str, str, str]] = []
    for row in rules.toLocalIterator():
        held.append(tuple(row))
        if len(held) >= most:
            yield Rules(held)
            held = []
    if held:
        yield Rules(held)


def judge_urls(pages: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages(page_id, url)`` under ``rules(host, path, verdict)``."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))
    urls = urls.withColumn("key", key).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    urls = urls.withColumn("h", F.lit(-1)).withColumn("p", F.lit(-1))
    usable = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict in ('allow', 'block')")
    usable = usable.withColumn("host", lower_ascii(F.col("host")))
    sort_key = ("key", "path", "page_id")
    urls = urls.repartitionByRange(max(1, conf_int(spark, "spark.sql.shuffle.partitions", 200)), *sort_key).sortWithinPartitions(*sort_key)
    schema = urls.schema
    for block in _blocks(usable, block_rules):
        shared = spark.sparkContext.broadcast(block)

        def sweep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pass_over = Sweep(shared.value)
            for batch in batches:
                before = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "rule", "verdict", "h", "p")), strict=True)
                best = [max(tuple(old), pass_over.fit(key, path), key=lambda x: (x[2], x[3], x[1] == "block")) for key, path, *old in before]
                new = [pa.array([b[i] for b in best], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "key")), *new], ["page_id", "host", "path", "key", "rule", "verdict", "h", "p"])

        urls = urls.mapInArrow(sweep, schema)
    own = F.when(F.col("host") == "", "block").otherwise("allow")
    return urls.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))
