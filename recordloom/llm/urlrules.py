"""URL filters: a trie over reversed host labels and path segments, the longest rule deciding.

A rule is (verdict, host, path).  It fits its host and all subdomains of it
where the URL's path starts with the rule's.  Of the rules that fit, the one of
the most host labels wins, then the one of the longest path, then block before
allow.  The trie goes to every task, so the rules in one are bounded, by number
and by characters; more rules make more tries, and each URL passes all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules in one trie, and their characters.
BLOCK_RULES, BLOCK_CHARACTERS = 200_000, 16 << 20
DEFAULT = "allow"

#: The rules that the query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_COLUMNS = ["host", "path", "rule", "verdict"]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes are dicts: by host label, then under None by whole path segment, and under "" by what a segment starts with, with the lengths of these under 0."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, start = path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        ends = node.setdefault("", {})
        if ends.get(start, ("", "allow"))[1] == "allow":
            ends[start] = (host + path, verdict)
            node.setdefault(0, set()).add(len(start))
    return root


def match(root: dict, host: str, path: str) -> tuple[int, int, str | None, str | None]:
    """Host labels, path length, rule and verdict of the longest rule that fits; (-1, -1, None, None) if none does."""
    best = (-1, -1, None, None)
    node, segments = root, path.split("/")
    for depth, label in enumerate(reversed(host.split("."))):
        node = node.get(label)
        if node is None:
            break
        at, length = node.get(None), 0
        for i, segment in enumerate(segments):
            if at is None:
                break
            # one look-up for each length that a rule has here, however many rules there are
            ends = at.get("")
            for n in at.get(0, ()):
                if n <= len(segment) and (depth, length + n) > best[:2] and (end := ends.get(segment[:n])):
                    best = (depth, length + n, *end)
            at = at.get("/" + segment) if i + 1 < len(segments) else None
            length += len(segment) + 1
    return best


def _blocks(rules: list[tuple[str, str, str]], most: int) -> list[list[tuple[str, str, str]]]:
    out: list[list] = [[]]
    size = 0
    for rule in rules:
        size += len(rule[1]) + len(rule[2]) + 64
        if len(out[-1]) == most or (out[-1] and size > BLOCK_CHARACTERS):
            out.append([])
            size = len(rule[1]) + len(rule[2]) + 64
        out[-1].append(rule)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url", default: str = DEFAULT, block_rules: int = BLOCK_RULES) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; columns of these names are replaced.

    Null URLs and those without :// have an empty host and path and get the
    default verdict.  Repeated rules count once; an empty table stays empty.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    names = [f for f in pages.schema if f.name not in _COLUMNS]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    out = pages.select(*[F.col(f"`{f.name}`") for f in names])
    for number, block in enumerate(_blocks(rules, block_rules)):
        shared = spark.sparkContext.broadcast(trie(block))

        def judge(batches, shared=shared, first=number == 0):
            for batch in batches:
                kept = [n for n in batch.schema.names if not n.startswith("__")]
                urls = [host_and_path(u) for u in batch.column(batch.schema.get_field_index(url_col)).to_pylist()]
                found = [match(shared.value, h, p) for h, p in urls]
                if not first:
                    old = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("__depth", "__length", "__rule", "__verdict")))
                    found = [max(a, b, key=lambda x: (x[0], x[1], x[3] == "block")) for a, b in zip(old, found)]
                columns = [*zip(*urls)] or [(), ()]
                columns += [*zip(*found)] or [(), (), (), ()]
                arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept]
                arrays += [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "__host", "__path", "__depth", "__length", "__rule", "__verdict"])

        out = out.mapInArrow(judge, f"{fields}, __host string, __path string, __depth int, __length int, __rule string, __verdict string")
    return out.select(*[F.col(f"`{f.name}`") for f in names], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM part, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM part LEFT JOIN fit USING (page_id)
"""
