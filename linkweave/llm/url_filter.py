"""URL filtering with a trie over reversed host labels and path segments.

The trie is broadcast: at most ``MAX_RULES`` rules of ``MAX_RULE_CHARS``
characters each. Longer lists go through ``filter_urls_join``, which joins each
url's host suffixes with the rule table and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import output, session

MAX_RULES = 100_000
MAX_RULE_CHARS = 2_000
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    action: str
    host: str
    path: str


@dataclass
class _Segment:
    #: Rules that end inside the next segment, by the text the segment has to begin with.
    tails: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    next: dict[str, _Segment] = field(default_factory=dict)


@dataclass
class _Label:
    next: dict[str, _Label] = field(default_factory=dict)
    any_path: Rule | None = None
    paths: _Segment | None = None


def _stronger(new: Rule, old: Rule | None) -> Rule:
    """Of two entries for the same host and path the blocking one holds."""
    return old if old is not None and old.action == BLOCK else new


def build_trie(rules: Iterable[Rule]) -> _Label:
    """The trie of ``rules``; a path is empty or begins with a slash."""
    root, rules = _Label(), [Rule(*r) for r in rules]
    if len(rules) > MAX_RULES or any(len(r.host) + len(r.path) > MAX_RULE_CHARS for r in rules):
        raise ValueError("too many or too long rules to broadcast; use filter_urls_join")
    for rule in rules:
        if rule.action not in (ALLOW, BLOCK) or not rule.host or rule.path[:1] not in ("", "/"):
            raise ValueError(f"bad rule {rule}")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.next.setdefault(label, _Label())
        if not rule.path:
            node.any_path = _stronger(rule, node.any_path)
            continue
        segment = node.paths = node.paths or _Segment()
        *whole, tail = rule.path[1:].split("/")
        for part in whole:
            segment = segment.next.setdefault(part, _Segment())
        segment.tails[tail] = _stronger(rule, segment.tails.get(tail))
        segment.lengths = sorted({*segment.lengths, len(tail)}, reverse=True)
    return root


def _longest_path(segment: _Segment | None, path: str) -> Rule | None:
    found = None
    if segment is None or not path.startswith("/"):
        return None
    for part in path[1:].split("/"):
        for n in segment.lengths:
            if len(part) >= n and (rule := segment.tails.get(part[:n])):
                found = rule
                break
        if part not in segment.next:
            break
        segment = segment.next[part]
    return found


def longest_match(trie: _Label, host: str, path: str) -> Rule | None:
    """The fitting rule with the most host labels, then the longest path."""
    found, node = None, trie
    for label in reversed(host.split(".")):
        if (node := node.next.get(label)) is None:
            break
        found = _longest_path(node.paths, path) or node.any_path or found
    return found


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: both empty for a null url or one without ``://``."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: the id, ``host``, ``path``, ``rule`` (host and path of the winner, else null), ``verdict``.

    A rule fits its host and all subdomains when the path begins with the
    rule's path; most host labels win, then the longest path, then block.
    Without a fitting rule, also for null and malformed urls, the verdict is
    ``default``. Repeated rows each get a row; null ids are kept; columns
    named host, path, rule or verdict in the input are not used.
    """
    spark = session(pages)
    trie = spark.sparkContext.broadcast(build_trie(rules))
    parts = with_host_path(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url").select("__id", "host", "path")
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            found = [longest_match(root, h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            schema = pa.schema([*batch.schema, ("rule", pa.string()), ("verdict", pa.string())])
            yield output(schema, __id=batch.column(0), host=batch.column(1), path=batch.column(2), rule=[r and r.host + r.path for r in found], verdict=[r.action if r else default for r in found])

    judged = parts.mapInArrow(judge, f"__id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("__id", id_col)


def filter_urls_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same rows as ``filter_urls`` for a rule table (``action, host, path``) of any size.

    Each distinct host and path meets the rules of its host suffixes in an
    equi-join; the best fitting rule is a map-side combined maximum.
    """
    urls = with_host_path(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url").select("__id", "host", "path")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    table = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action").distinct()
    rank = F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"), F.col("action") == BLOCK)
    best = each.join(table, "suffix").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), "action"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
