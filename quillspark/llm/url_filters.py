"""URL filters: rules by host and path, and a tree of path templates for what no rule judges.

Segments of a path first lose what varies by its looks: numbers, hexadecimal names, very long names. Then the tree of a host is
grown level by level from counts: a segment that too few of the host's urls share below its node becomes a wildcard, and all such
segments of a node are one branch from there on. So a tree has a bounded number of nodes however many urls its host has, and
all but the last step are joins and sums over distinct paths. In a last step, one tree after another, branches of a node merge
where no share differs by more than Hoeffding's bound allows: of labels, of paths that end there, of each branch below, down to
the leaves. A template is blocked if (blocked + 1) / (labelled + 2) of its urls reaches a threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written

ALLOW, BLOCK = "allow", "block"
#: What a segment loses by its looks, in this order.
SHAPES = [
    (r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])", "{uuid}"),
    (r"(?<![0-9A-Za-z])[0-9]+(?![0-9A-Za-z])", "{n}"),
    (r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{hex}"),
    (r"[0-9]+", "{n}"),
]
#: A longer segment is variable by its looks; segments from this level on are one, which stands for all of them.
LONG, DEPTH = 64, 8
#: A segment stays if so many urls share it below its node, and one in this many of the host's.
SUPPORT, SHARE = 8, 256
#: What smoothed purity blocks a template, and the chance of keeping apart two branches that are alike, for each share compared.
PURITY, DELTA = 0.8, 0.05
#: A wildcard: no path holds this.
WILD = "?"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark or hash, with A to Z in lower case; empty if there is none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after(url), "\\A[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What stands from there up to a question mark or hash."""
    return F.regexp_extract(_after(url), "\\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def fitting(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules with one host and path, the first
    stands. Rules become part of the plan: this is for hundreds of them.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shaped(path: Column) -> Column:
    """The segments of a path without what varies by its looks; empty ones are left out, and those from DEPTH on are one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        out = s
        for pattern, told in SHAPES:
            out = F.regexp_replace(out, pattern, told)
        return F.when(F.length(s) > LONG, "{long}").otherwise(out)

    segments = F.transform(segments, shape)
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH - 1), F.array(F.lit("{more}")))).otherwise(segments)


@dataclass
class Node:
    """Of the urls below a node, and of those that end there: how many, blocked and allowed; the templates that end there."""

    total: list[int] = field(default_factory=lambda: [0, 0, 0])
    ends: list[int] = field(default_factory=lambda: [0, 0, 0])
    told: list[str] = field(default_factory=list)
    below: dict[str, Node] = field(default_factory=dict)

    def add(self, other: Node) -> None:
        self.total = [a + b for a, b in zip(self.total, other.total)]
        self.ends = [a + b for a, b in zip(self.ends, other.ends)]
        self.told += other.told
        for name, node in other.below.items():
            self.below.setdefault(name, Node()).add(node)

    def shares(self) -> dict[str, int]:
        return {"": self.ends[0], "\tblocked": self.total[1], "\tallowed": self.total[2], **{name: n.total[0] for name, n in self.below.items()}}


def similar(a: Node, b: Node) -> bool:
    """No share of the two differs by more than chance would have it, at any level that both have."""
    n, m = a.total[0], b.total[0]
    most = math.sqrt(0.5 * math.log(2 / DELTA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    mine, theirs = a.shares(), b.shares()
    if any(abs(mine.get(name, 0) / n - theirs.get(name, 0) / m) > most for name in mine.keys() | theirs.keys()):
        return False
    return all(similar(a.below[name], b.below[name]) for name in a.below.keys() & b.below.keys())


def merged(node: Node, template: str = "") -> list[tuple[str, Node]]:
    """All templates of a tree, each with its node, after branches that are alike have become one, from the root downwards."""
    groups: list[tuple[list[str], Node]] = []
    for name, child in sorted(node.below.items(), key=lambda x: (-x[1].total[0], x[0])):
        for names, group in groups:
            if similar(group, child):
                names.append(name)
                group.add(child)
                break
        else:
            groups.append(([name], Node()))
            groups[-1][1].add(child)
    out = [(template or "/", node)] if node.ends[0] else []
    for names, group in groups:
        out += merged(group, f"{template}/{'|'.join(sorted(names)).replace(WILD, '*')}")
    return out


def purity(blocked: int, allowed: int) -> float:
    return (blocked + 1) / (blocked + allowed + 2)


_TREE = "key string, template string, purity double"


def judged_tree(leaves: pd.DataFrame) -> pd.DataFrame:
    """The templates of one host (host, node, n, blocked, allowed), each with what it has merged into and that one's purity."""
    root = Node()
    for name, n, blocked, allowed in zip(leaves["node"].tolist(), leaves["n"].tolist(), leaves["blocked"].tolist(), leaves["allowed"].tolist()):
        at, counts = root, [n, blocked, allowed]
        at.total = [a + b for a, b in zip(at.total, counts)]
        for segment in name.split("/")[1:]:
            at = at.below.setdefault(segment, Node())
            at.total = [a + b for a, b in zip(at.total, counts)]
        at.ends = counts
        at.told = [name]
    host = leaves["host"].iloc[0]
    rows = [(host + name, template, purity(*node.ends[1:])) for template, node in merged(root) for name in node.told]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _TREE.split(", ")])


def path_templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, label) to a row for each of their hosts' distinct shaped paths: key (host/shaped path), template, purity.

    label is "allow", "block" or anything else, which tells nothing. A host's tree is of bounded size before it meets one task.
    """
    segments = shaped(F.col("path"))
    count = lambda label: F.count_if(F.col("label") == label)
    paths = urls.groupBy("host", segments.alias("segments")).agg(F.count(F.lit(1)).alias("n"), count(BLOCK).alias("blocked"), count(ALLOW).alias("allowed"))
    paths = written(paths.select("*", F.lit("").alias("node")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n")), "hosts")
    paths = looked_up(paths, hosts, "host")
    depth = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(depth):
        there = F.size("segments") > level
        segment = F.get("segments", F.lit(level))
        paths = written(paths.withColumn("branch", F.when(there, F.concat("host", "node", F.lit("/"), segment))), "level")
        counts = paths.where(there).groupBy("branch").agg(F.sum("n").alias("branch_n"), F.max("host_n").alias("host_n"))
        stays = written(counts.where((F.col("branch_n") >= SUPPORT) & (F.col("branch_n") * SHARE >= F.col("host_n"))).select("branch", F.lit(True).alias("stays")), "branches")
        found = looked_up(paths, stays, "branch")
        node = F.when(there, F.concat("node", F.lit("/"), F.when(F.col("stays"), segment).otherwise(F.lit(WILD)))).otherwise(F.col("node"))
        paths = found.withColumn("node", node).drop("branch", "stays")
    paths = written(paths.withColumn("leaf", F.concat("host", "node")), "leaves")
    leaves = paths.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
    trees = written(leaves.groupBy("host").applyInPandas(judged_tree, _TREE).withColumnRenamed("key", "leaf"), "trees")
    return looked_up(paths, trees, "leaf").select(F.concat("host", F.lit("/"), F.array_join("segments", "/")).alias("key"), "template", "purity")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], label: str | None = None, threshold: float = PURITY) -> DataFrame:
    """Every page's verdict: page_id, host, path, rule, verdict, template, purity.

    pages: page_id, url and, if label names it, a column of labels "allow" and "block"; other columns are ignored. The longest rule
    that fits decides (see fitting). Where none does, the template of the url's path decides: it is blocked if its purity, smoothed
    by one url of either kind, reaches the threshold. Without a column of labels, the verdicts of rules are the labels: templates
    carry them on to urls of the same form that the rules leave open. A url that is null or has no :// has an empty host and
    path, and these are a host and a path like others. Repeated rows are judged each; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    told = pages.select("page_id", host.alias("host"), path.alias("path"), *([F.col(label).alias("label")] if label else []))
    told = told.withColumn("by", fitting(rules, F.col("host"), F.col("path")))
    told = told.select("page_id", "host", "path", "by.rule", "by.verdict", F.col("label") if label else F.col("by.verdict").alias("label"))
    key = F.concat("host", F.lit("/"), F.array_join(shaped(F.col("path")), "/"))
    told = written(told.withColumn("key", F.when(F.col("rule").isNull(), key)), "urls")
    unruled = told.where(F.col("rule").isNull())
    templates = written(path_templates(told), "templates")
    found = looked_up(unruled, templates, "key")
    verdict = F.when(F.col("purity") >= threshold, BLOCK).otherwise(ALLOW)
    ruled = told.where(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    return ruled.unionByName(found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))
