"""URL filters against plain Python: rules, the tree of templates level by level, merging and purity."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import url_filters as U  # noqa: E402
from quillspark.llm.queries import URL_RULES  # noqa: E402

PAGES = "page_id long, url string, label string, host int, key string, rule string, node string, n int"


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(rules, host, path):
    fits = [(at + start, verdict) for verdict, at, start in rules if (host == at or host.endswith("." + at)) and path.startswith(start)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def shape(path):
    out = []
    for s in path.split("/"):
        if s:
            t = re.sub(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])", "{uuid}", s)
            t = re.sub(r"(?<![0-9A-Za-z])[0-9]+(?![0-9A-Za-z])", "{n}", t)
            t = re.sub(r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{hex}", t)
            t = re.sub(r"[0-9]+", "{n}", t)
            out.append("{long}" if len(s) > U.LONG else t)
    return tuple(out[: U.DEPTH - 1] + ["{more}"] if len(out) > U.DEPTH else out)


def plain(pages, rules, labelled=False):
    """Per host: counts of prefixes, wildcards level by level, then branches merged by sets of urls, with no tree of nodes."""
    told = [(p, *parted(url), label) for p, url, label, *_ in pages]
    told = [(p, host, path, ruled(rules, host, path), label) for p, host, path, label in told]
    by = collections.defaultdict(list)
    for i, (_, host, path, (_, verdict), label) in enumerate(told):
        by[host].append((shape(path), label if labelled else verdict, i))
    found = {}
    for host, rows in by.items():
        paths = {i: [] for _, _, i in rows}
        for level in range(max(len(s) for s, _, _ in rows)):
            count = collections.Counter((*paths[i], s[level]) for s, _, i in rows if len(s) > level)
            for s, _, i in rows:
                if len(s) > level:
                    n = count[(*paths[i], s[level])]
                    paths[i] = [*paths[i], s[level] if n >= U.SUPPORT and n * U.SHARE >= len(rows) else "?"]
        merge([(tuple(paths[i]), label, i) for _, label, i in rows], "", found)
    out = collections.Counter()
    for i, (p, host, path, (rule, verdict), _) in enumerate(told):
        if rule is None:
            template, purity = found[i]
            out[(p, host, path, None, "block" if purity >= U.PURITY else "allow", template, round(purity, 9))] += 1
        else:
            out[(p, host, path, rule, verdict, None, None)] += 1
    return out


def alike(a, b):
    n, m = len(a), len(b)
    most = math.sqrt(0.5 * math.log(2 / U.DELTA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    share = lambda rows: collections.Counter([("ends",) if not s else ("below", s[0]) for s, _, _ in rows] + [("label", y) for _, y, _ in rows if y in ("allow", "block")])
    x, y = share(a), share(b)
    if any(abs(x[k] / n - y[k] / m) > most for k in x.keys() | y.keys()):
        return False
    heads = {s[0] for s, _, _ in a if s} & {s[0] for s, _, _ in b if s}
    below = lambda rows, h: [(s[1:], y, i) for s, y, i in rows if s and s[0] == h]
    return all(alike(below(a, h), below(b, h)) for h in heads)


def merge(rows, template, found):
    ends = [(y, i) for s, y, i in rows if not s]
    block, allow = (sum(y == v for y, _ in ends) for v in ("block", "allow"))
    for _, i in ends:
        found[i] = (template or "/", (block + 1) / (block + allow + 2))
    heads = collections.Counter(s[0] for s, _, _ in rows if s)
    groups = []
    for head, _ in sorted(heads.items(), key=lambda x: (-x[1], x[0])):
        below = [(s[1:], y, i) for s, y, i in rows if s and s[0] == head]
        for names, group in groups:
            if alike(group, below):
                names.append(head)
                group += below
                break
        else:
            groups.append(([head], below))
    for names, group in groups:
        merge(group, f"{template}/{'|'.join(sorted(names)).replace('?', '*')}", found)


def told(df):
    return collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"] if r["purity"] is None else round(r["purity"], 9)) for r in df.collect())


def odd_pages():
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://com", "ftp://a.com?x/en/", "HTTP://Www.Example.COM/en/a", "x://a://b.example.com/en/", "http://example.com/en", "http://ÄB.net/es/1", "http://a.net/es/?q", "http://a.net#/fr/", "http://notexample.com/en/", "http://u@a.com:80/é/x"]
    urls += [f"http://big.org/{rng.choice(['en', 'de'])}/{rng.randrange(999)}{rng.choice(['', '.html', '/'])}" for _ in range(600)]
    urls += [f"http://big.org/user/{''.join(rng.choices('abcdefgh', k=9))}/{rng.choice(['posts', 'likes'])}/{i}" for i in range(300)]
    urls += [f"http://s.net/{rng.choice(['es', 'en'])}/x{i}" for i in range(12)]
    urls += [f"http://deep.org/{'/'.join('abcdefghijkl'[: i % 12])}" for i in range(60)]
    urls += [f"http://hex.org/{rng.getrandbits(128):032x}/{'w' * (60 + i)}/1234-5678?{i}" for i in range(20)]
    urls += [f"http://wild.org/*/{{n}}/{i}" for i in range(20)]
    rows = [(i, u, rng.choice(["allow", None, "odd"]) if u is None or "user" not in u else rng.choice(["block", "block", None]), 1, "k", "r", "n", 0) for i, u in enumerate(urls)]
    return rows + rows[:30] + [(None, "http://x.org/a", None, 1, "k", "r", "n", 0)]


def test_verdicts(spark):
    rows = odd_pages()
    data = spark.createDataFrame(rows, PAGES).repartition(4)
    assert told(U.judge_urls(data, URL_RULES)) == plain(rows, URL_RULES)
    own = told(U.judge_urls(data, URL_RULES, label="label"))
    assert own == plain(rows, URL_RULES, labelled=True)
    assert {r[4] for r in own if r[1] == "big.org" and "/user/" in r[2]} == {"block"} and {r[4] for r in own if r[1] == "big.org" and "/user/" not in r[2]} == {"allow"}
    assert {r[5] for r in own if r[1] == "big.org" and "/user/" in r[2]} == {"/user/*/likes|posts/{n}"}
    assert U.judge_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
    assert told(U.judge_urls(data, [])) == plain(rows, [])


def test_a_bounded_tree(spark):
    """A hundred thousand urls of one host, no two alike: few templates reach the last step."""
    data = spark.range(100_000).selectExpr("id as page_id", "concat('http://a.org/', translate(hex(id), '0123456789', 'ghijklmnop'), '/', case when id % 2 = 0 then 'x' else 'y' end) as url")
    got = U.judge_urls(data, []).groupBy("template", "verdict").count().collect()
    assert [(r["template"], r["verdict"], r["count"]) for r in got] == [("/*/x|y", "allow", 100_000)]


def test_the_longest_rule_wins_in_any_order(spark):
    rules = [("allow", "com", "/"), ("block", "b.com", "/x"), ("allow", "a.b.com", "/x")]
    urls = spark.createDataFrame([("http://a.b.com/xy",), ("http://z.b.com/x",), ("http://b.com/y",), ("http://bb.com/x",), ("http://com",)], "url string").coalesce(1)
    host, path = U.host_of(F.col("url")), U.path_of(F.col("url"))
    for order in itertools.permutations(rules):
        got = urls.select(U.fitting(list(order), host, path).alias("by")).select("by.*").collect()
        assert [tuple(r) for r in got] == [("a.b.com/x", "allow"), ("b.com/x", "block"), ("com/", "allow"), ("com/", "allow"), (None, None)]
