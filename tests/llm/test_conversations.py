"""Conversation repair against a search of all edits, on every signature up to six rows and on odd tables."""

import collections
import hashlib
import heapq
import itertools
import re
import zlib

import duckdb
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import conversations as C  # noqa: E402

FORM = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of rows (initial, goes, truncated, role, text): edits tried cheapest first, then by their initials."""
    heap, seen = [(0, "", "", 0, ())], set()
    while heap:
        cost, audit, said, i, lines = heapq.heappop(heap)
        if i == len(rows) and FORM.fullmatch(said):
            return cost, audit, list(lines)
        if (said[-1:], said == "", i, audit) in seen or cost > 3 * len(rows):
            continue
        seen.add((said[-1:], said == "", i, audit))
        for c, role in (("u", "user"), ("a", "assistant")):
            if allowed(said, c):
                heapq.heappush(heap, (cost + 2, audit + "I", said + c, i, (*lines, f"{role}:")))
        if i < len(rows):
            initial, goes, truncated, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", said, i + 1, lines))
            if not goes:
                if allowed(said, initial):
                    heapq.heappush(heap, (cost + truncated, audit + "K", said + initial, i + 1, (*lines, f"{role}:{text}")))
                for c, other in (("u", "user"), ("a", "assistant")):
                    if allowed(said, c):
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", said + c, i + 1, (*lines, f"{other}:{text}")))


def allowed(said, c):
    return c != "" and c in {"": "su", "s": "u", "u": "a", "a": "u"}[said[-1:]]


def test_every_short_signature():
    kinds = [(0, "x", 1, 0), *((2 * r + t + 1, "suax"[r], 0, t) for r in range(4) for t in (0, 1))]
    for n in range(4):
        signatures = sorted(itertools.product(kinds, repeat=n), key=lambda s: bytes(k[0] for k in s))
        trie = C.Trie()
        for s, (cost, audit) in zip(signatures, trie.answers(bytes(k[0] for k in s) for s in signatures)):
            assert (cost, audit) == cheapest([(i, g, t, i, "") for _, i, g, t in s])[:2], s
        assert n < 2 or trie.made < 0.7 * trie.asked


def test_longer_signatures():
    some = [(0, "x", 1, 0), (1, "s", 0, 0), (3, "u", 0, 0), (6, "a", 0, 1), (5, "a", 0, 0), (7, "x", 0, 0)]
    signatures = sorted(list(itertools.product(some, repeat=5))[::7] + list(itertools.product(some[1:5], repeat=6))[::11], key=lambda s: bytes(k[0] for k in s))
    for s, told in zip(signatures, C.Trie().answers(bytes(k[0] for k in s) for s in signatures)):
        assert told == cheapest([(i, g, t, i, "") for _, i, g, t in s])[:2], s


def test_a_very_long_conversation():
    trie = C.Trie()
    (cost, audit), (again, more) = trie.answers([bytes([3, 5] * 200_000), bytes([3, 5] * 200_000 + [3])])
    assert (cost, audit) == (0, "K" * 400_000) and (again, more) == (2, "K" * 400_001 + "I") and len(trie.steps) < 50


def plain(rows):
    """The whole contract in plain Python."""
    by = collections.defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        told = by[conv_id]
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        told += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = collections.Counter()
    for conv_id, told in by.items():
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        count, seen, work = collections.Counter(), set(), []
        for _, role, text in told:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            work.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(work, work[1:]))
        turns = {t for t, *_ in told if t is not None}
        cost, audit, lines = cheapest(work)
        out[(conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


ROWS = "conv_id long, turn long, role string, text string, gone string, initial int, digest int"


def odd_rows():
    import random

    rng = random.Random(5)
    texts = ["Fine.", "No end", "", " \t\n", "What?", "é日本!", "Same.", "Same.", "a.b", None, "x" * 5000 + ". \x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünique", "sys"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts), "g", 1, 2) for c in range(150) for _ in range(rng.randrange(1, 7))]
    rows += [(None, None, None, None, "g", 1, 2), (None, 3, "user", "Hi.", "g", 1, 2), (-5, -7, "user", "A.", "g", 1, 2), (-5, 9, "assistant", "B.", "g", 1, 2)]
    return rows + rows[:9]


def test_repair_digests(spark):
    rows = odd_rows()
    want = plain(rows)
    got = collections.Counter(map(tuple, C.repair_digests(spark.createDataFrame(rows, ROWS).repartition(5)).collect()))
    assert got == want and sum(want.values()) == len({r[0] for r in rows})
    assert any(r[6] == 0 and r[7] == "" for r in want)  # nothing left
    assert C.repair_digests(spark.createDataFrame([], ROWS)).count() == 0


def test_sql_says_the_same(spark):
    rows = odd_rows()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    told = con.sql(C.ORACLE)
    names = [f.split()[0] for f in C._HASHED.split(", ")]
    assert collections.Counter(tuple(r[told.columns.index(n)] for n in names) for r in told.fetchall()) == plain(rows)


def test_repaired_rows(spark):
    rows = odd_rows()
    hurt = C.damaged(spark.createDataFrame(rows, ROWS))
    by = collections.defaultdict(list)
    for r in C.repaired(hurt).orderBy("conv_id", "place").collect():
        by[r["conv_id"]].append(r)
    digests = {r[0]: r[8] for r in plain(rows)}
    for conv_id, lines in by.items():
        assert [r["place"] for r in lines] == list(range(len(lines))) and FORM.fullmatch("".join(r["role"][0] for r in lines))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == digests[conv_id]
        assert all(r["text"] == "" for r in lines if r["edit"] == "insert")


def test_a_conversation_over_many_batches(spark):
    """Batches of three rows: a conversation's state passes from one to the next."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Text {i % 5}.", "g", 1, 2) for i in range(400)] + odd_rows()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = collections.Counter(map(tuple, C.repair_digests(spark.createDataFrame(rows, ROWS)).where("conv_id <> 7 or conv_id is null").collect()))
        long = C.repair_digests(spark.createDataFrame(rows, ROWS)).where("conv_id = 7").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain([r for r in rows if r[0] != 7]) and len(long) == 1 and long[0]["duplicate"] > 300
