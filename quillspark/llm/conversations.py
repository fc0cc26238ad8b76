"""Repair of conversation structure by a dynamic program over a trie of role and fault signatures.

A conversation's rows, in order, become a signature of one symbol a row: the initial of the role, whether the row has to go, and
whether it is truncated. Signatures are inserted into a prefix trie in sorted order. Every node has a layer: for each state of
the wanted form (nothing yet, after the system's, after the user's, after the assistant's) the cost of the cheapest edits that
lead there and their rank among the layer's four by ASCII order. A layer is made once from its parent's, whatever number of
signatures share the prefix, and the answer is read at the node where a signature ends. Audits that end with an edit of the same
row are never one the beginning of another, so ranks decide all ties and only those chosen in the end are spelled out.

A conversation is read as a stream, sorted by Spark, as the hash of its repaired text has to be made in order: a task's memory
holds a few bytes for each of its rows, never their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

KEEP, REROLE, DELETE = 0, 2, 3
INSERT, TRUNCATED = 2, 1
#: States: nothing yet, after the system's, the user's and the assistant's row. Those from which a user's or an assistant's follows.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_AFTER_INSERT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NONE = 1 << 60
#: From any state to what another one can still become costs this at most, so a state that costs more than that beyond another is none.
_FAR = 7
#: Symbols: a row that has to go; otherwise 2 * role + truncated + 1, roles in this order, any other last.
GOES, ROLES = 0, "sua"
#: Conversations answered at once, and the bytes of their signatures.
AT_ONCE, SIGNATURE_BYTES = 1 << 16, 32 << 20


class Layer(NamedTuple):
    """Of the four states: cost beyond the least of them, and rank of the audit."""

    cost: tuple[int, ...]
    rank: tuple[int, ...]


class Step(NamedTuple):
    """What a symbol makes of a layer: the next one, what all costs grow by, and for each state (state before, edits)."""

    layer: Layer
    grown: int
    back: tuple[tuple[int, str] | None, ...]


def _reached(layer: Layer) -> list[tuple[int, int, int, str]]:
    """(state, cost, state at the last row, inserts) that a layer reaches without another row."""
    out = []
    for start in range(4):
        state, cost = start, layer.cost[start]
        if cost <= _FAR:
            for n in range(3):
                out.append((state, cost, start, "I" * n))
                state, cost = _AFTER_INSERT[state], cost + INSERT
    return out


def step(layer: Layer, symbol: int) -> Step:
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(state: int, cost: int, start: int, edits: str) -> None:
        new = (cost, layer.rank[start], edits, start)
        if state not in found or new < found[state]:
            found[state] = new

    role, more = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
    for state, cost, start, inserts in _reached(layer):
        offer(state, cost + DELETE, start, inserts + "D")
        if symbol == GOES:
            continue
        for target in (SYSTEM, USER, ASSISTANT):
            if state in _BEFORE[target]:
                if role + 1 == target:
                    offer(target, cost + KEEP + more, start, inserts + "K")
                if target != SYSTEM:
                    offer(target, cost + REROLE + more, start, inserts + "R")
    least = min(x[0] for x in found.values())
    found = {s: x for s, x in found.items() if x[0] - least <= _FAR}
    order = sorted(found, key=lambda s: found[s][1:3])
    cost = tuple(found[s][0] - least if s in found else _NONE for s in range(4))
    return Step(Layer(cost, tuple(order.index(s) if s in found else 4 for s in range(4))), least, tuple((found[s][3], found[s][2]) if s in found else None for s in range(4)))


class Trie:
    """A prefix trie of signatures, each node with its layer; the nodes of a prefix are made once."""

    root = Layer((0, _NONE, _NONE, _NONE), (0, 4, 4, 4))

    def __init__(self) -> None:
        self.steps: dict[tuple[Layer, int], Step] = {}
        self.layers, self.costs, self.backs = [self.root], [0], [None]  # of the nodes on the path to the newest signature
        self.made = self.asked = 0  # nodes, and symbols of all signatures; for measurements

    def answers(self, signatures: Iterable[bytes]) -> Iterator[tuple[int, str]]:
        """Cost and audit of sorted signatures, one after another. A branch is left for good once the order passes it."""
        last = b""
        for signature in signatures:
            shared = common(last, signature)
            del self.layers[shared + 1 :], self.costs[shared + 1 :], self.backs[shared + 1 :]
            for symbol in signature[shared:]:
                key = (self.layers[-1], symbol)
                if key not in self.steps:
                    self.steps[key] = step(*key)
                made = self.steps[key]
                self.layers.append(made.layer)
                self.costs.append(self.costs[-1] + made.grown)
                self.backs.append(made.back)
            self.made += len(signature) - shared
            self.asked += len(signature)
            last = signature
            yield self.ended()

    def ended(self) -> tuple[int, str]:
        layer = self.layers[-1]
        ends = [(cost, layer.rank[start], edits, start) for state, cost, start, edits in _reached(layer) if state in (NOTHING, ASSISTANT)]
        cost, _, edits, state = min(ends)
        told = [edits]
        for back in reversed(self.backs[1:]):
            state, edits = back[state]
            told.append(edits)
        return self.costs[-1] + cost, "".join(reversed(told))


def common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`: conv_id, turn, role, text, gone.

    Nulls count as one space, in that name too. Of 20 remainders, 0 drops a row (it stays, marked as gone), 1 empties its text, 2
    takes `.`, `!` and `?` from it, 3 repeats it, 4 makes the user its role.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.when(F.col("kind") == 3, 2).otherwise(1)
    told = told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), twice)).alias("copy"))
    return told.drop("copy")


#: In which order a conversation's rows stand; rows of one turn by role and then by a digest of the text.
_ORDER = ["turn", "role", "digest"]  # Spark puts nulls first
_SPACE = "\\x20\\x09-\\x0D"


def signed(rows: DataFrame) -> DataFrame:
    """Rows with their symbols, without texts, each conversation's together and in order: conv_id, turn, gone, initial, fault.

    fault: 0 none, 1 blank, 2 seen before with this role, 3 truncated. The rows are exchanged once, by conversation; both windows
    are within it and go row by row, so that none is held in memory.
    """
    last = F.regexp_extract("text", f"([^{_SPACE}])[{_SPACE}]*\\z", 1)
    told = rows.select("conv_id", "turn", "gone", "role", F.substring("role", 1, 1).alias("initial"), F.md5(F.col("text").cast("binary")).alias("digest"), last.alias("last"))
    told = told.repartition("conv_id")
    before = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("gone", "turn")) > 1
    fault = F.when(F.col("last") == "", 1).when(before, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return told.withColumn("fault", fault.cast("byte")).sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "gone", "initial", "fault")


_REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of signed() to one row a conversation; a conversation may span any number of batches."""
    trie, done, size = Trie(), [], 0
    now = _Conversation(None)
    began = False

    def told() -> pa.RecordBatch:
        distinct = sorted({bytes(c.signature) for c in done})
        answer = dict(zip(distinct, trie.answers(distinct)))
        rows = [(c.conv_id, c.gaps(), *c.faults[1:], c.illegal, *answer[bytes(c.signature)]) for c in done]
        names = [f.split()[0] for f in _REPAIRS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "audit" else pa.int64()) for n, x in zip(names, zip(*rows))], names=names)

    for batch in batches:
        ids, turns, gone, initials, faults = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "gone", "initial", "fault"))
        for conv_id, turn, out, initial, fault in zip(ids, turns, gone, initials, faults):
            if not began or conv_id != now.conv_id:
                if began:
                    done.append(now)
                    size += len(now.signature)
                    if len(done) >= AT_ONCE or size >= SIGNATURE_BYTES:
                        yield told()
                        done, size = [], 0
                now, began = _Conversation(conv_id), True
            if not out:
                now.add(turn, initial, fault)
    if began:
        done.append(now)
        yield told()


class _Conversation:
    """What is known of a conversation up to some row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.signature, self.faults, self.illegal, self.last = conv_id, bytearray(), [0, 0, 0, 0], 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        role = ROLES.find(initial) if initial else -1
        self.signature.append(GOES if fault in (1, 2) else 2 * (role if role >= 0 else 3) + (fault == 3) + 1)
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


class _Edits:
    """The edits of an audit applied row by row: what stands in the repaired conversation, as (edit, role, text)."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.placed("insert", "")

    def placed(self, edit: str, text: str) -> tuple[str, str, str]:
        self.state = _AFTER_INSERT[self.state]
        return edit, "user" if self.state == USER else "assistant", text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = ROLES.find(role[:1]) + 1
            yield "keep", role, text
        elif edit == "R":
            yield self.placed("rerole", text)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple[str, str, str] | None]]:
    """Conversations, each its repair and then its rows in order: (repair, None), and then (None, line) of all that is repaired."""
    now = None
    for whole in batches:
        for batch in slices(whole):
            for repair, role, text in zip(*(batch.column(n).to_pylist() for n in ("repair", "role", "text"))):
                lines = now.row(role, text) if repair is None else now.inserts() if now else ()
                for line in lines:
                    yield None, line
                if repair is not None:
                    now = _Edits(repair["audit"])
                    yield repair, None
    for line in now.inserts() if now else ():
        yield None, line


def _batches(rows: Iterable[tuple], schema: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types, told, size = [pa.int64() if k == "long" else pa.string() for k in kinds], [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), types)], names=list(names))
    for row in rows:
        told.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield make()
            told, size = [], 0
    if told:
        yield make()


_LINES = "conv_id long, place long, edit string, role string, text string"
_HASHED = _REPAIRS + ", repaired_sha256 string"


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        conv_id = place = None
        for repair, line in edited(batches):
            if repair is not None:
                conv_id, place = repair["conv_id"], 0
            else:
                yield conv_id, place, *line
                place += 1

    return _batches(rows(), _LINES)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs, each with the hash of its `role:text` lines."""

    def rows() -> Iterator[tuple]:
        now = sha = None
        for repair, line in edited(batches):
            if repair is not None:
                if now:
                    yield *now.values(), sha.hexdigest()
                now, sha, first = repair, hashlib.sha256(), True
            else:
                sha.update(f"{'' if first else chr(10)}{line[1]}:{line[2]}".encode())
                first = False
        if now:
            yield *now.values(), sha.hexdigest()

    return _batches(rows(), _HASHED)


def structure(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation (conv_id, turn, role, text, gone) and the cheapest edits to the form (s?(ua)+)?.

    Per conv_id, null among them: gaps between its turns, its blank, duplicate and truncated rows (by first fault), adjacent roles
    out of order, the cost and the edits' initials (of the cheapest the ASCII-least). Rows stand by turn, nulls first, those of one
    turn by role and the md5 of the text. Rows that are gone count as absent; a conversation without others has zeros and no edits.
    Other columns are ignored; repeated rows are rows each; an empty table gives no rows.
    """
    return signed(rows).mapInArrow(repairs, _REPAIRS)


def _with_texts(rows: DataFrame, repair: DataFrame) -> DataFrame:
    """Each conversation's repair and then its rows in order, as sorted streams: every text is exchanged once."""
    none = F.lit(None)
    edits = repair.select("conv_id", F.struct("*").alias("repair"), F.lit(0).alias("kind"), none.cast("long").alias("turn"), *(none.cast("string").alias(c) for c in ("role", "digest", "text")))
    texts = rows.where(~F.col("gone")).select("conv_id", none.cast(edits.schema["repair"].dataType).alias("repair"), F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
    return both.select("repair", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """The conversations of structure() with their edits made: conv_id, place (from 0), edit (keep, rerole or insert), role, text."""
    return _with_texts(rows, written(structure(rows), "repairs")).mapInArrow(lines, _LINES)


def repair_digests(rows: DataFrame) -> DataFrame:
    """structure() of damaged conversations (conv_id, turn, role, text), with the sha256 of their repaired `role:text` lines."""
    hurt = damaged(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    return _with_texts(hurt, written(structure(hurt), "repairs")).mapInArrow(digests, _HASHED)


_SPACES = r"[\x20\x09-\x0D]"
_CRC = """cast(xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(name, ''), lambda ch: cast(ascii(ch) as bigint))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * cast(3988292384 as bigint)) + z)), 4294967295) as bigint)"""
#: For each target the states that lead to it, each with the inserts between.
_LEADS = {
    "n0": [("s0", 0)],
    "n1": [("s1", 0)],
    "n2": [("s2", 0), ("s0", 1), ("s1", 1), ("s3", 1), ("s2", 2)],
    "n3": [("s3", 0), ("s2", 1), ("s0", 2), ("s1", 2), ("s3", 2)],
}


def _least(states: list[str]) -> str:
    """The cheapest and then ASCII-least (cost, audit) that reaches any of the states."""
    offers = [f"{{'c': {s}.c + {INSERT * n}, 'a': {s}.a || '{'I' * n}'}}" for t in states for s, n in _LEADS[t]]
    return f"list_min([{', '.join(offers)}])"


def _sql() -> str:
    n = {f"n{i}": _least([f"n{i}"]) for i in range(4)}
    plus = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
    never = "{'c': cast(1000000000 as bigint), 'a': '~'}"
    fit = lambda state, role, before: ", ".join([plus(state, DELETE, "D")] + [f"case when stays and initial = '{role}' then {plus(b, 'more', 'K')} else {never} end" for b in before] + ([f"case when stays then {plus(b, f'{REROLE} + more', 'R')} else {never} end" for b in before] if role != "s" else []))
    return f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations
), dealt as (
  select *, {_CRC} % 20 as kind from named
), rows_ as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from dealt, (select unnest([1, 2]) as copy) where kind <> 0 and (copy = 1 or kind = 3)
), placed as (
  select *, substr(role, 1, 1) as initial, regexp_extract(text, '([^\\x20\\x09-\\x0D]){_SPACES}*$', 1) as last_,
         row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from rows_
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(initial) over (partition by conv_id order by i) as before_ from placed
), faulty as (
  select *, last_ = '' as blank, last_ <> '' and again as duplicate, last_ <> '' and not again and last_ not in ('.', '!', '?') as truncated from seen
), symbols as (
  select *, not blank and not duplicate as stays, case when truncated then {TRUNCATED} else 0 end as more from faulty
), ids as (select distinct conv_id from conversations
), dp as (
  select conv_id, cast(0 as bigint) as i, {{'c': cast(0 as bigint), 'a': ''}} as s0, {never} as s1, {never} as s2, {never} as s3 from ids
  union all
  select conv_id, i, list_min([{fit('n0', 'x', [])}]), list_min([{fit('n1', 's', ['n0'])}]),
         list_min([{fit('n2', 'u', ['n0', 'n1', 'n3'])}]), list_min([{fit('n3', 'a', ['n2'])}])
  from (select d.conv_id, r.i, r.initial, r.stays, cast(r.more as bigint) as more, {', '.join(f'{x} as {k}' for k, x in n.items())}
        from dp d join symbols r on d.conv_id is not distinct from r.conv_id and r.i = d.i + 1)
), ended as (
  select conv_id, i, {_least(['n0', 'n3'])} as best from dp qualify row_number() over (partition by conv_id order by i desc) = 1
), edits as (
  select conv_id, generate_subscripts(string_split(best.a, ''), 1) as k, unnest(string_split(best.a, '')) as e from ended where best.a <> ''
), at_ as (
  select *, sum(case when e = 'I' then 0 else 1 end) over (partition by conv_id order by k) as i from edits
), kept as (
  select a.conv_id, a.k, a.e, case when a.e = 'K' then r.role end as role, case when a.e = 'I' then '' else r.text end as text,
         case when a.e = 'K' then r.initial end as initial
  from at_ a left join placed r on a.conv_id is not distinct from r.conv_id and a.i = r.i where a.e <> 'D'
), numbered as (
  select *, row_number() over (partition by conv_id order by k) as n, max(case when initial = 's' then 1 else 0 end) over (partition by conv_id) as s from kept
), lines as (
  select *, coalesce(role, case when (n - s) % 2 = 1 then 'user' else 'assistant' end) || ':' || text as line from numbered
), hashes as (
  select conv_id, sha256(string_agg(line, chr(10) order by n)) as h from lines group by conv_id
), sums as (
  select conv_id, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
         count(*) filter (where i > 1 and before_ || initial not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps
  from faulty group by conv_id
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, e.best.c as cost, e.best.a as audit, coalesce(h, sha256('')) as repaired_sha256
from ended e left join sums s on e.conv_id is not distinct from s.conv_id left join hashes h on e.conv_id is not distinct from h.conv_id
"""


ORACLE = _sql()
