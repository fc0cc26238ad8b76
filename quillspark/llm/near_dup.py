"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has SYMBOLS symbols of 16 bits, the low bits of as many minima over the document's shingle set. It is split into
chunks of CHUNK symbols. Two signatures that differ in at most BOUND symbols differ, by the pigeonhole principle, in at most
one symbol of some chunk; so each chunk is indexed once for each symbol that may be in error, that symbol left out, and all
pairs within BOUND share an entry. At similarity 0.8 a pair shares none with probability under 2e-6.

Documents with equal sets are one class from the start. In every entry the members are compared with its smallest one, on
their full sets; members that are found to differ are compared with the other members of that smallest one's entries, in tiles.
So a large group of copies costs a comparison or so a member, and no link between different texts is lost to that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_array, even_keys, looked_up, placed, release, slices, texts_of, written
from .substrings import Batch, mixed, rolling

SYMBOLS, CHUNK = 50, 5
CHUNKS = SYMBOLS // CHUNK
#: The largest signature distance at which every pair is found.
BOUND = 2 * CHUNKS - 1
#: Documents in a block of a tile.
BLOCK = 192
#: Groups of hubs in which tiles are numbered.
GROUPS = 256
#: Members of a hub in a group that is compared with it, and rows of many small hubs in a group.
PART, FEW = 128, 96
_SETS = "doc_id long, file long, at long, n_shingles long, fp1 long, fp2 long, signature binary"
_ODD = (mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
_SALT = mixed(np.arange(1000, 1000 + CHUNKS * CHUNK, dtype=np.uint64)).reshape(CHUNKS, CHUNK)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; fewer words are one shingle."""
    batch = Batch(texts, folded=True)
    runs = rolling(batch.hashes[0], k, 0)
    none = np.zeros(0, dtype=np.uint64)
    out = []
    for a, b in zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(rolling(batch.hashes[0][a:b], b - a, 0) ^ np.uint64(b - a))
        else:
            out.append(none)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols by document; of an empty set all zero."""
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        size = np.array([len(sets[i]) for i in full])
        at = np.cumsum(size) - size
        for j in range(SYMBOLS):
            out[full, j] = mixed(np.minimum.reduceat(flat * _ODD[j] ^ (flat >> np.uint64(17)) * _ODD[-j - 1], at)).astype(np.uint16)
    return out


def entries(symbols: np.ndarray) -> np.ndarray:
    """Index entries of each signature: one for every chunk and symbol left out of it."""
    n = len(symbols)
    chunks = symbols.reshape(n, CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((n, CHUNKS, CHUNK), dtype=np.uint64)
    for e in range(CHUNK):
        rest = [j for j in range(CHUNK) if j != e]
        held = chunks[:, :, rest[0]]
        for j in rest[1:]:
            held = held << np.uint64(16) | chunks[:, :, j]
        out[:, :, e] = mixed(held ^ _SALT[None, :, e])
    return out.reshape(n, -1).view(np.int64)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(texts_of(part), k)
                prints = [(int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
                marks = signatures(sets)
                yield pa.record_batch(
                    [*(as_array(part.column(c)) for c in ("doc_id", "file", "at")), pa.array([len(s) for s in sets], pa.int64()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64()), pa.array([m.tobytes() for m in marks], pa.binary())],
                    names=["doc_id", "file", "at", "n_shingles", "fp1", "fp2", "signature"],
                )

    return run


def _index(batches):
    for batch in batches:
        data = b"".join(batch.column("signature").to_pylist())
        keys = entries(np.frombuffer(data, dtype=np.uint16).reshape(-1, SYMBOLS))
        docs = as_array(batch.column("node")).to_numpy(zero_copy_only=False)
        for a in range(0, len(docs), 2000):
            part = keys[a : a + 2000]
            yield pa.record_batch([pa.array(part.ravel()), pa.array(np.repeat(docs[a : a + 2000], part.shape[1]))], names=["entry", "node"])


def _compare(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        nodes, hubs = table.column("node").to_pylist(), table.column("hub").to_pylist()
        place = {d: i for i, d in reversed(list(enumerate(nodes)))}
        kept = sorted(place.values())
        sets = dict(zip((nodes[i] for i in kept), shingle_sets(texts_of(table.take(pa.array(kept))), k)))
        found = set()
        for a, b in zip(nodes, hubs):
            if a != b:
                x, y = sets[a], sets[b]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.add((a, b))
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _grouped(texts: DataFrame, rows: DataFrame, number: F.Column, small: F.Column, own: list[str], compare) -> DataFrame:
    """The links that compare finds in groups of rows (node, hub, ...), each with the node's text.

    A group is all rows with equal own columns, or, where small holds, those of a number of hubs, about FEW rows. Groups are
    dealt to partitions by number, in turn.
    """
    spark = rows.sparkSession
    keys, buckets = even_keys(spark), max(1, rows.where(small).count() // FEW)
    bucket = F.pmod(F.xxhash64("hub", F.lit(5)), F.lit(buckets))
    told = F.when(small, F.struct(F.lit(-1).cast("long").alias("g"), bucket.alias("h"), F.lit("").alias("o")))
    told = told.otherwise(F.struct(F.lit(0).cast("long").alias("g"), F.col("hub").alias("h"), F.concat_ws(",", *own).alias("o")))
    turn = F.when(small, bucket).otherwise(number)
    key = F.element_at(F.array(*map(F.lit, keys)), (F.pmod(turn, F.lit(len(keys))) + 1).cast("int"))
    dealt = rows.withColumn("grp", told).withColumn("key", key)
    held = texts.join(dealt.hint("merge"), "node").repartition(len(keys), "key")
    return held.groupBy("key", "grp").applyInArrow(compare, "a long, b long")


def confirm(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, hub, n) whose full sets are similar enough, as (a, b).

    A hub with n members is split over n / PART groups; its text goes once to every group that has members of it.
    """
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = pairs.select("a", "hub", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    rows = dealt.select(F.col("a").alias("node"), "hub", "parts", "part").unionByName(dealt.select(F.col("hub").alias("node"), "hub", "parts", "part").distinct())
    return _grouped(texts, written(rows, "dealt"), F.xxhash64("hub", "parts") % F.lit(1 << 40) + F.col("part"), F.col("parts") == 1, ["parts", "part"], _compare(k, percent))


def numbered(hubs: DataFrame, tiles: F.Column) -> DataFrame:
    """hubs with start: how many tiles those before have, so that all are numbered without gaps.

    hubs, one row each, are added up within GROUPS groups by hash; between these the driver adds up GROUPS sums.
    """
    told = hubs.withColumn("tiles", tiles.cast("long")).withColumn("g", F.pmod(F.xxhash64("hub", F.lit(9)), F.lit(GROUPS)).cast("int"))
    sums = dict(tuple(r) for r in told.groupBy("g").agg(F.sum("tiles")).collect())
    ahead = np.concatenate([[0], np.cumsum([sums.get(g, 0) for g in range(GROUPS)])]).tolist()
    before = Window.partitionBy("g").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.array(*map(F.lit, ahead)), F.col("g") + 1)
    return told.withColumn("start", base + F.coalesce(F.sum("tiles").over(before), F.lit(0))).drop("g", "tiles")


def _compare_tiles(k: int, percent: int):
    """Links between components, one for each two that a link within the group's tiles joins and that no other has joined there.

    A group gives less links than it has components, however many texts of these are similar; those that are left out join
    what is joined, and texts of components that have been joined are not compared any more.
    """

    def run(table: pa.Table) -> pa.Table:
        release()
        sets = shingle_sets(texts_of(table), k)
        marks = signatures(sets).reshape(len(sets), CHUNKS, CHUNK)
        nodes, labels = table.column("node").to_numpy(), table.column("component").to_numpy()
        first = table.column("first").combine_chunks().to_numpy(zero_copy_only=False)
        size, joined = np.array([len(s) for s in sets]), labels.copy()
        tiles: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("hub", "x", "y")))):
            tiles.setdefault(key, []).append(i)
        found = set()
        for (_, x, y), at_ in tiles.items():
            at = np.array(at_)
            left, right = (at, at) if x == y else (at[first[at]], at[~first[at]])
            for i in left.tolist():
                other = right[(joined[right] != joined[i]) & (nodes[right] > nodes[i] if x == y else True)]
                other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
                if len(other):  # in some chunk at most one symbol differs: they share an entry
                    other = other[((marks[other] == marks[i]).sum(axis=2) >= CHUNK - 1).any(axis=1)]
                for j in other.tolist():
                    if joined[j] == joined[i]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        found.add((max(labels[i], labels[j]), min(labels[i], labels[j])))
                        joined[joined == joined[j]] = joined[i]
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def compare_strangers(texts: DataFrame, pairs: DataFrame, found: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Components that are joined by links among the members of a hub's entries that are in other components than the hub, and of
    these to the rest: pairs of component numbers, as many as join them (see _compare_tiles).

    The first kind ("out") and the second ("in") are cut into blocks of ``block`` texts; a tile has one block of the first
    kind and another of either, so a task sees two blocks at most, and members of the hub's own component, which may be very
    many, are never compared with each other.
    """
    label = written(found, "found")
    told = looked_up(pairs.select("a", "hub"), label.select(F.col("node").alias("a"), F.col("component").alias("c")), "a")
    told = looked_up(written(told, "told"), label.select(F.col("node").alias("hub"), F.col("component").alias("h")), "hub")
    told = written(told.select("hub", "a", F.coalesce("c", "a").alias("component"), (F.coalesce("c", "a") != F.coalesce("h", "hub")).alias("out")), "told")
    many = told.groupBy("hub").agg(F.count(F.when(F.col("out"), 1)).alias("n_out"), F.count(F.lit(1)).alias("n")).where("n_out > 0 and n > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    many = written(many.select("hub", "n", blocks(F.col("n_out")).alias("outs"), blocks(F.col("n") - F.col("n_out")).alias("ins")), "strange")
    many = written(numbered(many, F.when(F.col("n") > FEW, F.expr("outs * (outs + ins) - outs * (outs - 1) div 2")).otherwise(0)), "numbered")
    rows = looked_up(told, many, "hub").where("outs is not null")
    rows = rows.withColumn("own", F.when(F.col("out"), F.pmod(F.xxhash64("a"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("a"), F.col("ins"))).cast("int"))
    # a tile is (x, y): x an out block, y the same, a later out block or an in block
    last = F.when(F.col("out"), F.col("outs") + F.col("ins") - 1).otherwise(F.col("outs") - 1)
    rows = rows.withColumn("z", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("x", F.least("own", "z")).withColumn("y", F.greatest("own", "z")).withColumn("first", F.col("own") == F.col("x"))
    number = F.expr("start + x * (outs + ins) - x * (x - 1) div 2 + y - x").cast("long").alias("number")
    rows = written(rows.select(F.col("a").alias("node"), "component", "hub", "x", "y", "first", number, (F.col("n") <= FEW).alias("small")), "tiles")
    return _grouped(texts, rows, F.col("number"), F.col("small"), ["x", "y"], _compare_tiles(k, percent))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link: the smallest node that can be reached.

    Every round each node takes the smallest label of its neighbours and then its label's label, until none changes; rounds
    are written tables in the shared folder. What meets at a node is a minimum, combined before it is exchanged; a node with
    very many links, and a label that very many nodes have, are looked up by broadcast (see looked_up).
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    label = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = looked_up(both, label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        hooked = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        hooked = written(hooked, "labels")
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = written(looked_up(hooked, jump, "component").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        settled = label.where("was != component").isEmpty()
        label = label.select("node", "component")
        if settled:
            return label


def _classes(rows: DataFrame, shingle: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (see _SETS), and by fp1, fp2 the component of each distinct set: the smallest (doc_id, file, at) in it."""
    sets = written(rows.select("row.doc_id", "text", "file", "at").mapInArrow(_describe(shingle), _SETS), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "file", "at")).alias("rep"), F.min("signature").alias("signature"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    index = written(nodes.select("node", "signature").mapInArrow(_index, "entry long, node long"), "index")
    hubs = written(index.groupBy("entry").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    met = looked_up(index, hubs, "entry").where("node != hub").select(F.col("node").alias("a"), "hub", "n")
    pairs = written(met.groupBy("a", "hub").agg(F.max("n").alias("n")), "pairs")
    # the texts of one row for each set that has a partner: all texts are exchanged once, here
    paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    paired = nodes.join(paired.hint("merge"), "node").select("node", "rep.file", "rep.at")
    texts = written(rows.select("text", "file", "at").join(paired.hint("merge"), ["file", "at"]).select("node", "text"), "paired")
    links = written(confirm(texts, pairs, shingle, percent), "confirmed")
    found = components(links)
    late = written(compare_strangers(texts, pairs, found, shingle, percent, block), "late")
    told = written(nodes.select("node", "fp1", "fp2", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "told")
    if not late.isEmpty():  # a graph of components, not of nodes
        wider = components(late).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        told = written(looked_up(told, wider, "component").select("node", "fp1", "fp2", "rep", F.coalesce("wider", "component").alias("component")), "told")
    first = written(told.groupBy("component").agg(F.min("rep").alias("first")), "first")
    return sets, written(looked_up(told, first, "component").select("fp1", "fp2", "first"), "classes")


def _judged(rows: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """Every row of placed rows: doc_id, file, at, n_shingles, first (null: linked with nothing by definition)."""
    sets, classes = _classes(rows, shingle, percent, block)
    own = F.col("n_shingles") > 0
    sets = sets.select("doc_id", "file", "at", "n_shingles", F.struct("fp1", "fp2").alias("print"))
    full = written(sets.where(own & F.col("doc_id").isNotNull()), "full")
    judged = looked_up(full, classes.select(F.struct("fp1", "fp2").alias("print"), "first"), "print")
    alone = sets.where(~own | F.col("doc_id").isNull()).withColumn("first", F.lit(None).cast(judged.schema["first"].dataType))
    return judged.unionByName(alone).drop("print")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id that can be reached), kept.

    Two rows are linked if 100 * intersection >= percent * union of their sets of ``shingle``-word shingles. An empty or
    null text is linked with nothing. A row with a null doc_id is kept, linked with nothing and has no component. Rows with
    one doc_id but different texts each go by their own text, whatever their order; repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result. block: texts in a block of a tile, which bounds a task.
    """
    judged = _judged(placed(docs.select("doc_id", "text")), shingle, percent, block)
    component = F.coalesce("first.doc_id", "doc_id").alias("component_id")
    return judged.select("doc_id", "n_shingles", component, F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns unchanged, but one row only of each component: the first by doc_id.

    Rows without words or without a doc_id stay, each of them; of repeated rows with words one stays. Rows are told apart by
    where they lie, so any column names will do. The texts are exchanged once for this. An empty table stays empty.
    """
    rows = placed(docs)
    judged = _judged(rows, shingle, percent, block)
    stays = F.col("first").isNull() | ((F.col("first.file") == F.col("file")) & (F.col("first.at") == F.col("at")))
    kept = judged.where(stays).select("file", "at")
    return rows.select("row", "file", "at").join(kept.hint("merge"), ["file", "at"], "left_semi").select("row.*")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), sets as (
  select doc_id, case when len(words) >= 2 then list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
                      else words end as s
  from w
), told as (
  select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
  select a.doc_id as a, b.doc_id as b
  from told a join told b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (
  select a, b from links union all select b, a from links
), reached(doc_id, place) as (
  select doc_id, doc_id from sets
  union
  select r.doc_id, e.b from reached r join edges e on e.a = r.place
)
select sets.doc_id, cast(len(s) as bigint) as n_shingles, min(place) as component_id, sets.doc_id = min(place) as kept
from sets join reached on sets.doc_id = reached.doc_id group by sets.doc_id, len(s)
"""
