"""Prefix trie of rebuilt conversations as a node table behind minimal perfect hashes.

A turn's digest is the SHA-256 of its role and text. A prefix's digest is the exclusive
or of its turns' hashes, each taken with its place, so prefixes are running sums: they are
formed per block of ``BLOCK`` turns and the blocks' totals are carried over, whatever one
conversation holds. Texts stay where they are read; only digests and lengths move.

Rows are dealt by conversation and block. A task takes them in shards of about
``SHARD_ROWS`` rows: it enumerates the shard's distinct prefix digests, gives each a slot
by a minimal perfect hash whose slots keep the whole digest to compare with, and scatters
counts into flat arrays. A node's counts are summed over the shards that hold it, so a
first turn of every conversation costs one row a shard. What is summed over subtrees is
attached to one shard: the one that holds the node's smallest member. There it is
accumulated through the array of parent slots, deepest first, and the shards' sums are
added per node. Sums of deeper blocks are carried to the last turn of the block before.

Equal digests are verified: all rows of a node must agree in parent digest, turn digest
and depth, which by induction means equal prefixes; otherwise the job raises.

Defined results: null role or text is empty; turns of equal number are taken in the order
of their digests, null numbers first. Repeated rows are turns of their own. Rows without a
conv_id belong to no conversation and are left out; below 0, ``%`` is SQL's. An empty
table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import shared
from tideline.llm.perfect_hash import PerfectHash

BLOCK = 4096
SHARD_ROWS = 400_000
PIECE = 1 << 20
GROUP, HEADS = 100, 6
NODE = ["p1", "p2"]
PARENT = ["q1", "q2"]


def numbered(chats: DataFrame) -> DataFrame:
    """(conv_id, part, seq, digest, n_chars): turns in order, numbered from 1 within their
    conversation and part. Parts are ranges of turns, so a long conversation has many."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256))
    rows = chats.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"))
    n = shared.shuffle_partitions(chats.sparkSession)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return shared.stored(ranged.drop("turn").mapInArrow(_number, "conv_id long, part int, seq long, digest binary, n_chars long"), "turns")


def _number(batches: Iterator[pa.RecordBatch]):
    last, seen, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(begin, len(ids)))
        seq = np.arange(len(ids)) - np.repeat(begin, sizes) + 1
        if last is not None and ids[0] == last:
            seq[: sizes[0]] += seen
        last, seen = ids[-1], int(seq[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(seq), batch.column(1), batch.column(2)], ["conv_id", "part", "seq", "digest", "n_chars"])


def rebuilt(chats: DataFrame) -> DataFrame:
    """(conv_id, d, digest, n_chars, ends) of all turns of all rebuilt conversations, and
    a row of depth 0 each: the head of the group's first conversation, then the rest of
    one's own turns."""
    turns = numbered(chats)
    parts = turns.groupBy("conv_id", "part").agg(F.max("seq").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per part
    parts = shared.stored(parts.withColumn("before", before), "parts")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", head).withColumn("group", F.expr(f"conv_id - conv_id % {GROUP}"))
    donors = convs.where("conv_id = group").select("group", F.col("n").alias("group_n"))
    convs = convs.join(donors, "group", "left").withColumn("taken", F.least("h", F.coalesce("group_n", F.lit(0))))
    convs = shared.stored(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "convs")

    placed = turns.join(parts.drop("n").join(convs.select("conv_id", "h", "taken", "length"), "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("seq"))
    own = placed.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "n_chars", "length")
    heads = placed.where(f"pos < {HEADS} and conv_id % {GROUP} = 0").select(F.col("conv_id").alias("group"), F.col("pos").alias("d"), "digest", "n_chars")
    given = convs.select("conv_id", "group", "taken", "length").join(heads, "group").where("d <= taken").select("conv_id", "d", "digest", "n_chars", "length")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n_chars"), "length")
    return own.unionByName(given).unionByName(roots).withColumn("ends", F.col("d") == F.col("length")).drop("length")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds block, the digest p1, p2 of the prefix that ends with the turn and q1, q2 of
    the one before it."""
    hashed = turns.withColumn("block", F.expr(f"d div {block}"))
    lane = lambda *c: F.when(F.col("d") > 0, F.xxhash64(*c)).otherwise(0)
    hashed = shared.stored(hashed.withColumn("l1", lane("digest", "d")).withColumn("l2", lane("d", F.lit(0x5EED), "digest")), "rebuilt")
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("l1").alias("t1"), F.bit_xor("l2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carry = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2)]).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("d")
    run = hashed.withColumns({f"r{k}": F.bit_xor(f"l{k}").over(within) for k in (1, 2)}).join(carry, ["conv_id", "block"], "left")
    run = run.withColumns({f"p{k}": F.col(f"r{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2)})
    return run.select("conv_id", "block", "d", "ends", "digest", "n_chars", *NODE, *[F.col(f"p{k}").bitwiseXOR(F.col(f"l{k}")).alias(f"q{k}") for k in (1, 2)])


# ---- node tables of shards --------------------------------------------------


class NodeTable:
    """Slots of the distinct digests among ``p`` (rows of two numbers)."""

    def __init__(self, p: np.ndarray):
        distinct = np.unique(p.view([("a", np.uint64), ("b", np.uint64)]).ravel()).view(np.uint64).reshape(-1, 2)
        self.salt, self.size = np.uint64(0), len(distinct)
        while len(np.unique(self._key(distinct))) != len(distinct):
            self.salt += np.uint64(1)
        self.hash = PerfectHash.build(self._key(distinct))
        self.print = np.zeros_like(distinct)
        self.print[self.hash.number(self._key(distinct))] = distinct

    def _key(self, p: np.ndarray) -> np.ndarray:
        return shared.mix(p[:, 0] ^ shared.mix(p[:, 1] + self.salt))

    def slots(self, p: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table doesn't hold it."""
        at = self.hash.number(self._key(p))
        held = (at >= 0) & (self.print[np.maximum(at, 0)] == p).all(1)
        return np.where(held, at, -1)


def _pairs(batch, a: str, b: str) -> np.ndarray:
    return np.ascontiguousarray(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (a, b)], 1))


LOCAL = "shard long, p1 long, p2 long, q1 long, q2 long, digest binary, depth long, n_chars long, n long, n_ends long, rep long, border long"


def _shards(batches: Iterator[pa.RecordBatch], block: int, shard_rows: int):
    """Cuts the task's rows into shards between blocks of conversations."""
    held, rows, number = [], 0, 0
    base = TaskContext.get().partitionId() << 32
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        rows += batch.num_rows
        if rows < shard_rows:
            continue
        table = pa.concat_tables(held)
        ids, blocks = table.column("conv_id").to_numpy(), table.column("block").to_numpy()
        edge = np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1]))
        if not len(edge):
            continue
        cut = int(edge[-1]) + 1
        yield from _local_nodes(table.slice(0, cut), base + number, block)
        held, rows, number = [table.slice(cut)], table.num_rows - cut, number + 1
    if rows:
        yield from _local_nodes(pa.concat_tables(held), base + number, block)


def _local_nodes(table: pa.Table, shard: int, block: int):
    """The shard's nodes with their counts; parents of other blocks come without counts,
    and a row of its own tells in which node a block of a longer conversation ends."""
    p, q = _pairs(table, *NODE), _pairs(table, *PARENT)
    ids, depth, ends = table.column("conv_id").to_numpy(), table.column("d").to_numpy(), table.column("ends").to_numpy()
    nodes = NodeTable(p)
    slot = nodes.slots(p)
    first = np.zeros(nodes.size, np.int64)
    first[slot[::-1]] = np.arange(len(slot))[::-1]
    digest = table.column("digest").combine_chunks()
    of = first[slot]
    same = (q == q[of]).all(1) & (depth == depth[of]) & np.asarray(pa.compute.equal(digest, digest.take(pa.array(of))))
    if not same.all():
        raise ValueError("two different prefixes have one digest")
    counts = np.bincount(slot, minlength=nodes.size)
    n_ends = np.bincount(slot, ends, minlength=nodes.size).astype(np.int64)
    rep = np.full(nodes.size, np.iinfo(np.int64).max)
    np.minimum.at(rep, slot, ids)
    away = np.flatnonzero((depth > 0) & (nodes.slots(q) < 0))
    away = away[np.unique(q[away].view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True)[1]] if len(away) else away
    border = np.flatnonzero((depth % block == block - 1) & ~ends)
    none, zero = pa.nulls, lambda k: np.zeros(k, np.int64)
    here = table.take(pa.array(first))

    def rows(keys: np.ndarray, more: list) -> pa.RecordBatch:
        names = [c.split()[0] for c in LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), shard, np.int64)), *(pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in (0, 1)), *more], names)

    chars = here.column("n_chars").combine_chunks()
    parent = [pa.array(np.ascontiguousarray(q[first][:, k]).view(np.int64)) for k in (0, 1)]
    yield rows(p[first], [*parent, digest.take(pa.array(first)), pa.array(depth[first]), chars, pa.array(counts), pa.array(n_ends), pa.array(rep), none(nodes.size, pa.int64())])
    if len(away):
        k = len(away)
        yield rows(q[away], [none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), pa.array(depth[away] - 1), none(k, pa.int64()), pa.array(zero(k)), pa.array(zero(k)), none(k, pa.int64()), none(k, pa.int64())])
    if len(border):
        k = len(border)
        yield rows(p[border], [none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), pa.array(depth[border]), none(k, pa.int64()), pa.array(zero(k)), pa.array(zero(k)), none(k, pa.int64()), pa.array(ids[border])])


def accumulated(group: pa.Table, block: int) -> pa.Table:
    """Of one shard: per node what its subtree within the block holds of ``saved`` and
    ``leaves``, added up through the parents' slots, deepest nodes first."""
    real = group.filter(pa.compute.equal(group.column("kind"), 0))
    p, depth = _pairs(real, *NODE), real.column("depth").to_numpy()
    if not len(p):
        return pa.table({c: pa.array([], pa.int64()) for c in (*NODE, "saved", "leaves")})
    nodes = NodeTable(p)
    slot = nodes.slots(p)
    level = np.zeros(nodes.size, np.int64)
    level[slot] = depth
    parent = np.full(nodes.size, -1)
    inner = depth % block > 0
    parent[slot[inner]] = nodes.slots(_pairs(real, *PARENT)[inner])
    sums = np.zeros((nodes.size, 2), np.int64)
    every = nodes.slots(_pairs(group, *NODE))
    np.add.at(sums, every, np.stack([group.column(c).to_numpy() for c in ("saved", "leaves")], 1))
    order = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], level[order][1:] != level[order][:-1], [True]]))
    for a, z in zip(edges[:-1], edges[1:]):
        mine = order[a:z]
        mine = mine[parent[mine] >= 0]
        np.add.at(sums, parent[mine], sums[mine])
    keep = sums.any(1)
    columns = [*(np.ascontiguousarray(nodes.print[keep][:, k]).view(np.int64) for k in (0, 1)), sums[keep, 0], sums[keep, 1]]
    return pa.table(dict(zip((*NODE, "saved", "leaves"), map(pa.array, columns))))


# ---- digests of members -----------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], most: int):
    """Ids of a node, comma-joined, in pieces: (p1, p2, part, number, piece)."""
    part, number, open_ = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        p, ids = _pairs(batch, *NODE), batch.column(2).to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1), [True]]))
        out = []
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            key, text = tuple(p[a].view(np.int64).tolist()), ",".join(map(str, ids[a:z])).encode()
            if open_ and open_[0] == key and len(open_[1]) + len(text) < most:
                open_ = (key, open_[1] + b"," + text)
                continue
            if open_:
                out.append((*open_[0], part, number, open_[1]))
                number += 1
            open_ = (key, text)
        if out:
            yield _piece_rows(out)
    if open_:
        yield _piece_rows([(*open_[0], part, number, open_[1])])


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*NODE, "part", "number", "piece"])


def _joined(batches: Iterator[pa.RecordBatch]):
    """SHA-256 of each node's pieces, read one after another."""
    key, sha = None, None
    for batch in batches:
        done = []
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece"))):
            if (a, b) == key:
                sha.update(b"," + piece)
                continue
            if key is not None:
                done.append((*key, sha.hexdigest()))
            key, sha = (a, b), hashlib.sha256(piece)
        if done:
            yield _sha_rows(done)
    if key is not None:
        yield _sha_rows([(*key, sha.hexdigest())])


def _sha_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(p1, p2, ends_sha256) from (p1, p2, conv_id). Ids are joined where they are sorted;
    only pieces of up to a MB a row meet at their node."""
    n = shared.shuffle_partitions(ends.sparkSession)
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(partial(_pieces, most=piece), "p1 long, p2 long, part long, number long, piece binary")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "part", "number").mapInArrow(_joined, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(chats: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS, piece: int = PIECE) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""

    def shard_sums(group: pa.Table) -> pa.Table:
        return accumulated(group, block)

    n = shared.shuffle_partitions(chats.sparkSession)
    rows = shared.stored(prefixes(rebuilt(chats), block), "prefixes")
    dealt = rows.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "d")
    local = shared.stored(dealt.mapInArrow(partial(_shards, block=block, shard_rows=shard_rows), LOCAL), "local-nodes")

    facts = F.struct(*PARENT, "digest", "depth")
    nodes = local.where("n > 0").groupBy(*NODE).agg(
        F.min(facts).alias("facts"), F.max(facts).alias("other"), F.first("n_chars").alias("n_chars"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.min("rep").alias("rep"), F.min("shard").alias("home")
    )
    checked = F.when(F.col("facts") == F.col("other"), F.col("facts")).otherwise(F.raise_error(F.lit("two different prefixes have one digest")))
    nodes = nodes.withColumn("facts", checked).select(*NODE, *[F.col(f"facts.{c}").alias(c) for c in (*PARENT, "depth")], "n_chars", "n", "n_ends", "rep", "home")
    nodes = shared.stored(nodes.withColumn("saved", (F.col("n") - 1) * F.col("n_chars")).withColumn("leaf", (F.col("n_ends") == F.col("n")).cast("long")), "nodes")

    # a node's sums go to the shard that holds its smallest member, there to be added up
    known = local.where("border is null").select("shard", *NODE, *PARENT, "depth", F.col("rep").alias("mine"), F.col("n").alias("here")).join(nodes.select(*NODE, "rep", "saved", "leaf"), NODE)
    known = shared.stored(known, "known")
    held = F.coalesce((F.col("mine") == F.col("rep")) & (F.col("here") > 0), F.lit(False))
    at_rep = known.where("here > 0").select("shard", *NODE, *PARENT, "depth", *[F.when(held, F.col(c)).otherwise(0).alias(o) for c, o in (("saved", "saved"), ("leaf", "leaves"))], F.lit(0).alias("kind"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per block
    of_blocks = nodes.groupBy(F.col("rep").alias("conv_id"), F.expr(f"depth div {block}").alias("block")).agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    borders = local.where("border is not null").select("shard", *NODE, "depth", F.col("border").alias("conv_id"), F.expr(f"depth div {block} + 1").alias("block"))
    # a block without sums of its own still passes on those of later ones
    blocks = of_blocks.where("block > 0").unionByName(borders.select("conv_id", "block", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("l"))).groupBy("conv_id", "block").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    carried = blocks.select("conv_id", "block", F.sum("s").over(later).alias("saved"), F.sum("l").over(later).alias("leaves"))
    none = F.lit(None).cast("long")
    carried = borders.join(carried, ["conv_id", "block"]).select("shard", *NODE, none.alias("q1"), none.alias("q2"), "depth", "saved", "leaves", F.lit(1).alias("kind"))
    sums = at_rep.unionByName(carried).groupBy("shard").applyInArrow(shard_sums, "p1 long, p2 long, saved long, leaves long")
    sums = sums.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children")).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    # parents are looked up within a shard, so no node meets all its children at once
    parents = known.select(F.col("shard").alias("home"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent_conv_id"))
    named = nodes.where("depth > 0").join(parents, ["home", *PARENT]).select(*NODE, "parent_conv_id")
    zero = F.lit(0).cast("long")
    return (
        nodes.join(named, NODE, "left").join(children, NODE, "left").join(sums, NODE, "left").join(ends_digests(rows.where("ends"), piece), NODE, "left")
        .select(
            F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
