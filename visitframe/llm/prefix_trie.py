"""Prefix trie of conversations, in double arrays per shard.

1. Conversations are rebuilt (`rebuilt`): one row each, an array of turn digests (md5 of role and text) and of text lengths.
2. Equal sequences combine to one with a count and the smallest conversation (`distinct`), so copies are no hot group.
3. Distinct sequences are dealt out by ranges of their first `KEY_TURNS` turns and sorted; a task cuts its sorted run into
   prefix shards of about `SHARD_TURNS` turns and packs each into a double array: turns get dense ids in a shard, a node
   is a slot, its child by turn id t is slot BASE[node] + t if CHECK of that slot is the node. The tries are written as a
   table, one row per shard.
4. Only nodes on the paths of a shard's first and last sequence can also lie in other shards, as shards are runs of one
   sorted order. These paths, found by walking the trie, are merged by Spark: counts add up, the smallest conversation
   and the lowest shard (the owner) are kept.
5. Each trie is traversed from CHECK, level by level, with the merged figures of its shared nodes put in. Sums over
   subtrees count a shared node in its owner only; so the partial sums of a shared node simply add up over shards.
6. Digests of the conversations that end at a node: ids sorted by ranges are first joined to long strings, and these are
   hashed in order, so even a sequence that a third of all conversations share moves as few rows.

Rows without conversation id are left out; null role and text are empty; turns of equal number are ordered by the digest
of role and text; repeated rows are turns of their own. Without conversations there are no nodes. Columns besides the
four are not read. A conversation's turns are one row (some 100 bytes a turn), which bounds how long it may be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.session import stage

SHARD_TURNS = 1 << 15
#: leading turns that the range edges look at; beyond them a run of sequences stays in one task, shard after shard
KEY_TURNS = 16
#: ids joined to one string before hashing
PACK_IDS = 1 << 14
FREE = -1
ROOT_CHECK = -2
DIGEST = 32


# ---------------------------------------------------------------------------
# Double array
# ---------------------------------------------------------------------------

@dataclass
class DoubleArray:
    """BASE and CHECK over dense turn ids; slot 0 is the root."""

    base: np.ndarray
    check: np.ndarray

    def walk(self, ids: np.ndarray) -> list[int]:
        """Slots along a sequence of turn ids, the root first; stops where the trie does."""
        node, path = 0, [0]
        for t in ids.tolist():
            to = int(self.base[node]) + t
            if to >= len(self.check) or to < 0 or self.check[to] != node:
                break
            node = to
            path.append(node)
        return path

    def levels(self) -> list[np.ndarray]:
        """Slots by depth: children of a slot are the slots whose CHECK it is."""
        slots = np.flatnonzero(self.check >= 0)
        order = slots[np.argsort(self.check[slots], kind="stable")]
        parent = self.check[order]
        out, front = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
        while True:
            lo, hi = np.searchsorted(parent, front, "left"), np.searchsorted(parent, front, "right")
            n = hi - lo
            if not n.sum():
                return out
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            front = np.sort(order[pick])
            out.append(front)


def pack_trie(parent: list[int], label: list[int], depth: list[int]) -> tuple[DoubleArray, np.ndarray]:
    """Double array of a trie given as nodes (parent, turn id from 1, depth; node 0 is the root), and the slot of each node."""
    n = len(parent)
    order = np.lexsort((label, parent))  # children of a node lie together, by turn id
    order = order[np.asarray(parent)[order] >= 0]
    kids_of = np.asarray(parent)[order]
    lo, hi = np.searchsorted(kids_of, np.arange(n), "left").tolist(), np.searchsorted(kids_of, np.arange(n), "right").tolist()
    kids, labels = order.tolist(), np.asarray(label)[order].tolist()
    size = 2 * n + max(label, default=0) + 2
    base, check, free = [1] * size, [FREE] * size, list(range(size + 1))
    check[0], free[0] = ROOT_CHECK, 1
    slot = [0] * n

    def next_free(s: int) -> int:
        while free[s] != s:
            free[s] = free[free[s]]
            s = free[s]
        return s

    for node in np.argsort(depth, kind="stable").tolist():
        a, b = lo[node], hi[node]
        if a == b:
            continue
        least = labels[a]
        at = next_free(least + 1)
        while True:
            shift = at - least
            need = shift + labels[b - 1] + 2
            if need > size:
                grow = max(need - size, size // 2)
                base += [1] * grow
                check += [FREE] * grow
                free += list(range(size + 1, size + grow + 1))
                size += grow
            if all(check[shift + t] == FREE for t in labels[a:b]):
                break
            at = next_free(at + 1)
        s = slot[node]
        base[s] = shift
        for i in range(a, b):
            to = shift + labels[i]
            check[to], free[to], slot[kids[i]] = s, to + 1, to
    end = max(slot) + 1
    return DoubleArray(np.array(base[:end], np.int32), np.array(check[:end], np.int32)), np.array(slot, np.int32)


# ---------------------------------------------------------------------------
# Shards
# ---------------------------------------------------------------------------

TRIE = pa.schema([("shard", pa.int64()), ("base", pa.binary()), ("check", pa.binary()), ("length", pa.binary()), ("ends", pa.binary()),
                  ("shared", pa.list_(pa.struct([("slot", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("conv", pa.int64()), ("inner", pa.bool_())])))])
TRIE_DDL = "shard long, base binary, check binary, length binary, ends binary, shared array<struct<slot:int,depth:int,path:string,n:long,conv:long,inner:boolean>>"
#: a distinct sequence: slot where it ends, conversations, smallest one, its digest
END = np.dtype([("slot", np.int32), ("n", np.int64), ("conv", np.int64), ("key", f"S{DIGEST}")])


def build_shard(shard: int, rows: list[tuple]) -> dict:
    """Trie of sorted distinct sequences (turn digests, text lengths, conversations, smallest conversation, digest)."""
    count = [len(r[0]) for r in rows]
    flat = np.array([t for r in rows for t in r[0]], f"S{DIGEST}")
    lengths = np.array([x for r in rows for x in r[1]], np.int64)
    place = np.concatenate([np.arange(c) for c in count]) if len(flat) else np.zeros(0, np.int64)
    # dense ids by first appearance from the top, so that siblings are close to each other
    _, first, back = np.unique(flat, return_index=True, return_inverse=True)
    first = np.full(len(first), len(flat))
    order = np.lexsort((np.arange(len(flat)), place))
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.arange(len(flat))
    np.minimum.at(first, back, rank)
    dense = np.empty(len(first), np.int64)
    dense[np.argsort(first)] = np.arange(1, len(first) + 1)
    ids = dense[back]
    length = np.zeros(len(first) + 1, np.int64)
    length[ids] = lengths
    parent, label, depth, ends = [-1], [0], [0], []
    path, before, at = [0], np.zeros(0, np.int64), 0
    for c in count:
        now = ids[at: at + c]
        m = min(len(before), c)
        differ = np.flatnonzero(before[:m] != now[:m])
        same = int(differ[0]) if len(differ) else m
        del path[same + 1:]
        for t in now[same:].tolist():
            parent.append(path[-1]), label.append(t), depth.append(len(path))
            path.append(len(parent) - 1)
        ends.append(path[-1])
        before, at = now, at + c
    trie, slot = pack_trie(parent, label, depth)
    end = np.zeros(len(rows), END)
    end["slot"], end["n"], end["conv"] = slot[ends], [r[2] for r in rows], [r[3] for r in rows]
    end["key"] = [r[4].encode() for r in rows]
    n, conv = counts(trie, trie.levels(), end)
    inner = np.zeros(len(trie.check), bool)
    inner[trie.check[trie.check >= 0]] = True
    shared = {}
    for i in (0, len(rows) - 1):
        begin = sum(count[:i])
        digest, names = hashlib.md5(), [hashlib.md5().hexdigest()]
        for t in rows[i][0]:
            digest.update(t.encode())
            names.append(digest.hexdigest())
        for d, (s, name) in enumerate(zip(trie.walk(ids[begin: begin + count[i]]), names)):
            shared[s] = {"slot": s, "depth": d, "path": name, "n": int(n[s]), "conv": int(conv[s]), "inner": bool(inner[s])}
    # the length of a slot's last text, ready for the traversal
    last = np.zeros(len(trie.check), np.int64)
    kids = np.flatnonzero(trie.check >= 0)
    last[kids] = length[kids - trie.base[trie.check[kids]]]
    return {"shard": shard, "base": trie.base.tobytes(), "check": trie.check.tobytes(), "length": last.tobytes(), "ends": end.tobytes(), "shared": list(shared.values())}


def counts(trie: DoubleArray, levels: list[np.ndarray], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and smallest member of each slot, from the sequences of this shard."""
    n, conv = np.zeros(len(trie.check), np.int64), np.full(len(trie.check), np.iinfo(np.int64).max)
    np.add.at(n, end["slot"], end["n"])
    np.minimum.at(conv, end["slot"], end["conv"])
    for level in levels[:0:-1]:
        np.add.at(n, trie.check[level], n[level])
        np.minimum.at(conv, trie.check[level], conv[level])
    return n, conv


NODES = pa.schema([("path", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("key", pa.string())])
NODES_DDL = "path string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key string"


def traverse(row: dict) -> pa.RecordBatch:
    """Nodes of a shard; those with a `path` are shared and carry this shard's part of the sums."""
    trie = DoubleArray(np.frombuffer(row["base"], np.int32), np.frombuffer(row["check"], np.int32))
    end, length = np.frombuffer(row["ends"], END), np.frombuffer(row["length"], np.int64)
    levels, size = trie.levels(), len(trie.check)
    n, conv = counts(trie, levels, end)
    path, owned, inner = {}, np.ones(size, bool), np.zeros(size, bool)
    inner[trie.check[trie.check >= 0]] = True
    for s in row["merged"] or []:
        n[s["slot"]], conv[s["slot"]], path[s["slot"]] = s["n"], s["conv"], s["path"]
        owned[s["slot"]], inner[s["slot"]] = s["owner"] == row["shard"], s["inner"]
    saved = np.where(owned, (n - 1) * length, 0)
    leaves, children = (owned & ~inner).astype(np.int64), np.zeros(size, np.int64)
    for level in levels[:0:-1]:
        up = trie.check[level]
        np.add.at(saved, up, saved[level])
        np.add.at(leaves, up, leaves[level])
        np.add.at(children, up, owned[level].astype(np.int64))
    slots = np.concatenate(levels)
    depth = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    up = trie.check[slots]
    key = dict(zip(end["slot"].tolist(), end["key"].tolist()))
    columns = [pa.array([path.get(s) for s in slots.tolist()], pa.string()), pa.array(conv[slots]), pa.array(depth), pa.array(conv[np.maximum(up, 0)], mask=up < 0), pa.array(n[slots]),
               pa.array(children[slots]), pa.array(leaves[slots]), pa.array(saved[slots]), pa.array([k.decode() if (k := key.get(s)) is not None else None for s in slots.tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=NODES)


def _trie_task(shard_turns: int):
    def task(batches):
        part, done, rows, turns = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if rows and turns + len(row[0]) > shard_turns:
                    yield pa.RecordBatch.from_pylist([build_shard(part + done, rows)], schema=TRIE)
                    done, rows, turns = done + 1, [], 0
                rows.append(row)
                turns += len(row[0]) + 1
        if rows:
            yield pa.RecordBatch.from_pylist([build_shard(part + done, rows)], schema=TRIE)

    return task


def _nodes_task(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield traverse(batch.slice(i, 1).to_pylist()[0])


# ---------------------------------------------------------------------------
# Digests of ids
# ---------------------------------------------------------------------------

def _runs(batches) -> Iterator[tuple[str, list]]:
    """(key, rows after the key) of consecutive equal keys, in runs of at most PACK_IDS rows."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if row[0] != key or len(rows) >= PACK_IDS:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


def _pack_ids(batches):
    for key, rows in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([rows[0][0]], pa.int64()), pa.array([",".join(str(r[0]) for r in rows)])], names=["key", "first", "ids"])


def _hash_ids(batches):
    key, digest = None, None
    for k, rows in _runs(batches):
        if k != key:
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])
            key, digest = k, hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(",".join(r[1] for r in rows).encode())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def ends_digests(seqs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of each distinct sequence: its conversations' ids, ascending."""
    packed = seqs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pack_ids, "key string, first long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_ids, "key string, ends_sha256 string")


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def rebuilt(conversations: DataFrame, shared_from: int = 100, most_shared: int = 6) -> DataFrame:
    """(conv_id, key, turns, lengths): the first h turns of the conversation c - c % `shared_from`, then c's own after its first h.

    h is the unsigned crc32 of c in decimal modulo `most_shared`.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(role, F.lit("\0"), text)).alias("id"), F.length(text).alias("n"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    own = stage(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "turns")
    heads = own.where(F.col("conv_id") % shared_from == 0).select(F.col("conv_id").alias("start"), F.slice("own", 1, most_shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int")
    joined = own.withColumn("start", F.col("conv_id") - F.col("conv_id") % shared_from).join(heads, "start", "left").withColumn("h", h)
    turns = F.expr("concat(coalesce(slice(head, 1, h), slice(own, 1, 0)), slice(own, h + 1, greatest(size(own) - h, 0)))")
    seqs = joined.select("conv_id", turns.alias("t")).select("conv_id", F.col("t.id").alias("turns"), F.col("t.n").alias("lengths"))
    return seqs.select("conv_id", F.md5(F.array_join("turns", "")).alias("key"), "turns", "lengths")


def conversation_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of all rebuilt conversations."""
    seqs = stage(rebuilt(conversations), "sequences")
    distinct = seqs.groupBy("key").agg(F.first("turns").alias("turns"), F.first("lengths").alias("lengths"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    dealt = distinct.repartitionByRange(F.slice("turns", 1, KEY_TURNS)).sortWithinPartitions("turns")
    tries = stage(dealt.select("turns", "lengths", "n", "conv", "key").mapInArrow(_trie_task(shard_turns), TRIE_DDL), "tries")
    # nodes that several shards hold
    paths = tries.select("shard", F.explode("shared").alias("s")).select("shard", "s.*")
    several = (paths.groupBy("path").agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("shard").alias("owner"), F.max("inner").alias("inner"))
               .where("shards > 1").drop("shards"))
    merged = paths.select("shard", "slot", "path").join(several, "path").groupBy("shard").agg(F.collect_list(F.struct("slot", "path", "n", "conv", "owner", "inner")).alias("merged"))
    nodes = stage(tries.drop("shared").join(merged, "shard", "left").mapInArrow(_nodes_task, NODES_DDL), "nodes")
    shared = nodes.where("path is not null").groupBy("path").agg(*[f(c).alias(c) for c, f in (
        ("conv_id", F.min), ("depth", F.min), ("parent_conv_id", F.min), ("n_convs", F.min), ("n_children", F.sum), ("n_leaves", F.sum), ("saved_tokens", F.sum), ("key", F.max))])
    whole = nodes.where("path is null").unionByName(shared).drop("path")
    return whole.join(ends_digests(seqs), "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                                F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
