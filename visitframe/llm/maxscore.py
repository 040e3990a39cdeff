"""Ranked lexical search with Block-Max MaxScore over an index of document shards.

Index. Each task cuts its documents into shards of some megabytes. A shard has one row per term: its postings in document
order, in blocks of `BLOCK`, each block packed as variable-length bytes (gap, frequency) with its last document and its
largest impact kept outside; and one row with the documents' ids and length factors. The index is a table: a term's
document frequency is a sum over it, and a query reads the rows of its terms only.

Search. The lists of the asked terms are dealt out by shard; a task walks through its shards and keeps one heap of the `k`
best documents per item, so later shards meet a high threshold. For an item the lists are ordered by their bound (weight
times largest impact). The longest run of weakest lists whose bounds together stay below the threshold is non-essential:
no document found there alone can enter. The essential lists are unpacked and summed. Then each non-essential list, from
strong to weak, first rejects candidates by the maximum of the block that could hold them, and only the blocks of the
rest are unpacked. Heaps of all tasks are merged by a ranked window. Bounds are whole numbers and a candidate at the
threshold is kept, so ranks and ties are exact.

Items are dealt into query blocks of about `ITEMS` each, so their number has no limit; the terms of a query block meet
the index by a join (broadcast within a checked bound).

Null, empty and wordless texts have no terms and are not counted. Rows with a null or repeated id are documents of their
own; a null id ranks last among equal scores. Every item row has a list of its own; an item without terms, or whose terms
occur nowhere, has no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitframe.llm.blocks import ALNUM
from visitframe.llm.terms import Piece, gather, pieces
from visitframe.scaling import broadcast_if_small
from visitframe.session import spread, stage

#: term bytes once A-Z are lower-cased, as a pattern over code points
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 18
BLOCK = 128
ITEMS = 256
#: (query block, term) rows that may be broadcast; a row holds a few numbers for each item that uses the term
USE_ROWS = 20_000
NO_ID = np.int64(2**63 - 1)
INDEX = "shard long, term string, n int, last binary, best binary, ends binary, payload binary"


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + 25 * length / mean length, in whole numbers."""
    return 75 + 25 * n * n_docs // n_terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturated frequency, in millionths."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


# ---------------------------------------------------------------------------
# Packed postings
# ---------------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): seven bits a byte, the last byte of a value below 128."""
    size = np.ones(len(values), np.int64)
    for b in (7, 14, 21, 28):
        size += values >= 1 << b
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - size
    for j in range(5):
        has = np.flatnonzero(size > j)
        part = values[has] >> 7 * j & 127
        out[first[has] + j] = part | np.where(size[has] - 1 > j, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    first = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(ends) else np.zeros(0, np.int64)


# ---------------------------------------------------------------------------
# Building shards
# ---------------------------------------------------------------------------

@dataclass
class Shard:
    """Collects documents, piece by piece, and gives their index rows."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    hash: list = field(default_factory=list)
    doc: list = field(default_factory=list)
    tf: list = field(default_factory=list)
    names: list = field(default_factory=list)
    size: int = 0

    def add(self, piece: Piece, ids: list) -> None:
        w, base = piece.words, len(self.ids)
        if not piece.begins:  # goes on with the last document
            base -= 1
            self.lengths[-1] += len(w.hash)
        else:
            self.ids += ids
            self.lengths += w.count.tolist()
        self.size += len(piece.data)
        if not len(w.hash):
            return
        order = np.argsort(w.hash, kind="stable")
        h, d = w.hash[order], w.row_of()[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.flatnonzero(new | np.concatenate([[True], d[1:] != d[:-1]]))
        self.hash.append(h[run])
        self.doc.append(d[run] + base)
        self.tf.append(np.diff(np.append(run, len(h))))
        first = order[np.flatnonzero(new)]
        text, begin = gather(piece.data, w.start[first], w.end[first] - w.start[first])
        self.names.append((h[new], text, begin))

    def rows(self, shard: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        m = length_factor(np.array(self.lengths, np.int64), n_docs, n_terms)
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        none = np.array([i is None for i in self.ids], np.uint8)
        head = [[shard], [None], [len(ids)], [ids.tobytes()], [m.tobytes()], [none.tobytes()], [b""]]
        head = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(head, SCHEMA)], schema=SCHEMA)
        if not self.hash:
            return head
        h = np.concatenate(self.hash)
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], np.concatenate(self.doc)[order], np.concatenate(self.tf)[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]]))  # a long document came in several pieces
        h, doc, tf, new = h[at], doc[at], np.add.reduceat(tf, at), new[at]
        term = np.flatnonzero(new)
        n = np.diff(np.append(term, len(h)))
        place = np.arange(len(h)) - np.repeat(term, n)
        block = np.flatnonzero(place % BLOCK == 0)
        gap = doc - np.where(new, -1, np.concatenate([[0], doc[:-1]]))
        data, ends = pack(np.stack([gap, tf], axis=1).ravel())
        ends = ends[1::2]
        done = np.append(block[1:], len(h)) - 1  # last posting of each block
        first_block = np.searchsorted(block, np.append(term, len(h)))
        stop = ends[done]
        base = np.concatenate([[0], ends])[term]
        best = np.maximum.reduceat(impacts(tf, m[doc]), block)
        inner = stop - np.repeat(base, np.diff(first_block))
        bounds = (4 * first_block).astype(np.int32)
        payload = np.append(base, ends[-1]).astype(np.int32)
        # names: the first piece that holds a term gives it
        seen = np.concatenate([x[0] for x in self.names])
        lengths = np.concatenate([np.diff(x[2]) for x in self.names])
        text = np.concatenate([x[1] for x in self.names])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        once = np.unique(seen, return_index=True)[1]
        name, begin = gather(text, starts[once], lengths[once])
        table = pa.RecordBatch.from_arrays([
            pa.array(np.full(len(term), shard)), _strings(pa.string(), begin.astype(np.int32), name), pa.array(n.astype(np.int32)),
            _strings(pa.binary(), bounds, doc[done].astype(np.int32)), _strings(pa.binary(), bounds, best.astype(np.int32)),
            _strings(pa.binary(), bounds, inner.astype(np.int32)), _strings(pa.binary(), payload, data)], schema=SCHEMA)
        return pa.Table.from_batches([head, table]).combine_chunks().to_batches()[0]


SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("last", pa.binary()), ("best", pa.binary()), ("ends", pa.binary()), ("payload", pa.binary())])


def _strings(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


# ---------------------------------------------------------------------------
# Searching a shard
# ---------------------------------------------------------------------------

class PostingList:
    """One term's list in a shard; blocks are unpacked when asked for."""

    def __init__(self, weight: int, last: bytes, best: bytes, ends: bytes, payload: bytes, m: np.ndarray):
        self.weight, self.m = weight, m
        self.last, self.best = np.frombuffer(last, np.int32), np.frombuffer(best, np.int32).astype(np.int64)
        self.ends = np.concatenate([[0], np.frombuffer(ends, np.int32)])
        self.payload = np.frombuffer(payload, np.uint8)
        self.top = int(self.best.max())
        self.full: tuple[np.ndarray, np.ndarray] | None = None
        self.unpacked = 0

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of some blocks."""
        size = self.ends[which + 1] - self.ends[which]
        data, _ = gather(self.payload, self.ends[which], size)
        pairs = unpack(data)
        gap, tf = pairs[::2], pairs[1::2]
        self.unpacked += len(which)
        # a block begins after the last document of the one before it
        count = np.full(len(which), BLOCK)
        count[which == len(self.last) - 1] = len(gap) - BLOCK * (len(which) - 1)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        before = np.where(which > 0, self.last[which - 1], -1)
        total = np.cumsum(gap)
        doc = total + np.repeat(before - (total[first] - gap[first]), count)
        return doc, impacts(tf, self.m[doc])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.full is None:
            self.full = self.blocks(np.arange(len(self.last)))
        return self.full


def best_documents(lists: list[PostingList], times: list[int], n_docs: int, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents of a shard that score `threshold` or more and may be among its `k` best."""
    factor = np.array([p.weight * t for p, t in zip(lists, times)], np.int64)
    bound = factor * np.array([p.top for p in lists], np.int64)
    order = np.argsort(bound, kind="stable")
    order = order[bound[order] > 0]
    reach = np.cumsum(bound[order])
    weak = int(np.searchsorted(reach, threshold, "left"))
    score = np.zeros(n_docs, np.int64)
    for j in order[weak:]:
        doc, impact = lists[j].all()
        score[doc] += factor[j] * impact
    cand = np.flatnonzero(score)
    score = score[cand]
    for i in range(weak - 1, -1, -1):
        if len(score) > k:  # partial sums are lower bounds
            threshold = max(threshold, int(np.partition(score, -k)[-k]))
        alive = score + reach[i] >= threshold
        cand, score = cand[alive], score[alive]
        if not len(cand):
            break
        p, f = lists[order[i]], factor[order[i]]
        block = np.searchsorted(p.last, cand)
        inside = block < len(p.last)
        most = np.where(inside, p.best[np.minimum(block, len(p.last) - 1)], 0) * f
        alive = score + most + (reach[i - 1] if i else 0) >= threshold
        cand, score, block = cand[alive], score[alive], block[alive & inside] if p.full is None else block[alive]
        if p.full is None and not len(block):
            continue
        doc, impact = p.all() if p.full is not None else p.blocks(np.unique(block))
        at = np.minimum(np.searchsorted(doc, cand), len(doc) - 1)
        score = score + np.where(doc[at] == cand, impact[at], 0) * f
    alive = score >= threshold
    return cand[alive], score[alive]


class Heaps:
    """The k best (score, id) of each item, over all shards of a task; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def threshold(self, item: int) -> int:
        held = self.rows.get(item)
        return int(held[0][-1]) if held is not None and len(held[0]) == self.k else 1

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if item in self.rows:
            score, ids, none = (np.concatenate([a, b]) for a, b in zip(self.rows[item], (score, ids, none)))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.rows[item] = score[order], ids[order], none[order]

    def table(self, id_type: pa.DataType) -> pa.RecordBatch:
        items = list(self.rows)
        score, ids, none = (np.concatenate([self.rows[i][j] for i in items]) for j in range(3)) if items else (np.zeros(0, np.int64),) * 3
        uid = np.repeat(np.array(items, np.int64), [len(self.rows[i][0]) for i in items])
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids, mask=none.astype(bool)).cast(id_type), pa.array(score)], names=["uid", "doc_id", "score"])


def _shards(batches) -> Iterator[tuple[dict, list[tuple]]]:
    """(document row, list rows) of one shard after the other; rows come in order of shard and query block."""
    head, rows = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("shard", "term", "weight", "last", "best", "ends", "payload", "uses")]
        for row in zip(*columns):
            if row[1] is None:
                if head is not None:
                    yield head, rows
                head, rows = row, []
            else:
                rows.append(row)
    if head is not None:
        yield head, rows


def search_task(k: int, id_type: pa.DataType):
    def task(batches):
        heaps = Heaps(k)
        for head, rows in _shards(batches):
            ids, m, none = np.frombuffer(head[3], np.int64), np.frombuffer(head[4], np.int64), np.frombuffer(head[5], np.uint8)
            lists: dict[str, PostingList] = {}
            asked: dict[int, tuple[list, list]] = {}
            for _, term, weight, last, best, ends, payload, uses in rows:
                p = lists.get(term)
                if p is None:
                    p = lists[term] = PostingList(weight, last, best, ends, payload, m)
                for u in uses:
                    chosen = asked.setdefault(u["uid"], ([], []))
                    chosen[0].append(p), chosen[1].append(u["times"])
            for item, (chosen, times) in asked.items():
                doc, score = best_documents(chosen, times, len(ids), k, heaps.threshold(item))
                if len(doc):
                    heaps.add(item, score, ids[doc], none[doc])
        yield heaps.table(id_type)

    return task


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

class LexicalIndex:
    """Index of all rows of `docs`, written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
        docs = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        self.id_field = docs.schema["id"].dataType
        self.id_type = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[self.id_field.simpleString()]
        self.n_docs, self.n_terms = self._sizes(docs)
        self.table = stage(self._build(docs, shard_bytes), "postings") if self.n_terms else None

    @staticmethod
    def _sizes(docs: DataFrame) -> tuple[int, int]:
        """(documents with a term, terms of all)."""

        def task(batches):
            for batch in batches:
                docs = terms = 0
                for p in pieces(batch.column(0), ALNUM, lower=True):
                    n = p.words.count
                    docs += int((n > 0).sum()) if not p.before else 0
                    terms += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

        r = docs.select("text").mapInArrow(task, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        return r[0], r[1]

    def _build(self, docs: DataFrame, shard_bytes: int) -> DataFrame:
        n_docs, n_terms = self.n_docs, self.n_terms

        def task(batches):
            part, done, shard = TaskContext.get().partitionId() << 32, 0, Shard()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for p in pieces(batch.column(1), ALNUM, lower=True):
                    shard.add(p, ids[p.first: p.first + p.rows])
                    if p.last and (shard.size >= shard_bytes or len(shard.ids) >= SHARD_DOCS):
                        yield shard.rows(part + done, n_docs, n_terms)
                        done, shard = done + 1, Shard()
            if shard.ids:
                yield shard.rows(part + done, n_docs, n_terms)

        return docs.mapInArrow(task, INDEX)

    def search(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
        """The `k` best documents of each item: item id, rank, doc_id, score."""
        spark = items.sparkSession
        items = stage(items.select(F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("uid"), F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text")), "items")
        n_items = items.count()
        schema = f"`{id_col}` {items.schema['item'].dataType.simpleString()}, rank int, doc_id {self.id_field.simpleString()}, score long"
        if self.table is None or not n_items:
            return spark.createDataFrame([], schema)
        block = F.pmod(F.xxhash64("uid"), F.lit(-(-n_items // ITEMS))).cast("int").alias("block")
        words = F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")
        uses = items.select("uid", words).groupBy("uid", "term").agg(F.count("*").alias("times")).select("uid", "term", "times", block)
        uses = stage(uses.groupBy("block", "term").agg(F.collect_list(F.struct("uid", "times")).alias("uses")), "item-terms")
        terms = self.table.where(F.col("term").isNotNull())
        # document frequencies of the asked terms
        asked = uses.select("term").distinct()
        df = terms.select("term", "n").join(broadcast_if_small(asked), "term").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(float(self.n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
        uses = stage(uses.join(df.select("term", weight.alias("weight")), "term"), "item-weights")
        lists = terms.join(broadcast_if_small(uses, USE_ROWS), "term").select("shard", "term", "weight", "last", "best", "ends", "payload", "uses", "block")
        heads = self.table.where(F.col("term").isNull()).select("shard", "term", F.lit(None).cast("long").alias("weight"), "last", "best", "ends", "payload",
                                                                F.lit(None).cast("array<struct<uid:bigint,times:bigint>>").alias("uses"), F.lit(-1).alias("block"))
        dealt = heads.unionByName(lists).repartition("shard").sortWithinPartitions("shard", "block")
        found = dealt.drop("block").mapInArrow(search_task(k, self.id_type), f"uid long, doc_id {self.id_field.simpleString()}, score long")
        order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.join(broadcast_if_small(items.select("uid", "item")), "uid").select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
