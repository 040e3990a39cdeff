"""Removal of long repeated passages by recompression.

Each round of recompression turns the symbols of a text into fewer ones: maximal runs of a symbol, and pairs whose left
member is on the left and whose right member is on the right side of a coin tossed per symbol and round, become one
symbol (together: `a...ab...b`). A symbol is named by a hash of the words it stands for, so every task gives the same
name without an exchange. Whether a border between two symbols stays depends on these two symbols only; so equal
passages get equal symbols but for a few at their ends. `Parse` keeps, for each border, the words that decided it, and
knows for every symbol the stretch of words that fixes it (its context).

All windows of `window` words pick, among the symbols whose context lies inside them, the one whose context has the
smallest hash. The choice depends on the window's words alone, so equal windows pick equal symbols. Neighbouring windows
mostly share their pick: one row per pick (`x` = name of the context, `u` = name of all words of its windows) stands for
about a dozen windows. Spark then

1. counts the rows of each `x` and finds whether they differ in `u`. A single row: none of its windows occurs twice.
   Two rows or more and one `u`: all of its windows occur twice, equal names verify whole stretches at once;
2. where an `x` has several `u` (the ends of repeats), compares the windows of each distinct (x, u) one by one;
3. brings the marks back to the documents and cuts the covered words.

Windows without any symbol fixed inside them (periodic passages) stand for themselves, so nothing is lost; those that a
piece holds twice are marked at once, and one row of them goes on to be compared. Equality is
that of two 64-bit hashes (x with u, or x with the window's). Rows of one (x, u) combine before the shuffle; the matches
of names with very many rows are broadcast, so these rows stay where they are. A long text is parsed piece by piece with an overlap of `window - 1` words: a pick looks
at its window only, so the pieces change nothing but the extent of a few `u`, which step 2 compares.

Null and empty texts have no words; rows with a null id and repeated rows are documents of their own (a repeated row
repeats all its windows); rows of one id with different texts are told apart by a 32-bit hash of the text.
Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.blocks import NOT_SPACE, mix, string_buffers
from visitframe.llm.terms import Spans, cut_words, gather, pieces
from visitframe.scaling import broadcast_if_small
from visitframe.session import spread, stage

WINDOW = 35
ROUNDS = 3
#: rows of one name that may meet in a task
HOT_ROWS = 10_000
#: windows of a group: their marks are bits of one long
LONGEST = 60
FAR = np.int64(1) << np.int64(40)
_U = np.uint64


@dataclass
class Parse:
    """Symbols of a run of rows after all rounds: first word, and the words [low, high) that fix each of them."""

    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


def recompress(words: np.ndarray, row_start: np.ndarray, spans: Spans, rounds: int = ROUNDS) -> Parse:
    """Rounds of run and pair compression over all rows at once; the ends of a row are fixed by no word."""
    n = len(words)
    start = np.arange(n, dtype=np.int64)
    name = words
    edge = np.zeros(n + 1, bool)
    edge[row_start] = True
    # before any round every border is there by itself, also a row's end
    low, high = np.arange(n + 1, dtype=np.int64), np.arange(n + 1, dtype=np.int64)
    for r in range(rounds):
        coin = (mix(name + _U(2 * r + 1)) >> _U(63)).astype(bool)
        m = len(start)
        goes = np.zeros(m + 1, bool)
        goes[1:m] = (name[1:] == name[:-1]) | (~coin[:-1] & coin[1:])
        stays = ~goes | edge
        # a border that stays was decided by its two symbols, so by the borders next to it
        low[1:], high[:-1] = low[:-1].copy(), high[1:].copy()
        low[edge], high[edge] = -FAR, FAR
        low, high, edge = low[stays], high[stays], edge[stays]
        start = start[stays[:-1]]
        name = spans.hash(start, np.append(start[1:], n))
    return Parse(start, low[:-1], high[1:])


def _least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest value in each [lo, hi); ranges are not empty."""
    table = [np.arange(len(values), dtype=np.int32)]
    width = hi - lo
    top = int(width.max()) if len(width) else 1
    while 2 << (len(table) - 1) <= top:
        before, step = table[-1], 1 << (len(table) - 1)
        left, right = before[:-step], before[step:]
        table.append(np.where(values[left] <= values[right], left, right))
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.zeros(len(lo), np.int64)
    for j, t in enumerate(table):
        w = np.flatnonzero(level == j)
        left, right = t[lo[w]], t[hi[w] - (1 << j)]
        out[w] = np.where(values[left] <= values[right], left, right)
    return out


@dataclass
class Groups:
    """Windows that share their pick: names, first word of the first window, number of windows.

    `known` groups hold windows that occur twice in the piece itself and need no comparison.
    """

    x: np.ndarray
    u: np.ndarray
    start: np.ndarray
    n: np.ndarray
    known: np.ndarray


def _stretches(at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of runs of windows between the cuts."""
    g = np.flatnonzero(cut)
    return g, np.diff(np.append(g, len(at)))


def window_groups(words: np.ndarray, row_start: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Groups:
    """Groups of the windows of all rows; a window lies inside one row."""
    spans = Spans(words)
    count = np.diff(row_start)
    row = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(words)) + window <= row_start[1:][row])
    p = recompress(words, row_start, spans, rounds)
    fixed = (p.low >= 0) & (p.high < FAR)
    low, high = p.low[fixed], p.high[fixed]
    name = spans.hash(low, high)
    first, beyond = np.searchsorted(low, at, "left"), np.searchsorted(high, at + window, "right")
    has = first < beyond
    a, pick = at[has], _least_in(mix(name), first[has], beyond[has])
    g, n = _stretches(a, np.concatenate([[True], (pick[1:] != pick[:-1]) | (a[1:] != a[:-1] + 1)])[: len(a)])
    s, k = a[g], pick[g]
    with np.errstate(over="ignore"):
        u = mix(spans.hash(s, s + n + window - 1) + (low[k] - s).astype(_U) * _U(0x9E3779B97F4A7C15))
    # windows that nothing inside them fixes: one row for each that the piece holds once or for the first time
    alone = at[~has]
    own, once, back, times = np.unique(spans.hash(alone, alone + window), return_index=True, return_inverse=True, return_counts=True)
    twice = alone[times[back] > 1]
    far = np.concatenate([[True], (twice[1:] != twice[:-1] + 1) | (row[twice[1:]] != row[twice[:-1]])])[: len(twice)]
    since = np.arange(len(twice)) - np.flatnonzero(far)[np.cumsum(far) - 1] if len(twice) else np.zeros(0, np.int64)
    t, m = _stretches(twice, far | (since % LONGEST == 0))
    none = np.zeros(len(t), _U)
    return Groups(np.concatenate([name[k], own ^ _U(0xA5A5A5A5A5A5A5A5), none]), np.concatenate([u, own, none]), np.concatenate([s, alone[once], twice[t]]),
                  np.concatenate([n, np.ones(len(own), np.int64), m]), np.repeat([False, False, True], [len(s), len(own), len(t)]))


def document_groups(column: pa.Array, window: int, rounds: int, max_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, Groups]]:
    """(row of the batch, groups with word numbers inside the row) piece by piece."""
    tail = np.zeros(0, _U)
    for p in pieces(column, NOT_SPACE, lower=False, max_bytes=max_bytes):
        words, row_start, skip = p.words.hash, p.words.row_start, 0
        if p.before:
            words, skip = np.concatenate([tail, words]), len(tail)
            row_start = np.array([0, len(words)])
        tail = words[-(window - 1):] if not p.last else np.zeros(0, _U)
        g = window_groups(words, row_start, window, rounds)
        row = np.searchsorted(row_start, g.start, "right") - 1
        g.start = g.start - row_start[row] + (p.before - skip)
        yield row + p.first, g


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _listed(column) -> tuple[np.ndarray, pa.StructArray]:
    """(row boundaries, flat structs) of a list column; a null list is an empty one."""
    flat = column.flatten()
    size = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(size)]), flat


def _spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their match in `table`, which has one row per key and the number `c` of rows that carry it.

    A key with more than `HOT_ROWS` rows is broadcast, so its rows stay where they are; there are few such keys, and
    their number is checked. All others meet by a shuffle.
    """
    hot = table.where(F.col("c") > HOT_ROWS)
    return (rows.join(broadcast_if_small(hot), keys).unionByName(rows.join(table.where(F.col("c") <= HOT_ROWS), keys))).drop("c")


class RepeatedPassages:
    """Finds and cuts words of windows that occur more than once in `docs`."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS):
        if not 2 <= window <= LONGEST:
            raise ValueError("a window has 2 to 60 words")
        self.window, self.rounds = window, rounds
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.docs = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("f", F.hash("text"))

    def groups(self) -> DataFrame:
        """One row per group of windows: x, u, id, f, s (first word), n (windows), known (occurs twice in its piece)."""
        window, rounds = self.window, self.rounds

        def task(batches):
            for batch in batches:
                for row, g in document_groups(batch.column(2), window, rounds):
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([_signed(g.x), _signed(g.u), batch.column(0).take(at), batch.column(1).take(at), pa.array(g.start.astype(np.int32)), pa.array(g.n.astype(np.int32)), pa.array(g.known)],
                                                     names=["x", "u", "id", "f", "s", "n", "known"])

        return self.docs.select("id", "f", "text").mapInArrow(task, f"x long, u long, id {self.kind}, f int, s int, n int, known boolean")

    def _with_lists(self, lists: DataFrame, how: str) -> DataFrame:
        """Documents with their lists, matched by id (also a null one) and text hash."""
        lists = lists.withColumnsRenamed({"id": "__id", "f": "__f"})
        match = F.col("id").eqNullSafe(F.col("__id")) & (F.col("f") == F.col("__f"))
        return self.docs.join(lists, match, how).drop("__id", "__f")

    def _variant_windows(self, variants: DataFrame) -> DataFrame:
        """Window hashes of one place of each (x, u): x, u, h, off (window of the group), n (rows of the (x, u))."""
        window = self.window
        lists = variants.groupBy("at.id", "at.f").agg(F.collect_list(F.struct("x", "u", F.col("at.s").alias("s"), F.col("at.n").alias("w"), "n")).alias("l"))

        def task(batches):
            for batch in batches:
                text, column = batch.column(0), batch.column(1)
                bounds, flat = _listed(column)
                x, u, s, w, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                done = np.zeros(0, _U)
                for p in pieces(text, NOT_SPACE, lower=False):
                    # a long text: its words come in parts, hashed together once all are there
                    done = np.concatenate([done, p.words.hash]) if p.before else p.words.hash
                    if not p.last:
                        continue
                    row_start = p.words.row_start if not p.before else np.array([0, len(done)])
                    spans = Spans(done)
                    lo, hi = bounds[p.first], bounds[p.first + p.rows]
                    row = np.searchsorted(bounds, np.arange(lo, hi), "right") - 1 - p.first
                    each = np.repeat(np.arange(lo, hi), w[lo:hi])
                    off = np.arange(len(each)) - np.repeat(np.concatenate([[0], np.cumsum(w[lo:hi])[:-1]]), w[lo:hi]) if hi > lo else np.zeros(0, np.int64)
                    start = row_start[row][each - lo] + s[each] + off
                    yield pa.RecordBatch.from_arrays([pa.array(x[each]), pa.array(u[each]), _signed(spans.hash(start, start + window)), pa.array(off.astype(np.int32)), pa.array(n[each])],
                                                     names=["x", "u", "h", "off", "n"])

        return self._with_lists(lists, "inner").select("text", "l").mapInArrow(task, "x long, u long, h long, off int, n long")

    def marks(self) -> DataFrame:
        """(id, f, marks): per document the groups with a repeated window, as (first word, bits of the repeated ones)."""
        groups = stage(self.groups(), "window-groups")
        named = groups.where(~F.col("known")).drop("known")
        again = named.groupBy("x").agg(F.count("*").alias("c"), F.min("u").alias("a"), F.max("u").alias("b")).where("c > 1").select("x", "c", (F.col("a") != F.col("b")).alias("varied"))
        found = stage(_spread_join(named, stage(again, "repeated-names"), ["x"]), "repeated-groups")
        full = F.expr("shiftleft(1L, n) - 1").alias("bits")
        plain = found.where(~F.col("varied")).select("id", "f", "s", full).union(groups.where("known").select("id", "f", "s", full))
        varied = found.where("varied")
        variants = stage(varied.groupBy("x", "u").agg(F.count("*").alias("n"), F.min(F.struct("id", "f", "s", "n")).alias("at")), "variants")
        windows = stage(self._variant_windows(variants), "variant-windows")
        twice = stage(windows.groupBy("x", "h").agg(F.sum("n").alias("total"), F.count("*").alias("c")).where("total > 1").select("x", "h", "c"), "repeated-windows")
        bits = _spread_join(windows, twice, ["x", "h"]).groupBy("x", "u").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"), F.max("n").alias("c"))
        ends = _spread_join(varied, stage(bits, "repeated-bits"), ["x", "u"]).select("id", "f", "s", "bits")
        return plain.union(ends).groupBy("id", "f").agg(F.collect_list(F.struct("s", "bits")).alias("marks"))

    def cut(self, keep_text: bool = False) -> DataFrame:
        """One row per document: doc_id, n_words, n_removed, kept_sha256; the text that is left on request."""
        window = self.window
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

        def task(batches):
            for batch in batches:
                ids, text = batch.column(0), batch.column(1)
                bounds, flat = _listed(batch.column(2))
                s, bits = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                n_words, n_removed, digest, kept = [], [], [], []
                state, parts, n, gone = hashlib.sha256(), [], 0, 0
                for p in pieces(text, NOT_SPACE, lower=False):
                    w = p.words
                    lo, hi = bounds[p.first], bounds[p.first + p.rows]
                    hit = covered(s[lo:hi], bits[lo:hi], np.searchsorted(bounds, np.arange(lo, hi), "right") - 1 - p.first, w.row_start, p.before, window)
                    left = np.flatnonzero(~hit)
                    out, begin = gather(p.data, w.start[left], w.end[left] - w.start[left], gap=1)
                    edge = begin[np.searchsorted(left, w.row_start)]
                    removed = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.row_start])
                    for r in range(p.rows):
                        new = out[edge[r]: edge[r + 1]].tobytes()[:-1]
                        if new:
                            state.update(b" " + new if parts else new)
                            parts.append(new if keep_text else b"")
                        n, gone = n + int(w.row_start[r + 1] - w.row_start[r]), gone + int(removed[r])
                        if p.last:
                            n_words.append(n), n_removed.append(gone), digest.append(state.hexdigest())
                            kept.append(b" ".join(parts).decode() if keep_text else None)
                            state, parts, n, gone = hashlib.sha256(), [], 0, 0
                columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())] + [pa.array(kept, pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = f"doc_id {self.kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
        return self._with_lists(self.marks(), "left").select("id", "text", "marks").mapInArrow(task, schema)


def covered(s: np.ndarray, bits: np.ndarray, row: np.ndarray, row_start: np.ndarray, before: int, window: int) -> np.ndarray:
    """Which words of a piece lie in a marked window; `s` counts words inside the row, of which `before` came earlier."""
    total = int(row_start[-1])
    change = np.zeros(total + 1, np.int64)
    bits = bits.view(_U) if bits.dtype == np.int64 else bits.astype(np.int64).view(_U)
    first, stop = row_start[:-1][row], row_start[1:][row]
    for sign, ends, reach in ((1, bits & ~(bits << _U(1)), 0), (-1, bits & ~(bits >> _U(1)), window)):
        for off in range(LONGEST):
            on = np.flatnonzero(ends >> _U(off) & _U(1))
            np.add.at(change, np.clip(first[on] - before + s[on] + off + reach, first[on], stop[on]), sign)
    return np.cumsum(change)[:total] > 0


def brute(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same by a plain dictionary of windows, for tests: (words, removed words, digest of what is left)."""
    cut = []
    for t in texts:
        column = pa.array([t], pa.string())
        data, offsets = string_buffers(column)
        w = cut_words(data[offsets[0]: offsets[-1]], offsets - offsets[0], NOT_SPACE)
        cut.append([data[offsets[0]:][a:b].tobytes() for a, b in zip(w.start, w.end)])
    seen: dict[tuple, int] = {}
    for words in cut:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for words in cut:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return out
