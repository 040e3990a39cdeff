"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task holds of the corpus at a time, up to `SHARD_WORDS`
indexed words. Its text is a sequence of word numbers; the index is the
Burrows-Wheeler transform in a wavelet matrix with a sampled suffix array.
All test phrases are searched backwards at once (one vectorised rank per word
and level), their occurrences are located from the samples and merged to spans.

Only words that some phrase holds can lie in an occurrence. So the texts are cut
at all other words, and pieces shorter than the shortest phrase are left out
before indexing; this drops no occurrence.

Phrases come in blocks of at most `PHRASE_CHARS` characters, which bounds what is
broadcast. A larger benchmark takes one pass of tasks per block, chained without
a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.blocks import ALNUM, Words, hash_words, text_blocks, words_of

WINDOW = 13
SHARD_WORDS = 1 << 18
SAMPLE = 8
PHRASE_CHARS = 8_000_000


# ---------------------------------------------------------------------------
# The index
# ---------------------------------------------------------------------------

def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still tied are sorted again."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(np.concatenate([[True], seq[sa][1:] != seq[sa][:-1]]))
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))  # place of the first of its group
    tied = np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n)))
    step = 1
    while tied.any():
        at = np.flatnonzero(tied)
        s = sa[at]
        ahead = s + step
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        own = rank[s]
        order = np.lexsort((nxt, own))
        s, own, nxt = s[order], own[order], nxt[order]
        sa[at] = s
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        rank[s] = np.repeat(at[first], size)
        tied = np.zeros(n, bool)
        tied[at] = np.repeat(size > 1, size)
        step *= 2
    return sa


class WaveletMatrix:
    """Ranks of a symbol before a place, one bit of the symbol per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((seq >> bit) & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones, dtype=np.int32)])))
            self.zeros.append(int(len(seq) - ones.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        lo = np.zeros_like(place)
        hi = place
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(up, zeros + a, lo - a)
            hi = np.where(up, zeros + b, hi - b)
        return hi - lo

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        value = np.zeros(len(place), np.int64)
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            up = ones[place + 1] - ones[place]
            value |= up.astype(np.int64) << bit
            place = np.where(up == 1, zeros + ones[place], place - ones[place])
        return value


class FMIndex:
    """Backward search and location over a sequence of numbers; 0 is a separator that no phrase holds."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        symbols += 1
        seq = np.append(seq.astype(np.int64) + 1, 0)  # an end that is smaller than all and stands once
        n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.tree = WaveletMatrix(bwt, symbols)
        sampled = sa % sample == 0
        self.sampled, self.sample_rank, self.samples = sampled, np.concatenate([[0], np.cumsum(sampled)]), sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase (right-aligned rows of symbols)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for j in range(width - 1, -1, -1):
            live = live[(lengths[live] >= width - j) & (lo[live] < hi[live])]
            if not len(live):
                break
            symbol = phrases[live, j] + 1
            base = self.before[symbol]
            lo[live], hi[live] = base + self.tree.rank(symbol, lo[live]), base + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to the next sampled one."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            at = rows[open_]
            symbol = self.tree.access(at)
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, at)
            walked[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.samples[self.sample_rank[rows]] + walked


# ---------------------------------------------------------------------------
# Phrases
# ---------------------------------------------------------------------------

class Phrases:
    """Distinct windows of a block of items, as rows of word numbers with the items that hold them.

    Windows of an item without an id are searched too, but name no item.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        words = hash_words([t for _, t in items], ALNUM)
        self.vocabulary, codes = np.unique(words.hash, return_inverse=True)
        codes = codes + 1
        owners: dict[bytes, set[str]] = {}
        for (name, _), lo, hi in zip(items, words.row_start[:-1].tolist(), words.row_start[1:].tolist()):
            for s in range(lo, max(lo + 1, hi - window + 1) if hi > lo else lo):
                owners.setdefault(codes[s: min(hi, s + window)].astype(np.int64).tobytes(), set()).update([] if name is None else [name])
        rows = [np.frombuffer(k, np.int64) for k in owners]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.rows[i, window - len(r):] = r
        self.items = [sorted(v) for v in owners.values()]
        self.shortest = int(self.lengths.min()) if rows else 0
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for a word that no phrase holds."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.likely[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == hashes[at], place + 1, 0)
        return out


def pieces(codes: np.ndarray, words: Words, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each run of numbered words inside a row that can hold a phrase."""
    hot = np.zeros(len(codes) + 2, bool)
    hot[1:-1] = codes > 0
    cut = np.zeros(len(codes) + 1, bool)
    cut[words.row_start] = True
    start = np.flatnonzero(hot[1:] & (~hot[:-1] | cut))
    end = np.flatnonzero(hot[:-1] & (~hot[1:] | cut))
    keep = end - start >= shortest
    return start[keep], (end - start)[keep]


def spread_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


def shard_hits(phrases: Phrases, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, phrase) of every occurrence among the pieces of a shard."""
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    # one separator after each piece
    source = spread_ranges(start, size + 1)
    seq = codes[np.minimum(source, len(codes) - 1)]
    seq[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.where(hi > lo, hi - lo, 0)
    which = np.repeat(np.arange(len(found)), found)
    at = index.locate(spread_ranges(lo, found))
    return source[at], phrases.lengths[which], which


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as disjoint ones in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


# ---------------------------------------------------------------------------
# Tasks
# ---------------------------------------------------------------------------

def search_texts(column: pa.Array, phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[tuple[np.ndarray, list, list]]:
    """Per run of rows: number of words, merged word spans, items. Rows keep their order."""
    held: list[tuple[Words, np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0
    for _, _, data, offsets in text_blocks(column):
        w = words_of(data, offsets, ALNUM)
        codes = phrases.number(w.hash)
        start, size = pieces(codes, w, phrases.shortest) if len(phrases.rows) else (np.zeros(0, np.int64),) * 2
        held.append((w, codes, start, size))
        total += int(size.sum()) + len(size)
        if total >= shard_words:
            yield from _search_held(held, phrases)
            held, total = [], 0
    if held:
        yield from _search_held(held, phrases)


def _search_held(held, phrases: Phrases):
    # only indexed words stay in the shard's sequence, so its memory follows SHARD_WORDS
    packed, firsts, sizes, base = [], [], [], 0
    for w, codes, start, size in held:
        packed.append(codes[spread_ranges(start, size)])
        firsts.append(np.cumsum(size) - size + base)
        sizes.append(size)
        base += int(size.sum())
    first, size = np.concatenate(firsts), np.concatenate(sizes)
    at, length, which = shard_hits(phrases, np.concatenate(packed), first, size)
    owner = np.searchsorted(first, at, "right") - 1  # the piece of each occurrence
    lo_piece = 0
    for w, _, start, sz in held:
        hi_piece = lo_piece + len(start)
        mine = np.flatnonzero((owner >= lo_piece) & (owner < hi_piece))
        word = start[owner[mine] - lo_piece] + at[mine] - first[owner[mine]]
        row = np.searchsorted(w.row_start, word, "right") - 1
        rows = len(w.row_start) - 1
        spans: list[list] = [[] for _ in range(rows)]
        items: list[set] = [set() for _ in range(rows)]
        for r, k in set(zip(row.tolist(), which[mine].tolist())):
            items[r].update(phrases.items[k])
        a, b = merge_spans(word, word + length[mine])
        for r, x, y in zip((np.searchsorted(w.row_start, a, "right") - 1).tolist(), a.tolist(), b.tolist()):
            # spans of two rows can touch but not overlap: cut at the rows' ends
            while y > x:
                stop = min(y, int(w.row_start[r + 1]))
                if stop > x:
                    spans[r].append((x - int(w.row_start[r]), stop - int(w.row_start[r])))
                x, r = stop, r + 1
        yield w.count, spans, [sorted(i) for i in items]
        lo_piece = hi_piece


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_chars: int) -> Iterator[Phrases]:
    """Windows of the items, in blocks of bounded size; the driver holds one block at a time."""
    block, chars = [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and chars + len(r[1]) > max_chars:
            yield Phrases(block, window)
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1])
    yield Phrases(block, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, max_chars: int = PHRASE_CHARS) -> DataFrame:
    """Adds `n_words`, `spans` (merged, in words) and `items` to every document; all columns of `docs` stay.

    Null and empty texts have no words; an item without words has no window; repeated rows are searched each on
    its own, and repeated item ids count once. Words inside windows of an item without an id are hit; it is not among `items`. Columns of the same names in `docs` are replaced.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark, names = docs.sparkSession, docs.columns
    place = names.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out, first = docs, True
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("spans"),
                         F.array(F.lit("")).alias("items")).schema
    for phrases in phrase_blocks(benchmark, item_col, item_text, window, max_chars):
        shared = spark.sparkContext.broadcast(phrases)

        def task(batches, shared=shared, first=first):
            for batch in batches:
                found = list(search_texts(batch.column(place), shared.value))
                n = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                spans = [s for f in found for s in f[1]]
                items = [i for f in found for i in f[2]]
                if not first:
                    old_spans, old_items = batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist()
                    items = [sorted({*a, *b}) for a, b in zip(items, old_items)]
                    for i, old in enumerate(old_spans):
                        if old:
                            both = np.array(spans[i] + [(o["start"], o["end"]) for o in old], np.int64)
                            spans[i] = list(zip(*(x.tolist() for x in merge_spans(both[:, 0], both[:, 1]))))
                spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
                                                 names=[*names, "n_words", "spans", "items"])

        out, first = out.mapInArrow(task, schema), False
    return out


def item_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """`n_hit` and `contaminated`: some word is hit, and at least one in `share` words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return (found.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))))
