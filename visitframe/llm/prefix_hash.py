"""Document fingerprints from prefix polynomial hashes.

`PrefixHashes` keeps, for a sequence of code points, the prefix sums of
`code * base^i` modulo the prime 2^31 - 1 for two bases. The hash of any span is
a difference of two of them, brought to a common power, so equality of spans is
one comparison and the longest common extension of two places is found by binary
search. Both work on arrays of places at once.

A fingerprint is the `SIZE` smallest hashes of all spans of `SPAN` code points
(spans of a whole shorter text), a sample that depends on the text alone. The
likeness of two fingerprints is the share of common hashes among the `SIZE`
smallest of both. The hash of a text that was joined from parts is put together
from the parts' spans and the few spans over the seam.

The fingerprint's likeness is a sample; what a text shares at its ends with its edited
text and with the following one is exact (`extensions`), from prefix hashes of the
whole texts, which take 16 bytes a code point while the two texts are compared.

Every document is compared with the next one in descending order of ids. Texts are
dealt out once by ranges of ids; the first row of each range also goes, as a
guest, to the range before, so neighbours always meet in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2**31 - 1
BASES = (1_000_003_019 % PRIME, 777_767_777)
SPAN, SIZE = 8, 64
_U = np.uint64
_P = _U(PRIME)
#: code points hashed at a time, so that the working arrays stay small
PIECE = 1 << 16


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x == _P, _U(0), x)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below `size`, by doubling."""
    both = []
    for b in (base, pow(base, -1, PRIME)):
        p = np.ones(1, _U)
        while len(p) < size:
            p = np.concatenate([p, _reduce(p * _U(pow(b, len(p), PRIME)))])
        both.append(p[:size])
    return both[0], both[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Span hashes of one sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        size = max(PIECE, 1 << int(self.n + 1).bit_length())
        self.down, self.sums = [], []
        for base in BASES:
            up, down = _powers(base, size)
            terms = _reduce((codes.astype(_U) + _U(1)) * up[: self.n])
            self.sums.append(np.concatenate([np.zeros(1, _U), _reduce(np.cumsum(terms, dtype=_U))]))
            self.down.append(down)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hash of each span [start, end); equal for equal spans of any two sequences."""
        h = [_reduce(_reduce(s[end] + (_P - s[start])) * d[start]) for s, d in zip(self.sums, self.down)]
        return (h[0] << _U(31)) | h[1]

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length."""
        n = self.n - length + 1
        if n <= 0:
            return np.zeros(0, _U)
        h = [_reduce(_reduce(s[length:] + (_P - s[:n])) * d[:n]) for s, d in zip(self.sums, self.down)]
        return (h[0] << _U(31)) | h[1]

    def common_extension(self, start: np.ndarray, other: "PrefixHashes", other_start: np.ndarray) -> np.ndarray:
        """Length of the longest common run from each pair of places, by binary search over span hashes."""
        start, other_start = np.asarray(start), np.asarray(other_start)
        return _longest(np.minimum(self.n - start, other.n - other_start),
                        lambda k: self.span(start, start + k) == other.span(other_start, other_start + k))

    def common_extension_back(self, end: np.ndarray, other: "PrefixHashes", other_end: np.ndarray) -> np.ndarray:
        """Length of the longest common run up to each pair of places."""
        end, other_end = np.asarray(end), np.asarray(other_end)
        return _longest(np.minimum(end, other_end), lambda k: self.span(end - k, end) == other.span(other_end - k, other_end))


def _longest(most: np.ndarray, same) -> np.ndarray:
    """Largest lengths up to `most` with `same`, which holds for all smaller ones; steps double first, as most runs are short."""
    lo, hi = np.zeros(len(most), np.int64), most
    while (lo < hi).any():
        mid = np.minimum((lo + hi + 1) // 2, 2 * lo + 1)
        yes = same(mid)
        lo, hi = np.where(yes, mid, lo), np.where(yes, hi, mid - 1)
    return lo


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The SIZE smallest distinct scrambled hashes."""
    with np.errstate(over="ignore"):
        h = (hashes ^ (hashes >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> _U(32))
    kept = SIZE
    while True:
        few = np.unique(np.partition(h, kept)[:kept] if len(h) > kept else h)
        if len(few) >= SIZE or kept >= len(h):
            return few[:SIZE]
        kept *= 4


class Windows:
    """Span hashes of a text and of its beginnings, for its own fingerprint and those of joined texts, and its prefix hashes as a whole."""

    def __init__(self, text: str):
        self.codes = code_points(text)
        self.n = len(self.codes)
        self.prefix = PrefixHashes(self.codes)
        if self.n <= PIECE:
            self.hashes = self.prefix.windows(SPAN)
        else:
            self.hashes = np.concatenate([PrefixHashes(self.codes[i: i + PIECE + SPAN - 1]).windows(SPAN) for i in range(0, max(1, self.n - SPAN + 1), PIECE)])

    @staticmethod
    def whole(codes: np.ndarray) -> np.ndarray:
        return PrefixHashes(codes).span(np.array([0]), np.array([len(codes)])) if len(codes) else np.zeros(0, _U)

    def sketch(self) -> np.ndarray:
        return _smallest(self.hashes if self.n >= SPAN else self.whole(self.codes))

    def joined_sketch(self, n: int, other: "Windows", m: int) -> np.ndarray:
        """Sketch of this text's first n code points followed by the other's first m."""
        seam = np.concatenate([self.codes[max(0, n - SPAN + 1): n], other.codes[: min(m, SPAN - 1)]])
        if n + m < SPAN:
            return _smallest(self.whole(seam))
        return _smallest(np.concatenate([self.hashes[: max(0, n - SPAN + 1)], PrefixHashes(seam).windows(SPAN), other.hashes[: max(0, m - SPAN + 1)]]))


def extensions(w: Windows, v: Windows) -> tuple[int, int, int, int, int]:
    """(edited_prefix, edited_suffix, next_prefix, next_suffix, seam) of a text, its edited text and the following text.

    Common prefix and suffix of text and edited text, and of text and following text; and how far the following
    text's start agrees with the text from the seam of the edited text on. Whatever their length, from span hashes.
    """
    half = w.n // 2
    kept, taken = w.n - half, min(half, v.n)
    seam, next_prefix = w.prefix.common_extension([kept, 0], v.prefix, [0, 0]).tolist()
    suffix, next_suffix = w.prefix.common_extension_back([w.n, w.n], v.prefix, [taken, v.n]).tolist()
    if suffix == taken:  # all that was put in; go on before the seam
        suffix += int(w.prefix.common_extension_back([w.n - taken], w.prefix, [kept])[0])
    return kept + min(seam, taken), suffix, next_prefix, next_suffix, seam


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the SIZE smallest of both; two empty texts are alike."""
    both = np.union1d(a, b)[:SIZE]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).mean())


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, " \
         "edited_prefix long, edited_suffix long, next_prefix long, next_suffix long, seam long"


def _pair(text: str, w: Windows, after: str, v: Windows) -> tuple:
    half = w.n // 2
    own, mixed, following = w.sketch(), w.joined_sketch(w.n - half, v, min(half, v.n)), v.sketch()
    return (w.n, hashlib.sha256(edited(text, after).encode()).hexdigest(), fingerprint(own), fingerprint(mixed), likeness(own, mixed), likeness(own, following),
            *extensions(w, v))


def by_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (b, doc_id, text, guest): ranges b and the ids in them descend; each range has its follower's first row as guest.

    The last range's guest is the first row of all. The driver reads one id per range.
    """
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    splits = [float("-inf"), *sorted(set(edges or [0.0])), float("inf")]
    docs = Bucketizer(splits=splits, inputCol="__id", outputCol="__b").transform(docs.withColumn("__id", F.col("doc_id").cast("double")))
    docs = docs.select("doc_id", "text", (F.lit(len(splits)) - F.col("__b")).cast("int").alias("b"))
    tops = [tuple(r) for r in docs.groupBy("b").agg(F.max("doc_id").alias("top")).orderBy("b").collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    hosts = docs.sparkSession.createDataFrame([(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)], f"doc_id {kind}, host int")
    guests = docs.join(F.broadcast(hosts), "doc_id").select(F.col("host").alias("b"), "doc_id", "text", F.lit(True).alias("guest"))
    return docs.select("b", "doc_id", "text", F.lit(False).alias("guest")).union(guests)


def _pack_task(batches):
    """Texts compressed one by one: they are shuffled at about half their size."""
    for batch in batches:
        packed = pa.array([zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(3)], names=["b", "doc_id", "text", "guest"])


def _neighbour_task(batches):
    prior, at = None, None  # (id, text, windows) that waits for its follower; its range

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    done = []
    for b, doc, text, guest in rows():
        if b != at:
            prior, at = None, b
        if guest and prior is None:
            continue
        text = zlib.decompress(text).decode()
        w = Windows(text)
        if prior is not None:
            done.append((prior[0], *_pair(prior[1], prior[2], text, w)))
        prior = None if guest else (doc, text, w)
        if len(done) == 500:
            yield _rows(done)
            done = []
    yield _rows(done)


def _alone_task(batches):
    nothing = Windows("")
    for batch in batches:
        yield _rows([(doc, *_pair(text, Windows(text), "", nothing)) for doc, text in zip(*(c.to_pylist() for c in batch.columns))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * 5]
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and `extensions`.

    `docs` has a whole-number doc_id and a text; a null text is an empty one. Rows of the same id follow each other
    in the order of their packed texts. A row without an id has no follower: its edited text is its first half, and it is compared with nothing.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = by_ranges(docs.where(F.col("doc_id").isNotNull()), ranges)
    dealt = dealt.mapInArrow(_pack_task, "b int, doc_id long, text binary, guest boolean")
    dealt = (dealt.repartition("b").sortWithinPartitions("b", "guest", F.col("doc_id").desc(), "text")
             .select("b", "doc_id", "text", "guest"))
    schema = f"doc_id long, {SCHEMA}"
    return dealt.mapInArrow(_neighbour_task, schema).union(docs.where(F.col("doc_id").isNull()).mapInArrow(_alone_task, schema))
