"""SentencePiece encoding and decoding through a table of distinct chunks.

Pieces of the model never hold a white-space marker after another character, so
no piece reaches over the start of a marked word. Each task cuts its texts into
marked words (a run of markers and what follows), lets the library segment every
distinct one once, and puts ids and decoded text back together by position. The
table stays in the task: shipping one row per word through a shuffle would move
several times the input. Beyond `MAX_CHUNKS` entries only those that the texts at
hand use are kept, which bounds its memory and changes no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
MAX_CHUNKS = 400_000
BATCH_CHARS = 1 << 20


def crossing_pieces(model) -> list[str]:
    """Pieces in which a marker follows another character; the table is exact only if there are none."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i))
    return [p for p in pieces if MARK in p.lstrip(MARK)]


class ChunkTable:
    """Segments marked words with the library, each distinct one once while the table lasts."""

    def __init__(self, model_file: str, max_chunks: int = MAX_CHUNKS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if crossing_pieces(self.model):
            raise ValueError("pieces of this model cross white-space markers")
        self.lone = self.model.piece_to_id(MARK)
        self.max_chunks = max_chunks
        size = self.model.get_piece_size()
        self.numbers = [str(i) for i in range(size)]
        self.pieces = [self.model.id_to_piece(i).replace(MARK, " ") for i in range(size)]
        self.plain = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)) for i in range(size)]
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) + len(chunks) > self.max_chunks:
            self.ids = {c: self.ids[c] for c in chunks if c in self.ids}
            self.text = {c: self.text[c] for c in self.ids}
        new = [c for c in chunks if c not in self.ids]
        # the library puts the first marker itself; it gives nothing for an empty text
        found = self.model.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)
        found = [f or [self.lone] for f in found]
        number, piece, plain, odd = self.numbers.__getitem__, self.pieces.__getitem__, self.plain.__getitem__, []
        for c, ids in zip(new, found):
            self.ids[c] = ",".join(map(number, ids))
            if all(map(plain, ids)):
                self.text[c] = "".join(map(piece, ids))
            else:  # bytes of characters without a piece of their own
                odd.append((c, ids))
        for (c, _), text in zip(odd, self.model.decode([ids for _, ids in odd]) if odd else []):
            self.text[c] = " " + text

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        for lo, hi in runs([len(t) for t in texts], BATCH_CHARS):
            cut = [self.chunks(t) for t in texts[lo:hi]]
            self.learn(set().union(*cut))
            for c in cut:
                yield ",".join(map(self.ids.__getitem__, c)), "".join(map(self.text.__getitem__, c))[1:]


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to `most`, one item at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, digests of ids and of the decoded text; ids and text themselves on request.

    A null text is an empty one and has no tokens; repeated rows and a null id stay as rows of their own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def task(batches):
        table = ChunkTable(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b, ids, back = [], [], [], [], []
            for joined, decoded in table.encode(texts):
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                if keep_text:
                    back.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            cols += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(back, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text)

    return docs.select(id_col, text_col).mapInArrow(task, schema)
