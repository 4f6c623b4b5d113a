"""Operator 8: best-fit packing planned on a histogram of piece lengths.

Documents become pieces of at most ``capacity`` tokens. Their lengths are counted (at most ``capacity``
rows); best-fit decreasing then runs over the counts, treating all open sequences with the same room
alike, and yields runs of slots: the pieces of one length with ranks from..to go to sequences
first, first+1, ... at one offset. Pieces take their slots by joining on length and rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, resident, row_groups

#: Bytes that a Python worker's units may take before it starts anew.
MEMORY_BYTES = 128 << 20
#: A unit is a run of plain white space and the word after it, or what follows a word of letters before more space; text with other white space is encoded whole.
UNIT = re.compile(r"[ \t\n\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^ \t\n\r.,;:|!?$&%*#])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder(dict):
    """Ids (little-endian 32-bit, as bytes) of a unit, computed by the tokenizers library when first met.

    The byte-level pre-tokenizer never joins a non-space to the white space after it, nor a letter to
    the marks listed in UNIT, so a text's ids are its units' ids in a row. New units are encoded in a row too; as each id stands for a known number
    of bytes, the units' lengths part the ids again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # The tokens that the library cuts out of a text before all else, such as an end-of-text mark; texts with one are encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        self.held = 0
        self.widths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self]
        if self.held > MEMORY_BYTES:
            self.clear()
            self.held, new = 0, list(units)
        self.held += sum(map(len, new)) + 250 * len(new)
        alone = [u for u in new if u[0] not in " \t\n\r" or u.isspace()]
        for unit in alone:
            self[unit] = self.whole(unit)
        row = [u for u in new if u not in self]
        for at in range(0, len(row), 2_000):
            some = row[at : at + 2_000]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(u.encode()) for u in some])) + 1
            data, first = ids.tobytes(), 0
            for unit, end in zip(some, ends.tolist()):
                self[unit] = data[4 * first : 4 * end]
                first = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        parts = [None if OTHER_SPACE.search(t) or self.added.search(t) else UNIT.findall(t) for t in texts]
        try:
            return [self.whole(t) if p is None else b"".join(map(self.__getitem__, p)) for t, p in zip(texts, parts)]
        except KeyError:
            self.learn({u for p in parts if p for u in p})
            return [self.whole(t) if p is None else b"".join(map(self.__getitem__, p)) for t, p in zip(texts, parts)]


def encoder(path: str) -> Encoder:
    return resident(f"encoder {path}", lambda: Encoder(path))


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document's ids; a document that is too long has its remainder first."""
    n = len(ids) // 4
    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    for a, b in zip(bounds, bounds[1:]):
        yield a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32. Null or empty text gives one piece, the end id alone."""
    kind = dict(docs.dtypes)[key]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, end in row_groups(batch.column(1)):
                rows, out = [], defaultdict(list)
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                for i, ids in enumerate(enc.encode(texts), first):
                    for k, x in enumerate(cut_pieces(ids + tail, capacity)):
                        rows.append(i)
                        for name, v in zip(PIECES.names, (k, *x)):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(out[f.name], f.type) for f in PIECES]], names=[key, *PIECES.names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first sequence, offset).

    ``room`` maps free tokens to runs [first, end) of sequences; a length takes runs with the least
    room that fits, else opens sequences. The rows number a few for each pair of lengths, however
    many pieces there are.
    """
    room: dict[int, list[list[int]]] = defaultdict(list)
    free: list[int] = []
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            at = bisect_left(free, length)
            if at == len(free):
                insort(free, capacity)
                room[capacity].append([opened, opened + (n - rank + capacity // length - 1) // (capacity // length)])
                opened = room[capacity][-1][1]
                continue
            left = free[at]
            first, end = room[left].pop()
            m = min(n - rank, end - first)
            if first + m < end:
                room[left].append([first + m, end])
            elif not room[left]:
                free.pop(at)
            rows.append((length, rank, rank + m, first, capacity - left))
            if left > length:
                if not room[left - length]:
                    insort(free, left - length)
                room[left - length].append([first, first + m])
            rank += m
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. Pieces are read twice, so they are cut in the shared folder first.

    Every sequence's pieces lie gapless from 0. An empty table gives an empty one. Rows that are equal
    (repeated documents) are pieces of their own. The plan's size is bounded by ``capacity``
    alone, which is why it may be broadcast.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "_length long, _from long, _to long, _first long, _offset long")
    ranked = numbered(pieces, ["length"], [key, "piece", "ids_crc32"], "_rank")
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(slots), fits)
    return placed.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with their place in a sequence of at most ``capacity`` tokens.

    Null keys and repeated rows are documents like any other; columns beside key and text are not read.
    """
    return pack(token_pieces(docs, path, capacity, end_id, key, text), capacity, key)
