"""Operator 10: substring dedup behind a count-min prefilter.

The texts are first written to the shared folder in runs of some million characters, dealt to buckets by run, so that later
passes meet a run's texts again without a shuffle. First pass: every run counts its windows of words in a sketch of two rows of
cells, and hands in the cells it met; the runs' sketches are merged block by block, and each run is told, one bit a cell, which of its cells another run met too. A
window's count is at most the least of its cells', so one with a cell that was met once occurs once and is passed over; no repeated
window is. Second pass: the windows estimated repeated are grouped exactly by the 128 bits of their hash. Within a run only the document
with the smallest id of each window needs to ask the others, if another run may have the window; the rest are decided on the spot. So a window that a
third of all documents share costs one row a run in the shuffle. The sketch is as wide as the input asks for; no task
holds more than one block of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORY_BYTES, cut, resident, row_groups, shared_dir

#: Words of a window.
WINDOW = 13
#: Characters of a run; a longer text is a run of its own.
RUN = 6_000_000
#: Cells of a block of the sketch that are meant to be met.
BLOCK = 1_000_000
#: Windows that one group of the second pass is meant to hold.
PART = 1_000_000
#: Mean gap between cells up to which its low part takes one byte, else two.
NARROW = 2_000
#: Stands for a null id: larger than any other, so such a document yields to all with an id.
NO_ID = np.iinfo(np.int64).max
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """word -> number of its 128-bit hash in ``data``."""

    def __init__(self):
        super().__init__()
        self.data, self.held = bytearray(), 0

    def __missing__(self, word: bytes) -> int:
        self.data += xxhash.xxh3_128_digest(word)
        self.held += len(word) + 200
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.held > MEMORY_BYTES:
            self.clear()
            self.data, self.held = bytearray(), 0
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(bytes(self.data), "<u8").reshape(-1, 2)[rows]


def window_hashes(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes (n, 2) of every window of every text, in order, and each text's number of words).

    A window's hash is a polynomial in its words' hashes modulo 2**64, twice, so equal windows have equal
    hashes and others differ but for a 128-bit accident.
    """
    lists = [t.split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(sizes.sum())
    if n < window:
        return np.empty((0, 2), np.uint64), sizes
    words = resident("word hashes", WordHashes).of([w for ws in lists for w in ws])
    total = np.zeros((n - window + 1, 2), np.uint64)
    for j in range(window):
        total *= np.array(MIX)
        total += words[j : n - window + 1 + j]
    total ^= total >> np.uint64(32)
    total *= np.array(MIX[::-1])
    total ^= total >> np.uint64(29)
    text = np.repeat(np.arange(len(lists)), sizes)
    return total[text[: n - window + 1] == text[window - 1 :]], sizes


def run_windows(table: pa.Table, window: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the run's documents in order, hashes of all its windows, each document's number of words)."""
    table = table.sort_by("at").combine_chunks()
    body = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    parts = [window_hashes([t.encode() for t in body.slice(a, b - a).to_pylist()], window) for a, b in row_groups(body)]
    return table, np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts])


def packed_cells(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct cells as gaps: their low bytes, one or two each, and what lies above as ones that end a count of zeros."""
    gaps = np.diff(cells, prepend=0)
    wide = len(gaps) > 0 and gaps.mean() > NARROW
    bits = np.zeros(int((gaps >> (16 if wide else 8)).sum()) + len(gaps), np.uint8)
    bits[np.cumsum((gaps >> (16 if wide else 8)) + 1) - 1] = 1
    return gaps.astype("<u2" if wide else "u1").tobytes(), np.packbits(bits).tobytes()


def unpacked_cells(n: int, low: bytes, high: bytes) -> np.ndarray:
    wide = len(low) == 2 * n
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))
    above = np.diff(ends, prepend=-1) - 1
    return np.cumsum(np.frombuffer(low, "<u2" if wide else "u1").astype(np.int64) + (above << (16 if wide else 8)))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


class Sketch:
    """Shape of the two rows of cells: cells of a row and blocks of a row, both powers of two."""

    def __init__(self, cells: int, windows: int):
        self.cells = min(cells, 1 << 40)
        self.blocks = min(self.cells, power_of_two(windows / BLOCK))
        self.width = self.cells // self.blocks

    def of(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """Cell of each window in one row."""
        return (hashes[:, row] >> np.uint64(24)).astype(np.int64) & (self.cells - 1)

    def bounds(self, found: np.ndarray) -> np.ndarray:
        """Where the blocks begin and end among sorted cells."""
        return np.searchsorted(found, np.arange(0, self.cells + 1, self.width))


def runs_of(docs: DataFrame, key: str, text: str) -> tuple[str, DataFrame]:
    """Name and rows of a table in the shared folder: run, at (a document's place in its run), key, id, n (bytes), text; bucketed by run."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            runs, ats = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > RUN:
                    number, place, held = number + 1, 0, 0
                runs[i], ats[i] = number, place
                place, held = place + 1, held + n
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(ats), *batch.columns[:2], pa.array(sizes), batch.column(2)], names=["run", "at", "key", "id", "n", "text"])

    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = own.mapInArrow(run, f"run long, at int, key {kind}, id long, n long, text string")
    name = f"window_runs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").bucketBy(buckets, "run").saveAsTable(name)
    return name, spark.table(name)


def sketch_rows(runs: DataFrame, sketch: Sketch, window: int) -> DataFrame:
    """The cells that each run met: run, block, n, low, high."""

    def count(table: pa.Table) -> pa.Table:
        number = table["run"][0].as_py()
        _, hashes, _ = run_windows(table, window)
        out: dict = {"run": [], "block": [], "n": [], "low": [], "high": []}
        for row in (0, 1):
            found = np.unique(sketch.of(hashes, row))
            bounds = sketch.bounds(found)
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[k], bounds[k + 1]
                for name, v in zip(out, (number, row * sketch.blocks + k, b - a, *packed_cells(found[a:b] - k * sketch.width))):
                    out[name].append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=list(out))

    return runs.select("run", "at", "text").groupBy("run").applyInArrow(count, "run long, block int, n int, low binary, high binary")


def merged_blocks(rows: DataFrame) -> DataFrame:
    """run, block, bits: for each cell that a run handed in, whether another run did too. A group is one block of all runs' cells."""

    def merge(table: pa.Table) -> pa.Table:
        lists = [unpacked_cells(*x) for x in zip(*[table[c].to_pylist() for c in ("n", "low", "high")])]
        found, times = np.unique(np.concatenate(lists), return_counts=True)
        bits = [np.packbits(times[np.searchsorted(found, x)] > 1).tobytes() for x in lists]
        return pa.table([table["run"], table["block"], pa.chunked_array([pa.array(bits, pa.binary())])], names=["run", "block", "bits"])

    return rows.groupBy("block").applyInArrow(merge, "run long, block int, bits binary")


def repeated(hashes: np.ndarray, sketch: Sketch, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window of a run is estimated to occur twice or more, and whether in another run, from its own cells and the answers of the merged blocks."""
    bits = dict(zip(answers["block"].to_pylist(), answers["bits"].to_pylist()))
    out, elsewhere = np.ones(len(hashes), bool), np.ones(len(hashes), bool)
    for row in (0, 1):
        found, at, times = np.unique(sketch.of(hashes, row), return_inverse=True, return_counts=True)
        bounds = sketch.bounds(found)
        met = [np.unpackbits(np.frombuffer(bits[row * sketch.blocks + k], np.uint8))[: bounds[k + 1] - bounds[k]] for k in np.flatnonzero(np.diff(bounds)).tolist()]
        other = (np.concatenate(met) if met else np.empty(0, np.uint8)).astype(bool)
        out &= (other | (times > 1))[at]
        elsewhere &= other[at]
    return out, elsewhere


def later(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by window and id; in that order, whether the row's window has a row with a smaller id."""
    order = np.lexsort((ids, h[:, 1], h[:, 0]))
    h, ids = h[order], ids[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]) if len(h) else np.empty(0, bool)
    smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else ids
    return order, ids > smallest


def stretches(windows: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of removed windows as stretches: first ones and lengths, 32 bits each."""
    windows = np.unique(windows)
    first = np.flatnonzero(np.diff(windows, prepend=-2) != 1)
    return windows[first].astype("<u4").tobytes(), np.diff(np.append(first, len(windows))).astype("<u4").tobytes()


# Rows of the second pass: asks (run, n and packed columns of one part), and a run's windows decided on the spot.
SECOND = "part int, run long, n int, hashes binary, ids binary, windows binary, starts binary, lengths binary"
KINDS = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
MARKS = "run long, starts binary, lengths binary"


def second_pass(runs: DataFrame, answers: DataFrame, sketch: Sketch, window: int, parts: int) -> DataFrame:
    """Asks and decided windows of every run; see SECOND."""
    names = [x.split()[0] for x in SECOND.split(", ")]

    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        number = table["run"][0].as_py() if table.num_rows else 0
        table, h, sizes = run_windows(table, window)
        twice, elsewhere = repeated(h, sketch, told)
        keep = twice.nonzero()[0]
        h = h[keep]
        own = np.repeat(table["id"].to_numpy(), np.maximum(sizes - window + 1, 0))[keep]
        order, is_later = later(h, own)
        rows: list = []
        if is_later.any():
            rows.append((xxhash.xxh32_intdigest(number.to_bytes(8, "little")) % parts, number, 0, None, None, None, *stretches(keep[order[is_later]])))
        asks = order[~is_later]
        asks = asks[elsewhere[keep[asks]]]
        part = (h[asks, 0] % np.uint64(parts)).astype(np.int64)
        asks = asks[np.lexsort((asks, part))]
        bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            some = asks[bounds[k] : bounds[k + 1]]
            rows.append((k, number, len(some), h[some].tobytes(), own[some].astype("<i8").tobytes(), keep[some].astype("<u4").tobytes(), None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(KINDS), KINDS)], names=names)

    return runs.select("run", "at", "id", "text").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(ask, SECOND)


def answered(rows: DataFrame) -> DataFrame:
    """Removed windows by run; see MARKS. Decided ones pass through as they are."""

    def answer(table: pa.Table) -> pa.Table:
        asks, done = table.filter(pc.is_valid(table["hashes"])), table.filter(pc.is_valid(table["starts"]))
        join = lambda name, kind: np.frombuffer(b"".join(asks[name].to_pylist()), kind)
        order, is_later = later(join("hashes", "<u8").reshape(-1, 2), join("ids", "<i8"))
        gone = np.sort(order[is_later])
        row = np.repeat(np.arange(asks.num_rows), asks["n"].to_numpy().astype(np.int64))[gone]
        windows, runs = join("windows", "<u4").astype(np.int64)[gone], asks["run"].to_numpy()
        bounds = np.searchsorted(row, np.arange(asks.num_rows + 1))
        some = np.flatnonzero(np.diff(bounds)).tolist()
        made = [stretches(windows[bounds[k] : bounds[k + 1]]) for k in some]
        own = pa.table([pa.array(runs[some], pa.int64()), pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.binary())], names=["run", "starts", "lengths"])
        return pa.concat_tables([own, done.select(["run", "starts", "lengths"])])

    return rows.groupBy("part").applyInArrow(answer, MARKS)


def kept_words(words: list[bytes], gone: np.ndarray, window: int) -> tuple[int, bytes]:
    """(removed words, kept words joined by spaces) of a text; ``gone`` has its removed windows."""
    if not gone.any():
        return 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(gone)] += gone
    edges[window:] -= gone
    cut_out = np.cumsum(edges)[:-1] > 0
    return int(cut_out.sum()), b" ".join([w for w, g in zip(words, cut_out.tolist()) if not g])


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, cells: int | None = None, texts: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (and with ``texts``: kept_text) of every document.

    A word goes if a window over it also starts in a document with a smaller key; all windows are judged on the
    input. Null text has no words; a text shorter than a window loses none. A null key counts as larger than any
    other. Rows with one key do not take words from each other. Other columns are not read. ``cells`` of a sketch row:
    by default as many as the texts have bytes, some six for each window. The result is cut in the shared folder, and what led to it deleted.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    name, runs = runs_of(docs, key, text)
    size = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sketch = Sketch(cells or power_of_two(max(size, 1 << 16)), size // 6)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (12 * PART))
    answers = merged_blocks(sketch_rows(runs, sketch, window))
    marks = answered(second_pass(runs, answers, sketch, window, parts))

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        lists = [t.encode().split() for t in table["text"].to_pylist()]
        sizes = np.maximum(np.fromiter(map(len, lists), np.int64, len(lists)) - window + 1, 0)
        starts, lengths = (np.frombuffer(b"".join(told[c].to_pylist()), "<u4").astype(np.int64) for c in ("starts", "lengths"))
        edges = np.zeros(int(sizes.sum()) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + lengths, -1)
        gone, ends = np.cumsum(edges)[:-1] > 0, np.cumsum(sizes)
        out = [kept_words(ws, gone[e - n : e], window) for ws, n, e in zip(lists, sizes.tolist(), ends.tolist())]
        columns = [table["key"], pa.array([len(ws) for ws in lists], pa.int64()), pa.array([n for n, _ in out], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for _, b in out], pa.string())]
        names = [key, "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(pa.array([b.decode() for _, b in out], pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    ddl = f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = cut(runs.select("run", "at", "key", "text").groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(finish, ddl))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    spark.sql(f"DROP TABLE {name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out
