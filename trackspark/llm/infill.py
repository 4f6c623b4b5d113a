"""Operator 11: fill-in-middle transformation.

A text is cut at two units and its three parts are laid out with markers, so that a model learns to fill in the middle. Units
(code points, words or lines) are counted in fixed blocks of the text's bytes; a Fenwick tree over the blocks holds units and code
points, and descends by halving steps to the block in which a unit begins. Only that block is looked at to find the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_groups

#: Bytes of a block.
BLOCK = 4096
#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def point_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def word_starts(data: np.ndarray) -> np.ndarray:
    """A unit is a word with the white space before it; white space at the end of a text is a unit of its own."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[:1] = True
    return starts


def line_starts(data: np.ndarray) -> np.ndarray:
    """A unit is a line with its \\n."""
    starts = np.ones(len(data), bool)
    starts[1:] = data[:-1] == 0x0A
    return starts


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": point_starts, "word": word_starts, "line": line_starts}


class BlockTree:
    """Fenwick tree over the blocks of one text. Node i sums the units and the code points that begin in the blocks up to i that its lowest bit spans."""

    def __init__(self, counts: np.ndarray):
        sums = np.zeros((len(counts) + 1, 2), np.int64)
        np.cumsum(counts, axis=0, out=sums[1:])
        at = np.arange(len(sums))
        self.nodes = (sums - sums[at - (at & -at)]).tolist()
        self.top = 1 << (len(counts).bit_length() - 1) if len(counts) else 0
        self.units, self.points = sums[-1].tolist()

    def descend(self, unit: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) of the block in which the unit with this number, from 0, begins; one past the last block for the number of units."""
        block = units = points = 0
        step = self.top
        while step:
            if block + step < len(self.nodes) and units + self.nodes[block + step][0] <= unit:
                block += step
                units += self.nodes[block][0]
                points += self.nodes[block][1]
            step >>= 1
        return block, units, points


class Blocks:
    """A text's bytes, the places where its units begin, and the tree over its blocks."""

    def __init__(self, data: bytes, unit: str = "char", size: int = BLOCK):
        self.size, self.bytes = size, np.frombuffer(data, np.uint8)
        self.points, self.starts = point_starts(self.bytes), UNITS[unit](self.bytes)
        edges = np.arange(0, len(data), size)
        self.tree = BlockTree(np.stack([np.add.reduceat(x, edges, dtype=np.int64) for x in (self.starts, self.points)], axis=1) if len(data) else np.zeros((0, 2), np.int64))

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which the unit with this number begins; the text's end for the number of units."""
        if unit >= self.tree.units:
            return len(self.bytes), self.tree.points
        block, units, points = self.tree.descend(unit)
        a = block * self.size
        b = a + int(np.flatnonzero(self.starts[a : a + self.size])[unit - units])
        return b, points + int(np.count_nonzero(self.points[a:b]))


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the key alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def layout(text: str, key: object, unit: str, seed: int, fim: int, spm: int, markers: tuple[str, str, str], size: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    data, (p, s, m) = text.encode(), (x.encode() for x in markers)
    blocks = Blocks(data, unit, size)
    n, (h1, h2, h3, h4) = blocks.tree.units, draws(seed, key)
    if not data or any(x in data for x in (p, s, m)) or h3 % 100 >= fim:
        return n, PLAIN, None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, at), (b, to) = blocks.cut(first), blocks.cut(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    form, parts = (SPM, (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else (PSM, (p, prefix, s, suffix, m, middle))
    return n, form, at, to - at, b"".join(parts)


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, fim: int = 90, spm: int = 20, markers: tuple[str, str, str] = MARKERS, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row a row: key, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``fim`` percent of the texts are laid out, ``spm`` percent of these with the suffix first; the choice and the cuts depend on ``seed`` and
    the key alone, so repeated rows are laid out alike, and null keys share one draw. Empty and null texts and texts that hold a marker stay as
    they are. Other columns are dropped. A text of any length is one task's work, in memory of a few times its bytes.
    """
    if len(set(markers)) < 3 or any(not (x.startswith("<") and x.endswith(">") and x.count("<") == x.count(">") == 1) for x in markers):
        raise ValueError("markers must be three different names in angle brackets, so that none can begin inside another")
    kind = dict(docs.dtypes)[key]
    ddl = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    made = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def work(keys: pa.Array, texts: list[str]) -> dict:
        rows = [layout(t, k, unit, seed, fim, spm, markers, size) for k, t in zip(keys.to_pylist(), texts)]
        columns = list(zip(*rows)) if rows else [[] for _ in made]
        out = {f.name: pa.array(c, f.type) for f, c in zip(made, columns) if f.name != "output"}
        return {"_key": keys, **out, "output": pa.array(columns[-1], pa.binary()).cast(pa.string())}

    def run(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field("_key"), *made])
            yield from by_groups(work, schema, "_key", "_text")([batch])

    return own.mapInArrow(run, ddl.replace(f"`{key}`", "_key", 1)).withColumnRenamed("_key", key)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a laid-out row was made from."""
    p, s, m = markers

    def split(rest: Column, marker: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, marker, 1)
        return head, F.substr(rest, F.length(head) + len(marker) + 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = split(F.substr(F.col(output), F.lit(len(first) + 1)), second)
        two, middle = split(rest, m)
        return one, two, middle

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(F.col(form) == PLAIN, F.col(output)).when(F.col(form) == PSM, psm).otherwise(F.concat(prefix, middle, suffix))
