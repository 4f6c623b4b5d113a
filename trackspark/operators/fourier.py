"""Fourier transforms of samples of any length, in groups of bounded size.

A transform of P * Q values is P transforms of every P-th value, each of Q values, whose results are turned by their twiddle factors and put through Q transforms of P values. Both steps
take many groups at a time in Arrow. A length with no such divisor is a convolution with a chirp, by three transforms of a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import Groups, in_batches

#: Values of a group; only lengths over its square need larger ones, of about twice the root of the length.
BLOCK = 16_384


def split_of(n: int, block: int = BLOCK) -> tuple[int, int]:
    """(size, parts) of the transform for a length: the length itself, if it has a divisor that leaves both factors within bounds, or else a power of two of room for the chirp."""
    most = max(block, 2 * math.isqrt(n) + 1)
    for parts in range(-(-n // most), most + 1):
        if n % parts == 0:
            return n, parts
    bits = (2 * n - 2).bit_length()
    return 1 << bits, 1 << (bits - min(bits, max(block.bit_length() - 1, (bits + 1) // 2)))


def _twist(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi * ((a * b) % size) / size)


def transformed(rows: DataFrame, sample: str, block: int = BLOCK) -> DataFrame:
    """sample, n, size, parts, k, re, im: the transform of ``size`` values of each sample, given as sample, n, size, parts, pos, re, im; places without a row are zero.

    Groups of equal shape are transformed side by side, some thousands of rows at a time.
    """
    kind = dict(rows.dtypes)[sample]

    def shapes(table: pa.Table, groups: Groups, *more: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray]]:
        """For each shape of groups: their numbers, the shape (size, parts, ...), their rows and of these the number of the group among them."""
        about = np.stack([*(table[c].to_numpy()[groups.first] for c in ("size", "parts")), *more], axis=1)
        each = groups.each()
        for shape in np.unique(about, axis=0):
            same = (about == shape).all(axis=1)
            at = np.flatnonzero(same[each])
            yield np.flatnonzero(same), [int(v) for v in shape], at, (np.cumsum(same) - 1)[each[at]]

    def made(table: pa.Table, groups: Groups, found: list[tuple], names: list[str], schema: list[str]) -> pa.Table:
        """Rows of all shapes: of each its groups, rows a group, and columns."""
        first = np.concatenate([np.repeat(groups.first[own], width) for own, width, *_ in found])
        kept = table.select(schema).take(pa.array(first))
        for i, name in enumerate(names):
            kept = kept.append_column(name, pa.array(np.concatenate([f[2 + i] for f in found])))
        return kept

    def first(table: pa.Table, groups: Groups) -> pa.Table:
        values = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        pos, part, found = table["pos"].to_numpy(), table["_part"].to_numpy()[groups.first], []
        for own, (size, parts), rows_, of in shapes(table, groups):
            x = np.zeros((len(own), size // parts), complex)
            x[of, pos[rows_] // parts] = values[rows_]
            at = np.arange(x.shape[1])
            y = np.fft.fft(x, axis=1) * _twist(part[own][:, None], at, size)
            found.append((own, len(at), np.tile(at, len(own)), y.real.ravel(), y.imag.ravel()))
        return made(table, groups, found, ["_at", "re", "im"], [sample, "n", "size", "parts", "_part"])

    def second(table: pa.Table, groups: Groups) -> pa.Table:
        values = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        at, part, found = table["_at"].to_numpy(), table["_part"].to_numpy(), []
        # Sorted by place, and a place has a row of every part.
        low, width = at[groups.first], at[groups.first + groups.size - 1] - at[groups.first] + 1
        begins = low[groups.each()]
        for own, (size, parts, wide), rows_, of in shapes(table, groups, width):
            y = np.zeros((len(own), wide, parts), complex)
            y[of, at[rows_] - begins[rows_], part[rows_]] = values[rows_]
            x = np.fft.fft(y, axis=2)
            k = (low[own][:, None] + np.arange(wide))[:, :, None] + size // parts * np.arange(parts)
            found.append((own, wide * parts, k.ravel(), x.real.ravel(), x.imag.ravel()))
        return made(table, groups, found, ["k", "re", "im"], [sample, "n", "size", "parts"])

    about = f"{sample} {kind}, n long, size long, parts long"
    own = rows.select(sample, *[F.col(c).cast("long").alias(c) for c in ("n", "size", "parts", "pos")], "re", "im", (F.col("pos") % F.col("parts")).cast("long").alias("_part"))
    one = in_batches(own, [sample, "_part"], [], first, f"{about}, _part long, _at long, re double, im double")
    # Neighbouring places share a group, as far as it has room.
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(block) / F.col("parts")))
    return in_batches(one.withColumn("_group", F.floor(F.col("_at") / room)), [sample, "_group"], [F.col("_at")], second, f"{about}, k long, re double, im double")


def _chirp(at: Column) -> tuple[Column, Column]:
    """Real and imaginary part of exp(-i pi at**2 / n). The square is reduced as a whole number, so the angle keeps its digits."""
    angle = F.lit(math.pi) * ((at * at) % (2 * F.col("n"))) / F.col("n")
    return F.cos(angle), -F.sin(angle)


def amplitudes(values: DataFrame, lengths: DataFrame, sample: str, block: int = BLOCK) -> DataFrame:
    """sample, n, k, amplitude of the transforms of long samples, given as sample, pos, v with pos counted from 0; lengths: sample, n."""
    kind = dict(values.dtypes)[sample]

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [split_of(int(n), block) for n in p["n"]]
            yield p.assign(size=[s for s, _ in made], parts=[k for _, k in made])

    planned = lengths.select(sample, "n").mapInPandas(plan, f"{sample} {kind}, n long, size long, parts long")
    rows = values.join(planned, sample)
    plain = transformed(rows.where("size = n").select(sample, "n", "size", "parts", "pos", F.col("v").alias("re"), F.lit(0.0).alias("im")), sample, block)

    odd = rows.where("size > n")
    c, s = _chirp(F.col("pos"))
    a = transformed(odd.select(sample, "n", "size", "parts", "pos", (F.col("v") * c).alias("re"), (F.col("v") * s).alias("im")), sample, block)
    places = F.explode(F.when(F.col("pos") == 0, F.array(F.col("pos"))).otherwise(F.array(F.col("pos"), F.col("size") - F.col("pos"))))
    # What the chirp gives depends on the length alone, so samples of one length share it.
    chirps = odd.select("n", "size", "parts", "pos").distinct()
    b = transformed(chirps.select(F.col("n").alias("_length"), "n", "size", "parts", places.alias("_to"), c.alias("re"), (-s).alias("im")).withColumnRenamed("_to", "pos"), "_length", block)
    both = a.join(b.select("n", "k", F.col("re").alias("_re"), F.col("im").alias("_im")), ["n", "k"])
    # The way back is the same transform of the conjugates; turning and conjugating the result once more does not change an amplitude.
    product = both.select(sample, "n", "size", "parts", F.col("k").alias("pos"), (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (-(F.col("re") * F.col("_im") + F.col("im") * F.col("_re"))).alias("im"))
    back = transformed(product, sample, block)
    length = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    half = F.col("k") < F.floor(F.col("n") / 2)
    return plain.where(half).select(sample, "n", "k", length.alias("amplitude")).unionByName(back.where(half).select(sample, "n", "k", (length / F.col("size")).alias("amplitude")))
