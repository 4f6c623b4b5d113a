"""Operator 5: exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is its bytes as digits of a number in base r, modulo a prime. Chunks compose by
length-shifted arithmetic: fp(A + B) = fp(A) * r**len(B) + fp(B). So the chunks of a huge document
are hashed side by side, here or in other tasks, and combined afterwards. Two primes with a base each
and the length make the key. Texts with equal keys are then compared chunk by chunk with the text that
stays; should two texts differ there, their key is refined by the text's SHA-256, so equality never
rests on the fingerprint alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, row_groups, spread_join, stored

# Two primes below 2**31, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes of a chunk, a power of two.
CHUNK = 1 << 14
#: Texts of more bytes than this have their chunks hashed as rows of their own, in any tasks; those of fewer are hashed whole.
LONG = 1 << 16
#: Duplicate groups that may be broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
#: Copies of one text that are compared with one replica of its chunks.
COPIES_A_REPLICA = 64


def chunk_fingerprints(rows: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Fingerprints of the rows of a (n, width) byte matrix; width a power of two. Neighbours combine, level by level."""
    level, power = rows.astype(np.uint64), np.uint64(base)
    p = np.uint64(prime)
    while level.shape[1] > 1:
        level = (level[:, 0::2] * power + level[:, 1::2]) % p
        power = power * power % p
    return level[:, 0] if level.shape[1] else np.zeros(len(rows), np.uint64)


def combine(left: int, right: int, right_len: int, which: int) -> int:
    """Fingerprint of two pieces in a row from theirs and the second's length."""
    return (left * pow(BASES[which], right_len, PRIMES[which]) + right) % PRIMES[which]


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both fingerprints of a text: chunks in parallel lanes of one matrix, then combined in order.

    The matrix is padded with zero bytes in front, which are leading zeros of the number and change nothing.
    """
    n = len(data)
    width = min(CHUNK, 1 << max(0, (n - 1).bit_length()))
    lanes = -(-n // width) if n else 1
    matrix = np.zeros(lanes * width, np.uint8)
    matrix[lanes * width - n :] = np.frombuffer(data, np.uint8)
    out = []
    for which, (p, r) in enumerate(zip(PRIMES, BASES)):
        total = 0
        for part in range(0, lanes, 64):
            for h in chunk_fingerprints(matrix.reshape(lanes, width)[part : part + 64], p, r).tolist():
                total = combine(total, h, width, which)
        out.append(total)
    return out[0], out[1]


def fingerprints(texts: list[bytes]) -> list[tuple[int, int]]:
    """Fingerprints of many texts; those of like size share one matrix."""
    out: list = [None] * len(texts)
    by_width: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            out[i] = fingerprint(t)
        else:
            by_width.setdefault(1 << max(0, (len(t) - 1).bit_length()), []).append(i)
    for width, members in by_width.items():
        step = max(1, (1 << 19) // width)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            matrix = np.frombuffer(b"".join(texts[i].rjust(width, b"\0") for i in some), np.uint8).reshape(len(some), width)
            for i, a, b in zip(some, *[chunk_fingerprints(matrix, p, r).tolist() for p, r in zip(PRIMES, BASES)]):
                out[i] = (a, b)
    return out


def combined_chunks(chunks: DataFrame, key: str, fps: tuple[str, str], length: str, position: str) -> DataFrame:
    """Fingerprints of documents from those of their chunks, hashed anywhere: key and both of ``fps``.

    ``chunks`` has a row a chunk with its fingerprints, byte length and position. Composition is a fold
    over the chunks in order; one document's chunk rows (not its text) meet in one task.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), F.col(length).cast("long").alias("n"), *[F.col(f).cast("long").alias(f) for f in fps])))
    met = chunks.groupBy(key).agg(parts.alias("_parts"))
    return met.select(key, *[_composed("_parts", f, p, r).alias(f) for f, p, r in zip(fps, PRIMES, BASES)])


def _composed(parts: str, fp: str, p: int, r: int) -> Column:
    """The fold over an array of chunks: what there is, shifted by the chunk's length, and the chunk."""
    # r**n by the bits of n: each step of this fold multiplies by one square of r if its bit is set.
    bits = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("unit"), F.lit(pow(r, 1 << i, p)).cast("long").alias("square")) for i in range(31)])

    def shift(total, n):
        return F.aggregate(bits, total, lambda t, b: F.when(F.floor(n / b["unit"]) % 2 == 1, t * b["square"] % p).otherwise(t))

    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, c: (shift(total, c["n"]) + c[fp]) % p)


def normalised(text: str) -> Column:
    """The text with A-Z in lower case, and empty for null. The letters are fixed values."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint_table(docs: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """Stored: key, others, fp1, fp2, n_bytes, text_sha256, chunks: the normalised text (A-Z in lower case) as byte chunks.

    A long text's chunks are hashed as rows dealt over the tasks, once for all its copies, and combined; the others are hashed in place.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    short = hashed_whole(docs.where(size <= LONG), key, text, others)
    names = [key, *others]
    body = F.encode(normalised(text), "UTF-8")
    starts = F.sequence(F.lit(0), F.octet_length(body) - 1, F.lit(CHUNK))
    long = docs.where(size > LONG).select(*names, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("text_sha256"), F.transform(starts, lambda a: F.substring(body, a + 1, F.lit(CHUNK))).alias("chunks"))
    long = stored(long.withColumn("_row", F.monotonically_increasing_id()), "exact-long")
    one = long.groupBy("text_sha256").agg(F.min("_row").alias("_row")).select("_row")
    rows = long.join(one, "_row", "left_semi").select("text_sha256", F.posexplode("chunks").alias("at", "chunk"))
    made = combined_chunks(hashed_chunks(rows.repartition("text_sha256", "at")), "text_sha256", ("fp1", "fp2"), "n", "at")
    met = long.join(made, "text_sha256").select(*names, "fp1", "fp2", "n_bytes", "text_sha256", "chunks")
    table = stored(short.unionByName(met), "exact")
    discard(long)
    return table


def hashed_chunks(rows: DataFrame) -> DataFrame:
    """text_sha256, at, n (bytes), fp1, fp2 of chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            fps = fingerprints(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(d) for d in data], pa.int64()), pa.array([a for a, _ in fps], pa.int64()), pa.array([b for _, b in fps], pa.int64())], names=["text_sha256", "at", "n", "fp1", "fp2"])

    return rows.select("text_sha256", "at", "chunk").mapInArrow(run, "text_sha256 string, at int, n long, fp1 long, fp2 long")


def hashed_whole(docs: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """The columns of ``fingerprint_table`` of texts that are hashed in place."""
    kinds = dict(docs.dtypes)
    names = [key, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in row_groups(batch.column(len(names))):
                part = batch.slice(first, end - first)
                data = [(t or "").encode().lower() for t in part.column(len(names)).to_pylist()]
                fps = fingerprints(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(names)],
                        pa.array([a for a, _ in fps], pa.int64()),
                        pa.array([b for _, b in fps], pa.int64()),
                        pa.array([len(d) for d in data], pa.int64()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                        pa.array([[d[i : i + CHUNK] for i in range(0, len(d), CHUNK)] for d in data], pa.list_(pa.binary())),
                    ],
                    names=[*names, "fp1", "fp2", "n_bytes", "text_sha256", "chunks"],
                )

    ddl = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return docs.select(*names, text).mapInArrow(run, f"{ddl}, fp1 long, fp2 long, n_bytes long, text_sha256 string, chunks array<binary>")


def differing_keys(table: DataFrame, groups: DataFrame, key: str, small: bool, total: int) -> DataFrame:
    """Keys (fp1, fp2, n_bytes) under which two texts differ, by comparing chunks with the text that stays.

    Only texts in groups of two or more are shuffled, as chunk rows. The chunks of the text that stays are
    replicated once for every 64 copies, and copies are dealt to the replicas, so a key with any
    share of the rows is spread over many tasks.
    """
    keys = ["fp1", "fp2", "n_bytes"]
    replicas = F.ceil(F.col("group_size") / COPIES_A_REPLICA)
    rows = table.select(key, *keys, "chunks")
    rows = rows.join(F.broadcast(groups), keys) if small else spread_join(rows, groups, keys, "group_size", total)
    is_kept = F.col(key).eqNullSafe(F.col("keep_id"))
    copies = rows.where(~is_kept).select(*keys, F.pmod(F.xxhash64(key), replicas).alias("replica"), F.posexplode("chunks").alias("at", "chunk"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), replicas - 1)).alias("replica")
    stays = rows.where(is_kept).select(*keys, "chunks", each).select(*keys, "replica", F.posexplode("chunks").alias("at", "kept_chunk"))
    met = copies.join(stays, [*keys, "replica", "at"])
    return met.where("chunk <> kept_chunk").select(*keys).distinct()


def _groups(table: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """The rows of a fingerprint table with keep_id and group_size, after comparing the texts of equal fingerprints."""
    keys = ["fp1", "fp2", "n_bytes"]
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max(key).alias("keep_id")).where("group_size > 1")
    groups = cut(sizes)
    small = groups.count() <= BROADCAST_GROUPS
    total = table.count()
    rows = table.select(key, *carry, *keys, "text_sha256")
    differing = differing_keys(table, groups, key, small, total)
    if differing.isEmpty():
        if small:
            met = rows.join(F.broadcast(groups), keys, "left")
        else:
            alone = rows.join(groups.select(*keys), keys, "left_anti").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast(dict(table.dtypes)[key])})
            met = spread_join(rows, groups, keys, "group_size", total).unionByName(alone)
        return met.withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "keep_id": F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))})
    # Some fingerprint stands for two texts: rows under such a key are told apart by their digests.
    finer = [*keys, "finer"]
    rows = rows.join(differing.withColumn("met", F.lit(True)), keys, "left").withColumn("finer", F.when(F.col("met"), F.col("text_sha256")).otherwise("")).drop("met")
    return spread_join(rows, rows.groupBy(*finer).agg(F.count(F.lit(1)).alias("group_size"), F.max(key).alias("keep_id")), finer, "group_size", total)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row a document, dropped ones too: key, keep_id, group_size, kept, text_sha256 (and ``carry``).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal
    each other. The row with the largest key of a group stays. Rows with a null key are members with no
    claim to stay, unless a group has no other: then keep_id is null and all its rows are kept. Repeated
    rows with the key that stays are all marked kept. An empty table gives an empty one.
    """
    carry = carry or []
    out = _groups(fingerprint_table(docs, key, text, carry), key, carry)
    return out.select(key, *carry, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text, with all its columns: the row with the largest key; rows with a null key yield to all others.

    Rows are told apart by key and text, so a key that other texts have too keeps their rows, and of rows with one key and one
    text any one stays. Null text counts as empty. The fingerprints and chunks are deleted before this returns.
    """
    table = fingerprint_table(docs.select(key, text), key, text, [])
    made = _groups(table, key, []).where(F.col(key).eqNullSafe(F.col("keep_id")))
    kept = cut(made.groupBy(F.col(key).alias("_key"), F.col("text_sha256").alias("_digest")).agg(F.count(F.lit(1)).alias("_rows")))
    discard(table)
    named = docs.columns
    rows = docs.withColumn("_digest", F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    same = lambda k: rows[key].eqNullSafe(k["_key"]) & (rows["_digest"] == k["_digest"])
    once, more = kept.where("_rows = 1"), kept.where("_rows > 1")
    single = rows.join(once, same(once), "left_semi").select(*named)
    if more.isEmpty():
        return single
    return single.unionByName(rows.join(more, same(more), "left_semi").dropDuplicates([key, "_digest"]).select(*named))
