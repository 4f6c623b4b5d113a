"""Operator 3: lossless media columns in FLAC: encoder, decoder, checksums, PCM blocks with sample offsets.

Samples are 8-bit mono. The encoder works on all frames of a group of rows at a time: each frame takes the
cheapest of a constant, fixed predictors of order 0 to 2, a quantised linear predictor or verbatim samples, Rice codes
for residuals, and both checksums. The decoder reads frames in lockstep: step t decodes residual t of every frame
at once, and likewise undoes their predictors. Streams of other writers (several Rice partitions, escapes,
other orders) go through a plain reader frame by frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_groups

#: Samples of a frame; characters of a group of rows; frames that are encoded, and decoded, at a time, however long a text is.
BLOCK = 4096
GROUP = 4_000_000
ENCODED, DECODED = 256, 1024
ORDER, PRECISION, SHIFT = 4, 10, 8
#: A Rice quotient is kept below this by a larger parameter, so that a code fits the decoder's 32-bit look-ahead.
QUOTIENT = 11
RATE = 8000
# Coefficients of the fixed predictors of order 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_tables(width: int, poly: int, length: int) -> np.ndarray:
    """Row d: checksum of each byte value followed by d zero bytes; a message's checksum is the exclusive or of its bytes' entries."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    first = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        first.append(c)
    kind = np.uint16 if width == 16 else np.uint8
    step = np.array(first, np.int64)
    rows = [step]
    for _ in range(length - 1):
        last = rows[-1]
        rows.append(((last << 8) & mask) ^ step[last >> (width - 8)])
    return np.array(rows).astype(kind)


_tables: dict[int, np.ndarray] = {}


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Checksums (width 8: poly 0x07, 16: poly 0x8005, from zero) of data[start:end] for ascending spans, none empty."""
    lengths = ends - starts
    need = int(lengths.max())
    if width not in _tables or len(_tables[width]) < need:
        _tables[width] = _crc_tables(width, {8: 0x07, 16: 0x8005}[width], max(need, 64 if width == 8 else 2 * BLOCK))
    bounds = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(bounds, lengths)
    rest = np.repeat(lengths, lengths) - 1 - at
    return np.bitwise_xor.reduceat(_tables[width][rest, data[np.repeat(starts, lengths) + at]], bounds)


def utf8_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * k & 0x3F for k in range(size - 1)]
    return bytes([0xFF00 >> size & 0xFF | n >> 6 * (size - 1), *tail[::-1]])


def predictors(samples: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Quantised linear-predictor coefficients (frames, ORDER) by the autocorrelation method, for SHIFT bits of fraction."""
    x = samples.astype(np.float64)
    local = np.arange(len(x)) - np.repeat(starts, lengths)
    lags = []
    for lag in range(ORDER + 1):
        product = np.zeros(len(x))
        product[lag:] = x[lag:] * x[: len(x) - lag]
        product[local < lag] = 0
        lags.append(np.add.reduceat(product, starts))
    r = np.array(lags)
    r[0] = r[0] * (1 + 1e-9) + 1e-9
    a, error = np.zeros((ORDER, len(starts))), r[0].copy()
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / error
        new = a.copy()
        new[i] = k
        new[:i] = a[:i] - k * a[:i][::-1]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top).astype(np.int64).T


def residuals(samples: np.ndarray, local: np.ndarray, coefficients: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """Samples less their prediction; coefficients (samples, order). Warm-up samples come out as zero."""
    order = coefficients.shape[1]
    guess = np.zeros(len(samples), np.int64)
    for j in range(order):
        guess[j + 1 :] += coefficients[j + 1 :, j] * samples[: len(samples) - j - 1]
    out = samples - (guess >> shift)
    out[local < order] = 0
    return out


def rice_parameters(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of each frame: the best near the mean, large enough to keep quotients short."""
    mean = np.add.reduceat(codes, starts) / np.maximum(counts, 1)
    largest = np.maximum.reduceat(codes, starts)
    least = np.ceil(np.log2(np.maximum(largest + 1, 1) / QUOTIENT)).clip(0).astype(np.int64)
    k = np.maximum(np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int64), least)
    best = bits = None
    sizes = np.diff(np.append(starts, len(codes)))
    for extra in (0, 1):
        cost = np.add.reduceat(codes >> np.repeat(k + extra, sizes), starts) + counts * (k + extra + 1)
        best = np.where(bits is None or cost < bits, k + extra, best if best is not None else k)
        bits = cost if bits is None else np.minimum(bits, cost)
    return best, bits


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of one byte or more; byte b is the sample b - 128."""
    parts = [(i, k, p[at : at + BLOCK]) for i, p in enumerate(payloads) for k, at in enumerate(range(0, len(p), BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    group, held = [], 0
    for x in [*parts, None]:
        if group and (x is None or held + len(x[2]) > ENCODED * BLOCK):
            for (i, *_), frame in zip(group, encode_frames([k for _, k, _ in group], [d for *_, d in group])):
                frames[i].append(frame)
            group, held = [], 0
        if x is not None:
            group.append(x)
            held += len(x[2])
    return [stream_of(p, f) for p, f in zip(payloads, frames)]


def stream_of(data: bytes, frames: list[bytes]) -> bytes:
    """Stream info with the samples' digest, a seek point for every frame, and the frames."""
    sizes = [len(f) for f in frames]
    lengths = [min(BLOCK, len(data) - at) for at in range(0, len(data), BLOCK)]
    digest = hashlib.md5((np.frombuffer(data, np.uint8) ^ np.uint8(0x80)).tobytes()).digest()
    fields = RATE << 44 | 0 << 41 | 7 << 36 | len(data)
    info = max(lengths).to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + fields.to_bytes(8, "big") + digest
    points, at = [], 0
    for k, (n, size) in enumerate(zip(lengths, sizes)):
        points.append((BLOCK * k).to_bytes(8, "big") + at.to_bytes(8, "big") + n.to_bytes(2, "big"))
        at += size
    # A metadata block holds under 16 MB; longer streams have a point for every so many frames.
    points = points[:: -(-len(points) // 900_000)]
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode_frames(numbers: list[int], parts: list[bytes]) -> list[bytes]:
    """A frame for each part of at most BLOCK bytes."""
    samples = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) - 128
    lengths = [len(p) for p in parts]
    n = np.array(lengths)
    starts = np.cumsum(n) - n
    frame = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(samples)) - starts[frame]

    # Costs of each way to code the frames: subframe header, warm-up, parameters, residuals.
    ways, best_bits, best = [], None, np.zeros(len(n), np.int64)
    lpc = predictors(samples, starts, n)
    for order in (0, 1, 2, "lpc"):
        if order == "lpc":
            coefficients, shift, warm, header = lpc[frame], SHIFT, ORDER, 8 + 8 * ORDER + 4 + 5 + PRECISION * ORDER + 10
        else:
            coefficients, shift, warm, header = np.tile(np.array(FIXED[order], np.int64), (len(samples), 1)) if order else np.zeros((len(samples), 0), np.int64), 0, order, 8 + 8 * order + 10
        r = residuals(samples, local, coefficients, shift)
        codes = np.where(r < 0, -2 * r - 1, 2 * r)
        k, bits = rice_parameters(codes, starts, n - warm)
        bits = bits + header
        ways.append((codes, k, warm))
        bits = np.where((n > warm) & (k < 15), bits, np.iinfo(np.int64).max)
        better = bits < best_bits if best_bits is not None else np.ones(len(n), bool)
        best = np.where(better, len(ways) - 1, best)
        best_bits = bits if best_bits is None else np.minimum(best_bits, bits)
    constant = np.maximum.reduceat(samples, starts) == np.minimum.reduceat(samples, starts)
    best = np.where(constant, 4, np.where(best_bits > 8 + 8 * n, 5, best))
    best_bits = np.where(constant, 16, np.where(best == 5, 8 + 8 * n, best_bits))

    heads = [b"\xff\xf8\x70\x02" + utf8_number(k) + (m - 1).to_bytes(2, "big") for k, m in zip(numbers, lengths)]
    head_size = np.array([len(h) for h in heads]) + 1
    size = head_size + (best_bits + 7) // 8 + 2
    ends = np.cumsum(size)
    begins = ends - size
    bits = np.zeros(int(ends[-1]) * 8, np.uint8)
    body = (begins + head_size) * 8
    kinds = np.array([0b001000, 0b001001, 0b001010, 0b100000 + ORDER - 1, 0b000000, 0b000001])[best]
    _put(bits, body, kinds << 1, 8)
    for way, (codes, k, warm) in enumerate(ways):
        mine = np.flatnonzero(best == way)
        if not len(mine):
            continue
        at = body[mine] + 8
        for j in range(warm):
            _put(bits, at, samples[starts[mine] + j] & 0xFF, 8)
            at = at + 8
        if way == 3:
            _put(bits, at, np.full(len(mine), PRECISION - 1), 4)
            _put(bits, at + 4, np.full(len(mine), SHIFT), 5)
            at = at + 9
            for j in range(ORDER):
                _put(bits, at, lpc[mine, j] & ((1 << PRECISION) - 1), PRECISION)
                at = at + PRECISION
        _put(bits, at + 6, k[mine], 4)
        at = at + 10
        chosen = (best[frame] == way) & (local >= warm)
        u, kk, owner = codes[chosen], k[frame[chosen]], frame[chosen]
        width = (u >> kk) + 1 + kk
        total = np.cumsum(width) - width
        first = np.searchsorted(owner, mine)
        stop = at[np.searchsorted(mine, owner)] + total - total[first][np.searchsorted(mine, owner)] + (u >> kk)
        bits[stop] = 1
        for j in range(int(kk.max()) if len(kk) else 0):
            some = kk > j
            bits[stop[some] + kk[some] - j] = u[some] >> j & 1
    for way in (4, 5):
        for f in np.flatnonzero(best == way):
            data = samples[starts[f] : starts[f] + (1 if way == 4 else n[f])].astype(np.int8).view(np.uint8)
            bits[body[f] + 8 : body[f] + 8 + 8 * len(data)] = np.unpackbits(data)
    stream = np.packbits(bits)
    for h, a in zip(heads, begins.tolist()):
        stream[a : a + len(h)] = np.frombuffer(h, np.uint8)
    stream[begins + head_size - 1] = crcs(stream, begins, begins + head_size - 1, 8)
    check = crcs(stream, begins, ends - 2, 16)
    stream[ends - 2], stream[ends - 1] = check >> 8, check & 0xFF

    frames = stream.tobytes()
    return [frames[a:b] for a, b in zip(begins.tolist(), ends.tolist())]


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """(stream info, seek points (sample, offset, samples), offset of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, {}, []
    while True:
        head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if head & 0x7F == 0:
            fields = int.from_bytes(body[10:18], "big")
            info = {"rate": fields >> 44, "channels": (fields >> 41 & 7) + 1, "bits": (fields >> 36 & 31) + 1, "samples": fields & (1 << 36) - 1, "md5": body[18:34]}
        elif head & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if head & 0x80:
            return info, [p for p in points if p[0] != 2**64 - 1], at


class Bits:
    """Big-endian bits of a byte string."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the stream ends within a frame")
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def read_frame(stream: bytes, at: int, depth: int = 8) -> tuple[np.ndarray, int]:
    """(samples, offset after it) of any mono frame, bit by bit, with both checksums verified."""
    b = Bits(stream, at)
    if b.take(14) != 0b11111111111110:
        raise ValueError("no frame here")
    b.take(2)
    size_code, rate_code, channels, _, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
    if channels:
        raise ValueError("only mono streams are read")
    lead = b.take(8)
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
        b.take(8)
    n = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0)) if rate_code in (12, 13, 14) else None
    raw = np.frombuffer(stream, np.uint8)
    if b.take(8) != crcs(raw, np.array([at]), np.array([(b.at >> 3) - 1]), 8)[0]:
        raise ValueError("a frame header's checksum is wrong")
    b.take(1)
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bits = depth - wasted
    if kind == 0:
        out = [b.signed(bits)] * n
    elif kind == 1:
        out = [b.signed(bits) for _ in range(n)]
    else:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        out, shift, coefficients = [b.signed(bits) for _ in range(order)], 0, FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefficients = [b.signed(precision) for _ in range(order)]
        wide = b.take(2) == 1
        parts = 1 << b.take(4)
        for part in range(parts):
            k, escape = b.take(5 if wide else 4), 31 if wide else 15
            raw_bits = b.take(5) if k == escape else None
            for _ in range(n // parts - (order if part == 0 else 0)):
                if raw_bits is not None:
                    r = b.signed(raw_bits)
                else:
                    u = b.unary() << k
                    u |= b.take(k) if k else 0
                    r = u >> 1 ^ -(u & 1)
                guess = sum(c * out[-1 - j] for j, c in enumerate(coefficients))
                out.append((guess >> shift if shift >= 0 else guess << -shift) + r)
    end = (b.at + 7) >> 3
    if int.from_bytes(stream[end : end + 2], "big") != crcs(raw, np.array([at]), np.array([end]), 16)[0]:
        raise ValueError("a frame's checksum is wrong")
    return np.array(out, np.int64) << wasted, end + 2


_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.uint8)


def _read_fields(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for j in range(width):
        out = out << 1 | bits[at + j]
    return out


def _signed(values: np.ndarray, width: int) -> np.ndarray:
    return values - ((values >> (width - 1)) << width)


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, unsigned bytes) of each stream; frame checksums, sample counts and digests are verified."""
    found = [metadata(s) for s in streams]
    blocks: list = [None] * len(streams)
    fast = [i for i, (info, points, _) in enumerate(found) if info["bits"] == 8 and info["channels"] == 1 and points and sum(p[2] for p in points) == info["samples"]]
    frames, at = [], 0
    for i in fast:
        _, points, first = found[i]
        offsets = [p[1] for p in points] + [len(streams[i]) - first]
        frames += [(i, p[0], p[2], at + first + a, at + first + b) for p, a, b in zip(points, offsets, offsets[1:])]
        at += len(streams[i])
    if frames:
        data = np.frombuffer(b"".join(streams[i] for i in fast) + bytes(8), np.uint8)
        table = np.array([f[2:] for f in frames], np.int64)
        slow = set()
        for at in range(0, len(frames), DECODED):
            some = table[at : at + DECODED]
            a, b = int(some[0, 1]), int(some[-1, 2])
            done, pcm = _lockstep(data[a : b + 8], some[:, 0], some[:, 1] - a, some[:, 2] - a)
            for (i, offset, *_), ok, x in zip(frames[at : at + DECODED], done, pcm):
                if blocks[i] is None:
                    blocks[i] = []
                blocks[i].append((offset, x))
                if not ok:
                    slow.add(i)
        fast = [i for i in fast if i not in slow]
    quick = set(fast)
    for i, s in enumerate(streams):
        info, _, first = found[i]
        if i not in quick:
            if info["channels"] != 1 or info["bits"] != 8:
                raise ValueError("only 8-bit mono streams are read")
            blocks[i], offset = [], 0
            while offset < info["samples"]:
                x, first = read_frame(s, first)
                blocks[i].append((offset, (x + 128).astype(np.uint8).tobytes()))
                offset += len(x)
        whole = b"".join(x for _, x in blocks[i])
        if len(whole) != info["samples"] or any(info["md5"]) and hashlib.md5((np.frombuffer(whole, np.uint8) ^ np.uint8(0x80)).tobytes()).digest() != info["md5"]:
            raise ValueError("the decoded samples differ from the stream's digest")
    return blocks


def _lockstep(data: np.ndarray, n: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(decoded here, unsigned PCM) of frames with 16-bit block sizes, one Rice partition and no escape."""
    if (crcs(data, begins, ends - 2, 16) != data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]).any():
        raise ValueError("a frame's checksum is wrong")
    lead = data[begins + 4]
    number = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, 6)))))
    head = 4 + number + 2
    plain = (data[begins] == 0xFF) & (data[begins + 1] == 0xF8) & (data[begins + 2] == 0x70) & (data[begins + 3] & 0xFE == 0x02)
    if (crcs(data, begins, begins + head, 8)[plain] != data[begins + head][plain]).any():
        raise ValueError("a frame header's checksum is wrong")
    bits = np.unpackbits(data)
    body = (begins + head + 1) * 8
    kind = _read_fields(bits, body, 8) >> 1
    order = np.where(kind >= 32, (kind & 31) + 1, np.where(kind >= 8, kind & 7, 0))
    verbatim, constant = kind == 1, kind == 0
    coded = ((kind >= 8) & (kind <= 12)) | (kind >= 32)
    good = plain & (coded | verbatim | constant) & (order <= ORDER) & (n > order) & (data[body // 8] & 1 == 0)
    coefficients, shift = np.zeros((len(n), ORDER), np.int64), np.zeros(len(n), np.int64)
    for o, c in enumerate(FIXED):
        coefficients[(kind == 8 + o), : len(c)] = c
    at = body + 8 + 8 * order
    for o in range(1, ORDER + 1):
        mine = np.flatnonzero(kind == 31 + o)
        if len(mine):
            precision, shift[mine] = _read_fields(bits, at[mine], 4) + 1, _read_fields(bits, at[mine] + 4, 5)
            good[mine] &= (precision == PRECISION) & (shift[mine] < 16)
            for j in range(o):
                coefficients[mine, j] = _signed(_read_fields(bits, at[mine] + 9 + PRECISION * j, PRECISION), PRECISION)
            at[mine] += 9 + PRECISION * o
    k = _read_fields(bits, np.minimum(at + 6, len(bits) - 4), 4)
    good &= ~coded | ((_read_fields(bits, np.minimum(at, len(bits) - 6), 6) == 0) & (k < 15))
    out = [b""] * len(n)
    for f in np.flatnonzero(good & ~coded):
        a = int(body[f]) // 8 + 1
        raw = data[a : a + int(n[f])] if verbatim[f] else np.repeat(data[a : a + 1], int(n[f]))
        out[f] = (raw ^ np.uint8(0x80)).tobytes()
    mine = np.flatnonzero(good & coded)
    if not len(mine):
        return good, out
    mine = mine[np.argsort(-n[mine], kind="stable")]
    words = (data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]).astype(np.uint32)
    place, kk, width, left = at[mine] + 10, k[mine], n[mine], n[mine] - order[mine]
    samples = np.zeros((int(width.max()) + ORDER, len(mine)), np.int64)  # ORDER rows of zeros come first
    for o in range(ORDER):
        warm = np.flatnonzero(order[mine] > o)
        samples[ORDER + o, warm] = _signed(_read_fields(bits, body[mine[warm]] + 8 + 8 * o, 8), 8)
    del bits
    low, bad = (1 << kk) - 1, np.zeros(len(mine), bool)
    c, s = coefficients[mine].T.copy(), shift[mine]
    active = np.searchsorted(-width, -np.arange(int(width.max())), side="left")
    for t in range(int(width.max())):
        m = int(active[t])
        going = t >= order[mine[:m]] if t < ORDER else None
        p = place[:m]
        x = words[p >> 3] << (p & 7).astype(np.uint32)
        q = _ZEROS[x >> np.uint32(16)].astype(np.int64)
        size = q + 1 + kk[:m]
        u = q << kk[:m] | (x.astype(np.int64) >> (32 - size).clip(0)) & low[:m]
        r = u >> 1 ^ -(u & 1)
        guess = c[0, :m] * samples[ORDER + t - 1, :m]
        for j in range(1, ORDER):
            guess += c[j, :m] * samples[ORDER + t - 1 - j, :m]
        value = (guess >> s[:m]) + r
        wrong = (q > 15) | (size > 25)
        if going is None:
            samples[ORDER + t, :m] = value
            place[:m] += size
            bad[:m] |= wrong
        else:
            samples[ORDER + t, :m] = np.where(going, value, samples[ORDER + t, :m])
            place[:m] += np.where(going, size, 0)
            bad[:m] |= wrong & going
    pcm = np.ascontiguousarray(((samples[ORDER:] + 128) & 0xFF).astype(np.uint8).T)
    for row, f in enumerate(mine.tolist()):
        out[f] = pcm[row, : int(n[f])].tobytes()
    good[mine[bad]] = False
    return good, out


def payload(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "media") -> DataFrame:
    """key, n_bytes (unpadded), media: every whole text as a FLAC stream. Null counts as empty: 64 zero bytes."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1), GROUP):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                streams = encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(streams, pa.binary())], names=[key, "n_bytes", out])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, `{out}` binary")


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, block, sample_offset, n_samples, pcm: a row a frame, so that a reader seeks by sample offset. Null media has no rows."""
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1), GROUP):
                rows, out = [], ([], [], [], [])
                present = [(i, s) for i, s in enumerate(batch.column(1).slice(a, b - a).to_pylist(), a) if s is not None]
                for (i, _), blocks in zip(present, decode([s for _, s in present])):
                    for k, (offset, pcm) in enumerate(blocks):
                        rows.append(i)
                        for column_, v in zip(out, (k, offset, len(pcm), pcm)):
                            column_.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=[key, "block", "sample_offset", "n_samples", "pcm"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, block int, sample_offset long, n_samples int, pcm binary")


def features(pcm: bytes, blocks: int) -> str:
    """Blocks, mean, root mean square, peak and zero crossings of the decoded samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={blocks};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings}"


def media_digests(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Digest columns of stored media, all from the decoded bytes but media_bytes and media_sha256; n_blocks counts the PCM blocks, whose sample
    offsets must follow each other without a gap, or the job ends. Null media gives nulls, repeated rows and null keys give rows of their own."""
    kind = dict(media.dtypes)[key]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(2), GROUP):
                streams = batch.column(2).slice(a, b - a).to_pylist()
                decoded = iter(decode([s for s in streams if s is not None]))
                rows = []
                for s in streams:
                    if s is None:
                        rows.append([None] * len(names))
                        continue
                    blocks = next(decoded)
                    pcm = b"".join(x for _, x in blocks)
                    if [offset for offset, _ in blocks] != [0, *accumulate(len(x) for _, x in blocks)][:-1]:
                        raise ValueError("sample offsets of the PCM blocks leave a gap")
                    rows.append([len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(s), hashlib.sha256(s).hexdigest(), features(pcm, len(blocks)), len(blocks)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[key, "n_bytes", *names])

    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return media.select(key, "n_bytes", column).mapInArrow(run, f"`{key}` {kind}, n_bytes long, {ddl}")
