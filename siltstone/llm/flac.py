"""FLAC as a media column: lossless mono streams of 8-bit samples.

``encode`` writes fixed- and linear-predictor (LPC), verbatim and constant
subframes with partitioned Rice residuals, a seek table with one point a frame,
and all checksums. ``decode`` reads mono streams of 8-bit samples from any
encoder: LPC of any order, escaped partitions, wasted bits, blocks of varying
size, with any seek table or none; where the table doesn't list every frame it
looks for sync codes whose header and frame checksums are right. It verifies
every frame's CRC-8 and CRC-16 and the stream's MD5, and gives PCM blocks with
their sample offsets; ``read_at`` starts at any sample.
Frames are decoded side by side: one NumPy step reads the next residual of
every frame of a batch.

Cases: null or empty text becomes 64 zero bytes; very long texts become one
stream of many frames, coded and decoded some at a time; a damaged stream, or
one of several channels or other sample sizes, raises ValueError naming what is
wrong; equal texts, and repeated rows, give equal streams; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents

BLOCK = 4096
RATE = 8000
PARTITION_ORDER = 2
#: Order of the encoder's linear predictors, and bits of a tap.
LPC_ORDER, LPC_BITS = 4, 10
#: Bytes of streams decoded together.
DECODED = 4 << 20
#: Frames coded or decoded side by side.
FRAMES = 2048
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8 = [int(x) for x in _crc_table(0x07, 8)]
_CRC16 = _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


#: _AHEAD[d][b]: the CRC-16 of byte b with d zero bytes after it. A CRC is the XOR of its bytes' own.
_AHEAD = _CRC16[None]


def crc16_each(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices of data at once."""
    global _AHEAD
    out, longest = np.zeros(len(start), np.uint16), int(length.max(initial=0))
    if len(_AHEAD) < longest:
        more = np.empty((longest, 256), np.uint16)
        more[: len(_AHEAD)] = _AHEAD
        for d in range(len(_AHEAD), longest):
            more[d] = (more[d - 1] << np.uint16(8)) ^ _CRC16[more[d - 1] >> np.uint16(8)]
        _AHEAD = more
    flat, some = _AHEAD.ravel(), np.nonzero(length > 0)[0]
    for k in range(0, len(some), 512):
        rows = some[k : k + 512]
        n = length[rows]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        left = np.repeat(n - 1, n) - place
        out[rows] = np.bitwise_xor.reduceat(flat[left << 8 | data[np.repeat(start[rows], n) + place]], first)
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's UTF-8 style."""
    if n < 0x80:
        return bytes([n])
    for size, top in ((2, 11), (3, 16), (4, 21), (5, 26), (6, 31)):
        if n < 1 << top:
            tail = [0x80 | (n >> 6 * k) & 0x3F for k in range(size - 2, -1, -1)]
            return bytes([(0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1), *tail])
    raise ValueError("too many frames")


def _header(number: int, n: int) -> bytes:
    head = b"\xff\xf8\x74\x02" + _number(number) + struct.pack(">H", n - 1)
    return head + bytes([crc8(head)])


def _fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _emit(heads: list[bytes], value: np.ndarray, width: np.ndarray, low: np.ndarray) -> list[bytes]:
    """Frames from tokens: rows of value, of which the last `low` of `width` bits may be set."""
    bits = width.sum(axis=1)
    sizes = (bits + 7) >> 3
    end = (np.cumsum(sizes) - sizes)[:, None] * 8 + np.cumsum(width, axis=1)
    plane = np.zeros(int(sizes.sum()) * 8, np.uint8)
    for j in range(int(low.max())):
        live = low > j
        plane[end[live] - 1 - j] = (value[live] >> j) & 1
    raw, at, out = np.packbits(plane).tobytes(), 0, []
    for h, n in zip(heads, sizes.tolist(), strict=True):
        out.append(h + raw[at : at + n])
        at += n
    return out


def _closed(frames: list[bytes]) -> list[bytes]:
    """Frames with their CRC-16."""
    n = np.array([len(f) for f in frames])
    crc = crc16_each(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(n) - n, n)
    return [f + c.to_bytes(2, "big") for f, c in zip(frames, crc.tolist(), strict=True)]


def _rice(folded: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter of each partition, and the bits of each row."""
    f = folded.reshape(len(folded), parts, -1)
    n, sums = f.shape[2], f.sum(axis=2, dtype=np.int64)
    ks = np.arange(14)
    cost = n * (ks + 1) + (sums[..., None] >> ks)
    k = cost.argmin(axis=2)
    return k, np.take_along_axis(cost, k[..., None], 2)[..., 0].sum(axis=1)


def _linear(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(taps, shift, residuals) of each row by linear prediction: least squares on the autocorrelation, rounded to LPC_BITS bits."""
    count, n = samples.shape
    if n <= 4 * LPC_ORDER:
        return np.zeros((count, LPC_ORDER), np.int64), np.zeros(count, np.int64), np.full(samples.shape, 1 << 20, np.int32)
    r = np.stack([np.einsum("ij,ij->i", samples[:, : n - k], samples[:, k:], dtype=np.int64) for k in range(LPC_ORDER + 1)], axis=1).astype(np.float64)  # whole numbers: the same sums everywhere
    at = np.abs(np.arange(LPC_ORDER)[:, None] - np.arange(LPC_ORDER))
    matrix = r[:, at] + np.eye(LPC_ORDER) * (r[:, :1, None] * 1e-6 + 1)
    real = np.linalg.solve(matrix, r[:, 1:, None])[..., 0]
    top = np.maximum(np.abs(real).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 14)
    most = (1 << LPC_BITS - 1) - 1
    taps = np.clip(np.rint(real * (1 << shift)[:, None]), -most - 1, most).astype(np.int64)
    guess = np.zeros((count, n - LPC_ORDER), np.int32)
    for k in range(LPC_ORDER):
        guess += taps[:, k : k + 1].astype(np.int32) * samples[:, LPC_ORDER - 1 - k : n - 1 - k]
    residuals = np.zeros_like(samples)
    residuals[:, LPC_ORDER:] = samples[:, LPC_ORDER:] - (guess >> shift[:, None].astype(np.int32))
    return taps, shift, residuals


def _encode_same(samples: np.ndarray, numbers: list[int], partition_order: int) -> list[bytes]:
    """Frames of samples, all of one length."""
    count, n = samples.shape
    parts = 1 << (partition_order if n % (1 << partition_order) == 0 and n >> partition_order > 4 else 0)
    heads, out = [_header(k, n) for k in numbers], [b""] * count
    residuals, costs = [], []
    now = samples
    for order in range(5):
        full = np.zeros_like(samples)
        full[:, order:] = now
        residuals.append(full)
        costs.append(_rice(_fold(full), parts)[1] + 8 * order)
        now = np.diff(now, axis=1)
    costs = np.stack(costs)
    kind = costs.argmin(axis=0)
    taps, shift, linear = _linear(samples)
    linear_cost = _rice(_fold(linear), parts)[1] + LPC_ORDER * (8 + LPC_BITS) + 9
    kind[linear_cost < costs.min(axis=0)] = 7
    costs = np.minimum(costs, linear_cost)
    kind[costs.min(axis=0) + 6 + 4 * parts >= 8 * n] = 5
    kind[(samples == samples[:, :1]).all(axis=1)] = 6
    for what in np.unique(kind):
        rows = np.nonzero(kind == what)[0]
        s = samples[rows]
        if what == 6:
            value, width = np.concatenate([np.zeros((len(rows), 1), np.int32), s[:, :1] & 0xFF], 1), np.full((len(rows), 2), 8)
            low = width
        elif what == 5:
            value = np.concatenate([np.full((len(rows), 1), 0b00000010, np.int32), s & 0xFF], 1)
            low = width = np.full(value.shape, 8)
        else:
            order = LPC_ORDER if what == 7 else what
            u = _fold((linear if what == 7 else residuals[what])[rows])
            k, _ = _rice(u, parts)
            per = n // parts
            each = np.repeat(k, per, axis=1)
            code, code_n, code_low = (1 << each) | (u & ((1 << each) - 1)), (u >> each) + 1 + each, each + 1
            fill = lambda x, n=len(rows): np.full((n, 1), x)
            pieces = [(fill((31 + order if what == 7 else 8 + what) << 1), 8), (s[:, :order] & 0xFF, 8)]
            if what == 7:
                pieces += [(fill(LPC_BITS - 1), 4), (shift[rows, None], 5), (taps[rows] & (1 << LPC_BITS) - 1, LPC_BITS)]
            pieces.append((fill(parts.bit_length() - 1), 6))
            vs, ws, ls = [p for p, _ in pieces], [np.full(p.shape, w) for p, w in pieces], [np.full(p.shape, w) for p, w in pieces]
            for j in range(parts):
                a, b = max(j * per, order if j == 0 else 0), (j + 1) * per
                vs += [k[:, j : j + 1], code[:, a:b]]
                ws += [np.full((len(rows), 1), 4), code_n[:, a:b]]
                ls += [np.full((len(rows), 1), 4), code_low[:, a:b]]
            value, width, low = np.concatenate(vs, 1), np.concatenate(ws, 1), np.concatenate(ls, 1)
        for r, frame in zip(rows.tolist(), _emit([heads[r] for r in rows], value, width, low), strict=True):
            out[r] = frame
    return out


def encode(payloads: list[bytes], partition_order: int = PARTITION_ORDER) -> list[bytes]:
    """One FLAC stream for each payload: its bytes, less 128, are the samples. Payloads have 16 bytes at least."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for j in range(-(-len(p) // BLOCK)):
            by_length.setdefault(min(BLOCK, len(p) - j * BLOCK), []).append((i, j))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for n, places in by_length.items():
        for k in range(0, len(places), FRAMES):
            some = places[k : k + FRAMES]
            data = np.frombuffer(b"".join(payloads[i][j * BLOCK : j * BLOCK + n] for i, j in some), np.uint8).reshape(-1, n)
            for (i, j), frame in zip(some, _encode_same(data.astype(np.int32) - 128, [j for _, j in some], partition_order), strict=True):
                frames[i][j] = frame
    closed = iter(_closed([f for some in frames for f in some]))
    frames = [[next(closed) for _ in some] for some in frames]
    return [stream(f, len(p), hashlib.md5(samples_of(p)).digest()) for f, p in zip(frames, payloads, strict=True)]


def samples_of(payload: bytes) -> bytes:
    """Signed 8-bit samples of a payload, as bytes; its own inverse."""
    return payload.translate(_FLIP)


_FLIP = bytes(b ^ 0x80 for b in range(256))


def stream(frames: list[bytes], samples: int, md5: bytes) -> bytes:
    sizes = [len(f) for f in frames]
    block = min(BLOCK, max(16, samples))
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + md5
    points, at = [], 0
    for k, size in enumerate(sizes):
        points.append(struct.pack(">QQH", k * BLOCK, at, min(BLOCK, samples - k * BLOCK)))
        at += size
    points = points[:: -(-len(points) // 900_000) or 1]
    seek = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


class Bits:
    """Big-endian bits of many places of one buffer at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each position, left-aligned."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits, 0 to 57, from each position."""
        n = np.asarray(n, np.int64)
        return np.where(n > 0, (self.window(at) >> (np.uint64(64) - np.maximum(n, 1).astype(np.uint64))).astype(np.int64), 0)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        top = self.window(at) >> np.uint64(11)
        out = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        for i in np.nonzero(top == 0)[0]:  # long runs
            p, q = int(at[i]), 0
            while not self.read(np.array([p + q]), 32)[0]:
                q += 32
                if p + q > len(self.words) * 8:
                    raise ValueError("residual runs past the stream")
            word = int(self.read(np.array([p + q]), 32)[0])
            out[i] = q + 32 - word.bit_length()
        return out


def _signed(value: np.ndarray, bits) -> np.ndarray:
    return value - ((value >> (np.asarray(bits) - 1)) & 1) * (np.int64(1) << np.asarray(bits, np.int64))


def decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int = 8, bits: Bits | None = None) -> list[np.ndarray]:
    """Samples of each frame; every checksum is verified."""
    if not len(start):
        return []
    raw = memoryview(data)
    found = crc16_each(data, start, length - 2)
    said = data[start + length - 2].astype(np.uint16) << np.uint16(8) | data[start + length - 1]
    if (found != said).any():
        raise ValueError(f"frame {int(np.nonzero(found != said)[0][0])}: CRC-16 differs")
    n, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for i, s in enumerate(start.tolist()):
        try:
            n[i], first, _ = frame_header(raw, s)
        except ValueError as wrong:
            raise ValueError(f"frame {i}: {wrong}") from None
        at[i] = first * 8
    bits = bits or Bits(data)
    head = bits.read(at, 8)
    at += 8
    kind = head >> 1 & 63
    if (head & 0x80).any():
        raise ValueError("reserved bit of a subframe")
    wasted = np.zeros(len(start), np.int64)
    some = np.nonzero(head & 1)[0]
    if len(some):  # samples whose last bits are all zero come without them
        wasted[some] = bits.zeros(at[some]) + 1
        at[some] += wasted[some]
    depths = depth - wasted
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(start)
    for i in np.nonzero(kind == 0)[0]:
        out[i] = np.full(n[i], _signed(bits.read(at[i : i + 1], depths[i]), depths[i])[0]) << wasted[i]
    verbatim = np.nonzero(kind == 1)[0]
    for i in verbatim:
        out[i] = _signed(bits.read(at[i] + depths[i] * np.arange(n[i]), depths[i]), depths[i]) << wasted[i]
    coded = np.nonzero(kind >= 8)[0]
    if ((kind > 1) & (kind < 8)).any():
        raise ValueError("reserved subframe type")
    if not len(coded):
        return out
    coded = coded[np.argsort(-n[coded], kind="stable")]
    size, p, what = n[coded], at[coded], kind[coded]
    order = np.where(what >= 32, what - 31, what - 8)
    if (order[what < 32] > 4).any():
        raise ValueError("reserved subframe type")
    longest = int(size[0])
    got = np.zeros((longest, len(coded)), np.int32)  # warm-up samples, then residuals
    for j in range(int(order.max())):
        live = order > j
        own = depths[coded][live]
        got[j, live] = _signed(bits.read(p[live], own), own)
        p = p + live * depths[coded]
    lpc = what >= 32
    precision = np.where(lpc, bits.read(p, 4) + 1, 0)
    p = p + lpc * 4
    shift = np.where(lpc, bits.read(p, 5), 0)
    p = p + lpc * 5
    taps = np.zeros((len(coded), int(order.max())), np.int64)
    for j in range(taps.shape[1]):
        live = lpc & (order > j)
        taps[live, j] = _signed(bits.read(p[live], precision[live]), precision[live])
        p = p + live * precision
    for i in np.nonzero(~lpc)[0]:
        taps[i, : order[i]] = FIXED[order[i]]
    method, part = bits.read(p, 2), bits.read(p + 2, 4)
    p = p + 6
    wide = np.where(method == 1, 5, 4)
    per = size >> part
    k, escape = np.zeros(len(coded), np.int64), np.zeros(len(coded), bool)
    active = len(coded)
    step, escapes, words = np.gcd.reduce(per), False, bits.words
    for i in range(longest):
        while active and size[active - 1] <= i:
            active -= 1
        if i % step == 0 or i < 33:
            fresh = (i == 0) | (i % per[:active] == 0)
            fresh = np.nonzero(fresh)[0]
            if len(fresh):
                value = bits.read(p[fresh], wide[fresh])
                p[fresh] += wide[fresh]
                escape[fresh] = value == (1 << wide[fresh]) - 1
                raw_n = bits.read(p[fresh], 5)
                k[fresh] = np.where(escape[fresh], raw_n, value)
                p[fresh] += escape[fresh] * 5
            escapes = bool(escape[:active].any())
        if escapes or (i < 33 and (order[:active] > i).any()):
            live = np.nonzero(order[:active] <= i)[0]
            q, kk, plain = p[live], k[live], escape[live]
            z = np.where(plain, -1, bits.zeros(q))
            low = bits.read(q + z + 1, kk)
            got[i, live] = np.where(plain, _fold(_signed(low, np.maximum(kk, 1))) * (kk > 0), (z << kk) | low)
            p[live] = q + z + 1 + kk
            continue
        q, kk = p[:active], k[:active]
        w = words[q >> 3] << (q & 7).view(np.uint64)
        top = w >> np.uint64(11)
        z = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        used = z + kk
        if top.all() and int(used.max()) < 56:
            low = ((w << (z + 1).view(np.uint64)) >> np.uint64(1) >> (63 - kk).view(np.uint64)).view(np.int64)
        else:
            z = bits.zeros(q)
            used, low = z + kk, bits.read(q + z + 1, kk)
        got[i, :active] = z << kk | low
        q += used
        q += 1
    for j in range(longest):  # warm-up samples stay; the others unfold
        row = got[j]
        got[j] = np.where(order > j, row, (row >> 1) ^ -(row & 1))
    for o in np.unique(order):
        for fixed in (True, False):
            rows = np.nonzero((order == o) & (lpc != fixed))[0]
            if not len(rows) or not o:
                continue
            x = got[:, rows].astype(np.int64)
            if fixed:  # integrate the residual o times
                diffs = [x[:o]]
                for _ in range(o - 1):
                    diffs.append(np.diff(diffs[-1], axis=0))
                rest = x[o:]
                for level in range(o - 1, -1, -1):
                    rest = diffs[level][-1] + np.cumsum(rest, axis=0)
                got[o:, rows] = rest
            else:
                c, s = taps[rows, :o].T, shift[rows]
                for i in range(o, longest):
                    x[i] += (c * x[i - o : i][::-1]).sum(axis=0) >> s
                got[:, rows] = x
    for j, i in enumerate(coded):
        out[i] = got[: n[i], j] << wasted[i]
    return out


def frame_header(raw: memoryview | bytes, s: int) -> tuple[int, int, int]:
    """(samples, place of the first subframe, frame or sample number) of the mono 8-bit frame at s."""
    if s + 6 > len(raw) or raw[s] != 0xFF or raw[s + 1] & 0xFE != 0xF8:
        raise ValueError("no sync code")
    first, p = raw[s + 4], s + 5
    number = first
    if first >= 0x80:
        more = 8 - (first ^ 0xFF).bit_length() - 1
        number = first & 0x3F >> more
        for k in range(more):
            if p + k >= len(raw) or raw[p + k] >> 6 != 2:
                raise ValueError("frame number")
            number = number << 6 | raw[p + k] & 0x3F
        p += more
    size, rate = raw[s + 2] >> 4, raw[s + 2] & 15
    end = p + (1 if size == 6 else 2 if size == 7 else 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(raw) or crc8(bytes(raw[s:end])) != raw[end]:
        raise ValueError("CRC-8 differs")
    if not size or rate == 15 or raw[s + 3] & 1:
        raise ValueError("reserved header")
    if raw[s + 3] >> 4:
        raise ValueError("one channel only")
    if raw[s + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("samples of 8 bits only")
    if size == 6:
        samples = raw[p] + 1
    elif size == 7:
        samples = (raw[p] << 8 | raw[p + 1]) + 1
    else:
        samples = 192 if size == 1 else 576 << (size - 2) if size <= 5 else 256 << (size - 8)
    return samples, end + 1, number


_SYNC = re.compile(b"\xff[\xf8\xf9]")


def frames_of(media: bytes, at: int, total: int, points: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first sample, byte, bytes) of every frame from byte `at` on: from the seek points where they follow each other, else by sync codes.

    A frame ends where the next right header stands and its own checksum is
    right up to there; sync codes inside a frame fail one of these.
    """
    if points and points[0][:2] == (0, at) and sum(n for _, _, n in points) == total and all(a[0] + a[2] == b[0] for a, b in zip(points, points[1:])):
        ends = [b for _, b, _ in points[1:]] + [len(media)]
        return [(s, b, e - b) for (s, b, _), e in zip(points, ends, strict=True)]
    places = []
    for m in _SYNC.finditer(media, at):
        try:
            places.append((m.start(), frame_header(media, m.start())[0]))
        except ValueError:
            if m.start() == at:
                raise
    if not places or places[0][0] != at:
        raise ValueError("no frame where the first one should be")
    data, out, k, sample = np.frombuffer(media, np.uint8), [], 0, 0
    while k < len(places):
        start, samples = places[k]
        for j in range(k + 1, len(places) + 1):
            end = places[j][0] if j < len(places) else len(media)
            if end - start > 8 and int(crc16_each(data, np.array([start]), np.array([end - start - 2]))[0]) == media[end - 2] << 8 | media[end - 1]:
                break
        else:
            raise ValueError(f"frame {len(out)}: CRC-16 differs")
        out.append((sample, start, end - start))
        sample += samples
        k = j
    return out


def layout(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]]]:
    """(samples, MD5, frames as (first sample, byte, bytes)) of a stream; bytes count from its start."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, points, samples, md5 = 4, [], 0, b""
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            samples, md5 = packed & (1 << 36) - 1, body[18:34]
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("one channel of 8-bit samples only")
        elif kind & 127 == 3:
            points = [struct.unpack(">QQH", body[k : k + 18]) for k in range(0, size, 18)]
        at += 4 + size
        if kind & 128:
            break
    frames = frames_of(media, at, samples, [(s, at + b, n) for s, b, n in points if s != (1 << 64) - 1])
    return samples, md5, frames


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, signed 8-bit samples) of each stream, whole and verified."""
    starts, lengths, owners, offsets = [], [], [], []
    base, layouts = 0, [layout(m) for m in streams]
    for i, (m, (_, _, frames)) in enumerate(zip(streams, layouts, strict=True)):
        for s, b, size in frames:
            starts.append(base + b)
            lengths.append(size)
            owners.append(i)
            offsets.append(s)
        base += len(m)
    data = np.frombuffer(b"".join(streams), np.uint8)
    start, length = np.array(starts, np.int64), np.array(lengths, np.int64)
    out: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    bits = Bits(data)
    by_size = np.argsort(-length, kind="stable")  # frames of like size go together
    for k in range(0, len(start), FRAMES):
        some = by_size[k : k + FRAMES]
        for j, x in zip(some.tolist(), decode_frames(data, start[some], length[some], 8, bits), strict=True):
            out[owners[j]].append((offsets[j], x.astype(np.int8).tobytes()))
    for blocks in out:
        blocks.sort()
    for i, (blocks, (samples, md5, _)) in enumerate(zip(out, layouts, strict=True)):
        pcm = b"".join(b for _, b in blocks)
        # a stream may leave its number of samples, and its MD5, unsaid
        if (samples and len(pcm) != samples) or (any(md5) and hashlib.md5(pcm).digest() != md5):
            raise ValueError(f"stream {i}: samples or MD5 differ")
    return out


def read_at(media: bytes, sample: int, count: int) -> bytes:
    """count samples from a sample on, decoding only the frames that hold them."""
    _, _, frames = layout(media)
    nexts = [s for s, _, _ in frames[1:]] + [1 << 62]
    hit = [f for f, after in zip(frames, nexts, strict=True) if f[0] < sample + count and after > sample]
    data = np.frombuffer(media, np.uint8)
    pcm = b"".join(x.astype(np.int8).tobytes() for x in decode_frames(data, np.array([b for _, b, _ in hit], np.int64), np.array([n for _, _, n in hit], np.int64)))
    return pcm[sample - hit[0][0] :][:count] if hit else b""


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its UTF-8 filled with zero bytes to a positive multiple of 64)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    some, size, first = [], 0, 0
    for i, t in enumerate(texts):
        some.append(payload(t))
        size += len(some[-1][1])
        if size >= 1 << 22:
            yield first, some
            some, size, first = [], 0, i + 1
    if some:
        yield first, some


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, some in _groups(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array([n for n, _ in some], pa.int64()), pa.array(encode([p for _, p in some]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def flac_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_streams, "doc_id long, n_bytes long, media binary")


def _by_bytes(media: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, streams) in runs of about DECODED bytes."""
    first, size = 0, 0
    for i, m in enumerate(media):
        size += len(m)
        if size >= DECODED:
            yield first, media[first : i + 1]
            first, size = i + 1, 0
    if first < len(media):
        yield first, media[first:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(1).to_pylist()
        for k, some in _by_bytes(media):
            rows = [(i, j, s, len(b), b) for i, blocks in enumerate(decode(some)) for j, (s, b) in enumerate(blocks)]
            row, block, offset, n, pcm = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k).take(pa.array(row)), pa.array(block, pa.int32()), pa.array(offset, pa.int64()), pa.array(n, pa.int32()), pa.array(pcm, pa.binary())], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, media) to (doc_id, block, sample_offset, n_samples, pcm)."""
    return media.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def feature(pcm: bytes) -> str:
    """Peak, mean level and zero crossings of signed 8-bit samples."""
    x = np.frombuffer(pcm, np.int8).astype(np.int64)
    return f"peak={int(np.abs(x).max())};level={float(np.abs(x).mean()):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for k, media in _by_bytes(batch.column(2).to_pylist()):
            pcm = [b"".join(b for _, b in blocks) for blocks in decode(media)]
            back = [samples_of(p) for p in pcm]
            columns = [pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([feature(p) for p in pcm])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(media)), batch.column(1).slice(k, len(media)), *columns], names=names)


def op6_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_streams(documents(spark, sf_dir)).mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
