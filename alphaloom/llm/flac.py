"""FLAC in numpy: mono streams of fixed block size, many frames at a time.

Encoding picks, for each frame, a fixed predictor of order 0 to 2 or a quantised linear predictor, with
Rice parameters for each of four partitions. Decoding finds frames by their headers (checksum and number
in sequence), reads the Rice residuals of all frames in lockstep, restores the samples and verifies the
CRC-16 of every frame and the MD5 of every stream. Frame n begins at sample n times the block
size, so each frame is a block that can be sought by its sample offset.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import accumulate
from dataclasses import dataclass

import numpy as np

BLOCK, RATE, PARTITIONS, LPC_ORDER, PRECISION = 1024, 16_000, 2, 2, 12
MAGIC = b"fLaC"
#: Block sizes by their code in a frame header (fixed values); codes 6 and 7 are followed by the size.
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _crc_table(poly: int, width: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        x = np.where(x >> (width - 1) & 1, x << 1 ^ poly, x << 1) & ((1 << width) - 1)
    return x.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(_CRC8[out ^ b])
    return out


@functools.lru_cache(maxsize=8)
def _crc16_by_distance(length: int) -> np.ndarray:
    """(length, 256): what a byte adds to the CRC-16 of a message, by how many bytes follow it."""
    out = np.empty((length, 256), np.uint16)
    out[0] = _CRC16
    for i in range(1, length):
        out[i] = (out[i - 1] << 8) ^ _CRC16[out[i - 1] >> 8]
    return out


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of ``data`` (sizes over 0)."""
    table = _crc16_by_distance(1 << max(11, int(size.max()).bit_length()))
    end = np.cumsum(size)
    after = np.repeat(end, size) - np.arange(end[-1]) - 1
    at = np.repeat(start - end + size, size) + np.arange(end[-1])
    return np.bitwise_xor.reduceat(table.ravel()[after * 256 + data[at]], end - size)


@functools.lru_cache(maxsize=1 << 16)
def frame_header(number: int, size: int) -> bytes:
    code = next((c for c, n in SIZES.items() if n == size), 6 if size <= 256 else 7)
    extra = b"" if code not in (6, 7) else (size - 1).to_bytes(code - 5, "big")
    coded = bytes([number])
    if number >= 0x80:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        tail = [0x80 | number >> 6 * i & 0x3F for i in range(n - 1)][::-1]
        coded = bytes([(0xFF << (8 - n) & 0xFF) | number >> 6 * (n - 1), *tail])
    out = bytes([0xFF, 0xF8, code << 4, 0x02]) + coded + extra
    return out + bytes([crc8(out)])


def read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, block size, header length) of a mono frame of 8-bit samples, or None."""
    head = data[at : at + 16]
    if len(head) < 6 or head[2] & 0x0F or head[3] not in (0x00, 0x02):
        return None
    lead = 8 - (head[4] ^ 0xFF).bit_length()
    if lead == 1 or lead > 7:
        return None
    n = lead or 1
    number = head[4] & (0x7F >> lead if lead else 0x7F)
    for b in head[5 : 4 + n]:
        number = number << 6 | b & 0x3F
    code, length = head[2] >> 4, 4 + n
    if code in (6, 7):
        size = int.from_bytes(head[length : length + code - 5], "big") + 1
        length += code - 5
    elif code in SIZES:
        size = SIZES[code]
    else:
        return None
    if len(head) <= length or crc8(head[:length]) != head[length]:
        return None
    return number, size, length + 1


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, LPC_ORDER) and shifts, by Levinson's recursion on exact sums."""
    n, p = x.shape[1], LPC_ORDER
    auto = np.stack([(x[:, : n - k].astype(np.int64) * x[:, k:]).sum(axis=1) for k in range(p + 1)], axis=1).astype(np.float64)
    a, error = np.zeros((len(x), p)), np.maximum(auto[:, 0], 1.0) * (1 + 1e-9)
    for i in range(p):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-6)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 1 - np.frexp(top)[1], 0, 15).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, parameters of the partitions and bits in all, of each frame."""
    u = (residual << 1) ^ (residual >> 31)
    u[:, :order] = 0
    parts = u.reshape(len(u), 1 << PARTITIONS, -1)
    count = np.full(1 << PARTITIONS, parts.shape[2])
    count[0] -= order
    mean = parts.sum(axis=2) / count
    low = np.clip(np.frexp(mean * 0.6931 + 1e-9)[1] - 1, 0, 13)
    best_bits, best = None, low
    for k in (low, low + 1):
        bits = (parts >> k[:, :, None]).sum(axis=2) + count * (1 + k)
        if best_bits is None:
            best_bits = bits
        else:
            best, best_bits = np.where(bits < best_bits, k, best), np.minimum(bits, best_bits)
    return u, best, best_bits.sum(axis=1)


def encode_frames(x: np.ndarray) -> list[bytes]:
    """Subframe bytes of each row of ``x`` (frames, samples) int32, samples of 8 bits."""
    f, n = x.shape
    coef, shift = _lpc(x)
    guess = np.zeros((f, n), np.int64)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    lpc = (x - (guess >> shift[:, None])).astype(np.int32)
    tries = []
    for kind in (0, 1, 2, "lpc"):
        order = LPC_ORDER if kind == "lpc" else kind
        r = lpc if kind == "lpc" else x.copy()
        if kind in (1, 2):
            r[:, order:] = np.diff(x, n=order, axis=1)
        u, k, bits = _rice(r, order)
        tries.append((kind, order, u, k, bits + order * 8 + (9 + PRECISION * order if kind == "lpc" else 0)))
    choice = np.argmin(np.stack([t[4] for t in tries]), axis=0)
    out: list[bytes] = [b""] * f
    for c, (kind, order, u, k, _) in enumerate(tries):
        rows = np.flatnonzero(choice == c)
        if not len(rows):
            continue
        m = len(rows)
        head = 0b0_100000_0 | order - 1 << 1 if kind == "lpc" else 0b0_001000_0 | order << 1
        values, sizes = [np.full((m, 1), head)], [np.full((m, 1), 8)]
        values.append(x[rows, :order] & 0xFF), sizes.append(np.full((m, order), 8))
        if kind == "lpc":
            values.append(np.column_stack([PRECISION - 1 << 5 | shift[rows], coef[rows] & (1 << PRECISION) - 1]))
            sizes.append(np.broadcast_to([9, *[PRECISION] * order], (m, 1 + order)))
        values.append(np.full((m, 1), PARTITIONS)), sizes.append(np.full((m, 1), 6))
        step = n >> PARTITIONS
        for p in range(1 << PARTITIONS):
            part = u[rows, p * step + (order if p == 0 else 0) : (p + 1) * step]
            param = k[rows, p : p + 1]
            values += [param, (1 << param) | (part & (1 << param) - 1)]
            sizes += [np.full((m, 1), 4), (part >> param) + 1 + param]
        for row, data in zip(rows, _packed(np.concatenate(values, axis=1).astype(np.int64), np.concatenate(sizes, axis=1).astype(np.int64))):
            out[row] = data
    return out


def _packed(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each row's codes end to end, the row padded to whole bytes. A code has its value in its last bits (16 at most) after zeros."""
    end = np.cumsum(sizes, axis=1)
    size = (end[:, -1] + 7) // 8
    start = np.cumsum(size) - size
    last = (end - 1 + start[:, None] * 8).ravel()
    word = values.ravel() << (7 - (last & 7))
    at, total = last >> 3, int(size.sum())
    data = np.zeros(total + 2)
    for back in range(3):  # bits of different codes never meet, so sums are unions
        data += np.bincount(at - back + 2, word >> 8 * back & 0xFF, minlength=total + 2)[: total + 2]
    flat = data[2:].astype(np.uint8).tobytes()
    return [flat[a : a + n] for a, n in zip(start.tolist(), size.tolist())]


def stream_info(total: int, sizes: list[int], md5: bytes) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | total
    body = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return MAGIC + bytes([0x80]) + len(body).to_bytes(3, "big") + body


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A stream of each payload (of 64 bytes or a multiple); byte b is the sample b - 128."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    frames: dict[int, list[tuple[int, int, int]]] = {}  # by block size: (stream, number, first sample)
    at = 0
    for i, p in enumerate(payloads):
        for number, first in enumerate(range(0, len(p), BLOCK)):
            frames.setdefault(min(BLOCK, len(p) - first), []).append((i, number, at + first))
        at += len(p)
    bodies: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for n, group in frames.items():
        for part in range(0, len(group), 2048):
            some = group[part : part + 2048]
            x = flat[np.array([g[2] for g in some])[:, None] + np.arange(n)]
            for (i, number, _), data in zip(some, encode_frames(x)):
                bodies[i][number] = frame_header(number, n) + data
    every = [b for body in bodies for b in body]
    size = np.array([len(b) for b in every])
    checks = crc16(np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size).tolist()
    out, k = [], 0
    for p, body in zip(payloads, bodies):
        parts = [b + checks[k + j].to_bytes(2, "big") for j, b in enumerate(body)]
        k += len(body)
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        out.append(stream_info(len(p), [len(x) for x in parts], hashlib.md5(signed).digest()) + b"".join(parts))
    return out


@dataclass
class Decoded:
    """One stream: its samples as bytes (sample + 128), and (sample offset, byte offset, samples) of each frame."""

    pcm: bytes
    seek: list[tuple[int, int, int]]


class _Lanes:
    """Bit positions of many frames in one buffer."""

    def __init__(self, data: np.ndarray, bit: np.ndarray):
        b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        self.last = len(data)
        self.bit = bit.astype(np.int64)
        self.lead = np.full(1 << 16, 16, np.int64)  # zeros before the first one in 16 bits
        for z in range(15, -1, -1):
            self.lead[1 << (15 - z) : 1 << (16 - z)] = z

    def _window(self, rows: slice | np.ndarray) -> np.ndarray:
        """The 25 bits or more that follow each position, from the top of 32."""
        bit = self.bit[rows]
        return self.words[np.minimum(bit >> 3, self.last)] << (bit & 7).astype(np.uint32)

    def read(self, rows: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Unsigned values of n (1 to 24) bits."""
        w = self._window(rows)
        self.bit[rows] += n
        return (w >> np.asarray(32 - n).astype(np.uint32)).astype(np.int64)

    def signed(self, rows: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v, half = self.read(rows, n), 1 << (np.asarray(n) - 1)
        return (v ^ half) - half

    def rice(self, rows: slice | np.ndarray, k: np.ndarray) -> np.ndarray:
        w = self._window(rows)
        q = self.lead[w >> 16]
        if (q + 1 + k).max(initial=0) > 24 or q.max(initial=0) == 16:  # a long code: zeros are skipped 16 at a time
            rows = np.arange(rows.stop) if isinstance(rows, slice) else rows
            q, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
            while len(open_):
                z = self.lead[self._window(rows[open_]) >> 16]
                q[open_] += z
                self.bit[rows[open_]] += z
                open_ = open_[(z == 16) & (self.bit[rows[open_]] >> 3 < self.last)]
            self.bit[rows] += 1
            rem = np.where(k > 0, self.read(rows, np.maximum(k, 1)), 0)
            self.bit[rows] -= k == 0
            u = q << k | rem
        else:
            rem = (w << (q + 1).astype(np.uint32)) >> (32 - k).astype(np.uint32) if k.min(initial=1) > 0 else np.where(k > 0, (w << (q + 1).astype(np.uint32)) >> np.minimum(32 - k, 31).astype(np.uint32), 0)
            self.bit[rows] += q + 1 + k
            u = q << k | rem.astype(np.int64)
        return u >> 1 ^ -(u & 1)


def decode_frames(data: np.ndarray, start: np.ndarray, sizes: np.ndarray, bits: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frames whose subframes start at the bytes ``start``, and the byte after each (before the CRC-16)."""
    order = np.argsort(-sizes, kind="stable")  # lanes end from the back
    n = sizes[order]
    lanes = _Lanes(data, start[order] * 8)
    every = np.arange(len(n))
    kind = lanes.read(every, 8) >> 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    constant, verbatim = kind == 0, kind == 1
    if not (fixed | linear | constant | verbatim).all():
        raise ValueError("reserved subframe type")
    predict = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    out = np.zeros((len(n), int(n.max())), np.int32)
    if constant.any():
        rows = np.flatnonzero(constant)
        out[rows] = lanes.signed(rows, bits)[:, None]
    for t in range(int(predict.max())):
        rows = np.flatnonzero(predict > t)
        out[rows, t] = lanes.signed(rows, bits)
    coef, shift = np.zeros((len(n), 32), np.int64), np.zeros(len(n), np.int64)
    if linear.any():
        rows = np.flatnonzero(linear)
        precision = lanes.read(rows, 4) + 1
        shift[rows] = lanes.signed(rows, 5)
        for j in range(int(predict[rows].max())):
            some = predict[rows] > j
            coef[rows[some], j] = lanes.signed(rows[some], precision[some])
    coded = np.flatnonzero(fixed | linear)
    wide = np.zeros(len(n), bool)
    parts = np.zeros(len(n), np.int64)
    wide[coded] = lanes.read(coded, 2) == 1
    parts[coded] = lanes.read(coded, 4)
    span = n >> parts
    k, raw = np.zeros(len(n), np.int64), np.where(verbatim, bits, 0)
    plain = not (constant.any() or verbatim.any())
    bound = np.where(fixed | linear, 0, 1 << 40)  # where the next partition begins
    for t in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -t))  # the first lanes, those with more than t samples
        begins = every[:live][(bound[:live] <= t) & (predict[:live] <= t)]
        if len(begins):
            width = np.where(wide[begins], 5, 4)
            k[begins] = lanes.read(begins, width)
            escape = k[begins] == (1 << width) - 1
            raw[begins] = 0
            if escape.any():
                rows = begins[escape]
                raw[rows] = lanes.read(rows, 5)
                k[rows] = 0
                raw[rows[raw[rows] == 0]] = -1  # all residuals 0, no bits
            bound[begins] = (t // span[begins] + 1) * span[begins]
            plain = not (constant.any() or verbatim.any() or (raw != 0).any())
        if plain and t >= predict[:live].max(initial=0):
            out[:live, t] = lanes.rice(slice(0, live), k[:live])
            continue
        ready = (predict[:live] <= t) & ~constant[:live]
        rows = np.flatnonzero(ready & (raw[:live] == 0))
        out[rows, t] = lanes.rice(rows, k[rows])
        rows = np.flatnonzero(ready & (raw[:live] > 0))
        if len(rows):
            out[rows, t] = lanes.signed(rows, raw[rows])
    for p in range(1, 5):  # a fixed predictor of order p sums p times
        rows = np.flatnonzero(fixed & (predict == p))
        if len(rows):
            x = out[rows].astype(np.int64)
            warm = x[:, :p].copy()
            for j in range(p - 1, -1, -1):
                x[:, j] = np.diff(warm, n=j, axis=1)[:, 0]
                x[:, j:] = np.cumsum(x[:, j:], axis=1)
            out[rows] = x
    rows = np.flatnonzero(linear)
    if len(rows):
        x, most = out[rows].astype(np.int64).T.copy(), int(predict[rows].max())
        c, s, p = coef[rows, :most].T.copy(), shift[rows], predict[rows]
        for t in range(1, x.shape[0]):
            back = min(t, most)
            guess = (c[:back] * x[t - back : t][::-1]).sum(axis=0) >> s
            x[t] += np.where(p <= t, guess, 0) if t < most else guess
        out[rows] = x.T
    end = np.empty(len(n), np.int64)
    end[order] = (lanes.bit + 7) // 8
    samples: list[np.ndarray] = [np.empty(0, np.int32)] * len(n)
    for lane, i in enumerate(order):
        samples[i] = out[lane, : n[lane]]
    return samples, end


def _head(m: bytes) -> tuple[int, int, bytes]:
    """Samples, where the first frame begins, and the MD5 of a stream."""
    if len(m) < 42 or m[:4] != MAGIC or m[4] & 0x7F:
        raise ValueError("no FLAC stream")
    total = int.from_bytes(m[18:26], "big") & (1 << 36) - 1
    if int.from_bytes(m[18:26], "big") >> 36 & 0xFF != 7:
        raise ValueError("only mono streams of 8-bit samples are read")
    first, last = 4, False
    while not last:
        if first + 4 > len(m):
            raise ValueError("no FLAC stream")
        last, first = bool(m[first] & 0x80), first + 4 + int.from_bytes(m[first + 1 : first + 4], "big")
    return total, first, m[26:42]


def _decoded(parts: list[np.ndarray], starts: list[int], md5: bytes) -> Decoded | None:
    signed = b"".join(x.astype(np.int8).tobytes() for x in parts)
    if any(md5) and hashlib.md5(signed).digest() != md5:
        return None
    sizes = [len(x) for x in parts]
    return Decoded((np.frombuffer(signed, np.uint8) ^ 0x80).tobytes(), list(zip(accumulate(sizes, initial=0), starts, sizes)))


def _decode_in_turn(m: bytes) -> Decoded:
    """A stream frame by frame, each where the one before it ends; ValueError where a checksum or the structure is wrong."""
    (total, at, md5), flat = _head(m), np.frombuffer(m + bytes(16), np.uint8)
    parts, starts, samples = [], [], 0
    while samples < total:
        h = read_header(m, at)
        if h is None or h[0] != len(parts):
            raise ValueError("frames are missing")
        try:
            (x,), (end,) = decode_frames(flat, np.array([at + h[2]]), np.array([h[1]]))
        except IndexError as e:
            raise ValueError("a frame is broken") from e
        if end + 2 > len(m) or crc16(flat, np.array([at]), np.array([end + 2 - at])).any():
            raise ValueError("a frame's CRC-16 is wrong")
        parts.append(x), starts.append(at)
        at, samples = int(end) + 2, samples + h[1]
    out = _decoded(parts, starts, md5)
    if samples != total or out is None:
        raise ValueError("a stream's MD5 is wrong")
    return out


def _decode_side_by_side(media: list[bytes]) -> list[Decoded | None]:
    """The streams' samples by frames that are found by their headers and decoded together; None where they don't fit."""
    data = b"".join(media)
    flat = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((flat[:-1] == 0xFF) & (flat[1:] == 0xF8)).tolist()
    starts, heads, sizes, spans = [], [], [], []
    at, s = 0, 0
    for m in media:
        total, first, md5 = _head(m)
        k, samples, end = len(starts), 0, at + len(m)
        while s < len(sync) and sync[s] < end:
            if sync[s] >= at + first and samples < total and (h := read_header(data, sync[s])) and h[0] == len(starts) - k:
                starts.append(sync[s]), heads.append(sync[s] + h[2]), sizes.append(h[1])
                samples += h[1]
            s += 1
        spans.append((k, len(starts), at, at + first, end, samples == total, md5))
        at = end
    parts: list[np.ndarray] = []
    begin, ends = np.array(starts, np.int64), np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 8192):
        some, ends[a : a + 8192] = decode_frames(flat, np.array(heads[a : a + 8192]), np.array(sizes[a : a + 8192]))
        parts += some
    good = ends + 2 <= len(flat)
    if len(starts):
        good[good] = crc16(flat, begin[good], ends[good] + 2 - begin[good]) == 0
    out: list[Decoded | None] = []
    for k, z, at, first, end, whole, md5 in spans:
        fits = whole and good[k:z].all() and np.array_equal(np.append(begin[k:z], end)[1:], ends[k:z] + 2) and (k == z or begin[k] == first)
        out.append(_decoded(parts[k:z], [x - at for x in starts[k:z]], md5) if fits else None)
    return out


def decode_streams(media: list[bytes]) -> list[Decoded]:
    """The streams' samples; ValueError where a checksum or the structure is wrong.

    Bits inside a frame may look like a header of the next one. Frames are therefore taken only where
    each begins at the end of the one before it and has a right CRC-16; a stream whose frames, as
    found, do not fit is decoded again in turn.
    """
    try:
        out = _decode_side_by_side(media) if media else []
    except (IndexError, ValueError):  # what looked like a frame is none
        out = [None] * len(media)
    return [_decode_in_turn(m) if d is None else d for m, d in zip(media, out)]
