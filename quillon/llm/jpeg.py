"""Media columns: progressive JPEG, decoded and written in numpy.

Decoding follows the format: spectral-selection and successive-approximation scans accumulate in coefficient arrays,
an inverse transform gives samples, chroma is upsampled to full resolution and converted, and the RGB tensor is
returned. Entropy-coded intervals (between restart markers, or whole scans) of all images of a batch are decoded in
lockstep: one numpy step advances every interval by one symbol.

The writer stores bytes losslessly in the format's own unit, the quantised coefficient: 64 bytes are one block, in
zigzag order. Each byte has its own coefficient; bytes that are frequent in text have small ones, which take few bits.
"""
from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of payload or media that one numpy step works on; a longer value is worked on alone.
STEP_BYTES = 3_000_000
#: Restart interval of written files, in MCUs.
RESTART = 4
NOTE = b"quillon payload "
ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda x: (x[0] + x[1], x[0] if sum(x) % 2 else x[1]))])
#: Bytes by their usual frequency in text, the rest by number; and coefficients from short codes to long ones. Those of 1 and -1 come
#: last: they begin in the second scans, where they are slow.
_FREQUENT = b" etaoinshrdlucmfwypvbgk,.\n\xc3\xa9TASI"
COEFFICIENT = np.zeros(256, np.int16)
COEFFICIENT[[*_FREQUENT, *(b for b in range(256) if b not in _FREQUENT)]] = [0, *(v for m in range(2, 128) for v in (m, -m)), -128, 1, -1]
BYTE = np.argsort(COEFFICIENT).astype(np.uint8)
#: (components, first, last, high, low) of each written scan.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1),
          ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + count)``."""
    counts = np.asarray(counts, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


# ---------------------------------------------------------------- Huffman tables

def _lengths(weights: dict[int, float]) -> dict[int, int]:
    """Huffman code lengths of at most 16, with one code left free at the end, as the format asks."""
    while True:
        heap = [(w, s, (s,)) for s, w in weights.items()] + [(0.0, 999, (999,))]
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, 999], 0)
        while len(heap) > 1:
            (a, s, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                depth[k] += 1
            heapq.heappush(heap, (a + b, s, x + y))
        if max(depth.values()) <= 16:
            return depth
        weights = {k: w ** 0.8 for k, w in weights.items()}


@functools.cache
def _tables() -> tuple[tuple[bytes, np.ndarray, np.ndarray], ...]:
    """DC and AC table: its segment's content, and code and length by symbol. Weights suit the coefficients of text, halved."""
    out = []
    sizes = (0.34, 0.4, 0.17, 0.07, 0.015, 0.004, 0.001)
    for weights in ({s: 2.0 ** -abs(s - 3) for s in range(9)}, {0x00: 0.05, 0xF0: 2.0 ** -13} | {r << 4 | s: max(2.0 ** -13, w * 0.84 * 0.16 ** r) for r in range(16) for s, w in enumerate(sizes, 1)}):
        depth = _lengths(weights)
        order = sorted(depth, key=lambda s: (depth[s], s))
        code, last, codes, lens = 0, depth[order[0]], np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s in order:
            code <<= depth[s] - last
            last = depth[s]
            if s < 256:
                codes[s], lens[s] = code, last
            code += 1
        kept = [s for s in order if s < 256]
        out.append((bytes(sum(1 for s in kept if depth[s] == n) for n in range(1, 17)) + bytes(kept), codes, lens))
    return tuple(out)


@functools.lru_cache(64)
def _lookup(content: bytes) -> np.ndarray:
    """``length << 8 | symbol`` by the next 16 bits. Bits that begin no code count as one bit of symbol 0."""
    out, code, at = np.full(65536, 1 << 8, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(content[n - 1]):
            out[code << (16 - n): (code + 1) << (16 - n)] = n << 8 | content[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# ---------------------------------------------------------------- writing

def _segment(marker: int, content: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(content) + 2).to_bytes(2, "big") + content


def _pack(value, length, lane, lanes, image_of_lane):
    """Events' bits by lane, padded with ones, stuffed, and joined by restart markers; and each image's share."""
    ends = np.cumsum(length)
    bits = np.bincount(lane, weights=length, minlength=lanes).astype(np.int64)
    size = (bits + 7) >> 3
    first = np.cumsum(size) - size
    at = (ends - length) + np.repeat(8 * first - (np.cumsum(bits) - bits), np.bincount(lane, minlength=lanes))
    x, byte, total = value << (32 - (at & 7) - length), at >> 3, int(size.sum())
    out = np.zeros(total + 4)
    for j in range(4):
        if (part := (x >> (24 - 8 * j)) & 255).any():
            out += np.bincount(byte + j, weights=part, minlength=total + 4)
    out = out[:total].astype(np.uint8)
    full = size > 0
    out[(first + size - 1)[full]] |= ((1 << (8 * size - bits)) - 1)[full].astype(np.uint8)
    last = np.append(image_of_lane[1:] != image_of_lane[:-1], True)
    number = np.arange(lanes) - np.searchsorted(image_of_lane, image_of_lane)
    marks = np.cumsum(~last) - ~last
    stuffed = out == 255
    before = np.cumsum(stuffed) - stuffed
    place = np.arange(total) + before + 2 * np.repeat(marks, size)
    whole = np.zeros(total + int(stuffed.sum()) + 2 * int((~last).sum()), np.uint8)
    whole[place] = out
    stop = first + size + np.append(before, stuffed.sum())[first + size] + 2 * marks
    whole[stop[~last]] = 255
    whole[stop[~last] + 1] = 0xD0 + number[~last] % 8
    cuts = np.append(0, stop[last])
    data = whole.tobytes()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def write(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files, 4:2:0, whose coefficients stand for the payloads' bytes. Lengths are multiples of 64."""
    blocks = np.array([len(p) // 64 for p in payloads])
    mcus = np.maximum(1, -(-blocks // 6))
    wide = -(-mcus // 4095)
    high = -(-mcus // wide)
    mcus = wide * high
    base = np.cumsum(6 * mcus) - 6 * mcus
    coef = np.zeros((int(6 * mcus.sum()), 64), np.int16)
    for p, b, n in zip(payloads, base, blocks):
        coef[b: b + n] = COEFFICIENT[np.frombuffer(p, np.uint8)].reshape(-1, 64)
    (dc_table, dc_code, dc_len), (ac_table, ac_code, ac_len) = _tables()
    size_of = np.array([int(x).bit_length() for x in range(1024)])
    offset, count = (0 * mcus, 4 * mcus, 5 * mcus), (4 * mcus, mcus, mcus)
    y_order = np.concatenate([np.arange(4 * w * h).reshape(h, 2, w, 2).transpose(0, 2, 1, 3).ravel() + b for w, h, b in zip(wide, high, base)])
    files = [[b"\xff\xd8", _segment(0xFE, NOTE + str(len(p)).encode()), _segment(0xDB, b"\0" + b"\1" * 64),
              _segment(0xC2, bytes((8,)) + int(16 * h).to_bytes(2, "big") + int(16 * w).to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))),
              _segment(0xC4, b"\x00" + dc_table), _segment(0xC4, b"\x10" + ac_table), _segment(0xDD, RESTART.to_bytes(2, "big"))]
             for p, w, h in zip(payloads, wide, high)]
    for comps, ss, se, ah, al in SCRIPT:
        if ss == 0:
            each = 6
            order = np.empty((int(mcus.sum()), 6), np.int64)
            order[:, :4] = y_order.reshape(-1, 4)
            order[:, 4] = _ranges(base + offset[1], mcus)
            order[:, 5] = _ranges(base + offset[2], mcus)
            order, units = order.ravel(), mcus
        else:
            each, units = 1, count[comps[0]]
            order = _ranges(base + offset[comps[0]], units)
        lanes_each = -(-units // RESTART)
        image_of_lane = np.repeat(np.arange(len(payloads)), lanes_each)
        lane = np.repeat(_ranges(np.cumsum(lanes_each) - lanes_each, lanes_each), np.minimum(RESTART, np.repeat(units, lanes_each) - RESTART * _ranges(0 * units, lanes_each)) * each)
        lanes = len(image_of_lane)
        if ss == 0 and ah == 0:
            v = coef[order, 0].astype(np.int64) >> al
            part = np.tile([0, 0, 0, 0, 1, 2], len(v) // 6)
            diff = np.empty_like(v)
            for c in range(3):
                i = np.flatnonzero(part == c)
                diff[i] = v[i] - np.where(np.append(True, lane[i][1:] != lane[i][:-1]), 0, np.append(0, v[i][:-1]))
            s = size_of[abs(diff)]
            value, length = dc_code[s] << s | (np.where(diff < 0, diff - 1, diff) & ((1 << s) - 1)), dc_len[s] + s
        elif ss == 0:
            value, length = coef[order, 0].astype(np.int64) & 1, np.ones(len(order), np.int64)
        elif ah == 0:
            value, length, lane = _ac_first(coef[order, ss: se + 1], al, lane, ac_code, ac_len, size_of)
        else:
            value, length, lane = _ac_refine(coef[order, ss: se + 1], lane, ac_code, ac_len)
        head = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes((c + 1, 0)) for c in comps) + bytes((ss, se, ah << 4 | al)))
        for f, data in zip(files, _pack(value, length, lane, lanes, image_of_lane)):
            f += (head, data)
    return [b"".join((*f, b"\xff\xd9")) for f in files]


def _ac_first(c: np.ndarray, al: int, lane, code, lens, size_of):
    v = np.sign(c) * (abs(c) >> al)
    rows, ks = np.nonzero(v)
    x = v[rows, ks].astype(np.int64)
    new = np.append(True, rows[1:] != rows[:-1])[:len(rows)]
    run = ks - np.where(new, -1, np.append(0, ks[:-1])[:len(ks)]) - 1
    skips, s = run >> 4, size_of[abs(x)]
    sym = (run & 15) << 4 | s
    per_row = np.bincount(rows, minlength=len(v))
    last = np.cumsum(per_row) - 1
    eob = (per_row == 0) | (np.append(ks, 0)[last] < v.shape[1] - 1)
    skipped = np.cumsum(skips)
    eobs = np.cumsum(eob) - eob
    at = np.arange(len(rows)) + skipped + eobs[rows]
    n = len(rows) + int(skips.sum()) + int(eob.sum())
    value, length = np.full(n, code[0xF0]), np.full(n, lens[0xF0])
    value[at], length[at] = code[sym] << s | (np.where(x < 0, x - 1, x) & ((1 << s) - 1)), lens[sym] + s
    at = (last + 1 + np.append(0, skipped)[last + 1] + eobs)[eob]
    value[at], length[at] = code[0], lens[0]
    return value, length, np.repeat(lane, per_row + np.bincount(rows, weights=skips, minlength=len(v)).astype(np.int64) + eob)


def _ac_refine(c: np.ndarray, lane, code, lens):
    """Correction bits of what earlier scans sent. Blocks with coefficients of 1 or -1, which begin here, go one by one."""
    mag = abs(c)
    old, odd = mag > 1, (mag == 1).any(axis=1)
    n_old = np.where(odd, 0, old.sum(axis=1))
    special: dict[int, list[tuple[int, int]]] = {int(i): _refine_block(c[i], code, lens) for i in np.flatnonzero(odd)}
    per_row = n_old + 1
    for i, e in special.items():
        per_row[i] = len(e)
    start = np.cumsum(per_row) - per_row
    value, length = np.ones(int(per_row.sum()), np.int64), np.ones(int(per_row.sum()), np.int64)
    plain = ~odd
    value[start[plain]], length[start[plain]] = code[0], lens[0]
    rows, ks = np.nonzero(old & plain[:, None])
    value[np.arange(len(rows)) - (np.cumsum(n_old) - n_old)[rows] + start[rows] + 1] = mag[rows, ks] & 1
    for i, e in special.items():
        value[start[i]: start[i] + len(e)], length[start[i]: start[i] + len(e)] = zip(*e)
    return value, length, np.repeat(lane, per_row)


def _refine_block(c: np.ndarray, code, lens) -> list[tuple[int, int]]:
    out, bits, run = [], [], 0
    end = int(np.flatnonzero(abs(c) == 1)[-1])
    for k, x in enumerate(c.tolist()):
        if abs(x) > 1:
            bits.append((abs(x) & 1, 1))
        elif x == 0:
            run += 1
            if run == 16 and k < end:
                out += [(int(code[0xF0]), int(lens[0xF0])), *bits]
                bits, run = [], 0
        else:
            out += [(int(code[run << 4 | 1]) << 1 | (x > 0), int(lens[run << 4 | 1]) + 1), *bits]
            bits, run = [], 0
    return out + ([(int(code[0]), int(lens[0])), *bits] if bits or run else [])


# ---------------------------------------------------------------- reading

class Image:
    """Header, scans and, after decoding, coefficients of one file."""

    def __init__(self):
        self.error, self.note, self.scans, self.comps, self.blocks = "", b"", [], [], 0


class Damaged(ValueError):
    pass


def _parse(buf: bytes, begin: int, end: int, marks: np.ndarray, resets: np.ndarray) -> Image:
    """marks, resets: places of all markers but restarts, and of restarts."""
    img, at, quant, tables, restart = Image(), begin + 2, {}, {}, 0
    if buf[begin: begin + 2] != b"\xff\xd8":
        raise Damaged("no start of image")
    while True:
        while at < end and buf[at] == 255 and buf[at + 1] == 255:
            at += 1
        if at + 2 > end or buf[at] != 255:
            raise Damaged("no marker")
        kind = buf[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(buf[at + 2: at + 4], "big")
        part = buf[at + 4: at + 2 + size]
        if size < 2 or at + 2 + size > end:
            raise Damaged("cut off")
        at += 2 + size
        if kind == 0xDB:
            while part:
                wide = 64 * (1 + (part[0] >> 4))
                quant[part[0] & 15] = np.frombuffer(part[1: 1 + wide], ">u2" if part[0] >> 4 else "u1").astype(np.float32)
                part = part[1 + wide:]
        elif kind == 0xC4:
            while part:
                n = 17 + sum(part[1:17])
                tables[part[0]] = part[1:n]
                part = part[n:]
        elif kind == 0xC2:
            img.height, img.width = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            if part[0] != 8 or not img.height or not img.width or part[5] not in (1, 3):
                raise Damaged("unsupported frame")
            raw = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(part[5])]
            if len(raw) == 1:
                raw = [(raw[0][0], 1, 1, raw[0][3])]
            hm, vm = max(c[1] for c in raw), max(c[2] for c in raw)
            img.mx, img.my, img.hm, img.vm = -(-img.width // (8 * hm)), -(-img.height // (8 * vm)), hm, vm
            for ident, h, v, tq in raw:
                img.comps.append({"id": ident, "h": h, "v": v, "tq": tq, "bw": img.mx * h, "bh": img.my * v, "at": img.blocks,
                                  "w": -(-(-(-img.width * h // hm)) // 8), "hh": -(-(-(-img.height * v // vm)) // 8)})
                img.blocks += img.mx * h * img.my * v
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise Damaged("not a progressive Huffman file")
        elif kind == 0xDD:
            restart = int.from_bytes(part[:2], "big")
        elif kind == 0xFE and part.startswith(NOTE):
            img.note = part[len(NOTE):]
        elif kind == 0xDA:
            names = {c["id"]: i for i, c in enumerate(img.comps)}
            n = part[0]
            comps = [(names[part[1 + 2 * i]], part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15) for i in range(n)]
            ss, se, ah, al = part[1 + 2 * n], part[2 + 2 * n], part[3 + 2 * n] >> 4, part[3 + 2 * n] & 15
            if se > 63 or ss > se or (ss and n > 1) or (ss == 0 and se):
                raise Damaged("wrong scan")
            stop = int(marks[np.searchsorted(marks, at)])
            i, j = np.searchsorted(resets, (at, stop))
            img.scans.append({"comps": comps, "ss": ss, "se": se, "ah": ah, "al": al, "restart": restart, "tables": tables.copy(),
                              "starts": np.append(at, resets[i:j] + 2), "stops": np.append(resets[i:j], stop)})
            at = stop
    if not img.comps:
        raise Damaged("no frame")
    img.quant = quant
    return img


def _units(img: Image, scan: dict) -> tuple[np.ndarray, int]:
    """Block numbers in a scan's order, and blocks in each MCU. Those of small images, which are often of one size, are remembered."""
    parts = tuple(tuple(img.comps[i][k] for k in ("at", "bw", "bh", "w", "hh", "h", "v")) for i, _, _ in scan["comps"])
    return (_small_units if img.blocks <= 600 else _units_of)(parts, img.mx, img.my)


def _units_of(parts: tuple, mx: int, my: int) -> tuple[np.ndarray, int]:
    if len(parts) == 1:
        at, bw, _, w, hh, _, _ = parts[0]
        return (at + np.arange(hh)[:, None] * bw + np.arange(w)).ravel(), 1
    both = np.concatenate([(at + np.arange(bw * bh)).reshape(my, v, mx, h).transpose(0, 2, 1, 3).reshape(-1, h * v) for at, bw, bh, _, _, h, v in parts], axis=1)
    return both.ravel(), both.shape[1]


_small_units = functools.lru_cache(2000)(_units_of)


class _Bits:
    def __init__(self, data: np.ndarray):
        d = np.append(data, np.zeros(12, np.uint8)).astype(np.uint32)
        self.words, self.last = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:], len(d) - 5

    def take(self, p: np.ndarray, n) -> np.ndarray:
        """n bits (24 at most) from bit p on."""
        w = self.words[np.minimum(p >> 3, self.last)].astype(np.int64)
        return (w >> (32 - (p & 7) - n)) & ((1 << n) - 1)


def read(files: list[bytes]) -> list[Image]:
    """Headers and coefficient arrays of progressive files; a damaged or other file has ``error`` set."""
    whole = b"".join(files)
    raw = np.frombuffer(whole + b"\0\0", np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    is_reset = (after >= 0xD0) & (after <= 0xD7)
    marks, resets = ff[(after != 0) & (after != 255) & ~is_reset], ff[is_reset]
    keep = np.append(True, (raw[:-1] != 255) | (raw[1:] != 0))
    moved = np.cumsum(keep) - keep
    bits = _Bits(raw[keep])
    images, at, blocks = [], 0, 0
    for f in files:
        try:
            img = _parse(whole, at, at + len(f), marks, resets)
        except (Damaged, IndexError, KeyError) as e:
            img = Image()
            img.error = str(e) or "damaged"
        img.base, at = blocks, at + len(f)
        blocks += img.blocks if not img.error else 0
        images.append(img)
    coef = np.zeros((blocks, 64), np.int32)
    for k in range(max((len(i.scans) for i in images if not i.error), default=0)):
        kinds: dict[tuple[bool, bool], list] = {}
        for img in images:
            if not img.error and k < len(img.scans):
                s = img.scans[k]
                kinds.setdefault((s["ss"] == 0, s["ah"] == 0), []).append((img, s))
        for (dc, first), group in kinds.items():
            _scan(group, dc, first, bits, coef, moved)
    for img in images:
        if not img.error:
            img.coef = coef[img.base: img.base + img.blocks]
    return images


def _scan(group: list, dc: bool, first: bool, bits: _Bits, coef: np.ndarray, moved: np.ndarray) -> None:
    blk, begin, end, start, stop, owner, tabs, comp, at = [], [], [], [], [], [], [], [], 0
    luts: dict[bytes, int] = {}
    for n, (img, s) in enumerate(group):
        units, each = _units(img, s)
        step = (s["restart"] or len(units)) * each
        lanes = -(-len(units) // step)
        if lanes != len(s["starts"]):
            img.error = "restart markers do not fit the frame"
            continue
        b = at + step * np.arange(lanes)
        blk.append(units + img.base)
        begin.append(b)
        end.append(np.minimum(b + step, at + len(units)))
        start.append(8 * moved[s["starts"]])
        stop.append(8 * moved[s["stops"]])
        owner.append(np.full(lanes, n))
        kind = 0 if dc else 16
        try:
            own = [luts.setdefault(s["tables"][kind | (td if dc else ta)], len(luts)) if first or not dc else 0 for _, td, ta in s["comps"]]
        except KeyError:
            img.error = "no such table"
            for x in (blk, begin, end, start, stop, owner):
                x.pop()
            continue
        if dc and len(own) > 1:
            sizes = [img.comps[i]["h"] * img.comps[i]["v"] for i, _, _ in s["comps"]]
            comp.append(np.tile(np.repeat(np.arange(len(own)), sizes), len(units) // each))
            tabs.append(np.array(own)[comp[-1]])
        else:
            comp.append(np.zeros(len(units) if dc else lanes, np.int64))
            tabs.append(np.full(len(units) if dc else lanes, own[0]))
        at += len(units)
    if not blk:
        return
    blk, begin, end, start, stop, owner, tabs, comp = map(np.concatenate, (blk, begin, end, start, stop, owner, tabs, comp))
    lut = np.stack([_lookup(t) for t in luts]).ravel() if luts else np.zeros(1, np.int32)
    every = lambda key: np.array([s[key] for _, s in group])[owner]
    if dc:
        p = _dc(blk, begin, end, start, tabs, comp, every("al"), lut, bits, coef, first)
    elif first:
        p = _ac(blk, begin, end, start, tabs << 16, every("ss"), every("se"), every("al"), lut, bits, coef)
    else:
        p = _ac_again(blk, begin, end, start, tabs << 16, every("ss"), every("se"), every("al"), lut, bits, coef)
    for n in set(owner[p > stop].tolist()):
        group[n][0].error = "entropy-coded data ends early"


def _signed(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(x < (1 << s >> 1), x - (1 << s) + 1, x)


def _dc(blk, begin, end, p, tabs, comp, al, lut, bits, coef, first):
    p, seen = p.copy(), np.zeros((len(p), 4), np.int64)
    for j in range(int((end - begin).max())):
        i = np.flatnonzero(begin + j < end)
        b = begin[i] + j
        if first:
            t = lut[(tabs[b] << 16) + bits.take(p[i], 16)]
            s = (t & 255).astype(np.int64) & 15
            p[i] += t >> 8
            seen[i, comp[b]] += _signed(bits.take(p[i], s), s)
            p[i] += s
            coef[blk[b], 0] = seen[i, comp[b]] << al[i]
        else:
            coef[blk[b], 0] |= bits.take(p[i], 1) << al[i]
            p[i] += 1
    return p


def _ac(blk, begin, end, start, tab, ss, se, al, lut, bits, coef):
    flat, final, lane = coef.reshape(-1), start.copy(), np.arange(len(start))
    p, b, k = start.copy(), begin.copy(), ss.copy()
    while len(p):
        t = lut[tab + bits.take(p, 16)].astype(np.int64)
        p += t >> 8
        r, s = t >> 4 & 15, t & 15
        run_end = (s == 0) & (r < 15)
        n = np.where(run_end, r, s)
        x = bits.take(p, n)
        p += n
        k += r
        hit = s > 0
        spot = 64 * blk[b] + np.minimum(k, 63)
        if hit.all():
            flat[spot] = _signed(x, s) << al
        else:
            flat[spot[hit]] = _signed(x[hit], s[hit]) << al[hit]
        k += 1
        over = run_end | (k > se)
        if over.any():
            b += np.where(run_end, (1 << r) + x, over)
            k = np.where(over, ss, k)
            live = b < end
            if not live.all():
                final[lane[~live]] = p[~live]
                p, b, k, end, tab, ss, se, al, lane = (y[live] for y in (p, b, k, end, tab, ss, se, al, lane))
    return final


def _ac_again(blk, begin, end, start, tab, ss, se, al, lut, bits, coef):
    """Each step takes one symbol a lane; the correction bits behind it are noted as a range and applied at the end."""
    final, lane, flat = start.copy(), np.arange(len(start)), coef.reshape(-1)
    per = end - begin
    low = np.repeat(al, per)
    band = (np.arange(64) >= np.repeat(ss, per)[:, None]) & (np.arange(64) <= np.repeat(se, per)[:, None])
    now = coef[blk]
    old, zero = band & (now != 0), band & (now == 0)
    del now, band
    zc = np.zeros((len(blk), 65), np.int16)
    np.cumsum(zero, axis=1, out=zc[:, 1:])
    oc = np.zeros((len(blk), 65), np.int16)
    np.cumsum(old, axis=1, out=oc[:, 1:])
    z_at, o_at = (np.cumsum(c[:, 64], dtype=np.int64) - c[:, 64] for c in (zc, oc))
    z_list = np.append(np.nonzero(zero)[1], 63)
    o_rows, o_cols = np.nonzero(old)
    p, b, k, left = start.copy(), begin.copy(), ss.copy(), np.zeros(len(start), np.int64)
    seg_from, seg_n, seg_p = [], [], []
    while len(p):
        t = lut[tab + bits.take(p, 16)].astype(np.int64)
        fresh = left == 0
        r, s = t >> 4 & 15, t & 15
        p += np.where(fresh, t >> 8, 0)
        run_end = fresh & (s == 0) & (r < 15)
        n = np.where(run_end, r, np.where(fresh, s > 0, 0))
        x = bits.take(p, n)
        p += n
        left = np.where(run_end, (1 << r) + x, left)
        rest = left > 0
        rank = zc[b, k].astype(np.int64) + r
        found = rank < zc[b, 64]
        to = np.where(rest | ~found, se + 1, z_list[np.minimum(z_at[b] + rank, len(z_list) - 1)])
        n = oc[b, to].astype(np.int64) - oc[b, k]
        seg_from.append(o_at[b] + oc[b, k])
        seg_n.append(n)
        seg_p.append(p.copy())
        p += n
        hit = fresh & (s > 0) & found & ~rest
        if hit.any():
            flat[(64 * blk[b] + np.minimum(to, 63))[hit]] = (np.where(x > 0, 1, -1) << al)[hit]
        k = to + 1
        left -= rest
        over = rest | (k > se)
        b += over
        k = np.where(over, ss, k)
        live = b < end
        if not live.all():
            final[lane[~live]] = p[~live]
            p, b, k, left, end, tab, ss, se, al, lane = (y[live] for y in (p, b, k, left, end, tab, ss, se, al, lane))
    n = np.concatenate(seg_n)
    which, spot = _ranges(np.concatenate(seg_from), n), _ranges(np.concatenate(seg_p), n)
    one = bits.take(spot, 1) > 0
    rows = o_rows[which[one]]
    spot = 64 * blk[rows] + o_cols[which[one]]
    flat[spot] += np.sign(flat[spot]) << low[rows]
    return final


# ---------------------------------------------------------------- samples

@functools.cache
def _basis() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return (np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


def rgb(img: Image) -> np.ndarray:
    """Height x width x 3 samples: inverse transform, chroma repeated to full resolution, then conversion."""
    planes, basis = [], _basis()
    for c in img.comps:
        n = c["bw"] * c["bh"]
        x = np.empty((n, 64), np.float32)
        x[:, ZIGZAG] = img.coef[c["at"]: c["at"] + n] * img.quant[c["tq"]]
        x = basis.T @ (x.reshape(n, 8, 8) @ basis)
        x = x.reshape(c["bh"], c["bw"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * c["bh"], 8 * c["bw"])
        x = np.clip(np.rint(x + 128), 0, 255)
        if (fy := img.vm // c["v"]) > 1 or img.hm // c["h"] > 1:
            x = x.repeat(fy, axis=0).repeat(img.hm // c["h"], axis=1)
        planes.append(x[: img.height, : img.width])
    out = np.empty((img.height, img.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = planes[0][:, :, None]
        return out
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    for i, v in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, i] = np.clip(np.rint(v), 0, 255)
    return out


def payload(img: Image) -> bytes | None:
    """The bytes that ``write`` stored, or None for a file that it did not write."""
    if img.error or not img.note.isdigit() or int(img.note) > 64 * img.blocks:
        return None
    return BYTE[img.coef.ravel()[: int(img.note)] + 128].tobytes()


# ---------------------------------------------------------------- columns

def _groups(values: list, size=lambda x: len(x)):
    group, total = [], 0
    for x in values:
        group.append(x)
        total += size(x)
        if total > STEP_BYTES:
            yield group
            group, total = [], 0
    if group:
        yield group


def _columns(df: DataFrame, without: set[str]) -> tuple[list, str]:
    keep = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return keep, "".join(f"`{c.replace('`', '``')}` {t}, " for c, t in df.select(*keep).dtypes)


def store(df: DataFrame, content: str = "content", media: str = "media") -> DataFrame:
    """Adds ``media``: a progressive JPEG file whose coefficients stand for the bytes of ``content``, which is dropped.

    Zero bytes are appended up to a positive multiple of 64, so that null and empty content give one block of zeros.
    Equal contents give equal files. Other columns and repeated rows pass through; a column named like ``media`` is
    replaced. Per row, no shuffle.
    """
    keep, schema = _columns(df, {content, media})

    def run(batches):
        for batch in batches:
            begin = 0
            for group in _groups(batch.column(batch.num_columns - 1).to_pylist(), lambda x: len(x or b"")):
                values = [(x or b"").ljust(max(64, -(-len(x or b"") // 64) * 64), b"\0") for x in group]
                part = batch.slice(begin, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(write(values), pa.binary())], [*part.schema.names[:-1], media])
                begin += len(group)

    return df.select(*keep, F.col(f"`{content}`").cast("binary").alias("_content")).mapInArrow(run, f"{schema}`{media}` binary")


def tensors(df: DataFrame, media: str = "media", with_rgb: bool = True) -> DataFrame:
    """Decodes ``media`` and drops it. Adds ``width``, ``height``, ``rgb`` (height x width x 3 bytes, row by row; null if not
    ``with_rgb``), ``means`` (average of each channel), ``payload`` (bytes stored by ``store``, else null) and ``error``.

    Null, damaged, baseline or arithmetic-coded files give nulls and a text in ``error``, and do not end the job.
    Columns with those names are replaced; others and repeated rows pass through.
    """
    new = ("width", "height", "rgb", "means", "payload", "error")
    keep, schema = _columns(df, {media, *new})
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            begin = 0
            for group in _groups(batch.column(batch.num_columns - 1).to_pylist(), lambda x: len(x or b"")):
                cols: list[list] = [[] for _ in new]
                for img in read([x or b"" for x in group]):
                    row = (None, None, None, None, None, img.error)
                    if not img.error:
                        x = rgb(img)
                        means = (x.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (x.size // 3)).tolist()
                        row = (img.width, img.height, x.tobytes() if with_rgb else None, means, payload(img), None)
                    for col, v in zip(cols, row):
                        col.append(v)
                part = batch.slice(begin, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, kinds))], [*part.schema.names[:-1], *new])
                begin += len(group)

    return df.select(*keep, F.col(f"`{media}`").alias("_media")).mapInArrow(run, f"{schema}width int, height int, rgb binary, means array<double>, payload binary, error string")
