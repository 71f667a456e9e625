"""Baseline JPEG in numpy: DC-only luminance thumbnails, and pictures made of DC.

``decode_thumbnails`` parses markers and Huffman-decodes baseline scans of any
component count, sampling and restart interval, and keeps the DC coefficient of
every luminance block: a thumbnail of an eighth of the picture's size.  Restart
intervals are independent bit strings, so all intervals of all pictures of a
call are decoded in step, one symbol of each at a time.

``encode_gray`` writes thumbnails as full-size grey pictures whose blocks hold
nothing but their DC coefficient, quantised by 8, so decoding returns every
sample exactly.  A block row is a restart interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The DC Huffman table for luminance of the JPEG standard (annex K.3.1), codes of each length, then symbols.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: An AC table for pictures without AC coefficients: end-of-block is the one-bit code 0.
AC_LENGTHS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
MAX_ROWS = 65535 // 8


def code_table(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits), codes counted up as the standard orders them."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For any 16 bits: length << 8 | symbol of the code they begin with, 0 if none."""
    out = np.zeros(1 << 16, np.uint16)
    for s, (code, bits) in code_table(lengths, symbols).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a whole block (DC difference, end of block) by difference + 255."""
    dc = code_table(DC_LENGTHS, DC_SYMBOLS)
    eob, eob_bits = code_table(AC_LENGTHS, AC_SYMBOLS)[0]
    codes, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = dc[size]
        extra = d if d > 0 else d + (1 << size) - 1
        codes[d + 255] = ((code << size | (extra if size else 0)) << eob_bits) | eob
        sizes[d + 255] = bits + size + eob_bits
    return codes, sizes


_CODES, _SIZES = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(width: int, height: int, interval: int) -> bytes:
    table = lambda kind, lengths, symbols: bytes((kind, *lengths, *symbols))
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xDB, bytes((0, 8, *[1] * 63)))
        + _segment(0xC0, bytes((8,)) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((1, 1, 0x11, 0)))
        + _segment(0xC4, table(0x00, DC_LENGTHS, DC_SYMBOLS)) + _segment(0xC4, table(0x10, AC_LENGTHS, AC_SYMBOLS))
        + _segment(0xDD, interval.to_bytes(2, "big")) + _segment(0xDA, bytes((1, 1, 0, 0, 63, 0)))
    )


def encode_gray(thumbnails: list[np.ndarray]) -> list[bytes]:
    """One JPEG a thumbnail; all must be uint8, equally wide and of 1 to ``MAX_ROWS`` rows."""
    if not thumbnails:
        return []
    columns = thumbnails[0].shape[1]
    rows = np.array([len(t) for t in thumbnails])
    x = np.concatenate(thumbnails).astype(np.int16) - 128
    diff = x.copy()
    diff[:, 1:] -= x[:, :-1]
    diff += 255
    sizes = _SIZES[diff]
    bits = sizes.sum(1)
    length = (bits + 7) >> 3
    begin = np.concatenate(([0], np.cumsum(length)))
    pad = length * 8 - bits
    # the last code of a row is its padding of ones
    code = np.concatenate([_CODES[diff], ((1 << pad) - 1).astype(np.uint64)[:, None]], 1).ravel()
    size = np.concatenate([sizes, pad[:, None]], 1)
    at = (np.cumsum(size, 1) - size + begin[:-1, None] * 8).ravel()
    size = size.ravel()
    words = np.zeros(int(begin[-1]) // 8 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    low = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[first]] += np.add.reduceat(low, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    flat = words.astype(">u8").view(np.uint8)[: begin[-1]]
    # a zero behind every 0xFF, and between rows a restart marker
    full = flat == 0xFF
    before = np.cumsum(full) - full
    row_of = np.repeat(np.arange(len(bits)), length)
    place = np.arange(len(flat)) + before + 2 * row_of
    total = len(flat) + int(full.sum()) + 2 * len(bits)
    out = np.zeros(total, np.uint8)
    out[place] = flat
    ends = np.concatenate((place[begin[1:-1]] - 2, [total - 2])) if len(bits) > 1 else np.array([total - 2])
    top = np.concatenate(([0], np.cumsum(rows)[:-1]))
    within = np.arange(len(bits)) - np.repeat(top, rows)
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + within % 8
    last = np.cumsum(rows) - 1
    out[ends[last] + 1] = 0xD9
    cuts = np.concatenate(([0], ends[last] + 2))
    body = out.tobytes()
    return [_head(columns * 8, int(r) * 8, columns) + body[a:b] for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)]


@dataclass
class _Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    """What the markers of one picture say; ``end`` is where it stops."""

    width: int
    height: int
    begin: int
    end: int
    interval: int
    parts: list[_Component]
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]]
    step: int  # of the luminance DC coefficient


def parse(data: bytes, at: int = 0) -> Picture:
    """The headers of a baseline picture with one scan over all components."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    tables: dict[int, tuple] = {}
    quant: dict[int, int] = {}
    frame: dict[int, _Component] = {}
    width = height = interval = 0
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = tuple(body[1:17]), tuple(body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = {body[6 + 3 * i]: _Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline pictures")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                part = frame[body[1 + 2 * i]]
                part.dc, part.ac = body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15
            parts = list(frame.values())
            if body[0] != len(parts) or not width or not height:
                raise ValueError("only pictures with one scan and a known size")
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            return Picture(width, height, at, end + 2, interval, parts, tables, quant[parts[0].quant])


def decode_thumbnails(pictures: list[tuple[bytes, Picture]]) -> list[np.ndarray]:
    """Luminance thumbnails (uint8, one sample a block) of parsed pictures."""
    tables: dict[tuple, int] = {}
    luts: list[np.ndarray] = []

    def table(p: Picture, key: int) -> int:
        t = p.tables[key]
        if t not in tables:
            tables[t] = len(luts)
            luts.append(_lookup(*t))
        return tables[t]

    # lanes: one a restart interval; plan: the blocks of one unit, as (table of DC, of AC, component, luminance place)
    starts, ends, first, units, plan_of, home = [], [], [], [], [], []
    plans: list[list[tuple[int, int, int, int]]] = []
    known: dict[tuple, int] = {}
    chunks, base, shapes = [], 0, []
    for k, (data, p) in enumerate(pictures):
        hmax, vmax = (max(c.h for c in p.parts), max(c.v for c in p.parts)) if len(p.parts) > 1 else (1, 1)
        across, down = -(-p.width // (8 * hmax)), -(-p.height // (8 * vmax))
        blocks = []
        for c, part in enumerate(p.parts):
            n = part.h * part.v if len(p.parts) > 1 else 1
            blocks += [(table(p, part.dc), table(p, part.ac), c, i if c == 0 else -1) for i in range(n)]
        key = tuple(blocks)
        if key not in known:
            known[key] = len(plans)
            plans.append(blocks)
        raw = np.frombuffer(data, np.uint8, p.end - 2 - p.begin, p.begin)
        ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
        marks = ff[(raw[ff + 1] >= 0xD0) & (raw[ff + 1] <= 0xD7)]
        drop = np.zeros(len(raw), bool)
        drop[ff[raw[ff + 1] == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        kept = np.cumsum(~drop)
        cut = kept[marks] if len(marks) else np.zeros(0, np.int64)  # bytes before each marker
        clean = raw[~drop]
        step = p.interval or across * down
        n = -(-across * down // step)
        if len(cut) < n - 1:
            raise ValueError("restart markers are missing")
        begins = np.concatenate(([0], cut[: n - 1]))
        starts.append(begins + base)
        ends.append(np.concatenate((cut[: n - 1], [len(clean)])) + base)
        first.append(np.arange(n) * step)
        units.append(np.minimum(step, across * down - np.arange(n) * step))
        plan_of.append(np.full(n, known[key]))
        home.append(np.full(n, k))
        chunks.append(clean)
        base += len(clean)
        shapes.append((across, down, p.parts[0].h if len(p.parts) > 1 else 1, p.parts[0].v if len(p.parts) > 1 else 1))
    if not pictures:
        return []
    bits = np.concatenate([*chunks, np.full(16, 0xFF, np.uint8)])
    window = np.ndarray((len(bits) - 8,), ">u8", bits, 0, (1,))
    start, limit, first, units, plan_of, home = (np.concatenate(x) for x in (starts, ends, first, units, plan_of, home))
    lut = np.stack(luts)
    wide = max(len(x) for x in plans)
    steps = np.zeros((len(plans), wide, 4), np.int64)
    for i, blocks in enumerate(plans):
        steps[i, : len(blocks)] = blocks
    unit_blocks = np.array([len(x) for x in plans])
    lumas = np.array([sum(b[3] >= 0 for b in x) for x in plans])
    # room for every lane's luminance values, in decoding order
    room = units * lumas[plan_of]
    offset = np.concatenate(([0], np.cumsum(room)))
    values = np.zeros(int(offset[-1]), np.int32)
    pos = start.astype(np.int64) * 8
    pred = np.zeros((len(pos), int(steps[:, :, 2].max()) + 1), np.int64)
    block = np.zeros(len(pos), np.int64)  # place in the unit
    left = units.copy()
    filled = offset[:-1].copy()
    coefficient = np.zeros(len(pos), np.int64)
    live = np.arange(len(pos))
    while len(live):
        at = pos[live]
        view = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        now = steps[plan_of[live], block[live]]
        k = coefficient[live]
        is_dc = k == 0
        entry = lut[np.where(is_dc, now[:, 0], now[:, 1]), (view >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        size = entry >> 8
        if not size.all():
            raise ValueError("not a Huffman code")
        symbol = entry & 0xFF
        extra = np.where(is_dc, symbol, symbol & 15)
        pos[live] = at + size + extra
        # DC: the difference, in one's complement if its first bit is 0
        d = live[is_dc]
        if len(d):
            e = extra[is_dc]
            v = ((view[is_dc] << size[is_dc].astype(np.uint64)) >> np.uint64(1) >> (63 - e).astype(np.uint64)).astype(np.int64)
            v = np.where((e > 0) & (v < (1 << np.maximum(e - 1, 0))), v - (1 << e) + 1, v)
            part = now[is_dc, 2]
            pred[d, part] += v
            luma = now[is_dc, 3] >= 0
            values[filled[d[luma]]] = pred[d[luma], 0]
            filled[d[luma]] += 1
        # AC: only positions matter
        jump = np.where(symbol == 0, 64, np.where(symbol == 0xF0, 16, (symbol >> 4) + 1))
        k = np.where(is_dc, 1, k + jump)
        done = k >= 64
        coefficient[live] = np.where(done, 0, k)
        if done.any():
            f = live[done]
            block[f] += 1
            full = f[block[f] == unit_blocks[plan_of[f]]]
            block[full] = 0
            left[full] -= 1
            live = live[left[live] > 0]
    if (pos > limit.astype(np.int64) * 8).any():
        raise ValueError("scan data end too early")
    out = []
    lane_of_picture = np.searchsorted(home, np.arange(len(pictures) + 1))
    for k, (_, p) in enumerate(pictures):
        across, down, h, v = shapes[k]
        a, b = offset[lane_of_picture[k]], offset[lane_of_picture[k + 1]]
        grid = values[a:b].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        grid = grid[: -(-p.height // 8), : -(-p.width // 8)] if len(p.parts) == 1 or (h, v) == (max(c.h for c in p.parts), max(c.v for c in p.parts)) else grid
        out.append(np.clip((grid * p.step + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out
