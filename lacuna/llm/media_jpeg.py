"""Media columns: texts kept as baseline JPEG, read back by a numpy decoder.

A payload byte b becomes one 8 x 8 block of flat grey b: with a DC quantiser of 8 the block's DC
coefficient is b - 128, so the picture's DC-only thumbnail *is* the payload and the code is
lossless. A picture is 192 blocks wide; each row of blocks is one restart interval, so rows start
on a byte and are decoded side by side (one numpy lane each). A picture holds ``MAX_ROWS`` rows;
longer payloads go on in a further picture, and the pictures follow each other in the stored bytes.

The decoder reads any baseline (SOF0) Huffman-coded picture of 8-bit samples: markers, tables,
restart intervals, stuffed bytes, one to four components with sampling factors, interleaved scans,
AC coefficients (walked over, not kept). Progressive or arithmetic pictures raise ``ValueError``.

Defined cases: a row without an id is left out; a null text is an empty one; an empty text gives one row of 192 spaces; equal texts
give equal values; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lacuna.llm import wordblock as wb

COLS = 192
MAX_ROWS = 8191
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int"
MEDIA_SCHEMA = SCHEMA + ", media binary"
_LANES = 16384

# Categories of DC differences (0 to 8 occur), most usual first for texts, with their code lengths.
_DC_LENGTHS = {6: 2, 5: 2, 7: 3, 4: 4, 3: 5, 2: 6, 0: 7, 1: 8, 8: 9}
_AC_LENGTHS = {0: 1}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """BITS, HUFFVAL and symbol -> (code, length), as Annex C of the JPEG standard assigns them."""
    order = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    bits = [0] * 16
    codes, code, last = {}, 0, 0
    for s in order:
        n = lengths[s]
        code <<= n - last if last else 0
        last = n
        codes[s] = (code, n)
        bits[n - 1] += 1
        code += 1
    return bits, order, codes


_DC_BITS, _DC_VALS, _DC_CODES = canonical(_DC_LENGTHS)
_AC_BITS, _AC_VALS, _AC_CODES = canonical(_AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quant = bytes([8] + [1] * 63)
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + quant),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(_DC_BITS) + bytes(_DC_VALS)),
        _segment(0xC4, b"\x10" + bytes(_AC_BITS) + bytes(_AC_VALS)),
        _segment(0xDD, struct.pack(">H", COLS)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def _coder() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference -255..255: the bits of a whole block (DC code, value, end of block) and their number."""
    values, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    eob, eob_n = _AC_CODES[0]
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        code, n = _DC_CODES[cat]
        low = diff if diff >= 0 else diff + (1 << cat) - 1
        values[diff + 255] = (((code << cat) | low) << eob_n) | eob
        sizes[diff + 255] = n + cat + eob_n
    return values, sizes


_VALUES, _SIZES = _coder()


def encode_rows(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-code rows of 192 samples; each row is stuffed and padded on its own. Returns bytes and row bounds."""
    rows = len(samples)
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1].astype(np.int16)
    diff[:, 0] -= 128
    at = (diff + 255).ravel()
    sizes = _SIZES[at]
    row_bits = sizes.reshape(rows, COLS).sum(1)
    row_bytes = (row_bits + 7) // 8
    base = np.concatenate(([0], np.cumsum(row_bytes)))
    place = np.cumsum(sizes.reshape(rows, COLS), axis=1) - sizes.reshape(rows, COLS) + base[:-1, None] * 8
    place = place.ravel()
    byte, shift = place >> 3, 32 - (place & 7) - sizes
    word = _VALUES[at].astype(np.uint64) << shift.astype(np.uint64)
    packed = np.zeros(base[-1] + 4, np.uint8)
    long = np.flatnonzero((place & 7) + sizes > 24)
    np.add.at(packed, byte[long] + 3, (word[long] & np.uint64(255)).astype(np.uint8))
    for k in range(3):
        packed += np.bincount(byte + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=base[-1] + 4).astype(np.uint8)
    packed = packed[: base[-1]]
    packed[base[1:] - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)
    full = packed == 255
    room = np.cumsum(full) - full
    stuffed = np.zeros(base[-1] + int(full.sum()), np.uint8)
    stuffed[np.arange(base[-1]) + room] = packed
    bounds = base + np.concatenate((room, [int(full.sum())]))[np.minimum(base, len(room))]
    return stuffed.tobytes(), bounds


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """One stored form for each payload (lengths are positive multiples of 192)."""
    if not payloads:
        return []
    body, bounds = encode_rows(np.concatenate(payloads).reshape(-1, COLS))
    out, row = [], 0
    for p in payloads:
        parts, left = [], len(p) // COLS
        while left:
            n = min(left, MAX_ROWS)
            scan = []
            for r in range(n):
                scan.append(body[bounds[row + r] : bounds[row + r + 1]])
                if r + 1 < n:
                    scan.append(b"\xff" + bytes((0xD0 + r % 8,)))
            parts += [_header(n), *scan, b"\xff\xd9"]
            row, left = row + n, left - n
        out.append(b"".join(parts))
    return out


# ---- reading ----


class Frame:
    """Marker data of one picture, with the bounds of its restart intervals in the stored bytes."""

    __slots__ = ("width", "height", "components", "tables", "quant", "interval", "scan", "segments", "end")


def parse(data: bytes, at: int = 0) -> Frame:
    """Walk the markers of one picture that starts at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f = Frame()
    f.tables, f.quant, f.interval, f.scan, f.segments = {}, {}, 0, None, []
    at += 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            f.end = at + 2
            return f
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            precision, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples are not of 8 bits")
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline picture")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                f.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                f.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            f.interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            if f.scan is not None or n != len(f.components):
                raise ValueError("pictures of several scans are not read")
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            begin = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise ValueError("a scan has no end")
                nxt = data[at + 1]
                if nxt == 0:
                    at += 2
                elif 0xD0 <= nxt <= 0xD7:
                    f.segments.append((begin, at))
                    at += 2
                    begin = at
                elif nxt == 0xFF:
                    at += 1
                else:
                    f.segments.append((begin, at))
                    break


_luts: dict[bytes, np.ndarray] = {}


def _lut(spec: bytes) -> np.ndarray:
    """16-bit window -> length << 8 | symbol (length 0: no such code)."""
    if spec not in _luts:
        lut, code, k = np.zeros(65536, np.uint16), 0, 16
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                lut[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        _luts[spec] = lut
    return _luts[spec]


def _plan(f: Frame) -> tuple[list[tuple[int, int, int]], int, int]:
    """(component, DC table, AC table) of each block of an MCU; MCUs across and down."""
    by = {c: (i, h, v) for i, (c, h, v, _) in enumerate(f.components)}
    if len(f.scan) == 1:
        _, h, v = by[f.scan[0][0]]
        return [(0, f.scan[0][1], f.scan[0][2])], -(-f.width // 8), -(-f.height // 8)
    hm, vm = max(c[1] for c in f.components), max(c[2] for c in f.components)
    plan = [(by[c][0], d, a) for c, d, a in f.scan for _ in range(by[c][1] * by[c][2])]
    return plan, -(-f.width // (8 * hm)), -(-f.height // (8 * vm))


def decode_dc(data: bytes, frames: list[Frame]) -> list[np.ndarray]:
    """DC coefficients in scan order, (MCUs, blocks of an MCU), of pictures with one and the same plan and tables."""
    plan, _, _ = _plan(frames[0])
    specs = [frames[0].tables[d] for _, d, _ in plan], [frames[0].tables[16 + a] for _, _, a in plan]
    kinds = list(dict.fromkeys([*specs[0], *specs[1]]))
    luts = np.stack([_lut(s) for s in kinds])
    dc_of = np.array([kinds.index(s) for s in specs[0]])
    ac_of = np.array([kinds.index(s) for s in specs[1]])
    comp_of = np.array([c for c, _, _ in plan])
    lanes, counts = [], []
    for f in frames:
        _, across, down = _plan(f)
        total = across * down
        step = f.interval or total
        want = [min(step, total - i) for i in range(0, total, step)]
        if len(want) != len(f.segments):
            raise ValueError("restart intervals and markers differ in number")
        lanes += f.segments
        counts += want
    results: list[np.ndarray] = []
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, len(lanes), _LANES):
        results += _decode_lanes(raw, lanes[lo : lo + _LANES], np.array(counts[lo : lo + _LANES]), luts, dc_of, ac_of, comp_of)
    out, k = [], 0
    for f in frames:
        out.append(np.concatenate(results[k : k + len(f.segments)]))
        k += len(f.segments)
    return out


def _decode_lanes(raw, lanes, counts, luts, dc_of, ac_of, comp_of) -> list[np.ndarray]:
    """Decode restart intervals side by side: all lanes take their next block together."""
    span = np.array(lanes, np.int64).reshape(-1, 2)
    lo, hi = int(span[:, 0].min()), int(span[:, 1].max())
    part = raw[lo:hi]
    plain = np.ones(len(part), bool)
    plain[1:] = (part[1:] != 0) | (part[:-1] != 255)
    room = np.concatenate(([0], np.cumsum(plain)))
    bits = np.concatenate((part[plain], np.full(16, 255, np.uint8)))
    # window[i]: the 64 bits from byte i on; a DC code, its value and an AC code fit behind any shift of 0 to 7
    window = np.lib.stride_tricks.as_strided(bits, (len(bits) - 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    last = len(window) - 1
    pos = room[span[:, 0] - lo] * 8
    stop = room[span[:, 1] - lo] * 8
    order = np.argsort(-counts, kind="stable")  # lanes that end early are the last ones, cut off as they end
    pos, stop, many = pos[order], stop[order], counts[order]
    coef = np.zeros((len(dc_of), int(counts.max()), len(counts)), np.int16)
    pred = np.zeros((int(comp_of.max()) + 1, len(counts)), np.int64)
    u = np.uint64
    live = len(order)
    for mcu in range(int(counts.max())):
        while many[live - 1] <= mcu:
            live -= 1
        if (pos[:live] > stop[:live]).any():
            raise ValueError("a restart interval ends too early")
        for b in range(len(dc_of)):
            dc, ac, c = luts[dc_of[b]], luts[ac_of[b]], comp_of[b]
            p = pos[:live]
            w = window[np.minimum(p >> 3, last)] << (p & 7).astype(u)
            got = dc[w >> u(48)]
            size, cat = (got >> 8).astype(u), (got & 255).astype(u)
            if not size.all():
                raise ValueError("no such Huffman code")
            w <<= size
            top = (w >> u(1)) >> (u(63) - cat)
            v = top.astype(np.int64)
            v -= np.where(w >> u(63), 0, (1 << cat.astype(np.int64)) - 1)
            w <<= cat
            pred[c, :live] += v
            coef[b, mcu, :live] = pred[c, :live]
            got = ac[w >> u(48)].astype(np.int64)
            used = size.astype(np.int64) + cat.astype(np.int64) + (got >> 8)
            sym = got & 255
            if not (got >> 8).all():
                raise ValueError("no such Huffman code")
            pos[:live] = p + used + (sym & 15)
            if sym.any():
                _skip_ac(window, last, pos, np.flatnonzero(sym), sym[sym != 0], ac)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    wide = coef.transpose(2, 1, 0)
    return [wide[back[i], : counts[i]] for i in range(len(counts))]


def _skip_ac(window, last, pos, lane, sym, ac) -> None:
    """Walk over the rest of a block's AC symbols for the lanes whose first one was ``sym``."""
    k = np.where(sym == 0xF0, 17, (sym >> 4) + 2)
    while len(lane):
        go = k < 64
        lane, k = lane[go], k[go]
        p = pos[lane]
        w = window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint64)
        got = ac[w >> np.uint64(48)].astype(np.int64)
        if not (got >> 8).all():
            raise ValueError("no such Huffman code")
        sym = got & 255
        pos[lane] = p + (got >> 8) + (sym & 15)
        k = np.where(sym == 0, 64, k + np.where(sym == 0xF0, 16, (sym >> 4) + 1))


def luminance(f: Frame, dc: np.ndarray) -> np.ndarray:
    """The DC-only thumbnail of the first component, one sample for each 8 x 8 block."""
    plan, across, down = _plan(f)
    _, h, v, q = f.components[0]
    mine = [i for i, (c, _, _) in enumerate(plan) if c == 0]
    if len(plan) == 1:
        h = v = 1
    grid = dc[:, mine].astype(np.int32).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    thumb = np.clip(np.floor_divide(grid * f.quant[q] + 4, 8) + 128, 0, 255).astype(np.uint8)
    hm, vm = max(c[1] for c in f.components), max(c[2] for c in f.components)
    wide, high = -(-f.width * f.components[0][1] // (8 * hm)), -(-f.height * f.components[0][2] // (8 * vm))
    return thumb[:high, :wide]


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each stored form, the luminance thumbnails of its pictures."""
    joined = b"".join(media)
    frames, of, at = [], [], 0
    for i, m in enumerate(media):
        end = at + len(m)
        while at < end:
            f = parse(joined, at)
            frames.append(f)
            of.append(i)
            at = f.end
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        plan, _, _ = _plan(f)
        groups.setdefault(tuple((c, f.tables[d], f.tables[16 + a]) for c, d, a in plan), []).append(i)
    out: list[list[np.ndarray]] = [[] for _ in media]
    done: list[np.ndarray | None] = [None] * len(frames)
    for members in groups.values():
        for i, dc in zip(members, decode_dc(joined, [frames[i] for i in members]), strict=True):
            done[i] = luminance(frames[i], dc)
    for i, thumb in zip(of, done, strict=True):
        out[i].append(thumb)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash over an 8 x 9 grid of cell means."""
    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(cells) * n // cells
        return lo, np.maximum(lo + 1, np.arange(1, cells + 1) * n // cells)

    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    (y0, y1), (x0, x1) = edges(thumb.shape[0], 8), edges(thumb.shape[1], 9)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def payload(text: bytes) -> np.ndarray:
    room = max(COLS, -(-len(text) // COLS) * COLS)
    out = np.full(room, 32, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def _rows(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, limit=1 << 20):
            texts = [block.text(i) for i in range(len(block))]
            media = encode([payload(t) for t in texts])
            cols: dict[str, list] = {c.split()[0]: [] for c in (MEDIA_SCHEMA if with_media else SCHEMA).split(", ")}
            for doc, text, m, thumbs in zip(block.column("doc_id"), texts, media, thumbnails(media), strict=True):
                back = b"".join(t.tobytes() for t in thumbs)
                width, height = thumbs[0].shape[1] * 8, sum(t.shape[0] for t in thumbs) * 8
                row = (doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:" + ".".join(thumbnail_hash(t) for t in thumbs), width, height, len(thumbs))
                for c, v in zip(cols.values(), (*row, m) if with_media else row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=_arrow(with_media))

    return run


def _arrow(with_media: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in (MEDIA_SCHEMA if with_media else SCHEMA).split(", ")])


def media_columns(docs, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True):
    """One row per document: stored form, dimensions, thumbnail hash and digests of what was read back.

    Map-only: no shuffle, and a block of about 1 MB of text in memory at a time.
    """
    return wb.doc_text(docs, id_col, text_col).mapInArrow(_rows(keep_media), MEDIA_SCHEMA if keep_media else SCHEMA)
