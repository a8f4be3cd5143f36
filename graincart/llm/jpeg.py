"""Progressive JPEG in numpy: scans into coefficient arrays, and coefficients into RGB.

``decode`` reads any Huffman-coded progressive file of 8-bit samples with one or three components.
Scans whose Huffman table has a single code have fields of one length and are read as arrays;
others are read bit by bit. ``pack`` writes bytes as such a file: every byte is a coefficient of
its own, so the file keeps the bytes although JPEG does not keep samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: For each place in the stream, the place in the 8 x 8 block.
ZIGZAG = np.array(
    sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
)
_N, _K = np.meshgrid(np.arange(8), np.arange(8))
_DCT = np.cos((2 * _N + 1) * _K * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)
#: From coefficients in stream order to samples.
_INVERSE = np.kron(_DCT, _DCT)[ZIGZAG].astype(np.float32)


@dataclass
class Part:
    """A component: sampling factors, table number, blocks of its image and coefficients in stream order."""

    name: int
    h: int
    v: int
    table: int
    wide: int = 0
    high: int = 0
    across: int = 0
    blocks: np.ndarray = field(default=None, repr=False)


@dataclass
class Image:
    width: int
    height: int
    parts: list[Part]
    quant: dict[int, np.ndarray]
    notes: list[bytes]


def _lay_out(width: int, height: int, parts: list[Part]) -> tuple[int, int]:
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    mcus = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for p in parts:
        p.wide = -(-(-(-width * p.h // most_h)) // 8)
        p.high = -(-(-(-height * p.v // most_v)) // 8)
        p.across = mcus[0] * p.h
        p.blocks = np.zeros((mcus[0] * p.h * mcus[1] * p.v, 64), np.int16)
    return mcus


class _Bits:
    """Bits of one restart interval; beyond its end there are zeros."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | (self.bits[self.at] if self.at < len(self.bits) else 0)
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        value = 0
        for n in range(1, 17):
            value = value << 1 | self.take(1)
            if (n, value) in codes:
                return codes[n, value]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _codes(data: bytes) -> tuple[dict[tuple[int, int], int], int]:
    counts, symbols, at, code = data[:16], data[16:], 0, 0
    codes = {}
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            codes[n, code] = symbols[at]
            at, code = at + 1, code + 1
        code <<= 1
    return codes, 16 + at


def _segments(data: bytes) -> list[bytes]:
    """The restart intervals of an entropy-coded part, without stuffed zeros."""
    if b"\xff" not in data:
        return [data]
    raw = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    edges = [0, *(mark + 2).tolist()]
    ends = [*mark.tolist(), len(data)]
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, ends, strict=True)]


def _single(codes: dict[tuple[int, int], int]) -> tuple[int, int] | None:
    """Length and symbol of the only code of a table."""
    return next(((n, s) for (n, _), s in codes.items())) if len(codes) == 1 else None


def _fields(data: bytes, count: int, size: int) -> np.ndarray:
    """``count`` fields of ``size`` bits as bits."""
    if size == 8:
        return np.unpackbits(np.frombuffer(data, np.uint8, count)).reshape(count, 8)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count * size).reshape(count, size)


def _values(bits: np.ndarray) -> np.ndarray:
    """Signed values of fields of bits, as JPEG extends them."""
    n = bits.shape[1]
    value = (np.packbits(bits, axis=1, bitorder="big")[:, 0].astype(np.int32) >> (8 - n)) if n <= 8 else bits @ (1 << np.arange(n - 1, -1, -1))
    return np.where(value >> (n - 1) & 1 if n else value < 0, value, value - (1 << n) + 1)


def _scan(parts: list[Part], ids: list[tuple[Part, dict, dict]], band: tuple[int, int], high: int, low: int, data: bytes, every: int, mcus: tuple[int, int]) -> None:
    one = len(ids) == 1
    part, dc, ac = ids[0]
    if one:
        order = (np.arange(part.high)[:, None] * part.across + np.arange(part.wide)).ravel()
        units = [[(part, dc, int(b))] for b in order] if not _fast(part, order, dc, ac, band, high, low, data, every) else []
    else:
        units = [
            [(p, d, (y * p.v + j) * p.across + x * p.h + i) for p, d, _ in ids for j in range(p.v) for i in range(p.h)]
            for y in range(mcus[1])
            for x in range(mcus[0])
        ]
    if not units:
        return
    segments = _segments(data)
    step = every or len(units)
    for k, segment in enumerate(segments):
        bits, before, run = _Bits(segment), {p.name: 0 for p in parts}, 0
        for unit in units[k * step : (k + 1) * step]:
            for p, d, b in unit:
                block = p.blocks[b]
                if band[0] == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[p.name] += bits.signed(bits.symbol(d))
                        block[0] = before[p.name] << low
                else:
                    run = (_refine if high else _first)(bits, block, ac, band, low, run)


def _first(bits: _Bits, block: np.ndarray, ac: dict, band: tuple[int, int], low: int, run: int) -> int:
    if run:
        return run - 1
    k = band[0]
    while k <= band[1]:
        r, s = divmod(bits.symbol(ac), 16)
        if s:
            k += r
            block[k] = bits.signed(s) * (1 << low)
            k += 1
        elif r < 15:
            return (1 << r) + bits.take(r) - 1
        else:
            k += 16
    return 0


def _refine(bits: _Bits, block: np.ndarray, ac: dict, band: tuple[int, int], low: int, run: int) -> int:
    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = band[0]
    while k <= band[1] and not run:
        r, s = divmod(bits.symbol(ac), 16)
        if not s and r < 15:
            run = (1 << r) + bits.take(r)
            break
        new = (1 if bits.take(1) else -1) * (1 << low) if s else 0
        while k <= band[1]:
            if block[k]:
                correct(k)
            elif r:
                r -= 1
            else:
                if new:
                    block[k] = new
                break
            k += 1
        k += 1
    if not run:
        return 0
    for j in range(k, band[1] + 1):
        if block[j]:
            correct(j)
    return run - 1


def _fast(part: Part, order: np.ndarray, dc: dict, ac: dict, band: tuple[int, int], high: int, low: int, data: bytes, every: int) -> bool:
    """Read a scan of one component whose fields all have one length; False if it is another scan."""
    n, width = len(order), band[1] - band[0] + 1
    whole = n == len(part.blocks)  # then the order is that of the array
    if band[0] == 0 and high and not every:
        raw = data.replace(b"\xff\x00", b"\xff")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(np.int16)
        part.blocks[order, 0] |= bits << low
        return True
    only = _single(dc if band[0] == 0 else ac) if not (band[0] == 0 and high) else None
    if only is None:
        return False
    length, (run, size) = only[0], divmod(only[1], 16)
    if band[0] == 0 and every == 1 and run == 0 and length + size == 8 and len(data) == 3 * n - 2:
        raw = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(n, 3)[:, :1]
        part.blocks[order, 0] = _values(np.unpackbits(raw, axis=1)[:, length:]) << low
        return True
    if band[0] == 0 or every or run:
        return False
    raw = data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data
    if not high and size and length + size == 8 and len(raw) == n * width:
        value = np.frombuffer(raw, np.uint8).astype(np.int16) & ((1 << size) - 1)
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1) << low
        if whole:
            part.blocks[:, band[0] : band[1] + 1] = value.reshape(n, width)
        else:
            part.blocks[order, band[0] : band[1] + 1] = value.reshape(n, width)
        return True
    if high and not size:
        now = part.blocks[:, band[0] : band[1] + 1] if whole else part.blocks[order, band[0] : band[1] + 1]
        if not now.all():
            return False
        bits = _fields(raw, n, length + width)[:, length:].astype(np.int16) << low
        now = np.where(now > 0, now + bits, now - bits)
        if whole:
            part.blocks[:, band[0] : band[1] + 1] = now
        else:
            part.blocks[order, band[0] : band[1] + 1] = now
        return True
    return False


def decode(data: bytes) -> Image:
    """The coefficients of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, every, quant, tables, image, mcus, notes = 2, 0, {}, {}, None, (0, 0), []
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = divmod(body[0], 16)
                quant[name] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                codes, used = _codes(body[1:])
                tables[body[0]] = codes
                body = body[1 + used :]
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xFE:
            notes.append(body)
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            parts = [Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, quant, notes)
            mcus = _lay_out(image.width, image.height, parts)
        elif marker == 0xDA:
            named = {p.name: p for p in image.parts}
            ids = [(named[body[i]], tables.get(body[i + 1] >> 4, {}), tables.get(16 | body[i + 1] & 15, {})) for i in range(1, 1 + 2 * body[0], 2)]
            first, last, steps = body[1 + 2 * body[0] :][:3]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _scan(image.parts, ids, (first, last), steps >> 4, steps & 15, data[at:end], every, mcus)
            at = end
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive Huffman-coded file")
    return image


def to_rgb(image: Image) -> np.ndarray:
    """uint8 samples (height, width, 3): inverse transform, chroma upsampled to full size, RGB."""
    most_h, most_v = max(p.h for p in image.parts), max(p.v for p in image.parts)
    planes = []
    for p in image.parts:
        values = (p.blocks * image.quant[p.table]).astype(np.float32) @ _INVERSE
        down = len(p.blocks) // p.across
        plane = values.reshape(down, p.across, 8, 8).swapaxes(1, 2).reshape(down * 8, p.across * 8)
        if (most_v // p.v, most_h // p.h) != (1, 1):
            plane = plane.repeat(most_v // p.v, axis=0).repeat(most_h // p.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    y = planes[0] + np.float32(128.5)
    if len(planes) == 1:
        planes = [y, y, y]
    else:
        cb, cr = planes[1], planes[2]
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    return np.stack([np.clip(x, 0, 255).astype(np.uint8) for x in planes], axis=-1)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    flat = bits.ravel()
    rest = -len(flat) % 8
    return np.packbits(np.concatenate([flat, np.ones(rest, np.uint8)]) if rest else flat).tobytes().replace(b"\xff", b"\xff\x00")


#: Bands of spectral selection of the packed files.
BANDS = ((1, 5), (6, 63))


def pack(payload: bytes) -> bytes:
    """A progressive JPEG file, chroma at half size both ways, whose coefficients are the bytes of ``payload``.

    A byte b is the coefficient b if b > 127, else b - 255 (b - 254 in the first place of a
    block): all have 8 bits of magnitude, so that all first scans give a code of one bit and 7
    bits, and one more bit comes in the refinement scans.
    """
    mcus = max(1, -(-len(payload) // 384))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    total = across * down
    values = np.zeros(total * 384, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = np.split(values.reshape(-1, 64), [4 * total, 5 * total])
    frame = b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    code = lambda kind, symbol: _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))
    out = [b"\xff\xd8", _segment(0xFE, b"bytes=%d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame)]
    out += [code(0x00, 7), code(0x10, 7), code(0x11, 0)]
    scan = lambda c, ac, first, last, steps: _segment(0xDA, bytes([1, c + 1, ac, first, last, steps]))
    out.append(_segment(0xDD, b"\x00\x01"))
    for c, x in enumerate(blocks):
        part = np.empty((len(x), 3), np.uint8)
        part[:, 0], part[:, 1], part[:, 2] = x[:, 0] >> 1, 0xFF, 0xD0 + np.arange(len(x)) % 8
        out += [scan(c, 0, 0, 0, 0x01), part.tobytes()[:-2]]
    out.append(_segment(0xDD, b"\x00\x00"))
    for band in BANDS:
        for c, x in enumerate(blocks):
            out += [scan(c, 0, *band, 0x01), (x[:, band[0] : band[1] + 1] >> 1).tobytes()]
    for c, x in enumerate(blocks):
        out += [scan(c, 0, 0, 0, 0x10), _stuffed(x[:, 0] & 1)]
    for c, x in enumerate(blocks):
        bits = np.zeros((len(x), 64), np.uint8)
        bits[:, 1:] = (x[:, 1:] & 1) ^ (x[:, 1:] < 128)
        out += [scan(c, 1, 1, 63, 0x10), _stuffed(bits)]
    out.append(b"\xff\xd9")
    return b"".join(out)


def unpack(image: Image) -> bytes:
    """The payload that ``pack`` stored."""
    size = next(int(n[6:]) for n in image.notes if n.startswith(b"bytes="))
    values = np.concatenate([p.blocks for p in image.parts])
    values = np.where(values > 0, values, values + 255)
    firsts = np.concatenate([p.blocks[:, 0] for p in image.parts])
    values[:, 0] = np.where(firsts > 0, firsts, firsts + 254)
    return values.astype(np.uint8).tobytes()[:size]
