"""Media columns: texts as baseline JPEG files, read back block by block.

Writing: the UTF-8 bytes of a text, padded with bytes 0 up to a positive multiple of 64, become
the samples of a greyscale picture of blocks, 64 to a line. A block is 8 x 8 pixels of one sample.
Its quantised DC coefficient is sample - 128 at a quantiser of 8, all its AC coefficients are 0, so
a decoder's DC-only luminance picture has exactly these samples. Each line of blocks is a restart
interval. A picture ends at 8,191 lines (the format's limit); longer payloads go on in further
files behind it, as in motion JPEG.

Reading: markers are parsed from SOI to EOI (DQT, SOF0, DHT, DRI, SOS, RSTn; unknown segments are
skipped by length), and the scan is Huffman-decoded with the tables of the file: all restart
intervals of a batch side by side, one code per step in numpy. DC values give the luminance
thumbnail; AC codes are read over. Other than 8-bit one-component baseline files raise an error
here: the reader is for files of this column.

The feature is <width>x<height>:<hash>, the pixels of all pictures and a difference hash of 8 x 8
bits over the mean-pooled thumbnail (sampled lines and columns if it is smaller than that).

Defined results: a null or empty text is 64 bytes 0; equal texts give equal files and values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridwright.llm.common import arrow_map, documents, id_and_text, text_passes

LINE = 64
MOST_LINES = 8191
#: Huffman code lengths of this column: DC categories 0 to 8 (differences of bytes), end of block.
DC_COUNTS = [0, 1, 2, 3, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [5, 6, 4, 3, 7, 0, 2, 1, 8]
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


class Table:
    """A Huffman table: codes by symbol, and (length, symbol) by the next 16 bits."""

    def __init__(self, counts, symbols):
        self.length = np.zeros(65536, np.uint8)
        self.symbol = np.zeros(65536, np.uint8)
        self.code = np.zeros(256, np.int64)
        self.bits = np.zeros(256, np.int64)
        code, at = 0, 0
        for size, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                span = slice(code << (16 - size), (code + 1) << (16 - size))
                self.length[span], self.symbol[span] = size, symbol
                self.code[symbol], self.bits[symbol] = code, size
                code += 1
            at += n
            code <<= 1


@lru_cache(maxsize=8)
def table(counts: bytes, symbols: bytes) -> Table:
    return Table(list(counts), list(symbols))


def _category(value: np.ndarray) -> np.ndarray:
    """Bits of the magnitude, up to 11 as baseline DC allows."""
    return np.searchsorted(1 << np.arange(12), np.abs(value), side="right")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def header(lines: int) -> bytes:
    """Everything before the scan's data."""
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8]) * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, lines * 8, LINE * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", LINE)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def scan_lines(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded lines of 64 samples each, with byte stuffing: (bytes, line offsets)."""
    dc = table(bytes(DC_COUNTS), bytes(DC_SYMBOLS))
    value = samples.reshape(-1, LINE).astype(np.int64) - 128
    change = np.diff(value, axis=1, prepend=0).ravel()
    size = _category(change)
    extra = np.where(change < 0, change + (1 << size) - 1, change)
    # DC code, magnitude bits and the end-of-block code 0 in one word of up to 16 bits.
    word = ((dc.code[size] << size | extra) << 1).astype(np.uint64)
    width = dc.bits[size] + size + 1
    line_bits = width.reshape(-1, LINE).sum(axis=1)
    line_bytes = (line_bits + 7) // 8
    start = np.concatenate(([0], np.cumsum(line_bytes)))
    within = np.cumsum(width.reshape(-1, LINE), axis=1) - width.reshape(-1, LINE)
    at = (within + start[:-1, None] * 8).ravel()
    # Each word touches at most three bytes; no bit is set twice, so sums are unions.
    shifted = word << (24 - width - (at & 7)).astype(np.uint64)
    place = at >> 3
    out = np.zeros(start[-1] + 3, np.int64)
    for k in range(3):
        part = ((shifted >> np.uint64(16 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(place + k, weights=part, minlength=len(out)).astype(np.int64)
    pad = line_bytes * 8 - line_bits
    out[start[1:] - 1] |= (1 << pad) - 1
    out = out[: start[-1]].astype(np.uint8)
    full = np.flatnonzero(out == 0xFF)
    stuffed = np.insert(out, full + 1, 0)
    return stuffed, start + np.searchsorted(full, start)


def files(payloads: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The stored form of each payload; ``sizes`` are multiples of 64."""
    data, at = scan_lines(payloads)
    raw, out, line = data.tobytes(), [], 0
    for count in (sizes // LINE).tolist():
        parts = []
        for first in range(0, count, MOST_LINES):
            lines = min(MOST_LINES, count - first)
            parts.append(header(lines))
            for i in range(lines):
                a = line + first + i
                parts.append(raw[at[a] : at[a + 1]])
                parts.append(_RESTART[i & 7] if i < lines - 1 else b"\xff\xd9")
        out.append(b"".join(parts))
        line += count
    return out


_RESTART = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def parse(file: bytes) -> Iterator[dict]:
    """The pictures of a stored form: sizes, tables and the place of the scan's data."""
    at = 0
    while at < len(file):
        if file[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        found: dict = {"tables": {}, "quant": {}, "restart": 0}
        while True:
            marker, length = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
            body = file[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide, which = body[0] >> 4, body[0] & 15
                    found["quant"][which] = struct.unpack_from(">H" if wide else "B", body, 1)[0]
                    body = body[129 if wide else 65 :]
            elif marker == 0xC0:
                bits, rows, columns, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1:
                    raise ValueError("not an 8-bit picture of one component")
                found |= {"rows": rows, "columns": columns, "q": body[8]}
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
                raise ValueError("not a baseline picture")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    found["tables"][body[0]] = table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                found["restart"] = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                found |= {"dc": found["tables"][body[2] >> 4],
                          "ac": found["tables"][0x10 | body[2] & 15], "data": at}
                break
        end = file.index(b"\xff\xd9", at)
        yield found | {"end": end}
        at = end + 2


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails of all pictures of each file."""
    pictures, owner = [], []
    for i, file in enumerate(stored):
        for found in parse(file):
            pictures.append(found | {"file": file})
            owner.append(i)
    out: list[list[np.ndarray]] = [[] for _ in stored]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        groups.setdefault((id(p["dc"]), id(p["ac"])), []).append(i)
    grids: dict[int, np.ndarray] = {}
    for members in groups.values():
        grids.update(_decode([pictures[i] for i in members], members))
    for i, who in enumerate(owner):
        out[who].append(grids[i])
    return out


def _decode(pictures: list[dict], names: list[int]) -> dict[int, np.ndarray]:
    """Huffman-decode the scans of pictures with the same tables, restart intervals in step."""
    data = np.frombuffer(b"".join(p["file"][p["data"] : p["end"]] for p in pictures), np.uint8)
    ends = np.cumsum([p["end"] - p["data"] for p in pictures])
    grid = [((p["rows"] + 7) // 8, (p["columns"] + 7) // 8) for p in pictures]
    blocks = np.array([r * c for r, c in grid])
    step = np.array([p["restart"] for p in pictures])
    step = np.where(step == 0, blocks, step)
    lanes = -(-blocks // step)
    # Restart markers end a lane; a stuffed 0 behind 0xFF goes.
    escape = np.flatnonzero(data[:-1] == 0xFF)
    follow = data[escape + 1]
    drop = np.zeros(len(data), bool)
    drop[escape[follow == 0] + 1] = True
    restart = escape[(follow >= 0xD0) & (follow <= 0xD7)]
    drop[restart] = drop[restart + 1] = True
    moved = np.concatenate(([0], np.cumsum(~drop)))
    starts = np.sort(np.concatenate((moved[np.concatenate(([0], ends[:-1]))], moved[restart])))
    if len(starts) != lanes.sum():
        raise ValueError("restart markers do not fit the picture's size")
    plain = np.concatenate((data[~drop], np.full(8, 0xFF, np.uint8)))
    # Codes and magnitudes have 16 bits at most and start inside a byte: 24 bits at each byte do.
    word = plain[:-2].astype(np.uint32) << np.uint32(8)
    word = ((word | plain[1:-1]) << np.uint32(8) | plain[2:]).astype(np.int64)
    last = len(word) - 1
    at = starts.astype(np.int64) * 8
    left = np.repeat(step, lanes)
    done_before = np.arange(len(left)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(left, np.repeat(blocks, lanes) - done_before * np.repeat(step, lanes))
    dc, ac = pictures[0]["dc"], pictures[0]["ac"]
    most = int(left.max())
    values = np.zeros((most, len(left)), np.int64)
    value = np.zeros(len(left), np.int64)

    def peek(bit: np.ndarray) -> np.ndarray:
        return (word[np.minimum(bit >> 3, last)] >> (8 - (bit & 7))) & 0xFFFF

    for block in range(most):
        live = np.flatnonzero(left > block)
        every = len(live) == len(left)
        bit = at if every else at[live]
        head = peek(bit)
        size = dc.symbol[head].astype(np.int64)
        bit = bit + dc.length[head]
        extra = peek(bit) >> (16 - size)
        bit = bit + size
        change = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        if every:
            value = value + change
            values[block] = value
        else:
            value[live] += change
            values[block, live] = value[live]
        # AC codes up to the end of the block.
        place = np.ones(len(bit), np.int64)
        going = np.arange(len(bit))
        while len(going):
            head = peek(bit[going])
            code = ac.symbol[head]
            bit[going] += ac.length[head].astype(np.int64) + (code & 15)
            place[going] += np.where(code == 0, 64, (code >> 4) + 1)
            going = going[place[going] < 64]
        if every:
            at = bit
        else:
            at[live] = bit
    out, lane = {}, 0
    for name, p, (rows, columns), n in zip(names, pictures, grid, lanes.tolist(), strict=True):
        own = values[:, lane : lane + n].T.reshape(-1)
        if n > 1 and rows * columns != len(own):
            own = np.concatenate([values[: left[i], i] for i in range(lane, lane + n)])
        own = own[: rows * columns]
        pixels = own * p["quant"][p["q"]] // 8 + 128
        out[name] = np.clip(pixels, 0, 255).astype(np.uint8).reshape(rows, columns)
        lane += n
    return out


def difference_hash(picture: np.ndarray) -> str:
    """64 bits: whether the mean of a cell is below that of the cell to its right."""
    rows, columns = picture.shape
    y = np.arange(9) * rows // 8
    x = np.arange(10) * columns // 9
    total = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(picture, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    y0, y1 = y[:-1], np.maximum(y[1:], y[:-1] + 1)
    x0, x1 = x[:-1], np.maximum(x[1:], x[:-1] + 1)
    mass = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    mean = mass / np.outer(y1 - y0, x1 - x0)
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def with_media(docs: DataFrame, keep_file: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, width, height[, media]); everything but n_bytes is read back from the file."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, at in text_passes(batch):
            sizes = np.diff(at)
            padded = np.maximum(-(-sizes // LINE), 1) * LINE
            place = np.concatenate(([0], np.cumsum(padded)))
            payload = np.zeros(place[-1], np.uint8)
            payload[np.arange(len(raw)) + np.repeat(place[:-1] - at[:-1], sizes)] = raw
            stored = files(payload, padded)
            columns: dict[str, list] = {n: [] for n in (
                "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                "feature", "width", "height")}
            for file, pictures in zip(stored, thumbnails(stored), strict=True):
                back = b"".join(p.tobytes() for p in pictures)
                whole = np.vstack(pictures) if len(pictures) > 1 else pictures[0]
                height, width = whole.shape[0] * 8, whole.shape[1] * 8
                for name, value in zip(columns, (
                    len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
                    len(file), hashlib.sha256(file).hexdigest(),
                    f"{width}x{height}:{difference_hash(whole)}", width, height), strict=True):
                    columns[name].append(value)
            out = {"doc_id": batch.column(0)[first:last], "n_bytes": pa.array(sizes)}
            out |= {
                n: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64())
                for n, v in columns.items()
            }
            if keep_file:
                out["media"] = pa.array(stored, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, width long, height long"
    )
    return arrow_map(
        docs.select("doc_id", "text"), work, schema + (", media binary" if keep_file else "")
    )


def query(spark, folder: str) -> DataFrame:
    return with_media(id_and_text(documents(spark, folder)), keep_file=False)
