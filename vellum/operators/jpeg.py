"""JPEG files of images in rows: a baseline encoder as an Arrow-batched kernel.

Blocks, coefficients and codes are arrays over a whole image. The Huffman codes follow a rule: a
symbol's length grows with its run and its size, which suits what quantised blocks hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The standard's example quantisation tables for luminance and chrominance, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)

_AT = np.arange(8)
_DCT = np.where(_AT[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _AT + 1) * _AT[:, None] * np.pi / 16))
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes and lengths by symbol, and the table's part of a file."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, out, many = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, [0] * 16
    last = lengths[order[0]]
    for s in order:
        out <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = out, last
        many[last - 1] += 1
        out += 1
    return code, size, bytes(many) + bytes(order)


_DC = _codes({s: 4 for s in range(12)})
_AC = _codes({0x00: 2, 0xF0: 8} | {run << 4 | size: min(16, 2 + run + size) for run in range(16) for size in range(1, 11)})


def _tables(quality: int) -> list[np.ndarray]:
    q = max(1, min(100, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.array(CHROMA).reshape(4, 4)
    return [np.clip((np.asarray(t).reshape(64) * scale + 50) // 100, 1, 255) for t in (LUMA, chroma)]


def _blocks(plane: np.ndarray) -> np.ndarray:
    """8 x 8 blocks in reading order; the last row and column are repeated to fill them."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each value, and the value as that many bits (negative ones as complements)."""
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def jpeg_bytes(bgr: np.ndarray, quality: int) -> bytes:
    """A baseline JPEG file of an image (height, width, 3), blue first; quality from 0 to 100, clamped."""
    b, g, r = np.moveaxis(bgr.astype(np.float64), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = y - 128, (b - y) / 1.772, (r - y) / 1.402
    tables = _tables(quality)
    coefficients = [np.rint(_DCT @ _blocks(p) @ _DCT.T / tables[min(c, 1)].reshape(8, 8)).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG] for c, p in enumerate(planes)]
    every = np.stack(coefficients, axis=1)  # (block, component, coefficient)
    first = np.diff(every[:, :, 0], axis=0, prepend=0).ravel()
    rest = every.reshape(-1, 64)
    block, column = np.nonzero(rest[:, 1:])
    column += 1
    gap = column - np.where(np.diff(block, prepend=-1) != 0, 0, np.concatenate([[0], column[:-1]])) - 1
    size, bits = _magnitude(np.clip(rest[block, column], -1023, 1023))
    symbol = (gap % 16) << 4 | size
    zeros = np.repeat(np.arange(len(block)), gap // 16)  # runs of sixteen before a value
    ended = np.flatnonzero(rest[:, 63] == 0)
    dc_size, dc_bits = _magnitude(np.clip(first, -2047, 2047))

    n = np.arange(len(rest))
    place = np.concatenate([n * 200, block[zeros] * 200 + 3 * column[zeros] - 1, block * 200 + 3 * column, ended * 200 + 199])
    code = np.concatenate([_DC[0][dc_size] << dc_size | dc_bits, np.full(len(zeros), _AC[0][0xF0]), _AC[0][symbol] << size | bits, np.full(len(ended), _AC[0][0])])
    length = np.concatenate([_DC[1][dc_size] + dc_size, np.full(len(zeros), _AC[1][0xF0]), _AC[1][symbol] + size, np.full(len(ended), _AC[1][0])])
    order = np.argsort(place, kind="stable")
    code, length = code[order].astype(np.uint32), length[order]
    spread = np.unpackbits((code << (32 - length).astype(np.uint32)).astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    stream = spread[np.arange(32) < length[:, None]]
    stream = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    out += b"".join(part(0xDB, bytes([i]) + bytes(t[_ZIGZAG].astype(np.uint8))) for i, t in enumerate(tables))
    out += part(0xC0, struct.pack(">BHHB", 8, bgr.shape[0], bgr.shape[1], 3) + b"\x01\x11\x00\x02\x11\x01\x03\x11\x01")
    out += part(0xC4, b"\x00" + _DC[2]) + part(0xC4, b"\x10" + _AC[2]) + part(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return out + stream + b"\xff\xd9"


def jpeg_files(images: DataFrame, id_col: str, quality: int) -> DataFrame:
    """``id, jpeg`` of ``id, width, height, data`` (BGR bytes); null where the data aren't an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, data in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("data").to_pylist(), strict=True):
                fits = data is not None and w and h and len(data) == 3 * w * h and max(w, h) < 65536
                out.append(jpeg_bytes(np.frombuffer(data, np.uint8).reshape(h, w, 3), quality) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], names=[id_col, "jpeg"])

    return images.select(id_col, "width", "height", "data").mapInArrow(run, f"{id_col} long, jpeg binary")
