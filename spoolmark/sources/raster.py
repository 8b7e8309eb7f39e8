"""Small images and documents as bytes: PNG read and written, ink grids, and the pages of a PDF.

Images are grey of 8 bits, read from grey or RGB(A) of 8 bits without
interlacing.  Defined results: bytes of another format or cut short give a
null grid or count and never an error; an ink grid holds the mean darkness of
its cells, 1 for black and 0 from grey 245 up, rows from the top.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

GRID_WIDTH, GRID_HEIGHT = 48, 34
#: Fixed value: grey from which a pixel holds no ink.
PAPER = 245
_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(grey: np.ndarray) -> bytes:
    """A grey image, rows from the top."""
    height, width = grey.shape
    rows = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in grey)
    return _HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.int64)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(stride):
                left = line[x - step] if x >= step else 0
                up, corner = above[x], above[x - step] if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    return out


def read_png(data: bytes) -> np.ndarray | None:
    """Grey values, rows from the top; none for bytes that are no such image."""
    try:
        if data[:8] != _HEAD:
            return None
        at, body, head = 8, b"", None
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            elif kind == b"IDAT":
                body += data[at + 8 : at + 8 + size]
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if depth != 8 or interlaced or step is None or not width or not height:
            return None
        pixels = _unfiltered(zlib.decompress(body), height, width * step, step).reshape(height, width, step)
        return pixels[:, :, :3].mean(axis=2) if step >= 3 else pixels[:, :, 0].astype(float)
    except (struct.error, zlib.error, TypeError, ValueError, IndexError):
        return None


def ink(grey: np.ndarray, width: int = GRID_WIDTH, height: int = GRID_HEIGHT) -> np.ndarray:
    """Mean darkness of each cell of a grid over the image."""
    dark = np.clip((PAPER - grey) / PAPER, 0, 1)
    ys = np.minimum(np.arange(grey.shape[0]) * height // grey.shape[0], height - 1)
    xs = np.minimum(np.arange(grey.shape[1]) * width // grey.shape[1], width - 1)
    cell = (ys[:, None] * width + xs[None, :]).ravel()
    total, n = np.bincount(cell, dark.ravel(), width * height), np.bincount(cell, minlength=width * height)
    return total / np.maximum(n, 1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ink_grid(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in images:
        yield pd.Series([None if b is None or (g := read_png(bytes(b))) is None else ink(g).tolist() for b in batch], dtype=object)


@F.pandas_udf(T.BinaryType())
def board(grids: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two ink grids beside each other as an image, a white column between them."""
    for left, right in grids:
        out = []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            both = [255 - np.asarray(g, float).reshape(GRID_HEIGHT, GRID_WIDTH) * 255 for g in (a, b)]
            out.append(write_png(np.round(np.hstack([both[0], np.full((GRID_HEIGHT, 1), 255.0), both[1]]))))
        yield pd.Series(out, dtype=object)


@F.pandas_udf(T.IntegerType())
def pdf_pages(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Page objects of a PDF; null for bytes of another format."""
    for batch in files:
        yield pd.Series([None if b is None or not bytes(b).startswith(b"%PDF-") else len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", bytes(b))) for b in batch], dtype="Int32")
