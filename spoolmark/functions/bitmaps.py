"""Compressed bitmaps over dense integer keys.

A key id splits into a range (one Spark bitmap bucket of 32,768 ids) and a bit
inside it.  Spark's ``bitmap_construct_agg`` builds the 4 KiB bitmaps with
map-side combining; ``pack`` deflates them before they are shuffled or joined,
and ``and_not_bits`` decodes the bits that survive ``a AND NOT b``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

RANGE_BITS = 32_768


def key_range(kid: Column) -> Column:
    return F.bitmap_bucket_number(kid + 1)


def key_bit(kid: Column) -> Column:
    return F.bitmap_bit_position(kid + 1)


def key_id(key_range: Column, bit: Column) -> Column:
    return (key_range - 1) * RANGE_BITS + bit


@F.pandas_udf(T.BinaryType())
def pack(bitmaps: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in bitmaps:
        yield batch.map(lambda b: None if b is None else zlib.compress(bytes(b), 1))


def unpack(packed: bytes) -> np.ndarray:
    """The bytes of a packed bitmap."""
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def set_bits(bits: np.ndarray) -> np.ndarray:
    """Places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(bits, bitorder="little"))
