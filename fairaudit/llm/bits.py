"""Sets of 64-bit fingerprints as bit tables of bounded size.

Two bits stand for each fingerprint. A table never misses one that it was made of;
it lets others through, about one in 250 while it has ``BITS_EACH`` bits for each
and more beyond ``BITS_MOST`` bits. So it may only save work, never decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_EACH = 32               # for each fingerprint
BITS_MOST = 1 << 29          # 64 MB, however many there are
BLOCK_BITS = 1 << 16

_U = np.uint64


def _bit_places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U(bits - 1)
    return prints & mask, (prints >> _U(32)) & mask


def may_hold(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints the bit table may hold."""
    out = np.ones(len(prints), bool)
    for at in _bit_places(prints, len(table) * 8):
        out &= (table[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
    return out


def bit_table(prints: DataFrame) -> np.ndarray:
    """Bits of a staged table of distinct fingerprints. ``BITS_EACH`` bits for each,
    up to ``BITS_MOST``: beyond that it lets more through and still loses none."""
    n = prints.count()
    bits = min(BITS_MOST, max(BLOCK_BITS, 1 << (n * BITS_EACH - 1).bit_length() if n else 0))
    low, high = F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1))
    places = (prints.select(F.explode(F.array(low, high)).alias("at"))
              .select(F.floor(F.col("at") / BLOCK_BITS).cast("int").alias("block"), (F.col("at") % BLOCK_BITS).cast("int").alias("bit")))

    def block(part):
        import pandas as pd
        held = np.zeros(BLOCK_BITS, np.uint8)
        held[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": part["block"].iloc[:1], "bits": [np.packbits(held, bitorder="little").tobytes()]})
    table = np.zeros(bits // 8, np.uint8)
    size = BLOCK_BITS // 8
    for r in places.groupBy("block").applyInPandas(block, "block int, bits binary").collect():      # ``BITS_MOST`` at most
        table[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table
