"""Count-min sketches of 64-bit keys, merged across tasks without a dense sketch ever travelling.

A task sends, for each block of counters that it touched, the 16-bit places of the counters it met once and of those it met
more often. Blocks are summed in a distributed pass, and one bit per counter (has it reached two?) returns to the scans: a bitmap
of a size bounded by ``MOST``. Estimates never fall short, so a key that occurs twice always passes ``repeated``. Beyond that size the bitmap
lets more keys through; users count those exactly, by a shuffle of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .store import dealt, map_arrow

#: Counters of a sketch row, at least and at most; rows of a sketch.
LEAST, MOST, ROWS = 1 << 18, 1 << 27, 2
#: Counters of a block.
BLOCK = 1 << 16
#: Counter hits that a task gathers before it sends them.
HELD = 1 << 22
COLUMNS = "block int, ones binary, twos binary"
FIELDS = [("block", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary())]


def width_for(keys: float) -> int:
    """Counters of a row for so many expected keys: about 16 each, within the bounds."""
    return 1 << int(np.ceil(np.log2(np.clip(16 * keys, LEAST, MOST))))


def counters(keys: np.ndarray, width: int) -> np.ndarray:
    """The counter of each key in each sketch row, rows end to end: (ROWS, keys)."""
    return np.stack([(tk.salted(keys, 11 + r) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(ROWS)])


class Gathered:
    """Counter hits of a task, given out as arrays of blocks (see COLUMNS)."""

    def __init__(self, width: int):
        self.width, self.met, self.held = width, [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Count each key once more; True if it is time to give out."""
        if len(keys):
            self.met.append(counters(keys, self.width).ravel())
            self.held += len(self.met[-1])
        return self.held >= HELD

    def blocks(self) -> list[pa.Array] | None:
        """The blocks so far, and start anew; None without any."""
        if not self.held:
            return None
        at = np.sort(np.concatenate(self.met))
        self.met, self.held = [], 0
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        often = np.diff(np.append(first, len(at))) > 1
        at = at[first]
        blocks, low = at // BLOCK, (at % BLOCK).astype(np.uint16)
        edge = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        ones, twos = [], []
        for a, b in zip(edge, [*edge[1:], len(at)], strict=True):
            ones.append(low[a:b][~often[a:b]].tobytes())
            twos.append(low[a:b][often[a:b]].tobytes())
        return [pa.array(blocks[edge].astype(np.int32)), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())]


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ones, twos) sorted by block -> (block, bitmap of the counters that reached two)."""
    schema = pa.schema([("block", pa.int32()), ("bitmap", pa.binary())])
    block, count = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        for b, ones, twos in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if b != block:
                if block is not None:
                    yield done()
                block, count = b, np.zeros(BLOCK, dtype=np.uint8)
            one, two = np.frombuffer(ones.as_buffer(), np.uint16), np.frombuffer(twos.as_buffer(), np.uint16)
            count[one] = np.minimum(count[one] + 1, 2)
            count[two] = 2
    if block is not None:
        yield done()


def repeated_bitmap(blocks: DataFrame, width: int, volume: int) -> bytes:
    """One bit per counter of the merged sketch of ``volume`` bytes of data: has it reached two? At most ROWS * MOST bits."""
    own = dealt(blocks.select("block", "ones", "twos"), "block", volume // 8).sortWithinPartitions("block")
    bitmap = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for block, part in map_arrow(own, _sum_blocks, "block int, bitmap binary").collect():
        bitmap[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    return bitmap.tobytes()


def repeated(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the merged sketch estimates at two or more."""
    width = len(bitmap) * 8 // ROWS
    c = counters(keys, width)
    return ((bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1).all(axis=0)
