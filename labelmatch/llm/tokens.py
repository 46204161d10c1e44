"""Texts of Arrow batches as coded words: each distinct word of a block is looked at once."""

from __future__ import annotations

import ctypes
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded_blocks(batch: pa.RecordBatch, find: Callable[[str], list[str]], limit: int, text_at: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """``(start, stop, counts, codes, words)``: rows start to stop hold counts[i] words each, words[codes] in order.

    A block closes before it exceeds ``limit`` characters; a longer text is a block of its own. Null texts have no words.
    """
    texts = batch.column(text_at)
    at = 0
    while at < len(texts):
        places: defaultdict = defaultdict()
        places.default_factory = places.__len__  # a new word takes the next place
        start, size, codes, counts = at, 0, array("I"), []
        while at < len(texts):
            text = texts[at].as_py() or ""
            if at > start and size + len(text) > limit:
                break
            words = find(text)
            codes.extend(map(places.__getitem__, words))
            counts.append(len(words))
            size += len(text)
            at += 1
        yield start, at, np.array(counts, np.int64), np.frombuffer(codes, np.uint32), list(places)


def in_characters(batch: pa.RecordBatch, text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to ``limit`` bytes of text; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


#: Rows of a batch that an operator on texts works on at once.
BATCH_ROWS = 2000


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over slices of BATCH_ROWS rows, after which the worker, which Spark keeps for later tasks, gives the memory it no longer uses back to the machine."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, len(batch), BATCH_ROWS))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return through
