"""Work per distinct word instead of per word, for batches of texts.

A batch's words are given codes by Arrow; what an operator needs of a word is computed once per
distinct word of the batch, or found in a bounded store, and gathered back by code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers are kept; what a batch needed isn't


@dataclass
class Coded:
    """The words of some texts: `words[codes[offsets[i] : offsets[i + 1]]]` are those of text i."""

    words: list[str]
    codes: np.ndarray
    offsets: np.ndarray


def coded(lists: pa.ListArray) -> Coded:
    found = lists.flatten().dictionary_encode()
    return Coded(
        found.dictionary.to_pylist(),
        found.indices.to_numpy(),
        np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)]),
    )


class Store(dict):
    """A bounded store of answers by word. A full store takes no more: those it saw first include
    the frequent words. After many misses it starts anew."""

    def __init__(self, size: int, longest: int = 64):
        super().__init__()
        self.size, self.longest, self.missed = size, longest, 0

    def all(self, words: list[str], solve: Callable[[list[str]], list]) -> list:
        """The answers of distinct words; `solve` is asked for those that aren't stored, and may
        answer None for what has none."""
        found = list(map(self.get, words))
        places = list(compress(range(len(words)), [x is None for x in found]))
        todo = [words[i] for i in places]
        new = solve(todo)
        for i, x in zip(places, new, strict=True):
            found[i] = x
        self.keep({w: x for w, x in zip(todo, new, strict=True) if x is not None})
        return found

    def keep(self, new: dict) -> None:
        if len(self) >= self.size:
            self.missed += len(new)
            if self.missed < 20 * self.size:
                return
            self.missed = 0
            self.clear()
        self.update((w, x) for w, x in new.items() if len(w) <= self.longest)


class Gathered:
    """Arrays per word, given as bytes, laid out in the order in which the words occur."""

    def __init__(self, arrays: list[bytes], dtype: np.dtype, codes: np.ndarray):
        size = np.dtype(dtype).itemsize
        lens = np.fromiter(map(len, arrays), np.int64, len(arrays)) // size
        starts = np.cumsum(lens) - lens
        flat = np.frombuffer(b"".join(arrays), dtype)
        #: end of each occurrence in `values`, and before the first
        self.ends = np.concatenate([[0], np.cumsum(lens[codes])])
        own = np.repeat(starts[codes] - self.ends[:-1], lens[codes])
        self.values = flat[np.arange(self.ends[-1]) + own]
