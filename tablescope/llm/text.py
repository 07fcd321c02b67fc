"""Shared helpers: words and hashes of whole Arrow batches, and passing columns through Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPAN = 1 << 16  # bytes that are widened to 64-bit numbers at a time
LONG_WORD = 1 << 14  # longer words are hashed one by one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Bytes of words that end at ASCII white space only.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_CODE = numbers(256, 1)
FACTOR = 0x5851F42D4C957F2D
PLACE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SPAN, FACTOR, dtype=np.uint64))])
BACK = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SPAN, pow(FACTOR, -1, 1 << 64), dtype=np.uint64))])  # inverses of PLACE


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def parts(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each; a longer text is a range of its own."""
    _, ends = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Words:
    """The words of some texts: ``doc``, ``start`` and ``end`` (bytes in ``data``), ``first`` word of each text."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        raw, ends = buffers(texts)
        self.data, self.bounds = LOWERED[raw], ends
        inside = kind[self.data]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = ends[1:] > ends[:-1]
        for marks, places in ((begin, ends[:-1][full]), (last, ends[1:][full] - 1)):
            marks[places] = inside[places]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, ends)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of its first ``longest`` bytes."""
        size = self.end - self.start
        if longest is not None:
            size = np.minimum(size, longest)
        out = np.zeros(len(size), np.uint64)
        n = np.minimum(size, LONG_WORD)
        at = 0
        while at < len(size):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SPAN, "right")))
            begin, stop = self.start[at:to] - low, self.start[at:to] - low + n[at:to]
            # differences of one running sum over all letters, taken back to the word's first place
            sums = np.zeros(stop[-1] + 1, np.uint64)
            np.cumsum(BYTE_CODE.take(self.data[low : low + stop[-1]]) * PLACE[: stop[-1]], out=sums[1:])
            out[at:to] = (sums[stop] - sums[begin]) * BACK[begin]
            at = to
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.start[i] + size[i]].tobytes())
        return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def runs(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the hash of every n words in a row within one text."""
        at = np.arange(max(len(hashes) - n + 1, 0))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[at + k]
        return at, mix(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def lowered(text: Column | str) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` except those that ``names`` would clash with."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def give_back() -> None:
    """Hand freed memory to the system, which Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; when it is over, its worker keeps nothing.

    A Python worker outlives its task, and an executor has more idle workers than
    cores if earlier plans had several such steps in one stage.
    """

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def extend(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable,
    keep: Sequence[str] | None = None,
    also: Sequence[str] = (),
    limit: int = 4 << 20,
    done: Callable | None = None,
) -> DataFrame:
    """Add ``fields`` computed from the text column, about ``limit`` bytes of text at a time.

    ``make()`` runs once per task and returns a function from the Arrow array of
    texts (and those of the columns ``also``) to the new arrays; ``done()`` runs
    at the task's end.  ``keep`` names
    the input columns to return (all by default); those that clash with a new
    name are replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in without(df, names) if keep is None or c in keep]
    extra = [col(c).alias(f"__llm_{i}") for i, c in enumerate(also)]
    source = df.select(*[col(c) for c in keep], *extra, col(text).cast("string").alias("__llm_text"))
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    n = len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            for at, to in parts(batch.columns[-1], limit):
                part = batch.slice(at, to - at)
                new = work(part.columns[-1], *part.columns[n:-1])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=schema.fieldNames())
        if done is not None:
            done()

    return source.mapInArrow(tidy(run), schema)
