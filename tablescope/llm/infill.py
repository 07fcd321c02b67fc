"""Fill-in-middle: a learned rank index gives the place of every token boundary, cuts are looked up in it.

The boundaries of a text are a rising sequence of byte offsets.  Line segments
are fitted to all of them so that no segment is off by more than ``ERROR``
bytes; what a segment misses at each boundary is stored in one byte.  The offset
of boundary k is the prediction of k's segment plus that residual: exact, and
found without going through the tokens before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.text import NOT_SPACE, buffers, extend

ERROR = 100  # bytes that a segment may be off; residuals fit into one byte
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundaries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All token boundaries of the texts ``data[bounds[d] : bounds[d + 1]]`` and the first one of each text.

    A token is white space and the word behind it, or the white space at the end;
    a text of n tokens has n + 1 boundaries, its start and its end among them.
    """
    inside = NOT_SPACE[data]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    full = bounds[1:][bounds[1:] > bounds[:-1]]
    ends[full - 1] = True  # a word or white space ends with its text
    found = np.flatnonzero(ends) + 1
    counts = np.searchsorted(found, bounds[1:], "right") - np.searchsorted(found, bounds[:-1], "right")
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    at = np.empty(first[-1], np.int64)
    starts = np.zeros(first[-1], bool)
    starts[first[:-1]] = True
    at[starts], at[~starts] = bounds[:-1], found
    return at, first


class RankIndex:
    """Piecewise linear, error-bounded model of boundary offsets by rank, with residuals that make it exact."""

    def __init__(self, at: np.ndarray, first: np.ndarray, error: int = ERROR):
        if not 0 <= error <= 127:
            raise ValueError("error must be in 0..127")
        self.residual = np.zeros(len(at), np.int8)
        low, high = first[:-1], first[1:] - 1  # a segment leads from boundary low to boundary high, high excluded
        done = []
        while len(low):
            size = np.maximum(high - low, 1)
            owner = np.repeat(np.arange(len(low)), size)
            begin = np.cumsum(size) - size
            rank = np.arange(len(owner)) - begin[owner]
            rise = at[high] - at[low]
            missed = at[low[owner] + rank] - at[low[owner]] - rise[owner] * rank // size[owner]
            fits = np.maximum.reduceat(np.abs(missed), begin) <= error
            good = fits[owner]
            self.residual[(low[owner] + rank)[good]] = missed[good]
            done.append(np.stack([low[fits], at[low[fits]], rise[fits], size[fits]]))
            low, high = low[~fits], high[~fits]
            half = (low + high) // 2
            low, high = np.concatenate([low, half]), np.concatenate([half, high])
        done.append(np.stack([first[1:] - 1, at[first[1:] - 1], np.zeros(len(first) - 1, np.int64), np.ones(len(first) - 1, np.int64)]))
        every = np.concatenate(done, axis=1)
        # the end of a text of no tokens is its start: the later segment, of length one, takes both
        self.low, self.base, self.rise, self.size = every[:, np.argsort(every[0], kind="stable")]

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of the boundaries with these numbers."""
        k = np.searchsorted(self.low, ranks, "right") - 1
        return self.base[k] + self.rise[k] * (ranks - self.low[k]) // self.size[k] + self.residual[ranks]


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers that depend on the key and the seed only."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 42,
    percent: int = 50,
    percent_spm: int = 80,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with the text cut and put together for infilling.

    Two boundaries, drawn by seed and key, cut a text into prefix, middle and
    suffix.  ``percent`` of the keys are transformed; of those ``percent_spm``
    become suffix, prefix, middle and the rest prefix, suffix, middle.  Adds
    ``n`` (tokens), ``form`` (plain, psm or spm), ``output``, ``prefix_chars`` and
    ``middle_chars`` (code points; null if plain).

    Null and empty texts and those that hold a marker already stay plain (a null
    gives an empty output).  A null key counts as an empty one.  Repeated rows are
    treated alike; an empty table gives no rows; input columns with the names of
    results are replaced.
    """
    kinds = [("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType())]
    fields = [T.StructField(n, t) for n, t in [*kinds, ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def make():
        def work(texts, keys):
            data, bounds = buffers(texts)
            at, first = boundaries(data, bounds)
            index = RankIndex(at, first)
            n = np.diff(first) - 1
            drawn = np.array([draws(k, seed) for k in keys.to_pylist()], np.int64).reshape(-1, 4)
            one, two = (first[:-1] + drawn[:, c] % (n + 1) for c in (0, 1))
            head, tail = index.offsets(np.minimum(one, two)), index.offsets(np.maximum(one, two))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            raw = data.tobytes()
            forms, out = [], []
            for d, (a, b, c, e) in enumerate(zip(bounds[:-1].tolist(), head.tolist(), tail.tolist(), bounds[1:].tolist())):
                whole = raw[a:e]
                if not whole or drawn[d, 2] % 100 >= percent or any(m in whole for m in marks):
                    forms.append("plain")
                    out.append(whole)
                elif drawn[d, 3] % 100 < percent_spm:
                    forms.append("spm")
                    out.append(marks[1] + raw[c:e] + marks[0] + raw[a:b] + marks[2] + raw[b:c])
                else:
                    forms.append("psm")
                    out.append(marks[0] + raw[a:b] + marks[1] + raw[c:e] + marks[2] + raw[b:c])
            plain = np.array([f == "plain" for f in forms], bool)
            return [
                pa.array(n, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(out, pa.binary()).cast(pa.string()),
                pa.array(chars[head] - chars[bounds[:-1]], pa.int64(), mask=plain),
                pa.array(chars[tail] - chars[head], pa.int64(), mask=plain),
            ]

        return work

    return extend(docs, text, fields, make, keep, also=[key])


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, put together again."""

    def between(start: str, end: str | None) -> Column:
        rest = F.split_part(output, F.lit(start), F.lit(2))
        return rest if end is None else F.split_part(rest, F.lit(end), F.lit(1))

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
