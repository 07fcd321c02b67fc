"""Periodic runs of words, found with a run-length grammar built by recompression.

Block compression gives a name to every stretch of equal symbols, pair
compression splits the alphabet in two and names every pair that leads from the
first half to the second; both alternate until one symbol is left.  What is
parsed together depends on neighbouring symbols only, so equal stretches of words
are parsed alike, and the longest common extension of two places is found by
climbing the levels while the symbols agree and descending where they differ.

A run of period q holds some multiple i of q together with i + q.  These pairs,
n / q for each q, are the candidates; extending them to both sides gives the
runs.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tablescope.llm.text import buffers, extend, mix

LEAST = 12  # words of the shortest run
MANY = 1 << 20  # candidates that are examined at a time
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class Level(NamedTuple):
    """Symbols of one level and how the next level groups them."""

    symbols: np.ndarray
    head: np.ndarray  # whether the symbol is the first of its group
    group: np.ndarray
    rest: np.ndarray  # symbols up to the end of the group, this one included
    first: np.ndarray  # the first symbol of each group
    block: bool  # groups are blocks of equal symbols rather than pairs

    def mirrored(self) -> Level:
        last = self.first + self.rest[self.first] - 1
        size = self.rest[self.first][self.group]
        tail = self.rest == 1
        return Level(
            self.symbols[::-1],
            tail[::-1],
            len(self.first) - 1 - self.group[::-1],
            (size - self.rest + 1)[::-1],
            len(self.symbols) - 1 - last[::-1],
            self.block,
        )


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar of a sequence, alternating block and pair compression."""
    levels: list[Level] = []
    fresh = int(symbols.max(initial=0)) + 1
    turn = 0
    while len(symbols) > 1:
        for block in (True, False):
            if block:
                glued = symbols[1:] == symbols[:-1]
            else:
                turn += 1
                left = (mix(symbols.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
                glued = left[:-1] & ~left[1:]
            if not glued.any():
                continue
            head = np.concatenate([[True], ~glued])
            first = np.flatnonzero(head)
            size = np.diff(first, append=len(symbols))
            group = np.cumsum(head) - 1
            rest = first[group] + size[group] - np.arange(len(symbols))
            levels.append(Level(symbols, head, group, rest, first, block))
            many = np.flatnonzero(size > 1)
            second = size[many] if block else symbols[first[many] + 1]
            names, which = np.unique(symbols[first[many]] * np.int64(max(fresh, len(symbols) + 1)) + second, return_inverse=True)
            symbols = symbols[first]
            symbols[many] = fresh + which
            fresh += len(names)
    return levels


def common_extension(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i on equal those from j on; i and j differ, and the sequence ends in a unique symbol."""
    x, y, top = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k, level in enumerate(levels):  # up, as far as everything agrees
        a, b = x[live], y[live]
        same = level.symbols[a] == level.symbols[b]
        top[live[~same]] = k
        live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
        inside = ~(level.head[a] & level.head[b])
        if level.block:  # the rest of a block is skipped at once; unequal rests end the extension
            step = np.where(inside, np.minimum(level.rest[a], level.rest[b]), 0)
            ended = inside & (level.rest[a] != level.rest[b])
        else:
            step, ended = inside.astype(np.int64), np.zeros(len(live), bool)
        a, b = a + step, b + step
        out = live[ended]
        x[out], y[out], top[out] = a[ended], b[ended], k
        live = live[~ended]
        x[live], y[live] = level.group[a[~ended]], level.group[b[~ended]]
    for k in range(int(top.max(initial=0)), 0, -1):  # down, into the symbols that differ
        level, at = levels[k - 1], np.flatnonzero(top >= k)
        a, b = level.first[x[at]], level.first[y[at]]
        same = level.symbols[a] == level.symbols[b]
        step = same * (np.minimum(level.rest[a], level.rest[b]) if level.block else 1)
        x[at], y[at] = a + step, b + step
    return x - i


def candidates(words: np.ndarray, longest: int):
    """``i, q``: equal words i and i + q, i a multiple of q, with equal neighbours on one side; q up to ``longest``."""
    n = len(words)
    q0 = 1
    while q0 <= longest:
        q1, total = q0, 0  # as many periods as make MANY pairs, one at least
        sizes = []
        while q1 <= longest and (not sizes or total + (n - 1) // q1 <= MANY):
            sizes.append((n - 1) // q1)
            total += sizes[-1]
            q1 += 1
        size = np.array(sizes, np.int64)
        begin = np.cumsum(size) - size
        for lo in range(0, total, MANY):
            flat = np.arange(lo, min(lo + MANY, total))
            which = np.searchsorted(begin, flat, "right") - 1
            q = which + q0
            i = (flat - begin[which]) * q
            keep = words[i] == words[i + q]
            i, q = i[keep], q[keep]
            keep = words[i + 1] == words[i + q + 1]
            keep |= words[i - 1] == words[i + q - 1]
            yield i[keep], q[keep]
        q0 = q1


def runs_of(words: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the runs with periods up to ``longest``, by start and period.

    ``words`` begins and ends with a word that occurs once, and so do runs that
    must not be crossed.
    """
    found = [np.zeros((3, 0), np.int64)]
    levels: list[Level] = []
    for i, q in candidates(words, longest):
        if not len(i):
            continue
        if not levels:
            levels = recompress(words)
            mirrored = [level.mirrored() for level in levels]
        after = common_extension(levels, i, i + q)
        before = common_extension(mirrored, len(words) - i, len(words) - i - q)
        length = before + q + after
        good = length >= np.maximum(least, 2 * q)
        every = np.stack([i[good] - before[good], length[good], q[good]])
        found.append(np.unique(every, axis=1))
    start, length, period = np.concatenate(found, axis=1)
    # a multiple of the period gives the same stretch: only the smallest period counts
    order = np.lexsort([period, length, start])
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def runs_in(texts: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The text number and (start, length, period) of all runs, texts in order.

    Texts of similar length are examined together, a unique word between them.
    """
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    classes: defaultdict[int, list[int]] = defaultdict(list)
    for d, words in enumerate(texts):
        if len(words) >= least:
            classes[len(words).bit_length()].append(d)
    owners, found = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)]
    for members in classes.values():
        sizes = np.array([len(texts[d]) for d in members], np.int64)
        first = np.cumsum(sizes + 1) - sizes
        line = np.zeros(int(sizes.sum()) + len(members) + 1, np.int64)
        for d, at, size in zip(members, first.tolist(), sizes.tolist()):
            line[at : at + size] = np.fromiter(map(ids.__getitem__, texts[d]), np.int64, size)
        gaps = np.concatenate([[0], first + sizes])
        line[gaps] = len(ids) + np.arange(len(gaps))
        start, length, period = runs_of(line, int(sizes.max()) // 2, least)
        which = np.searchsorted(first, start, "right") - 1
        owners.append(np.array(members, np.int64)[which])
        found.append(np.stack([start - first[which], length, period]))
    owner, every = np.concatenate(owners), np.concatenate(found, axis=1)
    order = np.argsort(owner, kind="stable")
    return owner[order], every[:, order]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[0] + runs[1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with the periodic runs of their words.

    Words end at ASCII white space.  A run is a stretch of words with smallest
    period q, ``least`` and 2 q words long at least, that no neighbouring word
    extends.  Adds ``runs`` (start, length and period, by start and period) and
    ``collapsed``: the words that no run holds after its first q words, joined by
    single spaces.

    Null and empty texts have no runs and an empty ``collapsed``.  Repeated rows
    are treated alike; an empty table gives no rows; input columns with the names
    of results are replaced.  Memory grows with the longest text, not with the
    number of its candidate pairs.
    """
    if least < 3:
        raise ValueError("least must be 3 or more")
    fields = [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    kind = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in RUN.fieldNames()])

    def make():
        def work(texts):
            data, bounds = buffers(texts)
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            owner, every = runs_in(words, least)
            ends = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
            out = []
            for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                out.append(b" ".join(words[d] if a == b else kept_words(words[d], every[:, a:b])))
            flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in every], fields=list(kind))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            return [runs, pa.array(out, pa.binary()).cast(pa.string())]

        return work

    return extend(docs, text, fields, make, keep)
