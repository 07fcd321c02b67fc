"""Toxicity scores from the nearest labelled examples.

Examples and documents are TF-IDF vectors over all terms of the examples; a
term weighs the more, the more toxic the examples that hold it are, and none
weighs nothing.  The examples sit in an inverted index.  Posting lists of terms
that few examples hold are essential and always added up.  The other terms are
added only for examples that can enter the k nearest: the largest weight of each
common term in a block of like examples, and the norm of an example in each
group of common terms, bound what they can still give.  Cosines and neighbours
are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.llm.text import ALNUM, Words, col, extend, lists, mix, numbers, parts, tidy
from tablescope.session import checkpoint

MAX_EXAMPLES = 8192  # labelled rows in the index, the smallest by hash of their key
PRIOR = 5  # examples with the overall toxic share that every term is taken to have besides its own
PLAIN = 0.05  # what a term weighs that tells nothing, relative to one e times as toxic as all
NEIGHBOURS = 25
BLOCK = 64  # examples in a block
COMMON = 0.1  # terms of a larger share of the examples are looked up only where they can matter
COMMON_BYTES = 64 << 20  # of their counts, as one table of 64-bit numbers, which narrower ones undercut; less common terms beyond it have posting lists
PART_BYTES = 1 << 20  # of texts that are taken apart at once
RANGES = 64  # of terms, whose postings are put in order by a task each
SIZES = 1 << 18  # postings whose weights the driver holds at once
GROUPS = 32  # groups of common terms, by the examples that hold them
TOGETHER = 32  # texts whose bounds are computed at once
SKETCH = 64  # random signs that compare two common terms
EXAMPLES_A_TASK = 512  # examples that vote on each other in one task
NEAR = 0.05  # keeps the weight of an equal vector finite
STEMS = (4, 5)  # bytes of a word's beginning that are terms too


def terms_of(texts: pa.Array, known: np.ndarray | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, term, count`` of the distinct terms of each text, by text and term.

    Terms are words and the first bytes of longer words, as 64-bit hashes; with
    ``known`` (sorted, ``starts`` as ``places`` takes it) only those are counted and
    given by their position.
    """
    words = Words(texts, ALNUM)
    docs, terms = [words.doc], [words.hashes()]
    for n, flip in zip(STEMS, numbers(len(STEMS), 7)):
        longer = words.end - words.start > n
        docs.append(words.doc[longer])
        terms.append(words.hashes(n)[longer] ^ flip)
    doc, term = np.concatenate(docs), np.concatenate(terms)
    if known is not None:
        place = places(known, term, starts)
        there = place >= 0
        cells, count = np.unique(doc[there] * max(len(known), 1) + place[there], return_counts=True)
        return cells // max(len(known), 1), (cells % max(len(known), 1)).astype(np.uint64), count
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def starts_of(known: np.ndarray) -> np.ndarray:
    """Where the hashes of each range begin in ``known``."""
    bits = max(len(known).bit_length(), 1)
    return np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def places(known: np.ndarray, term: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The position of each term in ``known`` (sorted hashes), -1 if it is not there."""
    shift = np.uint64(64 - max(len(known).bit_length(), 1))
    starts = starts_of(known) if starts is None else starts
    padded = np.append(known, np.uint64(2**64 - 1))
    at = starts[(term >> shift).astype(np.int64)]
    late = np.flatnonzero(padded[at] < term)
    while len(late):
        at[late] += 1
        late = late[padded[at[late]] < term[late]]
    return np.where((padded[at] == term) & (at < len(known)), at, -1)


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    n = end - start
    last = np.cumsum(n)
    out = np.arange(int(last[-1]) if len(n) else 0)
    out += np.repeat(start - last + n, n)
    return out


@dataclass
class Index:
    """The examples and the calibration of their votes.

    Terms of few examples have posting lists, which are always added up.  Terms
    of many examples (``COMMON``) are looked up example by example: a bound from
    block maxima and from the norms of the examples by group of common terms
    tells which examples can still enter the k nearest.
    """

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    ids: list
    toxic: np.ndarray
    size: np.ndarray  # length of each example's vector before it is scaled to 1
    example: np.ndarray  # of each posting, by term and example
    count: np.ndarray
    postings: np.ndarray  # of each term
    base: float  # the score without any neighbour
    votes: np.ndarray | None = None  # calibration steps: from this vote on ...
    scores: np.ndarray | None = None  # ... this score

    @staticmethod
    def build(terms, idf, ids, toxic, doc, term, count, base) -> Index:
        """Postings from the examples' term counts; ``doc`` numbers the examples and rises."""
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        order = np.argsort(term, kind="stable")
        postings = np.bincount(term, minlength=len(terms)).astype(np.int32)
        return Index.posted(terms, idf, ids, toxic, small(doc)[order], small(count)[order], postings, base)

    @staticmethod
    def posted(terms, idf, ids, toxic, example, count, postings, base) -> Index:
        """An index of postings that are in order; ``SIZES`` of them are weighed at a time."""
        size, ends = np.zeros(len(ids)), np.cumsum(postings, dtype=np.int64)
        for at in range(0, len(example), SIZES):
            some = slice(at, at + SIZES)
            term = np.searchsorted(ends, np.arange(at, min(at + SIZES, len(example))), "right")
            np.add.at(size, example[some], ((1 + np.log(count[some].astype(float))) * idf[term]) ** 2)
        size = np.sqrt(size)
        size = np.where(size > 0, size, 1)
        return Index(terms, idf, list(ids), toxic, size, example, count, postings, base)

    def prepare(self) -> Index:
        """Lay out what ``nearest`` needs; done where the index is used, so that it travels in few bytes."""
        n = len(self.ids)
        # a weight is the factor of its count by those of its term and its example, so postings need no weights
        self.factor = np.zeros(int(self.count.max(initial=0)) + 1)
        self.factor[1:] = 1 + np.log(np.arange(1, len(self.factor)))
        many = self.postings > max(COMMON * n, 1)
        room = COMMON_BYTES // (8 * max(n, 1))
        if many.sum() > room:
            many[np.argsort(-self.postings, kind="stable")[room:]] = False
        self.starts = starts_of(self.terms).astype(np.int32)
        self.slot = np.where(many, np.cumsum(many, dtype=np.int32) - 1, np.int32(-1))  # the number of each common term
        width = int(many.sum())
        self.ends = np.concatenate([[0], np.cumsum(np.where(many, 0, self.postings), dtype=np.int64)])
        self.listed = np.empty(int(self.ends[-1]), self.example.dtype)
        # the list of a term is made of runs of one count each; lists are put in order some at a time
        last, at = np.cumsum(self.postings, dtype=np.int64), 0
        long, times, heads, often = [np.zeros(0, np.int32)], [self.count[:0]], [np.zeros(0, np.int32)], [np.zeros((3, 0), np.int32)]
        while at < len(self.terms):
            begin = int(last[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(last, begin + SIZES, "right")))
            example, count = self.example[begin : last[to - 1]], self.count[begin : last[to - 1]]
            term = np.repeat(np.arange(at, to, dtype=np.int32), self.postings[at:to])
            apart = many[term]
            often.append(np.stack([example[apart].astype(np.int32), count[apart].astype(np.int32), self.slot[term[apart]]]))
            example, count, term = example[~apart], count[~apart], term[~apart]
            order = np.lexsort((count, term))
            self.listed[self.ends[at] : self.ends[to]] = example[order]
            count, term = count[order], term[order]
            fresh = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (count[1:] != count[:-1]))[: len(term)])
            long.append(np.diff(np.append(fresh, len(term))).astype(np.int32))
            times.append(count[fresh])
            heads.append(term[fresh])
            at = to
        self.long, self.by = np.concatenate(long), self.factor[np.concatenate(times)]
        self.runs = np.searchsorted(np.concatenate(heads), np.arange(len(self.terms) + 1, dtype=np.int32)).astype(np.int32)
        example, count, slot = np.concatenate(often, axis=1)
        del long, times, heads, often
        weight = self.factor[count] * self.idf[many][slot] / self.size[example]
        self.group = grouped(example, slot, weight, n, width)
        norms = np.bincount(example.astype(np.int64) * GROUPS + self.group[slot], weight * weight, minlength=n * GROUPS)
        self.norms = np.sqrt(norms).reshape(n, GROUPS)
        # examples that share their strongest group stand in the same blocks, so that maxima are tight
        order = np.lexsort((self.norms.max(1), self.norms.argmax(1)))
        self.block = np.empty(n, np.int64)
        self.block[order] = np.arange(n) // BLOCK
        self.most = np.zeros((int(self.block.max(initial=0)) + 1, width))
        np.maximum.at(self.most, (self.block[example], slot), weight)
        self.table = np.zeros((n, width), self.count.dtype)
        self.table[example, slot] = count
        self.common_idf = self.idf[many]
        self.opened = 0
        return self

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int = -1):
        """Positions and cosines of the k nearest examples with a positive cosine, with all that tie with the last."""
        return next(self.search(np.array([0, len(term)]), term, weight, k, [skip]))

    def search(self, starts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: Sequence[int] | None = None):
        """``nearest`` for each of the texts whose unit vectors begin at ``starts``."""
        slot = self.slot[term]
        for begin in range(0, len(starts) - 1, TOGETHER):
            end = min(begin + TOGETHER, len(starts) - 1)
            low = starts[begin]
            some = slice(low, starts[end])
            text = np.repeat(np.arange(end - begin), np.diff(starts[begin : end + 1]))
            few, own, part = slot[some] < 0, slot[some], weight[some]
            query = np.zeros((end - begin, self.most.shape[1]))
            query[text[~few], own[~few]] = part[~few]
            norm = np.bincount(text[~few] * GROUPS + self.group[own[~few]], part[~few] ** 2, minlength=len(query) * GROUPS)
            bound = np.sqrt(norm).reshape(-1, GROUPS) @ self.norms.T
            top = query @ self.most.T
            for i in range(end - begin):
                a, z = starts[begin + i] - low, starts[begin + i + 1] - low
                there = few[a:z]
                cosine = self.essential(term[some][a:z][there], part[a:z][there])
                if skip is not None and skip[begin + i] >= 0:
                    cosine[skip[begin + i]] = -9
                yield self.common(cosine, cosine + np.minimum(bound[i], top[i][self.block]), query[i], k)

    def essential(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What terms of few examples give to the cosine of each example."""
        at = spread(self.ends[term], self.ends[term + 1])
        run = spread(self.runs[term], self.runs[term + 1])
        weight = np.repeat(weight * self.idf[term], self.runs[term + 1] - self.runs[term]) * self.by[run]
        share = np.bincount(self.listed.take(at), np.repeat(weight, self.long[run]), minlength=len(self.ids))
        return share / self.size

    def common(self, cosine: np.ndarray, bound: np.ndarray, query: np.ndarray, k: int):
        """Add what common terms give, to all examples whose bound reaches the k-th best cosine."""
        # nothing is negative, so the k-th best of what is known so far is a least cosine
        least = max(1e-12, float(np.partition(cosine, -k)[-k]) if len(cosine) >= k else 0.0)
        found, exact, step = np.zeros(0, np.int64), np.zeros(0), 2 * k
        own = np.flatnonzero(query)
        query = query[own] * self.common_idf[own]
        rest = np.flatnonzero(bound >= least - 1e-9)
        while len(rest):
            if len(rest) > step:
                rest = rest[np.argpartition(-bound[rest], step)[:step]]
            bound[rest] = -9
            part = cosine[rest] + self.factor.take(self.table[rest[:, None], own], mode="clip") @ query / self.size[rest]
            found, exact = np.concatenate([found, rest]), np.concatenate([exact, part])
            self.opened += len(rest)
            if len(exact) >= k:
                least = max(least, float(np.partition(exact, -k)[-k]))
            step *= 4
            rest = np.flatnonzero(bound >= least - 1e-9)
        exact = np.round(exact, 12)
        every = np.flatnonzero(exact > 0)
        if len(every) > k:
            every = every[exact[every] >= np.partition(exact[every], -k)[-k]]
        every = every[np.lexsort((found[every], -exact[every]))]
        return found[every], np.minimum(exact[every], 1.0)

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """The share of toxic neighbours, weighted by the inverse of their distance."""
        weight = 1 / (NEAR + 1 - cosine)
        return float((weight * self.toxic[at]).sum() / weight.sum())

    def vectors(self, doc, term, count, n):
        """Unit vectors of the texts: where each begins, the terms and the weights."""
        weight = (1 + np.log(count.astype(float))) * self.idf[term]
        size = np.sqrt(np.bincount(doc, weight * weight, minlength=n))
        return np.searchsorted(doc, np.arange(n + 1)), term, weight / np.where(size > 0, size, 1)[doc]

    def own_vote(self, some: np.ndarray) -> np.ndarray:
        """The votes on the given examples, each left out of its own; NaN without neighbours."""
        wanted = np.flatnonzero(np.isin(self.example, some))
        term, example, count = np.searchsorted(np.cumsum(self.postings), wanted, "right"), self.example[wanted], self.count[wanted]
        order = np.argsort(example, kind="stable")
        starts, term, weight = self.vectors(example[order].astype(np.int64), term[order], count[order], len(self.ids))
        votes = np.full(len(some), np.nan)
        for i, (at, cosine) in enumerate(self.search(np.searchsorted(example[order], np.append(some, some[-1:] + 1)), term, weight, skip=some)):
            if len(at):
                votes[i] = self.vote(at, cosine)
        return votes

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit a rising step function from the examples' votes to their labels."""
        steps: list[list[float]] = []  # first vote, toxic, all
        for vote, said in sorted(zip(votes.tolist(), toxic.tolist())):
            if steps and steps[-1][0] == vote:
                steps[-1][1] += said
                steps[-1][2] += 1
            else:
                steps.append([vote, float(said), 1.0])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                last = steps.pop()
                steps[-1][1] += last[1]
                steps[-1][2] += last[2]
        self.votes = np.array([s[0] for s in steps])
        self.scores = np.array([(s[1] + self.base) / (s[2] + 1) for s in steps])
        self.scores = np.maximum.accumulate(self.scores) if len(steps) else self.scores

    def score(self, vote: float) -> float:
        if not len(self.votes):
            return self.base
        return float(self.scores[max(int(np.searchsorted(self.votes, vote, "right")) - 1, 0)])


def grouped(example: np.ndarray, slot: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """A group for each common term; terms of the same examples share one."""
    sketch = np.zeros((width, SKETCH))
    for k in range(SKETCH):
        sign = 1.0 - 2.0 * (numbers(n, k) >> np.uint64(63)).astype(float)
        sketch[:, k] = np.bincount(slot, sign[example] * weight, minlength=width)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-300)
    group, near = np.zeros(width, np.int64), np.full(width, -2.0)
    for g in range(min(GROUPS, width)):
        like = sketch @ sketch[np.argmin(near)]
        group[like > near] = g
        near = np.maximum(near, like)
    return group


READY: dict[str, Index] = {}  # the index that this Python worker's task has laid out, by name


def ready(name: str, held: Broadcast, votes: bool = False) -> Index:
    """The laid-out index; one before it goes first, so that no worker holds two.

    Only ``votes`` of the examples on each other need their own terms.  A task
    ends with ``release``: Spark keeps several idle workers beside those at
    work, and what they still hold counts as much.
    """
    if name not in READY:
        READY.clear()
        index = copy(held.value)  # what came stays as it was
        index.prepare()
        if not votes:
            index.example = index.count = None
        READY[name] = index
    return READY[name]


def release() -> None:
    """At the end of a task."""
    READY.clear()


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows that no label is learnt from: crc32 of the key as text, modulo ``folds``; never for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def telling_terms(facts: Broadcast):
    """``term, n, toxic``: in how many different sets of a task's examples each term is, and how many of them are toxic."""

    def run(batches):
        rows, _, once, worst = facts.value
        for batch in batches:
            at, sizes = np.searchsorted(rows, batch.column(0).to_numpy()), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            term, back = np.unique(batch.column(1).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(back, np.repeat(once[at], sizes), minlength=len(term)).astype(np.int64)
            bad = np.bincount(back, np.repeat(once[at] * worst[at], sizes), minlength=len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n), pa.array(bad)], names=["term", "n", "toxic"])

    return run


def ranges_of_terms(facts: Broadcast, held: Broadcast):
    """The postings of a task's examples, dealt to ``RANGES`` ranges of terms; numbers as bytes of 32 bits."""

    def run(batches):
        rows, number, _, _ = facts.value
        known = held.value
        starts = starts_of(known)
        for batch in batches:
            at, sizes = np.searchsorted(rows, batch.column(0).to_numpy()), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            term = places(known, batch.column(1).flatten().to_numpy().view(np.uint64), starts)
            order = np.argsort(term, kind="stable")
            term = term[order]
            part = term * RANGES // max(len(known), 1)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            doc = np.repeat(number[at], sizes)[order]
            count = batch.column(2).flatten().to_numpy()[order]
            sides = [[x[a:z].astype(np.int32).tobytes() for a, z in zip(cut, [*cut[1:], len(part)])] for x in (term, doc, count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cut], pa.int32()), *(pa.array(x, pa.binary()) for x in sides)], names=["part", "term", "doc", "count"]
            )

    return run


def merged_postings(table: pa.Table) -> pa.Table:
    """The postings of one range, by term and example; an example of several texts has the largest count.

    Counts come back in the least ``width`` that holds them.
    """
    term, doc, count = (np.frombuffer(b"".join(table[c].to_pylist()), np.int32) for c in ("term", "doc", "count"))
    order = np.lexsort((doc, term))
    term, doc, count = term[order], doc[order], count[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))
    small = lambda x: x.astype(np.min_scalar_type(int(x.max())))
    count = small(np.maximum.reduceat(count, first))
    heads, n = np.unique(term[first], return_counts=True)
    packed = [np.stack([heads, n.astype(np.int32)]), doc[first].astype(np.uint16 if doc.max() < 1 << 16 else np.int32), count]
    widths = packed[1].itemsize * 16 + count.itemsize
    return pa.table(
        {
            "part": table["part"].combine_chunks().slice(0, 1),
            **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("term", "doc", "count"), packed)},
            "width": pa.array([widths], pa.int32()),
        }
    )


def laid_out(found: pa.Table, n: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``example, count, postings`` of an index from the ranges that ``merged_postings`` gave."""
    postings = np.zeros(terms, np.int32)
    ranges = sorted(range(found.num_rows), key=found["part"].to_pylist().__getitem__)
    examples, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for i in ranges:
        width = found["width"][i].as_py()
        heads = np.frombuffer(found["term"][i].as_buffer(), np.int32).reshape(2, -1)
        postings[heads[0]] = heads[1]
        examples.append(np.frombuffer(found["doc"][i].as_buffer(), np.uint16 if width // 16 == 2 else np.int32))
        counts.append(np.frombuffer(found["count"][i].as_buffer(), f"u{width % 16}"))
    kind = np.min_scalar_type(max(n - 1, 0))
    return np.concatenate([x.astype(kind, copy=False) for x in examples]), np.concatenate(counts), postings


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
) -> Index:
    """An index of at most ``max_examples`` labelled rows of ``docs`` that are not held out.

    Labels of a repeated key are averaged.  All terms of the examples are indexed;
    their inverse document frequency is multiplied with how far (as a logarithm)
    their share of toxic examples lies above that of all, plus ``PLAIN``.  For
    that share texts with the same set of terms count once.  Document frequencies
    cover all of ``docs``.
    """
    own = labels.where(col(key).isNotNull() & col(label).isNotNull() & ~held_out(col(key)))
    own = own.groupBy(col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("toxic"))
    sample = own.orderBy(F.xxhash64("key"), "key").limit(max_examples)
    source = docs.select(col(key).alias("key"), col(text).alias("text")).join(F.broadcast(sample), "key")

    def make():
        def work(texts):
            n = len(texts)
            doc, term, count = terms_of(texts)
            mark = np.zeros(n, np.uint64)  # of the set of terms
            np.add.at(mark, doc, mix(term))
            sizes = np.bincount(doc, minlength=n)
            return [
                lists(term.view(np.int64), sizes, pa.int64()),
                lists(count.astype(np.int32), sizes, pa.int32()),
                pa.array(mark.view(np.int64)),
            ]

        return work

    fields = [T.StructField("terms", T.ArrayType(T.LongType(), False)), T.StructField("counts", T.ArrayType(T.IntegerType(), False))]
    examples = extend(source, "text", [*fields, T.StructField("mark", T.LongType())], make, ["key", "toxic"])
    examples = checkpoint(examples.dropDuplicates(["key", "terms", "counts"]).withColumn("row", F.monotonically_increasing_id()))
    # terms stay in the tasks; the driver has the rows, what all examples say of a term, and the finished postings
    table = examples.select("key", "toxic", "mark", "row").orderBy("key").toArrow()
    keys, said = table["key"].to_pylist(), table["toxic"].to_numpy().astype(float)
    rows = table["row"].to_numpy()

    # examples with the same set of terms count once, as toxic if one of them is
    _, one, alike = np.unique(table["mark"].to_numpy(), return_index=True, return_inverse=True)
    worst = np.zeros(len(one))
    np.maximum.at(worst, alike, said)
    p = min(max(float(worst.mean()) if len(one) else 0.0, 1e-6), 1 - 1e-6)
    once = np.isin(np.arange(len(rows)), one)
    # one example per key; the texts of a repeated key are one
    fresh = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))], bool)
    number = np.cumsum(fresh) - 1
    labelled = [keys[i] for i in np.flatnonzero(fresh)]
    toxic = said[fresh]

    context, order = docs.sparkSession.sparkContext, np.argsort(rows)
    facts = context.broadcast((rows[order], number[order], once[order], worst[alike][order]))
    sums = examples.select("row", "terms").mapInArrow(tidy(telling_terms(facts)), "term long, n long, toxic long")
    sums = sums.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    known = sums["term"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, n, t = known[order], sums["n"].to_numpy()[order], sums["toxic"].to_numpy()[order]
    telling = PLAIN + np.maximum(np.log((t + PRIOR * p) / (n + PRIOR) / p), 0)
    del sums, order, n, t

    held = context.broadcast(known)

    def frequencies(batches):
        known = held.value
        starts = starts_of(known)
        total, rows = np.zeros(len(known), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at, to in parts(batch.column(0), PART_BYTES):
                _, term, _ = terms_of(batch.column(0).slice(at, to - at), known, starts)
                total += np.bincount(term.astype(np.int64), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["term", "n"])

    texts = docs.select(col(text).cast("string").alias("text"))
    sums = texts.mapInArrow(tidy(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    place, n = sums["term"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(known))
    df[place[place >= 0]] = n[place >= 0]
    idf = (np.log((n[place < 0].sum() + 1) / (df + 1)) + 1) * telling
    del sums, place, n

    dealt = examples.select("row", "terms", "counts").mapInArrow(tidy(ranges_of_terms(facts, held)), "part int, term binary, doc binary, count binary")
    found = dealt.groupBy("part").applyInArrow(merged_postings, "part int, term binary, doc binary, count binary, width int").toArrow()
    example, count, postings = laid_out(found, len(labelled), len(known))
    del found
    pa.default_memory_pool().release_unused()
    alone = np.ones(len(labelled), bool)
    alone[example] = False
    base = float((toxic[alone].sum() + p * bool(len(labelled))) / (alone.sum() + 1))
    index = Index.posted(known, idf, labelled, toxic, example, count, postings, base)
    leave_one_out(docs.sparkSession, index)
    return index


def leave_one_out(spark: SparkSession, index: Index) -> None:
    """Calibrate with the examples' votes on each other; tasks cast the votes."""
    n, name = len(index.ids), uuid.uuid4().hex
    held = spark.sparkContext.broadcast(index)

    def cast(batches):
        for batch in batches:
            some = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ready(name, held, votes=True).own_vote(some))], names=["id", "vote"])
        release()

    votes = spark.range(0, n, 1, -(-n // EXAMPLES_A_TASK) or 1).mapInArrow(tidy(cast), "id long, vote double").toArrow()
    vote = votes["vote"].to_numpy()
    some = ~np.isnan(vote)
    index.calibrate(vote[some], index.toxic[votes["id"].to_numpy()[some]])
    held.destroy()


def score(
    docs: DataFrame, index: Index, text: str = "text", key_type: T.DataType | None = None, keep: list[str] | None = None, shown: int = 5
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``score`` and ``neighbours``.

    ``score`` is the calibrated chance of a toxic label; ``neighbours`` are the
    ``shown`` nearest examples with cosine and label, nearest first.

    A null or empty text, and one without any term of the examples, has no neighbours and
    the toxic share of such examples as its score.  Without labelled rows every
    score is 0.  Equal texts have equal scores; all examples that tie with the last
    neighbour vote.  Input columns with the names of
    results are replaced.
    """
    held, name = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex
    kind = key_type or T.LongType()
    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "neighbours",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", kind), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]
                )
            ),
        ),
    ]
    evidence = to_arrow_type(fields[1].dataType)

    def make():
        index = ready(name, held)

        def work(texts):
            doc, term, count = terms_of(texts, index.terms, index.starts)
            starts, term, weight = index.vectors(doc, term.astype(np.int64), count, len(texts))
            scores = np.full(len(texts), index.base)
            near: list[list[dict]] = [[] for _ in range(len(texts))]
            for i, (at, cosine) in enumerate(index.search(starts, term, weight)):
                if len(at):
                    scores[i] = index.score(index.vote(at, cosine))
                    near[i] = [
                        {"key": index.ids[a], "cosine": float(c), "toxic": int(index.toxic[a])} for a, c in zip(at[:shown], cosine)
                    ]
            return [pa.array(scores), pa.array(near, evidence)]

        return work

    return extend(docs, text, fields, make, keep, limit=PART_BYTES, done=release)


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", keep: list[str] | None = None, **options
) -> DataFrame:
    """Fit on the labelled rows that are not held out and score all rows; see ``fit`` and ``score``."""
    index = fit(docs, labels, text, key, label, **options)
    return score(docs, index, text, labels.schema[key].dataType, keep)
