"""Exact top-k BM25 search with block-max pruning, shard by shard, under global statistics.

The words of all texts are counted once.  A task's texts are cut into blocks of at
most ``BLOCK`` documents that use the same words; the inverted index of a block
goes to the shared folder and is read for every slice of queries.  Queries with
the same words are a group.  The sum of a block's largest weights of a query's
terms bounds its scores there: a group opens its most promising block first, and
a block only for the queries whose bound reaches the k-th best score so far.
That score is carried from shard to shard; a few shards are searched first, and
the others begin with what was found there.

An opened block is scored for all queries of a group together: terms that most of
both hold are multiplied as matrices, the postings of all others are added up.
Weights are rounded to millionths before they are added, so scores do not depend
on the order of addition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablescope.llm.text import ALNUM, Words, col, parts, tidy
from tablescope.session import checkpoint

K1, B = 1.2, 0.75
BLOCK = 4096  # documents, at most
GROUP = 1024  # queries that are scored together, at most
SHARD_BYTES = 32 << 20  # of texts, in parts of PART_BYTES
PART_BYTES = 4 << 20
QUERIES = 16_384  # queries in one broadcast; more take more passes
TERMS = 2 << 20  # terms of queries in one broadcast, about; more take more passes
CELLS = 1 << 16  # postings of queries that are added up at a time, about
ROOM = 1 << 22  # scores of queries and documents that are held at a time, about
MATRIX = 1 << 22  # numbers in a matrix of documents and terms, at most
COMMON = 256  # frequent terms that tell which texts use the same words
DENSE = 0.003  # a term goes into the matrices if so many pairs of a query and a document share it
FIRST = 3  # partitions of the index that are searched without a first round, at most
UNIT = 1e6


def terms_of(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc, term, count, at`` of the distinct words of each text, by term and text; ``at`` is one occurrence."""
    order = np.lexsort((words.doc, hashes))
    doc, term = words.doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], term[at], np.diff(np.append(at, len(doc))), order[at]


def alike(row: np.ndarray, term: np.ndarray, n: int, most: int) -> list[np.ndarray]:
    """Groups of at most ``most`` of ``n`` rows that hold the same frequent terms; ``row`` holds ``term`` (a small number).

    A group is cut across its main direction until it is small enough.
    """
    counts = np.bincount(term)
    common = np.argsort(-counts, kind="stable")[:COMMON]
    column = np.full(len(counts), -1)
    column[common] = np.arange(len(common))
    column = column[term]
    holds = np.zeros((n, len(common)), np.float32)
    holds[row[column >= 0], column[column >= 0]] = 1
    out, left = [], [np.arange(n)]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        some = holds[rows] - holds[rows].mean(0)
        along = some @ np.linalg.eigh(some.T @ some)[1][:, -1] if len(common) else np.zeros(len(rows))
        upper = along > 0
        if not len(rows) / 16 < upper.sum() < len(rows) * 15 / 16:  # a few rows by themselves are no group
            upper = np.argsort(np.argsort(along, kind="stable")) >= len(rows) // 2
        left += [rows[~upper], rows[upper]]
    return [rows for rows in out if len(rows)]


def small(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as all of them need."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``small`` has written."""
    return np.frombuffer(data, f"u{len(data) // n if n else 1}")


FIELDS = {"docs": "bigint", "words": "bigint"} | {name: "binary" for name in ("keys", "length", "term", "n", "doc", "count")}


def inverted(shard):
    """The blocks of ``keys, doc, term, count, length`` of some parts; one without ``keys`` has texts that count but are not found."""
    sizes = np.cumsum([0, *(len(counts) for *_, counts in shard)])
    keys = pa.concat_arrays([keys for keys, *_ in shard])
    doc = np.concatenate([doc + at.astype(np.int32) for (_, doc, *_), at in zip(shard, sizes)])
    term, count, length = (np.concatenate([part[i] for part in shard]) for i in (2, 3, 4))
    shard.clear()
    order = np.argsort(term, kind="stable")
    doc, term, count = doc[order], term[order], count[order]
    place_of = np.cumsum(np.append(True, term[1:] != term[:-1])[: len(term)], dtype=np.int32) - 1
    listed = keys.is_valid().to_numpy(zero_copy_only=False)
    keys = keys.fill_null(0).to_numpy()
    owner, place = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
    groups = [(rows[some], here) for rows in alike(doc, place_of, len(keys), BLOCK) for some, here in ((listed[rows], True), (~listed[rows], False)) if some.any()]
    for i, (rows, _) in enumerate(groups):
        owner[rows], place[rows] = i, np.arange(len(rows))
    order = np.argsort(owner[doc], kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(owner[doc], minlength=len(groups))))
    for i, (rows, here) in enumerate(groups):
        some = order[ends[i] : ends[i + 1]]
        heads = np.flatnonzero(np.append(True, term[some][1:] != term[some][:-1])[: len(some)])
        yield {
            "docs": len(rows),
            "words": int(length[rows].sum()),
            "keys": keys[rows].tobytes() if here else None,
            "length": small(length[rows]),
            "term": term[some][heads].tobytes(),
            "n": small(np.diff(np.append(heads, len(some)))),
            "doc": small(place[doc[some]]),
            "count": small(count[some]),
        }


def indexing(batches):
    """The blocks of batches of keys and texts."""
    schema = pa.schema([(name, pa.int64() if kind == "bigint" else pa.binary()) for name, kind in FIELDS.items()])
    shard, held = [], 0
    for batch in batches:
        for a, b in parts(batch.column(1), PART_BYTES):
            texts = batch.column(1).slice(a, b - a)
            words = Words(texts, ALNUM)
            doc, term, count, _ = terms_of(words, words.hashes())
            size = len(words.data)
            if shard and held + size > SHARD_BYTES:
                yield from (pa.RecordBatch.from_pylist([x], schema) for x in inverted(shard))
                shard, held = [], 0
            shard.append((batch.column(0).slice(a, b - a), doc.astype(np.int32), term, count.astype(np.int32), words.counts))
            held += size + 64 * len(texts)
    if shard:
        yield from (pa.RecordBatch.from_pylist([x], schema) for x in inverted(shard))


def index(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The inverted index of all texts, block by block."""
    source = docs.select(col(key).cast("bigint").alias("key"), col(text).cast("string").alias("text"))
    made = source.mapInArrow(tidy(indexing), ", ".join(f"{name} {kind}" for name, kind in FIELDS.items()))
    return checkpoint(made.withColumn("part", F.spark_partition_id()))


def frequencies(blocks: DataFrame) -> DataFrame:
    """``term, n``: the number of texts with each term of the index."""

    def run(batches):
        for batch in batches:
            terms = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
            counts = [large(x, len(term)) for x, term in zip(batch.column(1).to_pylist(), terms)]
            if terms and sum(map(len, terms)):
                term, count = np.concatenate(terms), np.concatenate(counts).astype(np.int64)
                order = np.argsort(term, kind="stable")
                term, count = term[order], count[order]
                heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(term[heads].view(np.int64)), pa.array(np.add.reduceat(count, heads))], names=["term", "n"])

    return blocks.select("term", "n").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """``query, term, word, count`` of the distinct words of each query."""
    source = queries.where(col(query).isNotNull()).select(col(query).cast("bigint").alias("query"), col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, b in parts(batch.column(1), PART_BYTES):
                words = Words(batch.column(1).slice(a, b - a), ALNUM)
                doc, term, count, at = terms_of(words, words.hashes())
                found = [words.data[x:y].tobytes().decode() for x, y in zip(words.start[at], words.end[at])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(term.view(np.int64)), pa.array(found, pa.string()), pa.array(count)],
                    names=["query", "term", "word", "count"],
                )

    made = source.mapInArrow(run, "query bigint, term bigint, word string, count bigint")
    return made.groupBy("query", "term").agg(F.min("word").alias("word"), F.max("count").alias("count"))


def packed(table: pa.Table) -> pa.Table:
    """One row with the queries of a slice, group by group: each group's terms, and which of them its queries ask for."""
    names, row = np.unique(table["query"].to_numpy(), return_inverse=True)
    term, at, place = np.unique(table["term"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    groups = alike(row, place, len(names), GROUP)
    owner, new = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    for g, rows in enumerate(groups):
        owner[rows], new[rows] = g, np.arange(len(rows))
    members, asks, sizes = [], [], []
    order = np.lexsort((place, new[row], owner[row]))
    ends = np.searchsorted(owner[row][order], np.arange(len(groups) + 1))
    for g in range(len(groups)):
        some = order[ends[g] : ends[g + 1]]
        member, ask = np.unique(place[some], return_inverse=True)
        members.append(member)
        asks.append(ask)
        sizes.append(np.bincount(new[row[some]], minlength=len(groups[g])))
    fields = {
        "term": term,
        "idf": table["idf"].to_numpy()[at],
        "queries": np.array([len(rows) for rows in groups]),
        "query": names[np.concatenate(groups)],
        "size": np.concatenate(sizes),
        "members": np.array([len(member) for member in members]),
        "member": np.concatenate(members),
        "ask": np.concatenate(asks),
    }
    return pa.table({name: pa.array([x.astype(Asked.FIELDS[name]).tobytes()], pa.binary()) for name, x in fields.items()})


class Group:
    """Queries with the same words, and the least scores that are still of use to them."""

    def __init__(self, query: np.ndarray, size: np.ndarray, member: np.ndarray, ask: np.ndarray, known: tuple[np.ndarray, np.ndarray]):
        self.query, self.size, self.member, self.ask = query, size, member, ask
        self.heads = np.cumsum(size) - size
        self.least = np.zeros(len(query), np.int64)
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], query), len(known[0]) - 1)
            self.least = np.where(known[0][at] == query, known[1][at], 0)
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> None:
        self.best = top(*(np.concatenate(x) for x in zip(self.best, (row, key, score))), k)
        raise_least(self.least, self.best[0], self.best[2], k)


class Asked:
    """The queries of a slice."""

    FIELDS = {"term": "u8", "idf": "f8", "queries": "i8", "query": "i8", "size": "i8", "members": "i8", "member": "i4", "ask": "i4"}

    def __init__(self, fields: dict[str, bytes], known: tuple[np.ndarray, np.ndarray]):
        x = {name: np.frombuffer(fields[name], kind) for name, kind in self.FIELDS.items()}
        self.term, self.idf = x["term"], x["idf"]
        cut = lambda name, counts: np.split(x[name], np.cumsum(counts)[:-1])
        sizes = cut("size", x["queries"])
        asks = cut("ask", [size.sum() for size in sizes])
        self.groups = [Group(*of, known) for of in zip(cut("query", x["queries"]), sizes, cut("member", x["members"]), asks)]


class Block:
    """The inverted index of some texts, and the scores of its postings for a slice of queries."""

    FIELDS = "keys", "length", "term", "n", "doc", "count"

    def __init__(self, row: dict, mean: float, asked: Asked):
        self.keys = np.frombuffer(row["keys"], np.int64)
        term = np.frombuffer(row["term"], np.uint64)
        n = large(row["n"], len(term)).astype(np.int64)
        total = int(n.sum())
        doc = large(row["doc"], total).astype(np.int64)
        count, length = large(row["count"], total).astype(np.int64), large(row["length"], len(self.keys)).astype(np.int64)[doc]
        weight = count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        place = np.minimum(np.searchsorted(term, asked.term), max(len(term) - 1, 0))
        there = term[place] == asked.term if len(term) else np.zeros(len(asked.term), bool)
        idf = np.zeros(len(term))
        idf[place[there]] = asked.idf[there]
        idf = np.repeat(idf, n)
        value = np.rint(idf * weight * UNIT).astype(np.int64)
        self.bits = len(self.keys).bit_length()
        self.posting = value << self.bits | doc
        begin = np.cumsum(n) - n
        most = np.maximum.reduceat(value, begin) if total else np.zeros(0, np.int64)
        # by term of the queries: postings, the first of them, the largest score
        self.n, self.at, self.most = (np.zeros(len(asked.term), np.int64) for _ in range(3))
        for to, x in ((self.n, n), (self.at, begin), (self.most, most)):
            to[there] = x[place[there]]
        #: A document that shares a term is found even if its score is rounded to 0.
        self.naught = bool(((value == 0) & (idf > 0)).any())

    def bounds(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """For each query: the largest score that a document can have, and whether any shares a term."""
        bound = np.add.reduceat(self.most[group.member].take(group.ask), group.heads)
        return bound, np.add.reduceat(self.n[group.member].take(group.ask), group.heads) > 0 if self.naught else bound > 0

    def search(self, group: Group, able: np.ndarray, k: int) -> None:
        """Adds to the group's best the documents that reach its ``least`` scores, for those queries that are ``able``."""
        rows = np.flatnonzero(able)
        step = max(1, ROOM // max(1, len(self.keys)))
        for i in range(0, len(rows), step):
            row, doc, score = self.reach(group, rows[i : i + step], k)
            group.add(row, self.keys[doc], score, k)

    def reach(self, group: Group, rows: np.ndarray, k: int):
        """``row, doc, score`` of the documents that may be among the k best of the queries ``rows``.

        Sums of matrices are rounded and serve to leave documents out; those that stay are added up exactly.
        """
        row, ask = np.repeat(np.arange(len(group.size)), group.size), group.ask.astype(np.int64)
        if len(rows) < len(group.query):
            new = np.full(len(group.query), -1)
            new[rows] = np.arange(len(rows))
            row = new[row]
            some = np.flatnonzero(row >= 0)
            row, ask = row[some], ask[some]
        n, at, width = self.n[group.member], self.at[group.member], len(self.keys)
        often = np.bincount(ask, minlength=len(n)) * n
        common = np.flatnonzero(often > DENSE * len(rows) * width)
        if len(common) > (most := max(1, MATRIX // max(1, width))):
            common = np.sort(common[np.argpartition(-often[common], most)[:most]])
        column = np.where(n > 0, -1, -2)
        column[common] = np.arange(len(common))
        column = column[ask]
        both, others = np.flatnonzero(column >= 0), np.flatnonzero(column == -1)
        holds = np.zeros((len(rows), len(common)), np.float32)
        holds[row[both], column[both]] = 1
        which, doc, value = self.postings(n[common], at[common])
        matrix = np.zeros((width, len(common)), np.int32 if self.most.max(initial=0) < 2**31 else np.int64)
        matrix[doc, which] = value
        about = holds @ matrix.astype(np.float32).T
        there = np.zeros(matrix.shape if self.naught else 0, np.float32)
        if self.naught:
            there[doc, which] = 1
        row, ask = row[others], ask[others]
        n, at = n[ask], at[ask]
        slack = 1 - (group.size[rows] + 4) * 2.0**-23  # of sums in single precision
        out = []
        step = max(1, CELLS // max(1, width))
        ends = np.searchsorted(row, np.arange(0, len(rows) + step, step))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            begin, to = i * step, min((i + 1) * step, len(rows))
            total = about[begin:to].astype(np.float64)
            self.add(total, row[a:b] - begin, n[a:b], at[a:b])
            least = group.least[rows[begin:to]] * slack[begin:to]
            if len(unknown := np.flatnonzero(least == 0)):
                least[unknown] = kth(total[unknown], k) * slack[begin + unknown] ** 2
            if self.naught:
                shared = (holds[begin:to] @ there.T).astype(np.float64)
                self.add(shared, row[a:b] - begin, n[a:b], at[a:b], count=True)
                total[shared == 0] = -1
            else:
                least = np.maximum(least, 0.5)
            some = np.flatnonzero(total.max(1, initial=-1) >= least)
            x, doc = np.divmod(np.flatnonzero(total[some] >= least[some, None]), max(width, 1))
            x = some[x]
            # all numbers are whole: what the matrices gave is taken off again without error
            score = total[x, doc] - about[begin + x, doc]
            few = max(1, CELLS * 16 // max(1, len(common)))
            for c in range(0, len(x), few):
                some = slice(c, c + few)
                score[some] += np.where(holds[begin + x[some]] > 0, matrix[doc[some]], 0).sum(1, dtype=np.int64)
            out.append((rows[begin + x], doc, score.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def add(self, total: np.ndarray, row: np.ndarray, n: np.ndarray, at: np.ndarray, count: bool = False) -> None:
        """Adds the postings from ``at``, ``n`` each, to the rows of ``total``, or counts them."""
        flat, row, ends, a = total.reshape(-1), row * total.shape[1], np.cumsum(n), 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
            which, doc, value = self.postings(n[a:b], at[a:b])
            doc += np.repeat(row[a:b], n[a:b])
            np.add.at(flat, doc, np.ones(len(doc)) if count else value)
            a = b

    def postings(self, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``which, doc, value`` of the postings from ``at``, ``n`` each."""
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which))
        place += np.repeat(at - np.cumsum(n) + n, n)
        posting = self.posting.take(place)
        return which, posting & ((1 << self.bits) - 1), (posting >> self.bits).astype(np.float64)


def kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest number of each row, or 0 if there are fewer."""
    at = score.shape[1] - k
    return np.partition(score, at, 1)[:, at] if 0 <= at < score.shape[1] else np.zeros(len(score))


def raise_least(least: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """The k-th best of a query's candidates is a lower bound for its k-th best of all."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    at = rank == k - 1
    least[q[at]] = np.maximum(least[q[at]], s[at])


def top(query, key, score, k: int):
    """The k best of each query; of equal scores the smallest keys."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    good = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[good], key[good], score[good]


def found(blocks: DataFrame, held: list, known: tuple[np.ndarray, np.ndarray], mean: float, k: int) -> DataFrame:
    """The k best of each task's texts for each query of all slices; ``known`` are queries and scores that others have reached."""
    spark = blocks.sparkSession
    schema = "query bigint, key bigint, score bigint"
    reached = spark.sparkContext.broadcast(known)
    out = spark.createDataFrame([], schema)
    for i, piece in enumerate(held):
        part = blocks.select(*Block.FIELDS).mapInArrow(tidy(searching(piece, reached, mean, k)), schema)
        out = out.unionByName(part) if i else part
    return out


def searching(held, known, mean: float, k: int):
    """The k best of a task's texts for each query of one slice."""

    def shards(batches):
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if rows and size + len(row["doc"]) > SHARD_BYTES / 4:
                    yield rows
                    rows, size = [], 0
                rows.append(row)
                size += len(row["doc"])
        if rows:
            yield rows

    def run(batches):
        asked = Asked(held.value, known.value)
        for rows in shards(batches):
            blocks = [Block(row, mean, asked) for row in rows]
            for group in asked.groups:
                bounds = [block.bounds(group) for block in blocks]
                for i in sorted(range(len(blocks)), key=lambda i: -bounds[i][0].sum()):
                    bound, shared = bounds[i]
                    blocks[i].search(group, shared & (bound >= group.least), k)
        for group in asked.groups:
            row, key, score = group.best
            yield pa.RecordBatch.from_arrays([pa.array(group.query[row]), pa.array(key), pa.array(score)], names=["query", "key", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    query: str = "query_id",
    query_text: str = "text",
    k: int = 10,
    max_terms: int | None = None,
) -> DataFrame:
    """``query_id, rank, doc_id, score`` (named as given): the k best documents of each query by BM25.

    A query is the set of its distinct words, or with ``max_terms`` of those with
    the highest count times inverse document frequency (of equal ones the first
    by word).  Words are runs of digits, letters A-Z (in lower case) and non-ASCII
    characters.  Statistics cover all of ``docs``; the result is exact, with ties
    broken by the smallest key.  Only documents that share a term are listed.

    Queries are broadcast against the index of all documents, ``QUERIES`` of them or ``TERMS`` terms at a time.

    Null and empty texts count as documents but are never found; queries with a
    null id, or without words, give no rows; documents with a null key count but
    are not listed; repeated rows are documents of their own, and repeated
    queries one query.  Empty tables give no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    blocks = index(docs, text, key)
    facts = blocks.agg(F.sum("docs").alias("n"), F.sum("words").alias("words"), F.countDistinct("part").alias("parts")).first()
    n_docs, words = facts["n"] or 0, facts["words"] or 0
    mean = max(words / n_docs if n_docs else 1.0, 1e-9)
    idf = F.log(1 + (n_docs - F.coalesce("n", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 0.5))
    chosen = query_terms(queries, query, query_text).join(frequencies(blocks), "term", "left")
    chosen = chosen.select("query", "term", "word", "count", idf.alias("idf"))
    if max_terms is not None:
        order = Window.partitionBy("query").orderBy(F.desc(F.col("count") * F.col("idf")), "word")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_terms)
    chosen = checkpoint(chosen.select("query", "term", "idf"))
    sizes = chosen.groupBy("query").count().agg(F.count("*").alias("n"), F.sum("count").alias("terms")).first()
    pieces = max(1, -(-sizes["n"] // QUERIES), -(-(sizes["terms"] or 0) // TERMS))
    slices = chosen.groupBy(F.pmod(F.xxhash64("query"), F.lit(pieces))).applyInArrow(packed, ", ".join(f"{name} binary" for name in Asked.FIELDS))
    held = [spark.sparkContext.broadcast({name: bytes(row[name]) for name in Asked.FIELDS}) for row in slices.toLocalIterator()]
    source = blocks.where("keys is not null")
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = math.isqrt(max(facts["parts"] - 1, 0)) + 1  # as many rows from the first partitions as from the others, about
    if facts["parts"] > FIRST:
        first = F.pmod(F.col("part"), F.lit(every)) == 0
        before = checkpoint(ranked(found(source.where(first), held, none, mean, k), k).drop("rank"))
        enough = before.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
        table = enough.select("query", "score").orderBy("query").toArrow()
        known = table["query"].to_numpy(), table["score"].to_numpy()
        best = ranked(before.unionByName(found(source.where(~first), held, known, mean, k)), k)
    else:
        best = ranked(found(source, held, none, mean, k), k)
    return best.select(
        F.col("query").alias(query), F.col("rank").cast("bigint").alias("rank"), F.col("key").alias(key), (F.col("score") / UNIT).alias("score")
    )
