"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A byte ends a chunk where the rolling hash of the last 16 bytes has certain bits
zero, so cuts depend on the text around them only: after an insertion the cuts,
and with them the chunks, fall into step again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.decontaminate import remove_spans
from tablescope.llm.text import buffers, col, extend, numbers, parts
from tablescope.session import checkpoint

BITS = 4  # a candidate every 16 bytes or so
LEAST = 12  # a candidate this close behind another one is no cut
MOST = 1024  # a longer stretch is cut at multiples of this
RUN = 80  # bytes of repeated chunks in a row that make a repeated passage
SLOTS = 1 << 26  # of the bitmap that tells which chunks are worth sending
WINDOW = 16
GEAR = numbers(256, 11)
MASK = np.uint64(((1 << BITS) - 1) << (WINDOW - BITS))


def cuts(raw: np.ndarray) -> np.ndarray:
    """The ends of the chunks of one text."""
    if not len(raw):
        return np.zeros(0, np.int64)
    found = []
    step = 1 << 20
    for at in range(0, len(raw), step):  # each piece sees the window before it
        begin = max(0, at - WINDOW)
        h = GEAR[raw[begin : at + step]]
        shift = 1
        while shift < WINDOW:  # from here on the hash covers twice as many bytes
            h[shift:] += h[:-shift] << np.uint64(shift)
            shift *= 2
        ends = np.flatnonzero((h & MASK) == 0) + begin + 1
        found.append(ends[ends > at])
    ends = np.concatenate(found)
    ends = ends[np.diff(ends, prepend=-LEAST) >= LEAST]
    ends = np.append(ends[ends < len(raw)], len(raw))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        extra = [np.arange(e - g + MOST, e, MOST) for e, g in zip(ends, gaps) if g > MOST]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def chunked(texts: pa.Array):
    """The bytes, chunk ends and chunk digests of each text."""
    data, bounds = buffers(texts)
    for i in range(len(texts)):
        raw = data[bounds[i] : bounds[i + 1]]
        ends = cuts(raw)
        whole, start, found = raw.tobytes(), 0, []
        for end in ends.tolist():
            found.append(digest(whole[start:end]))
            start = end
        yield whole, ends, found


def short_hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def repeated_hashes(docs: DataFrame, text: str) -> DataFrame:
    """``hash``: the first 64 bits of the digests that occur in two or more texts, counted where they are read first."""

    def run(batches):
        for batch in batches:
            for a, b in parts(batch.column(0), 8 << 20):
                found = [np.unique(short_hashes(d)) for _, _, d in chunked(batch.column(0).slice(a, b - a))]
                values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(counts, 2).astype(np.int8))], names=["hash", "n"])

    made = docs.select(col(text).cast("string").alias("text")).mapInArrow(run, "hash bigint, n tinyint")
    return made.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for every slot that holds a hash: at most SLOTS bits, however many hashes there are."""
    slot = F.pmod("hash", F.lit(SLOTS)).alias("slot")
    words = hashes.select(slot).groupBy(F.expr("slot div 32").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 32, np.uint32)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bits


def occurrences(docs: DataFrame, key: str, text: str, hashes: DataFrame) -> DataFrame:
    """``key, row, at, size, digest`` of the chunks whose hash may be repeated; ``row`` is the digest of the text."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(hashes))
    source = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"))
    fields = [T.StructField("row", T.BinaryType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType())]
    schema = T.StructType([source.schema["key"], *fields, T.StructField("digest", T.BinaryType())])

    def run(batches):
        bits = held.value
        for batch in batches:
            for a, b in parts(batch.column(1)):
                owner, rows, at, size, digests = [], [], [], [], []
                for i, (whole, ends, found) in enumerate(chunked(batch.column(1).slice(a, b - a))):
                    if not found:
                        continue
                    slots = short_hashes(found) % SLOTS
                    there = np.flatnonzero(bits[slots // 32] >> (slots % 32).astype(np.uint32) & np.uint32(1))
                    sizes = np.diff(ends, prepend=0)
                    owner += [a + i] * len(there)
                    rows += [digest(whole)] * len(there)
                    at += (ends - sizes)[there].tolist()
                    size += sizes[there].tolist()
                    digests += [found[k] for k in there]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(rows, pa.binary()),
                        pa.array(at, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(digests, pa.binary()),
                    ],
                    names=schema.fieldNames(),
                )

    return source.mapInArrow(run, schema)


def joined_spans(chunks: list[dict], least: int) -> tuple[list[int], list[int]]:
    """Stretches of adjacent chunks that are ``least`` bytes or longer, and the stretches in them to cut out."""
    repeats: list[int] = []
    later: list[int] = []
    run: list[tuple[int, int, bool]] = []
    for at, size, again in [*((c["at"], c["size"], c["again"]) for c in chunks), (-1, 0, False)]:
        if run and at != run[-1][0] + run[-1][1]:
            start, end = run[0][0], run[-1][0] + run[-1][1]
            if end - start >= least:
                repeats += [start, end]
                for a, n, repeated in run:
                    if repeated and later and later[-1] == a:
                        later[-1] = a + n
                    elif repeated:
                        later += [a, a + n]
            run = []
        run.append((at, size, again))
    return repeats, later


def find_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = RUN, keep: list[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with the passages that other documents have too.

    Texts are cut into chunks by their content.  A chunk is repeated if rows with
    another key or another text hold it; ``least`` bytes of repeated chunks in a
    row make a passage.  Adds ``n_chunks``, ``repeats`` (the passages as byte
    offsets: start, end, start, end and so on) and ``later`` (those parts of them
    that occur in a row with a smaller key already, or an equal text).

    Chunks are counted by a short hash where they are read; a bitmap of fixed
    size then keeps most chunks that occur once from being sent, and whole
    digests decide.

    A null or empty text has no chunks.  A null key comes before all others.
    Repeated rows are one document and have the same result.  Repeats within one
    document do not count.  An empty table gives no rows.  Input columns with the
    names of results are replaced.
    """
    hashes = checkpoint(repeated_hashes(docs, text))
    met = occurrences(docs, key, text, hashes)
    owner = F.struct("key", "row")
    ends = met.groupBy("digest").agg(F.min(owner).alias("first"), F.max(owner).alias("last")).where("not (first <=> last)")
    again = ~owner.eqNullSafe(F.col("first"))
    both = met.join(ends.select("digest", "first"), "digest").select("key", "row", F.struct("at", "size", again.alias("again")).alias("c"))
    whole = both.groupBy("key", "row").agg(F.sort_array(F.collect_set("c")).alias("chunks"))
    numbers_ = T.ArrayType(T.LongType(), False)
    schema = T.StructType([whole.schema["key"], whole.schema["row"], T.StructField("repeats", numbers_), T.StructField("later", numbers_)])

    def spans(batches):
        for batch in batches:
            found = [joined_spans(c, least) for c in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))],
                names=schema.fieldNames(),
            )

    found = whole.mapInArrow(spans, schema).withColumnsRenamed({"key": "__llm_k", "row": "__llm_r"})

    def make():
        def work(texts):
            rows = list(chunked(texts))
            return [pa.array([len(e) for _, e, _ in rows], pa.int64()), pa.array([digest(w) for w, _, _ in rows], pa.binary())]

        return work

    names = ("n_chunks", "repeats", "later")
    shown = [c for c in docs.columns if c.lower() not in names and (keep is None or c in keep)]
    rows = docs.select(*[col(c) for c in {*shown, text}], col(key).alias("__llm_key"))
    fields = [T.StructField("n_chunks", T.LongType()), T.StructField("__llm_row", T.BinaryType())]
    rows = extend(rows, text, fields, make, [*shown, "__llm_key"])
    same = rows["__llm_key"].eqNullSafe(found["__llm_k"]) & (rows["__llm_row"] == found["__llm_r"])
    none = F.array().cast("array<bigint>")
    out = rows.join(found, same, "left")
    return out.select(
        *[col(c) for c in shown], "n_chunks", F.coalesce("repeats", none).alias("repeats"), F.coalesce("later", none).alias("later")
    )


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = RUN) -> DataFrame:
    """Cut the later occurrences of repeated passages out of the texts; the columns and rows stay as they are."""
    found = find_repeats(docs.withColumn("__llm_scan", col(text)), "__llm_scan", key, least)
    found = found.select(*[col(c) for c in docs.columns], F.col("later").alias("__llm_spans"))
    return remove_spans(found, text, "__llm_spans")


def covered(spans: Column) -> Column:
    """The bytes in stretches given as start, end, start, end and so on."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda total, x: total + x)
