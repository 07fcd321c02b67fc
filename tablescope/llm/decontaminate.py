"""Benchmark decontamination: normalised test n-grams are broadcast and every training window is looked up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.text import ALNUM, Words, col, extend, lists, lowered, tidy
from tablescope.session import checkpoint

WINDOW = 10
#: Windows in one broadcast; a larger benchmark is looked up in several passes.
SLICE_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NUMBERS = T.ArrayType(T.LongType(), False)
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", NUMBERS),
    T.StructField("hit_spans", NUMBERS),
    T.StructField("items", T.ArrayType(T.StringType(), False)),
]


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``words, items``: every distinct window of the item texts and the items that hold it."""
    words = F.regexp_extract_all(lowered(col(text)), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        benchmark.select(col(item).cast("string").alias("item"), words.alias("w"))
        .where("size(w) > 0")
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
    )


def slices(windows: DataFrame, most: int) -> Iterator[dict[str, list[str]]]:
    """The windows, about ``most`` of them at a time; at least one slice, which may be empty."""
    pieces = max(1, -(-windows.count() // most))
    for k in range(pieces):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(pieces)) == k)
        yield {r["words"]: sorted(r["items"]) for r in part.toLocalIterator()}


class Scanner:
    """Looks the windows of one slice up in a batch of texts."""

    def __init__(self, windows: dict[str, list[str]]):
        self.windows = {tuple(k.encode().split(b" ")): v for k, v in windows.items()}
        by_size: dict[int, list[str]] = {}
        for k in windows:
            by_size.setdefault(k.count(" ") + 1, []).append(k)
        self.known: dict[int, np.ndarray] = {}
        for size, found in by_size.items():
            words = Words(pa.array(found), ALNUM)
            self.known[size] = np.unique(words.runs(words.hashes(), size)[1])

    def __call__(self, texts: pa.Array, hit_before: pa.Array | None = None, items_before: pa.Array | None = None):
        words, n = Words(texts, ALNUM), len(texts)
        hashes = words.hashes()
        change = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, known in self.known.items():
            at, runs = words.runs(hashes, size)
            place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            for i in at[known[place] == runs]:
                said = tuple(words.data[a:b].tobytes() for a, b in zip(words.start[i : i + size], words.end[i : i + size]))
                if (owners := self.windows.get(said)) is not None:
                    change[i] += 1
                    change[i + size] -= 1
                    items.setdefault(int(words.doc[i]), set()).update(owners)
        hit = np.cumsum(change[:-1]) > 0
        if hit_before is not None:  # of an earlier pass
            owner = np.repeat(np.arange(n), pc.list_value_length(hit_before).to_numpy(zero_copy_only=False))
            hit[words.first[owner] + hit_before.flatten().to_numpy()] = True
            for i, old in enumerate(items_before.to_pylist()):
                if old:
                    items.setdefault(i, set()).update(old)
        place = np.flatnonzero(hit)
        opens, closes = hit.copy(), hit.copy()
        together = hit[1:] & hit[:-1] & (words.doc[1:] == words.doc[:-1])
        opens[1:] &= ~together
        closes[:-1] &= ~together
        spans = np.stack([words.start[opens], words.end[closes]], axis=1) - words.bounds[words.doc[opens]][:, None]
        return [
            pa.array(words.counts, pa.int64()),
            lists(place - words.first[words.doc[place]], np.bincount(words.doc[hit], minlength=n), pa.int64()),
            lists(spans.reshape(-1), 2 * np.bincount(words.doc[opens], minlength=n), pa.int64()),
            pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
        ]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_windows: int = SLICE_WINDOWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with what they share with the benchmark.

    Words are runs of digits, letters A-Z (in lower case) and non-ASCII
    characters.  A window is ``window`` consecutive item words, or all words of
    a shorter item.  Adds ``n_words``, ``hit_words`` (numbers of the words inside
    an occurrence of a window, from 0), ``hit_spans`` (their stretches as byte
    offsets: start, end, start, end and so on) and ``items`` (sorted names).

    The windows are broadcast ``slice_windows`` at a time; a larger benchmark
    takes more passes over the documents, never a larger broadcast.  A hash only
    proposes an occurrence: the words themselves are compared.

    A null or empty text has no words; repeated rows are judged alike; an empty
    benchmark, or items without words, hit nothing; an item without id hits but
    has no name; input columns with the names of results are replaced.
    """
    context = docs.sparkSession.sparkContext
    windows = checkpoint(benchmark_windows(benchmark, item, item_text, window))
    wanted = docs.columns if keep is None else keep
    result, also = docs, []
    for part in slices(windows, slice_windows):
        held = context.broadcast(part)
        source = checkpoint(result) if also else result
        result = extend(source, text, FIELDS, lambda held=held: Scanner(held.value), [*wanted, text], also)
        also = ["hit_words", "items"]
    return result if text in wanted else result.drop(text)


def cut(texts: list[str], spans: list[list[int]]) -> list[str]:
    """The texts without the given stretches of bytes; a blank stands where one was cut out."""
    out = []
    for text, at in zip(texts, spans):
        raw, kept, last = text.encode(), [], 0
        for a, b in zip(at[::2], at[1::2]):
            kept.append(raw[last:a].decode().rstrip(" "))
            last = b
        kept.append(raw[last:].decode().lstrip(" "))
        out.append(" ".join(kept).strip(" "))
    return out


def remove_spans(df: DataFrame, text: str, spans: str) -> DataFrame:
    """Cut stretches of bytes out of the texts and drop the column that names them."""
    rest = [c for c in df.columns if c not in (text, spans)]
    source = df.select(*[col(c) for c in rest], col(spans), col(text))
    schema = T.StructType([df.schema[c] for c in rest] + [df.schema[text]])

    def run(batches):
        for batch in batches:
            old, at = batch.columns[-1], batch.columns[-2]
            changed = pc.fill_null(pc.and_(pc.greater(pc.list_value_length(at), 0), pc.is_valid(old)), False)
            new = cut(old.filter(changed).to_pylist(), at.filter(changed).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pc.replace_with_mask(old, changed, pa.array(new, old.type))], names=schema.fieldNames()
            )

    return source.mapInArrow(tidy(run), schema).select(*[col(c) for c in df.columns if c != spans])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", most_hit: float = 0.5, **options
) -> DataFrame:
    """Cut the shared stretches out of the texts; drop documents of which more than ``most_hit`` of the words were hit.

    Columns are those of ``docs``.  Clean documents come back unchanged, null and
    empty texts among them.
    """
    found = find_contamination(docs.withColumn("__llm_scan", col(text)), benchmark, "__llm_scan", **options)
    found = found.where(F.size("hit_words") <= most_hit * F.col("n_words"))
    found = found.select(*[col(c) for c in docs.columns if c in found.columns], F.col("hit_spans").alias("__llm_spans"))
    return remove_spans(found, text, "__llm_spans")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
