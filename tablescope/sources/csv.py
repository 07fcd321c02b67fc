"""Delimited text source."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablescope.session import checkpoint, shared_folder

# fixed values: encodings and Spark's names for them.  Every byte sequence is
# valid Latin-1, so no other single-byte encoding is ever reached by trying.
ENCODINGS = {"utf-8": "utf-8", "latin1": "iso-8859-1", "utf-16": "utf-16"}
#: Control characters that may separate records; one that no text holds is taken.
SEPARATORS = ["\x1e", "\x1f", "\x1d", "\x1c", "\x01"]


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated column names get a running number: ``x, x_2, x_3``; names already taken are skipped over."""
    taken = set(names)
    seen: Counter = Counter()
    out = []
    for name in names:
        seen[name] += 1
        fresh = name
        if seen[name] > 1:
            number = seen[name]
            while f"{name}_{number}" in taken:
                number += 1
            fresh = f"{name}_{number}"
            taken.add(fresh)
        out.append(fresh)
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: the physical lines; those of one byte range follow one another in one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select(*place, "value")


def _inspect(lines: DataFrame) -> DataFrame:
    """One row per byte range: whether its quotes leave a field open, and what its text tells about the files.  Written once."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return checkpoint(
        lines.groupBy("file", "start").agg(
            (F.sum(quotes) % 2 == 1).alias("odd"),
            F.max(quotes % 2 == 1).alias("open_quote"),
            F.max(F.col("value").contains("\x00")).alias("wide"),
            F.max(~F.is_valid_utf8("value")).alias("broken"),
            F.max(F.col("value").rlike("\r.")).alias("inner_return"),
            *[F.max(F.col("value").contains(s)).alias(f"sep{i}") for i, s in enumerate(SEPARATORS)],
        )
    )


def _parity(splits: DataFrame) -> DataFrame:
    """``file, start, inside``: whether a byte range begins inside a quoted field, by the quotes of the ranges before it."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0))
    return splits.select("file", "start", (opened % 2 == 1).alias("inside"))


WHOLE, END, BEGIN, MIDDLE = range(4)  # a record, or the part of one that a byte range holds
PARTS = "file string, start bigint, kind int, header boolean, text string"


def _assemble(batches):
    """Lines of byte ranges to records; what belongs to a record of another range comes out as a part of it."""
    place, pending, begun, odd, header = None, [], True, False, False
    for batch in batches:
        files, starts, inside, values = (batch.column(c) for c in ("file", "start", "inside", "value"))
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        names, begins, insides = files.to_pylist(), starts.to_pylist(), inside.to_pylist()
        for name, begin, within, line, n in zip(names, begins, insides, values.to_pylist(), quotes.tolist()):
            if (name, begin) != place:
                if pending:
                    out.append((*place, BEGIN if begun else MIDDLE, header, "\n".join(pending)))
                place, pending, begun, odd, header = (name, begin), [], not within, within, begin == 0
            pending.append(line)
            odd ^= bool(n % 2)
            if not odd:
                out.append((*place, WHOLE if begun else END, header, "\n".join(pending)))
                pending, begun, header = [], True, False
        yield _parts(out)
    if pending:
        yield _parts([(*place, BEGIN if begun else MIDDLE, header, "\n".join(pending))])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("text", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``text``: the records of all files without the header records, line breaks in quoted fields kept.

    Each byte range is read by one task from the right state: the quotes before
    it tell whether it begins inside a field.  Records that cross ranges are put
    together from their parts, of which a range holds two at most.
    """
    # one row per byte range
    line = F.regexp_replace("value", "\r$", "").alias("value")  # a break in a field becomes a line feed, as in whole files
    placed = lines.join(F.broadcast(_parity(splits)), ["file", "start"]).select("file", "start", "inside", line)
    parts = checkpoint(placed.mapInArrow(_assemble, PARTS))
    broken = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = broken.withColumn("record", F.count(F.when(F.col("kind") == BEGIN, 1)).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    whole = numbered.groupBy("file", "record").agg(
        F.max("header").alias("header"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text")
    )
    found = parts.where(F.col("kind") == WHOLE).select("header", "text").unionAll(whole.select("header", "text"))
    return found.where("not header").select("text")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """A header-led CSV with inferred types and repaired column names.

    Text that is not valid UTF-8 is read as Latin-1, text with zero bytes as
    UTF-16.  Files are split across tasks.  If a quoted field spans lines, the
    records are put together range by range (``_records``) and written to the
    shared folder with a separator that no text holds; reading goes on from
    there, split as well.  Only UTF-16 files, and quoted fields over lines in
    files that end lines with a bare carriage return or hold every separator,
    take one task per file.
    """
    if encoding is not None and encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding must be one of {list(ENCODINGS)}")
    lines = _lines(spark, path)
    splits = _inspect(lines)
    names_ = [c for c in splits.columns if c not in ("file", "start", "odd")]
    seen = splits.agg(*[F.max(c).alias(c) for c in names_]).first()
    used = (encoding or ("utf-16" if seen["wide"] else "latin1" if seen["broken"] else "utf-8")).lower()
    free = [s for i, s in enumerate(SEPARATORS) if not seen[f"sep{i}"]]
    spans = bool(seen["open_quote"])
    if seen["inner_return"]:  # these returns may end lines
        short = spark.read.text(path).select((F.regexp_count("value", F.lit('"')) % 2 == 1).alias("open"))
        spans = bool(short.agg(F.max("open")).first()[0])
    assemble = spans and used != "utf-16" and not seen["inner_return"] and free
    multi_line = used == "utf-16" or (spans and not assemble)
    options = {"encoding": ENCODINGS[used], "escape": '"'}
    head = spark.read.options(**options, multiLine=str(multi_line or spans).lower()).option("header", "false").csv(path).first()
    if head is None:
        raise ValueError(f"{path} holds no header line")
    names = unique_names([v if v is not None else f"_c{i}" for i, v in enumerate(head)])
    if not assemble:
        body = spark.read.options(**options, multiLine=str(multi_line).lower(), header="true", inferSchema=str(infer).lower())
        return body.csv(path).toDF(*names)
    if used == "latin1":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), ENCODINGS[used]))
    place = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    _records(lines, splits).write.option("lineSep", free[0]).text(place)
    body = spark.read.options(escape='"', lineSep=free[0], inferSchema=str(infer).lower())
    # without any record there is nothing to infer from, and every column is text
    found = body.csv(place)
    return found.toDF(*names) if found.columns else body.schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(place).toDF(*names)
