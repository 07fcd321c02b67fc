"""Document fingerprints by winnowing: rolling hashes of k characters, of each window the rightmost minimum.

Two texts that share ``k + window - 1`` characters in a row share a selected
hash, and every selected hash stands for k characters of the text, at the place
kept with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.llm.text import col, without
from tablescope.session import checkpoint

GRAM = 16  # characters that are hashed together
WINDOW = 32  # hashes in a window
PIECE = 16384  # windows that are examined at a time, so that a long text takes no more memory
PRIME = 2**31 - 1
BASE = 911  # so small that two code points need no remainder yet
NEAR = 6  # hashes on either side that are looked at before a window's minimum
PLACES = 1 << 16  # more than a piece has places
BLOCK_BYTES = 128 << 20  # bytes of text in a block of neighbours, about


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def joined(values: Column, far: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``far`` places on; the last ones lack it."""
    return let(values, lambda x: F.zip_with(x, F.slice(x, F.lit(far + 1), F.greatest(F.size(x) - far, F.lit(0))), join))


def next_power(factor: Column) -> Callable[[Column, Column], Column]:
    return lambda a, b: (a * factor + b) % F.lit(PRIME)


def rolling(text: Column, gram: int) -> Column:
    """The polynomial hash of every ``gram`` characters in a row, joined from hashes of half as many.

    A text of fewer characters is hashed as if filled up with zeros.
    """
    filled = F.when(F.char_length(text) < gram, F.rpad(text, F.lit(gram), F.lit("\0"))).otherwise(text)
    chars = F.split(filled, "")
    if gram == 1:
        return F.transform(chars, lambda c: F.ascii(c).cast("bigint"))
    hashes, far = joined(chars, 1, lambda a, b: F.ascii(a) * F.lit(BASE).cast("bigint") + F.ascii(b)), 2
    while far < gram:
        hashes = joined(hashes, far, next_power(F.lit(pow(BASE, far, PRIME))))
        far *= 2
    return let(hashes, lambda x: F.slice(x, F.lit(1), F.size(x) - (gram - 1)))


def placed(hash_: Column, at: Column) -> Column:
    """A hash with its place: of equal hashes the rightmost is the smallest."""
    return hash_ * F.lit(PLACES) + (F.lit(PLACES - 1) - at)


def mark_of(hash_: Column, at: Column) -> Column:
    return F.shiftleft(at.cast("bigint"), 31).bitwiseOR(hash_)


def minima(hashes: Column, window: int) -> Column:
    """The smallest placed hash of every window, rightmost of equal ones; of all hashes if they are fewer."""
    far = 1
    while far < window:
        hashes = joined(hashes, far, lambda a, b: F.least(a, b))  # a missing neighbour counts for nothing
        far *= 2
    return F.array_distinct(let(hashes, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - (window - 1), F.lit(1)))))


def check(gram: int, window: int) -> None:
    if gram & (gram - 1) or window & (window - 1) or min(gram, window) < 1 or gram + window > 8192:
        raise ValueError("gram and window must be powers of two up to 4096")


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The selected hashes of a text, as ``place * 2^31 + hash`` in rising order; a null or empty text has none.

    A text of fewer hashes than a window is one window.
    """
    check(gram, window)

    def marked(part: Column) -> Column:
        found = minima(F.transform(rolling(part["text"], gram), placed), window)
        return F.transform(found, lambda m: mark_of(F.shiftright(m, 16), part["at"] + (F.lit(PLACES - 1) - m % PLACES)))

    found = F.flatten(F.transform(pieces(text, 0, F.lit(0), gram + window - 1), marked))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>"))))


def place(mark: Column) -> Column:
    return F.shiftright(mark, 31)


def hash_of(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit((1 << 31) - 1))


def united(one: Column | str, two: Column | str) -> Column:
    return F.array_sort(F.array_union(one, two))


def spelled(found: Column) -> Column:
    """A fingerprint as text: ``place:hash`` (hexadecimal) of all marks, comma-joined."""
    return F.array_join(F.transform(found, lambda m: F.concat(place(m).cast("string"), F.lit(":"), F.hex(hash_of(m)))), ",")


def likeness(one: Column, two: Column) -> Column:
    """Shared hashes by all hashes of two fingerprints; 1 if neither has any."""
    a, b = F.transform(one, hash_of), F.transform(two, hash_of)
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``fingerprint``: ``hash`` and ``at`` of what winnowing selects.

    Places count code points.  Null and empty texts have an empty fingerprint;
    equal texts have equal ones.  Repeated rows are treated alike; an empty table
    gives no rows; an input column named ``fingerprint`` is replaced.
    """
    kept = [c for c in without(docs, ["fingerprint"]) if keep is None or c in keep]
    found = marks(F.coalesce(col(text).cast("string"), F.lit("")), gram, window)
    pairs = F.transform(found, lambda m: F.struct(hash_of(m).alias("hash"), place(m).alias("at")))
    return docs.select(*[col(c) for c in kept], pairs.alias("fingerprint"))


def in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key, text, block, guest``: the rows dealt to blocks of neighbours by key and then text.

    Each block ends with the first row of the next one as a guest, the last block
    with the first row of all.  A task gets some whole blocks.
    """
    rows = docs.select(col(key).alias("key"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(8 * tasks, -(-size // BLOCK_BYTES))
    where = F.struct("key", "tie")
    # the first row of each of so many ranges: written once, since ranges are drawn from a sample
    dealt = rows.select("key", "tie").repartitionByRange(blocks, "key", "tie").withColumn("range", F.spark_partition_id())
    first = checkpoint(dealt.groupBy("range").agg(F.min(where).alias("first")))
    bounds = first.agg(F.array_sort(F.collect_list("first")).alias("bounds")).scalar()
    steps = F.array(*[F.lit(1 << k) for k in range(blocks.bit_length(), -1, -1)])
    found = rows.withColumn("bounds", bounds)
    reached = lambda at, step: F.when(F.get("bounds", at + step) <= where, at + step).otherwise(at)
    found = found.withColumn("block", F.aggregate(steps, F.lit(0), reached))
    own = F.struct("block", F.lit(False).alias("guest"))
    before = F.pmod(F.col("block") - 1, F.size("bounds")).alias("block")
    guest = F.when(F.get("bounds", F.col("block")) == where, F.struct(before, F.lit(True).alias("guest")))
    found = found.select("key", "tie", "text", F.explode(F.filter(F.array(own, guest), lambda x: x.isNotNull())).alias("at"))
    return found.select("key", "tie", "text", "at.*").repartition(max(tasks, blocks // 8), "block")


def pieces(text: Column, kind: int, at: Column, reach: int) -> Column:
    """A text cut for ``selected``: ``kind``, the place of the piece in its document, and the piece; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - reach, F.lit(0)), F.lit(PIECE))

    def piece(start: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (at + start).cast("bigint").alias("at"),
            F.substring(text, start + 1, F.lit(PIECE + reach - 1)).alias("text"),
        )

    none = F.array().cast("array<struct<kind:int,at:bigint,text:string>>")
    return F.when(text != "", F.transform(starts, piece)).otherwise(none)


def selected(rows: DataFrame, parts: str, gram: int, window: int) -> DataFrame:
    """One row for every mark of the pieces in the column ``parts``, which gives way to ``kind`` and ``mark``.

    Windows are rows here, so that their minima run in generated code; a window
    counts if its minimum is new: no smaller than its last hash, or greater than
    the hash that just left it.  Rows without pieces stay, with nulls.
    """
    carried = [c for c in rows.columns if c != parts]
    rows = rows.select(*carried, F.explode_outer(parts).alias("part"))
    text = F.col("part.text")
    rows = rows.select(*carried, "part.kind", "part.at", F.when(text.isNotNull(), rolling(text, gram)).alias("hashes"))
    last = F.greatest(F.size("hashes") - window, F.lit(0))
    windows = F.when(F.col("hashes").isNotNull(), F.sequence(F.lit(0), last))
    rows = rows.select(*carried, "kind", "at", "hashes", F.explode_outer(windows).alias("i"))
    i = F.col("i")
    inside = F.slice("hashes", i + 1, F.lit(window))
    least, newest, left = F.array_min(inside), F.get("hashes", i + (window - 1)), F.get("hashes", i - 1)
    # most windows are told apart by a few hashes next to the two that decide, without their minimum
    few = range(1, min(NEAR, window - 1) + 1)
    came = reduce(and_, [newest <= F.get("hashes", i + (window - 1 - k)) for k in few], F.lit(True))
    went = reduce(and_, [left < F.get("hashes", i + (k - 1)) for k in few], F.lit(True))
    # one comparison, so that the minimum is computed once: least >= newest or least > left
    rows = rows.where(i.isNull() | (i == 0) | ((came | went) & (least >= F.least(newest, left + 1))))
    from_end = F.array_position(F.reverse(inside), least)  # of equal hashes the rightmost
    return rows.select(*carried, "kind", mark_of(least, F.col("at") + i + F.size(inside) - from_end).alias("mark"))


def edited_fingerprints(
    docs: DataFrame, text: str = "text", key: str = "doc_id", share: int = 4, gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """How the fingerprint of each document holds against an edit and against its neighbour.

    The last ``floor(n / share)`` characters of each text are replaced by the
    first as many (or all) of the next document, by ascending key; the first one
    follows the last.  Returns the key, ``n_chars``, ``edited_sha256`` and the
    marks of the text, the edited text and the next document's text:
    ``text_marks``, ``edited_marks``, ``next_marks``.  The windows that lie before
    the edit are examined once for both texts.

    A null key comes first; rows with equal keys are in the order of a hash of
    their texts.  A null text is empty.  Repeated rows are neighbours.  An empty
    table gives no rows.
    """
    check(gram, window)
    reach = gram + window - 1
    order = Window.partitionBy("block").orderBy("guest", "key", "tie")
    rows = in_order(docs, text, key).withColumn("next", F.lead("text").over(order))
    size = F.char_length("text")
    rows = rows.withColumn("cut", size - F.floor(size / share).cast("int"))
    rows = rows.withColumn("from", F.greatest(F.col("cut") - (reach - 1), F.lit(0)))
    cut, start = F.col("cut"), F.col("from")
    rows = rows.withColumns(
        {
            "head": F.substring("text", F.lit(1), cut),
            "tail": F.substring("text", start + 1, size),
            "fill": F.coalesce(F.substring("next", F.lit(1), size - cut), F.lit("")),
        }
    )
    joint = F.concat(F.substring("text", start + 1, cut - start), "fill")
    joint = F.when(F.col("guest") | ((cut >= reach) & (F.col("fill") == "")), F.lit("")).otherwise(joint)
    before = F.when(cut >= reach, F.col("head")).otherwise(F.lit(""))
    rows = rows.select(
        *("block", "guest", "key", "tie"),
        F.monotonically_increasing_id().alias("row"),
        size.cast("bigint").alias("n_chars"),
        F.sha2(F.concat("head", "fill").cast("binary"), 256).alias("edited_sha256"),
        F.concat(
            pieces(before, 0, F.lit(0), reach), pieces(F.col("tail"), 1, start, reach), pieces(joint, 2, start, reach)
        ).alias("parts"),
    )
    found = selected(rows, "parts", gram, window)
    kinds = [F.collect_list(F.when(F.col("kind") == k, F.col("mark"))) for k in range(3)]
    same = ["block", "guest", "key", "tie", "row", "n_chars", "edited_sha256"]
    found = found.groupBy(*same).agg(*[k.alias(f"marks{i}") for i, k in enumerate(kinds)])
    found = found.withColumns({"text_marks": united("marks0", "marks1"), "edited_marks": united("marks0", "marks2")})
    follower = F.lead("text_marks").over(Window.partitionBy("block").orderBy("guest", "key", "tie", "row"))
    found = found.withColumn("next_marks", follower).where("not guest")
    return found.select(F.col("key").alias(key), "n_chars", "edited_sha256", "text_marks", "edited_marks", "next_marks")
