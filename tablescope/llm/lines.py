"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablescope.llm.text import col
from tablescope.session import checkpoint

MIN_SITES = 10
LG_K = 12  # 4,096 registers: a relative standard error of about 1.6 %
BAND = 0.1  # six standard errors: sketches beyond it are trusted


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def digest(line: Column) -> Column:
    """128 bits of the line without the ASCII white space around it; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def spread(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """``line, sketch``: a sketch of the sites of every distinct non-blank line.

    Lines are sketched where they are read; only sketches are shuffled and
    merged.  Rows without a site do not count.
    """
    lines = F.explode(F.array_distinct(F.transform(lines_of(col(text)), digest)))
    rows = docs.where(col(site).isNotNull()).select(col(site).cast("string").alias("site"), lines.alias("line"))
    return rows.where("line is not null").groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``line``: digests of the lines that occur at ``min_sites`` or more distinct sites.

    A sketch decides where its estimate is farther than ``BAND`` from the
    threshold; the sites of all other lines are counted exactly.
    """
    sites = F.hll_sketch_estimate("sketch")
    near = spread(docs, text, site).select("line", sites.alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND))
    near = checkpoint(near)
    sure = near.where(F.col("sites") > min_sites * (1 + BAND)).select("line")
    unsure = near.where(F.col("sites") <= min_sites * (1 + BAND)).select("line")
    lines = F.explode(F.array_distinct(F.transform(lines_of(col(text)), digest)))
    rows = docs.where(col(site).isNotNull()).select(col(site).cast("string").alias("site"), lines.alias("line"))
    counted = rows.join(unsure, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return sure.unionByName(exact)


def copies(docs: DataFrame, text: str, key: Column) -> DataFrame:
    """``__llm_key, __llm_copy``: the keys of texts whose non-blank lines are those of another row."""
    whole = F.md5(F.array_join(F.transform(F.filter(F.transform(lines_of(col(text)), digest), lambda x: x.isNotNull()), F.hex), ","))
    texts = docs.where(col(text).isNotNull()).select(key.alias("__llm_key"), whole.alias("whole"))
    texts = texts.groupBy("__llm_key", "whole").agg(F.count("*").alias("n"))
    shared = texts.groupBy("whole").agg(F.sum("n").alias("n")).where("n > 1").select("whole")
    return texts.join(shared, "whole", "left_semi").select("__llm_key", F.lit(True).alias("__llm_copy"))


def remove_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    most: float = 1.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``clean``, ``n_lines`` and ``n_removed``.

    ``clean`` is the text without the lines that occur, white space around them
    aside, at ``min_sites`` or more distinct sites; blank lines stay.  A text
    that loses nothing is unchanged, and so is one that would lose more than the
    share ``most`` of its characters and is a copy: its non-blank lines, white
    space around them aside, are those of another row in the same order.

    A null text stays null and counts one line; rows without a site have their
    lines removed but do not count for the spread; repeated rows are treated
    alike; an empty table gives no rows.  Input columns with the names of
    results are replaced.
    """
    bad = checkpoint(boilerplate(docs, text, site, min_sites))
    names = ["clean", "n_lines", "n_removed"]
    kept = [c for c in docs.columns if c.lower() not in names and (keep is None or c in keep)]
    text_key = lambda: F.unhex(F.md5(col(text).cast("binary")))
    # which distinct texts hold which boilerplate lines; the texts themselves are not shuffled for that
    held = docs.select(text_key().alias("__llm_key"), F.explode(F.array_distinct(F.transform(lines_of(col(text)), digest))).alias("line"))
    held = held.where("line is not null").join(bad, "line").groupBy("__llm_key").agg(F.collect_set("line").alias("__llm_bad"))
    if most < 1:
        held = held.join(copies(docs, text, text_key()), "__llm_key", "left")
    else:
        held = held.withColumn("__llm_copy", F.lit(False))
    rows = docs.select(*[col(c) for c in kept], col(text).alias("__llm_text"), text_key().alias("__llm_key"))
    rows = rows.join(held, "__llm_key", "left")
    lines = lines_of(F.col("__llm_text"))
    good = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__llm_bad", digest(x)), F.lit(False)))
    left = F.char_length(F.array_join(good, "\n"))
    touched = F.col("__llm_bad").isNotNull() & (
        ~F.coalesce("__llm_copy", F.lit(False)) | (left >= (1 - most) * F.char_length("__llm_text"))
    )
    clean = F.when(touched, F.array_join(good, "\n")).otherwise(F.col("__llm_text"))
    removed = F.when(touched, F.size(lines) - F.size(good)).otherwise(0)
    return rows.select(
        *[col(c) for c in kept],
        clean.alias("clean"),
        F.size(lines).cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"),
    )
