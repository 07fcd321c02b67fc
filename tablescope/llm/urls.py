"""URL filters: a sorted sweep over reversed-host keys keeps a stack of the rules that enclose the current host."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.text import col, lowered, without

#: Rules in one broadcast; more rules take more sweeps over the same sorted rows.
SLICE_RULES = 200_000
BEST = T.StructType(
    [
        T.StructField("host_size", T.IntegerType()),
        T.StructField("path_size", T.IntegerType()),
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ]
)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels from right to left, each ended by a dot: a domain's key is a prefix of its subdomains' keys."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """Gets keys in ascending order; ``stack`` holds the rule hosts that enclose the last one, outermost first."""

    def __init__(self, nodes: list[tuple[bytes, dict[str, tuple[str, str]]]]):
        self.keys = [k for k, _ in nodes]
        self.paths = [sorted(p.items(), key=lambda x: (-len(x[0]), x[0])) for _, p in nodes]
        self.at, self.last = None, None
        self.stack: list[int] = []

    def move(self, key: bytes) -> None:
        if key == self.last:
            return
        self.last = key
        if self.at is None:  # nothing before the first label can enclose this key
            self.at = bisect_left(self.keys, key[: key.find(b".") + 1])
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            while self.stack and not self.keys[self.at].startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            self.stack.append(self.at)
            self.at += 1
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        """The fitting rule with the longest host and then the longest path."""
        for i in reversed(self.stack):
            for start, (rule, verdict) in self.paths[i]:
                if path.startswith(start):
                    return len(self.keys[i]), len(start), rule, verdict
        return None


def slices(rules: DataFrame, most: int) -> Iterator[list]:
    """The rules by host key, about ``most`` of them at a time; at least one slice, which may be empty."""
    pieces = max(1, -(-rules.count() // most))
    for k in range(pieces):
        nodes: dict[bytes, dict] = {}
        for r in rules.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == k).toLocalIterator():
            nodes.setdefault(r["key"].encode(), {})[r["path"]] = (r["host"] + r["path"], r["verdict"])
        yield sorted(nodes.items())


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    slice_rules: int = SLICE_RULES,
) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and
    all subdomains of it where the url's path starts with the rule's path.  The
    longest host wins, then the longest path; without a fitting rule the rule is
    null and the verdict is ``default``.

    Rows are ranged by reversed host and, within a host, by a hash of the row, so
    one host's rows spread over as many tasks as they fill; each task sweeps its
    sorted rows and keeps only the enclosing rules.

    A null url or one without ``://`` has an empty host and path and fits no
    rule.  Rules without a host or verdict are ignored, a null path is empty, and
    of rules with equal host and path ``block`` wins over ``allow`` (the largest
    verdict).  Repeated rows stay; empty tables give no rows or the default;
    input columns with the names of results are replaced.
    """
    names = ["host", "path", "rule", "verdict"]
    kept = without(pages, names)
    known = rules.select(
        lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> '' and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    address = col(url)
    rows = pages.select(
        *[col(c) for c in kept],
        host_of(address).alias("host"),
        path_of(address).alias("path"),
        F.lit(None).cast(BEST).alias("__llm_best"),
    )
    rows = rows.withColumn("__llm_key", host_key(F.col("host")).cast("binary"))
    salt = F.xxhash64(*[col(c) for c in kept if not isinstance(pages.schema[c].dataType, T.MapType)], "path")
    rows = rows.repartitionByRange("__llm_key", salt).sortWithinPartitions("__llm_key")
    context = pages.sparkSession.sparkContext
    for part in slices(known, slice_rules):
        rows = rows.mapInArrow(swept(context.broadcast(part)), rows.schema)
    best = F.col("__llm_best")
    return rows.select(
        *[col(c) for c in kept],
        "host",
        "path",
        best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )


def swept(nodes):
    """A sweep of sorted rows with one slice of the rules; it keeps an earlier slice's rule where that is longer."""

    def run(batches):
        sweep = Sweep(nodes.value)
        for batch in batches:
            keys, paths = batch.column("__llm_key").to_pylist(), batch.column("path").to_pylist()
            found = []
            for key, path, old in zip(keys, paths, batch.column("__llm_best").to_pylist()):
                sweep.move(key)
                new = sweep.best(path)
                old = old and (old["host_size"], old["path_size"], old["rule"], old["verdict"])
                pick = max((x for x in (old, new) if x), default=None)
                found.append(pick and dict(zip(("host_size", "path_size", "rule", "verdict"), pick)))
            at = batch.schema.get_field_index("__llm_best")
            best = pa.array(found, batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), best)

    return run
