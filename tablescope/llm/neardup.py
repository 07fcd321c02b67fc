"""MinHash near-duplicates found by a multi-index Hamming join and confirmed on full shingle sets.

1. Every text becomes its set of distinct shingles, a digest of that set and a
   signature of ``symbols`` b-bit MinHash values (b = 16).  Texts with one set
   are one class.
2. The signature is split into ``chunks``.  Two signatures that differ in at most
   ``distance`` symbols differ in at most ``distance // chunks`` symbols of some
   chunk, so they agree in one of the enumerated selections of that chunk that
   leave as many symbols out.  Every selection is a key.
3. Shingles that no other class with a shared key has are counted.  They bound
   every intersection, so classes with too many of them are linked with nothing.
4. Of each key the class with the smallest share of such shingles is the center:
   in a group of edited copies, the original.  Each class is confirmed against
   the center with which it shares most keys.  That merges large groups in
   linear work.
5. Of the keys whose classes are still apart, members with different labels are
   compared by signature and bound in blocks of bounded size; what remains is
   confirmed on full sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.text import NOT_SPACE, Words, col, extend, lists, mix, numbers, parts as pieces, tidy
from tablescope.operators.graph import merged_components
from tablescope.session import checkpoint

BLOCK = 512  # members of a key in one block of signature comparisons
SPREAD = 256  # members that are confirmed against one class in a task
SLOTS = 1 << 24  # of the bitmap that tells which sets are worth sending
TASK_LINKS = 1 << 18  # links that one task merges
PAIRS = 1 << 17  # signature pairs compared at a time


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each text, and the set sizes."""
    words = Words(texts, NOT_SPACE)
    hashes = words.hashes()
    at, runs = words.runs(hashes, size)
    doc = words.doc[at]
    for n in range(1, size):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(words.counts == n)
        first = words.first[short]
        value = np.full(len(short), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x2545F4914F6CDD1D) + hashes[first + k]
        runs, doc = np.concatenate([runs, mix(value)]), np.concatenate([doc, short])
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[fresh], np.bincount(doc[fresh], minlength=len(texts))


def set_digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that depend on the set alone; null for an empty set."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    halves = []
    for seed in (0x1B873593, 0xCC9E2D51):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)))])
        halves.append(mix(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64)))
    raw = np.stack(halves, axis=1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)]


def signatures(values: np.ndarray, sizes: np.ndarray, symbols: int) -> np.ndarray:
    """One row of 16-bit MinHash symbols for each set; zeros for an empty set."""
    out = np.zeros((len(sizes), symbols), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        flips, factors = numbers(symbols, 2), numbers(symbols, 3) | np.uint64(1)
        for k in range(symbols):
            least = np.minimum.reduceat((values ^ flips[k]) * factors[k], first)
            out[full, k] = mix(least).astype(np.uint16)
    return out


def selections(symbols: int, chunks: int, errors: int) -> list[np.ndarray]:
    """The symbols of every chunk that are left when ``errors`` of its symbols are left out."""
    found = []
    for part in np.array_split(np.arange(symbols), chunks):
        found += [np.array(c) for c in combinations(part, max(len(part) - errors, 1))]
    return found


def farthest(symbols: int, percent: int, miss: float = 1e-6) -> int:
    """The number of differing symbols that a pair at the threshold exceeds with a chance below ``miss``."""
    p, left = 1 - percent / 100, 1.0
    for d in range(symbols + 1):
        left -= comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if left < miss:
            return d
    return symbols


class Join:
    """The parameters of one near-duplicate run."""

    def __init__(self, text: str, shingle: int, percent: int, symbols: int, chunks: int, distance: int):
        self.text, self.shingle, self.percent = text, shingle, percent
        self.symbols, self.chunks, self.distance = symbols, chunks, distance

    def scan(self, docs: DataFrame, keep: list[str], signed: bool) -> DataFrame:
        """``keep`` with ``n_shingles``, ``node`` (the digest of the set) and, if ``signed``, its ``signature``."""
        size, symbols = self.shingle, self.symbols

        def make():
            def work(texts):
                values, sizes = shingle_sets(texts, size)
                out = [pa.array(sizes, pa.int64()), pa.array(set_digests(values, sizes), pa.binary())]
                if signed:
                    out.append(pa.array([r.tobytes() for r in signatures(values, sizes, symbols)], pa.binary()))
                return out

            return work

        fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType())]
        return extend(docs, self.text, fields + [T.StructField("signature", T.BinaryType())] * signed, make, keep)

    def keys(self, classes: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
        """``pick, key, node``: a row for every class and selection, without keys whose slot in ``bits`` is empty."""
        held = None if bits is None else classes.sparkSession.sparkContext.broadcast(bits)
        chosen = selections(self.symbols, self.chunks, self.distance // self.chunks)
        symbols = self.symbols

        def run(batches):
            for batch in batches:
                rows = np.array([np.frombuffer(x, np.uint16) for x in batch.column("signature").to_pylist()], np.uint64)
                rows = rows.reshape(-1, symbols)
                out = np.empty((len(rows), len(chosen)), np.uint64)
                for i, places in enumerate(chosen):
                    value = np.full(len(rows), i + 1, np.uint64)
                    for k in places:
                        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + rows[:, k])
                    out[:, i] = value
                slot = out % np.uint64(SLOTS)
                there = np.ones(out.shape, bool) if held is None else taken(held.value, slot)
                sizes = there.sum(axis=1)
                picks = np.broadcast_to(np.arange(len(chosen), dtype=np.int32), out.shape)
                keys = lists(out[there].view(np.int64), sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists(picks[there], sizes, pa.int32()), keys], names=["node", "picks", "keys"])

        found = classes.select("node", "signature").mapInArrow(tidy(run), "node binary, picks array<int>, keys array<bigint>")
        single = found.select(F.explode(F.arrays_zip("picks", "keys")).alias("k"), "node")
        return single.select(F.col("k.picks").alias("pick"), F.col("k.keys").alias("key"), "node")

    def sets(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """``node, values``: the sets of the given nodes, made anew from the texts.

        A bitmap of fixed size keeps most other sets from being sent; a join
        drops the rest.
        """
        slot = F.pmod(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint"), F.lit(SLOTS))
        held = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select(slot.alias("slot"))))
        size = self.shingle

        def run(batches):
            seen: set[bytes] = set()
            for batch in batches:
                for at, to in pieces(batch.column(0)):
                    values, sizes = shingle_sets(batch.column(0).slice(at, to - at), size)
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    found, packed = [], []
                    for i, node in enumerate(set_digests(values, sizes)):
                        if node is not None and node not in seen and listed(held.value, node):
                            seen.add(node)
                            found.append(node)
                            packed.append(values[ends[i] : ends[i + 1]].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.array(packed, pa.binary())], names=["node", "values"]
                    )

        made = docs.select(col(self.text).cast("string").alias("text")).mapInArrow(tidy(run), "node binary, values binary")
        return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def confirm(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs with the ``common`` shingles of their full sets and whether those make them ``similar`` enough.

        Each set is sent to the tasks of its right partners; a partner with many
        pairs has as many tasks as they need.
        """
        parts = pairs.groupBy("right").agg(F.ceil(F.count("*") / SPREAD).alias("parts"))
        left = pairs.join(parts, "right").select(
            F.col("left").alias("node"),
            F.col("right").alias("group"),
            F.pmod(F.xxhash64("left"), F.col("parts")).alias("part"),
            F.lit(1).alias("role"),
        )
        right = parts.select(
            F.col("right").alias("node"),
            F.col("right").alias("group"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
            F.lit(0).alias("role"),
        )
        percent = self.percent

        def compare(batches):
            center: dict = {}
            for batch in batches:
                a, b, n, linked = [], [], [], []
                groups, nodes, roles = (batch.column(c).to_pylist() for c in ("group", "node", "role"))
                for group, node, role, raw in zip(groups, nodes, roles, batch.column("values")):
                    values = np.frombuffer(raw.as_buffer(), np.uint64)
                    if role == 0:
                        center = {group: values.copy()}
                    elif (other := center.get(group)) is not None:
                        place = np.minimum(np.searchsorted(other, values), len(other) - 1)
                        common = int((other[place] == values).sum())
                        a.append(node)
                        b.append(group)
                        n.append(common)
                        linked.append(100 * common >= percent * (len(values) + len(other) - common))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(linked, pa.bool_())],
                    names=["left", "right", "common", "similar"],
                )

        met = sets.join(left.unionByName(right), "node").repartition("group", "part").sortWithinPartitions("group", "part", "role")
        return met.mapInArrow(tidy(compare), "left binary, right binary, common bigint, similar boolean")

    def linkable(self, sets: DataFrame) -> DataFrame:
        """``node, n, common`` of the sets that may be linked at all.

        ``common`` counts the shingles that another set has too; no intersection
        is larger.
        """

        def run(batches):
            for batch in batches:
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("values")]
                at = np.repeat(np.arange(len(values)), [len(v) for v in values])
                for i in range(0, len(at), 1 << 19):
                    some = at[i : i + (1 << 19)]
                    rows = np.concatenate(values)[i : i + len(some)] if len(values) > 1 else values[0][i : i + len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("node").take(pa.array(some))], names=["value", "node"])

        single = sets.mapInArrow(tidy(run), "value bigint, node binary").groupBy("value").agg(F.count("*").alias("n"), F.first("node").alias("node"))
        own = single.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
        sizes = sets.select("node", (F.octet_length("values") / 8).cast("bigint").alias("n")).join(own, "node", "left")
        found = sizes.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
        return found.where(100 * F.col("common") >= self.percent * F.col("n"))


def bitmap(slots: DataFrame) -> np.ndarray:
    """A bit for every ``slot`` (below SLOTS): at most SLOTS bits, however many rows there are."""
    words = slots.groupBy(F.expr("slot div 32").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 32, np.uint32)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bits


def taken(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bits of the slots are set."""
    return (bits[slots // np.uint64(32)] >> (slots % np.uint64(32)).astype(np.uint32) & np.uint32(1)).astype(bool)


def listed(bits: np.ndarray, node: bytes) -> bool:
    slot = int.from_bytes(node[:4], "big") % SLOTS
    return bool(bits[slot // 32] >> np.uint32(slot % 32) & np.uint32(1))


def close_pairs(join: Join):
    """Pairs of left and right members of each block that may be linked and have different labels.

    They lie within the distance, and the bounds of their intersection suffice:
    neither has more shingles in common with others, and of two members with one
    center neither more of the center's nor more common ones beyond it.  A pair
    is given in the first of its keys only.  Rows come sorted by block; a block's
    members are bounded, so only the unfinished block is kept between batches.
    """
    distance, percent, symbols = join.distance, join.percent, join.symbols
    chosen = selections(symbols, join.chunks, distance // join.chunks)

    def pairs(block, side):
        """Index pairs of left and right members of one block, about PAIRS of them at a time."""
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        kinds = np.unique(block)
        ends = [np.searchsorted(block[x], kinds, how) for x in (left, right) for how in ("left", "right")]
        lefts, rights, n = [], [], 0
        for a, b, c, d in zip(*ends):
            step = max(1, PAIRS // max(d - c, 1))
            for at in range(a, b, step) if d > c else ():
                some = left[at : min(at + step, b)]
                lefts.append(np.repeat(some, d - c))
                rights.append(np.tile(right[c:d], len(some)))
                n += len(lefts[-1])
                if n >= PAIRS:
                    yield np.concatenate(lefts), np.concatenate(rights)
                    lefts, rights, n = [], [], 0
        if n:
            yield np.concatenate(lefts), np.concatenate(rights)

    def work(table: pa.Table):
        nodes = table.column("node").to_pylist()
        names = {x: i for i, x in enumerate(dict.fromkeys(table.column("label").to_pylist()))}
        label = np.array([names[x] for x in table.column("label").to_pylist()])
        rows = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, symbols)
        block = table.column("block").to_numpy()
        centers = {x: i for i, x in enumerate(dict.fromkeys(table.column("own_center").to_pylist()))}
        center = np.array([centers[x] for x in table.column("own_center").to_pylist()])
        side, pick, n, common, held = (table.column(c).to_numpy() for c in ("side", "pick", "n", "common", "held"))
        found: set[tuple[bytes, bytes]] = set()
        for i, j in pairs(block, side):
            most = np.minimum(common[i], common[j])
            beyond = np.minimum(held[i], held[j]) + np.minimum(common[i] - held[i], common[j] - held[j])
            most = np.where(center[i] == center[j], np.minimum(most, beyond), most)
            near = (label[i] != label[j]) & (100 * most >= percent * (n[i] + n[j] - most))
            i, j = i[near], j[near]
            same = rows[i] == rows[j]
            near = same.sum(axis=1) >= symbols - distance
            i, j, same = i[near], j[near], same[near]
            first = np.full(len(i), len(chosen))
            for k in range(len(chosen) - 1, -1, -1):
                first[same[:, chosen[k]].all(axis=1)] = k
            own = first == pick[i]
            found.update((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in zip(i[own], j[own]))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["left", "right"])

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table]).combine_chunks()
            block = table.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1])) if len(block) else 0
            kept = table.slice(cut)
            if cut:
                yield work(table.slice(0, cut))
        if kept is not None and kept.num_rows:
            yield work(kept)

    return run


def blocks(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Deal the members of each key to blocks: ``block, side`` and what is known of the member, with its signature from ``signed``.

    ``major`` members have the label of the key's center and are compared
    with the others only, which are also compared among themselves.  A major
    member is repeated once per block of others, so a huge merged group with few
    others costs no more than its size.
    """
    minor = F.coalesce(F.sum(F.when(~F.col("major"), 1)), F.lit(0))
    sizes = members.groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") - minor, F.lit(1)) / BLOCK).alias("majors"),
        F.ceil(F.greatest(minor, F.lit(1)) / BLOCK).alias("minors"),
    )
    zero = F.lit(0).cast("bigint")
    dealt = members.join(sizes, "key").join(signed, "node")
    spot = F.xxhash64("node")
    own = F.pmod(spot, F.col("minors"))
    every = F.sequence(zero, F.col("minors") - 1)

    def place(kind: int, i, j, side: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(side).alias("side"))

    major_rows = F.transform(every, lambda j: place(0, F.pmod(spot, F.col("majors")), j, 0))
    minor_rows = F.concat(
        F.transform(F.sequence(zero, F.col("majors") - 1), lambda i: place(0, i, own, 1)),
        F.transform(F.filter(every, lambda j: j >= own), lambda j: place(1, own, j, 0)),
        F.transform(F.filter(every, lambda i: i <= own), lambda i: place(1, i, own, 1)),
    )
    known = ["pick", "node", "label", "signature", "n", "common", "own_center", "held"]
    rows = dealt.select(
        "key", *known, F.explode(F.when(F.col("major"), major_rows).otherwise(minor_rows)).alias("p")
    )
    block = F.xxhash64("key", "p.kind", "p.i", "p.j").alias("block")
    return rows.select(block, F.col("p.side").alias("side"), *known)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shingle: int = 5,
    percent: int = 80,
    symbols: int = 64,
    distance: int | None = None,
    chunks: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with their near-duplicate component.

    Texts are linked where ``100 * common >= percent * all`` of their distinct
    shingles of ``shingle`` words (A-Z in lower case, split at ASCII white
    space).  Adds ``n_shingles``, ``component_id`` (the smallest key reachable
    over links) and ``kept`` (the row's key is that).

    All pairs whose signatures differ in at most ``distance`` of ``symbols``
    places are examined; by default so many that a pair at the threshold differs
    more with a chance below 1e-6.  By default there are so many ``chunks`` that
    one of them differs in at most one place.  Links are confirmed on full sets.

    A text without words, or null, has no shingles, is linked with nothing and
    kept.  A text with fewer words than a shingle is one shingle.  Rows with a
    null key take part with their text but never name a component; they are kept
    only if nothing else in their component has a key.  Repeated rows have the
    same result.  An empty table gives no rows.  Input columns with the names of
    results are replaced.
    """
    distance = farthest(symbols, percent) if distance is None else distance
    chunks = distance // 2 + 1 if chunks is None else chunks
    join = Join(text, shingle, percent, symbols, chunks, distance)
    wanted = docs.columns if keep is None else keep
    held = checkpoint(join.scan(docs.select(col(key).alias("__llm_key"), col(text)), ["__llm_key"], True))
    full = held.where("node is not null")
    classes = full.groupBy("node").agg(F.min("__llm_key").alias("first"), F.first("signature").alias("signature"))
    classes = checkpoint(classes)
    found = components(join, docs, classes)
    named = found.join(classes.select("node", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = checkpoint(named.select("node", "component").join(least, "component").select("node", "component_id"))
    shown = [c for c in wanted if c.lower() not in ("n_shingles", "component_id", "kept")]
    if wanted == [key]:  # nothing else is asked for, so the texts need not be read again
        rows = held.drop("signature")
    else:
        rows = join.scan(docs.withColumn("__llm_key", col(key)), [*shown, "__llm_key"], False)
    out = rows.join(names, "node", "left")
    name = F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("__llm_key")))
    kept = F.coalesce(F.col("__llm_key") == name, name.isNull())
    source = {key: "__llm_key"} if wanted == [key] else {}
    columns = [col(source.get(c, c)).alias(c) for c in shown]
    return out.select(*columns, "n_shingles", name.alias("component_id"), kept.alias("kept"))


def components(join: Join, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, component`` for the classes that share a key with another one, and for the rest."""
    keys = join.keys(classes)
    # a class has a key once, so counting rows finds the shared ones; no digest is sent for it
    ends = checkpoint(keys.select("key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # a bitmap of fixed size keeps most other keys from being sent; the join drops the rest
    bits = bitmap(ends.select(F.pmod("key", F.lit(SLOTS)).alias("slot")))
    shared = checkpoint(join.keys(classes, bits).join(ends, "key"))
    sets = checkpoint(join.sets(docs, checkpoint(shared.select("node").distinct())))
    shared = checkpoint(shared.join(join.linkable(sets), "node"))
    order = F.struct((1 - F.col("common") / F.col("n")).alias("own"), "node")
    centers = shared.groupBy("key").agg(F.min(order)["node"].alias("center"), F.max("node").alias("b"), F.min("node").alias("a"))
    shared = checkpoint(shared.join(centers.where("a <> b").select("key", "center"), "key"))
    # the center that is met in most keys
    votes = shared.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("n"))
    best = votes.groupBy("node").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
    stars = checkpoint(join.confirm(sets, checkpoint(best.select(F.col("node").alias("left"), F.col("center").alias("right")))))
    first = merged_components(shared.select("node").distinct(), stars.where("similar").select("left", "right"), TASK_LINKS)
    own = stars.select(F.col("left").alias("node"), F.col("right").alias("own_center"), F.col("common").alias("held"))
    first = checkpoint(first.withColumnRenamed("component", "label").join(own, "node", "left"))
    # keys whose classes are still apart
    labelled = checkpoint(shared.join(first, "node"))
    of_center = F.max(F.when(F.col("node") == F.col("center"), F.col("label"))).alias("first_label")
    apart = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), of_center).where("a <> b")
    rest = labelled.join(apart.select("key", "first_label"), "key")
    major = (F.col("label") == F.col("first_label")).alias("major")
    center = F.coalesce("own_center", "node").alias("own_center")
    held = F.coalesce("held", "n").alias("held")
    members = checkpoint(rest.select("key", "pick", "node", "label", "n", "common", major, center, held))
    dealt = blocks(members, classes.select("node", "signature")).repartition("block").sortWithinPartitions("block")
    pairs = dealt.mapInArrow(tidy(close_pairs(join)), "left binary, right binary")
    links = join.confirm(sets, checkpoint(pairs)).where("similar")
    named = first.select(F.col("node").alias("n"), "label")
    edges = links.join(named, links["left"] == named["n"]).select(F.col("label").alias("l"), "right")
    edges = edges.join(named, edges["right"] == named["n"]).select(F.col("l").alias("left"), F.col("label").alias("right"))
    joined = merged_components(first.select(F.col("label").alias("node")).distinct(), edges.where("left <> right").distinct(), TASK_LINKS)
    joined = joined.withColumnRenamed("node", "label")
    done = first.join(joined, "label").select("node", "component")
    alone = classes.join(first, "node", "left_anti").select("node", F.col("node").alias("component"))
    return done.unionByName(alone)
