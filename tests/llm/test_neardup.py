import re
from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import neardup

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    return out


def brute(rows, size, percent):
    """doc_id -> (set size, smallest linked id) by comparing all pairs that share a shingle."""
    sets = sets_of([t for _, t in rows], size)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = set()
    for owners in where.values():
        for a in range(len(owners)):
            for b in range(a):
                pair = (owners[b], owners[a])
                if pair not in seen:
                    seen.add(pair)
                    i, j = pair
                    common = len(sets[i] & sets[j])
                    if 100 * common >= percent * len(sets[i] | sets[j]):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, size, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = neardup.near_duplicates(docs, shingle=size, percent=percent, keep=["doc_id"])
    assert result(found) == brute(rows, size, percent)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups larger than a block, so that blocks and spread partners are used."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(neardup, "BLOCK", 128)
    monkeypatch.setattr(neardup, "SPREAD", 64)
    base = [f"w{rng.integers(500)}" for _ in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 4)):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, f"other text number {i} of many") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs, shingle=3, percent=85, keep=["doc_id"])) == brute(rows, 3, 85)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [
        (7, None, "a"), (6, "", "a"), (5, "  \t\n", None), (4, "One two", "b"), (3, "one  TWO\n", "b"), (2, long, "c"),
        (1, long + " end", "c"), (None, long, "c"), (None, "lonely text here", "d"), (4, "One two", "b"), (9, "É two", "b"), (8, "é two", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = neardup.near_duplicates(docs, shingle=3, percent=85)
    assert found.columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()), key=repr)
    want = [
        (7, 0, 7, True), (6, 0, 6, True), (5, 0, 5, True), (4, 1, 3, False), (4, 1, 3, False), (3, 1, 3, True), (2, 29998, 1, False),
        (1, 29999, 1, True), (None, 29998, 1, False), (None, 1, None, True), (9, 1, 9, True), (8, 1, 8, True),
    ]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []


def test_pigeonhole():
    """Signatures within the distance always share a key; the selections of a chunk leave the errors out."""
    rng = np.random.default_rng(1)
    chosen = neardup.selections(64, 13, 25 // 13)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 64)
        b = a.copy()
        at = rng.choice(64, 25, replace=False)
        b[at] = (b[at] + 1) % (1 << 16)
        assert any((a[c] == b[c]).all() for c in chosen)


def test_only_shared_keys_are_sent(spark, monkeypatch):
    """Keys whose slot no shared key has are left out before the join; links merged a few at a time give the same groups."""
    from tablescope.llm import neardup
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(60)])) for i in range(40)]
    rows += [(100 + i, " ".join(words[: 60 - i] + ["z"] * i)) for i in range(4)]  # a chain of edited copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = neardup.Join("text", 3, 85, 64, 12, 23)
    classes = join.scan(docs, ["doc_id"], True)
    everything = join.keys(classes)
    shared = everything.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    assert everything.groupBy("key", "node").count().where("count > 1").isEmpty()
    bits = neardup.bitmap(shared.select(F.pmod("key", F.lit(neardup.SLOTS)).alias("slot")))
    sent = {tuple(r) for r in join.keys(classes, bits).collect()}
    wanted = {tuple(r) for r in everything.join(shared, "key", "left_semi").select("pick", "key", "node").collect()}
    assert wanted and wanted <= sent and len(sent) < everything.count() / 2
    found = neardup.near_duplicates(docs, shingle=3, percent=85, keep=["doc_id"]).collect()
    monkeypatch.setattr(neardup, "TASK_LINKS", 1)
    again = neardup.near_duplicates(docs, shingle=3, percent=85, keep=["doc_id"]).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert {r["component_id"] for r in found if r["doc_id"] >= 100} == {100}
