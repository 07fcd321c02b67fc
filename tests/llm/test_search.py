import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from comparing import differences, duck

from tablescope.llm import queries, search
from tablescope.llm.text import ALNUM, Words

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, asked, k):
    bags = [(d, Counter(words(t))) for d, t in docs]
    mean = max(sum(sum(b.values()) for _, b in bags) / len(bags), 1e-9)
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for q, text in asked:
        found = []
        for d, bag in bags:
            size, score = sum(bag.values()), 0
            for w in set(words(text)):
                if tf := bag[w]:
                    idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    score += round(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) * 1e6)
            if score and d is not None:
                found.append((-score, d))
        out |= {(q, i + 1, d, -s / 1e6) for i, (s, d) in enumerate(sorted(found)[:k])}
    return out


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(queries.QUERIES["op1_topk_search"](spark, folder), duck(folder), queries.SQL["op1_topk_search"]) == []


@pytest.mark.parametrize("block", [64, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "QUERIES", 2)
    docs = [(i, f"common w{i % 7} w{i % 11} " + "pad " * (i % 5)) for i in range(150)]
    docs += [(500, None), (501, ""), (None, "w3 w3"), (502, "É é ONE one " * 3), (503, "same text"), (504, "same text"), (505, "x " * 40000 + "w3")]
    asked = [(1, "w3 w5 common"), (2, "É ONE"), (3, None), (4, "nothing there"), (None, "w3"), (5, "Same TEXT w10"), (6, "pad")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body")
    found = search.top_k(table, spark.createDataFrame(asked, "query_id long, text string"), text="body", k=5)
    assert found.columns == ["query_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in found.collect()} == brute(docs, [a for a in asked if a[0] is not None], 5)


def test_query_takes_whole_texts(spark, monkeypatch):
    """The registered query without a limit of words: all words of a text count, in slices of few terms, too."""
    monkeypatch.setattr(search, "TERMS", 9000)
    monkeypatch.setattr(search, "CELLS", 5000)
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    asked = [(d, t) for d, t in docs if d % 20 == 0]
    assert max(len(set(words(t))) for _, t in asked) > 16
    assert {tuple(r) for r in queries.QUERIES["op1_topk_search"](spark, folder).collect()} == brute(docs, asked, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.top_k(docs.limit(0), asked).collect() == []
    assert search.top_k(docs, asked.limit(0)).collect() == []


def test_texts_are_read_once(spark, monkeypatch):
    """The index is made once, not again for each slice of queries."""
    monkeypatch.setattr(search, "QUERIES", 2)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = [(i, f"common w{i % 7} w{i % 11}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    asked = [(i, t) for i, t in docs if i % 5 == 0]
    found = search.top_k(table, spark.createDataFrame(asked, "query_id long, text string"), k=5)
    assert {tuple(r) for r in found.collect()} == brute(docs, asked, 5)
    assert read.value == len(docs)


def test_first_round(spark):
    """More partitions than are searched at once: scores of the first ones leave out documents of the others, ties do not."""
    docs = [(1000 - i, f"common w{i % 7} w{i % 11} " + "pad " * (i % 5)) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(9, "doc_id")
    asked = [(1, "w3 w5 common"), (2, "pad"), (3, "common"), (4, "w1 nothing")]
    found = search.top_k(table, spark.createDataFrame(asked, "query_id long, text string"), k=4)
    assert {tuple(r) for r in found.collect()} == brute(docs, asked, 4)


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("unit", [1e6, 0.4])
@pytest.mark.parametrize("dense, matrix", [(0.003, 1 << 23), (0, 1 << 23), (0, 60), (2, 1 << 23)])
def test_blocks_and_matrices(monkeypatch, dense, matrix, unit):
    """Small blocks, groups and pieces; terms in matrices or not; scores that are rounded to 0 count as found."""
    for name, value in {"BLOCK": 20, "GROUP": 7, "CELLS": 90, "ROOM": 60, "DENSE": dense, "MATRIX": matrix, "UNIT": unit, "SHARD_BYTES": 9000}.items():
        monkeypatch.setattr(search, name, value)
    docs = [(i, " ".join(f"w{i * j % (7 + j)}" for j in range(1, 3 + i % 30)) + " é" * (i % 2)) for i in range(230)] + [(None, "w1 w2"), (500, None), (501, "")]
    asked = [(i, t) for i, t in docs if i is not None and i % 5 == 0 and t]
    half = len(docs) // 2
    made = [[pa.array(x, kind) for x, kind in zip(zip(*part), (pa.int64(), pa.string()))] for part in (docs[:half], docs[half:])]
    rows = list(search.indexing(pa.RecordBatch.from_arrays(x, names=["key", "text"]) for x in made))
    sizes = [batch.to_pylist()[0] for batch in rows]
    assert sum(x["docs"] for x in sizes) == len(docs) and max(x["docs"] for x in sizes) <= 20
    mean = sum(x["words"] for x in sizes) / len(docs)
    bags = [(d, Counter(words(t))) for d, t in docs]
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    vocabulary = sorted(df)
    term = dict(zip(vocabulary, (Words(pa.array(vocabulary), ALNUM)).hashes().view(np.int64).tolist()))
    flat = [(q, term[w], idf[w]) for q, t in asked for w in set(words(t))]
    table = pa.table(dict(zip(("query", "term", "idf"), map(list, zip(*flat)))))
    pack = {name: c[0].as_py() for name, c in zip(search.packed(table).column_names, search.packed(table).columns)}
    listed = [batch for batch in rows if batch.column("keys")[0].is_valid]
    expected = set()
    for q, t in asked:
        found = []
        for d, bag in bags:
            if d is not None and set(bag) & set(words(t)):
                size = sum(bag.values())
                found.append((-sum(round(idf[w] * (bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean))) * unit) for w in set(words(t)) & set(bag)), d))
        expected |= {(q, d, -s) for s, d in sorted(found)[:4]}
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = pa.Table.from_batches(search.searching(Held(pack), Held(none), mean, 4)(listed)).to_pylist()
    assert {tuple(x.values()) for x in best} == expected
    # the last scores are known: nothing of them is lost
    least = {}
    for q, _, s in expected:
        least[q] = min(s, least.get(q, s))
    known = tuple(np.array(x, np.int64) for x in zip(*sorted(least.items())))
    best = pa.Table.from_batches(search.searching(Held(pack), Held(known), mean, 4)(listed)).to_pylist()
    assert {tuple(x.values()) for x in best} == expected
