import hashlib
import random
import zlib

import numpy as np
import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tablescope.llm import queries, runs

FOLDER = "/root/testdata/sf0.01"


def plain_runs(words, least=12):
    """The definition: for every period the maximal stretches, kept if the period is the smallest of the stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, m, q) for (s, m), q in best.items())


def plain_collapsed(words, found):
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    return [w for k, w in enumerate(words) if k not in gone]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind, size = rng.random(), rng.randint(0, 200)
        letters = "ab" if kind < 0.3 else "abc" if kind < 0.5 else [f"w{i}" for i in range(30)]
        words = [rng.choice(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3)):  # plant repeats
            part = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
            at = rng.randint(0, len(words))
            words[at:at] = (part * rng.randint(2, 8))[: rng.randint(5, 90)]
        yield words


@pytest.mark.parametrize("seed", range(5))
def test_runs_against_brute_force(seed):
    many = [[w.encode() for w in words] for words in texts(seed, 120)]
    owner, every = runs.runs_in(many)
    got = {}
    for d, r in zip(owner.tolist(), every.T.tolist()):
        got.setdefault(d, []).append(tuple(r))
    for d, words in enumerate(many):
        assert got.get(d, []) == plain_runs(words)
        assert runs.kept_words(words, np.array(got.get(d, []), np.int64).reshape(-1, 3).T) == plain_collapsed(words, plain_runs(words))


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_common_extension(letters):
    """Climbing the grammar finds the same as comparing symbol by symbol, in both directions."""
    rng = np.random.default_rng(letters)
    line = np.concatenate([[900], np.tile(rng.integers(0, letters, 37), 4), rng.integers(0, letters, 300), [901]])
    levels = runs.recompress(line)
    assert len(levels[-1].first) == 1 and len(levels) < 80
    i, j = rng.integers(1, len(line), 2000), rng.integers(1, len(line), 2000)
    i, j = i[i != j], j[i != j]

    def plain(seq, a, b):
        m = 0
        while a + m < len(seq) and b + m < len(seq) and seq[a + m] == seq[b + m]:
            m += 1
        return m

    assert runs.common_extension(levels, i, j).tolist() == [plain(line, a, b) for a, b in zip(i, j)]
    back = runs.common_extension([level.mirrored() for level in levels], len(line) - i, len(line) - j)
    assert back.tolist() == [plain(line[::-1], len(line) - a, len(line) - b) for a, b in zip(i, j)]


def test_many_candidates(monkeypatch):
    monkeypatch.setattr(runs, "MANY", 50)
    words = [b"x"] * 300 + [b"y", b"z"] * 40
    assert [tuple(r) for r in runs.runs_in([words])[1].T.tolist()] == plain_runs(words)


def test_long_texts():
    """A giant text of one repeated word, and one without repeats."""
    n = 60_000
    owner, every = runs.runs_in([[b"x"] * n, [str(i).encode() for i in range(n)]])
    assert owner.tolist() == [0] and every.T.tolist() == [[0, n, 1]]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 12), (4, "a " * 12), (None, "a b\x0b" * 6 + "c"), (5, "a " * 11), (6, "é x é " * 8)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, Runs int")
    found = runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=repr)
    want = [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 12, 1)], "a"), (4, [(0, 12, 1)], "a"), (None, [(0, 12, 2)], "a b c"),
        (5, [], " ".join("a" * 11)), (6, [(0, 16, 2)], "é x é"),
    ]
    assert got == sorted(want, key=repr)
    assert runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(docs, least=2)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 150 and n_chars < 5000")
    want = []
    for r in docs.collect():
        words = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        collapsed = hashlib.sha256(b" ".join(plain_collapsed(words, found))).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r["doc_id"], len(found), *top, digest, collapsed))
    got = queries.periodic_runs(docs.select("doc_id", "text"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert any(w[1] for w in want)


def test_query_against_sql(spark):
    df = queries.QUERIES["op11_periodic_runs"](spark, FOLDER)
    assert differences(df, duck(FOLDER), queries.SQL["op11_periodic_runs"]) == []


def test_query_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, None)], "doc_id long, text string")
    assert [r["n_runs"] for r in queries.periodic_runs(docs).collect()] == [0, 0]
    assert queries.periodic_runs(docs).select(F.count("collapsed_sha256")).first()[0] == 2
