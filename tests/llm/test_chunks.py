import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import chunks

GEAR = [int(g) for g in chunks.GEAR]


def plain_cuts(raw):
    """The definition, byte by byte."""
    mask = ((1 << chunks.BITS) - 1) << (chunks.WINDOW - chunks.BITS)
    candidates, h = [], 0
    for i, b in enumerate(raw):
        h = ((h << 1) + GEAR[b]) % 2**64
        if h & mask == 0:
            candidates.append(i + 1)
    ends = [c for i, c in enumerate(candidates) if i == 0 or c - candidates[i - 1] >= chunks.LEAST]
    ends = [*(e for e in ends if e < len(raw)), len(raw)] if raw else []
    out, last = [], 0
    for e in ends:
        while e - last > chunks.MOST:
            last += chunks.MOST
            out.append(last)
        out.append(e)
        last = e
    return out


def brute(rows, least):
    docs = {(k, t) for k, t in rows}
    owners = defaultdict(set)
    cut = {}
    for k, t in docs:
        raw = (t or "").encode()
        cut[k, t] = [raw[a:b] for a, b in zip([0, *plain_cuts(raw)], plain_cuts(raw))]
        for c in cut[k, t]:
            owners[c].add((k is not None, k or 0, hashlib.blake2b(raw, digest_size=16).digest()))
    out = {}
    for k, t in docs:
        me = (k is not None, k or 0, hashlib.blake2b((t or "").encode(), digest_size=16).digest())
        at, runs, run = 0, [], []
        for c in [*cut[k, t], None]:
            if c is not None and len(owners[c]) > 1:
                run.append((at, at + len(c), min(owners[c]) != me))
            elif run:
                runs.append(run)
                run = []
            at += len(c or b"")
        runs = [r for r in runs if r[-1][1] - r[0][0] >= least]
        repeats = [x for r in runs for x in (r[0][0], r[-1][1])]
        later = sum(b - a for r in runs for a, b, again in r if again)
        out[k, t] = (len(cut[k, t]), repeats, later)
    return out


def result(df):
    return {(r["doc_id"], r["text"]): (r["n_chunks"], r["repeats"], sum(r["later"][1::2]) - sum(r["later"][::2])) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 5000, 70000])
def test_cuts_follow_the_rolling_hash(n):
    raw = np.random.default_rng(n).integers(97, 110, n).astype(np.uint8).tobytes()
    assert chunks.cuts(np.frombuffer(raw, np.uint8)).tolist() == plain_cuts(raw)
    assert chunks.cuts(np.frombuffer(b"a" * n, np.uint8)).tolist() == plain_cuts(b"a" * n)


def test_cuts_across_pieces():
    raw = np.random.default_rng(1).integers(0, 256, (1 << 20) + 500).astype(np.uint8)
    assert chunks.cuts(raw).tolist()[-40:] == plain_cuts(raw.tobytes())[-40:]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(chunks.find_repeats(docs)) == brute(rows, chunks.RUN)


def test_passage_after_insertions(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(i * 7)) + f" {passage} " + " ".join(word() for _ in range(30))) for i in range(1, 30)]
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in chunks.find_repeats(docs).collect() if r["repeats"]}
    assert got == set(range(1, 30))
    cut = {r["doc_id"]: r["text"] for r in chunks.remove_repeats(docs).collect()}
    assert cut[1] == rows[0][1] and all(len(cut[i]) < len(rows[i - 1][1]) - 150 for i in range(2, 30))
    assert all(cut[100 + i] == rows[29 + i][1] for i in range(20))


def test_edges(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(50)) * 9
    other = " ".join(str(i * i) for i in range(200))
    rows = [(1, None), (2, ""), (3, other), (3, other), (None, other), (4, other + base), (5, base * 2000), (6, "é" * 300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, repeats string")
    found = chunks.find_repeats(docs)
    assert found.columns == ["doc_id", "text", "n_chunks", "repeats", "later"]
    assert found.count() == 8 and result(found) == brute(rows, chunks.RUN)
    assert chunks.find_repeats(docs.limit(0)).collect() == []
