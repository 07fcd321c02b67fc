import hashlib
import random

import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tablescope.llm import queries, winnow

FOLDER = "/root/testdata/sf0.01"


def plain_marks(text, gram=16, window=32):
    """(place, hash) of the rightmost minimum of every window."""
    codes = [ord(c) for c in text] + [0] * (gram - len(text) if text else 0)
    hashes = []
    for i in range(len(codes) - gram + 1):
        h = 0
        for c in codes[i : i + gram]:
            h = (h * winnow.BASE + c) % winnow.PRIME
        hashes.append(h)
    out = set()
    for i in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        part = hashes[i : i + window]
        at = max(k for k, h in enumerate(part) if h == min(part))
        out.add((i + at, part[at]))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.choice([0, 1, 3, 15, 16, 17, 46, 47, 48, 62, 63, 64, 200, 700])
        letters = rng.choice(["a", "ab", "abcdefgh ijk", "éö語 a𝔘"])
        yield "".join(rng.choice(letters) for _ in range(size))


@pytest.mark.parametrize("gram,window,piece", [(16, 32, 16384), (16, 32, 10), (4, 8, 1), (1, 1, 7)])
def test_marks(spark, monkeypatch, gram, window, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    rows = [(k, t) for k, t in enumerate(texts(gram, 120))] + [(500, None), (501, "x"), (501, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Fingerprint int")
    found = winnow.fingerprints(docs, gram=gram, window=window)
    assert found.columns == ["doc_id", "text", "fingerprint"]
    got = [(r["doc_id"], [(m["at"], m["hash"]) for m in r["fingerprint"]]) for r in found.collect()]
    assert sorted(got) == sorted((k, plain_marks(t or "", gram, window)) for k, t in rows)
    assert winnow.fingerprints(docs.limit(0)).collect() == []


def test_match_guarantee(spark):
    """A shared passage of gram + window - 1 characters is found, wherever it stands."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = word(47)
    rows = [(k, word(rng.randint(0, 300)) + shared + word(rng.randint(0, 300))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r["doc_id"]: {m["hash"]: m["at"] for m in r["fingerprint"]} for r in winnow.fingerprints(docs).collect()}
    for a in range(40):
        for b in range(a):
            same = at[a].keys() & at[b].keys()
            assert any(rows[a][1][at[a][h] : at[a][h] + 16] == rows[b][1][at[b][h] : at[b][h] + 16] for h in same)


def plain_query(rows):
    """The query by its definition; rows with unique keys."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []

    def spelled(marks):
        return ",".join(f"{a}:{h:X}" for a, h in marks)

    def near(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) - len(text) // 4
        edited = text[:cut] + following[: len(text) // 4]
        own, other, after = plain_marks(text), plain_marks(edited), plain_marks(following)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((key, len(text), digest, spelled(own), spelled(other), near(own, other), near(own, after)))
    return out


@pytest.mark.parametrize("n,piece", [(1, 16384), (2, 16384), (3, 5), (150, 16384), (60, 20)])
def test_query_against_brute_force(spark, monkeypatch, n, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    many = list(texts(n, n))
    rows = [(k * 3 - 50 if k else None, many[k] if k % 40 else None) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in queries.fingerprints_of(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain_query(rows), key=repr)


def test_repeated_keys_and_no_rows(spark):
    """Rows with one key are neighbours of each other; the last of them is followed by the next key."""
    rows = [(1, "a" * 100), (1, "b" * 100), (1, "b" * 100), (2, "c" * 100)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int")
    found = winnow.edited_fingerprints(docs).collect()
    marks = {t: [a * 2**31 + h for a, h in plain_marks(t * 100)] for t in "abc"}
    assert sorted(r["text_marks"] for r in found) == sorted([marks["a"], marks["b"], marks["b"], marks["c"]])
    letter = {str(m): t for t, m in marks.items()}
    pairs = {(letter[str(r["text_marks"])], letter[str(r["next_marks"])]) for r in found}
    assert ("b", "b") in pairs and pairs in ({("a", "b"), ("b", "b"), ("b", "c"), ("c", "a")}, {("b", "b"), ("b", "a"), ("a", "c"), ("c", "b")})
    assert winnow.edited_fingerprints(docs.limit(0)).collect() == []


def test_query_against_sql(spark):
    df = queries.QUERIES["op13_fingerprints"](spark, FOLDER)
    assert differences(df, duck(FOLDER), queries.SQL["op13_fingerprints"]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_parameters(spark):
    for gram, window in [(3, 8), (8, 3), (8192, 8)]:
        with pytest.raises(ValueError):
            winnow.marks(F.lit("x"), gram, window)


def test_windows_told_apart_by_neighbours(spark):
    """Rising, falling, equal and wave-like hashes, where the hashes next to those that decide tell little."""
    waves = ["a" * 300, "abcdefghijklmnopqrstuvwxyz" * 12, "zyxwvutsrqponmlkjihgfedcba" * 12, ("ab" * 40 + "b" * 40) * 3]
    waves += ["".join(chr(97 + abs(k % (2 * p) - p)) for k in range(400)) for p in (3, 5, 7, 13, 25)]
    docs = spark.createDataFrame(list(enumerate(waves)), "doc_id long, text string")
    for gram, window in ((1, 2), (1, 8), (2, 16), (16, 32)):
        got = {r["doc_id"]: r["text_marks"] for r in winnow.edited_fingerprints(docs, gram=gram, window=window).collect()}
        for k, t in enumerate(waves):
            assert [(m >> 31, m & (2**31 - 1)) for m in got[k]] == plain_marks(t, gram, window)
