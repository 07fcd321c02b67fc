import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tablescope.llm import infill, queries
from tablescope.llm.text import buffers

FOLDER = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.choice([0, 1, 2, 5, 40, 3000])
        yield "".join(rng.choice(["a", "é", "語", " ", "\n", "word", "x" * rng.randint(1, 400)]) for _ in range(size))


def plain_boundaries(text):
    out = [0]
    for t in TOKEN.findall(text):
        out.append(out[-1] + len(t.encode()))
    return out


@pytest.mark.parametrize("error", [0, 1, 100])
def test_rank_index_is_exact(error):
    many = [*texts(1, 60), "", " ", "\t\t", "end "]
    data, bounds = buffers(pa.array(many))
    at, first = infill.boundaries(data, bounds)
    for d, t in enumerate(many):
        assert (at[first[d] : first[d + 1]] - bounds[d]).tolist() == plain_boundaries(t)
    index = infill.RankIndex(at, first, error)
    assert index.offsets(np.arange(len(at))).tolist() == at.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error
    with pytest.raises(ValueError):
        infill.RankIndex(at, first, 200)


def test_few_segments():
    """Ordinary words need far fewer segments than boundaries."""
    rng = random.Random(3)
    many = [" ".join("w" * rng.randint(1, 12) for _ in range(n)) for n in (0, 1, 300, 5000)]
    at, first = infill.boundaries(*buffers(pa.array(many)))
    assert len(infill.RankIndex(at, first).low) < len(at) / 20


def plain(key, text):
    """The definition, with the standard expression engine."""
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    one, two = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    a, b, c = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, len(tokens), "plain", text, None, None
    if h4 % 100 < 80:
        return key, len(tokens), "spm", f"<S>{c}<P>{a}<M>{b}", len(a), len(b)
    return key, len(tokens), "psm", f"<P>{a}<S>{c}<M>{b}", len(a), len(b)


def test_against_brute_force_and_round_trip(spark):
    rows = [(k, t) for k, t in enumerate(texts(2, 300))]
    rows += [(1000 + k, t) for k, t in enumerate(["<", "<S", "P>", "S> M> <", "a<P", "<P>", "x <M> y", "<S>"] * 30)]
    rows += [(None, "null key here"), (7, None), (9, "same"), (9, "same"), (2000, "long wörd " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, Form string")
    found = infill.fill_in_middle(docs)
    assert found.columns == ["doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    mine = [(r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in got]
    assert sorted(mine, key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


def test_query_against_sql(spark):
    df = queries.QUERIES["op12_fill_in_middle"](spark, FOLDER)
    assert differences(df, duck(FOLDER), queries.SQL["op12_fill_in_middle"]) == []
