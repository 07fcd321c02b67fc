import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.llm import quality, text, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels")]


def accuracy(found, labels, label, least):
    held = found.where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    rows = held.select(label, (F.col("score") >= least).cast("int").alias("said")).collect()
    hits = {k: [r["said"] == r[label] for r in rows if r[label] == k] for k in (0, 1)}
    return [sum(h) / len(h) for h in hits.values()]


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    found = toxicity.toxicity(docs.select("doc_id", "text"), labels, keep=["doc_id"])
    clean, toxic = accuracy(found, labels, "toxic", 0.3)
    assert clean > 0.98 and toxic > 0.8
    row = found.orderBy(F.desc("score")).first()
    assert row["neighbours"] and all(n["cosine"] <= 1 for n in row["neighbours"])


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    low, high = accuracy(quality.quality(docs, labels, keep=["doc_id"]), labels, "quality", 0.5)
    assert low > 0.7 and high > 0.95


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


@pytest.mark.parametrize("seed", range(5))
def test_neighbours_are_exact(seed, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(seed)
    n, terms = 150, 30
    doc = np.repeat(np.arange(n), 4)
    term = np.concatenate([np.sort(rng.choice(terms, 4, replace=False)) for _ in range(n)])
    count = rng.integers(1, 4, len(doc))
    idf = rng.uniform(0.5, 3, terms)
    index = toxicity.Index.build(np.arange(terms, dtype=np.uint64), idf, list(range(n)), rng.integers(0, 2, n).astype(float), doc, term, count, 0.1)
    index.prepare()
    full = np.zeros((n, terms))
    full[doc, term] = (1 + np.log(count)) * idf[term]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    for i in range(20):
        q = np.sort(rng.choice(terms, 5, replace=False))
        w = rng.uniform(0.1, 1, 5)
        at, cosine = index.nearest(q, w / np.linalg.norm(w), k=7)
        every = np.round(full[:, q] @ (w / np.linalg.norm(w)), 12)
        least = max(np.sort(every)[-7], 1e-12)
        want = [j for j in np.lexsort((np.arange(n), -every)) if every[j] >= least]
        assert at.tolist() == want
        assert np.allclose(cosine, every[want])


def test_bounds_leave_most_examples_unopened(tables):
    """Common terms are looked up for few examples only, and no neighbour is lost by it."""
    texts = pa.array([r["text"] for r in tables[0].orderBy("doc_id").limit(2000).collect()])
    doc, term, count = toxicity.terms_of(texts)
    known = np.unique(term)
    term = toxicity.places(known, term)
    idf = np.log(len(texts) / np.bincount(term, minlength=len(known))) + 1
    own = doc < 1800
    toxic = np.zeros(1800)
    index = toxicity.Index.build(known, idf, list(range(1800)), toxic, doc[own], term[own], count[own], 0.1).prepare()
    starts, places, weight = index.vectors(doc[~own] - 1800, term[~own], count[~own], 200)
    found = list(index.search(starts, places, weight))
    assert index.opened < 200 * 1800 / 3
    share = (1 + np.log(count[own])) * idf[term[own]] / index.size[doc[own]]
    for i, (at, cosine) in enumerate(found):
        query = np.zeros(len(known))
        query[places[starts[i] : starts[i + 1]]] = weight[starts[i] : starts[i + 1]]
        every = np.round(np.bincount(doc[own], share * query[term[own]], minlength=1800), 12)
        least = max(np.sort(every)[-toxicity.NEIGHBOURS], 1e-12)
        assert sorted(at.tolist()) == np.flatnonzero(every >= least).tolist()
        assert np.allclose(cosine, np.minimum(every[at], 1))


def test_all_terms_of_examples_count(spark):
    """Neither few toxic examples nor ordinary words are left out of the cosines."""
    keys = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = set(keys[:3])
    docs = [(i, f"you idiot number{i}" if i in toxic else f"the weather of day{i} is fine") for i in keys]
    docs += [(100, "another idiot wrote"), (101, "fine weather again"), (102, "unheard")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in keys], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert {n["key"] for n in got[100]["neighbours"]} == toxic and got[100]["score"] >= 0.3
    assert got[101]["neighbours"] and not any(n["toxic"] for n in got[101]["neighbours"]) and got[101]["score"] < 0.3
    assert got[102]["neighbours"] == []


EDGE = [(1, None, None, None), (2, "", "", "x"), (3, "word " * 30000, "en", "s"), (3, "word " * 30000, "en", "s"), (None, "plain", "en", "s")]
KIND = "doc_id long, text string, lang string, score string"


@pytest.mark.parametrize("labelled", [[], [(3, 1)], [(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (7, 0)]])
def test_edges(spark, labelled):
    docs = spark.createDataFrame(EDGE + [(i, f"text {'bad' if i % 2 else 'good'} {i}", "en", "s") for i in range(4, 60)], KIND)
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels)
    assert found.columns == ["doc_id", "text", "lang", "score", "neighbours"]
    rows = found.collect()
    assert len(rows) == 61 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    found = quality.quality(docs, labels.withColumnRenamed("toxic", "quality"), metadata=("lang",))
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "lang", "text_score", "metadata_score", "score"]
    assert len(rows) == 61 and all(0 <= r["score"] <= 1 for r in rows)


def test_text_features():
    rows = quality.text_features(pa.array(["Ab#, c1\nc1\n", None, ""]))
    named = dict(zip(quality.FEATURES, rows[0]))
    assert named["words"] == np.log1p(3) and named["distinct words"] == 2 / 3 and named["upper case"] == 1 / 11
    assert not rows[1:].any()


def test_one_table_of_common_terms(monkeypatch):
    """Common terms beyond the table's bytes have posting lists, with the same neighbours; a worker holds one index."""
    rng = np.random.default_rng(2)
    n, terms = 200, 24
    doc, term = np.nonzero(rng.random((n, terms)) < rng.uniform(0.05, 0.9, terms))
    count, idf = rng.integers(1, 4, len(doc)), rng.uniform(0.5, 3, terms)
    make = lambda: toxicity.Index.build(np.arange(terms, dtype=np.uint64), idf, list(range(n)), np.zeros(n), doc, term, count, 0.1)
    whole = make().prepare()
    monkeypatch.setattr(toxicity, "COMMON_BYTES", 8 * n * 3)
    cut = make().prepare()
    assert cut.table.shape == (n, 3) and whole.table.shape[1] > 3
    for i in range(20):
        q, w = np.sort(rng.choice(terms, 6, replace=False)), rng.uniform(0.1, 1, 6)
        (a, x), (b, y) = (index.nearest(q, w / np.linalg.norm(w), k=5) for index in (whole, cut))
        assert a.tolist() == b.tolist() and np.allclose(x, y)

    class Held:
        @property
        def value(self):
            assert not toxicity.READY  # the index before it is gone by then
            return make()

    toxicity.READY["old"] = whole
    assert toxicity.ready("new", Held()).table.shape == (n, 3) and list(toxicity.READY) == ["new"]
    toxicity.READY.clear()


def test_index_holds_counts(monkeypatch):
    """A worker keeps a few bytes for each posting and no 64-bit weights; one that only scores drops the examples' own terms."""
    rng = np.random.default_rng(4)
    n, terms = 3000, 60
    doc, term = np.nonzero(rng.random((n, terms)) < rng.uniform(0.02, 0.4, terms))
    count, idf = rng.choice([1, 1, 1, 2, 5, 300], len(doc)), rng.uniform(0.5, 3, terms)
    make = lambda: toxicity.Index.build(np.arange(terms, dtype=np.uint64), idf, list(range(n)), np.zeros(n), doc, term, count, 0.1)

    class Held:
        value = property(lambda self: make())

    index = toxicity.ready("scores", Held())
    assert index.example is None and index.count is None
    assert toxicity.ready("votes", Held(), votes=True).own_vote(np.arange(5)).shape == (5,)
    toxicity.READY.clear()
    held = [x for x in vars(index).values() if isinstance(x, np.ndarray) and x.size >= n * 4 and x is not index.norms]
    assert held and all(x.itemsize <= 2 for x in held)
    full = np.zeros((n, terms))
    full[doc, term] = (1 + np.log(count)) * idf[term] / index.size[doc]
    for _ in range(20):
        q, w = np.sort(rng.choice(terms, 12, replace=False)), rng.uniform(0.1, 1, 12)
        w /= np.linalg.norm(w)
        at, cosine = index.nearest(q, w, k=9)
        every = np.round(full[:, q] @ w, 12)
        assert sorted(at.tolist()) == np.flatnonzero(every >= np.sort(every)[-9]).tolist() and np.allclose(cosine, every[at])


def test_word_hashes(monkeypatch):
    """Hashes by running sums equal those of each word on its own, also across spans and in long words."""
    texts = pa.array(["Ab cd ab", None, "", "x" * 20000 + " " + "y" * 16384, "é" * 300 + " tail", " ".join(f"w{i}" for i in range(20000))])
    words = text.Words(texts, text.NOT_SPACE)
    for longest in (None, 4):
        got = words.hashes(longest)
        monkeypatch.setattr(text, "SPAN", 1)
        assert (got == words.hashes(longest)).all()  # each word is a span of its own
        monkeypatch.undo()
    assert got[0] == got[2] != got[1]


def test_terms_of_examples_stay_in_the_tasks(spark, monkeypatch):
    """The driver gets no example's terms, only finished postings; those of a repeated key are one example's."""
    from pyspark.sql.classic.dataframe import DataFrame

    sent, collect = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: sent.append(self.schema.simpleString()) or collect(self))
    monkeypatch.setattr(toxicity, "SIZES", 3)
    learnt = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    texts = {k: f"w{k % 7} w{k % 7} w{k % 5} common" for k in learnt}
    rows = [*texts.items(), (learnt[0], "w0 extra common"), (learnt[0], "common common common extra w0"), (learnt[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 7 == 0)) for k in learnt], "doc_id long, toxic int"))
    assert sent and not any("array<" in x for x in sent)
    want = {}
    for k, text in rows:
        doc, term, count = toxicity.terms_of(pa.array([text or ""]))
        for t, c in zip(term.tolist(), count.tolist()):
            want[t, k] = max(c, want.get((t, k), 0))
    term = np.repeat(index.terms, index.postings).tolist()
    got = [(t, index.ids[e], int(c)) for t, e, c in zip(term, index.example, index.count)]
    assert got == sorted((t, k, c) for (t, k), c in want.items())
    size = np.zeros(len(index.ids))
    np.add.at(size, index.example, ((1 + np.log(index.count.astype(float))) * np.repeat(index.idf, index.postings)) ** 2)
    assert np.allclose(index.size, np.where(size > 0, np.sqrt(size), 1))


def test_workers_let_go_of_the_index(spark):
    """No worker holds a laid-out index once its task has ended, and what was sent stays as it was."""
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} common") for k in range(400)], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(400)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 400

    def held(batches):
        from tablescope.llm import toxicity

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(toxicity.READY)])], names=["n"])

    found = spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()
    assert len(found) == 64 and not any(r["n"] for r in found)

    index = toxicity.Index.build(np.arange(2, dtype=np.uint64), np.ones(2), [0, 1], np.zeros(2), np.array([0, 1]), np.array([0, 1]), np.array([1, 2]), 0.1)

    class Held:
        value = index

    for _ in range(2):
        assert toxicity.ready("some", Held()).example is None
        toxicity.release()
    assert index.example is not None and not hasattr(index, "table")


def test_lists_are_put_in_order_some_at_a_time(monkeypatch):
    """However many postings are laid out at once, the index is the same."""
    rng = np.random.default_rng(8)
    doc, term = np.nonzero(rng.random((300, 50)) < rng.uniform(0.01, 0.3, 50))
    count, idf = rng.choice([1, 1, 2, 300], len(doc)), rng.uniform(0.5, 3, 50)
    build = lambda: toxicity.Index.build(np.arange(50, dtype=np.uint64), idf, list(range(300)), np.zeros(300), doc, term, count, 0.1)
    whole = build().prepare()
    monkeypatch.setattr(toxicity, "SIZES", 7)
    parts = build().prepare()
    for name, x in vars(whole).items():
        if isinstance(x, np.ndarray):
            assert x.dtype == vars(parts)[name].dtype and np.allclose(x, vars(parts)[name]), name
    full = np.zeros((300, 50))
    full[doc, term] = (1 + np.log(count)) * idf[term] / whole.size[doc]
    for _ in range(20):
        q, w = np.sort(rng.choice(50, 9, replace=False)), rng.uniform(0.1, 1, 9)
        at, cosine = parts.nearest(q, w / np.linalg.norm(w), k=9)
        assert np.allclose(cosine, np.minimum(np.round(full[:, q] @ w / np.linalg.norm(w), 12), 1)[at])
