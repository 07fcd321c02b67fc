import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tablescope.llm import sentencepieces as sp
from tablescope.llm.queries import MODEL_FILE

LETTERS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "ß", "中", "国", "の", "!", "1", "\t", "aa", "the", "ing", "😀", " " * 7, "ation"]


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """A small hand-written unigram vocabulary."""
    model = sentencepiece_model_pb2.ModelProto()
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += [("▁", -3.1, 1), ("▁a", -2.2, 1), ("▁the", -2.7, 1), ("th", -3.3, 1), ("he", -3.4, 1), ("ab", -3.05, 1), ("aba", -3.6, 1)]
    rows += [("bab", -3.8, 1), ("eth", -4.15, 1), ("a", -4.01, 1), ("b", -4.03, 1), ("e", -4.07, 1), ("h", -4.09, 1), ("t", -4.2, 1)]
    for piece, score, kind in rows:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def in_chunks(encoder, text, size):
    whole, at, chunks = encoder.normal(text), 0, []
    n = encoder.model.longest
    for end in sp.chunk_ends(whole, size):
        chunks.append(sp.Chunk(encoder, whole[max(0, at - n) : at], whole[at:end], whole[end : end + n]))
        at = end
    path = sp.best_path([c.matrix() for c in chunks])
    return [i for c, (a, b) in zip(chunks, path) for i in c.trace(a, b)]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_scan_equals_the_library(kind, unigram_file):
    path = MODEL_FILE if kind == "bpe" else unigram_file
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), sp.Encoder(sp.read_model(path))
    rng = random.Random(7)
    joined = [x for x in LETTERS if " " not in x and x != "\n"]
    for k in range(400):
        letters = (LETTERS, joined, ["a", "b", "e", "t", "h"])[k % 3]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        want = library.encode(text)
        assert encoder.encode(encoder.normal(text)) == want, text
        for size in (1, 3, 8, 20):
            assert in_chunks(encoder, text, size) == want, (size, text)


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(2)
    sizes = [1, 4, 3, 5, 2, 1, 6, 1]
    ms = [rng.integers(-9, 9, (a, b)).astype(float) for a, b in zip(sizes, sizes[1:])]
    want = [ms[0]]
    for m in ms[1:]:
        want.append(sp.times(want[-1], m))
    assert all((a == b).all() for a, b in zip(sp.prefixes(ms), want))


@pytest.mark.parametrize("size", [sp.CHUNK, 700])
def test_documents_and_round_trip(spark, size):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    coded = sp.encode(docs, MODEL_FILE, size=size)
    rows = sp.decode(coded, MODEL_FILE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"]) and r["decoded"] == r["text"]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 3000), (5, "中文字" * 900), (5, "中文字" * 900), (None, "a b " * 700), (7, "\x00퟿"), (8, " " * 2500)]
    docs = spark.createDataFrame([(*r, [9]) for r in rows], "doc_id long, text string, Ids array<int>")
    coded = sp.encode(docs, MODEL_FILE, size=1000)
    assert coded.columns == ["doc_id", "text", "ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    got = sp.decode(coded, MODEL_FILE).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert sp.encode(docs.limit(0), MODEL_FILE).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([0, 99999, 3 + 0xFF],)], "ids array<int>")
    assert [r["decoded"] for r in sp.decode(odd, MODEL_FILE).collect()] == [None, "", "⁇  ⁇ �"]


def test_other_models_are_refused(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 4
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sp.read_model(str(tmp_path / "m"))


def test_beginnings_share_nodes(monkeypatch):
    """Segments that begin alike look for the nodes after their common letters only; the ids stay those of the merges."""
    encoder = sp.Encoder(sp.read_model(MODEL_FILE))
    encoder.segment("▁internation")
    asked = []
    apart = encoder.apart
    monkeypatch.setattr(encoder, "apart", lambda before, piece: asked.append(piece) or apart(before, piece))
    encoder.pairs.clear()
    assert encoder.segment("▁internationsh") == encoder.ids_of(encoder.merged("▁internationsh"))
    assert asked and all(p[-1] in "sh" for p in asked)
    rng = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    monkeypatch.setattr(sp, "NODES", 40)  # forgets its nodes again and again
    monkeypatch.setattr(sp, "MEMORY", 30)
    for _ in range(300):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40)))
        assert encoder.encode(encoder.normal(text)) == library.encode(text)


def test_merges_across_a_border():
    """The pieces of a pair are given up as soon as letters of both merge, and else are those of plain merging."""
    encoder = sp.Encoder(sp.read_model(MODEL_FILE))
    pieces = random.Random(1).sample([p for p in encoder.ids if 1 < len(p) < 9], 400)
    for a, b in zip(pieces, pieces[1:]):
        b = b.lstrip(sp.SPACE) or "x"
        assert (encoder.merge(list(a + b), len(a)) == [a, b]) == (encoder.merged(a + b) == [a, b])


def test_pairs_by_the_steps_of_both_pieces():
    """Whether two pieces stay apart follows from how each comes about, also where scores tie or rise again."""
    rng = random.Random(11)
    for model in [sp.read_model(MODEL_FILE)] + [None] * 20:
        if model is None:
            pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)} | set("abc"))
            rows = [(f"<0x{b:02X}>", 0.0, sp.BYTE) for b in range(256)] + [(p, float(-rng.randint(0, 9)), sp.NORMAL) for p in pieces]
            model = sp.Model(sp.BPE, *map(list, zip(*rows)), False)
        encoder = sp.Encoder(model)
        some = rng.sample(sorted(encoder.ids), min(len(encoder.ids), 300))
        for a, b in zip(some, rng.sample(some, len(some))):
            assert encoder.apart(a, b) == (encoder.merge(list(a + b), len(a)) == [a, b]), (a, b)
        for a in some:
            assert encoder.apart(None, a) == encoder.apart("\x01", a) == (encoder.merged(a) == [a])


def test_new_segments_without_merging(monkeypatch):
    """Texts are encoded together, their new segments in order; no letters are merged, and long segments are not kept."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    encoder = sp.Encoder(sp.read_model(MODEL_FILE))
    monkeypatch.setattr(encoder, "merge", None)
    asked, found = [], encoder.beginnings
    monkeypatch.setattr(encoder, "beginnings", lambda text: asked.append(text) or found(text))
    monkeypatch.setattr(sp, "SEGMENTS", 5)
    for texts in (["zebra apple", "apples " + "x" * 100, "", "zebra é😀"], ["apple pear", "zebra pear"]):
        asked.clear()
        got = encoder.encode_all([encoder.normal(t) for t in texts])
        assert [x.tolist() for x in got] == [library.encode(t) for t in texts]
        assert asked == sorted(set(asked))
        assert all(len(s) <= sp.SHORT for s in encoder.known)
    assert asked == ["▁pear"]
