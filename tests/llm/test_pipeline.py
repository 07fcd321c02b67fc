import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline as pipeline
from tablescope.llm import lines

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_registered():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert {"pipeline"} | {n for n in entries.queries() if n.startswith("op")} >= {"pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries() if n.startswith("op")) == list(range(1, 14))


def test_line_stage_against_plain_version(spark, docs):
    rows = docs.collect()
    sites = {}
    for r in rows:
        for line in r["text"].split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(r["source"])
    bad = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    want = {}
    for r in rows:
        new = "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\n\x0b\x0c\r") not in bad)
        want[r["doc_id"]] = new if len(new) >= 0.5 * len(r["text"]) else r["text"]
    found = pipeline.dedup_lines(spark, docs, FOLDER)
    assert found.columns == COLUMNS and texts(found) == want
    assert found.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_line_stage_spares_copies_only(spark):
    """A page of much boilerplate and a remainder of its own loses the boilerplate; a copied page stays whole."""
    menu = "home about contact imprint privacy terms of use of this site"
    rows = [(i, f"{menu}\nown {i}", "en", f"site{i}") for i in range(12)]
    rows += [(20, f"{menu}\nthe copied page", "en", "site1"), (21, f" {menu}\n\nthe copied page", "en", "site2"), (22, None, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: f"own {i}" for i in range(12)} | {r[0]: r[1] for r in rows if r[0] >= 20}
    assert texts(pipeline.dedup_lines(spark, docs, FOLDER)) == want


def test_toxic_stage_keeps_clean_rows(spark, docs):
    found = pipeline.reject_toxic(spark, docs, FOLDER)
    assert found.columns == COLUMNS
    kept, all_ = texts(found), texts(docs)
    bad = ("idiot", "moron", "scum", "worthless", "disgusting", "pathetic", "loser", "trash", "clown", "stupid")
    words = {d: set(t.lower().replace(".", " ").replace(",", " ").split()) for d, t in all_.items()}
    rude = {d for d, w in words.items() if w & set(bad)}
    assert len(rude - kept.keys()) >= 0.9 * len(rude)
    assert len(kept.keys() - rude) >= 0.97 * len(all_.keys() - rude)


def test_decontamination_stage(spark, docs):
    found = pipeline.decontaminate_documents(spark, docs, FOLDER)
    assert found.columns == COLUMNS
    again = pipeline.decontaminate_documents(spark, found, FOLDER)
    assert texts(again) == texts(found)


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*COLUMNS, "ids", "n_tokens", "round_trip"]
    assert out.count() > 100 and out.where("not round_trip").count() == 0
