"""The pipeline's stages on a small corpus, against plain Python."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from chronolens.llm import _store, op3_leaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "and", "er", "ou"], "fr": ["eau", "é", "oi", "que", "la"]}
    word = lambda l: "".join(rng.choice(parts[l]) for _ in range(3))
    item = " ".join(word("en") for _ in range(20))
    passage = [word("en") for _ in range(60)]
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(word(lang) for _ in range(80)), lang, "s", 1))
    rows += [(100, rows[4][1], "en", "s", 1), (101, rows[5][1] + " more", "en", "s", 1)]  # copy, near copy
    rows += [(102, " ".join([word("en") for _ in range(90)] + passage), "en", "s", 1), (103, " ".join(passage + [word("en") for _ in range(90)]), "en", "s", 1)]
    rows += [(104, " ".join([word("en") for _ in range(40)]) + " " + item.upper() + ".", "en", "s", 1)]
    rows += [(105, None, None, None, None), (106, "", "en", "s", 0), (107, "12 34", "en", "s", 5), (None, " ".join(word("en") for _ in range(30)), "en", "s", 1)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, passage


def test_pipeline(spark, folder):
    d, rows, passage = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    gone = {100, 101, 104, 105, 106, 107}
    assert set(got) == {r[0] for r in rows} - gone
    by = {r[0]: r[1] for r in rows}
    for k, r in got.items():
        assert r["n_tokens"] > 0 and len(r["ids_sha256"]) == 64
        assert r["text"] == (" ".join(by[103].split()[60:]) if k == 103 else by[k])
        assert r["lang"] == ("fr" if k is not None and k < 60 and k % 3 == 0 else "en")


def test_stages_take_odd_rows(spark, folder):
    """Clashing columns, repeated rows, long texts, nulls in any column."""
    d, rows, passage = folder
    odd = [*rows, rows[0], rows[0], (200, None, None, None, None), (201, " ".join(f"zz{i}" for i in range(60000)), "en", None, None)]
    names = ["n_words", "kept", "spans", "factors", "leaks", "score", "lang_pred", "held_out", "mixture", "n_shingles", "component_id", "_row", "_block", "n_tokens"]
    docs = spark.createDataFrame(odd, SCHEMA).repartition(2)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(f"own {i}"))
    docs = docs.withColumn("mixture", F.lit(None).cast("string"))
    sizes = {"language_id": {200, 105, 106, 107}, "ngram_jaccard_join": {100, 101}, "substring_dedup": {100}, "benchmark_decontamination": {104}}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, d)
        got = out.collect()
        if name == "sentencepiece_encoding":
            assert len(got) == len(odd) and all(isinstance(r["n_tokens"], int) for r in got)
            continue
        assert out.columns == docs.columns
        assert {r[0] for r in odd} - {r["doc_id"] for r in got} == sizes[name], name
        assert all(r[n] == f"own {i}" for r in got for i, n in enumerate(names) if n != "mixture")
        assert sum(r["doc_id"] == 0 for r in got) == (1 if name == "ngram_jaccard_join" else 3), name
        assert sum(r["doc_id"] is None for r in got) == 1


def test_run_removes_what_it_staged(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(_store, "shared_dir", lambda spark: f"file://{tmp_path}")
    d, _, _ = folder
    out = corpus_pipeline.run(spark, d)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == [corpus_pipeline.STAGES[-2][0]]
    assert out.count() > 0


def test_stages_keep_columns_and_empty_tables(spark, folder):
    d, _, _ = folder
    empty = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, empty, d)
        assert out.columns[:5] == empty.columns and out.count() == 0, name
    assert op3_leaks.normal("A-b  C.") == "a b c"
