"""A training-corpus pipeline of five stages over ``documents``.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; each result is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  ``run`` removes
what a stage has staged once its result is written; whoever calls a stage alone
leaves that to the end of the process.

All stages give an empty table for an empty one, take repeated rows one by one
unless they say otherwise, read very long texts whole, and keep columns beyond
those of documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import op2_jaccard, op3_leaks, op4_languages, op6_pieces, op7_substrings
from chronolens.llm._store import fresh, remove, scratch, stage

#: Share of the largest language below which a text is rejected: a mixture that no
#: language leads.  Measured: 0 of 10,000 documents at sf0.1 and 0 of 51,282 of the
#: check tool's small input lie below it (at 0.4: 0 and 1, at 0.5: 0 and 10).
MIN_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, or without a letter) and mixtures in which no
    language has MIN_SHARE go; ``lang`` becomes the predicted language.

    Null ids and sources: kept as they are; a null ``lang`` is not learned from.
    Ties between languages go to the first in order of code points; without a row
    to learn from, every text is in no language and goes.
    """
    model = op4_languages.learn(docs)
    before, name = fresh(docs, "_lang_pred", "_score")
    # columns of the operator's result that documents bring along are put aside
    aside = {c: n for c, n in zip(["lang_pred", "score", "held_out", "mixture"], fresh(docs, "_a", "_b", "_c", "_d")) if c in docs.columns}
    found = op4_languages.identify(docs.withColumnsRenamed(aside), model)
    found = found.withColumnsRenamed({"lang_pred": before, "score": name}).drop("held_out", "mixture")
    kept = found.where((F.col(before) != op4_languages.UNKNOWN) & (F.col(name) >= MIN_SHARE))
    return kept.withColumn("lang", F.col(before)).withColumnsRenamed({n: c for c, n in aside.items()}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: the one whose
    id names the component.

    Rows without an id stay, as do null texts and texts without words, which are
    similar to nothing.  Where ids repeat, rows with equal id and text become one;
    rows with equal ids and other texts are told apart by nothing, so they stay or
    go together.
    """
    found = stage(op2_jaccard.jaccard_components(docs.select("doc_id", "text")), "components")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    out = op2_jaccard.drop_ids(docs, gone)
    if not found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(out.where("doc_id IS NULL"))
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of texts; texts with nothing left go.

    The copy under the smallest id stays; of texts that are cut, the words left are
    joined by one space and ``n_chars`` is counted anew.  Texts without a repeated
    passage stay as they are, with their white space; so do null and empty texts
    and rows without an id.
    """
    aside = {c: n for c, n in zip(["n_words", "n_removed", "spans", "factors", "kept"], fresh(docs, "_a", "_b", "_c", "_d", "_e")) if c in docs.columns}
    found = op7_substrings.substring_dedup(docs.withColumnsRenamed(aside))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("n_removed") > 0
    count = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    left = left.withColumn("n_chars", count).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    return left.drop("n_words", "n_removed", "spans", "factors", "kept").withColumnsRenamed({n: c for c, n in aside.items()}).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; null items are held by none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    aside = {"leaks": fresh(docs, "_leaks")[0]} if "leaks" in docs.columns else {}
    found = op3_leaks.find_leaks(docs.withColumnsRenamed(aside), benchmark)
    return found.where(F.size("leaks") == 0).drop("leaks").withColumnsRenamed({n: c for c, n in aside.items()}).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids of each text, and the digests of ids and decoded text.

    Null and empty texts have no ids.  Columns of these names that come with the
    documents are replaced.
    """
    model = op6_pieces.default_model()
    return op6_pieces.encode_decode(docs, model, only=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece_encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is staged in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: list[str] = []
    for name, function in STAGES[:-1]:
        with scratch() as made:
            out = function(spark, docs, sf_dir)
        with scratch() as written:
            docs = stage(out, name)
        remove(spark, [*held, *made])  # what led to the table just written
        held = written
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model and the tokeniser are beyond SQL.
ORACLE_SQL = None
