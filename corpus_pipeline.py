"""A training corpus from `documents`: quality rules, near copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents. Each stage's result is written as Parquet before the next one
reads it, so a lost executor costs the tasks it ran, not the stages before.

Columns beyond doc_id, text, source and n_chars are carried as they are, whatever their names. An
empty table gives an empty one at every stage. Each stage says what it does with nulls and repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, mixing, packing, quality, substrings
from sparkloom.llm.common import written
from sparkloom.llm.queries import tokenizer_path
from sparkloom.sources.tables import table


#: A short document may be a good one; the other rules judge it.
MIN_WORDS = 1


def _beside(docs: DataFrame) -> Column:
    """All columns but the text as one, `row`, so that their names meet no others and texts travel once."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")


def _back(frame: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` from `row`, with that text; n_chars, where there is one, is the text's."""
    changed = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return frame.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every quality rule lets pass.

    A null text, or one without words, goes. Repeated rows are judged each; a null doc_id doesn't matter.
    """
    judged = quality.quality_cascade(docs.select(_beside(docs), "text"), quality.default_rules(min_words=MIN_WORDS))
    return judged.filter("kept").select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % of five-word shingles, the document of the smallest doc_id.

    Documents without a doc_id, and those that repeat the kept one's, stay.
    """
    found = jaccard.similarity_components(docs, n=5, percent=80)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words of 20-word windows that also start earlier; the rest keeps its layout.

    A null text stays null. Rows of one doc_id (null: one more) are one document, in which equal
    places don't precede each other, so repeated rows keep their words.
    """
    cut = substrings.dedup_substrings(docs.select("doc_id", "text", _beside(docs)), window=20, source_layout=True)
    return _back(cut, docs, F.when(F.col("text").isNotNull(), F.col("kept_text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a document taken twice is there twice, one in which a quota ends is cut there.

    The rows lie as the mix deals them: by shard, in slices, each shuffled by place. A null source is
    a source; a text without words is in no take; repeated rows are taken together, each on its own.
    """
    whole = docs.select("doc_id", "source", "text", _beside(docs))
    return _back(mixing.laid_out(mixing.mixed_documents(whole)), docs, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the mixed documents in its sequence, with its token ids.

    A null text makes one piece of its end mark; a null doc_id stays null; repeated rows are packed each.
    """
    return packing.pack(docs, packing.BatchEncoder(tokenizer_path()))


STAGES = [
    ("quality_rules", good_documents),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: Hashed blocks, packing and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
