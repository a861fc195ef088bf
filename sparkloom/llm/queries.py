"""The opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat, extraction, jaccard, licenses, merkle, minhash, mixing, oracles, packing, quality, substrings, suffix_tree, vafile, whitening
from sparkloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracles.SQL)

#: Where the tokenizer file of a public byte-level BPE vocabulary lies.
TOKENIZER = "byte_bpe_50k.json"


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark, sf_dir):
    """Every piece of every document in its sequence of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.BatchEncoder(tokenizer_path()), with_ids=False)


@query
def op3_quality_cascade(spark, sf_dir):
    """The base figures and the cascade's verdict for every document."""
    rules = quality.default_rules() + quality.shape_rules()
    judged = quality.quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), rules, features=quality.FEATURES)
    return judged.select(
        "doc_id",
        *quality.FEATURES,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        "kept",
    )


@query
def op10_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    mixed = mixing.mix(mixing.sized_documents(table(spark, sf_dir, "documents")))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "takes")


@query
def op8_chat_formatting(spark, sf_dir):
    """Digests of every conversation, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    planted = planted.select("conv_id", F.col("turn").cast("long"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.format_chats(chat.turns_of_table(rows.unionByName(planted)))
    read = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.text_under(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op9_vector_top_k(spark, sf_dir):
    """The five best partners of every row whose vec_id is divisible by 50.

    Its contract goes by rows, its SQL by ids: where ids are repeated or null, the two differ.
    """
    return vafile.top_k_of_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query
def op4_license_scan(spark, sf_dir):
    """Every line or text that is a licence notice."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_substring_dedup(spark, sf_dir):
    """What is left of every document without its repeated windows of 20 words."""
    cut = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_jaccard_join(spark, sf_dir):
    """Every document's component under links of 90 % over three-word shingles."""
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op2_suffix_tree_scores(spark, sf_dir):
    """Every document's log10 probability, learning from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return suffix_tree.suffix_tree_scores(docs, train)


@query
def op6_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return extraction.extract_text(table(spark, sf_dir, "pages"))


@query
def op11_merkle_manifest(spark, sf_dir):
    """Every document's proof, and the root that it leads to where a fifth of the texts were changed."""
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), small))
    proofs = merkle.merkle_proofs(docs, changed=changed)
    told = proofs.withColumn("folded_root", merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("steps")))
    return told.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_whitening(spark, sf_dir):
    """The first eight whitened components of every vector; a deviation that a long can't hold is null and stands in `deviation_exact` alone."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumnRenamed("deviation", "deviation_exact").withColumn("deviation", F.col("deviation_exact").try_cast("long"))


@query
def op13_fingerprints(spark, sf_dir):
    """Every text's fingerprint and that of its edited text, in hex, and how near they are."""
    made = minhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return made.select("doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
