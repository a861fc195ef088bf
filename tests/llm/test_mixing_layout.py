"""Shards of the mix, and how the pipeline lays its rows out."""

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import mixing


def test_ordinary_inputs_have_several_shards(spark):
    for documents, words in ((2000, 25_000), (300, 400)):
        sized = spark.range(documents).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", f"{words}L AS size")
        drawn = mixing.mix(sized).select(F.explode("takes").alias("t")).groupBy("t.shard").agg(F.sum("t.words").alias("n")).collect()
        assert sorted(r.shard for r in drawn) == list(range(len(drawn))) and len(drawn) > 4
        assert sum(r.n for r in drawn) == 1.5 * documents * words


def test_what_is_taken_is_what_the_tree_draws(spark, monkeypatch):
    sized = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "400L AS size")
    taken = lambda: mixing.mix(sized).select(F.sum(F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"]))).first()[0]
    assert taken() == 180_000
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed: iter(()))
    assert taken() == 0


def test_columns_of_any_name_are_carried(spark):
    names = ["words", "block", "once", "again", "done", "of", "at", "n_blocks", "_", "shard", "pass", "a.b"]
    sized = spark.range(20).selectExpr("id AS doc_id", "'s' AS source", "10L AS size", "7 AS takes", *(f"id + {k} AS `{c}`" for k, c in enumerate(names)))
    rows = mixing.mix(sized).collect()
    assert rows[0].__fields__ == ["doc_id", "source", "size", *names, "source_size", "target", "takes"]
    assert all(r[c] == r.doc_id + k for r in rows for k, c in enumerate(names))


def test_rows_lie_by_shard_and_place(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id, ' other') AS text", "'s' AS source").coalesce(1)
    planned = {(r.doc_id, r.place): (r.shard, r.place) for r in mixing.mixed_documents(docs).collect()}
    rows = corpus_pipeline.mixed(spark, docs, "")
    assert rows.columns == docs.columns
    ids = [[r.doc_id for r in part] for part in rows.rdd.glom().collect()]
    places = {}
    for (doc_id, _), at in planned.items():
        places.setdefault(doc_id, []).append(at)
    assert sum(map(len, ids)) == len(planned)
    for part in ids:
        left, last = {d: sorted(places[d]) for d in part}, None
        for d in part:
            # the least place of the document that goes on with the order
            at = next(a for a in left[d] if last is None or a >= last)
            left[d].remove(at)
            last = at
    # both takes of a document lie next to each other no more
    assert sum(a == b for part in ids for a, b in zip(part, part[1:], strict=False)) < 20
