"""The pipeline's stages on odd tables: nulls in every column, repeated rows, clashing names, no rows."""

import pytest

import corpus_pipeline

TEXT = " ".join(f"word{k}" for k in range(70))
NAMES = ["row", "kept", "failed_rule", "kept_text", "n_words", "shard", "place", "takes", "block", "words", "component_id", "part", "a.b"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES)
ROWS = [(1, TEXT), (1, TEXT), (2, TEXT), (None, TEXT + " more"), (None, None), (3, ""), (4, "Short but good."), (None, "Another good one."), (5, None)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame([(d, t, None, None if k % 2 else "s", None if t is None else len(t), *range(len(NAMES))) for k, (d, t) in enumerate(rows)], COLUMNS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, before, "")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == before.dtypes
            assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in kept[name])
    if not rows:
        return
    ids = lambda name: sorted((str(r.doc_id) for r in kept[name]))
    assert ids("quality_rules") == ["1", "1", "2", "4", "None", "None"]
    assert ids("ngram_jaccard_join") == ["1", "1", "4", "None", "None"]  # 2 is a copy of 1; rows without an id stay
    texts = [r.text for r in kept["substring_dedup"]]
    # the rows without an id come first, so the text of 1 starts earlier there
    assert sorted(len(t.split()) for t in texts) == [0, 0, 3, 3, 71]
    assert {r.n_chars == len(r.text) for r in kept["substring_dedup"]} == {True}
    assert kept["source_mixing"] and all(r.n_chars == len(r.text) for r in kept["source_mixing"])
    assert sum(r.length for r in kept["packing"]) == sum(p.doc_tokens for p in kept["packing"] if p.start == 0)
