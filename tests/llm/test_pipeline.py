"""The pipeline's stages against plain rules on the smallest tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import quality
from foliospark.llm.common import Scratch
from tests.llm.test_operators import plain_hits, plain_near

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch.put(stage(spark, docs, SF_DIR), name)
        after = [r.doc_id for r in docs.collect()]
        if name == "quality_rules":
            bits = {i: dict(zip(quality.MEASURES, quality.measure(r.text.encode()), strict=True)) for i, r in before.items()}
            clear = {i for i, m in bits.items() if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]}
            assert set(after) <= clear
        elif name == "language_id":
            assert set(after) == set(before)
        elif name == "near_dedup":
            ids = sorted(before)
            labels = plain_near([before[i].text for i in ids])
            assert sorted(after) == sorted({ids[x] for x in labels})
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, r in before.items() if not plain_hits(r.text, items)[1]}
        else:
            assert set(after) <= set(before) and docs.columns == [*columns, "mix"]
            continue
        assert docs.columns == columns and len(after) == len(set(after))


def test_run_equals_the_stages(spark):
    first = corpus_pipeline.run(spark, SF_DIR)
    assert first.count() > 0 and "mix" in first.columns


def test_stages_on_odd_input(spark, tmp_path):
    rng = random.Random(2)
    plain = [" ".join(rng.choices([f"word{k}" for k in range(900)], k=60)) for _ in range(40)]
    texts = [*plain, plain[0], None, "", " \n\t", "w " * 60_000, "!" * 90_000, plain[1] + " once more", plain[2]]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 4 else None, 1, 2) for i, t in enumerate(texts)]
    rows += [(None, plain[3], "en", "s", 1, 2), rows[5], rows[5]]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, `a.b` int, __mix_n int")
    made = made.withColumns({c: F.lit(c) for c in ("mix", "simhash_row", "simhash_words", "language_found", "decontamination_row", "print")})
    benchmark = spark.createDataFrame([("i1", plain[7]), ("i2", None), ("i3", "")], "item_id string, text string")
    for name, docs, items in (("full", made, benchmark), ("empty", made.limit(0), benchmark), ("no_items", made, benchmark.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder)
        kept = found.collect()
        assert found.columns == [*made.columns, "mix_"]
        if name == "empty":
            assert not kept
            continue
        ids = {r.doc_id for r in kept}
        assert not ids & {41, 42, 43, 44, 45}  # no words, or one word repeated
        assert not ids & {40, 46, 47}  # copies of 0, 1 and 2
        assert (7 in ids) == (name == "no_items") and {r["a.b"] for r in kept} == {1}
        assert len({(r.doc_id, r.mix_.epoch) for r in kept}) == len(kept)
