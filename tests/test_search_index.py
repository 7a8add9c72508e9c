"""The stored index: what it holds, and its rankings against the ones that scan the texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import stemming
from foliospark.operators import chunking, retrieval, search_index as si

SCHEMA = "file_path string, file_extension string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma_ray", "Délta", "ray", "x_y_z", "x", "y", "common"] + [f"w{k}" for k in range(80)]
    texts = [" ".join([*rng.choices(words, k=rng.randint(0, 60)), "common"] * rng.randint(1, 12)) for _ in range(60)]
    texts += ["", " !! ", None, texts[5], texts[5], texts[5]]
    rows = [(f"dir{k % 7}/{k:03d}.txt", ".txt", t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return docs.select("file_path", F.coalesce("content", F.lit("")).alias("content"), "file_extension")


@pytest.fixture(scope="module")
def chunked(corpus):
    return chunking.with_chunks(corpus, max_chars=120, overlap=10, keep_quality=False)


@pytest.fixture(scope="module")
def index(spark, chunked, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    fields = (si.DOCUMENTS, si.FOLDED_DOCUMENTS, si.CHUNKS, si.FOLDED_CHUNKS)
    si.write(chunked.select("file_path", "content", "chunks"), path, fields, block=3, segment_bits=2)  # many segments and blocks
    return si.Index(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["alpha beta common", "gamma_ray ray", "x_y_z", "common", "w1 w2 w3 w4", "nothing here", "005 dir5", "Délta delta", "common common w7"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")


def rows(df, *columns):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_chunk_search_agrees_with_the_scan(index, chunked, queries):
    chunks = chunking.explode_chunks(chunked, "file_path")
    columns = ("query_id", "file_path", "chunk_index", "score", "rank")
    want = rows(retrieval.search_chunks(chunks, queries, 7), *columns)
    assert rows(si.search_chunks(index, queries, 7), *columns) == want and any(r[0] == 2 for r in want)


@pytest.mark.parametrize("limit", [3, 40, 200])
def test_document_ranking_agrees_with_the_scan(index, corpus, queries, limit):
    columns = ("query_id", "file_path", "score", "rank")
    assert rows(si.rank_documents(index, queries, limit), *columns) == rows(retrieval.rank_documents(corpus, queries, limit), *columns)


def test_rolled_up_chunks_agree_with_the_scan(index, chunked, queries):
    chunks = chunking.explode_chunks(chunked, "file_path")
    columns = ("query_id", "file_path", "score", "rank")
    assert rows(si.search_relevant_documents(index, queries, 4), *columns) == rows(retrieval.search_relevant_documents(chunks, queries, 4), *columns)


def test_places_restore_the_texts(index, chunked):
    blocks = index.field(si.CHUNKS).blocks.collect()
    held = {}
    for b in blocks:
        number, at = 0, 0
        for k in range(b.n):
            number += b.docs[k]
            place = 0
            for step in b.places[at : at + b.tfs[k]]:
                place += step
                held.setdefault(number, {})[place] = b.term
            at += b.tfs[k]
            assert b.lens[k] >= b.tfs[k]
        assert at == len(b.places) and b.n <= 3
    from foliospark.functions import text as tx

    paths = {r.position: r.file_path for r in index.files.collect()}
    assert [p for _, p in sorted(paths.items())] == sorted(paths.values())
    want = {
        (r.file_path, r.chunk_index): r.tokens
        for r in chunking.explode_chunks(chunked, "file_path").withColumn("tokens", tx.search_tokens("text")).collect()
        if r.tokens
    }
    got = {(paths[n >> si.CHUNK_BITS], n & ((1 << si.CHUNK_BITS) - 1)): [t for _, t in sorted(p.items())] for n, p in held.items()}
    assert got == want


def test_an_empty_corpus_can_be_searched(spark, queries, tmp_path):
    docs = spark.createDataFrame([], "file_path string, content string, chunks array<string>")
    si.write(docs, str(tmp_path), (si.DOCUMENTS, si.CHUNKS, si.FOLDED_CHUNKS))
    empty = si.Index(spark, str(tmp_path))
    assert si.search_chunks(empty, queries, 3).count() == 0
    assert si.rank_documents(empty, queries, 3).count() == 0
    assert si.search_relevant_documents(empty, queries, 3).count() == 0


def test_published_stems(spark):
    known = """boa boa,boassu boassu,boataria boat,boatos boat,bobagem bobag,bobagens bobagens,quiabo quiab,quicaram quic,quieto quiet,
quilates quilat,quilinhos quilinh,quilométricas quilometr,documentação document,cidades cidad,rapidamente rapid,informações inform,
tecnologias tecnolog,existência existent,ativamente ativ,segue seg,x_1 x_1,é e"""
    pairs = [tuple(k.split()) for k in known.replace("\n", "").split(",")]
    out = stemming.with_stems(spark.createDataFrame([*pairs, (None, None)], "term string, want string"))
    assert out.where(~F.col("stem").eqNullSafe(F.col("want"))).collect() == [] and out.columns == ["term", "want", "stem"]


def test_stemmed_search_finds_inflected_forms(spark, tmp_path):
    texts = {
        "a": "A informação foi documentada rapidamente", "b": "informações e informações novas", "c": "nada aqui", "d": "INFORMAR a cidade",
        "e": "cidades cidades cidade", "f": "", "g": "informação informações informar",
    }
    docs = spark.createDataFrame(list(texts.items()), "file_path string, content string")
    si.write(docs, str(tmp_path / "i"), (si.DOCUMENTS,), block=2, segment_bits=1)
    index = si.Index(spark, str(tmp_path / "i"))
    si.write_stems(index, si.DOCUMENTS)
    asked = spark.createDataFrame([(1, "informou"), (2, "Cidade"), (3, "inexistente"), (4, "")], "query_id bigint, query string")
    got = {}
    for r in si.search_stemmed(index, asked, 10).collect():
        got.setdefault(r.query_id, {})[r.file_path] = r.score
    assert set(got) == {1, 2} and set(got[1]) == set("abdg") and set(got[2]) == set("de")
    # One term with the summed frequency: 4 of 6 documents with words hold it, g three times in three words.
    n, df, total = 6, 4, 5 + 4 + 2 + 3 + 3 + 3
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert got[1]["g"] == pytest.approx(idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 3 / (total / n))), abs=1e-6)


def test_queries_go_once_to_each_segment_of_a_term(spark, index, monkeypatch):
    def counting(*_):
        def run(batches):
            import pyarrow as pa

            for table in si._groups(batches, 1):
                asked = sum(len(x) for x in table["asked"].to_pylist() if x)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([asked]), pa.array([0.0])], ["query_id", "doc", "score"])

        return run

    monkeypatch.setattr(si, "_score", counting)
    postings = index.field(si.DOCUMENTS)
    blocks = postings.blocks.where("term = 'common'")
    weights = spark.createDataFrame([(k, "common", 1.0) for k in range(50)], "query_id bigint, term string, weight double")
    sent = postings.best(blocks, weights, 1.5, 0.75, 3).agg(F.sum("doc")).first()[0]
    assert sent == 50 * blocks.select("segment").distinct().count() < 50 * blocks.count()


def test_fields_are_added_to_a_written_index(spark, corpus, chunked, queries, tmp_path):
    made = chunking.with_chunks(corpus)
    si.write(corpus, str(tmp_path / "a"), ())
    si.write(made.select("file_path", "content", "chunks"), str(tmp_path / "b"), (si.CHUNKS,))
    si.add_field(spark, str(tmp_path / "a"), si.CHUNKS)
    found = [rows(si.search_chunks(si.Index(spark, str(tmp_path / x)), queries, 5), "query_id", "file_path", "chunk_index", "score", "rank") for x in "ab"]
    assert found[0] == found[1] and found[0]


def test_rows_of_one_path_are_one_document_of_the_merged_search(spark, tmp_path):
    texts = [f"common alpha w{k % 5} gamma_ray beta{k % 3}" for k in range(30)]
    names = [None if k % 7 == 3 else f"d/{k % 9}.txt" for k in range(30)]
    docs = spark.createDataFrame([(p, t, [t, f"common w{k % 4} alpha alpha"]) for k, (p, t) in enumerate(zip(names, texts, strict=True))],
                                 "file_path string, content string, chunks array<string>").repartition(4)
    si.write(docs, str(tmp_path), (si.CHUNKS,), block=2, segment_bits=1)
    index = si.Index(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "alpha w1"), (2, "gamma_ray common"), (None, "beta2 w3"), (4, "zzz")], "query_id bigint, query string")
    columns = ("query_id", "file_path", "chunk_index", "score", "rank")
    key = lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)
    found = lambda df: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=key)
    want = found(retrieval.search_chunks(chunking.explode_chunks(docs, "file_path"), asked, 6))
    assert found(si.search_chunks(index, asked, 6, merged=True)) == want and {r[0] for r in want} == {1, 2, None}
    assert len({r[:3] for r in want}) == len(want) and any(r[1] is None for r in want)
    # All rows of a path are in one segment, though positions are numbered on.
    rows_of = spark.read.parquet(f"{tmp_path}/rows")
    assert rows_of.select("position").distinct().count() == 30
    assert rows_of.groupBy("file_path").agg(F.count_distinct("first").alias("n")).where("n > 1").count() == 0


def test_excerpts_come_from_the_stored_index_and_only_hit_files_are_read_again(spark, tmp_path):
    from foliospark.plans import structured

    rng = random.Random(9)
    words = [f"word{k}" for k in range(400)]
    long = [(k, " ".join(rng.choices(words, k=300)), "en", f"s{k % 3}", 0) for k in range(150)]
    long += [long[5], long[7], (151, None, "en", "s1", 0), (152, long[8][1], "en", None, 0)]
    spark.createDataFrame(long, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "word3 word5 word9"), (2, "word17"), (3, "nothing"), (4, None), (4, "word20 word21")]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits, files = structured.chunk_hits(spark, str(tmp_path))
    paths = hits.select("file_path").where("file_path IS NOT NULL").distinct().count()
    assert files.select("file_path").distinct().count() == paths < 100  # all texts were cut and written before
    chunks = chunking.explode_chunks(chunking.with_chunks(structured.corpus(spark, str(tmp_path))), "file_path")
    scanned = retrieval.search_chunks(chunks, structured.benchmark_queries(spark, str(tmp_path)), 20).localCheckpoint()
    columns = ("query_id", "file_path", "excerpts", "text_sha")
    want = retrieval.matched_chunks(scanned, chunks).select(
        "query_id", "file_path", F.size("matched_chunks").alias("excerpts"), F.sha2(F.array_join("matched_chunks", "|"), 256).alias("text_sha"))
    assert rows(structured.matched_chunks(spark, str(tmp_path)), *columns) == rows(want, *columns)
    context = retrieval.answer_context(scanned, chunks, structured.corpus(spark, str(tmp_path)))
    want = context.select("query_id", F.sha2("context", 256).alias("context_sha"))
    assert rows(structured.prompt_context(spark, str(tmp_path)), "query_id", "context_sha") == rows(want, "query_id", "context_sha")


def test_accepted_chunks_are_those_without_a_quality_reason(spark):
    letters, other = "ação niño ũé ", "12 34 56 78 9 "
    made = [a * i + b * j + tail for a in (letters, "plain words here ", "é ") for b in (other, "²³ ¹ ", "-- ! ", "日本 ") for i in (0, 1, 2, 5, 9) for j in (0, 1, 3, 8) for tail in ("", "x y z v w q")]
    made += ["Summário " + "alpha beta gamma delta epsilon " * 3, "İndex " * 30, "same " * 30 + "a b c d", "same " * 30 + "a b c"]
    made += ["a" * k + "1" * (100 - k) + " b c d e" for k in (20, 27, 28, 29, 30, 31, 35, 39, 40, 41, 49, 50, 60)]
    chunks = spark.createDataFrame([(t.strip(),) for t in made], "t string")
    got = chunks.select("t", chunking.quality_reason("t").isNull().alias("kept")).collect()
    assert [chunking._accepted(r.t) for r in got] == [r.kept for r in got] and len({r.kept for r in got}) == 2


def test_null_texts_are_indexed_as_empty_ones(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", None), ("c", "alpha")], "file_path string, content string")
    si.write(docs, str(tmp_path), (si.DOCUMENTS, si.FOLDED_DOCUMENTS))
    index = si.Index(spark, str(tmp_path))
    assert [(index.field(f).rows, index.field(f).total) for f in (si.DOCUMENTS, si.FOLDED_DOCUMENTS)] == [(2, 3), (3, 3)]
    asked = spark.createDataFrame([(1, "beta")], "query_id bigint, query string")
    assert [r.file_path for r in si.rank_simple(index, asked, 5).collect()] == ["a"]
