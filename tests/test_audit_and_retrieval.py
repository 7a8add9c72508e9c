import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import audit, chunking, dedup, evaluation, index, remediation, retrieval, skew, vector
from foliospark.staging import stage


def docs(spark, *pairs):
    rows = [(p, "." + p.rsplit(".", 1)[-1], c) for p, c in pairs]
    return spark.createDataFrame(rows, "file_path string, file_extension string, content string")


def flags_of(spark, *pairs):
    audited = audit.audit_documents(docs(spark, *pairs))
    return {r["file_path"]: r for r in audited.collect()}


PROSE = "The quick brown fox jumps over lazy dogs while clever people write tests about chunks number {} today. "


def prose(n, tail=""):
    return "".join(PROSE.format(f"w{n}x{i} y{n}z{i}") for i in range(5)) + tail


def test_unusable_and_repetitive_documents(spark):
    got = flags_of(
        spark,
        ("/n.txt", "12345 67890 " * 40),
        ("/r.txt", "\n".join(["the same line repeated again and again"] * 12)),
        *[(f"/ok{i}.txt", prose(i)) for i in range(4)],
    )
    assert {"no_usable_chunks", "numeric_heavy"} <= set(got["/n.txt"]["flags"])
    assert "repetitive_content" in got["/r.txt"]["flags"]


def test_length_outlier(spark):
    pairs = [(f"/s{i}.txt", f"short text number {i} " * 3) for i in range(5)]
    got = flags_of(spark, *pairs, ("/big.txt", " ".join(f"word{i}" for i in range(1500))))
    assert {"char_count_outlier", "token_count_outlier"} <= set(got["/big.txt"]["flags"])


def test_clusters_and_duplicates(spark):
    a = "Python decorators wrap functions and classes with reusable behaviour and generators yield values lazily"
    got = flags_of(
        spark,
        ("/a.txt", a + " today"),
        ("/b.txt", a + " tomorrow"),
        ("/c.txt", "Quarterly revenue invoices taxation ledger balance auditing budget forecast expense"),
        ("/d.txt", "Same document with   spaces"),
        ("/e.txt", "same document   WITH spaces"),
    )
    assert got["/a.txt"]["cluster_id"] == got["/b.txt"]["cluster_id"] == "/a.txt"
    assert got["/c.txt"]["cluster_id"] is None
    assert got["/e.txt"]["duplicate_of"] == "/d.txt" and got["/d.txt"]["duplicate_of"] is None
    plan = {r["file_path"]: r for r in remediation.plan(audit.audit_documents(docs(
        spark, ("/a.txt", a + " today"), ("/b.txt", a + " today"), ("/z.txt", "1 2 3")))).collect()}
    assert plan["/b.txt"]["action"] == "ignore_duplicate" and not plan["/b.txt"]["should_index"]
    assert plan["/z.txt"]["action"] == "isolate"


def test_policy_override_downgrades_to_review(spark):
    flags = F.array(F.lit("very_short_document"))
    row = spark.range(1).select(
        remediation.action(flags).alias("default"),
        remediation.action(flags, remediation.isolate_policy("numeric_heavy, ,NUMERIC_heavy")).alias("custom"),
    ).first()
    assert (row["default"], row["custom"]) == ("isolate", "index_with_review")
    assert remediation.isolate_policy("numeric_heavy, ,NUMERIC_heavy") == ("numeric_heavy",)


def test_duplicates_keep_smallest_path_even_when_hot(spark):
    pairs = [("/z.txt", "duplicated"), ("/a.txt", "duplicated"), ("/u.txt", "unique")]
    pairs += [(f"/h{i:04d}.txt", "hot copy") for i in range(400)]
    d = docs(spark, *pairs)
    got = {r["file_path"]: r["duplicate_of"] for r in dedup.detect_duplicates(dedup.with_fingerprint(d)).collect()}
    assert got["/z.txt"] == "/a.txt" and len(got) == 400
    assert all(v == "/h0000.txt" for k, v in got.items() if k.startswith("/h"))
    assert dedup.unique_documents(d).count() == 3


def test_empty_documents_share_one_fingerprint(spark):
    d = docs(spark, ("/a.txt", ""), ("/b.txt", "   "))
    assert dedup.detect_duplicates(dedup.with_fingerprint(d)).first()["file_path"] == "/b.txt"


def test_batches_follow_scan_order(spark):
    rows = [(f"/{i}.txt", 0, random.Random(i).randint(1, 9)) for i in range(37)]
    df = spark.createDataFrame(rows, "file_path string, scan_priority int, size_bytes int")
    got = {r["file_path"]: r["batch_id"] for r in audit.assign_batches(df, 10).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert [got[r[0]] for r in want] == [i // 10 for i in range(37)]
    assert {r["batch_id"] for r in audit.assign_batches(df, 10**6).collect()} == {0}
    with pytest.raises(ValueError):
        audit.assign_batches(df, 0)


def test_robust_stats(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 2, 2, 4, 6, 9)], ["v"])
    r = audit.robust_stats(df, "v").first()
    assert (r["median"], r["mad"]) == (2.0, 1.0)


def test_error_decisions(spark):
    errors = spark.createDataFrame(
        [("Falha ao carregar /a.pdf: PDF sem texto extraivel: /a.pdf",), ("Falha ao carregar /b.png: Imagem requer OCR",),
         ("Falha ao carregar /c.txt: outro",), ("sem prefixo",)], ["error"])
    got = {r["file_path"]: r["action"] for r in remediation.error_decisions(errors).collect()}
    assert got == {"/a.pdf": "ocr_required", "/b.png": "ocr_required"}
    s = remediation.error_summary(errors).first()
    assert (s["total"], s["pdf_without_text"], s["image_requires_ocr"], len(s["samples"])) == (4, 1, 1, 3)


def test_salted_lookup_keeps_every_row(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = facts.groupBy("k").agg(F.min("id").alias("first"))
    got = skew.salted_lookup(facts, groups, "k", "id")
    assert got.count() == 1000 and got.where("k = 1").select("first").distinct().count() == 1


def bm25_brute(texts, query, kind):
    toks = [t.lower().split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    vocab = {w for t in toks for w in t}
    df = {w: sum(w in t for t in toks) for w in vocab}
    okapi = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(okapi.values()) / len(okapi)
    out = []
    for t in toks:
        s = 0.0
        for w in query.lower().split():
            tf = t.count(w)
            if not tf:
                continue
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if kind == "simple" else okapi[w]
            if kind == "okapi" and idf < 0:
                idf = 0.25 * mean
            s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append(round(s, 6))
    return out


def test_bm25_variants_against_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    texts += ["only omega here and nothing else"] * 5
    d = docs(spark, *[(f"/{i:03d}.txt", t) for i, t in enumerate(texts)])
    query = "alpha omega omega beta"
    qs = spark.createDataFrame([(1, query)], ["query_id", "query"])
    okapi = {r["file_path"]: r["score"] for r in retrieval.rank_documents(d, qs, 100).collect()}
    want = bm25_brute(texts, query, "okapi")
    assert len(okapi) == len(texts)
    for i, w in enumerate(want):
        assert okapi[f"/{i:03d}.txt"] == pytest.approx(w, abs=2e-6)
    wanted = retrieval.query_terms(qs, retrieval.tx.folded_tokens("query"))
    scan = index.scan_terms(d, ["file_path"], retrieval.tx.folded_tokens("content"), stage(wanted, "w"))
    simple = {r["file_path"]: r["score"] for r in retrieval.bm25_simple(scan, wanted).collect()}
    for i, w in enumerate(bm25_brute(texts, query, "simple")):
        assert simple.get(f"/{i:03d}.txt", 0.0) == pytest.approx(w, abs=2e-6)


def test_ranking_fallbacks(spark):
    d = docs(spark, *[(f"/{c}.txt", f"text {c}{c}{c} filler{c}") for c in "abcdef"])
    nothing = spark.createDataFrame([(1, "unknownword other stuff")], ["query_id", "query"])
    assert [r["file_path"] for r in retrieval.rank_documents(d, nothing, 2).orderBy("rank").collect()] == ["/e.txt", "/f.txt"]
    named = spark.createDataFrame([(1, "c")], ["query_id", "query"])
    r = retrieval.rank_documents(d, named, 1).first()
    assert (r["file_path"], r["score"]) == ("/c.txt", 0.1)
    few = spark.createDataFrame([(1, "bbb zzz yyy")], ["query_id", "query"])
    assert [r["file_path"] for r in retrieval.rank_documents(d, few, 3).orderBy("rank").collect()] == ["/b.txt", "/a.txt", "/c.txt"]


def test_phrase_search_needs_adjacency(spark):
    chunks = spark.createDataFrame(
        [("/a", 0, "vector search is here"), ("/b", 0, "search the vector"), ("/c", 0, "unrelated words"), ("/d", 0, "more text"),
         ("/e", 0, "still more")], "file_path string, chunk_index int, text string")
    qs = spark.createDataFrame([(1, "vector_search")], ["query_id", "query"])
    assert [r["file_path"] for r in retrieval.search_chunks(chunks, qs, 10).collect()] == ["/a"]


def test_hybrid_finds_the_matching_document(spark):
    d = docs(
        spark,
        ("mongodb-notes.md", "MongoDB indexing and transactions guide. " + prose(1)),
        ("vector-guide.md", "Embeddings and agents with vector search. " + prose(2)),
        *[(f"other{i}.md", prose(10 + i)) for i in range(6)],
    )
    stored = stage(index.stored_documents(d), "stored")
    qs = spark.createDataFrame([(1, "mongodb indexing transactions"), (2, "embeddings agents")], ["query_id", "query"])
    got = retrieval.hybrid(stored, qs, 3)
    best = {r["query_id"]: r for r in got.where("rank = 1").collect()}
    assert best[1]["file_path"] == "mongodb-notes.md" and best[2]["file_path"] == "vector-guide.md"
    assert best[1]["score"] > 0 and best[1]["metadata_bonus"] > 0
    chunks = chunking.explode_chunks(stored, "file_path")
    hits = retrieval.search_chunks(chunks, qs, 12)
    assert all(1 <= len(r["matched_chunks"]) <= 3 for r in retrieval.matched_chunks(hits, chunks).collect())
    with pytest.raises(ValueError):
        retrieval.hybrid(stored, qs, 0)


def test_persisted_index_gives_the_same_hits(spark, tmp_path):
    d = docs(spark, *[(f"/{i}.txt", prose(i)) for i in range(8)])
    index.write_index(d, str(tmp_path / "idx"))
    terms = ["clever", "w3x1"]
    scan = index.read_index(spark, str(tmp_path / "idx"), "doc_postings", ["file_path"], terms)
    assert scan.rows == 8 and scan.hits.where("term = 'clever'").count() == 8
    assert [r["file_path"] for r in scan.hits.where("term = 'w3x1'").collect()] == ["/3.txt"]


def test_metadata_bonus(spark):
    meta = F.struct(F.lit("bancos").alias("theme"), F.array(F.lit("mongodb")).alias("stack"), F.array(F.lit("vector_search")).alias("concepts"))
    score = lambda *terms: spark.range(1).select(
        retrieval.metadata_bonus(meta, F.array(*[F.lit(t) for t in terms]).cast("array<string>")).alias("b")).first()["b"]
    assert score("mongodb") == 1.5
    assert score("mongodb", "nothing") == 0.75
    assert score("zebra") == 0.0


@pytest.mark.parametrize(
    "scores,level", [([10, 5, 2], "high"), ([6], "medium"), ([2, 1], "medium"), ([2, 1.9], "low"), ([0.4], "abstain"), ([0.0], "abstain")]
)
def test_confidence(spark, scores, level):
    df = spark.createDataFrame([(1, float(s), i + 1) for i, s in enumerate(scores)], "query_id int, score double, rank int")
    assert retrieval.confidence(df).first()["level"] == level


def test_ir_metrics(spark):
    ranked = spark.createDataFrame(
        [(1, "x/mongo.pdf", 1), (1, "x/atlas.pdf", 2), (1, "x/other.pdf", 3), (2, "o", 1), (2, "Mongo", 2), (3, "o", 1)],
        "query_id int, file_path string, rank int")
    expected = spark.createDataFrame([(1, ["MONGO", "atlas"]), (2, ["mongo"]), (3, ["mongo"]), (4, ["x"])], "query_id int, expected_files array<string>")
    got = {r["query_id"]: r for r in evaluation.query_metrics(ranked, expected).collect()}
    assert (got[1]["ndcg_at_k"], got[1]["reciprocal_rank"], got[1]["precision_at_k"]) == (1.0, 1.0, 0.6667)
    assert 0 < got[2]["ndcg_at_k"] < 1 and got[2]["reciprocal_rank"] == 0.5
    assert got[3]["ndcg_at_k"] == 0.0 and got[4]["precision_at_k"] == 0.0
    totals = evaluation.aggregate_metrics(evaluation.query_metrics(ranked, expected))
    worse = totals.withColumn("mrr", F.lit(0.1))
    assert [r["metric"] for r in evaluation.regressions(worse, totals).collect()] == ["mrr"]
    assert evaluation.regressions(totals, totals).count() == 0


def test_vector_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = vector.nearest(df, F.array(F.lit(1.0), F.lit(0.0)), 2, active=F.col("vec_id") != 1).collect()
    assert [(r["vec_id"], r["similarity"]) for r in got] == [(3, 0.707107), (2, 0.0)]
