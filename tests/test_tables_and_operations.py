import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliospark import workflows
from foliospark.functions import json_schema, scoring
from foliospark.operators import control, conversation, history, store, tabular
from foliospark.sinks import reports
from foliospark.sources import documents as src, extract
from foliospark.streaming import rolling, watch

PATHS = StructType([StructField("file_path", StringType())])


def now():
    return F.lit(dt.datetime(2024, 5, 1, 12, 0, 0)).cast("timestamp_ntz")


# --- restricted SQL -------------------------------------------------------

@pytest.mark.parametrize(
    "sql",
    ["", "DROP TABLE dataset;", "SELECT * FROM dataset; SELECT 1;", "SELECT * FROM read_csv('dados.csv')", "SELECT * FROM outra_tabela",
     "WITH x AS (SELECT 1) SELECT * FROM dataset", "SELECT * FROM (SELECT 1)", "SELECT * FROM dataset JOIN dataset", "SELECT * FROM dataset, other",
     "SELECT * FROM dataset -- x", "SELECT * FROM dataset UNION SELECT 1", "SELECT * FROM dataset EXCEPT SELECT 1",
     "SELECT java_method('java.lang.System', 'exit') FROM dataset", "SELECT 1", "SELECT id FROM dataset WHERE id IN (SELECT id FROM secret)",
     "SELECT (SELECT count(*) FROM global_temp.gv) FROM dataset", "SELECT id FROM dataset WHERE EXISTS (SELECT 1 FROM default.secret)",
     "INSERT INTO dataset VALUES (1)", "SELECT * FROM dataset INTERSECT SELECT * FROM dataset", "SELECT * FROM range(5)"],
)
def test_blocked_sql(spark, sql):
    with pytest.raises(tabular.BlockedQuery):
        tabular.validate_sql(sql)


def test_sanitize_and_columns(spark):
    assert tabular.sanitize_sql("```sql\nSELECT 1\n```") == "SELECT 1"
    assert tabular.sanitize_sql("SELECT 1;;") == "SELECT 1"
    used = tabular.referenced_columns("SELECT produto, SUM(preco) AS total FROM dataset WHERE cliente = 'Norte' GROUP BY Produto")
    assert used == ["produto", "preco", "cliente"]
    assert tabular.referenced_columns("SELECT * FROM dataset WHERE x = 1") == []
    assert tabular.check_columns(["PRODUTO"], ["produto", "cliente"], "SELECT produto FROM dataset") == ["produto"]
    for claimed, sql in ((["nope"], None), ([], "SELECT nope FROM dataset"), (["cliente"], "SELECT produto FROM dataset")):
        with pytest.raises(tabular.BlockedQuery):
            tabular.check_columns(claimed, ["produto", "cliente"], sql)
    assert tabular.validate_select_only("select 1 -- drop\n;") == "select 1"
    with pytest.raises(tabular.BlockedQuery):
        tabular.validate_select_only("DELETE FROM x")


def test_table_answers(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("produto,prioridade,quantidade,preco,ativo\ncaneta,alta,10,2.50,true\nlapis,baixa,5,1.25,no\n", encoding="utf-8-sig")
    load = lambda s: tabular.read_csv(s, str(path))
    out = tabular.answer(spark, load, "SELECT produto, prioridade FROM dataset WHERE prioridade = 'alta'")
    assert (out["status"], out["rows"], out["columns"]) == ("ok", [("caneta", "alta")], ["produto", "prioridade"])
    assert tabular.answer(spark, load, "SELECT SUM(quantidade) FROM dataset")["answer"] == "Valor: 15"
    assert tabular.answer(spark, load, "SELECT * FROM other")["status"] == "blocked"
    assert tabular.answer(spark, load, "SELECT nope(produto) FROM dataset")["status"] == "error"
    assert tabular.answer(spark, load, "SELECT produto FROM dataset", shown=1)["truncated"] is True
    whole = tabular.answer(spark, load, "SELECT produto AS p FROM dataset ORDER BY p", shown=1)
    assert (whole["row_count"], whole["result"].count(), whole["referenced_columns"]) == (2, 2, ["produto"])
    types = {r["column"]: r["inferred_type"] for r in tabular.infer_types(src.load_csv_rows(spark, str(path))).collect()}
    assert types == {"produto": "TEXT", "prioridade": "TEXT", "quantidade": "INTEGER", "preco": "DOUBLE", "ativo": "BOOLEAN"}


def test_files_and_other_views_are_out_of_reach(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    spark.range(1).createOrReplaceTempView("leak")
    load = lambda s: s.range(3)
    for sql in (f"SELECT (SELECT max(id) FROM parquet.`{tmp_path}/t`) FROM dataset", "SELECT (SELECT max(id) FROM leak) FROM dataset"):
        assert tabular.answer(spark, load, sql)["status"] in ("error", "blocked")


def test_other_separators(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a;b\n1;x\n")
    assert tabular.read_csv(spark, str(tmp_path / "s.csv")).columns == ["a", "b"]
    (tmp_path / "q.csv").write_text('nome;"valor,total"\na;1,5\nb;2,5\n')
    assert tabular.read_csv(spark, str(tmp_path / "q.csv")).columns == ["nome", "valor,total"]


# --- history, dashboard ---------------------------------------------------

def events(spark):
    t = lambda s: dt.datetime(2024, 5, 1, 10, 0, s)
    rows = [(1, "a", t(1), ["x"], "index", True, "index", None), (2, "a", t(5), [], "isolate", False, "audit", None),
            (3, "a", t(5), ["ocr_required"], "ocr_required", False, "audit", None), (4, "b", t(2), [], "index", True, "index", None)]
    return spark.createDataFrame(rows, "id long, file_path string, audit_timestamp timestamp_ntz, flags array<string>, "
                                 "remediation_action string, should_index boolean, source_command string, duplicate_of string")


def test_history(spark):
    h = events(spark)
    latest = {r["file_path"]: r["id"] for r in history.latest_decisions(h).collect()}
    assert latest == {"a": 3, "b": 4}
    assert [r["id"] for r in history.page(history.filter_history(h, "a"), 2, 1).collect()] == [2, 1]
    assert history.filter_history(h, "a", "audit", "isolate").count() == 1
    docs = spark.createDataFrame([("b", ".txt", "cloud", 5), ("c", ".md", "", 7)], "file_path string, file_extension string, theme string, content_length int")
    rows = history.report_rows(docs, history.latest_decisions(h))
    s = history.report_summary(rows).first()
    assert (s["rows_total"], s["indexed_documents"], s["pending_ocr_documents"], s["indexed_without_history"]) == (3, 2, 1, 1)
    counts = {(r["dimension"], r["value"]): r["files"] for r in history.report_counts(rows).collect()}
    assert counts[("flag", "ocr_required")] == 1 and counts[("extension", ".md")] == 1
    runs = spark.createDataFrame([(i, i, "ok" if i % 2 else "error") for i in range(10)], "id int, run_timestamp int, status string")
    assert {r["status"]: r["runs"] for r in history.recent_status_counts(runs, 3).collect()} == {"ok": 2, "error": 1}


def test_dashboard_alerts_health(spark):
    at = lambda h: dt.datetime(2024, 5, 1, 12 - h, 0, 0)
    runs = spark.createDataFrame(
        [(1, at(0), "completed", 1500, 120, "conv", False), (2, at(2), "failed", 52000, 90, None, True)],
        "run_id int, created_at timestamp_ntz, status string, latency_ms long, tokens long, triggered_by string, guardrail_blocked boolean")
    tools = spark.createDataFrame([(1, at(0), "search", "success"), (2, at(0), "search", "error"), (3, at(0), "list", "success")],
                                  "id int, executed_at timestamp_ntz, tool_name string, status string")
    board = control.dashboard(runs, tools)
    b = board.first()
    assert (b["total_runs"], b["guardrail_blocks"], b["total_tool_executions"], b["tool_errors"], b["p95_latency_ms"]) == (2, 1, 3, 1, 1500)
    assert control.in_period(runs, "created_at", now(), "last_1h").count() == 1
    fired = control.alerts(control.metrics(board, F.lit(0.2)), control.rules_table(spark))
    got = {r["rule_id"]: r["severity"] for r in fired.collect()}
    assert got == {"error-rate-warning": "critical", "eval-score-critical": "critical"}
    assert control.health(fired).first()["status"] == "critical"
    assert control.health(fired.limit(0)).first()["status"] == "healthy"
    assert control.alerts(control.metrics(board), control.rules_table(spark)).count() == 1


def test_nearest_rank_against_sorting(spark):
    values = [((i * 7919) % 1000) for i in range(333)] + [5] * 200
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for p in (50, 95, 100):
        want = sorted(values)[max(0, -(-p * len(values) // 100) - 1)]
        assert control.nearest_rank(df, "v", p).first()["p"] == want


def test_versions_and_definition_diff(spark):
    r = spark.range(1).select(control.version_greater(F.lit("1.10.0"), F.lit("1.9.9")).alias("a"), control.version_greater(F.lit("1.0.0"), F.lit("1.0.0")).alias("b")).first()
    assert (r["a"], r["b"]) == (True, False)
    old = spark.createDataFrame([("x", 1, ["a"])], "id string, n int, tools array<string>")
    new = spark.createDataFrame([("x", 1, ["a", "b"])], "id string, n int, tools array<string>")
    assert [r["field"] for r in control.changed_fields(old, new, "id").collect()] == ["tools"]


# --- conversations, scoring ----------------------------------------------

def test_context_window(spark):
    rows = [(1, i, "tool" if i == 0 else "user", "x" * (3000 if i in (0, 59) else 40)) for i in range(60)] + [(2, 0, "user", "hi")]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r for r in conversation.context_summary(m).collect()}
    assert (got[1]["original_messages"], got[1]["final_messages"], got[1]["truncated"]) == (60, 40, True)
    assert (got[2]["final_messages"], got[2]["truncated"]) == (1, False)
    tight = conversation.prepare_context(m.where("conv_id = 1"), max_tokens=10)
    assert sorted(r["turn"] for r in tight.collect()) == [58, 59]
    merged = spark.range(1).select(conversation.merge_facts(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bd")), 2).alias("f")).first()["f"]
    assert merged == ["c", "d"]


def case(spark, **over):
    base = dict(actual_output="Resposta com mongodb [1]", expected_keywords=["mongodb", "atlas"], forbidden_keywords=["senha"], requires_citations=True,
                expected_agents=["k"], actual_agents=["k"], latency_budget_ms=100, actual_latency_ms=50)
    base.update(over)
    schema = ("actual_output string, expected_keywords array<string>, forbidden_keywords array<string>, requires_citations boolean, "
              "expected_agents array<string>, actual_agents array<string>, latency_budget_ms int, actual_latency_ms int")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_answer_scoring(spark):
    r = scoring.score_cases(case(spark)).first()
    assert (r["relevance"], r["faithfulness"], r["citation_coverage"], r["overall_score"], r["passed"]) == (0.5, 1.0, 1.0, 0.825, True)
    r = scoring.score_cases(case(spark, actual_output="a senha", actual_latency_ms=500, actual_agents=[])).first()
    assert (r["faithfulness"], r["guardrail_compliance"], r["latency_budget"], r["tool_success"]) == (0.0, 0.0, 0.0, 0.0)
    c = case(spark, actual_output="senha").select(scoring.critique("actual_output").alias("c")).first()["c"]
    assert not c["approved"] and len(c["violations"]) == 3 and c["confidence"] == 0.0


# --- keyed tables ---------------------------------------------------------

def test_keyed_table_upsert_delete(spark, tmp_path):
    mk = lambda *rows: spark.createDataFrame(list(rows), "file_path string, content_hash string")
    t = store.KeyedTable(spark, str(tmp_path / "t"), "file_path", mk(("a", "1")).schema, file_bytes=200)
    assert t.read().count() == 0
    t.upsert(mk(("a", "1"), ("b", "1"), ("c", "1")))
    incoming = mk(("a", "1"), ("b", "2"), ("d", "1"))
    acts = store.upsert_actions(t.read(), incoming)
    assert {r["file_path"]: r["action"] for r in acts.collect()} == {"a": "unchanged", "b": "updated", "d": "inserted"}
    s = store.action_summary(acts).first()
    assert (s["inserted"], s["updated"], s["unchanged"], s["total"]) == (1, 1, 1, 3)
    assert store.upsert_actions(t.read(), incoming, force=True).where("action = 'unchanged'").count() == 0
    t.upsert(incoming)
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]
    assert t.lookup("b").first()["content_hash"] == "2"
    t.delete(mk(("a", ""), ("b", ""), ("c", "")))
    assert [r["file_path"] for r in t.read().collect()] == ["d"]


def test_keyed_table_keeps_the_old_version_when_a_write_fails(spark, tmp_path):
    mk = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    t = store.KeyedTable(spark, str(tmp_path / "t"), "k", mk(("a", 1)).schema)
    assert t.versions() == [] and t.upsert(mk(("a", 1), ("b", 1), (None, 1))) == 1
    broken = F.udf(lambda k: 1 // (0 if k == "b" else 1), "int")  # half of its rows are written before it fails
    with pytest.raises(Exception, match="ZeroDivisionError"):
        t.upsert(mk(("a", 2), ("b", 2)).repartition(2).withColumn("n", broken("k")))
    assert t.versions() == [1] and state(t) == {"a": 1, "b": 1, None: 1}
    t._write(mk(("a", 9)).withColumn(store.DELETED, F.lit(False)))  # a driver that is lost before the commit
    assert state(t) == {"a": 1, "b": 1, None: 1}
    assert t.delete(mk(("b", 0), (None, 0), ("zz", 0))) == 2 and state(t) == {"a": 1}
    assert {r["k"]: r["n"] for r in t.read(1).collect()} == {"a": 1, "b": 1, None: 1}
    with pytest.raises(ValueError, match="no version 7"):
        t.read(7)
    with pytest.raises(store.Conflict):
        t._commit(2, [])
    assert t.vacuum() > 0 and t.versions() == [2] and state(t) == {"a": 1}
    with pytest.raises(ValueError):
        t.read(1)


def test_keyed_table_merges_runs_geometrically(spark, tmp_path):
    schema = spark.range(1).selectExpr("id", "id AS n").schema
    t = store.KeyedTable(spark, str(tmp_path / "t"), "id", schema, file_bytes=20_000)
    want = {}
    t.upsert(spark.range(20_000).selectExpr("id", "0L AS n"))
    want |= dict.fromkeys(range(20_000), 0)
    for step in range(1, 7):
        t.upsert(spark.range(step * 50, step * 50 + 200).selectExpr("id", f"{step}L AS n"))
        want |= dict.fromkeys(range(step * 50, step * 50 + 200), step)
        t.delete(spark.range(step * 60, step * 60 + 10).toDF("id"))
        for k in range(step * 60, step * 60 + 10):
            want.pop(k, None)
    runs = t._runs()[1]
    assert 1 < len(runs) <= 5 and all(a["bytes"] > b["bytes"] for a, b in zip(runs, runs[1:]))
    assert {r["id"]: r["n"] for r in t.read().collect()} == want
    assert len(t._run(runs[0]["name"]).inputFiles()) > 1 and t.lookup(210).first()["n"] == want[210]


def state(table):
    return {r[0]: r[1] for r in table.read().collect()}


def test_snapshots_versions_cache(spark):
    snap = lambda *rows: spark.createDataFrame(list(rows), "file_path string, size long, mtime long")
    changes = store.snapshot_changes(snap(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), snap(("a", 1, 1), ("b", 2, 1), ("d", 1, 1)))
    assert {r["file_path"]: r["change"] for r in changes.collect()} == {"b": "modified", "c": "removed", "d": "added"}
    m = spark.range(1).select(store.parse_snapshot(F.lit('{"a": [5, 7], "bad": [1]}')).alias("m")).first()["m"]
    assert list(m) == ["a"] and (m["a"]["mtime"], m["a"]["size"]) == (5, 7)
    log = spark.createDataFrame([("r", 1, "running"), ("r", 2, "completed")], "id string, version int, status string")
    assert store.latest_versions(log, "id", "version").first()["status"] == "completed"
    cache = spark.createDataFrame([(f"k{i}", i) for i in range(25)], "k string, inserted int")
    assert sorted(r["inserted"] for r in store.evict_oldest(cache, 20, "k", "inserted").collect()) == list(range(5, 25))
    nulls = spark.createDataFrame([(f"k{i}", i, None if i < 3 else "v") for i in range(6)], "k string, inserted int, v string")
    assert sorted(r["k"] for r in store.evict_oldest(nulls, 4, "k", "inserted").collect()) == ["k2", "k3", "k4", "k5"]
    counted = store.touch(nulls.withColumn("access_count", F.lit(None).cast("long")), nulls.where("k < 'k2'").unionAll(nulls.where("k = 'k0'")), "k")
    assert {r["k"]: r["access_count"] for r in counted.collect()} == {"k0": 2, "k1": 1, "k2": 0, "k3": 0, "k4": 0, "k5": 0}
    hits, misses = store.read_through(cache.limit(0).unionByName(spark.createDataFrame([("k1", 0), ("zz", 0)], cache.schema)), cache.select("k"), "k")
    assert (hits.count(), misses.count()) == (1, 1)


# --- sources, sinks, workflows, streaming ---------------------------------

def docx(path):
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Primeiro</w:t></w:r></w:p><w:p><w:r><w:t>Segundo</w:t></w:r></w:p></w:body></w:document>")


def corpus_folder(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    long = "Um texto com palavras suficientes para formar um bloco valido e aceito pelo filtro de qualidade numero {}. " * 4
    (folder / "a.txt").write_text(long.format(1, 2, 3, 4), encoding="utf-8")
    (folder / "sub" / "latin.txt").write_bytes(("Ação " + long.format(5, 6, 7, 8)).encode("cp1252"))
    (folder / "c.json").write_text(json.dumps({"b": [1, {"x": "y"}], "a": True}))
    (folder / "broken.json").write_text("{")
    (folder / "scan.png").write_bytes(b"\x89PNG")
    (folder / "ignored.bin").write_bytes(b"x")
    docx(folder / "d.docx")
    reports.write_xlsx({"Plan": [["nome", "qtd"], ["caneta", 3]]}, str(folder / "e.xlsx"))
    return folder


def test_load_folder(spark, tmp_path):
    folder = corpus_folder(tmp_path)
    documents, errors = src.load_folder(spark, str(folder))
    got = {r["file_path"].rsplit("/", 1)[-1]: r for r in documents.collect()}
    assert set(got) == {"a.txt", "latin.txt", "c.json", "d.docx", "e.xlsx"}
    assert got["latin.txt"]["content"].startswith("Ação")
    assert got["c.json"]["content"].splitlines()[1] == '  "a": true,'
    assert got["d.docx"]["content"] == "Primeiro\n\nSegundo"
    assert got["e.xlsx"]["content"] == "[Sheet: Plan]\nnome\tqtd\ncaneta\t3"
    assert json.loads(got["e.xlsx"]["metadata_json"])["sheet_names"] == ["Plan"]
    assert sorted(r["file_path"].rsplit("/", 1)[-1] for r in errors.collect()) == ["broken.json", "scan.png"]
    assert src.list_folder(spark, str(folder)).count() == 7
    with pytest.raises(extract.LoadError):
        src.load_folder_strict(spark, str(folder))
    flat = spark.createDataFrame([('{"b": [1, {"x": "y"}]}',), ("no json",)], ["t"]).select(src.flattened_json("t").alias("f"))
    assert [r["f"] for r in flat.collect()] == ['b[0]: 1\nb[1].x: "y"', "no json"]


def test_index_folder_is_incremental(spark, tmp_path):
    folder, root = corpus_folder(tmp_path), str(tmp_path / "root")
    first = workflows.index_folder(spark, str(folder), root, now())
    decided = {r["file_path"].rsplit("/", 1)[-1]: r["action"] for r in first.decisions.collect()}
    assert decided["scan.png"] == "ocr_required" and decided["d.docx"] == "isolate"
    n = first.actions.where("action = 'inserted'").count()
    assert n == first.decisions.where("should_index").count() > 0
    again = workflows.index_folder(spark, str(folder), root, now())
    assert again.actions.where("action <> 'unchanged'").count() == 0
    (folder / "a.txt").unlink()
    third = workflows.index_folder(spark, str(folder), root, now())
    assert third.removed.count() == 1
    report = workflows.report(spark, root)
    payload = reports.summary_payload(history.report_summary(report), history.report_counts(report), "2024-05-01")
    assert payload["summary"]["pending_ocr_documents"] == 1
    assert "pending ocr documents: 1" in reports.markdown(payload)
    reports.report_workbook(payload, str(tmp_path / "r.xlsx"))
    text, meta = extract.xlsx_text((tmp_path / "r.xlsx").read_bytes())
    assert "Summary" in meta["sheet_names"] and "pending_ocr_documents\t1" in text
    for fmt in ("csv", "json"):
        reports.write_rows(report, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == report.count()


def test_watch_cycles_and_stream(spark, tmp_path):
    folder = corpus_folder(tmp_path)
    seen = []
    process = lambda docs, errs, gone: seen.append((docs.count(), errs.count()))
    changes = watch.watch_cycle(spark, str(folder), str(tmp_path / "snap"), process)
    assert changes.count() == 7 and seen == [(5, 2)]
    assert watch.watch_cycle(spark, str(folder), str(tmp_path / "snap"), process).count() == 0
    (folder / "a.txt").write_text("changed text that is longer than before" * 20)
    (folder / "c.json").unlink()
    got = {r["file_path"].rsplit("/", 1)[-1]: r["change"] for r in watch.watch_cycle(spark, str(folder), str(tmp_path / "snap"), process).collect()}
    assert got == {"a.txt": "modified", "c.json": "removed"} and seen[-1] == (1, 0)
    streamed = []
    q = watch.stream_new_files(spark, str(folder), str(tmp_path / "ck"), lambda d, e, gone: streamed.append((d.count(), e.count())))
    q.awaitTermination(60)
    assert streamed == [(4, 2)]
    for f in [f for f in folder.rglob("*") if f.is_file()]:
        f.unlink()
    assert watch.watch_cycle(spark, str(folder), str(tmp_path / "snap"), process).where("change = 'removed'").count() == 6
    assert watch.watch_cycle(spark, str(folder), str(tmp_path / "snap"), process).count() == 0


def test_watch_keeps_unchanged_documents_indexed(spark, tmp_path):
    folder, root, snap = corpus_folder(tmp_path), str(tmp_path / "root"), str(tmp_path / "snap")
    process = workflows.watch_process(spark, root, now)
    stored = lambda: {r["file_path"].rsplit("/", 1)[-1] for r in store.KeyedTable(spark, f"{root}/documents", "file_path", PATHS).read().collect()}
    watch.watch_cycle(spark, str(folder), snap, process)
    first = stored()
    assert len(first) > 1 and "a.txt" in first
    (folder / "new.txt").write_text((folder / "a.txt").read_text().replace("numero 1", "numero 99 e um final novo"))
    watch.watch_cycle(spark, str(folder), snap, process)
    assert stored() == first | {"new.txt"}
    (folder / "a.txt").unlink()
    watch.watch_cycle(spark, str(folder), snap, process)
    assert stored() == (first | {"new.txt"}) - {"a.txt"}


def test_hourly_stream_matches_batch_and_drops_late_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp_ntz, event_type string, value double"
    batches = [[(at(1), "view", 1.0), (at(1, 30), "view", 2.0)], [(at(9), "view", 1.0)], [(at(1, 5), "view", 100.0), (at(20), "view", 1.0)], [(at(23), "view", 0.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = rolling.hourly(s).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = {r["hour"].hour: (r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (2, 3.0) and got[9] == (1, 1.0)


def test_schedule(spark):
    def boom():
        raise RuntimeError("no folder")

    run = workflows.run_schedule(spark, {"audit": lambda: {"documents": 3}, "report": boom})
    assert run["status"] == "error" and run["steps"]["evaluate"]["status"] == "skipped" and workflows.exit_code(run) == 1
    ok = workflows.run_schedule(spark, {"evaluate": lambda: {"status": "partial", "critical": True, "regressions": ["mrr fell"]}}, ["evaluate"])
    assert ok["status"] == "partial" and workflows.exit_code(ok) == 2


def test_json_schema(spark):
    schema = {"type": "object", "required": ["nome"], "properties": {
        "nome": {"type": "string", "minLength": 3}, "idade": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "maxItems": 1, "items": {"enum": ["a", "b"]}},
        "id": {"oneOf": [{"type": "string"}, {"type": "number"}]}}}
    rows = ['```json\n{"nome": "Ana"}\n```', '{"nome": "A", "idade": -1, "tags": ["a", "c"], "id": true}', "{}", "x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", json_schema.check("t", schema).alias("v")).collect()}
    assert got[0] == [] and len(got[1]) == 5 and got[2] == ["$.nome: required field is missing"] and got[3] == ["$: not valid JSON"]


def test_eval_query_files(spark, tmp_path):
    q = [{"query": "x", "expected_files": ["a"]}]
    (tmp_path / "l.json").write_text(json.dumps(q))
    (tmp_path / "o.json").write_text(json.dumps({"queries": q}))
    for name in ("l.json", "o.json"):
        r = src.load_eval_queries(spark, str(tmp_path / name)).first()
        assert (r["query"], r["expected_files"], r["description"], r["min_score"]) == ("x", ["a"], "", 0.0)


def test_missing_dimensions_and_base_folder(spark):
    dims = list(scoring.WEIGHTS)
    rows = spark.createDataFrame([(1.0, None, *[0.5] * 5), (*[None] * 7,)], ", ".join(f"{d} double" for d in dims))
    got = [r["overall_score"] for r in scoring.with_overall(rows).collect()]
    weights = list(scoring.WEIGHTS.values())
    assert got == [round((weights[0] + 0.5 * sum(weights[2:])) / (sum(weights) - weights[1]), 3), None]
    from foliospark.functions import text as tx

    paths = spark.createDataFrame([("C:\\in\\a.txt",), ("C:/other/a.txt",)], "p string").select(tx.portable_path("p", "C:\\in").alias("p"))
    assert [r["p"] for r in paths.collect()] == ["a.txt", "C:/other/a.txt"]
