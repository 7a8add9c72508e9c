"""Change logs against a plain fold, trace trees on incomplete logs."""

import random

from pyspark.sql import functions as F

from foliospark.operators import changelog as cl, control, retrieval, store, traces

RULES = {"name": cl.Set(), "born": cl.SetOnce(), "n": cl.Add(), "tail": cl.Append(last=3), "all": cl.Append()}
SCHEMA = "key string, at int, name string, born int, n long, tail string, all string, dead boolean"


def plain(log):
    """One change after another."""
    rows = {}
    for key, _, name, born, n, tail, everything, dead in sorted(log, key=lambda r: r[1]):
        if dead:
            rows.pop(key, None)
            continue
        r = rows.setdefault(key, [None, None, 0, [], []])
        r[0] = name if name is not None else r[0]
        r[1] = r[1] if r[1] is not None else born
        r[2] += n or 0
        r[3] = [*r[3], *([tail] if tail is not None else [])][-3:]
        r[4] = [*r[4], *([everything] if everything is not None else [])]
    return {k: tuple(v) for k, v in rows.items()}


def test_log_in_batches_agrees_with_one_change_after_another(spark, tmp_path):
    rng = random.Random(5)
    some = lambda value: rng.choice([value, value, None])
    log = [
        (rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), at, some(f"n{at}"), some(at), some(at % 7), some(f"t{at}"), some(f"e{at}"),
         rng.choice([True, None, *[False] * 14]))
        for at in range(240)
    ]
    rows = spark.createDataFrame(log, SCHEMA)
    whole = cl.fold(rows, "key", "at", RULES, "dead").where(~F.col(cl.GONE))
    read = lambda df: {r["key"]: (r["name"], r["born"], r["n"], r["tail"], r["all"]) for r in df.collect()}
    assert read(whole) == plain(log)
    table = store.KeyedTable(spark, str(tmp_path / "t"), "key", whole.select("key", *RULES).schema)
    for start in (0, 100, 101, 180):
        stop = {0: 100, 100: 101, 101: 180, 180: 240}[start]
        cl.apply(table, rows.where((F.col("at") >= start) & (F.col("at") < stop)), "at", RULES, "dead")
        assert read(table.read()) == plain(log[:stop])
    assert table.versions() == [1, 2, 3, 4]
    cl.apply(table, rows.limit(0), "at", RULES, "dead")
    assert read(table.read()) == plain(log)


def test_trace_trees_of_incomplete_logs(spark):
    runs = spark.createDataFrame([("r1", "c1", "completed"), ("r2", "c1", "running"), ("r4", "c2", "failed"), ("r4", "c2", "failed")], "run_id string, conversation_id string, status string")
    steps = spark.createDataFrame([("r1", 2, "tool"), ("r1", 1, "think"), ("r1", 5, "answer"), ("r3", 1, "think"), ("r1", 1, "think")], "run_id string, step int, kind string")
    calls = spark.createDataFrame([("r1", 2, 3, "get"), ("r1", 2, 1, "search"), ("r1", 4, 1, "lost"), ("r5", 2, 2, "late")], "run_id string, step int, call int, tool string")
    out = {r["run_id"]: r for r in traces.trees(runs, steps, calls).collect()}
    assert set(out) == {"r1", "r2", "r3", "r4", "r5"}
    shape = [(s["step"], s["logged"], s["kind"], [(c["call"], c["tool"]) for c in s["calls"]]) for s in out["r1"]["steps"]]
    assert shape == [(1, True, "think", []), (2, True, "tool", [(1, "search"), (3, "get")]), (4, False, None, [(1, "lost")]), (5, True, "answer", [])]
    assert (out["r1"]["missing_steps"], out["r1"]["missing_calls"], out["r1"]["started"]) == ([3, 4], 1, True)
    assert (out["r2"]["steps"], out["r2"]["missing_steps"], out["r2"]["missing_calls"]) == (None, [], 0)
    assert (out["r3"]["started"], out["r3"]["status"], out["r4"]["status"]) == (False, None, "failed")
    assert (out["r5"]["missing_steps"], out["r5"]["missing_calls"]) == ([1, 2], 1)
    assert [r["run_id"] for r in traces.of_run(runs, steps, calls, "r1").collect()] == ["r1"]
    assert sorted(r["run_id"] for r in traces.of_conversation(runs, steps, calls, "c1").collect()) == ["r1", "r2"]
    assert traces.trees(runs.limit(0), steps.limit(0), calls.limit(0)).count() == 0


def test_cooldown_walks_a_rule_in_order(spark):
    hours = {"a": [0, 1, 2, 3, 5, 6, 9], "b": [4], "c": []}
    fired = spark.createDataFrame([(k, h, f"m{h}") for k, hs in hours.items() for h in hs], "rule_id string, h int, message string")
    fired = fired.withColumn("tick", F.timestamp_seconds(F.col("h") * 3600))
    sent = control.outside_cooldown(fired.repartition(3), 180)
    assert sorted((r["rule_id"], r["h"]) for r in sent.collect()) == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 4)]
    assert control.outside_cooldown(fired.limit(0), 180).count() == 0 and control.outside_cooldown(fired, 0).count() == 8


def test_rules_look_back_over_their_own_window(spark):
    rows = [("00:30", "failed", 5), ("01:10", "completed", 100), ("01:59", "completed", 300), ("03:00", "completed", 50)]
    runs = spark.createDataFrame(rows, "at string, status string, latency_ms long").select(
        F.to_timestamp(F.concat(F.lit("2024-05-01 "), "at")).alias("created_at"), "status", "latency_ms", F.lit(False).alias("guardrail_blocked"))
    rules = spark.createDataFrame(
        [("e1", "Erros", "error_rate", "gt", 0.3, 60, True), ("e2", "Erros", "error_rate", "gt", 0.3, 120, True), ("off", "x", "error_rate", "gte", 0.0, 60, False),
         ("l", "Lat", "avg_latency_ms", "gt", 150.0, 60, True)],
        "rule_id string, rule_name string, metric string, operator string, threshold double, window_minutes int, is_active boolean")
    got = {(r["rule_id"], r["tick"].hour): r for r in control.active_alerts(runs, rules).collect()}
    assert set(got) == {("e1", 1), ("e2", 1), ("e2", 2), ("l", 2)}
    assert got["l", 2]["message"] == "[WARNING] Lat: 200.00 gt 150.0" and round(got["e2", 2]["value"], 4) == 0.3333
    assert control.active_alerts(runs, rules.where("NOT is_active")).count() == 0


def test_prompt_blocks_show_metadata_and_fall_back_to_the_opening(spark):
    docs = spark.createDataFrame([("d/a.txt", "a", ("T", "spark,sql")), ("d/b.txt", "  long\n text " + "x" * 2000, (None, None))], "file_path string, content string, d struct<theme:string,stack:string>")
    ranked = spark.createDataFrame([(1, "d/a.txt", 2.5, 1), (1, "d/b.txt", 1.0, 2)], "query_id long, file_path string, score double, rank int")
    found = spark.createDataFrame([(1, "d/a.txt", ["x  y\n z", " ", "w" * 600])], "query_id long, file_path string, matched_chunks array<string>")
    context = retrieval.context_blocks(ranked, found, docs.withColumnRenamed("d", "declared")).first()["context"]
    first, second = context.split("\n\n")
    assert first.split("\n") == ["[Fonte 1]", "Arquivo: a.txt", "Caminho: d/a.txt", "Score: 2.500000", "Tema: T", "Stack: spark, sql", "Trecho relevante 1: x y z", "Trecho relevante 2: " + "w" * 500]
    assert second.split("\n")[-1] == "Conteúdo recuperado: " + ("long text " + "x" * 2000)[:1500]
