"""Corpus-wide similarity clusters and the batch audit against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import audit, graph, similarity


def plain(sets, threshold):
    """name -> (cluster, size, links, mean similarity) by comparing every pair."""
    names = sorted(sets)
    label = {n: n for n in names}
    links = {n: [] for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            union = len(sets[a] | sets[b])
            score = len(sets[a] & sets[b]) / union if union else 0
            if union and score >= threshold - 1e-9:
                links[a].append(score)
                links[b].append(score)
                low, high = sorted((label[a], label[b]))
                label = {n: low if x == high else x for n, x in label.items()}
    size = {n: sum(x == label[n] for x in label.values()) for n in names}
    return {
        n: (label[n] if links[n] else None, size[n], len(links[n]), round(sum(links[n]) / len(links[n]), 9) if links[n] else None)
        for n in names
    }


@pytest.mark.parametrize(("threshold", "block"), [(0.3, 1024), (0.3, 4), (0.6, 3), (1.0, 8)])
def test_clusters_match_brute_force(spark, threshold, block):
    rng = random.Random(block)
    common, rare = [f"common{k}" for k in range(12)], [f"rare{k}" for k in range(400)]
    sets = {}
    for k in range(160):
        base = set(rng.choices(common, k=rng.randint(0, 5))) | set(rng.choices(rare, k=rng.randint(0, 20)))
        for c in range(rng.choice((1, 1, 1, 2, 4))):
            sets[f"d{k:03d}-{c}"] = set(rng.sample(sorted(base), max(len(base) - rng.choice((0, 0, 1, 4)), 0)))
    rows = [(n, [*sorted(t, reverse=True), *list(t)[:1]]) for n, t in sets.items()]  # unordered, with a repeat
    docs = spark.createDataFrame(rows, "file_path string, signature_terms array<string>").repartition(5)
    got = similarity.clusters(docs, threshold=threshold, block=block).collect()
    assert {r.file_path: (r.cluster_id, r.cluster_size, r.links, r.mean_similarity and round(r.mean_similarity, 9)) for r in got} == plain(sets, threshold)


def test_clusters_of_nothing_and_of_one_text(spark):
    schema = "file_path string, signature_terms array<string>"
    assert similarity.clusters(spark.createDataFrame([], schema)).count() == 0
    rows = [(f"p{k}", ["alpha", "beta"]) for k in range(40)] + [("q", []), ("r", None), ("s", ["gamma"])]
    got = {r.file_path: r for r in similarity.clusters(spark.createDataFrame(rows, schema)).collect()}
    assert {(got[f"p{k}"].cluster_id, got[f"p{k}"].cluster_size, got[f"p{k}"].links) for k in range(40)} == {("p0", 40, 39)}
    assert [(got[k].cluster_id, got[k].cluster_size, got[k].links) for k in "qrs"] == [(None, 1, 0)] * 3


SETS = "file_path string, signature_terms array<string>"


def alike(rng, count, least, most):
    """Sets of ``least`` to ``most`` terms, some of which are much like each other."""
    words = [f"word{k}" for k in range(8 * most)]
    sets = {}
    for k in range(count):
        base = rng.sample(words, rng.randint(least, most)) + [f"common{c}" for c in range(rng.randint(1, 6))]
        for c in range(rng.choice((1, 1, 2, 3))):
            sets[f"d{k:03d}-{c}"] = set(rng.sample(base, max(int(len(base) * rng.uniform(0.6, 1)), 1)))
    return sets


@pytest.mark.parametrize(("most", "block"), [(12, 1000), (12, 40), (90, 1000), (90, 40)])
def test_tasks_of_any_bounds_find_the_links_of_brute_force(spark, monkeypatch, most, block):
    sets = {n: set(t) for t, n in {tuple(sorted(t)): n for n, t in alike(random.Random(most), 130, 2, most).items()}.items()}
    groups = similarity.classes(spark.createDataFrame([(n, sorted(t)) for n, t in sets.items()], "name string, terms array<string>"))
    groups = groups.orderBy("name").withColumn("id", F.monotonically_increasing_id()).localCheckpoint()
    names = {r.id: (r.name, r.copies) for r in groups.collect()}
    cells = similarity._cells(similarity.rare_first(groups), 0.3, block).orderBy("term", "low", "high").toArrow()
    want = plain(sets, 0.3)

    def found():
        links, total, edges = {}, {}, []
        for batch in similarity._compare(0.3)(iter(cells.combine_chunks().to_batches(50))):
            for r in batch.to_pylist():
                links[r["id"]] = links.get(r["id"], 0) + r["links"]
                total[r["id"]] = total.get(r["id"], 0) + r["similarity"]
                edges.append((r["id"], r["head"]))
        label = {k: k for edge in edges for k in edge}
        for a, b in edges:
            low, high = sorted((label[a], label[b]))
            label = {k: low if x == high else x for k, x in label.items()}
        return {names[k][0]: (names[label[k]][0], round(total[k] / n, 9), n) for k, n in links.items()}

    assert {copies for _, copies in names.values()} == {1}
    right = {n: (c, s, k) for n, (c, _, k, s) in want.items() if k}
    assert found() == right and len(right) > 50
    for name, bound in (("CELL_ROWS", 1), ("HELD", 3), ("PAIRS", 7), ("WIDE", 3), ("COUNTED", 100), ("SHORT", 10)):
        monkeypatch.setattr(similarity, name, bound)
    assert found() == right


def test_a_set_is_shuffled_once_for_each_rare_term_and_no_shuffle_file_stays(spark, monkeypatch):
    rng, dealt = random.Random(3), []
    rows = [(f"p{k:04d}", ["all", *{f"w{rng.randrange(900)}" for _ in range(5)}]) for k in range(2500)]
    cells = similarity._cells
    monkeypatch.setattr(similarity, "_cells", lambda *a: dealt.append(cells(*a)) or dealt[0])
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if ".data" in f.getName()}
    docs, before = spark.createDataFrame(rows, SETS), files()
    similarity.clusters(docs)
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert dealt[0].count() <= sum(len(t) - -(-len(t) * 3 // 10) + 1 for _, t in rows)


def test_sets_without_a_name_change_no_other_sets_links(spark):
    rows = [("a", ["x", "y"]), ("b", ["x", "y", "z"]), (None, ["x", "y", "w"]), (None, ["x", "v"])]
    got = similarity.clusters(spark.createDataFrame(rows, SETS)).collect()
    assert sorted((r.file_path or "", r.cluster_id or "", r.cluster_size, r.links) for r in got) == [("", "", 1, 0)] * 2 + [("a", "a", 2, 1), ("b", "a", 2, 1)]


def test_shared_terms_are_counted_after_the_join_of_whole_sets(spark):
    sets = alike(random.Random(8), 60, 3, 9)
    docs = spark.createDataFrame([(n, [*sorted(t), *list(t)[:1]]) for n, t in sets.items()], SETS)
    found = similarity.clusters(docs, threshold=0.5)
    got = similarity.shared_terms(found, docs, limit=3)
    want = {}
    for n, (head, size, _, _) in plain(sets, 0.5).items():
        if head:
            want[head, size] = want.get((head, size), sets[n]) & sets[n]
    assert {(r.cluster_id, r.cluster_size): r.shared_terms for r in got.collect()} == {k: sorted(v)[:3] for k, v in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # terms are not shuffled one by one


def test_shared_terms_are_those_of_every_member(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["x", "y", "w"]), ("c", ["x", "w", "v"]), ("d", ["u"])]
    docs = spark.createDataFrame(rows, "file_path string, signature_terms array<string>")
    got = similarity.shared_terms(similarity.clusters(docs, threshold=0.5), docs).collect()
    assert [(r.cluster_id, r.cluster_size, r.shared_terms) for r in got] == [("a", 3, ["x"])]


def test_components_of_long_paths_and_loops(spark):
    path = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(300)]
    edges = [*path, ("z1", "z1"), ("y2", "y1"), ("y1", "y2"), ("y2", "y1")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{k:04d}": "n0000" for k in range(301)}, "y1": "y1", "y2": "y1"}


def test_batches_of_any_size_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    rows = [(f"f{k:03d}.txt", ".txt", " ".join(rng.choices(words, k=rng.randint(3, 40)))) for k in range(90)]
    rows += [(f"g{k}.txt", ".txt", rows[k][2] + " extra") for k in range(30)]
    docs = spark.createDataFrame(rows, "file_path string, file_extension string, content string")
    shown = lambda: [
        (r.file_path, r.cluster_id, r.cluster_size, r.average_similarity, r.links, r.shared_terms)
        for r in audit.audit_documents(docs, batch_size=5000).orderBy("file_path").collect()
    ]
    whole = shown()
    monkeypatch.setattr(audit, "COMPARED", 7)
    assert shown() == whole and sum(r[2] > 1 for r in whole) >= 30
