"""Each operator against brute force or an exact round trip, and its defined results for odd input."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import (
    chat, components, decontamination, html, language, licences, mixing, quality, simhash, suffix_tree, toxicity,
)
from foliospark.llm.common import Scratch
from foliospark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, print string, row bigint, ledger string"


def documents(spark, texts, langs=None, sources=None):
    """Rows with extra columns that carry names the operators use themselves; ids from 1, null texts allowed."""
    rows = [
        (i + 1, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], "x", 7, "kept") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "one two", "same words here", "same words here", "x " * 50_000]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, con, name):
    ok, message, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert ok, message


# -- near duplicates --------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=120)
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            copy[rng.randrange(120)] = "changed"
            texts.append(" ".join(copy))
    texts += ODD
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    labels = plain_components(prints)
    assert [got[i + 1].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i + 1].component_id for i in range(len(texts))] == [x + 1 for x in labels]
    assert got[1].n_linked == Counter(labels)[labels[0]]
    kept = simhash.keep_one(documents(spark, texts), radius=3, most=192)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x + 1 for x in labels}) and kept.columns == documents(spark, []).columns


def plain_words(text):
    """All three words of the fingerprint, by plain integers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    full, out = (1 << 64) - 1, []
    for word in range(3):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        if word:
            hashes = [h ^ (word * 0x9E3779B97F4A7C15 & full) for h in hashes]
            hashes = [(h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full for h in hashes]
            hashes = [(h ^ h >> 27) * 0x94D049BB133111EB & full for h in hashes]
            hashes = [h ^ h >> 31 for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def plain_near(texts):
    """The place of the first text of each text's group of near copies."""
    found = [plain_words(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            apart = [(a ^ b).bit_count() for a, b in zip(found[i], found[j], strict=True)]
            if (apart[0] == 0 or apart[0] <= 8 and sum(apart) <= 27) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
    return copy


def test_near_copies_are_found_as_brute_force_finds_them(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, families = [], []
    for family in range(40):
        base = rng.choices(vocabulary, k=300)
        for _ in range(5):
            texts.append(" ".join(edited(rng, base, rng.randint(0, 5))))
            families.append(family)
    for _ in range(40):  # a third of the words changed: not a near copy
        texts.append(" ".join(edited(rng, texts[0].split(), 100)))
        families.append(-len(texts))
    label = plain_near(texts)
    kept = sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect())
    assert kept == sorted({x + 1 for x in label})
    copies = [i for i in range(200) if families.index(families[i]) != i]
    assert sum(i + 1 not in kept for i in copies) >= 0.9 * len(copies)
    assert all(families[label[i]] == families[i] for i in range(len(texts)))


def test_any_radius_and_number_of_ranges_gives_the_same_links(spark):
    rng = random.Random(4)
    prints = sorted({rng.choice((0x0F0F << 20, 0x3333 << 30)) ^ sum(1 << b for b in rng.sample(range(62), 5)) for _ in range(150)})
    table, scratch = spark.createDataFrame([(p,) for p in prints], "print bigint"), Scratch(spark, "test")
    for radius, agree in ((5, 2), (7, 2), (5, 3), (5, 1)):
        edges = simhash.linked(table, scratch, radius=radius, agree=agree, tile=32)
        found = {r.node: r.component for r in components.components(edges, scratch).collect()}
        labels = plain_components(prints, radius)
        groups = {}
        for p, x in zip(prints, labels, strict=True):
            groups.setdefault(x, set()).add(p)
        assert all({found.get(p, p) for p in g} == {min(g)} for g in groups.values())


def test_large_files_are_cut_into_tiles_without_losing_links(spark):
    rng = random.Random(3)
    prints = sorted({1 << 40 ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)})
    table = spark.createDataFrame([(p,) for p in prints], "print bigint")
    scratch = Scratch(spark, "test")
    found = {r.node: r.component for r in components.components(simhash.linked(table, scratch, tile=16), scratch).collect()}
    labels = plain_components(prints)
    groups = {}
    for p, x in zip(prints, labels, strict=True):
        groups.setdefault(x, set()).add(p)
    for group in groups.values():
        assert {found.get(p, p) for p in group} == {min(group)}


def test_repeated_rows_and_null_ids_keep_one(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1), (9, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, simhash_row int")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [5, 9]
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {5, 9}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


# -- language model ---------------------------------------------------------------------


def test_base_score_and_known_words_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD", 5)  # so that most words go through the join
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"W{k}" for k in range(30)], k=rng.randint(0, 40))) for _ in range(60)] + ODD
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i + 1).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in suffix_tree.scores(documents(spark, texts)).collect()}
    for i, words in enumerate(tokens):
        row = got[i + 1]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (i not in train, len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))
    assert suffix_tree.scores(documents(spark, [])).count() == 0


def plain_tree_score(tree_counts, text, depth):
    """Scores byte by byte with the longest counted suffix, smoothing up from the empty context."""
    total, seen = 0.0, suffix_tree.END * depth
    for byte in text:
        chance = 1 / 256
        for size in range(depth + 1):
            context = seen[len(seen) - size :]
            if context not in tree_counts:
                break
            byte_list, n = tree_counts[context]
            kinds, own = len(byte_list), dict(zip(byte_list.tolist(), n.tolist(), strict=True)).get(byte, 0)
            chance = (own + kinds * chance) / (n.sum() + kinds)
        total += math.log10(chance)
        seen += bytes([byte])
    return total


def test_tree_scores_match_a_walk_from_the_root(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "then", "there", "a", "an", "and"]) for _ in range(30)) for _ in range(80)]
    held = {}
    plain_init = suffix_tree.Tree.__init__
    monkeypatch.setattr(suffix_tree.Tree, "__init__", lambda self, counted: (held.update(counted), plain_init(self, counted))[1])
    tree = suffix_tree.learn(documents(spark, texts), "text", Scratch(spark, "test"), depth=4, floor=2.0)
    assert max(map(len, held)) > 2
    spelled = [suffix_tree.spelled(suffix_tree.words(t.encode())) for t in [*texts[:5], "unseen Ünïcode", ""]]
    for text, score in zip(spelled, tree.score(spelled), strict=True):
        assert score == pytest.approx(plain_tree_score(held, text, 4), rel=1e-4)
    assert abs((10 ** tree.logs).sum(axis=1) - 1).max() < 1e-3


def test_tree_keeps_every_context_of_a_large_corpus(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))] * 30) for _ in range(5000)]  # 9 own contexts each
    held = {}
    for block in (suffix_tree.BLOCK, 20_000):
        monkeypatch.setattr(suffix_tree, "BLOCK", block)
        rows = suffix_tree.scores(documents(spark, [*texts, *ODD])).collect()
        held[block] = {r.doc_id: r.score for r in rows}
        assert len(rows) == len(texts) + len(ODD)
        assert all(r.score > -30 for r in rows if not r.held_out and r.doc_id <= len(texts))
    grown = suffix_tree.Grown(documents(spark, texts), "text", Scratch(spark, "test"))
    assert grown.groups[1].sum() > suffix_tree.STATES and len(grown.ranges()) > 2
    assert held[block] == pytest.approx(held[6_000_000], rel=1e-5)
    tree = grown.whole()
    spelled = [suffix_tree.spelled(suffix_tree.words(t.encode())) for t in [*texts[:5], "unseen Ünïcode", "", texts[7][:40]]]
    assert sum(part.score(spelled) for part in grown.parts()) == pytest.approx(tree.score(spelled), rel=1e-4)


# -- decontamination --------------------------------------------------------------------


def plain_hits(text, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for item, phrase in items:
        p = cut(phrase)
        for window in {tuple(p[i : i + size]) for i in range(max(1, len(p) - size + 1))} if p else ():
            for s in range(len(words) - len(window) + 1):
                if tuple(words[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 50)
    rng = random.Random(4)
    words = ["a", "b", "c", "d"]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([12, 15, 3, 1, 0, 10])] + [(0, "a b-c"), (None, "d D d"), (8, None)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + ODD
    texts.append("x y " + items[0][1].upper() + " z " + items[1][1].replace(" ", ", "))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, texts)
    for block in (200_000, 3):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        got = {r.doc_id: r for r in decontamination.report(docs, benchmark).collect()}
        for i, text in enumerate(texts):
            row = got[i + 1]
            assert (row.n_words, row.n_hit, row["items"]) == plain_hits(text, items)
    clean = decontamination.keep_clean(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated} and clean.columns == docs.columns
    assert decontamination.report(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), benchmark).count() == 0


def test_proximity_matches_allow_moved_words(spark):
    docs = documents(spark, ["red green blue", "red very green blue", "blue red green"])
    items = decontamination.benchmark_windows(spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string"))
    for slop, want in ((0, {1}), (1, {1, 2})):
        rows, found = decontamination.matches(docs, items, Scratch(spark, "test"), slop=slop)
        assert {r.id for r in rows.join(found, "row").collect()} == want


def test_blocks_of_windows_see_the_same_rows(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(60)] + [None]
    shuffled = documents(spark, texts).repartition(5, F.rand())  # every reading deals the rows anew
    items = [(str(k), " ".join(rng.choices("abcdefgh", k=4))) for k in range(30)]
    windows = decontamination.benchmark_windows(spark.createDataFrame(items, "item_id string, text string"))
    rows, found = decontamination.matches(shuffled, windows, Scratch(spark, "test"), block=7)
    got = {}
    for r in rows.join(found, "row").collect():
        got.setdefault(r.id, set()).add(r["item"])
    want = {i + 1: set(plain_hits(t, items)[2]) for i, t in enumerate(texts)}
    assert got == {i: found for i, found in want.items() if found}


# -- licences ---------------------------------------------------------------------------


def test_licence_inheritance_and_odd_paths(spark):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", "Released under the MIT License."),
        (4, "ab/x.py", None), (5, None, ""), (6, "x.py", "# All rights reserved.\n" + "word " * 30_000), (7, "a/b/y.py", "Licensed under CC BY-NC 4.0."),
        (2, "a/b/c/x.py", "code"),
    ]
    table = spark.createDataFrame([(*f, "k") for f in files], "doc_id bigint, path string, text string, row string")
    got = [(r.doc_id, r.licence, r.inherited_from) for r in licences.scan(table).orderBy("doc_id").collect()]
    assert got == [
        (1, "Apache-2.0", None), (2, "MIT", "a/b"), (2, "MIT", "a/b"), (3, "MIT", None), (4, None, None), (5, None, None),
        (6, "proprietary", None), (7, "CC-BY-NC-4.0", None),
    ]
    assert licences.scan(table.limit(0)).count() == 0


# -- language identification ------------------------------------------------------------


def test_language_backs_off_and_marks_the_undetermined(spark):
    rng = random.Random(6)
    stems = {"en": ["thing", "other", "with"], "de": ["schule", "nicht", "kraft"]}
    langs = [rng.choice(["en", "de"]) for _ in range(80)]
    texts = [" ".join(rng.choices(stems[x], k=12)) for x in langs]
    odd = [None, "", "123 !?", "Nichtschule krafts", "thingother withs"]
    docs = documents(spark, texts + odd, langs + [None] * len(odd))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i + 1].lang_pred == x for i, x in enumerate(langs))
    assert [got[81 + i].lang_pred for i in range(5)] == ["und", "und", "und", "de", "en"] and got[81].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert language.keep(docs).count() == 82 and language.keep(docs).columns == docs.columns
    assert {r.lang_pred for r in language.identify(documents(spark, ["word"], [None])).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# -- html -------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body class="has-sidebar"><nav><ul>{menu}</ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post has-comments"><header><h1>{title}</h1></header>{body}<div class="ad">buy</div>
<form><p>mail</p></form><section id="comments"><p>great</p></section></article><aside><p>side</p></aside><footer>f</footer>"""


def test_extraction_and_wrapper(spark):
    pages = []
    for k in range(12):
        body = "".join(f"<p>text {k}.{j} &amp; <b>more</b>\n  &eacute;<br>x" for j in range(k % 4))
        pages.append((k, "http://H.example/p", PAGE.format(menu="<li><a>m</a></li>" * (k % 3 + 2), title=f"T{k}", body=body)))
    pages += [(20, None, None), (21, "http://h.example", ""), (22, "http://other.example", "just text <p>and &lt;more"), (22, "http://other.example", "just text <p>and &lt;more")]
    table = spark.createDataFrame([(*p, "r") for p in pages], "page_id bigint, url string, html string, region string")
    got = {r.page_id: r for r in html.extract(table).collect()}
    for k in range(12):
        assert got[k].text == "\n".join([f"T{k}", *(f"text {k}.{j} & more é x" for j in range(k % 4))])
    assert got[20].text == got[21].text == "" and got[22].text == "just text\nand <more" and got[22].n_chars == 19
    found = {r.host: r for r in html.wrappers(table).collect()}
    assert found["h.example"].region == "article.post" and "+" in found["h.example"].wrapper and "?" in found["h.example"].wrapper
    assert html.extract(table.limit(0)).count() == 0


def test_template_text_of_unmarked_hosts_is_left_out():
    pages = [f"<body><div>Fixed line</div><p>own {k}</p></body>" for k in range(4)]
    shapes = {}
    for page in pages:
        html.merged(shapes, html.stream(page))
    region, fixed = html.described(html.one(shapes))
    assert region == "" and html.main_text(pages[2], region, frozenset(fixed)) == "own 2"


def test_text_of_one_page_is_not_template(spark):
    page = "<html><body><div>menu</div><h1>Title {0}</h1>{1}</body></html>"
    body = lambda k, n: "".join(f"<p>own {k} {i}</p>" for i in range(n))
    short, long, single = page.format(1, body(1, 1)), page.format(2, body(2, 3)), page.format(3, body(3, 2) + "<h2>last</h2>")
    rows = [("a", short), ("a", short), ("a", long), ("b", single), ("c", short), ("c", short), ("d", short)]
    table = spark.createDataFrame([(i, f"https://{host}.org/{i}", html_) for i, (host, html_) in enumerate(rows)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert got[0] == got[1] == "Title 1\nown 1 0" and got[2] == "Title 2\nown 2 0\nown 2 1\nown 2 2"
    assert got[3] == "menu\nTitle 3\nown 3 0\nown 3 1\nlast"
    assert got[4] == got[5] == got[6] == "menu\nTitle 1\nown 1 0"


# -- chat -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\<\\|", "<", "|>", None, "", "é\n<<SYS>>\\", "<|next|>"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "user", "assistant", "assistant", "a|>b", None, "user", "assistant", "assistant"], nasty, strict=True))]
    rows += [(None, 0, "assistant", "z"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, runs int")
    made = chat.format_conversations(table).select("conv_id", "formatted", "loss_spans", chat.read_back().alias("turns"), chat.loss_texts().alias("losses"))
    got = {r.conv_id: r for r in made.collect()}
    want = [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    for c in (1, 2):
        assert [tuple(t) for t in got[c].turns] == want and got[c].losses == [t for r, t in want if r == "assistant"]
    assert [tuple(t) for t in got[3].turns] == [("user", "a"), ("user", "a"), ("user", "b")] and got[3].formatted.count("<|user|>") == 1
    assert got[None].losses == ["z"] and not any(m in got[1].formatted for m in ("</s>", "[INST]", "[/INST]"))
    assert chat.format_conversations(table.limit(0)).count() == 0


# -- quality ----------------------------------------------------------------------------


def plain_repeats(words, size=8):
    windows = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return len({j for i in range(len(words) - size + 1) if windows[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})


def test_repeated_windows_match_brute_force():
    rng = random.Random(7)
    for n in [*range(20), 60, 200]:
        words = [rng.choice([b"a", b"b"]) for _ in range(n)]
        assert quality.repeated_words(words) == plain_repeats(words)


def test_ledger_policies_and_ablations(spark):
    texts = [*ODD, "clean words of a text that has nothing wrong with it at all and goes on for more than twenty words in total here", "A!! " * 3 + "B " * 30]
    docs = documents(spark, texts)
    ledger = quality.ledger(docs)
    bits = {r.doc_id: r.failed_rules for r in ledger.collect()}
    assert bits[1] & 1 and bits[2] & 1 and bits[9] == 0 and bits[8] & (1 << 5)
    kept = quality.keep(docs)
    assert [r.doc_id for r in kept.collect()] == [9] and kept.columns == docs.columns
    for row in quality.ablations(ledger).collect():
        policy, rule = quality.POLICIES[row.policy], next(r for r in quality.RULES if r.name == row.rule)
        passes = lambda b: not b & policy.mask(policy.fatal) and (b & policy.mask(policy.soft)).bit_count() <= policy.tolerated  # noqa: B023, E731
        assert row.n_failed == sum(b >> rule.bit & 1 for b in bits.values())
        assert row.n_kept == sum(passes(b) for b in bits.values())
        assert row.n_kept_without == sum(passes(b & ~(1 << rule.bit)) for b in bits.values())
    assert quality.ledger(docs.limit(0)).count() == 0


# -- toxicity ---------------------------------------------------------------------------


def test_grammar_tells_kinds_of_clauses():
    grammar = toxicity.Grammar({"moron": 3.0, "idio*": 3.0})
    kinds = lambda text: [toxicity.KINDS[k] for k in grammar.read(text.encode())]
    assert kinds("What a moron. Nice day.") == ["insult"]
    assert kinds("You are an Idiotic man") == ["aimed_insult"]
    assert kinds("that is not a moron!") == ["negated_insult"]
    assert kinds("the paper called it a moron, they say") == ["reported_insult"]
    assert kinds("I will kill you\nplain line") == ["aimed_threat"] and kinds("") == []


def test_toxicity_learns_insults_not_copied_words(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(40)]
    texts, labels = [], []
    for k in range(300):
        words = rng.choices(common, k=20)
        if k % 4 == 0:
            words.insert(rng.randrange(20), rng.choice(["blarg", "zork" + rng.choice("abcdef")]))
        texts.append(" ".join(words))
        labels.append((k + 1, int(k % 4 == 0)))
    docs = documents(spark, texts + ODD)
    table = spark.createDataFrame([*labels, (None, 1), (1, 1), (301, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, table).collect()}
    assert all(got[i].predicted == toxic for i, toxic in labels) and len(got) == len(texts) + len(ODD)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert got[301].predicted == 0 and toxicity.scores(docs, table.limit(0)).where("predicted = 1").count() == 0


# -- mixing -----------------------------------------------------------------------------


def test_exponent_and_budgets(spark):
    sizes = {"big": 9_000, "mid": 900, "small": 100}
    table = spark.createDataFrame(list(sizes.items()), "source string, tokens bigint")
    total = sum(sizes.values())

    def weights(a):
        powers = {s: (n / total) ** a for s, n in sizes.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    found = mixing.solve(table, entropy=0.6, repeats=100)
    assert entropy(found.exponent) == pytest.approx(0.6 * math.log(3), abs=1e-6)
    limited = mixing.solve(table, entropy=1.0, repeats=4)
    assert max(weights(limited.exponent)[s] * total / n for s, n in sizes.items()) == pytest.approx(4, abs=1e-5)
    assert mixing.solve(table, entropy=0.0).exponent == 1.0 and mixing.solve(table.limit(0)).tokens == 0


def test_mixture_keeps_budgets_and_repeats(spark):
    rng = random.Random(9)
    texts = ["w " * rng.randint(1, 30) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["a"] * 12 + ["b"] * 3 + [None]) for _ in texts]
    docs = documents(spark, texts, sources=sources).withColumnRenamed("print", "mix")
    mixed, shares, name = mixing.mix(docs, entropy=0.9)
    assert name == "mix_" and mixed.columns == [*docs.columns, name]
    rows = mixed.select("doc_id", "source", f"{name}.tokens", f"{name}.epoch").collect()
    for share in shares.collect():
        own = [r for r in rows if r.source == share.source]
        used = sum(r.tokens for r in own)
        assert share.budget - 30 <= used <= share.budget
        copies = Counter(r.doc_id for r in own if r.tokens)
        assert max(copies.values()) - min([copies[i + 1] for i, s in enumerate(sources) if s == share.source and texts[i]] or [0]) <= 1
    again, _, _ = mixing.mix(docs, entropy=0.9)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_mixture_with_clashing_and_dotted_names(spark):
    docs = documents(spark, ["a b c", "d e", None, ""], sources=["x", "y", "x", None])
    odd = docs.selectExpr("*", "1 AS `a.b`", "2 AS `__mix_n`", "3 AS mix", "4 AS mix_share", "5 AS MIX_STEP", "6 AS `tick``s`")
    mixed, _, name = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, name] and {r["a.b"] for r in mixed.collect()} == {1}
