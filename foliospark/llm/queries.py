"""The registered form of each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.llm import (
    chat, conversation_repair, decontamination, fill_middle, html, language, licences, mixing, quality, simhash, suffix_levels, suffix_tree, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS_SQL = r"""regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"""

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS_SQL} AS w FROM documents),
word AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
win AS (SELECT r, p, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x,
               count(*) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n,
               w = lag(w) OVER (PARTITION BY r ORDER BY p) AS same FROM word),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM win WHERE n = 8),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice WHERE c > 1) GROUP BY r),
adj AS (SELECT r, count(*) FILTER (WHERE same) AS n_adjacent FROM win GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT l) AS n_own FROM line WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]') GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             coalesce(n_lines - n_own, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_adjacent, 0) AS n_adjacent,
             len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters
      FROM d LEFT JOIN rep USING (r) LEFT JOIN adj USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END' for r in quality.RULES)})::BIGINT AS failed_rules FROM m)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_rules = 0 AS kept FROM b"""


@query("op8_quality_rules", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    found = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.passes(quality.POLICIES["base-1"])
    return found.withColumns(
        {"base_failed": base, "kept": ~base & quality.passes(quality.POLICIES[quality.DEFAULT_POLICY])}
    )


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, list_aggregate(w[p:p + 9], 'string_agg', ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT r, p, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS x
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT DISTINCT r, p, n, item_id FROM dw JOIN bw USING (n, x)),
place AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN item USING (r)"""


@query("op3_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark, sf_dir):
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op2_suffix_tree_scoring")
def suffix_tree_scoring(spark, sf_dir):
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxicity_scores(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PROBE = "</s>[INST] ok [/INST]"
_ESCAPED = r"replace(text, '\', '\\')"
for _mark in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
           (SELECT conv_id, turn, role, text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joined,
             {_ESCAPED} AS e FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(e) + CASE WHEN joined THEN {len(chat.NEXT)} ELSE length(role) + 5 + {len(chat.END)} END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


@query("op7_chat_formatting", CHAT_SQL)
def chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(given.unionByName(probe))
    read = made.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.loss_texts().alias("losses"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.length(F.array_join("losses", "")).cast("long").alias("loss_chars"),
        sha(F.array_join("losses", "")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


MIXING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS_SQL}) AS tokens, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(tokens) > 0),
t AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM s),
x AS (SELECT ln(tokens / total) AS x FROM s, t),
bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= goal THEN hi ELSE (lo + hi) / 2 END,
         CASE WHEN m > {mixing.REPEATS} + 1e-9 THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN m > {mixing.REPEATS} + 1e-9 THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT *, (SELECT ln(sum(exp((lo + hi) / 2 * x))) - sum(exp((lo + hi) / 2 * x) * (lo + hi) / 2 * x) / sum(exp((lo + hi) / 2 * x)) FROM x) AS h,
               (SELECT max(exp((rlo + rhi) / 2 * x) / exp(x)) / sum(exp((rlo + rhi) / 2 * x)) FROM x) AS m,
               {mixing.ENTROPY} * ln(n) - 1e-12 AS goal FROM bis, t) WHERE i < 48),
ends AS (SELECT (SELECT ln(count(*)) * {mixing.ENTROPY} - 1e-12 <= -sum(exp(x) * x) FROM x) AS at_one,
                (SELECT max(1 / exp(x)) / count(*) <= {mixing.REPEATS} + 1e-9 FROM x) AS at_zero),
e AS (SELECT round(greatest(CASE WHEN at_one THEN 1.0 ELSE lo END, CASE WHEN at_zero THEN 0.0 ELSE rhi END), 9) AS a FROM bis, ends WHERE i = 48),
w AS (SELECT source, tokens, exp(a * ln(tokens / total)) AS p, total FROM s, t, e),
sh AS (SELECT source, tokens, p / sum(p) OVER () AS weight, floor(p / sum(p) OVER () * total + 0.5)::BIGINT AS budget,
              ceil(sqrt(tokens / {mixing.UNIT}.0))::BIGINT AS blocks FROM w),
dealt AS (SELECT doc_id, d.source, d.tokens, place, ('0x' || place[1:8])::BIGINT % blocks AS block FROM d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source),
b AS (SELECT source, block, sum(tokens) AS in_block FROM dealt GROUP BY ALL),
ep AS (SELECT b.source, block, in_block, tokens, budget, unnest(range(budget // tokens + 1)) AS epoch FROM b JOIN sh ON b.source IS NOT DISTINCT FROM sh.source),
k AS (SELECT *, row_number() OVER o AS block_order,
             budget - epoch * tokens - coalesce(sum(in_block) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM ep WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('{mixing.SEED}|' || epoch || '|' || coalesce(source, '') || '|' || block), block)),
f AS (SELECT doc_id, dealt.source, dealt.tokens, place, dealt.block, epoch, block_order, room, in_block,
             sum(dealt.tokens) OVER (PARTITION BY dealt.source, dealt.block, epoch ORDER BY place) AS filled
      FROM dealt JOIN k ON dealt.source IS NOT DISTINCT FROM k.source AND dealt.block = k.block WHERE room > 0)
SELECT doc_id, source, tokens AS n_tokens, epoch, block, block_order FROM f WHERE room >= in_block OR filled <= room"""


@query("op10_mixing", MIXING_SQL)
def source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, _, name = mixing.mix(docs)
    return mixed.select("doc_id", *[F.col(name)[c].alias(a) for c, a in (
        ("source", "source"), ("tokens", "n_tokens"), ("epoch", "epoch"), ("block", "block"), ("block_order", "block_order"))])


@query("op6_html_extraction")
def html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


# The tables have no paths; both sides shelve the documents by source, language and number.
_VALUES = ", ".join(f"({i}, '{lic}', '{w}', {x!r}::DOUBLE)" for i, lic, w, x in licences._vectors())
_LICENCE_TERMS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x80-\U0010ffff]+'), lambda x: x <> '')"
LICENCE_SQL = rf"""
WITH tpl(template, licence, word, weight) AS (VALUES {_VALUES}),
idf AS (SELECT word, ln({1 + len(licences.TEMPLATES)}.0 / (1 + count(*))) + 1 AS idf FROM tpl GROUP BY word),
f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, doc_id % 40 = 0 AS lf,
             CASE WHEN doc_id % 400 = 0 THEN source || '/LICENSE'
                  ELSE source || '/' || coalesce(lang, 'none') || '/' || doc_id % 20 || CASE WHEN doc_id % 40 = 0 THEN '/LICENSE' ELSE '/' || doc_id || '.txt' END END AS path
      FROM documents),
d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM f),
u AS (SELECT r, 0 AS unit, text FROM d WHERE lf
      UNION ALL SELECT r, unit, text FROM (SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit, unnest(string_split(text, chr(10))) AS text FROM d)
      WHERE regexp_matches(text, '(?i){licences.CUE}')),
w AS (SELECT r, unit, word, count(*) AS n FROM (SELECT r, unit, unnest({_LICENCE_TERMS}) AS word FROM u) GROUP BY ALL),
x AS (SELECT r, unit, word, n * coalesce(idf, {licences.idf(0)!r}) AS w FROM w LEFT JOIN idf USING (word)),
len AS (SELECT r, unit, sqrt(sum(w * w)) AS length FROM x GROUP BY ALL),
c AS (SELECT r, licence, round(sum(w * weight) / any_value(length), 6) AS cosine FROM x JOIN tpl USING (word) JOIN len USING (r, unit) GROUP BY r, unit, template, licence),
own AS (SELECT r, arg_min(licence, (-cosine, licence)) AS licence, max(cosine) AS cosine FROM c WHERE cosine >= {licences.THRESHOLD} GROUP BY r),
a AS (SELECT d.*, licence, cosine FROM d LEFT JOIN own USING (r)),
lic AS (SELECT directory AS spot, arg_min(licence, (-cosine, licence)) AS licence FROM a WHERE lf AND licence IS NOT NULL GROUP BY directory),
up AS (SELECT r, max_by(lic.licence, length(spot)) AS inherited, max_by(spot, length(spot)) AS inherited_from
       FROM a JOIN lic ON starts_with(a.directory || '/', spot || '/') GROUP BY r)
SELECT doc_id, path, licence AS own_licence, cosine AS own_cosine, coalesce(licence, inherited) AS licence,
       CASE WHEN licence IS NULL THEN inherited_from END AS inherited_from FROM a LEFT JOIN up USING (r)"""


@query("op4_licence_scan", LICENCE_SQL)
def licence_scan(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 40 == 0, F.lit("LICENSE")).otherwise(F.concat(number, F.lit(".txt")))
    shelf = F.concat_ws("/", F.coalesce("lang", F.lit("none")), (F.col("doc_id") % 20).cast("string"), name)
    path = F.concat_ws("/", "source", F.when(F.col("doc_id") % 400 == 0, F.lit("LICENSE")).otherwise(shelf))
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


@query("op12_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    cut = suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + (r["stop"] - r["start"]))
    return cut.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_UNIT = r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+"
FILL_MIDDLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
                  sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, {", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_middle.CHANGED} THEN 'plain'
                  WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""


@query("op11_fill_in_middle", FILL_MIDDLE_SQL)
def fill_in_middle(spark, sf_dir):
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    back = made.withColumn("text", fill_middle.restored())
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    return back.select(*kept, sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))


@query("op13_conversation_repair")
def repair_conversations(spark, sf_dir):
    hurt = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    made = conversation_repair.repair(hurt, present=F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return made.select(*[c for c in made.columns if c != "repaired"], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
