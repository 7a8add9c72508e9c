"""Conversation, guardrail and answer-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import guardrails as gr, scoring, text as tx
from foliospark.operators import conversation
from foliospark.plans.corpus import STRIP, TOKENS
from foliospark.plans.registry import CORPUS_SQL, corpus, query, spread, table


def messages(spark, sf):
    return table(spark, sf, "conversations")


# Ten conversations stand for a long one and assistant turns, three times over, for tool outputs, so that the
# window, the trimming and the budget all have something to cut.
TOOL_SQL = """m AS (
  SELECT conv_id // 10 AS conv_id, conv_id % 10 * 100 + turn AS turn, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'assistant' THEN text || text || text ELSE text END AS text FROM conversations),
trimmed AS (
  SELECT conv_id, turn, role, role = 'tool' AND length(text) > 2000 AS cut,
    CASE WHEN role = 'tool' AND length(text) > 2000 THEN substring(text, 1, 2000) || chr(10) || '[...output truncado]' ELSE text END AS text FROM m),
aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM trimmed),
costed AS (
  SELECT *, CAST(ceil(chars_from_newest / 4) AS BIGINT) AS tokens_from_newest FROM (
    SELECT *, sum(length(text) + 10) OVER (PARTITION BY conv_id ORDER BY age ROWS UNBOUNDED PRECEDING) AS chars_from_newest
    FROM aged WHERE age <= {window}))"""


def tool_messages(spark, sf):
    tool = F.col("role") == "assistant"
    return messages(spark, sf).select(
        F.floor(F.col("conv_id") / 10).alias("conv_id"), (F.col("conv_id") % 10 * 100 + F.col("turn")).alias("turn"),
        F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.when(tool, F.repeat("text", F.lit(3))).otherwise(F.col("text")).alias("text"),
    )


@query("conv_context_window", f"""WITH {TOOL_SQL.format(window=40)}
SELECT conv_id, turn, age, tokens_from_newest, sha256(text) AS text_sha FROM costed WHERE tokens_from_newest <= 6000 OR age <= 2""")
def conv_context_window(spark, sf):
    kept = conversation.prepare_context(tool_messages(spark, sf))
    return kept.select("conv_id", "turn", F.col("age").cast("long").alias("age"), "tokens_from_newest", F.sha2("text", 256).alias("text_sha"))


@query("conv_token_budget", f"""WITH {TOOL_SQL.format(window=30)},
after AS (SELECT conv_id, count(*) AS final_messages, max(chars_from_newest) AS chars
          FROM costed WHERE tokens_from_newest <= 4000 OR age <= 2 GROUP BY 1),
before AS (SELECT conv_id, count(*) AS original_messages, bool_or(cut) AS cut FROM trimmed GROUP BY 1),
joined AS (SELECT *, cut OR original_messages > final_messages AS truncated,
  chr(10) || chr(10) || '[Nota: mensagens anteriores foram resumidas para caber no contexto. Originalmente '
    || original_messages || ' mensagens, agora ' || final_messages || '.]' AS note FROM before JOIN after USING (conv_id))
SELECT conv_id, original_messages, final_messages, truncated,
       CAST(ceil((chars + CASE WHEN truncated THEN length(note) ELSE 0 END) / 4) AS BIGINT) AS estimated_tokens FROM joined""")
def conv_token_budget(spark, sf):
    return conversation.context_summary(tool_messages(spark, sf), max_messages=30, max_tokens=4000)


@query("conv_paginate", """SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn LIMIT 100 OFFSET 200""")
def conv_paginate(spark, sf):
    rows = conversation.paginate(messages(spark, sf), 3, 100, F.desc("conv_id"), F.col("turn"))
    return rows.select("conv_id", "turn", "role")


@query("conv_page_info", """SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM conversations""")
def conv_page_info(spark, sf):
    return conversation.page_info(messages(spark, sf), 20)


@query("conv_token_estimate", """SELECT conv_id, count(*) AS messages,
  CAST(ceil(sum(length(text) + 10) / 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1""")
def conv_token_estimate(spark, sf):
    return messages(spark, sf).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), conversation.estimate_tokens(F.sum(F.length("text") + 10)).alias("tokens")
    )


@query("conv_list", """SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn
FROM conversations GROUP BY 1""")
def conv_list(spark, sf):
    """Conversation headers without the message bodies."""
    return messages(spark, sf).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.max("turn").alias("last_turn"),
    )


def pii_sql(column: str) -> str:
    out = column
    for spec, label, _ in gr.PII:
        out = f"regexp_replace({out}, '{gr.pattern(spec, chr(92) + 'b')}', '{label}', 'g')"
    return out


INJECTION_SQL = "(?i)" + "|".join(f"(?:{gr.pattern(p, chr(92) + 'b')})" for p, _ in gr.INJECTION)


@query("pii_mask", f"""WITH {CORPUS_SQL}, m AS (SELECT file_path, content, {pii_sql('content')} AS masked FROM corpus)
SELECT file_path, sha256(masked) AS masked_sha, masked <> content AS has_pii FROM m""")
def pii_mask(spark, sf):
    m = corpus(spark, sf).select("file_path", "content", gr.mask_pii("content").alias("masked"))
    return m.select("file_path", F.sha2("masked", 256).alias("masked_sha"), (F.col("masked") != F.col("content")).alias("has_pii"))


@query("pii_counts", f"""WITH m AS (SELECT {pii_sql('text')} AS t FROM documents)
SELECT sum(len(string_split(t, '[CPF REDACTED]')) - 1)::BIGINT AS cpf, sum(len(string_split(t, '[EMAIL REDACTED]')) - 1)::BIGINT AS email,
       sum(len(string_split(t, '[TELEFONE REDACTED]')) - 1)::BIGINT AS phone, sum(len(string_split(t, '[CARTAO REDACTED]')) - 1)::BIGINT AS card FROM m""")
def pii_counts(spark, sf):
    m = corpus(spark, sf).select(gr.mask_pii("content").alias("t"))
    n = lambda label: F.sum(F.size(F.split("t", rf"\[{label} REDACTED\]")) - 1)
    return m.agg(n("CPF").alias("cpf"), n("EMAIL").alias("email"), n("TELEFONE").alias("phone"), n("CARTAO").alias("card"))


@query("injection_flag", f"""WITH {CORPUS_SQL}
SELECT file_path, regexp_matches(content, '{INJECTION_SQL}') AS flagged FROM corpus""")
def injection_flag(spark, sf):
    return corpus(spark, sf).select("file_path", gr.is_injection("content").alias("flagged"))


@query("guardrail_input", f"""WITH {CORPUS_SQL}, r AS (SELECT file_path, CASE
    WHEN regexp_matches(content, '{INJECTION_SQL}') THEN 'content_filter' WHEN length(content) > 8000 THEN 'max_tokens' END AS reason FROM corpus)
SELECT file_path, reason IS NULL AS passed, reason FROM r""")
def guardrail_input(spark, sf):
    return corpus(spark, sf).select("file_path", gr.check_input("content").alias("g")).select("file_path", "g.passed", "g.reason")


@query("guardrail_output", f"""WITH {CORPUS_SQL}, m AS (SELECT file_path, content, {pii_sql('content')} AS masked FROM corpus)
SELECT file_path, length(content) <= 8000 AS passed, CASE WHEN length(content) > 8000 THEN 'max_tokens' END AS reason,
       CASE WHEN length(content) <= 8000 AND masked <> content THEN sha256(masked) END AS modified_sha FROM m""")
def guardrail_output(spark, sf):
    g = corpus(spark, sf).select("file_path", gr.check_output("content").alias("g"))
    return g.select("file_path", "g.passed", "g.reason", F.sha2("g.modified", 256).alias("modified_sha"))


@query("length_guard", f"""WITH {CORPUS_SQL} SELECT file_path, length(content) > 8000 AS too_long FROM corpus""")
def length_guard(spark, sf):
    return corpus(spark, sf).select("file_path", gr.is_too_long("content").alias("too_long"))


def any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("intent_route", f"""SELECT conv_id, turn, CASE WHEN {any_sql(gr.EXTRACTION_WORDS)} THEN 'extraction_agent'
  WHEN {any_sql(gr.TOOL_WORDS)} THEN 'tool_agent' ELSE 'knowledge_agent' END AS agent,
  CASE WHEN {any_sql(gr.EXTRACTION_WORDS)} THEN 'extraction' WHEN {any_sql(gr.TOOL_WORDS)} THEN 'action'
       WHEN {any_sql(gr.KNOWLEDGE_WORDS)} THEN 'knowledge' ELSE 'default' END AS reason
FROM conversations WHERE role = 'user'""")
def intent_route(spark, sf):
    rows = messages(spark, sf).where(F.col("role") == "user")
    return rows.select("conv_id", "turn", gr.route_intent("text").alias("agent"), gr.route_reason("text").alias("reason"))


@query("handoff_tokens", """SELECT agent, count(*) AS n FROM (
  SELECT nullif(regexp_extract(text || CASE WHEN role = 'user' THEN ' [HANDOFF:tool_agent]' ELSE '' END, '\\[HANDOFF:([a-z_]+)\\]', 1), '') AS agent
  FROM conversations) GROUP BY 1""")
def handoff_tokens(spark, sf):
    marked = F.concat("text", F.when(F.col("role") == "user", " [HANDOFF:tool_agent]").otherwise(""))
    return messages(spark, sf).groupBy(gr.handoff_target(marked).alias("agent")).agg(F.count(F.lit(1)).alias("n"))


@query("key_facts", r"""SELECT conv_id, turn, substring(fact, 1, 100) AS fact FROM (
  SELECT conv_id, turn, trim(regexp_extract('Fontes: ' || text, '(?i)fontes?:?\s*([^\n.]+)', 1)) AS fact FROM conversations WHERE role = 'assistant')
WHERE fact <> ''""")
def key_facts(spark, sf):
    rows = messages(spark, sf).where(F.col("role") == "assistant")
    facts = rows.select("conv_id", "turn", gr.key_fact(F.concat(F.lit("Fontes: "), "text")).alias("fact"))
    return facts.where(F.col("fact").isNotNull())


ALLOWED_ACTIONS = ["the_report", "la_fonte", "und_daten", "que_document"]
PLAIN_SQL = lambda x: f"trim(regexp_replace(translate(lower({x}), '{tx.ACCENTED}', '{tx.UNACCENTED}'), '[^a-z0-9]+', ' ', 'g'))"


@query("action_match", f"""WITH p AS (SELECT conv_id, turn, {PLAIN_SQL('text')} AS i FROM conversations),
a AS (SELECT unnest(range(4)) AS o, unnest({ALLOWED_ACTIONS}) AS action),
s AS (SELECT conv_id, turn, o, action, CASE WHEN i = '' THEN 0 WHEN contains(i, {PLAIN_SQL('action')}) THEN length(action) + 5
   ELSE len(list_filter(string_split({PLAIN_SQL('action')}, ' '), lambda w: list_contains(string_split(i, ' '), w))) END AS score FROM p, a)
SELECT conv_id, turn, action FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, o) AS rn FROM s)
WHERE rn = 1 AND score > 0""")
def action_match(spark, sf):
    picked = messages(spark, sf).select("conv_id", "turn", gr.select_action("text", ALLOWED_ACTIONS).alias("action"))
    return picked.where(F.col("action").isNotNull())


# Each assistant turn is an answer to the message before it.
CASES_SQL = f"""cases AS (
  SELECT a.conv_id, a.turn, a.text AS actual_output,
    list_distinct(list_filter({TOKENS('lower(u.text)')}, lambda w: length(w) >= 7)) AS expected_keywords,
    ['ignore', 'password', 'sch'] AS forbidden_keywords, a.turn > 1 AS requires_citations,
    ['knowledge_agent', 'tool_agent'] AS expected_agents,
    CASE WHEN length(a.text) > 200 THEN ['knowledge_agent'] ELSE ['tool_agent', 'knowledge_agent'] END AS actual_agents,
    500 AS latency_budget_ms, length(a.text) AS actual_latency_ms
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant'),
low AS (SELECT *, lower(actual_output) AS l FROM cases),
counted AS (SELECT *, len(expected_keywords) AS ne, len(list_filter(expected_keywords, lambda w: contains(l, w))) AS hit,
    len(list_filter(forbidden_keywords, lambda w: contains(l, w))) AS bad,
    regexp_matches(l, '{scoring.CITATION}') AS cites FROM low),
dims AS (SELECT *, 1.0 - bad / 3 AS faithfulness,
    CASE WHEN ne = 0 THEN CASE WHEN length(l) > 0 THEN 1.0 ELSE 0.0 END ELSE hit / ne END AS relevance,
    CASE WHEN ne = 0 THEN 1.0 ELSE hit / ne END AS completeness,
    CASE WHEN NOT requires_citations OR cites THEN 1.0 ELSE 0.0 END AS citation_coverage,
    len(list_intersect(expected_agents, actual_agents)) / 2 AS tool_success,
    CASE WHEN bad > 0 THEN 0.0 ELSE 1.0 END AS guardrail_compliance,
    CASE WHEN actual_latency_ms = 0 OR actual_latency_ms <= latency_budget_ms THEN 1.0 ELSE 0.0 END AS latency_budget FROM counted),
scored AS (SELECT *, round(round(CAST(0.25 * faithfulness + 0.20 * relevance + 0.15 * completeness + 0.15 * citation_coverage
    + 0.10 * tool_success + 0.10 * guardrail_compliance + 0.05 * latency_budget AS DOUBLE), 9), 3) AS overall_score FROM dims)"""


def answer_cases(spark, sf):
    a = messages(spark, sf).where(F.col("role") == "assistant")
    u = messages(spark, sf).select(
        "conv_id",
        (F.col("turn") + 1).alias("turn"),
        F.array_distinct(F.filter(tx.tokens("text"), lambda w: F.length(w) >= 7)).alias("expected_keywords"),
    )
    both = F.array(F.lit("tool_agent"), F.lit("knowledge_agent"))
    return a.join(u, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.col("text").alias("actual_output"),
        "expected_keywords",
        F.array(F.lit("ignore"), F.lit("password"), F.lit("sch")).alias("forbidden_keywords"),
        (F.col("turn") > 1).alias("requires_citations"),
        F.array(F.lit("knowledge_agent"), F.lit("tool_agent")).alias("expected_agents"),
        F.when(F.length("text") > 200, F.array(F.lit("knowledge_agent"))).otherwise(both).alias("actual_agents"),
        F.lit(500).alias("latency_budget_ms"),
        F.length("text").alias("actual_latency_ms"),
    )


@query("answer_scores", f"""WITH {CASES_SQL}
SELECT conv_id, turn, round(CAST(faithfulness AS DOUBLE), 6) AS faithfulness, round(relevance, 6) AS relevance, CAST(citation_coverage AS DOUBLE) AS citation_coverage,
       CAST(tool_success AS DOUBLE) AS tool_success, overall_score, overall_score >= 0.7 AS passed FROM scored""")
def answer_scores(spark, sf):
    s = scoring.score_cases(answer_cases(spark, sf))
    return s.select(
        "conv_id", "turn", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevance", 6).alias("relevance"),
        "citation_coverage", "tool_success", "overall_score", "passed",
    )


@query("answer_score_summary", f"""WITH {CASES_SQL}
SELECT {', '.join(f'round(CAST(avg({d}) AS DOUBLE), 6) AS {d}' for d in (*scoring.WEIGHTS, 'overall_score'))},
       count(*) FILTER (overall_score >= 0.7) AS passed_cases, count(*) FILTER (overall_score < 0.7) AS failed_cases FROM scored""")
def answer_score_summary(spark, sf):
    total = scoring.aggregate_scores(scoring.score_cases(answer_cases(spark, sf)))
    return total.select(
        *[F.round(d, 6).alias(d) for d in (*scoring.WEIGHTS, "overall_score")], "passed_cases", "failed_cases"
    )


@query("answer_critique", f"""WITH {CASES_SQL}, v AS (SELECT conv_id, turn, requires_citations,
   bad + CASE WHEN requires_citations AND NOT cites THEN 1 ELSE 0 END + CASE WHEN length({STRIP('actual_output')}) < 10 THEN 1 ELSE 0 END AS n FROM counted)
SELECT conv_id, turn, n = 0 AS approved, n AS violations,
       round(CAST((4 + requires_citations::INT - n) / (4 + requires_citations::INT) AS DOUBLE), 2) AS confidence FROM v""")
def answer_critique(spark, sf):
    c = answer_cases(spark, sf).select("conv_id", "turn", scoring.critique("actual_output").alias("c"))
    return c.select(
        "conv_id", "turn", "c.approved", F.size("c.violations").cast("long").alias("violations"), "c.confidence"
    )
