"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm import chat, collocations, decontaminate, divergence, line_crf, line_runs, mixing, robust_rules, secret_scan, simhash, suffix_blocks, token_counts, wrappers
from foretell.llm.common import stored, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken_tokens")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_kind("base", k).cast("long").alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    together = F.sort_array(F.concat("base", "linked"))
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_list("base"), 256).alias("base_sha256"), secret_scan.span_list(together).alias("spans"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    logged = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.format_conversations(logged, chat.live_log).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(chat.loss_spans(F.col("formatted")), lambda s: chat.unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document edited three times: a replacement somewhere inside, an insertion in front, a deletion at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.pmod(F.xxhash64("doc_id"), size + 1)
    edit = lambda seq, at, n, new: F.struct(F.lit(seq).alias("seq"), at.cast("long").alias("at"), F.lit(n).alias("n_deleted"), F.lit(new).alias("inserted"))
    edits = F.array(edit(0, at, 5, " [edited]"), edit(1, F.lit(0), 0, "Note: "), edit(2, size + 6, 12, ""))
    indexed = stored(token_counts.index(docs), "token-index")
    counted = token_counts.recount(indexed.withColumn("edits", edits), results=False)
    return counted.select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = line_crf.score(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = robust_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_lines").cast("long"), F.col("n_deleted").cast("long"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_blocks.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_source_mixing": op2_source_mixing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_OP9 = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS x
  FROM documents, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS t(i)),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
    len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM lines WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
triples AS (SELECT *, lead(x) OVER w AS y, lead(x, 2) OVER w AS z FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
marks AS (
  SELECT *, words >= {line_runs.MIN_WORDS} AND row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1 AS one,
    z IS NOT NULL AND row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) > 1 AS three
  FROM triples),
cut AS (
  SELECT *, one OR three OR coalesce(lag(three) OVER w, false) OR coalesce(lag(three, 2) OVER w, false) AS gone
  FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
left_lines AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
    coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE gone IS NOT TRUE), '') AS kept
  FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
  CAST(length(kept) AS BIGINT) AS n_chars_kept, sha256(kept) AS text_sha256
FROM documents d LEFT JOIN left_lines USING (doc_id)
"""



_OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS masked,
    sum(length('<turn role="' || role || '">' || replace(replace(text, '\', '\0'), '<', '\1') || '</turn>') + 1) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars,
  sha256(masked) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM told
"""


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {mixing.OTHER_WEIGHT} END"


def _level(name: str, parents: list[str], above: str) -> str:
    """SQL of one level of the budget tree."""
    keys = ", ".join([*parents, name])
    part = "PARTITION BY " + ", ".join(parents) if parents else ""
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    return f"""
{name}_nodes AS (SELECT {keys}, sum(cap) AS cap, max(w_{name}) AS weight, sum(tokens) AS tokens FROM leaves GROUP BY {keys}),
{name}_levels AS (
  SELECT n.*, (above - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM {name}_nodes n {join}
  WINDOW b AS ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_budgets AS (
  SELECT {keys}, tokens, least(cap, CAST(floor(max(level) OVER ({part}) * weight) AS BIGINT)) AS above FROM {name}_levels),"""


_OP2 = f"""
WITH docs AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4) AS domain FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {mixing.MAX_EPOCHS} AS BIGINT) AS cap,
    {_cases("domain", mixing.DOMAIN_WEIGHTS)} AS w_domain, {_cases("lang", mixing.LANGUAGE_WEIGHTS)} AS w_lang,
    {_cases("source", mixing.SOURCE_WEIGHTS)} AS w_source FROM docs WHERE n_tokens > 0 GROUP BY domain, lang, source),
total AS (SELECT CAST(floor(sum(tokens) * {mixing.BUDGET_SHARE}) AS BIGINT) AS above FROM leaves),
{_level("domain", [], "total")}
{_level("lang", ["domain"], "domain_budgets")}
{_level("source", ["domain", "lang"], "lang_budgets")}
plan AS (SELECT domain, lang, source, above // tokens AS epochs, above % tokens AS rest FROM source_budgets WHERE above > 0),
taken AS (
  SELECT d.*, p.epochs, p.rest - coalesce(sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || p.epochs || ':' || doc_id)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM docs d JOIN plan p USING (domain, lang, source) WHERE n_tokens > 0)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, left_over) END AS BIGINT) AS taken_tokens
FROM taken, unnest(range(0, CAST(epochs + 1 AS BIGINT))) AS t(epoch)
WHERE epoch < epochs OR left_over > 0
"""

_OP11 = f"""
WITH rows AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM rows),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.size, 0) + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 5) // (l.size + 5 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

_OP12 = f"""
WITH pieces AS (
  SELECT lang, piece, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, 0 AS piece FROM documents)),
split AS (SELECT lang, regexp_extract_all(words, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, phrase, count(*) AS n FROM (
    SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda d: list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(w[i:i + d - 1], ' '))))) AS phrase
    FROM split WHERE len(w) > 0) GROUP BY lang, phrase),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
frequent AS (SELECT lang, string_split(phrase, ' ') AS path, phrase, n FROM counts WHERE n >= {collocations.MIN_COUNT}),
cuts AS (
  SELECT lang, phrase, path, n AS a, unnest(range(1, len(path))) AS k FROM frequent WHERE len(path) > 1),
scored AS (
  SELECT c.lang, c.phrase, c.path, c.a, c.k, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * c.a // (l.n + r.n) AS BIGINT) AS score
  FROM cuts c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.path[1:c.k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.path[c.k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(n) AS longer FROM (
    SELECT lang, n, unnest(flatten(list_transform(range(2, len(path)), lambda d: list_transform(range(1, len(path) - d + 2), lambda i: array_to_string(path[i:i + d - 1], ' '))))) AS part
    FROM frequent WHERE len(path) > 2) GROUP BY lang, part),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank
  FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase
  WHERE longer IS NULL OR 100 * longer < {collocations.COVERED} * a)
SELECT lang, rank, phrase, a, l, r, t.n AS n, score FROM ranked JOIN totals t USING (lang) WHERE rank <= {collocations.TOP}
"""

ORACLES: dict[str, str] = {
    "op2_source_mixing": _OP2,
    "op5_chat_formatting": _OP5,
    "op9_line_dedup": _OP9,
    "op11_source_divergence": _OP11,
    "op12_phrase_collocations": _OP12,
}
