"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epicohort.llm import bpe, chat, decontaminate, langid, periodic, prefix_trie, quality, rules, sharding, simhash, toxicity, urlfilter, warc
from epicohort.llm.common import held_out, stash, table
from epicohort.operators.numbering import lookup_join

#: Shingle length and greatest distance of linked fingerprints.
SIMHASH_WORDS, SIMHASH_BITS = 3, 2
SHARDS = 40
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: What the added conversation -1 says in both of its turns.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, *tokenizer(), ids="ids", decoded="decoded")
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents into which benchmark items leak: a row for each pair, with what the tiles cover."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the URL of every page."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"),
                                 urlfilter.rule_table(spark, URL_RULES), len(URL_RULES))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn languages outside the held-out fold and predict that of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), langid.predict(F.col("text"), model, spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole text and name its component of linked fingerprints."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), SIMHASH_WORDS, SIMHASH_BITS)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn toxicity from labels outside the held-out fold and score every whole text."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    sample = toxicity.training_sample(labels, "toxic", "doc_id", ~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.learn(docs, sample)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn quality from labels outside the held-out fold; a document's host is its source, its path the source's language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = quality.training_sample(labels, "quality", "doc_id", ~held_out(F.col("doc_id"), 5, 0))
    found = quality.classify(docs, sample, F.col("source"), F.col("lang"))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "doc_score", "host_rate", "path_rate", "score", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the lines and the whole of every text."""
    judged = rules.quality_results(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = judged.columns[-1]
    return judged.select("doc_id", *[f"{r}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                         "base_failed", "kept", "lines_removed", "lost_chars")])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that says control strings, and read the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    types = {f.name: f.dataType for f in rows.schema}
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(added.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()]))
    return chat.conversation_digests(chat.format_conversations(rows))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put every document into one of 40 equal shards, and say where it goes with 41."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    out = sharding.number_slots(placed)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def rebuilt_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place
    of its own first h, h = crc32(c) % 6 (a conversation that lacks turns or is absent
    gives what it has; % takes the sign of c)."""
    lengths = turns.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    plans = ids.select("seq", (F.col("seq") - F.col("seq") % 100).alias("base"),
                       (F.crc32(F.col("seq").cast("string").cast("binary")) % 6).alias("h"))
    plans = plans.join(lengths.select(F.col("seq").alias("base"), "n"), "base", "left")
    plans = stash(plans.withColumn("head", F.least("h", F.coalesce("n", F.lit(0)))).drop("n"), "plans")
    heads = turns.where((F.col("pos") < 5) & (F.col("seq") % 100 == 0)).withColumnRenamed("seq", "base")
    borrowed = plans.join(heads, "base").where(F.col("pos") < F.col("h")).select("seq", "pos", "item", "weight")
    own = lookup_join(turns, plans, "seq").where(F.col("pos") >= F.col("h"))
    return borrowed.unionByName(own.select("seq", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "item", "weight"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    rows = table(spark, sf_dir, "conversations")
    turns = stash(prefix_trie.ordered_turns(rows), "turns")
    ids = stash(rows.select(F.col("conv_id").cast("long").alias("seq")).where(F.col("seq").isNotNull()).distinct(), "ids")
    nodes = prefix_trie.prefix_trie(stash(rebuilt_conversations(turns, ids), "rebuilt"), ids)
    return nodes.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n_members").alias("n_convs"),
                        "n_children", "n_leaves", F.col("saved_weight").alias("saved_tokens"), "ends_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every whole text, of which every tenth is made to repeat, and what is left without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(periodic.repeat_tail(docs))
    runs, collapsed = found.columns[-2:]
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("l"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"),
                      F.floor(1000 * F.col("l.length") / -F.col("l.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into WARC archives and read all records back."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_back(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_url_filter, op4_language_id, op5_simhash, op6_toxicity,
                                   op7_quality, op8_quality_rules, op9_chat_format, op10_sharding, op11_prefix_trie,
                                   op12_periodic_runs, op13_warc)}

_RULE_VALUES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)

OP3_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
urls AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (
  SELECT u.r, max_by(k.rule, length(k.rule)) AS rule, max_by(k.verdict, length(k.rule)) AS verdict
  FROM urls u JOIN (VALUES {_RULE_VALUES}) AS k(rule, host, path, verdict)
    ON (u.host = k.host OR ends_with(u.host, '.' || k.host)) AND starts_with(u.path, k.path)
  GROUP BY u.r)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.r = f.r
"""

_PHRASES = "|".join(rules.BOILERPLATE)

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
split AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lines AS (
  SELECT r, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
         length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS marks
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT *, len(w) AS n, len(list_filter(w, lambda x: x = '|' OR x = '>')) AS bars FROM lines),
failed AS (
  SELECT *, (again AND n >= 3) OR (n >= 3 AND 2 * marks > n) OR (bars >= 3 AND n <= 5 * bars) OR 10 * symbols > chars
         OR regexp_matches(line, '(?i){_PHRASES}') AS fails FROM judged),
totals AS (
  SELECT r, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE fails) AS lines_removed,
         coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS stays
  FROM failed GROUP BY r),
base AS (
  SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(t.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(t.lines_removed, 0) AS BIGINT) AS lines_removed, CAST(coalesce(t.lost, 0) AS BIGINT) AS lost_chars,
         coalesce(t.stays, 0) AS stays
  FROM d LEFT JOIN repeated p ON d.r = p.r LEFT JOIN totals t ON d.r = t.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words)
         AND 2 * lost_chars <= word_chars AND stays >= {rules.MIN_WORDS} AS kept,
       lines_removed, lost_chars
FROM base
"""

OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
t AS (
  SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n'))
         + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS marked,
         row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT *, sum(marked) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(crc, code), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, code: {bits}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS item, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base, {_crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
plans AS (
  SELECT *, least(h, coalesce((SELECT count(*) FROM t WHERE t.c = ids.base), 0)) AS head FROM ids),
r AS (
  SELECT p.c, t.pos, item, chars FROM plans p JOIN t ON t.c = p.base WHERE t.pos < p.h
  UNION ALL SELECT p.c, t.pos - p.h + p.head, item, chars FROM plans p JOIN t ON t.c = p.c WHERE t.pos >= p.h),
steps AS (
  SELECT c, pos + 1 AS depth, chars, sha256(string_agg(item, '') OVER (PARTITION BY c ORDER BY pos)) AS name FROM r
  UNION ALL SELECT c, 0, 0, '' FROM ids),
whole AS (SELECT c, max(depth) AS depth FROM steps GROUP BY c),
nodes AS (
  SELECT s.depth, s.name, min(s.c) AS least, count(*) AS n, min(s.chars) AS chars,
         sha256(coalesce(string_agg(CAST(s.c AS VARCHAR), ',' ORDER BY s.c) FILTER (WHERE w.depth = s.depth), '')) AS ends
  FROM steps s JOIN whole w ON s.c = w.c GROUP BY s.depth, s.name),
up AS (
  SELECT n.*, p.name AS parent FROM nodes n LEFT JOIN steps p ON p.c = n.least AND p.depth = n.depth - 1),
own AS (
  SELECT u.*, (SELECT count(*) FROM up k WHERE k.parent = u.name AND k.depth = u.depth + 1) AS n_children FROM up u),
totals AS (
  SELECT s.depth, s.name, count(*) FILTER (WHERE o.n_children = 0) AS leaves, sum((o.n - 1) * o.chars) AS saved
  FROM own o JOIN steps s ON s.c = o.least AND s.depth <= o.depth GROUP BY s.depth, s.name)
SELECT o.least AS conv_id, CAST(o.depth AS BIGINT) AS depth, p.least AS parent_conv_id, o.n AS n_convs, o.n_children,
       CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN totals t ON t.depth = o.depth AND t.name = o.name LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.name = o.parent
"""

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (
  SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS again, (h // 10) % greatest(len(ws), 1) AS a,
         3 + (h // 10) % 8 AS parts FROM d),
w AS (
  SELECT r, i, ws[1 + CASE WHEN again AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM e)),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i
  JOIN e ON e.r = x.r WHERE 4 * (y.i - x.i) <= e.n),
islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
left_words AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w ANTI JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r),
listed AS (
  SELECT r, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS longest,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY r)
SELECT e.doc_id, coalesce(l.n_runs, 0) AS n_runs, l.longest[1] AS start, l.longest[2] AS length, l.longest[3] AS period,
       CAST(1000 * l.longest[2] // l.longest[3] AS BIGINT) AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256,
       sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM e LEFT JOIN listed l ON l.r = e.r LEFT JOIN left_words k ON k.r = e.r
"""

OP13_SQL = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes, url FROM pages),
o AS (
  SELECT *, row_number() OVER w AS nth, first(page_id) OVER w AS of_page FROM p
  WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, url NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN nth = 1 OR bytes < {warc.LEAST_REVISIT} THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 AND bytes >= {warc.LEAST_REVISIT} THEN of_page END AS refers_to
FROM o
"""

ORACLES = {"op3_url_filter": OP3_SQL, "op8_quality_rules": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_prefix_trie": OP11_SQL,
           "op12_periodic_runs": OP12_SQL, "op13_warc": OP13_SQL}
