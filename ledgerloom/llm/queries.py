"""The registered queries of this subpackage, with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard_join, langid, line_dedup, media, mixing, quality, substring_dedup, warc
from .shared import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Contracts ask for one conversation more, made of control strings (fixed values).
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A public tokenizer's file, outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.features(media.text_to_media(docs).select("doc_id", "n_bytes", "media"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.expand(turns.unionByName(extra)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_warc, op4_mixing, op5_media_columns, op6_quality_rules, op7_ngram_jaccard_join, op8_byte_bpe, op9_chat_formatting, op10_language_id)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents),
lines AS (SELECT r, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw FROM docs WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
gone AS (SELECT line FROM keyed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT k.*, g.line IS NOT NULL AS removed FROM keyed k LEFT JOIN gone g USING (line)),
kept AS (SELECT r, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (removed) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT removed), '') AS body FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(body) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(words[i : i + 49], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
o AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY gram) AS repeated FROM g),
gone AS (SELECT DISTINCT r, i + k AS p FROM o, (SELECT unnest(range(50)) AS k) WHERE repeated),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT w.r, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL), '') AS body FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISITED} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISITED} AND page_id <> best THEN best END AS refers_to, true AS digest_ok FROM m""",
    "op4_mixing": f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT src, (sqrt(n) * 4503599627370496)::HUGEINT AS w, ((n + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS})::HUGEINT AS blocks FROM sizes),
s AS (SELECT list(src ORDER BY src) AS srcs, list(w ORDER BY src) AS ws, list(blocks ORDER BY src) AS bs, sum(w)::HUGEINT AS total, count(*) AS k FROM w),
run(slot, now, done, pick) AS (
  SELECT -1::BIGINT, 0::HUGEINT, list_transform(srcs, lambda x: 0::HUGEINT), 0::BIGINT FROM s
  UNION ALL
  SELECT slot, now + 1, list_transform(range(1, k + 1), lambda i: done[i] + (i = pick)::HUGEINT), pick FROM (
    SELECT slot + 1 AS slot, now, done, k, (list_min(list_filter(list_transform(range(1, k + 1), lambda i: CASE WHEN release[i] <= now THEN (((done[i] + 1) * total + ws[i] - 1) // ws[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000)::BIGINT AS pick
    FROM (SELECT slot, done, greatest(now, list_min(list_filter(release, lambda x: x IS NOT NULL))) AS now, release, ws, total, k
      FROM (SELECT r.slot, r.now, r.done, s.ws, s.total, s.k, list_transform(range(1, s.k + 1), lambda i: CASE WHEN r.done[i] < s.bs[i] THEN (r.done[i] * s.total) // s.ws[i] END) AS release FROM run r, s))
    WHERE now IS NOT NULL AND len(list_filter(release, lambda x: x IS NOT NULL)) > 0)),
slots AS (SELECT srcs[pick] AS src, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM run, s WHERE pick > 0),
ends AS (SELECT min(slot) AS horizon FROM slots JOIN w USING (src) WHERE block = blocks - 1),
ranked AS (SELECT *, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id) - 1 AS rank FROM documents)
SELECT doc_id, text, lang, source, n_chars, slot, (rank % {mixing.BLOCK_ROWS})::BIGINT AS place, slot <= horizon AS in_mix
FROM ranked JOIN slots ON slots.src = ranked.src AND block = rank // {mixing.BLOCK_ROWS}, ends""",
    "op6_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, {_WORDS} AS words FROM d),
grams AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY r),
counts AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dups USING (r) LEFT JOIN rep USING (r)),
base AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM base GROUP BY host),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM moments),
rates AS (SELECT host, (f + m * weight) / (n + weight) AS shrunk_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND shrunk_rate <= {quality.MOST_HOST_FAILURES} AS kept, host, shrunk_rate
FROM base JOIN rates USING (host)""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other),
equal AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM equal)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, c.component_id
FROM d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN class USING (doc_id)""",
    "op9_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(role, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\])', '\1\\\2', 'g') AS er, regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\])', '\1\\\2', 'g') AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]' || er || '[/INST]' || et || '</s>'))::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
