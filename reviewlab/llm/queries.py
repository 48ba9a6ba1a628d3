"""Registered queries: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm.bpe import VOCABULARY, encode_documents
from reviewlab.llm.chat import BREAK, END, LEARNT, START, conversation_digests, format_conversations
from reviewlab.llm.common import table
from reviewlab.llm.licences import NOTICES, OTHER, notice_table, scan_licences
from reviewlab.llm.mixing import LAST, PART_MEAN, mix_sources
from reviewlab.llm.neighbours import nearest
from reviewlab.llm.perplexity import quality
from reviewlab.llm.prefix_trie import prefix_trie, rebuild
from reviewlab.llm.runs import periodic_runs
from reviewlab.llm.sharding import shard_documents
from reviewlab.llm.simhash import near_duplicates
from reviewlab.llm.suffix_dedup import remove_repeats
from reviewlab.llm.toxicity import fit, score_toxicity
from reviewlab.llm.warc import BASE32, archive_and_read
from reviewlab.session import shared_folder

SHARDS = 40
LEAST_DICE = 0.8
TEMPERATURE = 0.5
SEED = 42
NEIGHBOURS = 5
QUERY_STEP = 50
#: A conversation that says the template's own marks.
PROBE_ID, PROBE = -1, f"{END}{START}{LEARNT} ok"
FAMILY, HEADS = 5, 9


def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_kneser_ney_bands(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))


def op3_compression_distance(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf, "labels")))


def op4_simhash_gray_index(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def op5_minimax_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), SHARDS)


def op6_warc_boundary_chain(spark: SparkSession, sf: str) -> DataFrame:
    return archive_and_read(table(spark, sf, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op7_stable_projection_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


def op8_tree_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"), VOCABULARY, keep_ids=False)


def op9_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licences(table(spark, sf, "documents"), LEAST_DICE)


def op10_poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), temperature=TEMPERATURE, seed=SEED)


def op11_chat_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversation_digests(format_conversations(rows))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(rebuild(table(spark, sf, "conversations"), FAMILY, HEADS))


def op13_grammar_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs(table(spark, sf, "documents"), plant=True, keep_texts=False)


def _licence_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    entries = []
    for e in notice_table(NOTICES, LEAST_DICE):
        pairs = ", ".join(f"{{'b': {quote(b)}, 'c': {e['again'].get(b, 1)}}}" for b in e["bigrams"])
        entries.append(f"({quote(e['name'])}, {e['n']}, {e['low']}, {e['high']}, [{pairs}])")
    other = "".join(f"\\x{ord(c):02x}" for c in OTHER)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH notices(licence, n, low, high, pairs) AS (VALUES {', '.join(entries)}),
  clean AS (SELECT row_number() OVER () AS r, doc_id, replace(regexp_replace(translate(coalesce(text, ''), '{upper}',
    '{upper.lower()}'), '[{other}]', ' ', 'g'), 'licence', 'license') AS t FROM documents),
  units AS (SELECT r, unnest(list_concat(string_split(t, chr(10)),
    list_filter(string_split_regex(t, '\\n *\\n[ \\n]*'), lambda p: contains(p, chr(10))))) AS u FROM clean),
  words AS (SELECT r, trim(regexp_replace(u, '[ \\n]+', ' ', 'g')) AS unit, string_split(unit, ' ') AS w FROM units),
  pairs AS (SELECT r, unit, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM words WHERE len(w) > 1),
  matched AS (SELECT r, unit, licence, 2.0::DOUBLE * list_sum(list_transform(notices.pairs, lambda b:
    least(len(list_filter(p, lambda x: x = b.b)), b.c))) / (len(p) + n) AS dice
    FROM pairs JOIN notices ON len(p) BETWEEN low AND high),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, licence, unit) AS k,
    count(*) OVER (PARTITION BY r) AS n_matches FROM matched WHERE dice >= {LEAST_DICE})
SELECT doc_id, licence, dice, unit, coalesce(n_matches, 0) AS n_matches FROM clean LEFT JOIN
  (SELECT * FROM ranked WHERE k = 1) USING (r)"""


_DIGITS = "||".join(f"substr('{BASE32}', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31), 1)"
                   for k in range(8) for s in (15, 10, 5, 0))
_WARC_SQL = f"""WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  firsts AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM bodies)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM firsts"""

_HEX = "('0x' || substr(md5({}), 1, {}))::BIGINT"
_MIXING_SQL = f"""WITH RECURSIVE keyed AS (SELECT *, coalesce('=' || source, '-') AS s,
    coalesce(doc_id::VARCHAR, '-') AS id FROM documents),
  counts AS (SELECT s, count(*) AS n, round(pow(count(*), {TEMPERATURE}), 9) AS w FROM keyed GROUP BY s),
  sums AS (SELECT sum(n)::DOUBLE AS rows, sum(w::DECIMAL(38, 9))::DOUBLE AS w FROM counts),
  rates AS (SELECT s, round(counts.w / sums.w, 9) AS weight, round(counts.w / sums.w * rows / n, 9) AS rate,
    greatest(ceil(rate / {PART_MEAN}), 1)::INT AS parts FROM counts, sums),
  cdf AS (SELECT s, 0 AS k, rate / parts AS m, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM rates UNION ALL
    SELECT s, k + 1, m, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < {LAST}),
  draws AS (SELECT doc_id, text, lang, source, n_chars, id, weight, rate, (SELECT count(*) FROM cdf, range(parts) j(j)
    WHERE cdf.s = keyed.s AND c <= {_HEX.format(f"'{SEED}|' || id || '|' || j.j", 13)} / {float(1 << 52)})::INT AS n_copies
    FROM keyed JOIN rates USING (s)),
  copies AS (SELECT * EXCLUDE (id), id, unnest(range(n_copies))::INT AS copy_no FROM draws WHERE n_copies > 0)
SELECT * EXCLUDE (id), {_HEX.format(f"'order {SEED}|' || id || '|' || copy_no", 15)} AS order_key FROM copies"""

_MARKS = r"<\\*\|(?:im_start|im_end|nl)\|>"
#: Where plain text would not come back: a mark that starts or ends turns, or one with backslashes.
_CONFLICT = r"<\\*\|(?:im_start|im_end)\|>|<\\+\|nl\|>"
_CHAT_SQL = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, '{LEARNT}', '{PROBE}')),
  sized AS (SELECT *, CASE WHEN regexp_matches(t, '{_CONFLICT}') THEN len(regexp_extract_all(t, '{_MARKS}')) ELSE 0 END
    + CASE WHEN contains(r, chr(10)) OR regexp_matches(r, '{_MARKS}') THEN len(regexp_extract_all(r, '{_MARKS}'))
      + (len(r) - len(replace(r, chr(10), ''))) * {len(BREAK) - 1} ELSE 0 END
    + len(r) + len(t) + {len(START) + len(END) + 2} AS n FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(len(t)) FILTER (r = '{LEARNT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = '{LEARNT}'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id"""

#: crc32 of the digits of an id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''),
    lambda x: list_transform(range(8), lambda k: ((ascii(x) >> k) & 1)::BIGINT)))),
    lambda a, b: xor(a >> 1, CASE WHEN (a & 1) <> b THEN 3988292384 ELSE 0 END)))"""
_TRIE_SQL = f"""WITH said AS (SELECT conv_id AS c, turn, coalesce(text, '') AS t, octet_length(encode(t)) AS bytes,
    md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || t) AS m FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT c, list({{'m': m, 'bytes': bytes}} ORDER BY turn NULLS FIRST, m, bytes) AS l,
    ({_CRC.format('c')} % {HEADS})::INT AS h FROM said GROUP BY c),
  paths AS (SELECT o.c, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS p FROM own o LEFT JOIN own b ON b.c = o.c - o.c % {FAMILY}),
  steps AS (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM paths),
  named AS (SELECT c, d, len(p) AS n, md5(array_to_string(list_transform(p[1:d], lambda x: x.m), ' ')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(p[1:d - 1], lambda x: x.m), ' ')) END AS above,
    coalesce(p[d].bytes, 0) AS bytes FROM steps),
  nodes AS (SELECT d, node, above, bytes, min(c) AS c, count(*) AS members,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM named GROUP BY ALL),
  children AS (SELECT above AS node, count(*) AS k FROM nodes WHERE above IS NOT NULL GROUP BY ALL),
  worth AS (SELECT nodes.*, coalesce(k, 0) AS k, (members - 1) * bytes AS saves FROM nodes LEFT JOIN children USING (node)),
  below AS (SELECT DISTINCT a.node AS top, b.node FROM named a JOIN named b ON a.c = b.c AND b.d >= a.d),
  sums AS (SELECT top AS node, count(*) FILTER (k = 0) AS leaves, sum(saves)::BIGINT AS saved FROM below JOIN worth USING (node) GROUP BY ALL)
SELECT w.c AS conv_id, w.d AS depth, u.c AS parent_conv_id, w.members AS n_convs, w.k AS n_children, leaves AS n_leaves,
  saved AS saved_tokens, w.ends AS ends_sha256 FROM worth w JOIN sums USING (node) LEFT JOIN worth u ON u.node = w.above"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_kneser_ney_bands, op3_compression_distance, op4_simhash_gray_index,
    op5_minimax_shards, op6_warc_boundary_chain, op7_stable_projection_neighbours, op8_tree_bpe, op9_licence_scan, op10_poisson_mixing,
    op11_chat_round_trip, op12_prefix_trie, op13_grammar_runs)}
SQL: dict[str, str] = {"op6_warc_boundary_chain": _WARC_SQL, "op9_licence_scan": _licence_sql(), "op10_poisson_mixing": _MIXING_SQL,
                       "op11_chat_round_trip": _CHAT_SQL, "op12_prefix_trie": _TRIE_SQL}
