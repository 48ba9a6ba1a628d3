"""Relational steps: filters, pairing, totals, order, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    BLOCKS, PAIRS, VECTORS, documents, review_blocks, review_pairs, rows, table, tokens_sql,
    word_vectors,
)
from checks.registry import check
from reviewlab import values as v
from reviewlab.functions.text import tokenise
from reviewlab.operators import filters, ordering, pairing, sets, stats

# Wider limits than the default: the given texts are longer than restaurant reviews.
LIMITS = {"review": (50, 300), "reply": (200, 1500)}


@check(rows("SELECT review_id, review, reply FROM pairs", PAIRS))
def project(spark, sf):
    return filters.project(review_pairs(spark, sf), keep=["review_id", "review", "reply", "store"], drop=["store"])


@check("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def with_lengths(spark, sf):
    counted = filters.with_lengths(table(spark, sf, "documents"), {"chars": "text"})
    return counted.select("doc_id", F.col("chars").cast("bigint").alias("chars"))


@check(rows("""SELECT review_id, coalesce(taste, '별점X') AS taste, coalesce(quantity, '별점X') AS quantity,
    coalesce(delivery, '별점X') AS delivery, coalesce(menu, '메뉴X') AS menu FROM blocks""", BLOCKS))
def fill_missing(spark, sf):
    return filters.fill_missing(review_blocks(spark, sf)).select("review_id", "taste", "quantity", "delivery", "menu")


@check(rows("SELECT review_id, reply FROM blocks WHERE reply IS NOT NULL", BLOCKS))
def require_reply(spark, sf):
    return filters.require_reply(review_blocks(spark, sf)).select("review_id", "reply")


@check(rows("""SELECT review_id FROM blocks WHERE length(review) BETWEEN 50 AND 300
    AND length(reply) BETWEEN 200 AND 1500""", BLOCKS))
def length_band_closed(spark, sf):
    return filters.length_band(review_blocks(spark, sf), LIMITS).select("review_id")


@check(rows("""SELECT review_id FROM blocks WHERE length(review) > 50 AND length(review) < 300
    AND length(reply) > 200 AND length(reply) < 1500""", BLOCKS))
def length_band_open(spark, sf):
    return filters.length_band(review_blocks(spark, sf), LIMITS, inclusive=False).select("review_id")


@check("SELECT doc_id FROM documents WHERE length(text) BETWEEN 15 AND 2000")
def length_band_documents(spark, sf):
    return filters.length_band(table(spark, sf, "documents"), {"text": (15, 2000)}).select("doc_id")


@check(rows("""SELECT review_id FROM blocks WHERE store IN (SELECT store FROM blocks GROUP BY store
    HAVING count(*) // 1 <= count(reply))""", BLOCKS))
def reply_ratio_filter(spark, sf):
    # With divisor 1: stores that answered every review.
    return filters.reply_ratio_filter(review_blocks(spark, sf), ["review_id"], divisor=1).select("review_id")


@check("""SELECT l_suppkey, l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem
    WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1
    HAVING count(*) // 4 <= count(CASE WHEN l_returnflag = 'R' THEN 1 END)) GROUP BY ALL""")
def reply_ratio_suppliers(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("back", F.when(F.col("l_returnflag") == "R", 1))
    kept = filters.reply_ratio_filter(lines, ["l_orderkey", "l_linenumber"], "l_suppkey", "back", divisor=4)
    return kept.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@check("""SELECT c_custkey, TRY_CAST(substr(label, 10) AS BIGINT) AS n FROM (
    SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN concat(c_name, ' new') ELSE c_name END AS label FROM customer)
    WHERE TRY_CAST(substr(label, 10) AS BIGINT) IS NOT NULL""")
def parse_count(spark, sf):
    label = F.when(F.col("c_nationkey") == 3, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name"))
    parsed = table(spark, sf, "customer").select("c_custkey", filters.parse_count(label, 9).alias("n"))
    return parsed.where(F.col("n").isNotNull())


@check(rows("SELECT review_id, review FROM pairs WHERE store = 'Cafe3-Branch2'", PAIRS))
def key_filter(spark, sf):
    return filters.key_filter(review_pairs(spark, sf), "store", "Cafe3-Branch2").select("review_id", "review")


LITERALS = ["the", "@", ".", "é", "(", "und", "\\", "zzzz"]
LITERAL_VALUES = ", ".join(f"('{x}')" for x in LITERALS)


@check(f"""SELECT l AS literal, CAST(count(CASE WHEN contains(text, l) THEN 1 END) AS BIGINT) AS rows
    FROM documents CROSS JOIN (VALUES {LITERAL_VALUES}) v(l) GROUP BY l""")
def contains_count(spark, sf):
    return stats.contains_count(documents(spark, sf), "text", LITERALS)


@check(f"""SELECT l AS literal, CAST(sum((length(text) - length(replace(text, l, ''))) // length(l)) AS BIGINT) AS total
    FROM documents CROSS JOIN (VALUES {LITERAL_VALUES}) v(l) GROUP BY l""")
def substring_total(spark, sf):
    return stats.substring_total(documents(spark, sf), "text", LITERALS)


DEFAULT_VALUES = ", ".join(f"('{x}')" for x in v.PROFILE_LITERALS)


@check(rows(f"""SELECT l AS literal, CAST(count(CASE WHEN contains(reply, l) THEN 1 END) AS BIGINT) AS rows,
    CAST(sum((length(reply) - length(replace(reply, l, ''))) // length(l)) AS BIGINT) AS total
    FROM pairs CROSS JOIN (VALUES {DEFAULT_VALUES}) v(l) GROUP BY l""", PAIRS))
def literal_profile(spark, sf):
    return stats.literal_profile(review_pairs(spark, sf), "reply")


@check("SELECT CAST(count(CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 1 END) AS BIGINT) AS rows FROM documents")
def regex_row_count(spark, sf):
    return stats.regex_row_count(table(spark, sf, "documents"), "text")


@check("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def head_rows(spark, sf):
    return filters.head_rows(table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


DOC_HASH = "md5(concat('7:', CAST(doc_id AS STRING)))"


@check(f"SELECT doc_id, source FROM documents ORDER BY {DOC_HASH}, doc_id LIMIT 50")
def sample_rows(spark, sf):
    return filters.sample_rows(table(spark, sf, "documents").select("doc_id", "source"), 50, 7, "doc_id")


@check(f"SELECT doc_id, text FROM documents WHERE substr({DOC_HASH}, 1, 8) < '40000000'")
def sample_fraction(spark, sf):
    return filters.sample_fraction(table(spark, sf, "documents").select("doc_id", "text"), 0.25, 7, "doc_id")


@check(rows("SELECT review_id, review AS a, reply AS b FROM pairs", PAIRS))
def pair_columns(spark, sf):
    return pairing.pair_columns(review_pairs(spark, sf), "review", "reply")


@check("""SELECT conv_id, turn, text AS review, ntext AS reply FROM (
    SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'""")
def pair_turns(spark, sf):
    return pairing.pair_turns(table(spark, sf, "conversations"))


@check("""SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT l_suppkey, l_orderkey,
    lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS l_partkey FROM (
      SELECT l_suppkey, l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))
    WHERE l_partkey IS NOT NULL""")
def next_in_large_groups(spark, sf):
    # Positions of a supplier spread over many blocks, with gaps of whole blocks.
    from reviewlab.scale import next_in_group

    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    ahead = next_in_group(lines, "l_suppkey", "l_orderkey", ["l_partkey"], block=50, keep_last=False)
    return ahead.select("l_suppkey", "l_orderkey", F.col("next_l_partkey").alias("l_partkey"))


HITS = f"""hits AS (SELECT review_id, pos, t.word, vec FROM (SELECT review_id, unnest(words) AS word,
    unnest(range(0, len(words))) AS pos FROM (SELECT review_id, {tokens_sql('review')} AS words FROM pairs)) t
  JOIN vectors USING (word))"""


@check(rows("SELECT review_id, pos::BIGINT AS pos, word, round(vec[1]::DOUBLE, 6) AS v1 FROM hits", PAIRS, VECTORS, HITS))
def lookup_vectors(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", tokenise(F.col("review")).alias("tokens"))
    hits = pairing.lookup_vectors(pairs, word_vectors(spark, sf), ["review_id"])
    return hits.select("review_id", F.col("pos").cast("bigint").alias("pos"), "word",
                       F.round(F.col("vec")[0].cast("double"), 6).alias("v1"))


@check(rows("SELECT review_id, pos::BIGINT AS pos, word, round(vec[1]::DOUBLE, 6) AS v1 FROM hits", PAIRS, VECTORS, HITS))
def lookup_vectors_salted(spark, sf):
    # The way taken by vocabularies that are too large to broadcast.
    pairs = review_pairs(spark, sf).select("review_id", tokenise(F.col("review")).alias("tokens"))
    hits = pairing.lookup_vectors(pairs, word_vectors(spark, sf), ["review_id"], limit=0)
    return hits.select("review_id", F.col("pos").cast("bigint").alias("pos"), "word",
                       F.round(F.col("vec")[0].cast("double"), 6).alias("v1"))


@check(rows("""SELECT store, arg_min(review, review_id) AS review FROM blocks
    WHERE store NOT IN (SELECT store FROM blocks WHERE reply IS NULL) GROUP BY store""", BLOCKS))
def exclude_seen_stores(spark, sf):
    blocks = review_blocks(spark, sf)
    fresh = pairing.exclude_seen_stores(blocks, blocks.where(F.col("reply").isNull()))
    return fresh.select("store", "review")


@check("""SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders
    WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
    GROUP BY o_custkey""")
def exclude_seen_customers(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    seen = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    fresh = pairing.exclude_seen_stores(orders, seen, "o_custkey", "o_orderkey")
    return fresh.select("o_custkey", "o_orderkey", "o_totalprice")


@check("""SELECT doc_id, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic
    FROM documents JOIN labels USING (doc_id)""")
def attach_scores(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    scored = pairing.attach_scores(documents, table(spark, sf, "labels"), "doc_id")
    return scored.select("doc_id", "source", F.col("quality").cast("bigint").alias("quality"),
                         F.col("toxic").cast("bigint").alias("toxic"))


@check(rows("""SELECT count(DISTINCT store) AS store, count(DISTINCT taste) AS taste, count(DISTINCT menu) AS menu,
    count(DISTINCT customer_id) AS customer_id, count(DISTINCT review) AS review, count(DISTINCT reply) AS reply
    FROM blocks""", BLOCKS))
def nunique(spark, sf):
    return stats.nunique(review_blocks(spark, sf), ["store", "taste", "menu", "customer_id", "review", "reply"])


DESCRIBE = """SELECT count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
    round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75,
    max({c})::DOUBLE AS max FROM {t}"""


def _rounded(df):
    return df.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")], "min", "max")


@check(DESCRIBE.format(c="length(text)", t="documents"))
def describe_lengths(spark, sf):
    return _rounded(stats.describe(filters.with_lengths(table(spark, sf, "documents"), {"n": "text"}), "n"))


@check(DESCRIBE.format(c="l_extendedprice", t="lineitem"))
def describe_scores(spark, sf):
    return _rounded(stats.describe(table(spark, sf, "lineitem"), "l_extendedprice"))


@check("""SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "value", 20)


# Bin width: the smaller of range / (log2 n + 1) and 2 * IQR / cbrt n, at least 1 for whole numbers.
@check("""WITH d AS (SELECT n_chars AS x FROM documents),
    s AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi, count(*) AS n,
      quantile_cont(x::DOUBLE, 0.75) - quantile_cont(x::DOUBLE, 0.25) AS iqr FROM d),
    b AS (SELECT *, ceil((hi - lo) / greatest(least((hi - lo) / (log2(n) + 1), 2 * iqr / cbrt(n)), 1)) AS bins FROM s)
    SELECT CAST(least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM d, b GROUP BY 1""")
def histogram_auto(spark, sf):
    lengths = table(spark, sf, "documents").select("n_chars")
    return stats.histogram(lengths, "n_chars", stats.auto_bins(lengths, "n_chars"))


@check("""SELECT round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount,
    round(avg(l_tax), 6) AS l_tax, round((avg(l_extendedprice) + avg(l_discount) + avg(l_tax)) / 3, 6) AS grand_mean
    FROM lineitem""")
def grand_mean(spark, sf):
    cols = ["l_extendedprice", "l_discount", "l_tax"]
    means = stats.grand_mean(stats.mean_scores(table(spark, sf, "lineitem"), cols), cols)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@check(rows("SELECT DISTINCT store FROM pairs", PAIRS))
def distinct_stores(spark, sf):
    return stats.distinct_values(review_pairs(spark, sf), "store")


@check(rows("SELECT count(DISTINCT reply) + max((reply IS NULL)::BIGINT) AS n FROM blocks", BLOCKS))
def count_replies(spark, sf):
    return stats.count_values(review_blocks(spark, sf), "reply")


CHARS = r"[^a-zA-Z0-9가-힣.,<>/?!@~*^ㅠㅜㅎ ]"
CHAR_COUNTS = f"""found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CHARS}', 0)) AS ch FROM documents),
  counts AS (SELECT ch, count(*) AS total, count(DISTINCT doc_id) AS rows FROM found GROUP BY ch)"""


@check(rows("SELECT * FROM counts ORDER BY total DESC, ch LIMIT 50", CHAR_COUNTS))
def char_totals(spark, sf):
    return stats.char_frequency(documents(spark, sf), "text")


@check(rows("SELECT * FROM counts ORDER BY rows DESC, ch LIMIT 50", CHAR_COUNTS))
def char_rows(spark, sf):
    return stats.char_frequency(documents(spark, sf), "text", by="rows")


@check(rows("""SELECT store, replies, CAST(sum(replies) OVER (ORDER BY first) AS BIGINT) AS running FROM (
    SELECT store, min(review_id) AS first, count(reply) AS replies FROM blocks GROUP BY store)""", BLOCKS))
def reply_total(spark, sf):
    return stats.reply_total(review_blocks(spark, sf))


@check("""SELECT user_id, replies, CAST(sum(replies) OVER (ORDER BY first) AS BIGINT) AS running FROM (
    SELECT user_id, min(event_id) AS first, count(CASE WHEN event_type = 'click' THEN 1 END) AS replies
    FROM events GROUP BY user_id)""")
def reply_total_events(spark, sf):
    events = table(spark, sf, "events").withColumn("reply", F.when(F.col("event_type") == "click", 1))
    return stats.reply_total(events, "user_id", "reply", "event_id")


@check(rows("""SELECT 'all' AS stage, count(*) AS rows FROM blocks UNION ALL
    SELECT 'replied', count(*) FROM blocks WHERE reply IS NOT NULL UNION ALL
    SELECT 'review length', count(*) FROM blocks WHERE reply IS NOT NULL AND length(review) BETWEEN 50 AND 300 UNION ALL
    SELECT 'reply length', count(*) FROM blocks WHERE length(review) BETWEEN 50 AND 300
      AND length(reply) BETWEEN 200 AND 1500""", BLOCKS))
def row_count(spark, sf):
    return stats.row_count(review_blocks(spark, sf), {
        "replied": F.col("reply").isNotNull(),
        "review length": filters.in_band(F.col("review"), LIMITS["review"]),
        "reply length": filters.in_band(F.col("reply"), LIMITS["reply"]),
    })


@check(""" SELECT 'l_quantity' AS name, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max FROM lineitem
    UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem""")
def column_extremes(spark, sf):
    return stats.column_extremes(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@check("SELECT doc_id, n_chars FROM documents")
def sort_by_score(spark, sf):
    return ordering.sort_by_score(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@check("""(SELECT 'head' AS side, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 26) UNION ALL
    (SELECT 'tail', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 13)""")
def extremes(spark, sf):
    return ordering.extremes(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 26, 13, "doc_id")


@check("""SELECT source, doc_id, text, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10""")
def preview_per_store(spark, sf):
    shown = ordering.preview_per_store(table(spark, sf, "documents"), 10, "source", "doc_id")
    return shown.select("source", "doc_id", "text", F.col("rank").cast("bigint").alias("rank"))


@check(rows("""SELECT store, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS store_no FROM (
    SELECT store, min(review_id) AS first FROM blocks GROUP BY store)""", BLOCKS))
def store_index(spark, sf):
    return ordering.store_index(review_blocks(spark, sf))


@check("""SELECT l_partkey, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS store_no FROM (
    SELECT l_partkey, min(l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber) AS first
    FROM (SELECT DISTINCT l_partkey, l_orderkey, l_suppkey, l_linenumber FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY l_partkey) = 1)
    GROUP BY l_partkey)""")
def store_index_parts(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("first", F.expr("l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber"))
    unique = lines.groupBy("first").agg(F.min("l_partkey").alias("l_partkey"))
    return ordering.store_index(unique, "l_partkey", "first")


@check("""SELECT doc_id, CAST(pos // (n // 50 + 1) AS BIGINT) AS block FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)""")
def assign_block(spark, sf):
    return ordering.assign_block(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@check(rows("SELECT store, count(*) AS reviews FROM pairs GROUP BY store", PAIRS))
def rank_stores(spark, sf):
    return ordering.rank_stores(review_pairs(spark, sf))


@check(rows("SELECT review_id, review AS text FROM pairs UNION ALL SELECT doc_id, text FROM documents", PAIRS))
def stack_positional(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", "review")
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return sets.stack_positional([pairs, documents], ["review_id", "text"])


@check(rows("""SELECT review_id, store, review, customer_id FROM pairs
    UNION ALL SELECT review_id, store, review, NULL FROM pairs""", PAIRS))
def concat_by_name(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", "store", "review", "customer_id")
    return sets.concat_by_name([pairs, pairs.select("review", "store", "review_id")])


