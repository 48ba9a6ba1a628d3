"""Scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import (
    BLOCKS, PAIRS, VECTORS, conversation_words, review_blocks, review_pairs, rows, scratch, table, word_vectors,
)
from checks.registry import check
from reviewlab.functions.text import strip
from reviewlab.operators.filters import seeded_hash
from reviewlab.sources.markup import Element
from reviewlab.sources.pages import extract_blocks, extract_reviews, extract_stores
from reviewlab.sources.tables import (
    REVIEW_COLUMNS, read_columnar, read_numbered, read_reviews, read_sharded, read_word_vectors, seed_list,
    string_schema, write_columnar, write_reviews, write_word_vectors,
)
from reviewlab.streaming.incremental import (
    add_reply_totals, append_new_keys, latest, new_keys, reply_totals, stream_files, stream_reply_total, update_available,
)

ID_SCHEMA = T.StructType([T.StructField("review_id", T.LongType()), *string_schema(REVIEW_COLUMNS).fields])
ALL_COLUMNS = ", ".join(["review_id", *REVIEW_COLUMNS])


@check(rows(f"SELECT {ALL_COLUMNS} FROM pairs", PAIRS))
def read_reviews_csv(spark, sf):
    path = scratch(spark)
    write_reviews(review_pairs(spark, sf), path)
    return read_reviews(spark, path, ID_SCHEMA)


@check(rows(f"SELECT {ALL_COLUMNS} FROM blocks", BLOCKS))
def read_sharded_csv(spark, sf):
    folder = scratch(spark)
    blocks = review_blocks(spark, sf)
    write_reviews(blocks.where(F.col("reply").isNull()), f"{folder}/total_0.csv")
    write_reviews(blocks.where(F.col("reply").isNotNull()), f"{folder}/total_1.csv")
    write_reviews(blocks, f"{folder}/other.csv")
    return read_sharded(spark, folder, "total", ID_SCHEMA)


@check(rows("SELECT review_id, store, review, CAST(review_id % 3 AS INT)::BIGINT AS shard FROM pairs", PAIRS))
def read_numbered_csv(spark, sf):
    folder = scratch(spark)
    pairs = review_pairs(spark, sf)
    for i in range(3):
        write_reviews(pairs.where(F.col("review_id") % 3 == i), f"{folder}/review_data{i}.csv")
    return read_numbered(spark, folder, 3, ID_SCHEMA).select(
        "review_id", "store", "review", F.col("shard").cast("bigint").alias("shard"))


@check("SELECT doc_id, text, lang, source, n_chars FROM documents")
def write_reviews_csv(spark, sf):
    path = scratch(spark)
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    write_reviews(documents, path)
    return read_reviews(spark, path, documents.schema)


HASH = "substr(md5(concat('42:', CAST(doc_id AS STRING))), 1, 1)"


@check(f"SELECT doc_id, text, 'train' AS split FROM documents WHERE {HASH} < 'a'")
def columnar_round_trip(spark, sf):
    path = scratch(spark)
    part = F.when(F.substring(seeded_hash(F.col("doc_id"), 42), 1, 1) < "a", "train").otherwise("test")
    write_columnar(table(spark, sf, "documents").select("doc_id", "text", part.alias("split")), path)
    return read_columnar(spark, path, "train")


@check("""SELECT page_id, lang, title, CAST(i - 1 AS BIGINT) AS "at", urls[i] AS url, names[i] AS label FROM (
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
      replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title,
      regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS urls,
      list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x:
        replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
          '&amp;', '&')) AS names,
      unnest(range(1, len(urls) + 1)) AS i FROM pages)""")
def extract_page_blocks(spark, sf):
    page_fields = {"lang": Element("html", take="lang"), "title": Element("title")}
    fields = {"url": Element("a", take="href"), "label": Element("a")}
    found = extract_blocks(table(spark, sf, "pages"), Element("li"), fields, page_fields)
    return found.withColumn("at", F.col("at").cast("bigint"))


def escaped(col):
    """Text as a page holds it: named, decimal and hexadecimal references."""
    for char, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ("'", "&#x27;"), ('"', "&quot;")]:
        col = F.replace(col, F.lit(char), F.lit(name))
    return col


def shown(tag, attrs, text):
    return F.when(text.isNotNull(), F.concat(F.lit(f"<{tag} {attrs}>"), escaped(text), F.lit(f"</{tag}>"))).otherwise("")


def page_of_reviews(df):
    """A review page per conversation: quotes of both kinds, lists within blocks, closing tags left out."""
    stars = [shown("span", f"class='points ng-binding' ng-show=\"review.rating_{c} > 0\"", F.col(c)) for c in ("taste", "quantity", "delivery")]
    block = F.concat(
        F.lit("<li ng-repeat='review in restaurant.reviews' class=\"list-group-item star-point ng-scope\"><ul><li>inner"
              "<li class=x title='a > b'>list</ul><!-- <li> --><br>"),
        shown("span", 'ng-show="review.phone" class="review-id ng-binding"', F.col("customer_id")), *stars,
        shown("div", "data-x='>' class='order-items default ng-binding'", F.col("menu")),
        shown("p", 'class="ng-binding" ng-show="review.comment"', F.col("review")),
        shown("p", "ng-bind-html='review.owner_reply.comment|strip_html' class='ng-binding'", F.concat(F.lit("\n "), "reply", F.lit(" "))),
        # A reply of the site stands outside of the block: what a cut at the next block would take in.
        F.lit('</li><li><p class="ng-binding" ng-bind-html="review.owner_reply.comment|strip_html">of the site</p>'))
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("review_id", block.alias("b")))), lambda x: x["b"]), "")
    name = F.concat(F.lit("<html><script>'<li>'</script><span class='restaurant-name ng-binding'>"), escaped(F.any_value("store")), F.lit("</span><ul>"))
    return df.groupBy(F.floor(F.col("review_id") / 100).alias("page_id")).agg(F.concat(name, blocks, F.lit("</ul></html>")).alias("html"))


@check(rows("""SELECT review_id // 100 AS page_id, store, coalesce(taste, '별점X') AS taste, coalesce(quantity, '별점X') AS quantity,
    coalesce(delivery, '별점X') AS delivery, coalesce(menu, '메뉴X') AS menu, customer_id, review, reply,
    row_number() OVER (PARTITION BY review_id // 100 ORDER BY review_id) AS place FROM
    (SELECT * REPLACE (regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS reply) FROM blocks) WHERE reply IS NOT NULL""", BLOCKS))
def extract_review_pages(spark, sf):
    found = extract_reviews(page_of_reviews(review_blocks(spark, sf)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("bigint")
    return found.select("page_id", "store", "taste", "quantity", "delivery", "menu", "customer_id", "review", "reply", place.alias("place"))


@check(rows("""SELECT conv_id // 20 AS page_id, CAST(row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id) - 1 AS BIGINT) AS "at",
    'Shop <' || conv_id || '> & "Co"' AS store FROM (SELECT DISTINCT conv_id FROM conversations)"""))
def extract_listing_pages(spark, sf):
    name = F.concat(F.lit("Shop <"), "conv_id", F.lit('> & "Co"'))
    entry = F.concat(F.lit("<div><div data-x='<div>' class='restaurant-name ng-binding'>"), escaped(name), F.lit("</div>9 reviews</div>"))
    stores = table(spark, sf, "conversations").select("conv_id", entry.alias("entry")).distinct()
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "entry"))), lambda x: x["entry"]), "<hr>")
    found = extract_stores(stores.groupBy(F.floor(F.col("conv_id") / 20).alias("page_id")).agg(listed.alias("html")))
    return found.withColumn("at", F.col("at").cast("bigint"))


@check("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links,
    trim(regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1)) AS heading FROM pages""")
def extract_page_fields(spark, sf):
    heading = F.regexp_extract("html", "(?s)<h1>([^<]*)</h1>", 1)
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    return table(spark, sf, "pages").select("page_id", links.cast("bigint").alias("links"), strip(heading).alias("heading"))


@check(rows("""SELECT word, CAST(len(vec) AS BIGINT) AS size, round(vec[1]::DOUBLE, 6) AS first,
    round(list_sum(vec::DOUBLE[]), 6) AS total FROM vectors""", VECTORS))
def read_word_vector_text(spark, sf):
    path = scratch(spark)
    write_word_vectors(word_vectors(spark, sf), path)
    vec = F.col("vec").cast("array<double>")
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)
    return read_word_vectors(spark, path).select(
        "word", F.size("vec").cast("bigint").alias("size"), F.round(vec[0], 6).alias("first"),
        F.round(total, 6).alias("total"))


SEEDS = ["Cafe3-Branch0", "Cafe5-Branch1", "Cafe18-Branch2", "Cafe99-Branch0"]


@check(rows(f"""SELECT "at"::BIGINT AS "at", seed, count(review_id) AS reviews
    FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SEEDS))}) s("at", seed)
    LEFT JOIN pairs ON store = seed GROUP BY ALL""", PAIRS))
def seed_list_jobs(spark, sf):
    reviews = review_pairs(spark, sf).groupBy(F.col("store").alias("seed")).agg(F.count("*").alias("n"))
    joined = seed_list(spark, SEEDS).join(reviews, "seed", "left")
    return joined.select("at", "seed", F.coalesce("n", F.lit(0)).alias("reviews"))


EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType())])


def event_batches(spark, sf):
    """The events in order of their ids, in five micro-batches."""
    folder = scratch(spark)
    table(spark, sf, "events").repartitionByRange(5, "event_id").write.parquet(folder)
    return stream_files(spark, folder, EVENTS, files_per_batch=1)


@check("""SELECT DISTINCT user_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)""")
def stream_new_users(spark, sf):
    path = scratch(spark)
    seen = table(spark, sf, "events").where("event_type = 'signup' AND value > 90")
    append_new_keys(event_batches(spark, sf), "user_id", path, f"{path}-state", seen, every=2)
    return new_keys(spark, path, "user_id")


@check("""SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS replies FROM events GROUP BY user_id""")
def stream_reply_totals(spark, sf):
    path = scratch(spark)
    replied = event_batches(spark, sf).withColumn("reply", F.when(F.col("event_type") == "purchase", 1))
    update_available(stream_reply_total(replied, "user_id", "reply"), path, f"{path}-state", "user_id", "replies", every=2)
    return latest(spark, path, "user_id", "replies")


@check("""SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS replies FROM events GROUP BY user_id""")
def stream_added_totals(spark, sf):
    path = scratch(spark)
    replied = event_batches(spark, sf).withColumn("reply", F.when(F.col("event_type") == "purchase", 1))
    add_reply_totals(replied, "user_id", "reply", path, f"{path}-state", every=2)
    return reply_totals(spark, path, "user_id")


@check(rows("SELECT word, length(word)::BIGINT AS letters FROM vocabulary", VECTORS))
def vocabulary_of_conversations(spark, sf):
    return conversation_words(spark, sf).select("word", F.length("word").cast("bigint").alias("letters"))
