"""Cleaning, masking, templating and tokenising of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    PAIRS, SPACE, TOKEN, documents, gazetteer, review_pairs, rows, strip_sql, table, words_sql,
)
from checks.registry import check
from reviewlab import values as v
from reviewlab.functions import masking, text
from reviewlab.operators import sets
from reviewlab.operators.masking import find_entities, mask_entities
from reviewlab.plans import jobs

SPACES = rf"{SPACE}{{2,}}"


@check(rows(f"""SELECT review_id, regexp_replace(menu, '{SPACES}', chr(10), 'g') AS menu,
    regexp_replace(reply, '{SPACES}', chr(10), 'g') AS reply FROM pairs""", PAIRS))
def collapse_space(spark, sf):
    return review_pairs(spark, sf).select("review_id", text.collapse_space(F.col("menu")).alias("menu"),
                                          text.collapse_space(F.col("reply")).alias("reply"))


@check(rf"""SELECT doc_id, regexp_replace(text, '[\t\n\x0b\f\r\x1c-\x20\x85\p{{Z}}\\n]{{2,}}', chr(10), 'g') AS text
    FROM documents""")
def collapse_space_compat(spark, sf):
    return documents(spark, sf).select("doc_id", text.collapse_space(F.col("text"), compat=True).alias("text"))


CUSTOMER_SQL = """CASE WHEN customer_id = '   손님'
    THEN regexp_replace({0}, '[ㄱ-ㅎ가-힣\\p{{L}}\\p{{N}}_]+(\\*\\*)* *(님|고객님)', '#@고객이름#', 'g')
    ELSE regexp_replace({0}, concat(regexp_escape(customer_id), '|', regexp_escape(left(customer_id, -1)), '|',
      regexp_escape(left(customer_id, -2))), '#@고객이름#', 'g') END"""
STORE_SQL = """regexp_replace(replace(replace(replace(replace({0}, store, '#@상호명#'), replace(store, '-', ' '), '#@상호명#'),
    split_part(store, '-', 1), '#@상호명#'), split_part(store, '-', 2), '#@상호명#'), '(#@상호명#){{2,}}', '#@상호명#', 'g')"""


@check(rows(f"SELECT review_id, {CUSTOMER_SQL.format('reply')} AS reply FROM pairs", PAIRS))
def mask_customer(spark, sf):
    masked = masking.mask_customer(F.col("reply"), F.col("customer_id"))
    return review_pairs(spark, sf).select("review_id", masked.alias("reply"))


@check(rows(f"SELECT review_id, {STORE_SQL.format('reply')} AS reply FROM pairs", PAIRS))
def mask_store(spark, sf):
    return review_pairs(spark, sf).select("review_id", masking.mask_store(F.col("reply"), F.col("store")).alias("reply"))


ENTITIES = "regexp_replace(regexp_replace({0}, 'mail', '#@기관#', 'g'), 'Branch0|Branch1|Branch2', '#@위치#', 'g')"


@check(rows(f"SELECT review_id, {ENTITIES.format('reply')} AS reply FROM pairs", PAIRS))
def mask_entities_substring(spark, sf):
    return mask_entities(review_pairs(spark, sf), "reply", gazetteer(spark)).select("review_id", "reply")


# A gazetteer that grows with the data: domain words of the pages' links, by length.
GAZETTEER = rf"""gaz AS (SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'LOCATION' ELSE 'ORGANIZATION' END AS type FROM (
    SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="/([\p{{L}}]{{7,}})"', 1)) AS term FROM pages)),
  spans AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS term FROM documents),
  found AS (SELECT doc_id, term AS word, type FROM spans JOIN gaz USING (term))"""


def page_gazetteer(spark, sf):
    links = F.regexp_extract_all("html", F.lit(r'<a href="/([\p{L}]{7,})"'), 1)
    terms = table(spark, sf, "pages").select(F.explode(links).alias("term")).distinct()
    kind = F.when(F.length("term") % 2 == 0, "LOCATION").otherwise("ORGANIZATION")
    return terms.withColumn("type", kind)


@check(rows("SELECT doc_id, word, type FROM found", GAZETTEER))
def distinct_entities(spark, sf):
    found = find_entities(documents(spark, sf), "text", page_gazetteer(spark, sf), "doc_id")
    return sets.distinct_entities(found, "doc_id")


# Terms of a text are replaced one by one, longest first; none of them holds another one's mask.
MASKED = """ordered AS (SELECT doc_id, type, list(word ORDER BY length(word) DESC, word) AS words FROM found GROUP BY ALL),
  masked AS (SELECT d.doc_id, text, coalesce(o.words, []) AS orgs, coalesce(l.words, []) AS places FROM documents d
    LEFT JOIN ordered o ON o.doc_id = d.doc_id AND o.type = 'ORGANIZATION'
    LEFT JOIN ordered l ON l.doc_id = d.doc_id AND l.type = 'LOCATION'),
  once AS (SELECT doc_id, places, CASE WHEN len(orgs) = 0 THEN text
    ELSE regexp_replace(text, array_to_string(orgs, '|'), '#@기관#', 'g') END AS text FROM masked)"""


@check(rows("""SELECT doc_id, CASE WHEN len(places) = 0 THEN text
    ELSE regexp_replace(text, array_to_string(places, '|'), '#@위치#', 'g') END AS text FROM once""", GAZETTEER, MASKED))
def mask_entities_token(spark, sf):
    texts = documents(spark, sf).select("doc_id", "text")
    return mask_entities(texts, "text", page_gazetteer(spark, sf), "token", "doc_id")


TERMS = ["the", "und", "les", "le", "(x)"]


@check("SELECT doc_id, regexp_replace(text, 'the|und|les|le|\\(x\\)', '#@상호명#', 'g') AS text FROM documents")
def mask_terms(spark, sf):
    return documents(spark, sf).select("doc_id", masking.mask_terms(F.col("text"), TERMS, v.STORE).alias("text"))


HANDLES = "regexp_replace({0}, '@[a-zA-Z0-9_]+', '#@전화번호#', 'g')"
PHONES = r"regexp_replace({0}, '(2\.[\p{{L}}\p{{N}}_.]+)|(010-[\p{{L}}\p{{N}}_-]+)', '#@전화번호#', 'g')"
ADDRESSES = r"regexp_replace({0}, '[\p{{L}}\p{{N}}_/:.@]+.com[\p{{L}}\p{{N}}_/.]*', '#@전화번호#', 'g')"


@check(f"SELECT doc_id, {HANDLES.format('text')} AS text FROM documents")
def mask_handles(spark, sf):
    return documents(spark, sf).select("doc_id", masking.mask_handles(F.col("text")).alias("text"))


@check(f"SELECT doc_id, {PHONES.format('text')} AS text FROM documents")
def mask_phones(spark, sf):
    return documents(spark, sf).select("doc_id", masking.mask_phones(F.col("text")).alias("text"))


@check(f"SELECT doc_id, {ADDRESSES.format('text')} AS text FROM documents")
def mask_urls_emails(spark, sf):
    return documents(spark, sf).select("doc_id", masking.mask_urls_emails(F.col("text")).alias("text"))


@check("SELECT doc_id, replace(text, 'the ', '') AS text FROM documents")
def remove_literal(spark, sf):
    return documents(spark, sf).select("doc_id", text.remove_literal(F.col("text"), "the ").alias("text"))


@check(f"SELECT doc_id, replace({strip_sql('text')}, chr(10), '') AS text FROM documents")
def strip_and_flatten(spark, sf):
    return documents(spark, sf).select("doc_id", text.strip_and_flatten(F.col("text")).alias("text"))


MASKED_REPLY = f"masked AS (SELECT *, {CUSTOMER_SQL.format('reply')} AS r1 FROM pairs), named AS (SELECT *, {STORE_SQL.format('r1')} AS r2 FROM masked)"


@check(rows("""SELECT review_id, replace(replace(replace(replace(replace(replace(replace(
    concat(r2, '#@위치#<unk></s>[a-zA-Z]+'), '[a-zA-Z]+', ''), '#@상호명#', store), '#@고객이름#', customer_id),
    '#@위치#', ''), '<unk>', ''), '</s>', ''), chr(10), ' ') AS reply FROM named""", PAIRS, MASKED_REPLY))
def unmask_reply(spark, sf):
    masked = masking.mask_store(masking.mask_customer(F.col("reply"), F.col("customer_id")), F.col("store"))
    marked = F.concat(masked, F.lit("#@위치#<unk></s>[a-zA-Z]+"))
    return review_pairs(spark, sf).select(
        "review_id", masking.unmask_reply(marked, F.col("store"), F.col("customer_id")).alias("reply"))


@check(f"""SELECT doc_id, {strip_sql("text")} AS marked, {strip_sql("replace(text, '<unk>', '')")} AS plain
    FROM documents""")
def clean_decoded(spark, sf):
    decoded = F.concat(F.lit("a <unused1> b <unused1> "), F.col("text"), F.lit(" <eos> c"))
    special = F.concat(F.lit("</s> "), F.col("text"), F.lit("<unk></s>"))
    return documents(spark, sf).select(
        "doc_id", text.clean_decoded(decoded).alias("marked"), text.clean_decoded(special, "plain").alias("plain"))


@check(rows("""SELECT review_id, concat('맛:', taste, ' 양:', quantity, ' 배달:', delivery, ' 리뷰:', review) AS tight,
    concat('맛: ', taste, ' 양: ', quantity, ' 배달:', delivery, ' 리뷰:', review) AS spaced,
    concat('리뷰: ', review) AS short, concat('맛:5 양:5 배달:5 리뷰:', review) AS constant FROM (
      SELECT review_id, coalesce(taste, '별점X') AS taste, coalesce(quantity, '별점X') AS quantity,
        coalesce(delivery, '별점X') AS delivery, review FROM pairs)""", PAIRS))
def build_prompt(spark, sf):
    from reviewlab.operators.filters import fill_missing

    cols = [F.col(c) for c in ("taste", "quantity", "delivery", "review")]
    return fill_missing(review_pairs(spark, sf)).select(
        "review_id", *[text.build_prompt(*cols, style=s).alias(s) for s in ("tight", "spaced", "short", "constant")])


@check(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9][0-9.-]+', 0), '|') AS found FROM documents")
def regex_extract(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(text.regex_extract(F.col("text"), "[0-9][0-9.-]+"), "|").alias("found"))




@check(f"SELECT doc_id, {strip_sql('n')} AS text FROM (SELECT doc_id, "
       "regexp_replace(lower(text), '[^A-Za-z0-9가-힣]', ' ', 'g') AS n FROM documents)")
def normalise_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.normalise_text(F.col("text")).alias("text"))


@check(f"SELECT doc_id, array_to_string(list_slice({words_sql('text')}, 1, 100), ' ') AS text FROM documents")
def truncate_words(spark, sf):
    return documents(spark, sf).select("doc_id", text.truncate_text(F.col("text"), 100).alias("text"))


# Lines with the size of all earlier lines; a line is reached while that stays below the limit.
def lines_sql(size: str, limit: int) -> str:
    return f"""lines AS (SELECT doc_id, {strip_sql('line')} AS line, i FROM (
      SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    sized AS (SELECT *, {size} AS n FROM lines),
    placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS used FROM sized),
    reached AS (SELECT *, coalesce(max((used + n >= {limit})::INT) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM placed)"""


@check(rows("""SELECT doc_id, coalesce(string_agg(CASE WHEN used + n < 500 THEN concat(CASE WHEN used > 0 THEN ' ' ELSE '' END, line)
    ELSE concat(CASE WHEN used > 0 THEN ' ' ELSE '' END, left(line, CAST(500 - used AS BIGINT))) END, '' ORDER BY i), '') AS text
    FROM reached WHERE past = 0 GROUP BY doc_id""", lines_sql("length(line)", 500)))
def truncate_characters(spark, sf):
    return documents(spark, sf).select("doc_id", text.truncate_text(F.col("text"), 500, "chars").alias("text"))


@check(rows("""SELECT doc_id, string_agg(left(line, CAST(least(500 - used, n) AS BIGINT)), chr(10) ORDER BY i) AS text
    FROM reached WHERE past = 0 GROUP BY doc_id""", lines_sql("length(line)", 500)))
def truncate_sentence_characters(spark, sf):
    cut = text.truncate_sentences(F.col("text"), 500, "chars")
    return documents(spark, sf).select("doc_id", F.array_join(cut, "\n").alias("text"))


@check(rows(f"""SELECT doc_id, string_agg(array_to_string(list_slice({words_sql('line')}, 1, CAST(least(100 - used, n) AS BIGINT)), ' '),
    chr(10) ORDER BY i) AS text FROM reached WHERE past = 0 GROUP BY doc_id""", lines_sql(f"len({words_sql('line')})", 100)))
def truncate_sentence_words(spark, sf):
    cut = text.truncate_sentences(F.col("text"), 100)
    return documents(spark, sf).select("doc_id", F.array_join(cut, "\n").alias("text"))


@check(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{TOKEN}', 1), ' ') AS tokens FROM documents")
def tokenise(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.tokenise(F.col("text")), " ").alias("tokens"))


@check(rows(f"""SELECT review_id, regexp_replace(menu, '{SPACES}', chr(10), 'g') AS menu,
    regexp_replace(review, '{SPACES}', chr(10), 'g') AS review, {ENTITIES.format('r2')} AS reply FROM named""",
            PAIRS, f"spaced AS (SELECT * REPLACE (regexp_replace(reply, '{SPACES}', chr(10), 'g') AS reply) FROM pairs)",
            MASKED_REPLY.replace("FROM pairs", "FROM spaced")))
def preprocess_reviews(spark, sf):
    done = jobs.preprocess_reviews(review_pairs(spark, sf), gazetteer(spark))
    return done.select("review_id", "menu", "review", "reply")


@check(f"""SELECT doc_id, {ADDRESSES.format(PHONES.format(HANDLES.format(
    "regexp_replace(regexp_replace(regexp_replace(text, 'the|und', '#@상호명#', 'g'), 'les|le', '#@위치#', 'g'), 'ing', '#@기관#', 'g')")))}
    AS text FROM documents""")
def additional_masking(spark, sf):
    masked = jobs.additional_masking(F.col("text"), ["the", "und"], ["les", "le"], ["ing"], ["하늘을달리다"])
    return documents(spark, sf).select("doc_id", masked.alias("text"))


@check(rows(f"SELECT review_id, {ADDRESSES.format(PHONES.format(HANDLES.format('reply')))} AS reply FROM pairs", PAIRS))
def additional_masking_default_lists(spark, sf):
    # The given texts hold none of the listed Korean names, so the contact masks remain.
    return review_pairs(spark, sf).select("review_id", jobs.additional_masking(F.col("reply")).alias("reply"))
