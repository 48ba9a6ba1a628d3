"""Training examples, splits and candidate filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import PAIRS, VECTORS, conversation_words, review_pairs, rows, table, tokens_sql
from checks.registry import check
from reviewlab import values as v
from reviewlab.functions import tokens as ids
from reviewlab.functions.text import tokenise
from reviewlab.operators import candidates, examples
from reviewlab.operators.filters import fill_missing
from reviewlab.operators.models import encode_texts

# Reserved ids, followed by the words of the conversations in their order.
PAD, BOS, EOS, UNK, MARK = 0, 1, 2, 3, 4
FIRST = 10
N = 48
VOCAB = f"""vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY encode(word)) + {FIRST - 1} AS INT) AS id FROM vocabulary),
  replies AS (SELECT review_id, review, coalesce(taste, '별점X') AS taste, coalesce(quantity, '별점X') AS quantity,
    coalesce(delivery, '별점X') AS delivery, reply FROM pairs)"""


def coded_sql(col: str, out: str) -> str:
    """CTE ``out`` (review_id, ids) of the token ids of a text column."""
    return f"""{out} AS (SELECT review_id, list(coalesce(id, {UNK}) ORDER BY pos) AS ids FROM (
      SELECT review_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM (
        SELECT review_id, {tokens_sql(col)} AS words FROM replies)) LEFT JOIN vocab USING (word) GROUP BY review_id)"""


CODED = ", ".join([VOCAB, coded_sql("review", "cr"), coded_sql("reply", "cp"), coded_sql("taste", "ct"),
                   coded_sql("quantity", "cq"), coded_sql("delivery", "cd"),
                   """coded AS (SELECT review_id, cr.ids AS a, cp.ids AS b, ct.ids AS t, cq.ids AS q, cd.ids AS d FROM cr
                      JOIN cp USING (review_id) JOIN ct USING (review_id) JOIN cq USING (review_id) JOIN cd USING (review_id))"""])


def text_sql(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def repeat_sql(value: str | int, times: str) -> str:
    return f"list_resize([]::INT[], greatest({times}, 0), {value}::INT)"


def pad_sql(expr: str, fill: int) -> str:
    return f"list_slice(list_concat({expr}, {repeat_sql(fill, str(N))}), 1, {N})"


def vocabulary(spark, sf):
    return examples.build_vocab(conversation_words(spark, sf), first_id=FIRST)


def coded(spark, sf):
    pairs = fill_missing(review_pairs(spark, sf))
    cols = {"a": "review", "b": "reply", "t": "taste", "q": "quantity", "d": "delivery"}
    tokens = pairs.select("review_id", *[tokenise(F.col(text)).alias(f"_{c}") for c, text in cols.items()])
    return examples.encode_tokens(tokens, vocabulary(spark, sf), {c: f"_{c}" for c in cols}, UNK)


def joined(*cols):
    return [F.array_join(F.col(c), " ").alias(c.split(".")[-1]) for c in cols]


@check(rows("SELECT word, id::BIGINT AS id FROM vocab", PAIRS, VECTORS, VOCAB))
def build_vocab(spark, sf):
    return vocabulary(spark, sf).select("word", F.col("id").cast("bigint").alias("id"))


MASKS = ", ".join(f"('{m}', {i})" for i, m in enumerate(v.MASK_TOKENS, 1))


@check(rows(f"""SELECT word, id::BIGINT AS id FROM vocab UNION ALL
    SELECT m, ((SELECT max(id) FROM vocab) + i)::BIGINT FROM (VALUES {MASKS}) t(m, i)""", PAIRS, VECTORS, VOCAB))
def extend_vocab(spark, sf):
    return examples.extend_vocab(vocabulary(spark, sf)).select("word", F.col("id").cast("bigint").alias("id"))


@check(rows(f"SELECT review_id, {text_sql('a')} AS a, {text_sql('b')} AS b, {text_sql('t')} AS t FROM coded", PAIRS, VECTORS, CODED))
def encode_tokens(spark, sf):
    return coded(spark, sf).select("review_id", *joined("a", "b", "t"))


@check(rows(f"SELECT review_id, {text_sql(pad_sql('a', PAD))} AS ids FROM coded", PAIRS, VECTORS, CODED))
def pad_or_cut(spark, sf):
    padded = coded(spark, sf).select("review_id", ids.pad_or_cut(F.col("a"), N, PAD).alias("ids"))
    return padded.select("review_id", *joined("ids"))


def _seq2seq(mode, fill):
    sql = rows(f"""SELECT review_id, {text_sql(pad_sql('a', PAD))} AS input_ids,
        {text_sql(pad_sql(f'list_concat([{EOS}], b)', PAD))} AS decoder_input_ids,
        {text_sql(pad_sql(f'list_concat(b, [{EOS}])', fill))} AS labels FROM coded""", PAIRS, VECTORS, CODED)

    @check(sql, f"seq2seq_example_{mode}")
    def query(spark, sf):
        made = coded(spark, sf).select("review_id", ids.seq2seq_example(F.col("a"), F.col("b"), N, EOS, PAD, mode).alias("e"))
        return made.select("review_id", *joined("e.input_ids", "e.decoder_input_ids", "e.labels"))


_seq2seq("train", ids.IGNORED)
_seq2seq("test", PAD)

# Article: begin id, then the review; a rated article names each rating by a heading id.
HEADINGS = [[5], [6], [7], [8]]
PLAIN = f"list_concat([{BOS}], a)"
RATED = f"list_concat(list_concat(list_concat([{BOS}, 5], t), list_concat([6], q)), list_concat(list_concat([7], d), list_concat([8], a)))"
PROMPTED = f"list_concat([{BOS}, 9, 9, 9], a)"


def causal_sql(article: str, variant: str, n: int = 160) -> str:
    made = f"""art AS (SELECT review_id, {article} AS art, list_concat([{MARK}], list_concat(b, [{EOS}])) AS summ FROM coded),
      cut AS (SELECT *, greatest(len(art) - greatest(len(art) + len(summ) - {n}, 0), 0) AS keep FROM art)"""
    labels = {
        "reply": f"list_concat(summ, {repeat_sql(PAD, f'{n} - len(summ)')})",
        "aligned": f"list_concat(list_concat({repeat_sql(-100, 'keep')}, list_slice(summ, 2, len(summ))), "
                   f"{repeat_sql(-100, f'{n} - keep - len(summ) + 1')})",
    }[variant]
    return rows(f"""SELECT review_id,
      {text_sql(f"list_concat(list_concat(list_slice(art, 1, keep), summ), {repeat_sql(PAD, f'{n} - keep - len(summ)')})")} AS input_ids,
      {text_sql(f"list_concat(list_concat({repeat_sql(0, 'keep')}, {repeat_sql(1, 'len(summ)')}), {repeat_sql(0, f'{n} - keep - len(summ)')})")}
        AS attention_mask,
      {text_sql(labels)} AS labels, len(summ) > {n} AS too_long FROM cut""", PAIRS, VECTORS, CODED, made)


def _causal(spark, sf, article, variant):
    made = coded(spark, sf).select("review_id", ids.causal_example(
        article, F.col("b"), 160, MARK, EOS, PAD, variant).alias("e"))
    return made.select("review_id", *joined("e.input_ids", "e.attention_mask", "e.labels"), "e.too_long")


@check(causal_sql(PLAIN, "reply"))
def causal_example_reply(spark, sf):
    return _causal(spark, sf, F.concat(F.array(F.lit(BOS)), F.col("a")), "reply")


@check(causal_sql(RATED, "aligned"))
def causal_example_rated(spark, sf):
    article = ids.rated_prefix(BOS, F.col("t"), F.col("q"), F.col("d"), F.col("a"), HEADINGS)
    return _causal(spark, sf, article, "aligned")


@check(causal_sql(PROMPTED, "aligned"))
def causal_example_prompted(spark, sf):
    return _causal(spark, sf, ids.prompt_prefix(BOS, 9, 3, F.col("a")), "aligned")


@check(rows(f"""SELECT review_id, {text_sql('list_slice(a, 1, 20)')} AS input_ids,
    {text_sql(repeat_sql(1, 'least(len(a), 20)'))} AS attention_mask, {text_sql('list_slice(b, 1, 30)')} AS labels
    FROM coded""", PAIRS, VECTORS, CODED))
def truncated_example(spark, sf):
    made = coded(spark, sf).select("review_id", ids.truncated_example(F.col("a"), F.col("b"), 20, 30).alias("e"))
    return made.select("review_id", *joined("e.input_ids", "e.attention_mask", "e.labels"))


@check(rows(f"""SELECT review_id, {text_sql("list_concat(list_slice(a, 1, keep_a), list_slice(c, 1, keep_c))")} AS input_ids
    FROM (SELECT review_id, a, c,
        CASE WHEN la + lc <= {N} THEN la WHEN la <= lc THEN least(la, {N // 2}) ELSE greatest({N} - lc, {N - N // 2}) END AS keep_a,
        CASE WHEN la + lc <= {N} THEN lc WHEN la <= lc THEN greatest({N} - la, {N - N // 2}) ELSE least(lc, {N // 2}) END AS keep_c
      FROM (SELECT review_id, a, list_concat([5, 6], b) AS c, len(a) AS la, len(b) + 2 AS lc FROM coded))""", PAIRS, VECTORS, CODED))
def pair_example(spark, sf):
    made = coded(spark, sf).select("review_id", ids.pair_example(F.col("a"), F.col("b"), [5, 6], N).alias("e"))
    return made.select("review_id", *joined("e.input_ids"))


@check(rows(f"""SELECT review_id, {text_sql(pad_sql(f'list_concat(list_concat([{BOS}], b), [{EOS}])', PAD))} AS input_ids,
    {text_sql(pad_sql(repeat_sql(1, 'len(b) + 2'), 0))} AS attention_mask FROM coded""", PAIRS, VECTORS, CODED))
def lm_example(spark, sf):
    made = coded(spark, sf).select("review_id", ids.lm_example(F.col("b"), N, BOS, EOS, PAD).alias("e"))
    return made.select("review_id", *joined("e.input_ids", "e.attention_mask"))


@check(rows(f"""SELECT review_id, {text_sql(pad_sql(repeat_sql(1, 'len(a)'), 0))} AS attention,
    {text_sql(pad_sql(f'list_concat(b, [{EOS}])', PAD))} AS restored FROM coded""", PAIRS, VECTORS, CODED))
def attention_and_restored_labels(spark, sf):
    made = coded(spark, sf).select("review_id", ids.seq2seq_example(F.col("a"), F.col("b"), N, EOS, PAD).alias("e"))
    seen = made.select("review_id", ids.attention_mask(F.col("e.input_ids"), PAD).alias("attention"),
                       ids.restore_ignored(F.col("e.labels"), PAD).alias("restored"))
    return seen.select("review_id", *joined("attention", "restored"))


def letter_codes():
    """Code points modulo 1000 as ids: stands in for a sub-word tokenizer."""
    def encode(texts):
        return [[ord(c) % 1000 for c in t] for t in texts]

    return encode


@check(rows("""SELECT review_id, array_to_string(list_transform(string_split(review, ''), lambda c: unicode(c) % 1000), ' ') AS a,
    array_to_string(list_transform(string_split(reply, ''), lambda c: unicode(c) % 1000), ' ') AS b FROM pairs""", PAIRS))
def encode_subwords_model(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", "review", "reply")
    made = encode_texts(pairs, {"a": "review", "b": "reply"}, letter_codes, "array<int>")
    return made.select("review_id", *joined("a", "b"))


HASH = "md5(concat('42:', CAST(doc_id AS STRING)))"


@check(f"""SELECT doc_id, CASE WHEN substr({HASH}, 1, 8) < '33333333' THEN 'test'
    WHEN substr({HASH}, 1, 8) < '66666666' THEN 'val' ELSE 'train' END AS split FROM documents""")
def split_by_hash(spark, sf):
    return examples.split_train_test_val(table(spark, sf, "documents").select("doc_id"), row_id="doc_id")


@check(f"""SELECT doc_id, CASE WHEN pos < ceil(n * 0.2) THEN 'test' WHEN pos < ceil(n * 0.2) + ceil(n * 0.2) THEN 'val'
    ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) - 1 AS pos,
      count(*) OVER () AS n FROM documents)""")
def split_exact(spark, sf):
    return examples.split_train_test_val(table(spark, sf, "documents").select("doc_id"), row_id="doc_id", exact=True)


# ----------------------------------------------------------------- candidates

def nucleus_sql(top_k: int, top_p: float, temperature: float) -> str:
    return f"""scaled AS (SELECT user_id AS grp, event_id AS token, value / {temperature}::DOUBLE AS s FROM events),
      ranked AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY s DESC) AS k FROM scaled),
      topped AS (SELECT * FROM ranked WHERE {top_k} = 0 OR k <= {top_k}),
      weighed AS (SELECT *, exp(s - max(s) OVER (PARTITION BY grp)) AS w FROM topped),
      shares AS (SELECT *, w / sum(w) OVER (PARTITION BY grp) AS p FROM weighed),
      summed AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY grp ORDER BY s DESC, token ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS before FROM shares),
      kept AS (SELECT grp, token, p / sum(p) OVER (PARTITION BY grp) AS prob FROM summed
        WHERE {top_p} = 0 OR before <= {top_p})"""


def _candidates(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("token"),
                                             F.col("value").alias("score"))


def _nucleus(name, top_k, top_p, temperature):
    @check(rows("SELECT grp, token, round(prob, 6) AS prob FROM kept", nucleus_sql(top_k, top_p, temperature)), name)
    def query(spark, sf):
        kept = candidates.nucleus_filter(_candidates(spark, sf), top_k=top_k, top_p=top_p, temperature=temperature)
        return kept.select("grp", "token", F.round("prob", 6).alias("prob"))


_nucleus("nucleus_filter", 0, 0.9, 10.0)
_nucleus("top_k_filter", 5, 0.0, 10.0)
_nucleus("top_k_nucleus_filter", 12, 0.8, 20.0)


@check(rows("""SELECT grp, arg_max(token, ln(prob) - ln(-ln(u))) AS token FROM (SELECT grp, token, prob,
    (CAST('0x' || substr(md5(concat('3:', grp, '|', token)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM kept) GROUP BY grp""",
            nucleus_sql(0, 0.9, 10.0)))
def sample_candidate(spark, sf):
    kept = candidates.nucleus_filter(_candidates(spark, sf), top_p=0.9, temperature=10.0, renormalise=False)
    return candidates.sample_candidate(kept, seed=3)
