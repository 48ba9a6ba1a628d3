"""Similarities, label sets, ROUGE, rater agreement, and the jobs built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    BIAS, LEXICON, PAIRS, PREDICTIONS, VECTORS, cosine_sql, documents, label_sets_sql, lexicon, predictions, review_pairs, rows,
    scores_sql, scratch, sentence_vector_sql, table, tokens_sql, with_sentence_vectors, word_vectors,
    words_sql,
)
from checks.registry import check
from reviewlab.functions import labels as label_functions
from reviewlab.functions.overlap import f_score as f_score_of
from reviewlab.functions.overlap import vector_cosine as cosine
from reviewlab.operators import agreement, rouge, similarity, stats
from reviewlab.operators.filters import length_band, similarity_gate
from reviewlab.operators.models import (
    batched_map, encode_texts, generate_replies, score_labels, score_labels_batch, tag_entities,
)
from reviewlab.plans import jobs
from reviewlab.scale import compute_once
from reviewlab.sources.tables import read_columnar


def tfidf_sql(source: str, a: str, b: str, out: str) -> str:
    """CTE ``out`` (review_id, score) of two-text TF-IDF cosines."""
    return f"""{out}_t AS (
        SELECT review_id, unnest({tokens_sql(a)}) AS tok, 1.0::DOUBLE AS ta, 0.0::DOUBLE AS tb FROM {source}
        UNION ALL SELECT review_id, unnest({tokens_sql(b)}), 0.0, 1.0 FROM {source}),
      {out}_f AS (SELECT review_id, sum(ta) AS ta, sum(tb) AS tb FROM {out}_t GROUP BY review_id, tok),
      {out}_w AS (SELECT *, CASE WHEN ta > 0 AND tb > 0 THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS w FROM {out}_f),
      {out} AS (SELECT review_id, coalesce(sum(ta * tb) / nullif(sqrt(sum(ta * w * ta * w)) * sqrt(sum(tb * w * tb * w)), 0), 0)
        AS score FROM {source} LEFT JOIN {out}_w USING (review_id) GROUP BY review_id)"""


def mean_vector_sql(source: str, col: str, out: str) -> str:
    """CTE ``out`` (review_id, vec) of mean word vectors."""
    return f"""{out}_d AS (SELECT review_id, unnest(vec) AS x, unnest(range(0, len(vec))) AS d FROM (
        SELECT review_id, unnest({tokens_sql(col)}) AS word FROM {source}) JOIN vectors USING (word)),
      {out} AS (SELECT review_id, list(m ORDER BY d) AS vec FROM (
        SELECT review_id, d, avg(x::DOUBLE) AS m FROM {out}_d GROUP BY ALL) GROUP BY review_id)"""


def glove_sql(a: str, b: str, out: str, source: str) -> str:
    """CTE ``out`` (review_id, score) over two CTEs of mean vectors."""
    return f"""{out} AS (SELECT s.review_id, coalesce({cosine_sql('a.vec', 'b.vec')}, 0) AS score FROM {source} s
        LEFT JOIN {a} a ON a.review_id = s.review_id LEFT JOIN {b} b ON b.review_id = s.review_id)"""


TFIDF = tfidf_sql("pairs", "review", "reply", "tfidf")


@check(rows("SELECT review_id, round(score, 6) AS tfidf FROM tfidf", PAIRS, TFIDF))
def tfidf_pair_cosine(spark, sf):
    pairs = similarity.with_tokens(review_pairs(spark, sf), {"a": "review", "b": "reply"})
    scored = similarity.with_tfidf(pairs, {"tfidf": (F.col("a"), F.col("b"))})
    return scored.select("review_id", F.round("tfidf", 6).alias("tfidf"))


GLOVE = ", ".join([mean_vector_sql("pairs", "review", "va"), mean_vector_sql("pairs", "reply", "vb"),
                   glove_sql("va", "vb", "glove", "pairs")])


def _glove(spark, sf, **scale):
    pairs = similarity.with_tokens(review_pairs(spark, sf), {"a": "review", "b": "reply"})
    scored = similarity.with_word_vector_cosine(
        pairs, word_vectors(spark, sf), {"va": F.col("a"), "vb": F.col("b")}, {"glove": ("va", "vb")}, **scale)
    return scored.select("review_id", F.round("glove", 6).alias("glove"))


@check(rows("SELECT review_id, round(score, 6) AS glove FROM glove", PAIRS, VECTORS, GLOVE))
def word_vector_cosine(spark, sf):
    return _glove(spark, sf)


@check(rows("SELECT review_id, round(score, 6) AS glove FROM glove", PAIRS, VECTORS, GLOVE))
def word_vector_cosine_shuffled(spark, sf):
    return _glove(spark, sf, limit=0)


SBERT = f"sbert AS (SELECT review_id, {cosine_sql(sentence_vector_sql(0), sentence_vector_sql(101))} AS score FROM pairs p)"


@check(rows("SELECT review_id, round(score, 6) AS sbert FROM sbert", PAIRS, SBERT))
def vector_cosine(spark, sf):
    pairs = with_sentence_vectors(spark, sf, review_pairs(spark, sf), {"ea": 0, "eb": 101})
    scored = similarity.with_vector_cosine(pairs, {"sbert": ("ea", "eb")})
    return scored.select("review_id", F.round("sbert", 6).alias("sbert"))


@check(f"""SELECT a.vec_id, round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS score
    FROM (SELECT *, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS o FROM embeddings) a JOIN embeddings b ON b.vec_id = a.o""")
def embedding_cosine(spark, sf):
    vecs = table(spark, sf, "embeddings")
    other = vecs.select(F.col("vec_id").alias("o"), F.col("embedding").alias("b"))
    joined = vecs.join(other, F.expr(f"(vec_id * 7 + 1) % {vecs.count()} = o"))
    return joined.select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("score"))


@check(rows("SELECT review_id, label, round(score, 6) AS score FROM s", PAIRS, LEXICON, scores_sql("pairs", "review", "s")))
def score_labels_lexicon(spark, sf):
    scored = score_labels(review_pairs(spark, sf), {"scores": "review"}, lexicon(spark), BIAS)
    return scored.select("review_id", F.inline("scores")).select("review_id", "label", F.round("score", 6).alias("score"))


DOCUMENT_LABELS = rows(
    """SELECT review_id AS doc_id, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM s x
      WHERE x.review_id = d.review_id AND score > 0.4), '') AS labels FROM docs d""",
    "docs AS (SELECT doc_id AS review_id, text FROM documents)", LEXICON, scores_sql("docs", "text", "s"))


@check(DOCUMENT_LABELS)
def threshold_labels(spark, sf):
    scored = score_labels(table(spark, sf, "documents").select("doc_id", "text"), {"scores": "text"}, lexicon(spark),
                          BIAS, "doc_id")
    return scored.select("doc_id", F.array_join(label_functions.threshold_labels(F.col("scores")), "|").alias("labels"))


PAIR_LABELS = label_sets_sql("pairs", {"a": "review", "b": "reply"})


def _labelled(spark, sf):
    scored = score_labels(review_pairs(spark, sf), {"sa": "review", "sb": "reply"}, lexicon(spark), BIAS)
    return scored.select("review_id", label_functions.threshold_labels(F.col("sa")).alias("a"),
                         label_functions.threshold_labels(F.col("sb")).alias("b"))


@check(rows("""SELECT review_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS common,
    array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS either FROM labelled""", PAIRS, LEXICON, PAIR_LABELS))
def common_and_union_labels(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _labelled(spark, sf).select("review_id", F.array_join(label_functions.common_labels(a, b), "|").alias("common"),
                                       F.array_join(label_functions.union_labels(a, b), "|").alias("either"))


@check(rows("""SELECT review_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard
    FROM labelled WHERE len(a) + len(b) > 0""", PAIRS, LEXICON, PAIR_LABELS))
def label_jaccard(spark, sf):
    jaccard = label_functions.label_jaccard(F.col("a"), F.col("b"))
    return _labelled(spark, sf).select("review_id", F.round(jaccard, 6).alias("jaccard")).where("jaccard IS NOT NULL")


@check(rows("SELECT count(CASE WHEN len(list_intersect(a, b)) < 2 THEN 1 END) AS rows FROM labelled", PAIRS, LEXICON, PAIR_LABELS))
def few_common_labels(spark, sf):
    common = label_functions.common_labels(F.col("a"), F.col("b")).alias("common_emotions")
    return stats.few_common_labels(_labelled(spark, sf).select(common), n=2)


@check(rows("SELECT round(avg((len(list_intersect(a, b)) > 0)::INT), 6) AS share FROM labelled", PAIRS, LEXICON, PAIR_LABELS))
def any_common_share(spark, sf):
    common = label_functions.common_labels(F.col("a"), F.col("b")).alias("common_emotions")
    return stats.any_common_share(_labelled(spark, sf).select(common)).select(F.round("share", 6).alias("share"))


# ---------------------------------------------------------------------- ROUGE

def whole_sql(col: str) -> str:
    """Normalised words of a text."""
    return f"regexp_extract_all(regexp_replace(lower({col}), '[^A-Za-z0-9가-힣]', ' ', 'g'), '[^ ]+', 0)"


def rouge_n_sql(source: str, n: int, out: str, alpha: float = 0.5, key: str = "review_id") -> str:
    """CTEs ``<out>_counts`` and ``out`` over a CTE with hyp_tokens and ref_tokens."""
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))

    def side(col: str, h: str, r: str) -> str:
        return f"""SELECT {key}, {gram} AS g, {h} AS h, {r} AS r FROM (
            SELECT {key}, {col} AS t, unnest(range(1, len({col}) - {n - 2})) AS i FROM {source})"""

    return f"""{out}_g AS (SELECT {key}, g, sum(h) AS h, sum(r) AS r FROM (
        {side('hyp_tokens', '1', '0')} UNION ALL {side('ref_tokens', '0', '1')}) GROUP BY ALL),
      {out}_o AS (SELECT {key}, sum(least(h, r))::DOUBLE AS overlap FROM {out}_g GROUP BY ALL),
      {out}_counts AS (SELECT {key}, len(hyp_tokens) - {n - 1} AS hyp, len(ref_tokens) - {n - 1} AS ref,
        coalesce(overlap, 0) AS overlap FROM {source} LEFT JOIN {out}_o USING ({key})),
      {out}_pr AS (SELECT *, CASE WHEN hyp = 0 THEN 0 ELSE overlap / hyp END AS p,
        CASE WHEN ref = 0 THEN 0 ELSE overlap / ref END AS r FROM {out}_counts),
      {out} AS (SELECT *, CASE WHEN p = 0 OR r = 0 THEN 0 ELSE p * r / ({1 - alpha} * p + {alpha} * r) END AS f FROM {out}_pr)"""


ROUGE_INPUT = f"""texts AS (SELECT review_id, {whole_sql('predicted_reply')} AS hyp_tokens,
    {whole_sql('reply')} AS ref_tokens FROM predictions)"""


def _rouge_input(spark, sf):
    return predictions(spark, sf).select("review_id", rouge.whole_tokens(F.col("predicted_reply")).alias("hyp_tokens"),
                                         rouge.whole_tokens(F.col("reply")).alias("ref_tokens"))


def _scores(df, key, score, digits=6):
    return df.select(key, *[F.round(F.col(f"{score}.{x}"), digits).alias(x) for x in ("p", "r", "f")])


def _rouge_check(n):
    sql = rows("SELECT review_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rg", PREDICTIONS, ROUGE_INPUT,
               rouge_n_sql("texts", n, "rg"))

    @check(sql, f"rouge_{n}")
    def query(spark, sf):
        return _scores(rouge.rouge_n(_rouge_input(spark, sf), n, "s"), "review_id", "s")


for _n in (1, 2, 3):
    _rouge_check(_n)


CHARACTERS = ROUGE_INPUT.replace(whole_sql("predicted_reply"), f"list_filter(string_split(array_to_string({whole_sql('predicted_reply')}, ' '), ''), lambda c: c <> ' ')").replace(
    whole_sql("reply") + " AS", f"list_filter(string_split(array_to_string({whole_sql('reply')}, ' '), ''), lambda c: c <> ' ') AS")


@check(rows("SELECT review_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rg", PREDICTIONS, CHARACTERS,
            rouge_n_sql("texts", 2, "rg")))
def rouge_2_characters(spark, sf):
    tokens = predictions(spark, sf).select(
        "review_id", rouge.whole_tokens(F.col("predicted_reply"), by="characters").alias("hyp_tokens"),
        rouge.whole_tokens(F.col("reply"), by="characters").alias("ref_tokens"))
    return _scores(rouge.rouge_n(tokens, 2, "s"), "review_id", "s")


@check(rows("SELECT review_id, round(f, 6) AS f FROM rg", PREDICTIONS, ROUGE_INPUT, rouge_n_sql("texts", 1, "rg", 0.8)))
def f_score(spark, sf):
    scored = rouge.rouge_n(_rouge_input(spark, sf), 1, "s")
    return scored.select("review_id", F.round(f_score_of(F.col("s.p"), F.col("s.r"), 0.8), 6).alias("f"))


# Two references per sample: the reply and the review.
MULTI = f"""refs AS (SELECT review_id * 10 AS pair_id, review_id, 0 AS ref_id, {whole_sql('predicted_reply')} AS hyp_tokens,
      {whole_sql('reply')} AS ref_tokens FROM predictions
    UNION ALL SELECT review_id * 10 + 1, review_id, 1, {whole_sql('predicted_reply')}, {whole_sql('review')} FROM predictions)"""
MULTI_ROUGE = MULTI + ", " + rouge_n_sql("refs", 2, "rg", key="pair_id")


def _references(spark, sf):
    sides = F.array(F.struct(F.lit(0).alias("ref_id"), F.col("reply").alias("text")),
                    F.struct(F.lit(1).alias("ref_id"), F.col("review").alias("text")))
    refs = predictions(spark, sf).select(F.col("review_id").alias("sample_id"), "predicted_reply", F.inline(sides))
    return refs.select("sample_id", "ref_id", rouge.whole_tokens(F.col("predicted_reply")).alias("hyp_tokens"),
                       rouge.whole_tokens(F.col("text")).alias("ref_tokens"))


def _aggregated(spark, sf, mode):
    scored = rouge.rouge_n(_references(spark, sf), 2, "s")
    out = rouge.rouge_aggregate(scored, "s", mode)
    return out.select(*[c for c in ("sample_id", "ref_id") if c in out.columns],
                      *[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


@check(rows("""SELECT review_id AS sample_id, round(p, 6) AS p, round(r, 6) AS r,
    round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE p * r / (0.5 * p + 0.5 * r) END, 6) AS f FROM (
      SELECT pair_id // 10 AS review_id, CASE WHEN sum(hyp) = 0 THEN 0 ELSE sum(overlap) / sum(hyp) END AS p,
        CASE WHEN sum(ref) = 0 THEN 0 ELSE sum(overlap) / sum(ref) END AS r FROM rg_counts GROUP BY 1)""",
            PREDICTIONS, MULTI_ROUGE))
def rouge_pooled_references(spark, sf):
    return _aggregated(spark, sf, "avg")


@check(rows("""SELECT pair_id // 10 AS sample_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rg
    QUALIFY row_number() OVER (PARTITION BY pair_id // 10 ORDER BY rg.r DESC, pair_id) = 1""", PREDICTIONS, MULTI_ROUGE))
def rouge_best_reference(spark, sf):
    return _aggregated(spark, sf, "best")


@check(rows("""SELECT pair_id // 10 AS sample_id, pair_id % 10 AS ref_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f
    FROM rg""", PREDICTIONS, MULTI_ROUGE))
def rouge_all_references(spark, sf):
    return _aggregated(spark, sf, "all").withColumn("ref_id", F.col("ref_id").cast("bigint"))


@check(rows("SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f), 6) AS f FROM rg", PREDICTIONS, ROUGE_INPUT,
            rouge_n_sql("texts", 2, "rg")))
def rouge_mean(spark, sf):
    scored = rouge.rouge_n(_rouge_input(spark, sf), 2, "s").select("s.*")
    return rouge.rouge_mean(scored).select(*[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


# Longest common subsequence by rows: each token of the one text updates the row of the other.
LCS = """lcs AS (SELECT review_id, len(hyp_tokens) AS hyp, len(ref_tokens) AS ref,
    CASE WHEN len(hyp_tokens) = 0 OR len(ref_tokens) = 0 THEN 0 ELSE list_last(list_reduce(hyp_tokens,
      lambda prev, tok: list_reduce(range(1, len(ref_tokens) + 1), lambda cur, j: list_append(cur,
        CASE WHEN ref_tokens[j] = tok THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0::BIGINT]),
      list_resize([0::BIGINT], len(ref_tokens) + 1, 0::BIGINT))) END AS n FROM texts)"""


def lines_sql(col: str) -> str:
    return f"list_transform(string_split({col}, chr(10)), lambda line: {whole_sql('line')})"


def recursive(select: str, *ctes: str) -> str:
    return rows(select, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def rouge_lcs_sql(source: str, out: str, weight: float = 1.0, key: str = "review_id") -> str:
    """CTEs up to ``out`` (key, p, r, f) of ROUGE-L or ROUGE-W over a CTE with hyp_lines and ref_lines.

    The alignment of two lines is filled row by row: values, and lengths of the runs of matches that end in a cell.
    The way back reads a letter per cell: m match, u up, l left. All ways of a reference line make its hits, of which
    each token counts as often as the hypothesis has it; a run closes with a hit that counts and is the last of its
    neighbours.
    """
    size = "1" if weight == 1.0 else f"pow(count(*), {weight})"
    run = "place" if weight == 1.0 else "before"
    ends = "" if weight == 1.0 else "HAVING max(ends) = 1"
    return f"""{out}_r AS (SELECT {key}, unnest(range(1, len(ref_lines) + 1)) AS line, unnest(ref_lines) AS r FROM {source}),
      {out}_h AS (SELECT {key}, unnest(range(1, len(hyp_lines) + 1)) AS other, unnest(hyp_lines) AS h FROM {source}),
      {out}_two AS (SELECT row_number() OVER () AS two, * FROM {out}_r JOIN {out}_h USING ({key}) WHERE len(r) > 0 AND len(h) > 0),
      {out}_fill(two, i, r, h, row, runs) AS (
        SELECT two, 0::BIGINT, r, h, list_transform(range(len(h) + 1), lambda x: 0.0::DOUBLE),
          list_transform(range(len(h) + 1), lambda x: 0::BIGINT) FROM {out}_two
        UNION ALL SELECT two, i + 1, r, h, list_reduce(range(1, len(h) + 1), lambda cur, j: list_append(cur,
            CASE WHEN tok = h[j] THEN row[j] + pow(runs[j] + 1, {weight}) - pow(runs[j], {weight})
            ELSE greatest(row[j + 1], cur[j]) END), [0.0::DOUBLE]),
          list_prepend(0::BIGINT, list_transform(range(1, len(h) + 1), lambda j: CASE WHEN tok = h[j] THEN runs[j] + 1 ELSE 0 END))
        FROM (SELECT *, r[i + 1] AS tok FROM {out}_fill WHERE i < len(r))),
      {out}_move AS (SELECT two, i, array_to_string(list_transform(range(1, len(h) + 1), lambda j: CASE WHEN tok = h[j] THEN 'm'
          WHEN above[j + 1] >= row[j] THEN 'u' ELSE 'l' END), '') AS moves
        FROM (SELECT *, r[i] AS tok, lag(row) OVER (PARTITION BY two ORDER BY i) AS above FROM {out}_fill) WHERE i > 0),
      {out}_way AS (SELECT two, list_reduce(list(moves ORDER BY i DESC),
          lambda back, moves: {{'i': back.i - 1,
            'j': length(rtrim(moves[1:back.j], 'l')) - (right(rtrim(moves[1:back.j], 'l'), 1) = 'm')::BIGINT,
            's': CASE WHEN right(rtrim(moves[1:back.j], 'l'), 1) = 'm' THEN back.s || ',' || back.i ELSE back.s END}}, {{'i': max(i)::BIGINT, 'j': max(length(moves))::BIGINT, 's': ''}}) AS way FROM {out}_move GROUP BY two),
      {out}_at AS (SELECT DISTINCT {key}, line, place, r[place] AS tok FROM (SELECT {key}, line, r,
          unnest(string_split(way.s[2:], ','))::BIGINT AS place FROM {out}_way JOIN {out}_two USING (two) WHERE way.s <> '')),
      {out}_hit AS (SELECT *, row_number() OVER (PARTITION BY {key}, tok ORDER BY line, place) AS nth,
        (lead(place) OVER (PARTITION BY {key}, line ORDER BY place) IS DISTINCT FROM place + 1)::INT AS ends FROM {out}_at),
      {out}_have AS (SELECT {key}, tok, count(*) AS n FROM (SELECT {key}, unnest(h) AS tok FROM {out}_h) GROUP BY ALL),
      {out}_used AS (SELECT {key}, line, place, ends, coalesce(sum(ends) OVER (PARTITION BY {key}, line ORDER BY place
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM {out}_hit JOIN {out}_have USING ({key}, tok) WHERE nth <= n),
      {out}_o AS (SELECT {key}, sum(size) AS overlap FROM (SELECT {key}, {size} AS size FROM {out}_used
        GROUP BY {key}, line, {run} {ends}) GROUP BY ALL),
      {out}_counts AS (SELECT {key}, pow(list_sum(list_transform(hyp_lines, lambda x: len(x))), {weight}) AS hyp,
        pow(list_sum(list_transform(ref_lines, lambda x: pow(len(x), {weight}))), {weight}) AS ref,
        coalesce(overlap, 0) AS overlap FROM {source} LEFT JOIN {out}_o USING ({key})),
      {out}_pr AS (SELECT {key}, pow(CASE WHEN hyp = 0 THEN 0 ELSE overlap / hyp END, {1 / weight}) AS p,
        pow(CASE WHEN ref = 0 THEN 0 ELSE overlap / ref END, {1 / weight}) AS r FROM {out}_counts),
      {out} AS (SELECT *, CASE WHEN p = 0 OR r = 0 THEN 0 ELSE p * r / (0.5 * p + 0.5 * r) END AS f FROM {out}_pr)"""


LINES = f"""texts AS (SELECT review_id, {lines_sql('predicted_reply')} AS hyp_lines,
    {lines_sql('reply')} AS ref_lines FROM predictions)"""
ROUGE_L, ROUGE_W = rouge_lcs_sql("texts", "rl"), rouge_lcs_sql("texts", "rw", 1.2)


def _lines(spark, sf):
    return predictions(spark, sf).select("review_id", rouge.sentence_list(F.col("predicted_reply")).alias("hyp_lines"),
                                         rouge.sentence_list(F.col("reply")).alias("ref_lines"))


@check(recursive("SELECT review_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rl", PREDICTIONS, LINES, ROUGE_L))
def rouge_l(spark, sf):
    return _scores(rouge.rouge_lcs(_lines(spark, sf), "s"), "review_id", "s")


@check(recursive("SELECT review_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rw", PREDICTIONS, LINES, ROUGE_W))
def rouge_w(spark, sf):
    return _scores(rouge.rouge_lcs(_lines(spark, sf), "s", weight=1.2), "review_id", "s")


MULTI_LINES = f"""refs AS (SELECT review_id * 10 AS pair_id, {lines_sql('predicted_reply')} AS hyp_lines,
      {lines_sql('reply')} AS ref_lines FROM predictions
    UNION ALL SELECT review_id * 10 + 1, {lines_sql('predicted_reply')}, {lines_sql('review')} FROM predictions)"""


@check(recursive("""SELECT pair_id // 10 AS sample_id, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM rl
    QUALIFY row_number() OVER (PARTITION BY pair_id // 10 ORDER BY rl.r DESC, pair_id) = 1""",
            PREDICTIONS, MULTI_LINES, rouge_lcs_sql("refs", "rl", key="pair_id")))
def rouge_l_best_reference(spark, sf):
    sides = F.array(F.struct(F.lit(0).alias("ref_id"), F.col("reply").alias("text")),
                    F.struct(F.lit(1).alias("ref_id"), F.col("review").alias("text")))
    refs = predictions(spark, sf).select(F.col("review_id").alias("sample_id"), "predicted_reply", F.inline(sides))
    lines = refs.select("sample_id", "ref_id", rouge.sentence_list(F.col("predicted_reply")).alias("hyp_lines"),
                        rouge.sentence_list(F.col("text")).alias("ref_lines"))
    best = rouge.rouge_aggregate(rouge.rouge_lcs(lines, "s"), "s", "best")
    return best.select("sample_id", *[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


@check(recursive("SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f), 6) AS f FROM rl", PREDICTIONS, LINES, ROUGE_L))
def prediction_rouge_l_mean(spark, sf):
    scored = rouge.rouge_lcs(_lines(spark, sf), "s").select("s.*")
    return rouge.rouge_mean(scored).select(*[F.round(c, 6).alias(c) for c in ("p", "r", "f")])


# --------------------------------------------------------------------- raters

RATINGS = """ratings AS (SELECT doc_id AS item_id, r AS rater_id, (doc_id * 31 + r * 17 + n_chars) % 3 AS category
    FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(r))"""


def _ratings(spark, sf):
    raters = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rater_id")
    rated = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "n_chars", raters)
    return rated.withColumn("category", F.expr("(item_id * 31 + rater_id * 17 + n_chars) % 3"))


@check(rows("""SELECT round((p - pe) / (1 - pe), 6) AS kappa FROM (SELECT avg((squares - n)::DOUBLE / (n * (n - 1))) AS p FROM (
      SELECT item_id, sum(c * c) AS squares, sum(c) AS n FROM (
        SELECT item_id, category, count(*) AS c FROM ratings GROUP BY ALL) GROUP BY ALL)),
    (SELECT sum(share * share) AS pe FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM ratings) AS share
      FROM ratings GROUP BY category))""", RATINGS))
def fleiss_kappa(spark, sf):
    return agreement.fleiss_kappa(_ratings(spark, sf)).select(F.round("kappa", 6).alias("kappa"))


@check(rows("""SELECT count(CASE WHEN yes * 2 > n THEN 1 END) AS accepted, count(*) AS items FROM (
    SELECT item_id, sum((category > 0)::BIGINT) AS yes, count(*) AS n FROM ratings GROUP BY item_id)""", RATINGS))
def hard_vote(spark, sf):
    votes = _ratings(spark, sf).select("item_id", (F.col("category") > 0).cast("int").alias("vote"))
    return agreement.hard_vote(votes)


# ----------------------------------------------------------------------- jobs

REPORT = ", ".join([
    tfidf_sql("predictions", "review", "predicted_reply", "t1"), tfidf_sql("predictions", "reply", "predicted_reply", "t2"),
    mean_vector_sql("predictions", "review", "v1"), mean_vector_sql("predictions", "reply", "v2"),
    mean_vector_sql("predictions", "predicted_reply", "v3"),
    glove_sql("v1", "v3", "g1", "predictions"), glove_sql("v2", "v3", "g2", "predictions"),
    f"""report AS (SELECT p.review_id, t1.score AS tfidf_review, t2.score AS tfidf_reply, g1.score AS glove_review,
      g2.score AS glove_reply, {cosine_sql(sentence_vector_sql(0), sentence_vector_sql(202))} AS sbert_review,
      {cosine_sql(sentence_vector_sql(101), sentence_vector_sql(202))} AS sbert_reply
      FROM predictions p JOIN t1 USING (review_id) JOIN t2 USING (review_id) JOIN g1 USING (review_id)
      JOIN g2 USING (review_id))"""])
SIX = similarity.PREDICTION_SCORES


def _encoded_predictions(spark, sf):
    return with_sentence_vectors(spark, sf, predictions(spark, sf), {"e_review": 0, "e_reply": 101, "e_pred": 202})


ENCODED = ("e_review", "e_reply", "e_pred")


@check(rows(f"SELECT review_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in SIX)} FROM report", PREDICTIONS, VECTORS, REPORT))
def prediction_report(spark, sf):
    report = similarity.prediction_report(_encoded_predictions(spark, sf), word_vectors(spark, sf), ENCODED)
    return report.select("review_id", *[F.round(c, 6).alias(c) for c in SIX])


@check(rows(f"SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIX)} FROM report", PREDICTIONS, VECTORS, REPORT))
def mean_scores(spark, sf):
    report = similarity.prediction_report(_encoded_predictions(spark, sf), word_vectors(spark, sf), ENCODED)
    return stats.mean_scores(report, SIX).select(*[F.round(c, 6).alias(c) for c in SIX])


MEASURES = [("rouge_l", "rl"), ("rouge_w", "rw")]


@check(recursive(f"""SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIX)},
    {', '.join(f'round(avg({t}.{x}), 6) AS {m}_{x}' for m, t in MEASURES for x in ('p', 'r', 'f'))},
    round(({' + '.join(f'avg({c})' for c in SIX)}) / 6, 6) AS grand_mean
    FROM report JOIN rl USING (review_id) JOIN rw USING (review_id)""", PREDICTIONS, VECTORS, REPORT, LINES, ROUGE_L, ROUGE_W))
def evaluate_predictions(spark, sf):
    means = jobs.evaluate_predictions(_encoded_predictions(spark, sf), word_vectors(spark, sf), ENCODED, weight=1.2)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@check(rows(f"""SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in SIX)},
    round(({' + '.join(f'avg({c})' for c in SIX)}) / 6, 6) AS grand_mean FROM report""", PREDICTIONS, VECTORS, REPORT))
def evaluate_prediction_similarity(spark, sf):
    means = jobs.evaluate_predictions(_encoded_predictions(spark, sf), word_vectors(spark, sf), ENCODED)
    return means.select(*[F.round(c, 6).alias(c) for c in [*SIX, "grand_mean"]])


EMOTIONS = label_sets_sql("predictions", {"a": "review", "b": "reply", "c": "predicted_reply"}) + """,
  sims AS (SELECT *, CASE WHEN len(a) + len(b) > 0
      THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS s1,
    CASE WHEN len(a) + len(c) > 0
      THEN len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) END AS s2 FROM labelled)"""


@check(rows("""SELECT review_id, array_to_string(a, '|') AS review_emotions, array_to_string(b, '|') AS reply_emotions,
    array_to_string(c, '|') AS predicted_emotions, coalesce(round(s1, 6), -1) AS reply_emotion_sim,
    coalesce(round(s2, 6), -1) AS predicted_emotion_sim FROM sims""", PREDICTIONS, LEXICON, EMOTIONS))
def emotion_report(spark, sf):
    report = jobs.emotion_report(predictions(spark, sf), lexicon(spark), BIAS)
    sets = [F.array_join(c, "|").alias(c) for c in ("review_emotions", "reply_emotions", "predicted_emotions")]
    sims = [F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("reply_emotion_sim", "predicted_emotion_sim")]
    return report.select("review_id", *sets, *sims)


@check(rows("SELECT round(avg(s1), 6) AS reply_emotion_sim, round(avg(s2), 6) AS predicted_emotion_sim FROM sims",
            PREDICTIONS, LEXICON, EMOTIONS))
def mean_emotion_sim(spark, sf):
    means = jobs.mean_emotion_sim(jobs.emotion_report(predictions(spark, sf), lexicon(spark), BIAS))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


SCORED = ", ".join([VECTORS, TFIDF, GLOVE, SBERT, LEXICON, PAIR_LABELS])
SCORED_ROWS = """FROM pairs p JOIN tfidf t USING (review_id) JOIN glove g USING (review_id) JOIN sbert s USING (review_id)
    JOIN labelled l USING (review_id)"""


def _scored_pairs(spark, sf, pairs):
    encoded = with_sentence_vectors(spark, sf, pairs, {"ea": 0, "eb": 101})
    return jobs.score_pairs(encoded, word_vectors(spark, sf), ("ea", "eb"), lexicon(spark), BIAS)


@check(rows(f"""SELECT review_id, round(t.score, 6) AS tfidf, round(g.score, 6) AS glove, round(s.score, 6) AS sbert,
    array_to_string(list_sort(list_intersect(a, b)), '|') AS common {SCORED_ROWS}""", PAIRS, SCORED))
def score_pairs(spark, sf):
    scored = _scored_pairs(spark, sf, review_pairs(spark, sf))
    return scored.select("review_id", *[F.round(c, 6).alias(c) for c in ("tfidf", "glove", "sbert")],
                         F.array_join("common_emotions", "|").alias("common"))


# Gates that suit the given vectors, which do not come from a language model.
GATES = {"glove": 0.4, "sbert": 0.0}
LIMITS = {"review": (50, 300), "reply": (200, 1500)}


@check(rows(f"SELECT review_id {SCORED_ROWS} WHERE g.score > 0.4 AND s.score > 0.0", PAIRS, SCORED))
def similarity_gate_pairs(spark, sf):
    return similarity_gate(_scored_pairs(spark, sf, review_pairs(spark, sf)), GATES).select("review_id")


@check(rows(f"""SELECT review_id, CASE WHEN h < '33333333' THEN 'test' WHEN h < '66666666' THEN 'val' ELSE 'train' END AS split
    FROM (SELECT review_id, substr(md5(concat('42:', CAST(review_id AS STRING))), 1, 8) AS h {SCORED_ROWS}
      WHERE length(p.review) > 50 AND length(p.review) < 300 AND length(p.reply) > 200 AND length(p.reply) < 1500
      AND g.score > 0.4 AND s.score > 0.0)""", PAIRS, SCORED))
def select_training_set(spark, sf):
    # The band goes first, so that scores are computed for the rows that can be kept.
    kept = length_band(review_pairs(spark, sf), LIMITS, inclusive=False)
    path = scratch(spark)
    jobs.select_training_set(_scored_pairs(spark, sf, kept), LIMITS, GATES, path=path)
    return read_columnar(spark, path).select("review_id", "split")


FLAGSHIP = rows(f"""SELECT p.store, count(*) AS pairs, round(avg(t.score), 6) AS tfidf,
    CAST(sum(length(p.reply)) AS BIGINT) AS reply_chars FROM clean p JOIN tfidf t USING (review_id)
    WHERE t.score > 0.02 GROUP BY p.store""", PAIRS, r"""spaced AS (SELECT * REPLACE (
      regexp_replace(review, '[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]{2,}', chr(10), 'g') AS review,
      regexp_replace(reply, '[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]{2,}', chr(10), 'g') AS reply) FROM pairs),
    m1 AS (SELECT * REPLACE (CASE WHEN customer_id = '   손님'
      THEN regexp_replace(reply, '[ㄱ-ㅎ가-힣\p{L}\p{N}_]+(\*\*)* *(님|고객님)', '#@고객이름#', 'g')
      ELSE regexp_replace(reply, concat(regexp_escape(customer_id), '|', regexp_escape(left(customer_id, -1)), '|',
        regexp_escape(left(customer_id, -2))), '#@고객이름#', 'g') END AS reply) FROM spaced),
    m2 AS (SELECT * REPLACE (regexp_replace(replace(replace(replace(replace(reply, store, '#@상호명#'),
      replace(store, '-', ' '), '#@상호명#'), split_part(store, '-', 1), '#@상호명#'), split_part(store, '-', 2), '#@상호명#'),
      '(#@상호명#){2,}', '#@상호명#', 'g') AS reply) FROM m1),
    m3 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(reply, '@[a-zA-Z0-9_]+', '#@전화번호#', 'g'),
      '(2\.[\p{L}\p{N}_.]+)|(010-[\p{L}\p{N}_-]+)', '#@전화번호#', 'g'),
      '[\p{L}\p{N}_/:.@]+.com[\p{L}\p{N}_/.]*', '#@전화번호#', 'g') AS reply) FROM m2),
    clean AS (SELECT * FROM m3 WHERE length(review) > 50 AND length(review) < 300 AND length(reply) > 200
      AND length(reply) < 1500)""", tfidf_sql("clean", "review", "reply", "tfidf"))


@check(FLAGSHIP)
def usable_pairs_per_store(spark, sf):
    """Which masked pairs are usable for training, and how similar are they, per store?"""
    masked = jobs.clean_and_mask(review_pairs(spark, sf))
    contact = compute_once(masked, {"reply": jobs.additional_masking(F.col("reply"))})
    kept = length_band(contact, LIMITS, inclusive=False)
    scored = similarity.with_tfidf(similarity.with_tokens(kept, {"a": "review", "b": "reply"}),
                                   {"tfidf": (F.col("a"), F.col("b"))})
    gated = similarity_gate(scored, {"tfidf": 0.02})
    return gated.groupBy("store").agg(F.count("*").alias("pairs"), F.round(F.avg("tfidf"), 6).alias("tfidf"),
                                      F.sum(F.length("reply")).alias("reply_chars"))


# ------------------------------------------------- callables over text batches

def letter_scorer():
    """Two labels from the share of vowels: stands in for a classifier."""
    def score(texts):
        shares = [sum(c in "aeiou" for c in t) / max(len(t), 1) for t in texts]
        return [[{"label": "vowels", "score": s}, {"label": "others", "score": 1 - s}] for s in shares]

    return score


def letter_encoder():
    """Counts of 26 letters: stands in for a sentence encoder."""
    def encode(texts):
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    return encode


def capital_tagger():
    """Words in capitals as organisations: stands in for a tagger."""
    def tag(texts):
        return [[{"word": w, "type": "ORGANIZATION"} for w in t.split() if w.isupper() and len(w) > 2] for t in texts]

    return tag


def echo_generator():
    def reply(texts):
        return [f"thanks for {len(t)} characters" for t in texts]

    return reply


VOWELS = "(length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')))::DOUBLE / greatest(length(text), 1)"


@check(f"""SELECT doc_id, round({VOWELS}, 6) AS vowels, round(1 - {VOWELS}, 6) AS others FROM documents""")
def score_labels_model(spark, sf):
    scored = score_labels_batch(documents(spark, sf).select("doc_id", "text"), "text", letter_scorer, "s")
    return scored.select("doc_id", F.round(F.col("s")[0]["score"], 6).alias("vowels"),
                         F.round(F.col("s")[1]["score"], 6).alias("others"))


LETTERS = ", ".join(
    f"(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz")


@check(rows(f"""SELECT review_id, round({cosine_sql('[' + LETTERS.format('review') + ']', '[' + LETTERS.format('reply') + ']')}, 6)
    AS score FROM pairs""", PAIRS))
def encode_texts_model(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", "review", "reply")
    encoded = encode_texts(pairs, {"a": "review", "b": "reply"}, letter_encoder)
    return encoded.select("review_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))


@check(f"""SELECT doc_id, array_to_string(list_filter({words_sql('text')},
    lambda w: length(w) > 2 AND upper(w) = w AND lower(w) <> w), '|') AS words FROM documents""")
def tag_entities_model(spark, sf):
    tagged = tag_entities(documents(spark, sf).select("doc_id", "text"), "text", capital_tagger)
    return tagged.select("doc_id", F.array_join(F.transform("entities", lambda e: e["word"]), "|").alias("words"))


@check(rows("SELECT review_id, concat('thanks for ', length(regexp_replace(regexp_replace(review, "
            r"'^[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]+|[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]+$', '', 'g'), '\n', '', 'g')), "
            "' characters') AS reply FROM pairs", PAIRS))
def generate_replies_model(spark, sf):
    pairs = review_pairs(spark, sf).select("review_id", "review")
    return generate_replies(pairs, "review", echo_generator).select("review_id", F.col("predicted_reply").alias("reply"))


@check("SELECT doc_id, concat(lang, ':', source) AS tag FROM documents")
def batched_map_rows(spark, sf):
    def tag(batch):
        return batch.assign(tag=batch.lang + ":" + batch.source)[["doc_id", "tag"]]

    return batched_map(table(spark, sf, "documents").select("doc_id", "lang", "source"), tag, "doc_id long, tag string")


@check(rows("SELECT review_id, hyp, ref, n FROM lcs", PREDICTIONS, ROUGE_INPUT, LCS))
def rouge_l_single_line(spark, sf):
    # One line per text, so the union over lines is one longest common subsequence.
    one = _rouge_input(spark, sf).select("review_id", F.array(F.array_join("hyp_tokens", " ")).alias("hyp_lines"),
                                         F.array(F.array_join("ref_tokens", " ")).alias("ref_lines"))
    counts = rouge.rouge_lcs(one, "s").select("review_id", "s_counts.*")
    return counts.select("review_id", *[F.col(c).cast("bigint").alias(n)
                                        for c, n in (("hyp", "hyp"), ("ref", "ref"), ("overlap", "n"))])


