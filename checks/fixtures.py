"""Review tables derived from the given tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.operators.pairing import pair_turns
from reviewlab.scale import spread
from reviewlab.session import shared_folder

# Columns of the review tables over (conv_id, turn, review, answer), valid in both engines.
BLOCK_COLUMNS = [
    "conv_id * 100 + turn AS review_id",
    "concat('Cafe', CAST(conv_id % 20 AS STRING), '-Branch', CAST(conv_id % 3 AS STRING)) AS store",
    "CASE WHEN (conv_id + turn) % 6 = 0 THEN NULL ELSE CAST((conv_id + turn) % 6 AS STRING) END AS taste",
    "CASE WHEN (conv_id + turn + 1) % 6 = 0 THEN NULL ELSE CAST((conv_id + turn + 1) % 6 AS STRING) END AS quantity",
    "CASE WHEN (conv_id + turn + 2) % 6 = 0 THEN NULL ELSE CAST((conv_id + turn + 2) % 6 AS STRING) END AS delivery",
    "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('Set ', CAST(conv_id % 4 AS STRING), '   \n Drink') END AS menu",
    "CASE WHEN conv_id % 10 = 9 THEN '   손님' ELSE concat('u', CAST(conv_id AS STRING), '**님') END AS customer_id",
    "review",
    """CASE WHEN answer IS NULL THEN NULL ELSE concat('Hello u', CAST(conv_id AS STRING), '**님!  \n\n  Thank you from Cafe',
        CAST(conv_id % 20 AS STRING), '-Branch', CAST(conv_id % 3 AS STRING), '. ', answer, ' Call 010-1234-',
        CAST(1000 + conv_id AS STRING), ' or @cafe_', CAST(conv_id % 20 AS STRING), ' or help',
        CAST(conv_id AS STRING), '@mail.com') END AS reply""",
]

BLOCKS = f"""turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  asked AS (SELECT conv_id, turn, text AS review, CASE WHEN nrole = 'assistant' THEN ntext END AS answer
    FROM turns WHERE role = 'user'),
  blocks AS (SELECT {', '.join(BLOCK_COLUMNS)} FROM asked)"""
PAIRS = BLOCKS + ", pairs AS (SELECT * FROM blocks WHERE reply IS NOT NULL)"
# A generated reply: the reply with many of its words spelt otherwise, and the review.
PREDICTED = "concat(replace(replace(reply, 'er', 'ar'), 'de', 'do'), ' ', review)"
PREDICTIONS = PAIRS + f""", predictions AS (SELECT review_id, review, reply,
    {PREDICTED} AS predicted_reply FROM pairs)"""

TOKEN = r"([\p{L}\p{N}_]+)"
SPACE = r"[\t\n\x0b\f\r\x1c-\x20\x85\p{Z}]"


def tokens_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{TOKEN}', 1)"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{SPACE}+'), lambda w: w <> '')"


def rows(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, shared out for work on long texts."""
    return spread(table(spark, sf, "documents"))


def review_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with a reply or NULL."""
    asked = pair_turns(table(spark, sf, "conversations"), unanswered=True)
    return asked.withColumnRenamed("reply", "answer").selectExpr(*BLOCK_COLUMNS)


def review_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Answered reviews."""
    asked = pair_turns(table(spark, sf, "conversations"))
    return asked.withColumnRenamed("reply", "answer").selectExpr(*BLOCK_COLUMNS)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return review_pairs(spark, sf).selectExpr(
        "review_id", "review", "reply",
        f"{PREDICTED} AS predicted_reply")


# Label weights per token, and the bias that keeps texts without hits below the threshold.
LEXICON_ROWS = [("joy", "the", 1.5), ("joy", "la", 1.5), ("joy", "die", 1.5), ("calm", "of", 1.0), ("calm", "le", 1.0),
                ("calm", "der", 1.0), ("calm", "de", 0.5), ("anger", "is", 2.0), ("anger", "un", 2.0),
                ("anger", "und", 2.0)]
BIAS = -2.0
LEXICON = "lexicon(label, token, weight) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in LEXICON_ROWS) + ")"


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "label string, token string, weight double")


def scores_sql(source: str, col: str, out: str) -> str:
    """CTE ``out`` (review_id, label, score) of all labels for a text column."""
    return f"""{out}_z AS (SELECT review_id, label, sum(weight) AS z FROM (
        SELECT review_id, unnest({tokens_sql(col)}) AS token FROM {source}) JOIN lexicon USING (token) GROUP BY ALL),
      {out} AS (SELECT s.review_id, l.label, 1 / (1 + exp(-({BIAS} + coalesce(z, 0)))) AS score
        FROM {source} s CROSS JOIN (SELECT DISTINCT label FROM lexicon) l
        LEFT JOIN {out}_z z ON z.review_id = s.review_id AND z.label = l.label)"""


def label_sets_sql(source: str, cols: dict[str, str]) -> str:
    """CTE ``labelled``: review_id and a sorted label list per text column."""
    parts = ", ".join(scores_sql(source, text, out) for out, text in cols.items())
    sets = ", ".join(
        f"coalesce((SELECT list(label ORDER BY label) FROM {out} x WHERE x.review_id = s.review_id AND score > 0.4),"
        f" []::VARCHAR[]) AS {out}" for out in cols)
    return f"{parts}, labelled AS (SELECT review_id, {sets} FROM {source} s)"


GAZETTEER_ROWS = [("Branch0", "LOCATION"), ("Branch1", "LOCATION"), ("Branch2", "LOCATION"), ("mail", "ORGANIZATION")]


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER_ROWS, "term string, type string")


# Vector of a token: a row of the embeddings picked by the token's letters. Tokens that
# start with z are out of the vocabulary.
VECTOR_KEY = "(length(word) * 131 + ascii(word) * 7)"
N_VECTORS = "(SELECT count(*) FROM embeddings)"
VECTORS = f"""vocabulary AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM conversations),
  picked AS (SELECT word, {VECTOR_KEY} % {N_VECTORS} AS key FROM vocabulary),
  vectors AS (SELECT word, embedding AS vec FROM picked JOIN embeddings ON vec_id = key WHERE word NOT LIKE 'z%')"""


def conversation_words(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 1)
    return table(spark, sf, "conversations").select(F.explode(tokens).alias("word")).distinct()


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    words = conversation_words(spark, sf).where("word NOT LIKE 'z%'").withColumn("vec_id", F.expr(VECTOR_KEY) % vecs.count())
    # Vectors are a stored table, not a step of the job that looks words up.
    path = scratch(spark)
    words.join(vecs, "vec_id").select("word", "vec").write.parquet(path)
    return spark.read.parquet(path)


def with_sentence_vectors(spark: SparkSession, sf: str, df: DataFrame, cols: dict[str, int]) -> DataFrame:
    """Add a row of the embeddings per text column, picked by review id and offset."""
    vecs = table(spark, sf, "embeddings")
    n = vecs.count()
    for new, offset in cols.items():
        keyed = vecs.select(F.col("vec_id").alias("_v"), F.col("embedding").alias(new))
        df = df.join(keyed, F.expr(f"(review_id * 13 + {offset}) % {n}") == F.col("_v")).drop("_v")
    return df


def sentence_vector_sql(offset: int, alias: str = "p") -> str:
    return f"(SELECT embedding FROM embeddings e WHERE e.vec_id = ({alias}.review_id * 13 + {offset}) % {N_VECTORS})"


def cosine_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
