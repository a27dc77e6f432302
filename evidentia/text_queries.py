"""Queries of answer likeness and likelihood, each with the same query in SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import likelihood, metrics, similarity
from evidentia.queries import _query, _t
from evidentia.streaming.monitor import checkpoint_folder


def _turns(spark, sf_dir: str) -> DataFrame:
    """Each turn with the text of the conversation's next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _t(spark, sf_dir, "conversations").withColumn("next_text", F.lead("text").over(w))
    return turns.where("next_text is not null")


_PAIRS = "p AS (SELECT conv_id, turn, text AS b, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations QUALIFY a IS NOT NULL)"


def _overlap(n: int) -> str:
    grams = lambda x: f"(SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))) AS g FROM p) GROUP BY ALL)"
    return f"s{n} AS (SELECT conv_id, turn, sum(least(x.c, y.c))::BIGINT AS s FROM {grams('a')} x JOIN {grams('b')} y USING (conv_id, turn, g) GROUP BY ALL)"


@_query(f"""WITH {_PAIRS}, {", ".join(_overlap(n) for n in range(1, 5))},
m AS (SELECT p.conv_id, p.turn, length(a) AS la, length(b) AS lb, [coalesce(s1.s, 0), coalesce(s2.s, 0), coalesce(s3.s, 0), coalesce(s4.s, 0)] AS s
  FROM p LEFT JOIN s1 USING (conv_id, turn) LEFT JOIN s2 USING (conv_id, turn) LEFT JOIN s3 USING (conv_id, turn) LEFT JOIN s4 USING (conv_id, turn)),
l AS (SELECT *, list_sum([CASE WHEN s[n] > 0 THEN ln(s[n]::DOUBLE / greatest(la - n + 1, 1)) ELSE -ln(2.0::DOUBLE ** len(list_filter(s[1:n], lambda x: x = 0)) * greatest(la - n + 1, 1)) END FOR n IN [1, 2, 3, 4]]) AS g FROM m)
SELECT conv_id, turn, round(100 * CASE WHEN s[1] = 0 THEN 0.0::DOUBLE ELSE CASE WHEN la > lb THEN 1.0::DOUBLE ELSE exp(1 - lb::DOUBLE / la) END * exp(g / 4) END, 4) AS bleu_4,
  round(100 * CASE WHEN s[1] = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * s[1] / (la + lb) END, 4) AS rouge_1,
  round(100 * CASE WHEN s[2] = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * s[2] / (la + lb - 2) END, 4) AS rouge_2 FROM l""")
def answer_similarity(spark, sf_dir):
    """How like each turn is to the one before it."""
    return similarity.text_similarity(_turns(spark, sf_dir), "next_text", "text").select("conv_id", "turn", "bleu_4", "rouge_1", "rouge_2")


@_query(None)
def answer_subsequence(spark, sf_dir):
    """The same by longest common subsequences, for which the tests have a table over all places."""
    return similarity.text_similarity(_turns(spark, sf_dir), "next_text", "text").select("conv_id", "turn", "rouge_l")


def _candidates(spark, sf_dir: str) -> DataFrame:
    """Of each turn with a next one: that one (kind 1), and the next one of the following turn of all (kind 0), in parts.

    An answer's words from the third on are as likely after any prompt, so the two candidates that share an answer share
    the row of these words (part 0, id answer); their own rows (part 1) have its first two words."""
    turns = _turns(spark, sf_dir).where("text is not null")
    tail = F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2))
    turns = turns.withColumn("w", likelihood.words(F.col("text"))).select("conv_id", "turn", tail.alias("before"), likelihood.words(F.col("next_text")).alias("said"))
    turns = _stored(turns.withColumn("answer", F.monotonically_increasing_id()))
    first, rest = F.slice("said", 1, 2).alias("said"), F.slice("said", 3, F.greatest(F.size("said") - 2, F.lit(0))).alias("said")
    own = turns.select("conv_id", "turn", F.lit(1).alias("kind"), "answer", "before", first)
    other = turns.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.lit(0).alias("kind"), "answer", first)
    other = turns.select("conv_id", "turn", "before").join(other, ["conv_id", "turn"])
    heads = own.unionByName(other).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.lit(1))
    rests = turns.select(F.col("answer").alias("id"), F.lit(0).alias("part"), first.alias("before"), rest)
    return _stored(heads.unionByName(rests, allowMissingColumns=True))


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SCORES = f"""WITH {_PAIRS}, w AS (SELECT {_WORDS.format("text")} AS w FROM documents), c1 AS (SELECT g, count(*) AS c FROM (SELECT unnest(w) AS g FROM w) GROUP BY 1),
c2 AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM w) GROUP BY 1),
c3 AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w) GROUP BY 1), n AS (SELECT sum(c)::DOUBLE AS n FROM c1),
k AS (SELECT conv_id, turn, b, 1 AS kind, a FROM p UNION ALL SELECT x.conv_id, x.turn, x.b, 0, y.a FROM p x JOIN p y ON y.conv_id = x.conv_id + 1 AND y.turn = x.turn),
t AS (SELECT conv_id, turn, kind, {_WORDS.format("b")}[-2:] AS h, {_WORDS.format("a")} AS s FROM k),
e AS (SELECT conv_id, turn, kind, list_concat(h, s) AS u, unnest(range(len(h) + 1, len(h) + len(s) + 1)) AS i FROM t),
g AS (SELECT conv_id, turn, kind, u[i] AS g1, CASE WHEN i > 1 THEN array_to_string(u[i - 1:i], ' ') END AS g2, CASE WHEN i > 1 THEN u[i - 1] END AS h2, CASE WHEN i > 2 THEN array_to_string(u[i - 2:i], ' ') END AS g3, CASE WHEN i > 2 THEN array_to_string(u[i - 2:i - 1], ' ') END AS h3 FROM e),
q AS (SELECT g.*, coalesce(a.c / n, 1 / (n + 1)) AS p1, b.c AS b, bh.c AS bh, d.c AS d, dh.c AS dh
  FROM g, n LEFT JOIN c1 a ON a.g = g1 LEFT JOIN c2 b ON b.g = g2 LEFT JOIN c1 bh ON bh.g = h2 LEFT JOIN c3 d ON d.g = g3 LEFT JOIN c2 dh ON dh.g = h3),
r AS (SELECT *, CASE WHEN b IS NOT NULL THEN b / bh WHEN g2 IS NOT NULL THEN 0.4::DOUBLE * p1 ELSE p1 END AS p2 FROM q),
z AS (SELECT *, ln(CASE WHEN d IS NOT NULL THEN d / dh WHEN g3 IS NOT NULL THEN 0.4::DOUBLE * p2 ELSE p2 END) AS lp FROM r),
f AS (SELECT conv_id, turn, kind, count(*) AS n_words, round(avg(lp), 6) AS score FROM z GROUP BY ALL)"""


def _stored(df: DataFrame) -> DataFrame:
    """The same rows from a folder of their own, written once."""
    folder = checkpoint_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _likelihood(spark, sf_dir: str) -> DataFrame:
    parts = _candidates(spark, sf_dir)
    # of the model, what the candidates ask for is kept, written once for all that reads it
    model = _stored(likelihood.model_for(_t(spark, sf_dir, "documents"), "text", parts, "before", "said"))
    found = likelihood.candidate_likelihood(parts, ["part", "id"], "before", "said", model)
    found = _stored(found.select("part", "id", "n_words", F.coalesce(F.col("score") * F.col("n_words"), F.lit(0.0)).alias("log_p")))
    rests = found.where("part = 0").select(F.col("id").alias("answer"), F.col("n_words").alias("n_rest"), F.col("log_p").alias("rest"))
    heads = parts.where("part = 1").select("id", "conv_id", "turn", "kind", "answer").join(found.where("part = 1"), "id").join(rests, "answer")
    n = F.sum(F.col("n_words") + F.col("n_rest"))
    return heads.groupBy("conv_id", "turn", "kind").agg(n.alias("n_words"), F.round(F.sum(F.col("log_p") + F.col("rest")) / n, 6).alias("score")).where("n_words > 0")


@_query(f"{_SCORES} SELECT * FROM f")
def answer_likelihood(spark, sf_dir):
    """How likely each turn's answer, and another conversation's, is by a model of the documents' words."""
    return _likelihood(spark, sf_dir)


@_query(f"""{_SCORES}, o AS (SELECT kind, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM f)
SELECT count(*) FILTER (WHERE kind = 1) AS n_pos, count(*) FILTER (WHERE kind = 0) AS n_neg,
  round((sum(r) FILTER (WHERE kind = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 9) AS auc FROM o""")
def likelihood_auc(spark, sf_dir):
    """How well the likelihood tells a turn's own answer from another's."""
    found = metrics.auc(_stored(_likelihood(spark, sf_dir)), "kind", "score")
    return found.withColumn("auc", F.round("auc", 9))
