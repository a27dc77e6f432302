"""Queries of the curation and evaluation operators over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.functions import extract as X
from evidentia.operators import aggregates as A
from evidentia.operators import joins as J
from evidentia.operators import metrics as M
from evidentia.operators import progress as P
from evidentia.operators import reshape as R
from evidentia.operators import rules as L
from evidentia.operators import sampling as S
from evidentia.operators import sets as U
from evidentia.plans import curation as plans
from evidentia.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _QUERIES.items() if v[1]}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by their keys: much work a row, few bytes, so that a scan may read all in one task."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def _sha(key: str, digits: int = 8) -> str:
    """The SQL of a key's bucket of 100."""
    return f"(CAST('0x' || substr(sha1({key}), 1, {digits}) AS BIGINT) % 100)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and label with its tri-state."""
    long = R.unpivot(_labelled(spark, sf_dir), ["doc_id", "lang", "source", "n_chars"], ["quality", "toxic"])
    return long.withColumn("state", C.tri_state(F.col("value"))).drop("value")


_KINDS = """kinds AS (
  SELECT doc_id, lang, source, n_chars, kind, CASE WHEN v = 1 THEN 'present' WHEN v = 0 THEN 'absent' ELSE 'unknown' END AS state
  FROM (SELECT d.doc_id, lang, source, n_chars, 'quality' AS kind, quality AS v FROM documents d LEFT JOIN labels l USING (doc_id)
        UNION ALL SELECT d.doc_id, lang, source, n_chars, 'toxic', toxic FROM documents d LEFT JOIN labels l USING (doc_id)))"""

# Classification metrics


@_query("""
WITH p AS (SELECT lang, quality = 1 AS gold, n_chars >= 700 AS pred FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp,
  count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn FROM p GROUP BY lang),
t AS (SELECT * FROM c UNION ALL SELECT 'all', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(tn)::BIGINT FROM c)
SELECT lang, tp, fp, fn, tn, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
  tn::DOUBLE / nullif(tn + fp, 0) AS specificity, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM t""")
def confusion_by_lang(spark, sf_dir):
    rows = _kinds(spark, sf_dir).where("kind = 'quality' and state <> 'unknown'")
    cell = M.outcome(F.col("state") == "present", F.col("n_chars") >= 700, policy="strict")
    counts = M.confusion_counts(rows, cell, ["lang"])
    every = M.binary_metrics(counts).unionByName(M.micro(counts).withColumn("lang", F.lit("all")))
    return every.select("lang", *M.CELLS, "precision", "recall", "specificity", "f1")


_POLICY_BUCKET = _sha("CAST(doc_id AS VARCHAR) || '::' || kind")


@_query(f"""
WITH {_KINDS},
p AS (SELECT kind, state = 'present' AS gold, CASE WHEN h < 20 THEN NULL ELSE n_chars % 2 = 0 END AS pred, h >= 10 AS parsed, h >= 35 AS ok
  FROM (SELECT *, {_POLICY_BUCKET} AS h FROM kinds WHERE state <> 'unknown')),
x AS (SELECT kind, CASE WHEN NOT parsed THEN u WHEN NOT ok AND policy <> 'relaxed' THEN o WHEN pred IS NULL THEN m
    WHEN gold AND pred THEN 'tp' WHEN gold THEN 'fn' WHEN pred THEN 'fp' ELSE 'tn' END AS cell, policy
  FROM (SELECT *, CASE WHEN policy IN ('lenient', 'general') THEN NULL WHEN gold THEN 'fn' WHEN policy = 'joint' THEN 'tn' ELSE 'fp' END AS u,
      CASE WHEN gold THEN 'fn' WHEN policy IN ('strict') THEN 'fp' ELSE 'tn' END AS o,
      CASE WHEN gold THEN 'fn' WHEN policy IN ('strict', 'relaxed') THEN 'fp' ELSE 'tn' END AS m
    FROM p, (VALUES ('strict'), ('lenient'), ('joint'), ('relaxed'), ('general')) AS q(policy)))
SELECT policy, kind, count(*) FILTER (cell = 'tp') AS tp, count(*) FILTER (cell = 'fp') AS fp, count(*) FILTER (cell = 'fn') AS fn, count(*) FILTER (cell = 'tn') AS tn
FROM x GROUP BY policy, kind""")
def confusion_policies(spark, sf_dir):
    h = C.sha1_bucket(C.key_of(F.col("doc_id"), F.col("kind")))
    rows = _kinds(spark, sf_dir).where("state <> 'unknown'").withColumn("h", h)
    gold, predicted = F.col("state") == "present", F.when(F.col("h") >= 20, F.col("n_chars") % 2 == 0)
    cells = F.array(*[F.struct(F.lit(p).alias("policy"), M.outcome(gold, predicted, policy=p, parsed=F.col("h") >= 10, right_target=F.col("h") >= 35).alias("cell")) for p in M.POLICIES])
    long = rows.select("kind", F.explode(cells).alias("c")).select("kind", "c.*")
    return M.confusion_counts(long, F.col("cell"), ["policy", "kind"])


_CUTS = "CASE WHEN n_chars < 600 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 4000 THEN 3 ELSE 4 END"
_GRID = f"""g AS (SELECT {_CUTS} AS gold, least(4, greatest(0, {_CUTS} + CASE WHEN {_sha("CAST(doc_id AS VARCHAR)")} < 30 THEN 1 WHEN {_sha("CAST(doc_id AS VARCHAR)")} < 45 THEN -1 ELSE 0 END)) AS pred FROM documents),
m AS (SELECT a.i::INTEGER AS gold, b.i::INTEGER AS predicted, count(g.gold) AS n FROM range(5) a(i), range(5) b(i) LEFT JOIN g ON g.gold = a.i AND g.pred = b.i GROUP BY 1, 2)"""


def _matrix(spark, sf_dir):
    grade = C.bucket(F.col("n_chars"), ([("<", 600, 0), ("<", 1000, 1), ("<", 2000, 2), ("<", 4000, 3)], 4), missing=None).cast("int")
    h = C.sha1_bucket(F.col("doc_id").cast("string"))
    off = F.when(h < 30, 1).when(h < 45, -1).otherwise(0)
    rows = _t(spark, sf_dir, "documents").select(grade.alias("g"), F.least(F.lit(4), F.greatest(F.lit(0), grade + off)).alias("p"))
    return M.confusion_matrix(rows, F.col("g"), F.col("p"), range(5))


@_query(f"WITH {_GRID} SELECT * FROM m")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@_query(f"""WITH {_GRID}, s AS (SELECT gold AS label, sum(n)::BIGINT AS support, (sum(n) FILTER (gold = predicted))::BIGINT AS tp FROM m GROUP BY 1),
c AS (SELECT predicted AS label, sum(n)::BIGINT AS called FROM m GROUP BY 1)
SELECT label, support, called, tp, coalesce(tp::DOUBLE / nullif(called, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce((2 * tp)::DOUBLE / nullif(support + called, 0), 0) AS f1 FROM s JOIN c USING (label)""")
def multiclass_metrics(spark, sf_dir):
    return M.class_metrics(_matrix(spark, sf_dir)).select("label", "support", "called", "tp", "precision", "recall", "f1")


@_query(f"""WITH {_GRID}, p AS (SELECT *, sum(n) OVER (PARTITION BY gold) AS r, sum(n) OVER (PARTITION BY predicted) AS c, sum(n) OVER () AS t FROM m),
f AS (SELECT gold AS label, 2 * sum(n) FILTER (gold = predicted) / nullif(sum(n) + (SELECT sum(n) FROM m m2 WHERE m2.predicted = m.gold), 0)::DOUBLE AS f1 FROM m GROUP BY gold)
SELECT round_even(1 - sum((gold - predicted) * (gold - predicted) / 16.0::DOUBLE * n) / sum((gold - predicted) * (gold - predicted) / 16.0::DOUBLE * r::DOUBLE * c / t), 9)::DOUBLE AS qwk,
  round_even((sum(n) FILTER (gold = predicted))::DOUBLE / sum(n), 9)::DOUBLE AS accuracy,
  (SELECT round_even(count(*) FILTER (f1 > 0) / sum(1 / f1) FILTER (f1 > 0), 9)::DOUBLE FROM f) AS harmonic_f1 FROM p""")
def kappa_and_harmonic(spark, sf_dir):
    matrix = _matrix(spark, sf_dir)
    parts = [M.weighted_kappa(matrix, 5), M.accuracy(matrix).select("accuracy"), M.harmonic_f1(M.class_metrics(matrix))]
    tagged = [p.select(F.bround(F.col(p.columns[0]), 9).alias(p.columns[0])) for p in parts]
    return U.tagged_union(dict(zip("abc", tagged, strict=True))).agg(*[F.max(n).alias(n) for n in ("qwk", "accuracy", "harmonic_f1")])


@_query("""
WITH j AS (SELECT lang, quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0::DOUBLE AS k FROM j)
SELECT lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
  round_even((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 9)::DOUBLE AS auc
FROM r GROUP BY lang""")
def auc_tie_avg(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null")
    return M.auc(rows, "quality", "n_chars", ["lang"]).withColumn("auc", F.bround("auc", 9))


@_query("""SELECT o_orderpriority, count(*) AS n, round_even(avg(abs(o_totalprice - 150000)), 4)::DOUBLE AS mae, round_even(avg(abs(o_totalprice - 150000) / nullif(o_totalprice, 0)), 6)::DOUBLE AS mape
FROM orders GROUP BY 1""")
def mae_mape(spark, sf_dir):
    out = M.numeric_errors(_t(spark, sf_dir, "orders"), F.col("o_totalprice"), F.lit(150000.0), ["o_orderpriority"])
    return out.select("o_orderpriority", "n", F.bround("mae", 4).alias("mae"), F.bround("mape", 6).alias("mape"))


@_query("""
WITH p AS (SELECT kind, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn
  FROM (SELECT kind, state = 'present' AS g, n_chars >= 1000 AS p FROM kinds WHERE state <> 'unknown') GROUP BY kind),
m AS (SELECT (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM p)
SELECT round_even(avg(f1), 9)::DOUBLE AS macro_f1, round_even(avg(recall), 9)::DOUBLE AS macro_recall FROM m""".replace("WITH p", "WITH " + _KINDS + ", p"))
def macro_metrics(spark, sf_dir):
    rows = _kinds(spark, sf_dir).where("state <> 'unknown'")
    cell = M.outcome(F.col("state") == "present", F.col("n_chars") >= 1000, policy="strict")
    found = M.macro(M.binary_metrics(M.confusion_counts(rows, cell, ["kind"])), ["f1", "recall"])
    return found.select(F.bround("macro_f1", 9).alias("macro_f1"), F.bround("macro_recall", 9).alias("macro_recall"))


# Projections, buckets and rules


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_projection_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "lang", "n_chars")


@_query("""
SELECT CASE WHEN q <= 0 THEN 'none' WHEN q <= 3 THEN 'few' WHEN q <= 10 THEN 'some' ELSE 'many' END AS four,
  CASE WHEN q <= 0 THEN NULL WHEN q <= 1 THEN 'single' WHEN q <= 5 THEN 'few' ELSE 'many' END AS three,
  CASE WHEN q <= 0 THEN '未见' WHEN q <= 3 THEN '少量' WHEN q <= 10 THEN '数处' WHEN q <= 20 THEN '较多' ELSE '大量' END AS five, count(*) AS n
FROM (SELECT l_quantity AS q FROM lineitem) GROUP BY 1, 2, 3""")
def bucket_counts(spark, sf_dir):
    q = F.col("l_quantity")
    rows = _t(spark, sf_dir, "lineitem").select(C.bucket(q, C.COUNT_FOUR).alias("four"), C.bucket(q, C.COUNT_THREE).alias("three"), C.bucket(q, C.COUNT_FIVE).alias("five"))
    return A.counter(rows, ["four", "three", "five"])


@_query("SELECT l_orderkey, l_linenumber, round_even(greatest(least(1.0::DOUBLE, l_quantity / 8.0::DOUBLE), least(1.0::DOUBLE, l_extendedprice / 1500.0::DOUBLE)), 6)::DOUBLE AS confidence FROM lineitem WHERE l_quantity < 8")
def confidence_linear(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").where("l_quantity < 8")
    return rows.select("l_orderkey", "l_linenumber", C.linear_confidence(F.col("l_quantity"), F.col("l_extendedprice")).alias("confidence"))


@_query("""
SELECT floor(10 * greatest(0, least(1, ln(1 + l_extendedprice / 5000) / ln(11))) * greatest(0, least(1, ln(1 + l_quantity) / ln(21))))::BIGINT AS tenth,
  CASE WHEN b < 9 THEN '周边部' WHEN b < 11 THEN '中周部' WHEN b < 13 THEN '后极部' ELSE '黄斑区' END AS band, count(*) AS n
FROM (SELECT *, ln(1 + l_extendedprice) + 2 * ln(1 + l_quantity) AS b FROM lineitem) GROUP BY 1, 2""")
def confidence_and_burden(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    rows = _t(spark, sf_dir, "lineitem").select(F.floor(10 * C.log_confidence(quantity, price, 5000.0)).alias("tenth"), C.burden_band(price, quantity).alias("band"))
    return A.counter(rows, ["tenth", "band"])


@_query("""
WITH s AS (SELECT doc_id, kind, state, source, n_chars, state = 'present' AND source IN ('src0', 'src1', 'src2') AND n_chars < 2000 AS a, state = 'present' AND n_chars < 600 AS b FROM kinds)
SELECT doc_id, kind, CASE WHEN a OR b THEN 'unknown' ELSE state END AS state,
  array_to_string(list_filter(CASE WHEN a AND b THEN ['too_short', 'weak_source'] WHEN a THEN ['weak_source'] WHEN b THEN ['too_short'] ELSE CAST([] AS VARCHAR[]) END, lambda x: TRUE), ',') AS flags FROM s""".replace("WITH s", "WITH " + _KINDS + ", s"))
def rule_flags(spark, sf_dir):
    present = F.col("state") == "present"
    rules = [
        L.Rule("weak_source", present & F.col("source").isin("src0", "src1", "src2") & (F.col("n_chars") < 2000), {"state": F.lit("unknown")}),
        L.Rule("too_short", present & (F.col("n_chars") < 600), {"state": F.lit("unknown")}),
    ]
    out = L.apply_rules(_kinds(spark, sf_dir), rules)
    return out.select("doc_id", "kind", "state", F.array_join("flags", ",").alias("flags"))


@_query("""
SELECT doc_id, kind, CASE WHEN hit THEN 'unknown' ELSE state END AS state, CASE WHEN hit THEN state END AS raw_state, CASE WHEN hit THEN source END AS raw_source,
  CASE WHEN hit THEN 'short::' || lang END AS suppressed_reason
FROM (SELECT *, state = 'present' AND n_chars < 800 AS hit FROM kinds)""".replace("\nSELECT doc_id", "\nWITH " + _KINDS + "\nSELECT doc_id", 1))
def suppression_keeps_raw(spark, sf_dir):
    out = L.suppress(_kinds(spark, sf_dir), (F.col("state") == "present") & (F.col("n_chars") < 800), "state", "source", C.key_of(F.lit("short"), F.col("lang")))
    return out.select("doc_id", "kind", "state", "raw_state", "raw_source", "suppressed_reason")


@_query("""
SELECT doc_id, CASE WHEN quality IS NULL THEN 'Step1' WHEN toxic = 1 AND quality = 0 THEN 'Step2' WHEN toxic = 1 THEN 'Step3' WHEN n_chars > 5000 THEN 'Step4' WHEN quality = 1 THEN 'Step5' END AS step,
  quality IS NULL OR n_chars < 300 AS limited FROM documents LEFT JOIN labels USING (doc_id)""")
def decision_list_steps(spark, sf_dir):
    limited = {"limited": F.col("quality").isNull() | (F.col("n_chars") < 300)}
    steps = [("Step1", F.col("quality").isNull(), {}), ("Step2", (F.col("toxic") == 1) & (F.col("quality") == 0), {}), ("Step3", F.col("toxic") == 1, {}), ("Step4", F.col("n_chars") > 5000, {}), ("Step5", F.col("quality") == 1, {})]
    return _labelled(spark, sf_dir).select("doc_id", L.decision_list(steps, limited).alias("d")).select("doc_id", "d.*")


@_query("""
WITH e AS (SELECT doc_id, CASE WHEN state = 'absent' THEN 'absent' WHEN state = 'present' AND source IN ('src1', 'src3') THEN 'strong' WHEN state = 'present' AND n_chars / 4000.0 >= 0.5 THEN 'strong' WHEN state = 'present' THEN 'weak' ELSE 'unknown' END AS s,
  CASE WHEN n_chars <= 0 THEN 'none' WHEN n_chars < 300 THEN 'small' WHEN n_chars < 1500 THEN 'medium' ELSE 'large' END AS a FROM kinds),
p AS (SELECT doc_id, sum(CASE WHEN s = 'strong' THEN CASE a WHEN 'large' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END WHEN s = 'weak' THEN 1 ELSE 0 END)::BIGINT AS points FROM e GROUP BY doc_id)
SELECT doc_id, points, CASE WHEN points = 0 THEN 'none' WHEN points <= 2 THEN 'light' WHEN points <= 5 THEN 'moderate' ELSE 'heavy' END AS burden FROM p""".replace("WITH e", "WITH " + _KINDS + ", e"))
def evidence_burden(spark, sf_dir):
    strength = L.evidence_strength(F.col("state"), F.col("source"), ["src1", "src3"], F.col("n_chars") / 4000.0)
    return L.burden(_kinds(spark, sf_dir), "doc_id", strength, C.bucket(F.col("n_chars"), C.AREA_FIXED))


@_query("""
SELECT doc_id, bool_or(state = 'present' AND n_chars > 500) AS usable_a, bool_or(state <> 'unknown') AS usable_b FROM kinds GROUP BY doc_id""".replace("\nSELECT doc_id", "\nWITH " + _KINDS + "\nSELECT doc_id", 1))
def usability_flags(spark, sf_dir):
    return L.usability(_kinds(spark, sf_dir), "doc_id", {"usable_a": (F.col("state") == "present") & (F.col("n_chars") > 500), "usable_b": F.col("state") != "unknown"})


@_query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 3 AS b, (o_orderkey // 4) % 5 - (o_orderkey // 4) % 5 * (o_custkey % 2) AS c, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 0 END AS d FROM orders),
t AS (SELECT *, a + b + c + d AS total, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS k,
  list_sort([{'v': -a, 'i': 0, 'q': 'ST'}, {'v': -b, 'i': 1, 'q': 'SN'}, {'v': -c, 'i': 2, 'q': 'IT'}, {'v': -d, 'i': 3, 'q': 'IN'}]) AS l FROM v),
p AS (SELECT *, list_transform(list_filter(l, lambda x: -x.v >= greatest(1, total // 4)), lambda x: x.q) AS top FROM t)
SELECT o_orderkey, CASE WHEN total = 0 THEN NULL WHEN k = 4 AND least(a, b, c, d) >= greatest(1, total // 6) THEN '4Q' WHEN k = 1 THEN top[1] || '_only' WHEN len(top) = 1 THEN top[1] || '_pred' ELSE array_to_string(top[1:3], '+') END AS place FROM p""")
def quadrant_places(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fifth = F.floor(k / 4) % 5
    counts = {"ST": k % 4, "SN": c % 3, "IT": fifth - fifth * (c % 2), "IN": F.when(k % 7 == 0, 9).otherwise(0)}
    return orders.select("o_orderkey", C.quadrant_code(counts).alias("place"))


# Joins


@_query("SELECT d.doc_id, source, quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.lang = 'en'")
def conditional_left_enrich(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return J.enrich(docs, _t(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], keep=F.col("lang") == "en").select("doc_id", "source", "quality", "found")


@_query("""
SELECT o_orderkey, coalesce(a.v, b.v, -1)::DOUBLE AS v, CASE WHEN a.v IS NOT NULL THEN 'items' WHEN b.v IS NOT NULL THEN 'account' ELSE 'missing' END AS origin
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON o_orderkey = l_orderkey
LEFT JOIN (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_acctbal > 0) b ON o_custkey = c_custkey""")
def priority_fallback_join(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("v"))
    first = J.first_of(orders, [("items", items)], ["o_orderkey"], "v")
    account = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("__a"))
    both = first.join(account, "o_custkey", "left")
    origin = F.when(F.col("v").isNotNull(), "items").when(F.col("__a").isNotNull(), "account").otherwise("missing")
    return both.select("o_orderkey", F.coalesce("v", "__a", F.lit(-1.0)).alias("v"), origin.alias("origin"))


@_query("SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def matched_and_unmatched(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    hit, missed = J.matched_and_not(_t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])
    return hit.groupBy("c_custkey").agg(F.count("*").alias("n")).unionByName(missed.withColumn("n", F.lit(0).cast("bigint")))


@_query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_holdout(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    return J.excluding(_t(spark, sf_dir, "documents").select("doc_id", "lang"), labels.where("toxic = 1"), labels.where("quality = 0"), on=["doc_id"])


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_membership(spark, sf_dir):
    return J.including(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@_query("""
SELECT k.doc_id, k.kind, k.state, k.state = 'absent' AND EXISTS (SELECT 1 FROM kinds c WHERE c.doc_id = k.doc_id AND c.state = 'present' AND c.kind = CASE k.kind WHEN 'quality' THEN 'toxic' ELSE 'quality' END) AS is_hard
FROM kinds k""".replace("\nSELECT k.", "\nWITH " + _KINDS + "\nSELECT k.", 1))
def confounder_hard_negative(spark, sf_dir):
    out = J.hard_negatives(_kinds(spark, sf_dir), "doc_id", "kind", "state", {"quality": ["toxic"], "toxic": ["quality"]})
    return out.select("doc_id", "kind", "state", "is_hard")


@_query("""
WITH c AS (SELECT source AS name, avg(quality)::DOUBLE AS q, avg(toxic)::DOUBLE AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1), b AS (SELECT q, t FROM c WHERE name = 'src0')
SELECT name, round_even(c.q - b.q, 9)::DOUBLE AS delta_q, round_even(c.t - b.t, 9)::DOUBLE AS delta_t FROM c, b""")
def baseline_cross_compare(spark, sf_dir):
    per = _labelled(spark, sf_dir).where("quality is not null").groupBy(F.col("source").alias("name")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    out = J.against_baseline(per, per.where("name = 'src0'"), ["q", "t"])
    return out.select("name", F.bround("delta_q", 9).alias("delta_q"), F.bround("delta_t", 9).alias("delta_t"))


@_query("""
WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, a.n AS all_n, b.n AS labelled_n, b.n - a.n AS delta_n FROM a JOIN b USING (lang)""")
def model_compare(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return J.compare_models(A.counter(docs, ["lang"]), A.counter(J.including(docs, _t(spark, sf_dir, "labels"), ["doc_id"]), ["lang"]), ["lang"], ["n"], ("all", "labelled"))


@_query("""
SELECT doc_id::VARCHAR || CASE WHEN copy > 0 THEN '__aug' || copy ELSE '' END AS doc_id, p AS path, copy::INTEGER AS copy
FROM (SELECT doc_id, unnest(list_concat(['base/' || doc_id], coalesce(c.paths, []))) AS p, unnest(range(0, 1 + coalesce(len(c.paths), 0))) AS copy
  FROM documents LEFT JOIN (SELECT doc_id, ['a/' || doc_id, 'b/' || doc_id] AS paths FROM labels WHERE quality = 0) c USING (doc_id))""")
def augment_explode(spark, sf_dir):
    text = F.col("doc_id").cast("string")
    copies = _t(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.array(F.concat(F.lit("a/"), text), F.concat(F.lit("b/"), text)).alias("paths"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("base/"), text).alias("path"))
    return J.expand_copies(docs, "doc_id", copies, ["doc_id"], "paths", "path").select("doc_id", "path", "copy")


# Aggregates


@_query("SELECT lang, source, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def counter_composite(spark, sf_dir):
    return A.counter(_labelled(spark, sf_dir), ["lang", "source", "quality"])


@_query("SELECT lang, source, count(*) AS n, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)")
def counter_rollup(spark, sf_dir):
    return A.counter_with_totals(_t(spark, sf_dir, "documents"), ["lang", "source"])


@_query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS entities FROM events GROUP BY 1")
def distinct_groups(spark, sf_dir):
    return A.distinct_per_group(_t(spark, sf_dir, "events"), ["event_type"], "user_id")


@_query("""SELECT lang, grouping(lang) = 1 AS overall, count(*) AS n, sum((n_chars > 1000)::INT)::DOUBLE / greatest(1, count(*)) AS is_long, sum(coalesce(toxic = 1, FALSE)::INT)::DOUBLE / greatest(1, count(*)) AS is_toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""")
def rate_grouping_sets(spark, sf_dir):
    return A.rates(_labelled(spark, sf_dir), "lang", {"is_long": F.col("n_chars") > 1000, "is_toxic": F.col("toxic") == 1})


@_query("""
WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN value > 100 THEN 'present' WHEN value > 50 THEN 'absent' ELSE 'unknown' END AS s FROM events),
p AS (SELECT user_id, event_type, count(*) AS c, count(DISTINCT s) AS d, coalesce(max(CASE WHEN s = 'present' THEN s END), arg_min(s, event_id)) AS s FROM e GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || s, ',' ORDER BY event_type) AS states, count(*) FILTER (d > 1) AS conflicts, sum(c - 1)::BIGINT AS duplicates FROM p GROUP BY 1""")
def entity_regroup(spark, sf_dir):
    state = F.when(F.col("value") > 100, "present").when(F.col("value") > 50, "absent").otherwise("unknown")
    out = A.entity_map(_t(spark, sf_dir, "events").withColumn("s", state), "user_id", "event_type", "s", "event_id")
    joined = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("user_id", joined.alias("states"), "conflicts", "duplicates")


@_query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 7")
def most_common(spark, sf_dir):
    return A.most_common(_t(spark, sf_dir, "documents"), "source", 7)


@_query("""
WITH b AS (SELECT lang, CASE WHEN n_chars <= 0 THEN 'none' WHEN n_chars < 300 THEN 'small' WHEN n_chars < 1500 THEN 'medium' ELSE 'large' END AS band FROM documents),
c AS (SELECT lang, band, count(*) AS n FROM b GROUP BY GROUPING SETS ((lang, band), (band)))
SELECT lang, band, n, n::DOUBLE / sum(n) OVER (PARTITION BY lang) AS share FROM c""")
def band_shares(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("lang", C.bucket(F.col("n_chars"), C.AREA_FIXED).alias("band"))
    return A.shares(rows, ["lang"], "band")


@_query("""
WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY 1)
SELECT lang, len(v) AS n, v[round_even(0.5::DOUBLE * (len(v) - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.9::DOUBLE * (len(v) - 1), 0)::BIGINT + 1] AS p90, v[round_even(0.99::DOUBLE * (len(v) - 1), 0)::BIGINT + 1] AS p99,
  list_min(v) AS min, list_max(v) AS max, round_even(list_avg(v), 6)::DOUBLE AS mean FROM s""")
def nearest_rank_summary(spark, sf_dir):
    return A.summary(_t(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars").withColumn("mean", F.bround("mean", 6))


@_query("SELECT lang, round_even(quantile_cont(n_chars, 1.0 / 3)::DOUBLE, 6)::DOUBLE AS low, round_even(quantile_cont(n_chars, 2.0 / 3)::DOUBLE, 6)::DOUBLE AS high FROM documents GROUP BY 1")
def tertiles(spark, sf_dir):
    out = A.linear_quantiles(_t(spark, sf_dir, "documents"), ["lang"], "n_chars", (1 / 3, 2 / 3), ("low", "high"))
    return out.select("lang", F.bround("low", 6).alias("low"), F.bround("high", 6).alias("high"))


@_query("""
SELECT event_type, CASE WHEN value = 200 THEN 19 ELSE floor(value / 200 * 20)::INT END AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1, 2""")
def histogram_fixed(spark, sf_dir):
    return A.histogram(_t(spark, sf_dir, "events"), F.col("value"), 0.0, 200.0, 20, ["event_type"])


@_query("SELECT CASE WHEN q >= 40 THEN 4 WHEN q >= 30 THEN 3 WHEN q >= 20 THEN 2 WHEN q >= 10 THEN 1 ELSE 0 END AS band, count(*) AS n FROM (SELECT l_quantity AS q FROM lineitem WHERE l_quantity >= 0) GROUP BY 1")
def edge_histogram(spark, sf_dir):
    return A.edge_histogram(_t(spark, sf_dir, "lineitem"), F.col("l_quantity"), [0, 10, 20, 30, 40])


@_query("""
WITH t AS (SELECT lang, CASE WHEN count(*) < 25 THEN 0 ELSE list_sort(list(n_chars))[round_even(0.9::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] END::DOUBLE AS threshold FROM documents GROUP BY 1)
SELECT doc_id, lang, n_chars, threshold FROM documents JOIN t USING (lang) WHERE n_chars >= threshold""")
def group_percentile_filter(spark, sf_dir):
    out = A.above_group_percentile(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", 90)
    return out.select("doc_id", "lang", "n_chars", F.col("threshold").cast("double"))


# Splits, samples and mixes


@_query(f"SELECT doc_id, CASE WHEN {_sha('source || CAST(doc_id AS VARCHAR)', 8).replace('source || CAST(doc_id AS VARCHAR)', 'source || chr(58) || chr(58) || doc_id')} < 10 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return S.hash_split(docs, C.key_of(F.col("source"), F.col("doc_id")), 10).select("doc_id", "split")


@_query(f"SELECT doc_id, CASE WHEN source = 'src3' THEN 'val' WHEN {_sha('CAST(doc_id AS VARCHAR)', 12)} < 20 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_with_override(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return S.hash_split(docs, F.col("doc_id").cast("string"), 20, digits=12, override=F.when(F.col("source") == "src3", "val")).select("doc_id", "split")


@_query("SELECT event_id, user_id, CASE WHEN max((value > 150)::INT) OVER (PARTITION BY user_id) = 1 THEN 'val' ELSE 'train' END AS split FROM events")
def split_propagation(spark, sf_dir):
    return S.propagate_split(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", F.col("value") > 150).select("event_id", "user_id", "split")


_ORDER = "sha1('s1::' || CAST(doc_id AS VARCHAR)), doc_id"


def _order():
    return [C.stable_key(F.col("doc_id"), salt="s1"), F.col("doc_id")]


@_query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents) WHERE r <= 15")
def stable_shuffle_topn(spark, sf_dir):
    return S.top_n(_t(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], _order(), 15)


@_query(f"""SELECT doc_id, lang, unnest(range(0, ((200 - r) // m)::BIGINT + 1))::INTEGER AS cycle
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY lang) AS m FROM documents) WHERE r <= 200""")
def cyclic_take(spark, sf_dir):
    return S.cyclic_take(_t(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], _order(), 200)


@_query(f"""
WITH t AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'S0' WHEN quality = 0 THEN 'S1' ELSE 'S2' END AS tier FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, tier ORDER BY {_ORDER}) AS k FROM t),
p AS (SELECT *, CASE WHEN k <= CASE tier WHEN 'S0' THEN 30 WHEN 'S1' THEN 12 ELSE 18 END THEN 0 ELSE 1 END AS phase FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY phase, tier, k, {_ORDER}) AS n, count(*) OVER (PARTITION BY lang) AS m FROM p)
SELECT doc_id, lang, tier, phase, unnest(range(0, ((60 - n) // m)::BIGINT + 1))::INTEGER AS cycle FROM o WHERE n <= 60""")
def tier_mix_sample(spark, sf_dir):
    tier = L.tiered([("S0", F.col("quality") == 1), ("S1", F.col("quality") == 0), ("S2", F.lit(True))])
    rows = _labelled(spark, sf_dir).select("doc_id", "lang", tier.alias("tier"))
    out = S.tier_mix(rows, ["lang"], "tier", [("S0", 0.5), ("S1", 0.2), ("S2", 0.3)], _order(), 60)
    return out.select("doc_id", "lang", "tier", "phase", "cycle")


@_query(f"""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents)
WHERE CASE lang WHEN 'en' THEN r <= 100 WHEN 'de' THEN FALSE WHEN 'fr' THEN r <= 20 ELSE TRUE END""")
def step_budget_cap(spark, sf_dir):
    budgets = spark.createDataFrame([("en", 100), ("de", 0), ("fr", 20), ("es", None)], "lang string, budget int")
    return S.capped(_t(spark, sf_dir, "documents").select("doc_id", "lang"), budgets, "lang", _order()).select("doc_id", "lang")


@_query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE event_type = 'purchase'),
v AS (SELECT *, unnest(range(0, (6 - j) // k + 1)) AS p FROM e WHERE j <= 6),
q AS (SELECT *, p * k + j AS view_index, row_number() OVER (ORDER BY p, event_id) AS n FROM v)
SELECT user_id, event_id, p::INTEGER AS pass, view_index, max(view_index) OVER (PARTITION BY user_id) AS entity_views FROM q WHERE n <= 3000""")
def round_robin_views(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    return S.round_robin_views(rows, "user_id", [F.col("event_id")], 6, 3000)


@_query("SELECT user_id, event_type, arg_min(event_id, {'r': CASE WHEN value > 100 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END, 's': event_id}) AS event_id FROM events GROUP BY 1, 2")
def dedupe_best_tier(spark, sf_dir):
    rank = F.when(F.col("value") > 100, 0).when(F.col("value") > 50, 1).otherwise(2)
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return J.first_by(rows, ["user_id", "event_type"], [rank, F.col("event_id")]).select("user_id", "event_type", "event_id")


@_query(f"""
WITH l AS (SELECT doc_id, lang, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY {_ORDER}) AS k FROM l)
SELECT doc_id, lang, pos AS positive FROM r JOIN c USING (lang) WHERE k <= least(p, n)""")
def balanced_posneg(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null").select("doc_id", "lang", (F.col("quality") == 1).alias("positive"))
    return S.balanced(rows, ["lang"], F.col("positive"), _order())


@_query(f"""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents)
WHERE r <= CASE lang WHEN 'en' THEN 26 WHEN 'fr' THEN 25 WHEN 'de' THEN 25 WHEN 'es' THEN 25 ELSE 0 END""")
def stratified_budgets(spark, sf_dir):
    budgets = S.even_budgets(["en", "fr", "de", "es"], 101)
    return S.take_budgets(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", budgets, _order(), cyclic=False)


@_query("SELECT lang, count(*) AS available, least(count(*), 130) AS taken, greatest(0, 130 - count(*)) AS short FROM documents GROUP BY 1")
def shortage_report(spark, sf_dir):
    return S.shortage_report(_t(spark, sf_dir, "documents"), "lang", 130)


@_query(f"""
WITH l AS (SELECT doc_id, source, quality = 0 AS pos, row_number() OVER (PARTITION BY source ORDER BY quality = 0 DESC, {_ORDER}) AS e FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY {_ORDER}) AS k FROM l WHERE e = 1)
SELECT doc_id, source FROM r WHERE k <= CASE WHEN pos THEN 6 ELSE 4 END""")
def locked_sets(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null")
    return S.locked_sets(rows, F.col("quality") == 0, _order(), 6, 4, "source").select("doc_id", "source")


@_query(f"""
WITH l AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'positive' WHEN toxic = 1 THEN 'hard_negative' ELSE 'easy_negative' END AS role FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY role) AS m, CASE role WHEN 'positive' THEN 80 WHEN 'hard_negative' THEN 33 ELSE 67 END AS n FROM l)
SELECT doc_id, role, unnest(range(0, (n - k) // m + 1))::INTEGER AS cycle FROM r WHERE k <= n""")
def hard_negative_mix(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null").select("doc_id", "quality", "toxic")
    return S.hard_negative_mix(rows, F.col("quality") == 0, F.col("toxic") == 1, _order(), 80, 100).select("doc_id", "role", "cycle")


@_query("""
WITH c AS (SELECT source AS name, round_even(avg(quality), 9)::DOUBLE AS q, round_even(avg(toxic), 9)::DOUBLE AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT name, q, t, n FROM c WHERE q >= (SELECT q FROM c WHERE name = 'src0') - 0.1 AND n >= 5 ORDER BY q DESC, n DESC, name DESC LIMIT 1""")
def candidate_selection(spark, sf_dir):
    per = _labelled(spark, sf_dir).where("quality is not null").groupBy(F.col("source").alias("name")).agg(F.bround(F.avg("quality"), 9).alias("q"), F.bround(F.avg("toxic"), 9).alias("t"), F.count("*").alias("n"))
    beside = J.against_baseline(per, per.where("name = 'src0'"), ["q"])
    return S.select_candidate(beside, (F.col("q") >= F.col("base_q") - 0.1) & (F.col("n") >= 5), ["q", "n"]).select("name", "q", "t", "n")


@_query(f"""
WITH a AS (SELECT doc_id, 'gold' AS component FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY component) AS m, CASE component WHEN 'gold' THEN 280 ELSE 120 END AS n FROM a)
SELECT doc_id, component, unnest(range(0, (n - k) // m + 1))::INTEGER AS cycle FROM r WHERE k <= n""")
def union_tagged_mix(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels")
    return U.mixture([("gold", J.including(docs, labels.where("quality = 1"), ["doc_id"]), 0.7), ("rest", J.excluding(docs, labels, on=["doc_id"]), 0.3)], 400, _order()).select("doc_id", "component", "cycle")


@_query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 150), c AS (SELECT DISTINCT user_id FROM events WHERE value < 1)
SELECT 'buy' AS left, 'high' AS right, (SELECT count(*) FROM a JOIN b USING (user_id)) AS shared UNION ALL SELECT 'buy', 'low', (SELECT count(*) FROM a JOIN c USING (user_id)) UNION ALL SELECT 'high', 'low', (SELECT count(*) FROM b JOIN c USING (user_id))""")
def overlap_audit(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return U.overlap_audit({"buy": events.where("event_type = 'purchase'"), "high": events.where("value > 150"), "low": events.where("value < 1")}, "user_id")


@_query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS label FROM customer")
def later_source_wins(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer")
    return U.later_wins([customers.select("c_custkey", F.col("c_mktsegment").alias("label")), customers.where("c_acctbal < 0").select("c_custkey", F.lit("debt").alias("label"))], ["c_custkey"])


@_query(f"""
WITH c AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS m FROM documents), v AS (SELECT *, unnest(range(0, ceil(150.0 / m)::BIGINT))::INTEGER AS cycle FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, cycle ORDER BY sha1('z::' || cycle || '::' || doc_id), doc_id) AS k FROM v)
SELECT doc_id, lang, cycle FROM r WHERE cycle * m + k <= 150""")
def reshuffled_cycles(spark, sf_dir):
    return S.reshuffled_cycles(_t(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), [F.col("doc_id")], 150, "z")


@_query(f"""SELECT doc_id, lang, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, {_ORDER}) AS r FROM (
  SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'gold' WHEN toxic = 1 THEN 'odd' ELSE 'other' END AS rank, CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS p FROM documents LEFT JOIN labels USING (doc_id))) WHERE r <= 60""")
def priority_sample(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return S.priority_sample(rows, ["lang"], [("gold", F.col("quality") == 1), ("odd", F.col("toxic") == 1)], _order(), 60).select("doc_id", "lang", "rank")


@_query(f"""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents), (SELECT count(*) AS b FROM documents WHERE lang = 'es')
WHERE CASE lang WHEN 'es' THEN TRUE WHEN 'en' THEN r <= floor(b * 1.5) WHEN 'de' THEN r <= floor(b * 0.5) ELSE FALSE END""")
def ratio_caps(spark, sf_dir):
    return S.ratio_capped(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "es", [("en", 1.5), ("de", 0.5)], _order()).select("doc_id", "lang")


@_query(f"""
WITH r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY s) AS m, CASE s WHEN 1 THEN 46 ELSE 45 END AS n FROM (SELECT doc_id, quality AS s FROM labels JOIN documents USING (doc_id)))
SELECT doc_id, s AS quality, unnest(range(0, (n - k) // m + 1))::INTEGER AS cycle FROM r WHERE k <= n""")
def odd_aware_halves(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null").select("doc_id", "quality")
    return S.odd_aware_halves(rows, F.col("quality") == 1, _order(), 91)


@_query(f"""SELECT doc_id, lang, CASE WHEN r <= 5 THEN 'repair' ELSE 'anchor' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS r FROM documents)
WHERE lang = 'en' AND r <= 15 OR lang = 'de' AND r <= 5""")
def quotas_with_roles(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.quotas_with_roles(rows, "lang", ["doc_id"], [("en", "repair", 5), ("de", "repair", 5), ("en", "anchor", 10)], _order())


@_query("""SELECT * FROM (SELECT doc_id, n_chars, 'top' AS "end" FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT doc_id, n_chars, 'bottom' FROM documents ORDER BY n_chars, doc_id LIMIT 5)""")
def extreme_examples(spark, sf_dir):
    return S.extremes(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 5)


@_query("""SELECT l_returnflag, coalesce(sum(l_linenumber) FILTER (l_discount > 0.05), 0)::BIGINT AS high_l_linenumber, coalesce(sum(l_suppkey) FILTER (l_discount > 0.05), 0)::BIGINT AS high_l_suppkey,
  sum(l_linenumber)::BIGINT AS all_l_linenumber, sum(l_suppkey)::BIGINT AS all_l_suppkey FROM lineitem GROUP BY 1""")
def conditional_sums(spark, sf_dir):
    return A.conditional_sums(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linenumber", "l_suppkey"], {"high": F.col("l_discount") > 0.05, "all": F.lit(True)})


# Text, shapes and progress


@_query("""
SELECT event_id, json_valid(t) AS strict, regexp_extract(t, '(?s)\\{.*\\}') = props AS greedy_same, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'out: ' || props || ' end' ELSE props END AS t FROM events)""")
def json_extraction(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("out: "), F.col("props"), F.lit(" end"))).otherwise(F.col("props"))
    rows = _t(spark, sf_dir, "events").select("event_id", "props", t.alias("t"))
    doc = X.first_object(F.col("t"))
    return rows.select("event_id", X.is_strict_object(F.col("t")).alias("strict"), (X.greedy_object(F.col("t")) == F.col("props")).alias("greedy_same"), F.try_variant_get(doc, "$.k", "bigint").alias("k"))


@_query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey + 1) % 5 WHEN 1 THEN o_orderkey % 5 WHEN 2 THEN o_orderkey % 5 END::INTEGER AS graded, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 5 WHEN 1 THEN o_orderkey % 5 WHEN 2 THEN o_orderkey % 5 END::INTEGER AS training,
  o_orderkey % 4 < 2 AS forbidden, CASE WHEN o_orderkey % 4 = 3 THEN chr((65 + o_orderkey % 5)::INTEGER) END AS letter FROM orders""")
def grade_cascade(spark, sf_dir):
    k = F.col("o_orderkey")
    digit = (k % 5).cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("GRADE "), digit, F.lit(" then 【结论】 DR Grade "), ((k + 1) % 5).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("so grade "), digit))
        .when(k % 4 == 2, F.concat(F.lit('{"dr_grade": '), digit, F.lit("}")))
        .otherwise(F.concat(F.lit("Answer: ("), F.char((65 + k % 5).cast("int")), F.lit(")")))
    )
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    t = F.col("t")
    return rows.select("o_orderkey", X.grade(t).alias("graded"), X.grade(t, "training").alias("training"), X.has_forbidden(t).alias("forbidden"), X.letter(t).alias("letter"))


@_query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'A,B' ELSE '' END AS kinds FROM customer")
def key_value_block(spark, sf_dir):
    kinds = F.when(F.col("c_custkey") % 2 == 0, "B, A, NONE, A").otherwise("NONE")
    text = F.concat_ws("\n", F.concat(F.lit("name: "), F.col("c_name")), F.lit("no pair"), F.concat(F.lit("segment : "), F.col("c_mktsegment")), F.concat(F.lit("kinds:"), kinds))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", X.key_values(text).alias("m"))
    return rows.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.array_join(X.name_list(F.col("m")["kinds"]), ",").alias("kinds"))


@_query("SELECT source, count(*) AS n, avg((text LIKE '%!!%')::INT::DOUBLE) AS shouts, avg((text LIKE '%|%')::INT::DOUBLE) AS bars FROM documents GROUP BY 1")
def format_adherence(spark, sf_dir):
    return M.parse_rates(_t(spark, sf_dir, "documents"), {"shouts": F.contains("text", F.lit("!!")), "bars": F.contains("text", F.lit("|"))}, ["source"])


@_query("""
SELECT p_partkey, chr((65 + p_size % 4)::INTEGER) AS letter, 'A. w' || chr(10) || 'B. x' || chr(10) || 'C. y' || chr(10) || 'D. z' AS lines, 'part-' || lpad(p_partkey::VARCHAR, 7, '0') AS name FROM part""")
def option_letters(spark, sf_dir):
    options = F.array(*map(F.lit, "wxyz"))
    rows = _t(spark, sf_dir, "part")
    return rows.select("p_partkey", C.option_letter(options, F.element_at(options, F.col("p_size") % 4 + 1)).alias("letter"), C.option_lines(options).alias("lines"), R.padded_id(F.col("p_partkey"), 7, "part-").alias("name"))


@_query("SELECT conv_id, count(*) AS n_messages, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def conversation_messages(spark, sf_dir):
    packed = R.conversation(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda s, m: s + F.length(m["content"]))
    return packed.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"), chars.alias("n_chars"))


@_query("""
SELECT doc_id, 'Is the text good?' AS question, '{"doc_id":' || doc_id || ',"quality":' || coalesce(quality::VARCHAR, 'null') || '}' AS answer, 3::BIGINT AS turns FROM documents LEFT JOIN labels USING (doc_id)""")
def sft_pack(spark, sf_dir):
    answer = X.compact_json(F.struct("doc_id", "quality"))
    out = R.sft_rows(_labelled(spark, sf_dir), F.lit("Judge."), F.lit("Is the text good?"), answer, F.array(F.col("source")), ["doc_id", "lang"])
    return out.select("meta.doc_id", F.col("messages")[1]["content"].alias("question"), F.col("messages")[2]["content"].alias("answer"), F.size("messages").cast("bigint").alias("turns"))


@_query("""
WITH e AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE value > 120 GROUP BY 1, 2)
SELECT u.user_id, k AS event_type, coalesce(v, 0) AS v FROM (SELECT DISTINCT user_id FROM e) u, (VALUES ('click'), ('purchase'), ('view')) AS d(k) LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = k""")
def default_fill_domain(spark, sf_dir):
    found = _t(spark, sf_dir, "events").where("value > 120").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return R.complete(found, ["user_id"], "event_type", ["click", "purchase", "view"], {"v": F.lit(0.0)})


@_query("""
WITH r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events),
s AS (SELECT event_type, (count(*) - 1) / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0)::DOUBLE * 1e6 AS rate FROM r WHERE k <= 50 GROUP BY 1)
SELECT event_type, count(*) AS done, round_even(any_value(rate), 9)::DOUBLE AS rate, round_even(greatest(20000 - count(*), 0) / any_value(rate), 3)::DOUBLE AS eta_seconds FROM events JOIN s USING (event_type) GROUP BY 1""")
def throughput_eta(spark, sf_dir):
    out = P.throughput(_t(spark, sf_dir, "events").select("event_type", "ts"), ["event_type"], "ts", 20000)
    return out.select("event_type", "done", F.bround("rate", 9).alias("rate"), F.bround("eta_seconds", 3).alias("eta_seconds"))


@_query("""
SELECT user_id, arg_max(s, {'t': ts, 'r': CASE s WHEN 'error' THEN 2 WHEN 'done' THEN 1 ELSE 0 END}) AS status, max(ts) AS ts
FROM (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS s FROM events) GROUP BY 1""")
def latest_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    return P.latest_status(_t(spark, sf_dir, "events").select("user_id", "ts", status.alias("status")), "user_id", "ts", "status")


_CURATED = _KINDS + """, k AS (SELECT *, CASE WHEN state = 'present' AND n_chars < 400 THEN 'unknown' ELSE state END AS s2 FROM kinds),
t AS (SELECT doc_id, kind, s2 AS state, CASE WHEN s2 = 'present' THEN 'S0' WHEN s2 = 'absent' THEN 'S1' END AS tier, """ + _sha("source || '::' || doc_id") + """ < 20 AS v FROM k),
p AS (SELECT doc_id, kind, state, tier, CASE WHEN v THEN 'val' ELSE 'train' END AS split FROM t WHERE tier IS NOT NULL),
c AS (SELECT kind, least(count(*) FILTER (state = 'present'), count(*) FILTER (state <> 'present')) AS m FROM p WHERE split = 'train' GROUP BY 1),
r AS (SELECT p.*, m, row_number() OVER (PARTITION BY kind, split, state = 'present' ORDER BY sha1('r1::' || doc_id || '::' || kind), doc_id) AS n FROM p JOIN c USING (kind))"""


@_query(f"WITH {_CURATED} SELECT doc_id, kind, state, tier, split FROM r WHERE split = 'val' OR n <= m")
def curated_training_set(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = plans.facts(docs, _t(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])
    short = L.Rule("too_short", (F.col("state") == "present") & (F.col("n_chars") < 400), {"state": F.lit("unknown")})
    cleaned = plans.clean(rows, [[short]], [("S0", F.col("state") == "present"), ("S1", F.col("state") == "absent")])
    out = plans.training_and_validation(cleaned, "doc_id", C.key_of(F.col("source"), F.col("doc_id")), 20, "r1")
    return out.select("doc_id", "kind", "state", "tier", "split")


@_query(f"""
WITH {_KINDS}, x AS (SELECT unnest([300, 600, 1200]) AS cut), c AS (SELECT 'cut' || cut AS name, kind, count(*) FILTER (g AND n_chars >= cut) AS tp, count(*) FILTER (NOT g AND n_chars >= cut) AS fp, count(*) FILTER (g AND n_chars < cut) AS fn
  FROM (SELECT *, state = 'present' AS g FROM kinds WHERE state <> 'unknown'), x GROUP BY 1, 2),
m AS (SELECT name, round_even(avg((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0)), 9)::DOUBLE AS macro_f1, round_even(avg(tp::DOUBLE / nullif(tp + fn, 0)), 9)::DOUBLE AS macro_recall FROM c GROUP BY 1)
SELECT name, macro_f1, macro_recall FROM m WHERE macro_recall >= (SELECT macro_recall FROM m WHERE name = 'cut600') - 0.02 ORDER BY macro_f1 DESC, macro_recall DESC, name DESC LIMIT 1""")
def gated_candidate(spark, sf_dir):
    rows = _kinds(spark, sf_dir)
    scored = {f"cut{n}": plans.score(rows, F.col("n_chars") >= n, "kind") for n in (300, 600, 1200)}
    table = plans.candidate_metrics(scored).select("name", F.bround("macro_f1", 9).alias("macro_f1"), F.bround("macro_recall", 9).alias("macro_recall"))
    return plans.choose(table, table.where("name = 'cut600'"), plans.Gate())


@_query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def streamed_counts(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    # a stream reads folders or patterns, and the table may be one file
    events = monitor.stream_parquet(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema)
    return monitor.drained(monitor.counts_by_key(events, "event_type"), f"streamed_{uuid.uuid4().hex}", monitor.checkpoint_folder(spark))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    out = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


@_query("SELECT c_custkey, 'Customer ' || c_name || ' (' || c_mktsegment || ')' AS line, (c_nationkey + 1)::BIGINT AS n FROM customer")
def templates_and_deep_keys(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct(F.array(F.struct((F.col("c_nationkey") + 1).alias("n"))).alias("list")).alias("deep"), F.lit(1).alias("other")))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", X.rendered("Customer {name} ({segment})", name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("line"), doc.alias("doc"))
    return rows.select("c_custkey", "line", X.first_key("n", "missing")("doc").cast("bigint").alias("n"))
