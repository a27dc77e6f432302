"""Queries of buckets, words, choices, biomarkers, evidence groups, counters and repeated keys, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import aggregates as A
from evidentia.operators import joins as J
from evidentia.operators import reshape as R
from evidentia.operators import sampling as S
from evidentia.plans import curation
from evidentia.plans import validated as V
from evidentia.queries import _query, _sha, _t
from evidentia.record_queries import _folder
from evidentia.sources import readers, sinks


@_query("""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount < 0.04 THEN 'normal' WHEN l_discount < 0.05 THEN 'mild_elevation' WHEN l_discount < 0.065 THEN 'moderate_elevation' ELSE 'glaucoma_suspicion' END AS cup,
  CASE WHEN l_quantity / 50 < 0.65 THEN 'low' WHEN l_quantity / 50 < 0.85 THEN 'normal' ELSE 'elevated' END AS ratio,
  CASE WHEN l_tax IS NULL THEN 'unknown' WHEN l_tax * 10 < 0.20 THEN 'normal' WHEN l_tax * 10 < 0.40 THEN 'mild' WHEN l_tax * 10 < 0.60 THEN 'moderate' ELSE 'severe' END AS twist,
  CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS by_limits,
  CASE WHEN l_quantity - 3 <= 0 THEN '未见' WHEN l_quantity - 3 < 12 THEN '小灶性' WHEN l_quantity - 3 < 30 THEN '中等面积' ELSE '大面积' END AS words,
  CASE WHEN l_quantity / 5 <= 1 THEN '黄斑区' WHEN l_quantity / 5 <= 3 THEN '后极部' WHEN l_quantity / 5 <= 6 THEN '中周部' ELSE '周边部' END AS band FROM lineitem""")
def value_buckets(spark, sf_dir):
    q = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        C.bucket(F.col("l_discount"), ([(sign, bound / 10, name) for sign, bound, name in C.CUP_BUCKETS[0]], C.CUP_BUCKETS[1])).alias("cup"),
        C.bucket(q / 50, C.RATIO_BUCKETS).alias("ratio"), C.bucket(F.col("l_tax") * 10, C.TWIST_BUCKETS).alias("twist"),
        C.threshold_bucket(q, F.lit(10.0), F.lit(30.0)).alias("by_limits"), C.area_words(q - 3, 12, 30).alias("words"), C.bucket(q / 5, C.DISTANCE_BANDS).alias("band"),
    )


@_query(f"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE (p_size % 4)::VARCHAR END AS tagged,
  (['plain', 'short', 'long'])[1 + CAST('0x' || substr(sha1(p_partkey::VARCHAR), 1, 8) AS BIGINT) % 3] AS template,
  ([p_brand, p_type, p_name])[p_partkey % 5 + 1] AS chosen, {_sha("p_partkey::VARCHAR")} AS bucket FROM part""")
def choices_and_tags(spark, sf_dir):
    k = F.col("p_partkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in "aBcDe"]), (k % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", C.tag((F.col("p_size") % 4).cast("string"), {"0": "zero", "1": "one"}).alias("tagged"), C.hash_choice(k.cast("string"), ["plain", "short", "long"]).alias("template"),
        C.option_value(F.array("p_brand", "p_type", "p_name"), letter).alias("chosen"), C.sha1_bucket(k.cast("string")).alias("bucket"),
    )


_CELLS = "q AS (SELECT l_orderkey, l_linenumber, [l_quantity::INT % 3, l_partkey % 4, l_suppkey % 2, CASE WHEN l_orderkey % 5 = 0 THEN 8 ELSE 0 END]::BIGINT[] AS c FROM lineitem)"


@_query(f"""WITH {_CELLS}, t AS (SELECT *, list_sum(c) AS total, len(list_filter(c, lambda x: x > 0)) AS held, list_min(c) >= greatest(1, list_sum(c) // 6) AND len(list_filter(c, lambda x: x > 0)) = 4 AS even FROM q),
o AS (SELECT *, list_transform(list_sort(list_filter([{{'n': -c[i], 'i': i}} FOR i IN [1, 2, 3, 4]], lambda e: -e.n >= greatest(1, total // 4))),
  lambda e: (['superior-temporal', 'superior-nasal', 'inferior-temporal', 'inferior-nasal'])[e.i]) AS top FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN total = 0 THEN NULL WHEN even THEN 'throughout all four quadrants (macula-centered)' WHEN held = 1 THEN 'in the ' || top[1] || ' quadrant only'
  WHEN len(top) = 1 THEN 'predominantly in the ' || top[1] || ' quadrant' WHEN len(top) = 2 THEN 'distributed in the ' || top[1] || ' and ' || top[2] || ' quadrants'
  ELSE 'distributed across ' || len(top) || ' quadrants (' || array_to_string(top, ', ') || ')' END AS prose FROM o""")
def quadrants_in_prose(spark, sf_dir):
    far = F.when(F.col("l_orderkey") % 5 == 0, 8).otherwise(0)
    counts = {"ST": F.col("l_quantity").cast("int") % 3, "SN": F.col("l_partkey") % 4, "IT": F.col("l_suppkey") % 2, "IN": far}
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.quadrant_prose(counts).alias("prose"))


@_query("""SELECT o_orderkey AS record_id, (o_orderkey % 10) / 8.0::DOUBLE AS cdr, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 0.7::DOUBLE END AS av_ratio,
  round_even((o_custkey % 7 + 0.25::DOUBLE + o_orderkey % 3) / 2, 6)::DOUBLE AS tortuosity, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS eye_side,
  o_orderkey % 4 > 0 AS od_qc, o_custkey % 2 = 0 AS vessel_qc,
  CASE WHEN o_orderkey % 6 = 0 THEN 'missing' WHEN (o_custkey % 100)::DOUBLE < 10 THEN 'too_near' WHEN (o_custkey % 100)::DOUBLE > 80 THEN 'too_far' END AS reason FROM orders""")
def biomarkers_of_documents(spark, sf_dir):
    """Biomarkers, quality checks and geometry read from documents of nested objects and of lists."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    macula = F.when(k % 2 == 0, F.concat(F.lit("["), 5 + c % 100, F.lit(", 7]"))).otherwise(F.concat(F.lit('{"x": '), 5 + c % 100, F.lit(', "y": 7}')))
    doc = F.concat(
        F.lit('{"measurements": {"optic_disc_cup": {"eye_side": "'), F.when(k % 2 == 0, "left").otherwise("right"), F.lit('", "cup_disc_ratio": {"value": '), (k % 10) / 8.0,
        F.lit('}, "qc": {"pass": '), (k % 4 > 0).cast("string"), F.lit('}, "disc": {"center": [5, 7], "radius": '), F.when(k % 6 == 0, "null").otherwise("10"),
        F.lit('}}, "vessels": {"av_ratio": '), F.when(c % 3 == 0, '"none"').otherwise("0.7"), F.lit(', "tortuosity": {"artery": '), c % 7 + F.lit(0.25), F.lit(', "vein": '), k % 3,
        F.lit('}, "qc_flag": '), (c % 2 == 0).cast("string"), F.lit('}, "macula": {"center": '), macula, F.lit("}}}"),
    )
    docs = _t(spark, sf_dir, "orders").select(k.alias("record_id"), (k % 5).cast("int").alias("grade"), F.try_parse_json(doc).alias("doc"))
    found = V.document_biomarkers(docs)
    return found.select("record_id", "cdr", "av_ratio", "tortuosity", "eye_side", "od_qc", "vessel_qc", F.col("geometry")["reason"].alias("reason"))


@_query("""WITH s AS (SELECT l_orderkey AS record_id, (['HE', 'EX', 'SE', 'MA', 'IRMA', 'NV'])[l_linenumber] AS lesion, (['strong_present', 'weak_present', 'absent', 'template'])[l_partkey % 4 + 1] AS strength FROM lineitem WHERE l_linenumber <= 6),
g AS (SELECT DISTINCT record_id, unnest(['HE', 'EX', 'SE', 'MA', 'IRMA', 'NV']) AS lesion, unnest([1, 2, 3, 4, 5, 6]) AS i FROM s),
b AS (SELECT record_id, lesion, arg_min(strength, list_position(['strong_present', 'weak_present', 'absent', 'template'], strength)) AS strength FROM s GROUP BY ALL),
f AS (SELECT g.*, coalesce(strength, 'unknown') AS strength FROM g LEFT JOIN b USING (record_id, lesion))
SELECT record_id, coalesce(string_agg(lesion, ',' ORDER BY i) FILTER (WHERE strength = 'strong_present'), '') AS strong, coalesce(string_agg(lesion, ',' ORDER BY i) FILTER (WHERE strength = 'weak_present'), '') AS weak,
  coalesce(string_agg(lesion, ',' ORDER BY i) FILTER (WHERE strength IN ('unknown', 'template')), '') AS unknown, coalesce(string_agg(lesion, ',' ORDER BY i) FILTER (WHERE strength = 'absent'), '') AS absent FROM f GROUP BY record_id""")
def evidence_by_strength(spark, sf_dir):
    lesion = F.element_at(F.array(*map(F.lit, V.LESIONS)), F.col("l_linenumber"))
    strength = F.element_at(F.array(*[F.lit(x) for x in ("strong_present", "weak_present", "absent", "template")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = _t(spark, sf_dir, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").alias("record_id"), lesion.alias("lesion"), strength.alias("strength"))
    of = lambda c: F.array_join(c, ",")
    return V.evidence_groups(rows).select("record_id", of("strong_present").alias("strong"), of("weak_present").alias("weak"), of("unknown_or_template").alias("unknown"), of("absent").alias("absent"))


@_query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'in credit,' ELSE '' END || CASE WHEN c_nationkey % 2 = 0 THEN 'even,' ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder,' ELSE '' END AS held FROM customer")
def held_in_order(spark, sf_dir):
    kinds = {"in credit": F.col("c_acctbal") > 0, "even": F.col("c_nationkey") % 2 == 0, "builder": F.col("c_mktsegment") == "BUILDING"}
    return _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("", F.transform(R.ordered_list(kinds), lambda x: F.concat(x, F.lit(",")))).alias("held"))


@_query("SELECT 'by_priority' AS counter, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'by_status_and_year', o_orderstatus || '::' || year(o_orderdate), count(*) FROM orders GROUP BY 2")
def counts_beside_a_set(spark, sf_dir):
    """A set written as JSON lines with its counters beside it, read back from the document."""
    folder, orders = _folder(spark), _t(spark, sf_dir, "orders")
    sinks.write_json_lines(orders.select("o_orderkey", "o_orderpriority"), f"{folder}/set")
    dated = orders.withColumn("year", F.year("o_orderdate"))
    sinks.write_counts(f"{folder}/set_stats.json", {"by_priority": A.counter(orders, ["o_orderpriority"]), "by_status_and_year": A.counter(dated, ["o_orderstatus", "year"])})
    text = spark.read.text(f"{folder}/set_stats.json", wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("counter", "m"))
    return outer.select("counter", F.explode("m").alias("key", "n"))


@_query("""SELECT problems, count(*) AS n, min(l_orderkey) AS first FROM (SELECT l_orderkey, array_to_string(list_filter([CASE WHEN l_partkey % 9 = 0 THEN 'l_quantity is missing' END, CASE WHEN l_suppkey % 7 = 0 THEN 'box has another length than 2' END], lambda x: x IS NOT NULL), ';') AS problems FROM lineitem)
WHERE problems <> '' GROUP BY 1""")
def rows_that_fail_checks(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_suppkey") % 7 == 0, F.array("l_tax")).otherwise(F.array("l_tax", "l_discount")).alias("box"))
    bad = readers.violations(rows, ["l_orderkey", "l_quantity"], {"box": 2})
    return bad.groupBy(F.array_join("problems", ";").alias("problems")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


@_query("""WITH b AS (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey % 4 + 1 ELSE 2 END AS pos, CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 5 END AS neg, n_nationkey FROM nation),
c AS (SELECT c_custkey, n_name, pos, neg, c_acctbal > 3000 AS p, row_number() OVER (PARTITION BY n_name, c_acctbal > 3000 ORDER BY c_custkey) AS rn FROM customer JOIN b ON c_nationkey = n_nationkey)
SELECT c_custkey, n_name, p FROM c WHERE rn <= CASE WHEN p THEN pos ELSE neg END""")
def sample_by_plan_rows(spark, sf_dir):
    """A sample by budgets that stand in a table as CLASS:POSITIVE:NEGATIVE items, some without numbers."""
    nation, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    items = nation.select(F.concat("n_name", F.when(k % 3 == 0, F.concat(F.lit(":"), k % 4 + 1, F.lit(":3"))).when(k % 3 == 1, ":2").otherwise("")).alias("item"))
    plan = curation.plan_rows(items, "item", (2, 5))
    customers = _t(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    sides = plan.select(F.explode(F.array(F.struct(F.concat_ws("|", "name", F.lit("true")).alias("class"), F.col("positives").alias("budget")), F.struct(F.concat_ws("|", "name", F.lit("false")).alias("class"), F.col("negatives").alias("budget")))).alias("s")).select("s.*")
    marked = customers.select("c_custkey", "n_name", (F.col("c_acctbal") > 3000).alias("p")).withColumn("class", F.concat_ws("|", "n_name", F.col("p").cast("string")))
    return S.capped(marked, sides, "class", [F.col("c_custkey")]).select("c_custkey", "n_name", "p")


@_query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS g, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice > 150000 END AS p FROM orders), c AS (SELECT g, least(count(*) FILTER (WHERE p), count(*) FILTER (WHERE NOT p)) AS m FROM r GROUP BY g)
SELECT o_orderkey, g, p FROM (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY o_orderkey) AS rn FROM r WHERE p IS NOT NULL) JOIN c USING (g) WHERE rn <= m""")
def balance_without_unknown(spark, sf_dir):
    """As many of either class as the scarcer has; rows of which the class is unknown are in neither."""
    known = F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice") > 150000)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), known.alias("p"))
    return S.balanced(rows, ["g"], F.col("p"), [F.col("o_orderkey")])


@_query("""WITH l AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1)
SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, price) AS v, price IS NOT NULL AS found, priority AS value, CASE WHEN priority IS NULL THEN 'missing' ELSE 'orders' END AS origin FROM customer LEFT JOIN l ON c_custkey = k""")
def lookups_of_repeated_keys(spark, sf_dir):
    """Look-ups in a table that has many rows for a key, of which the last by another column counts."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("value"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    at = F.col("o_orderkey")
    filled = J.fill_missing(rows, orders, ["k"], "v", order=at)
    found = J.enrich(filled, orders.select("k", "o_orderkey"), ["k"], order=at).drop("o_orderkey")
    return J.first_of(found, [("orders", orders)], ["k"], "value", order=at)
