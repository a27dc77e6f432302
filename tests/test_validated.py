import json

import pytest
from pyspark.sql import functions as F

from evidentia.plans import validated as V

S = V.Sources(measured="model", negative="model_negative", annotated=("mask", "label"), explicit="label")


def facts(spark, rows):
    return V.measured_lesions(spark.createDataFrame(rows, "record_id string, grade int, lesion string, count int, area double"), S)


def by(df, *columns):
    return {(r.record_id, r.lesion): tuple(r[c] for c in columns) for r in df.collect()}


def test_measured_lesions(spark):
    got = by(facts(spark, [("a", 2, "HE", 4, 300.0), ("a", 2, "EX", 0, 9.0), ("a", 2, "SE", None, None)]), "present", "confidence", "count_bucket", "area_bucket", "source")
    assert got["a", "HE"] == ("true", 0.5, "some", "medium", "model")
    assert got["a", "EX"] == ("false", 0.006, "none", "small", "model_negative")
    assert got["a", "SE"] == ("false", 0.0, "none", "none", "model_negative")


def test_grade_rules(spark):
    rows = [(f"g{g}", g, x, 5, 400.0) for g in (0, 1, 2, 4) for x in V.MEASURED]
    got = by(V.grade_rules(V.with_grade_lesions(facts(spark, rows))), "present", "source", "flags")
    assert got["g0", "HE"] == ("false", "grade_rule_override", ["he_suppressed_grade0"])
    assert got["g0", "MA"][:2] == ("false", "grade_rule")
    assert got["g1", "MA"] == ("template_only", "grade_rule", ["grade1_ma_only_template"])
    assert got["g2", "SE"] == ("true", "model", []) and got["g2", "MA"][0] == "unknown" and got["g2", "NV"][0] == "false"
    assert got["g4", "NV"][:2] == ("possible_by_grade_template", "grade_rule")


def test_cleaning(spark):
    rows = [("a", 2, "HE", 1, 400.0), ("a", 2, "EX", 1, 40.0), ("a", 2, "SE", 4, 900.0), ("b", 1, "HE", 9, 900.0), ("b", 1, "SE", 9, 900.0), ("n", None, "SE", 9, 900.0)]
    df = facts(spark, rows).withColumn("source", F.when((F.col("record_id") == "b") & (F.col("lesion") == "HE"), "mask").otherwise(F.col("source")))
    got = by(V.clean_lesions(df, S), "present", "source", "raw_source", "suppressed_reason", "flags")
    assert got["a", "HE"] == ("false", "cleaning_rule", "model", "measured_he_below_min_count_area_conf", ["measured_he_below_min_count_area_conf"])
    assert got["a", "EX"][0] == "false" and got["a", "SE"] == ("true", "model", None, None, [])
    assert got["b", "HE"] == ("true", "mask", None, None, ["he_strong_mask_conflicts_grade1"])
    assert got["b", "SE"][3] == "measured_se_low_conf_or_tiny"
    assert got["n", "SE"][0] == "false"


def test_usability(spark):
    lesions = spark.createDataFrame([("a", "HE", "true", "model"), ("b", "IRMA", "false", "mask"), ("c", "MA", "template_only", "grade_rule")], "record_id string, lesion string, present string, source string")
    records = spark.createDataFrame([("a", 2, 0.5, None, None, True, False, "left"), ("b", None, None, 9.0, None, False, True, ""), ("c", 1, None, 0.5, 1.0, None, True, None)], "record_id string, grade int, cdr double, av_ratio double, tortuosity double, od_qc boolean, vessel_qc boolean, eye_side string")
    got = {r.record_id: tuple(r)[1:] for r in V.usable_for(lesions, V.valid_biomarkers(records), S).collect()}
    assert got == {"a": (True, True, True, False, True), "b": (False, True, False, True, False), "c": (True, False, True, False, False)}


def test_biomarker_rules(spark):
    rows = [("a", 0, 0.4, 0.8, 1.9), ("b", 4, 0.9, 1.0, 1.05), ("c", 2, None, None, 3.0), ("d", 3, 1.3, 0.5, None)]
    got = {r.record_id: (r.av_ratio, r.cdr, r.tortuosity, r.flags) for r in V.biomarker_rules(spark.createDataFrame(rows, "record_id string, grade int, av_ratio double, cdr double, tortuosity double")).collect()}
    assert got["a"] == (0.4, 0.8, 1.9, ["av_ratio_grade0_low_suspicious", "cdr_high_note", "tortuosity_grade01_high_suspicious"])
    assert got["b"] == (None, None, 1.05, ["av_ratio_grade34_high_null", "cdr_out_of_range_null", "tortuosity_grade4_low_suspicious"])
    assert got["c"] == (None, None, None, ["tortuosity_out_of_range_null"]) and got["d"][0] is None


def test_tiers(spark):
    rows = [("a", 2, "HE", "true", "model"), ("a", 2, "NV", "true", "model"), ("a", 2, "NV2", "unknown", "x"), ("b", 0, "MA", "false", "grade_rule"), ("b", 1, "MA", "template_only", "grade_rule"), ("c", 2, "MA", "true", "model"), ("d", 3, "IRMA", "true", "label"), ("e", 2, "EX", "false", "cleaning_rule"), ("f", 2, "SE", "true", "mask")]
    df = spark.createDataFrame(rows, "record_id string, grade int, lesion string, present string, source string")
    assert by(V.evidence_tiers(df, S), "tier", "origin") == {("a", "HE"): ("S2", "measured"), ("b", "MA"): ("S4", "grade0_weak_negative"), ("d", "IRMA"): ("S1", "explicit_lesion_annotation"), ("e", "EX"): ("S3", "cleaning_rule_negative"), ("f", "SE"): ("S0", "direct_mask")}
    masked = V.evidence_tiers(df.where("record_id = 'c'"), S, direct=F.lit(False))
    assert by(masked, "tier", "present") == {("c", "MA"): ("S0", "false")}


@pytest.mark.parametrize(
    ("grade", "rows", "step", "burden"),
    [
        (4, [("NV", "true", "mask", "large", None)], "Step1", "none"),
        (4, [("NV", "possible_by_grade_template", "grade_rule", None, None)], "Step2a", "none"),
        (4, [("NV", "false", "grade_rule", None, None)], "Step2b", "none"),
        (3, [("IRMA", "true", "mask", None, None)], "Step3a", "none"),
        (3, [("HE", "true", "model", "large", 0.9), ("EX", "true", "model", "large", 0.9)], "Step3b", "heavy"),
        (3, [("HE", "true", "model", "small", 0.9)], "Step3c", "light"),
        (2, [("HE", "true", "model", "large", 0.9)], "Step4", "moderate"),
        (2, [("HE", "false", "model_negative", None, None)], "Step4b", "none"),
        (1, [("MA", "template_only", "grade_rule", None, None)], "Step5a", "none"),
        (1, [("MA", "true", "grade_rule_override", None, None)], "Step5b", "light"),
        (1, [("HE", "true", "model", "large", 0.2)], "Step5c", "light"),
        (0, [("HE", "false", "model_negative", None, None)], "Step6", "none"),
        (0, [("HE", "true", "model", "medium", 0.6)], "Step6b", "light"),
        (None, [("HE", "unknown", "x", None, None)], "StepX", "none"),
    ],
)
def test_decision_steps(spark, grade, rows, step, burden):
    df = spark.createDataFrame([("r", grade, *r) for r in rows], "record_id string, grade int, lesion string, present string, source string, area_bucket string, confidence double")
    strong = V.strengths(df, strong=("model", "mask", "label"))
    got = V.steps(strong).first()
    assert (got.step, got.burden) == (step, burden)
    groups = V.evidence_groups(strong).first()
    assert sum(len(groups[c]) for c in ("strong_present", "weak_present", "unknown_or_template", "absent")) == len(V.LESIONS)


def test_documents_of_several_layouts(spark):
    new = {"measurements": {"lesions": {"lesion_dr": {"categories": {"hemorrhage": {"count": 3, "area_px": 400.5, "quadrant_distribution": {"superior_temporal": 2, "inferior_nasal": 1}}}}}, "optic_disc_cup": {"eye_side": "left", "cup_disc_ratio": {"value": 0.4}, "disc": {"center": [10, 10], "radius": 5}, "qc": {"pass": True}}, "vessels": {"av_ratio": 0.7, "tortuosity": {"artery": 1.0, "vein": 2.0}, "qc_flag": False}, "macula": {"center": {"x": 30, "y": 10}}}}
    old = {"lesion_analysis": {"he": {"num": 2, "total_area": 10}}, "lesions": {"EX": {"count": "4", "area": 1}}}
    rows = [("new", 2, json.dumps(new)), ("old", None, json.dumps(old)), ("bad", 1, "nothing")]
    docs = spark.createDataFrame(rows, "record_id string, grade int, t string").select("record_id", "grade", F.try_parse_json("t").alias("doc"))
    got = by(V.document_lesions(docs), "count", "area", "ST", "IN")
    assert got["new", "HE"] == (3, 400.5, 2, 1) and got["old", "HE"] == (2, 10.0, 0, 0) and got["bad", "SE"] == (0, 0.0, 0, 0)
    assert got["old", "EX"] == (4, 1.0, 0, 0)
    marks = {r.record_id: r for r in V.valid_biomarkers(V.document_biomarkers(docs)).collect()}
    assert (marks["new"].cdr_valid, marks["new"].av_ratio_valid, marks["new"].tortuosity, marks["new"].eye_side_valid, marks["new"].geometry.valid) == (True, False, 1.5, True, True)
    assert not marks["old"].cdr_valid and marks["bad"].geometry.reason == "missing"
