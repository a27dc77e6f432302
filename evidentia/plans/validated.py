"""Validated records: lesion facts merged, ruled by grade, cleaned, tiered and turned into decision steps.

Facts are kept in long form, a row per record and lesion with `present` as one of true, false, unknown, template_only
and possible_by_grade_template; all rules are column expressions over these rows, and whatever a rule needs from other
lesions of the record comes from one aggregation by record. Names of sources are data (`Sources`), thresholds are the
fixed values below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.functions.extract import first_key
from evidentia.operators.reshape import complete
from evidentia.operators.rules import Rule, apply_rules, decision_list
from evidentia.sources.readers import point

LESIONS = ("HE", "EX", "SE", "MA", "IRMA", "NV")
MEASURED = ("HE", "EX", "SE")


@dataclass(frozen=True)
class Sources:
    """Names of sources: measured by a model and kept or negative, and annotated by people."""

    measured: str
    negative: str
    annotated: Sequence[str]
    explicit: str  # of the annotated ones, that of explicit lesion labels
    prefix: str = "measured"  # of the flags that rules on measured facts leave


# Least count, area, confidence and grade of a measured lesion, and the name of the flag.
LEAST = {"HE": (2, 50.0, 0.25, None, "he_below_min_count_area_conf"), "EX": (1, 50.0, 0.25, None, "ex_below_min_area_conf"), "SE": (2, 300.0, 0.5, 2, "se_low_conf_or_tiny")}
# Ranges in which a biomarker is valid, and the quality check that it needs.
BIOMARKERS = {"cdr": (0.0, 1.2, "od_qc"), "av_ratio": (0.2, 1.5, "vessel_qc"), "tortuosity": (0.0, 5.0, "vessel_qc")}
# Fixed values of the second rule set: outside the range a value is dropped.
STRICT_BIOMARKERS = {"av_ratio": (0.3, 1.2), "cdr": (0.0, 0.9), "tortuosity": (1.0, 2.5)}


# Where documents of different layouts keep a lesion's block and its numbers, in the order of precedence.
BLOCKS = {
    "HE": ["$.lesions.HE", "$.lesion.HE", "$.lesion_analysis.HE", "$.lesion_quantification.HE", "$.lesions.he", "$.lesion_analysis.he", "$.measurements.lesions.lesion_dr.categories.hemorrhage"],
    "EX": ["$.lesions.EX", "$.lesion.EX", "$.lesion_analysis.EX", "$.lesion_quantification.EX", "$.lesions.ex", "$.lesion_analysis.ex", "$.measurements.lesions.lesion_dr.categories.exudate"],
    "SE": ["$.lesions.SE", "$.lesion.SE", "$.lesion_analysis.SE", "$.lesion_quantification.SE", "$.lesions.se", "$.lesion_analysis.se", "$.measurements.lesions.lesion_dr.categories.cotton_wool_spot"],
}
COUNTS = ["$.count", "$.num", "$.n", "$.number"]
AREAS = ["$.total_area", "$.area_total", "$.area", "$.sum_area", "$.area_px", "$.total_area_px"]
PLACES = {"ST": "superior_temporal", "SN": "superior_nasal", "IT": "inferior_temporal", "IN": "inferior_nasal"}


def _number(doc: Column, paths: Sequence[str]) -> Column:
    """The first number at several paths."""
    return C.finite(F.coalesce(*[F.try_variant_get(doc, p, "double") for p in paths]))


def document_lesions(docs: DataFrame) -> DataFrame:
    """A row per record and measured lesion with count, area and counts by quadrant, from documents (record_id, grade, doc)."""
    known = {k: F.coalesce(*[F.when(F.schema_of_variant(b).startswith("OBJECT"), b) for p in paths for b in (F.try_variant_get("doc", p, "variant"),)]) for k, paths in BLOCKS.items()}
    # only where no known path holds the block, the whole document is searched for a key of the lesion's name
    searched = {k: F.try_parse_json(first_key(k, k.lower(), objects=True)(F.when(known[k].isNull(), F.to_json("doc")))) for k in BLOCKS}
    blocks = F.array(*[F.struct(F.lit(k).alias("lesion"), F.coalesce(known[k], searched[k]).alias("block")) for k in BLOCKS])
    long = docs.select("record_id", "grade", F.explode(blocks).alias("b")).select("record_id", "grade", "b.lesion", "b.block")
    block = F.col("block")
    quadrant = {q: F.coalesce(_number(block, [f"$.quadrant_distribution.{name}", f"$.quadrants.{name}"]), F.lit(0.0)).cast("int") for q, name in PLACES.items()}
    numbers = {"count": F.coalesce(_number(block, COUNTS), F.lit(0.0)).cast("int"), "area": F.coalesce(_number(block, AREAS), F.lit(0.0))}
    return long.withColumns({**numbers, **quadrant}).drop("block")


def document_biomarkers(docs: DataFrame) -> DataFrame:
    """One row per record with cdr, av_ratio, tortuosity, eye_side, both quality checks, and the geometry of disc and macula."""
    doc = F.col("doc")
    at = lambda path: f"$.measurements.{path}"
    flag = lambda path: F.coalesce(F.try_variant_get(doc, at(path), "boolean"), F.lit(False))
    artery, vein = _number(doc, [at("vessels.tortuosity.artery")]), _number(doc, [at("vessels.tortuosity.vein")])
    disc, macula = point(doc, at("optic_disc_cup.disc.center")), point(doc, at("macula.center"))
    return docs.select(
        "record_id", "grade",
        _number(doc, [at("optic_disc_cup.cup_disc_ratio.value")]).alias("cdr"),
        _number(doc, [at("vessels.av_ratio")]).alias("av_ratio"),
        F.bround((artery + vein) / 2, 6).alias("tortuosity"),
        F.try_variant_get(doc, at("optic_disc_cup.eye_side"), "string").alias("eye_side"),
        flag("optic_disc_cup.qc.pass").alias("od_qc"), flag("vessels.qc_flag").alias("vessel_qc"),
        C.radial_geometry(disc["x"], disc["y"], macula["x"], macula["y"], _number(doc, [at("optic_disc_cup.disc.radius")])).alias("geometry"),
    )


def measured_lesions(df: DataFrame, sources: Sources) -> DataFrame:
    """Adds present, confidence, buckets and source to rows (record_id, grade, lesion, count, area)."""
    seen = (F.coalesce("count", F.lit(0)) > 0) & (F.coalesce("area", F.lit(0.0)) > 0)
    return df.withColumns({
        "present": F.when(seen, "true").otherwise("false"),
        "confidence": C.linear_confidence(F.coalesce("count", F.lit(0)), F.coalesce("area", F.lit(0.0))),
        "count_bucket": C.bucket(F.coalesce("count", F.lit(0)), C.COUNT_FOUR),
        "area_bucket": C.bucket(F.coalesce("area", F.lit(0.0)), C.AREA_FIXED),
        "source": F.when(seen, sources.measured).otherwise(sources.negative),
    })


def with_grade_lesions(df: DataFrame) -> DataFrame:
    """Adds the lesions that no measurement gives: MA unknown and NV absent."""
    full = complete(df, ["record_id", "grade"], "lesion", [*MEASURED, "MA", "NV"], {})
    given = {"MA": ("unknown", "missing_or_strong_mask_required"), "NV": ("false", "grade_rule")}
    for lesion, (state, source) in given.items():
        new = (F.col("lesion") == lesion) & F.col("present").isNull()
        full = full.withColumn("source", F.when(new, source).otherwise(F.col("source"))).withColumn("present", F.when(new, state).otherwise(F.col("present")))
    return full


def grade_rules(df: DataFrame) -> DataFrame:
    """Grade 0: all negative; grade 1: a template MA alone; grade 4: a possible NV. Leaves flags."""
    grade, lesion = F.col("grade"), F.col("lesion")
    measured, seen = lesion.isin(*MEASURED), F.col("present") == "true"
    off = {"present": F.lit("false"), "source": F.lit("grade_rule_override")}
    rules = [Rule(f"{x.lower()}_suppressed_grade{g}", (grade == g) & (lesion == x) & seen) for g in (0, 1) for x in MEASURED]
    flagged = apply_rules(df, rules)
    sets = [
        ((grade == 0) | (grade == 1)) & measured,
        (grade == 0) & (lesion == "MA"),
        (grade == 1) & (lesion == "MA"),
        (grade == 4) & (lesion == "NV"),
    ]
    values = [off, {"present": F.lit("false"), "source": F.lit("grade_rule")}, {"present": F.lit("template_only"), "source": F.lit("grade_rule")}, {"present": F.lit("possible_by_grade_template"), "source": F.lit("grade_rule")}]
    out = {c: _first(list(zip(sets, [v[c] for v in values], strict=True)), F.col(c)) for c in ("present", "source")}
    out["flags"] = C.add_flags(F.col("flags"), {"grade1_ma_only_template": (grade == 1) & (lesion == "MA")})
    return flagged.withColumns(out)


# Fixed values of the second rule set: names of sources and flags as its records carry them.
FORCED = {0: "grade0_all_negative_forced", 1: "grade1_ma_only_forced"}


def consistency_rules(df: DataFrame, *, least_area: Mapping[str, float], se_threshold: Mapping[int, float], he_area_max: float, prefix: str = "measured") -> DataFrame:
    """The second grade-rule set, from rows (record_id, grade, lesion of MEASURED, count, area, valid).

    Adds MA and NV by grade and laser_spot as missing; adds present, confidence, band, source and flags. Grade 0 and 1
    override as FORCED says; from grade 2 on a weak SE (below its grade's threshold) and at grade 2 an HE larger than
    `he_area_max` are withdrawn."""
    full = complete(df, ["record_id", "grade"], "lesion", [*MEASURED, "MA", "NV", "laser_spot"], {})
    grade, lesion = F.col("grade"), F.col("lesion")
    count, area, valid = F.coalesce("count", F.lit(0)), F.coalesce("area", F.lit(0.0)), F.coalesce("valid", F.lit(False))
    measured = lesion.isin(*MEASURED)
    floor = F.element_at(F.create_map(*[F.lit(x) for k, v in least_area.items() for x in (k, float(v))]), lesion)
    confidence = F.when(measured, C.log_confidence(count, area, floor))
    seen = F.when(measured, valid & (count > 0) & (area > 0)).when(lesion == "MA", grade >= 1).when(lesion == "NV", grade == 4).otherwise(False)
    source = F.when(measured, F.concat(F.lit(prefix), F.when(valid, "_valid").otherwise("_filtered"))).when(lesion == "laser_spot", f"missing_in_{prefix}").otherwise("grade_template")
    weak = F.lit(False)
    for g, threshold in se_threshold.items():
        weak = weak | ((grade == g) & (F.coalesce(confidence, F.lit(0.0)) < threshold))
    weak = seen & (lesion == "SE") & weak
    large = seen & (lesion == "HE") & (grade == 2) & (area > he_area_max)
    off = (grade == 0) | (grade == 1) & lesion.isin(*MEASURED, "NV")
    out = {
        "confidence": confidence,
        "band": F.when(measured, C.burden_band(area, count)),
        "present": seen & ~F.coalesce(off, F.lit(False)) & ~weak & ~large,
        "source": F.when(off, "grade_rule_override").when(weak, "low_confidence_filtered").when(large, "grade2_he_area_anomaly_suppressed").otherwise(source),
        "flags": C.flag_set({
            FORCED[0]: (grade == 0) & (lesion == "MA"), FORCED[1]: (grade == 1) & (lesion == "MA"),
            **{f"{x.lower()}_suppressed_grade1": (grade == 1) & (lesion == x) & seen for x in MEASURED},
            "se_low_confidence_suppressed": weak, "he_area_anomaly_suppressed": large,
        }),
    }
    return full.withColumns(out)


def _first(cases: list[tuple[Column, Column]], rest: Column) -> Column:
    out = rest
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def _suppressed(df: DataFrame, when: Column, reason: Column) -> DataFrame:
    """Present becomes false by a cleaning rule; what it was first is kept."""
    hit = F.coalesce(when, F.lit(False))
    keep = {f"raw_{c}": F.when(hit & F.col("raw_present").isNull(), F.col(c)).otherwise(F.col(f"raw_{c}")) for c in ("present", "source")}
    change = {"present": F.when(hit, "false").otherwise(F.col("present")), "source": F.when(hit, "cleaning_rule").otherwise(F.col("source")), "suppressed_reason": F.when(hit, reason).otherwise(F.col("suppressed_reason"))}
    flags = F.when(hit, F.array_sort(F.array_distinct(F.concat("flags", F.array(reason))))).otherwise(F.col("flags"))
    return df.withColumns({**keep, **change, "flags": flags})


def clean_lesions(df: DataFrame, sources: Sources) -> DataFrame:
    """Withdraws measured lesions below their least values, then those that the grade rules out; annotated ones are only flagged."""
    empty = {c: F.lit(None).cast("string") for c in ("raw_present", "raw_source", "suppressed_reason") if c not in df.columns}
    if "flags" not in df.columns:
        empty["flags"] = F.array().cast("array<string>")
    df = df.withColumns(empty) if empty else df
    seen, grade = F.col("present") == "true", F.col("grade")
    weak, reason = F.lit(False), F.lit(None).cast("string")
    for lesion, (count, area, conf, least_grade, name) in LEAST.items():
        ok = (F.coalesce("count", F.lit(0)) >= count) & (F.coalesce("area", F.lit(0.0)) >= area) & (F.coalesce("confidence", F.lit(0.0)) >= conf)
        if least_grade is not None:
            ok = ok & F.coalesce(grade >= least_grade, F.lit(False))
        hit = (F.col("lesion") == lesion) & ~ok
        weak, reason = weak | hit, F.when(hit, f"{sources.prefix}_{name}").otherwise(reason)
    df = _suppressed(df, seen & (F.col("source") == sources.measured) & weak, reason)

    low = grade.isin(0, 1) & F.col("lesion").isin(*MEASURED) & seen
    strong = F.col("source").isin(*sources.annotated)
    where = F.concat(F.lower("lesion"), F.lit("_suppressed_by_grade"), grade.cast("string"))
    conflict = F.concat(F.lower("lesion"), F.lit("_strong_mask_conflicts_grade"), grade.cast("string"))
    flagged = df.withColumn("flags", F.when(low & strong, F.array_sort(F.array_distinct(F.concat("flags", F.array(conflict))))).otherwise(F.col("flags")))
    df = _suppressed(flagged, low & ~strong, where)
    ma = (F.col("lesion") == "MA") & ~F.coalesce(strong, F.lit(False))
    return df.withColumns({
        "present": F.when(ma & (grade == 0), "false").when(ma & (grade == 1), "template_only").otherwise(F.col("present")),
        "source": F.when(ma & grade.isin(0, 1), "grade_rule").otherwise(F.col("source")),
    })


def valid_biomarkers(df: DataFrame) -> DataFrame:
    """Adds <name>_valid by range and quality check to records with cdr, av_ratio, tortuosity, od_qc, vessel_qc and eye_side."""
    out = {f"{n}_valid": C.in_range(C.finite(F.col(n)), low, high) & F.coalesce(F.col(qc), F.lit(False)) for n, (low, high, qc) in BIOMARKERS.items()}
    out["eye_side_valid"] = (F.coalesce(F.length("eye_side"), F.lit(0)) > 0) & F.coalesce("od_qc", F.lit(False))
    return df.withColumns(out)


def biomarker_rules(df: DataFrame) -> DataFrame:
    """The second rule set: values out of range are dropped; values that do not suit the grade are dropped or flagged."""
    grade, av, cdr, tort = F.col("grade"), F.col("av_ratio"), F.col("cdr"), F.col("tortuosity")
    outside = {n: (F.col(n) < low) | (F.col(n) > high) for n, (low, high) in STRICT_BIOMARKERS.items()}
    inside = {n: ~c for n, c in outside.items()}
    none = F.lit(None).cast("double")
    rules = [Rule(f"{n}_out_of_range_null", c, {n: none}) for n, c in outside.items()] + [
        Rule("av_ratio_grade0_low_suspicious", inside["av_ratio"] & (grade == 0) & (av < 0.5)),
        Rule("av_ratio_grade34_high_null", inside["av_ratio"] & grade.isin(3, 4) & (av > 0.8), {"av_ratio": none}),
        Rule("cdr_high_note", inside["cdr"] & (cdr > 0.7)),
        Rule("tortuosity_grade01_high_suspicious", inside["tortuosity"] & grade.isin(0, 1) & (tort > 1.8)),
        Rule("tortuosity_grade4_low_suspicious", inside["tortuosity"] & (grade == 4) & (tort < 1.1)),
    ]
    return apply_rules(df, rules)


def usable_for(lesions: DataFrame, records: DataFrame, sources: Sources) -> DataFrame:
    """L2, L3, L4, strong_L3 and measured_L3 of each record, from its lesions and its valid biomarkers."""
    seen = F.col("present") == "true"
    per = lesions.groupBy("record_id").agg(
        F.bool_or(F.coalesce(F.col("source").isin(*sources.annotated), F.lit(False))).alias("strong_L3"),
        F.bool_or(F.coalesce((F.col("source") == sources.measured) & F.col("lesion").isin(*MEASURED) & seen, F.lit(False))).alias("measured_L3"),
        F.bool_or(F.coalesce(seen & F.col("lesion").isin("HE", "EX", "SE", "MA", "NV"), F.lit(False))).alias("evidence"),
    )
    joined = records.join(per, "record_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    l2 = flag(F.col("eye_side_valid")) | flag(F.col("cdr_valid")) | flag(F.col("av_ratio_valid")) | flag(F.col("tortuosity_valid"))
    l4 = flag(F.col("grade") >= 0) & (flag(F.col("evidence")) | flag(F.col("grade").isin(0, 1)))
    return joined.select("record_id", l2.alias("L2"), (flag(F.col("strong_L3")) | flag(F.col("measured_L3"))).alias("L3"), l4.alias("L4"), flag(F.col("strong_L3")).alias("strong_L3"), flag(F.col("measured_L3")).alias("measured_L3"))


def evidence_tiers(df: DataFrame, sources: Sources, direct: Column | None = None) -> DataFrame:
    """Adds tier S0 to S4 and origin, and drops facts that are no evidence. `direct` tells a state read from a mask
    (true or false) that comes before everything else."""
    seen, lesion, source = F.col("present") == "true", F.col("lesion"), F.col("source")
    masks = [s for s in sources.annotated if s != sources.explicit]
    by_mask = F.lit(False) if direct is None else direct.isNotNull()
    state = F.col("present") if direct is None else F.when(direct.isNotNull(), direct.cast("string")).otherwise(F.col("present"))
    grade0 = source.isin("grade_rule", "grade_rule_override") & ~seen & (F.col("grade") == 0) & lesion.isin("MA", *MEASURED)
    tier = decision_list(
        [
            ("S0", by_mask, {"origin": F.lit("direct_mask")}),
            ("S1", source == sources.explicit, {"origin": F.lit("explicit_lesion_annotation")}),
            ("S0", source.isin(*masks) & lesion.isin("MA", *MEASURED), {"origin": F.lit("direct_mask")}),
            ("S2", source == sources.measured, {"origin": F.lit("measured")}),
            ("S2", source == sources.negative, {"origin": F.lit("measured_negative")}),
            ("S3", (source == "cleaning_rule") & ~seen, {"origin": F.lit("cleaning_rule_negative")}),
            ("S4", grade0, {"origin": F.lit("grade0_weak_negative")}),
        ],
        {"origin": F.lit(None).cast("string")},
        name="tier",
    )
    out = df.withColumn("__t", tier).withColumns({"tier": F.col("__t.tier"), "origin": F.col("__t.origin"), "present": state}).drop("__t")
    rare = lesion.isin("IRMA", "NV") & ~F.col("origin").eqNullSafe("direct_mask") & (F.col("tier") != "S1")
    ma = (lesion == "MA") & (F.col("present") == "true") & ~F.col("tier").isin("S0", "S1")
    return out.where(F.col("tier").isNotNull() & F.col("present").isin("true", "false") & ~rare & ~ma)


def strengths(df: DataFrame, strong: Sequence[str], weak: Sequence[str] = ("grade_rule_override",)) -> DataFrame:
    """Adds strength: strong_present, weak_present, template, unknown or absent."""
    present, area, conf = C.tri_state(F.col("present")), F.col("area_bucket"), F.col("confidence")
    trusted = F.col("source").isin(*strong) & ~F.col("source").isin(*weak)
    small = (area == "small") | (conf < 0.5)
    large = area.isin("medium", "large") & (conf.isNull() | (conf >= 0.5))
    return df.withColumn(
        "strength",
        F.when(F.col("present").isin("template_only", "possible_by_grade_template"), "template")
        .when(present != "present", present)
        .when(~F.coalesce(trusted, F.lit(False)), "weak_present")
        .when(F.coalesce(large, F.lit(False)), "strong_present")
        .when(F.coalesce(small, F.lit(False)), "weak_present")
        .otherwise("strong_present"),
    )


def steps(df: DataFrame) -> DataFrame:
    """One row per record: burden, proliferation, boundary, and the step with its rule and whether evidence is limited."""
    strength, lesion = F.col("strength"), F.col("lesion")
    points = F.when(strength == "strong_present", F.when(F.col("area_bucket") == "large", 3).when(F.col("area_bucket") == "medium", 2).otherwise(1)).when(strength == "weak_present", 1).otherwise(0)
    of = lambda name, column: F.max(F.when(lesion == name, F.col(column)))
    per = df.groupBy("record_id", "grade").agg(
        F.sum(F.when(lesion.isin("HE", "EX", "SE", "MA"), points).otherwise(0)).alias("points"),
        of("NV", "strength").alias("nv"), of("NV", "present").alias("nv_state"), of("IRMA", "strength").alias("irma"), of("MA", "strength").alias("ma"), of("MA", "present").alias("ma_state"),
    )
    per = per.withColumns({
        "burden": F.when(F.col("points") == 0, "none").when(F.col("points") <= 2, "light").when(F.col("points") <= 5, "moderate").otherwise("heavy"),
        "proliferation": F.when(F.col("nv") == "strong_present", "direct").when(F.col("nv_state") == "possible_by_grade_template", "possible_template").otherwise("none"),
        "boundary": F.when(F.col("irma") == "strong_present", "irma_present").otherwise("none"),
    })
    g, burden, prolif, boundary = (F.col(c) for c in ("grade", "burden", "proliferation", "boundary"))
    rule = lambda name, limited: {"rule": F.lit(name), "evidence_limited": F.lit(limited)}
    listed = [
        ("Step1", (g == 4) & (prolif == "direct"), rule("nv_present_grade4_pdr", False)),
        ("Step2a", (g == 4) & (prolif == "possible_template"), rule("grade4_label_with_possible_nv_template", True)),
        ("Step2b", g == 4, rule("supervised_grade4_without_direct_nv_evidence_limited", True)),
        ("Step3a", (g == 3) & (boundary == "irma_present"), rule("irma_without_nv_grade3_boundary", False)),
        ("Step3b", (g == 3) & (burden == "heavy"), rule("heavy_nonproliferative_without_nv_grade3", False)),
        ("Step3c", g == 3, rule("supervised_grade3_evidence_limited", True)),
        ("Step4", (g == 2) & burden.isin("light", "moderate"), rule("nonproliferative_lesions_without_severe_boundary_grade2", False)),
        ("Step4b", g == 2, rule("supervised_grade2_evidence_limited", True)),
        ("Step5a", (g == 1) & (F.col("ma_state") == "template_only"), rule("mild_or_template_ma_grade1", True)),
        ("Step5b", (g == 1) & F.col("ma").isin("strong_present", "weak_present") & burden.isin("none", "light"), rule("ma_only_grade1", False)),
        ("Step5c", g == 1, rule("supervised_grade1_evidence_limited", True)),
        ("Step6", (g == 0) & (burden == "none") & (prolif == "none") & (boundary == "none"), rule("no_reliable_dr_lesion_grade0", False)),
        ("Step6b", g == 0, rule("supervised_grade0_unexpected_lesion", True)),
        ("StepX", F.lit(True), rule("label_supervision_evidence_limited", True)),
    ]
    chosen = decision_list(listed, {"rule": F.lit(None).cast("string"), "evidence_limited": F.lit(True)})
    return per.withColumn("d", chosen).select("record_id", "grade", "burden", "proliferation", "boundary", "d.*")


#: Strengths from the one that counts most where a record has several rows of a lesion.
STRENGTHS = ("strong_present", "weak_present", "absent", "template", "unknown")


def evidence_groups(df: DataFrame) -> DataFrame:
    """Per record the lesions of each strength in their fixed order; lesions without a row, or with another strength,
    are unknown, and of several rows the one with the greater strength counts."""
    place = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    place = F.when(place > 0, place).otherwise(len(STRENGTHS))
    held = df.groupBy("record_id").agg(*[F.min(F.when(F.col("lesion") == x, place)).alias(f"__{x}") for x in LESIONS])

    def of(*names: str) -> Column:
        wanted = [STRENGTHS.index(n) + 1 for n in names]
        return F.array_compact(F.array(*[F.when(F.coalesce(f"__{x}", F.lit(len(STRENGTHS))).isin(*wanted), F.lit(x)) for x in LESIONS]))

    return held.select("record_id", of("strong_present").alias("strong_present"), of("weak_present").alias("weak_present"), of("unknown", "template").alias("unknown_or_template"), of("absent").alias("absent"))
