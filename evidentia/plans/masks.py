"""What the masks of five lesions say about an eye: counts, sizes, places, patterns and alerts, with a sentence for each.

A mask's components come from one Arrow pass a mask (`functions/raster.py`); everything else is column expressions over
the arrays of components, so that rows stay where they are and nothing is shuffled. A missing mask counts as an empty
one, and an empty one is not present; its other facts are NULL. With points (fovea, disc) missing, facts of places are
NULL and so are the sentences that name them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import raster
from evidentia.functions.columns import bucket, distance_between
from evidentia.functions.extract import fixed_point, rendered

# Pixels of a disc diameter, of the central zone, of the largest dot; bleedings a quadrant from which it
# is severe; disc radii around the disc; share of hollow area of a ring; components of a multifocal pattern; disc
# diameters squared of a large spot; ratio of the sides of an irregular spot; sizes of the kernels that close gaps.
DISC_DIAMETER, CENTRAL, LARGEST_DOT = 90.0, 35.0, 45
SEVERE, NEAR_DISC, RING_SHARE, MANY, LARGE_SPOT, IRREGULAR = 20, 2.0, 0.2, 10, 0.083, 1.5
CLOSING = (0, 9, 25)
LESIONS = ("MA", "HE", "EX", "SE", "NV")
QUADRANTS = ("TS", "TI", "NS", "NI")
BANDS = ([("<=", 1.0, "黄斑区（≤1DD）"), ("<=", 3.0, "后极部（1-3DD）"), ("<=", 6.0, "中周部（3-6DD）")], "周边部（>6DD）")
# The sentences.
NO_DOTS, NO_SMALL_DOTS = "未见典型红色点状微动脉瘤，MA（-）。", "未见明确微动脉瘤，MA（-）。"
NO_BLEEDING, NO_EXUDATE, NO_SPOTS = "未见暗红色斑块状出血，HE（-）。", "未见黄白色蜡样沉积物，EX（-）。", "未见灰白色棉絮状斑块，SE（-）。"
NO_VESSELS, NOT_LOOKED_FOR = "未见视网膜表面新生血管，NV（-）。", "未见新生血管，NV（-）。"
DOTS = (
    "后极部可见约{count}处红色至暗红色{shape}，边界清晰锐利，直径约{least}-{most}px。主要分布于{quadrant}象限，"
    "最近病灶距黄斑中心约{distance}DD（{band}）。边界规则，区别于点状出血的不规则边缘。"
)
BLEEDING = "可见{count}处暗红色至黑红色{shape}出血，最大病灶横径约{width}px，分布于{quadrants}象限。面积明显大于微动脉瘤。{alert}"
BLEEDING_ALERT = "【注意：{quadrant}象限出血{count}处，达重度NPDR的4-2-1规则阈值，建议紧急复查。】"
EXUDATE = (
    "可见黄白色蜡样沉积物，边界清晰锐利，呈{pattern}，总掩码面积约{area}px²。最近病灶距黄斑中心约{distance}DD。{alert}"
    "边界明确，区别于棉绒斑的边缘模糊；不遮挡其下血管。"
)
EXUDATE_ALERT = "【注意：最近病灶距黄斑中心仅{distance}DD（<500μm），达CSME诊断阈值，中心视力受累风险高。】"
SPOTS = "可见{count}处灰白色棉絮状斑块，边界模糊不清，大小{sizes}，{place}。边界欠清，区别于硬性渗出的清晰边界；可能遮挡局部血管走行。"
SPOTS_PLACE = "位于后极部，距黄斑中心约{distance}DD"
VESSELS = "视网膜{disc}表面可见细小新生血管网，走行迂曲紊乱，形态不规则，共{count}处（{kinds}）。【提示增殖期DR，建议紧急干预。】"
ROUND_DOT, PATCHES, DOTLIKE = "规则圆点", "不规则斑块状", "类圆点状"
RING, MULTIFOCAL, CLUSTERS = "环形（circinate）分布", "多灶散在分布", "散在簇状"


def quadrant(x: Column, y: Column, disc: Column, fovea: Column) -> Column:
    """Temporal or nasal and superior or inferior to the midpoint of disc and fovea; the fovea is temporal."""
    mid_x, mid_y = (disc["x"] + fovea["x"]) / 2, (disc["y"] + fovea["y"]) / 2
    temporal = F.when(fovea["x"] > disc["x"], x > mid_x).otherwise(x < mid_x)
    return F.concat(F.when(temporal, "T").when(~temporal, "N"), F.when(y < mid_y, "S").when(y >= mid_y, "I"))


def nearest(props: Column, fovea: Column, diameter: float = DISC_DIAMETER) -> Column:
    """Disc diameters from the fovea to the nearest component, with one decimal."""
    return F.array_min(F.transform(props, lambda p: F.round(distance_between(p["cx"], p["cy"], fovea["x"], fovea["y"]) / diameter, 1)))


def by_quadrant(props: Column, disc: Column, fovea: Column) -> Column:
    """A struct of the number of components in each quadrant; NULL without both points."""
    found = F.transform(props, lambda p: quadrant(p["cx"], p["cy"], disc, fovea))
    known = disc["x"].isNotNull() & disc["y"].isNotNull() & fovea["x"].isNotNull() & fovea["y"].isNotNull()
    return F.when(known, F.struct(*[(F.size(found) - F.size(F.array_remove(found, q))).alias(q) for q in QUADRANTS]))


def small_ones(props: Column) -> Column:
    """Components smaller than a circle of the largest dot's diameter."""
    return F.filter(props, lambda p: p["area"] < LARGEST_DOT**2 * math.pi / 4)


def _written(when: Column, template: str, **values: Column) -> Column:
    """The sentence, NULL where a value is."""
    known = when
    for v in values.values():
        known = known & v.isNotNull()
    return F.when(known, rendered(template, **values))


def _facts(present: Column, absent: Column | str, text: Column, **fields: Column) -> Column:
    absent = F.lit(absent) if isinstance(absent, str) else absent
    return F.struct(present.alias("present"), *[F.when(present, v).alias(n) for n, v in fields.items()], F.when(present, text).otherwise(absent).alias("text"))


def dots(props: Column, small: Column, by: Column, distance: Column) -> Column:
    """Counts, sizes and places of the small components; of equal quadrants the first counts as the main one."""
    present, count = F.size(small) > 0, F.size(small)
    across = F.transform(small, lambda p: 2 * F.sqrt(p["area"] / math.pi))
    least, most = F.array_min(across).cast("int"), F.array_max(across).cast("int")
    highest = F.greatest(*[by[q] for q in QUADRANTS])
    main = F.coalesce(*[F.when(by[q] == highest, q) for q in QUADRANTS])
    text = _written(present, DOTS, count=count, shape=F.lit(ROUND_DOT), least=least, most=most, quadrant=main, distance=distance, band=bucket(distance, BANDS, None))
    absent = F.when(F.size(props) > 0, NO_SMALL_DOTS).otherwise(NO_DOTS)
    return _facts(present, absent, text, count_estimate=count, diameter_range_px=F.array(least, most), main_quadrant=main, min_dist_to_fovea_dd=distance, morphology=F.lit(ROUND_DOT))


def bleeding(props: Column, by: Column) -> Column:
    """Shape by the mean ratio of sides, and an alert for the first quadrant that reaches the severe count."""
    present, count = F.size(props) > 0, F.size(props)
    width = F.array_max(F.transform(props, lambda p: p["x2"] - p["x1"]))
    ratios = F.aggregate(props, F.lit(0.0), lambda s, p: s + p["major_axis"] / (p["minor_axis"] + 1e-5))
    shape = F.when(ratios / F.when(present, count) > IRREGULAR, PATCHES).otherwise(DOTLIKE)
    severe = F.coalesce(*[F.when(by[q] >= SEVERE, rendered(BLEEDING_ALERT, quadrant=F.lit(q), count=by[q])) for q in QUADRANTS])
    named = F.when(by.isNotNull(), F.array_join(F.array(*[F.when(by[q] > 0, q) for q in QUADRANTS]), "、"))
    text = _written(present, BLEEDING, count=count, shape=shape, width=width, quadrants=named, alert=F.coalesce(severe, F.lit("")))
    return _facts(present, NO_BLEEDING, text, count_estimate=count, max_width_px=width, quadrant_distribution=by, morphology=shape, alert=severe.isNotNull())


def exudate(props: Column, hollow: Column, distance: Column) -> Column:
    """Rings by the area that they enclose, and an alert where the nearest component is in the central zone."""
    present, count = F.size(props) > 0, F.size(props)
    area = F.aggregate(props, F.lit(0).cast("bigint"), lambda s, p: s + p["area"])
    central = distance * DISC_DIAMETER < CENTRAL
    pattern = F.when(hollow > F.floor(area * RING_SHARE), RING).when(count >= MANY, MULTIFOCAL).otherwise(CLUSTERS)
    alert = F.when(central, rendered(EXUDATE_ALERT, distance=distance)).otherwise("")
    text = _written(present, EXUDATE, pattern=pattern, area=area, distance=distance, alert=alert)
    return _facts(present, NO_EXUDATE, text, total_area_px2=area, pattern=pattern, hollow_area_px2=hollow, hollow_ratio=F.round(hollow / (area + 1e-6), 3), min_dist_to_fovea_dd=distance, csme_risk=central)


def spots(props: Column, distance: Column, diameter: float = DISC_DIAMETER) -> Column:
    """The three largest spots in disc diameters squared, and the nearest one's distance."""
    present, count = F.size(props) > 0, F.size(props)
    areas = F.sort_array(F.transform(props, lambda p: p["area"]), asc=False)
    disc_area = math.pi * (diameter / 2) ** 2
    sizes = F.transform(F.slice(areas, 1, 3), lambda a: F.concat(F.lit("约"), fixed_point(a / disc_area), F.lit("DD²"), F.when(a / disc_area >= LARGE_SPOT, "（较大）").otherwise("")))
    listed = F.concat(F.when(count > 1, "分别为").otherwise(""), F.array_join(sizes, "、"))
    place = _written(present, SPOTS_PLACE, distance=fixed_point(distance, 1))
    return _facts(present, NO_SPOTS, _written(present, SPOTS, count=count, sizes=listed, place=place), count=count, min_dist_to_fovea_dd=distance, location=place)


def vessels(props: Column, disc: Column, radius: Column, looked_for: Column) -> Column:
    """Components near the disc and elsewhere; where new vessels were not looked for, none is present."""
    props = F.when(looked_for, props).otherwise(F.slice(props, 1, 0))
    present, count = F.size(props) > 0, F.size(props)
    within = radius.isNotNull() & disc["x"].isNotNull() & disc["y"].isNotNull()
    near = F.when(within, F.size(F.filter(props, lambda p: distance_between(p["cx"], p["cy"], disc["x"], disc["y"]) <= radius * NEAR_DISC)))
    far = count - near
    kinds = F.array_join(F.array(F.when(near > 0, rendered("NVD（视盘旁{n}处）", n=near)), F.when(far > 0, rendered("NVE（视网膜表面{n}处）", n=far))), "、")
    text = _written(present, VESSELS, disc=F.when(near > 0, "及视盘").otherwise(""), count=count, kinds=F.when(near.isNotNull(), kinds))
    absent = F.when(looked_for, NO_VESSELS).otherwise(NOT_LOOKED_FOR)
    return _facts(present, absent, text, total_count=count, nvd_count=near, nve_count=far)


def mask_findings(df: DataFrame, masks: Mapping[str, str], disc: str = "disc", fovea: str = "fovea", radius: str = "radius", looked_for: str = "has_nv") -> DataFrame:
    """Adds a struct a lesion (MA, HE, EX, SE, NV) and `analysis`, their sentences by line. `masks` names the mask column
    of each lesion, one left out counts as missing; `disc` and `fovea` are structs of x and y. Columns of `df` with the added names are replaced."""
    none = F.array().cast(raster.PROPS)
    props = {f"__props_{n}": F.coalesce(raster.component_props(masks[n]), none) if n in masks else none for n in LESIONS}
    nothing = F.lit(0).cast("bigint")
    hollow = F.coalesce(raster.hollow_area(CLOSING)(masks["EX"]), nothing) if "EX" in masks else nothing
    found = df.withColumns({**props, "__hollow": hollow})
    p = {name: F.col(f"__props_{name}") for name in LESIONS}
    d, f, seen = F.col(disc), F.col(fovea), F.coalesce(F.col(looked_for), F.lit(False))
    # each used many times below, so columns of their own
    small, close = F.col("__small"), {n: f"__near_{n}" for n in ("MA", "EX", "SE")}
    counts = {n: f"__by_{n}" for n in ("MA", "HE")}
    found = found.withColumn("__small", small_ones(p["MA"]))
    of = {**p, "MA": small}
    found = found.withColumns({**{c: nearest(of[n], f) for n, c in close.items()}, **{c: by_quadrant(of[n], d, f) for n, c in counts.items()}})
    facts = {
        "MA": dots(p["MA"], small, F.col(counts["MA"]), F.col(close["MA"])),
        "HE": bleeding(p["HE"], F.col(counts["HE"])),
        "EX": exudate(p["EX"], F.col("__hollow"), F.col(close["EX"])),
        "SE": spots(p["SE"], F.col(close["SE"])),
        "NV": vessels(p["NV"], d, F.col(radius), seen),
    }
    found = found.withColumns(facts).drop(*props, "__hollow", "__small", *close.values(), *counts.values())
    lines = [F.when(F.col(n)["text"].isNotNull(), F.concat(F.lit(f"【{n}】"), F.col(n)["text"])) for n in facts]
    return found.withColumn("analysis", F.concat_ws("\n", *lines))
