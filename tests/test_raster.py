import numpy as np
import pytest

from evidentia.functions import raster
from evidentia.plans import masks


def flood(mask):
    """Components by plain search."""
    left, out = set(zip(*map(list, np.nonzero(mask)), strict=True)), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((int(y), int(x)))
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(own)
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.8])
def test_components_equal_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(20):
        mask = (rng.random(rng.integers(1, 18, 2)) < share).astype(np.uint8)
        got = [{(int(r), c) for r, a, b in runs for c in range(a, b)} for runs in raster.components(mask)]
        assert sorted(map(sorted, got)) == sorted(map(sorted, flood(mask)))


def test_facts_props_and_alignment(spark):
    empty, one = np.zeros((8, 8), np.uint8), np.zeros((8, 8), np.uint8)
    one[2:4, 1:5] = 255
    dots = np.zeros((16, 16), np.uint8)
    dots[::4, ::4] = 1
    dots[10:12, 10:12] = 1
    rows = [(i, None if m is None else (m.shape[0], m.shape[1], m.tobytes()), [1, 2, 5, 4]) for i, m in enumerate([empty, one, dots, None])]
    df = spark.createDataFrame(rows, "i int, m struct<height:int,width:int,data:binary>, box array<int>")
    got = {r.i: r for r in df.select("i", raster.mask_facts("m").alias("f"), raster.component_props("m").alias("p"), raster.aligned_mask(4)("m", "box").alias("a")).collect()}
    assert tuple(got[0].f) == (False, 0, 0, 0.0, None) and got[0].p == []
    assert tuple(got[1].f) == (True, 1, 8, 0.125, "isolated")
    assert tuple(got[1].p[0]) == (8, 2, 2, 1, 2, 5, 4, 4, 2)
    assert got[2].f.component_count == 16 and got[2].f.distribution == "diffuse"
    assert np.frombuffer(got[1].a.data, np.uint8).tolist() == [255] * 16
    assert np.frombuffer(got[3].a.data, np.uint8).sum() == 0


def plainly_closed(mask, k):
    """Closing by sets of pixels."""
    h, w = mask.shape
    r = k // 2
    ellipse = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) <= round((r * r - y * y) ** 0.5)]
    inside = {(y, x) for y in range(h) for x in range(w)}
    grown = {(y + a, x + b) for y, x in zip(*np.nonzero(mask), strict=True) for a, b in ellipse} & inside
    return np.array([[all((y + a, x + b) in grown for a, b in ellipse if (y + a, x + b) in inside) for x in range(w)] for y in range(h)])


def plainly_enclosed(mask):
    left = {(y, x) for y in range(mask.shape[0]) for x in range(mask.shape[1]) if not mask[y, x]}
    todo = [(0, 0)] if (0, 0) in left else []
    left -= set(todo)
    while todo:
        y, x = todo.pop()
        for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if n in left:
                left.remove(n)
                todo.append(n)
    return len(left)


@pytest.mark.parametrize("k", [0, 3, 5, 9])
def test_closing_and_enclosed_area_equal_plain_ones(k):
    rng = np.random.default_rng(k)
    for share in (0.05, 0.2, 0.5, 0.95):
        for _ in range(4):
            mask = (rng.random(rng.integers(1, 20, 2)) < share).astype(np.uint8)
            closed = raster.closed(mask, k)
            assert (closed == (plainly_closed(mask, k) if k else mask > 0)).all()
            assert raster.enclosed(closed) == plainly_enclosed(closed)


def test_findings_of_masks(spark):
    blank, many, broken = (np.zeros((200, 200), np.uint8) for _ in range(3))
    many[2:40:4, 2:60:6] = 1
    many[120:180, 100:160] = 1
    broken[60:90, 60:90] = 1
    broken[63:87, 63:87] = 0
    broken[73:76, 60:63] = 0
    as_row = lambda m: None if m is None else (*m.shape, m.tobytes())
    kinds = {"dots": (many, many, broken, many, many), "blank": (blank,) * 5, "none": (None,) * 5, "lost": (many, many, broken, many, many)}
    rows = [(n, (150, 100), (50, 100), 40, n != "none", *map(as_row, m)) for n, m in kinds.items() if n != "lost"]
    rows.append(("lost", None, None, None, None, *map(as_row, kinds["lost"])))
    mask = "struct<height:int,width:int,data:binary>"
    df = spark.createDataFrame(rows, f"id string, disc struct<x:int,y:int>, fovea struct<x:int,y:int>, radius int, has_nv boolean, {', '.join(f'{n} {mask}' for n in ('m1', 'm2', 'm3', 'm4', 'm5'))}")
    found = masks.mask_findings(df, dict(zip(masks.LESIONS, ("m1", "m2", "m3", "m4", "m5"), strict=True)))
    got = {r.id: r for r in found.collect()}
    dots = got["dots"]
    assert (dots.MA.count_estimate, dots.MA.diameter_range_px, dots.MA.main_quadrant) == (100, [1, 1], "TS")
    assert dots.MA.min_dist_to_fovea_dd == round(np.hypot(0, 62) / 90, 1)
    assert (dots.HE.count_estimate, dots.HE.max_width_px, dots.HE.alert) == (101, 60, True) and "TS象限出血100处" in dots.HE.text
    assert dots.HE.quadrant_distribution.asDict() == {"TS": 100, "TI": 0, "NS": 0, "NI": 1}
    # the ellipse of 9 leaves 6 pixels in each corner and enters the gap by 3
    assert (dots.EX.hollow_area_px2, dots.EX.pattern, dots.EX.total_area_px2) == (24 * 24 - 4 * 6 + 3, masks.RING, int(broken.sum()))
    assert dots.SE.text.split("大小")[1].startswith("分别为约0.57DD²（较大）、约0.00DD²、约0.00DD²，位于后极部")
    assert dots.NV.total_count == 101 and dots.NV.nvd_count == 1 and dots.NV.nve_count == 100
    for n in ("blank", "none"):
        assert [got[n][x].present for x in masks.LESIONS] == [False] * 5 and got[n].MA.count_estimate is None and got[n].analysis.count("\n") == 4
    assert got["blank"].NV.text == masks.NO_VESSELS and got["none"].NV.text == masks.NOT_LOOKED_FOR
    lost = got["lost"]
    assert lost.MA.count_estimate == 100 and lost.MA.main_quadrant is None and lost.MA.text is None and not lost.NV.present
    assert masks.mask_findings(df.limit(0), {"MA": "m1"}).count() == 0


def test_mask_work_is_dealt_over_tasks(spark, tmp_path):
    """A table of small rows is one file and one task; what is done for each row is not."""
    from evidentia import record_queries

    spark.range(200).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for query in (record_queries.mask_components, record_queries.mask_rules):
        found = query(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
