"""Image functions against loops over pixels, and files against their images."""

import math
import os
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import images
from evidentia.sources import image_files


def noise(rng, h, w):
    return np.array([[[rng.randrange(256) for _ in range(3)] for _ in range(w)] for _ in range(h)], np.uint8)


def disc_image(size, circles, ground=60):
    y, x = np.mgrid[:size, :size]
    out = np.full((size, size, 3), ground, np.uint8)
    for cx, cy, r, level in circles:
        out[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = level
    return out


def test_smallest_circle_equals_all_pairs_and_triples():
    rng = random.Random(1)
    for _ in range(60):
        points = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 9))]
        best = None
        for i, a in enumerate(points):
            for j in range(i, len(points)):
                for k in range(j, len(points)):
                    some = [a, points[j], points[k]]
                    (x1, y1), (x2, y2), (x3, y3) = some
                    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
                    if d:
                        s = [p[0] ** 2 + p[1] ** 2 for p in some]
                        c = ((s[0] * (y2 - y3) + s[1] * (y3 - y1) + s[2] * (y1 - y2)) / d, (s[0] * (x3 - x2) + s[1] * (x1 - x3) + s[2] * (x2 - x1)) / d)
                    else:
                        p, q = max(((p, q) for p in some for q in some), key=lambda v: math.dist(*v))
                        c = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
                    for centre in (c, ((x1 + x2) / 2, (y1 + y2) / 2)):
                        r = max(math.dist(centre, p) for p in points)
                        best = r if best is None else min(best, r)
        x, y, r = images.enclosing_circle(np.array(points))
        assert r == pytest.approx(best, abs=1e-6) and all(math.dist((x, y), p) <= r + 1e-6 for p in points)


def test_resampling_equals_covered_areas():
    rng = random.Random(2)
    for h, w, nh, nw in ((7, 5, 3, 4), (4, 4, 4, 4), (3, 6, 7, 5), (1, 1, 3, 2)):
        image = noise(rng, h, w)
        got = images.resampled(image, nh, nw)
        for i in range(nh):
            for j in range(nw):
                total, area = np.zeros(3), 0.0
                for y in range(h):
                    for x in range(w):
                        part = max(0, min(y + 1, (i + 1) * h / nh) - max(y, i * h / nh)) * max(0, min(x + 1, (j + 1) * w / nw) - max(x, j * w / nw))
                        total, area = total + part * image[y, x], area + part
                assert np.abs(got[i, j] - total / area).max() <= 0.5 + 1e-6


def test_local_contrast_equals_loops():
    rng = random.Random(3)
    size, tiles, clip = 32, 4, 2.0
    levels = np.array([[rng.randrange(40, 90) + (x > 12) * 50 for x in range(size)] for _ in range(size)], np.uint8)
    t, maps = size // tiles, {}
    for a in range(tiles):
        for b in range(tiles):
            counts = [0] * 256
            for y in range(a * t, a * t + t):
                for x in range(b * t, b * t + t):
                    counts[levels[y, x]] += 1
            most = max(1, int(clip * t * t / 256))
            over = sum(max(0, c - most) for c in counts)
            counts = [min(c, most) + over // 256 for c in counts]
            rest, step = over % 256, max(256 // (over % 256), 1) if over % 256 else 0
            for k in range(rest):
                counts[k * step] += 1
            total, held = 0, []
            for c in counts:
                total += c
                held.append(min(255, round(total * 255 / (t * t))))
            maps[a, b] = held
    got = images.local_contrast(levels, clip, tiles)
    for y in range(size):
        for x in range(size):
            fy, fx = y / t - 0.5, x / t - 0.5
            ya, xa = math.floor(fy), math.floor(fx)
            clamp = lambda v: min(max(v, 0), tiles - 1)
            at = lambda a, b: maps[clamp(a), clamp(b)][levels[y, x]]  # noqa: E731, B023
            p, q = fy - ya, fx - xa
            want = (at(ya, xa) * (1 - q) + at(ya, xa + 1) * q) * (1 - p) + (at(ya + 1, xa) * (1 - q) + at(ya + 1, xa + 1) * q) * p
            assert abs(int(got[y, x]) - want) <= 0.51


def test_colours_survive_lab():
    image = noise(random.Random(4), 20, 20)
    assert np.abs(images.coloured(images.lightness(image)).astype(int) - image).max() <= 1


def test_view_and_prepared_image():
    image = disc_image(120, [(70, 50, 40, 180)], ground=3)
    assert images.view_box(image) == (30, 10, 110, 90)
    assert images.view_box(np.zeros((9, 14, 3), np.uint8)) == (0, 0, 14, 9)
    out = images.prepared(image, images.view_box(image), 64)
    assert out.shape == (64, 64, 3) and (out[0, 0] == images.OUTSIDE).all() and (out[32, 3] != images.OUTSIDE).any()
    y, x = np.mgrid[:64, :64] - 32
    assert (out[x * x + y * y > 30 * 30] == images.OUTSIDE).all()
    assert images.prepared(image, (0, 0, 120, 120), 32, soft=True).shape == (32, 32, 3)


def test_discs_are_found_and_blank_images_get_the_prior():
    rng = random.Random(5)
    for _ in range(6):
        size = 256
        x, y, r = rng.randrange(150, 200), rng.randrange(60, 190), rng.randrange(12, 22)
        image = disc_image(size, [(128, 128, 124, 90), (x, y, r, 200)], ground=128)
        image = np.clip(image.astype(int) + np.random.default_rng(1).integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
        fx, fy, fr, fovea, fovea_y, found = images.disc_of(image)
        assert found and math.dist((x, y), (fx, fy)) <= 3 and abs(r - fr) <= 3 and fovea_y == fy and fovea == max(0, round(fx - 5 * fr))
    assert images.disc_of(np.full((256, 256, 3), 90, np.uint8)) == (166, 128, 18, 76, 128, False)
    assert images.disc_of(np.zeros((1024, 1024, 3), np.uint8)) == (665, 512, 70, 315, 512, False)


def frame(spark, named, parts=1):
    rows = [(n, None if x is None else (x.shape[0], x.shape[1], bytearray(x.tobytes()))) for n, x in named]
    return spark.createDataFrame(rows, "name string, image struct<height: int, width: int, data: binary>").repartition(parts)


def test_copies_are_the_same_in_any_partitioning(spark):
    rng = random.Random(6)
    named = [(f"i{k}", noise(rng, rng.randrange(1, 20), rng.randrange(1, 20))) for k in range(12)] + [("none", None)]
    got = []
    for parts in (1, 5):
        df = frame(spark, named, parts).withColumn("a", images.augmentation(F.col("name"), F.col("image")))
        got.append({r.name: (r.a, r.c.data and (r.c.height, r.c.width, bytes(r.c.data))) for r in df.select("name", "a", images.augmented()("image", "a").alias("c")).collect()})
    assert got[0] == got[1]
    for name, x in named[:-1]:
        a, (h, w, data) = got[0][name]
        assert (h, w) == x.shape[:2] and 0.9 <= a.brightness <= 1.1 and 0.85 <= a.colour <= 1.15 and 0 <= a.x <= w - a.width and 0 <= a.y <= h - a.height
        by_hand = np.clip(np.rint(x * a.brightness), 0, 255)
        weights = np.array([0.299, 0.587, 0.114])
        mean = round(float(np.mean([round(float(p @ weights)) for p in by_hand.reshape(-1, 3)])))
        by_hand = np.clip(np.rint(mean + (by_hand - mean) * a.contrast), 0, 255)
        own = np.array([round(float(p @ weights)) for p in by_hand.reshape(-1, 3)]).reshape(h, w, 1)
        by_hand = np.clip(np.rint(own + (by_hand - own) * a.colour), 0, 255).astype(np.uint8)
        by_hand = images.resampled(by_hand[a.y : a.y + a.height, a.x : a.x + a.width], h, w)
        assert data == (by_hand[:, ::-1] if a.flip else by_hand).tobytes()
    assert got[0]["none"][1] is None


def filtered(image, kinds):
    """A PNG whose rows have the filters given, byte by byte."""
    h, w, n = image.shape
    raw = bytearray()
    for y in range(h):
        raw.append(kinds[y % len(kinds)])
        for x in range(w):
            for c in range(n):
                a = int(image[y, x - 1, c]) if x else 0
                b = int(image[y - 1, x, c]) if y else 0
                d = int(image[y - 1, x - 1, c]) if x and y else 0
                p = a + b - d
                paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, d)))[2]
                raw.append((int(image[y, x, c]) - [0, a, b, (a + b) // 2, paeth][kinds[y % len(kinds)]]) % 256)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    half = zlib.compress(bytes(raw))
    kind = {1: 0, 3: 2, 4: 6}[n]
    return images._SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"tEXt", b"x") + part(b"IDAT", half[:9]) + part(b"IDAT", half[9:]) + part(b"IEND", b"")


def test_png_of_all_filters_and_broken_files():
    rng = random.Random(7)
    image = noise(rng, 11, 6)
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (images.png_image(filtered(image, kinds)) == image).all()
    assert (images.png_image(filtered(image[..., :1], [4, 1])) == np.repeat(image[..., :1], 3, -1)).all()
    rgba = np.concatenate([image, image[..., :1]], -1)
    assert (images.png_image(filtered(rgba, [3, 4])) == image).all()
    data = images.png_bytes(image)
    assert (images.png_image(data) == image).all()
    for bad in (None, b"", data[:40], data[:-13], data.replace(b"IDAT", b"IDAX"), data[:60] + b"\0" + data[61:]):
        assert images.png_image(bad) is None


def test_images_are_written_checked_and_read(spark, tmp_path):
    rng = random.Random(8)
    named = [(f"i{k}", noise(rng, 5 + k, 9)) for k in range(6)] + [("none", None)]
    folder = f"file://{tmp_path}/png"
    done = {r.name: r for r in image_files.write_images(frame(spark, named, 3), "name", "image", folder).collect()}
    assert done["none"].error == "no image" and all(done[n].error is None and done[n].length > 0 for n, x in named if x is not None)
    assert sorted(os.listdir(tmp_path / "png")) == [f"i{k}.png" for k in range(6)]
    (tmp_path / "png" / "i1.png").write_bytes(b"broken")
    read = {r.name: r.image for r in image_files.read_images(spark, folder).collect()}
    assert read["i1"] is None and all(bytes(read[n].data) == x.tobytes() for n, x in named if x is not None and n != "i1")
    image_files.write_images(frame(spark, [(n, x) for n, x in named if n != "i0"] + [("i0", noise(rng, 2, 2))]), "name", "image", folder).collect()
    read = {r.name: r.image for r in image_files.read_images(spark, folder).collect()}
    assert bytes(read["i1"].data) == named[1][1].tobytes() and read["i0"].height == 5  # mended, and kept
    again = image_files.write_images(frame(spark, [("i0", named[1][1])]), "name", "image", folder, overwrite=True).first()
    assert again.crc32 == zlib.crc32((tmp_path / "png" / "i0.png").read_bytes())


def test_image_work_is_dealt_over_tasks(spark, tmp_path):
    """A table of small rows is one file and one task; what is done for each row is not."""
    from evidentia import image_queries

    spark.range(200).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert image_queries._views(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() > 3
    found = image_queries.discs_or_prior(spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_drawn_images_leave_by_parts():
    from evidentia import image_queries

    disc = [{"x": 2, "y": 2, "r": 1, "grey": 9}]
    sizes = [len(f) for f in image_queries._drawn(4).func(iter([pd.Series([disc] * 150)]))]
    assert sum(sizes) == 150 and max(sizes) <= image_queries.DRAWN_AT_ONCE


def test_large_images_leave_by_bytes():
    from evidentia import image_queries

    disc = [{"x": 2, "y": 2, "r": 1, "grey": 9}]
    drawn = list(image_queries._drawn(256).func(iter([pd.Series([disc] * 64)])))
    assert sum(map(len, drawn)) == 64 and max(f["data"].map(len).sum() for f in drawn) <= 2 << 20
    numbers = pd.DataFrame([(1.0, 1.0, 1.0, 0, 0, 256, 256, False)] * 64, columns=["brightness", "contrast", "colour", "x", "y", "width", "height", "flip"])
    copies = list(images.augmented().func(iter([(pd.concat(drawn), numbers)])))
    assert sum(map(len, copies)) == 64 and max(f["data"].map(len).sum() for f in copies) <= 2 << 20
    again = list(images.decoded_png().func(iter([pd.Series([images.png_bytes(np.zeros((600, 600, 3), np.uint8))] * 4 + [b"no"])])))
    assert [len(f) for f in again] == [1, 1, 1, 2] and again[-1]["data"].iloc[-1] is None


def test_files_are_written_and_read_in_small_batches(spark, tmp_path, monkeypatch):
    """By the sink and the reader themselves, whatever made the images; a task's rows don't decide what Python holds."""
    key, most, real = "spark.sql.execution.arrow.maxBytesPerBatch", images.PART_BYTES, images._images

    def noted(batch):
        with open(f"{tmp_path}/sizes", "a") as out:
            out.write(f"{batch['data'].map(len).sum()}\n")
        return real(batch)

    monkeypatch.setattr(image_files, "_images", noted)
    folder = f"file://{tmp_path}/png"
    df = spark.range(40).repartition(1).select(F.concat(F.lit("i"), "id").alias("name"), F.struct(F.lit(256).alias("height"), F.lit(256).alias("width"), F.unhex(F.repeat(F.lit("0a"), 256 * 256 * 3)).alias("data")).alias("image"))
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        assert image_files.write_images(df, "name", "image", folder).where("error IS NULL").count() == 40
        sizes = [int(n) for n in (tmp_path / "sizes").read_text().split()]
        assert sum(sizes) == 40 * 256 * 256 * 3 and max(sizes) <= most + 256 * 256 * 3  # Spark ends a batch after the row that fills it
        spark.conf.unset(key)
        read = image_files.read_images(spark, folder)
        assert spark.conf.get(key) == images.BATCH_BYTES
        assert read.where(F.length("image.data") == 256 * 256 * 3).count() == 40
    finally:
        spark.conf.set(key, before)
