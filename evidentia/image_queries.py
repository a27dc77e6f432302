"""Queries of images that are drawn from the driver's tables, and of the progress of folders of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import images
from evidentia.plans import folders
from evidentia.queries import _query, _spread, _t
from evidentia.record_queries import _folder
from evidentia.sources import image_files


#: Images of a part of a batch, at most.
DRAWN_AT_ONCE = 64


def _drawn(size: int):
    """A function of lists of (x, y, radius, grey): an image with these discs, one over the other, on black."""

    @F.pandas_udf(images.IMAGE)
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:size, :size]

        def image(discs: list) -> np.ndarray:
            out = np.zeros((size, size), np.uint8)
            for d in discs:
                out[(x - d["x"]) ** 2 + (y - d["y"]) ** 2 <= d["r"] ** 2] = d["grey"]
            return out.repeat(3).reshape(size, size, 3)

        for batch in batches:
            # a batch has many rows of few numbers, so their images go out by parts
            for at in range(0, len(batch), DRAWN_AT_ONCE):
                yield from images.image_rows(map(image, batch[at : at + DRAWN_AT_ONCE]))

    return draw


def _discs(*discs: tuple) -> Column:
    each = [[(F.lit(v) if isinstance(v, int) else v).cast("int").alias(n) for n, v in zip(("x", "y", "r", "grey"), d, strict=True)] for d in discs]
    return F.array(*[F.struct(*fields) for fields in each])


def _views(spark, sf_dir: str) -> DataFrame:
    """An image for each supplier with a field of view of its own, and none for some."""
    k = F.col("s_suppkey")
    view = F.when(k % 9 == 0, _discs((0, 0, -1, 0))).otherwise(_discs((50 + k % 7, 44 + k % 11, 30 + k % 5, 90), (46 + k % 7, 40, 6, 200)))
    return images.in_image_batches(_spread(_t(spark, sf_dir, "supplier"), "s_suppkey")).select("s_suppkey", _drawn(96)(view).alias("image"))


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE (50 + s_suppkey % 7) - (30 + s_suppkey % 5) END::INTEGER AS x1, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE (44 + s_suppkey % 11) - (30 + s_suppkey % 5) END::INTEGER AS y1,
  CASE WHEN s_suppkey % 9 = 0 THEN 96 ELSE (50 + s_suppkey % 7) + (30 + s_suppkey % 5) END::INTEGER AS x2, CASE WHEN s_suppkey % 9 = 0 THEN 96 ELSE (44 + s_suppkey % 11) + (30 + s_suppkey % 5) END::INTEGER AS y2, 48 AS size, 128 AS corner FROM supplier""")
def fields_of_view(spark, sf_dir):
    """The box of each image's field of view, and the prepared image's size and corner."""
    rows = _views(spark, sf_dir).withColumn("box", images.view_boxes()("image"))
    made = rows.withColumn("view", images.prepared_views(48)("image", "box"))
    corner = F.conv(F.hex(F.substring(F.col("view.data"), 1, 1)), 16, 10).cast("int")
    return made.select("s_suppkey", *[F.col("box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("view.width").alias("size"), corner.alias("corner"))


@_query("""SELECT s_suppkey, s_suppkey % 4 > 0 AS found, CASE WHEN s_suppkey % 4 > 0 THEN true ELSE NULL END AS near, CASE WHEN s_suppkey % 4 > 0 THEN NULL ELSE 166 END AS prior_x FROM supplier""")
def discs_or_prior(spark, sf_dir):
    """Drawn discs found within three pixels, and the prior where none is drawn."""
    k = F.col("s_suppkey")
    x, y, r = 150 + k % 50, 80 + k % 90, 13 + k % 8
    image = F.when(k % 4 > 0, _discs((128, 128, 400, 128), (x, y, r, 210))).otherwise(_discs((128, 128, 400, 90)))
    rows = images.in_image_batches(_spread(_t(spark, sf_dir, "supplier"), "s_suppkey")).select("s_suppkey", x.alias("x"), y.alias("y"), r.alias("r"), _drawn(256)(image).alias("image"))
    found = rows.withColumn("d", images.discs()("image"))
    near = (F.hypot(F.col("d.x") - F.col("x"), F.col("d.y") - F.col("y")) <= 3) & (F.abs(F.col("d.radius") - F.col("r")) <= 3)
    return found.select("s_suppkey", F.col("d.found").alias("found"), F.when(F.col("d.found"), near).alias("near"), F.when(~F.col("d.found"), F.col("d.x")).alias("prior_x"))


def _unit(name: str) -> str:
    return f"(CAST('0x' || substr(sha1(s_suppkey || '::copy::{name}'), 1, 12) AS BIGINT)::DOUBLE / 281474976710656)"


_SIDE = f"floor(96 * (0.85::DOUBLE + {_unit('crop')} * (1 - 0.85::DOUBLE)))"


@_query(f"""SELECT s_suppkey, round(1 + (2 * {_unit("brightness")} - 1) * 0.1::DOUBLE, 6) AS brightness, round(1 + (2 * {_unit("contrast")} - 1) * 0.1::DOUBLE, 6) AS contrast, round(1 + (2 * {_unit("colour")} - 1) * 0.15::DOUBLE, 6) AS colour,
  floor({_unit("x")} * (97 - {_SIDE}))::INTEGER AS x, floor({_unit("y")} * (97 - {_SIDE}))::INTEGER AS y, {_SIDE}::INTEGER AS side, {_unit("flip")} < 0.5 AS flip, 27648 AS bytes FROM supplier""")
def augmented_views(spark, sf_dir):
    """An augmented copy of each image with its numbers, which its key alone decides."""
    rows = _views(spark, sf_dir).withColumn("a", images.augmentation(F.concat(F.col("s_suppkey").cast("string"), F.lit("::copy")), F.col("image")))
    made = rows.withColumn("copy", images.augmented()("image", "a"))
    return made.select("s_suppkey", "a.brightness", "a.contrast", "a.colour", "a.x", "a.y", F.col("a.width").alias("side"), "a.flip", F.length("copy.data").alias("bytes"))


@_query("SELECT 'i' || s_suppkey AS name, true AS same, true AS written FROM supplier")
def written_images(spark, sf_dir):
    """Images written as files, checked, and read back."""
    folder = f"{_folder(spark)}/png"
    rows = _views(spark, sf_dir).select(F.concat(F.lit("i"), "s_suppkey").alias("name"), "image")
    done = image_files.write_images(rows, "name", "image", folder)
    done.write.parquet(f"{folder}-done")
    read = image_files.read_images(spark, folder).select("name", F.col("image.data").alias("again"))
    state = spark.read.schema(done.schema).parquet(f"{folder}-done").select("name", (F.col("error").isNull() & (F.col("length") > 0)).alias("written"))
    return rows.join(read, "name", "left").join(state, "name", "left").select("name", F.coalesce(F.col("image.data") == F.col("again"), F.lit(False)).alias("same"), "written")


_FACTS = """f AS (SELECT s_suppkey AS k, (s_suppkey % 4)::DOUBLE AS he, (s_suppkey % 3)::DOUBLE AS ex, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 7 / 10.0::DOUBLE END AS cdr,
  CASE s_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS eye, s_suppkey % 2 = 0 AS qc, s_suppkey % 10 = 0 AS odd FROM supplier WHERE s_suppkey % 6 > 0)"""


@_query(f"""WITH {_FACTS} SELECT count(*) AS scanned, (SELECT count(*) FROM supplier) AS total, count(*) AS done, (SELECT count(*) FROM supplier) - count(*) AS missing, avg((he > 0)::INT)::DOUBLE AS he_rate, avg((ex > 0)::INT)::DOUBLE AS ex_rate, 0.0::DOUBLE AS se_rate,
  count(*) FILTER (WHERE eye = 'left') AS eye_left, count(*) FILTER (WHERE eye = 'right') AS eye_right, count(*) FILTER (WHERE eye = 'unknown') AS eye_unknown, avg(qc::INT)::DOUBLE AS qc_rate, avg(odd::INT)::DOUBLE AS odd_rate,
  count(cdr) AS cdr_n, list_sort(list(cdr) FILTER (WHERE cdr IS NOT NULL))[round_even(0.5 * (count(cdr) - 1), 0)::INT + 1] AS cdr_p50, sum(he * 2)::BIGINT AS he_st FROM f""")
def progress_of_a_folder(spark, sf_dir):
    """How far a folder of one document per entity is, by the files that are there, and what the documents say."""
    folder, k = _folder(spark), F.col("s_suppkey")
    block = lambda n: F.struct(n.alias("count"), F.lit(100.0).alias("area_px"), F.struct((2 * n).alias("superior_temporal")).alias("quadrant_distribution"))
    disc = F.struct(F.array(F.lit(5.0), F.lit(7.0)).alias("center"), F.lit(10.0).alias("radius"))
    cup = F.struct(F.when(k % 3 == 0, "LEFT").when(k % 3 == 1, "right").alias("eye_side"), F.struct(F.when(k % 5 > 0, k % 7 / 10.0).alias("value")).alias("cup_disc_ratio"), disc.alias("disc"))
    macula = F.struct(F.struct(F.lit(9.0).alias("x"), F.when(k % 10 == 0, 50.0).otherwise(8.0).alias("y")).alias("center"))
    measured = F.struct(cup.alias("optic_disc_cup"), F.struct((k % 2 == 0).alias("qc_flag")).alias("vessels"), macula.alias("macula"))
    doc = F.to_json(F.struct(F.struct(block(k % 4).alias("HE"), block(k % 3).alias("EX")).alias("lesions"), measured.alias("measurements")))
    entities = _spread(_t(spark, sf_dir, "supplier"), "s_suppkey").select(F.concat(F.lit("e"), k).alias("entity"), doc.alias("value"), k.alias("k"))
    entities.where("k % 6 > 0").select("entity", "value").write.partitionBy("entity").text(folder)
    state = folders.folder_progress(spark, folder, entities.count())
    said = folders.summary_of_documents(folders.recent_documents(spark, folder, None))
    both = said.join(F.broadcast(state.select("total", "done", "missing")), how="inner", on=F.lit(True))
    return both.select("scanned", "total", "done", "missing", "he_rate", "ex_rate", "se_rate", "eye_left", "eye_right", "eye_unknown", "qc_rate", "odd_rate", "cdr_n", "cdr_p50", "he_st")
