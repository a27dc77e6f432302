"""Colour images: field of view, local contrast, the disc and its prior, augmented copies, and PNG bytes.

An image is a struct of height, width and data (red, green and blue of each pixel, row by row). Each function works on
one image of an Arrow batch at a time; what Spark can say in columns (sizes, boxes, an augmentation's numbers) is said
in columns. Where there is no image, or its data have another length than its sides say, the result's fields are NULL.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.raster import MASK, components

IMAGE = MASK
BOX = T.ArrayType(T.IntegerType())
# Darkness up to which a pixel is outside the field of view; tiles and levels of the local contrast; the
# grey of what lies outside the circle.
DARK, TILES, LEVELS, OUTSIDE = 15, 8, 256, 128
CLIP, SOFT_CLIP = 2.0, 1.5


#: Bytes of a batch that goes to Python, and of images that come back from it at once: each of a task's functions holds
#: some copies of both, however many rows a task has.
BATCH_BYTES, PART_BYTES, _DEFAULT_BATCH_BYTES = "2m", 2 << 20, 64 << 20


def in_image_batches(df: DataFrame) -> DataFrame:
    """The same frame, after a session that still has Spark's default of bytes a batch for Python has got a smaller one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key).lower() in (f"{_DEFAULT_BATCH_BYTES}b", "64mb", "64m"):
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def _images(batch: pd.DataFrame) -> Iterator[np.ndarray | None]:
    for h, w, data in zip(batch["height"], batch["width"], batch["data"], strict=True):
        whole = data is not None and not pd.isna(h) and not pd.isna(w) and len(data) == int(h) * int(w) * 3 and len(data) > 0
        yield np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3) if whole else None


def image_rows(images: Iterable[np.ndarray | None]) -> Iterator[pd.DataFrame]:
    """The images' fields, in frames of at most PART_BYTES or one image: small rows can yield large images."""
    rows, held = [], 0
    for x in images:
        if rows and held + (0 if x is None else x.nbytes) > PART_BYTES:
            yield pd.DataFrame(rows, columns=MASK.names)
            rows, held = [], 0
        rows.append((None, None, None) if x is None else (*x.shape[:2], x.tobytes()))
        held += 0 if x is None else x.nbytes
    yield pd.DataFrame(rows, columns=MASK.names)


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around points (x, y).

    The farthest point outside the circle so far goes on the border of the next, whose few border points are found among
    the last ones and itself; each circle is larger than the last, so this ends after few steps."""

    def through(*on: np.ndarray) -> tuple[np.ndarray, float]:
        if len(on) == 1:
            return on[0], 0.0
        a, b = on[0], on[1]
        if len(on) == 3:
            m = 2 * np.array([b - a, on[2] - a])
            if abs(np.linalg.det(m)) > 1e-9:
                centre = np.linalg.solve(m, [b @ b - a @ a, on[2] @ on[2] - a @ a])
                return centre, float(np.hypot(*(centre - a)))
            a, b = max(((p, q) for p in on for q in on), key=lambda pq: np.hypot(*(pq[0] - pq[1])))
        return (a + b) / 2, float(np.hypot(*(a - b))) / 2

    def around(some: np.ndarray, *on: np.ndarray) -> tuple[np.ndarray, float]:
        centre, radius = through(*on) if on else through(some[0])
        at = 0
        while True:
            far = np.flatnonzero(np.hypot(*(some[at:] - centre).T) > radius + 1e-7)
            if not len(far):
                return centre, radius
            at += int(far[0])
            centre, radius = around(some[:at], *on, some[at]) if len(on) < 2 and at else through(*on, some[at])
            at += 1

    points = np.unique(points.astype(float), axis=0)
    border, centre, radius = points[:1], points[0], 0.0
    while True:
        gaps = np.hypot(*(points - centre).T)
        far = int(np.argmax(gaps))
        if gaps[far] <= radius + 1e-7:
            break
        border = np.concatenate([border, points[far : far + 1]])
        before, (centre, radius) = radius, around(border)
        if radius <= before:  # rounding alone; all points in turn
            centre, radius = around(np.random.default_rng(0).permutation(points))
            break
        border = border[np.abs(np.hypot(*(border - centre).T) - radius) <= 1e-7]
    return float(centre[0]), float(centre[1]), radius


def view_box(image: np.ndarray) -> tuple[int, int, int, int]:
    """The box (x1, y1, x2, y2) of the circle around the largest bright part, or the whole image where there is none."""
    found = components(grey(image) > DARK)
    h, w = image.shape[:2]
    if found:
        runs = max(found, key=lambda c: int((c[:, 2] - c[:, 1]).sum()))
        edge = np.concatenate([runs[:, [1, 0]], np.stack([runs[:, 2] - 1, runs[:, 0]], 1)])
        x, y, r = (int(v + 1e-6) for v in enclosing_circle(edge))
        box = max(0, x - r), max(0, y - r), min(w, x + r), min(h, y + r)
        if box[2] > box[0] and box[3] > box[1]:
            return box
    return 0, 0, w, h


def resampled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers."""
    out = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        m = out.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        edges = np.arange(n + 1) * m / n
        low = np.minimum(edges.astype(int), m - 1)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        at = np.take(sums, low, axis) * (1 - part) + np.take(sums, low + 1, axis) * part
        out = np.diff(at, axis=axis) * n / m
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = _TO_XYZ.sum(1)


def lightness(image: np.ndarray) -> np.ndarray:
    """L of Lab from 0 to 255, and the image's Lab."""
    c = image / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def coloured(lab: np.ndarray) -> np.ndarray:
    """The image of a Lab array."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    return np.clip(np.rint(255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)), 0, 255).astype(np.uint8)


def local_contrast(levels: np.ndarray, clip: float, tiles: int = TILES) -> np.ndarray:
    """Histogram equalisation by tiles with a limit on each level, blended between the tiles' centres."""
    h, w = levels.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(levels, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    blocks = padded.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(b, minlength=LEVELS) for b in blocks])
    most = max(1, int(clip * th * tw / LEVELS))
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + (over // LEVELS)[:, None]
    for row, rest in zip(counts, over % LEVELS, strict=True):
        if rest:
            row[: rest * max(LEVELS // rest, 1) : max(LEVELS // rest, 1)] += 1
    maps = np.clip(np.rint(np.cumsum(counts, 1) * (LEVELS - 1) / (th * tw)), 0, LEVELS - 1).reshape(tiles, tiles, LEVELS)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    y0, y1, fy = between(h, th)
    x0, x1, fx = between(w, tw)
    at = lambda y, x: maps[y[:, None], x[None], levels]
    top, bottom = (at(y, x0) * (1 - fx) + at(y, x1) * fx for y in (y0, y1))
    return np.rint(top * (1 - fy[:, None]) + bottom * fy[:, None]).astype(np.uint8)


def _smoothed(levels: np.ndarray) -> np.ndarray:
    """A blur over three by three pixels with the weights 1, 2, 1."""
    p = np.pad(levels.astype(float), 1, mode="reflect" if min(levels.shape) > 1 else "edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16).astype(np.uint8)


def prepared(image: np.ndarray, box: tuple[int, int, int, int], size: int, soft: bool = False) -> np.ndarray:
    """The field of view at `size`, with local contrast in its lightness and grey outside the circle."""
    lab = lightness(resampled(image[box[1] : box[3], box[0] : box[2]], size, size))
    levels = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    levels = local_contrast(_smoothed(levels), SOFT_CLIP) if soft else local_contrast(levels, CLIP)
    out = coloured(np.concatenate([levels[..., None] / 2.55, lab[..., 1:]], -1))
    y, x = np.mgrid[:size, :size] - size // 2
    out[x * x + y * y > max(size // 2 - 2, 0) ** 2] = OUTSIDE
    return out


def view_boxes() -> Column:
    """A function of an image: the box of its field of view."""

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else list(view_box(x)) for x in _images(batch)], dtype=object)

    return F.pandas_udf(boxes, BOX)


def prepared_views(size: int, soft: bool = False):
    """A function of an image and its box: the prepared image."""

    def prepare(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for images, boxes in batches:
            yield from image_rows(None if x is None or b is None else prepared(x, tuple(map(int, b)), size, soft) for x, b in zip(_images(images), boxes, strict=True))

    return F.pandas_udf(prepare, IMAGE)


# Fixed values, of an image of 1024 pixels: radii of a disc, steepness of an edge, votes of a centre and how far centres
# are apart; and where a disc is supposed where none is found, with the distance to the fovea in diameters.
SIDE, RADII, STEEP, VOTES, APART, CENTRES = 1024, (40, 120), 50, 30, 100, 5
#: Votes that are counted at once.
VOTES_AT_ONCE = 1 << 18
#: Edge pixels, for each of its own, that a circle must have; arcs of other circles have few.
DRAWN = 0.75
PRIOR = (0.65, 0.5, 70)
FOVEA = 2.5
#: A plausible disc's distance from the border, at least, in pixels and in radii; and the distance of disc
#: and fovea, from and to, in diameters of so many pixels.
MARGIN, DIAMETER, NEAR, FAR = (8, 0.3), 90, 1.5, 5.0
DISC = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "radius", "fovea_x", "fovea_y")] + [T.StructField("found", T.BooleanType())])


def circles(levels: np.ndarray, radii: tuple[int, int], steep: float, votes: int, apart: float) -> list[tuple[int, int, int]]:
    """(x, y, radius) of circles, those with most votes first.

    Every edge pixel votes along its gradient for the centres at all radii; of the pixels with most votes around, the
    radius is the one at which most edge pixels for its length stand."""
    h, w = levels.shape
    p = np.pad(levels.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    strength = np.hypot(gx, gy)
    y, x = np.nonzero(strength > steep)
    if not len(y):
        return []
    ux, uy = gx[y, x] / strength[y, x], gy[y, x] / strength[y, x]
    held = np.zeros(h * w, np.int64)
    steps = np.array([side * r for r in range(radii[0], radii[1] + 1) for side in (-1, 1)])[:, None]
    at_once = max(1, VOTES_AT_ONCE // len(y))
    for i in range(0, len(steps), at_once):
        cx, cy = np.rint(x + steps[i : i + at_once] * ux).astype(int), np.rint(y + steps[i : i + at_once] * uy).astype(int)
        inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        held += np.bincount(cy[inside] * w + cx[inside], minlength=h * w)
    sums = np.pad(held.reshape(h, w), 1)
    near = sum(sums[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    out: list[tuple[int, int, int]] = []
    enough = np.flatnonzero(near > votes)
    for at in enough[np.argsort(-near.ravel()[enough], kind="stable")][: 50 * CENTRES]:
        cy, cx = divmod(int(at), w)
        if len(out) == CENTRES:
            break
        if any((cx - a) ** 2 + (cy - b) ** 2 < apart * apart for a, b, _ in out):
            continue
        far = np.rint(np.hypot(x - cx, y - cy)).astype(int)
        count = np.bincount(far[far <= radii[1] + 1], minlength=radii[1] + 2)[: radii[1] + 2]
        smooth = count + np.concatenate([[0], count[:-1]]) + np.concatenate([count[1:], [0]])
        scale = np.arange(radii[0], radii[1] + 1)
        drawn = smooth[radii[0] : radii[1] + 1] / (2 * np.pi * scale)
        if drawn.max() < DRAWN:
            continue
        # the circle through the edge pixels around, by least squares
        on = np.abs(np.hypot(x - cx, y - cy) - scale[np.argmax(drawn)]) <= 3
        a, b, c = np.linalg.lstsq(np.stack([2 * x[on], 2 * y[on], np.ones(on.sum())], 1), (x * x + y * y)[on], rcond=None)[0]
        out.append((round(float(a)), round(float(b)), round(float(np.sqrt(max(c + a * a + b * b, 0))))))
    return out


def disc_of(image: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """Disc, its radius and the fovea: the largest circle whose fovea is plausible, or the prior."""
    h, w = image.shape[:2]
    scale = w / SIDE
    found = circles(grey(image), (max(2, round(RADII[0] * scale)), max(3, round(RADII[1] * scale))), STEEP, VOTES, APART * scale)
    for x, y, r in sorted(found, key=lambda c: -c[2]):
        fovea = min(max(round(x - 2 * FOVEA * r), 0), w - 1)
        margin = max(int(MARGIN[0] * scale), int(r * MARGIN[1]))
        inside = margin <= x <= w - 1 - margin and margin <= y <= h - 1 - margin
        if inside and NEAR <= (x - fovea) / (DIAMETER * scale) <= FAR:
            return x, y, r, fovea, y, True
    x, y, r = int(w * PRIOR[0]), int(h * PRIOR[1]), round(PRIOR[2] * scale)
    return x, y, r, int(min(max(x - 2 * FOVEA * r, 0), w - 1)), y, False


def discs():
    """A function of a prepared image: disc, radius, fovea and whether a disc was found."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(None,) * 6 if x is None else disc_of(x) for x in _images(batch)], columns=DISC.names, dtype=object)

    return F.pandas_udf(find, DISC)


# How far brightness, contrast and colour go either way, and the least share that a crop keeps.
BRIGHTNESS, CONTRAST, COLOUR, LEAST_CROP = 0.10, 0.10, 0.15, 0.85


def augmentation(key: Column, image: Column) -> Column:
    """The numbers of an augmented copy, drawn by the key's sha1 alone: brightness, contrast, colour, x, y, width, height
    of the crop, and flip."""

    def drawn(name: str) -> Column:
        number = F.conv(F.substring(F.sha1(F.concat_ws("::", key.cast("string"), F.lit(name)).cast("binary")), 1, 12), 16, 10)
        return number.cast("double") / float(16**12)

    around = lambda name, by: F.round(1 + (2 * drawn(name) - 1) * by, 6)
    ratio = LEAST_CROP + drawn("crop") * (1 - LEAST_CROP)
    width, height = (F.greatest(F.floor(image[side] * ratio).cast("int"), F.lit(1)) for side in ("width", "height"))
    place = lambda name, side, size: F.floor(drawn(name) * (image[side] - size + 1)).cast("int")
    return F.struct(
        around("brightness", BRIGHTNESS).alias("brightness"), around("contrast", CONTRAST).alias("contrast"), around("colour", COLOUR).alias("colour"),
        place("x", "width", width).alias("x"), place("y", "height", height).alias("y"), width.alias("width"), height.alias("height"), (drawn("flip") < 0.5).alias("flip"),
    )


def augmented_copy(image: np.ndarray, brightness: float, contrast: float, colour: float, x: int, y: int, width: int, height: int, flip: bool) -> np.ndarray:
    """Brightness, contrast around the mean grey, colour around each pixel's grey, crop and scale, and mirror."""
    out = np.clip(np.rint(image * brightness), 0, 255)
    mean = np.rint(grey(out.astype(np.uint8)).mean())
    out = np.clip(np.rint(mean + (out - mean) * contrast), 0, 255)
    own = grey(out.astype(np.uint8))[..., None].astype(float)
    out = np.clip(np.rint(own + (out - own) * colour), 0, 255).astype(np.uint8)
    out = resampled(out[y : y + height, x : x + width], *image.shape[:2])
    return out[:, ::-1].copy() if flip else out


def augmented():
    """A function of an image and the struct of its augmentation: the copy."""

    def copy(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for images, numbers in batches:
            drawn = zip(*(numbers[c] for c in ("brightness", "contrast", "colour", "x", "y", "width", "height", "flip")), strict=True)
            yield from image_rows(None if x is None else augmented_copy(x, *d[:3], *map(int, d[3:7]), bool(d[7])) for x, d in zip(_images(images), drawn, strict=True))

    return F.pandas_udf(copy, IMAGE)


_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of eight-bit colours; each row is stored as the difference to the row above or to the pixel before."""
    h, w = image.shape[:2]
    flat = image.reshape(h, w * 3).astype(np.int16)
    up = np.diff(flat, axis=0, prepend=np.zeros((1, w * 3), np.int16)) & 255
    left = flat.copy()
    left[:, 3:] -= flat[:, :-3]
    left &= 255
    cost = [np.minimum(a, 256 - a).sum(1) for a in (left, up)]
    kind = np.where(cost[0] <= cost[1], 1, 2)
    rows = np.where((kind == 1)[:, None], left, up).astype(np.uint8)
    raw = np.concatenate([kind[:, None].astype(np.uint8), rows], 1).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def png_image(data: bytes | None) -> np.ndarray | None:
    """The image of a PNG of eight-bit grey or colour without interlacing; None for anything else and for broken files."""
    if not data or data[:8] != _SIGNATURE:
        return None
    at, held, head = 8, b"", None
    while at + 12 <= len(data):
        size, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            return None
        head = struct.unpack(">IIBBBBB", body) if name == b"IHDR" else head
        held += body if name == b"IDAT" else b""
        at += 12 + size
        if name == b"IEND":
            break
    else:
        return None
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        return None
    w, h, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(held), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((h + 1, w, n), np.int64)
    for i, (kind, row) in enumerate(zip(raw[:, 0], raw[:, 1:].reshape(h, w, n).astype(np.int64), strict=True)):
        above = out[i]
        if kind == 2:
            row = row + above
        elif kind == 1:
            row = np.cumsum(row, 0)
        elif kind:
            left = corner = np.zeros(n, np.int64)
            for x in range(w):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    a, b, c = (np.abs(v) for v in (above[x] - corner, left - corner, left + above[x] - 2 * corner))
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                row[x] = left = (row[x] + guess) & 255
                corner = above[x]
        out[i + 1] = row & 255
    image = out[1:].astype(np.uint8)
    return np.repeat(image[..., :1], 3, -1) if n < 3 else np.ascontiguousarray(image[..., :3])


def decoded_png():
    """A function of a file's bytes: its image."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from image_rows(map(png_image, batch))

    return F.pandas_udf(decode, IMAGE)
