"""Facts of masks: 8-connected components, their properties, and alignment to a crop.

A mask is a struct of height, width and data (one byte per pixel, row by row); anything above 0 belongs to it. Images
are read by Spark's binary source and decoded by the caller, since no image library is required here. Each mask is
worked on by itself in an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("area", "cx", "cy", "x1", "y1", "x2", "y2", "major_axis", "minor_axis")]))
FACTS = T.StructType([T.StructField("present", T.BooleanType()), T.StructField("component_count", T.IntegerType()), T.StructField("mask_area", T.LongType()), T.StructField("mask_fraction", T.DoubleType()), T.StructField("distribution", T.StringType())])
MASK = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])
# Components up to which a mask is isolated or multifocal, and from which it can be diffuse.
ISOLATED, MULTIFOCAL, DIFFUSE = 1, 5, 12


def _joined_runs(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Runs (row, first, end), those of a component together and in the order of rows, and where each component begins."""
    reach = 1 if corners else 0
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask > 0
    change = np.diff(padded, axis=1)
    rows, first = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    runs = np.stack([rows, first, end], axis=1)
    if not len(runs):
        return runs, np.zeros(0, np.int64)
    # plain numbers, which are faster one by one
    at, starts, ends = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist(), first.tolist(), end.tolist()
    parent = list(range(len(starts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for r in range(1, mask.shape[0]):
        i, j = at[r - 1], at[r]
        while i < at[r] and j < at[r + 1]:
            if starts[i] < ends[j] + reach and starts[j] < ends[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(parent))], np.int64)
    order = np.argsort(roots, kind="stable")
    return runs[order], np.flatnonzero(np.diff(roots[order], prepend=-1))


def components(mask: np.ndarray, corners: bool = True) -> list[np.ndarray]:
    """Runs (row, first, end) of each component, joined run by run; pixels that meet at a corner are joined too (8
    neighbours) or not (4)."""
    runs, starts = _joined_runs(mask, corners)
    return np.split(runs, starts[1:]) if len(runs) else []


def _measured(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Area, centroid (x, y) and box (x1, y1, x2, y2) of all components at once."""
    runs, starts = _joined_runs(mask)
    if not len(runs):
        return (np.zeros(0, np.int64),) * 7
    row, first, end = runs.T
    n = end - first
    total = lambda v: np.add.reduceat(v, starts)
    area = total(n)
    x, y = total(n * (first + end - 1) / 2) / area, total(n * row) / area
    return area, x, y, np.minimum.reduceat(first, starts), np.minimum.reduceat(row, starts), np.maximum.reduceat(end, starts), np.maximum.reduceat(row, starts) + 1


def _arrays(batch: pd.DataFrame) -> Iterator[np.ndarray | None]:
    for h, w, data in zip(batch["height"], batch["width"], batch["data"], strict=True):
        yield None if data is None or pd.isna(h) or pd.isna(w) else np.frombuffer(data, np.uint8).reshape(int(h), int(w))


def facts_of(mask: np.ndarray) -> tuple:
    areas, xs, ys, *_ = _measured(mask)
    count, area, h, w = len(areas), int(areas.sum()), *mask.shape
    if count <= ISOLATED:
        spread = "isolated"
    elif count <= MULTIFOCAL:
        spread = "multifocal"
    else:
        quarters = np.unique((ys >= h / 2) * 2 + (xs >= w / 2))
        spread = "diffuse" if len(quarters) == 4 and count >= DIFFUSE else "scattered"
    return bool(area), count, area, area / max(mask.size, 1), spread if area else None


@F.pandas_udf(FACTS)
def mask_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """present, component_count, mask_area, mask_fraction and distribution of each mask."""
    for batch in batches:
        rows = [(None,) * 5 if m is None else facts_of(m) for m in _arrays(batch)]
        yield pd.DataFrame(rows, columns=FACTS.names, dtype=object)


@F.pandas_udf(PROPS)
def component_props(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Area, rounded centroid, bounding box (ends exclusive) and its longer and shorter side of each component."""
    for batch in batches:
        out = []
        for m in _arrays(batch):
            props = []
            if m is not None:
                area, x, y, x1, y1, x2, y2 = _measured(m)
                across, down = x2 - x1, y2 - y1
                columns = (area, np.rint(x).astype(int), np.rint(y).astype(int), x1, y1, x2, y2, np.maximum(across, down), np.minimum(across, down))
                props = [dict(zip(PROPS.elementType.names, p, strict=True)) for p in zip(*(c.tolist() for c in columns), strict=True)]
            out.append(None if m is None else props)
        yield pd.Series(out, dtype=object)


def _ellipse(k: int) -> list[int]:
    """Half the width of each row of the ellipse of k rows."""
    r = k // 2
    return [round(math.sqrt(r * r - y * y)) for y in range(-r, r + 1)]


def _spread(mask: np.ndarray, k: int) -> np.ndarray:
    """The mask and all that the ellipse covers around its pixels, within the image."""
    h, w = mask.shape
    out, before = np.zeros((h, w), bool), np.zeros((h, w + 1), np.int32)
    np.cumsum(mask, axis=1, out=before[:, 1:])
    across = np.arange(w)
    for dy, half in zip(range(-(k // 2), k // 2 + 1), _ellipse(k), strict=True):
        rows = (before[:, np.minimum(across + half + 1, w)] - before[:, np.maximum(across - half, 0)]) > 0
        a, b = max(dy, 0), h + min(dy, 0)
        if a < b:
            out[a:b] |= rows[a - dy : b - dy]
    return out


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Closing by an ellipse of k rows (odd): gaps that it can't enter are filled. What lies outside the image neither
    adds to the mask nor takes from it."""
    return ~_spread(~_spread(mask > 0, k), k) if k > 1 else mask > 0


def enclosed(mask: np.ndarray) -> int:
    """Pixels beside the mask that no path over sides joins to the first pixel of the image."""
    runs, starts = _joined_runs(~(mask > 0), corners=False)
    if not len(runs):
        return 0
    areas = np.add.reduceat(runs[:, 2] - runs[:, 1], starts)
    # the component of the first pixel, if it is not of the mask, is the first
    return int(areas.sum() - (areas[0] if tuple(runs[0, :2]) == (0, 0) else 0))


def hollow_area(kernels: Sequence[int]):
    """A function of a mask: the largest area that it encloses after closing by any of the kernels."""

    @F.pandas_udf("bigint")
    def hollow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if m is None else max((enclosed(closed(m, k)) for k in kernels), default=0) if m.any() else 0 for m in _arrays(batch)], dtype="Int64")

    return hollow


def aligned_mask(size: int):
    """A function of (mask, crop box of four numbers) that crops and scales to `size` by the nearest pixel."""

    @F.pandas_udf(MASK)
    def align(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for masks, boxes in batches:
            rows = []
            for m, box in zip(_arrays(masks), boxes, strict=True):
                m = np.zeros((size, size), np.uint8) if m is None else m
                if box is not None and len(box) == 4:
                    x1, x2 = (min(max(int(v), 0), m.shape[1]) for v in (box[0], box[2]))
                    y1, y2 = (min(max(int(v), 0), m.shape[0]) for v in (box[1], box[3]))
                    m = m[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else m
                down, across = (np.arange(size) * n // size for n in m.shape)
                rows.append((size, size, m[down][:, across].tobytes()))
            yield pd.DataFrame(rows, columns=MASK.names)

    return align
