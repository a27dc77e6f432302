"""Column functions: casts, buckets, bands, confidences, states, flags and keys.

Every function takes and returns Spark columns and stays inside code generation. Thresholds are parameters; the
defaults under "Fixed values" are those that results must agree with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison, bound and name of each bucket in order; the last name is for all that is larger. A name of
# None is for values that have no bucket.
COUNT_FOUR = ([("<=", 0, "none"), ("<=", 3, "few"), ("<=", 10, "some")], "many")
COUNT_THREE = ([("<=", 0, None), ("<=", 1, "single"), ("<=", 5, "few")], "many")
COUNT_FIVE = ([("<=", 0, "未见"), ("<=", 3, "少量"), ("<=", 10, "数处"), ("<=", 20, "较多")], "大量")
AREA_FIXED = ([("<=", 0, "none"), ("<", 300, "small"), ("<", 1500, "medium")], "large")
DISTANCE_BANDS = ([("<=", 1, "黄斑区"), ("<=", 3, "后极部"), ("<=", 6, "中周部")], "周边部")
BURDEN_BANDS = ([("<", 9, "周边部"), ("<", 11, "中周部"), ("<", 13, "后极部")], "黄斑区")
CUP_BUCKETS = ([("<", 0.40, "normal"), ("<", 0.50, "mild_elevation"), ("<", 0.65, "moderate_elevation")], "glaucoma_suspicion")
RATIO_BUCKETS = ([("<", 0.65, "low"), ("<", 0.85, "normal")], "elevated")
TWIST_BUCKETS = ([("<", 0.20, "normal"), ("<", 0.40, "mild"), ("<", 0.60, "moderate")], "severe")
POSITIVE_WORDS = ("present", "true", "yes", "1", "positive")
NEGATIVE_WORDS = ("absent", "false", "no", "0", "negative")


def finite(value: Column) -> Column:
    """The number, or NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lenient_int(text: Column) -> Column:
    """int(float(text)), NULL where that fails."""
    number = finite(F.trim(text).try_cast("double"))
    return F.when(F.abs(number) < 2.0**63, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint"))


def lenient_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def numeric_only(value: Column) -> Column:
    """The number of a VARIANT that holds a number; texts are never cast. A boolean is a number, 0 or 1."""
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    return number.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))


def numeric_not_boolean(value: Column) -> Column:
    """The number of a VARIANT that holds a number or a text that is one; a boolean is none."""
    return F.when(F.schema_of_variant(value) != "BOOLEAN", finite(F.trim(F.try_variant_get(value, "$", "string")).try_cast("double")))


def null_sentinel(value: Column, sentinel) -> Column:
    """The value, with the sentinel that stands for a missing one as NULL."""
    return F.nullif(value, F.lit(sentinel))


def bucket(value: Column, breaks: tuple[Sequence[tuple[str, float, str | None]], str], missing: str | None = "unknown") -> Column:
    """The name of the first bucket whose comparison holds."""
    bounds, rest = breaks
    out = F.when(value.isNull(), F.lit(missing))
    for sign, bound, name in bounds:
        out = out.when(value <= bound if sign == "<=" else value < bound, F.lit(name))
    return out.otherwise(rest)


def threshold_bucket(value: Column, low: Column, high: Column, names: Sequence[str] = ("small", "medium", "large")) -> Column:
    """Three buckets of a positive value by two threshold columns (each reached by equality); else NULL."""
    known = value.isNotNull() & (value > 0) & low.isNotNull() & high.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), F.lit(None)).when(value <= low, names[0]).when(value <= high, names[1]).otherwise(names[2])


def area_words(area: Column, low: float, high: float) -> Column:
    """Four fixed words for an area by two bounds."""
    return bucket(area, ([("<=", 0, "未见"), ("<", low, "小灶性"), ("<", high, "中等面积")], "大面积"), missing=None)


def burden_band(area: Column, count: Column) -> Column:
    """Bands of log1p(area) + 2 log1p(count), NULL unless both are positive."""
    return F.when((area > 0) & (count > 0), bucket(F.log1p(area) + 2 * F.log1p(count), BURDEN_BANDS, missing=None))


def linear_confidence(count: Column, area: Column, full_count: float = 8.0, full_area: float = 1500.0) -> Column:
    """The larger of two capped shares, rounded half to even at six places."""
    share = lambda x, full: F.least(F.lit(1.0), x.cast("double") / full)
    return F.bround(F.greatest(share(count, full_count), share(area, full_area)), 6)


def log_confidence(count: Column, area: Column, least_area: float, full_count: float = 20.0) -> Column:
    """Product of two logarithmic shares, each between 0 and 1."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return clamp(F.log1p(area / least_area) / F.log1p(F.lit(10.0))) * clamp(F.log1p(count) / F.log1p(F.lit(full_count)))


def in_range(value: Column, low: float, high: float) -> Column:
    """Whether a finite value lies between bounds, false where it is missing."""
    return F.coalesce((value >= low) & (value <= high), F.lit(False))


def distance_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def radial_geometry(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column) -> Column:
    """Valid if the distance is from one to eight radii; a struct of the result and its reason."""
    d = distance_between(x1, y1, x2, y2)
    known = radius.isNotNull() & (radius > 0) & d.isNotNull()
    reason = F.when(~F.coalesce(known, F.lit(False)), "missing").when(d < radius, "too_near").when(d > 8 * radius, "too_far")
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def vertical_geometry(y1: Column, y2: Column, radius: Column) -> Column:
    """Valid if the vertical distance is at most two radii."""
    return F.coalesce(F.abs(y2 - y1) <= 2 * radius, F.lit(False))


def tri_state(value: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """present, absent or unknown, by word lists."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*positive), "present").when(word.isin(*negative), "absent").otherwise("unknown")


def flag_set(flags: Mapping[str, Column]) -> Column:
    """The names whose conditions hold, sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))))


def add_flags(flags: Column, more: Mapping[str, Column]) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(flags, F.array().cast("array<string>")), flag_set(more))))


def tag(value: Column, names: Mapping[str, str]) -> Column:
    """A dictionary look-up that leaves unknown values as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def sha1_bucket(key: Column, digits: int = 8, buckets: int = 100) -> Column:
    """The first hex digits of the key's sha1 as a number, modulo the number of buckets."""
    if digits > 15:
        raise ValueError("at most 15 hex digits fit a bigint")
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, digits), 16, 10).cast("bigint") % buckets


def stable_key(*parts: Column, salt: str = "") -> Column:
    """A sort key that shuffles rows in the same way every time."""
    return F.sha1(F.concat_ws("::", F.lit(salt), *[p.cast("string") for p in parts]).cast("binary"))


def hash_choice(key: Column, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (sha1_bucket(key, buckets=len(options)) + 1).cast("int"))


def key_of(*parts: Column) -> Column:
    return F.concat_ws("::", *[p.cast("string") for p in parts])


def option_letter(options: Column, value: Column) -> Column:
    """The letter of a value's place in a row's own list of options, NULL if it is not there."""
    place = F.array_position(options, value)
    return F.when(place > 0, F.char((place + 64).cast("int")))


def option_value(options: Column, letter: Column) -> Column:
    return F.try_element_at(options, (F.ascii(F.upper(letter)) - 64).cast("int"))


def option_lines(options: Column) -> Column:
    """One line `A. text` per option."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char((i + 65).cast("int")), F.lit(". "), x)), "\n")


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)


# Quadrants in the order that breaks ties, and their names in prose.
QUADRANTS = {"ST": "superior-temporal", "SN": "superior-nasal", "IT": "inferior-temporal", "IN": "inferior-nasal"}


def _quadrants(counts: Mapping[str, Column]) -> tuple[Column, Column, Column, Column]:
    """Total, number above zero, whether all four share evenly, and the names with at least a quarter, largest first."""
    values = [F.coalesce(c, F.lit(0)).cast("bigint") for c in counts.values()]
    total = sum(values[1:], values[0])
    some = sum((F.when(v > 0, 1).otherwise(0) for v in values[1:]), F.when(values[0] > 0, 1).otherwise(0))
    even = (some == 4) & (F.least(*values) >= F.greatest(F.lit(1), F.floor(total / 6)))
    entries = F.array(*[F.struct((-v).alias("n"), F.lit(i).alias("i"), F.lit(q).alias("q")) for i, (q, v) in enumerate(zip(counts, values, strict=True))])
    top = F.filter(F.array_sort(entries), lambda e: -e["n"] >= F.greatest(F.lit(1), F.floor(total / 4)))
    return total, some, even, F.transform(top, lambda e: e["q"])


def quadrant_code(counts: Mapping[str, Column]) -> Column:
    """4Q, X_only, X_pred, X+Y or X+Y+Z from counts by quadrant; ties keep the order given; NULL without any."""
    total, some, even, top = _quadrants(counts)
    by_size = F.when(F.size(top) == 1, F.concat(top[0], F.lit("_pred"))).otherwise(F.array_join(F.slice(top, 1, 3), "+"))
    return F.when(total == 0, F.lit(None)).when(even, "4Q").when(some == 1, F.concat(top[0], F.lit("_only"))).otherwise(by_size)


def quadrant_prose(counts: Mapping[str, Column]) -> Column:
    """The same in words."""
    total, some, even, top = _quadrants(counts)
    names = F.transform(top, lambda q: tag(q, QUADRANTS))
    return (
        F.when(total == 0, F.lit(None))
        .when(even, "throughout all four quadrants (macula-centered)")
        .when(some == 1, F.concat(F.lit("in the "), names[0], F.lit(" quadrant only")))
        .when(F.size(top) == 1, F.concat(F.lit("predominantly in the "), names[0], F.lit(" quadrant")))
        .when(F.size(top) == 2, F.concat(F.lit("distributed in the "), F.array_join(names, " and "), F.lit(" quadrants")))
        .otherwise(F.concat(F.lit("distributed across "), F.size(top), F.lit(" quadrants ("), F.array_join(names, ", "), F.lit(")")))
    )


def laterality_quadrant(x: Column, y: Column, cx: Column, cy: Column, right_eye: Column) -> Column:
    """The quadrant of a point around a centre; the temporal side depends on the eye."""
    temporal = F.when(right_eye, x < cx).otherwise(x > cx)
    return F.concat(F.when(y < cy, "S").otherwise("I"), F.when(temporal, "T").otherwise("N"))


def rescaled(value: Column, offset: Column, extent: Column, target: float) -> Column:
    """A coordinate after cropping at `offset` and scaling `extent` to `target`."""
    return (value - offset) * target / F.nullif(extent.cast("double"), F.lit(0.0))


def kept_measure(area: Column, count: Column, least_area: float, grade: Column | None = None) -> Column:
    """Whether a measured finding counts: something is there and large enough, and the grade is not 0."""
    ok = F.coalesce((count > 0) & (area >= least_area), F.lit(False))
    return ok if grade is None else ok & ~F.coalesce(grade == 0, F.lit(False))
