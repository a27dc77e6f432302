"""Text extraction: markers, JSON payloads, grades, letters, key-value blocks, log lines and paths."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and patterns of grades in the order in which each scorer tries them. Patterns are tried on the
# text after each marker that occurs, then on the whole text.
GRADES = {
    "benchmark": ([r'"dr_grade"\s*:\s*([0-4])'], ["【结论】"], [r"(?i)DR\s*Grade\s*([0-4])"]),
    "graded": ([], ["【结论】", "【JSON】"], [r'(?i)"dr_grade"\s*:\s*([0-4])', r'(?i)"grade"\s*:\s*([0-4])', r"(?i)DR\s*Grade\s*[:：]?\s*([0-4])", r"(?i)dr_grade\s*[:：]?\s*([0-4])", r"(?i)Grade\s*[:：]?\s*([0-4])"]),
    "format": ([r"(?i)DR\s*Grade\s*([0-4])", r'"dr_grade"\s*:\s*([0-4])', r"(?i)\bGrade\s*([0-4])\b"], [], []),
    "training": ([r"(?i)GRADE\s*[:：]?\s*([0-4])\b", r"\b([0-4])\b"], [], []),
}
# Forbidden grade texts, option letters, markers, headings and the patterns around JSON payloads and log lines.
FORBIDDEN = r"(?i)\b(?:DR\s*)?grade\s*[0-4]\b"
FORBIDDEN_WIDE = r"(?i)\b(DR\s*grade|dr_grade|final\s+grade|grade\s*[0-4])\b"
LETTERS = (r"(?i)\b([A-E])\b", r"(?i)(?:answer|option|答案|选项)\s*[:：]?\s*([A-E])")

STRUCTURED, OUTPUT = "[Structured Output]", "## Output"
FENCED, MARKED = r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)【JSON】\s*(\{.*?\})\s*(?:$|\n\n)"
STEP, STEPS, STEPS_STATED = r"(\d+)/\d+ \[", r"\d+/(\d+) \[", r"Total optimization steps = ([\d,]+)"
LOSS, ELAPSED, REMAINING = r"'loss': '?([0-9.eE+-]+)", r"\[(\d+(?::\d{2})+)<", r"<(\d+(?::\d{2})+)[,\]]"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def after_marker(text: Column, marker: str) -> Column:
    """What follows the first marker, or the whole text without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[_group(text, p) for p in patterns])


def grade(text: Column, scorer: str = "graded") -> Column:
    """The grade that a scorer reads from a text, NULL if it finds none."""
    first, markers, patterns = GRADES[scorer]
    tails = [F.when(F.instr(text, m) > 0, after_marker(text, m)) for m in markers]
    tried = [_group(text, p) for p in first] + [_group(t, p) for t in (*tails, text) for p in patterns]
    return F.coalesce(*tried).try_cast("int")


def letter(text: Column) -> Column:
    """An option's letter from A to E."""
    return F.upper(first_match(F.trim(text), LETTERS))


def has_forbidden(text: Column, pattern: str = FORBIDDEN) -> Column:
    return text.rlike(pattern)


def greedy_object(text: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return _group(text, r"(?s)\{.*\}", 0)


def lazy_object(text: Column) -> Column:
    """From the first opening brace to the next closing one: never whole for nested objects."""
    return _group(text, r"(?s)\{.*?\}", 0)


def _parsing(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def fenced_object(text: Column, key: str = "dr_grade") -> Column:
    """The first that parses of: the object in a JSON fence, the one after the JSON marker, and all flat ones that name
    the key."""
    flat = F.regexp_extract_all(text, F.lit(r'\{[^{}]*"' + key + r'"[^{}]*\}'), F.lit(0))
    good = F.filter(flat, lambda x: F.try_parse_json(x).isNotNull())
    return F.coalesce(_parsing(_group(text, FENCED)), _parsing(_group(text, MARKED)), F.try_element_at(good, F.lit(1)))


def output_object(text: Column) -> Column:
    """The object after an output heading, code fences taken off."""
    return _group(F.regexp_replace(after_marker(text, OUTPUT), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)


@F.pandas_udf(T.StringType())
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JSON value of each text, written anew; of repeated keys the last counts."""
    for batch in batches:
        out = []
        for text in batch:
            try:
                out.append(None if text is None else json.dumps(json.JSONDecoder().raw_decode(text)[0], ensure_ascii=False))
            except ValueError:
                out.append(None)
        yield pd.Series(out, dtype=object)


def first_object(text: Column, marker: str = STRUCTURED) -> Column:
    """The JSON object that begins at the first opening brace after the marker, or anywhere if none follows it, as a
    VARIANT; what comes after the object does not count. NULL if it can't be read or holds a NaN.

    Only texts that VARIANT does not take, such as objects that repeat a key, go to Python."""
    tail = after_marker(text, marker)
    tail = F.when(F.contains(tail, F.lit("{")), tail).otherwise(text)
    at = F.instr(tail, "{")
    found = F.when(at > 0, F.substring(tail, at, F.length(tail)))
    parsed = F.try_parse_json(found)
    return F.coalesce(parsed, F.try_parse_json(_decoded(F.when(parsed.isNull(), found))))


@F.pandas_udf(T.BooleanType())
def is_strict_object(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether the text is one JSON object with nothing after it, as Python's own reader judges it."""

    def parses(text) -> bool:
        try:
            return isinstance(json.loads(text), dict)
        except (TypeError, ValueError):
            return False

    for batch in batches:
        yield pd.Series([parses(t) for t in batch], dtype=bool)


def single_quoted_map(text: Column) -> Column:
    """A log line's dictionary in single quotes, as a map of strings."""
    return F.from_json(_group(text, r"\{.*\}", 0), "map<string,string>", {"allowSingleQuotes": "true"})


def key_values(text: Column) -> Column:
    """Lines `key: value` as a map, parted at the first colon; of repeated keys the last counts."""
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def tail_text(text: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(text, F.lit(n))


def head_text(text: Column, n: int, more: str = "") -> Column:
    """The first n characters, and a mark where there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(more))).otherwise(text)


def fixed_point(value: Column, digits: int = 2) -> Column:
    """A number with so many decimals, rounded as the exact binary value, ties to even (as C's and Python's %.2f); for
    numbers below 2^52 / 10^digits, others are NULL."""
    scale = 10.0**digits
    x = F.abs(value.cast("double"))
    up = x * scale
    # what the product leaves out, exactly: the upper half of the number times the scale fits a double
    high = x * 134217729.0 - (x * 134217729.0 - x)
    left_out = (high * scale - up) + (x - high) * scale
    whole = F.floor(up)
    part = up - whole
    above = (part > 0.5) | ((part == 0.5) & ((left_out > 0) | ((left_out == 0) & (whole % 2 == 1))))
    n = (whole + F.when(above, 1).otherwise(0)).cast("bigint")
    one = 10**digits
    shown = ((n - n % one) / one).cast("bigint").cast("string")
    if digits:
        shown = F.concat(shown, F.lit("."), F.lpad((n % one).cast("string"), digits, "0"))
    return F.when(up < 2.0**52, F.concat(F.when(value < 0, "-").otherwise(""), shown))


def name_list(text: Column, none: str = "NONE") -> Column:
    """A comma list as a sorted set, without the word for an empty one."""
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: (s != "") & (s != none))
    return F.array_sort(F.array_distinct(parts))


def compact_json(value: Column) -> Column:
    """JSON without spaces that keeps NULL fields and characters beyond ASCII."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]*$", "")


def without_prefix(path: Column, prefix: str) -> Column:
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, F.length(path))).otherwise(path)


def without_copy_suffix(identifier: Column) -> Column:
    """An id without the suffix that numbers its augmented copies."""
    return F.regexp_replace(identifier, r"__aug\d+$", "")


def first_components(key: Column, n: int = 2, separator: str = "::") -> Column:
    return F.substring_index(key, separator, n)


def duration_seconds(text: Column) -> Column:
    """Seconds of MM:SS or H:MM:SS, NULL for other texts."""
    parts = F.transform(F.split(text, ":"), lambda s: s.try_cast("bigint"))
    ok = text.rlike(r"^\d+:\d{2}(:\d{2})?$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 60 + x))


def progress(line: Column) -> Column:
    """step, total, loss, elapsed and remaining seconds of a training log's line, each NULL if it is not there."""
    number = lambda pattern, kind: _group(line, pattern).try_cast(kind)
    return F.struct(
        number(STEP, "bigint").alias("step"),
        F.coalesce(number(STEPS, "bigint"), number(STEPS_STATED, "bigint")).alias("total"),
        number(LOSS, "double").alias("loss"),
        duration_seconds(_group(line, ELAPSED)).alias("elapsed"),
        duration_seconds(_group(line, REMAINING)).alias("remaining"),
    )


def has_sections(text: Column, sections: Sequence[str]) -> Column:
    """The share of the sections' headings that a text holds."""
    return sum((F.when(F.contains(text, F.lit(s)), 1.0).otherwise(0.0) for s in sections), F.lit(0.0)) / len(sections)


def trimmed_tokens(ids: Column, pad: int) -> Column:
    """A row of token ids up to its first padding id."""
    at = F.array_position(ids, F.lit(pad))
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def _first_key(node, wanted: tuple, objects: bool):
    """Pre-order: a node's own keys in order, then its children. A key with null ends the search below its node only; with
    `objects` the keys are tried in the order given, and one whose value is no object doesn't count."""
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            hit = next((k for k in wanted if isinstance(at.get(k), dict)), None) if objects else next((k for k in at if k in wanted), None)
            if hit is None:
                stack.extend(reversed(list(at.values())))
            elif at[hit] is not None:
                return at[hit]
        elif isinstance(at, list):
            stack.extend(reversed(at))
    return None


def first_key(*names: str, objects: bool = False):
    """A function of JSON texts: the value, as JSON, at the first of several keys anywhere in the document. Only for
    documents whose layout is not known; known paths are cheaper by `any_path`."""
    @F.pandas_udf(T.StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                try:
                    value = _first_key(json.loads(text), names, objects)
                except (TypeError, ValueError):
                    value = None
                out.append(None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")))
            yield pd.Series(out, dtype=object)

    return find


def rendered(template: str, **values: Column) -> Column:
    """A template with {name} places filled from columns; NULL values are written as nothing."""
    out, rest = [], template
    while rest:
        head, opened, tail = rest.partition("{")
        out.append(F.lit(head))
        if opened:
            name, _, tail = tail.partition("}")
            out.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = tail
    return F.concat(*out) if out else F.lit("")
