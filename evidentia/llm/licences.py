"""Licences by sentence rules, in DataFrame functions alone.

A text is cut into lines, and after . ; : ! ? with white space (but not after the v. of a version); each piece is
normalised to its lower-case letters and digits with single spaces, which also takes comment marks away. A known
sentence is a piece, or a run of pieces that only single line ends part, so that wrapped sentences are found too;
pieces without letters or digits (blank lines) and sentence marks end a run. A notice (licensed under the .. licence)
may stand anywhere in a piece, with words before and after it, unless "not" stands before it. A line that begins with an
SPDX tag gives a sentence for each licence of its expression. Of known sentences that begin in one place the longest
counts, and each piece counts once. Known sentences are mapped to identifiers. The row of a text's identifiers is then
matched against the rules in order: a rule names a licence by a sequence of identifiers that stand next to each other,
and uses up what it matches, so that longer sequences come before their parts.

Cases: null and empty texts have no sentences and no licences; texts are read whole; null and repeated doc_ids stay as
rows; no rows give no rows; other columns are ignored; a sentence that repeats is listed each time, a licence once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import text_or_empty

#: Well-known sentences of licences and licence notices, normalised, by identifier.
SENTENCES = {
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "gpl-free": ["this program is free software", "this library is free software", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3-or-later": ["either version 3 of the license or at your option any later version"],
    "gpl2-or-later": ["either version 2 of the license or at your option any later version"],
    "gpl2.1-or-later": ["either version 2 1 of the license or at your option any later version"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-obtain": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["all rights reserved"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-no-event": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-no-event": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "apache-title": ["apache license version 2 0 january 2004"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
}
#: Names by which a notice may call a licence, normalised, by identifier.
NAMES = {
    "apache-notice": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "mit-notice": ["mit license"],
    "bsd3-notice": ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"],
    "bsd2-notice": ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause"],
    "mpl2-notice": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "isc-notice": ["isc license"],
    "zlib-notice": ["zlib license"],
    "bsl-notice": ["boost software license version 1 0", "boost software license 1 0"],
    "epl2-notice": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0"],
    "cc-by-notice": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "cc-by-sa-notice": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-notice": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc0-notice": ["cc0 1 0"],
    "unlicense-notice": ["unlicense"],
}
#: Names of the licences of one family in sentences and notices, and their versions.
FAMILIES = {"gpl": ("gnu general public license", ("2.0", "3.0")), "lgpl": ("gnu lesser general public license", ("2.1", "3.0")), "agpl": ("gnu affero general public license", ("3.0",))}
LATER = ("or later", "or any later version", "or at your option any later version")
_TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
#: Licences in the order in which they are tried, by sequences of identifiers.
RULES = [
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-no-event"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
]
_LATEST = {"2.0": "2", "2.1": "2.1", "3.0": "3"}
for _short, (_long, _versions) in FAMILIES.items():
    _own = "gpl-free" if _short == "gpl" else f"{_short}-free"
    SENTENCES.setdefault(_own, [_TERMS.format(_long)])
    for _v in _versions:
        _n, _name = _LATEST[_v], f"{_short.upper()}-{_v}"
        _words = _n.replace(".", " ")
        SENTENCES[f"{_short}{_n}-terms"] = [f"{_TERMS.format(_long)} either version {_words} of the license or at your option any later version"]
        _called = [f"{_long} {w}" for w in (f"version {_words}", f"v{_words}", *([f"version {_words} 0", f"v{_words} 0"] if "." not in _n else []))]
        _called += [f"{_short} {_words}", f"{_short} v{_words}", f"{_short}v{_words}", f"{_short} version {_words}", *([f"{_short} {_words} 0"] if "." not in _n else [])]
        NAMES[f"{_short}{_n}-notice"] = _called
        NAMES[f"{_short}{_n}-later-notice"] = [f"{c} {later}" for c in _called for later in LATER]
        RULES += [
            (f"{_name}-or-later", ["gpl-free", _own, f"gpl{_n}-or-later"]),
            (f"{_name}-or-later", ["gpl-free", f"{_short}{_n}-terms"]),
            (f"{_name}-or-later", [f"{_short}{_n}-terms"]),
            (f"{_name}-or-later", [f"{_short}{_n}-later-notice"]),
            (f"{_name}-only", [f"{_short}{_n}-notice"]),
        ]
RULES += [
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("Zlib", ["zlib-notice"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("Unlicense", ["unlicense-notice"]),
    ("proprietary", ["all-rights"]),
]
#: Names after an SPDX tag that mean another one above: a family's version alone, and with a plus; full names mean themselves.
SHORT_NAMES = {f"{s.upper()}-{v}": f"{s.upper()}-{v}-only" for s, (_, versions) in FAMILIES.items() for v in versions}
SHORT_NAMES |= {f"{k}+": f"{k}-or-later" for k in SHORT_NAMES}
_TAGGED = {n: n for n, _ in RULES if n != "proprietary"} | SHORT_NAMES


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower().replace("+", " plus")).strip()


for _short, _name in _TAGGED.items():
    SENTENCES.setdefault(f"spdx-{_name.lower()}", []).append(f"spdx license identifier {_plain(_short)}")
RULES += [(n, [f"spdx-{n.lower()}"]) for n in dict.fromkeys(_TAGGED.values())]
_WHOLE = [s for forms in SENTENCES.values() for s in forms]
#: What stands before a licence's name in a notice.
_UNDER = "(?:licensed|released|distributed|published|available|provided|dedicated to the public domain) under (?:the )?(?:terms of )?(?:the |an? )?(?:terms of the )?"
SENTENCES |= {i: [f"licensed under the {n}" for n in names] for i, names in NAMES.items()}
#: The tag's name may stand on the next line; its colon would end a sentence.
_TAG = r"(?i)spdx-license-identifier:(?:[^a-z0-9(\n]*\n)?[^a-z0-9(\n]*"
_MARK = "spdxlicenseidentifieris "
#: A line of a tag: its expression of licences with AND, OR and WITH.
_TAGGED_LINE = rf"^[^A-Za-z0-9]*{_MARK}[ \t(]*([A-Za-z0-9.+-]+(?:[ \t()]+(?:AND|OR|WITH|and|or|with)[ \t(]+[A-Za-z0-9.+-]+)*)"
#: Every known sentence or notice in lower case holds one of these, so other texts have none. The short ones are looked for as words.
_HINTS = ("licen", "copyright", "permi", "redistribut", "software", "domain", "reserved", "warrant", "reproduction", "gpl", "cc0", "apache", "bsd", "creative", "boost", "eclipse", "zlib")
_SHORT = ("mpl", "cc")
_HINT = "|".join([*_HINTS, *(rf"\b{w}\b" for w in _SHORT)])


def _hinted(text: Column) -> Column:
    """Whether a text may hold a known sentence: plain searches, far faster than one pattern."""
    low = F.lower(text)
    found = [F.contains(low, F.lit(w)) for w in _HINTS]
    found += [F.contains(low, F.lit(w)) & low.rlike(rf"\b{w}\b") for w in _SHORT]
    return reduce(lambda a, b: a | b, found)


def _longest(forms: list[str], gap: str) -> str:
    return "|".join(s.replace(" ", gap) for s in sorted(forms, key=len, reverse=True))


def _spread(pattern: str, gap: str) -> str:
    return pattern.replace(" ", gap)


def _known(before: str, after: str, gap: str) -> str:
    """Known sentences between line ends, and notices between words, each longest first; `gap` stands for a space or a single line end."""
    names = _longest([n for ns in NAMES.values() for n in ns], gap)
    return rf"{before}(?:{_longest(_WHOLE, gap)}){after}|\b(?:not{gap})?{_spread(_UNDER, gap)}(?:{names})\b"


_KNOWN = _known(r"(?<=\n)", r"(?=\n)", "[ \n]")
_IDS = {s: i for i, forms in SENTENCES.items() if i not in NAMES for s in forms} | {n: i for i, names in NAMES.items() for n in names}


def _tag(identifiers: list[str]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences in order."""
    known = F.create_map(*[F.lit(x) for pair in _IDS.items() for x in pair])
    tagged = F.regexp_replace(F.regexp_replace(text, _TAG, _MARK), r"(?i)\bv\.[ \t\r\n]+([0-9])", "v $1")
    parts = F.split(F.regexp_replace(tagged, r"([.;:!?])[ \t\r\n]+", "$1\n\n"), "\n")

    def plain(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))

    def piece(s: Column) -> Column:
        names = F.regexp_extract_all(F.regexp_extract(s, _TAGGED_LINE, 1), F.lit("[A-Za-z0-9.+-]+"), F.lit(0))
        each = F.transform(names, lambda n: F.concat(F.lit("spdx license identifier "), plain(F.replace(n, F.lit("+"), F.lit(" plus")))))
        return F.when(F.contains(s, F.lit(_MARK)), F.array_join(each, "\n")).otherwise(plain(s))

    lines = F.concat(F.lit("\n"), F.array_join(F.transform(parts, piece), "\n"), F.lit("\n"))
    names = F.transform(F.regexp_extract_all(lines, F.lit(_KNOWN), F.lit(0)), lambda s: F.regexp_replace(F.translate(s, "\n", " "), f"^{_UNDER}", ""))
    found = F.array_compact(F.transform(names, lambda n: F.try_element_at(known, n)))
    return F.when(_hinted(text), found).otherwise(F.array().cast("array<string>"))


def licensed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids and licences (both comma-joined)."""
    found = docs.select("doc_id", sentence_ids(text_or_empty()).alias("ids"))
    out = found.withColumn("rest", F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))))
    names = []
    for k, (name, ids) in enumerate(RULES):
        tag = F.lit(_tag(ids))
        out = out.withColumn(f"__ev_{k}", F.when(F.contains("rest", tag), F.lit(name))).withColumn("rest", F.replace("rest", tag, F.lit("|")))
        names.append(f"__ev_{k}")
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licences.alias("licences"))


def oracle_sql() -> str:
    """The same result in DuckDB's SQL."""
    known = ", ".join(f"('{n}', '{i}')" for n, i in _IDS.items())
    steps, last = [], "j"
    for k, (name, ids) in enumerate(RULES):
        tag = _tag(ids)
        steps.append(f"r{k} AS (SELECT * REPLACE (replace(rest, '{tag}', '|') AS rest, CASE WHEN contains(rest, '{tag}') THEN list_append(names, '{name}') ELSE names END AS names) FROM {last})")
        last = f"r{k}"
    # every line stands between line ends of its own here, for want of look-around: two of them part the lines of a run
    run = _known("\\n", "\\n", "(?: |\\n\\n)")
    plain = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    tagged = f"""list_transform(regexp_extract_all(regexp_extract(x, '{_TAGGED_LINE}', 1), '[A-Za-z0-9.+-]+'),
    lambda n: chr(10) || 'spdx license identifier ' || {plain.format("replace(n, '+', ' plus')")} || chr(10))"""
    return f"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_TAG}', '{_MARK}', 'g'), '(?i)\\bv\\.[ \\t\\r\\n]+([0-9])', 'v \\1', 'g'),
    '([.;:!?])[ \\t\\r\\n]+', '\\1' || chr(10) || chr(10), 'g'), chr(10)) AS a FROM documents
), p AS (
  SELECT doc_id, array_to_string(list_transform(a, lambda x: CASE WHEN contains(x, '{_MARK}') THEN coalesce(array_to_string({tagged}, ''), '') ELSE chr(10) || {plain.format("x")} || chr(10) END), '') AS t FROM s
), m AS (
  SELECT doc_id, regexp_extract_all(t, '{run}') AS f FROM p
), e AS (
  SELECT doc_id, i, regexp_replace(trim(replace(replace(f[i], chr(10) || chr(10), ' '), chr(10), '')), '^{_UNDER}', '') AS n FROM m, unnest(range(1, len(f) + 1)) AS t(i)
), k(n, id) AS (VALUES {known}
), j AS (
  SELECT doc_id, count(*) AS c, string_agg(id, ',' ORDER BY i) AS ids, string_agg('<' || id || '>', '' ORDER BY i) AS rest, CAST([] AS VARCHAR[]) AS names
  FROM e JOIN k USING (n) GROUP BY doc_id
), {", ".join(steps)}
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences
FROM documents d LEFT JOIN {last} USING (doc_id)
"""
