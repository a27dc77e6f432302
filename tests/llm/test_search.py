import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontam, licences, quality

from .conftest import prose


def shingles(text, k=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(9)
    return [(i, prose(rng, n)) for i, n in enumerate([12, 30, 57, 200, 8, 5, 3, 1])] + [(90, ""), (91, None), (None, prose(rng, 25))]


@pytest.fixture(scope="module")
def planted(benchmark_rows):
    rng = random.Random(10)
    rows = []
    for i, (_, item) in enumerate(benchmark_rows):
        around = prose(rng, 3000 if i == 1 else 60)
        words = (item or "").split()
        rows.append((10 * i, f"{around} {item or ''} {prose(rng, 40)}"))
        rows.append((10 * i + 1, f"{prose(rng, 30)} {' '.join(words[: len(words) // 2])} {prose(rng, 30)}"))
        rows.append((10 * i + 2, (item or "").upper()))
        if len(words) > 40:
            rows.append((10 * i + 3, f"{prose(rng, 30)} {' '.join(['odd', *words[1:-1], 'odd'])} {prose(rng, 30)}"))
    return [*rows, (None, None), (500, "")]


def test_containment_equals_brute_force(spark, planted, benchmark_rows):
    docs = spark.createDataFrame(planted, "doc_id long, text string").withColumn("item", F.lit(1))
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.contained_items(docs, items).collect()}
    want = {}
    for d, text in planted:
        for i, item in benchmark_rows:
            n = len(re.findall(r"\w+", (item or "").lower()))
            if n:
                s = shingles(item, min(n, 5))
                share = len(s & shingles(text, min(n, 5))) / len(s)
                if share >= 0.8:
                    want[d, i] = share
    assert got == want
    assert {r.doc_id for r in decontam.clean_documents(docs, items).collect()} == {d for d, _ in planted} - {d for d, _ in want}
    by_salted_joins = {(r.doc_id, r.item_id): r.containment for r in decontam.contained_items(docs, items, broadcast_rows=0).collect()}
    assert by_salted_joins == want
    assert decontam.clean_documents(docs, items, broadcast_rows=0).count() == len(planted) - len({d for d, _ in want})


def test_small_bitmaps_change_no_result(spark, planted, benchmark_rows, monkeypatch):
    """Bits that many keys share let more rows through to the joins, which drop them."""
    docs, items = spark.createDataFrame(planted, "doc_id long, text string"), spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = sorted(map(tuple, decontam.contained_items(docs, items).na.fill(-1).collect()))
    full = decontam.Filter(*[np.full(4096, 255, np.uint8)] * 3, [8, 16, 32, 64, 256], [1, 3, 5])
    monkeypatch.setattr(decontam, "_filter", lambda rows: (full, 10))
    assert sorted(map(tuple, decontam.contained_items(docs, items).na.fill(-1).collect())) == want


def test_items_of_few_shingles_are_all_found(spark):
    rng = random.Random(12)
    items = [prose(rng, 5 + i % 3) for i in range(600)] + [" ".join(["again"] * 9)]
    texts = [f"{prose(rng, (0, 7, 60)[i % 3])} {item} {prose(rng, 40)}" for i, item in enumerate(items)]
    want = {(j, i) for j, text in enumerate(texts) for i, item in enumerate(items) if shingles(item) <= shingles(text)}
    assert all((i, i) in want for i in range(len(items)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contained_items(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_containment_of_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "same text of a few words here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contained_items(odd, items).collect()] == [(1, 1)] * 2
    assert decontam.clean_documents(odd, items).columns == odd.columns
    assert decontam.contained_items(none, items).count() == 0
    assert decontam.contained_items(odd, items.limit(0)).count() == 0
    assert decontam.clean_documents(odd, items.limit(0)).count() == 5


def test_licences(spark, odd, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "Words. Licensed under the Apache License, Version 2.0.\nMore. Released under the MIT License! "), (2, mit), (3, "No licence here."), (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (5, None)]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licences.licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, "Apache-2.0,MIT"), 2: (2, "MIT"), 3: (0, ""), 4: (2, "CC-BY-NC-4.0"), 5: (0, "")}
    assert licences.licensed(odd).count() == 5 and licences.licensed(none).count() == 0


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
"""


def test_wrapped_licences(spark):
    apart = "Released under the\n\nMIT License. Released under. The MIT License."
    rows = [(1, MIT), (2, BSD), (3, GPL), (4, MIT.replace("\n", "\r\n")), (5, "# This work is dedicated to the public\n# domain under CC0 1.0."), (6, apart), (7, "Title\nReleased under\nthe MIT License\nAll rights reserved\nBody")]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mit = ("mit-grant,mit-keep", "MIT")
    bsd = ("all-rights,bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause,proprietary")
    assert got == {1: mit, 2: bsd, 3: ("gpl-free,gpl-free,gpl2-or-later", "GPL-2.0-or-later"), 4: mit, 5: ("cc0-notice", "CC0-1.0"), 6: ("", ""), 7: ("mit-notice,all-rights", "MIT,proprietary")}


def test_tags_and_the_same_in_sql(spark):
    """SPDX tags in comments, and wrapped texts, by the query and by its SQL."""
    tags = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier:Apache-2.0\ncode", "/* spdx-license-identifier: GPL-2.0 */", "SPDX-License-Identifier: Unknown-1.0", "x SPDX-License-Identifier: MIT", "SPDX-License-Identifier:\nMIT"]
    rows = [(1, MIT), (2, BSD), (3, GPL), (4, "Released under\n\nthe MIT License"), (5, None), (6, "a. Released under the\n# MIT License! b"), *((10 + i, t) for i, t in enumerate(tags))]
    got = {r.doc_id: tuple(r) for r in licences.licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[10 + i][3] for i in range(6)] == ["MIT", "Apache-2.0", "GPL-2.0-only", "", "", "MIT"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r for r in con.execute(licences.oracle_sql()).fetchall()} == got


def test_every_known_sentence_passes_the_hint():
    for forms in licences.SENTENCES.values():
        for s in forms:
            assert re.search(licences._HINT, s), s
    known = set(licences.SENTENCES)
    assert all(i in known for _, ids in licences.RULES for i in ids)


def test_quality_separates_junk(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = prose(rng, 60).capitalize() + "."
        if not good:
            text = [" ".join(w + "***" for w in text.split()), text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 80)][i // 3 % 3]
        rows.append((i, text))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert 30 < len(held) < 90
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert quality.accepted(docs, marks).columns == docs.columns


def test_held_out_labels_are_not_used(spark, docs):
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    turned = marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality.scored(docs, m).collect()} for m in (marks, turned))
    assert a == b


def test_quality_of_odd_rows(spark, odd, none):
    marks = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.scored(odd, marks).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in quality.scored(odd, marks.limit(0)).collect())
    assert quality.scored(none, marks).count() == 0


def test_a_repeated_id_stays_within_the_bound(spark, monkeypatch):
    """A labelled doc_id with very many rows brings no more examples than the bound."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda examples: seen.append(len(examples)))
    docs = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    quality.fit_quality(docs, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int"), fit_rows=20)
    assert seen == [20]


def test_factorisation_machine_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.FEATURES).astype(np.float32), rng.normal(size=(quality.FEATURES, quality.RANK)).astype(np.float32))
    numbers, values = np.array([3, 70, 5, 9]), np.array([0.5, 1.0, -1.0, 2.0], np.float32)
    got = m.raw(numbers, values, np.array([0, 4]))[0][0]
    want = m.bias + sum(m.linear[i] * v for i, v in zip(numbers, values, strict=True))
    for a in range(4):
        for b in range(a):
            want += float(m.factors[numbers[a]] @ m.factors[numbers[b]]) * values[a] * values[b]
    assert abs(got - want) < 1e-3


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
LGPL21 = """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.
"""
MIT_REST = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_REST = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
#: Texts as they are usually found, with their licences as a reader would name them.
BY_HAND = [
    (MIT + MIT_REST, "MIT"),
    (BSD + BSD_REST, "BSD-3-Clause,proprietary"),
    (ISC, "ISC"),
    (APACHE, "Apache-2.0"),
    ("\n".join("# " + x for x in APACHE.splitlines()), "Apache-2.0"),
    (GPL3, "GPL-3.0-or-later"),
    (GPL3.replace("General", "Affero General"), "AGPL-3.0-or-later"),
    (GPL3.replace("General", "Lesser General").replace("program", "library"), "LGPL-3.0-or-later"),
    (GPL, "GPL-2.0-or-later"),
    (LGPL21, "LGPL-2.1-or-later"),
    (MPL, "MPL-2.0"),
    (MPL.replace("v. 2.0", "v.\n2.0"), "MPL-2.0"),
    ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later WITH Classpath-exception-2.0 AND (MIT OR BSD-3-Clause) */", "BSD-3-Clause,GPL-3.0-or-later,MIT"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("Our code is released under the terms of the GNU General Public License v3.0 or later, as all know.", "GPL-3.0-or-later"),
    ("It is distributed under GPLv2.", "GPL-2.0-only"),
    ("Released under CC-BY-4.0.", "CC-BY-4.0"),
    ("Available under\n# the MPL 2.0", "MPL-2.0"),
    ("Provided under the 3-clause BSD license", "BSD-3-Clause"),
    ("This file is not licensed under the MIT License.", ""),
    ("Some words on licences: the MIT License is short. License to sing!", ""),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Available under the Boost Software License, Version 1.0", "BSL-1.0"),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
]


def test_usual_texts_of_licences(spark):
    rows = [(i, t) for i, (t, _) in enumerate(BY_HAND)]
    got = {r.doc_id: tuple(r) for r in licences.licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, got[i][3]) for i in range(len(rows))] == [(i, want) for i, (_, want) in enumerate(BY_HAND)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r for r in con.execute(licences.oracle_sql()).fetchall()} == got
