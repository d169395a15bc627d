import textwrap

import pytest

from lodestone.llm import licenses as L
from lodestone.llm.queries import ORACLE, op2_licenses


def found(spark, text):
    row = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return row.sentence_ids, row.licences


def test_query_equals_its_sql(same):
    same(op2_licenses, ORACLE["op2_licenses"])


def test_plan_is_native(spark):
    plan = op2_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_single_sentences(spark):
    assert found(spark, "Some text ###\nReleased  under the MIT-License.\nMore.") == (["mit-release"], ["MIT"])
    assert found(spark, "LICENSED UNDER CC BY-NC 4.0. Licensed under CC BY 4.0.") == (["cc-by-nc-licensed", "cc-by-licensed"], ["CC-BY-4.0", "CC-BY-NC-4.0"])
    assert found(spark, "Not released under the MIT License.") == ([], [])


def test_wrapped_notice(spark):
    text = "\n\n".join(["Copyright", "\n".join(L.SENTENCES["mit-grant"].split(" ")), L.SENTENCES["mit-notice"] + "\n" + L.SENTENCES["mit-warranty"].replace(" ", "\n", 3)])
    assert found(spark, text)[1] == ["MIT"]


def test_order_matters(spark):
    s = L.SENTENCES
    assert found(spark, " ".join([s["gpl-free"], s["gpl-warranty"]]))[1] == ["GPL-3.0-or-later"]
    assert found(spark, " ".join([s["gpl-warranty"], s["gpl-free"]]))[1] == []


@pytest.mark.parametrize("text", [None, "", "licence " * 50_000])
def test_nothing(spark, text):
    assert found(spark, text) == ([], [])


def test_rules_are_checked():
    with pytest.raises(ValueError):
        L.LicenceRules(sentences=(("a", "nothing of the kind"),), rules=())
    with pytest.raises(ValueError):
        L.LicenceRules(rules=((("none",), "X"),))


def test_odd_rows(spark):
    text = "Released under the MIT License."
    df = spark.createDataFrame([(None, text, "a"), (1, text, None), (1, text, None)], "doc_id long, text string, t string")
    assert [r.licences for r in L.scan(df).collect()] == [["MIT"]] * 3
    assert L.scan(df.limit(0)).count() == 0


APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = "Copyright\n\n" + "\n\n".join(textwrap.fill(L.SENTENCES[n], 70) for n in ("mit-grant", "mit-notice", "mit-warranty"))
BSD = "Copyright\n\n{}\n{}\n{}\n\nTHIS SOFTWARE IS PROVIDED"
CLAUSES = [L.SENTENCES[n] for n in ("bsd-redistribution", "bsd-source", "bsd-binary")]
COMMENTS = [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("<!--\n", "", "\n-->"), ("", "-- ", ""), ("", ";; ", ""), ("", "! ", ""), ('"""\n', "", '\n"""')]


@pytest.mark.parametrize("marks", [("", ""), ("1. ", "2. "), ("(1) ", "(2) "), ("a) ", "b) "), ("* ", "* "), ("- ", "- ")])
def test_notices_in_comments(spark, marks):
    bsd = BSD.format(*[textwrap.fill(m + c, 70) for m, c in zip(("", *marks), CLAUSES)])
    wanted = [
        (APACHE, ["apache2-header", "apache2-warranty", "apache2-see"], ["Apache-2.0"]),
        (APACHE.replace("at\n\n", "at\n"), ["apache2-header", "apache2-copy", "apache2-warranty", "apache2-see"], ["Apache-2.0"]),
        (MIT, ["mit-grant", "mit-notice", "mit-warranty"], ["MIT"]),
        (MIT.replace(":\n\n", ":\n"), ["mit-grant", "mit-notice", "mit-warranty"], ["MIT"]),
        (bsd, ["bsd-redistribution", "bsd-source", "bsd-binary"], ["BSD-2-Clause"]),
    ]
    cases = []
    for text, ids, licences in wanted:
        for first, sign, last in COMMENTS:
            for end in ("\n", "\r\n"):
                lines = [(sign + line).rstrip() for line in text.split("\n")]
                cases.append((len(cases), (f"import os\n{first}" + "\n".join(lines) + f"{last}\nx = 1\n").replace("\n", end), ids, licences))
    got = {r.id: (r.sentence_ids, r.licences) for r in L.scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    for k, text, ids, licences in cases:
        assert got[k] == (ids, licences), text


def test_wrapped_and_single_lines_mixed(spark):
    s = L.SENTENCES
    text = textwrap.fill(s["gpl-free"], 70) + "\n" + s["gpl-warranty"] + "\nCode\nReleased under the MIT License\nmore"
    assert found(spark, text) == (["gpl-free", "gpl-warranty", "mit-release"], ["GPL-3.0-or-later", "MIT"])
    assert found(spark, "# Not\n# released under the MIT License, or so.") == ([], [])


FULL = {
    "MIT": MIT.replace("Copyright\n\n", "MIT License\n\nCopyright (c) 2020 Somebody\n\n"),
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n",
    "GPL-2.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n",
    "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy",
    "LGPL-2.1-only": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999",
    "LGPL-3.0-only": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
    "AGPL-3.0-only": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE",
    "ISC": "ISC License\n\nCopyright\n\n" + textwrap.fill(L.SENTENCES["isc-grant"], 70) + "\n\nTHE SOFTWARE IS PROVIDED",
    "BSD-3-Clause": BSD.format(*CLAUSES).replace("\n\nTHIS", "\n\n3. " + textwrap.fill(L.SENTENCES["bsd-endorse"], 70) + "\n\nTHIS"),
    "BSD-2-Clause": BSD.format(*CLAUSES),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
    "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0 International\n\nCreative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n\nBy exercising",
}
HEADERS = {
    "GPL-2.0-or-later": ["gpl2-later", "gpl-warranty", "gpl-see"],
    "GPL-2.0-only": ["gpl2-only", "gpl-warranty", "gpl-see"],
    "GPL-3.0-or-later": ["gpl-free", "gpl-warranty", "gpl-see"],
    "GPL-3.0-only": ["gpl3-only", "gpl-warranty", "gpl-see"],
    "LGPL-2.1-or-later": ["lgpl21-later", "lgpl-warranty", "lgpl-see"],
    "LGPL-2.1-only": ["lgpl21-only", "lgpl-warranty", "lgpl-see"],
    "LGPL-3.0-or-later": ["lgpl3-later", "gpl-warranty", "lgpl-see"],
    "AGPL-3.0-or-later": ["agpl3-later", "gpl-warranty", "agpl-see"],
    "EPL-2.0": ["epl2-header"],
}


def test_full_texts_and_headers(spark):
    cases = [(FULL[k], k) for k in FULL]
    for k, names in HEADERS.items():
        plain = "  ".join(L.SENTENCES[n] for n in names)
        cases += [(plain, k), ("/*\n" + textwrap.indent(textwrap.fill(plain, 66), " * ") + "\n */\nint x;", k)]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/."
    cases += [("# " + mpl + "\nimport x", "MPL-2.0"), (mpl.replace("# ", ""), "MPL-2.0")]
    cases += [(f"// SPDX-License-Identifier: {x}\nint x;", x) for x in L.SPDX]
    got = {r.id: r.licences for r in L.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for k, (text, licence) in enumerate(cases):
        assert got[k] == [licence], text


def test_the_longer_rule_holds(spark):
    two, three = ("\n".join(CLAUSES), "\n".join([*CLAUSES, L.SENTENCES["bsd-endorse"]]))
    assert found(spark, three)[1] == ["BSD-3-Clause"]
    assert found(spark, two)[1] == ["BSD-2-Clause"]
    assert found(spark, three + "\n\n" + two)[1] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_unknown_licensing(spark):
    texts = ["All rights reserved under the Frob License 7. Nothing else.\n\nReleased under the MIT License.", "plain", None, "No warranty, and no permission. A word of copyright!"]
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_unknown for r in sorted(rows)] == [1, 0, 0, 2]


def test_sql_reads_wrapped_and_commented_texts_alike(spark, duck, tmp_path):
    """The SQL on texts that the tables don't have."""
    import duckdb

    texts = [*FULL.values(), *("# " + t.replace("\n", "\n# ") for t in FULL.values()), *(t.replace("\n", "\r\n") for t in FULL.values()), APACHE, " ".join(L.SENTENCES.values()), "\n".join(L.SENTENCES.values()), "licence:\nReleased under the MIT License", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours = sorted((r.id, len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licences), r.n_unknown) for r in L.scan(df).collect())
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert ours == sorted(con.sql(L.oracle()).fetchall())
