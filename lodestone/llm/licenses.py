"""Licence scans by sentence rules, in DataFrame operations only.

A text is read once.  Comment signs and bracketed list marks at the beginnings
of lines are dropped, and the text is cut into parts at sentence ends and blank
lines.  A part that isn't known as a whole is cut after colons that end a line,
and what isn't known then at line ends.  Each piece is normalised (lower-cased
ASCII letters and digits, everything else one space) and looked up among the
known licence sentences.  Licence rules are ordered sequences of sentence
identifiers: a rule holds where its identifiers follow one another among the
recognised sentences, outside of places where a longer rule that contains it
holds.  So the identifiers returned are those the licences rest on.  Parts that
hold no known sentence but a word of licensing are counted as unknown.

Texts without any of the words that every known sentence has one of can't
hold a known sentence and are not cut up.

Defined results: a null text counts as empty (no sentences, no licences);
repeated rows are scanned each; an empty table gives an empty result; further
columns are ignored; ids may be of any type or null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every known sentence contains one of these (checked when rules are made).
HINTS = ("licen", "warrant", "copyright", "permission", "redistribut", "spdx", "public domain")
#: What is dropped at the beginnings of lines, and where texts are cut, coarse to fine.
COMMENT_SIGNS = r"""^[ \t#*/;%!<>"'|=~+-]+(?:\(?(?:[0-9]{1,2}|[A-Za-z])\)[ \t]+)?|^\(?(?:[0-9]{1,2}|[A-Za-z])\)[ \t]+"""
BORDERS = (r"[.!?]+[ \t\r\n]+|\r?\n[ \t]*\r?\n", r":[ \t]*[\r\n]+", r"[\r\n]+")

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License (MIT)",
    "mit-release": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-of-the-licence": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-only": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-plain-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-title": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-sa-title": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-nc-title": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "cc0-dedicated": "This work is dedicated to the public domain under CC0 1.0.",
    "unlicense-release": "This is free and unencumbered software released into the public domain.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Ordered rules (sentence identifiers, licence).
RULES = (
    (("mit-title",), "MIT"),
    (("mit-the-title",), "MIT"),
    (("mit-release",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("apache2-title",), "Apache-2.0"),
    (("apache2-licensed",), "Apache-2.0"),
    (("apache2-header", "apache2-copy", "apache2-warranty"), "Apache-2.0"),
    (("apache2-header", "apache2-warranty"), "Apache-2.0"),
    (("gpl2-title",), "GPL-2.0-only"),
    (("gpl2-later", "gpl-warranty"), "GPL-2.0-or-later"),
    (("gpl2-only", "gpl-warranty"), "GPL-2.0-only"),
    (("gpl2-of-the-licence", "gpl-warranty"), "GPL-2.0-only"),
    (("gpl3-title",), "GPL-3.0-only"),
    (("gpl3-licensed",), "GPL-3.0-only"),
    (("gpl3-only", "gpl-warranty"), "GPL-3.0-only"),
    (("gpl-free", "gpl-warranty"), "GPL-3.0-or-later"),
    (("lgpl21-title",), "LGPL-2.1-only"),
    (("lgpl21-later", "lgpl-warranty"), "LGPL-2.1-or-later"),
    (("lgpl21-only", "lgpl-warranty"), "LGPL-2.1-only"),
    (("lgpl3-title",), "LGPL-3.0-only"),
    (("lgpl3-later", "gpl-warranty", "lgpl-see"), "LGPL-3.0-or-later"),
    (("agpl3-title",), "AGPL-3.0-only"),
    (("agpl3-later", "gpl-warranty", "agpl-see"), "AGPL-3.0-or-later"),
    (("mpl2-title",), "MPL-2.0"),
    (("mpl2-header",), "MPL-2.0"),
    (("epl2-title",), "EPL-2.0"),
    (("epl2-header",), "EPL-2.0"),
    (("epl2-plain-header",), "EPL-2.0"),
    (("cc-by-nc-licensed",), "CC-BY-NC-4.0"),
    (("cc-by-licensed",), "CC-BY-4.0"),
    (("cc-by-sa-licensed",), "CC-BY-SA-4.0"),
    (("cc-by-work",), "CC-BY-4.0"),
    (("cc-by-sa-work",), "CC-BY-SA-4.0"),
    (("cc-by-nc-work",), "CC-BY-NC-4.0"),
    (("cc-by-title",), "CC-BY-4.0"),
    (("cc-by-sa-title",), "CC-BY-SA-4.0"),
    (("cc-by-nc-title",), "CC-BY-NC-4.0"),
    (("cc0-dedicated",), "CC0-1.0"),
    (("unlicense-release",), "Unlicense"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("isc-title",), "ISC"),
    (("isc-grant",), "ISC"),
)
#: Licences that have an ``SPDX-License-Identifier`` line as a sentence and rule of its own.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense",
)
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
RULES += tuple(((f"spdx-{x.lower()}",), x) for x in SPDX)


def normal(sentence: str) -> str:
    """Python's form of ``normalised``."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]+", " "))


@dataclass(frozen=True)
class LicenceRules:
    sentences: tuple[tuple[str, str], ...] = tuple(SENTENCES.items())
    rules: tuple[tuple[tuple[str, ...], str], ...] = RULES
    hints: tuple[str, ...] = HINTS

    def __post_init__(self) -> None:
        known = dict(self.sentences)
        for name, s in self.sentences:
            if not any(h in s.lower() for h in self.hints):
                raise ValueError(f"sentence {name} has none of the hint words")
            if "," in name or not normal(s):
                raise ValueError(f"sentence {name} can't be told apart")
        for names, _ in self.rules:
            if not names or not set(names) <= set(known):
                raise ValueError(f"rule {names} has unknown sentences")

    def lookup(self) -> Column:
        return F.create_map(*[F.lit(x) for name, s in self.sentences for x in (normal(s), name)])

    def read(self, text: Column) -> Column:
        """The text's parts in order: identifiers of their known sentences, and whether there is none but a word of licensing."""
        lookup = self.lookup()

        def known(part: Column, finer: tuple[str, ...]) -> Column:
            whole = F.try_element_at(lookup, normalised(part))
            below = F.flatten(F.transform(F.split(part, finer[0]), lambda s: known(s, finer[1:]))) if finer else F.array().cast("array<string>")
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(below)

        def told(part: Column) -> Column:
            hinted = F.lit(False)
            for h in self.hints:
                hinted = hinted | normalised(part).contains(h)
            return F.struct(known(part, BORDERS[1:]).alias("ids"), hinted.alias("hinted"))

        return F.transform(F.split(F.regexp_replace(text, "(?md)" + COMMENT_SIGNS, ""), BORDERS[0]), told)

    def longer(self, names: tuple[str, ...]) -> list[str]:
        """The marks of rules that contain ``names``, longest first."""
        own = marked(names)
        return [m for m in sorted({marked(n) for n, _ in self.rules}, key=lambda m: (-len(m), m)) if own in m and m != own]

    def matched(self, ids: Column) -> list[Column]:
        """Per rule, its licence where the identifiers follow one another, else null."""
        line = F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(","))), "")
        out = []
        for names, licence in self.rules:
            left = line
            for m in self.longer(names):
                left = F.replace(left, F.lit(m), F.lit(";"))
            out.append(F.when(left.contains(marked(names)), F.lit(licence)))
        return out


def marked(names: tuple[str, ...]) -> str:
    return "".join(f",{n}," for n in names)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: LicenceRules = LicenceRules()) -> DataFrame:
    """(id, sentence_ids, licences, n_unknown): licences sorted and distinct; n_unknown counts parts that may speak of licences unknown here."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    may = t.rlike("(?i)" + "|".join(map(re.escape, rules.hints)).replace(r"\ ", r"[^a-z0-9]+"))
    slim = df.select(F.col(f"`{key}`").alias("id"), F.when(may, t).alias("t"))
    parts = slim.select("id", F.when(F.col("t").isNotNull(), rules.read(F.col("t"))).alias("parts"))
    none = F.array().cast("array<string>")
    unknown = F.size(F.filter("parts", lambda p: (F.size(p.ids) == 0) & p.hinted))
    read = parts.select("id", F.coalesce(F.flatten(F.col("parts.ids")), none).alias("sentence_ids"), F.coalesce(F.when(F.col("parts").isNotNull(), unknown), F.lit(0)).cast("long").alias("n_unknown"))
    licences = F.when(F.size("sentence_ids") > 0, F.array_compact(F.array(*rules.matched(F.col("sentence_ids"))))).otherwise(none)
    return read.select("id", "sentence_ids", F.array_sort(F.array_distinct(licences)).alias("licences"), "n_unknown")


def oracle(rules: LicenceRules = LicenceRules()) -> str:
    """The scan of ``documents`` as SQL for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def norm(s: str) -> str:
        return f"trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"

    def known(part: str, depth: int = 1) -> str:
        if depth > len(BORDERS):
            return "[]"
        below = f"flatten(list_transform(string_split_regex({part}, {quoted(BORDERS[depth])}), lambda s{depth}: ({known(f's{depth}', depth + 1)})))" if depth < len(BORDERS) else "CAST([] AS VARCHAR[])"
        return f"CASE WHEN known[{norm(part)}] IS NOT NULL THEN [known[{norm(part)}]] ELSE {below} END"

    def rule(names: tuple[str, ...], licence: str) -> str:
        left = "line"
        for m in rules.longer(names):
            left = f"replace({left}, {quoted(m)}, ';')"
        return f"CASE WHEN contains({left}, {quoted(marked(names))}) THEN {quoted(licence)} END"

    sentences = ", ".join(f"{quoted(normal(s))}: {quoted(name)}" for name, s in rules.sentences)
    hinted = " OR ".join(f"contains({norm('p')}, {quoted(h)})" for h in rules.hints)
    return f"""
WITH k AS (SELECT MAP {{{sentences}}} AS known),
d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), {quoted('(?m)' + COMMENT_SIGNS)}, '', 'g'), {quoted(BORDERS[0])}) AS parts FROM documents),
r AS (SELECT doc_id, list_transform(parts, lambda p: {{'ids': {known('p')}, 'hinted': {hinted}}}) AS parts FROM d, k),
f AS (SELECT doc_id, flatten(list_transform(parts, lambda x: x.ids)) AS ids, len(list_filter(parts, lambda x: len(x.ids) = 0 AND x.hinted)) AS n_unknown FROM r),
l AS (SELECT *, array_to_string(list_transform(ids, lambda x: ',' || x || ','), '') AS line FROM f)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(rule(*x) for x in rules.rules)}], lambda x: x IS NOT NULL))), ',') AS licences, CAST(n_unknown AS BIGINT) AS n_unknown
FROM l"""
