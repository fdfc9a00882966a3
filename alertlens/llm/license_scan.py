"""Licence scan by sentence rules, in DataFrame operations only.

A rule is a licence and an ordered run of sentences. Texts are cut into sentences
twice: at line ends (a notice is often a line of its own) and at sentence ends within
paragraphs (a licence text is often wrapped); each sentence is normalised to lower
case words and mapped to the identifier of a known licence sentence. The identifiers
of a document, in order and without unknown sentences, are matched against the rules
in their order, longest run first; a match consumes its identifiers, so that a full
licence text is not also reported as its own first line.

Defined results: null and empty texts have no licence; every document gives one row
(repeated doc_ids as often as they occur); other columns are ignored. Nothing is
shuffled: the rule table is a literal of fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices, a rule each: (licence, sentences); \n is a paragraph end. Fixed values.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0\n"
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:\nNeither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products derived from this software without specific prior written "
                     "permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                         "option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is licensed under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
#: Every known sentence has one of these in it; documents without cannot match.
ANCHORS = ["licen", "permission", "redistribut", "program"]

_END = r"([.!?;])\s+([^0-9\s])"  # a sentence ends at such a mark and blanks, but not in "v. 2.0"
_SEP = "\x1e"


def _normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def sentence_rules() -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """Sentence -> identifier, and the rules as (licence, identifiers), longest first."""
    ids: dict[str, int] = {}
    rules = []
    for licence, notice in NOTICES:
        run = [_normal(s) for s in re.sub(_END, "\\1" + _SEP + "\\2", notice.replace("\n", _SEP)).split(_SEP)]
        rules.append((licence, [ids.setdefault(s, len(ids) + 1) for s in run if s]))
    return ids, sorted(rules, key=lambda r: -len(r[1]))


def _run(ids: list[int]) -> str:
    return "".join(f"|{i}|" for i in ids)


def _identifiers(text: Column, known: Column) -> Column:
    """Identifiers of the known sentences of ``text``, as one string |a||b|..."""
    units = F.split(F.regexp_replace(text, _END, "$1" + _SEP + "$2"), _SEP)
    plain = F.transform(units, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    hits = F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    return F.array_join(F.transform(hits, lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|"))), "")


def _match(run: Column, rules: Column) -> Column:
    """Licences whose rules occur in ``run``, each match consuming its identifiers."""
    start = F.struct(run.alias("run"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["run"], rule["run"], F.lit("|-|"))
        found = F.when(rest != acc["run"], F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"])
        return F.struct(rest.alias("run"), found.alias("found"))

    return F.aggregate(rules, start, step, lambda acc: acc["found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licences (sorted, joined by commas, '' for none), n_sentences (known
    licence sentences found, by the cut that finds more)."""
    ids, rules = sentence_rules()
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    table = F.array(*[F.struct(F.lit(lic).alias("licence"), F.lit(_run(r)).alias("run")) for lic, r in rules])
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    maybe = low.contains(ANCHORS[0])
    for a in ANCHORS[1:]:
        maybe = maybe | low.contains(a)
    lines = F.regexp_replace(text, r"[\r\n]+", _SEP)
    paragraphs = F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]*\r?\n\s*", _SEP), r"\s*\n\s*", " ")
    out = docs.select("doc_id", F.when(maybe, _identifiers(lines, known)).alias("a"),
                      F.when(maybe, _identifiers(paragraphs, known)).alias("b"))
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in "ab"})
    empty = F.array().cast("array<string>")
    found = F.when((F.col("a") != "") | (F.col("b") != ""),
                   F.array_union(_match(F.col("a"), table), _match(F.col("b"), table))).otherwise(empty)
    count = lambda c: F.length(F.regexp_replace(c, "[^|]", "")) / 2
    return out.select("doc_id", F.array_join(F.array_sort(found), ",").alias("licences"),
                      F.greatest(count("a"), count("b")).cast("long").alias("n_sentences"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: the rules become a chain of replacements."""
    ids, rules = sentence_rules()
    known = ", ".join(f"('{s}', {i})" for s, i in ids.items())
    cuts = {"a": r"regexp_replace(text, '[\r\n]+', chr(30), 'g')",
            "b": r"regexp_replace(regexp_replace(text, '\r?\n[ \t]*\r?\n\s*', chr(30), 'g'), '\s*\n\s*', ' ', 'g')"}
    q = "WITH known(s, i) AS (VALUES " + known + "),\nt AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
    for c, cut in cuts.items():
        q += (f",\nu{c} AS (SELECT rid, generate_subscripts(us, 1) AS k, unnest(us) AS u FROM (SELECT rid, string_split("
              f"regexp_replace({cut}, '([.!?;])\\s+([^0-9\\s])', '\\1' || chr(30) || '\\2', 'g'), chr(30)) AS us FROM t))"
              f",\nr{c} AS (SELECT rid, string_agg('|' || i || '|', '' ORDER BY k) AS run, count(*) AS n FROM u{c} JOIN known "
              f"ON s = trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) GROUP BY rid)")
        step = f"SELECT rid, run, []::VARCHAR[] AS found FROM r{c}"
        for licence, r in rules:
            step = (f"SELECT rid, replace(run, '{_run(r)}', '|-|') AS run, CASE WHEN contains(run, '{_run(r)}') "
                    f"THEN list_append(found, '{licence}') ELSE found END AS found FROM ({step})")
        q += f",\nf{c} AS ({step})"
    return q + """
SELECT t.doc_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(fa.found, []), coalesce(fb.found, [])))), ',') AS licences,
       greatest(coalesce(ra.n, 0), coalesce(rb.n, 0)) AS n_sentences
FROM t LEFT JOIN fa ON fa.rid = t.rid LEFT JOIN fb ON fb.rid = t.rid LEFT JOIN ra ON ra.rid = t.rid LEFT JOIN rb ON rb.rid = t.rid"""
