"""Licences recognised by their sentences, on DataFrame functions only.

Known sentences of licences and notices are a fixed table. A text is cut into sentences, each
is normalised (letters and digits in lower case, single spaces) and looked up; what remains of
the text is a sequence of sentence numbers with a mark for each unknown sentence. A rule is an
ordered list of sentence numbers, and matches where they follow each other with at most
``GAP`` unknown sentences between two of them. Texts are cut in two ways, because licences are
wrapped over lines as well as written line by line: once with line breaks as spaces, once
with every line for itself; a rule matches if it does in either.

Everything happens within a row: nothing is shuffled or broadcast, and a text without any of
the words that every rule needs one of is not cut at all.

Defined results: NULL and empty texts match nothing; repeated rows each get their answer;
other columns pass through, and a column named like an output is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

GAP = 2

# Sentences of public licences and of the notices that refer to them.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a "
                 "copy of this software and associated documentation files (the "
                 "\"Software\"), to deal in the Software without restriction, including "
                 "without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit "
                 "persons to whom the Software is furnished to do so, subject to the "
                 "following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included "
                  "in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
                    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any "
                 "purpose with or without fee is hereby granted, provided that the above "
                 "copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
                    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                    "WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without "
                 "modification, are permitted provided that the following conditions are "
                 "met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, "
                  "this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright "
                  "notice, this list of conditions and the following disclaimer in the "
                  "documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its "
                 "contributors may be used to endorse or promote products derived from this "
                 "software without specific prior written permission.",
    "bsd-released": "Released under the BSD License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software "
                    "distributed under the License is distributed on an \"AS IS\" BASIS, "
                    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                    "implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation, "
                  "either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later "
                    "version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but "
                "WITHOUT ANY WARRANTY;",
    "lgpl-work": "This work is licensed under the GNU Lesser General Public License, "
                 "version 3.",
    "agpl-work": "This work is licensed under the GNU Affero General Public License, "
                 "version 3.",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public "
                 "License, v.",
    "mpl-version": "2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License.",
    "cc0-law": "To the extent possible under law, the author has waived all copyright and "
               "related or neighboring rights to this work.",
    "unlicense-free": "This is free and unencumbered software released into the public "
                      "domain.",
}

# Rules as licence and ordered sentences.
RULES = {
    "mit-text": ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    "mit-short": ("MIT", ("mit-released",)),
    "mit-licensed": ("MIT", ("mit-licensed",)),
    "mit-project": ("MIT", ("mit-this",)),
    "isc-text": ("ISC", ("isc-grant", "isc-warranty")),
    "bsd-2-text": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "bsd-3-text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    "bsd-short": ("BSD", ("bsd-released",)),
    "apache-short": ("Apache-2.0", ("apache-licensed",)),
    "apache-header": ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy")),
    "gpl-3-short": ("GPL-3.0", ("gpl3-work",)),
    "gpl-2-short": ("GPL-2.0", ("gpl2-work",)),
    "gpl-3-header": ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    "gpl-2-header": ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms", "gpl2-version")),
    "lgpl-3-short": ("LGPL-3.0", ("lgpl-work",)),
    "agpl-3-short": ("AGPL-3.0", ("agpl-work",)),
    "mpl-2-header": ("MPL-2.0", ("mpl-terms", "mpl-version")),
    "cc-by-nc-short": ("CC-BY-NC-4.0", ("cc-by-nc",)),
    "cc-by-short": ("CC-BY-4.0", ("cc-by",)),
    "cc-by-sa-short": ("CC-BY-SA-4.0", ("cc-by-sa",)),
    "cc-by-work": ("CC-BY-4.0", ("cc-by-work",)),
    "cc-by-nc-work": ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    "cc-by-sa-work": ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    "cc0-law": ("CC0-1.0", ("cc0-law",)),
    "unlicense": ("Unlicense", ("unlicense-free",)),
}
# A rule that another rule contains counts only where the longer one does not match.
LONGER = {"bsd-2-text": "bsd-3-text"}

# The sentences of every rule hold one of these.
ANCHOR = (r"(?i)licen[cs]e|permission|warrant|redistribut|free software|public domain"
          r"|waived")
_STOP = r"([.!?;:])\s+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


NUMBERS = {name: k + 1 for k, name in enumerate(SENTENCES)}
KNOWN = {normalised(s): NUMBERS[name] for name, s in SENTENCES.items()}


def pattern(rule: str) -> str:
    """A rule as a pattern over sentence numbers, each between two bars."""
    return rf"(\|_){{0,{GAP}}}".join(rf"\|{NUMBERS[s]}" for s in RULES[rule][1]) + r"\|"


def _numbers(sentences: Column) -> Column:
    """Sentence numbers as text: |3|_|17|, with _ for unknown sentences."""
    known = F.create_map(*[F.lit(x) for k, n in KNOWN.items() for x in (k, str(n))])
    looked_up = F.transform(sentences, lambda s: F.coalesce(F.element_at(
        known, F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), F.lit("_")))
    return F.concat(F.lit("|"), F.array_join(looked_up, "|"), F.lit("|"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``sentences`` (known sentences in the order of the text, by number,
    cut line by line), ``rules`` and ``licenses`` that match, in order of their names."""
    names = ("sentences", "rules", "licenses")
    own = [c for c in docs.columns if c not in names]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stops = F.regexp_replace(body, _STOP, "$1\n")
    spaced = F.regexp_replace(F.regexp_replace(body, r"[\n\r]+", " "), _STOP, "$1\n")
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        body.rlike(ANCHOR).alias("_any"),
        F.when(body.rlike(ANCHOR), F.split(stops, "\n")).alias("_lines"),
        F.when(body.rlike(ANCHOR), F.split(spaced, "\n")).alias("_whole"),
    ).select("_row", "_any", _numbers(F.col("_lines")).alias("_lines"),
             _numbers(F.col("_whole")).alias("_whole"))

    def matches(rule: str) -> Column:
        either = F.col("_lines").rlike(pattern(rule)) | F.col("_whole").rlike(pattern(rule))
        return either & ~matches(LONGER[rule]) if rule in LONGER else either

    def matching(what: dict[str, str]) -> Column:
        hits = [F.when(matches(rule), F.lit(value)) for rule, value in what.items()]
        return F.when(F.col("_any"), F.array_sort(F.array_distinct(F.filter(
            F.array(*hits), lambda x: x.isNotNull())))).otherwise(
                F.array().cast("array<string>"))

    return found.select(
        *[F.col("_row").getField(c).alias(c) for c in own],
        F.when(F.col("_any"), F.transform(
            F.filter(F.split("_lines", r"\|"), lambda x: x.rlike("^[0-9]+$")),
            lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))
        .alias("sentences"),
        matching({r: r for r in RULES}).alias("rules"),
        matching({r: licence for r, (licence, _) in RULES.items()}).alias("licenses"))


def scan_sql() -> str:
    """The same in SQL, for one row per document as the registered query has it."""
    known = ", ".join(f"'{k}': '{n}'" for k, n in KNOWN.items())
    key = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"

    def numbers(cut: str) -> str:
        return (f"'|' || array_to_string(list_transform(string_split({cut}, chr(10)), "
                f"lambda s: coalesce(map_extract(known, {key})[1], '_')), '|') || '|'")

    lines = numbers("regexp_replace(t, '([.!?;:])\\s+', '\\1' || chr(10), 'g')")
    whole = numbers("regexp_replace(regexp_replace(t, '[\\n\\r]+', ' ', 'g'), "
                       "'([.!?;:])\\s+', '\\1' || chr(10), 'g')")

    def matches(rule: str) -> str:
        either = f"(regexp_matches(a, '{pattern(rule)}') OR regexp_matches(b, '{pattern(rule)}'))"
        return f"{either} AND NOT {matches(LONGER[rule])}" if rule in LONGER else either

    def listed(what: dict[str, str]) -> str:
        hits = ", ".join(f"CASE WHEN {matches(r)} THEN '{v}' END" for r, v in what.items())
        return f"coalesce(array_to_string(list_sort(list_distinct([{hits}])), ','), '')"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, MAP {{{known}}} AS known FROM documents),
n AS (SELECT doc_id, {lines} AS a, {whole} AS b FROM d)
SELECT doc_id, len(regexp_extract_all(a, '[0-9]+'))::BIGINT AS n_sentences,
       array_to_string(regexp_extract_all(a, '[0-9]+'), ',') AS sentences,
       {listed({r: r for r in RULES})} AS rules,
       {listed({r: v for r, (v, _) in RULES.items()})} AS licenses
FROM n"""
