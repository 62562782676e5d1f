"""Licence recognition by sentences.

A text that mentions licensing at all is split into sentences, each is normalised (lower
case, comment signs and punctuation to blanks) and mapped to the identifier of a known
licence sentence.  The identifiers, in order and without the sentences that mean nothing,
are matched with rules: ordered runs of identifiers that make up a licence.  Longer rules
come first and use their sentences up.

An SPDX tag gives one sentence for each licence of its expression; how the expression joins
them, and exceptions after WITH, are not told.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licence texts and notices, as patterns that a whole
# normalised sentence must match.  The first that matches counts.
SENTENCES = {
    "apache2-grant": r"licensed under the apache license version 2 0( the license)?( you may not use .*)?",
    "apache2-use": r"you may not use this file except in compliance with the license",
    "apache2-copy": r"you may obtain a copy of the license at( http.*)?",
    "apache2-warranty": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": r"see the license for the specific language governing permissions and limitations under the license",
    "mit-title": r"(the )?mit license( mit)?",
    "mit-released": r"(this (software|work|project|code) is )?(released|licensed|distributed) under (the terms of )?the mit license",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .* subject to the following conditions",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": r"the software is provided as is without warranty of any kind express or implied .*",
    "mit-liability": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": r"the software is provided as is and the author disclaims all warranties with regard to this software .*",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": r"(3 )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": r"this software is provided by the copyright holders and contributors as is and any express or implied warranties .* are disclaimed",
    "gpl-free": r"this (program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version",
    "gpl2-free": r"this (program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version",
    "gpl3-work": r"this (work|software|program|project) is licensed under the gnu general public license version 3( 0)?",
    "gpl2-work": r"this (work|software|program|project) is licensed under the gnu general public license version 2( 0)?",
    "agpl3-free": r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license .* version 3 of the license .*",
    "gpl2-only": r"this (program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-free": r"this (library|program|file) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (at your option )?any later version",
    "lgpl3-free": r"this (library|program|file) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version",
    "lgpl-free": r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license .*",
    "gpl-warranty": r"this (program|library) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": r"see the gnu (lesser |affero )?general public license for more details",
    "gpl-received": r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library) .*",
    "mpl2-form": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": r"if a copy of the mpl was not distributed with this file you can obtain one at .*",
    "cc-by-nc4": r"(this work is )?licensed under (a )?(cc by nc 4 0|creative commons attribution noncommercial 4 0 international( license)?)",
    "cc-by-sa4": r"(this work is )?licensed under (a )?(cc by sa 4 0|creative commons attribution sharealike 4 0 international( license)?)",
    "cc-by4": r"(this work is )?licensed under (a )?(cc by 4 0|creative commons attribution 4 0 international( license)?)",
    "cc0": r"(this work is )?(licensed|released) under (cc0 1 0|the creative commons zero .*)",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "public-domain": r"(this work|this file|this software) is (hereby )?(released into|placed in|in) the public domain",
    "epl2-terms": r"this program and the accompanying materials are made available under the terms of the eclipse public license (v )?2 0( which .*)?",
    "epl1-terms": r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0( which .*)?",
    "cddl-terms": r"the contents of this file are subject to the terms of the common development and distribution license( the license)?( version 1 0)?( the license)?( you may not use .*)?",
    "zlib-warranty": r"this software is provided as is without any express or implied warranty",
    "zlib-liability": r"in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost": r"distributed under the boost software license version 1 0( see .*)?",
    "rights": r"(copyright .* )?all rights reserved",
}

# Rules, the identifiers of a licence's sentences in order.  Longer rules first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache2-grant", "apache2-use", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("LGPL", ["lgpl-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-warranty", "gpl-see", "gpl-received"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-see"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-released"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL", ["lgpl-free"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("CDDL-1.0", ["cddl-terms"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-2.0", ["gpl2-work"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("ISC", ["isc-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["rights"]),
]

# Licence identifiers that SPDX tags may name.
SPDX = [
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0",
    "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Python-2.0", "Unlicense",
    "WTFPL", "X11", "Zlib",
]
_SPDX_SAYS = "spdx license identifier "
_SPDX_SENTENCES = {"spdx-" + i.lower(): _SPDX_SAYS + re.sub("[^a-z0-9]+", " ", i.lower()) for i in SPDX}
RULES += [(i, ["spdx-" + i.lower()]) for i in SPDX]

#: Every known sentence holds one of these words; texts without any are not split.  No two
#: words, which a line end may part.
MENTIONS = (
    "licen", "permi", "redistribut", "warrant", "copyright", "software", "domain",
    "rights", "mpl", "liable", "endorse",
)

# An SPDX tag that ends its line, but for what closes a comment, is a sentence of its own;
# others end at . ! ? ; : before a blank, or at a line that is blank but for comment signs.
_ID = r"[(]*[a-z0-9.+-]+[)]*"
_TAG = rf"spdx-license-identifier:[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)[ \t]*(?:\*/|-->|\*\))?[ \t]*\r?(\n|$)"
_JOINED = r"\s+(?:and|or|with)\s+"
_END = r"[.!?;:]+\s+|\n[\s*/#;%!-]*\n"
# Comment signs that would end a sentence, at the start of a line.
_SIGNS = r"(?m)^[ \t]*[;!]+(?=\s)"
# Places within known notices where such a sign ends no sentence.
_INSIDE = [
    (r"is free software", "[;:]", r"you can redistribute"),
    (r"free software foundation", "[;:]", r"either version"),
    (r"any warranty", "[;:]", r"without even the implied"),
    (r"along with this (?:program|library)", "[.;:]", r"if not"),
    (r"public license v", "[.]", r"2[.]0"),
    (r"(?:inc|ltd|corp|co)", "[.]", r"nor the names"),
]
_GAP = "[^a-z0-9]+"
_JOIN = "|".join(rf"(\b{a.replace(' ', _GAP)}){sign}(?={_GAP}{b.replace(' ', _GAP)})" for a, sign, b in _INSIDE)
_KEEP = "".join(f"${i + 1}" for i in range(len(_INSIDE)))


def _marker(identifier: str) -> str:
    return f"<{identifier}>"


def _sentences(lower: Column) -> Column:
    tagged = F.regexp_replace(lower, _TAG, " . spdx license identifier $1 . ")
    return F.split(F.regexp_replace(F.regexp_replace(tagged, _SIGNS, ""), _JOIN, _KEEP + " "), _END)


def sentence_identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lower = F.lower(text)

    def known(s: Column) -> Column:
        cases = [(s == text, name) for name, text in _SPDX_SENTENCES.items()]
        tagged = F.when(*cases[0])
        for case in cases[1:]:
            tagged = tagged.when(*case)
        first = F.when(s.startswith(_SPDX_SAYS), tagged)
        for name, pattern in SENTENCES.items():
            first = first.when(s.rlike(f"^(?:{pattern})$"), name)
        return first

    def of_expression(s: Column) -> Column:
        """A tag's sentence as one sentence for each licence it names."""
        named = F.split(F.replace(F.substring(s, len(_SPDX_SAYS) + 1, 2**31 - 1), F.lit("+"), F.lit("-or-later")), _JOINED)
        return F.when(s.startswith(_SPDX_SAYS), F.transform(named, lambda e: F.concat(F.lit(_SPDX_SAYS), e))).otherwise(F.array(s))

    mentioned = lambda s: s.rlike("|".join(MENTIONS))
    sentences = F.transform(
        F.flatten(F.transform(F.filter(_sentences(lower), mentioned), of_expression)),
        lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")),
    )
    any_mention = F.lit(False)
    for m in MENTIONS:
        any_mention = any_mention | F.contains(lower, F.lit(m))
    found = F.filter(F.transform(sentences, known), lambda x: x.isNotNull())
    return F.when(any_mention, found).otherwise(F.array().cast("array<string>"))


def rule_tokens(identifiers: Column) -> Column:
    """The identifiers with every run that makes up a licence replaced by ``@`` and its name."""
    run = F.array_join(F.transform(identifiers, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for name, rule in RULES:
        run = F.replace(run, F.lit("".join(map(_marker, rule))), F.lit(_marker("@" + name)))
    return F.filter(F.split(F.translate(run, "<", ""), ">"), lambda x: x != "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, sentences, licenses, unmatched.

    ``sentences`` lists the known sentences in order, ``licenses`` the licences whose rules
    match, each once and sorted, and ``unmatched`` the known sentences that no rule used; all
    are joined by blanks.  Null and empty texts, and texts that say nothing known, have none.
    Repeated rows are scanned alike; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       sentence_identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("_ids"))
    rows = rows.withColumn("_tokens", rule_tokens(F.col("_ids")))
    licenses = F.array_sort(F.array_distinct(F.transform(
        F.filter("_tokens", lambda x: x.startswith("@")), lambda x: F.substring(x, 2, 100))))
    return rows.select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_sentences"), F.array_join("_ids", " ").alias("sentences"),
        F.array_join(licenses, " ").alias("licenses"),
        F.array_join(F.filter("_tokens", lambda x: ~x.startswith("@")), " ").alias("unmatched"),
    )


def _sql() -> str:
    tagged = " ".join(f"WHEN '{t}' THEN '{n}'" for n, t in _SPDX_SENTENCES.items())
    cases = f"WHEN starts_with(s, '{_SPDX_SAYS}') THEN CASE s {tagged} END "
    cases += " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in SENTENCES.items())
    # RE2 looks ahead at nothing: what follows a sign is captured and put back
    split = r"regexp_replace(t, '(?m)^[ \t]*[;!]+(\s)', '\1', 'g')"
    for a, sign, b in _INSIDE:
        before, after = a.replace(" ", _GAP), b.replace(" ", _GAP)
        split = rf"regexp_replace({split}, '(\b{before}){sign}({_GAP}{after})', '\1 \2', 'g')"
    run = "coalesce(string_agg('<' || id || '>', '' ORDER BY i), '')"
    for name, rule in RULES:
        run = f"replace({run}, '{''.join(map(_marker, rule))}', '{_marker('@' + name)}')"
    return rf"""
WITH m AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '{_TAG}', ' . spdx license identifier \1 . ', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_split_to_array({split}, '{_END}') AS parts FROM m),
e AS (SELECT doc_id, flatten(list_transform(parts, lambda p: CASE WHEN starts_with(p, '{_SPDX_SAYS}')
  THEN list_transform(regexp_split_to_array(replace(substr(p, {len(_SPDX_SAYS) + 1}), '+', '-or-later'), '{_JOINED}'), lambda n: '{_SPDX_SAYS}' || n)
  ELSE [p] END)) AS parts FROM s),
x AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS i FROM e),
y AS (SELECT doc_id, i, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM x WHERE regexp_matches(raw, '{"|".join(MENTIONS)}')),
k AS (SELECT doc_id, i, CASE {cases} END AS id FROM y),
g AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS ids, {run} AS run FROM k WHERE id IS NOT NULL GROUP BY doc_id),
r AS (SELECT doc_id, n, ids, list_filter(string_split(translate(run, '<', ''), '>'), lambda v: v <> '') AS tok FROM g)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(tok, lambda v: v[1] = '@'), lambda v: v[2:]))), ' '), '') AS licenses,
  coalesce(array_to_string(list_filter(tok, lambda v: v[1] <> '@'), ' '), '') AS unmatched
FROM documents d LEFT JOIN r USING (doc_id)
"""


SQL = _sql()
