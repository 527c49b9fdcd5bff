"""Recognises licences by sentence rules, with DataFrame functions only.

A text is normalised (A-Z to lower case, all but letters a-z and digits to one blank).
Known licence sentences are found in it where they begin and end at a line end, a blank
line, or . ! ? : ; before white space; within them single line ends and the comment marks
at line starts don't count, so wrapped texts and comment headers are found too. The
identifiers found, in order, are matched against ordered rules: each rule is a sequence of
identifiers that must follow each other with nothing but other sentences of no licence
between them. ``n_sentences`` counts sentences at line ends and after . ! ? before white space.

The SQL states the part of this that needs no patterns: sentences that stand on one line,
of ``SENTENCES`` and ``RULES`` only.

Results for odd input: a null or empty text has no sentences and no licence; repeated
rows, and rows that share an id, give a result each; of sentences that begin at one place the longest
counts, of rules with the same licence one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "licensed under cc by nc sa 4 0": "ccbyncsa4-ref",
    "licensed under cc by nc nd 4 0": "ccbyncnd4-ref",
    "licensed under cc by nd 4 0": "ccbynd4-ref",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "all rights reserved": "reserved",
}
# Ordered rules: the licence, and the identifiers that must come in sequence.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-warranty", "zlib-liable", "zlib-grant"]),
    ("Unlicense", ["unlicense-head", "unlicense-grant"]),
    ("Unlicense", ["unlicense-head"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-ref"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-ref"]),
    ("CC-BY-ND-4.0", ["ccbynd4-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("proprietary", ["reserved"]),
]

# Beyond the SQL: patterns of more wordings (a blank is any white space and comment mark, but no blank line).
_UNDER = r"(?:(?:this|the) [a-z]+(?: [a-z]+)? is )?(?:made available|available|licensed|released|distributed|published|provided) under (?:the )?(?:terms of (?:the )?)?"
_GRANT = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version"
_THING = "(?:program|library|software|file|package)"
PATTERNS = [
    (_UNDER + "mit licen[sc]e", "mit-ref"),
    (_UNDER + "apache (?:software )?licen[sc]e(?: version)? (?:v )?2 0", "apache2-ref"),
    (_UNDER + "(?:gnu general public license|gnu gpl|gpl) (?:version 3|v3)(?: 0)?", "gpl3-ref"),
    (_UNDER + "(?:gnu general public license|gnu gpl|gpl) (?:version 2|v2)(?: 0)?", "gpl2-ref"),
    (_UNDER + "(?:gnu lesser general public license|gnu lgpl|lgpl) (?:version 3|v3)(?: 0)?", "lgpl3-ref"),
    (_UNDER + "(?:gnu lesser general public license|gnu lgpl|lgpl) (?:version 2 1|v2 1)", "lgpl21-ref"),
    (_UNDER + "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: licen[sc]e)?", "bsd3-ref"),
    (_UNDER + "(?:2 clause bsd|bsd 2 clause|simplified bsd)(?: licen[sc]e)?", "bsd2-ref"),
    (_UNDER + "mozilla public licen[sc]e(?: version)? (?:v )?2 0", "mpl2-ref"),
    (_UNDER + "isc licen[sc]e", "isc-ref"),
    (_UNDER + "(?:gnu affero general public license|gnu agpl|agpl) (?:version 3|v3)(?: 0)?", "agpl3-ref"),
    (_UNDER + "boost software licen[sc]e(?: version)? 1 0", "bsl-ref"),
    (_UNDER + "eclipse public licen[sc]e(?: version)? (?:v )?2 0", "epl2-ref"),
    (_UNDER + "(?:a )?creative commons attribution 4 0(?: international)?(?: licen[sc]e)?", "ccby4-ref"),
    (_UNDER + "(?:a )?creative commons attribution share(?: )?alike 4 0(?: international)?(?: licen[sc]e)?", "ccbysa4-ref"),
    (_UNDER + "(?:a )?creative commons attribution non(?: )?commercial 4 0(?: international)?(?: licen[sc]e)?", "ccbync4-ref"),
    (_UNDER + "(?:a )?creative commons attribution no(?: )?derivatives 4 0(?: international)?(?: licen[sc]e)?", "ccbynd4-ref"),
    (_UNDER + "(?:a )?creative commons attribution non(?: )?commercial share(?: )?alike 4 0(?: international)?(?: licen[sc]e)?", "ccbyncsa4-ref"),
    (_UNDER + "(?:a )?creative commons attribution non(?: )?commercial no(?: )?derivatives 4 0(?: international)?(?: licen[sc]e)?", "ccbyncnd4-ref"),
    (_GRANT.format(_THING, "affero general public license", "3"), "agpl3-grant"),
    (_GRANT.format(_THING, "general public license", "2"), "gpl2-grant"),
    (_GRANT.format(_THING, "general public license", "3"), "gpl3-grant"),
    (_GRANT.format(_THING, "lesser general public license", "2 1"), "lgpl21-grant"),
    (_GRANT.format(_THING, "lesser general public license", "3"), "lgpl3-grant"),
    (f"this {_THING} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-warranty"),
    ("neither the name of [a-z0-9 ]{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-name"),
    ("this source code form is subject to the terms of the mozilla public license v[|]2 0", "mpl2-head"),
    ("permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-grant"),
]
_BSD3 = "bsd-grant bsd-source bsd-binary bsd-name"
MORE_RULES = [
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("ISC", ["isc-grant"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("BSL-1.0", ["bsl-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("ISC", ["isc-ref"]),
]

#: One of these is in every known sentence and pattern; texts without any aren't searched.
WORDS = "(?i)licen|permi|reserved|redistribut|warrant|notice|bsd|gpl|creative|liable|unencumbered|anyone"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, licence): identifiers and licences joined
    by one blank, in the order of the text and of the rules; licence is that of the first rule met."""
    ended = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[.!?][ \t]+", "\n")
    plain = F.regexp_replace(F.translate(ended, _UPPER, _LOWER), r"[^a-z0-9\n]+", " ")
    sentences = F.filter(F.transform(F.split(plain, "\n"), lambda s: F.btrim(s)), lambda s: s != "")
    found = F.transform(F.when(F.col("text").rlike(WORDS), F.regexp_extract_all(_marked(), F.lit(_any()), F.lit(0))).otherwise(F.array().cast("array<string>")), lambda x: _identifier(F.regexp_replace(x, r"[ \n~]+", " ")))
    rows = docs.select("doc_id", F.size(sentences).cast("long").alias("n_sentences"), F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")).alias("ids"))
    # three clauses are not two as well
    rows = rows.withColumn("other", F.replace("ids", F.lit(f" {_BSD3} "), F.lit(" bsd3 ")))
    rules = [("BSD-3-Clause", ["bsd3"]), *RULES, *MORE_RULES]
    met = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("other", F.lit(f" {' '.join(ids)} ")), F.lit(name)) for name, ids in rules])))
    # a right that is reserved says something only where no licence is granted
    met = F.when(F.size(met) > 1, F.array_remove(met, "proprietary")).otherwise(met)
    return rows.select("doc_id", "n_sentences", F.btrim("ids").alias("sentence_ids"), F.array_join(met, " ").alias("licences"), F.try_element_at(met, F.lit(1)).alias("licence"))


def _marked() -> Column:
    """The normalised text with its boundaries: a line end, ~ after : and ;, | after . ! ? and at blank lines."""
    text = F.regexp_replace(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER + "|~", _LOWER + "  "), r"[.!?](?=[ \t\r\n]|$)", "|")
    text = F.regexp_replace(F.regexp_replace(text, r"[:;](?=[ \t\r\n]|$)", "~"), r"[^a-z0-9\n|~]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r" ?([\n|~]) ?", "$1"), r"\n\n+", "|"))


def _any() -> str:
    """A pattern of all known sentences, the longest first, from boundary to boundary."""
    every = [*sorted(SENTENCES, key=len, reverse=True), *(p for p, _ in PATTERNS)]
    joined = "|".join(every).replace("[a-z0-9 ]", "@").replace(" ", r"[ \n~]+").replace("@", r"[a-z0-9 \n]")
    return f"(?<![a-z0-9 ])(?:{joined})(?![a-z0-9 ])"


def _identifier(sentence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    other = F
    for pattern, name in PATTERNS:
        other = other.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return F.coalesce(F.try_element_at(known, sentence), other)


def _sql() -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    met = ", ".join(f"CASE WHEN contains(ids, ' {' '.join(ids)} ') THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[.!?][ \\t]+', chr(10), 'g'),
    '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM documents),
named AS (
  SELECT doc_id, len(sentences) AS n, ' ' || coalesce(array_to_string(list_filter(list_transform(sentences, lambda s: MAP {{{known}}}[s]), lambda x: x IS NOT NULL), ' '), '') || ' ' AS ids FROM cut),
ruled AS (SELECT *, list_filter([{met}], lambda x: x IS NOT NULL) AS found FROM named),
once AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i AND (x <> 'proprietary' OR len(list_distinct(found)) = 1)) AS met FROM ruled)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, trim(ids) AS sentence_ids, coalesce(array_to_string(met, ' '), '') AS licences, met[1] AS licence FROM once
"""


SQL = _sql()
