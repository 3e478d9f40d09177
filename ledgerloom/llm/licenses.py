"""Licence scans in DataFrame functions alone: known sentences first, then rules over the sequence of their identifiers.

A text is cut into sentences, also at line ends unless the next line goes on in lower case. Sentences that hold a trigger word are
normalised and looked up by their opening words; a document's known sentences, in order, form a sequence of identifiers, on which the
ordered rules match: at each place the first rule that fits takes the identifiers it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, lower_ascii, text_or_empty

# Identifiers of licence sentences and their normalised openings (a longer opening comes before one that starts it).
SENTENCES = [
    ("mit", "under the mit license"),
    ("mit", "under the mit licence"),
    ("mit", "spdx-license-identifier mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included"),
    ("mit-warranty", "the software is provided as is without warranty of any kind"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable"),
    ("apache2", "under the apache license version 2.0"),
    ("apache2", "under the apache license 2.0"),
    ("apache2", "under apache-2.0"),
    ("apache2", "spdx-license-identifier apache-2.0"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-law", "unless required by applicable law or agreed to in writing software"),
    ("gpl-free", "this program is free software"),
    ("agpl3", "under the gnu affero general public license version 3"),
    ("lgpl3", "under the gnu lesser general public license version 3"),
    ("lgpl2", "under the gnu lesser general public license version 2.1"),
    ("gpl3", "under the gnu general public license version 3"),
    ("gpl2", "under the gnu general public license version 2"),
    ("gpl3", "spdx-license-identifier gpl-3.0"),
    ("gpl2", "spdx-license-identifier gpl-2.0"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful"),
    ("gpl-copy", "you should have received a copy of the gnu"),
    ("mpl2", "under the mozilla public license version 2.0"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("mpl2", "spdx-license-identifier mpl-2.0"),
    ("bsd3", "under the bsd 3-clause license"),
    ("bsd2", "under the bsd 2-clause license"),
    ("bsd3", "spdx-license-identifier bsd-3-clause"),
    ("bsd2", "spdx-license-identifier bsd-2-clause"),
    ("bsd-head", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-name", "neither the name of"),
    ("isc", "permission to use copy modify and/or distribute this software for any purpose"),
    ("isc", "under the isc license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "under cc0 1.0"),
    ("cc-by-nc-sa4", "under cc by-nc-sa 4.0"),
    ("cc-by-nc-nd4", "under cc by-nc-nd 4.0"),
    ("cc-by-nc4", "under cc by-nc 4.0"),
    ("cc-by-nd4", "under cc by-nd 4.0"),
    ("cc-by-sa4", "under cc by-sa 4.0"),
    ("cc-by4", "under cc by 4.0"),
    ("rights", "all rights reserved"),
]
# Licences and the identifier sequences that tell them, in the order in which they are tried.
RULES = [
    ("BSD-3-Clause", "<bsd-head><bsd-source><bsd-binary><bsd-name>"),
    ("BSD-2-Clause", "<bsd-head><bsd-source><bsd-binary>"),
    ("MIT", "<mit-grant>(<mit-notice>)?(<mit-warranty>)?(<mit-liability>)?"),
    ("MIT", "<mit>"),
    ("Apache-2.0", "<apache2>(<apache-comply>)?(<apache-copy>)?(<apache-law>)?"),
    ("AGPL-3.0", "(<gpl-free>)?<agpl3>(<gpl-warranty>)?(<gpl-copy>)?"),
    ("LGPL-3.0", "(<gpl-free>)?<lgpl3>(<gpl-warranty>)?(<gpl-copy>)?"),
    ("LGPL-2.1", "(<gpl-free>)?<lgpl2>(<gpl-warranty>)?(<gpl-copy>)?"),
    ("GPL-3.0", "(<gpl-free>)?<gpl3>(<gpl-warranty>)?(<gpl-copy>)?"),
    ("GPL-2.0", "(<gpl-free>)?<gpl2>(<gpl-warranty>)?(<gpl-copy>)?"),
    ("MPL-2.0", "<mpl2>"),
    ("BSD-3-Clause", "<bsd3>"),
    ("BSD-2-Clause", "<bsd2>"),
    ("ISC", "<isc>(<mit-warranty>)?"),
    ("Unlicense", "<unlicense>(<mit-warranty>)?"),
    ("CC0-1.0", "<cc0>"),
    ("CC-BY-NC-SA-4.0", "<cc-by-nc-sa4>"),
    ("CC-BY-NC-ND-4.0", "<cc-by-nc-nd4>"),
    ("CC-BY-NC-4.0", "<cc-by-nc4>"),
    ("CC-BY-ND-4.0", "<cc-by-nd4>"),
    ("CC-BY-SA-4.0", "<cc-by-sa4>"),
    ("CC-BY-4.0", "<cc-by4>"),
    ("LicenseRef-all-rights-reserved", "<rights>"),
]
TRIGGERS = r"licen[cs]e|copyright|permission|redistribut|warrant|rights reserved|public domain|free software|copy of the gnu|neither the name|under (cc|apache)"
# Normal form, in this order: what is replaced by what.
NORMAL = [
    (r"creative commons attribution-noncommercial", "cc by-nc"),
    (r"[^a-z0-9/.\x20-]+", " "),
    (r"\.(\x20|$)", " "),
    (r"\x20\x20+", " "),
    (r"^\x20|\x20$", ""),
    (r"^.*\b(released|licensed|distributed|available|published|redistribute it and/or modify it|provided)\x20under\x20(the\x20terms\x20of\x20)?", "under "),
    (r"\x20(as\x20published\x20by\x20the\x20free\x20software\x20foundation\x20)?either\x20version\x20", " version "),
    (r"\x20as\x20published\x20by\x20the\x20free\x20software\x20foundation\x20version\x20", " version "),
]
#: Sentence ends become line ends; line ends before a lower-case letter become spaces.
WRAPPED, ENDED = r"\n[\x20\t#*/]*([a-z])", r"([.!?;:])[\x20\t\r]+"


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, WRAPPED, " $1"), ENDED, "$1\n"), "\n")


def normal(sentence: Column) -> Column:
    out = lower_ascii(sentence)
    for pattern, by in NORMAL:
        out = F.regexp_replace(out, pattern, by)
    return out


def identified(sentence: Column) -> Column:
    """The identifier of a normalised sentence: that of the first opening it has, else null."""
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(o).alias("opening")) for i, o in SENTENCES])
    return F.get(F.filter(known, lambda k: F.startswith(sentence, k["opening"])), F.lit(0))["id"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids and licenses (comma-joined, in order) of docs (doc_id, text; more columns are ignored).

    Null or empty text: one sentence, no licence. Null doc_id and repeated rows: kept. Very long texts are scanned whole. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences(text_or_empty()).alias("each"))
    told = F.filter("each", lambda s: F.regexp_like(lower_ascii(s), F.lit(TRIGGERS)))
    ids = F.array_compact(F.transform(F.transform(told, lambda s: normal(s)), lambda s: identified(s)))
    rows = rows.select("doc_id", F.size("each").cast("long").alias("n_sentences"), ids.alias("ids"))
    sequence = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    runs = F.regexp_extract_all(sequence, F.lit("|".join(f"(?:{rule})" for _, rule in RULES)), F.lit(0))

    def name(run: Column) -> Column:
        out = F.lit(None)
        for licence, rule in reversed(RULES):
            out = F.when(F.regexp_like(run, F.lit(f"^(?:{rule})$")), F.lit(licence)).otherwise(out)
        return out

    return rows.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.transform(runs, name), ",").alias("licenses"))


def sql() -> str:
    """The same scan as DuckDB SQL."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    norm = f"translate(s, '{UPPER}', '{LOWER}')"
    for pattern, by in NORMAL:
        norm = f"regexp_replace({norm}, {text(pattern)}, {text(by)}, 'g')"
    known = "CASE " + " ".join(f"WHEN starts_with(n, {text(o)}) THEN {text(i)}" for i, o in SENTENCES) + " END"
    name = "CASE " + " ".join(f"WHEN regexp_full_match(r, {text(rule)}) THEN {text(licence)}" for licence, rule in RULES) + " END"
    every = "|".join(f"(?:{rule})" for _, rule in RULES)
    split = f"string_split(regexp_replace(regexp_replace(coalesce(text, ''), {text(WRAPPED)}, ' \\1', 'g'), {text(ENDED)}, '\\1' || chr(10), 'g'), chr(10))"
    return f"""
WITH s AS (SELECT doc_id, {split} AS each FROM documents),
t AS (SELECT doc_id, CAST(len(each) AS BIGINT) AS n_sentences,
             list_filter(each, lambda s: regexp_matches(translate(s, '{UPPER}', '{LOWER}'), {text(TRIGGERS)})) AS told FROM s),
i AS (SELECT doc_id, n_sentences, list_filter(list_transform(list_transform(told, lambda s: {norm}), lambda n: {known}), lambda x: x IS NOT NULL) AS ids FROM t)
SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_transform(regexp_extract_all(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), {text(every)}), lambda r: {name}), ',') AS licenses
FROM i
"""
