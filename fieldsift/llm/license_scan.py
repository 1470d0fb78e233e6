"""Licence recognition by sentence identifiers and ordered rules.

A text is cut into paragraphs at blank lines and into sentences behind sentence marks; a
sentence may run over several lines.  Normalised, known licence sentences become identifiers.
Where a sentence is not known, each of its lines is tried alone, as notices of one line often
have no mark.  The sequence of identifiers of a document is matched against rules in order: a
rule that finds its identifiers next to each other names a licence and uses them up, so a
longer rule comes before the shorter ones it contains.

Native: the work on a document stays in its row, with DataFrame functions only; there is
no shuffle.

Defined results: a null or empty text has no sentences; repeated sentences repeat their
identifier but a licence is named once; lines that speak of licences and are not known are
counted as unknown; rows are told apart by nothing, so repeated rows and null ids are rows of
their own; a very long text costs time in proportion to it; an empty table gives no rows.
Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "?"

# Sentences of licences and notices, normalised, and their identifiers.
_OWN_SENTENCES = {
    # Apache
    "licensed under the apache license version 2.0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind "
    "either express or implied": "apache_as_is",
    "see the license for the specific language governing permissions and limitations under "
    "the license": "apache_limits",
    # MIT
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions": "mit_grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including "
    "but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement": "mit_as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or "
    "other liability whether in an action of contract tort or otherwise arising from out of or "
    "in connection with the software or the use or other dealings in the software": "mit_liable",
    # ISC
    "permission to use copy modify and or distribute this software for any purpose with or "
    "without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies": "isc_grant",
    # BSD
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission": "bsd_name",
    # MPL
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2",
    # GPL family: a sentence ends behind the first half of the notices of version 2
    "either version 2 of the license or at your option any later version": "v2_later",
    "either version 2.1 of the license or at your option any later version": "v21_later",
    "either version 3 of the license or at your option any later version": "v3_later",
    "version 2 of the license": "v2_only",
    "version 2": "v2_only",
    # others
    "this work is dedicated to the public domain": "public_domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Names in short notices, and what they stand for.
_NAMED = {
    "apache license version 2.0": "apache2",
    "mit license": "mit",
    "isc license": "isc",
    "bsd 2 clause license": "bsd2",
    "bsd 3 clause license": "bsd3",
    "mozilla public license version 2.0": "mpl2",
    "gnu general public license version 2": "gpl2",
    "gnu general public license version 3": "gpl3",
    "gnu lesser general public license version 2.1": "lgpl21",
    "gnu lesser general public license version 3": "lgpl3",
    "gnu affero general public license version 3": "agpl3",
    "creative commons attribution 4.0 international license": "ccby4",
}
_CREATIVE_COMMONS = {"cc by 4.0": "ccby4", "cc by sa 4.0": "ccbysa4", "cc by nc 4.0": "ccbync4", "cc0 1.0": "cc0"}
_SPDX = {
    "apache 2.0": "apache2", "mit": "mit", "isc": "isc", "bsd 2 clause": "bsd2", "bsd 3 clause": "bsd3",
    "mpl 2.0": "mpl2", "gpl 2.0 only": "gpl2", "gpl 3.0 only": "gpl3", "gpl 2.0 or later": "gpl2_later",
    "gpl 3.0 or later": "gpl3_later", "lgpl 2.1 only": "lgpl21", "lgpl 2.1 or later": "lgpl21_later",
    "lgpl 3.0 only": "lgpl3", "lgpl 3.0 or later": "lgpl3_later", "agpl 3.0 only": "agpl3",
    "agpl 3.0 or later": "agpl3_later", "cc by 4.0": "ccby4", "cc by sa 4.0": "ccbysa4",
    "cc by nc 4.0": "ccbync4", "cc0 1.0": "cc0", "unlicense": "unlicense",
}
_NOTICES = (
    "licensed under", "released under", "distributed under", "this work is licensed under",
    "this software is licensed under", "this project is licensed under", "available under",
)
_GNU = {"gpl": "gnu general", "lgpl": "gnu lesser general", "agpl": "gnu affero general"}
_GNU_VERSIONS = {"2": "2", "2.1": "21", "3": "3"}


def _sentences() -> dict[str, str]:
    """Every known sentence; notices and GNU sentences by their rules."""
    made = dict(_OWN_SENTENCES)
    for notice in _NOTICES:
        for name, own in _NAMED.items():
            made[f"{notice} the {name}"] = own
            made[f"{notice} a {name}"] = own
        for name, own in _CREATIVE_COMMONS.items():
            made[f"{notice} {name}"] = own
            made[f"{notice} the {name} license"] = own
    for name, own in _SPDX.items():
        made[f"spdx license identifier {name}"] = own
    for short, name in _GNU.items():
        terms = f"you can redistribute it and or modify it under the terms of the {name} public license"
        by = "as published by the free software foundation"
        made[f"{terms} {by}"] = f"{short}_terms"
        for version, digits in _GNU_VERSIONS.items():
            later = f"either version {version} of the license or at your option any later version"
            made[f"{terms} {by} {later}"] = f"{short}{digits}_later"
            made[f"{terms} {by} version {version}"] = f"{short}{digits}"
            made[f"{terms} {by} version {version} of the license"] = f"{short}{digits}"
            made[f"{terms} version {version} {by}"] = f"{short}{digits}"
    return made


SENTENCES = _sentences()

#: What a licence sentence speaks of.  A sentence with none of these is not counted as unknown.
_TOPICS = ("licen", "copyright", "spdx", "permission", "redistribut", "warrant", "public domain")


def _hints() -> tuple[str, ...]:
    """Topics, and the longest word of every known sentence that holds none of them."""
    hints = list(_TOPICS)
    for sentence in SENTENCES:
        if not any(hint in sentence for hint in hints):
            hints.append(max(sentence.split(), key=len))
    return tuple(hints)


#: A sentence without one of these is no known one: derived from the sentences.
HINTS = _hints()

_GNU_NAMES = {
    f"{short}{digits}": f"{short.upper()}-{version if '.' in version else version + '.0'}"
    for short in _GNU
    for version, digits in _GNU_VERSIONS.items()
}
#: Licence and the identifiers that name it, in the order they are tried.
RULES = (
    ("Apache-2.0", ("apache2", "apache_comply", "apache_copy", "apache_as_is", "apache_limits")),
    ("Apache-2.0", ("apache2", "apache_comply", "apache_copy", "apache_limits")),
    ("Apache-2.0", ("apache2", "apache_comply", "apache_copy")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", ("isc_grant",)),
    *[
        (f"{_GNU_NAMES[f'{short}{d}']}-{end}", (f"{short}_terms", f"v{d}_{end.split('-')[-1]}"))
        for short in _GNU
        for d, end in (("2", "or-later"), ("21", "or-later"), ("3", "or-later"), ("2", "only"))
    ],
    *[(f"{name}-or-later", (f"{own}_later",)) for own, name in _GNU_NAMES.items()],
    *[(f"{name}-only", (own,)) for own, name in _GNU_NAMES.items()],
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit",)),
    ("MIT", ("mit_grant",)),
    ("ISC", ("isc",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public_domain",)),
)
# Its colon ends no sentence.
_SPDX_MARK = "SPDX-License-Identifier:"
# Items of a list, comment signs and the like before the first word of a sentence.
_LEADING = "^(?:[0-9]+ |[a-z] )(?=redistribution|neither)"


def normal(sentence: Column) -> Column:
    """ASCII lower case; other signs become one space, dots stay within numbers."""
    words = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9.]+", " ")
    plain = F.btrim(F.regexp_replace(words, "[.]+( |$)", " "), F.lit(" "))
    return F.regexp_replace(plain, _LEADING, "")


def _hinted(sentence: Column) -> Column:
    low = F.translate(sentence, UPPER, LOWER)
    found = F.contains(low, F.lit(HINTS[0]))
    for hint in HINTS[1:]:
        found = found | F.contains(low, F.lit(hint))
    return found


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences and ``?`` for others on licences, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # A mark in front of white space, or a blank line, ends a sentence.  "1. Redistributions"
    # is an item: a mark behind a number that begins a line ends none.
    text = F.replace(text, F.lit(_SPDX_MARK), F.lit(_SPDX_MARK.replace(":", " ")))
    items = F.regexp_replace(text, "(?m)^([ \\t*#/]*[0-9]{1,2})[.][ \\t]", "$1 ")
    broken = F.regexp_replace(items, "([.!?;:])[ \\t\\r\\n]|\\r?\\n[ \\t*#/]*\\r?\\n", "$1\u0001")

    def of_sentence(sentence: Column) -> Column:
        lines = F.transform(
            F.filter(F.split(sentence, "[\\r\\n]+"), _hinted),
            lambda line: F.coalesce(known[normal(line)], F.lit(UNKNOWN)),
        )
        return F.get(
            F.transform(
                F.array(known[normal(sentence)]),
                lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(lines),
            ),
            F.lit(0),
        )

    sentences = F.filter(F.split(broken, "\u0001"), _hinted)
    return F.flatten(F.transform(sentences, of_sentence))


def _tags(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scanned(docs: DataFrame) -> DataFrame:
    """Per document the sequence of sentence identifiers and the licences they name."""
    rules = F.array(
        *[F.struct(F.lit(_tags(ids)).alias("ids"), F.lit(name).alias("name")) for name, ids in RULES]
    )

    def tried(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            # What is used up leaves a sign, so identifiers around it do not become neighbours.
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit("|")))
            .otherwise(state["left"])
            .alias("left"),
            F.when(hit, F.array_union(state["names"], F.array(rule["name"])))
            .otherwise(state["names"])
            .alias("names"),
        )

    tags = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    none = F.array().cast("array<string>")
    start = F.struct(tags.alias("left"), none.alias("names"))
    return (
        id_and_text(docs)
        .select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("ids"))
        .withColumn(
            "licenses",
            F.when(F.size("ids") > 0, F.aggregate(rules, start, tried)["names"]).otherwise(none),
        )
        .select(
            "doc_id",
            F.size("ids").cast("long").alias("n_sentences"),
            F.size(F.filter("ids", lambda i: i == UNKNOWN)).cast("long").alias("n_unknown"),
            F.array_join("ids", ",").alias("sentence_ids"),
            F.array_join("licenses", ",").alias("licenses"),
        )
    )


def oracle() -> str:
    """The same as relational DuckDB SQL: sentences and lines as rows, rules by position.

    The fixed sentences and rules are read in as data; cutting, normalising, looking up and
    matching are written a second time.
    """
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())

    def plain(x: str) -> str:
        words = f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[.]+[a-z0-9]+)*')"
        return (
            f"regexp_replace(array_to_string({words}, ' '), "
            "'^(?:[0-9]+ |[a-z] )(redistribution|neither)', '\\1')"
        )

    hints = "|".join(HINTS)
    steps = []
    for k, (name, ids) in enumerate(RULES):
        pattern = _tags(ids).replace("|", "[|]")
        steps.append(
            f"s{k} AS (SELECT doc_id, num, regexp_replace(tags, '{pattern}', '|', 'g') AS tags, "
            f"CASE WHEN regexp_matches(tags, '{pattern}') THEN list_append(names, '{name}') ELSE names "
            f"END AS names FROM {'t' if k == 0 else f's{k - 1}'})"
        )
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS num, doc_id, regexp_replace(
    replace(coalesce(text, ''), '{_SPDX_MARK}', 'SPDX-License-Identifier '), '(?m)^([ \\t*#/]*[0-9]{{1,2}})[.][ \\t]', '\\1 ', 'g') AS text FROM documents),
cut AS (
  SELECT num, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM (
    SELECT num, string_split(regexp_replace(text,
      '([.!?;:])[ \\t\\r\\n]|\\r?\\n[ \\t*#/]*\\r?\\n', '\\1' || chr(1), 'g'), chr(1)) AS parts
    FROM docs)),
hinted AS (SELECT * FROM cut WHERE regexp_matches(lower(sentence), '{hints}')),
found AS (
  SELECT num, place, hinted.sentence, id FROM hinted LEFT JOIN known k ON k.sentence = {plain('hinted.sentence')}),
lines AS (
  SELECT num, place, unnest(parts) AS line, generate_subscripts(parts, 1) AS part FROM (
    SELECT num, place, string_split_regex(sentence, '[\\r\\n]+') AS parts FROM found WHERE id IS NULL)),
ids AS (
  SELECT num, place, 0 AS part, id FROM found WHERE id IS NOT NULL
  UNION ALL
  SELECT num, place, part, coalesce(id, '{UNKNOWN}') FROM lines LEFT JOIN known k
    ON k.sentence = {plain('line')} WHERE regexp_matches(lower(line), '{hints}')),
listed AS (SELECT num, list(id ORDER BY place, part) AS ids FROM ids GROUP BY num),
t AS (
  SELECT num, doc_id, array_to_string(list_transform(coalesce(ids, []),
    lambda i: '<' || i || '>'), '') AS tags, CAST([] AS VARCHAR[]) AS names
  FROM docs LEFT JOIN listed USING (num)),
{", ".join(steps)}
SELECT doc_id, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(coalesce(ids, []), lambda i: i = '{UNKNOWN}')) AS BIGINT) AS n_unknown,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  array_to_string(list_transform(list_filter(range(1, len(names) + 1),
    lambda k: list_position(names, names[k]) = k), lambda k: names[k]), ',') AS licenses
FROM s{len(RULES) - 1} LEFT JOIN listed USING (num)"""
