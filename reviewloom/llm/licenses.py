"""Licence scans by sentence rules.

Texts are cut into sentences (at ``. ; : ?`` before white space, and at blank lines; line breaks inside a
sentence are blanks). The colon of an SPDX tag and the full stop of "v. 2" do not cut. A normalised sentence, lower-case letters and digits with single blanks, is looked up
among the known licence sentences; one that is not known is looked up line by line. The known ones of a
document, in order, form a sequence of identifiers. Licence rules are tried in the order of ``RULES``: a rule
holds if its identifiers occur in this order, others between them, and are not all used by rules before it.

Sentences are unfolded where the row is and meet the known ones in a broadcast join of fixed size; only hits are
shuffled.

Defined results: null and empty texts have no licence and give no row; neither do documents in which no rule
holds. Rows that repeat an id and a text give one row, rows with the same id and other texts one each. Only
``id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.llm.common import documents, text_or_empty
from reviewloom.operators.bounded import small_table

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "spdx license identifier mit"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-ref": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
        "the asf licenses this file to you under the apache license version 2 0 the license",
        "the asf licenses this file to you under the apache license version 2 0",
        "spdx license identifier apache 2 0",
    ],
    "isc-ref": ["licensed under the isc license", "spdx license identifier isc"],
    "bsd3-ref": ["spdx license identifier bsd 3 clause"],
    "bsd2-ref": ["spdx license identifier bsd 2 clause"],
    "apache-limit": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl-free": [
        "this program is free software",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "gpl3-notice": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-notice": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl-free": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-free": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "gpl3-later": ["either version 3 of the license or at your option any later version"],
    "gpl2-later": ["either version 2 of the license or at your option any later version"],
    "gpl3-ref": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "this program is licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3 0",
        "spdx license identifier gpl 3 0 only",
        "spdx license identifier gpl 3 0 or later",
    ],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"],
    "lgpl-ref": [
        "licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1", "this library is free software",
        *[f"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version" for v in ("2 1", "3")],
        *[f"spdx license identifier lgpl {v}{end}" for v in ("2 1", "3 0") for end in ("", " only", " or later")],
    ],
    "agpl-ref": [
        "licensed under the gnu affero general public license version 3",
        "this work is licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        *[f"spdx license identifier agpl 3 0{end}" for end in ("", " only", " or later")],
    ],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "cc0-ref": ["this work is dedicated to the public domain", "licensed under cc0 1 0", "released under cc0 1 0", "spdx license identifier cc0 1 0"],
    "ccby-ref": ["licensed under cc by 4 0", "spdx license identifier cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa-ref": ["licensed under cc by sa 4 0", "spdx license identifier cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync-ref": ["licensed under cc by nc 4 0", "spdx license identifier cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbynd-ref": ["licensed under cc by nd 4 0", "spdx license identifier cc by nd 4 0"],
    "boost-ref": ["distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "spdx license identifier bsl 1 0"],
    "unlicense-ref": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "epl-ref": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
        "spdx license identifier epl 2 0", "spdx license identifier epl 1 0",
    ],
    "copyright": [],  # any sentence that starts with "copyright" and a year
    "reserved": ["all rights reserved"],
}
COPYRIGHT = "^copyright( c)? [0-9]{4}( |$)"
# Licence, its identifiers in order, and whether it restricts the use of the text.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"], False),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], False),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], False),
    ("ISC", ["isc-grant"], False),
    ("AGPL-3.0", ["gpl-free", "agpl-free", "gpl3-later"], True),
    ("AGPL-3.0", ["agpl-free", "gpl3-later"], True),
    ("LGPL", ["gpl-free", "lgpl-free", "gpl3-later"], True),
    ("LGPL", ["lgpl-free"], True),
    ("GPL-3.0", ["gpl3-notice"], True),
    ("GPL-2.0", ["gpl2-notice"], True),
    ("GPL-3.0", ["gpl-free", "gpl3-later"], True),
    ("GPL-2.0", ["gpl-free", "gpl2-later"], True),
    ("Apache-2.0", ["apache-ref", "apache-limit", "apache-copy"], False),
    ("Apache-2.0", ["apache-ref"], False),
    ("MIT", ["mit-ref"], False),
    ("MIT", ["mit-title"], False),
    ("AGPL-3.0", ["agpl-ref"], True),
    ("LGPL", ["lgpl-ref"], True),
    ("GPL-3.0", ["gpl3-ref"], True),
    ("GPL-2.0", ["gpl2-ref"], True),
    ("MPL-2.0", ["mpl-ref"], False),
    ("ISC", ["isc-ref"], False),
    ("BSD-3-Clause", ["bsd3-ref"], False),
    ("BSD-2-Clause", ["bsd2-ref"], False),
    ("CC0-1.0", ["cc0-ref"], False),
    ("CC-BY-SA-4.0", ["ccbysa-ref"], True),
    ("CC-BY-NC-4.0", ["ccbync-ref"], True),
    ("CC-BY-ND-4.0", ["ccbynd-ref"], True),
    ("CC-BY-4.0", ["ccby-ref"], False),
    ("BSL-1.0", ["boost-ref"], False),
    ("Unlicense", ["unlicense-ref"], False),
    ("EPL", ["epl-ref"], False),
    ("proprietary", ["copyright", "reserved"], True),
    ("proprietary", ["reserved"], True),
]
CUT = "\u0001"
SPLIT = r"([.;:?])[ \t-\r]+|\n[ \t\r]*\n"
LINES = r"[\n\r]+"
# Marks that are no ends of sentences, as groups of what stays.
INNER = [
    *[(r"(?i)(spdx-license-identifier)[ \t]*:[ \t]*\(?([A-Za-z0-9.+-]+)[ \t]+(?:OR|AND)[ \t]+", "$1 $2" + CUT + "$1: ")] * 3,  # up to four identifiers
    (r"(?i)(spdx-license-identifier)[ \t]*:[ \t]*", "$1 "),
    (r"(?i)\b(v)\.[ \t-\r]+([0-9])", "$1 $2"),
    *[(r"(?i)(neither[ \t-\r]+the[ \t-\r]+name[ \t-\r]+of[^;:?.]{1,200}?)\.([ \t-\r][^;:?]{0,200}?nor[ \t-\r])", "$1$2")] * 3,
]
# A clause that names a holder, and the form it is known by.
HOLDER = (r"^([0-9] )?neither the name of .+ nor the names of (its )?contributors", "neither the name of the copyright holder nor the names of its contributors")


def normalise(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), *HOLDER)


def known_sentences(spark: SparkSession) -> DataFrame:
    rows = [{"_norm": s, "_sentence": name} for name, found in SENTENCES.items() for s in found]
    return small_table(spark, rows, T.StructType([T.StructField("_norm", T.StringType()), T.StructField("_sentence", T.StringType())]))


def look_up(units: DataFrame, known: DataFrame) -> DataFrame:
    """``units`` with ``_sentence``: the identifier of their ``_unit``, or null."""
    found = units.withColumn("_norm", normalise(F.col("_unit"))).join(F.broadcast(known), "_norm", "left")
    return found.withColumn("_sentence", F.coalesce("_sentence", F.when(F.col("_norm").rlike(COPYRIGHT), F.lit("copyright")))).drop("_norm")


def sentence_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _tag, _at, _line, _sentence: the known sentences of every text with their places."""
    known = known_sentences(docs.sparkSession)
    whole = text_or_empty(text)
    for inner, stays in INNER:
        whole = F.regexp_replace(whole, inner, stays)
    cut = F.split(F.regexp_replace(whole, SPLIT, "$1" + CUT), CUT)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_tag"), F.posexplode(cut).alias("_at", "_unit"))
    whole = look_up(rows, known)
    lines = F.when(F.col("_sentence").isNotNull(), F.array(F.lit(""))).otherwise(F.split("_unit", LINES))
    parts = whole.select("doc_id", "_tag", "_at", F.col("_sentence").alias("_whole"), F.posexplode(lines).alias("_line", "_unit"))
    # A single line has been looked up already.
    found = look_up(parts.filter("_whole is not null or _line > 0 or _unit <> ''"), known)
    return found.select("doc_id", "_tag", "_at", "_line", F.coalesce("_whole", "_sentence").alias("_sentence")).filter("_sentence is not null")


def apply_rules(sequence: Column, rules=RULES) -> Column:
    """Licences whose rules hold in the space-joined ``sequence``, as an array in the order of the rules.

    A rule whose identifiers were all used by rules before it is passed over.
    """
    used: list[Column] = []
    found = []
    for k, (licence, ids, _) in enumerate(rules):
        pattern = "(^| )" + "( | .* )".join(ids) + "( |$)"
        holds = sequence.rlike(pattern)
        earlier = [u for u, (_, other, _) in zip(used, rules[:k]) if set(ids) <= set(other)]
        holds = reduce(lambda a, b: a & ~b, earlier, holds)
        used.append(holds)
        found.append(F.when(holds, F.lit(licence)))
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses, sentences (both space-joined), restricted: one row per document with a licence."""
    hits = sentence_hits(docs, doc_id, text)
    found = hits.groupBy("doc_id", "_tag").agg(F.sort_array(F.collect_set(F.struct("_at", "_line", "_sentence"))).alias("_hits"))
    found = found.withColumn("sentences", F.array_join(F.col("_hits._sentence"), " "))
    found = found.withColumn("_licenses", apply_rules(F.col("sentences"))).filter(F.size("_licenses") > 0)
    strict = sorted({name for name, _, restricts in RULES if restricts})
    restricted = F.arrays_overlap("_licenses", F.array(*[F.lit(s) for s in strict]))
    return found.select("doc_id", F.array_join("_licenses", " ").alias("licenses"), "sentences", restricted.alias("restricted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op10_licenses": op10_licenses}


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{name}')" for name, found in SENTENCES.items() for s in found)
    norm = f"regexp_replace(trim(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g')), '{HOLDER[0]}', '{HOLDER[1]}')"
    whole = "coalesce(text, '')"
    for inner, stays in INNER:
        whole = f"regexp_replace({whole}, '{inner}', '{stays.replace('$', chr(92))}', 'g')"
    named = "coalesce(k.name, CASE WHEN regexp_matches(" + norm + f", '{COPYRIGHT}') THEN 'copyright' END)"
    checks = []
    for n, (_, ids, _) in enumerate(RULES):
        pattern = "(^| )" + "( | .* )".join(ids) + "( |$)"
        earlier = [f"AND NOT r{m}" for m in range(n) if set(ids) <= set(RULES[m][1])]
        checks.append(f"regexp_matches(sentences, '{pattern}') {' '.join(earlier)} AS r{n}")
    strict = ", ".join(f"'{s}'" for s in sorted({name for name, _, restricts in RULES if restricts}))
    # The place of a licence is that of its first rule that holds.
    places = ", ".join(f"CASE WHEN r{n} THEN {{'n': {n}, 'l': '{licence}'}} END" for n, (licence, _, _) in enumerate(RULES))
    return rf"""
WITH known(norm, name) AS (VALUES {known}),
cut AS (
  SELECT DISTINCT doc_id, text, string_split(regexp_replace({whole}, '{SPLIT}', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
units AS (SELECT doc_id, text, p.at_, s[p.at_] AS unit FROM cut, unnest(range(1, len(s) + 1)) AS p(at_)),
whole AS (SELECT u.*, {named.replace("{0}", "unit")} AS name FROM units u LEFT JOIN known k ON k.norm = {norm.replace("{0}", "unit")}),
parts AS (SELECT doc_id, text, at_, q.line, string_split_regex(unit, '{LINES}')[q.line] AS piece FROM whole,
          unnest(range(1, len(string_split_regex(unit, '{LINES}')) + 1)) AS q(line) WHERE name IS NULL),
lined AS (SELECT p.*, {named.replace("{0}", "piece")} AS name FROM parts p LEFT JOIN known k ON k.norm = {norm.replace("{0}", "piece")}),
hits AS (SELECT doc_id, text, at_, 0 AS line, name FROM whole WHERE name IS NOT NULL
         UNION ALL SELECT doc_id, text, at_, line, name FROM lined WHERE name IS NOT NULL),
docs AS (SELECT doc_id, text, string_agg(name, ' ' ORDER BY at_, line) AS sentences FROM hits GROUP BY doc_id, text),
held AS (SELECT doc_id, sentences, {", ".join(checks)} FROM docs),
named AS (SELECT doc_id, sentences, list_filter([{places}], lambda x: x IS NOT NULL) AS found FROM held)
SELECT doc_id, array_to_string(list_transform(list_filter(found, lambda x: NOT list_contains(list_transform(list_filter(found, lambda y: y.n < x.n), lambda y: y.l), x.l)), lambda x: x.l), ' ') AS licenses,
       sentences, list_has_any(list_transform(found, lambda x: x.l), [{strict}]) AS restricted
FROM named WHERE len(found) > 0"""


ORACLES = {"op10_licenses": _oracle()}
