"""License scan by sentence rules (built-in functions only).

Text is cut into sentences, sentences are normalised and mapped to known license-sentence
identifiers, and the identifier sequence of a document is matched against ordered rules: a rule
holds where its identifiers follow each other in the document's sequence of known sentences. Other known sentences may
lie between them, and at most ``MAX_GAP`` pieces from one to the next (two lines of one piece: as many lines).

Defined results: null or empty text has no sentences, hence no rows; a sentence that wraps over
lines and a line without a full stop are both recognised; repeated rows give repeated results
(rows are told apart by doc_id and the text's hash, so equal rows count once); extra columns of
the input are ignored. An empty table gives no rows. A piece that is known as a whole and as one of its lines counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences, as published in the license texts and in common notices. Identifier -> normalised
#: sentence (lower case, runs of other characters than a-z 0-9 as one blank). A published sentence that END cuts is
#: there in its pieces.
SENTENCES = {
    "mit.ref": "released under the mit license",
    "mit.ref2": "licensed under the mit license",
    "mit.title": "the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.ref": "licensed under the apache license version 2 0",
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "gpl3.ref": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.free1": "this program is free software",
    "gpl.free2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl.terms1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl.version": "either version 3 of the license or at your option any later version",
    "gpl2.version": "either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.hope1": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.hope2": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4.ref": "licensed under cc by nc 4 0",
    "ccby4.ref": "licensed under cc by 4 0",
    "ccbysa4.ref": "licensed under cc by sa 4 0",
    "ccby4.long": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0.ref": "this work is dedicated to the public domain under cc0 1 0",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2.ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2.ref1": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2.copy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
                  "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "lgpl.free1": "this library is free software",
    "lgpl21.free2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21.version": "either version 2 1 of the license or at your option any later version",
    "lgpl3.free2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.hope1": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3.free2": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost.ref": ("distributed under the boost software license version 1 0", "boost software license version 1 0"),
    "epl2.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "artistic2.title": "the artistic license 2 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
}


#: Licenses by the names that people give them in a sentence, and such sentences. Fixed values.
NAMES = {
    "MIT": ("mit license",), "Apache-2.0": ("apache license 2 0", "apache 2 0 license", "apache license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"), "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "ISC": ("isc license",), "Zlib": ("zlib license",), "BSL-1.0": ("boost software license 1 0",), "MPL-2.0": ("mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license 2 0",), "Artistic-2.0": ("artistic license 2 0",), "Unlicense": ("unlicense",),
}
PHRASES = ("released under the {}", "licensed under the {}", "licensed under the terms of the {}", "distributed under the {}", "available under the {}",
           "this project is licensed under the {}", "this project is licensed under the terms of the {}", "this software is licensed under the {}")
#: Identifiers of SPDX lines. The short GNU ones do not say whether later versions are meant and stay as they are.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Artistic-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
        *(f"{x}{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later")))
_WORDED = {x for v in SENTENCES.values() for x in ([v] if isinstance(v, str) else v)}
#: Sentences made of a name and a phrase, but for those above that have an identifier of their own.
SENTENCES |= {f"name.{i}": tuple(x for n in names for p in PHRASES if (x := p.format(n)) not in _WORDED) for i, names in NAMES.items()}
SENTENCES |= {f"spdx.{i}": "spdx license identifier " + i.lower().replace("-", " ").replace(".", " ") for i in SPDX}
SENTENCES["name.MIT"] += ("mit licensed",)


def _notice(name: str, license: str, gpl: str) -> tuple:
    """The rules of a GPL notice. END cuts it at the ':' or ';' of 'free software', the ';' before 'either' and the ';' of
    the warranty; copies have commas or nothing there, so each way of cutting is a rule. The first is the published one's."""
    published = "semicolons" if gpl == "gpl2" else "colon"
    free = {"colon": ("gpl.free1", f"{gpl}.free2"), "semicolons": ("gpl.free1", "gpl.terms", f"{gpl}.version"),
            "semicolon": ("gpl.terms1", f"{gpl}.version"), "plain": (f"{gpl}.free",)}
    hope = {"": ("gpl.hope1", "gpl.hope2"), "-whole": ("gpl.hope",)}
    order = sorted(free, key=lambda x: x != published)
    return tuple((name + (f"-{f}" if f != published else "") + h, license, free[f] + hope[h]) for f in order for h in hope)


#: License rules: name, license, ordered sentence identifiers. Where a rule's sequence contains another's, both hold and
#: the report says which is the longest per license.
RULES = (
    ("mit-ref", "MIT", ("mit.ref",)),
    ("mit-ref-licensed", "MIT", ("mit.ref2",)),
    ("mit-title", "MIT", ("mit.title",)),
    ("mit-text", "MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("apache-ref", "Apache-2.0", ("apache2.ref",)),
    ("apache-header", "Apache-2.0", ("apache2.header", "apache2.comply", "apache2.copy")),
    ("gpl3-ref", "GPL-3.0-only", ("gpl3.ref",)),
    *_notice("gpl3-notice", "GPL-3.0-or-later", "gpl"),
    *_notice("gpl2-notice", "GPL-2.0-or-later", "gpl2"),
    ("cc-by-nc-ref", "CC-BY-NC-4.0", ("ccbync4.ref",)),
    ("cc-by-ref", "CC-BY-4.0", ("ccby4.ref",)),
    ("cc-by-long", "CC-BY-4.0", ("ccby4.long",)),
    ("cc-by-sa-ref", "CC-BY-SA-4.0", ("ccbysa4.ref",)),
    ("cc-by-sa-long", "CC-BY-SA-4.0", ("ccbysa4.long",)),
    ("cc0-ref", "CC0-1.0", ("cc0.ref",)),
    ("bsd-2", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("bsd-3", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("isc-text", "ISC", ("isc.grant",)),
    ("mpl-ref", "MPL-2.0", ("mpl2.ref1", "mpl2.copy")),
    ("mpl-ref-plain", "MPL-2.0", ("mpl2.ref",)),
    ("unlicense-text", "Unlicense", ("unlicense.free",)),
    ("lgpl21-notice", "LGPL-2.1-or-later", ("lgpl.free1", "lgpl21.free2", "lgpl21.version", "lgpl.hope1", "gpl.hope2")),
    ("lgpl3-notice", "LGPL-3.0-or-later", ("lgpl.free1", "lgpl3.free2", "lgpl.hope1", "gpl.hope2")),
    ("lgpl3-program-notice", "LGPL-3.0-or-later", ("gpl.free1", "lgpl3.free2", "gpl.hope1", "gpl.hope2")),
    ("agpl3-notice", "AGPL-3.0-or-later", ("gpl.free1", "agpl3.free2", "gpl.hope1", "gpl.hope2")),
    ("zlib-text", "Zlib", ("zlib.warranty", "zlib.grant")),
    ("boost-ref", "BSL-1.0", ("boost.ref",)),
    ("epl-ref", "EPL-2.0", ("epl2.terms",)),
    ("artistic-title", "Artistic-2.0", ("artistic2.title",)),
    *((f"name-{i}", i, (f"name.{i}",)) for i in NAMES),
    *((f"spdx-{i}", i, (f"spdx.{i}",)) for i in SPDX),
)
#: Pieces between two neighbours of a rule; longer distances are two texts.
MAX_GAP = 20
#: The colon of an SPDX line ends no sentence.
SPDX_TAG = "SPDX-License-Identifier"

#: A sentence ends at . ! ? ; : before white space or the end, and at an empty line.
END = r"(?<![.!?;:])[.!?;:]++(?:[\x20\x09-\x0D]+|$)|\n[\x20\x09]*\n"


def normalised(sentence: Column) -> Column:
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def known_sentences(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, _text, piece, line, sentence_id): the known sentences of each text, in order.

    ``sentences`` is the table (sentence, sentence_id); it is joined by equality. Whole pieces have
    line 0; the lines of a piece of several lines follow from 1.
    """
    text = F.replace("text", F.lit(SPDX_TAG + ":"), F.lit(SPDX_TAG))
    pieces = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode_outer(F.split(text, END)).alias("piece", "_p"))
    lines = F.when(F.contains(F.col("_p"), F.lit("\n")), F.concat(F.array("_p"), F.split("_p", "\n"))).otherwise(F.array("_p"))
    parts = pieces.select("doc_id", "_text", "piece", F.posexplode_outer(lines).alias("line", "_s"))
    # The key is never null (no known sentence is empty), so that no null test computes it a second time.
    return (parts.withColumn("sentence", F.coalesce(normalised(F.col("_s")), F.lit("")))
            .join(sentences, "sentence").select("doc_id", "_text", "piece", "line", "sentence_id"))


def wordings(sentences: dict) -> list[tuple[str, str]]:
    """(sentence, identifier) of each wording."""
    return [(x, i) for i, v in sentences.items() for x in ([v] if isinstance(v, str) else v)]


def _chained(seq: Column, ids: Column, max_gap: int) -> Column:
    """(n, first, last) of the matches of ``ids`` in ``seq``, an array of (piece, line, sentence_id) in order.

    For each step of the rule the latest place where its beginning ends, with the place where that began; the latest one is
    the nearest to whatever follows, so none is missed. Matches that begin at the same place are one."""
    place = "struct<piece:int,line:int>"
    step = f"struct<began:{place},at:{place}>"
    start = F.struct(F.transform(ids, lambda _: F.lit(None).cast(step)).alias("steps"), F.lit(0).cast("long").alias("n"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def near(x: Column, y: Column) -> Column:
        return F.when(x["piece"] == y["piece"], y["line"] - x["line"] <= max_gap).otherwise(y["piece"] - x["piece"] <= max_gap)

    def on(acc: Column, x: Column) -> Column:
        here = F.struct(x["piece"].alias("piece"), x["line"].alias("line"))
        old = acc["steps"]

        def moved(s: Column, k: Column) -> Column:
            before = F.get(old, k - 1)
            return (F.when(F.get(ids, k) != x["sentence_id"], s).when(k == 0, F.struct(here.alias("began"), here.alias("at")))
                    .when(near(before["at"], here), F.struct(before["began"].alias("began"), here.alias("at"))).otherwise(s))

        steps = F.transform(old, moved)
        was, now = F.element_at(old, -1)["began"], F.element_at(steps, -1)["began"]
        new = F.coalesce(now != was, now.isNotNull())
        return F.struct(steps.alias("steps"), (acc["n"] + new.cast("long")).alias("n"), F.coalesce(acc["first"], now["piece"]).alias("first"),
                        F.when(F.element_at(ids, -1) == x["sentence_id"], F.coalesce(F.element_at(steps, -1)["at"]["piece"], acc["last"])).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.filter(seq, lambda x: F.array_contains(ids, x["sentence_id"])), start, on)


def scan(docs: DataFrame, sentences: dict[str, str | tuple] = SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, license, rule, n_matches, n_sentences, first_piece, last_piece) for each rule that holds in a text.

    Matches with different first sentences are counted; the pieces (from 0) are those of the first match's beginning and
    the last one's end. The sentence table and the rules are arguments of the call, so their size is known: the
    sentence table is broadcast. Only known sentences are shuffled. A rule must not name a sentence twice.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(wordings(sentences), "sentence string, sentence_id string")
    known = known_sentences(docs, F.broadcast(table))
    # A piece of one sentence and white space is known as a whole and as a line.
    at = known.groupBy("doc_id", "_text", "piece", "sentence_id").agg(F.collect_set("line").alias("_l"))
    at = at.select("doc_id", "_text", "piece", "sentence_id", F.explode(F.when(F.array_min("_l") == 0, F.array(F.lit(0))).otherwise(F.col("_l"))).alias("line"))
    seq = at.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list(F.struct("piece", "line", "sentence_id"))).alias("_seq"))
    seq = seq.withColumn("_ids", F.array_distinct(F.transform("_seq", lambda x: x["sentence_id"])))
    entry = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(l).alias("license"), F.array(*map(F.lit, ids)).alias("ids")) for n, l, ids in rules])
    hits = seq.select("doc_id", "_seq", F.explode(F.filter(entry, lambda r: F.size(F.array_except(r["ids"], F.col("_ids"))) == 0)).alias("_r")).select("doc_id", "_seq", "_r.*")
    return (hits.withColumn("_m", _chained(F.col("_seq"), F.col("ids"), max_gap)).filter("_m.n > 0")
            .select("doc_id", "license", "rule", F.col("_m.n").alias("n_matches"), F.size("ids").alias("n_sentences"), F.col("_m.first").alias("first_piece"), F.col("_m.last").alias("last_piece")))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Steps of the longest rule.
_STEPS = max(len(ids) for _, _, ids in RULES)


def _step_sql(k: int) -> str:
    """Rows with the step ``k`` (from 1) of their rule: where its beginning began, and whether the step before lies near enough."""
    up = "OVER (PARTITION BY doc_id, t, rule ORDER BY piece, line, sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
w{k} AS (
  SELECT *, max(CASE WHEN b{k - 1} IS NOT NULL THEN (piece, line) END) {up} AS near, max(b{k - 1}) {up} AS begun FROM s{k - 1}
), s{k} AS (
  SELECT * EXCLUDE (near, begun), CASE WHEN sentence_id = ids[{k + 1}] AND near IS NOT NULL
         AND CASE WHEN near[1] = piece THEN line - near[2] <= {MAX_GAP} ELSE piece - near[1] <= {MAX_GAP} END THEN begun END AS b{k} FROM w{k}
)"""


#: DuckDB SQL of scan() over ``documents``.
ORACLE_SQL = rf"""
WITH known(sentence, sentence_id) AS (VALUES {_values(wordings(SENTENCES))}),
rule_ids(rule, license, step, sentence_id) AS (VALUES {_values((n, l, k, x) for n, l, ids in RULES for k, x in enumerate(ids))}),
rules AS (SELECT rule, license, list(sentence_id ORDER BY step) AS ids FROM rule_ids GROUP BY rule, license),
d AS (
  SELECT doc_id, text, regexp_split_to_array(replace(text, '{SPDX_TAG}:', '{SPDX_TAG}'), '[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n[\x20\x09]*\n') AS a FROM documents
), p AS (
  SELECT doc_id, hash(text) AS t, unnest(a) AS p, generate_subscripts(a, 1) - 1 AS piece FROM d
), q AS (
  SELECT doc_id, t, piece, CASE WHEN contains(p, chr(10)) THEN list_prepend(p, string_split(p, chr(10))) ELSE [p] END AS l FROM p
), r AS (
  SELECT doc_id, t, piece, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS line FROM q
), k AS (
  SELECT DISTINCT doc_id, t, piece, line, sentence_id
  FROM r JOIN known ON trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = sentence
), o AS (
  SELECT * FROM k QUALIFY line = 0 OR min(line) OVER (PARTITION BY doc_id, t, piece, sentence_id) > 0
), s0 AS (
  SELECT o.*, rule, license, ids, CASE WHEN sentence_id = ids[1] THEN (piece, line) END AS b0 FROM o JOIN rules ON list_contains(ids, sentence_id)
), {", ".join(_step_sql(k) for k in range(1, _STEPS))}, m AS (
  SELECT doc_id, t, license, rule, piece, len(ids) AS n, CASE len(ids) {" ".join(f"WHEN {k + 1} THEN b{k}" for k in range(_STEPS))} END AS begun FROM s{_STEPS - 1}
)
SELECT doc_id, license, rule, count(DISTINCT begun)::BIGINT AS n_matches, n::INT AS n_sentences, min(begun)[1]::INT AS first_piece, max(piece)::INT AS last_piece
FROM m WHERE begun IS NOT NULL GROUP BY doc_id, t, license, rule, n
"""
