"""Revisits, license scan, decontamination, mixing and weighted sampling: brute force and edge cases."""

import collections
import datetime as dt
import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadgrid.llm import cws, decontam, licenses, mixing, queries, revisits
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, con, name):
    ok, msg, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, "\n".join(map(str, msg))


def edge_docs(spark):
    """Nulls in any column, empty and blank text, a very long text, repeated rows, clashing extra columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word " * 60_000, "en", "s", 1),
            (5, "Plain text here.", None, "s", 1), (5, "Plain text here.", None, "s", 1), (None, "No id at all.", "en", None, 1), (None, None, None, None, None)]
    return (spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("side", F.lit(2)).withColumn("rank", F.lit(3))
            .withColumn("h", F.lit(0)).withColumn("piece", F.lit(0)).withColumn("license", F.lit("y")).withColumn("item_id", F.lit(1)).withColumn("edited", F.lit("z")))


def test_edges(spark):
    d, empty = edge_docs(spark), spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "one two")], "item_id long, text string")
    assert mixing.mix_report(d).count() == 8 and mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert {(r.doc_id, r.size) for r in mixing.mix_report(d).collect()} == {(1, 0), (2, 0), (3, 0), (4, 60_000), (5, 3), (None, 4), (None, 0)}
    assert mixing.mixed(d).columns == d.columns
    assert licenses.scan(d).count() == 0 and licenses.scan(empty).count() == 0
    assert decontam.contaminated(d, bench).count() == 0 and decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(d, bench.limit(0)).count() == 0
    assert decontam.decontaminated(d, bench).count() == 8
    r = cws.report(d).collect()
    assert len(r) == 8 and cws.report(empty).count() == 0
    by = collections.defaultdict(list)
    for x in r:
        by[x.doc_id].append(x)
    assert len(by[5]) == 2 and by[5][0] == by[5][1] and len(by[None]) == 2
    assert by[2][0].fingerprint == "" == by[3][0].fingerprint and by[4][0].n_chars == 300_000


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "en", s, 0) for s, n, o in (("a", 4000, 0), ("b", 1500, 10_000), ("c", 20, 20_000), (None, 800, 30_000)) for i in range(o, o + n)]
    r = mixing.mix_report(spark.createDataFrame(rows, DOCS)).collect()
    total, by = sum(x.size for x in r), collections.defaultdict(list)
    for x in r:
        by[x.source_size].append(x)
        assert x.taken <= 3 * x.size
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for size, v in by.items():
        assert v[0].target <= 3 * size + 1e-9 and abs(sum(x.taken for x in v) - v[0].target) < 0.05 * v[0].target + 60
    assert sorted(r) == sorted(mixing.mix_report(spark.createDataFrame(rows, DOCS)).collect())
    out = mixing.mixed(spark.createDataFrame(rows, DOCS))
    assert out.count() == sum(x.taken // x.size for x in r)


def test_license_sequences(spark):
    mit = "Copyright (c) someone\n\n" + ". ".join(licenses.SENTENCES[k].capitalize() for k in ("mit.grant", "mit.notice", "mit.warranty")) + "."
    swapped = ". ".join(licenses.SENTENCES[k] for k in ("mit.warranty", "mit.grant", "mit.notice")) + "."
    docs = spark.createDataFrame([(1, mit), (2, swapped), (3, "some line\nReleased under the MIT License.\nmore"), (4, "Licensed under the\nApache License,\nVersion 2.0."),
                                  (5, "Released under the MIT License. Again: released under the mit license!")], "doc_id long, text string")
    got = {(r.doc_id, r.rule): r.n_matches for r in licenses.scan(docs).collect()}
    assert got == {(1, "mit-text"): 1, (3, "mit-ref"): 1, (4, "apache-ref"): 1, (5, "mit-ref"): 2}


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MIT = """The MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
#: Published notices, and all rules that hold on each.
NOTICES = [
    (MIT, {"mit-title", "mit-text"}), ("Released under the MIT License.", {"mit-ref"}), ("Licensed under the MIT License.", {"mit-ref-licensed"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-ref"}),
    ("""   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
""", {"apache-header"}),
    ("This work is licensed under the GNU General Public License version 3.", {"gpl3-ref"}),
    (GPL.format(":", ",", 3), {"gpl3-notice"}), (GPL.format(";", ";", 2), {"gpl2-notice"}), (GPL.format(":", ",", 2), {"gpl2-notice-colon"}), (GPL.format(";", ";", 3), {"gpl3-notice-semicolons"}),
    (GPL.format(",", ",", 3).replace("WARRANTY;", "WARRANTY,"), {"gpl3-notice-plain-whole"}), (GPL.format(",", ",", 2), {"gpl2-notice-plain"}), (GPL.format(",", ";", 2), {"gpl2-notice-semicolon"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-ref"}), ("Licensed under CC BY 4.0.", {"cc-by-ref"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-ref"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-long"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-long"}),
    ("This work is dedicated to the public domain under CC0 1.0.", {"cc0-ref"}),
    (BSD, {"bsd-2"}), (BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""", {"bsd-2", "bsd-3"}),
    ("""Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""", {"isc-text"}),
    ("""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""", {"mpl-ref"}), ("This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0.", {"mpl-ref-plain"}),
    ("This is free and unencumbered software released into the public domain.\n", {"unlicense-text"}),
    (GPL.format(";", ";", 2.1).replace("program", "library").replace("General", "Lesser General"), {"lgpl21-notice"}),
    (GPL.format(":", ",", 3).replace("program", "library").replace("General", "Lesser General"), {"lgpl3-notice"}),
    (GPL.format(":", ",", 3).replace("General", "Lesser General"), {"lgpl3-program-notice"}),
    (GPL.format(":", ",", 3).replace("General", "Affero General"), {"agpl3-notice"}),
    ("""This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""", {"zlib-text"}),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", {"boost-ref"}),
    ("""This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
""", {"epl-ref"}),
    ("The Artistic License 2.0\n", {"artistic-title"}),
    *[(f"Distributed under the {n}.", {f"name-{i}"}) for i, names in licenses.NAMES.items() for n in names], ("MIT licensed", {"name-MIT"}),
    *[(f"SPDX-License-Identifier: {i}\nimport x", {f"spdx-{i}"}) for i in licenses.SPDX],
]


def test_license_rules_skip_other_known_sentences(spark):
    grant, notice, warranty = (licenses.SENTENCES[k].capitalize() for k in ("mit.grant", "mit.notice", "mit.warranty"))
    far = "Some words here. " * licenses.MAX_GAP
    texts = [f"{grant}.\n2.0\n{notice}. {warranty}.", f"{grant}. Released under the MIT License. {notice}. {warranty}.", f"{grant}. {far}{notice}. {warranty}.",
             f"{grant}. {far.replace('Some words here. ', '', 1)}{notice}. {warranty}.", f"{grant}. {far}{grant}. {notice}. {notice}. {warranty}. {grant}. {notice}. {warranty}. {warranty}.",
             "Intro.\n\n\nReleased under the MIT License.", f"{grant}. {notice}. {far}{notice}. {far}{warranty}."]
    got = collections.defaultdict(dict)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id][r.rule] = (r.n_matches, r.first_piece, r.last_piece)
    gap = licenses.MAX_GAP
    assert got == {0: {"mit-text": (1, 0, 2)}, 1: {"mit-text": (1, 0, 3), "mit-ref": (1, 1, 1)}, 3: {"mit-text": (1, 0, gap + 1)},
                   4: {"mit-text": (2, gap + 1, gap + 8)}, 5: {"mit-ref": (1, 1, 1)}}


def test_license_rules_hold_on_their_published_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)] + [(-1 - i, "".join(f" * {x}\n" for x in t.splitlines())) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].add(r.rule)
    for i, (_, rules) in enumerate(NOTICES):
        assert got[i] == rules
        if i:       # also as a comment block; there an empty line is " * " and ends no piece, so the title's piece goes on into the MIT grant
            assert got[-1 - i] == rules
    published = {n for n, _, _ in licenses.RULES if not n.startswith(("gpl2-notice-", "gpl3-notice-"))}
    assert published <= set().union(*got.values())
    # A rule of several ways to be cut asks for the right version in every one.
    assert all((x[0] == "gpl2-notice" or x[0].startswith("gpl2-")) == any(i.startswith("gpl2.") for i in x[2]) for x in licenses.RULES)


def test_license_scan_equals_its_sql_on_mixed_sentences(spark):
    rng = random.Random(5)
    words = [x for ids in (r[2] for r in licenses.RULES if len(r[2]) > 1) for i in ids for x, k in licenses.wordings(licenses.SENTENCES) if k == i]
    fill = ["Some words. " * n for n in (1, 3, licenses.MAX_GAP - 1, licenses.MAX_GAP)]
    rows = []
    for i in range(150):
        some = rng.sample(words, 6)
        rows.append((i // 2, "".join(rng.choice([w.capitalize() + rng.choice([". ", ";\n", "\n", ".\n\n"]), rng.choice(fill), "\n" * rng.randint(1, 25)]) for w in rng.choices(some, k=60))))
        start = rng.choice([r[2] for r in licenses.RULES if len(r[2]) > 2])
        rows.append((1000 + i, "".join(dict(map(reversed, licenses.wordings(licenses.SENTENCES)))[x] + rng.choice([". ", "\n", ". " + rng.choice(fill)]) for x in start for _ in range(rng.randint(1, 2)))))
    rows += rows[:3] + [(None, None), (7, ""), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    got = collections.Counter(map(tuple, licenses.scan(docs).collect()))
    assert got == collections.Counter(c.execute(licenses.ORACLE_SQL).fetchall()) and len(got) > 100


def test_revisits_against_brute_force(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        kind = "revisit" if i * 7 % 10 < 6 else "response"
        tag = [None, '"a"', 'W/"a"', '"b"'][i * 13 % 4]
        rows.append((i, kind, f"http{'s' * (i % 2)}://www.H{i % 5}.com/p/{i % 2}?utm_source=x#f" if i % 29 else None, t0 + dt.timedelta(minutes=i // 2 * 97) if i % 31 else None,
                     tag, [None, "m1"][i % 2], {"date": str(i), "content-type": kind, "connection": "x"} if i % 37 else None))
    rows += rows[:20]
    schema = "record_id long, record_type string, url string, ts timestamp, etag string, last_modified string, headers map<string,string>"
    got = collections.Counter((r.record_id, r.status, r.response_id, str(sorted((r.headers or {}).items()))) for r in revisits.resolve(
        spark.createDataFrame(rows, schema).withColumn("status", F.lit(1)).withColumn("hit", F.lit(2)), stretch_s=7200).collect())
    weak = lambda x: x.removeprefix("W/") if x else x
    want = collections.Counter()
    for i, kind, url, ts, tag, mod, head in rows:
        key = lambda u: u and (u.split("//")[1].split("?")[0].lower().removeprefix("www."))
        best = max(((r[3], r[0], r[4], r[5], r[6] or {}) for r in rows if r[1] == "response" and key(r[2]) == key(url) and r[3] and ts and key(url) and r[3] < ts), default=None,
                   key=lambda r: r[:2])
        status, hit, out = "full", None, head or {}
        if kind == "revisit":
            out = {}
            status = "no_response" if best is None else "no_validator" if tag is None and mod is None else "resolved" if (
                weak(tag) == weak(best[2]) if tag is not None else mod == best[3]) else "validator_mismatch"
            if status == "resolved":
                hit, out = best[1], {**best[4], **{k: v for k, v in (head or {}).items() if k == "date"}}
        want[(i, status, hit, str(sorted(out.items())))] += 1
    assert got == want
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def test_canonical_url(spark):
    cases = {"HTTPS://User@WWW.Example.com:443/A/b/?utm_source=f&x=1&fbclid=q#top": "example.com/A/b/?x=1", "http://example.com": "example.com", "http://example.com/?gclid=x&utm_a=b": "example.com",
             "http://h/x?ref=dev": "h/x?ref=dev", "http://h/x?ref=main": "h/x?ref=main", "http://h/?b=2&a=1": "h/?a=1&b=2", "http://h/?a=1&b=2": "h/?a=1&b=2", "http://h/?a=2&&b=0&a=1&": "h/?a=2&a=1&b=0",
             "http://h/%7Eme/%41%2f%zz%": "h/~me/A%2F%zz%", "http://h/~me/A%2F%zz%25": "h/~me/A%2F%zz%25", "http://h/a/?": "h/a", "": "", None: None}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


def test_headers_and_types_in_any_case(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda i: t0 + dt.timedelta(hours=i)
    rows = [(1, " Response", "http://h/x", at(0), '"a"', None, {"Content-Length": "10", "Server": "s", "DATE": "1", "Via": "v"}),
            (2, "REVISIT", "http://h/x", at(1), '"a"', None, {"content-length": "0", "Date": "2", "Connection": "close", "ETag": "x", "etag": "y"}),
            (3, None, "http://h/x", at(2), '"a"', None, {"a": "b"}), (4, "request", "http://h/x", at(3), '"a"', None, None), (5, "revisit", None, at(4), '"a"', None, None),
            (6, "revisit", "http://h/x", None, '"a"', None, None), (7, "response", None, at(0), '"a"', None, None), (None, "revisit", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, record_type string, url string, ts timestamp, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "full", 2: "resolved", 3: "other", 4: "other", 5: "no_response", 6: "no_response", 7: "full", None: "no_response"}
    assert got[2].headers == {"content-length": "10", "server": "s", "date": "2", "via": "v", "etag": "y"} and got[1].headers["Content-Length"] == "10"


ITEM = "A train leaves with 12 wagons and 30 seats at noon while Maria waits for 5 km near the old station gate and later counts 12 wagons again in the yard"


def test_contradicting_slots_are_no_leak_of_their_own(spark):
    """An item with a slot in every window: one value for each of its values is a leak, two values for one are not, unless 13 tokens in a row are equal."""
    item = "if Anna buys 12 apples and Carl buys 15 pears then Anna sells 12 apples and Carl eats 15 pears while Anna keeps 12 coins in boxes"
    docs = spark.createDataFrame([(1, "well " + item.replace("Anna", "Eva").replace("Carl", "Hugo").replace("12", "31").replace("15", "44")),
                                  (2, "well if Eva buys 31 apples and Hugo buys 44 pears then Lena sells 32 apples and Otto eats 45 pears while Maria keeps 33 coins in boxes"),
                                  (3, "well " + item.replace("keeps 12", "keeps 14").replace("buys 12", "buys 13"))], "doc_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1, 3}
    long = " ".join(f"word{i} stays" for i in range(40)).replace("word3 ", "12 ").replace("word30 ", "12 ")
    docs = spark.createDataFrame([(1, long.replace("12", "13", 1).replace("12 stays word31", "14 stays word31"))], "doc_id long, text string")
    assert decontam.contaminated(docs, spark.createDataFrame([(7, long)], "item_id long, text string")).count() == 1


def test_decontamination_finds_reparameterised_items(spark):
    other = ITEM.replace("12", "77").replace("30", "41").replace("Maria", "Pedro").replace("5 km", "9 miles")
    broken = ITEM.replace("12 wagons and", "77 wagons and").replace("counts 12", "counts 13")    # 12 maps to two values, but long stretches are equal
    docs = spark.createDataFrame([(1, "Intro words here. " + ITEM + ". The end of it"), (2, "Some other start. " + other), (3, broken), (4, "Quite another text about wagons and seats " * 3),
                                  (5, ITEM.upper()), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, "short item with only six words")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.exact) for r in decontam.contaminated(docs, bench).collect()}
    assert got[1] == (7, True) and got[2] == (7, False) and got[None] == (7, True) and 4 not in got and got[3] == (7, False)
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns and not {1, 2, None} & {r.doc_id for r in left.collect()}
    short = spark.createDataFrame([(1, "Look: short item with only six words, indeed")], "doc_id long, text string")
    assert [r.item_id for r in decontam.contaminated(short, bench).collect()] == [8]


def _leaks(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_decontamination_names_do_not_depend_on_the_neighbour(spark):
    short, tom = "What is the capital of France?", "Tom has 5 apples. Tom gives Mary 3 apples. How many apples does Tom have left?"
    assert _leaks(spark, short, [f"Some heading {short} Paris", f"Some heading. {short}", "So, what is the capital of France?", "What is the capital of Spain?", "What is a capital of France?"]) == {0, 1, 2, 3}
    assert _leaks(spark, tom, ["Pedro has 7 apples. Pedro gives Anna 2 apples. How many apples does Pedro have left?", f"A heading {tom}", tom.lower(), "Pedro has 7 pears and eats them all."]) == {0, 1, 2}


def test_decontamination_keeps_consistent_windows(spark):
    item = "A basket holds 3 red apples next to the wall and another basket holds 5 green pears close to the open kitchen door"
    assert _leaks(spark, item, [item.replace("3", "4").replace("5", "4"), item.replace("3", "5"), item.replace("3", "6").replace("5", "7")]) == {0, 1, 2}
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(10)]
    twice = " ".join(words[:4] + ["12"] + words[4:45] + ["12"] + words[45:])
    assert _leaks(spark, twice, [twice.replace("12", "13", 1), twice.replace("12", "13")]) == {0, 1}


def test_decontamination_finds_verbatim_items_with_few_literals(spark):
    for item in ("What is 12 + 34 ?", "Anna Bert Carla Dora Emil Frida Gustav Hans Ida Jan", "1 2 3 4 5 6 7 8 9 10 11", "Two words"):
        assert _leaks(spark, item, [f"First a line here {item} and more", item, "What is 13 + 35 ? Max Eva 1 2 4 6 7 9 or two other words"]) == {0, 1}


def test_decontamination_against_brute_force(spark):
    """Whole exact passages of the benchmark in the given documents, found by plain windows of words."""
    docs = [(r.doc_id, r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = collections.defaultdict(set)
    for i, w in bench:
        for k in range(len(w) - 7):
            windows[tuple(w[k:k + 8])].add(i)
    hits = collections.Counter()
    for d, w in docs:
        for k in range(len(w) - 7):
            for i in windows.get(tuple(w[k:k + 8]), ()):
                hits[d, i] += 1
    want = {k for k, n in hits.items() if n >= decontam.MIN_WINDOWS + 2}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    assert want and want <= got and {d for d, _ in got} <= {d for d, _ in hits}


def _odd_texts(seed):
    """Items of odd tokens, and documents that hold them with other tokens here and there."""
    r = random.Random(seed)
    odd = ("<s>foo <S>Foo foo<s> s>foo <s> s foo Foo foo, <num> x<num> <name> <unit> 5 (5), 7km 9 km Km. km, Tom Tom. Tom: \"Anna\" 'Mary' Mary- tom anna -- - ** <> (<div>. <div> a> a>. >a "
           "\u0130 i\u0307 \u0130> i\u0307> \u039f\u0394\u039f\u03a3 \u03bf\u03b4\u03bf\u03c2, \u03a3' \u00a0 \u4e2d\u6587 \U0001f600 \u24b6 \u24d0 \u2160 e\u0301 word Word word. other. other rows? rows").split(" ")
    items = [" ".join(r.choice(odd) for _ in range(r.choice((1, 2, 4, 9, 14)))) for _ in range(30)] + ["-- -- --", "s", "Tom. Anna. Tom. Mary. Foo. Word. Other. Rows. Tom.", "5 7 9 5 7 9 5 7 9 5", " ", "<s>"]
    docs = []
    for i in range(120):
        words = [r.choice(odd) for _ in range(r.randrange(12))] + [r.choice(odd) if r.random() < 0.12 else w for w in items[i % len(items)].split(" ")] + [r.choice(odd) for _ in range(r.randrange(6))]
        docs.append((i, "".join(w + r.choice((" ", " ", " ", "\n", "  ")) for w in words)))
    return docs, list(enumerate(items))


@pytest.mark.parametrize("window, least", [(8, 4), (4, 2), (3, 0)])
def test_decontamination_anchors_lose_no_window(spark, window, least):
    """Stretches cut out at anchors against every position of every whole text."""
    docs, items = _odd_texts(window)
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), decontam.benchmark_windows(spark.createDataFrame(items, "item_id long, text string"), window, least)
    whole = decontam._texts(docs, "doc_id").crossJoin(bench.select("width").distinct())
    whole = whole.select("*", F.posexplode(F.split("_raw", " ")).alias("_pos", "_token")).drop("_token").withColumn("word", F.col("_pos"))
    whole = whole.filter(F.col("word") + F.col("width") <= F.size(F.split("_raw", " ")))

    def windows(stretches):
        rows = decontam.agreeing(stretches, bench).collect()
        # Named windows need enough words in common, as `contaminated` asks for.
        return {(x.doc_id, x.word, x.item_id, x.pos, x.form, tuple(x.pairs)) for x in rows if x.form != 1 or x.literals + len({b for b, d in x.pairs if b == d} & set(x["first"])) >= least}

    want = windows(whole)
    assert {x[4] for x in want} == {0, 1, 2} and windows(decontam.anchored(docs, bench)) == want


def test_decontamination_cuts_out_few_stretches(spark):
    """Windows are formed and compared where two words of a benchmark window are at their places, not at each position of each text."""
    texts = ["some plain words of a long text without the rest " * 2_000, "wagons of " * 2_000, f"Some words. {ITEM} " + "and more " * 2_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = decontam.benchmark_windows(spark.createDataFrame([(7, ITEM)], "item_id long, text string"))
    rows = decontam.anchored(docs, bench).collect()
    assert {x.doc_id for x in rows} == {2} and len(rows) <= 3 * len(ITEM.split()) and all(len(x["_raw"].split()) <= 9 for x in rows)
    assert [x.doc_id for x in decontam.contaminated(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()] == [2]


def test_weighted_sampling(spark):
    texts = {i: " ".join(f"w{(i * 7 + k * k) % 60}" for k in range(80 + i)) for i in range(60)}
    texts[60], texts[61] = texts[3], "a"
    r = {x.doc_id: x for x in cws.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order, errors = sorted(texts, reverse=True), []
    for n, i in enumerate(order):
        t, nxt = texts[i], texts[order[(n + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert r[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r[i].n_chars == len(t)

        def jaccard(a, b):
            a, b = collections.Counter(a.split()), collections.Counter(b.split())
            return sum((a & b).values()) / sum((a | b).values())

        errors += [r[i].near_edited - jaccard(t, edited), r[i].near_next - jaccard(t, nxt)]
    assert r[60].fingerprint == r[3].fingerprint and r[60].fingerprint != r[4].fingerprint
    assert abs(sum(errors) / len(errors)) < 0.03 and sum(map(abs, errors)) / len(errors) < 0.09
    one = cws.report(spark.createDataFrame([(1, "x y z")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
