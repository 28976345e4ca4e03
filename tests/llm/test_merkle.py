"""Merkle manifest: brute force over small tables with small and production blocks."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loadgrid.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    for level in levels[:-1]:
        run = i // 3 * 3
        yield "".join(level[run:i]), "".join(level[i + 1:run + 3])
        i //= 3


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, ordered = {}, {}
    for s in names:
        ordered[s] = sorted(((r, _leaf(*r)) for r in by[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = _levels([h for _, h in ordered[s]])
    top = _levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(ordered[s]):
            path = [*_path(trees[s], i), *_path(top, k)]
            doc_id, text, *rest = r
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
            h = _leaf(doc_id, text.replace("\n", ""), *rest) if tampered else leaf
            for a, b in path:
                h = _h(a + h + b)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], _h("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def _check(df, **options):
    got = [tuple(r) for r in merkle.report(df, **options).collect()]
    assert _sorted(got) == _sorted(brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]))
    return got


def _many(n, source, start=0):
    return [(start + i * 7 % n, f"text {i}\n" * (i % 4), "en", source, i) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_small_blocks_equal_brute_force(spark, levels):
    rows = [r for k, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 82)) for r in _many(n, f"s{k}", 1000 * k)]
    got = _check(spark.createDataFrame(rows, DOCS), levels=levels)
    assert {True, False} == {r[-1] for r in got}


def test_production_blocks(spark):
    _check(spark.createDataFrame(_many(1500, "hot") + _many(729, "b", 5000) + _many(730, None, 9000) + _many(1, "", 20000), DOCS))


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "wörd\n" * 60_000, "en", "s", 1), (4, "other", None, "s", 1),
            (None, "No\nid", "en", None, 1), (None, None, None, None, None), (None, None, None, None, None), (-5, "\n", "de", "Ω", -1), (6, "x", "-", "", 2), (2, "b", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("g", "b", "up", "hash", "kids", "path", "tops", "leaf", "_u", "_part", "n"):
        df = df.withColumn(c, F.lit("x"))
    _check(df)
    _check(df, levels=1)


def test_one_document_and_none(spark):
    one = merkle.report(spark.createDataFrame([(1, "a\nb", "en", "s", 3)], DOCS)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == _h("")
    assert merkle.report(spark.createDataFrame([], DOCS)).collect() == []


def test_paths_prove_the_leaf(spark):
    m = merkle.manifest(spark.createDataFrame(_many(40, "a") + _many(5, "b", 100), DOCS))
    assert m.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert m.filter(merkle.fold(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")).count() == 0
