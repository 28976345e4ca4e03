"""Personal data: base rules against the plain patterns, gradients, held-out spans, windows, edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loadgrid.llm import pii, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# The patterns of the base rules.
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if good(k, m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "+1 ", "(", ")", "1", "25", "255", "256", "4111 1111 1111 1111", "4111111111111111", "0", "..", "é", "@@", "1.2.3.4", "%", "\n", "555-"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("") == []


def test_base_spans_are_linear():
    n = 300_000
    for text in ("a" * n, "1" * n, "1." * n, "a@" * n, "+1" * n, "@a" * n, "1 " * n, "a." * n + "@"):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    windows = [("mail bob@x.org now", [(5, 0, 14)]), ("call +1 (455) 555-8597", [(5, 3, 22)]), ("ip 1.2.3.4 ok", [(3, 1, 10)])]
    ids, gold = np.stack([pii.symbols(w, 24) for w, _ in windows]), np.stack([pii.tags(w, s, 24) for w, s in windows])
    p = {k: v.astype(np.float64) for k, v in pii._init(rng, 4).items()}
    p["move"] = rng.normal(0, 0.3, p["move"].shape)
    _, g = pii.loss_and_gradients(p, ids, gold)
    for k in p:
        flat = np.abs(g[k]).ravel()
        for at in flat.argsort()[-4:]:
            i, old, side = np.unravel_index(at, p[k].shape), p[k].flat[at], []
            for step in (1e-2, -1e-2):
                p[k][i] = old + step
                side.append(pii.loss_and_gradients(p, ids, gold)[0])
            p[k][i] = old
            assert abs((side[0] - side[1]) / 2e-2 - g[k][i]) < 2e-3 + 0.02 * abs(g[k][i]), (k, i)


@pytest.fixture(scope="module")
def model():
    """The tagger trained on two thirds of the labelled windows of a table, and the other third."""
    texts = [t.as_py() or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0)]
    windows = [(w, [tuple(map(int, s.split(":")))] if s else []) for t in texts for w, s in pii.labelled(t)]
    spans, none = [x for x in windows if x[1]], [x for x in windows if not x[1]][:3000]
    rng = np.random.default_rng(1)
    learn = spans[::3] + spans[1::3]
    p = pii.train(learn + none[:2000] + [m for w, s in learn for _ in range(3) if (m := pii.rewritten(w, s[0], rng))])
    return p, spans[2::3], none[2000:]


def _found(p, windows):
    out = pii.decode(p, np.stack([pii.symbols(w, pii.TRAIN_WINDOW) for w, _ in windows]))
    return [pii.reconciled(w, [(0, d)], []) for (w, _), d in zip(windows, out)]


def test_held_out_windows(model):
    p, spans, none = model
    got = _found(p, spans)
    assert sum(s[0] in g for (_, s), g in zip(spans, got)) >= 0.95 * len(spans)
    rng = np.random.default_rng(2)
    other = [m for w, s in spans for _ in range(4) if (m := pii.rewritten(w, s[0], rng))]
    got = _found(p, other)
    assert sum(g == s for (_, s), g in zip(other, got) if s) >= 0.95 * sum(bool(s) for _, s in other)
    assert sum(bool(g) for (_, s), g in zip(other, got) if not s) <= 0.05 * sum(not s for _, s in other)
    assert not any(_found(p, none))


LONG = "Write to " + "very.long.name." * 6 + "bob (at) mail." + "sub-domain." * 5 + "example (dot) org today, or call (455) 555-8597."


def test_long_spans_at_any_place(model):
    start = LONG.index("very")
    for shift in range(0, 230, 17):
        text = "x " * shift + LONG + " y" * 40
        (_, added), = pii.tag_texts([text], model[0])
        assert (start + 2 * shift, 0, text.index(" today")) in added and any(k == 3 for _, k, _ in added)


def test_windows_without_a_trigger_give_nothing(model):
    rng = random.Random(3)
    bits = ["word ", "naïve ", "(at) ", "bob", "@", "dot", " . ", "(dot)", "(455) 555-8597 ", "1925-08-18 ", "+", "4111.1111.1111.1111 ", ".", "\n", "at ", "quiet words here " * 4, "10[.]0[.]0[.]1 "]
    for _ in range(40):
        text = "".join(rng.choice(bits) for _ in range(60))
        every = range(0, max(1, len(text)), pii.STEP)
        spans = pii.decode(model[0], np.stack([pii.symbols(text[i:i + pii.WINDOW], pii.WINDOW) for i in every]))
        base = pii.base_spans(text)
        assert pii.tag_texts([text], model[0])[0][1] == pii.reconciled(text, list(zip(every, spans)), base)


def test_reconciliation_takes_the_best_set():
    rng = random.Random(8)
    text = "1234567890 " * 8
    for _ in range(200):
        spans = []
        for i in range(8):
            spans += [(i * 11, 3, i * 11 + 10, rng.randrange(20, 60) / 10)] if rng.random() < 0.8 else []
            if i < 7 and rng.random() < 0.5:
                spans.append((i * 11, 3, i * 11 + 10, rng.randrange(20, 60) / 10))
        got = pii.reconciled(text, [(0, spans)], [(0, 2, 5)])
        best = {}
        for s, k, e, sc in spans:
            best[(s, k, e)] = max(sc, best.get((s, k, e), sc))
        assert got == sorted(x for x in best if x[0] >= 5)
    # Two short spans against one across both.
    text = "1234567890 1234567890"
    cross = {(0, 3, 10): 3.0, (11, 3, 21): 3.0, (5, 3, 16): 5.0}
    assert not pii.valid(text, 5, 3, 16)
    old = pii.valid
    try:
        pii.valid = lambda *a: True
        for scores in itertools.product((3.0, 9.0), repeat=3):
            spans = [(*x, sc) for x, sc in zip(cross, scores)]
            got = pii.reconciled(text, [(0, spans)], [])
            assert sum(dict(zip(cross, scores))[x] for x in got) == max(scores[2], scores[0] + scores[1])
    finally:
        pii.valid = old


def test_edges(spark):
    good = "Bob bob@mail.example.com, 10.0.0.255, 4111 1111 1111 1111, +1 (455) 555-8597."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word " * 60_000 + good, "en", "s", 1), (5, good, None, "s", 1), (5, good, None, "s", 1),
            (None, "\U0001f600é " + good, "en", None, 1), (None, None, None, None, None), (6, "300.1.1.1 and 4111 1111 1111 1112 +1 23", "en", "s", 1), (7, "9" * 100_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("spans", "window", "span", "n_email", "kind", "base_sha256"):
        df = df.withColumn(c, F.lit("x"))
    got = pii.report(df).collect()
    want = sorted((str(r[0]), pii.joined(plain_spans(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), ",".join(x for x in r.spans.split(",") if x)) for r in got if not r.n_added) == [w for w in want if w[0] in {str(r.doc_id) for r in got if not r.n_added}]
    for r in got:
        texts = [x[1] or "" for x in rows if x[0] == r.doc_id]
        assert r.base_sha256 in {hashlib.sha256(pii.joined(plain_spans(t)).encode()).hexdigest() for t in texts}
    assert sum(r.n_email for r in got) == 4 and sum(r.n_phone for r in got) == 4
    assert pii.report(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.spans for r in pii.report(spark.createDataFrame([(1, "no such thing 12", None, None, None)], DOCS)).collect()] == [""]


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_personal_data(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = plain_spans(r.text or "")
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest() and [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(pii.joined(spans).split(",")) <= set(g.spans.split(",")) | {""}
