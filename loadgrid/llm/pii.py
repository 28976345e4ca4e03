"""Personal data: base rules and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The base rules (email, ip, card, phone) label the spans of a bounded sample of documents; windows around them, rewritten
forms of them (``name (at) host (dot) org``, a phone without ``+``, a card in dotted groups, a defanged address) and windows of other numbers train
the tagger. Whole texts are then tagged in overlapping windows. Each window is decoded by Viterbi; a span that a window cuts lies whole
in another one, and of all whole spans of a document those of the greatest total score are kept that overlap neither each other nor a base span.
An added span has at most ``WINDOW - STEP`` characters (256; a valid email address has at most 254), so that some window has it whole wherever it lies.

The CRF's states allow only some characters, and a span counts only in a valid form of its kind (``valid``): a card passes
Luhn, a phone has 9 to 15 digits, an ip four parts, an email an at-sign or its bracketed word. A window without a digit, ``@`` or such a
word therefore can't give a span, and only the others are run through the network: leaving it out changes nothing, at any size of text.

Defined results: null text counts as empty; an empty text has no span. Spans are in code points, end exclusive; the base rules' n_* columns count base spans,
``n_added`` the others. With no labelled span in the sample the base spans are all. Rows are independent of each other, so repeated rows and null ids get
equal results each; texts of any length are read whole, a few MB at a time. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgrid.llm.common import ship_code

KINDS = ("email", "ip", "card", "phone")
#: The tagger learns from about this many documents (by hash of id and text) and at most so many windows of them.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOWS_A_DOC = 8_000, 4_000, 6
#: Characters of a training window; of a window of a text and its step. Hidden units of each direction.
TRAIN_WINDOW, WINDOW, STEP, HIDDEN = 64, 384, 128, 16
ROUNDS, BATCH, RATE = 220, 64, 0.02
#: A span is added if its path scores so much more than no span.
LEAST_SCORE = 2.0
#: Windows tagged at a time; characters of texts held at a time.
WINDOWS_AT_ONCE, CHARS_AT_ONCE = 512, 4_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT = re.compile(r"\x20?(?:@|[(\[{<]\x20?(?:at|AT|At)\x20?[)\]}>])\x20?")
_DOT = re.compile(r"\x20?[(\[{<]\x20?(?:dot|DOT|Dot|\.)\x20?[)\]}>]\x20?|\x20\.\x20(?=[A-Za-z0-9])")
_TRIGGER = re.compile(r"[0-9@]+|[(\[{<]\x20?(?:at|AT|At)\x20?[)\]}>]")


# ---------------------------------------------------------------- base rules, each in one pass

def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: the leftmost matches of each kind that don't overlap, without those that fail its condition."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                end = start + sum(map(len, four)) + 3
                if all(map(_byte, four)):
                    out.append((start, 1, end))
                start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def valid(text: str, start: int, kind: int, end: int) -> bool:
    """Whether an added span has a form of its kind and doesn't cut a word or number."""
    s = text[start:end]
    before, after = text[start - 1:start], text[end:end + 1]
    if before.isalnum() or after.isalnum() or (before in tuple(".-/+") and text[start - 2:start - 1].isalnum()) or (after in tuple("-/@:") and text[end + 1:end + 2].isalnum()):
        return False
    if kind == 0:
        local, *domain = _AT.split(s)
        return len(domain) == 1 and len(local) > 0 and _LOCAL.issuperset(local) and _DOMAIN.fullmatch(_DOT.sub(".", domain[0])) is not None
    if kind == 1:
        parts = _DOT.sub(".", s).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and _byte(p) for p in parts)
    digits = _NOT_DIGIT.sub("", s)
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits) and re.fullmatch(r"[0-9](?:[\x20./_-]{0,2}[0-9])+", s) is not None
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])+", s) is not None


# ---------------------------------------------------------------- characters and tags

#: Symbols: ASCII, other characters, at and dot words, nothing.
OTHER, AT, DOT, PAD, SYMBOLS = 128, 129, 130, 131, 132
#: Tags: none; email begin, local, at, domain; begin and inside of ip, card, phone.
TAGS = 11
_FIRST = (1, 5, 7, 9)
_KIND_OF = np.array([-1, 0, 0, 0, 0, 1, 1, 2, 2, 3, 3])
_NO = -30.0


def _allowed() -> np.ndarray:
    ok = np.zeros((SYMBOLS, TAGS), bool)
    ok[:, 0] = True
    for tag, chars in ((1, "azAZ09"), (2, "azAZ09"), (4, "azAZ09"), (5, "09"), (6, "09"), (7, "09"), (8, "09"), (9, "09"), (10, "09")):
        for a, b in zip(chars[::2], chars[1::2]):
            ok[ord(a):ord(b) + 1, tag] = True
    for tag, chars in ((2, "._%+-"), (4, ".-"), (6, "."), (8, " -./_"), (9, "+("), (10, " ()./-")):
        ok[[ord(c) for c in chars], tag] = True
    ok[AT, 3] = ok[DOT, 4] = ok[DOT, 6] = True
    return ok


def _possible() -> np.ndarray:
    ok = np.zeros((TAGS, TAGS), bool)
    ends = [0, 4, 6, 8, 10]
    for a in ends:
        ok[a, [0, *_FIRST]] = True
    for a, b in ((1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4), (5, 6), (6, 6), (7, 8), (8, 8), (9, 10), (10, 10)):
        ok[a, b] = True
    return ok


ALLOWED, POSSIBLE = _allowed(), _possible()


def symbols(window: str, width: int) -> np.ndarray:
    out = np.full(width, PAD, np.int64)
    code = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    out[:len(code)] = np.where(code < 128, code, OTHER)
    for pattern, symbol in ((_DOT, DOT), (_AT, AT)):
        for m in pattern.finditer(window):
            out[m.start():m.end()] = symbol
    return out


def tags(window: str, spans: list[tuple[int, int, int]], width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for start, kind, end in spans:
        out[start:end] = _FIRST[kind] + 1
        out[start] = _FIRST[kind]
        if kind == 0 and (m := _AT.search(window, start, end)):
            out[m.start():m.end()], out[m.end():end] = 3, 4
    return out


# ---------------------------------------------------------------- network

def _init(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    p = {"out": rng.normal(0, 0.1, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
        p["x" + d][:, hidden:2 * hidden] += 1.0
        p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(wx: np.ndarray, seq: np.ndarray, wh: np.ndarray, keep: bool):
    """Hidden states (T, B, H) over symbols (T, B) with a row of input weights each: input, forget, output gate and candidate."""
    t, b, h = *seq.shape, wh.shape[0]
    hs, c, prev, kept = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), []
    for i in range(t):
        z = wx[seq[i]] + prev @ wh
        z[:, :3 * h] *= 0.5
        np.tanh(z, out=z)
        z[:, :3 * h] = 0.5 * z[:, :3 * h] + 0.5
        old = c
        c = z[:, h:2 * h] * c + z[:, :h] * z[:, 3 * h:]
        tc = np.tanh(c)
        prev = hs[i] = z[:, 2 * h:3 * h] * tc
        if keep:
            kept.append((z, old, tc))
    return hs, kept


def _lstm_back(dh: np.ndarray, hs: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, b, h = dh.shape
    dx, dwh = np.empty((t, b, 4 * h), np.float32), np.zeros_like(wh)
    back, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for i in range(t - 1, -1, -1):
        z, old, tc = kept[i]
        gi, gf, go, g = z[:, :h], z[:, h:2 * h], z[:, 2 * h:3 * h], z[:, 3 * h:]
        d = dh[i] + back
        dc = dc + d * go * (1 - tc * tc)
        dz = dx[i]
        dz[:, :h], dz[:, h:2 * h] = dc * g * gi * (1 - gi), dc * old * gf * (1 - gf)
        dz[:, 2 * h:3 * h], dz[:, 3 * h:] = d * tc * go * (1 - go), dc * gi * (1 - g * g)
        if i:
            dwh += hs[i - 1].T @ dz
        back, dc = dz @ wh.T, dc * gf
    return dx, dwh


def emissions(p: dict, ids: np.ndarray, keep: bool = False):
    """Scores (T, B, TAGS) of windows (B, T); tags that a character can't have get ``_NO``."""
    seq = ids.T
    hf, kf = _lstm(p["xf"], seq, p["hf"], keep)
    hb, kb = _lstm(p["xb"], seq[::-1], p["hb"], keep)
    both = np.concatenate([hf, hb[::-1]], axis=2)
    em = np.where(ALLOWED[seq], both @ p["out"] + p["bias"], _NO)
    return em, (seq, hf, kf, hb, kb, both)


def _moves(p: dict) -> np.ndarray:
    return np.where(POSSIBLE, p["move"], _NO)


def loss_and_gradients(p: dict, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the gold tags under the CRF, and its gradients."""
    em, (seq, hf, kf, hb, kb, both) = emissions(p, ids, True)
    t, b, k = em.shape
    move, em = _moves(p).astype(float), em.astype(float)
    y, rows = gold.T, np.arange(b)
    top = em.max(2, keepdims=True)
    e, m = np.exp(em - top), np.exp(move)
    start = np.isin(np.arange(k), (0, *_FIRST)).astype(float)
    stop = np.isin(np.arange(k), (0, 4, 6, 8, 10)).astype(float)
    a, scale = np.empty((t, b, k)), np.empty((t, b, 1))
    for i in range(t):
        x = (start if i == 0 else a[i - 1] @ m) * e[i]
        scale[i] = x.sum(1, keepdims=True)
        a[i] = x / scale[i]
    end = (a[-1] * stop).sum(1, keepdims=True)
    back = np.repeat(stop[None], b, 0) / end
    marginal, dmove = np.empty((t, b, k)), np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        marginal[i] = a[i] * back
        if i:
            right = e[i] * back / scale[i]
            dmove += (a[i - 1].T @ right) * m
            back = right @ m.T
    norm = np.log(scale[..., 0]).sum(0) + np.log(end[:, 0]) + top[..., 0].sum(0)
    path = em[np.arange(t)[:, None], rows, y].sum(0) + move[y[:-1], y[1:]].sum(0)
    dem = marginal
    dem[np.arange(t)[:, None], rows, y] -= 1
    np.add.at(dmove, (y[:-1].ravel(), y[1:].ravel()), -1)
    dem = (np.where(ALLOWED[seq], dem, 0) / b).astype(np.float32)
    g = {"move": (np.where(POSSIBLE, dmove, 0) / b).astype(np.float32), "bias": dem.sum((0, 1)), "out": both.reshape(t * b, -1).T @ dem.reshape(t * b, k)}
    dh, h = dem @ p["out"].T, hf.shape[2]
    for d, hs, kept, part, s in (("f", hf, kf, dh[..., :h], seq), ("b", hb, kb, dh[::-1, :, h:], seq[::-1])):
        dx, g["h" + d] = _lstm_back(part, hs, kept, p["h" + d])
        g["x" + d] = np.zeros_like(p["x" + d])
        np.add.at(g["x" + d], s.ravel(), dx.reshape(t * b, -1))
    return float((norm - path).mean()), g


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], hidden: int = HIDDEN, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE) -> dict | None:
    """The tagger from labelled windows (Adam); None without a labelled span."""
    if not any(spans for _, spans in windows):
        return None
    rng = np.random.default_rng(7)
    ids = np.stack([symbols(w, TRAIN_WINDOW) for w, _ in windows])
    gold = np.stack([tags(w, s, TRAIN_WINDOW) for w, s in windows])
    # As many windows of each kind, and as many without a span.
    kinds = np.array([s[0][1] if s else -1 for _, s in windows])
    pools = [np.flatnonzero(kinds == k) for k in range(-1, len(KINDS)) if (kinds == k).any()]
    p = _init(rng, hidden)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        at = np.concatenate([rng.choice(pool, -(-batch // len(pools))) for pool in pools])
        _, g = loss_and_gradients(p, ids[at], gold[at])
        length = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        fall = rate * (1 - 0.9 * step / rounds)
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (length + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - fall * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


# ---------------------------------------------------------------- training windows

def rewritten(window: str, span: tuple[int, int, int], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The window with its span in another form of its kind, or with another kind of number in its place (no span then)."""
    start, kind, end = span
    s, to, pick = window[start:end], kind, lambda *x: x[rng.integers(len(x))]
    digits = _NOT_DIGIT.sub("", s)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if rng.random() < 0.35:
        to = None
        s = pick(f"19{number(2)}-0{rng.integers(1, 10)}-1{number(1)}", f"{number(1)}{number(1)}:{number(2)}:{number(2)}", f"{rng.integers(1, 99)},{number(3)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(2)}",
                 f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"No. {number(rng.integers(3, 20))}", f"{number(rng.integers(1, 8))}", f"{number(5)}-{number(4)}", f"{number(3)}/{number(4)}", f"id={number(4)}a{number(5)}f{number(3)}",
                 f"({number(4)})", f"#{number(10)}", f"{number(9)} {pick('items', 'rows', 'km')}", "@" + s[:3] + "x", f"{number(2)}.{number(2)}.20{number(2)}", f"{number(rng.integers(9, 16))}")
    elif kind == 0:
        local, domain = s.split("@", 1)
        dot = pick(".", " (dot) ", "[dot]", " [dot] ", "(.)")
        s = local + pick("@", " (at) ", "(at)", "[at]", " [at] ", " @ ", "{at}") + domain.replace(".", dot)
    elif kind == 1:
        s = s.replace(".", pick("[.]", "(.)", " . ", ".", "[dot]"))
    elif kind == 2:
        s = pick(".", "/", "  ", "_", " ", "-").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    elif len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        s = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00 {digits[:-10]} {a} {b} {c}", f"({a}) {b} {c}", f"{a}/{b}-{c}", s)
    if start + len(s) > TRAIN_WINDOW:
        return None
    out = (window[:start] + s + window[end:])[:TRAIN_WINDOW]
    return out, [] if to is None else [(start, to, start + len(s))]


def _draw(text: str, i: int) -> int:
    return zlib.crc32(f"{i}|{len(text)}|{text[:64]}".encode("utf-8", "surrogatepass"))


def labelled(text: str) -> list[tuple[str, str]]:
    """Windows of a text with one base span each, taken in hash order, and as many at places drawn by hash without one: (window, ``start:kind:end`` or empty)."""
    spans, out, n = base_spans(text), [], len(text)
    for i in sorted(range(len(spans)), key=lambda i: _draw(text, i))[:WINDOWS_A_DOC]:
        start, kind, end = spans[i]
        at = max(0, start - _draw(text, -1 - i) % max(1, TRAIN_WINDOW - (end - start))) if end - start < TRAIN_WINDOW else -1
        if at >= 0 and all(e <= at or s >= at + TRAIN_WINDOW for j, (s, _, e) in enumerate(spans) if j != i):
            out.append((text[at:at + TRAIN_WINDOW], f"{start - at}:{kind}:{end - at}"))
    for i in range(2):
        at = _draw(text, 1000 + i) % max(1, n - TRAIN_WINDOW)
        if n and all(e <= at or s >= at + TRAIN_WINDOW for s, _, e in spans):
            out.append((text[at:at + TRAIN_WINDOW], ""))
    return out


def sample(docs: DataFrame, size: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows of about ``size`` documents, those of the least hash of id and text; windows with spans first, at most ``windows``."""
    ship_code(docs.sparkSession)
    cut = min(1.0, size / max(1, docs.count()))
    chosen = docs.filter(F.col("text").isNotNull() & (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) < int(cut * (1 << 31)))).select("text")

    def cut_out(batches):
        for b in batches:
            rows = [w for text in b.column(0) for w in labelled(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["window", "span"])

    found = chosen.mapInArrow(cut_out, "window string, span string").distinct()
    # Of spans and of windows without one, half the number at most.
    rows = [r for side in (F.col("span") != "", F.col("span") == "") for r in found.filter(side).orderBy(F.xxhash64("window"), "window", "span").limit(windows // 2).collect()]
    out = [(r.window, [tuple(map(int, r.span.split(":")))] if r.span else []) for r in rows]
    rng = np.random.default_rng(11)
    more = [rewritten(w, s[0], rng) for w, s in out if s for _ in range(3)]
    return out + [m for m in more if m]


# ---------------------------------------------------------------- tagging

def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an at-sign or a word for it."""
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        found.update(range(max(0, (m.start() - WINDOW) // STEP + 1), (m.end() - 1) // STEP + 1))
    return sorted(at * STEP for at in found)


def decode(p: dict, ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of the spans on each window's best path; the score is that of the path over its part less that of no span."""
    em, _ = emissions(p, ids)
    t, b, k = em.shape
    move = _moves(p)
    best, back = np.where(np.isin(np.arange(k), (0, *_FIRST)), em[0], em[0] + _NO), np.empty((t, b, k), np.int8)
    for i in range(1, t):
        x = best[:, :, None] + move
        back[i] = x.argmax(1)
        best = np.take_along_axis(x, back[i][:, None].astype(np.int64), 1)[:, 0] + em[i]
    path = np.empty((t, b), np.int64)
    path[-1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i][np.arange(b), path[i]]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(b)]
    for j in np.flatnonzero(path.any(0)):
        y, i = path[:, j], 0
        while i < t:
            if y[i] == 0:
                i += 1
                continue
            start, kind = i, int(_KIND_OF[y[i]])
            score = move[0, y[i]] + em[i, j, y[i]] - em[i, j, 0] - move[0, 0]
            i += 1
            while i < t and _KIND_OF[y[i]] == kind and y[i] not in _FIRST:
                score += move[y[i - 1], y[i]] + em[i, j, y[i]] - em[i, j, 0] - move[0, 0]
                i += 1
            out[j].append((start, kind, i, float(score + move[y[i - 1], 0] - move[0, 0])))
    return out


def reconciled(text: str, decoded: list[tuple[int, list[tuple[int, int, int, float]]]], base: list[tuple[int, int, int]], least: float = LEAST_SCORE) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) to add, from the spans of each window (its start and they): what a window cuts, is invalid, scores below ``least`` or
    overlaps a base span goes, and of the rest the set without overlaps and of the greatest total score stays."""
    whole: dict[tuple[int, int, int], float] = {}
    for at, spans in decoded:
        for start, kind, end, score in spans:
            a, z = at + start, at + end
            if (start == 0 and at > 0) or (end == WINDOW and z < len(text)) or end - start > WINDOW - STEP:
                continue
            while z > a and not text[z - 1].isalnum() and text[z - 1] != ")":
                z -= 1
            whole[(a, kind, z)] = max(score, whole.get((a, kind, z), score))
    ok = [(s, k, e, sc) for (s, k, e), sc in whole.items() if sc >= least and not any(bs < e and s < be for bs, _, be in base) and valid(text, s, k, e)]
    ok.sort(key=lambda x: (x[2], x[0], x[1]))
    total: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # best of the first i spans: total, the last one taken, what it stands on
    for i, (s, _, _, sc) in enumerate(ok):
        j = next((j for j in range(i, 0, -1) if ok[j - 1][2] <= s), 0)
        take = total[j][0] + sc
        total.append((take, i, j) if take > total[i][0] else (total[i][0], *total[i][1:]))
    out, (_, i, j) = [], total[-1]
    while i >= 0:
        out.append(ok[i][:3])
        _, i, j = total[j]
    return sorted(out)


def tag_texts(texts: list[str], p: dict | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    if p is None:
        return [(b, []) for b in base]
    todo = [(i, at) for i, t in enumerate(texts) for at in windows_of(t)]
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(todo), WINDOWS_AT_ONCE):
        part = todo[k:k + WINDOWS_AT_ONCE]
        for (i, at), spans in zip(part, decode(p, np.stack([symbols(texts[i][at:at + WINDOW], WINDOW) for i, at in part])), strict=True):
            found[i].append((at, spans))
    return [(b, reconciled(t, f, b) if f else []) for t, b, f in zip(texts, base, found, strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def tagged(docs: DataFrame, p: dict | None) -> DataFrame:
    """doc_id with the counts, digest and spans of its text."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def pieces(column):
        part, size = [], 0
        for x in column:
            part.append(x.as_py() or "")
            size += len(part[-1])
            if size >= CHARS_AT_ONCE:
                yield part
                part, size = [], 0
        yield part

    def run(batches):
        for b in batches:
            rows = []
            for part in pieces(b.column(1)):
                for base, added in tag_texts(part, shared.value):
                    n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, " + ", ".join(f"{n} long" for n in names[1:5]) + ", base_sha256 string, spans string, n_added long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    return tagged(docs, train(sample(docs)))
