"""Benchmark decontamination by template canonicalisation (built-in functions only).

Numbers, names and units become typed placeholders, windows of ``WINDOW`` canonical tokens of the
benchmark and of the documents are hash-joined, and a value of the item must have one value in the slots of
aligned windows: the same question with other numbers or names is caught, a chance agreement of
placeholders is not. A capitalised word at a sentence's start is tried as a word and as a name, and
windows are joined verbatim (but for case and marks at the tokens' edges) as well.

The documents' windows are formed only where they may agree: each benchmark window has two of its words as anchor,
every token of every document is looked up among the anchors' first words, and where the second word is at its place too
the window is cut out, brought into its forms and hash-joined. Forms only drop marks or put placeholders, so no equal window is missed.

Defined results: null or empty text has no windows; an item shorter than a window is one window of
its own length; windows with fewer than ``MIN_LITERALS`` different literal tokens match only verbatim; an item
without any token matches nothing. A document repeated with the same text counts
once; rows with null doc_id are told apart by their text. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import checkpointed, small_side

WINDOW = 8
MIN_LITERALS = 4
#: Consistent windows that make a leak: six windows of eight tokens are 13 tokens in a row.
MIN_WINDOWS = 6
#: Benchmark windows up to this number (hash, tokens and slots, below 1 kB each) are broadcast;
#: beyond it the window join shuffles.
BROADCAST_WINDOWS = 50_000
#: Likewise for the anchors of the benchmark's windows, below 100 bytes each.
BROADCAST_ANCHORS = 500_000

#: Placeholders, and the units that follow a number.
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Mark of a capitalised word at a sentence's start, which may be a name. The forms of a text: such words as literals, as
#: names, and every token verbatim but for case and marks at its edges.
START, FORMS, VERBATIM = "<s>", ("_plain", "_named", "_low"), 2
#: The key of any token, for windows that agree without a common word (only if no literal is asked for); no token holds it.
ANY = "\t"
UNITS = ("km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|oz|tons?|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|"
         "weeks?|months?|years?|mph|kmh|dollars?|euros?|cents?|usd|eur|percent|degrees?")

# Possessive and anchored at a token's edge, so that long runs of marks or digits cost no second look. Each begins with a test of
# one character that nearly all letters fail, so that the looks behind run at few positions.
_NUMBER = rf"(?=[-+($€£0-9])(?<![^ ])[-+(]*+(?:[$€£]?[0-9][0-9.,:/]*+[%€$)]*+|[0-9][0-9.,]*+(?i:{UNITS})[)]*+)[.,;:!?]*+(?![^ ])"
_UNIT = rf"{NUM} (?i:{UNITS})[.,;:!?)]*+(?![^ ])"
_NAME = r"(?=[(\"'\p{Lu}])(?<=[^ .!?:] )[(\"']*+\p{Lu}\p{Ll}[\p{L}'-]*+[.,;:!?)\"']*+(?![^ ])"
_FIRST = r"(?=[(\"'\p{Lu}])(?<![^ ])[(\"']*+(?=\p{Lu}\p{Ll}[\p{L}'-]*+[.,;:!?)\"']*+(?![^ ]))"
_MARKS = r"(?=[^\p{L}\p{N} ])(?:(?<![^ ])[^\p{L}\p{N} ]++(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}])[^\p{L}\p{N} ]++(?![^ ]))"
_EDGE = r"(?=[^\p{L}\p{N} ])(?:(?<![^ ])[^\p{L}\p{N}< ]++|(?<=[\p{L}\p{N}>])[^\p{L}\p{N}> ]++(?![^ ]))"


def raw_text(text: Column) -> Column:
    """White space as single blanks, no blank at the ends."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " "))


def canonical_text(raw: Column) -> Column:
    """One canonical token for each blank-separated token of ``raw``; a capitalised word inside a
    sentence is a name, one at its start has the mark ``START``, other words lose case and punctuation at their edges."""
    t = F.regexp_replace(raw, _NAME, NAME)
    t = F.regexp_replace(t, _FIRST, START)
    t = F.regexp_replace(t, _NUMBER, NUM)
    t = F.regexp_replace(t, _UNIT, f"{NUM} {UNIT}")
    return F.lower(F.regexp_replace(t, _EDGE, ""))


def _forms(table: DataFrame) -> DataFrame:
    """The tokens of the text ``_raw`` as they are, and in the forms of ``FORMS``; other columns unchanged."""
    keep = [c for c in table.columns if c != "_raw"]
    out = table.select(*keep, "_raw", canonical_text(F.col("_raw")).alias("_canon"))
    return out.select(*keep, F.split("_raw", " ").alias("_raw"), F.split(F.replace("_canon", F.lit(START), F.lit("")), " ").alias("_plain"),
                      F.split(F.regexp_replace("_canon", f"{START}[^ ]*+", NAME), " ").alias("_named"),
                      F.split(F.lower(F.regexp_replace("_raw", _MARKS, "")), " ").alias("_low"))


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("text").isNotNull()).select(F.col(key), F.xxhash64("text").alias("_text"), raw_text(F.col("text")).alias("_raw"))


def _windows(tokens: DataFrame) -> DataFrame:
    """A row per form of the window of ``width`` tokens behind the first ``_pos`` ones: ``_form`` and ``_hash`` of its tokens in that form."""
    hashes = F.array(*[F.xxhash64(F.slice(f, F.col("_pos") + 1, F.col("width"))) for f in FORMS])
    return tokens.select("*", F.posexplode(hashes).alias("_form", "_hash"))


def _value(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _slots() -> tuple[Column, Column]:
    """The window in its form as text, and its raw values at placeholders in order."""
    width = F.col("width")
    form = F.when(F.col("_form") == 0, F.col(FORMS[0])).when(F.col("_form") == 1, F.col(FORMS[1])).otherwise(F.col(FORMS[2]))
    canon, raw = F.slice(form, F.col("_pos") + 1, width), F.slice("_raw", F.col("_pos") + 1, width)
    pairs = F.filter(F.arrays_zip(canon.alias("c"), raw.alias("r")), lambda x: x["c"].isin(NUM, NAME, UNIT))
    slots = F.transform(pairs, lambda x: _value(x["r"]))
    return F.concat_ws(" ", canon), F.when(F.col("_form") < VERBATIM, slots).otherwise(F.array().cast("array<string>"))


def _literal(token: Column) -> Column:
    return ~token.isin(NUM, NAME, UNIT, "")


def _literals(tokens: Column) -> Column:
    return F.size(F.array_distinct(F.filter(tokens, _literal)))


def _key(low: Column) -> Column:
    """Lower-cased tokens without marks: equal wherever literals or verbatim tokens are, since all forms only drop marks."""
    return F.regexp_replace(low, r"[^\p{L}\p{N} ]++", "")


def _anchors(min_literals: int) -> Column:
    """The places of a benchmark window whose keys a document's window must share to agree in its form, as an array of
    (key, offset, step to the second key, second key): two literals, any two tokens verbatim, the longest of those that are no names first.
    A named window without a literal agrees at a sentence's first word; one that may agree without any common word has the key ``ANY``."""
    form = F.col("_form")

    def place(x: Column, i: Column) -> Column:
        token = F.when(form == 0, x["p"]).when(form == 1, x["n"]).otherwise(x["l"])
        key = _key(token)
        return F.struct(((form == VERBATIM) | _literal(token)).alias("fixed"), _literal(x["n"]).alias("literal"), F.length(key).alias("length"), key.alias("key"), i.alias("at"))

    def anchor(first: Column, second: Column) -> Column:
        return F.struct(first["key"].alias("key"), first["at"].alias("offset"), (second["at"] - first["at"]).alias("step"), second["key"].alias("second"))

    zipped = F.arrays_zip(F.col("_p").alias("p"), F.col("_n").alias("n"), F.col("_l").alias("l"), F.col("_r").alias("r"))
    places = F.sort_array(F.filter(F.transform(zipped, place), lambda x: x["fixed"]), asc=False)
    pair = F.transform(F.slice(places, 1, 1), lambda x: anchor(x, F.coalesce(F.get(places, F.lit(1)), x)))
    firsts = F.filter(F.transform(zipped, lambda x, i: F.struct((~_literal(x["n"]) & F.array_contains("first", _value(x["r"]))).alias("fixed"), _key(F.lower(x["r"])).alias("key"), i.alias("at"))),
                      lambda x: x["fixed"])
    anywhere = F.array(F.struct(F.lit(ANY).alias("key"), F.lit(0).alias("offset"), F.lit(0).alias("step"), F.lit(ANY).alias("second")))
    return (F.when(F.size(places) > 0, pair).when((form == 1) & (F.col("literals") < min_literals), F.transform(firsts, lambda x: anchor(x, x))).otherwise(anywhere))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(item_id, item_text, width, pos, form, hash, template, slots, literals, first, anchors, n_windows, n_usable) of the windows; small: up to three rows a benchmark word.

    A window is there verbatim if any of its tokens has a character, and in the other forms if it has enough literals.
    In the named form a word at a sentence's start (``first``) is a literal only where the document has the same."""
    tokens = _forms(_texts(benchmark, "item_id")).withColumn("width", F.least(F.size("_plain"), F.lit(window)))
    tokens = checkpointed(tokens.select("*", F.explode(F.sequence(F.lit(0), F.size("_plain") - F.col("width"))).alias("_pos")))
    template, slots = _slots()
    cut = [F.slice(f, F.col("_pos") + 1, F.col("width")).alias(n) for f, n in zip((*FORMS, "_raw"), ("_p", "_n", "_l", "_r"), strict=True)]
    first = F.transform(F.filter(F.arrays_zip(F.col("_p").alias("p"), F.col("_n").alias("n")), lambda x: x["p"] != x["n"]), lambda x: x["p"])
    out = (_windows(tokens).select("item_id", F.col("_text").alias("item_text"), "width", "_pos", "_form", "_hash", template.alias("template"), slots.alias("slots"), *cut)
           .select("*", _literals(F.col("_p")).alias("_literals"), _literals(F.col("_n")).alias("literals"), F.array_distinct(first).alias("first"))
           .filter(F.when(F.col("_form") == VERBATIM, F.trim("template") != "").otherwise(F.col("_literals") >= min_literals))
           .withColumn("anchors", _anchors(min_literals)).withColumnsRenamed({"_pos": "pos", "_form": "form", "_hash": "hash"}))
    item = Window.partitionBy("item_id", "item_text")
    n, usable = F.size(F.collect_set("pos").over(item)), F.size(F.collect_set(F.when(F.col("form") < VERBATIM, F.col("pos"))).over(item))
    return checkpointed(out.select("item_id", "item_text", "width", "pos", "form", "hash", "template", "slots", "literals", "first", "anchors", n.cast("long").alias("n_windows"), usable.cast("long").alias("n_usable")))


def anchored(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, _text, word, width, _raw, _pos): the documents' stretches that may agree with a benchmark window, from token ``word`` on.

    ``_raw`` begins with the token before it, if there is one (``_pos`` is their number): what a token becomes depends on no other. Every token's
    key is looked up among the first keys of the anchors; where the second one is at its place too, the stretch is cut out."""
    anchors = bench.select("width", F.inline("anchors")).distinct()
    side = small_side(checkpointed(anchors.select("width", "offset", "step", "second", F.xxhash64("key").alias("_first"))), BROADCAST_ANCHORS)
    low = F.lower("_raw")
    # A token's literal form has lost a ``START`` that was in the text, its verbatim one has not: such a text has both keys, one list behind the other.
    keys = F.when(F.contains(low, F.lit(START)), F.concat(F.split(_key(low), " "), F.split(_key(F.replace(low, F.lit(START), F.lit(""))), " "))).otherwise(F.split(_key(low), " "))
    if not anchors.filter(F.col("key") == ANY).isEmpty():
        keys = F.concat(keys, F.array_repeat(F.lit(ANY), F.size(F.split("_raw", " "))))
    rows = _texts(docs, "doc_id").select("doc_id", "_text", F.split("_raw", " ").alias("_raw"), keys.alias("_keys"))
    # Outer, and compared null-safely: a filter on the arrays, as Spark infers it, would compute the keys once more below the generator.
    rows = rows.select("*", F.posexplode_outer("_keys").alias("_at", "_token"))
    word = F.col("_at") % F.size("_raw") - F.col("offset")
    found = (rows.join(side, (F.xxhash64("_token") == F.col("_first")) & F.get("_keys", F.col("_at") + F.col("step")).eqNullSafe(F.col("second"))
                       & (word >= 0) & (word + F.col("width") <= F.size("_raw")))
             .select("doc_id", "_text", "_raw", "width", word.alias("word")))
    before = F.least(F.col("word"), F.lit(1))
    return found.select("doc_id", "_text", "word", "width", F.concat_ws(" ", F.slice("_raw", F.col("word") - before + 1, F.col("width") + before)).alias("_raw"), before.alias("_pos"))


def agreeing(stretches: DataFrame, bench: DataFrame) -> DataFrame:
    """The windows of ``stretches`` joined with the benchmark's: a row per window, form and equal benchmark window."""
    template, slots = _slots()
    side = small_side(bench.drop("width", "anchors"), BROADCAST_WINDOWS)
    return (_windows(_forms(stretches)).join(side, (F.col("_hash") == F.col("hash")) & (F.col("_form") == F.col("form")))
            .filter(template == F.col("template"))
            .select("doc_id", "_text", "item_id", "item_text", "n_windows", "n_usable", "pos", "form", "word",
                    F.arrays_zip(F.col("slots").alias("b"), slots.alias("d")).alias("pairs"), "literals", "first"))


def _pairs(hits: Column, form: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(hits, lambda x: x["form"] == form), lambda x: x["pairs"])))


def _kept_as_is(pairs: Column, value: Column) -> Column:
    return F.exists(pairs, lambda y: (y["b"] == value) & (y["d"] == value))


def _contradicts(pairs: Column) -> Column:
    """Whether a value of the item has several values in the document and none is the item's own."""
    return F.exists(pairs, lambda x: F.exists(pairs, lambda y: (y["b"] == x["b"]) & (y["d"] != x["d"])) & ~_kept_as_is(pairs, x["b"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS,
                 min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, _text, item_id, n_matched, n_windows, first_word, exact): the documents that hold a benchmark item.

    Windows that agree are grouped by their alignment (document position minus item position). A
    value of the item must have one value in the alignment; where some of its places have the item's own, only the windows
    with another one do not count. Verbatim windows always count. A document holds the item if its windows number at least
    ``min_windows``, or all windows of a shorter item, or all those with enough literals.
    """
    bench = benchmark_windows(benchmark, window, min_literals)
    hits = agreeing(anchored(docs, bench), bench)
    item = ["doc_id", "_text", "item_id", "item_text", "n_windows", "n_usable"]

    def enough(x: Column) -> Column:
        same = F.transform(F.filter(x["pairs"], lambda y: y["b"] == y["d"]), lambda y: y["b"])
        return (x["form"] != 1) | (x["literals"] + F.size(F.array_intersect(same, x["first"])) >= min_literals)

    aligned = (hits.groupBy(*item, (F.col("word") - F.col("pos")).alias("_at")).agg(F.collect_set(F.struct("pos", "form", "pairs", "literals", "first")).alias("_hits"))
               .withColumn("_hits", F.filter("_hits", enough))
               .select("*", _pairs(F.col("_hits"), 0).alias("_p0"), _pairs(F.col("_hits"), 1).alias("_p1"))
               .select("*", _contradicts(F.col("_p0")).alias("_no0"), _contradicts(F.col("_p1")).alias("_no1")))

    def holds(x: Column) -> Column:
        def fits(pairs: str) -> Column:
            return F.forall(x["pairs"], lambda y: (y["b"] == y["d"]) | ~_kept_as_is(F.col(pairs), y["b"]))
        # The named form is as good as the plain one where the plain one finds nothing amiss; equal windows are a leak whatever the slots elsewhere say.
        return F.when(x["form"] == 0, ~F.col("_no0") & fits("_p0")).when(x["form"] == 1, ~F.col("_no0") & ~F.col("_no1") & fits("_p1")).otherwise(F.lit(True))

    # Alignments without a hit count for nothing below; a filter here would move down and compute the columns above once a hit.
    aligned = aligned.withColumn("_hits", F.filter("_hits", holds))
    positions = F.array_distinct(F.transform("_hits", lambda x: x["pos"]))
    usable = F.array_distinct(F.transform(F.filter("_hits", lambda x: x["form"] < VERBATIM), lambda x: x["pos"]))
    same = F.forall(F.concat("_p0", "_p1"), lambda x: x["b"] == x["d"])
    found = (aligned.groupBy(*item)
             .agg(F.sum(F.size(positions)).alias("_n"), F.sum(F.size(usable)).alias("_u"), F.min(F.col("_at") + F.array_min(positions)).alias("first_word"), F.min(F.when(F.size("_hits") > 0, same)).alias("exact"))
             .withColumn("n_matched", F.least("_n", "n_windows")))
    return (found.filter("_n > 0").filter((F.col("n_matched") >= F.least(F.lit(min_windows), F.col("n_windows")))
                                         | (F.col("n_usable") > 0) & (F.col("_u") >= F.least(F.lit(min_windows), F.col("n_usable"))))
            .select("doc_id", "_text", "item_id", "n_matched", "n_windows", "first_word", "exact"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns unchanged."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad_id"), F.col("_text").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
