"""Token ids as Parquet list columns: dictionary pages for the ids, delta encoding for the ascending
columns, bounded row groups and small pages with page indexes, so that a read by document touches
few pages and a read of the metadata none of the ids.

A store is a folder of Parquet files. Documents are in ascending order of doc_id (null first, equal
ids by text) over the files in order of their part number; a row holds doc_id, part, at (ids of the
part before it), n_tokens and ids.

Defined results: null and empty text encode to the end id alone; repeated rows are stored as often
as they occur; an empty table makes an empty store. Texts are encoded whole. Extra columns are not
stored.
"""

from __future__ import annotations

import json
import os
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadgrid.llm.common import release_memory, scratch_path, ship_code

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>"
#: Bytes of a row group, rows of a page, bytes of a page.
ROW_GROUP, PAGE_ROWS, PAGE = 32 << 20, 1_000, 256 << 10
#: Words whose ids a worker keeps, and words encoded in one call.
KEPT_WORDS, CALL_WORDS = 1_500_000, 2_000
#: Marks that close a word.
MARKS = ".,;:!?"
#: Characters of text encoded at a time, and rows of a batch that is handed back.
PIECE_CHARS, BATCH_ROWS = 6_000_000, 500


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of white-space separated words, kept between batches in Arrow columns: ``words`` and ``ids``, a list each.

    The tokenizer drops white space and never lets a token span it, so a text's ids are those of its
    words in order. Arrow splits the texts, numbers their distinct words, finds them among the kept ones and puts the ids in place; only new
    words are handled one by one. They are encoded together: a word of lower-case letters alone is one piece, whose last
    token is marked as the end of a word; all other words are cut apart by their offsets.
    Of more than KEPT_WORDS words the half that was not seen for longest is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.words, self.ids, self.seen, self.call = pa.array([""], pa.string()), pa.array([[]], pa.list_(pa.int32())), np.zeros(1, np.int64), 0
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def learn(self, words: list[str]) -> tuple[list[str], pa.ListArray]:
        """The words in some order, and the ids of each."""
        plain, other, done, ids, sizes = [], [], [], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for w in words:
            letters = self.ends is not None and w.isalpha() and w.islower() and is_normalized("NFC", w)
            (plain if letters else other).append(w)
        for i in range(0, len(plain), CALL_WORDS):
            part = plain[i:i + CALL_WORDS]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[got])
            if len(last) == len(part):
                done += part
                ids.append(got[:last[-1] + 1])
                sizes.append(np.diff(last, prepend=-1))
            else:
                other += part
        for i in range(0, len(other), CALL_WORDS):
            part = other[i:i + CALL_WORDS]
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            got = np.array(enc.ids, np.int32)
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            at = np.array([o[0] for o in enc.offsets], np.int64) if len(got) else np.zeros(0, np.int64)
            cut = np.append(np.searchsorted(at, starts), len(got))
            done += part
            ids.append(got[cut[0]:])
            sizes.append(np.diff(cut))
        return done, _lists(np.cumsum(np.concatenate(sizes)), pa.array(np.concatenate(ids)))

    def _add(self, words: pa.Array, ids: pa.ListArray) -> None:
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.seen = np.append(self.seen, np.full(len(words), self.call))

    def _forget(self) -> None:
        keep = self.seen >= np.median(self.seen[1:])
        keep[np.cumsum(keep) > KEPT_WORDS // 2] = False
        keep[0] = True  # the empty word
        self.words, self.ids, self.seen = self.words.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.seen[keep]

    def find(self, distinct: pa.Array) -> np.ndarray:
        """The places of the words among the kept ones, to which new ones are added."""
        self.call += 1
        if len(self.words) > KEPT_WORDS:
            self._forget()
        # A mark after a letter is a token of its own: such a word is its stem's ids and the mark's.
        has = pc.and_(pc.match_substring_regex(distinct, f"[a-z][{MARKS}]$"), pc.invert(pc.match_substring(distinct, "<|")))
        marked = distinct.filter(has)
        parts = pa.concat_arrays([pc.binary_slice(marked.cast(pa.binary()), 0, -1), pc.binary_slice(marked.cast(pa.binary()), -1)]).cast(pa.string())
        at = pc.index_in(pa.concat_arrays([distinct, parts]), value_set=self.words)
        here, of = at.slice(0, len(distinct)), at.slice(len(distinct))
        new = here.is_null()
        new_marked = new.filter(has)  # which of the marked words
        both = pa.concat_arrays([new_marked, new_marked])
        least = len(self.words)
        needed = pc.unique(pa.concat_arrays([distinct.filter(pc.and_(new, pc.invert(has))), parts.filter(pc.and_(both, of.is_null()))]))
        done, ids = self.learn(needed.to_pylist())
        learned = pa.array(done, pa.string())
        self._add(learned, ids)

        def place(words, known):
            return pc.coalesce(known, pc.add(pc.index_in(words, value_set=learned), pa.scalar(least, pa.int32()))).to_numpy(zero_copy_only=False)

        two = place(parts.filter(both), of.filter(both)).astype(np.int64).reshape(2, -1).T.ravel()  # stem, mark, stem, mark
        pairs = self.ids.take(pa.array(two))
        self._add(marked.filter(new_marked), _lists(pairs.offsets.to_numpy()[::2], pairs.values))
        out = np.empty(len(distinct), np.int64)
        is_new_marked = pc.and_(new, has).to_numpy(zero_copy_only=False)
        rest = pa.array(~is_new_marked)
        out[~is_new_marked] = place(distinct.filter(rest), here.filter(rest))
        out[is_new_marked] = least + len(done) + np.arange(is_new_marked.sum())
        self.seen[out] = self.call
        self.seen[two] = self.call
        return out

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text, and ``end_id``."""
        special = pc.match_substring(texts, "<|")  # special tokens are case-sensitive
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        at = self.find(coded.dictionary)
        ids = pa.concat_arrays([self.ids.take(pa.array(at)), pa.array([[end_id]], self.ids.type)])
        sizes = pc.list_value_length(ids).to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        words = np.insert(coded.indices.to_numpy(), ends, len(at))
        to = np.cumsum(sizes[words], dtype=np.int64)[ends + np.arange(len(ends))]
        return _lists(np.concatenate([[0], to]), ids.take(pa.array(words)).flatten())


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    """One per Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def _by_size(sizes: list[int], limit: int = PIECE_CHARS):
    """Slices of the texts of these sizes, of at most ``limit`` characters or one text each."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if sizes:
        yield start, len(sizes)


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The rows of a store, ordered: range-partitioned by doc_id, sorted inside each part, encoded in place."""
    ship_code(docs.sparkSession)
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        enc = _encoder(path or tokenizer_path())
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i, j in _by_size(pc.utf8_length(texts).to_pylist()):
                lists = enc.encode(texts.slice(i, j - i), end_id)
                ends = lists.offsets.to_numpy()[1:].astype(np.int64)
                n = np.diff(ends, prepend=0)
                done = pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(before + ends - n), pa.array(n), lists],
                                                  names=["doc_id", "part", "at", "n_tokens", "ids"])
                before += int(ends[-1])
                del lists
                yield from (done.slice(k, BATCH_ROWS) for k in range(0, j - i, BATCH_ROWS))
                del done
                release_memory()

    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, row_group: int = ROW_GROUP,
          page_rows: int = PAGE_ROWS, page: int = PAGE) -> None:
    """Write the store of ``docs`` to ``folder``."""
    w = encoded(docs, path, end_id).write
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": row_group,
               "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": 1 << 20}
    for c in ("doc_id", "at", "n_tokens"):
        options[f"parquet.enable.dictionary#{c}"] = "false"  # delta encoding instead
    for k, v in options.items():
        w = w.option(k, str(v))
    w.parquet(folder)


def read(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; ``where`` on doc_id reaches the page index.

    The offsets of the parts come from one narrow column, a row per part reaches the broadcast.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    chosen = rows if where is None else rows.filter(where)
    return chosen.join(F.broadcast(parts), "part").select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for b in batches:
        lists = b.column(3)
        off = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = pa.array([zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], pa.int64())
        n = pa.array(np.diff(off).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store that was read."""
    ship_code(store.sparkSession)
    return store.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def report(docs: DataFrame) -> DataFrame:
    """Encode ``docs`` into a store in the shared folder, read it back and digest what was read."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write(docs, folder)
    return digest(read(docs.sparkSession, folder))
