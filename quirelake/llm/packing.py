"""Lexical retrieval packing: each training window holds a document and its BM25 neighbours.

1. Every whole text is tokenized in one narrow pass (blanks always separate tokens, so
   distinct words are encoded once per batch) and the ids are written once.
2. Document frequencies of all token ids over all documents are summed by Spark; the
   result has one number for each entry of the vocabulary, a fixed size, and is broadcast.
3. Documents are sorted over the cluster by a min-hash of their token pairs, then id.
   Copies and near copies stand together, and a hot group is split by id, as ranges are.
4. Runs of about ``SHARD_TOKENS`` ids are shards. A shard builds its part of the
   inverted index with the global weights. The first unused document is the seed of
   a window; its best unused neighbours fill the window, those that fit first, then
   the best one is cut and its rest becomes the next seed.

Every id lies in exactly one piece. Only the last window of a shard can be short; it is
cut into sequences whose lengths are powers of two, so nothing is padded.

Defined results: null text is empty text, and every document has at least the end id;
documents longer than a window fill several; equal scores go to the document that
comes first in the sort; rows that repeat are packed as often as they occur; an empty
table gives no pieces; extra columns are ignored. A document is held whole in one
task, a shard by its token count.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, tidy, written

WINDOW, END = 4096, 2
SHARD_TOKENS = 1 << 20
TOKENS_PER_TASK = 4 << 20
LOOK_AT = 64  # best neighbours tried for fit before the best is cut
K1, B = 1.2, 0.75
REMEMBERED = 400_000
JOINED = 64
TEXT_BYTES = 6 << 20  # of texts that are tokenized together
MARKS = ".,;:!?&#*$%"
#: The steps before the merges of a tokenizer that reads words apart, as its file states them.
STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_open: dict = {}


class WordTokenizer:
    """Ids of whole texts; the ids of recent words are remembered within a task, up to a bound.

    Words are looked up apart only if the tokenizer's own steps are the ones that this is made for
    (``STEPS``); any other tokenizer encodes texts as they are.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content)
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        parts = json.loads(content)
        self.by_words = [parts.get("normalizer"), parts.get("pre_tokenizer")] == STEPS
        self.special = [t["content"].lower() for t in parts.get("added_tokens") or []]
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered: words, and their ids one after the other with a size each."""
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.empty(0, self.kind), np.empty(0, np.int64)

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, then ``end``. Strings between blanks, and of these the words without the marks behind them, are looked up once."""
        if not texts or not self.by_words:
            return [np.array([*e.ids, end], self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        split = pc.split_pattern(pa.array([self._alike(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        found = split.flatten().dictionary_encode()
        cores, marks = _parts(found.dictionary)
        cores = cores.dictionary_encode()
        place, ids, sizes = self._looked_up(cores.dictionary)
        shown = {m: i for i, m in enumerate(dict.fromkeys(marks), len(sizes))}
        more, n = self._learned(list(shown))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, n])
        # ids of each distinct string from those of its word and marks, then of each string as it stands
        ids, sizes = _gathered(ids, sizes, np.stack([place[cores.indices.to_numpy()], [shown[m] for m in marks]], axis=1).ravel())
        ids, sizes = _gathered(ids, sizes[::2] + sizes[1::2], found.indices.to_numpy())
        cuts = np.append(0, np.cumsum(sizes))[np.cumsum(pc.list_value_length(split).to_numpy())]
        return np.split(np.insert(ids, cuts, end), (cuts + np.arange(1, len(cuts) + 1))[:-1])

    def _alike(self, text: str) -> str:
        """A text with the same ids: lower case, where that is certain to be the tokenizer's own."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(t in low for t in self.special) else low

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each of ``words``, which are distinct, in a table of ids: the table and its sizes."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(known))
        ids, sizes = self._learned(new.to_pylist())
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        place = known.fill_null(0).to_numpy().astype(np.int64)
        place[pc.is_null(known).to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(sizes))
        if len(sizes) <= REMEMBERED:
            self.words, self.ids, self.sizes = pa.concat_arrays([self.words, new]), ids, sizes
        else:  # these words only
            self.words = words
            self.ids, self.sizes = _gathered(ids, sizes, place)
        return place, ids, sizes

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        sizes, rows = np.zeros(len(words), np.int64), [np.empty(0, self.kind)] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        found = self._joined([words[i] for i in plain]) if self.ends.any() else None
        if found is not None and len(plain) == len(words):
            return found
        if found is not None:
            for i, x in zip(plain, np.split(found[0], np.cumsum(found[1])[:-1]), strict=True):
                rows[i] = x
        done = set(plain) if found is not None else set()
        rest = [i for i in range(len(words)) if i not in done]
        for i, e in zip(rest, self.model.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            rows[i] = np.array(e.ids, self.kind)
        sizes[:] = [len(x) for x in rows]
        return np.concatenate(rows) if rows else np.empty(0, self.kind), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters, from encodings of many at once, cut where a word ends; None if that is not certain.

        Each word gives at least one token that ends a word, so as many of them as words means one each.
        """
        if not words:
            return None
        lines = [" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else None


def _parts(strings: pa.Array) -> tuple[pa.Array, list[str]]:
    """Strings without the marks that follow letters, which are tokens apart, and these marks.

    The tokenizer's lower case of a dotted capital I ends in a combining mark, to which a mark behind it is joined: not cut.
    """
    cores = pc.utf8_rtrim(strings, MARKS)
    n = pc.subtract(pc.binary_length(strings), pc.binary_length(cores)).to_numpy()
    cut = (n > 0) & pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False) & ~pc.match_substring(cores, "\u0130").to_numpy(zero_copy_only=False)
    marks = np.full(len(strings), "", object)
    last = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[np.frombuffer(strings.buffers()[1], np.int64)[1 : len(strings) + 1] - 1] if cut.any() else n
    for m in MARKS:
        marks[cut & (n == 1) & (last == ord(m))] = m
    more = np.flatnonzero(cut & (n > 1))
    marks[more] = [s[-k:] for s, k in zip(strings.take(pa.array(more)).to_pylist(), n[more].tolist(), strict=True)]
    return pc.if_else(pa.array(cut), cores, strings), marks.tolist()


def _gathered(table: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``table``, which has one of each size after the other, in the order of ``index``; their sizes."""
    n = sizes[index]
    shift = (np.cumsum(sizes) - sizes)[index] - np.cumsum(n) + n
    return table[np.arange(n.sum()) + np.repeat(shift, n)], n


def open_tokenizer(shared) -> WordTokenizer:
    key = hash(shared.value)
    if key not in _open:
        _open.clear()
        _open[key] = WordTokenizer(shared.value)
    return _open[key]


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> tuple[DataFrame, int, type]:
    """(doc_id, n, route, ids) of each text, the vocabulary's size and the width of an id.

    ``route`` is a min-hash of the pairs of neighbouring ids.
    """
    content = Path(tokenizer).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    local = WordTokenizer(content)
    kind, size = local.kind, max(local.model.get_vocab_size(), end + 1)

    def encode(batches):
        model = open_tokenizer(shared)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sums = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sums)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                ids, routes = model.encode(texts.slice(a, b - a).to_pylist(), end), []
                for x in ids:
                    x = x.astype(np.uint64)
                    pairs = (x[:-1] * np.uint64(size) + x[1:] if len(x) > 1 else x) * np.uint64(0x9E3779B97F4A7C15)
                    routes.append(int((pairs ^ (pairs >> np.uint64(31))).min() >> np.uint64(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array(routes, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "route", "ids"])
        model.forget()
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, route long, ids binary"), size, kind


def document_frequencies(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """Number of documents that hold each id, over all documents: one number for each entry of the vocabulary."""

    def count(batches):
        total, place = np.zeros(size, np.int64), np.zeros(size, np.int32)
        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_buffer(), kind)
                at = np.arange(len(ids), dtype=np.int32)
                place[ids] = at  # of equal ids the last stays
                total[ids[place[ids] == at]] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    found = rows.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[found["term"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


class ShardIndex:
    """BM25 inverted index over the documents of one shard, with the weights of the whole corpus.

    The lists of terms that at least an eighth of the documents hold are kept as rows of a dense table.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        wide = np.uint64 if len(idf) * n >= 1 << 32 else np.uint32
        place = np.concatenate(docs).astype(wide) * wide(n) + np.repeat(np.arange(n, dtype=wide), sizes)
        place, tf = np.unique(place, return_counts=True)
        term, doc = np.divmod(place, wide(n))
        self.doc = doc.astype(np.int32)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        first = np.flatnonzero(np.diff(term.astype(np.int64), prepend=-1))
        held = np.diff(first, append=len(term))
        row = np.repeat(np.arange(len(first)), held)
        by_doc = np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
        rows_of = np.split(row[by_doc], np.cumsum(np.bincount(self.doc, minlength=n))[:-1])
        common = held >= max(8, n // 8)
        dense = np.cumsum(common) - 1
        self.dense = np.zeros((int(common.sum()), n), np.float32)
        often = common[row]
        self.dense[dense[row[often]], self.doc[often]] = self.weight[often]
        self.common_of = [dense[r[common[r]]] for r in rows_of]
        self.rare_of = [r[~common[r]] for r in rows_of]
        self.first, self.held, self.n = first, held, n

    def scores(self, doc: int) -> np.ndarray:
        rows = self.rare_of[doc]
        a, sizes = self.first[rows], self.held[rows]
        at = np.arange(sizes.sum()) + np.repeat(a - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n) + self.dense[self.common_of[doc]].sum(axis=0)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold each id once."""
    index = ShardIndex(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    sequences, pieces, space = [], [], window
    first, seed, at = 0, -1, 0  # the seed and how much of it is placed
    while True:
        if seed < 0:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                break
            seed, at = first, 0
            unused[seed] = False
        take = min(space, len(docs[seed]) - at)
        pieces.append((seed, at, take))
        at, space = at + take, space - take
        if space:
            asked, seed = seed, -1
            left = np.flatnonzero(unused)
            if len(left):
                score = index.scores(asked)[left]
                best = left[np.lexsort((left, -score))] if len(left) <= LOOK_AT else left[_best(score, LOOK_AT)]
                for d in best:
                    if len(docs[d]) <= space:
                        pieces.append((int(d), 0, len(docs[d])))
                        unused[d] = False
                        space -= len(docs[d])
                        if not space:
                            break
                if space:
                    rest = [int(d) for d in best if unused[d]]
                    if rest:  # cut the best that does not fit; its rest seeds the next window
                        seed, at = rest[0], space
                        unused[seed] = False
                        pieces.append((seed, 0, space))
                        space = 0
                    else:
                        continue
        if not space:
            if seed >= 0 and at == len(docs[seed]):
                seed = -1
            sequences.append(pieces)
            pieces, space = [], window
    return sequences + powers_of_two(pieces)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, largest first, equal ones in order."""
    edge = -np.partition(-score, k - 1)[k - 1]
    over, equal = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
    found = np.concatenate([over, equal[: k - len(over)]])
    return found[np.lexsort((found, -score[found]))]


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut pieces into sequences whose lengths are the powers of two in their sum, largest first."""
    total = sum(p[2] for p in pieces)
    out, pieces = [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            need, own = 1 << bit, []
            while need:
                d, start, length = pieces.pop()
                own.append((d, start, min(length, need)))
                if length > need:
                    pieces.append((d, start + need, length - need))
                need -= own[-1][2]
            out.append(own)
    return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows, size, kind = tokenized(docs, tokenizer, key, text, end)
    rows = written(rows)
    n_docs, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = document_frequencies(rows, size, kind)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, max(1.0, n_tokens / max(1, n_docs))))
    parts = shuffle_parts(spark, n_tokens, TOKENS_PER_TASK)
    rows = rows.repartitionByRange(parts, "route", "doc_id").sortWithinPartitions("route", "doc_id").select("doc_id", "ids")

    def packed(batches):
        idf, mean = shared.value
        number = TaskContext.get().partitionId() << 32

        def flush(held):
            nonlocal number
            out = []
            arrays = [ids for _, ids in held]
            for sequence in pack_shard(arrays, idf, mean, window):
                offset = 0
                for d, start, length in sequence:
                    crc = zlib.crc32(arrays[d][start : start + length].astype("<u4").tobytes())
                    out.append((held[d][0], start, length, crc, len(arrays[d]), number, offset))
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held, tokens = [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, np.frombuffer(ids.as_py(), kind)))
                tokens += len(held[-1][1])
                if tokens >= SHARD_TOKENS:
                    yield flush(held)
                    held, tokens = [], 0
        if held:
            yield flush(held)
        held = []
        tidy()

    return rows.mapInArrow(packed, PIECES)
