"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised and cut into pieces of at most `limit` ids; only the
pieces' lengths and checksums go on. Pieces are dealt into randomised groups of
documents and each group is packed by itself: the largest piece first, each into
the first bin with room, which a tournament tree over the bins' free capacities
finds in logarithmic time.

Defined cases: a null text is empty and holds the end id alone; rows with the
same doc_id are separate documents; a null doc_id stays null; a very long text is cut
into pieces that may lie in different sequences; an empty table gives an empty one;
further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, mix64, sized_batches, text_buffer, trimming, word_spans

LIMIT, END_ID = 4096, 2
#: Documents of a group on average, and words whose ids a worker remembers.
GROUP, REMEMBERED = 4096, 1_000_000
VOCABULARY = "word_bpe_49k.json"
#: Text whose words are told apart at a time.
SLICE = 1 << 22


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    Holds for a tokenizer that splits at white space and drops it, so that a
    text's ids are its words' ids in order. Words are remembered with the bytes of
    their ids. A word of plain letters and closing punctuation is two units of
    the tokenizer (letters; signs), which are remembered apart.
    """

    #: Letters that stay one letter in lower case, then ASCII signs but the apostrophe.
    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn_units(self, units: list[str]) -> None:
        """Ids of units, each of which ends at the next id that closes a word."""
        for lo in range(0, len(units), 1000):
            part = units[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                raw, at = ids.tobytes(), 0
                for unit, end in zip(part, ends.tolist(), strict=True):
                    self.units[unit] = raw[4 * at : 4 * end]
                    at = end
            else:
                self.units |= {unit: self._encode(unit).tobytes() for unit in part}

    def _learn(self, words: set[bytes]) -> None:
        split, fresh = {}, set()
        for word in words:
            text = word.decode("utf-8", "replace")
            if m := self.plain.fullmatch(text):
                split[word] = unit, sign = m[1].lower(), m[2]
                fresh.update(u for u in (unit, sign) if u not in self.units)
            else:
                self.words[word] = self._encode(text).tobytes()
        self._learn_units(sorted(fresh))
        for word, (unit, sign) in split.items():
            self.words[word] = self.units[unit] + self.units[sign]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct words."""
        missing = set(words).difference(self.words)
        if len(self.words) + len(missing) > REMEMBERED:
            self.words.clear()
            self.units = {"": b""}
            missing = set(words)
        if missing:
            self._learn(missing)
        return list(map(self.words.__getitem__, words))

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids.

        Words of a batch are told apart by their bytes themselves, of which two numbers hold 15 and the length; longer
        ones by dictionary. What all distinct words have for ids is then put in the order of the words.
        """
        data, offsets = text_buffer(texts)
        starts, ends = word_spans(data, offsets)
        sizes = ends - starts
        firsts = np.searchsorted(starts, offsets)  # of each text, and the end
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low = eight[starts] & _MASKS[np.minimum(sizes, 8)]
        high = eight[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(sizes - 8, 0, 7)] | np.minimum(sizes, 16).astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(sizes > 15)
        raw, numbers = data.tobytes(), {}
        low[long] = [numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        mixed = mix64(low * np.uint64(0x9E3779B97F4A7C15) + high)
        order = np.argsort(mixed)
        new = np.ones(len(order), bool)
        new[1:] = np.diff(mixed[order]) != 0
        same = np.flatnonzero(~new)
        if (low[order[same]] != low[order[same - 1]]).any() or (high[order[same]] != high[order[same - 1]]).any():  # two words have one mix
            order = np.lexsort((high, low))
            new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        kind = np.empty(len(order), np.int64)  # of each word, its place among the distinct ones
        kind[order] = np.cumsum(new) - 1
        some = order[new]
        known = self._known([raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        found = np.frombuffer(b"".join(known), "<u4")
        counts = np.array([len(k) // 4 for k in known], np.int64)
        begins = (np.cumsum(counts) - counts)[kind]
        counts = counts[kind]
        edges = np.concatenate([[0], np.cumsum(counts)])
        out = found[np.repeat(begins - edges[:-1], counts) + np.arange(edges[-1])] if edges[-1] else np.zeros(0, "<u4")
        for lo, hi in zip(edges[firsts[:-1]].tolist(), edges[firsts[1:]].tolist(), strict=True):
            yield out[lo:hi]


#: Masks of the lowest 0 to 8 bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each path in a worker process: what it remembers serves later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int | None = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a random number `deal` for each piece of every row."""

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path or vocabulary_path())
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        seen = 0
        for batch in sized_batches(batches, "text", SLICE):
            doc, start, length, crc, tokens, deal = [], [], [], [], [], []
            lots = mix64(np.uint64(TaskContext.get().partitionId() << 40) + np.arange(seen, seen + len(batch), dtype=np.uint64)) >> np.uint64(1)
            seen += len(batch)
            for i, (found, lot) in enumerate(zip(own.ids(batch.column("text")), lots.tolist(), strict=True)):
                ids = found.tobytes() + end
                n = len(ids) // 4
                for at in range(0, n, limit):
                    piece = ids[4 * at : 4 * (at + limit)]
                    doc.append(i), start.append(at), length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece)), tokens.append(n), deal.append(lot)
            columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, tokens, deal)]]
            yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    names = ["start", "length", "ids_crc32", "doc_tokens", "deal"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in names]])
    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; sizes are at most limit."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [limit] * (2 * leaves)  # a node holds the largest free capacity below it; free[1] is the root
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, limit - free[at]
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return bins, offsets


def pack(found: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """found (see `pieces`) with sequence_id and offset instead of deal."""
    found = materialize(found)  # the deal holds for good, and texts are tokenised once
    n = found.filter("start = 0").count()
    groups = max(1, -(-n // group))

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), limit)
        ids = bins + (table.column("g")[0].as_py() << 32)
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = found.withColumn("g", F.pmod(F.col("deal"), F.lit(groups))).drop("deal")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", found.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in names]])
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "g").groupBy("g").applyInArrow(run, schema)


def packed(docs: DataFrame, limit: int = LIMIT, group: int = GROUP, **how) -> DataFrame:
    """Every document's pieces with the sequence and offset each lies at."""
    return pack(pieces(docs, limit, **how), limit, group)
