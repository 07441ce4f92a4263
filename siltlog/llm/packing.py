"""Sequences of a fixed length along a Hilbert curve through the documents.

A document's tokens, hashed to signs, give a mean vector of DIMS dimensions; its Hilbert key orders the documents so that
neighbours share words. Documents lie end to end in that order and are cut every SEQUENCE tokens: only the last sequence
needs padding. Tokens are made once and written as 2 or 4 bytes each to the shared folder, then range-sorted by key: the one
shuffle, whatever the table's size. Running sums inside the ranges and prefix sums over them (a row for each range) give
each document its place, and the pieces follow row by row. Copies and repeated keys are told apart by id and row, so that a
group of equal documents is spread over ranges like any others.

Cases: a null text counts as empty and has only the end token; null ids and repeated rows are packed like others; an
empty table gives an empty result; very long texts are cut like others; other columns are dropped by name first.
"""

from __future__ import annotations

import functools
import json
import math
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .shared import Memo, Scratch, tidy

SEQUENCE, END_ID = 4096, 2
DIMS, BITS = 3, 16
#: Bytes of tokens in a range, about: the number of ranges follows the size of the table.
RANGE_BYTES = 32 << 20
#: Words whose ids a worker remembers for good; with the last ones, some 60 MB.
CACHE_WORDS = 200_000
_SLICE = 512


class _Words(Memo):
    """ids, as bytes, of what a word pattern finds in a text without white space; what has several words is put together from theirs."""

    def __init__(self, find, model, kind: str, most: int):
        super().__init__(self._merge, most)
        self.find, self.model, self.kind = find, model, kind
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _merge(self, chunk: str) -> bytes:
        words = self.find(chunk)
        if words == [chunk]:
            plain = chunk.isascii() and chunk.isprintable()
            return array(self.kind, [t.id for t in self.model.tokenize(chunk if plain else self.bytes_of(chunk)[0][0])]).tobytes()
        return b"".join(map(self.__getitem__, words))


class TextEncoder:
    """ids of ``tokenizers``, without special tokens, as bytes.

    For a tokenizer that lower-cases and cuts words by PATTERN before its merges, a word's ids don't depend on its
    neighbours; what lies between white space in Latin text is then looked up, and only new words go through the merges.
    Texts with other letters, or with the strings of special tokens, go through the tokenizer whole.
    """

    # Fixed value: the word pattern for which words can be looked up.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = range(0x20, 0x250)

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        small = self.full.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if small else "<u4")
        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = small and sys.byteorder == "little" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and steps == ["NFC", "Replace", "Lowercase"] and cut[0].get("pattern", {}).get("Regex") == self.PATTERN
        if self.by_word:
            of = {k: "".join(re.escape(chr(c)) for c in self.LATIN if unicodedata.category(chr(c))[0] == k) for k in "LN"}
            words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^\\s{of['L']}{of['N']}]+")
            self.known = _Words(words.findall, self.full.model, "H", CACHE_WORDS)
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            # Python's white space has four controls more; one letter's lower case is two characters
            self.odd = ("\x1c", "\x1d", "\x1e", "\x1f", "\u0130", *self.special)
            self.beyond = re.compile("[^\x00-\u024f]")

    def _whole(self, text: str) -> bool:
        if not self.by_word or any(x in text for x in self.odd):
            return True
        return not text.isascii() and self.beyond.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        done = dict(zip(whole, self.full.encode_batch([texts[i] for i in whole], add_special_tokens=False)))
        return [np.array(done[i].ids, self.kind).tobytes() if i in done else b"".join(map(self.known.__getitem__, t.lower().split())) for i, t in enumerate(texts)]


@functools.lru_cache(2)
def text_encoder(path: str) -> TextEncoder:
    """One for a worker process, which outlives its tasks."""
    return TextEncoder(path)


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of unsigned axes (rows x dimensions, each below 2**bits)."""
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations, from the coarsest cell inward
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turned
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def token_signs(vocabulary: int) -> np.ndarray:
    """A sign for each token and dimension, by a fixed mixing of the id."""
    with np.errstate(over="ignore"):
        h = np.arange(1, vocabulary + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.stack([((h >> np.uint64(7 * i + 3)) & np.uint64(1)).astype(np.int32) * 2 - 1 for i in range(DIMS)])


def document_keys(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, signs: np.ndarray) -> np.ndarray:
    means = np.stack([np.add.reduceat(s[ids], starts) for s in signs], axis=1) / lengths[:, None]
    return hilbert_key(np.minimum((means + 1) * (1 << (BITS - 1)), (1 << BITS) - 1), BITS)


def tokenised(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str) -> DataFrame:
    """id, Hilbert key, number of tokens and their bytes for each row of df; the end token is the last."""

    def encode(batches):
        encoder = text_encoder(tokenizer_path)
        signs, end = token_signs(max(END_ID + 1, encoder.full.get_vocab_size())), np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                data = [x + end for x in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                lengths = np.array([len(x) for x in data]) // encoder.kind.itemsize
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                keys = document_keys(np.frombuffer(b"".join(data), encoder.kind), starts, lengths, signs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()), pa.array([encoder.kind.itemsize] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["id", "key", "n", "width", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(encode), f"id {rows.schema['id'].dataType.simpleString()}, key long, n long, width int, ids binary").withColumn("row", F.monotonically_increasing_id())


def along_curve(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` in ranges of the curve, each with its range and the number of tokens before it in the range."""
    kind = tokens.schema["id"].dataType.simpleString()
    size = tokens.agg(F.sum(F.col("n") * F.col("width")).alias("n")).first()["n"] or 0
    dealt = tokens.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), "key", "id", "row").sortWithinPartitions("key", "id", "row").select("id", "n", "width", "ids")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], names=["id", "n", "width", "ids", "range", "before"])
            before = int(ends[-1]) if len(n) else before

    return dealt.mapInArrow(tidy(run), f"id {kind}, n long, width int, ids binary, range int, before long")


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, scratch: Scratch, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of df's documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, width and ids (bytes)."""
    tokens = scratch.keep(tokenised(df, id_col, text_col, tokenizer_path), "tokens", "zstd")
    curve = scratch.keep(along_curve(tokens), "curve", "zstd")
    scratch.drop("tokens")
    sums = curve.groupBy("range").agg(F.sum("n").alias("held"))  # a row for each range
    bases = sums.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    joined = curve.join(F.broadcast(bases), "range").select("id", "n", "width", "ids", (F.col("base") + F.col("before")).alias("place"))

    def cut(batches):
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                take, out = [], []
                for i, (n, width, data, place) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 5)))):
                    ids, start = np.frombuffer(data, f"<u{width}"), 0
                    while start < n:
                        length = min(n - start, sequence - (place + start) % sequence)
                        piece = ids[start : start + length]
                        out.append((start, length, zlib.crc32(piece.astype("<u4").tobytes()), n, (place + start) // sequence, (place + start) % sequence, width, piece.tobytes()))
                        take.append(i)
                        start += length
                columns = list(zip(*out))
                kinds = [*[pa.int64()] * 6, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "width", "ids"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(tidy(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, width int, ids binary").withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens (array of ids, padded unless their number is a power of two) of what ``pack`` returned. A group is one sequence."""

    def build(key, frame):
        import pandas as pd

        frame = frame.sort_values("offset")
        ids = np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(frame["ids"], frame["width"])])
        n = len(ids)
        if n & (n - 1):
            ids = np.pad(ids, (0, sequence - n), constant_values=pad_id)
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [n], "tokens": [ids]})

    return pieces.select("sequence_id", "offset", "width", "ids").groupBy("sequence_id").applyInPandas(build, "sequence_id long, n_tokens long, tokens array<int>")
