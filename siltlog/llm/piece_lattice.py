"""SentencePiece encoding and decoding as a relational lattice.

A text becomes segments: the meta symbol for spaces begins a word, as no piece has it after another character, and a word is cut
between any two characters that no piece has next to each other. So no piece reaches over a segment's end. Each distinct segment's
substrings of bounded length are exploded and equi-joined to the piece table; what is found are its edges, grouped by segment; higher-order
aggregates fold them. Viterbi gives the best path over scores, its ids and its score. For a unigram model that is the
encoding. For a BPE model it isn't what the model means: there, a second fold merges, step by step, the neighbours whose joint
edge has the highest score, and gives the ids; the best path stands beside them. Characters without a piece become byte pieces.
Segments of more than FOLDED characters (long runs of letters without a space) are folded by a heap and a running best,
in time that follows their length, instead of by aggregates, whose states would be copied at each step; that is done where they stand.
Texts are cut, and look their segments' codes up, over arrays, many at once: up to FREQUENT codes are broadcast, of the segments that are most
frequent in a sample. A text that has others asks, under its 64-bit hash,
for the codes of its distinct ones by a join, and is read again to meet them, packed; so no occurrence of a segment is shuffled, and no text is
written but by that one shuffle. A text with many copies asks once. One of the texts
of a hash asks for all of them; should two texts differ, the query fails for want of a code instead of giving a wrong one.

Cases: null and empty texts have no ids; segments of any length are folded whole; repeated rows are encoded each; an empty
table gives an empty result; other columns are dropped by name before any are added.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, keep_ids, shuffles_removed, tidy

SPACE = "▁"
#: Segments whose codes are broadcast, at most: a fixed number; they are some 20 MB.
FREQUENT = 100_000
#: The longest segment that is folded by aggregates.
FOLDED = 64
#: Counts of segments fall into so many classes for each factor e; the classes tell which segments are frequent.
_STEPS = 8
#: One text in so many, by hash, is read for that.
SAMPLED = 8
_CACHE = 100_000
#: Bytes of text that are cut at once, some; a longer text is cut whole.
_STRETCH = 1 << 19
_FLOAT, _DOUBLE = struct.Struct("<f").unpack_from, struct.Struct("<d").unpack_from
CODES = "ids array<int>, best array<int>, score double"


@dataclass(frozen=True)
class Pieces:
    """A model's normal pieces with ids and scores, and the id of byte 0 (None: no byte pieces; then unknown_id)."""

    rows: tuple[tuple[str, int, float], ...]
    byte_base: int | None
    unknown_id: int
    is_bpe: bool
    dummy_prefix: bool = True

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rows = tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in normal)
    scores = [s for _, _, s in rows]
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in rows):
        raise ValueError("a piece goes on after a space: words can't be encoded apart")
    return Pieces(rows, next((i for i in ids if sp.is_byte(i)), None), sp.unk_id(), all(s == round(s) for s in scores))


class Cutter:
    """The segments of a text."""

    def __init__(self, pieces: Pieces):
        self.joined = frozenset(p[i : i + 2] for p, _, _ in pieces.rows for i in range(len(p) - 1))
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.prefix = SPACE if pieces.dummy_prefix else ""

    def cut(self, word: str) -> list[str]:
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def split(self, text: str | None) -> list[str]:
        """The words of a text, each with the spaces before it."""
        return self.words(self.prefix + text.replace(" ", SPACE)) if text else []

    def __call__(self, text: str | None) -> list[str]:
        return [x for word in self.split(text) for x in self.cut(word)]


class Spans:
    """The segments of many texts at once: what Cutter gives text by text, found in arrays of code points."""

    def __init__(self, pieces: Pieces):
        pairs = {p for p in Cutter(pieces).joined if p[1] != SPACE or p[0] == SPACE}
        chars = sorted({c for p in pairs for c in p})
        self.prefix, self.most, at = " " if pieces.dummy_prefix else "", len(chars) + 1, {c: i + 1 for i, c in enumerate(chars)}
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = range(1, self.most)
        self.classes[ord(" ")] = at.get(SPACE, 0)
        self.keys = np.array(sorted(at[p[0]] * self.most + at[p[1]] for p in pairs), np.int64)
        self.table = None
        if self.most**2 <= 1 << 26:
            self.table = np.zeros(self.most**2, bool)
            self.table[self.keys] = True

    def __call__(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct segments, the places there of all segments, and where those of each text begin and end."""
        own = [self.prefix + t.replace(SPACE, " ") if t else "" for t in texts]
        sizes, whole = np.cumsum([0, *map(len, own)]), "".join(own)
        if not whole:
            return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(len(own) + 1, np.int64)
        points, data = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
        kinds = self.classes[points]
        pairs = kinds[:-1] * self.most + kinds[1:] if self.table is not None else kinds[:-1].astype(np.int64) * self.most + kinds[1:]
        begins = np.ones(len(points), bool)
        begins[1:] = ~(self.table[pairs] if self.table is not None else np.isin(pairs, self.keys))
        begins[sizes[:-1][sizes[:-1] < len(points)]] = True
        starts = np.flatnonzero(begins)
        ends = np.searchsorted(starts, sizes)
        if len(data) != len(points):
            widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            starts = (np.cumsum(widths, dtype=np.int64) - widths)[starts]
        offsets = np.append(starts, len(data))
        small = len(data) < 1 << 31
        kind = pa.StringArray if small else pa.LargeStringArray
        found = kind.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32 if small else np.int64)), pa.py_buffer(data)).dictionary_encode()
        return pc.replace_substring(found.dictionary, " ", SPACE).cast(pa.string()), found.indices.to_numpy(), ends


def stretches(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows of some ``most`` in sum, a row at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0))
    cuts = np.unique([0, *cuts, len(sizes)]).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def counted(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """word and n of the segments up to FOLDED characters of a column of texts: sums over stretches of rows, not yet added up."""

    def count(batches):
        spans, words = Spans(pieces), Counter()

        def found():
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            column = batch.column(0)
            for a, b in stretches(_sizes(column), _STRETCH):
                segments, at, _ = spans(column.slice(a, b - a).to_pylist())
                for x, n in zip(segments.to_pylist(), np.bincount(at, minlength=len(segments)).tolist()):
                    if len(x) <= FOLDED:
                        words[x] += n
                if len(words) > 2 * _CACHE:
                    yield found()
        yield found()

    return texts.mapInArrow(tidy(count), "word string, n long")


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lattice(words: DataFrame, pieces: Pieces, unknown_score: float) -> DataFrame:
    """The columns of ``words``, dealt by their distinct ``word``; their ways, the edges from start to end with score and id (null: a character
    without a piece, which costs unknown_score); and edges, those with an id, as a map from start * (longest + 1) + length."""
    table = words.sparkSession.createDataFrame(list(pieces.rows), "_piece string, id int, score double")
    columns, wide = words.columns, pieces.longest + 1
    each = words.withColumn("_start", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    each = each.withColumn("_size", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("word") - F.col("_start")))))
    each = each.withColumn("_piece", F.col("word").substr(F.col("_start") + 1, F.col("_size")))
    found = each.join(F.broadcast(table), "_piece", "left").where("id is not null or _size = 1")
    way = F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_size")).alias("end"), F.coalesce("score", F.lit(float(unknown_score))).alias("score"), "id")
    rows = found.groupBy(*columns).agg(F.collect_list(way).alias("ways"))
    known = F.filter("ways", lambda w: w["id"].isNotNull())
    edges = F.map_from_entries(F.transform(known, lambda w: F.struct((w["start"] * wide + w["end"] - w["start"]).alias("at"), F.struct(w["score"].alias("score"), w["id"].alias("id")).alias("edge"))))
    return rows.withColumn("edges", edges)


def _edge(start: Column, end: Column, wide: int) -> Column:
    return F.when(end - start < wide, F.try_element_at(F.col("edges"), start * wide + (end - start)))


def merge_fold(pieces: Pieces) -> Column:
    """The ends of a word's pieces, from 0, after all merges; the leftmost of equal scores first.

    The state holds the ends, and of each pair of neighbours the score of their joint edge; a merge changes two of these.
    """
    wide, never, n = pieces.longest + 1, F.lit(float("-inf")), F.length("word")
    score = lambda a, b: F.coalesce(_edge(a, b, wide)["score"], never)
    none = F.array().cast("array<double>")
    state = lambda cuts, gain: F.struct(cuts.alias("cuts"), gain.alias("gain"))

    def merged(s: Column, p: Column) -> Column:
        """After a merge of pair p, from 1."""
        cuts, gain = s["cuts"], s["gain"]
        cut = lambda k: F.get(cuts, k.cast("int"))
        left = F.when(p > 1, F.array(score(cut(p - 2), cut(p + 1)))).otherwise(none)
        right = F.when(p < F.size(gain), F.array(score(cut(p - 1), cut(p + 2)))).otherwise(none)
        q = p.cast("int")
        return state(F.concat(F.slice(cuts, F.lit(1), q), F.slice(cuts, q + 2, F.size(cuts))), F.concat(F.slice(gain, F.lit(1), F.greatest(q - 2, F.lit(0))), left, right, F.slice(gain, q + 2, F.size(cuts))))

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(s["gain"])
        # an array of one element binds the place of the best pair, so that it is sought once
        return F.when(best > never, F.get(F.transform(F.array(F.array_position(s["gain"], best)), lambda p: merged(s, p)), F.lit(0))).otherwise(s)

    first = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda j: score(j, j + 2))).otherwise(none)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), state(F.sequence(F.lit(0), n), first), step)["cuts"]


def viterbi_fold() -> Column:
    """score of the best path and the ends of its pieces (cuts), from 0, over the ``ways`` of a lattice."""
    state = lambda best, back: F.struct(best.alias("best"), back.alias("back"))

    def step(s: Column, end: Column) -> Column:
        ways = F.transform(F.filter("ways", lambda w: w["end"] == end), lambda w: F.struct((F.get(s["best"], w["start"]) + w["score"]).alias("s"), (-w["start"]).alias("a")))
        # an array of one element binds the best way, so that it is sought once
        return F.get(F.transform(F.array(F.array_max(ways)), lambda t: state(F.array_append(s["best"], t["s"]), F.array_append(s["back"], -t["a"]))), F.lit(0))

    n = F.length("word")
    first = state(F.array(F.lit(0.0)), F.array(F.lit(0)))

    def finish(done: Column) -> Column:
        # from the end back to 0: each step puts the start of the last piece before what is known
        cuts = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(F.array_prepend(cuts, F.get(done["back"], F.get(cuts, F.lit(0))))))
        return F.struct(F.get(done["best"], n).alias("score"), cuts.alias("cuts"))

    return F.aggregate(F.sequence(F.lit(1), n), first, step, finish)


def _ids(pieces: Pieces, cuts: str) -> Column:
    """ids of the pieces between ``cuts``, with byte pieces for characters that have none."""
    wide = pieces.longest + 1

    def of(known: Column, j: Column) -> Column:
        a, b = F.get(cuts, j), F.get(cuts, j + 1)
        data = F.hex(F.encode(F.substring(F.col("word"), a + 1, b - a), "utf-8"))
        if pieces.byte_base is None:
            other = F.array(F.lit(pieces.unknown_id))
        else:
            other = F.transform(F.sequence(F.lit(1), (F.length(data) / 2).cast("int")), lambda i: (F.conv(F.substring(data, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + pieces.byte_base))
        return F.when(known.isNotNull(), F.array(known)).otherwise(other)

    # an array of one element binds the ids, so that they are sought once; bytes are asked for only where one is missing
    places = F.sequence(F.lit(0), F.size(cuts) - 2)
    found = F.transform(places, lambda j: _edge(F.get(cuts, j), F.get(cuts, j + 1), wide)["id"])
    return F.get(F.transform(F.array(found), lambda ids: F.when(F.exists(ids, lambda i: i.isNull()), F.flatten(F.transform(ids, of))).otherwise(ids)), F.lit(0))


class LongFold:
    """The same two folds for one long segment, in time n log n and n."""

    def __init__(self, pieces: Pieces, unknown_score: float):
        self.pieces, self.unknown, self.longest = pieces, unknown_score, pieces.longest
        self.table = {p: (s, i) for p, i, s in pieces.rows}

    def _coded(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            if part in self.table:
                out.append(self.table[part][1])
            else:
                out += [self.pieces.unknown_id] if self.pieces.byte_base is None else [self.pieces.byte_base + b for b in part.encode()]
        return out

    def merged(self, word: str) -> list[int]:
        """Neighbours are merged, the highest score first, the leftmost of equal ones."""
        ends, after, before = list(range(1, len(word) + 1)), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            """The pair of the part that begins at i and the one after it."""
            if 0 <= i and after[i] < len(word) and (hit := self.table.get(word[i : ends[after[i]]])):
                heapq.heappush(heap, (-hit[0], i, ends[after[i]]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            # parts that have changed since: i was merged away, or it or its neighbour ends elsewhere
            if ends[i] < 0 or after[i] >= len(word) or ends[after[i]] != end or word[i:end] not in self.table:
                continue
            gone = after[i]
            ends[i], after[i], ends[gone] = end, after[gone], -1
            if after[i] < len(word):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        parts, i = [], 0
        while i < len(word):
            parts.append(word[i : ends[i]])
            i = after[i]
        return self._coded(parts)

    def best(self, word: str) -> tuple[list[int], float]:
        score, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            ways = []
            for a in range(max(0, end - self.longest), end):
                hit = self.table.get(word[a:end])
                if hit or end - a == 1:
                    ways.append((score[a] + (hit[0] if hit else self.unknown), -a))
            top = max(ways)
            score.append(top[0])
            back.append(-top[1])
        parts, end = [], len(word)
        while end:
            parts.append(word[back[end] : end])
            end = back[end]
        return self._coded(parts[::-1]), score[-1]

    def __call__(self, word: str) -> tuple[list[int], list[int], float]:
        best, score = self.best(word)
        return self.merged(word) if self.pieces.is_bpe else best, best, score


def unknown_score(pieces: Pieces) -> float:
    return min((s for _, _, s in pieces.rows), default=0.0) - 10


def encode_words(words: DataFrame, pieces: Pieces, unknown: float | None = None) -> DataFrame:
    """The columns of words, dealt by their distinct, not empty ``word`` of FOLDED characters at most; ids, best (the ids of the best path) and its score."""
    columns = words.columns
    rows = lattice(words, pieces, unknown_score(pieces) if unknown is None else unknown)
    rows = rows.withColumn("path", viterbi_fold()).withColumn("best_cuts", F.col("path.cuts"))
    best = _ids(pieces, "best_cuts")
    if pieces.is_bpe:
        return rows.withColumn("cuts", merge_fold(pieces)).select(*columns, _ids(pieces, "cuts").alias("ids"), best.alias("best"), F.col("path.score").alias("score"))
    return rows.select(*columns, best.alias("ids"), best.alias("best"), F.col("path.score").alias("score"))


def _packed(lists: pa.Array) -> list[bytes]:
    """The numbers of each list, four bytes each."""
    flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
    return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


class Compact:
    """A segment of FOLDED characters at most and its codes as few bytes: flags, three lengths less 1, score, text, ids and, if they differ, best ids."""

    def __init__(self, pieces: Pieces):
        top = max([pieces.unknown_id, (pieces.byte_base or 0) + 255, *(i for _, i, _ in pieces.rows)])
        self.kind, self.width = ("<u2", 2) if top < 1 << 16 else ("<i4", 4)

    def pack(self, word: str, ids: bytes, best: bytes, score: float) -> bytes:
        exact, data, less = struct.unpack("<f", struct.pack("<f", score))[0] == score, word.encode(), lambda x: np.frombuffer(x, "<i4").astype(self.kind).tobytes()
        own = b"" if best == ids else less(best)
        head = struct.pack("<BBBB" + "df"[exact], (not exact) | 2 * bool(own), len(data) - 1, len(ids) // 4 - 1, max(0, len(best) // 4 - 1), score)
        return head + data + less(ids) + own

    def parts(self, code: bytes) -> tuple[bytes, bytes, bytes, float]:
        """The segment's bytes, ids and best ids in the code's own width, and the score."""
        flags, size, n, m = code[:4]
        at = 13 + size if flags & 1 else 9 + size
        end = at + (n + 1) * self.width
        ids = code[at:end]
        return code[at - size - 1 : at], ids, code[end : end + (m + 1) * self.width] if flags & 2 else ids, (_DOUBLE if flags & 1 else _FLOAT)(code, 4)[0]

    def codes(self, codes: list[bytes]) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
        """ids, best ids and score of each segment."""
        parts = [self.parts(c) for c in codes]
        lists = []
        for k in (1, 2):
            flat, ends = np.frombuffer(b"".join([p[k] for p in parts]), self.kind).astype(np.int32), np.cumsum([0, *(len(p[k]) // self.width for p in parts)]).tolist()
            lists.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
        return {p[0].decode(): (ids, best, p[3]) for p, ids, best in zip(parts, *lists)}

    def unpack(self, code: bytes) -> tuple[str, tuple[bytes, bytes, float]]:
        word, ids, best, score = self.parts(code)
        whole = lambda x: np.frombuffer(x, self.kind).astype("<i4").tobytes()
        return word.decode(), (whole(ids), whole(best), score)


class Lists:
    """Lists of numbers end to end, with where each begins and how long it is."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))

    def picked(self, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The picked lists end to end, and where each ends, from 0."""
        sizes = self.sizes[picks]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[picks] - (ends - sizes), sizes) + np.arange(total)], np.concatenate([[0], ends])


class Coder:
    """Codes (ids, best ids, score) of many texts at once from those of their segments."""

    def __init__(self, pieces: Pieces, often: pa.Table):
        self.spans, self.long = Spans(pieces), LongFold(pieces, unknown_score(pieces))
        often = often.combine_chunks()
        word, ids, best, score = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in often.columns]
        self.place = {w: i for i, w in enumerate(word.to_pylist())}
        self.codes = [Lists(x.flatten().to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)) for x in (ids, best)]
        self.scores = score.to_numpy(zero_copy_only=False)

    def __call__(self, texts: list[str | None], own: dict | None = None) -> tuple[list[pa.Array], pa.Array]:
        """ids, best and score of each text, and its segments that neither are frequent nor in own (null: none); texts that lack some have no codes yet."""
        words, at, ends = self.spans(texts)
        segments, places, more, own = words.to_pylist(), np.empty(len(words), np.int64), [], own or {}
        known = len(self.place)
        for i, x in enumerate(segments):
            p = self.place.get(x)
            if p is None:
                code = own.get(x)
                if code is None and len(x) > FOLDED:
                    ids, best, score = self.long(x)
                    code = np.array(ids, np.int32), np.array(best, np.int32), score
                p = -1
                if code is not None:
                    p = known + len(more)
                    more.append(code)
            places[i] = p
        picks, text = places[at], np.repeat(np.arange(len(texts)), np.diff(ends))
        lacks = np.zeros(len(texts), bool)
        lacks[text[picks < 0]] = True
        # each text's lacking segments, once each
        unique = np.unique(text[picks < 0] * max(1, len(words)) + at[picks < 0])
        rare = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(unique // max(1, len(words)), np.arange(len(texts) + 1)), pa.int32()), words.take(pa.array(unique % max(1, len(words)))), mask=pa.array(~lacks)
        )
        kept = ~lacks[text]
        picks, ends = picks[kept], np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=len(texts)))])
        out = []
        for k, codes in enumerate(self.codes):
            if more:
                codes = codes + Lists(np.concatenate([c[k] for c in more]), np.array([len(c[k]) for c in more]))
            flat, stops = codes.picked(picks)
            out.append(pa.ListArray.from_arrays(pa.array(stops[ends], pa.int32()), pa.array(flat, pa.int32())))
        scores = np.concatenate([self.scores, [c[2] for c in more]])[picks]
        return [*out, pa.array(np.bincount(text[kept], scores, len(texts)), pa.float64())], rare


def frequent(counts: DataFrame, pieces: Pieces) -> pa.Table:
    """The codes of the most frequent words, FREQUENT at most: whole classes of counts from the top."""
    of = F.floor(F.log("n") * _STEPS)
    room, least = FREQUENT, None
    for row in counts.groupBy(of.alias("c")).count().orderBy(F.col("c").desc()).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["c"]
    words = counts.where("false" if least is None else of >= least).select("word")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return encode_words(words.repartition(parts, "word"), pieces).toArrow()


def encode_texts(df: DataFrame, keys: list[str], text_col: str, pieces: Pieces, scratch: Scratch) -> DataFrame:
    """The columns ``keys`` of df, n_ids and ids of each row, best_ids (of the best path) and best_score."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_digest"))
    # a sample says which segments are frequent; that places them, and leaves none out
    sample = rows.where(F.pmod("_digest", F.lit(SAMPLED)) == 0).select("_text")
    with shuffles_removed(spark):
        counts = scratch.keep(counted(sample, pieces).groupBy("word").agg(F.sum("n").alias("n")), "counts", "zstd")
        often = spark.sparkContext.broadcast(frequent(counts, pieces))
    scratch.drop("counts")
    done = T.StructType([*rows.schema.fields[: len(keys)], *T.StructType.fromDDL(f"{CODES}, _digest long, _row long, rare array<string>").fields])

    def first(batches):
        """Codes of texts all of whose segments are known; of the others, the segments that they lack."""
        coder, row = Coder(pieces, often.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(len(keys))
            for a, b in stretches(_sizes(texts), _STRETCH):
                codes, rare = coder(texts.slice(a, b - a).to_pylist())
                others = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*others[: len(keys)], *codes, others[len(keys) + 1], pa.array(np.arange(row, row + b - a)), rare], names=done.names)
                row += b - a

    met = scratch.keep(rows.mapInArrow(tidy(first), done), "met", "zstd")
    # one of all texts of a hash asks, and what it gets is a few bytes for each segment
    asking = met.where("rare is not null").select("_digest", "_row", "rare")
    with shuffles_removed(spark):
        firsts = scratch.keep(asking.groupBy("_digest").agg(F.min("_row").alias("_row")).select("_row"), "firsts", "zstd")
    lacking = keep_ids(asking, firsts, "_row").select("_digest", F.explode("rare").alias("word"))
    # segments cost much time for their bytes: they are dealt to all tasks, and encoded there
    words = lacking.select("word").repartition(parts, "word").distinct()
    compact = Compact(pieces)

    def shrink(batches):
        for batch in batches:
            columns = batch.column(0).to_pylist(), _packed(batch.column(1)), _packed(batch.column(2)), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compact.pack(*x) for x in zip(*columns)], pa.binary())], names=["word", "code"])

    with shuffles_removed(spark):
        codes = scratch.keep(encode_words(words, pieces).mapInArrow(tidy(shrink), "word string, code binary"), "codes", "zstd")
        # two statements, so that the first one's shuffle is gone when the second one's is written
        given = scratch.keep(lacking.join(codes, "word").select("_digest", "code"), "given", "zstd")
        scratch.drop("codes", "firsts")
        own = scratch.keep(given.groupBy("_digest").agg(F.collect_list("code").alias("own")), "own", "zstd")
    scratch.drop("given")

    def packed(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([pack(t or b"") for t in texts], pa.binary()), batch.column(len(keys) + 1)], names=small.names)

    small = T.StructType([*rows.schema.fields[: len(keys)], *T.StructType.fromDDL("_text binary, _digest long").fields])
    others = rows.mapInArrow(tidy(packed), small).join(own.hint("shuffle_hash"), "_digest").select(*keys, "_text", "own")
    final = T.StructType([*rows.schema.fields[: len(keys)], *T.StructType.fromDDL(CODES).fields])

    def second(batches):
        coder, unpack = Coder(pieces, often.value), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at, codes = batch.column(len(keys) + 1).offsets.to_pylist(), batch.column(len(keys) + 1).values
            texts = [unpack(x).decode() for x in batch.column(len(keys)).to_pylist()]
            for a, b in stretches(np.array([len(t) for t in texts]), _STRETCH):
                own = compact.codes(codes.slice(at[a], at[b] - at[a]).unique().to_pylist())
                found, rare = coder(texts[a:b], own)
                if rare.null_count < len(rare):
                    raise ValueError("texts of one hash differ: a segment has no code")
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keys)]), *found], names=final.names)

    out = met.where("rare is null").select(*keys, "ids", "best", "score").unionAll(others.mapInArrow(tidy(second), final))
    return out.select(*keys, F.size("ids").alias("n_ids"), "ids", F.col("best").alias("best_ids"), F.col("score").alias("best_score"))


def decode_ids(df: DataFrame, keys: list[str], ids_col: str, pieces: Pieces) -> DataFrame:
    """The columns ``keys`` of df and the text of their ids, row by row; ids that have no piece are skipped."""
    data = {i: p.encode() for p, i, _ in pieces.rows}
    if pieces.byte_base is not None:
        data |= {pieces.byte_base + b: bytes([b]) for b in range(256)}
    # the last entry, of nothing, is for all others
    known = [data.get(i, b"") for i in range(max(data, default=-1) + 1)] + [b""]
    rows = df.select(*keys) if ids_col in keys else df.select(*keys, ids_col)
    at, prefix = rows.columns.index(ids_col), pieces.dummy_prefix
    schema = T.StructType([*rows.schema.fields[: len(keys)], T.StructField("text", T.StringType())])

    def decode(batches):
        table = Lists(np.frombuffer(b"".join(known), np.uint8), np.array([len(x) for x in known]))
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in stretches(sizes, _STRETCH // 4):
                ids = pc.fill_null(lists.slice(a, b - a).flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, stops = table.picked(np.where((ids < 0) | (ids >= len(known)), len(known) - 1, ids))
                whole, ends = flat.tobytes(), stops[np.concatenate([[0], np.cumsum(sizes[a:b])])].tolist()
                texts = [whole[x:y].decode("utf-8", "replace").replace(SPACE, " ") for x, y in zip(ends[:-1], ends[1:])]
                texts = [t[1:] if prefix and t[:1] == " " else t for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keys)]), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(tidy(decode), schema)
