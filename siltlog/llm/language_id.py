"""Language by compression: the zstandard dictionary of which language packs a text best?

A bounded sample of labelled texts (SAMPLE_DOCS a language, the first by hash of id) becomes one raw-content
dictionary of DICT_BYTES for each language. A text is normalised (lower case, only letters, single spaces), cut into
pieces of CHUNK bytes (so that a long text doesn't become its own dictionary), and every piece of the whole text is
compressed with every dictionary. The language with the smallest sum wins, ties to the one with most labelled documents,
then to the first by name.
The score is 1 - smallest / next smallest, 0 to 1; under MIN_MARGIN the text is rejected, though its language is given.

Cases: null texts and texts without a letter are ``und`` with score 0, and rejected; with one learned language the
score is 1; with none, every text is ``und``; null labels are never learned from; repeated rows are judged alike;
empty tables give empty results; other columns are dropped by name before any are added.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy

#: The sample that is learned from, by default (arguments of ``learn``): documents a language, characters that are read of each, and bytes
#: of a dictionary, to which every sampled document gives a like share of its beginning. At most MAX_LANGS languages.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, MAX_LANGS = 96, 8192, 64 * 1024, 256
CHUNK, LEVEL, MIN_MARGIN = 1024, 8, 0.002
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int | None = None, sample_chars: int | None = None, dict_bytes: int | None = None, max_langs: int | None = None) -> dict[str, bytes]:
    """A dictionary for each language in df, from a bounded sample of its documents (by default, of SAMPLE_DOCS); the commonest language first."""
    sample_docs, sample_chars = SAMPLE_DOCS if sample_docs is None else sample_docs, SAMPLE_CHARS if sample_chars is None else sample_chars
    dict_bytes, max_langs = DICT_BYTES if dict_bytes is None else dict_bytes, MAX_LANGS if max_langs is None else max_langs
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(labelled.groupBy(lang_col).count().limit(max_langs + 1).collect())
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    ids = labelled.select(id_col, lang_col).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample_docs).select(id_col).distinct()
    picked = labelled.join(F.broadcast(ids), id_col, "left_semi").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample_docs)
    rows = picked.select(lang_col, "_rank", F.substring(text_col, 1, sample_chars)).collect()
    texts: dict[str, dict[str, None]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if has_letter(text):
            texts.setdefault(lang, {})[normalised(text)] = None
    # a share of each text, so that one long text doesn't fill a dictionary
    share = {k: max(256, dict_bytes // len(v)) for k, v in texts.items()}
    return {k: b" ".join(t.encode()[: share[k]] for t in texts[k])[:dict_bytes] for k in sorted(texts, key=lambda k: (-counts[k], k))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.packers = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            fixed = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionaries[lang]), write_content_size=False, write_checksum=False, write_dict_id=False)
            raw.precompute_compress(compression_params=fixed)
            self.packers.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=fixed))

    def sizes(self, text: str) -> list[int]:
        data = normalised(text).encode("utf-8", "replace")
        pieces = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.packers]

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        sizes = self.sizes(text)
        best, second = sorted(sizes)[:2]
        return self.langs[sizes.index(best)], 1 - best / second if second else 0.0


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _judged(df: DataFrame, dictionaries: dict[str, bytes], text_at: int, keep: Sequence[int], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns ``keep`` of df with lang_pred, score and rejected."""
    names, schema = [df.columns[i] for i in keep], df.schema
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def judge(batches):
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.judge(t) for t in batch.column(text_at).to_pylist()]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            gone = pa.array([x == "und" or y < min_margin for x, y in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lang, score, gone], names=[*names, "lang_pred", "score", "rejected"])

    out = [schema[i] for i in keep]
    return df.mapInArrow(tidy(judge), T.StructType([*out, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], id_col: str, text_col: str, min_margin: float = MIN_MARGIN) -> DataFrame:
    """id_col, held_out, lang_pred, score and rejected of each row of df."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return _judged(rows, dictionaries, 1, [0], min_margin).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text_col: str, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of df whose language isn't rejected, with df's columns."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    judged = _judged(plain, dictionaries, names.index(text_col), range(len(names)), min_margin)
    return judged.where(~F.col("rejected")).drop("lang_pred", "score", "rejected").toDF(*names)
