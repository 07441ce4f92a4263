import random

from helpers import TEXTS, awkward, empty

from siltlog.llm import language_id as L

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "keit", "ein", "lich"], "fr": ["eaux", "ment", "que", "oir", "elle"]}


def sample(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 400))), lang))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(sample(400), "doc_id long, text string, lang string")
    model = L.learn(df.where(~L.held_out("doc_id")), "doc_id", "text", "lang")
    assert list(model) [0] == "en" and set(model) == set(SYLLABLES) and all(len(d) <= L.DICT_BYTES for d in model.values())
    rows = L.identify_languages(df, model, "doc_id", "text").join(df, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_sample_is_bounded_and_the_label_is_no_input(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCS", 3)
    df = spark.createDataFrame(sample(60), "doc_id long, text string, lang string")
    few = L.learn(df, "doc_id", "text", "lang")
    assert set(few) == set(SYLLABLES)
    a = L.identify_languages(df, few, "doc_id", "text").orderBy("doc_id").collect()
    b = L.identify_languages(df.withColumn("lang", df["text"]), few, "doc_id", "text").orderBy("doc_id").collect()
    assert a == b


def test_held_out_is_crc32(spark):
    import zlib

    for r in spark.range(50).select("id", L.held_out("id").alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1)


def test_awkward_rows(spark):
    model = L.learn(awkward(spark), "doc_id", "text", "lang")
    assert list(model) == ["en"]
    got = L.identify_languages(awkward(spark), model, "doc_id", "text").collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    for i, t in TEXTS:
        want = "und" if not t or not any(c.isalpha() for c in t) else "en"
        assert by[i]["lang_pred"] == want and by[i]["rejected"] == (want == "und")
    assert by[None]["held_out"] is False
    assert L.identify_languages(empty(spark), {}, "doc_id", "text").count() == 0
    assert {r["lang_pred"] for r in L.identify_languages(awkward(spark), {}, "doc_id", "text").collect()} == {"und"}
    kept = L.keep_identified(awkward(spark), model, "text")
    assert kept.schema == awkward(spark).schema
    assert kept.count() == sum(r["lang_pred"] != "und" for r in got)


def test_long_texts_are_read_whole():
    a, b = (" ".join(SYLLABLES[x] * 200) for x in ("en", "de"))
    model = L.Classifier({"en": (a[:2000]).encode(), "de": b[:2000].encode()})
    assert model.judge("the and " + b * 5)[0] == "de" and model.judge(b[:3000] + a * 5)[0] == "en"


def test_against_brute_force(spark):
    """Every text with every dictionary, by a compressor made anew for each piece."""
    import re

    import zstandard

    df = spark.createDataFrame(sample(90, 7) + [(200, "", None), (201, "12", None), (202, None, None)], "doc_id long, text string, lang string")
    model = L.learn(df.where(~L.held_out("doc_id")), "doc_id", "text", "lang", sample_docs=5, sample_chars=900, dict_bytes=4096)
    assert all(len(d) <= 4096 for d in model.values())

    def size(text, dictionary):
        raw, n = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), 0
        how = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw.precompute_compress(compression_params=how)
        data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
        while data:
            n, data = n + len(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress(data[: L.CHUNK])), data[L.CHUNK :]
        return n

    got = {r["doc_id"]: r for r in L.identify_languages(df, model, "doc_id", "text").collect()}
    for r in df.collect():
        one = got[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (one["lang_pred"], one["score"], one["rejected"]) == ("und", 0.0, True)
            continue
        sizes = [(size(r["text"], d), at, lang) for at, (lang, d) in enumerate(model.items())]
        (least, _, lang), (second, _, _) = sorted(sizes)[:2]
        assert one["lang_pred"] == lang and one["score"] == 1 - least / second and one["rejected"] == (one["score"] < L.MIN_MARGIN)
