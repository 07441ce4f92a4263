"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chroma_fingerprint import align
from .jaccard_join import jaccard_components
from .language_id import held_out, identify_languages, learn
from .license_scan import oracle as license_oracle
from .license_scan import scan_licenses
from .packing import pack
from .piece_lattice import decode_ids, encode_texts, load_pieces
from .secrets_scan import scan_secrets
from .shared import Scratch, table
from .sharding import shard_documents
from .topk_search import search_top_k
from .url_filter import filter_urls

# The rules of op8, (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), Scratch(spark, "packing")).drop("width", "ids")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, Scratch(spark, "topk"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are no recordings among the tables: the UTF-8 bytes of documents are played as 8-bit samples. All pairs vote."""
    return align(table(spark, sf_dir, "documents"), "doc_id", "text", Scratch(spark, "chroma"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, or conv_id and turn, n_ids, ids, best_ids and best_score (of the best path) and decoded_sha256, the digest of the text that the ids decode to, of documents and conversations."""
    keys, pieces = ["doc_id", "conv_id", "turn"], load_pieces(tokenizer_path("piece_bpe_32k.model"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), allowMissingColumns=True)
    encoded = encode_texts(texts, keys, "text", pieces, Scratch(spark, "pieces"))
    kept = [*keys, "n_ids", "ids", "best_ids", "best_score"]
    return decode_ids(encoded, kept, "ids", pieces).select(*kept, F.sha2("text", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"), 8)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, "page_id", "url")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", Scratch(spark, "jaccard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    return identify_languages(docs, dictionaries, "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_licenses": op2_licenses,
        "op3_packing": op3_packing,
        "op4_topk": op4_topk,
        "op5_chroma": op5_chroma,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_sharding": op7_sharding,
        "op8_url_filter": op8_url_filter,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": license_oracle(),
        "op4_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
        "op9_jaccard_join": r"""
            WITH RECURSIVE w AS (
              SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
            sets AS (
              SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
            counted AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(0))) AS d, s FROM sets),
            class AS (SELECT min(doc_id) AS c, any_value(n) AS n, any_value(s) AS s, d FROM counted WHERE n > 0 GROUP BY d),
            x AS (SELECT c, n, unnest(s) AS s FROM class),
            rare AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
            y AS (SELECT c, n, hash(s) AS s FROM x WHERE s IN (SELECT s FROM rare)),
            links AS (
              SELECT a.c AS a, b.c AS b FROM y a JOIN y b ON a.s = b.s AND a.c < b.c AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
              GROUP BY a.c, b.c, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
            both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(c, r) AS (SELECT c, c FROM class UNION SELECT reach.c, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
            ends AS (SELECT c, min(r) AS component FROM reach GROUP BY c)
            SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
            FROM counted LEFT JOIN (SELECT d, component FROM class JOIN ends USING (c)) k ON counted.d = k.d AND counted.n > 0""",
        "op8_url_filter": r"""
            WITH p AS (
              SELECT page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
              ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
            m AS (
              SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
              FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
            SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    }
