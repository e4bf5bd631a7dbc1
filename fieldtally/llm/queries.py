"""The registered queries of these operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, idfiles, lattice, merkle, mixing, neardup, phrases, pii, quality, shards, urls, vafile
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_JSON = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def coded(docs: DataFrame) -> DataFrame:
    """Per document: number of ids, checksums of the ids and of what they decode to."""
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    made = bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return made.select(
        "doc_id", bpe.n_ids(F.col("coded.token_ids")).alias("n_tokens"), F.sha2("coded.token_ids", 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256")
    )


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir))


@query("op2_vector_shards")
def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.pack_shards(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "words")


@query("op3_pii_spans")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir), keep=("doc_id",))
    counts = [pii.n_of("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op4_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "quality.*")


@query("op5_phrase_fingerprints")
def phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(documents(spark, sf_dir))


@query("op6_near_duplicates")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_ids(*neardup.near_duplicates(documents(spark, sf_dir)))


@query("op7_lattice_scores")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(documents(spark, sf_dir), public_tokenizers.path(PIECES))


@query("op8_id_files")
def id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idfiles.id_folder(spark)
    manifest = idfiles.write_ids(documents(spark, sf_dir), path, public_tokenizers.path(BYTE_JSON), END_ID)
    back = idfiles.read_ids(spark, manifest, path)
    return back.select("doc_id", "start", bpe.n_ids(F.col("token_ids")).alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


@query("op9_pivotal_mix")
def pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.per_row(mixing.mix(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@query(
    "op10_url_trie",
    """
    WITH parts AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), split AS (
      SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
    ), hosts AS (
      SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
    ), ruled AS (
      SELECT page_id, host, path,
        CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
      FROM hosts
    )
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
           WHEN path LIKE '/%' AND regexp_matches('.' || host, '\\.(adult-x|casino-win|ads-track)\\.example\\.(com|org)$') THEN 'block'
           ELSE 'allow' END AS verdict
    FROM ruled
    """,
)
def url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages.select("page_id", "url")).select("page_id", "filtered.*")


@query(
    "op11_vector_approximation",
    """
    WITH fine AS (
      SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.ints, c.ints)]) AS BIGINT) AS score
      FROM fine q JOIN fine c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
)
def vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query(
    "op12_fill_in_middle",
    """
    WITH drawn AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents
    ), numbers AS (
      SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn
    ), cuts AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers
    ), parts AS (
      SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM cuts
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
             ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM parts
    """,
)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


@query(
    "op13_merkle_manifest",
    """
    WITH RECURSIVE coded AS (
      SELECT doc_id, source, text,
        [CASE WHEN v IS NULL THEN '-' ELSE CAST(strlen(v) AS VARCHAR) || ':' || v END FOR v IN
          [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, replace(text, chr(10), '')]] AS parts,
        -- CRC-32, bit by bit, of the decimal id
        xor(list_reduce([4294967295] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
          lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
      FROM documents
    ), rows_ AS (
      SELECT doc_id, source, sha256(array_to_string(parts[1:5], '')) AS leaf,
        sha256(array_to_string(CASE WHEN crc % 2 = 0 THEN parts[1:4] || parts[6:6] ELSE parts[1:5] END, '')) AS changed,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
      FROM coded
    ), t(source, level, pos, n, h) AS (
      SELECT source, 0, pos, n, leaf FROM rows_
      UNION ALL
      SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, level, pos // 3, n
    ), subroots AS (
      SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
    ), u(level, pos, n, h) AS (
      SELECT 0, pos, n, subroot FROM subroots
      UNION ALL
      SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n
    ), placed AS (SELECT r.*, s.subroot, s.pos AS spos FROM rows_ r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source),
    met AS (
      SELECT doc_id, level, t.pos AS spot, r.pos // CAST(power(3, level) AS BIGINT) AS own, h
      FROM placed r JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.n > 1 AND t.pos // 3 = r.pos // CAST(power(3, level + 1) AS BIGINT)
      UNION ALL
      SELECT doc_id, 100 + level, u.pos, spos // CAST(power(3, level) AS BIGINT), h
      FROM placed JOIN u ON u.n > 1 AND u.pos // 3 = spos // CAST(power(3, level + 1) AS BIGINT)
    ), steps AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) - 1 AS k,
        coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS before, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS after
      FROM met GROUP BY doc_id, level
    ), folds(doc_id, k, h) AS (
      SELECT doc_id, 0, changed FROM placed
      UNION ALL
      SELECT f.doc_id, f.k + 1, sha256(before || h || after) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k
    ), ends AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folds GROUP BY doc_id),
    proofs AS (SELECT doc_id, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY doc_id)
    SELECT p.doc_id, leaf, subroot, root.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root.h AS verified
    FROM placed p JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id) CROSS JOIN (SELECT h FROM u WHERE n = 1) AS root
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = merkle.document_manifest(documents(spark, sf_dir))
    as_text = lambda c: F.lower(F.hex(c))
    return merkle.checked(found, "changed").select(
        F.col("id").alias("doc_id"), as_text("leaf").alias("leaf"), as_text("subroot").alias("subroot"), as_text("root").alias("root"),
        F.sha2(as_text("proof"), 256).alias("proof_sha256"), as_text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
