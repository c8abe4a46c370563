"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import bpe, centroids, cover_tree, html_text, infill, langid, licenses, media, ngram_join, packing, substring, token_counts, winnow


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), ranks)
    decoded = bpe.decode_documents(encoded.select("doc_id", "ids"), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def ids_crc32(ids: str) -> Column:
    """CRC-32 of each id list as little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("long")
    def crc32_of_ids(lists: pa.Array) -> pa.Array:
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * 4
        data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        return pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64())

    return crc32_of_ids(ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(documents(spark, sf_dir), licenses.train())
    part = lambda name: F.transform("licences", lambda x: x[name])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(part("family"))), ",").alias("families"),
        F.array_max(part("confidence")).alias("confidence"),
        F.array_max(part("similarity")).alias("similarity"),
        F.transform("licences", lambda x: F.concat(x["family"], F.lit("@"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))).alias("places"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(langid.fold() != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(langid.fold() == 1, F.lit(True))  # without an id: not learned from
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), "language.languages")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.edited_against_next(documents(spark, sf_dir))
    sets = {f"{c}_set": winnow.hashes(F.col(f"{c}fingerprint")) for c in ("", "edited_", "next_")}
    return rows.withColumns(sets).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnow.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        winnow.likeness(F.col("_set"), F.col("edited__set")).alias("near_edited"),
        winnow.likeness(F.col("_set"), F.col("next__set")).alias("near_next"),
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(documents(spark, sf_dir))
    clip = lambda c: F.concat(c["start_s"].cast("string"), F.lit("-"), c["end_s"].cast("string"), F.lit(":"), c["mean"].cast("string"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", clip), ";").alias("feature"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), rule="largest")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeated(documents(spark, sf_dir), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(documents(spark, sf_dir), n=4, percent=85)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.similar_vectors(embeddings(spark, sf_dir), cosine=0.93)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("infill")
    return infill.infill_documents(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        *[x[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(x["output"], 256).alias("output_sha256"),
        F.sha2(infill.restored(x["output"], x["form"]), 256).alias("restored_sha256"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.centroid_clusters(embeddings(spark, sf_dir), k=40, rounds=5)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"[^\x20\x09-\x0D]+"
_OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g,
 lead(i, 19) OVER (PARTITION BY doc_id ORDER BY i) AS last_i FROM p),
v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM y WHERE last_i IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + j.range AS i FROM v, range(20) AS j WHERE rn > 1),
k AS (SELECT p.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS kept
 FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
_OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * both_have >= 85 * (na.n + nb.n - both_have)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) AS m ON m.a = d.doc_id"""


_OP11 = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND list_aggregate(list_transform(v, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_aggregate(list_transform(v, lambda x: abs(x)), 'max') > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id <= coalesce(m.b, vec_id) AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""
_GROUP = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, length(t) AS n, {_GROUP.format(1)} % (length(t) + 1) AS x, {_GROUP.format(9)} % (length(t) + 1) AS y FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_GROUP.format(17)} % 100 >= 90 THEN 'plain'
 WHEN {_GROUP.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
 ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def _op13() -> str:
    """Five rounds written out: nearest centroid, then floored means."""
    near = (
        "a{k} AS (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.vec_id, p.x, q.c, "
        "list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p, c{k} AS q) GROUP BY 1, 2)"
    )
    mean = (
        "s{k} AS (SELECT c, j, CAST(floor_div(sum(v), count(*)) AS BIGINT) AS v FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS j FROM a{k}) GROUP BY 1, 2), "
        "c{n} AS (SELECT q.c, coalesce(m.x, q.x) AS x FROM c{k} AS q LEFT JOIN (SELECT c, list(v ORDER BY j) AS x FROM s{k} GROUP BY 1) AS m ON m.c = q.c)"
    ).replace("floor_div(sum(v), count(*))", "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)")
    steps = [
        "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64)",
        "p AS (SELECT vec_id, list_transform(v, lambda y: CAST(floor(256 * y) AS BIGINT)) AS x FROM e WHERE list_aggregate(list_transform(v, lambda y: CASE WHEN y IS NULL OR NOT isfinite(y) THEN 1 ELSE 0 END), 'sum') = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, x FROM p QUALIFY c < 40)",
    ]
    for k in range(5):
        steps += [near.format(k=k), mean.format(k=k, n=k + 1)]
    steps.append(near.format(k=5))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a5.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.c = a5.c"""


def oracle_sql() -> dict[str, str]:
    """SQL of the exact operators; the others are held against brute force in the tests."""
    return {"op9_substring_dedup": _OP9, "op10_ngram_join": _OP10, "op11_embedding_near_dedup": _OP11, "op12_fill_in_middle": _OP12, "op13_centroid_clusters": _op13()}
