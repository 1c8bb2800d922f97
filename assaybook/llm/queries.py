"""The registered queries of the operators and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.session import tune

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_exact_dedup(spark, sf_dir):
    from .exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


ORACLE["op9_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""


@query
def op8_warc(spark, sf_dir):
    from .warc import page_records, read_warc, write_warc

    files = write_warc(table(spark, sf_dir, "pages"))
    return page_records(read_warc(spark, files, range_bytes=4 << 20, payloads=False))


ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
     b AS (SELECT page_id, x, cast(cast(unhex(sha1(x)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY x) AS latest FROM p)
SELECT page_id, cast(strlen(x) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + 16 * cast(substr(bits, 5 * i + 1, 1) AS INT)
           + 8 * cast(substr(bits, 5 * i + 2, 1) AS INT) + 4 * cast(substr(bits, 5 * i + 3, 1) AS INT) + 2 * cast(substr(bits, 5 * i + 4, 1) AS INT)
           + cast(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM b
"""


@query
def op10_minhash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("tk", "tk2")


ORACLE["op10_minhash"] = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN sides ON a = r)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""


@query
def op6_decontamination(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op6_decontamination"] = """
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
windows AS (
    SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS x
    FROM words WHERE kind = 'b' AND len(w) > 0),
places AS (
    SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x
    FROM words, (SELECT DISTINCT n FROM windows) WHERE kind = 'd' AND len(w) >= n),
met AS (SELECT id, i, p.n, item_id FROM places p JOIN windows v ON v.x = p.x AND v.n = p.n),
hit AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM met) GROUP BY 1),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, cast(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT w.id AS doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON h.id = w.id LEFT JOIN items i ON i.id = w.id WHERE kind = 'd'
"""


@query
def op3_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_language_id(spark, sf_dir):
    from .langid import fit, fold, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, only=fold() != 2)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_secrets(spark, sf_dir):
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


@query
def op1_substring_dedup(spark, sf_dir):
    from .substrings import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).withColumn("changed", F.col("n_removed") > 0)


@query
def op5_toxicity(spark, sf_dir):
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_licenses(spark, sf_dir):
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op11_token_files(spark, sf_dir):
    import public_tokenizers

    from .tokenfiles import read_token_files, token_digests, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(read_token_files(spark, files))


@query
def op12_centroids(spark, sf_dir):
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


_ROUND = """d{n} AS (SELECT v.row, v.q, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS d FROM v, c{n} c),
a{n} AS (SELECT row, any_value(q) AS q, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY row)"""
_MOVE = """s{n} AS (SELECT c, i, cast(floor(sum(q[i]) / count(*)) AS BIGINT) AS x FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{m} AS (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{n} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM s{n} GROUP BY c) n ON n.c = c.c)"""
ORACLE["op12_centroids"] = f"""
WITH v AS (
    SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('1:' || cast(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 16)),
{_ROUND.format(n=0)}, {_MOVE.format(n=0, m=1)}, {_ROUND.format(n=1)}, {_MOVE.format(n=1, m=2)}, {_ROUND.format(n=2)}, {_MOVE.format(n=2, m=3)}, {_ROUND.format(n=3)}
SELECT v.vec_id, cast(a.c AS INT) AS cluster, cast(a.d AS BIGINT) AS distance, cast(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       cast(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a3 a ON a.row = v.row JOIN c3 c ON c.c = a.c
"""


@query
def op13_infill(spark, sf_dir):
    from .infill import fill_in_middle, infill_digests

    return infill_digests(fill_in_middle(table(spark, sf_dir, "documents")))


ORACLE["op13_infill"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || cast(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, cast('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, cast('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
        CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR cast('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
             WHEN cast('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j FROM u),
s AS (SELECT *, substr(x, 1, i) AS pre, substr(x, i + 1, j - i) AS mid, substr(x, j + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM s
"""
