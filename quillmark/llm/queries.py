"""Queries over the whole tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import DATE, audit, write_archive
from .ball_clusters import ball_kmeans
from .decontamination import contaminated
from .infilling import digests, fill_in_middle
from .languages import fit, held_out, identify
from .licenses import scan_licenses
from .near_dups import components, fingerprints
from .packing import pack_pieces, pieces
from .privacy import find_private
from .storage import new_path
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .token_files import file_digests, write_token_files
from .vector_search import nearest


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The byte-level BPE file that the queries count, pack and write with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the rows that aren't held out; which those are is told from the id, after the prediction."""
    docs = _read(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out()))).withColumn("held_out", held_out())


def op3_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(fingerprints(_read(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one new cache: the first one encodes all distinct texts, the second one finds their stored counts."""
    docs, cache = _read(spark, sf_dir, "documents"), new_path(spark, "token-cache")
    count_tokens(docs, tokenizer_path(), cache)
    return count_tokens(docs, tokenizer_path(), cache)


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages in which some were changed, some lost and some added, by their ids."""
    pages, path = _read(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc")
    i = F.col("page_id")
    changed = F.when(i % 97 == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("#"))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(i % 101 != 7, F.lit(True))).withColumn("html", changed)
    write_archive(replica.unionByName(pages.where(i % 103 == 11).withColumn("page_id", (i + 1_000_000_000).cast(pages.schema["page_id"].dataType))), path)
    return audit(pages, path)


def _op6_records(name: str, source: str) -> str:
    return f"""{name}_bodies AS (SELECT page_id, coalesce(html, '') AS body, regexp_replace(coalesce(url, ''), '[\x00-\x1F]', '%20', 'g') AS url FROM {source}),
{name}_records AS (
    SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>'
        || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
        || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || body AS record FROM {name}_bodies),
{name}_digests AS (SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM {name}_records),
{name} AS (
    SELECT page_id, row_number() OVER o - 1 AS rank, CAST(sum(length + 4) OVER o - length - 4 AS BIGINT) AS "offset", length, digest
    FROM {name}_digests WINDOW o AS (ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_OP6_NAMES = [f"name{k}" for k in range(1, 9)]
_OP6_LEVELS = "".join(
    f", level{k} AS (SELECT {', '.join(_OP6_NAMES[k - 1 :])}, min(first) AS first, sha256(string_agg(digest, '' ORDER BY first)) AS digest FROM level{k - 1} GROUP BY {', '.join(_OP6_NAMES[k - 1 :])})" for k in range(1, 9)
)
_OP6_SQL = f"""
WITH replica_pages AS (
    SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN coalesce(html, '') || '#' ELSE html END AS html FROM pages WHERE coalesce(page_id % 101 <> 7, true)
    UNION ALL SELECT page_id + 1000000000, url, html FROM pages WHERE page_id % 103 = 11),
{_op6_records('leaves', 'pages')}, {_op6_records('found', 'replica_pages')},
keyed AS (SELECT *, md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), digest, CAST(row_number() OVER (PARTITION BY page_id, digest ORDER BY rank) - 1 AS VARCHAR))) AS h FROM leaves),
opened AS (SELECT *, length(h) - length(rtrim(h, '0')) AS lv, CAST('0x' || left(h, 15) AS BIGINT) AS name FROM keyed),
level0 AS (SELECT rank AS first, digest, {', '.join(f"coalesce(last_value(CASE WHEN lv >= {k} THEN name END IGNORE NULLS) OVER o, 0) AS name{k}" for k in range(1, 9))} FROM opened WINDOW o AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)){_OP6_LEVELS},
top AS (SELECT sha256(string_agg(digest, '' ORDER BY first)) AS root FROM level8)
SELECT page_id, rank, "offset", length, digest, CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'differs' ELSE 'intact' END AS state, root FROM leaves, top
UNION ALL SELECT page_id, NULL, "offset", length, digest, 'extra', root FROM found, top WHERE page_id >= 1000000000
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(pieces(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(_read(spark, sf_dir, "documents"), path, tokenizer_path())
    return file_digests(spark, path)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(_read(spark, sf_dir, "documents")))


_OP11_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(length(text) AS BIGINT) AS n, {draws} FROM rows),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, left(text, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""".format(draws=", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4)))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(_read(spark, sf_dir, "embeddings"))


def _op12_round(r: int) -> str:
    return f"""
near{r} AS MATERIALIZED (SELECT row, min({{'d': CAST(list_sum(list_transform(list_zip(kept.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.c}}) AS best FROM kept, centroids{r} AS c GROUP BY row),
sums{r} AS (SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM near{r} JOIN kept USING (row), range(1, 65) AS t(i) GROUP BY ALL),
centroids{r + 1} AS MATERIALIZED (
    SELECT old.c, coalesce(new.x, old.x) AS x FROM centroids{r} AS old
    LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{r} GROUP BY c) AS new USING (c))"""


_OP12_SQL = f"""
WITH finite AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64),
kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM finite),
starts AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM kept),
centroids0 AS MATERIALIZED (SELECT c, x FROM starts WHERE c < 40),{','.join(_op12_round(r) for r in range(6))},
done AS (SELECT vec_id, best.c AS c, best.d AS d FROM near5 JOIN kept USING (row))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(centroids5.x, ',')) AS centroid_sha256 FROM done JOIN centroids5 USING (c)
"""


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_simhash_near_dups": op3_simhash_near_dups,
        "op4_private_data": op4_private_data,
        "op5_token_counts": op5_token_counts,
        "op6_merkle_audit": op6_merkle_audit,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_token_files": op8_token_files,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_multiprobe_search": op10_multiprobe_search,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_ball_kmeans": op12_ball_kmeans,
        "op13_suffix_array_dedup": op13_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_merkle_audit": _OP6_SQL, "op11_fill_in_middle": _OP11_SQL, "op12_ball_kmeans": _OP12_SQL}
