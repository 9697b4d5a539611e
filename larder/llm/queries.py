"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    decontaminate, exact_dedup, html_extract, language_id, ngram_join, packing, pii_crf, quality_gam, resample, simhash, token_files,
    toxicity_kn, zone_clusters,
)
from larder.llm.common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(read_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"""[x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> '']"""


def _shingles_sql(table: str, key: str) -> str:
    """Distinct word shingles (lists of words) of a table's texts: id, s."""
    return f"""SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                   ELSE [w[i:i + 4] for i in range(1, len(w) - 3)] END) AS s
               FROM (SELECT {key} AS id, {_WORDS} AS w FROM {table})"""


OP8_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}), b AS ({_shingles_sql("benchmark", "item_id")}),
     n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
     c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, n_common, n_common / n AS containment
FROM c JOIN n ON n.id = c.item_id WHERE 100 * n_common >= 80 * n
"""


OP3_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles_sql("documents", "doc_id")}),
     n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
     p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y USING (s) WHERE x.id < y.id GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b
                        WHERE 100 * k >= 80 * (na.n + nb.n - k)),
     e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT a AS v, a AS m FROM e UNION SELECT e.b AS v, r.m FROM r JOIN e ON e.a = r.v WHERE r.m < e.b),
     c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c.m, doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN c ON c.v = doc_id
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(pii_crf.find_personal_data(read_table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_kn.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.hex_print(F.col("fingerprint")))


def op13_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = zone_clusters.cluster_report(read_table(spark, sf_dir, "embeddings"))
    return report.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# Checksums in SQL: CRC-32 (reflected polynomial 0xEDB88320) over the bytes of every distinct feature, by a table made from the rule.
OP11_SQL = r"""
WITH RECURSIVE step AS (
       SELECT i, 0 AS k, i AS c FROM (SELECT cast(unnest(range(256)) AS bigint) AS i)
       UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
     crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
     d AS MATERIALIZED (
       SELECT side, doc_id, row_number() OVER () AS r, [x FOR x IN regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
       FROM (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
     f AS MATERIALIZED (
       SELECT side, doc_id, r, len(w) AS n_words, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))],
                [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS feature FROM d),
     b AS MATERIALIZED (
       SELECT feature, xor(list_reduce(list_prepend(4294967295, [cast(('0x' || h[2 * j + 1:2 * j + 2]) AS bigint) FOR j IN range(len(h) // 2)]),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
       FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f), crc),
     n AS MATERIALIZED (SELECT side, r, bucket, count(*) AS k FROM f JOIN b USING (feature) GROUP BY 1, 2, 3),
     sums AS (SELECT bucket, coalesce(sum(k) FILTER (side = 's'), 0) AS s, coalesce(sum(k) FILTER (side = 't'), 0) AS t FROM n GROUP BY 1),
     gains AS (SELECT bucket, cast(floor(1000 * ln(cast((t + 1) * (ss + 10000) AS double) / cast((s + 1) * (tt + 10000) AS double))) AS bigint) AS gain
               FROM sums, (SELECT sum(s) AS ss, sum(t) AS tt FROM sums)),
     weights AS (SELECT r, sum(k) AS n_features, sum(k * gain) AS weight FROM n JOIN gains USING (bucket) WHERE side = 's' GROUP BY 1),
     scored AS (
       SELECT doc_id, len(w) AS n_words, cast(coalesce(n_features, 0) AS bigint) AS n_features, cast(coalesce(weight, 0) AS bigint) AS weight,
              cast(coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(('0x' || sha256('42:' || coalesce(cast(doc_id AS varchar), ''))[1:8]) AS bigint)
                + 0.5::double) / 4294967296))) AS bigint) AS bigint) AS score
       FROM d LEFT JOIN weights USING (r) WHERE side = 's'),
     placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                       count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


def _op13_sql(rounds: int) -> str:
    parts = ["""v AS MATERIALIZED (SELECT vec_id, [cast(floor(256 * cast(x AS double)) AS bigint) FOR x IN embedding] AS v FROM embeddings
       WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs(x) > 524288]) = 0),
     x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM v),
     c0 AS MATERIALIZED (SELECT cluster, unnest(range(64)) AS i, unnest(v) AS c FROM (
       SELECT row_number() OVER (ORDER BY sha256('2:' || cast(vec_id AS varchar))) - 1 AS cluster, v FROM v QUALIFY cluster < 40))"""]
    for j in range(rounds + 1):
        parts.append(f"""a{j} AS MATERIALIZED (SELECT vec_id, cluster, cast(sum((x - c) * (x - c)) AS bigint) AS distance FROM x JOIN c{j} USING (i)
       GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if j < rounds:  # floored division of whole numbers
            parts.append(f"""c{j + 1} AS MATERIALIZED (SELECT cluster, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{j} LEFT JOIN (
       SELECT cluster, i, cast(sum(x) AS bigint) AS s, count(*) AS n FROM x JOIN a{j} USING (vec_id) GROUP BY 1, 2) USING (cluster, i))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cast(cluster AS integer) AS cluster, distance, cast(sum(distance) OVER (PARTITION BY cluster) AS bigint) AS cluster_inertia,
       cast(sum(distance) OVER () AS bigint) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(cast(c AS varchar), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY 1) USING (cluster)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii_crf": op6_pii_crf,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_simhash": op12_simhash,
    "op13_zone_clusters": op13_zone_clusters,
}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_zone_clusters": _op13_sql(5),
}
