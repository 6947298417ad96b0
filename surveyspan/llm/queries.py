"""The registered queries of this folder and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surveyspan.llm import (
    byte_shards,
    exact_dedup,
    html_extraction,
    language_id,
    license_classifier,
    mixing,
    packing,
    pivot_simhash,
    ptolemaic_clusters,
    spelling_variants,
    structural_secrets,
    subspace_join,
    token_files,
)
from surveyspan.llm.tools import table


def op1_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural_secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op4_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards.shard_plan(table(spark, sf_dir, "documents"), n_shards=40)


def op6_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_salted_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_classifier.scan_licenses(table(spark, sf_dir, "documents"))


def op11_recurrent_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ptolemaic_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed=2)
    return found.drop("measured")


def op13_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tiered_packing,
        op2_structural_secrets,
        op3_range_coded_ids,
        op4_subspace_join,
        op5_byte_shards,
        op6_pivot_simhash,
        op7_subword_language,
        op8_salted_exact_dedup,
        op9_source_mixing,
        op10_license_classifier,
        op11_recurrent_extraction,
        op12_ptolemaic_clusters,
        op13_permuterm_variants,
    )
}

_OP8 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

# The level is found in one go: sources sorted by the level at which they stop. The draws are
# the words of the same digest that the operator uses.
_OP9 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS draws
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM s
),
o AS (
  SELECT *, 3 * source_size AS cap,
         row_number() OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST) AS i,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM w
),
p AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
            / (sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM o
),
l AS (SELECT level FROM p WHERE cap::DOUBLE > level * weight OR total = 0 ORDER BY i LIMIT 1),
r AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
         CASE WHEN source_size = 0 THEN 0 ELSE least(cap::DOUBLE, level * weight) / source_size END AS rate
  FROM o CROSS JOIN l
),
k AS (
  SELECT d.*, r.source_size, r.target,
         [floor(rate)::BIGINT + CASE WHEN ('0x' || substr(draws, 8 * x + 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate)
                                     THEN 1 ELSE 0 END FOR x IN range(8)] AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
),
e AS (
  SELECT source, x, abs(sum(copies[x] * size) - any_value(target)) AS error
  FROM k CROSS JOIN range(1, 9) AS c(x) GROUP BY source, x
),
b AS (SELECT source, x FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY error, x) = 1)
SELECT doc_id, size, source_size, target, (copies[x] * size)::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""



def _op12(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out. Inner products of integers stay exact in doubles here."""
    nearest = """a{0} AS (
  SELECT r, min(d) AS distance, arg_min(c, d * 1000 + c) AS c
  FROM (SELECT r, c, (list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m))::HUGEINT AS d
        FROM v CROSS JOIN c{0}) GROUP BY r
)"""
    mean = """c{1} AS (
  SELECT o.c, coalesce(any_value(n.m), any_value(o.m)) AS m
  FROM c{0} o LEFT JOIN (
    SELECT c, list(floor_mean::DOUBLE ORDER BY j) AS m
    FROM (SELECT c, j, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS floor_mean
          FROM (SELECT a.c, p.j, sum(v.v[p.j]::HUGEINT) AS s, count(*) AS n
                FROM a{0} a JOIN v USING (r) CROSS JOIN range(1, 65) AS p(j) GROUP BY a.c, p.j))
    GROUP BY c) n ON n.c = o.c GROUP BY o.c
)"""
    steps = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m
  FROM v QUALIFY c < {k}
)""",
    ]
    for i in range(rounds):
        steps += [nearest.format(i), mean.format(i, i + 1)]
    steps.append(nearest.format(rounds))
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.c
"""


# DuckDB has no crc32: a message's value is the XOR of what each byte contributes by its distance from the
# end and of a constant for the length, both from the polynomial.
_OP13 = r"""
WITH RECURSIVE
t AS (
  SELECT d.doc_id, translate(unnest(regexp_extract_all(coalesce(d.text, ''), '[A-Za-zÀ-ÿ]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents d
),
u AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS m, run, count(*) AS c FROM t WHERE length(run) >= 5 GROUP BY ALL),
bits(b, i, x) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE i < 8
),
one AS (SELECT b, x FROM bits WHERE i = 8),
byte(k, b, x) AS (
  SELECT 0::BIGINT, b, x FROM one
  UNION ALL
  SELECT k + 1, p.b, xor(p.x >> 8, o.x) FROM byte p JOIN one o ON o.b = p.x & 255
  WHERE k + 1 < (SELECT max(octet_length(encode(m))) FROM u)
),
start(n, x) AS (
  SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL
  SELECT n + 1, xor(p.x >> 8, o.x) FROM start p JOIN one o ON o.b = p.x & 255
  WHERE n < (SELECT max(octet_length(encode(m))) FROM u)
),
h AS (SELECT m, hex(encode(m)) AS hx, octet_length(encode(m)) AS n FROM u),
parts AS (SELECT m, n, unnest(range(n)) AS i, hx FROM h),
crc AS (
  SELECT p.m, xor(xor(bit_xor(y.x), any_value(s.x)), 4294967295) AS h
  FROM parts p JOIN byte y ON y.k = p.n - 1 - p.i AND y.b = ('0x' || substr(p.hx, 2 * p.i + 1, 2))::BIGINT
  JOIN start s ON s.n = p.n
  GROUP BY p.m
),
w AS (
  SELECT CASE WHEN h % 97 = 0
              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         sum(c)::BIGINT AS n
  FROM u JOIN crc USING (m) GROUP BY 1
),
words AS (SELECT * FROM w WHERE length(word) >= 5 AND n >= 3),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word
),
form AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * words.n THEN top END AS form_n,
         CASE WHEN top >= 2 * words.n
              THEN (SELECT min(other COLLATE "C") FROM near x WHERE x.word = words.word AND x.n = best.top) END AS form
  FROM words LEFT JOIN best ON best.word = words.word
),
chain(word, stop) AS (
  SELECT word, word FROM form
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.stop WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.stop AS root, f.n, f.n_near, f.form_n
FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.stop AND e.form IS NULL
"""

ORACLES: dict[str, str] = {
    "op8_salted_exact_dedup": _OP8,
    "op9_source_mixing": _OP9,
    "op12_ptolemaic_clusters": _op12(),
    "op13_permuterm_variants": _OP13,
}
