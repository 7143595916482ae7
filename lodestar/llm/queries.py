"""The queries of the training-data operators, op1 to op13, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, hnsw, langid, linededup, lm, mixing, packing, quality, resampling, secrets, simhash, toxicity
from .common import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(load(spark, sf_dir, "documents"), gone="gone")
    n_words = mixing.n_words(F.col("text"))
    return cleaned.select(
        "doc_id",
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"),
        n_words.alias("n_words_kept"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
        "text",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("mark")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: op7: every document position is compared with every window of the same number of words.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, rowid AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, lengths WHERE len(w) >= n)
), hit AS (
  SELECT r, dw.n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.words = iw.words
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


#: op12: crc32 bit by bit over the bytes of each distinct word.
OP12_SQL = r"""
WITH steps AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)
), w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sources AS (
  SELECT unnest(w) AS word FROM w
), targets AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(hex(encode(word))) + 1, 2), lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM sources UNION SELECT word FROM targets), steps
), s AS (
  SELECT bucket, count(*) AS s FROM sources JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM targets JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, (SELECT count(*) FROM sources) AS all_s, (SELECT count(*) FROM targets) AS all_t
        FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket))
), weights AS (
  SELECT r, sum(gain) AS weight FROM (SELECT r, unnest(w) AS word FROM w) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN CAST(place AS BIGINT) END AS rank
FROM ranked
"""

#: op13: all phrases within pieces, counted one by one.
OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, size, f, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, k, CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = head JOIN grams y ON y.lang = c.lang AND y.phrase = tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), dropped AS (
  SELECT DISTINCT p.lang, p.phrase FROM grams p JOIN (
    SELECT lang, size, f, unnest(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda s: array_to_string(string_split(phrase, ' ')[s : s + m - 1], ' ')))) AS parts
    FROM grams WHERE size > 2) q ON p.lang = q.lang AND list_contains(parts, p.phrase) AND CAST(100 AS HUGEINT) * q.f >= 80 * p.f
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN dropped USING (lang, phrase)) JOIN n USING (lang)
WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7_SQL, "op12_resampling": OP12_SQL, "op13_collocations": OP13_SQL}
