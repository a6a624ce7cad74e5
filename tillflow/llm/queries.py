"""One query per corpus operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, hard_negatives, html_text, language_id, license_scan, mixing, piece_tokens, quality, sharding, simhash, substring_dedup, token_files

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
five AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c, lead(word, 3) OVER d AS e, lead(word, 4) OVER d AS f
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) AS n FROM five WHERE f IS NOT NULL),
steps AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS covers FROM found WHERE n > 1),
repeats AS (SELECT doc_id, sum(covers) AS n FROM steps GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
per_line AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM per_line GROUP BY doc_id),
base AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN repeats ON repeats.doc_id = t.doc_id LEFT JOIN dups ON dups.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_symbols > 3 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM base"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(documents(spark, sf_dir), 24)
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv
  FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT max(lv) FROM l WHERE lv * weight <= cap) * weight, cap::DOUBLE)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS ratio FROM g),
m AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size::DOUBLE AS rest FROM r),
b AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM d),
z AS (SELECT b.source, b.bits, m.rest, CAST(sum(b.size) AS BIGINT) AS words FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source WHERE b.size > 0 GROUP BY ALL),
q AS (
  SELECT *, (rest - coalesce(sum(words) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(bits * words) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv
  FROM z WINDOW c AS (PARTITION BY source ORDER BY bits DESC)),
i AS (SELECT *, greatest(0, least(1, coalesce(max(CASE WHEN lv * bits <= 1 THEN lv END) OVER (PARTITION BY source) * bits, 1)))::DOUBLE AS p FROM q),
f AS (SELECT source, bits, p, rest - coalesce(sum(CASE WHEN p >= 1 THEN words END) OVER (PARTITION BY source), 0)::DOUBLE AS rest FROM i),
u AS (
  SELECT b.doc_id, b.size, b.source, f.p, f.rest, (('0x' || substr(md5('mix-1:' || b.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS x
  FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source AND b.bits = f.bits),
o AS (SELECT *, (x / (1 - x)) / (p / (1 - p)) AS odds FROM u WHERE p > 0 AND p < 1),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM o),
e AS (SELECT doc_id FROM k WHERE 2 * reached - size <= 2 * rest UNION ALL SELECT doc_id FROM u WHERE p >= 1)
SELECT d.doc_id, d.size, m.source_size, m.target, CAST((m.whole + CASE WHEN e.doc_id IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN e ON e.doc_id = d.doc_id"""


@query("op8_mixing", MIXING_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


EXACT_SQL = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON g.t = coalesce(d.text, '')"""


@query("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(documents(spark, sf_dir))


def tokenizer_file(name: str) -> str:
    """Place of an installed vocabulary file; every node has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_piece_tokens")
def op1_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


SUBSTRING_SQL = rf"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
runs AS (
  SELECT doc_id, i, count(*) OVER d AS n, string_agg(word, ' ') OVER d AS run
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT run, min(doc_id) AS least FROM runs WHERE n = 13 GROUP BY run),
hits AS (SELECT r.doc_id, r.i FROM runs r JOIN firsts f ON f.run = r.run WHERE r.n = 13 AND f.least < r.doc_id),
marked AS (
  SELECT words.doc_id, words.i, word, max(CASE WHEN hits.i IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN hits ON hits.doc_id = words.doc_id AND hits.i = words.i),
kept AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS s FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id"""


@query("op6_substring_dedup", SUBSTRING_SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), with_text=False).drop("kept_text")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Integer vectors, anchors against all rows, positives, windows.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS r, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), anchors=F.col("vec_id") % 50 == 0)


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


MIDDLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op13_fill_middle", MIDDLE_SQL)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restore(fill_middle.transform(documents(spark, sf_dir)))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
