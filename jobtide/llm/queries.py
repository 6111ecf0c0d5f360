"""The workload queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import storage
from jobtide.llm import bpe, decontaminate, fuzzyhash, gam, htmltext, linededup, maxent, negatives, pii, runs, simhash, tokenfile, topk
from jobtide.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "jobtide-surrogates"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = lambda spark, sf: run(ready(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op1_surrogates")
def op1(spark, sf):
    return pii.replace(table(spark, sf, "documents").select("doc_id", "text"), SURROGATE_KEY, counts=True)


@query("op2_fm_index", r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM windows)
  WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("spans", "items")


@query("op3_max_entropy")
def op3(spark, sf):
    return maxent.score(table(spark, sf, "documents"))


@query("op4_additive_quality")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    return gam.score(docs, gam.fit(docs, table(spark, sf, "labels")))


@query("op5_token_files")
def op5(spark, sf):
    path = storage.scratch(spark, "token-files")
    tokenfile.write(table(spark, sf, "documents"), path, tokenizer(), end=0)
    read = tokenfile.read(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_term_at_a_time", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""")
def op6(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op7_line_dedup")
def op7(spark, sf):
    return linededup.deduplicate(table(spark, sf, "documents").select("doc_id", "text"), report=True, least=linededup.MIN_WORDS)


@query("op8_page_text")
def op8(spark, sf):
    return htmltext.extract(table(spark, sf, "pages"))


@query("op9_simhash")
def op9(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op10_bpe_automaton")
def op10(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), tokenizer())


@query("op11_piecewise_hash")
def op11(spark, sf):
    return fuzzyhash.with_edited(table(spark, sf, "documents"))


@query("op12_periodic_runs")
def op12(spark, sf):
    return runs.digests(runs.with_planted_period(table(spark, sf, "documents")))


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def op13(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)
