"""The operators of this package as queries over the corpus tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse.llm import bpe, ctw, decontaminate, licenses, merkle, minhash, pii, quality, sharding, substrings, topk, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_cotraining_quality(spark, sf_dir):
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "meta_score", "quality_score", "good")


@query
def op5_threshold_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where("vec_id % 20 = 0"), vectors)


@query
def op6_circulant_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_bpe_merge_rounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_hilbert_shards(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op3_prefix_filtered_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


@query
def op7_seed_extend_substrings(spark, sf_dir):
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_license_dice(spark, sf_dir):
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
                        F.array_max(F.transform("licenses", lambda m: m["dice"])).alias("best_dice"))


@query
def op9_skip_chain_crf(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(told("base_spans"), 256).alias("base_sha256"), told("spans").alias("spans"))


@query
def op10_context_tree_weighting(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


@query
def op11_pattern_grammar_toxicity(spark, sf_dir):
    found = toxicity.find_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("clauses").cast("long").alias("n_clauses"))


@query
def op12_value_dictionary_codes(spark, sf_dir):
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    sha = F.sha2(F.lit(vector_codes.as_text(codebooks)), 256)
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


@query
def op13_slot_pivot_merkle(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), changed={"n_chars": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = found.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op6_circulant_minhash"] = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.doc_id
), lowest AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, c AS component_id, c = doc_id AS kept FROM sized JOIN lowest USING (doc_id)
"""

_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op3_prefix_filtered_containment"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w, least(len({_ALNUM}), 10) AS m FROM benchmark),
starts AS (SELECT item_id, w, m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE m > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM starts),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM wins)),
occ AS (SELECT doc_id, p, m, item_id FROM (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS t FROM places) JOIN wins USING (m, t)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_TEMPLATES = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in licenses.TEMPLATES.items())

ORACLE_SQL["op8_license_dice"] = rf"""
WITH units AS (
  SELECT doc_id, u AS text, false AS whole FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents)
  UNION ALL SELECT doc_id, text, true FROM documents
), said AS (SELECT doc_id, whole, {_ALNUM} AS w FROM units),
shown AS (SELECT doc_id, count(*) AS spoken FROM said WHERE NOT whole AND len(w) > 0 GROUP BY doc_id),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s
  FROM said JOIN shown USING (doc_id) WHERE len(w) > 1 AND (NOT whole OR spoken > 1)
), temps AS (
  SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t
  FROM (SELECT name, {_ALNUM} AS w FROM (VALUES {_TEMPLATES}) AS v(name, text))
), pairs AS (
  SELECT doc_id, name, CAST(2 * len(list_intersect(s, t)) AS DOUBLE) / (len(s) + len(t)) AS dice
  FROM sets JOIN temps ON 2 * least(len(s), len(t)) >= {licenses.THRESHOLD} * (len(s) + len(t))
), hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS best
  FROM pairs WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, best AS best_dice
FROM documents LEFT JOIN hits USING (doc_id)
"""

ORACLE_SQL["op5_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL["op7_seed_extend_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
said AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE g IS NULL) AS t, count(g) AS n
  FROM (SELECT said.doc_id, word, said.p, gone.p AS g FROM said LEFT JOIN gone ON gone.doc_id = said.doc_id AND gone.p = said.p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_CRC = """(SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b)
  FROM range(256) AS bytes(b))"""

ORACLE_SQL["op13_slot_pivot_merkle"] = f"""
WITH RECURSIVE crcs AS (SELECT {_CRC} AS t),
told AS (
  SELECT doc_id, lang, n_chars, [coalesce(strlen(v) || ':' || v, '-') FOR v IN [CAST(doc_id AS VARCHAR), source, lang]] AS before,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    4294967295 - list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc
  FROM documents, crcs
), hashed AS (
  SELECT doc_id, lang, sha256(array_to_string(before, '') || n || body) AS leaf, sha256(array_to_string(before, '') || m || body) AS claimed
  FROM (SELECT *, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS tampered,
    CASE WHEN crc % 7 = 0 THEN tampered ELSE n END AS m FROM told)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS size FROM hashed
), tree(lang, level, spot, size, h) AS (
  SELECT lang, 0, spot, size, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, spot // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM tree WHERE size > 1 GROUP BY lang, level, spot // 2, size
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS size FROM tree WHERE size = 1
), top(level, spot, size, h) AS (
  SELECT 0, spot, size, subroot FROM subroots
  UNION ALL
  SELECT level + 1, spot // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY spot)) FROM top WHERE size > 1 GROUP BY level, spot // 2, size
), steps AS (
  SELECT l.doc_id, l.lang, l.spot, t.level, CASE WHEN (l.spot >> t.level) % 2 = 1 THEN 'L' ELSE 'R' END AS side, b.h
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE size > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree b ON b.lang IS NOT DISTINCT FROM l.lang AND b.level = t.level AND b.spot = xor(l.spot >> t.level, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, l.spot, 1000 + t.level, CASE WHEN (s.spot >> t.level) % 2 = 1 THEN 'L' ELSE 'R' END, b.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, (SELECT DISTINCT level FROM top WHERE size > 1) t
  LEFT JOIN top b ON b.level = t.level AND b.spot = xor(s.spot >> t.level, 1)
), paths AS (
  SELECT lang, spot, coalesce(string_agg(h, '' ORDER BY level), '') AS proof, list(side || coalesce(h, '') ORDER BY level) AS path FROM steps GROUP BY lang, spot
), whole AS (SELECT h AS root FROM top WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (
  SELECT l.*, s.subroot, root, proof, list_reduce(list_prepend(claimed, coalesce(path, [])),
    lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.spot = l.spot, whole
)
"""


def _rounds() -> str:
    """The assignments and codebooks of four rounds, each from the one before."""
    parts = []
    for i in range(vector_codes.ROUNDS + 1):
        parts.append(f"""near{i} AS MATERIALIZED (
  SELECT row, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT row, p, e, sum((x - y) * (x - y)) AS far FROM parts JOIN book{i} USING (p, j) GROUP BY row, p, e) GROUP BY row, p)""")
        if i < vector_codes.ROUNDS:
            parts.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT p, e, j, coalesce(z, y) AS y FROM book{i} LEFT JOIN (
    SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS z FROM near{i} JOIN parts USING (row, p) GROUP BY p, e, j) USING (p, e, j))""")
    return ",\n".join(parts)


ORACLE_SQL["op12_value_dictionary_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, (i - 1) // (len(v) // 4) AS p, (i - 1) % (len(v) // 4) AS j, v[i] AS x FROM (SELECT row, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (SELECT p, row - 1 AS e, j, x AS y FROM parts WHERE row <= {vector_codes.ENTRIES}),
{_rounds()},
coded AS (
  SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(y, ',' ORDER BY p, e, j)) FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""
