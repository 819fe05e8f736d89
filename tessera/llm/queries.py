"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    op1_lm_scoring,
    op2_near_vectors,
    op3_ngram_join,
    op4_quality,
    op5_passages,
    op6_url_filters,
    op7_decontamination,
    op8_sharding,
    op9_secret_scans,
    op10_sentencepiece,
    op11_ranked_search,
    op12_chat_windows,
    op13_whitening,
)
from tessera.llm.workspace import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lm_scoring.score(_table(spark, sf_dir, "documents"))


def op2_near_vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op4_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_passages.repeated_passages(_table(spark, sf_dir, "documents"))


# Host, path and verdict of the rules to apply.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_filters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return op6_url_filters.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT n.page_id, any_value(n.host) AS host, any_value(n.path) AS path,
  max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM named n LEFT JOIN rules r
  ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
GROUP BY n.page_id
"""


def op7_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op9_secret_scans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = op9_secret_scans.scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in op9_secret_scans.RULES if r.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(op9_secret_scans.as_text(of_base), 256).alias("base_sha256"),
        op9_secret_scans.as_text(F.col("spans")).alias("spans"),
    )


SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op10_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sentencepiece.encode(_table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op11_ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = keep(op11_ranked_search.build_index(_table(spark, sf_dir, "documents")), "search-index")
    return op11_ranked_search.search(index, _table(spark, sf_dir, "benchmark"), 50)


# Fixed value: both turns of the added conversation say this.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation read back from its windows; the digests need each one whole, the windows do not."""
    asked = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    read = op12_chat_windows.read_back(op12_chat_windows.chat_windows(asked.unionByName(added)))
    fresh = F.filter("said", lambda t: ~t["repeated"])
    targets = F.filter(F.transform("said", lambda t: t["target"]), lambda t: t.isNotNull())
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("segment", "window", said.alias("said"), F.array_join(targets, "").alias("target"))
    parts = F.array_sort(F.collect_list(part))
    sums = read.groupBy("conv_id").agg(parts.alias("parts"), F.sum(F.size(fresh)).cast("long").alias("n_turns"), F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"))
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return sums.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("said"), 256).alias("turns_sha256"),
        F.char_length(whole("target")).cast("long").alias("loss_chars"),
        F.sha2(whole("target"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op13_whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening.report(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _op9_sql() -> str:
    """Matches and what lies between them, kind by kind; their lengths add up to the spans."""
    parts = []
    for rank, rule in enumerate(op9_secret_scans.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
  a := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), n := length(m[i]), kept := length(v[i]) >= {rule.at_least}))) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v, regexp_split_to_array(text, '{pattern}') AS g FROM documents)""")
    base = ", ".join(f"'{r.kind}'" for r in op9_secret_scans.RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in op9_secret_scans.RULES if r.base)
    return f"""WITH f AS ({" UNION ALL ".join(parts)}), t AS (SELECT doc_id, rank, kind, CAST(s.a AS BIGINT) AS a, kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT) AS said FROM f WHERE s.kept)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(said, ',' ORDER BY a, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY a, rank), '') AS spans
FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""


OP9_SQL = _op9_sql()

OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""

OP12_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x.turn, x.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS i,
  len(regexp_extract_all(text, '[\p{L}\p{N}]{1,6}|[^\x20\x09-\x0D\p{L}\p{N}]')) AS n, 15 + length(role) + length(regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g')) AS chars FROM c),
s AS (SELECT conv_id, min(i) AS si, arg_min(n, i) AS sn, arg_min(chars, i) AS sc FROM t WHERE role = 'system' GROUP BY 1),
u AS (SELECT t.conv_id, i, n, chars, CASE WHEN si < i THEN sn ELSE 0 END AS top, CASE WHEN si < i THEN sc ELSE 0 END AS top_chars,
  CASE WHEN i = si THEN 0 ELSE n END AS own, CASE WHEN i = si THEN 0 ELSE chars END AS own_chars FROM t LEFT JOIN s USING (conv_id)),
h AS (SELECT conv_id, i, max(past) AS past, max(past_chars) AS past_chars FROM (
  SELECT a.conv_id, a.i, a.n, a.top, sum(b.own) OVER w AS past, sum(b.own_chars) OVER w AS past_chars FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 8 AND a.i - 1
  WINDOW w AS (PARTITION BY a.conv_id, a.i ORDER BY b.i DESC)) WHERE past <= least(192, 768 - top - n) GROUP BY 1, 2),
v AS (SELECT u.*, top + coalesce(past, 0) AS again, top_chars + coalesce(past_chars, 0) AS again_chars FROM u LEFT JOIN h USING (conv_id, i)),
r AS (SELECT conv_id, i, again + n AS used, again_chars + chars AS out FROM v WHERE i = 0
  UNION ALL SELECT v.conv_id, v.i, CASE WHEN r.used + n > 768 THEN again + n ELSE r.used + n END, r.out + chars + CASE WHEN r.used + n > 768 THEN again_chars ELSE 0 END FROM r JOIN v ON v.conv_id = r.conv_id AND v.i = r.i + 1),
f AS (SELECT conv_id, CAST(max(out) AS BIGINT) AS formatted_chars FROM r GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN f USING (conv_id) GROUP BY conv_id
"""

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring_query,
    "op2_near_vectors": op2_near_vectors_query,
    "op3_ngram_join": op3_ngram_join_query,
    "op4_quality": op4_quality_query,
    "op5_passages": op5_passages_query,
    "op6_url_filters": op6_url_filters_query,
    "op7_decontamination": op7_decontamination_query,
    "op8_sharding": op8_sharding_query,
    "op9_secret_scans": op9_secret_scans_query,
    "op10_sentencepiece": op10_sentencepiece_query,
    "op11_ranked_search": op11_ranked_search_query,
    "op12_chat_windows": op12_chat_windows_query,
    "op13_whitening": op13_whitening_query,
}
ORACLES = {"op2_near_vectors": OP2_SQL, "op3_ngram_join": OP3_SQL, "op6_url_filters": OP6_SQL, "op9_secret_scans": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_chat_windows": OP12_SQL}
