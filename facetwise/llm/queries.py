"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetwise.llm import (
    decontamination, exact, katz, language, licenses, lines, packing, phrases, pieces, resampling, simhash, substrings, vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Lines within one edit share their first or second half, cut for the shorter length, or are equal.
LINES_SQL = """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, u.i - 1 AS line_no, ls[u.i] AS line
      FROM raw, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u
      WHERE trim(ls[u.i]) <> ''),
d AS (SELECT line, min((doc_id, line_no)) AS place FROM l GROUP BY line),
k AS (SELECT line, place, m, left(line, m // 2) AS a, right(line, m - m // 2) AS z
      FROM (SELECT line, place, unnest([length(line), length(line) - 1]) AS m FROM d WHERE length(line) >= 5) WHERE m >= 5),
c AS (SELECT x.line, y.place FROM k x JOIN k y ON x.m = y.m AND x.a = y.a WHERE y.place < x.place AND levenshtein(x.line, y.line) = 1
      UNION ALL
      SELECT x.line, y.place FROM k x JOIN k y ON x.m = y.m AND x.z = y.z WHERE y.place < x.place AND levenshtein(x.line, y.line) = 1),
o AS (SELECT d.line, least(d.place, coalesce(min(c.place), d.place)) AS place FROM d LEFT JOIN c USING (line) GROUP BY d.line, d.place),
g AS (SELECT l.doc_id, l.line_no, length(l.line) AS n FROM l JOIN o USING (line) WHERE o.place < (l.doc_id, l.line_no)),
s AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS nos FROM g GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(s.n, 0) AS n_removed, coalesce(s.nos, '') AS removed
FROM documents t LEFT JOIN s USING (doc_id)
"""


@query(LINES_SQL)
def op1_line_dedup(spark, sf_dir):
    """Per document: its lines, and the numbers of those within one edit of an earlier line."""
    docs = table(spark, sf_dir, "documents")
    gone = lines.duplicate_lines(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("removed")
    )
    counted = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    return counted.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed")
    )


@query()
def op2_sentencepiece(spark, sf_dir):
    """Per document: its pieces, a checksum of their ids, and of the text decoded from them."""
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    return pieces.digests(*pieces.encode_parts(docs, model), model)


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query(VECTORS_SQL)
def op3_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), ids=False)


@query()
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query()
def op6_katz_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fitted = katz.fit(docs.where(katz.training_rows()))
    return katz.score(docs, fitted).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query()
def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query(EXACT_SQL)
def op8_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("text", 256)})


SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, u.p, array_to_string(ws[u.p : u.p + 19], ' ') AS k
      FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS p) u),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM late),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""


@query(SUBSTRINGS_SQL)
def op9_substring_dedup(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query()
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.training_rows()))
    return language.identify(docs, model).select(
        "doc_id", (~language.training_rows()).alias("held_out"), "lang_pred", "score", "rejected"
    )


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASES_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f
      FROM p, LATERAL (SELECT unnest(range(1, 5)) AS s), LATERAL (SELECT unnest(range(1, len(w) - s + 2)) AS i) GROUP BY ALL),
h AS (SELECT lang, s, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= 30),
cuts AS (SELECT h.lang, h.phrase, h.s, h.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * h.f // (x.f + y.f))::BIGINT AS score
         FROM h, LATERAL (SELECT unnest(range(1, s)) AS k)
         JOIN h x ON x.lang = h.lang AND x.phrase = array_to_string(h.w[1:k], ' ')
         JOIN h y ON y.lang = h.lang AND y.phrase = array_to_string(h.w[k + 1 :], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ins AS (SELECT lang, f, array_to_string(w[i : i + z - 1], ' ') AS phrase
        FROM h, LATERAL (SELECT unnest(range(2, s)) AS z), LATERAL (SELECT unnest(range(1, s - z + 2)) AS i)),
gone AS (SELECT DISTINCT low.lang, low.phrase FROM low JOIN ins ON ins.lang = low.lang AND ins.phrase = low.phrase AND 100 * ins.f >= 80 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low ANTI JOIN gone USING (lang, phrase) JOIN totals USING (lang) QUALIFY rank <= 2000
""".replace("{lower}", LOWER_SQL)


@query(PHRASES_SQL)
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p
      FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
x AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
      FROM d, (SELECT DISTINCT n FROM v), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
h AS (SELECT doc_id, item_id, i, n FROM x JOIN v USING (n, p)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""".replace("{lower}", LOWER_SQL)


@query(DECONTAMINATION_SQL)
def op12_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


# Words with their buckets: the CRC-32 is worked out byte by byte from its table.
RESAMPLING_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
u AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT unnest(w) AS w FROM d UNION ALL SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT),
                    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, crc),
x AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN k USING (w)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM x GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
             / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
f AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)
""".replace("{lower}", LOWER_SQL)


@query(RESAMPLING_SQL)
def op13_importance_resampling(spark, sf_dir):
    ranked = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
