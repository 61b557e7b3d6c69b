"""Registered queries: vectors, related datasets, catalog, question log and question texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetwise.functions import text as X
from facetwise.operators import catalog as K, cells as C, vectors as V
from facetwise.plans.profile_queries import rounded
from facetwise.plans.registry import query, table
from facetwise.session import scratch_path, write_through

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


# --- vectors: the embeddings table stands in for the column registry, label for the dataset ---

def registry(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("d%02d", "label").alias("dataset_id"),
        F.format_string("v%06d", "vec_id").alias("column_name"),
        "embedding",
    )


REGISTRY_SQL = """
reg AS (SELECT printf('d%02d', label) AS dataset_id, printf('v%06d', vec_id) AS column_name,
               embedding::DOUBLE[] AS e FROM embeddings)
"""


@query(
    f"""
    WITH {REGISTRY_SQL}, q AS (SELECT e FROM reg WHERE column_name = 'v000007')
    SELECT column_name, dataset_id, round(list_cosine_similarity(reg.e, q.e), 6) AS score
    FROM reg, q ORDER BY list_cosine_similarity(reg.e, q.e) DESC, column_name LIMIT 10
    """
)
def nearest_vectors(spark, sf_dir):
    frame = registry(spark, sf_dir)
    vector = frame.where("column_name = 'v000007'").head()["embedding"]
    found = V.nearest(frame, vector, 10)
    return rounded(
        found.select(F.col("item_id").alias("column_name"), F.col("item_group").alias("dataset_id"), "score"), "score"
    )


MATCHES_SQL = f"""
{REGISTRY_SQL}, pairs AS (
  SELECT l.column_name AS local_id, r.column_name AS item_id, r.dataset_id AS item_group,
         round(list_cosine_similarity(l.e, r.e), 9) AS score
  FROM reg l JOIN reg r ON l.dataset_id <> r.dataset_id WHERE l.dataset_id = 'd00'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY score DESC, item_id) AS rank FROM pairs),
matches AS (SELECT * FROM ranked WHERE rank <= 5 AND score >= 0.3)
"""


def matches(spark, sf_dir, limit=V.MAX_BROADCAST_QUERIES):
    frame = registry(spark, sf_dir)
    local = frame.where("dataset_id = 'd00'")
    queries = local.select(F.col("column_name").alias("query_id"), F.col("dataset_id").alias("query_group"), "embedding")
    found = V.best_matches(queries, V._items(frame, "column_name", "dataset_id"), 5, "other", limit)
    return found.where(F.col("score") >= 0.3).withColumnRenamed("query_id", "local_id")


MATCH_COLUMNS = ("local_id", "item_id", "item_group", "score")


@query(f"WITH {MATCHES_SQL} SELECT local_id, item_id, item_group, round(score, 6) AS score, rank FROM matches")
def nearest_columns_elsewhere(spark, sf_dir):
    frame = registry(spark, sf_dir)
    found = V.knn_join(frame.where("dataset_id = 'd00'"), frame, min_score=0.3)
    return rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "score")


@query(f"WITH {MATCHES_SQL} SELECT local_id, item_id, item_group, round(score, 6) AS score, rank FROM matches")
def nearest_columns_by_blocks(spark, sf_dir):
    """The same join for a local side too large to send to every task."""
    return rounded(matches(spark, sf_dir, limit=10).withColumn("rank", F.col("rank").cast("bigint")), "score")


@query(
    f"""WITH {MATCHES_SQL} SELECT item_group AS dataset_id, round(avg(score), 6) AS similarity, count(*) AS matches,
        string_agg(local_id || '>' || item_id, ',' ORDER BY score DESC, local_id, item_id) AS columns
        FROM matches GROUP BY 1"""
)
def related_datasets(spark, sf_dir):
    found = V.related(matches(spark, sf_dir))
    listed = F.array_join(F.transform("columns", lambda c: F.concat(c["local"], F.lit(">"), c["remote"])), ",")
    return rounded(found.withColumn("columns", listed), "similarity")


@query(
    f"""
    WITH {REGISTRY_SQL}
    SELECT dataset_id, column_name, CASE WHEN column_name LIKE '%5' THEN 'new' ELSE 'old' END AS description FROM reg
    UNION ALL SELECT dataset_id, column_name || '+', 'new' FROM reg WHERE column_name LIKE '%5'
    """
)
def registry_upsert(spark, sf_dir):
    old = registry(spark, sf_dir).select("dataset_id", "column_name", F.lit("old").alias("description"))
    fives = old.where("column_name LIKE '%5'").withColumn("description", F.lit("new"))
    fresh = fives.unionByName(fives.withColumn("column_name", F.concat("column_name", F.lit("+"))))
    # Every new key comes twice; the larger row wins.
    fresh = fresh.unionByName(fresh.withColumn("description", F.lit("earlier")))
    return V.upsert(old, fresh, ["dataset_id", "column_name"], ["description"])


@query(
    "\nUNION\n".join(
        f"""SELECT 'nation' AS dataset_id, '{c}' AS column_name, '{t}' AS dtype,
            '{c} ({t}): sample values: ' || (SELECT string_agg(v, ', ' ORDER BY k) FROM
              (SELECT CAST({c} AS VARCHAR) AS v, n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 3))"""
        + (f" || '; range ' || min({c}) || '–' || max({c})" if t == "int" else "")
        + " AS description FROM nation"
        for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))
    )
)
def described_columns(spark, sf_dir):
    return V.column_descriptions(table(spark, sf_dir, "nation"), "nation", ["n_nationkey"])


#: What orders the rows of each test table.
TABLE_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def described_tables(spark, sf_dir):
    described = None
    for name in TABLES:
        frame = V.column_descriptions(table(spark, sf_dir, name), name, TABLE_KEYS[name])
        described = frame if described is None else described.unionByName(frame)
    return write_through(described, "descriptions")


@query()
def embedded_descriptions(spark, sf_dir):
    described = V.embed(described_tables(spark, sf_dir), "description")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return described.select("dataset_id", "column_name", F.size("embedding").alias("dims"), F.round(length, 4).alias("length"))


@query()
def column_search_by_text(spark, sf_dir):
    described = V.embed(described_tables(spark, sf_dir), "description")
    return V.search_columns(described, catalog(spark, sf_dir), "retail price of a part", 5)


def stored_index(spark, sf_dir, cells=8):
    path = scratch_path(spark, "vector-index")
    frame = registry(spark, sf_dir)
    late = F.col("column_name").endswith("3")
    C.write_index(frame.where(~late), path, cells)
    C.add_to_index(frame.where(late), path, "late")
    return path


def hundredths(spark, sf_dir, rest="00"):
    """The stated query set: every vector whose id is divisible by 100."""
    frame = registry(spark, sf_dir).where(F.col("column_name").endswith(rest))
    return frame.select(F.col("column_name").alias("query_id"), F.col("dataset_id").alias("query_group"), "embedding")


@query()
def index_probe(spark, sf_dir):
    """Approximate search in the stored index, with as many cells as other vectors needed; tests compare it with the
    exact one."""
    path = stored_index(spark, sf_dir)
    # 200 other vectors by hash: a sample for the number of cells only, every vector is in the index.
    others = hundredths(spark, sf_dir, "").where(~F.col("query_id").endswith("00")).orderBy(F.xxhash64("query_id"), "query_id").limit(200)
    probes = C.probes_for(others, path, 10)
    return C.probe_index(hundredths(spark, sf_dir), path, 10, probes)


HUNDREDTHS_SQL = f"""
{REGISTRY_SQL}, pairs AS (
  SELECT l.column_name AS query_id, r.column_name AS item_id, r.dataset_id AS item_group,
         round(list_cosine_similarity(l.e, r.e), 9) AS score
  FROM reg l JOIN reg r ON l.dataset_id <> r.dataset_id WHERE l.column_name LIKE '%00'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
"""


@query(f"WITH {HUNDREDTHS_SQL} SELECT query_id, item_id, item_group, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def nearest_through_cells(spark, sf_dir):
    """Exact: cells of the stored index are skipped only where they cannot hold one of the best."""
    found = C.join_index(hundredths(spark, sf_dir), stored_index(spark, sf_dir), 5, "other").found
    return rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "score")


@query(
    f"""WITH {HUNDREDTHS_SQL} SELECT query_id, count(*) AS matches, round(max(score), 6) AS best
        FROM ranked WHERE rank <= 5 AND score >= 0.35 GROUP BY 1"""
)
def strong_matches_through_cells(spark, sf_dir):
    """With a least score, cells that cannot reach it are skipped too."""
    found = C.join_index(hundredths(spark, sf_dir), stored_index(spark, sf_dir), 5, "other", min_score=0.35).found
    grouped = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.max("score").alias("best"))
    return rounded(grouped, "best")


# --- catalog: the test tables themselves ---

CATALOG_SQL = "cat AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS dataset_id, '{name}.parquet' AS name, (SELECT count(*) FROM {name}) AS row_count, "
    f"TIMESTAMP '2024-01-01' + INTERVAL {i} DAY AS created_at"
    for i, name in enumerate(TABLES)
) + ")"


def catalog(spark, sf_dir):
    frames = [
        K.register(
            table(spark, sf_dir, name),
            name,
            f"{name}.parquet",
            f"{sf_dir}/{name}.parquet",
            F.expr(f"TIMESTAMP_NTZ '2024-01-01' + INTERVAL {i} DAY"),
        )
        for i, name in enumerate(TABLES)
    ]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


@query(f"WITH {CATALOG_SQL} SELECT * FROM cat")
def catalog_rows(spark, sf_dir):
    return K.list_datasets(catalog(spark, sf_dir)).select("dataset_id", "name", "row_count", "created_at")


@query(f"WITH {CATALOG_SQL} SELECT dataset_id, name, row_count FROM cat WHERE dataset_id = 'orders'")
def catalog_entry(spark, sf_dir):
    return K.get(catalog(spark, sf_dir), "orders").select("dataset_id", "name", "row_count")


@query(f"WITH {CATALOG_SQL} SELECT dataset_id, row_count FROM cat WHERE row_count >= 500")
def catalog_without_small(spark, sf_dir):
    whole = catalog(spark, sf_dir)
    return K.remove(whole, whole.where("row_count < 500")).select("dataset_id", "row_count")


@query(
    f"""WITH {CATALOG_SQL} SELECT dataset_id, CASE WHEN row_count < 100 THEN 'error'
        WHEN row_count < 1000 THEN 'processing' ELSE 'ready' END AS status FROM cat"""
)
def catalog_status(spark, sf_dir):
    whole = catalog(spark, sf_dir)
    facts = whole.where("row_count < 100 OR row_count >= 1000").select(
        F.col("dataset_id").alias("dataset"),
        F.when(F.col("row_count") < 100, "error").otherwise("shape").alias("section"),
    )
    return K.status(whole, facts)


# --- question log: conversations, the conversation modulo 20 as dataset ---

LOG_SQL = """
turns AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
log AS (SELECT printf('%08d-%04d', conv_id, turn) AS id, 'ds' || (conv_id % 20) AS dataset_id, text AS question, answer,
               trim(substring(answer, 1, 200)) AS answer_summary,
               TIMESTAMP '2024-01-01' + to_minutes(conv_id * 100 + turn) AS created_at
        FROM turns WHERE role = 'user' AND next_role = 'assistant')
"""


def question_log(spark, sf_dir):
    from pyspark.sql import Window as W

    in_turn = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns(
        {"answer": F.lead("text").over(in_turn), "next_role": F.lead("role").over(in_turn)}
    )
    asked = turns.where("role = 'user' AND next_role = 'assistant'").select(
        F.format_string("%08d-%04d", "conv_id", "turn").alias("id"),
        F.concat(F.lit("ds"), F.col("conv_id") % 20).alias("dataset_id"),
        F.col("text").alias("question"),
        "answer",
        F.to_json(F.struct("answer")).alias("response_json"),
        X.intent(F.col("text")).alias("query_type"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, conv_id * 100 + turn)").alias("created_at"),
    )
    return K.log_entries(asked)


@query(f"WITH {LOG_SQL} SELECT id, dataset_id, question, answer_summary, created_at FROM log")
def logged_questions(spark, sf_dir):
    return question_log(spark, sf_dir).select("id", "dataset_id", "question", "answer_summary", "created_at")


@query(
    f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id DESC) AS rank
        FROM log) SELECT dataset_id, id, rank FROM r WHERE rank <= 5"""
)
def recent_questions(spark, sf_dir):
    found = K.recent(question_log(spark, sf_dir), 5)
    return found.select("dataset_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {LOG_SQL} SELECT id, dataset_id, question, answer, created_at FROM log")
def question_answers(spark, sf_dir):
    return K.answers(question_log(spark, sf_dir))


@query(
    f"""WITH {LOG_SQL}, names AS (SELECT 'ds' || o_custkey % 15 AS dataset_id, min(o_orderpriority) AS name FROM orders GROUP BY 1)
        SELECT id, dataset_id, name, question FROM log JOIN names USING (dataset_id)"""
)
def log_with_dataset_names(spark, sf_dir):
    names = (
        table(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("ds"), F.col("o_custkey") % 15).alias("dataset_id"))
        .agg(F.min("o_orderpriority").alias("name"))
    )
    return K.log_with_names(question_log(spark, sf_dir), names).select("id", "dataset_id", "name", "question")


def new_questions(spark, sf_dir):
    """Slightly changed copies of logged questions."""
    return question_log(spark, sf_dir).select(
        F.col("id").alias("question_id"),
        "dataset_id",
        F.concat(F.upper(F.substring("question", 1, 40)), F.expr("substring(question, 41)"), F.lit("?")).alias("question"),
    )


@query()
def semantic_history(spark, sf_dir):
    return K.search_log(question_log(spark, sf_dir), new_questions(spark, sf_dir))


# The best match of a question with "?" added is that question itself: 2n of 2n + 1 case-folded letters.
# Of equal questions the newest counts.
@query(
    f"""
    WITH {LOG_SQL}, known AS (SELECT * FROM log WHERE trim(question) <> '' AND trim(answer_summary) <> ''),
    n AS (SELECT id AS question_id, dataset_id, trim(question) AS q FROM known),
    p AS (SELECT n.question_id, k.id, k.dataset_id, length(replace(n.q, 'ß', 'ss')) AS m,
                 row_number() OVER (PARTITION BY n.question_id ORDER BY k.created_at DESC, k.id DESC) AS rk
          FROM n JOIN known k ON k.dataset_id = n.dataset_id AND trim(k.question) = n.q)
    SELECT question_id, id, dataset_id, round(2.0 * m / (2 * m + 1), 6) AS score, CAST(1 AS BIGINT) AS rank FROM p WHERE rk = 1
    """
)
def text_history(spark, sf_dir):
    """The nearest earlier question of each logged one with a sign added, over the whole log."""
    log = question_log(spark, sf_dir)
    asked = log.where("trim(question) <> '' AND trim(answer_summary) <> ''").select(
        F.col("id").alias("question_id"), "dataset_id", F.concat(F.trim("question"), F.lit("?")).alias("question")
    )
    found = K.similar_text(log, asked, k=1).withColumn("rank", F.col("rank").cast("bigint"))
    return rounded(found, "score")


PLAIN_SQL = """regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[_\\-]+', ' ', 'g'),
               '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')"""


@query(
    f"""
    WITH {LOG_SQL},
    p AS (SELECT id, dataset_id, {PLAIN_SQL.format(c='question')} AS x, created_at,
                 row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id DESC) AS age FROM log),
    pairs AS (SELECT n.id AS question_id, o.id, o.age, o.x, n.x AS y,
                     list_filter(string_split(o.x, ' '), lambda w: w <> '') AS xs,
                     list_filter(string_split(n.x, ' '), lambda w: w <> '') AS ys
              FROM p n JOIN p o ON n.dataset_id = o.dataset_id),
    scored AS (SELECT question_id, id, age,
        CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.92
             ELSE len(list_filter(ys, lambda w: list_contains(xs, w))) / greatest(len(xs), len(ys)) END AS score FROM pairs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, age) AS rk
               FROM scored WHERE score >= 0.4)
    SELECT question_id, id, round(score, 6) AS score FROM ranked WHERE rk = 1
    """
)
def overlapping_questions(spark, sf_dir):
    log = question_log(spark, sf_dir)
    asked = log.select(F.col("id").alias("question_id"), "dataset_id", "question")
    return rounded(K.overlapping(log, asked, accept=0.4), "score")


# --- question texts ---

# Question wordings put before the conversation texts.
WORDINGS = (
    "hi, what columns exist?", "Hello there!", "thanks for your help", "what are you?", "tell me about the data",
    "Summarize the dataset", "what columns exist", "show schema", "which product sold most",
    "Compare average sentiment by month", "which two columns are related?",
    "show correlation between sales and month", "summarize missing values and duplicates",
    "Is LoanAmount / ApplicantIncome (loan burden) related to approval? Summarize by burden quartiles",
    "What is the total_sales for each product?", "find outliers in price", "group by region", "similar rows please",
    "forecast next month", "what is the trend", "plot a histogram of price by district",
    "what is the most important feature", "key drivers as a bar chart", "",
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED_SQL = f"""
asked AS (SELECT conv_id, turn, [{', '.join(_quote(w) for w in WORDINGS)}][1 + (conv_id + turn) % {len(WORDINGS)}] || ' '
                 || text AS question FROM conversations WHERE role = 'user')
"""


def asked(spark, sf_dir):
    wording = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (1 + (F.col("conv_id") + F.col("turn")) % len(WORDINGS)).cast("int"))
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.concat(wording, F.lit(" "), F.col("text")).alias("question"))


NORM_SQL = "array_to_string(regexp_extract_all(lower(question), '[a-z0-9'']+'), ' ')"


@query(f"WITH {ASKED_SQL} SELECT conv_id, turn, {NORM_SQL} AS normalised FROM asked")
def normalised_questions(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", X.normalised(F.col("question")).alias("normalised"))


def _any_sql(column: str, marks) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(m)})" for m in marks) + ")"


def _word_sql(words) -> str:
    return "(" + " OR ".join(f"list_contains(t, {_quote(w)})" for w in words) + ")"


def _start_sql(starts) -> str:
    tests = " OR ".join(f"starts_with(w, {_quote(s)})" for s in starts)
    return f"len(list_filter(t, lambda w: {tests})) > 0"


INTENT_SQL = f"""
CASE WHEN {_word_sql(X.SMALLTALK_WORDS)} OR {_any_sql('n', X.SMALLTALK_PHRASES)} THEN 'smalltalk'
     WHEN {_start_sql(X.ANOMALY_STARTS)} OR {_word_sql(X.ANOMALY_WORDS)} THEN 'anomaly'
     WHEN {_start_sql(X.CLUSTER_STARTS)} OR {_word_sql(X.CLUSTER_WORDS)} THEN 'clustering'
     WHEN {_start_sql(X.FORECAST_STARTS)} OR {_word_sql(X.FORECAST_WORDS)} OR {_any_sql('n', X.FORECAST_PHRASES)}
       THEN 'forecast'
     WHEN {_start_sql(X.CORRELATION_STARTS)} OR {_word_sql(X.CORRELATION_WORDS)}
       OR ({_word_sql(X.CORRELATION_LINKS)} AND {_word_sql(X.COLUMN_WORDS)}) OR {_any_sql('n', X.CORRELATION_PHRASES)}
       THEN 'correlation'
     WHEN ({_word_sql(X.SUMMARY_WORDS)} AND {_word_sql(X.DATA_WORDS)} AND NOT list_contains(t, 'by'))
       OR {_any_sql('n', X.DESCRIPTIVE_PHRASES)} OR {_word_sql(X.DESCRIPTIVE_WORDS)} THEN 'descriptive'
     ELSE 'analytical' END
"""


@query(
    f"""
    WITH {ASKED_SQL}, x AS (SELECT *, {NORM_SQL} AS n, regexp_extract_all(lower(question), '[a-z0-9'']+') AS t FROM asked)
    SELECT conv_id, turn, {INTENT_SQL} AS intent, {_any_sql('lower(question)', X.CHART_MARKS)} AS chart,
           {_any_sql('lower(question)', X.IMPORTANCE_MARKS)} AS importance FROM x
    """
)
def question_intents(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select(
        "conv_id",
        "turn",
        X.intent(q).alias("intent"),
        X.wants_chart(q).alias("chart"),
        X.wants_importance(q).alias("importance"),
    )


PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    f"""
    WITH q AS (SELECT p_partkey AS question_id, 'is P_Size of ' || p_name || ' or ' || p_brand || ' p_types'
                      || CASE WHEN p_partkey % 3 = 0 THEN ' above p_retailprice and (p_brand)' ELSE ' like p_brand2' END
                      || CASE WHEN p_partkey % 5 = 0 THEN ' for ring vs x' ELSE '' END AS question FROM part),
    names AS (SELECT unnest([{', '.join(_quote(c) for c in PART_COLUMNS)}, 'or', 'x', 'ring', 'red widget']) AS column_name),
    hit AS (SELECT question_id, column_name,
                   length(regexp_extract(lower(question), '^(.*?)\\b' || column_name || '\\b', 1)) AS position
            FROM q, names WHERE regexp_matches(lower(question), '\\b' || column_name || '\\b')
                          AND column_name NOT IN ('or', 'x'))
    SELECT question_id, column_name, position,
           row_number() OVER (PARTITION BY question_id ORDER BY position, column_name) AS rank FROM hit
    """
)
def mentioned_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    questions = part.select(
        F.col("p_partkey").alias("question_id"),
        F.lit("part").alias("dataset_id"),
        F.expr(
            """'is P_Size of ' || p_name || ' or ' || p_brand || ' p_types'
               || CASE WHEN p_partkey % 3 = 0 THEN ' above p_retailprice and (p_brand)' ELSE ' like p_brand2' END
               || CASE WHEN p_partkey % 5 = 0 THEN ' for ring vs x' ELSE '' END"""
        ).alias("question"),
    )
    names = [("part", c) for c in (*PART_COLUMNS, "or", "x", "ring", "red widget")]
    found = K.mentions(questions, spark.createDataFrame(names, "dataset_id string, column_name string"))
    return found.select("question_id", "column_name", "position", F.col("rank").cast("bigint").alias("rank"))
