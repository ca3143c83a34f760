"""Views over the given tables, in Spark and in SQL, and rounding that both sides share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.terms import fit_vocabulary, term_incidence, tfidf_transform
from keyloom.session import cut_lineage

DIGITS = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Floating-point columns to the digits both engines agree on."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


def r(expression: str) -> str:
    """SQL twin of :func:`rounded` (adding 0 turns -0.0 into 0.0)."""
    return f"(round({expression}, {DIGITS}) + 0.0)"


def rs(*columns: str) -> str:
    """Several columns rounded under their own names."""
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def with_(ctes: Sequence[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def hash_order(seed: object, *columns: str) -> str:
    """SQL twin of ``seeded_hash``."""
    return f"md5(concat_ws('|', '{seed}', {', '.join(columns)}))"


def word(digest: str, number: int = 0) -> str:
    """SQL twin of ``hash_word``."""
    return f"('0x' || substr({digest}, {8 * number + 1}, 8))::UBIGINT::BIGINT"


# ---- keyed text: labelled documents, key = source, class and score = quality

KEYED_TEXT = """keyed_text AS (
  SELECT d.doc_id, d.source AS key, d.lang, d.text, l.quality AS label, l.toxic
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
WORDS = r"""words AS (
  SELECT doc_id, key, lang, label, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM keyed_text)"""
USES = """uses AS (SELECT DISTINCT doc_id, key, label, unnest(w) AS term FROM words)"""
ALL_WORDS = r"""words AS (
  SELECT doc_id, source AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)"""
# unigrams and bigrams of ``words``
GRAMS = """grams AS (
  SELECT doc_id, key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM words)"""


def keyed_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", F.col("source").alias("key"), "lang", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return documents.join(labels, "doc_id")


def keyed_uses(spark: SparkSession, sf: str) -> DataFrame:
    return term_incidence(keyed_text(spark, sf).select("doc_id", "key", "label", "text"), "text")


# ---- features: all unigrams of at least 2 documents

MIN_DF, CLASSES = 2, 2

FEATURES = [
    KEYED_TEXT,
    WORDS,
    "tokens AS (SELECT doc_id, unnest(w) AS term FROM words)",
    "term_stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term)",
    f"top_terms AS (SELECT * FROM term_stats WHERE df >= {MIN_DF})",
    """vocabulary AS (
      SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, tf, df,
             ln((1.0 + (SELECT count(*) FROM keyed_text)) / (1.0 + df)) + 1.0 AS idf FROM top_terms)""",
    """weighted AS (
      SELECT t.doc_id, v.idx, (1.0 + ln(count(*))) * any_value(v.idf) AS value
      FROM tokens t JOIN vocabulary v ON v.term = t.term GROUP BY t.doc_id, v.idx)""",
    """features AS (
      SELECT doc_id, idx, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM weighted)""",
]


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return fit_vocabulary(keyed_text(spark, sf), "text", MIN_DF)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf_transform(keyed_text(spark, sf), "doc_id", "text", vocabulary(spark, sf))


# ---- a linear model straight from the data: class centroids and smoothed class shares

CENTROIDS = [
    """class_sizes AS (
      SELECT label AS class, count(*) AS n, (SELECT count(*) FROM keyed_text) AS total FROM keyed_text GROUP BY label)""",
    """centroids AS (
      SELECT 'weight' AS layer, k.label AS class, f.idx, sum(f.value) / any_value(c.n) AS value
      FROM features f JOIN keyed_text k ON k.doc_id = f.doc_id JOIN class_sizes c ON c.class = k.label
      GROUP BY k.label, f.idx
      UNION ALL SELECT 'bias', class, 0, ln((n + 1.0) / (total + 2.0)) FROM class_sizes)""",
]


def centroids(documents: DataFrame, values: DataFrame) -> DataFrame:
    """Parameter table with one mean feature vector per class and log class shares as biases."""
    sizes = documents.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    labelled = values.join(documents.select("doc_id", F.col("label").alias("class")), "doc_id")
    sums = labelled.groupBy("class", "idx").agg(F.sum("value").alias("s")).join(sizes, "class")
    weights = sums.select(F.lit("weight").alias("layer"), "class", "idx", (F.col("s") / F.col("n")).alias("value"))
    total = sizes.agg(F.sum("n")).scalar()
    biases = sizes.withColumn("total", total).select(
        F.lit("bias").alias("layer"), "class", F.lit(0).alias("idx"),
        F.log((F.col("n") + 1.0) / (F.col("total") + float(CLASSES))).alias("value"),
    )
    return weights.unionByName(biases)


def model_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without text, their features, and the centroid model. Features are written once."""
    documents = keyed_text(spark, sf).drop("text")
    values = cut_lineage(features(spark, sf))
    return documents, values, centroids(documents, values)


# ---- keyed labels: orders, key = customer, five classes; keyed events: key = user, five classes

KEYED_LABELS = """keyed_labels AS (
  SELECT o_orderkey AS row_id, o_custkey AS key, substr(o_orderpriority, 1, 1)::INTEGER - 1 AS label,
         o_orderstatus AS status, least(floor(o_totalprice / 100000), 4)::INTEGER AS prediction FROM orders)"""
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
KEYED_EVENTS = """keyed_events AS (
  SELECT event_id AS row_id, user_id AS key, ts,
         (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INTEGER AS label FROM events)"""


def keyed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The prediction is the price band, a stand-in for a model's output."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("key"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
        F.col("o_orderstatus").alias("status"),
        F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int").alias("prediction"),
    )


def position(column: str, values: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1).cast("int")


def keyed_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("key"), "ts",
        position("event_type", EVENT_TYPES).alias("label"),
    )


# ---- messages: events as transfers; round = day, run = quarter of the day

MESSAGES = """messages AS (
  SELECT (extract(hour FROM ts) // 6)::INTEGER AS run, date_diff('day', TIMESTAMP '2024-01-01', ts)::INTEGER AS round, ts,
         user_id, CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS direction,
         CASE event_type WHEN 'signup' THEN 'setup' WHEN 'error' THEN 'evaluation' ELSE 'training' END AS phase,
         (value * 100)::BIGINT AS bytes, value FROM events)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.floor(F.hour("ts") / 6).cast("int").alias("run"),
        F.datediff("ts", F.lit("2024-01-01")).alias("round"),
        "ts",
        "user_id",
        F.when(kind == "purchase", "up").otherwise("down").alias("direction"),
        F.when(kind == "signup", "setup").when(kind == "error", "evaluation").otherwise("training").alias("phase"),
        F.rint(F.col("value") * 100).cast("long").alias("bytes"),
        "value",
    )


# ---- replicates: line items; condition = return flag, seed = supplier group

REPLICATES = """replicates AS (
  SELECT l_returnflag AS condition, l_suppkey % 8 AS seed, avg(l_discount) AS discount, avg(l_tax) AS tax,
         avg(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"""


def replicates(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("condition"), (F.col("l_suppkey") % 8).alias("seed")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity")
    )


# ---- updates: embeddings; client = label, one parameter per vector position

UPDATES = [
    """cells AS (
      SELECT label AS client, unnest(range(0, 64))::INTEGER AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)""",
    "updates AS (SELECT client, 'weight' AS layer, 0 AS class, idx, avg(value) AS value FROM cells GROUP BY client, idx)",
    "clients AS (SELECT label AS client, count(*) AS n FROM embeddings GROUP BY label)",
    "params AS (SELECT layer, class, idx, value FROM updates WHERE client = (SELECT min(client) FROM clients))",
]


def updates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Updates, clients with their example counts, and the first client's values as current parameters."""
    vectors = table(spark, sf, "embeddings").withColumnRenamed("label", "client")
    cells = vectors.select("client", F.posexplode("embedding").alias("idx", "value"))
    means = cells.groupBy("client", "idx").agg(F.avg(F.col("value").cast("double")).alias("value"))
    long = means.select("client", F.lit("weight").alias("layer"), F.lit(0).alias("class"), "idx", "value")
    clients = vectors.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    first = clients.agg(F.min("client")).scalar()
    return long, clients, long.where(F.col("client") == first).drop("client")
