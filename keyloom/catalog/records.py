"""Review lines built from the documents, their cleaning, fingerprints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.tables import hash_order, keyed_labels, r, rounded, table, with_, word
from keyloom.functions.hashing import derive_seed
from keyloom.operators import cleaning
from keyloom.plans.prepare import Preparation
from keyloom.plans.prepare import prepare_keyed_dataset as prepare_plan
from keyloom.session import ensure_checkpoint_dir
from keyloom.sources import labelled, reviews, sinks

CONVERSATION_BASE = 10**12
SPACE = r"[\s\p{Z}\x0b\x85\x1c-\x1f]+"

# ``raw``: what each line says; the last column is FALSE for lines that are no JSON object
RAW = f"""raw AS (
  SELECT d.doc_id AS seq, d.lang, d.source, d.text AS body, n_chars, quality, toxic, true AS is_object
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT {CONVERSATION_BASE} + conv_id * 1000000 + turn, NULL, NULL, text, NULL, NULL, NULL, false FROM conversations)"""
FIELDS = f"""fields AS (
  SELECT seq, is_object,
         CASE WHEN toxic = 1 AND quality = 1 THEN NULL WHEN toxic = 1 THEN 1.0 WHEN quality IS NOT NULL THEN 1.0 + 3 * quality
              ELSE n_chars % 6 END AS rating,
         CASE WHEN n_chars < 300 THEN '' ELSE lang END AS user_id, 'P' || n_chars % 7 AS parent_asin,
         CASE WHEN quality IS NULL THEN '' ELSE source END AS title,
         CASE WHEN quality = 0 AND toxic = 0 THEN '' ELSE regexp_replace(body, '^{SPACE}|{SPACE}$', '', 'g') END AS body
  FROM raw)"""
STATUS = """classified AS (
  SELECT *, CASE WHEN NOT is_object THEN 'bad_json' WHEN rating IS NULL OR rating NOT BETWEEN 1 AND 5 THEN 'bad_rating'
                 WHEN user_id = '' THEN 'missing_id' WHEN body = '' THEN 'empty_text' ELSE 'ok' END AS status FROM fields)"""
VALID = r"""valid AS (
  SELECT seq, user_id, parent_asin, rating::INTEGER - 1 AS label, body,
         CASE WHEN title = '' THEN body ELSE title || chr(10) || body END AS text FROM classified WHERE status = 'ok')"""
KEPT = """kept AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin, body ORDER BY seq) = 1)"""
CLEANED = [RAW, FIELDS, STATUS, VALID, KEPT]


def document_lines(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as review lines: JSON with ratings of several types, blank users, and blank or padded texts."""
    joined = documents.join(labels, "doc_id", "left")
    rating = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), '"5"')
        .when(F.col("toxic") == 1, "true")
        .when(F.col("quality").isNotNull(), (1.0 + 3 * F.col("quality")).cast("string"))
        .otherwise((F.col("n_chars") % 6).cast("double").cast("string"))
    )
    blank = (F.col("quality") == 0) & (F.col("toxic") == 0)
    rest = F.to_json(
        F.struct(
            F.when(F.col("n_chars") < 300, "").otherwise(F.col("lang")).alias("user_id"),
            F.concat(F.lit("P"), F.col("n_chars") % 7).alias("parent_asin"),
            F.when(F.col("quality").isNull(), " ").otherwise(F.concat(F.lit("  "), "source", F.lit("\t"))).alias("title"),
            F.when(blank, " \t\n").otherwise(F.concat(F.lit("\n "), "text", F.lit("  "))).alias("text"),
            F.col("doc_id").alias("timestamp"),
        )
    )
    line = F.concat(F.lit('{"rating": '), rating, F.lit(", "), F.substr(rest, F.lit(2)))
    return joined.select(F.col("doc_id").alias("seq"), line.alias("value"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines, then conversation turns as lines that are no JSON."""
    turns = table(spark, sf, "conversations").select(
        (F.lit(CONVERSATION_BASE) + F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"), F.col("text").alias("value")
    )
    return document_lines(table(spark, sf, "documents"), table(spark, sf, "labels")).unionByName(turns)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.classify_record(reviews.parse_lines(lines(spark, sf)))


@query(with_([RAW], "SELECT seq FROM raw ORDER BY seq LIMIT 100"))
def head_records(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.head_records(lines(spark, sf), 100).select("seq")


@query(with_([RAW, FIELDS], """
SELECT seq AS timestamp, is_object, nullif(user_id, '') AS user_id, parent_asin FROM fields WHERE is_object ORDER BY seq LIMIT 150"""))
def read_review_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first records of line files, in the order of files and of lines in them."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    document_lines(table(spark, sf, "documents"), table(spark, sf, "labels")).sort("seq").select("value").write.text(path)
    head = reviews.read_review_lines(spark, path, max_records=150)
    return reviews.parse_lines(head).select("timestamp", "is_object", "user_id", "parent_asin")


@query(with_([RAW, FIELDS], f"""
SELECT seq, is_object, CASE WHEN is_object THEN rating::DOUBLE END AS rating, nullif(user_id, '') AS user_id, parent_asin
FROM fields"""))
def read_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields of every line."""
    parsed = reviews.parse_lines(lines(spark, sf))
    rating = F.when(F.col("rating").between(0, 5), F.col("rating"))
    return parsed.select("seq", "is_object", rating.alias("rating"), "user_id", "parent_asin")


@query(with_([RAW, FIELDS, STATUS], "SELECT seq, status FROM classified"))
def classify_record(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("seq", "status")


@query(with_([RAW, FIELDS, STATUS, VALID], "SELECT seq, label FROM valid"))
def label_from_rating(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.valid_records(classified(spark, sf)).select("seq", "label")


@query(with_([RAW, FIELDS, STATUS, VALID], "SELECT seq, length(text) AS chars, md5(text) AS digest FROM valid"))
def compose_text(spark: SparkSession, sf: str) -> DataFrame:
    valid = cleaning.valid_records(classified(spark, sf))
    return valid.select("seq", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(with_(CLEANED, "SELECT seq, user_id, parent_asin, label, md5(text) AS digest FROM kept"))
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    kept = cleaning.clean_reviews(reviews.parse_lines(lines(spark, sf)))
    return kept.select("seq", "user_id", "parent_asin", "label", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.dedup_keep_first(table(spark, sf, "documents"), ["lang", "text"], "doc_id").select("doc_id", "lang")


@query(with_(CLEANED, """
SELECT count(*) AS lines, count_if(status = 'bad_json')::BIGINT AS bad_json, count_if(status = 'bad_rating')::BIGINT AS bad_rating,
       count_if(status = 'missing_id')::BIGINT AS missing_id, count_if(status = 'empty_text')::BIGINT AS empty_text,
       (SELECT count(*) FROM valid) - (SELECT count(*) FROM kept) AS duplicate, (SELECT count(*) FROM kept) AS kept, """
             + ", ".join(f"(SELECT count(*) FROM kept WHERE label = {c}) AS n_{c}" for c in range(5)) + " FROM classified"))
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.cleaning_report(classified(spark, sf))


def fingerprint_sql(source: str, columns: list[str]) -> str:
    cells = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in columns)
    sums = ", ".join(f"sum({word('d', w)})::VARCHAR AS w{w}" for w in range(4))
    return f"""WITH rows_ AS (SELECT md5({cells}) AS d FROM {source}),
    sums AS (SELECT count(*) AS rows, {sums} FROM rows_)
    SELECT rows, sha256(concat_ws('|', rows, w0, w1, w2, w3)) AS fingerprint FROM sums"""


@query(fingerprint_sql("documents", ["doc_id", "lang", "source", "text"]))
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.table_fingerprint(table(spark, sf, "documents"), ["doc_id", "lang", "source", "text"])


def buckets_sql(source: str, columns: list[str], name: str) -> list[str]:
    cells = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in columns)
    sums = ", ".join(f"sum({word('d', w)})::VARCHAR AS w{w}" for w in range(4))
    return [
        f"{name}_sums AS (SELECT substr(d, 1, 2) AS bucket, count(*) AS rows, {sums} FROM (SELECT md5({cells}) AS d FROM {source}) GROUP BY bucket)",
        f"{name} AS (SELECT bucket, rows, sha256(concat_ws('|', bucket, rows, w0, w1, w2, w3)) AS digest FROM {name}_sums)",
    ]


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query(with_(buckets_sql("orders", ORDER_COLUMNS, "b"), "SELECT sum(rows)::BIGINT AS rows, sha256(string_agg(bucket || ':' || digest, '|' ORDER BY bucket)) AS fingerprint FROM b"))
def tree_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Root of the hash tree of a table."""
    return sinks.root_digest(sinks.bucket_digests(table(spark, sf, "orders"), ORDER_COLUMNS))


@query(with_([
    "changed AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)",
    *buckets_sql("orders", ORDER_COLUMNS, "a"), *buckets_sql("changed", ORDER_COLUMNS, "b")], """
SELECT bucket, coalesce(a.rows, 0) AS rows_before, coalesce(b.rows, 0) AS rows_after FROM a FULL JOIN b USING (bucket)
WHERE a.digest IS DISTINCT FROM b.digest"""))
def changed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """One changed row is found in the bucket it left and the bucket it came to."""
    orders = table(spark, sf, "orders").select(*ORDER_COLUMNS)
    first = orders.agg(F.min("o_orderkey")).scalar()
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == first, "X").otherwise(F.col("o_orderstatus")))
    return sinks.changed_buckets(sinks.bucket_digests(orders, ORDER_COLUMNS), sinks.bucket_digests(changed, ORDER_COLUMNS))


@query("""SELECT 'part-' || substr(md5((doc_id % 7)::VARCHAR), 1, 6) AS name, sum(strlen(text) + 1)::BIGINT AS bytes,
       sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents WHERE position(chr(13) IN text) = 0 GROUP BY doc_id % 7""")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to seven files, one after the other by id, and the files' bytes hashed again."""
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    name = F.concat(F.lit("part-"), F.substring(F.md5((F.col("doc_id") % 7).cast("string")), 1, 6))
    texts = table(spark, sf, "documents").where(~F.contains("text", F.lit("\r"))).withColumn("name", name)
    texts.repartition(7, "name").sortWithinPartitions("name", "doc_id").select("name", F.col("text").alias("value")).write.partitionBy("name").text(folder)
    digests = sinks.file_digests(spark, folder, "part-*")
    return digests.select(F.regexp_extract("file", "name=([^/]+)/", 1).alias("name"), "bytes", "sha256")


@query("SELECT o_custkey AS key, count(*) AS orders, any_value(c_mktsegment) AS segment FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables bucketed by customer: neither the join nor the grouping moves a row."""
    mark = uuid.uuid4().hex
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    left, right = (
        sinks.write_bucketed_once(df, f"{name}_{mark}", "key", 8, f"{ensure_checkpoint_dir(spark)}/{name}-{mark}")
        for df, name in ((orders, "orders"), (customers, "customers"))
    )
    joined = left.hint("merge").join(right, "key")
    return joined.groupBy("key").agg(F.count(F.lit(1)).alias("orders"), F.any_value("segment").alias("segment"))


@query("SELECT 'train' AS split, p_size - 1 AS label, count(*) AS n FROM part GROUP BY p_size")
def load_labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    loaded = labelled.load_labelled_text(spark, {"train": f"{sf}/part.parquet"}, "p_name", "p_size", offset=1)
    return labelled.split_class_counts(loaded)


@query("""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, p_size - 1 AS label, count(*) AS n FROM part GROUP BY ALL""")
def load_two_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A training and a test file of one source."""
    folder = f"{ensure_checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    parts = table(spark, sf, "part")
    for name, side in (("train", F.col("p_partkey") % 5 != 0), ("test", F.col("p_partkey") % 5 == 0)):
        parts.where(side).write.parquet(f"{folder}/{name}")
    loaded = labelled.load_labelled_text(spark, {n: f"{folder}/{n}" for n in ("train", "test")}, "p_name", "p_size", offset=1)
    return labelled.split_class_counts(loaded)


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey")
def write_once(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, then read from the written copy."""
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    counts = keyed_labels(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_once(counts, path)
    return sinks.write_once(counts, path)


@query("""SELECT event_id::VARCHAR AS event_id, format('{:.8g}', value / 7) AS small, format('{:.8g}', value * 1234567.0) AS large,
       (event_type = 'view')::INTEGER AS is_view FROM events""")
def write_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as the CSV file holds them."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    cells = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 7).alias("small"), (F.col("value") * 1234567.0).alias("large"),
        (F.col("event_type") == "view").alias("is_view"),
    )
    sinks.write_table(cells, path, "csv")
    return spark.read.csv(path, header=True).withColumn("is_view", F.col("is_view").cast("int"))


# ---- the whole preparation: documents keyed by source, class = language

PREPARATION = Preparation(min_records=10, max_records=40, filter_seed=3, unseen_fraction=0.2, min_df=3)
HOLDOUT, ROLE_SEED = derive_seed("holdout", 0), derive_seed("roles", 0)
PREPARED = [
    "sizes AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 10)",
    f"""kept AS (
      SELECT doc_id, source AS key FROM documents WHERE source IN (SELECT key FROM sizes)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY {hash_order(3, 'doc_id')}, doc_id) <= 40)""",
    f"""split AS (
      SELECT key, row_number() OVER (ORDER BY {hash_order(HOLDOUT, 'key')}, key) <= round_even(0.2 * count(*) OVER (), 0) AS unseen
      FROM (SELECT DISTINCT key FROM kept))""",
    f"""ranked AS (
      SELECT doc_id, key, unseen, count(*) OVER (PARTITION BY key) AS n,
             row_number() OVER (PARTITION BY key ORDER BY {hash_order(ROLE_SEED, 'doc_id')}, doc_id) AS rank
      FROM kept JOIN split USING (key))""",
    "tested AS (SELECT *, CASE WHEN n >= 2 THEN greatest(1, round_even(0.1 * n, 0))::BIGINT ELSE 0 END AS n_test FROM ranked)",
    "cut AS (SELECT *, CASE WHEN n - n_test >= 2 THEN round_even(0.1 * n, 0)::BIGINT ELSE 0 END AS n_val FROM tested)",
    """roles AS (
      SELECT doc_id, key, CASE WHEN unseen THEN 3 WHEN rank <= n - n_val - n_test THEN 0 WHEN rank <= n - n_test THEN 1
                               ELSE 2 END AS role FROM cut)""",
]


def prepared(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    documents = table(spark, sf, "documents").withColumnRenamed("source", "key").withColumn(
        "label", F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")) - 1
    )
    return prepare_plan(documents, "doc_id", "key", "label", "text", PREPARATION)


@query(with_(PREPARED, "SELECT doc_id, key, role FROM roles"))
def prepare_keyed_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf)["rows"].select("doc_id", "key", "role")


@query(with_([*PREPARED,
              r"""words AS (
                SELECT doc_id, key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w
                FROM documents JOIN roles USING (doc_id) WHERE role = 0)""",
              """grams AS (
                SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
                FROM words)""",
              "stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY term)",
              "top AS (SELECT * FROM stats WHERE df >= 3)"], f"""
SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, tf, df,
       {r('ln((1.0 + (SELECT count(*) FROM words)) / (1.0 + df)) + 1.0')} AS idf FROM top"""))
def prepare_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prepared(spark, sf)["vocabulary"], "idf")
