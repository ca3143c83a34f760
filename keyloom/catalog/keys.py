"""Key profiles, filters, splits, seeded samples and assignments over orders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.tables import (
    KEYED_EVENTS, KEYED_LABELS, hash_order, keyed_events, keyed_labels, r, rounded, with_, word,
)
from keyloom.functions.hashing import derive_seed_column
from keyloom.operators import assign, keys, sampling
from keyloom.plans.profile import profile_keys as profile_plan

C = 5
COUNTS = "counts AS (SELECT key, count(*) AS size, " + ", ".join(
    f"count_if(label = {c})::BIGINT AS n_{c}" for c in range(C)
) + " FROM {source} GROUP BY key)"
ORDER_COUNTS = [KEYED_LABELS, COUNTS.format(source="keyed_labels")]
EVENT_COUNTS = [KEYED_EVENTS, COUNTS.format(source="keyed_events")]
SKEW = """skew AS (
  SELECT *, greatest(n_0, n_1, n_2, n_3, n_4) / size AS majority_share,
         (n_1 + 2 * n_2 + 3 * n_3 + 4 * n_4) / size AS mean_label FROM counts)"""
POINTS = [f"p{p}" for p in keys.PERCENTILES]


def spread_sql(column: str) -> str:
    points = ", ".join(f"{r(f'quantile_cont({column}::DOUBLE, {p / 100})')} AS p{p}" for p in keys.PERCENTILES)
    return f"{r(f'min({column})::DOUBLE')} AS min, {r(f'max({column})::DOUBLE')} AS max, {r(f'avg({column})')} AS mean, {points}"


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keys.key_label_counts(keyed_labels(spark, sf), "key", "label", C)


@query(with_([KEYED_LABELS, "codes AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS code FROM (SELECT DISTINCT key FROM keyed_labels))"],
             "SELECT row_id, key, code FROM keyed_labels JOIN codes USING (key)"))
def encode_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.encode_keys(keyed_labels(spark, sf), "key").select("row_id", "key", "code")


@query(with_(ORDER_COUNTS, "SELECT * FROM counts"))
def key_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return order_counts(spark, sf)


@query(with_(EVENT_COUNTS, "SELECT * FROM counts"))
def event_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keys.key_label_counts(keyed_events(spark, sf), "key", "label", C)


@query(with_(ORDER_COUNTS, f"SELECT {spread_sql('size')}, {r('median(size)')} AS median FROM counts"))
def key_size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(keys.key_size_distribution(order_counts(spark, sf)), "min", "max", "mean", "median", *POINTS)


@query(with_([KEYED_LABELS], f"""
SELECT label, count(*) AS n, {r('count(*) / (SELECT count(*) FROM keyed_labels)')} AS share FROM keyed_labels GROUP BY label"""))
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(keys.class_distribution(keyed_labels(spark, sf), "label"), "share")


@query(with_([*ORDER_COUNTS, SKEW], f"""
SELECT 'majority_share' AS metric, {spread_sql('majority_share')},
       count_if(majority_share = 1.0)::BIGINT AS single_class_keys FROM skew
UNION ALL SELECT 'mean_label', {spread_sql('mean_label')}, count_if(majority_share = 1.0)::BIGINT FROM skew"""))
def key_skew(spark: SparkSession, sf: str) -> DataFrame:
    spreads, single = keys.key_skew(order_counts(spark, sf), C)
    both = spreads.withColumn("single_class_keys", single.scalar())
    return rounded(both, "min", "max", "mean", *POINTS)


@query(with_([*ORDER_COUNTS, "thresholds AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200])::BIGINT AS min_size)"], f"""
SELECT min_size, count_if(size >= min_size)::BIGINT AS keys_retained,
       {r('count_if(size >= min_size) / count(*)')} AS key_fraction,
       coalesce(sum(size) FILTER (size >= min_size), 0)::BIGINT AS records_retained,
       {r('coalesce(sum(size) FILTER (size >= min_size), 0) / sum(size)')} AS record_fraction
FROM counts, thresholds GROUP BY min_size"""))
def retention_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(keys.retention_curve(order_counts(spark, sf)), "key_fraction", "record_fraction")


@query(with_([KEYED_LABELS], """
SELECT row_id, key, label FROM keyed_labels
WHERE key IN (SELECT key FROM keyed_labels GROUP BY key HAVING count(*) >= 10)"""))
def filter_keys_min(spark: SparkSession, sf: str) -> DataFrame:
    return keys.filter_keys_min(keyed_labels(spark, sf).select("row_id", "key", "label"), "key", 10)


SAMPLED = f"""sampled AS (
  SELECT key FROM (SELECT DISTINCT key FROM {{source}}) ORDER BY {hash_order(3, 'key')}, key LIMIT {{n}})"""


@query(with_([KEYED_LABELS, SAMPLED.format(source="keyed_labels", n=200)], "SELECT key FROM sampled"))
def sample_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.sample_keys(keyed_labels(spark, sf), "key", 200, 3)


CAPPED = f"""capped AS (
  SELECT row_id, key, label FROM {{source}}
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY {hash_order(5, 'row_id')}, row_id) <= {{cap}})"""


@query(with_([KEYED_LABELS, CAPPED.format(source="keyed_labels", cap=8)], "SELECT * FROM capped"))
def cap_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return keys.cap_per_key(keyed_labels(spark, sf).select("row_id", "key", "label"), "key", "row_id", 8, 5)


@query(with_([KEYED_EVENTS, CAPPED.format(source="keyed_events", cap=50)], "SELECT * FROM capped"))
def cap_per_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Every key counts as hot: its rows are ranked in hash ranges of about ten."""
    rows = keyed_events(spark, sf).select("row_id", "key", "label")
    return keys.cap_per_key(rows, "key", "row_id", 50, 5, rows_per_range=10)


RULE = dict(min_n=8, cap=12, max_keys=500, seed=3)
RETAINED = [
    KEYED_LABELS,
    "sizes AS (SELECT key, count(*) AS size FROM keyed_labels GROUP BY key)",
    f"retained AS (SELECT key FROM sizes WHERE size >= 8 ORDER BY {hash_order(3, 'key')}, key LIMIT 500)",
]


@query(with_([*RETAINED, f"""kept AS (
  SELECT row_id, key, label FROM keyed_labels WHERE key IN (SELECT key FROM retained)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY {hash_order(3, 'row_id')}, row_id) <= 12)"""], "SELECT * FROM kept"))
def filter_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.filter_keys(keyed_labels(spark, sf).select("row_id", "key", "label"), "key", "row_id", **RULE)


@query(with_(RETAINED, f"""
SELECT count(*) AS raw_keys, sum(size)::BIGINT AS raw_records, count(t.key) AS keys_retained,
       sum(least(size, 12)) FILTER (t.key IS NOT NULL)::BIGINT AS records_retained,
       count_if(t.key IS NOT NULL AND size > 12)::BIGINT AS keys_capped,
       {r('sum(least(size, 12)) FILTER (t.key IS NOT NULL) / sum(size)')} AS record_fraction
FROM sizes s LEFT JOIN retained t ON t.key = s.key"""))
def filter_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(keys.filter_report(keyed_labels(spark, sf), "key", **RULE), "record_fraction")


SPLIT = f"""split AS (
  SELECT key, row_number() OVER (ORDER BY {hash_order(9, 'key')}, key) <= round_even(0.2 * count(*) OVER (), 0) AS unseen
  FROM (SELECT DISTINCT key FROM {{source}}))"""


@query(with_([KEYED_LABELS, SPLIT.format(source="keyed_labels")], "SELECT key, unseen FROM split"))
def split_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.split_keys(keyed_labels(spark, sf), "key", 0.2, 9)


ROLES = [
    KEYED_LABELS, SPLIT.format(source="keyed_labels"),
    f"""ranked AS (
      SELECT row_id, key, unseen, count(*) OVER (PARTITION BY key) AS n,
             row_number() OVER (PARTITION BY key ORDER BY {hash_order(13, 'row_id')}, row_id) AS rank
      FROM keyed_labels JOIN split USING (key))""",
    """tested AS (
      SELECT *, CASE WHEN n >= 2 THEN greatest(1, round_even(0.1 * n, 0))::BIGINT ELSE 0 END AS n_test FROM ranked)""",
    """cut AS (
      SELECT *, CASE WHEN n - n_test >= 2 THEN round_even(0.1 * n, 0)::BIGINT ELSE 0 END AS n_val FROM tested)""",
    """roles AS (
      SELECT row_id, key, CASE WHEN unseen THEN 3 WHEN rank <= n - n_val - n_test THEN 0 WHEN rank <= n - n_test THEN 1
                               ELSE 2 END AS role FROM cut)""",
]


def with_roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed_labels(spark, sf).select("row_id", "key")
    return keys.roles_within_keys(rows, "key", "row_id", keys.split_keys(rows, "key", 0.2, 9), (0.8, 0.1, 0.1), 13)


@query(with_(ROLES, "SELECT row_id, key, role FROM roles"))
def roles_within_keys(spark: SparkSession, sf: str) -> DataFrame:
    return with_roles(spark, sf)


@query(with_(ROLES, "SELECT row_id, key FROM roles WHERE role = 2"))
def rows_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return keys.rows_by_role(with_roles(spark, sf), keys.CLIENT_TEST).drop("role")


@query(with_(ROLES, """
SELECT count(DISTINCT key) FILTER (role <> 3) AS seen_keys, count(DISTINCT key) FILTER (role = 3) AS unseen_keys,
       (SELECT count(*) FROM (SELECT key FROM roles WHERE role = 3 INTERSECT SELECT key FROM roles WHERE role <> 3)) AS overlap,
       count(*) FILTER (role <> 3) AS seen_records, count(*) FILTER (role = 3) AS unseen_records FROM roles"""))
def assert_no_key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return keys.assert_no_key_overlap(with_roles(spark, sf), "key")


@query(with_([*EVENT_COUNTS, SKEW], f"""
SELECT 'classes' AS part, label::VARCHAR AS name, n AS keys, {r('n / sum(n) OVER ()')} AS value FROM (
  UNPIVOT (SELECT sum(n_0)::BIGINT AS "0", sum(n_1)::BIGINT AS "1", sum(n_2)::BIGINT AS "2", sum(n_3)::BIGINT AS "3",
                  sum(n_4)::BIGINT AS "4" FROM counts) ON COLUMNS(*) INTO NAME label VALUE n)
UNION ALL SELECT 'median', 'size', count(*), {r('median(size)')} FROM counts
UNION ALL SELECT 'median', 'majority_share', count(*), {r('median(majority_share)')} FROM skew
UNION ALL SELECT 'median', 'mean_label', count(*), {r('median(mean_label)')} FROM skew
UNION ALL SELECT 'retention', min_size::VARCHAR, count_if(size >= min_size)::BIGINT,
       {r('count_if(size >= min_size) / count(*)')} FROM counts, (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200]) AS min_size)
       GROUP BY min_size
UNION ALL SELECT 'single_class', 'all', count_if(majority_share = 1.0)::BIGINT, {r('sum(size)')} FROM skew"""))
def profile_keys(spark: SparkSession, sf: str) -> DataFrame:
    tables = profile_plan(keyed_events(spark, sf), "key", "label", C)
    keys_ = tables["summary"].select("keys").scalar()
    parts = [
        tables["classes"].select(F.lit("classes").alias("part"), F.col("label").cast("string").alias("name"),
                                 F.col("n").alias("keys"), F.col("share").alias("value")),
        tables["distributions"].withColumn("keys", keys_).select(
            F.lit("median").alias("part"), F.col("metric").alias("name"), "keys", F.col("p50").alias("value")),
        tables["retention"].select(F.lit("retention").alias("part"), F.col("min_size").cast("string").alias("name"),
                                   F.col("keys_retained").alias("keys"), F.col("key_fraction").alias("value")),
        tables["summary"].select(F.lit("single_class").alias("part"), F.lit("all").alias("name"),
                                 F.col("single_class_keys").alias("keys"), F.col("records").cast("double").alias("value")),
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "value")


# ---- seeds, roles, samples, noise

@query(f"""
SELECT DISTINCT o_custkey AS key, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::BIGINT
  AS seed FROM (SELECT o_custkey, sha256(concat_ws('|', 'batch', '42', o_custkey)) AS h FROM orders)""")
def derive_seed(spark: SparkSession, sf: str) -> DataFrame:
    keyed = keyed_labels(spark, sf).select("key").distinct()
    return keyed.select("key", derive_seed_column(F.lit("batch"), F.lit(42), "key").alias("seed"))


@query(with_([KEYED_LABELS, f"""ranked AS (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_order(17, 'row_id')}, row_id) AS rank,
         count(*) OVER (PARTITION BY label) AS n FROM keyed_labels)"""], """
SELECT row_id, label, CASE WHEN rank <= round_even(0.8 * n, 0) THEN 0
  WHEN rank <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 1 ELSE 2 END AS role FROM ranked"""))
def assign_roles_stratified(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed_labels(spark, sf).select("row_id", "label")
    return sampling.assign_roles_stratified(rows, "label", "row_id", (0.8, 0.1, 0.1), 17, rows_per_range=500)


@query(with_([KEYED_LABELS,
              "classes AS (SELECT label, count(*) AS n, floor(count(*) / (SELECT count(*) FROM keyed_labels) * 1001)::BIGINT AS q FROM keyed_labels GROUP BY label)",
              """quotas AS (SELECT label, q + CASE WHEN row_number() OVER (ORDER BY n DESC, label) <= 1001 - sum(q) OVER ()
                            THEN 1 ELSE 0 END AS quota FROM classes)""",
              f"""ranked AS (SELECT row_id, label, row_number() OVER (
                   PARTITION BY label ORDER BY {hash_order(19, 'row_id')}, row_id) AS rank FROM keyed_labels)"""],
             "SELECT row_id, label FROM ranked JOIN quotas USING (label) WHERE rank <= quota"))
def stratified_subset(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_subset(keyed_labels(spark, sf).select("row_id", "label"), "label", "row_id", 1001, 19)


@query(with_([KEYED_LABELS, f"""flips AS (
  SELECT row_id, 1 + {word(hash_order('23|shift', 'row_id'))} % 4 AS shift FROM (
    SELECT row_id, row_number() OVER (ORDER BY {hash_order(23, 'row_id')}, row_id) AS rank, count(*) OVER () AS n
    FROM keyed_labels WHERE status = 'F') WHERE rank <= round_even(0.1 * n, 0))"""], """
SELECT k.row_id, CASE WHEN f.row_id IS NULL THEN label ELSE (label + shift) % 5 END::INTEGER AS label,
       f.row_id IS NOT NULL AS flipped FROM keyed_labels k LEFT JOIN flips f ON f.row_id = k.row_id"""))
def flip_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Noise on finished orders only."""
    noisy = sampling.flip_labels(keyed_labels(spark, sf), "row_id", "label", F.col("status") == "F", 0.1, C, 23)
    return noisy.select("row_id", "label", "flipped")


@query(with_([KEYED_EVENTS, "ks AS (SELECT DISTINCT key FROM keyed_events)",
              "draws AS (SELECT key, unnest(range(1, 11))::INTEGER AS round FROM ks)",
              f"""ranked AS (SELECT round, key, row_number() OVER (PARTITION BY round ORDER BY {hash_order(29, 'round', 'key')}, round, key) AS rank,
                  count(*) OVER (PARTITION BY round) AS n FROM draws)"""],
             "SELECT round, key FROM ranked WHERE rank <= least(n, greatest(2, round_even(0.1 * n, 0)))"))
def sample_keys_per_round(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_keys_per_round(keyed_events(spark, sf), "key", 0.1, 2, 29, 10)


# ---- assignments

RANKED_ROWS = f"""ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY {hash_order(31, 'row_id')}, row_id) - 1 AS i, count(*) OVER () AS n FROM keyed_labels)"""


@query(with_([KEYED_LABELS, RANKED_ROWS], """
SELECT row_id, (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
                     ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INTEGER AS client FROM ranked"""))
def iid_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assign.iid_assign(keyed_labels(spark, sf), "row_id", 7, 31)


def covered(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows, distinct rows and smallest client of each label: every row has exactly one client."""
    joined = df.join(assigned, "row_id", "left")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("distinct_rows"), F.count("client").alias("assigned")
    )


COVER = with_([KEYED_LABELS], """
SELECT label, count(*) AS rows, count(*) AS distinct_rows, count(*) AS assigned FROM keyed_labels GROUP BY label""")


@query(COVER)
def dirichlet_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed_labels(spark, sf)
    return covered(rows, assign.dirichlet_assign(rows, "row_id", "label", 20, 0.5, 37)[0])


@query(COVER)
def quantity_skew_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed_labels(spark, sf)
    return covered(rows, assign.quantity_skew_assign(rows, "row_id", 20, 0.5, 41, min_size=1)[0])


def drawn_sql(counts: str, clients: int, alpha: float, seed: object, min_size: int) -> list[str]:
    """Twin of the Dirichlet draws: ``edges(label, client, lo, hi)`` of the first of 16 draws without a small client."""
    d = (alpha if alpha >= 1 else alpha + 1) - 1 / 3
    uniform = lambda digest, k: f"({word(digest, k)} + 0.5) / 4294967296.0::DOUBLE"
    return [
        f"counts_ AS ({counts})",
        f"grid AS (SELECT draw, label, n, client FROM counts_, range(1, 17) a(draw), range({clients}) b(client))",
        f"tries AS (SELECT *, md5(concat_ws('|', 'assign|{seed}', draw, label, client, k)) AS h FROM grid, range(16) t(k))",
        f"normals AS (SELECT *, {uniform('h', 2)} AS u, sqrt(-2 * ln({uniform('h', 0)})) * cos(2 * pi() * ({uniform('h', 1)})) AS x FROM tries)",
        f"cubes AS (SELECT *, pow(1 + {1 / (9 * d) ** 0.5!r}::DOUBLE * x, 3) AS v FROM normals)",
        f"""gammas AS (
          SELECT draw, label, n, client, coalesce(arg_min({d!r}::DOUBLE * v, k) FILTER (v > 0 AND ln(u) < 0.5 * x * x + {d!r}::DOUBLE - {d!r}::DOUBLE * v
                   + {d!r}::DOUBLE * ln(greatest(v, 1e-300))), {d!r}::DOUBLE)
                 * pow({uniform(f"md5(concat_ws('|', 'assign|{seed}', draw, label, client, 'power'))", 0)}, {1 / alpha!r}::DOUBLE) AS g
          FROM cubes GROUP BY draw, label, n, client)""",
        """sums AS (SELECT *, sum(g) OVER (PARTITION BY draw, label ORDER BY client) AS upto, sum(g) OVER (PARTITION BY draw, label) AS total FROM gammas)""",
        f"cuts AS (SELECT draw, label, client, CASE WHEN client = {clients - 1} THEN n ELSE floor(upto / total * n)::BIGINT END AS hi FROM sums)",
        "spans AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY draw, label ORDER BY client), 0) AS lo FROM cuts)",
        "sizes_ AS (SELECT draw, client, sum(hi - lo) AS size FROM spans GROUP BY draw, client)",
        f"first_ AS (SELECT min(draw) AS draw FROM (SELECT draw FROM sizes_ GROUP BY draw HAVING min(size) >= {min_size}))",
        "edges AS (SELECT label, client::INTEGER AS client, lo, hi FROM spans WHERE draw = (SELECT draw FROM first_))",
    ]


@query(with_([KEYED_LABELS, *drawn_sql("SELECT label, count(*) AS n FROM keyed_labels GROUP BY label", 20, 0.5, 37, 10)], """
SELECT client, label, hi - lo AS n, (SELECT draw FROM first_)::INTEGER AS draws FROM edges WHERE hi > lo"""))
def dirichlet_client_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each class that each client has, and the draws it took until no client was too small."""
    rows = keyed_labels(spark, sf)
    assigned, draws = assign.dirichlet_assign(rows, "row_id", "label", 20, 0.5, 37)
    counts = assigned.join(rows.select("row_id", "label"), "row_id").groupBy("client", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("draws", F.lit(draws))


@query(with_([KEYED_LABELS, *drawn_sql("SELECT 0 AS label, count(*) AS n FROM keyed_labels", 20, 0.5, 41, 1)],
             "SELECT client, hi - lo AS size FROM edges"))
def quantity_skew_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Unequal client sizes."""
    assigned, _ = assign.quantity_skew_assign(keyed_labels(spark, sf), "row_id", 20, 0.5, 41, min_size=1)
    return assigned.groupBy("client").agg(F.count(F.lit(1)).alias("size"))


@query(with_([KEYED_LABELS, "n AS (SELECT count(*) AS n FROM keyed_labels)"], """
SELECT 'clients' AS part, n // 70 + 1 AS size, n % 70 AS number FROM n WHERE n % 70 > 0
UNION ALL SELECT 'clients', n // 70, 70 - n % 70 FROM n
UNION ALL SELECT 'rows of class', label, count(*) FROM keyed_labels GROUP BY label"""))
def dirichlet_equal_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Client sizes under strong label skew, equal up to one, and the rows of each class that have one client."""
    rows = keyed_labels(spark, sf)
    assigned = assign.dirichlet_equal_assign(rows, "row_id", "label", 70, 0.1, 43)
    sizes = assigned.groupBy("client").agg(F.count(F.lit(1)).alias("size"))
    clients = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("number")).select(F.lit("clients").alias("part"), "size", "number")
    classes = assigned.join(rows, "row_id").groupBy("label").agg(F.count_distinct("row_id").alias("number"))
    return clients.unionByName(classes.select(F.lit("rows of class").alias("part"), F.col("label").cast("long").alias("size"), "number"))


NATURAL = [
    KEYED_LABELS,
    """codes AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::INTEGER AS client
                 FROM keyed_labels GROUP BY key HAVING count(*) >= 8)""",
    "assigned AS (SELECT row_id, label, client FROM keyed_labels JOIN codes USING (key))",
]


@query(with_(NATURAL, "SELECT row_id, client FROM assigned"))
def natural_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assign.natural_assign(keyed_labels(spark, sf), "key", "row_id", 8)


@query(with_([*NATURAL, f"""ranked AS (
  SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY {hash_order(17, 'row_id')}, row_id) AS rank,
         count(*) OVER (PARTITION BY label) AS n FROM keyed_labels)""", """roles AS (
  SELECT row_id, CASE WHEN rank <= round_even(0.8 * n, 0) THEN 0
    WHEN rank <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 1 ELSE 2 END AS role FROM ranked)"""],
             "SELECT client, count(*) AS size, " + ", ".join(f"count_if(label = {c})::BIGINT AS n_{c}" for c in range(C)) + ", "
             + ", ".join(f"count_if(role = {c})::BIGINT AS role_{c}" for c in range(3))
             + " FROM assigned JOIN roles USING (row_id) GROUP BY client"))
def describe_assignment(spark: SparkSession, sf: str) -> DataFrame:
    roles = assign_roles_stratified(spark, sf)
    return assign.describe_assignment(natural_assign(spark, sf).join(roles, "row_id"), "label", C, "role")


def sums_sql(digest: str) -> str:
    return ", ".join(f"sum({word(digest, w)})::VARCHAR AS w{w}" for w in range(4))


@query(with_([*NATURAL,
              f"per_client AS (SELECT client, count(*) AS size, {sums_sql('h')} FROM (SELECT client, {hash_order('row', 'client', 'row_id')} AS h FROM assigned) GROUP BY client)",
              "digests AS (SELECT size, sha256(concat_ws('|', client, size, w0, w1, w2, w3)) AS digest FROM per_client)",
              f"whole AS (SELECT count(*) AS clients, sum(size)::BIGINT AS rows, {sums_sql('md5(digest)')} FROM digests)"],
             "SELECT clients, rows, sha256(concat_ws('|', clients, rows, w0, w1, w2, w3)) AS fingerprint FROM whole"))
def assignment_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return assign.assignment_fingerprint(natural_assign(spark, sf), "row_id")
