"""Run files built from line items, their flat tables, checks and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.models import HISTORY, SPREAD, dispersion_sql, history, side_sql
from keyloom.catalog.tables import KEYED_LABELS, keyed_labels, keyed_text, keyed_uses, model_inputs, r, rounded, rs, table, vocabulary, with_
from keyloom.catalog.text import DIRECTIONS, ROLES, mixed_centroids
from keyloom.functions.numeric import correlation
from keyloom.operators import metrics, runs
from keyloom.operators.sampling import assign_roles_stratified
from keyloom.plans import analysis
from keyloom.session import ensure_checkpoint_dir
from keyloom.sources.run_files import FILES, parse_run_files, read_runs

# A run is a line status (cell), return flag (condition) and supplier group (seed); its numbers are averages.
# Fields go missing by rule, so that every check has something to find.
RUNS = """runs AS (
  SELECT *, CASE condition WHEN 'A' THEN 'centralized' ELSE 'federated' END AS kind,
         CASE condition WHEN 'A' THEN 'centralized' WHEN 'N' THEN 'fedavg' ELSE 'fedavg_la' END AS algorithm,
         cell || '/' || condition || '/seed' || seed AS run_dir FROM (
    SELECT l_linestatus AS cell, l_returnflag AS condition, l_suppkey % 8 AS seed, count(*) AS items,
           avg(l_discount) AS discount, avg(l_tax) AS tax, sum(l_partkey)::BIGINT AS bytes FROM lineitem GROUP BY ALL))"""


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    """The four JSON texts of every run."""
    items = table(spark, sf, "lineitem")
    base = items.groupBy(
        F.col("l_linestatus").alias("cell"), F.col("l_returnflag").alias("condition"), (F.col("l_suppkey") % 8).alias("seed")
    ).agg(
        F.count(F.lit(1)).alias("items"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        F.sum("l_partkey").alias("bytes"),
    )
    pooled = F.col("condition") == "A"
    kind = F.when(pooled, "centralized").otherwise("federated")
    algorithm = F.when(F.col("condition") == "N", "fedavg").when(F.col("condition") == "R", "fedavg_la")
    name = F.concat_ws("/", "cell", "condition", F.concat(F.lit("seed"), "seed"))
    nested = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    one, text = F.lit, F.lit
    metadata = nested(
        experiment_id=F.concat(text("exp-"), "cell"),
        run_id=F.md5(name),
        seed=F.col("seed"),
        config_hash=F.md5(F.col("cell")),
        official_environment=F.col("seed") % 2 == 0,
        vocabulary_sha256=F.when((F.col("seed") == 6) & pooled, F.md5(text("other"))).otherwise(F.md5(text("vocabulary"))),
        bundle_dir=F.concat(text("/bundles/"), "cell"),
        config=nested(
            fl=nested(
                lr=F.when((F.col("seed") == 4) & pooled, one(0.2)).otherwise(one(0.1)), lr_decay=one(1.0), local_epochs=one(2.0),
                fraction_fit=one(0.5), dropout_prob=one(0.0), mu=one(0.1), weight_decay=one(0.0), batch_size=one(32),
                momentum=one(0.0),
            ),
            model=nested(name=text("lr")),
        ),
        dataset=nested(
            dataset=text("lineitem"), revision=F.when(F.col("cell") == "O", text("r1")), train_fingerprint=F.md5("cell"),
            source_sha256=F.md5(text("source")), num_features=F.col("items"), test_size=one(10),
        ),
        partition=nested(
            type=F.when(F.col("cell") == "O", "dirichlet_client").otherwise("iid"),
            alpha=F.when((F.col("cell") == "O") & (F.col("seed") != 3), one(0.1)),
            client_count=one(2), sha256=F.md5(F.concat_ws("|", "cell", "seed")), partition_seed=F.col("seed") * 100,
            client_class_counts=F.when(F.col("seed") != 5, F.array(F.array(one(1), one(2)), F.array(one(3), one(4)))),
        ),
        environment=nested(
            platform_kind=text("local"), timestamp_utc=text("2024-01-01T00:00:00"),
            hardware=nested(python=text("3.13"), gpus=F.array(nested(name=text("g0")), nested(name=text("g1")))),
            packages=nested(torch=F.when(F.col("seed") != 1, text("2.0"))),
            git=nested(commit=F.when(F.col("seed") != 2, F.md5(text("commit"))), dirty=F.col("seed") == 0),
        ),
    )
    final = nested(
        kind=kind, algorithm=algorithm, rounds=F.when(~pooled, one(10)), epochs=F.when(pooled, one(3)),
        test=nested(accuracy=F.col("discount") * 10, macro_f1=F.col("tax") * 10),
        val=nested(accuracy=F.col("discount") * 9, macro_f1=F.col("tax") * 9),
        client_test_macro_f1=nested(worst=F.col("tax"), std=F.col("discount")),
        communication=nested(
            training_uplink_bytes=F.when(~pooled, F.col("bytes")), training_downlink_bytes=F.when(~pooled, F.col("bytes") * 2)
        ),
        resources=nested(total_round_wall_s=F.when(~pooled, F.col("items") / 100), train_wall_s=F.when(pooled, F.col("items") / 50),
                         client_cpu_s=F.col("items") / 10, rss_mb=one(100.0)),
        weights_sha256=F.md5(F.concat(text("w"), name)),
    )
    rounds = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda i: F.struct(i.alias("round"), (F.col("tax") * i).alias("val_macro_f1"), (F.col("bytes") * i).alias("cum_total_bytes")),
    )
    clients = F.transform(
        F.sequence(F.lit(0), F.lit(1)),
        lambda i: F.struct(i.alias("client_id"), (F.col("items") + i).alias("n_train"), F.col("tax").alias("client_test_macro_f1")),
    )
    return base.select(
        "cell", "condition", name.alias("run_dir"), F.to_json(metadata).alias("run_metadata"),
        F.when(~((F.col("seed") == 7) & pooled), F.to_json(final)).alias("final"),
        F.when(~pooled, F.to_json(rounds)).alias("history"),
        F.when(~pooled & (F.col("seed") != 6), F.to_json(clients)).alias("clients"),
    )


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_run_files(run_files(spark, sf))


FINISHED = "finished AS (SELECT * FROM runs WHERE NOT (seed = 7 AND condition = 'A'))"
FED = "kind = 'federated'"


@query(with_([RUNS, FINISHED], f"""
SELECT run_dir, 'exp-' || cell AS experiment_id, md5(run_dir) AS run_id, 'lineitem' AS dataset,
       CASE WHEN cell = 'O' THEN 'r1' END AS dataset_version, md5(cell) || '|' || md5('source') AS dataset_hash,
       CASE WHEN cell = 'O' THEN 'dirichlet_client' ELSE 'iid' END AS partition_type,
       CASE WHEN cell = 'O' AND seed <> 3 THEN 0.1::DOUBLE END AS alpha, 2::BIGINT AS client_count, seed, algorithm,
       CASE WHEN seed = 4 AND condition = 'A' THEN 0.2 ELSE 0.1 END::DOUBLE AS learning_rate,
       CASE WHEN {FED} THEN 2.0::DOUBLE END AS local_epochs, CASE WHEN {FED} THEN 10 ELSE 3 END::BIGINT AS rounds,
       NULL::DOUBLE AS mu, 'g0; g1' AS gpu, {r('discount * 10')} AS test_accuracy, {r('tax * 9')} AS val_macro_f1,
       {r('tax')} AS worst_client_macro_f1, CASE WHEN {FED} THEN bytes END AS uplink_bytes,
       CASE WHEN {FED} THEN bytes * 2 END AS downlink_bytes,
       {r(f'CASE WHEN {FED} THEN items / 100 ELSE items / 50 END')} AS wall_clock_s, {r('items / 10')} AS cpu_time_s,
       100.0::DOUBLE AS memory_mb, seed % 2 = 0 AS official_environment, CASE WHEN seed <> 2 THEN md5('commit') END AS git_commit
FROM finished"""))
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    flat = runs.collect_tables(parsed(spark, sf))["runs"].select(
        "run_dir", "experiment_id", "run_id", "dataset", "dataset_version", "dataset_hash", "partition_type", "alpha",
        "client_count", "seed", "algorithm", "learning_rate", "local_epochs", "rounds", "mu", "gpu", "test_accuracy",
        "val_macro_f1", "worst_client_macro_f1", "uplink_bytes", "downlink_bytes", "wall_clock_s", "cpu_time_s", "memory_mb",
        "official_environment", "git_commit",
    )
    return rounded(flat, "test_accuracy", "val_macro_f1", "worst_client_macro_f1", "wall_clock_s", "cpu_time_s")


@query(with_([RUNS, FINISHED], f"""
SELECT run_dir, 'no final.json' AS problem FROM runs WHERE seed = 7 AND condition = 'A'
UNION ALL SELECT run_dir, 'torch: no value' FROM finished WHERE seed = 1
UNION ALL SELECT run_dir, 'git: an official run needs a clean commit' FROM finished WHERE seed IN (0, 2)
UNION ALL SELECT run_dir, 'no clients.json' FROM finished WHERE {FED} AND seed = 6
UNION ALL SELECT run_dir, 'alpha: needed for this partition' FROM finished WHERE {FED} AND cell = 'O' AND seed = 3
UNION ALL SELECT run_dir, 'class counts: none for any client' FROM finished WHERE seed = 5"""))
def validate_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.validate_runs(parsed(spark, sf))


@query(with_([RUNS, FINISHED], f"""
SELECT 'rounds' AS part, md5(run_dir) AS run_id, unnest(range(1, 4)) AS number, {r('tax * unnest(range(1, 4))')} AS value
FROM finished WHERE {FED}
UNION ALL SELECT 'clients', md5(run_dir), unnest(range(0, 2)), {r('tax')} FROM finished WHERE {FED} AND seed <> 6
UNION ALL SELECT 'validation', 'all', count(*), count_if(seed IN (0, 1, 2, 5) OR ({FED} AND (seed = 6 OR (cell = 'O' AND seed = 3))))
FROM finished"""))
def collect_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables = runs.collect_tables(parsed(spark, sf))
    rows = tables["rounds"].select(F.lit("rounds").alias("part"), "run_id", F.col("round").alias("number"), F.col("val_macro_f1").alias("value"))
    rows = rows.unionByName(
        tables["clients"].select(F.lit("clients").alias("part"), "run_id", F.col("client_id").alias("number"), F.col("client_test_macro_f1").alias("value"))
    ).unionByName(
        tables["validation"].select(F.lit("validation").alias("part"), F.lit("all").alias("run_id"), F.col("runs").alias("number"),
                                    F.col("runs_with_problems").cast("double").alias("value"))
    )
    return rounded(rows, "value")


CHECKS = (
    "same vocabulary", "same feature bundle", "same training split", "same test set", "same seed", "identical lr", "identical lr_decay",
    "identical batch_size", "identical weight_decay", "identical momentum", "identical model", "same partition", "partition seed recorded",
    "client class counts saved", "alpha recorded", "client count recorded", "seed recorded", "configuration hash recorded",
    "official status recorded", "git commit recorded",
)


@query(with_([RUNS, "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CHECKS) + "]) AS \"check\")"], """
SELECT cell, seed, "check", CASE "check" WHEN 'same vocabulary' THEN seed <> 6 WHEN 'identical lr' THEN seed <> 4
  WHEN 'client class counts saved' THEN seed <> 5 WHEN 'alpha recorded' THEN NOT (cell = 'O' AND seed = 3)
  WHEN 'git commit recorded' THEN seed <> 2 ELSE true END AS passed,
  CASE "check" WHEN 'same vocabulary' THEN '{"vocabulary_sha256":"' || md5(CASE WHEN seed = 6 THEN 'other' ELSE 'vocabulary' END) || '"}'
    WHEN 'same feature bundle' THEN '{"bundle_dir":"/bundles/' || cell || '"}' WHEN 'same training split' THEN '{"train_fingerprint":"' || md5(cell) || '"}'
    WHEN 'same test set' THEN '{"test_size":10}' WHEN 'same seed' THEN '{"seed":' || seed || '}'
    WHEN 'identical lr' THEN CASE WHEN seed = 4 THEN '{"lr":0.2}' ELSE '{"lr":0.1}' END WHEN 'identical lr_decay' THEN '{"lr_decay":1.0}'
    WHEN 'identical batch_size' THEN '{"batch_size":32}' WHEN 'identical weight_decay' THEN '{"weight_decay":0.0}'
    WHEN 'identical momentum' THEN '{"momentum":0.0}' WHEN 'identical model' THEN '{"name":"lr"}'
    WHEN 'same partition' THEN '{"sha256":"' || md5(cell || '|' || seed) || '"}'
    WHEN 'partition seed recorded' THEN '["' || seed * 100 || '","' || seed * 100 || '"]'
    WHEN 'alpha recorded' THEN CASE WHEN cell = 'O' AND seed <> 3 THEN '["0.1","0.1"]' ELSE '["none","none"]' END
    WHEN 'client count recorded' THEN '["2","2"]' WHEN 'official status recorded' THEN '["' || (seed % 2 = 0) || '"]'
    WHEN 'git commit recorded' THEN '["' || CASE WHEN seed <> 2 THEN md5('commit') ELSE 'none' END || '"]' END AS detail
FROM (SELECT DISTINCT cell, seed FROM runs), names"""))
def comparability_checks(spark: SparkSession, sf: str) -> DataFrame:
    files = run_files(spark, sf).select("cell", "condition", "run_dir")
    nested = parsed(spark, sf).join(files, "run_dir").withColumn("seed", F.col("run_metadata.seed"))
    named = F.when(F.col("condition") == "A", "centralized").when(F.col("condition") == "N", "fedavg").otherwise("fedavg_la")
    return runs.comparability_checks(nested.withColumn("condition", named), ["cell", "seed"], "condition")


@query(with_([RUNS, FINISHED, "groups_ AS (SELECT DISTINCT cell, algorithm FROM finished)",
              "seed_counts AS (SELECT cell, algorithm, count(DISTINCT seed) AS n FROM finished GROUP BY ALL)"], """
SELECT 'exp-' || cell AS experiment_id, algorithm, 'seeds: ' || n || ' of 8' AS reason FROM seed_counts WHERE n <> 8
UNION ALL SELECT 'exp-' || cell, algorithm, 'dataset: no revision' FROM groups_ WHERE cell = 'F'
UNION ALL SELECT 'exp-' || cell, algorithm, 'git: no commit' FROM groups_
UNION ALL SELECT 'exp-' || cell, algorithm, 'git: dirty' FROM groups_
UNION ALL SELECT 'exp-' || cell, algorithm, 'learning_rate: not as tuned' FROM groups_ WHERE algorithm = 'centralized'"""))
def admission_rules(spark: SparkSession, sf: str) -> DataFrame:
    flat = runs.collect_tables(parsed(spark, sf))["runs"]
    return runs.admission_rules(flat, ["experiment_id", "algorithm"], 8, {"learning_rate": 0.1})


@query(with_([RUNS], "SELECT cell, seed, 'requested' AS side FROM runs WHERE seed = 7 AND condition = 'A'"))
def seeds_differ(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled runs that were requested but not finished."""
    nested = run_files(spark, sf).where("condition = 'A'").select("cell", "run_dir", "final")
    seeds = parsed(spark, sf).select("run_dir", F.col("run_metadata.seed").alias("seed")).join(nested, "run_dir")
    return runs.seeds_differ(seeds, seeds.where(F.col("final").isNotNull()), ["cell"])


def written_runs(spark: SparkSession, sf: str) -> str:
    """The runs as folders of JSON files, one folder per run and as many runs at any scale; the folder's path.

    Clients get two fields that no schema names. Runs without a text have no such file.
    """
    extra = F.regexp_replace("clients", r'\{"client_id":(\d)', r'{"client_id":$1,"device":"d$1","load":$1.5,"parts":[1,2]')
    rows = run_files(spark, sf).withColumn("clients", extra).collect()  # two cells, three conditions, eight seeds
    root = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for run in rows:
        for name in FILES:
            if run[name] is not None:
                out = files.create(path(f"{root}/{run['run_dir']}/{name}.json"))
                out.write(bytearray(run[name].encode()))
                out.close()
    return root


def runs_from_files(spark: SparkSession, sf: str) -> DataFrame:
    nested = read_runs(spark, written_runs(spark, sf))
    return nested.withColumn("run_dir", F.regexp_extract("run_dir", "([^/]+/[^/]+/[^/]+)$", 1))


@query(with_([RUNS], f"""
SELECT run_dir, md5(run_dir) AS run_id, seed, CASE WHEN NOT (seed = 7 AND condition = 'A') THEN kind END AS kind,
       CASE WHEN {FED} THEN 3 END::INTEGER AS rounds, CASE WHEN {FED} AND seed <> 6 THEN 2 END::INTEGER AS clients FROM runs"""))
def read_runs_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Run folders read back; a file that is missing is NULL."""
    return runs_from_files(spark, sf).select(
        "run_dir", "run_metadata.run_id", "run_metadata.seed", "final.kind", F.size("history").alias("rounds"), F.size("clients").alias("clients")
    ).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("rounds", "clients")})


@query(with_([RUNS], f"""
SELECT md5(run_dir) AS run_id, seed, algorithm, c::BIGINT AS client_id, items + c AS n_train, {r('tax')} AS client_test_macro_f1,
       'd' || c AS device, c + 0.5::DOUBLE AS load FROM runs, range(2) t(c) WHERE {FED} AND seed <> 6"""))
def client_fields_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every scalar field of the clients' files, two of them in no schema; lists are left out."""
    rows = runs.collect_tables(runs_from_files(spark, sf))["clients"]
    if "parts" in rows.columns:
        raise RuntimeError("a list is no scalar field")
    return rounded(rows.select("run_id", "seed", "algorithm", "client_id", "n_train", "client_test_macro_f1", "device", "load"), "client_test_macro_f1")


VALUES = """vals AS (
  SELECT condition, cell, seed, unnest(['spearman', 'partial_pearson']) AS statistic,
         unnest([a, CASE WHEN seed <> 5 OR cell = 'O' THEN b END]) AS value
  FROM (SELECT l_returnflag AS condition, l_linestatus AS cell, l_suppkey % 8 AS seed, corr(l_discount, l_quantity) AS a,
               corr(l_tax, l_quantity) AS b FROM lineitem GROUP BY ALL))"""
CRITERIA = [
    VALUES,
    """sums AS (
      SELECT condition, statistic, count(DISTINCT seed) FILTER (cell = 'O') AS seeds, count(value) FILTER (cell = 'O') AS defined,
             min(value) FILTER (cell = 'O') AS lowest, max(value) FILTER (cell = 'O') AS highest,
             avg(abs(value)) FILTER (cell = 'O') AS mean_abs_skew,
             coalesce(sum(abs(value)) FILTER (cell = 'F'), 0) / count(DISTINCT seed) FILTER (cell = 'O') AS mean_abs_control
      FROM vals GROUP BY condition, statistic)""",
    """criteria AS (
      SELECT *, defined = seeds AS defined_in_all_seeds, defined = seeds AND (lowest > 0 OR highest < 0) AS same_sign,
             mean_abs_skew - mean_abs_control AS excess FROM sums)""",
    """decided AS (
      SELECT *, CASE WHEN same_sign THEN sign(lowest)::INTEGER ELSE 0 END AS sign, same_sign AND excess >= 0.0 AS passed FROM criteria)""",
]


def values(spark: SparkSession, sf: str) -> DataFrame:
    """Two correlations per condition, cell and seed; one is undefined in one seed of the control cell."""
    seed = (F.col("l_suppkey") % 8).alias("seed")
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("cell"), seed).agg(
        correlation("l_discount", "l_quantity").alias("spearman"), correlation("l_tax", "l_quantity").alias("partial_pearson")
    )
    kept = F.when((F.col("seed") != 5) | (F.col("cell") == "O"), F.col("partial_pearson"))
    sums = sums.withColumn("partial_pearson", kept)
    return sums.unpivot(["condition", "cell", "seed"], ["spearman", "partial_pearson"], "statistic", "value")


def criteria(spark: SparkSession, sf: str) -> DataFrame:
    return runs.criterion(values(spark, sf), ["condition", "statistic"], "seed", "cell", "value", "O", "F", 0.0)


@query(with_(CRITERIA, f"""
SELECT condition, statistic, seeds, defined_in_all_seeds, same_sign, sign, {rs('mean_abs_skew', 'mean_abs_control', 'excess')}, passed
FROM decided"""))
def criterion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(criteria(spark, sf), "mean_abs_skew", "mean_abs_control", "excess")


@query(with_([*CRITERIA,
              """effects AS (
                SELECT s.condition, s.passed AND p.passed AND s.sign = p.sign AS effect FROM decided s
                JOIN decided p ON p.condition = s.condition AND p.statistic = 'partial_pearson' WHERE s.statistic = 'spearman')""",
              """sides AS (SELECT bool_or(effect) FILTER (condition = 'N') AS plain_effect,
                                  bool_or(effect) FILTER (condition = 'R') AS corrected_effect FROM effects)"""], """
SELECT *, CASE WHEN NOT plain_effect THEN 'A' WHEN NOT corrected_effect THEN 'B' ELSE 'C' END AS outcome FROM sides"""))
def decision_rule(spark: SparkSession, sf: str) -> DataFrame:
    return runs.decision_rule(criteria(spark, sf), [], plain="N", corrected="R")


GRID = """grid AS (
  SELECT l_returnflag AS cell, l_discount AS lr, l_tax AS weight_decay, round(avg(l_quantity), 3) AS val_macro_f1 FROM lineitem GROUP BY ALL)"""


@query(with_([GRID], """
SELECT cell, lr, weight_decay, val_macro_f1, lr IN (lr_low, lr_high) AS lr_on_edge, weight_decay IN (wd_low, wd_high) AS weight_decay_on_edge
FROM (SELECT *, min(lr) OVER g AS lr_low, max(lr) OVER g AS lr_high, min(weight_decay) OVER g AS wd_low, max(weight_decay) OVER g AS wd_high,
             row_number() OVER (PARTITION BY cell ORDER BY val_macro_f1 DESC, lr, weight_decay DESC) AS place
      FROM grid WINDOW g AS (PARTITION BY cell)) WHERE place = 1"""))
def select_best(spark: SparkSession, sf: str) -> DataFrame:
    grid = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("cell"), F.col("l_discount").alias("lr"), F.col("l_tax").alias("weight_decay")
    ).agg(F.round(F.avg("l_quantity"), 3).alias("val_macro_f1"))
    return runs.select_best(grid.withColumn("test_macro_f1", F.lit(None).cast("double")), ["cell"])


@query(with_(HISTORY, f"""
SELECT run, {r('max(metric) FILTER (back = 1)')} AS last, {r('max(metric) FILTER (back = 6)')} AS earlier
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round DESC) AS back FROM history) GROUP BY run"""))
def value_rounds_earlier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(runs.value_rounds_earlier(history(spark, sf), ["run"], "round", "metric"), "last", "earlier")


@query(with_([KEYED_LABELS,
              "per_key AS (SELECT key AS run, row_number() OVER (PARTITION BY key ORDER BY row_id) AS round, status FROM keyed_labels)",
              "ks AS (SELECT DISTINCT key AS run FROM keyed_labels)",
              "used AS (SELECT DISTINCT key AS run, prediction FROM keyed_labels)"], """
SELECT DISTINCT key AS run, 'silent round' AS anomaly FROM keyed_labels WHERE status = 'P'
UNION ALL SELECT run, 'unused class' FROM ks WHERE (SELECT count(*) FROM used u WHERE u.run = ks.run) < 5"""))
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """A customer is a run, an order a round; pending orders have no reporter, price bands are predictions."""
    rows = keyed_labels(spark, sf).withColumnRenamed("key", "run")
    rounds = rows.select("run", F.when(F.col("status") == "P", 0).otherwise(1).alias("reported"))
    return runs.anomalies(rounds, metrics.confusion(rows, "label", "prediction", 5, ["run"]), ["run"])


CELL = [
    *DIRECTIONS, *[cte for cte in [ROLES] if cte not in DIRECTIONS],
    """sides AS (
      SELECT k.doc_id, k.key, k.label, CASE WHEN k.lang = 'de' THEN 'unseen' WHEN t.rank > t.train + round_even(0.1 * s.n, 0) THEN 'seen' END AS side
      FROM keyed_text k JOIN roles t ON t.doc_id = k.doc_id JOIN (SELECT label, count(*) AS n FROM keyed_text GROUP BY label) s ON s.label = k.label)""",
    """models AS (
      SELECT 'centralized' AS model, layer, class, idx, value FROM centroids
      UNION ALL SELECT 'fedavg', 'weight', class, idx, sum(value) / (SELECT keys FROM key_count) FROM per_key GROUP BY class, idx)""",
    """sums_ AS (
      SELECT p.model, f.doc_id, p.class, sum(f.value * p.value) AS s FROM features f
      JOIN models p ON p.idx = f.idx AND p.layer = 'weight' GROUP BY ALL)""",
    """scored AS (
      SELECT m.model, t.doc_id, t.key, t.label, t.side, c.class, coalesce(s.s, 0.0) + coalesce(b.value, 0.0) AS logit
      FROM sides t CROSS JOIN (SELECT DISTINCT model FROM models) m CROSS JOIN range(2) c(class)
      LEFT JOIN sums_ s ON s.model = m.model AND s.doc_id = t.doc_id AND s.class = c.class
      LEFT JOIN models b ON b.model = m.model AND b.layer = 'bias' AND b.class = c.class WHERE t.side IS NOT NULL)""",
    """sided AS (
      SELECT model, key, side, label, class::INTEGER AS prediction FROM scored
      QUALIFY row_number() OVER (PARTITION BY model, doc_id ORDER BY logit DESC, class) = 1)""",
    *side_sql("pool", "model, side", 2), *side_sql("cell", "model, side, key", 2),
    f"spread AS (SELECT model, side, {dispersion_sql('macro_f1')} FROM measured_cell GROUP BY model, side)",
    "s AS (SELECT * FROM measured_pool JOIN spread USING (model, side) WHERE side = 'seen')",
    "u AS (SELECT * FROM measured_pool JOIN spread USING (model, side) WHERE side = 'unseen')",
]


@query(with_(CELL, "SELECT s.model, " + ", ".join(
    f"{t}.n AS {name}_n, {t}.count AS {name}_key_count, " + ", ".join(f"{r(f'{t}.{c}')} AS {name}_{c}" for c in ("accuracy", "macro_f1"))
    + ", " + ", ".join(f"{r(f'{t}.{c}')} AS {name}_key_{c}" for c in SPREAD) for t, name in (("s", "seen"), ("u", "unseen")))
    + f", {r('s.macro_f1 - u.macro_f1')} AS gap_macro_f1, {r('s.accuracy - u.accuracy')} AS gap_accuracy FROM s JOIN u ON u.model = s.model"))
def analyze_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Seen against unseen performance of two centroid models, after checks, decomposition, null and flags."""
    documents, values_, pooled = model_inputs(spark, sf)
    roles = assign_roles_stratified(keyed_text(spark, sf).select("doc_id", "key", "lang", "label"), "label", "doc_id", (0.8, 0.1, 0.1), 7)
    rows = roles.withColumn("role", F.when(F.col("lang") == "de", 3).otherwise(F.col("role")))
    models = {"centralized": pooled, "fedavg": mixed_centroids(documents, values_)}
    tables = analysis.analyze_cell(
        rows, keyed_uses(spark, sf), values_, vocabulary(spark, sf), models, "doc_id", "key", "label", 2,
        analysis.FlagRule(repeats=5, fdr=0.5), 11,
    )
    return rounded(tables["performance"], *[c for c, kind in tables["performance"].dtypes if kind == "double"])
