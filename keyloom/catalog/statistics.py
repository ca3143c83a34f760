"""Replicate statistics, ledgers and resources over line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.tables import MESSAGES, REPLICATES, messages, r, replicates, rounded, rs, table, with_
from keyloom.catalog.text import TERM_P, term_p
from keyloom.functions.tdist import quantile
from keyloom.operators import ledger
from keyloom.operators import replicates as stats

T_TABLE = "t_table AS (SELECT * FROM (VALUES " + ", ".join(f"({v}, {quantile(v)!r}::DOUBLE)" for v in range(1, 41)) + ") t(dof, t))"
LONG = """long AS (
  SELECT condition, seed, unnest(['discount', 'tax', 'quantity']) AS metric, unnest([discount, tax, quantity]) AS value
  FROM replicates)"""


def summary_sql(source: str, by: str, value: str) -> str:
    """``(by.., n, mean, std, ci95_low, ci95_high)``."""
    return f"""(SELECT s.*, mean - t * std / sqrt(n) AS ci95_low, mean + t * std / sqrt(n) AS ci95_high FROM (
      SELECT {by}, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS std FROM {source} GROUP BY {by}) s
      LEFT JOIN t_table ON dof = n - 1)"""


def long(spark: SparkSession, sf: str) -> DataFrame:
    return replicates(spark, sf).unpivot(["condition", "seed"], ["discount", "tax", "quantity"], "metric", "value")


@query(with_([REPLICATES, LONG, T_TABLE], f"""
SELECT condition, metric, n, {rs('mean', 'std', 'ci95_low', 'ci95_high')} FROM {summary_sql('long', 'condition, metric', 'value')}"""))
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.summarize(long(spark, sf), ["condition", "metric"], "value"), "mean", "std", "ci95_low", "ci95_high")


# every pair of conditions on shared seeds; the signed-rank null by listing all sign patterns
PAIRS = [
    REPLICATES, LONG, T_TABLE,
    """pairs AS (
      SELECT x.metric, x.condition AS a, y.condition AS b, x.seed, x.value AS value_a, y.value AS value_b, x.value - y.value AS d
      FROM long x JOIN long y ON y.metric = x.metric AND y.seed = x.seed AND x.condition < y.condition)""",
    f"summary AS (SELECT * FROM {summary_sql('pairs', 'metric, a, b', 'd')})",
    """ranks AS (
      SELECT metric, a, b, d, row_number() OVER g - 1 AS bit, rank() OVER g + (count(*) OVER (PARTITION BY metric, a, b, abs(d)) - 1) / 2.0 AS rk
      FROM pairs WHERE d <> 0 WINDOW g AS (PARTITION BY metric, a, b ORDER BY abs(d)))""",
    """observed AS (
      SELECT metric, a, b, count(*) AS m, sum(rk) AS total, coalesce(sum(rk) FILTER (d > 0), 0) AS plus FROM ranks GROUP BY ALL)""",
    "patterns AS (SELECT metric, a, b, unnest(range(0, 1 << m::INTEGER)) AS mask FROM observed)",
    """pattern_sums AS (
      SELECT p.metric, p.a, p.b, p.mask, sum(CASE WHEN (p.mask >> r.bit) & 1 = 1 THEN rk ELSE 0 END) AS s
      FROM patterns p JOIN ranks r ON r.metric = p.metric AND r.a = p.a AND r.b = p.b GROUP BY ALL)""",
    """signed AS (
      SELECT o.metric, o.a, o.b, avg((abs(s - total / 2) >= abs(plus - total / 2) - 1e-12)::INTEGER) AS wilcoxon_p,
             any_value((2 * plus - total) / total) AS rank_biserial
      FROM pattern_sums p JOIN observed o ON o.metric = p.metric AND o.a = p.a AND o.b = p.b GROUP BY o.metric, o.a, o.b)""",
    # eight seeds: seven degrees of freedom
    "angles AS (SELECT *, atan(abs(mean / (std / sqrt(n))) / sqrt(7.0)) AS h FROM summary)",
    """compared AS (
      SELECT metric, a, b, n, mean AS mean_diff, ci95_low AS diff_ci95_low, ci95_high AS diff_ci95_high, mean / std AS cohens_dz,
             greatest(0.0, 1.0 - 2 / pi() * (h + sin(h) * (cos(h) + 2.0 / 3 * cos(h) ** 3 + 8.0 / 15 * cos(h) ** 5))) AS t_p,
             2.0 / 2 ** n AS wilcoxon_min_p, wilcoxon_p, rank_biserial FROM angles JOIN signed USING (metric, a, b))""",
]
COMPARED = ("mean_diff", "diff_ci95_low", "diff_ci95_high", "cohens_dz", "t_p", "wilcoxon_min_p", "wilcoxon_p", "rank_biserial")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = long(spark, sf)
    left = rows.select("metric", "seed", F.col("condition").alias("a"), F.col("value").alias("value_a"))
    right = rows.select("metric", "seed", F.col("condition").alias("b"), F.col("value").alias("value_b"))
    return left.join(right, ["metric", "seed"]).where("a < b")


@query(with_(PAIRS, f"SELECT metric, a, b, 'exact' AS wilcoxon_method, {rs('wilcoxon_p', 'rank_biserial')} FROM signed"))
def wilcoxon_exact(spark: SparkSession, sf: str) -> DataFrame:
    diffs = pairs(spark, sf).withColumn("d", F.col("value_a") - F.col("value_b"))
    return rounded(stats.wilcoxon(diffs, ["metric", "a", "b"], "d"), "wilcoxon_p", "rank_biserial")


@query(with_(PAIRS, f"SELECT metric, a, b, n, 'exact' AS wilcoxon_method, {rs(*COMPARED)} FROM compared"))
def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.paired_comparison(pairs(spark, sf), ["metric", "a", "b"], "value_a", "value_b"), *COMPARED)


HOLM = """holm AS (
  SELECT *, least(1.0, max((m - k + 1) * p0) OVER (ORDER BY k)) AS p_holm FROM (
    SELECT *, coalesce({p}, 1.0) AS p0, row_number() OVER (ORDER BY coalesce({p}, 1.0), {row}) AS k, count(*) OVER () AS m
    FROM {source}))"""


@query(with_([*TERM_P, HOLM.format(source="tests_", p="p", row="term")], f"SELECT term, {rs('p', 'p_holm')} FROM holm"))
def holm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.holm(term_p(spark, sf), "p", ["term"]), "p", "p_holm")


@query(with_([*PAIRS, "taxes AS (SELECT * EXCLUDE (metric) FROM compared WHERE metric = 'tax')",
              HOLM.format(source="taxes", p="wilcoxon_p", row="a, b")],
             f"SELECT a, b, n, 'exact' AS wilcoxon_method, {rs(*COMPARED, 'p_holm')} FROM holm"))
def all_pairs_comparison(spark: SparkSession, sf: str) -> DataFrame:
    compared = stats.all_pairs_comparison(replicates(spark, sf), "condition", "seed", "tax")
    return rounded(compared, *COMPARED, "p_holm")


@query(with_([REPLICATES, LONG, T_TABLE], f"""
SELECT condition, metric, n, {rs('mean', 'std', 'ci95_low', 'ci95_high')},
       format('{{:.4f}} +/- {{:.4f}} [{{:.4f}}, {{:.4f}}]', mean, std, ci95_low, ci95_high) AS cell
FROM {summary_sql('long', 'condition, metric', 'value')}"""))
def headline_table(spark: SparkSession, sf: str) -> DataFrame:
    headline = stats.headline_table(replicates(spark, sf), "condition", ["discount", "tax", "quantity"])
    return rounded(headline, "mean", "std", "ci95_low", "ci95_high")


@query(with_([REPLICATES, "shifted AS (SELECT condition, seed, discount - 0.05 AS shift FROM replicates)", T_TABLE], f"""
SELECT condition, s.n, {rs('mean', 'std', 'ci95_low', 'ci95_high', 'mean_abs')}, reports,
       s.n = reports AND (lowest > 0 OR highest < 0) AS same_sign
FROM {summary_sql('shifted', 'condition', 'shift')} s JOIN (
  SELECT condition, count(DISTINCT seed) AS reports, avg(abs(shift)) AS mean_abs, min(shift) AS lowest, max(shift) AS highest
  FROM shifted GROUP BY condition) USING (condition)"""))
def sign_consistency(spark: SparkSession, sf: str) -> DataFrame:
    shifted = replicates(spark, sf).select("condition", "seed", (F.col("discount") - 0.05).alias("shift"))
    return rounded(stats.across_seeds(shifted, ["condition"], "seed", "shift"), "mean", "std", "ci95_low", "ci95_high", "mean_abs")


# ---- ledgers

SUMS = ", ".join(
    f"count(*) FILTER (direction = '{d}') AS {d}link_clients, coalesce(sum(bytes) FILTER (direction = '{d}'), 0)::BIGINT AS {d}link_bytes"
    for d in ("down", "up")
)
LEDGER = [MESSAGES, f"sums AS (SELECT run, round, {SUMS} FROM messages WHERE phase = 'training' GROUP BY run, round)"]


def per(d: str) -> str:
    return r(f"CASE WHEN {d}link_clients > 0 THEN {d}link_bytes / {d}link_clients ELSE 0.0 END") + f" AS {d}link_bytes_per_client"


@query(with_(LEDGER, f"""
SELECT *, {per('down')}, {per('up')}, (sum(downlink_bytes) OVER g)::BIGINT AS cum_downlink_bytes,
       (sum(uplink_bytes) OVER g)::BIGINT AS cum_uplink_bytes, (sum(downlink_bytes + uplink_bytes) OVER g)::BIGINT AS cum_total_bytes
FROM sums WINDOW g AS (PARTITION BY run ORDER BY round)"""))
def round_ledger(spark: SparkSession, sf: str) -> DataFrame:
    training = messages(spark, sf).where("phase = 'training'")
    return rounded(ledger.round_ledger(training, ["run"], "round"), "downlink_bytes_per_client", "uplink_bytes_per_client")


PHASES = ", ".join(
    f"coalesce(sum(bytes) FILTER (phase = '{p}' AND direction = '{d}'), 0)::BIGINT AS {p}_{d}link_bytes"
    for p in ("training", "setup", "evaluation") for d in ("down", "up")
)


@query(with_([MESSAGES], f"""
SELECT run, {PHASES}, coalesce(sum(bytes) FILTER (phase = 'training'), 0)::BIGINT AS training_total_bytes FROM messages GROUP BY run"""))
def ledger_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ledger_totals(messages(spark, sf), ["run"])


@query(with_([MESSAGES], "SELECT run, phase, direction, sum(bytes)::BIGINT AS bytes FROM messages GROUP BY ROLLUP (run, phase, direction)"))
def phase_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.phase_rollup(messages(spark, sf), ["run"])


@query(f"""
SELECT l_returnflag AS run, l_linenumber AS round, count(*) AS reported, {r('sum(l_quantity)')} AS wall_s, {r('sum(l_tax)')} AS cpu_s,
       {r('sum(l_discount)')} AS gpu_s, max(l_extendedprice) AS peak_memory_mb,
       {r('sum(l_discount * l_quantity) / sum(l_quantity)')} AS train_loss, sum(l_partkey)::BIGINT AS steps,
       {r('sum(l_tax) * 15.0 + sum(l_discount) * 70.0')} AS energy_joules FROM lineitem GROUP BY ALL""")
def round_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as reports: quantity in seconds and examples, tax and discount as processor time."""
    reports = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("round"), F.col("l_quantity").alias("wall_s"),
        F.col("l_tax").alias("cpu_s"), F.col("l_discount").alias("gpu_s"), F.col("l_extendedprice").alias("memory_mb"),
        F.col("l_discount").alias("train_loss"), F.col("l_quantity").alias("num_examples"), F.col("l_partkey").alias("steps"),
    )
    sums = ledger.round_resources(reports, ["run"], "round", 15.0, 70.0)
    return rounded(sums, "wall_s", "cpu_s", "gpu_s", "train_loss", "energy_joules")
