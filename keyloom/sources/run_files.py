"""Run directories: nested JSON files read as one row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ("run_metadata", "final", "history", "clients")

# The parts of the four files that the flat tables use.
METADATA = """
experiment_id string, run_id string, seed long, config_hash string, official_environment boolean,
vocabulary_sha256 string, bundle_dir string,
config struct<
  fl: struct<lr: double, lr_decay: double, local_epochs: double, fraction_fit: double, dropout_prob: double,
             mu: double, weight_decay: double, batch_size: long, momentum: double, rounds: long>,
  model: struct<name: string>>,
dataset struct<dataset: string, revision: string, train_fingerprint: string, test_fingerprint: string,
               source_sha256: string, num_features: long, test_size: long, features_config: string>,
partition struct<type: string, alpha: double, client_count: long, client_definition: string,
                 client_filter_rule: struct<filter_seed: long, max_clients: long, max_reviews: long, min_reviews: long>,
                 sha256: string, partition_seed: long, client_class_counts: array<array<long>>>,
environment struct<platform_kind: string, timestamp_utc: string,
                   hardware: struct<python: string, gpus: array<struct<name: string>>, cuda_version: string>,
                   packages: struct<torch: string, flwr: string>,
                   git: struct<commit: string, dirty: boolean>>
"""
FINAL = """
kind string, algorithm string, rounds long, epochs long, test_evaluated boolean,
test struct<accuracy: double, macro_f1: double, confusion_matrix: array<array<long>>>,
val struct<loss: double, accuracy: double, macro_f1: double>,
client_test_macro_f1 struct<worst: double, std: double, mean: double>,
global_test_macro_f1 struct<mean: double>, global_test_accuracy struct<mean: double>,
communication struct<training_uplink_bytes: long, training_downlink_bytes: long, training_total_bytes: long>,
rounds_to_target long,
resources struct<total_round_wall_s: double, train_wall_s: double, wall_s: double, client_cpu_s: double,
                 train_cpu_s: double, peak_client_rss_mb: double, rss_mb: double, peak_client_vram_mb: double,
                 energy_proxy_joules: double>,
weights_sha256 string
"""
HISTORY = """
array<struct<round: long, train_loss: double, val_loss: double, val_accuracy: double, val_macro_f1: double,
             test_loss: double, test_accuracy: double, test_macro_f1: double, uplink_bytes: long, downlink_bytes: long,
             cum_total_bytes: long, selected: long, reported: long, dropped: long, stragglers: long,
             round_wall_s: double, client_train_wall_s: double, agg_wall_s: double, lr: double>>
"""
CLIENTS = """
array<struct<client_id: long, n_train: long, client_test_n: long, client_test_accuracy: double,
             client_test_macro_f1: double, global_test_accuracy: double, global_test_macro_f1: double>>
"""
SCHEMAS = {"run_metadata": METADATA, "final": FINAL, "history": HISTORY, "clients": CLIENTS}


def read_run_files(spark: SparkSession, root: str) -> DataFrame:
    """``(run_dir, run_metadata, final, history, clients)`` as JSON text; a file that is missing is NULL."""
    names = "{" + ",".join(f"{name}.json" for name in FILES) + "}"
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).select(
        F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("run_dir"), "_metadata.file_name", "value"
    )
    return texts.groupBy("run_dir").agg(
        *[F.max(F.when(F.col("file_name") == f"{name}.json", F.col("value"))).alias(name) for name in FILES]
    )


def parse_run_files(raw: DataFrame) -> DataFrame:
    """The JSON texts as nested columns, and the clients' text, which may have fields that no schema names."""
    return raw.select("run_dir", *[F.from_json(name, SCHEMAS[name]).alias(name) for name in FILES], F.col("clients").alias("clients_text"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every run below ``root`` as one nested row."""
    return parse_run_files(read_run_files(spark, root))
