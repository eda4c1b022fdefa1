"""Evaluation studies: which experiments there are, and their results side by side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(name: Column) -> Column:
    """A name with everything but letters and digits removed."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "")


def experiment_grid(
    pretrained: DataFrame, fine_tuned: DataFrame, label_folders: list[tuple[str, str]]
) -> DataFrame:
    """Every fine-tuned setting with each of its pretrained models and each label folder pair.

    ``pretrained`` has ``pretrained_model, num_epochs``; ``fine_tuned`` has ``fine_tuned_model,
    pretrained_model, pretrained_epoch``, where a null epoch means the model's last. Asking for a
    later epoch than the model has is an error.
    """
    pairs = F.array(
        *[F.struct(F.lit(a).alias("train_label"), F.lit(b).alias("test_label")) for a, b in label_folders]
    )
    epoch = F.coalesce("pretrained_epoch", "num_epochs")
    checked = F.when(
        epoch > F.col("num_epochs"),
        F.raise_error(F.concat(F.lit("no such epoch of pretrained model "), "pretrained_model")).cast("bigint"),
    ).otherwise(epoch)
    cells = fine_tuned.join(pretrained, "pretrained_model").withColumn("pretrained_epoch", checked)
    name = F.concat(file_name(F.col("pretrained_model")), F.lit("_e"), F.col("pretrained_epoch").cast("string"))
    setting = file_name(F.col("fine_tuned_model"))
    return cells.select(
        "fine_tuned_model", "pretrained_model", "pretrained_epoch", F.explode(pairs).alias("_pair")
    ).select(
        "fine_tuned_model",
        "pretrained_model",
        "pretrained_epoch",
        "_pair.*",
        F.concat(F.lit("eval_"), name, F.lit("_"), setting).alias("evaluation_folder"),
        F.concat(
            F.lit("model_"), name, F.lit("_"), setting, F.lit("_"), file_name(F.col("_pair.train_label"))
        ).alias("model_folder"),
    )


GRID_KEYS = ["fine_tuned_model", "pretrained_model", "pretrained_epoch", "test_label"]


def combine_results(grid: DataFrame, metrics: DataFrame, on: list[str] = GRID_KEYS) -> DataFrame:
    """Metric columns of each experiment beside what identifies it.

    Results scanned from files join on ``evaluation_folder`` and ``test_label``.
    """
    kept = [*GRID_KEYS, *[c for c in on if c not in GRID_KEYS]]
    return grid.select(*kept).join(metrics, on)


def summarise_results(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric over the experiments that share ``keys``."""
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
