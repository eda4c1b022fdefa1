import os

import pytest
from pyspark.sql import functions as F

from ehrseq.operators import study
from ehrseq.operators.vocabulary import fit_vocabulary
from ehrseq.plans.process import process_cdm_data, process_tables
from ehrseq.settings import MappingSettings
from ehrseq.sources import cdm as source
from ehrseq.sources import files
from ehrseq.plans.trial_run import trial_run
from ehrseq.staging import ResumableStaging, measured
from tests.conftest import SMALL, rows


def test_a_folder_of_tables_becomes_sequences(spark, cdm, tmp_path):
    root, out = str(tmp_path / "cdm"), str(tmp_path / "out")
    stamped = cdm["condition_occurrence"].withColumn(
        "condition_start_date", F.col("condition_start_date").cast("timestamp_ntz")
    )
    source.write_cdm({**cdm, "condition_occurrence": stamped}, root)
    tables = source.read_cdm(spark, root)
    assert sorted(tables) == sorted(cdm)
    assert dict(tables["condition_occurrence"].dtypes)["condition_start_date"] == "date"
    settings = MappingSettings(map_drugs_to_ingredients=False)
    counters = process_cdm_data(spark, root, out, settings)
    assert counters.first().persons == 1
    written = files.read_sequences(spark, f"{out}/sequences")
    assert {r.observation_period_id: r.concept_ids for r in written.collect()} == {
        11: ["VS", "811", "VE", "M2", "VS", "822", "VE"],
        13: ["VS", "VE"],
    }
    assert rows(spark.read.parquet(f"{out}/tokens")) == rows(process_tables(cdm, settings).tokens)
    assert files.read_record(spark, MappingSettings, f"{out}/settings") == settings


class Stopped(Exception):
    pass


def _spoil(folder):
    """Overwrite the values of every file below, but not the footers that tell the columns, and leave no trace."""
    changed = {place: place.stat() for place in [folder, *(p for p in folder.rglob("*") if p.is_dir())]}
    for path in folder.rglob("part-*.parquet"):
        held = path.read_bytes()
        footer = 8 + int.from_bytes(held[-8:-4], "little")
        # Without a checksum the footer can still be read.
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        path.write_bytes(held[:4] + b"\xff" * (len(held) - 4 - footer) + held[len(held) - footer :])
    for place, stat in changed.items():
        os.utime(place, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def _stop(*_, **__):
    raise Stopped


@pytest.mark.parametrize("where, step", [("visits", "resolve_days"), ("tokens", "rank_visits")])
def test_a_stopped_run_is_taken_up(spark, tmp_path, monkeypatch, where, step):
    """After ``linked_events`` no source table is read again."""
    root, out, whole = (tmp_path / n for n in ("cdm", "out", "whole"))
    run = trial_run(spark, SMALL)
    settings, path = MappingSettings(has_labels=True), str(tmp_path / "labels")
    source.write_cdm(run.tables, str(root))
    source.write_labels(run.labels.withColumn("concept_id", F.lit(1)), path)
    again = lambda place, given=settings: process_cdm_data(spark, str(root), str(place), given, path, 1)
    again(whole)
    with monkeypatch.context() as patch:
        patch.setattr(f"ehrseq.operators.{where}.{step}", _stop)
        with pytest.raises(Stopped):
            again(out)
    assert (out / "_staged" / "linked_events.manifest").exists() and not (out / "tokens").exists()
    _spoil(root)
    _spoil(tmp_path / "labels")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|read"):
        source.read_cdm(spark, str(root))["person"].collect()
    again(out)
    for name in ("tokens", "counters"):
        assert rows(spark.read.parquet(str(out / name))) == rows(spark.read.parquet(str(whole / name)))
    assert not (out / "_staged").exists() and spark.read.parquet(str(out / "sequences")).count() > 0
    with pytest.raises(FileExistsError):
        again(out)


def test_other_settings_or_sources_start_anew(spark, cdm, tmp_path, monkeypatch):
    root, out = str(tmp_path / "cdm"), str(tmp_path / "out")
    source.write_cdm(cdm, root)
    settings = MappingSettings(map_drugs_to_ingredients=False)
    for change in ("settings", "sources"):
        with monkeypatch.context() as patch:
            patch.setattr("ehrseq.operators.tokens.rank_visits", _stop)
            with pytest.raises(Stopped):
                process_cdm_data(spark, root, out, settings)
        if change == "settings":
            settings.concepts_to_remove = [0, 811]
    more = cdm["condition_occurrence"].withColumn("condition_concept_id", F.lit(833).cast("bigint"))
    more.write.mode("append").parquet(f"{root}/condition_occurrence")
    process_cdm_data(spark, root, out, settings)
    found = {i for r in files.read_sequences(spark, f"{out}/sequences").collect() for i in r.concept_ids}
    assert "833" in found and "811" not in found


def test_staged_tables_are_read_and_not_computed(spark, tmp_path):
    folder = str(tmp_path / "staged")
    first = ResumableStaging(spark, folder, "a")
    one, two = first(spark.range(3), "plain"), first.measured(spark.range(4), "counted", {"total": F.sum("id")})
    again = ResumableStaging(spark, folder, "a")
    assert rows(again(spark.range(99), "plain")) == rows(one)
    assert measured(again.measured(spark.range(99), "counted")) == measured(two)
    other = ResumableStaging(spark, folder, "b")
    assert other(spark.range(99), "plain").count() == 99
    # A table without a manifest was not finished.
    spark.range(7).write.parquet(f"{folder}/half")
    assert other(spark.range(2), "half").count() == 2


def test_labels_by_concept(spark, cdm, tmp_path):
    labels = spark.createDataFrame(
        [(5, 70, True), (5, 71, False), (2, 70, False)], "person_id bigint, concept_id bigint, label boolean"
    )
    path = str(tmp_path / "labels")
    source.write_labels(labels, path)
    assert rows(source.read_labels(spark, path, 70)) == [(2, False), (5, True)]
    with pytest.raises(ValueError):
        source.read_labels(spark, path)
    assert rows(source.read_all_labels(spark, path)) == [(70, 2, False), (70, 5, True), (71, 5, False)]
    source.write_cdm(cdm, str(tmp_path / "cdm"))
    settings = MappingSettings(map_drugs_to_ingredients=False, has_labels=True)
    process_cdm_data(spark, str(tmp_path / "cdm"), str(tmp_path / "out"), settings, path, 71)
    assert {r.label for r in spark.read.parquet(str(tmp_path / "out/sequences")).collect()} == {False}


def test_vocabulary_round_trips(spark, tmp_path):
    words = fit_vocabulary(spark.createDataFrame([("b",), ("a",)], "t string"), "t")
    files.write_vocabulary(words, str(tmp_path / "v"))
    files.export_vocabulary_json(words, str(tmp_path / "j"))
    assert rows(files.read_vocabulary(spark, str(tmp_path / "v"))) == rows(words)
    assert rows(files.import_vocabulary_json(spark, str(tmp_path / "j"))) == rows(words)


def test_metrics_with_the_experiment_they_belong_to(spark, tmp_path):
    path = str(tmp_path / "m")
    files.write_metrics(spark.createDataFrame([(0.5, 0.75)], "loss double, auc double"), path)
    read = files.read_metrics(spark, path, "loss double, auc double", pretrained_model="base", pretrained_epoch=3)
    assert rows(read) == [(0.5, 0.75, "base", 3)]


def test_results_of_a_study_are_found_by_their_place(spark, tmp_path):
    pretrained = spark.createDataFrame([("base", 4)], "pretrained_model string, num_epochs bigint")
    fine_tuned = spark.createDataFrame(
        [("one", "base", None), ("two", "base", 2)],
        "fine_tuned_model string, pretrained_model string, pretrained_epoch bigint",
    )
    grid = study.experiment_grid(pretrained, fine_tuned, [("a", "label_b")])
    for folder, auc in (("eval_base_e4_one", 0.5), ("eval_base_e2_two", 0.75)):
        files.write_metrics(spark.createDataFrame([(auc,)], "auc double"), f"{tmp_path}/{folder}/evaluationlabel_b")
    found = files.scan_results(spark, str(tmp_path), "auc double")
    results = study.combine_results(grid, found, ["evaluation_folder", "test_label"])
    assert rows(results, "fine_tuned_model", "pretrained_epoch", "test_label", "auc") == [
        ("one", 4, "label_b", 0.5),
        ("two", 2, "label_b", 0.75),
    ]
