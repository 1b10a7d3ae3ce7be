import pytest
from pyspark.sql import functions as F

from climspark import read_observations, score_grains
from climspark.sources.staging import shared_folder, stage
from climspark.sources.tables import write_json, write_table


@pytest.mark.parametrize("extension", ["csv", "parquet"])
def test_round_trip(spark, network, tmp_path, extension):
    path = str(tmp_path / f"obs.{extension}")
    assert write_table(network, path) == path
    back = read_observations(spark, path)
    assert [f.dataType.simpleString() for f in back.schema.fields] == ["bigint", "date"] + ["double"] * 4
    assert back.exceptAll(network).count() == 0 and back.count() == network.count()


def test_csv_columns_are_found_by_name(spark, network, tmp_path):
    path = str(tmp_path / "obs.csv")
    write_table(network.select("prec", "date", "altitude", "station", "longitude", "latitude"), path)
    assert read_observations(spark, path).exceptAll(network).count() == 0


def test_nan_becomes_null(spark, network, tmp_path):
    path = str(tmp_path / "obs.parquet")
    write_table(network.withColumn("prec", F.lit(float("nan"))), path)
    assert read_observations(spark, path).filter("prec is null").count() == network.count()


def test_unknown_extension_and_no_path(network):
    with pytest.raises(ValueError, match="No writer for extension"):
        write_table(network, "/tmp/x.feather")
    assert write_table(network, None) is None and write_json(network, None) is None


def test_undefined_scores_are_null_in_json(spark, network, tmp_path):
    path = str(tmp_path / "m")
    flat = network.select("station", "date", F.lit(1.0).alias("y_true"), F.lit(2.0).alias("y_pred"))
    write_json(score_grains(flat.filter("date < '2000-02-01'")), path)
    text = [r[0] for r in spark.read.text(path).collect()]
    assert len(text) == 9 and all('"r2":null' in t for t in text)


def test_staged_tables_lie_in_the_shared_folder(spark, network):
    staged = stage(network, "copy")
    folder = shared_folder(spark).removeprefix("file:").rstrip("/")
    assert all(folder in f for f in staged.inputFiles())
    assert staged.schema == network.schema and staged.exceptAll(network).count() == 0


def test_run_folder_can_be_dropped(spark, tmp_path, monkeypatch):
    from climspark.sources import staging

    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    table = staging.stage(spark.range(3).toDF("n"), "numbers")
    assert table.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert staging.drop_run_folder(spark) and not list(tmp_path.iterdir())
