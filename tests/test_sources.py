"""Files in and out, and the layer builds end to end."""

import json

import pytest

from cardpulse.config import BenchmarkSource, Layers
from cardpulse.plans import layers as builds
from cardpulse.schema import GOLD_COLUMNS, SILVER
from cardpulse.sources.adapters import from_benchmark
from cardpulse.sources.files import read_benchmark_csv, read_json, rows_frame, write_json, write_parquet

RAW = [
    {"transaction_id": "tx_1", "card_id": "card_1", "event_time": "2013-09-01T01:00:00Z", "amount": 10.0, "merchant_category": "retail", "latitude": 40.0, "longitude": -74.0, "anomaly_type": "none"},
    {"transaction_id": "tx_2", "card_id": "card_1", "event_time": "2013-09-01T02:00:00Z", "amount": 25.0, "merchant_category": "retail", "latitude": 40.1, "longitude": -74.1, "anomaly_type": "none"},
]


def test_layers_end_to_end(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in RAW))
    (tmp_path / "raw" / "skip.txt").write_text("no json")
    (tmp_path / "paths.yaml").write_text("data: {raw: raw, bronze: b, silver: s, gold: g}\ningest: {file_pattern: '*.jsonl'}\n")
    layers = Layers.load(tmp_path / "paths.yaml")
    assert layers.bronze == str(tmp_path / "b")
    built = builds.run_layers(spark, layers)
    assert {k: v.count() for k, v in built.items()} == {"bronze": 2, "silver": 2, "gold": 2}
    bronze = built["bronze"].first()
    assert bronze["source_path"].endswith("raw/a.jsonl")
    assert bronze["ingestion_timestamp"] is not None
    assert built["silver"].columns == list(SILVER)
    assert tuple(built["gold"].columns) == GOLD_COLUMNS
    again = builds.run_bronze_ingest(spark, paths_yaml=str(tmp_path / "paths.yaml"))
    assert again.count() == 2  # overwritten, not added to


def test_benchmark_csv(spark, tmp_path):
    head = "trans_num,cc_num,unix_time,amt,category,merch_lat,merch_long,is_fraud,merchant,lat,long,extra\n"
    (tmp_path / "d.csv").write_text(head + 't1,11,1325376018,2.5,food,10,20,1,"a, b",1,2,x\nt2,11,1325376019,bad,food,10,20,,m,1,2,x\n')
    out = builds.normalize_benchmark_raw(spark, str(tmp_path / "d.csv"), str(tmp_path / "raw"), BenchmarkSource(fraud_label_value="F", non_fraud_label_value="N"))
    rows = {r["transaction_id"]: r for r in out.collect()}
    assert rows["t1"]["event_time"] == "2012-01-01T00:00:18Z"
    assert (rows["t1"]["anomaly_type"], rows["t2"]["anomaly_type"]) == ("F", "N")
    assert (rows["t1"]["merchant"], rows["t2"]["amount"], rows["t1"]["ref_transaction_id"]) == ("a, b", None, None)
    gold = builds.run_gold_features(spark, *[str(tmp_path / n) for n in ("silver", "gold")]) if builds.run_silver_transform(spark, _bronze(spark, tmp_path), str(tmp_path / "silver")).count() else None
    assert [r["transaction_id"] for r in gold.collect()] == ["t1"]


def _bronze(spark, tmp_path):
    builds.run_bronze_ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), file_pattern="*.json")
    return str(tmp_path / "bronze")


@pytest.mark.parametrize("columns", ["unix_time", "trans_date_trans_time", "trans_date,trans_time"])
def test_three_time_layouts(spark, columns):
    values = {"unix_time": "1325376018", "trans_date_trans_time": "2012-01-01 00:00:18", "trans_date": "2012-01-01", "trans_time": "00:00:18"}
    names = ["trans_num", "cc_num", "amt", "category", "merch_lat", "merch_long", "is_fraud", "merchant", "lat", "long", *columns.split(",")]
    row = from_benchmark(spark.createDataFrame([tuple(values.get(n, "1") for n in names)], names)).first()
    assert (row["event_time"], row["event_time_unix"]) == ("2012-01-01T00:00:18Z", 1325376018)


def test_no_time_is_an_error(spark):
    with pytest.raises(ValueError, match="no time"):
        from_benchmark(spark.createDataFrame([("1",)], ["trans_num"]))


def test_writers(spark, tmp_path):
    df = rows_frame(spark, [{"a": 1, "b": "x"}, {"a": 2}], "a int, b string")
    write_json(df, str(tmp_path / "j"))
    write_json(df, str(tmp_path / "j"), "append")
    assert read_json(spark, str(tmp_path / "j"), "*.json", df.schema).count() == 4
    back = write_parquet(df, str(tmp_path / "p"), rebalance=["a"])
    assert sorted(map(tuple, back.collect())) == [(1, "x"), (2, None)]
    assert write_parquet(df, str(tmp_path / "q"), partition_by=["a"]).where("a = 2").count() == 1
    with pytest.raises(ValueError, match="write mode"):
        write_json(df, str(tmp_path / "j"), "replace")


def test_csv_reader_takes_known_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("long,trans_num,zzz\n3,t,9\n")
    assert read_benchmark_csv(spark, str(tmp_path / "d.csv")).columns == ["long", "trans_num"]


def test_missing_configuration(tmp_path):
    with pytest.raises(FileNotFoundError):
        Layers.load(tmp_path / "none.yaml")
