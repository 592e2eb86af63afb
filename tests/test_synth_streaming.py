"""Generator, streaming form of velocity, command line and the registry without the corpus part."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardpulse import cli, synth
from cardpulse.operators.clean import clean, typed
from cardpulse.operators.reports import rule_alignment
from cardpulse.plans.features import feature_table
from cardpulse.streaming.velocity import read_stream, velocity

ROOT = Path(__file__).resolve().parents[1]


def test_minimum_gap_by_hand(spark):
    df = spark.createDataFrame([("c", f"t{k}", t) for k, t in enumerate((0, 5, 40, 41, 200))], "card_id string, transaction_id string, t long")
    got = synth.minimum_gap(df, 30, "card_id", "t", "transaction_id")
    assert [r["t"] for r in got.orderBy("transaction_id").collect()] == [0, 30, 60, 90, 200]


def test_generator(spark):
    config = synth.GeneratorConfig(num_transactions=4000, num_cards=150, anomaly_ratio=0.04, seed=7)
    df = synth.generate(spark, config).cache()
    assert df.exceptAll(synth.generate(spark, config).repartition(5)).count() == 0  # the same for the same seed
    assert synth.generate(spark, synth.GeneratorConfig(num_transactions=50, seed=8)).count() == 50
    kinds = {r["anomaly_type"]: r["count"] for r in df.groupBy("anomaly_type").count().collect()}
    assert kinds["impossible_travel"] == 80
    assert 40 < kinds["spending_spike"] < 130
    gold = feature_table(clean(typed(df)))
    rules = {r["anomaly_type"]: r for r in rule_alignment(gold).collect()}
    assert rules["impossible_travel"]["impossible_by_rule_frac"] > 0.9
    assert rules["spending_spike"]["spike_by_rule_frac"] > 0.4
    assert rules["none"]["spike_by_rule_frac"] < 0.02
    shares = {r["merchant_category"]: r["n"] for r in df.groupBy("merchant_category").agg((F.count("*") / df.count()).alias("n")).collect()}
    assert abs(shares["retail"] - 0.4) < 0.05


def test_every_travel_row_is_there(spark):
    """Also with far more cards than transactions, most of which have none."""
    config = synth.GeneratorConfig(num_transactions=300, num_cards=5000, anomaly_ratio=0.5)
    df = synth.generate(spark, config)
    travel = df.where("anomaly_type = 'impossible_travel'")
    assert travel.count() == 75
    assert travel.join(df.select(F.col("transaction_id").alias("i"), F.col("card_id").alias("c")), (F.col("ref_transaction_id") == F.col("i")) & (F.col("card_id") == F.col("c")), "left_semi").count() == 75


def test_generator_writes_and_loads(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("num_transactions: 4\nnum_cards: 2\nanomaly_ratio: 0.0\nmerchant_categories:\n  - {name: retail, weight: 1.0}\n")
    config = synth.GeneratorConfig.load(tmp_path / "g.yaml", output_path=str(tmp_path / "raw"))
    assert synth.run(spark, config).count() == 4
    lines = [json.loads(x) for f in (tmp_path / "raw").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4
    assert all("ref_transaction_id" not in x and x["merchant_category"] == "retail" for x in lines)
    with pytest.raises(ValueError, match="write mode"):
        synth.write_raw(synth.generate(spark, config), str(tmp_path / "x"), "merge")
    with pytest.raises(ValueError, match="transactions"):
        synth.generate(spark, synth.GeneratorConfig(num_transactions=0))


def test_appended_runs_stand_side_by_side(spark, tmp_path):
    config = synth.GeneratorConfig(num_transactions=5, num_cards=2, anomaly_ratio=0.0, output_path=str(tmp_path / "raw"), raw_write_mode="append")
    df = synth.generate(spark, config)
    assert synth.write_raw(df, config.output_path, "append", "first").endswith("raw/run_id=first")
    assert synth.run(spark, config).count() == 5
    assert spark.read.json(config.output_path).count() == 10
    with pytest.raises(Exception, match="(?i)exists"):
        synth.write_raw(df, config.output_path, "append", "first")


def test_commands_run(spark, tmp_path, capsys):
    """The command line from generated rows to the reports, on a small table."""
    (tmp_path / "g.yaml").write_text(f"num_transactions: 1500\nnum_cards: 40\nanomaly_ratio: 0.2\noutput_path: {tmp_path}/raw\n")
    (tmp_path / "p.yaml").write_text(f"raw: {tmp_path}/raw\nbronze: {tmp_path}/bronze\nsilver: {tmp_path}/silver\ngold: {tmp_path}/gold\n")
    assert cli.main(["generate", "--config", str(tmp_path / "g.yaml")]) == 0
    gold = str(tmp_path / "labelled")
    df = feature_table(clean(typed(spark.read.json(f"{tmp_path}/raw"))), slice_merchants=True)
    df.withColumn("is_fraud", (F.col("anomaly_type") != "none").cast("int")).write.parquet(gold)
    assert cli.main(["evaluate", "--gold", gold, "--feature-set", "amount_only"]) == 0
    assert cli.main(["inspect", "--gold", gold]) == 0
    assert cli.main(["time", "--gold", gold, "--scales", "0.5", "--output-json", str(tmp_path / "t.json"), "--output-csv", str(tmp_path / "t.csv")]) == 0
    assert json.loads((tmp_path / "t.json").read_text())["runs"][0]["scale"] == 0.5
    assert len((tmp_path / "t.csv").read_text().splitlines()) == 2
    out = capsys.readouterr().out
    assert "test_pr_auc" in out
    assert "first 5000 alerts" in out


def test_package_exports(spark):
    import cardpulse

    assert all(callable(getattr(cardpulse, n)) for n in cardpulse.__all__)
    with pytest.raises(AttributeError):
        cardpulse.nothing  # noqa: B018


def test_stream_equals_batch(spark, tmp_path):
    df = synth.generate(spark, synth.GeneratorConfig(num_transactions=200, num_cards=10))
    synth.write_raw(df, str(tmp_path / "raw"))
    stream = velocity(read_stream(spark, str(tmp_path / "raw"), "*.json"), lateness="90 days")
    query = stream.writeStream.format("memory").queryName("velocity_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = velocity(typed(df))
    both = [sorted((r["card_id"], r["window_start"], r["tx_count"]) for r in x.collect()) for x in (spark.table("velocity_test"), batch)]
    assert both[0] == both[1]


def test_cli_arguments():
    args = cli.parser().parse_args(["evaluate", "--gold", "g", "--category-k-grid", "2,3", "--train-fraction", "0.5"])
    assert (args.category_k_grid, args.train_fraction, args.topk_primary) == ([2, 3], 0.5, 5000)
    args = cli.parser().parse_args(["rerank", "--gold", "g", "--topk", "10,20", "--rerank-mode", "blended"])
    assert (args.topk, args.alpha, args.base_lr_run) == ([10, 20], 0.1, 9)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["evaluate", "--gold", "g", "--model-type", "tree"])


def test_entry_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "cardpulse", tmp_path / "cardpulse", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); assert not any(n.startswith('op') for n in q); assert 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
