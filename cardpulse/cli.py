"""Command line: ``python -m cardpulse.cli COMMAND``; see ``--help`` of each."""

from __future__ import annotations

import argparse
import json
import time
from statistics import median

from .config import BenchmarkSource, Layers
from .operators import ranking
from .operators.modelling import FEATURE_SETS, evaluate, fill_defaults, gate_sweep, model_frame, split_and_sample, two_stage
from .operators.reports import alert_summary, false_positive_categories, sample_false_positives, split_summary
from .session import build_session

#: Runs of earlier reports by number: their feature sets.
BASE_RUNS = {9: "amount_plus_night", 17: "amount_plus_night_catz_v3_damped_shrunk"}
RERANK_RUNS = {18: "amount_plus_night_catz_v3_shrunk"}


def _numbers(kind):
    def parse(text: str) -> list:
        found = [kind(x) for x in text.split(",") if x.strip()]
        if not found:
            raise argparse.ArgumentTypeError("at least one number")
        return found

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cardpulse", description="Transaction features and alert ranking on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text, description=text)

    p = command("build", "Build bronze, silver and gold.")
    p.add_argument("--paths", help="YAML with the layers' paths")
    p.add_argument("--stage", choices=("all", "bronze", "silver", "gold"), default="all")
    p = command("normalize", "Turn the labelled CSV into raw JSON.")
    p.add_argument("--config", help="YAML with a benchmark section")
    p = command("generate", "Write synthetic raw transactions.")
    p.add_argument("--config", help="YAML of the generator")

    def sampling(p: argparse.ArgumentParser) -> None:
        p.add_argument("--gold", required=True, help="feature table")
        for split in ("train", "validation", "test"):
            p.add_argument(f"--{split}-fraction", type=float, default=1.0)

    p = command("evaluate", "Evaluate feature sets, or sweep the category gate.")
    sampling(p)
    p.add_argument("--feature-set", choices=("all", *FEATURE_SETS), default="all")
    p.add_argument("--model-type", choices=("logistic", "gbt", "both"), default="logistic")
    p.add_argument("--logistic-class-weights", action="store_true")
    p.add_argument("--topk-secondary-signal", choices=ranking.SECONDARY, default="none")
    p.add_argument("--topk-secondary-epsilon", type=float, default=0.0)
    p.add_argument("--category-k-grid", type=_numbers(int), default=[])
    p.add_argument("--category-z-variant", choices=("raw", "damped", "both"), default="damped")
    for name, k in (("primary", 5000), ("tie-break", 10000), ("sanity", 100)):
        p.add_argument(f"--topk-{name}", type=int, default=k)
    p = command("rerank", "Two-stage ranking: a logistic queue whose head boosted trees reorder.")
    sampling(p)
    p.add_argument("--base-lr-run", type=int, choices=sorted(BASE_RUNS), default=9)
    p.add_argument("--reranker-gbt-run", type=int, choices=sorted(RERANK_RUNS), default=18)
    p.add_argument("--shortlist-n", type=int, default=5000)
    p.add_argument("--rerank-mode", choices=("pure", "blended"), default="pure")
    p.add_argument("--alpha", type=float, default=0.10)
    p.add_argument("--logistic-class-weights", action="store_true")
    p.add_argument("--topk", type=_numbers(int), default=list(ranking.TOP_K))
    p.add_argument("--compute-full-metrics", action="store_true")
    p = command("inspect", "Look into the head of the alert queue.")
    sampling(p)
    p.add_argument("--feature-set", choices=tuple(FEATURE_SETS), default="amount_plus_night")
    p.add_argument("--model-type", choices=("logistic", "gbt"), default="logistic")
    p = command("time", "Time reading, preparation and evaluation at several sampling fractions.")
    p.add_argument("--gold", required=True)
    p.add_argument("--scales", type=_numbers(float), default=[1.0, 0.5, 0.25])
    p.add_argument("--fast", action="store_true")
    p.add_argument("--feature-set", choices=tuple(FEATURE_SETS), default="amount_plus_night")
    p.add_argument("--model-type", choices=("logistic", "gbt"), default="logistic")
    p.add_argument("--repeats", type=int, default=1)
    p.add_argument("--output-json")
    p.add_argument("--output-csv", help="append one row per scale")
    return top


def _model(spark, args):
    df = split_and_sample(model_frame(spark.read.parquet(args.gold)), args.train_fraction, args.validation_fraction, args.test_fraction)
    return df.cache()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("cardpulse")
    if args.command == "build":
        from .plans.layers import run_bronze_ingest, run_gold_features, run_layers, run_silver_transform

        layers = Layers.load(args.paths) if args.paths else Layers()
        steps = {"bronze": lambda: run_bronze_ingest(spark, layers.raw, layers.bronze, file_pattern=layers.file_pattern), "silver": lambda: run_silver_transform(spark, layers.bronze, layers.silver), "gold": lambda: run_gold_features(spark, layers.silver, layers.gold)}
        for name, df in (run_layers(spark, layers) if args.stage == "all" else {args.stage: steps[args.stage]()}).items():
            print(f"{name}: {df.count()} rows")
    elif args.command == "normalize":
        from .plans.layers import normalize_benchmark_raw

        print(normalize_benchmark_raw(spark, config=BenchmarkSource.load(args.config) if args.config else None).count(), "rows")
    elif args.command == "generate":
        from .synth import GeneratorConfig, run

        print(run(spark, GeneratorConfig.load(args.config) if args.config else GeneratorConfig()).count(), "rows")
    elif args.command == "evaluate":
        df = _model(spark, args)
        split_summary(df).show()
        if args.category_k_grid:
            variants = ("raw", "damped") if args.category_z_variant == "both" else (args.category_z_variant,)
            for row in gate_sweep(df, args.category_k_grid, variants, args.topk_primary, args.topk_tie_break, args.topk_sanity):
                print(json.dumps(row))
            return 0
        sets = FEATURE_SETS if args.feature_set == "all" else {args.feature_set: FEATURE_SETS[args.feature_set]}
        kinds = ("logistic", "gbt") if args.model_type == "both" else (args.model_type,)
        found = [{"name": n, **evaluate(df, c, k, weighted=args.logistic_class_weights and k == "logistic", secondary=args.topk_secondary_signal, epsilon=args.topk_secondary_epsilon)} for n, c in sets.items() for k in kinds]
        for row in sorted(found, key=lambda r: -(r["test_pr_auc"] or 0)):
            print(json.dumps(row))
    elif args.command == "rerank":
        df = _model(spark, args)
        print(json.dumps(two_stage(df, FEATURE_SETS[BASE_RUNS[args.base_lr_run]], FEATURE_SETS[RERANK_RUNS[args.reranker_gbt_run]], args.shortlist_n, args.rerank_mode, args.alpha, args.topk, args.logistic_class_weights, args.compute_full_metrics), indent=1))
    elif args.command == "inspect":
        inspect(spark, args)
    else:
        timings(spark, args)
    return 0


def inspect(spark, args) -> None:
    """Reports on the first 100 and 5000 alerts of the test split."""
    from .operators.modelling import assemble, fit, scored

    gold = spark.read.parquet(args.gold)
    extra = gold.select("transaction_id", "event_time_ts", "merchant_category", "merchant")
    df = assemble(_model(spark, args), FEATURE_SETS[args.feature_set])
    model = fit(df.where("split = 'train'"), args.model_type)
    head = ranking.queue_head(scored(model, df.where("split = 'test'")), 5000).drop("features")
    head = fill_defaults(extra.join(head, "transaction_id")).cache()
    for k in (100, 5000):
        top = head.where(head["position"] <= k)
        print(f"first {k} alerts of {args.feature_set}, {args.model_type}")
        alert_summary(top).show(truncate=False)
        false_positive_categories(top).show(truncate=False)
        sample_false_positives(top).show(truncate=False)


def timings(spark, args) -> None:
    """Seconds of each phase by scale, the median of the repeats."""
    out = []
    for scale in [0.02] if args.fast else args.scales:
        runs = []
        for _ in range(max(1, args.repeats)):
            t0 = time.perf_counter()
            df = split_and_sample(model_frame(spark.read.parquet(args.gold)), scale, scale, scale).cache()
            rows = df.count()
            t1 = time.perf_counter()
            evaluate(df, FEATURE_SETS[args.feature_set], args.model_type)
            runs.append((rows, t1 - t0, time.perf_counter() - t1))
            df.unpersist()
        out.append({"scale": scale, "rows": runs[0][0], "prepare_s": median(r[1] for r in runs), "evaluate_s": median(r[2] for r in runs)})
    text = json.dumps({"feature_set": args.feature_set, "model_type": args.model_type, "runs": out}, indent=1)
    if args.output_json:
        with open(args.output_json, "w") as f:
            f.write(text)
    if args.output_csv:
        with open(args.output_csv, "a") as f:
            if f.tell() == 0:
                f.write(",".join(out[0]) + "\n")
            f.writelines(",".join(str(v) for v in row.values()) + "\n" for row in out)
    print(text)


if __name__ == "__main__":
    raise SystemExit(main())
