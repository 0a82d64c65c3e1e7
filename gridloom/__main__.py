"""Command line: train, predict, evaluate and show boosted models over delimited files; forecast and backtest panels."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from gridloom.operators import boost, forecast, global_forecast, metrics
from gridloom.session import session
from gridloom.sources import files


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="gridloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("train", "predict", "evaluate", "inspect"):
        p = sub.add_parser(name)
        p.add_argument("--model", required=True)
        if name != "inspect":
            p.add_argument("--data", required=True)
        if name in ("train", "evaluate"):
            p.add_argument("--target", required=True)
        if name == "train":
            p.add_argument("--rounds", type=int, default=20)
            p.add_argument("--depth", type=int, default=3)
            p.add_argument("--rate", type=float, default=0.1)
            p.add_argument("--loss", default="l2")
        if name == "predict":
            p.add_argument("--out", required=True)
    for name in ("forecast", "backtest"):
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--timestamp", required=True)
        p.add_argument("--target", required=True)
        p.add_argument("--series")
        p.add_argument("--config", required=True, help="a TOML or JSON file")
        if name == "forecast":
            p.add_argument("--out", required=True)
    a = top.parse_args(argv)
    spark = session("gridloom-cli")
    text = lambda path: "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    if a.command == "inspect":
        print(boost.BoostModel.from_json(text(a.model)).dump(), end="")
    elif a.command in ("train", "predict", "evaluate"):
        columns = spark.read.option("header", True).csv(a.data).columns
        rows = files.read_numeric_csv(spark, a.data, columns, getattr(a, "target", columns[-1]))
        if a.command == "train":
            spec = boost.BoostSpec(rounds=a.rounds, depth=a.depth, rate=a.rate, loss=a.loss)
            model = boost.fit(rows, [c for c in columns if c != a.target], a.target, spec)
            spark.range(1).select(F.lit(model.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(a.model)
        else:
            made = boost.BoostModel.from_json(text(a.model)).transform(rows)
            if a.command == "predict":
                made.write.mode("overwrite").option("header", True).csv(a.out)
            else:
                print(json.dumps(metrics.point_metrics(made, (), a.target, "prediction").first().asDict()))
    else:
        config = files.ForecastConfig.parse(text(a.config))
        panel = files.read_series_csv(spark, a.data, a.timestamp, a.target, a.series)
        if a.command == "forecast":
            made = None
            for name in config.models:
                one = global_forecast.forecaster(name)(panel, config.horizon).withColumn("model", F.lit(name))
                made = one if made is None else made.unionByName(one)
            files.write_forecast(made, a.out, {"horizon": config.horizon})
        else:
            folds = forecast.rolling_origins(panel, config.horizon, config.step, config.min_train, n_splits=config.folds)
            for name in config.models:
                run = forecast.backtest(panel, folds, lambda p, name=name: global_forecast.forecaster(name)(p, config.horizon))
                print(json.dumps({"model": name} | run.agg(*(F.avg(m).alias(m) for m in ("mae", "rmse", "wape"))).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
