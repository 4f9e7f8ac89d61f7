"""The lake jobs as commands, for spark-submit or `python -m vitalake`; each says what it does under --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vitalake.plans import runs, training
from vitalake.session import configure
from vitalake.sources.backup import restore
from vitalake.sources.landing import EXPORTS
from vitalake.sources.versions import read_tables
from vitalake.streaming import log_streams

# The dump commands and the export each stands for.
EXPORT_OF = {"workout": "workout_session", "food": "food_item", "exercise": "exercise", "diet": "diet_recommendation"}


def _enum(text: str) -> tuple[str, list[str]]:
    column, _, allowed = text.partition("=")
    if not allowed:
        raise argparse.ArgumentTypeError(f"{text!r} is not column=value,value")
    return column, allowed.split(",")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vitalake", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, says: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=says, description=says)
        sub.add_argument("--root", required=True, help="lake folder, shared by all executors")
        return sub

    dump = job("dump", "land source files or fetched exports as versioned datasets")
    dump.add_argument("what", choices=["external", *EXPORT_OF, "api", "all"], help="the source files, one export, all exports, or all")
    dump.add_argument("--folder", help="folder of the external source files")
    dump.add_argument("--export", help="path of one fetched export")
    dump.add_argument("--exports", help="folder of fetched exports, <dataset>.csv")
    dump.add_argument("--missing", choices=["skip", "fail"], default="skip", help="what to do about a source that is not there")
    dump.add_argument("--exercises", choices=["json", "jsonl"], default="json", help="one JSON array, or one object a line, which splits")
    load = job("load", "merge landed files into the serving tables")
    load.add_argument("target", choices=[*runs.SERVING_DATASETS, "all"])
    load.add_argument("--enum", type=_enum, action="append", default=[], metavar="COLUMN=A,B", help="values a column may have; others fail the load")
    warehouse = job("warehouse", "reload warehouse datasets from landed files")
    warehouse.add_argument("datasets", nargs="*", metavar="dataset", help="all if none is named")
    save = job("backup", "snapshot the published tables of one or more services")
    save.add_argument("service", nargs="+")
    save.add_argument("--tables", required=True, action="append", help="tables of each service in turn, <root>/<section>/<name>")
    back = job("restore", "replace tables by a snapshot")
    back.add_argument("service")
    back.add_argument("version", nargs="?", default="latest")
    back.add_argument("--target", required=True, help="tables to replace, <root>/<section>/<name>")
    train = job("train", "fit a model on the latest tables and make it the latest version")
    train.add_argument("model", choices=list(training.MODELS))
    score = job("score", "write the predictions of the latest model for a parquet table")
    score.add_argument("model", choices=list(training.MODELS))
    score.add_argument("--rows", required=True, help="parquet table with the features of the model")
    score.add_argument("--out", required=True, help="folder for all its rows and their prediction")
    logs = job("logs", "append container records that lie in a folder to the log table under root")
    logs.add_argument("--records", required=True, help="folder of JSON lines, as the shipper drops them")
    logs.add_argument("--keep", required=True, nargs="+", help="services whose lines are kept")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """Do one job; returns what it reports."""
    if args.job == "dump":
        done = {}
        if args.what in ("external", "all"):
            done.update(runs.dump_external(spark, args.folder, args.root, missing=args.missing, exercise=args.exercises))
        if args.what in EXPORT_OF:
            done.update(runs.dump_exports(spark, {EXPORT_OF[args.what]: args.export}, args.root))
        if args.what in ("api", "all"):
            paths = {name: f"{args.exports}/{name}.csv" for name in EXPORTS}
            done.update({f"api/{k}": v for k, v in runs.dump_exports(spark, paths, args.root).items()})
        return done
    if args.job == "load":
        datasets = runs.SERVING_DATASETS if args.target == "all" else [args.target]
        return runs.load_serving(spark, args.root, datasets=datasets, enums=dict(args.enum))
    if args.job == "warehouse":
        return runs.load_warehouse(spark, args.root, datasets=args.datasets or runs.WAREHOUSE_DATASETS)
    if args.job == "backup":
        if len(args.service) != len(args.tables):
            raise ValueError(f"{len(args.service)} services, but {len(args.tables)} --tables")
        pairs = zip(args.service, args.tables, strict=True)
        return runs.backup_services({s: read_tables(spark, *t.rstrip("/").rsplit("/", 2)) for s, t in pairs}, args.root)
    if args.job == "restore":
        return sorted(restore(spark, args.root, args.service, args.version, args.target))
    if args.job == "score":
        training.score_latest(spark, args.root, args.model, spark.read.parquet(args.rows)).write.parquet(args.out)
        return args.out
    if args.job == "logs":
        records = log_streams.open_json(spark, args.records, log_streams.RECORD_SCHEMA)
        table, checkpoint = f"{args.root}/logs/lines", f"{args.root}/logs/checkpoint"
        log_streams.store_logs(log_streams.ingest(records, args.keep), table, checkpoint=checkpoint, once=True).awaitTermination()
        return table
    return training.train(spark, args.root, args.model).uid


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"vitalake {args.job}").getOrCreate())
    print(run(spark, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
