"""Jobs for spark-submit: ``python -m runwise <job> --help``."""

import argparse
import os

from pyspark.sql import SparkSession

from runwise import operators as op, plans, sources as src
from runwise.session import JOB_CONF, event_log_conf, s3a_conf, scratch_scope


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="runwise")
    parser.add_argument("--event-log-dir", help="leave an event log of this job here")
    parser.add_argument("--params", default="", help="Spark options as key=value;key=value")
    jobs = parser.add_subparsers(dest="job", required=True)

    generate = jobs.add_parser("generate", help="write a synthetic person table")
    generate.add_argument("--rows", type=int, required=True)
    generate.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    generate.add_argument("--output", required=True)
    generate.add_argument("--seed", type=int, default=0)
    generate.add_argument("--phone-prefix", default=src.pools.PHONE_PREFIX)

    profile = jobs.add_parser("profile", help="total the Parquet footers below a path")
    profile.add_argument("--input", required=True)
    profile.add_argument("--endpoint", help="of an S3-compatible store; its keys come from AWS_ACCESS_KEY_ID and AWS_SECRET_ACCESS_KEY")

    workload = jobs.add_parser("workload", help="derive, count and self-join a person table")
    workload.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    workload.add_argument("--input", required=True)
    workload.add_argument("--output")
    workload.add_argument("--config-log-dir", help="leave a configuration record of this run here")
    workload.add_argument("--join", action=argparse.BooleanOptionalAction, default=True)

    analyze = jobs.add_parser("analyze", help="fit input rows to executor memory over all logged runs")
    analyze.add_argument("--event-logs", required=True)
    analyze.add_argument("--config-logs", required=True)
    analyze.add_argument("--points", required=True, help="where to keep the training points")
    analyze.add_argument("--rows-key", default="limit")
    analyze.add_argument("--curve", help="where to keep the fitted curve")
    analyze.add_argument("--old-curve", help="a kept curve to refit with the new points")

    trials = jobs.add_parser("trials", help="rank the values a parameter had in all logged runs")
    trials.add_argument("--event-logs", required=True)
    trials.add_argument("--config-logs", required=True)
    trials.add_argument("--param", default="spark.sql.shuffle.partitions")
    return parser


def _keys() -> tuple[str, str]:
    return os.environ["AWS_ACCESS_KEY_ID"], os.environ["AWS_SECRET_ACCESS_KEY"]


def _store(args):
    """The file system for footers, where the store has an endpoint of its own."""
    if not args.endpoint:
        return None
    from pyarrow import fs

    scheme, _, host = args.endpoint.rpartition("://")
    key, secret = _keys()
    return fs.S3FileSystem(endpoint_override=host, scheme=scheme or "https", access_key=key, secret_key=secret)


def _session(args) -> SparkSession:
    options = dict(JOB_CONF)
    if getattr(args, "endpoint", None):
        options.update(s3a_conf(args.endpoint, *_keys()))
    if args.event_log_dir:
        options.update(event_log_conf(args.event_log_dir))
    options.update(item.split("=", 1) for item in args.params.split(";") if "=" in item)
    builder = SparkSession.builder.appName(f"runwise-{args.job}")
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _workload(spark: SparkSession, args) -> None:
    persons = src.read_table(spark, args.format, args.input)
    result = plans.run_workload(persons, args.output, need_to_join=args.join)
    rows = result.rows.first()["rows"]
    if args.config_log_dir:
        record = plans.own_record(
            spark, args.params, job=args.format, input_path=args.input, output_path=args.output,
            need_to_join=str(args.join).lower(), total_num_rows=rows,
        )
        src.write_config_log(record, args.config_log_dir)
    result.counts.show()
    result.other_counts.show()
    result.rows.show()
    if result.joined_rows is not None:
        result.joined_rows.show()


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = _session(args)
    with scratch_scope(spark):
        _run(spark, args)


def _run(spark: SparkSession, args) -> None:
    if args.job == "generate":
        people = src.generate_persons(src.person_ids(spark, args.rows), phone_prefix=args.phone_prefix, seed=args.seed)
        src.write_table(people, args.format, args.output)
    elif args.job == "profile":
        src.parquet_profile(src.parquet_footers(spark, args.input, _store(args))).show()
    elif args.job == "workload":
        _workload(spark, args)
    elif args.job == "analyze":
        result = plans.analyze_runs(spark, args.event_logs, args.config_logs, args.points, args.rows_key, args.curve, args.old_curve)
        result.points.show()
        result.probe.show()
    else:
        durations = op.app_durations(src.read_event_logs(spark, args.event_logs, complete=True))
        trials = op.trial_table(src.read_config_logs(spark, args.config_logs), durations, args.param)
        op.trial_stats(trials, by="value").orderBy("avg").show()
        op.best_trial(trials, ties=("application_attempt",)).show()


if __name__ == "__main__":
    main()
