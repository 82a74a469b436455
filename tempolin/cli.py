"""Command line: ``python -m tempolin.cli fit|compare ...`` under spark-submit or alone."""

from __future__ import annotations

import argparse
import dataclasses
import math
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tempolin.batch import asked_sessions, compare_models, fit_sessions, mean_by_model
from tempolin.plans.library import MODELS
from tempolin.plans.spec import CVConfig, Dropout, FitConfig
from tempolin.sources import sinks
from tempolin.sources.session import QC_COLUMN, TableStore, qc_units


def dropout_argument(text: str) -> Dropout:
    """``gain:name``, ``group:name`` or ``predictors:a,b``."""
    kind, colon, names = text.partition(":")
    makers = {"gain": lambda: Dropout.gain(names), "group": lambda: Dropout.group(names), "predictors": lambda: Dropout.predictors(*filter(None, names.split(",")))}
    if not colon or kind not in makers:
        raise argparse.ArgumentTypeError(f"{text!r} is not gain:name, group:name or predictors:a,b")
    return makers[kind]()


def positive_argument(text: str) -> float:
    value = float(text)
    if not (math.isfinite(value) and value > 0):
        raise argparse.ArgumentTypeError(f"{text} is not a positive number")
    return value


def condition_argument(text: str) -> str:
    """SQL text that Spark can parse; it needs a session, and waits for one otherwise."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
        except Exception as error:
            raise argparse.ArgumentTypeError(f"no SQL condition: {text!r}") from error
    return text


def _common(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--store", required=True, help="folder of Parquet tables")
    parser.add_argument("--session", help="the session of tables without a session column")
    qc = parser.add_mutually_exclusive_group()
    qc.add_argument("--qc-column", default=QC_COLUMN)
    qc.add_argument("--qc-filter", type=condition_argument, help="SQL condition in place of the QC column; noise is left out anyway")
    parser.add_argument("--cv-split", choices=("auto", "groups", "trials"), default="auto")
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--fold-seed", type=int)
    parser.add_argument("--max-iter", type=int, default=FitConfig().max_iter)
    parser.add_argument("--dt", type=positive_argument)
    parser.add_argument("--use-instruction-trials", action="store_true")
    reduced = parser.add_mutually_exclusive_group()
    reduced.add_argument("--dropout", action="append", type=dropout_argument)
    reduced.add_argument("--no-dropouts", action="store_true")


# Names of the options.
def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="fit the units of all sessions of a store")
    _common(fit)
    fit.add_argument("--output", required=True)
    fit.add_argument("--model", choices=sorted(MODELS), default="default")
    fit.add_argument("--limit", type=int, help="units of a session at most")
    fit.add_argument("--sessions", nargs="+", help="sessions to run; all by default")
    fit.add_argument("--session-limit", type=int, help="sessions at most, before those that are done are left out")
    fit.add_argument("--overwrite", action="store_true")
    fit.add_argument("--dry-run", action="store_true", help="list the sessions that would be fitted")
    compare = commands.add_parser("compare", help="compare models on the same units")
    _common(compare)
    compare.add_argument("--models", nargs="+", choices=sorted(MODELS), required=True)
    compare.add_argument("--unit-ids", nargs="+")
    compare.add_argument("--unit-limit", type=int, default=8)
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    spark = SparkSession.builder.appName("tempolin").getOrCreate()
    args = build_parser().parse_args(argv)
    store = TableStore(spark, args.store, args.session)
    shared = {
        "fit": FitConfig(max_iter=args.max_iter), "cv": CVConfig(folds=args.folds, seed=args.fold_seed, split=args.cv_split),
        "dropouts": () if args.no_dropouts else args.dropout, "qc_column": args.qc_column, "qc_filter": args.qc_filter, "use_instruction_trials": args.use_instruction_trials,
    }
    with_dt = lambda m: m if args.dt is None else dataclasses.replace(m, dt=args.dt)
    if args.command == "compare":
        table = compare_models(store, [with_dt(MODELS[m]) for m in args.models], unit_ids=args.unit_ids, unit_limit=args.unit_limit, **shared).persist()
        table.show(truncate=False)
        mean_by_model(table).show(truncate=False)
        return
    if args.dry_run:
        known = qc_units(store, args.qc_column, args.qc_filter).select("session").distinct()
        asked = asked_sessions(known, args.sessions, args.session_limit)
        known = known if asked is None else known.join(asked, "session", "left_semi")
        sinks.pending(known, sinks.written_sessions(spark, args.output), args.overwrite).show(truncate=False)
        return
    fitted = fit_sessions(store, args.output, model=with_dt(MODELS[args.model]), limit=args.limit, overwrite=args.overwrite, sessions=args.sessions, session_limit=args.session_limit, **shared)
    sinks.save_parameters(spark, args.output, vars(args), fitted)


if __name__ == "__main__":
    main()
