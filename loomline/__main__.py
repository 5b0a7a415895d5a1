"""Command line: python -m loomline STEP.

    queries                        names of all registered queries
    query NAME --data D --out O    writes a query's rows as Parquet
    models --data D --out O        walk-forward forecasts of the registry; --models, --smoke, --restart
    report --data D --out O        report sheets as CSV folders
    environment --out O            versions, commit and settings of this installation as JSON
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from . import config as settings

log = logging.getLogger("loomline")
#: Sheets of the report: names, titles and the queries behind them.
SHEETS = {
    "sample": ("The sample's period", "sample_period"),
    "sources": ("Sources and their spans", "sources_span"),
    "cleaning": ("Stages of cleaning", "cleaning_stages"),
    "data_flow": ("From records to rows", "data_flow"),
    "flags": ("Coverage of the tags", "flag_coverage"),
    "precision": ("Precision of times by source", "time_precision"),
    "offset": ("The clock's offset", "offset_verdict"),
    "coverage": ("Coverage of the grid", "grid_coverage"),
    "features": ("Summary of the features", "feature_summary"),
    "returns": ("Returns", "return_descriptives"),
    "accuracy": ("Accuracy", "accuracy_metrics"),
    "folds": ("Ratio to the zero forecast by fold", "fold_ratio_pivot"),
    "effects": ("Changes of the squared error and their bounds", "effect_bounds"),
    "causality": ("Granger causality", "granger"),
    "stationarity": ("Unit roots", "adf"),
    "strategies": ("Strategies after costs", "backtest_summary"),
    "selection": ("Selection of a model", "model_selection"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--config", help="a YAML file of settings")
    steps = out.add_subparsers(dest="step", required=True)
    steps.add_parser("queries")
    for name in ("query", "models", "report"):
        step = steps.add_parser(name)
        step.add_argument("--data", help="the folder of the tables; by default the settings' data_path")
        step.add_argument("--out", required=True)
        if name == "query":
            step.add_argument("name")
        if name == "models":
            step.add_argument("--models", nargs="*", help="names, families or keys")
            step.add_argument("--assets", nargs="*", help="symbols; by default all")
            step.add_argument("--smoke", action="store_true", help="the last fold, one seed, small settings")
            step.add_argument("--restart", action="store_true", help="move earlier forecasts aside and begin anew")
        if name == "report":
            step.add_argument("--sheets", nargs="*", default=list(SHEETS))
    steps.add_parser("environment").add_argument("--out")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    chosen = settings.load(args.config)
    from . import catalogue

    if args.step == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    if args.step == "environment":
        text = json.dumps(settings.manifest(chosen), indent=2, sort_keys=True)
        if not args.out:
            print(text)
            return
        os.makedirs(os.path.dirname(os.path.abspath(args.out)), exist_ok=True)
        with open(args.out, "w") as file:
            file.write(text)
        return
    from .session import get_session
    from .sources.files import write_table

    spark, data = get_session(), args.data or chosen.data_path
    if args.step == "query":
        write_table(catalogue.QUERIES[args.name](spark, data), args.out)
    elif args.step == "models":
        from . import models
        from .plans.evaluation import FOLDS
        from .plans.series import model_table

        table = model_table(spark, data)
        table = table.filter(table.symbol.isin(args.assets)) if args.assets else table
        done = models.run(table, FOLDS, args.out, args.models, args.smoke, args.restart)
        log.info("forecasts of %s are in %s", ", ".join(done), args.out)
    else:
        from .operators.report import write_sheets

        write_sheets({name: (SHEETS[name][0], catalogue.QUERIES[SHEETS[name][1]](spark, data)) for name in args.sheets}, args.out)
    log.info("%s: done", args.step)


if __name__ == "__main__":
    main()
