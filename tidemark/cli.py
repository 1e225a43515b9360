"""Command line: python -m tidemark.cli <command> ...; every report is JSON."""

from __future__ import annotations

import argparse
import json

from tidemark.functions.signals import FAMILIES
from tidemark.operators.bars import numbered
from tidemark.operators.consolidate import POLICIES, consolidate
from tidemark.plans import models, reports, search
from tidemark.session import session
from tidemark.sources import ledgers, objects, readers


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for a in args:
            p.add_argument(a)
        p.add_argument("--report", help="directory for the JSON report")
        p.add_argument("--registry", help="hash-chained ledger to append the report to")
        return p

    p = command("search", "search a family's grid over execution variants, behind the validation gate", "dataset")
    p.add_argument("--family", choices=sorted(FAMILIES), required=True)
    p.add_argument("--expiries", type=numbers, default=[1, 2, 3, 5])
    p.add_argument("--payout", type=float, default=0.82)
    p.add_argument("--min-payouts", type=numbers, default=[])
    p.add_argument("--payout-column", default="none", help="column name, or none")
    p.add_argument("--objective", default="wilson_low")
    p.add_argument("--min-trades", type=int, default=30)
    p.add_argument("--min-expectancy", type=float)
    p = command("walk-forward", "rolling train and test windows", "dataset")
    p.add_argument("--family", choices=sorted(FAMILIES), required=True)
    p.add_argument("--train", type=int, required=True)
    p.add_argument("--test", type=int, required=True)
    p.add_argument("--expiry", type=int, default=3)
    p = command("model", "train, gate and test a model", "dataset")
    p.add_argument("--kind", choices=sorted(models.FITS), default="logistic")
    command("benchmark", "baselines and family experiments", "dataset")
    p = command("fetch", "fetch hourly tick objects and store candles", "base", "symbol", "start", "end", "output")
    p.add_argument("--width", default="1 minute")
    p = command("consolidate", "merge overlapping snapshots", "output")
    p.add_argument("snapshots", nargs="+")
    p.add_argument("--policy", choices=POLICIES, default="error")
    command("verify", "verify a hash-chained ledger", "path")
    return top


def run(args: argparse.Namespace) -> dict:
    spark = session()
    if args.command == "verify":
        return {"valid": ledgers.verify(spark, args.path)}
    if args.command == "fetch":
        got = objects.download_candles(spark, args.base, args.symbol, args.start, args.end, f"{args.output}.objects", args.width)
        readers.write_frame(got, args.output)
        return readers.write_metadata(readers.read_frame(spark, args.output), args.output, base=args.base, symbol=args.symbol)
    if args.command == "consolidate":
        readers.write_frame(consolidate([readers.read_frame(spark, p) for p in args.snapshots], args.policy), args.output)
        return readers.write_metadata(readers.read_frame(spark, args.output), args.output, snapshots=args.snapshots)
    bars = numbered(readers.load_dataset(spark, args.dataset))
    if args.command == "benchmark":
        return reports.public_benchmark(bars, args.dataset)
    if args.command == "model":
        return models.run_model_experiment(bars, args.kind)
    family = FAMILIES[args.family]
    if args.command == "walk-forward":
        rows = search.walk_forward(bars, family, search.Variant(args.expiry), args.train, args.test).orderBy("window_id").collect()
        return {"windows": [reports.payload(r.asDict()) for r in rows]}
    variants = [search.Variant(int(e), payout=args.payout, min_payout=m) for e in args.expiries for m in (args.min_payouts or [None])]
    return search.run_experiment(bars, family, variants, objective=args.objective, min_trades=args.min_trades, min_expectancy=args.min_expectancy,
                                 payout_column=None if args.payout_column == "none" else args.payout_column)


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    report = run(args)
    if args.report:
        readers.write_report(session(), report, args.report)
    if args.registry:
        ledgers.append(session(), args.registry, {"command": args.command, "report": json.loads(json.dumps(report, default=str))})
    print(json.dumps(report, sort_keys=True, default=str))
    return report


if __name__ == "__main__":
    main()
