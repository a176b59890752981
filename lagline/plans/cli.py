"""Command line: list, download, prepare, info, features.

A command that works on datasets makes a result for each (done, skipped or failed) and reports
them at the end, so one that fails leaves the others; the exit code is 1 if any failed.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import SparkSession

from ..sources import adapters
from ..sources.config import Config, load
from ..sources.files import FetchError, fetch
from ..sources.schema import with_rid
from ..sources.sinks import uri, write_features
from .features import SETS, attach_slow
from .prepare import prepare

#: What may go wrong with one dataset. Anything else is a bug, and ends the command.
EXPECTED = (FetchError, ValueError, FileNotFoundError)


@dataclass(frozen=True)
class Result:
    dataset: str
    state: str  # done, skipped or failed
    note: object

    def __str__(self) -> str:
        return f"[{self.state:7}] {self.dataset}: {self.note}"


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build_features(spark: SparkSession, name: str, config: Config, dest: str | None = None) -> str:
    if name not in SETS:
        raise ValueError(f"no feature set for {name!r}; there are {', '.join(SETS)}")
    read = lambda n: spark.read.parquet(uri(config.processed / n / "data.parquet"))
    df = read(name)
    keys = ["event_time", "entity_id", "amount"]
    extra = ()
    if name == "sparkov":
        df, extra = attach_slow(df, read("sparkov_slow")), ("reported_at_slow",)
        keys.append("trans_num")
    out = SETS[name](with_rid(df, keys))
    dest = dest or uri(config.processed.parent / "features" / f"{name}.parquet")
    write_features(out, dest, extra)
    return dest


def attempt(name: str, work: Callable[[str], object], commercial_only: bool = False) -> Result:
    try:
        adapter = adapters.get(name)
        if commercial_only and not adapter.commercial:
            return Result(name, "skipped", f"not for commercial use under {adapter.license}")
        return Result(name, "done", work(name))
    except adapters.UnknownDataset as e:
        return Result(name, "failed", e.args[0])
    except EXPECTED as e:
        return Result(name, "failed", e)


def report(results: Iterable[Result]) -> int:
    results = list(results)
    for r in results:
        print(r, file=sys.stderr if r.state == "failed" else sys.stdout)
    return int(any(r.state == "failed" for r in results))


def show_list(args) -> int:
    rows = [("dataset", "licence", "commercial use", "source")]
    rows += [(n, a.license, "yes" if a.commercial else "no", a.source.url) for n, a in ((n, adapters.get(n)) for n in adapters.names())]
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    for row in rows:
        print("  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=True)).rstrip())
    return 0


def show_info(args) -> int:
    card = load(args.config).processed / args.dataset / "dataset_card.json"
    if card.is_file():
        print(card.read_text().strip())
        return 0
    return report([Result(args.dataset, "failed", f"no card at {card}: prepare it first")])


def on_datasets(make: Callable[[argparse.Namespace, Config], Callable[[str], object]], known: Callable[[], list[str]], args) -> int:
    config = load(args.config)
    work = make(args, config)
    return report(attempt(n, work, args.exclude_noncommercial) for n in (known() if args.all else [args.dataset]))


def _download(args, config: Config):
    return lambda n: fetch(adapters.get(n).source, config.raw / adapters.get(n).raw_name, force=args.force)


def _prepare(args, config: Config):
    return lambda n: prepare(session(), n, config, force=args.force)


def _features(args, config: Config):
    return lambda n: build_features(session(), n, config)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lagline", description=__doc__.partition("\n")[0])
    commands = out.add_subparsers(required=True)
    commands.add_parser("list", help="the datasets, their licences and sources").set_defaults(run=show_list)
    info = commands.add_parser("info", help="a prepared dataset's card")
    info.add_argument("dataset")
    info.set_defaults(run=show_info)
    for name, make, known in (("download", _download, adapters.names), ("prepare", _prepare, adapters.names), ("features", _features, lambda: sorted(SETS))):
        p = commands.add_parser(name)
        one = p.add_mutually_exclusive_group(required=True)
        one.add_argument("dataset", nargs="?")
        one.add_argument("--all", action="store_true")
        p.add_argument("--force", action="store_true")
        p.add_argument("--exclude-noncommercial", action="store_true")
        p.set_defaults(run=partial(on_datasets, make, known))
    for p in commands.choices.values():
        p.add_argument("--config")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
