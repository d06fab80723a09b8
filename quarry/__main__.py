"""Command line of the jobs: python -m quarry fetch|load|clean|enrich|build, each with the options of JobConfig that it uses."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import JobConfig
from .plans import build, enrich, load
from .schemas import MATCHES_RAW
from .sources import paged
from .sources.readers import read_csv, read_pages, typed
from .sources.writers import write_csv

DEFAULTS = JobConfig()


def _option(parser: argparse.ArgumentParser, *names: str) -> None:
    """Options of the fields of JobConfig, with their types and defaults."""
    for name in names:
        value = getattr(DEFAULTS, name)
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            parser.add_argument(flag, action="store_true")
        elif isinstance(value, tuple):
            parser.add_argument(flag, nargs="*", default=list(value))
        else:
            parser.add_argument(flag, type=date.fromisoformat if isinstance(value, date) else type(value), default=value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Match results: fetch, load, clean, enrich, build.")
    jobs = top.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("fetch", help="listing pages by offset, to Parquet; pages that are there are not asked for again")
    p.add_argument("--url", required=True, help="address with {offset}")
    p.add_argument("--target", required=True)
    for name, kind, value in (("retries", int, 5), ("timeout", float, 30.0), ("sleep-min", float, 1.5), ("sleep-max", float, 3.5)):
        p.add_argument(f"--{name}", type=kind, default=value)
    _option(p, "start_date", "max_pages", "page_size", "start_offset")
    p = jobs.add_parser("load", help="fetched listing pages to raw matches")
    p.add_argument("--pages", required=True, help="what fetch has written")
    _option(p, "start_date", "end_date", "max_pages", "raw_path")
    p = jobs.add_parser("clean", help="a generic match list")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p = jobs.add_parser("enrich", help="saved match and statistics pages to the enriched relations")
    p.add_argument("--match-pages", required=True)
    p.add_argument("--stats-pages", required=True)
    p.add_argument("--target", required=True, help="folder of the relations")
    _option(p, "raw_path", "start_offset", "limit_matches")
    p = jobs.add_parser("build", help="raw and enriched relations to the final dataset")
    _option(p, "raw_path", "enriched_dirs", "output_dir", "cutoff_date", "compat")
    return top


def configured(args: argparse.Namespace) -> JobConfig:
    """The defaults with what the command line says."""
    said = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if hasattr(DEFAULTS, k)}
    return replace(DEFAULTS, **said)


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """Do the job and say what came of it."""
    config = configured(args)
    if args.job == "fetch":
        how = {"start": config.start_offset, "pages": config.max_pages, "step": config.page_size, "since": config.start_date, "retries": args.retries, "timeout": args.timeout, "sleepmin": args.sleep_min, "sleepmax": args.sleep_max}
        got = paged.fetch(spark, args.target, url=args.url, **how).agg(F.count("*").alias("pages"), F.count("error").alias("failed")).first()
        return f"{got['pages']} pages, {got['failed']} of them failed"
    if args.job == "load":
        out = load.load(spark.read.parquet(args.pages).filter("error is null").select("page_idx", "html"), config)
        rows = write_csv(out["matches_raw"], config.raw_path)["rows"]
        told = load.progress(out["pages"], config).first()
        return f"{rows} matches of {told['pages']} pages, {told['percent'] or 0:.1f} % of the days"
    if args.job == "clean":
        return f"{write_csv(load.clean(read_csv(spark, args.source)), args.target)['rows']} rows"
    if args.job == "enrich":
        raw = typed(read_csv(spark, config.raw_path, MATCHES_RAW), MATCHES_RAW)
        matches, _ = read_pages(spark, args.match_pages, r"(\d+)[^/]*\.html$", "match_id")
        stats, _ = read_pages(spark, args.stats_pages, r"(\d+)[^/]*\.html$", "mapstatsid")
        out = enrich.enrich(raw, matches.select("match_id", "html"), stats.select("mapstatsid", "html"), config)
        return ", ".join(f"{n}: {write_csv(df, f'{args.target}/{n}.csv')['rows']} rows" for n, df in out.items())
    return build.run(spark, config)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quarry-{args.job}").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main()
