"""Command line: check, settings, report."""

from __future__ import annotations

import argparse
import getpass
import os
import sys
import threading
import time
from collections.abc import Sequence
from pathlib import Path

from . import display, schema
from . import settings as config
from .translate import tr, use
from .sources.links import ContentUrl

VERSION = "0.1.0"


class Unique(argparse.Action):
    """Stores a list; a repeated value is an error."""

    def __call__(self, parser, namespace, values, option=None):
        repeated = sorted({str(v) for v in values if list(values).count(v) > 1})
        if repeated:
            parser.error(tr("Give each value once; given more than once: {}", ", ".join(repeated)))
        setattr(namespace, self.dest, list(values))


class Password(argparse.Action):
    """Asks for the password if none is given."""

    def __call__(self, parser, namespace, value, option=None):
        setattr(namespace, self.dest, value or getpass.getpass())


def directory(path: str) -> Path:
    if not os.path.isdir(path):
        raise argparse.ArgumentTypeError(tr("There is no directory '{}'.", path))
    return Path(path).resolve()


def file(path: str) -> Path:
    if not os.path.isfile(path):
        raise argparse.ArgumentTypeError(tr("There is no file '{}'.", path))
    return Path(path).resolve()


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="quillmatch", description=tr("Finds similar parts of source codes."), formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    root.add_argument("-v", "--version", action="version", version=f"quillmatch {VERSION}")
    commands = root.add_subparsers(dest="root", required=True, metavar="COMMAND")

    settings = commands.add_parser("settings", help=tr("Modify and show settings.")).add_subparsers(dest="settings", required=True, metavar="COMMAND")
    m = settings.add_parser("modify", help=tr("Change settings."))
    m.add_argument("-env", "--environment", type=file, help="File with the access token of the code host.")
    m.add_argument("-r", "--reports", type=Path, metavar="PATH", help="File or folder of reports.")
    m.add_argument("-re", "--reports_extension", choices=schema.REPORTS_EXTENSIONS)
    m.add_argument("-sp", "--show_progress", type=int, choices=[0, 1])
    m.add_argument("-so", "--short-output", type=int, choices=schema.SHORT_OUTPUTS, help="0 shows all results, 1 new ones, 2 none.")
    m.add_argument("-t", "--threshold", type=int, choices=schema.THRESHOLDS, metavar="{50, 51, ..., 99}")
    m.add_argument("-md", "--max-depth", type=int, choices=schema.MAX_DEPTHS)
    m.add_argument("-nl", "--ngrams-length", type=int, choices=schema.NGRAMS_LENGTHS)
    m.add_argument("-l", "--language", choices=schema.LANGUAGES)
    m.add_argument("--log-level", choices=schema.LOG_LEVELS)
    m.add_argument("-w", "--workers", type=int, choices=range(1, (os.cpu_count() or 1) + 1))
    m.add_argument("-mh", "--mongo-host")
    m.add_argument("-mpt", "--mongo-port", type=int, choices=range(1, 65536), metavar="{1, 2, ..., 65535}")
    m.add_argument("-mu", "--mongo-user")
    m.add_argument("-mps", "--mongo-pass", nargs="?", action=Password)
    settings.add_parser("show", help=tr("Show settings."))

    check = commands.add_parser("check", help=tr("Search for similar works."))
    check.add_argument("-d", "--directories", type=directory, nargs="+", action=Unique, default=[], metavar="DIRECTORY")
    check.add_argument("-f", "--files", type=file, nargs="+", action=Unique, default=[], metavar="FILE")
    check.add_argument("--mode", choices=schema.MODES, default="many_to_many")
    check.add_argument("-pe", "--path-regexp")
    check.add_argument("--ignore-threshold", action="store_true")
    check.add_argument("-ext", "--extension", choices=tuple(schema.EXTENSIONS), required=True)
    check.add_argument("-ab", "--all-branches", action="store_true")
    check.add_argument("-re", "--repo-regexp")
    check.add_argument("-gu", "--github-user", default="")
    check.add_argument("-gurl", "--github-urls", type=ContentUrl, nargs="+", action=Unique, default=[], metavar="URL")

    create = commands.add_parser("report", help=tr("Work with reports.")).add_subparsers(dest="report", required=True, metavar="COMMAND").add_parser("create", help=tr("Write a report."))
    create.add_argument("-p", "--path", type=Path, required=True)
    create.add_argument("-t", "--type", choices=schema.REPORT_TYPES, default="general")
    create.add_argument("-frp", "--first-root-path")
    create.add_argument("-srp", "--second-root-path")
    return root


def parse(args: Sequence[str] | None = None) -> argparse.Namespace:
    use(config.read_settings()["language"])
    p = parser()
    a = p.parse_args(args)
    if a.root == "settings" and a.settings == "modify" and not any(getattr(a, k, None) is not None for k in config.KEYS):
        p.error(tr("Here is nothing to modify: name a setting."))
    if a.root == "check":
        if a.repo_regexp and not a.github_user:
            p.error(tr("--repo-regexp chooses among the repositories of --github-user, which is missing."))
        if a.path_regexp and not (a.directories or a.github_user or a.github_urls):
            p.error(tr("--path-regexp needs directories, a user or links to choose from."))
    if a.root == "report" and bool(a.first_root_path) != bool(a.second_root_path):
        p.error(tr("Give both root paths or none."))
    return a


def csv_path(reports: Path) -> str:
    return str(reports / "quillmatch_report.csv") if reports.is_dir() else str(reports)


def show_progress(spark, workers: int, stop: threading.Event) -> None:
    """Print the share of tasks done in the stages that run, once a second."""
    tracker, began = spark.sparkContext.statusTracker(), time.monotonic()
    while not stop.wait(1.0):
        progress = display.Progress.of_stages(map(tracker.getStageInfo, tracker.getActiveStageIds()), began)
        if progress.total:
            print(progress.line(workers), end="\r")


def run(a: argparse.Namespace) -> int:
    if a.root == "settings":
        now = config.modify(vars(a)) if a.settings == "modify" else config.read_settings()
        print(config.table(now))
        return schema.ExitCode.SUCCESS

    from pyspark import SparkConf
    from pyspark.sql import SparkSession

    from .operators.report import compliance_table
    from .plans.check import WorksComparator, access_token
    from .plans.html import html_report_create
    from .sources.store import feature_store, read_csv, result_store

    s = config.read_settings()
    builder = SparkSession.builder.appName("quillmatch")
    if SparkSession.getActiveSession() is None and not SparkConf().contains("spark.master"):
        builder = builder.master(f"local[{s['workers']}]")
    spark = builder.getOrCreate()
    reports, stored = s.get("reports"), s["reports_extension"] == "mongo"
    if a.root == "report":
        if not reports or not (os.path.exists(reports) if stored else os.path.exists(csv_path(reports))):
            config.log.error(tr("There are no reports."))
            return schema.ExitCode.INVALID
        infos = result_store(spark, f"{reports}/results").read() if stored else read_csv(spark, csv_path(reports))
        html_report_create(infos, str(a.path), a.type, s["threshold"], s["language"], a.first_root_path, a.second_root_path)
        return schema.ExitCode.SUCCESS
    threshold = None if a.ignore_threshold else s["threshold"]
    comparator = WorksComparator(
        spark, a.extension, a.mode, threshold, s["ngrams_length"], s["max_depth"], a.path_regexp, a.repo_regexp, a.all_branches, access_token(s.get("environment")),
        features=feature_store(spark, f"{reports}/features") if reports and stored else None, results=result_store(spark, f"{reports}/results") if reports and stored else None,
        csv_report=csv_path(reports) if reports and not stored else None,
    )
    stop = threading.Event()
    if s["show_progress"]:
        threading.Thread(target=show_progress, args=(spark, s["workers"], stop), daemon=True).start()
    try:
        done = comparator.check(a.files, a.directories, a.github_user, a.github_urls)
    finally:
        stop.set()
    if done is None:
        return schema.ExitCode.SUCCESS
    shown = done.shown(s["short_output"])
    for row in shown.toLocalIterator() if shown is not None else ():
        matrix = compliance_table(row) if display.show_matrix(row["structure"]["similarity"], threshold) else None
        print(display.compare_text(row, matrix))
    return done.exit_code


def main(args: Sequence[str] | None = None) -> int:
    a = parse(args)
    config.set_logging(config.read_settings()["log_level"])
    try:
        return run(a)
    except KeyboardInterrupt:
        config.log.warning(tr("Stopped."))
        return schema.ExitCode.KEYBOARD
    except Exception:
        config.log.error(tr("The run failed."), exc_info=True)
        return schema.ExitCode.UNEXPECTED


if __name__ == "__main__":
    sys.exit(main())
