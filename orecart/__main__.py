"""Command line: python -m orecart index | hydrate | grep | map | get | usage | config, for the working copy in the current folder.

The store and the settings are in a folder of the working copy, .orecart unless --store names another.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import SparkSession

from orecart.functions import config as cf
from orecart.operators import embedding, report, usage
from orecart.plans import index as commands
from orecart.sources import store as st
from orecart.streaming import watch


def git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="orecart")
    p.add_argument("--root", default=".")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    sub.add_parser("hydrate")
    grep = sub.add_parser("grep")
    grep.add_argument("query")
    grep.add_argument("-n", "--max-count", type=int, default=commands.MAX_RESULTS)
    sub.add_parser("map").add_argument("query", nargs="?")
    sub.add_parser("get").add_argument("location")
    use = sub.add_parser("usage")
    use.add_argument("-s", "--sessions", type=int, default=commands.MAX_SESSIONS)
    use.add_argument("-w", "--watch", type=int, metavar="SECS")
    use.add_argument("--projects", required=True, help="folder that has a folder of session files for each working copy")
    conf = sub.add_parser("config")
    conf.add_argument("key", nargs="?")
    conf.add_argument("value", nargs="?")
    for flag in ("list", "get", "unset"):
        conf.add_argument(f"--{flag}", action="store_true")
    return p.parse_args(argv)


def index(spark: SparkSession, root: str, kept: st.Store, provider: embedding.Provider) -> list[str]:
    """All tracked files at first; later what changed since the revision of the last version."""
    now, before = git(root, "rev-parse", "HEAD").strip(), kept.bookmark()
    files = st.read_files(spark, root, st.tracked(root))
    if before is None:
        done = commands.index(kept, files, provider, now)
        return [done.summary().first()["line"]]
    lines = git(root, "diff", "--name-status", "-M", before, "HEAD").splitlines()
    changes = st.read_changes(spark.createDataFrame([(x,) for x in lines], "line string"))
    done = commands.index(kept, files, provider, now, changes)
    said = [f"Last indexed: {before[:8]}"]
    return [*said, "Already up to date."] if done.version is None else [*said, done.summary().first()["line"]]


def usage_lines(spark: SparkSession, folder: str, sessions: int) -> list[str]:
    rows, spike = commands.usage_rows(spark, folder, sessions)
    out = [usage.HEADER, "-" * 80, *[r["row"] for r in rows.collect()]]
    return [*out, "", *[r["line"] for r in spike.collect()]]


def run(argv: list[str], spark: SparkSession, out=print) -> int:
    a = arguments(argv)
    root = os.path.abspath(a.root)
    home = os.path.abspath(a.store or os.path.join(root, ".orecart"))
    os.makedirs(home, exist_ok=True)
    settings = cf.Settings(os.path.join(home, "settings.json"))
    if a.command == "config":
        for line in cf.command(settings, a.key, a.value, a.list, a.get, a.unset):
            out(line)
        return 0
    if a.command == "usage":
        folder = watch.project_folder(spark, a.projects, root)
        if folder is None:
            out(f"No sessions found for current project ({root}).")
            return 0
        if a.watch is None:
            for line in usage_lines(spark, folder, a.sessions):
                out(line)
            return 0
        watch.watch(spark, folder, os.path.join(home, f"watch-{os.getpid()}"), lambda _, tick: out("\n".join(usage_lines(spark, folder, a.sessions))), a.watch).awaitTermination()
        return 0
    kept = st.Store(spark, os.path.join(home, "store"))
    provider = embedding.create_provider(cf.load_or_default(settings))
    if a.command == "index":
        for line in index(spark, root, kept, provider):
            out(line)
        return 0
    tables = commands.hydrate(kept)
    if a.command == "hydrate":
        counts = {name: t.count() for name, t in tables.items()}
        out(f"Version {kept.bookmark() or 'none'}: {counts['chunks']} chunks, {counts['subsystems']} subsystems, {counts['edges']} edges.")
        return 0
    if a.command == "grep":
        found = commands.grep(tables["chunks"], a.query, provider.vectors([a.query])[0], a.max_count)
        rows = report.found_rows(found).orderBy("rank").collect()
        missing = "No results found."
    elif a.command == "map":
        rows = commands.map_rows(tables["subsystems"], tables["edges"], provider.vectors([a.query])[0] if a.query else None).collect()
        missing = "The map is empty."
    else:
        rows = report.chunk_rows(commands.get(tables["chunks"], a.location)).collect()
        missing = f"No chunks found overlapping {a.location}."
    for r in rows:
        out(r["line"])
    if not rows:
        out(f"{missing} Run `index` first.")
    return 0 if rows else 1


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(sys.argv[1:], spark))


if __name__ == "__main__":
    main()
