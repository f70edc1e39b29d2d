"""Command line: run | verify | bench | gen | channels. Exit 2 for wrong arguments, 1 for failures."""

from __future__ import annotations

import argparse
import random
import statistics
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tallyloom.operators import profile, verify
from tallyloom.operators.aggregate import channel_month_stats, lines
from tallyloom.session import session
from tallyloom.sources.readers import read_lines, read_messages
from tallyloom.sources.schema import BENCH_LOG
from tallyloom.sources.sinks import append_log, write_single_text

_HEADER = "unix_timestamp,channel_path,message_length,stamp_count\n"


def run(spark, source: str, target: str, strict: bool = False) -> None:
    """Statistics of a message CSV as one text file."""
    messages = read_messages(spark, source, strict)
    write_single_text(lines(channel_month_stats(profile.require_valid(messages) if strict else messages)), target)


def generate(path: str, rows: int, channels: int = 10_000, seed: int = 1) -> None:
    """A message CSV whose channels have Zipf-like frequencies, in the contract's year."""
    rng = random.Random(seed)
    names = [f"team{i % 97}/c{i}" if i % 3 else f"c{i}" for i in range(channels)]
    weights = [1 / (i + 1) for i in range(channels)]
    with open(path, "w", newline="\n") as f:
        f.write(_HEADER)
        for at in range(0, rows, 100_000):
            picked = rng.choices(names, weights, k=min(100_000, rows - at))
            f.writelines(f"{rng.randrange(1798761600, 1830297600)},{c},{int(rng.lognormvariate(4.3, 0.8)) + 1},{int(rng.expovariate(0.5))}\n" for c in picked)


def bench(spark, source: str, target: str, log: str | None, label: str, runs: int = 3) -> float:
    """Median seconds of some runs; a record is appended to the log folder, if there is one."""
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        run(spark, source, target)
        times.append(time.perf_counter() - began)
    median = statistics.median(times)
    if log:
        size = spark.read.format("binaryFile").load(source).agg(F.sum("length")).first()[0]
        append_log(spark.createDataFrame([(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), label, times, median, size, None)], BENCH_LOG), log)
    return median


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--strict", action="store_true")
    p = sub.add_parser("verify")
    p.add_argument("expected")
    p.add_argument("actual")
    p = sub.add_parser("bench")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--log")
    p.add_argument("--label", default="run")
    p = sub.add_parser("gen")
    p.add_argument("target")
    p.add_argument("rows", type=int)
    p = sub.add_parser("channels")
    p.add_argument("source")
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.command == "gen":
            generate(a.target, a.rows)
            return 0
        spark = session("tallyloom-cli")
        if a.command == "run":
            run(spark, a.source, a.target, a.strict)
        elif a.command == "bench":
            print(f"{bench(spark, a.source, a.target, a.log, a.label):.3f}")
        elif a.command == "channels":
            messages = read_messages(spark, a.source)
            profile.distinct_channels(messages).show()
            profile.topk_coverage(messages).orderBy("top").show()
            profile.name_length_hist(messages).orderBy("name_length").show(200)
        else:
            shown = verify.first_diffs(read_lines(spark, a.expected), read_lines(spark, a.actual)).collect()
            for r in shown:
                print(f"{r.side}: {r.value} x{r.n}")
            return int(bool(shown))
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
