"""Summarise a Spark event log per query: stages, tasks, stage time, shuffle bytes.

Usage: python tools/stage_times.py EVENT_LOG_DIR_OR_FILE

Run ``bench.py`` with ``BENCH_EVENT_LOG_DIR`` set first; the bench labels
every job with the query name (job group), which this tool groups by.
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _log_files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    out = []
    for root, _, files in os.walk(path):
        out += [os.path.join(root, f) for f in files if not f.startswith(".")]
    return sorted(out)


def _metric(stage_info: dict, name: str) -> int:
    for acc in stage_info.get("Accumulables", []):
        if acc.get("Name") == name:
            try:
                return int(acc.get("Value", 0))
            except (TypeError, ValueError):
                return 0
    return 0


def _lines(file: str):
    if file.endswith(".zstd") or file.endswith(".zst"):
        import io

        import zstandard
        with open(file, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(file, encoding="utf-8") as fh:
            yield from fh


def summarise(path: str) -> dict[str, dict[str, float]]:
    stage_group: dict[int, str] = {}
    jobs: dict[str, set[int]] = defaultdict(set)
    totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for file in _log_files(path):
        if "appstatus" in os.path.basename(file):
            continue
        for line in _lines(file):
            event = json.loads(line)
            kind = event.get("Event")
            if kind == "SparkListenerJobStart":
                group = (event.get("Properties") or {}).get("spark.jobGroup.id") or "(none)"
                jobs[group].add(event["Job ID"])
                for sid in event.get("Stage IDs", []):
                    stage_group[sid] = group
            elif kind == "SparkListenerStageCompleted":
                info = event["Stage Info"]
                group = stage_group.get(info["Stage ID"], "(none)")
                t = totals[group]
                t["stages"] += 1
                t["tasks"] += info.get("Number of Tasks", 0)
                if info.get("Completion Time") and info.get("Submission Time"):
                    t["stage_sec"] += (info["Completion Time"] - info["Submission Time"]) / 1000.0
                t["shuffle_write_mb"] += _metric(info, "internal.metrics.shuffle.write.bytesWritten") / 1e6
                t["shuffle_read_mb"] += (
                    _metric(info, "internal.metrics.shuffle.read.remoteBytesRead")
                    + _metric(info, "internal.metrics.shuffle.read.localBytesRead")
                ) / 1e6
                t["input_mb"] += _metric(info, "internal.metrics.input.bytesRead") / 1e6
    for group, t in totals.items():
        t["jobs"] = len(jobs.get(group, ()))
    return totals


def main() -> None:
    totals = summarise(sys.argv[1])
    cols = ["jobs", "stages", "tasks", "stage_sec", "input_mb", "shuffle_write_mb", "shuffle_read_mb"]
    print(f"{'query':32s} " + " ".join(f"{c:>16s}" for c in cols))
    for group in sorted(totals, key=lambda g: -totals[g]["stage_sec"]):
        t = totals[group]
        print(f"{group:32s} " + " ".join(f"{t.get(c, 0):16.2f}" for c in cols))


if __name__ == "__main__":
    main()
