"""Per-query stage metrics from a Spark event log written by bench.py.

Usage: BENCH_EVENTLOG=<dir> python bench.py; python tests/eventlog_report.py <dir>
Prints, per job group (= query): stages, tasks, task time, shuffle bytes
written, and bytes spilled to memory/disk.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
from collections import defaultdict


def _open(path: str):
    """Text stream over a plain or zstd-compressed event log."""
    if path.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
        return io.TextIOWrapper(raw, encoding="utf-8")
    return open(path, encoding="utf-8")


def main(folder: str) -> None:
    # plain event logs (local-*/app-*) or Spark 4 rolling logs (eventlog_v2_*/events_*)
    files = [f for f in glob.glob(os.path.join(folder, "*"))
             if os.path.isfile(f) and os.path.basename(f).startswith(("local-", "app-"))]
    files += sorted(glob.glob(os.path.join(folder, "eventlog_v2_*", "events_*")))
    stage_group, job_group = {}, {}
    stats = defaultdict(lambda: defaultdict(int))
    for path in files:
        with _open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    job_group[ev["Job ID"]] = g
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev["Stage ID"])
                    if g is None:
                        continue
                    m = ev.get("Task Metrics") or {}
                    s = stats[g]
                    s["tasks"] += 1
                    s["run_ms"] += m.get("Executor Run Time", 0)
                    s["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    s["mem_spill"] += m.get("Memory Bytes Spilled", 0)
                    s["disk_spill"] += m.get("Disk Bytes Spilled", 0)
                    s["stages"] = len({sid for sid, gg in stage_group.items() if gg == g})
    print("| query | stages | tasks | task time (s) | shuffle written (MB) | spilled (MB) |")
    print("|---|---|---|---|---|---|")
    for g in sorted(stats, key=lambda k: -stats[k]["run_ms"]):
        s = stats[g]
        print(f"| `{g}` | {s['stages']} | {s['tasks']} | {s['run_ms'] / 1000:.1f} | "
              f"{s['shuffle_write'] / 2**20:.1f} | {(s['mem_spill'] + s['disk_spill']) / 2**20:.1f} |")


if __name__ == "__main__":
    main(sys.argv[1])
