"""Stage durations from a Spark event log folder (see ``BENCH_EVENT_LOG``).

    python stage_times.py /tmp/sitelens-events-XXXX
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return raw.decode("utf-8").splitlines()


def main() -> None:
    root = sys.argv[1]
    files = [p for p in glob.glob(os.path.join(root, "**"), recursive=True)
             if os.path.isfile(p) and os.path.basename(p).startswith("events_")]
    for f in sorted(files):
        for line in _lines(f):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                sec = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                print(f"stage {si['Stage ID']:4d}  {sec:7.2f}s  tasks {si['Number of Tasks']:5d}  {si['Stage Name'][:60]}")


if __name__ == "__main__":
    main()
