"""Slowest stages from a Spark event log folder (zstd or plain).

    python scripts/stage_times.py /tmp/run-XXXX [top]
"""
import glob
import io
import json
import sys

import zstandard


def lines(path):
    if path.endswith(".zstd"):
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        yield from open(path, encoding="utf-8")


def main():
    root, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    for f in sorted(glob.glob(f"{root}/**/events_*", recursive=True)):
        for line in lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                det = [x.strip() for x in si.get("Details", "").split("\n") if "corpusforge" in x]
                stages.append((dur, si["Stage ID"], si["Number of Tasks"], si["Stage Name"][:50], det[:2]))
    print("stages", len(stages), "sum_sec", round(sum(s[0] for s in stages), 1))
    for s in sorted(stages, reverse=True)[:top]:
        print(round(s[0], 2), s[1], s[2], s[3], [x[:110] for x in s[4]])


if __name__ == "__main__":
    main()
