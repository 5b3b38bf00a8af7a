"""Job and stage timings of one registered query, from Spark's event log.

    python tools/stage_times.py QUERY [sf_dir] [runs]

Runs the query ``runs`` times (noop sink) with the event log written to a
fresh scratch folder, then prints the jobs and stages of the last run:
start offset, duration and task count. Local development tool; the UI and
its REST interface stay off.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def _events(folder: str):
    import zstandard

    for path in sorted(glob.glob(os.path.join(folder, "**", "*"), recursive=True)):
        name = os.path.basename(path)
        if os.path.isdir(path) or name.startswith(".") or name.startswith("appstatus"):
            continue
        with open(path, "rb") as fh:
            data = fh.read()
        if path.endswith(".zstd"):
            data = zstandard.ZstdDecompressor().stream_reader(data).read()
        for line in data.decode().splitlines():
            yield json.loads(line)


def main() -> None:
    query = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    runs = int(sys.argv[3]) if len(sys.argv) > 3 else 3
    log_dir = tempfile.mkdtemp(prefix="epilens-events-")

    from epilens import build_session
    from epilens.plans.queries import QUERIES

    spark = build_session(
        "local[8]", shuffle_partitions=8, extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
    )
    spark.sparkContext.setLogLevel("ERROR")
    marks = []
    for _ in range(runs):
        t0 = time.time()
        QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append((t0 * 1000, time.time() * 1000))
    spark.stop()

    jobs, stages = {}, {}
    for e in _events(log_dir):
        kind = e["Event"]
        if kind == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, e["Stage IDs"]]
        elif kind == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            stages[info["Stage ID"]] = (info["Submission Time"], info["Completion Time"], info["Number of Tasks"])
    start, end = marks[-1]
    print(f"{query}: last run {end - start:.0f} ms wall, event log in {log_dir}")
    for jid, (s, c, sids) in sorted(jobs.items()):
        if s < start or c is None:
            continue
        print(f"job {jid:4d} +{s - start:6.0f} ms  {c - s:5d} ms")
        for sid in sids:
            if sid in stages:
                ss, cc, n = stages[sid]
                print(f"    stage {sid:4d} +{ss - start:6.0f} ms  {cc - ss:5d} ms  {n} tasks")


if __name__ == "__main__":
    main()
