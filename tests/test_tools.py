"""The event-log summary tool groups stages by the bench's job groups."""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import stage_times  # noqa: E402


def test_stage_times_groups_by_job_group():
    events = [
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [10, 11],
         "Properties": {"spark.jobGroup.id": "overall_churn"}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {
            "Stage ID": 10, "Number of Tasks": 4, "Submission Time": 1000, "Completion Time": 3500,
            "Accumulables": [{"Name": "internal.metrics.shuffle.write.bytesWritten", "Value": 2_000_000}]}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {
            "Stage ID": 11, "Number of Tasks": 1, "Submission Time": 4000, "Completion Time": 4500,
            "Accumulables": [{"Name": "internal.metrics.shuffle.read.localBytesRead", "Value": 2_000_000}]}},
    ]
    path = os.path.join(tempfile.mkdtemp(prefix="churnlens-evlog-"), "events_1_app")
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(e) for e in events) + "\n")
    totals = stage_times.summarise(os.path.dirname(path))
    t = totals["overall_churn"]
    assert (t["jobs"], t["stages"], t["tasks"]) == (1, 2, 5)
    assert t["stage_sec"] == 3.0
    assert t["shuffle_write_mb"] == 2.0 and t["shuffle_read_mb"] == 2.0
