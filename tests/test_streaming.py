import json

from granary.streaming import run_log, windowed_status


def _drain(stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def test_run_log_drops_repeats_and_counts_windows(spark, tmp_path):
    line = lambda task, minute, status: json.dumps({"run_id": "r", "task_id": task, "at": f"2026-01-01T00:{minute:02d}:00Z", "status": status})
    (tmp_path / "a.json").write_text("\n".join([line("t1", 1, "ok"), "", line("t1", 2, "ok"), line("t2", 3, "error")]))
    (tmp_path / "b.json").write_text("\n".join([line("t3", 15, "ok"), line("t4", 55, "ok")]))
    log = run_log(spark, str(tmp_path), "run_id string, task_id string, at timestamp, status string", ["run_id", "task_id"], "at", "10 minutes")
    _drain(log, "log")
    assert sorted(r.task_id for r in spark.table("log").collect()) == ["t1", "t2", "t3", "t4"]
    _drain(windowed_status(log, "at", "status"), "counts")
    got = {(r.window.start.minute, r.status): r.n for r in spark.table("counts").collect()}
    assert got[0, "ok"] == 1 and got[0, "error"] == 1 and got[10, "ok"] == 1 and (50, "ok") not in got  # the last window is still open
