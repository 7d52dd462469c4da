import json

from trailbase import runlog
from trailbase.operators import analytics


def test_events_are_lines(spark, tmp_path, capsys):
    file = tmp_path / "run" / "log"
    runlog.setup("INFO", "json", str(file))
    runlog.event("walk.round", round=1, tokens=12, elapsed=0.5)
    runlog.event("walk.debug", 10, round=2)
    runlog.event("task.done", reason="two words", tokens=30)
    line = json.loads(capsys.readouterr().err.splitlines()[0])
    assert (line["event"], line["tokens"], line["level"]) == ("walk.round", 12, "INFO")
    kept = file.read_text().splitlines()
    assert len(kept) == 2 and kept[1].endswith('INFO task.done reason="two words" tokens=30')
    fields = analytics.log_fields(spark.read.text(f"file://{file}")).collect()
    assert [(r.event, r.tokens, r.elapsed) for r in fields] == [("walk.round", 12, 0.5), ("task.done", 30, None)]
    runlog.setup("OFF")
    runlog.event("walk.round", round=3)
    assert capsys.readouterr().err == "" and len(file.read_text().splitlines()) == 2


def test_report_of_nothing(spark):
    rounds = spark.createDataFrame([], "round long, popped long, found long, kept long, added long, tokens long, seconds double")
    row = analytics.report(rounds, spark.createDataFrame([], "drop_reason string"), spark.createDataFrame([], "outcome string, classification string")).first()
    assert analytics.report_lines(row.asDict(), "STOPPED", "") == "walk ended: STOPPED (none)\n  pages:      0 in 0 rounds\n  links:      0 found, 0 kept, 0 queued\n  duration:   0.0s"
