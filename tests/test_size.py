"""What grows with the data: bytes stored on the way, rows that move, texts that are read again."""

import glob
import json
import os
import subprocess
import sys

from pyspark.sql import DataFrameWriter, Row
from pyspark.sql import functions as F

from telelake import session
from telelake.checks import fixtures as X
from telelake.checks import ingest as checks
from telelake.checks import operators
from telelake.functions import otlp
from telelake.operators import schedule
from telelake.plans import running
from telelake.sources import envelope
from telelake.streaming import ingest as stream_load
from telelake.streaming import output as capture
from telelake.streaming.changes import label

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
STAGING = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from telelake.checks import fixtures as X
from telelake.sources import envelope
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", "file://{out}/events").config("spark.eventLog.rolling.enabled", "false")
         .config("spark.eventLog.compress", "false").getOrCreate())
lines = X.deployment_lines(spark, {sf!r}).union(X.status_lines(spark, {sf!r}))
envelope.stage(lines, "{out}/staged")
assert envelope.scan_staged(spark, "{out}/staged").count() == lines.count()
spark.stop()
"""


def stored_bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*", recursive=True))


def test_staged_lines_are_stored_small_and_whole(spark, tmp_path):
    lines = X.span_lines(spark, SF).union(X.status_lines(spark, SF))
    path = str(tmp_path / "staged")
    envelope.stage(lines, path)
    text = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    assert stored_bytes(path) * 4 < text
    found = envelope.scan_staged(spark, path)
    assert found.exceptAll(lines).count() == 0 and lines.exceptAll(found).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_staged_parts_are_not_cut_out_for_each_line(spark, tmp_path):
    lines = X.status_lines(spark, SF).union(X.deployment_lines(spark, SF))
    path = str(tmp_path / "staged")
    envelope.stage(lines.unionByName(lines.limit(3).withColumn("file", F.lit("status.txt"))), path)
    found = envelope.scan_staged(spark, path)
    assert "substring_index" not in plan(found.where("file = 'status.jsonl'"))
    assert found.exceptAll(lines).count() == 0 and lines.exceptAll(found).count() == 0
    # Any other layout is read by the names in its paths, also where it looks much the same.
    for place, name in (("file=a.jsonl/b.jsonl", "b.jsonl"), ("file=a.jsonl/sub/part", None), ("x/file=c.jsonl/part", "c.jsonl"),
                        ("d.jsonl/part", "d.jsonl"), ("file=e e.jsonl/part", None)):
        other = tmp_path / place.replace("/", "_") / "root"
        os.makedirs(os.path.dirname(other / place))
        (other / place).write_text("line\n")
        rows = [r.file for r in envelope.scan_staged(spark, str(other)).collect()]
        cut = envelope._with_file(spark.read.option("recursiveFileLookup", True).text(str(other)))
        assert rows == [r.file for r in cut.collect()]
        assert name is None or rows == [name]
    os.makedirs(tmp_path / "none")
    assert envelope.scan_staged(spark, str(tmp_path / "none")).count() == 0


def test_events_are_not_copied_where_they_are_judged(spark):
    assert "transform(array(" not in plan(envelope.verdicts(X.status_lines(spark, SF), "ContainerStatus"))


def test_single_pairs_read_as_lists_do(spark):
    kind = f"id int, pairs {otlp.KEY_VALUES}"
    none = (None,) * 7
    cases = [("k", ("a\"b", *none[1:])), ("k", (None, None, "7", *none[3:])), ("k", (None, None, "x", *none[3:])), ("k", none), ("k", None),
             (None, (None, True, *none[2:])), ("k", (None, None, None, float("nan"), *none[4:])), None]
    rows = [(i, [c]) for i, c in enumerate(cases)] + [(i, [c, ("z", none)]) for i, c in enumerate(cases)] + [(99, []), (98, None)]
    found: dict = {}
    for r in spark.createDataFrame(rows, kind).select("id", otlp.key_values_json(F.col("pairs")).alias("t")).collect():
        found.setdefault(r.id, []).append(r.t)
    # A pair without a value beside it is left out, but makes the list go through the general way.
    assert all(a == b for a, b in (found[i] for i in range(len(cases))))
    assert [found[i][0] for i in range(len(cases))] == ['{"k":"a\\"b"}', '{"k":7}', "{}", "{}", "{}", '{"":true}', '{"k":null}', "{}"]
    assert found[99] == found[98] == [None]


def test_staging_holds_more_names_than_open_files(spark, tmp_path):
    names = F.concat((F.col("id") % 40).cast("string"), F.lit(".jsonl"))
    lines = spark.range(400).select(F.col("id").cast("string").alias("value"), names.alias("file"))
    envelope.stage(lines, str(tmp_path))
    assert envelope.scan_staged(spark, str(tmp_path)).exceptAll(lines).count() == 0
    assert envelope.scan_staged(spark, str(tmp_path)).count() == 400


def test_staging_does_not_sort(spark, tmp_path, monkeypatch):
    """A task that may keep several files open holds no lines; the setting is back afterwards."""
    setting, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.text

    def watched(self, path, *args, **options):
        seen.append(int(spark.conf.get(setting)))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", watched)
    before = spark.conf.get(setting)
    envelope.stage(X.status_lines(spark, SF), str(tmp_path))
    assert spark.conf.get(setting) == before and seen[0] >= len(envelope.VARIANTS)
    # Sorted lines would be in the order of the names; as they come, parts keep the order of the input.
    mixed = spark.range(0, 100, 1, 1).select(
        F.col("id").cast("string").alias("value"), F.when(F.col("id") % 2 == 0, "b.jsonl").otherwise("a.jsonl").alias("file")
    )
    envelope.stage(mixed, str(tmp_path / "mixed"))
    assert envelope.scan_staged(spark, str(tmp_path / "mixed")).exceptAll(mixed).count() == 0


def test_tasks_that_stage_hold_no_lines(tmp_path):
    """By the event log of a session of its own: tasks that write lines take no memory for sorting them."""
    (tmp_path / "events").mkdir()
    script = STAGING.format(root=ROOT, sf=SF, out=tmp_path)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    (log,) = (tmp_path / "events").iterdir()
    ended = [e["Task Metrics"] for e in map(json.loads, log.open()) if e["Event"] == "SparkListenerTaskEnd"]
    writers = [t for t in ended if t["Output Metrics"]["Records Written"]]
    assert sum(t["Output Metrics"]["Records Written"] for t in writers) == 2000
    assert max(t["Peak Execution Memory"] for t in writers) == 0


def test_a_micro_batch_has_a_bounded_number_of_lines(spark, tmp_path, monkeypatch):
    """Parts are cut, so that the files of a trigger hold so many lines at most, however much is staged."""
    monkeypatch.setattr(envelope, "PART_LINES", 100)
    staged, root, marks = (str(tmp_path / p) for p in ("staged", "lake", "marks"))
    lines = X.deployment_lines(spark, SF).repartition(2)
    envelope.stage(lines, staged)
    query = stream_load.ingest_stream(
        spark, staged, root, marks, names=["deployments"], trigger={"availableNow": True}, maxFilesPerTrigger=3
    )
    assert stream_load.drain(query) == {"deployments": None}
    read = [p.numInputRows for p in query["deployments"].recentProgress]
    # Files of other names are passed over.
    assert sum(read) == lines.where("file = 'deployments.jsonl'").count() and max(read) <= 300


def test_lines_are_not_stored_before_they_are_used(spark):
    before = list(session._scratch) + list(session._kept)
    checks.all_lines(spark, SF).select("file").distinct().collect()
    assert list(session._scratch) + list(session._kept) == before


def test_queries_of_spans_take_nothing_from_each_other(spark):
    """Each derives its spans, so that its figures are its own; read once, they are not stored at all."""
    before = list(session._scratch) + list(session._kept)
    assert operators.span_events_flat(spark, SF).count() > 0
    assert operators.attribute_lookup(spark, SF).count() > 0
    assert list(session._scratch) + list(session._kept) == before
    operators.span_children(spark, SF)
    assert not session._kept


def test_plain_lines_do_not_nest(spark):
    marks = lambda *values: spark.createDataFrame([(v,) for v in values], "value string").where(envelope.may_nest(F.col("value")))
    assert marks('{"a":{"stringValue":"x","intValue":"1"}}').count() == 0
    assert marks('{"arrayValue":{}}', '{"kvlistValue":{}}', '{"\\u0061rrayValue":{}}').count() == 3


def test_an_expression_is_read_once(spark):
    crons = F.element_at(F.array(F.lit("@daily"), F.lit("61 * * * * *"), F.lit(None)), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(300).select(F.col("id").cast("string").alias("service"), crons.alias("cron"))
    assert schedule._expressions(rows, 0).count() == 3
    assert schedule.cron_rejects(rows).count() == 200
    assert schedule.cron_firings(rows, "2024-01-01", "2024-01-03").count() == 200


def test_services_without_polls_are_not_sorted(spark, monkeypatch):
    sorted_rows = []

    def watched(df, *args, **options):
        sorted_rows.append(df.count())
        return running.with_running(df, *args, **options)

    monkeypatch.setattr(schedule, "with_running", watched)
    fired = spark.createDataFrame([(s, t) for s in ("a", "b", None) for t in range(100)], "service string, firing_us bigint")
    polls = spark.createDataFrame([("a", 50), ("c", 1), (None, 99)], "service string, poll_us bigint")
    found = {(r.service, r.poll_us) for r in schedule.cron_runs(fired, polls, segments=3).collect()}
    assert found == {("a", 50), (None, 99)}
    assert sorted_rows == [203]


def test_state_of_repeats_holds_no_long_messages(spark):
    texts = ["", "a", "x" * 31, "x" * 32, "x" * 5000, "x" * 5001, None]
    rows = spark.createDataFrame([(t,) for t in texts], "message string")
    kept = [r[0] for r in rows.select(capture.told(F.col("message"))).collect()]
    assert [len(k) for k in kept if k is not None] == [0, 1, 31, 32, 32, 32]
    assert len({bytes(k) for k in kept if k is not None}) == 6 and kept[-1] is None


def test_labels_need_rows_alone():
    seen = [Row(image="i", ts_us=t, digest=d) for t, d in ((3, "b"), (1, None), (2, "a"), (4, "b"), (None, None))]
    found = [(r.ts_us, r.previous, r.outcome) for r in label(seen, False, None)]
    assert found == [(1, None, "Baseline"), (2, None, "Updated"), (3, "a", "Updated"), (4, "b", "NotUpdated"), (None, "b", "Deleted")]
    assert [r.outcome for r in label(seen[:1], True, "b")] == ["NotUpdated"]


def test_lines_are_parsed_once_for_all_loads(spark):
    for check in (checks.compact, checks.catalog_tables):
        before = set(session._scratch)
        check(spark, SF)
        assert sum("/rows-" in path for path in set(session._scratch) - before) == 1
