"""Online assignment: batch, stream and a plain fold agree."""

import numpy as np
from pyspark.sql import functions as F

from lineup.operators import reports
from lineup.plans import queries_online
from lineup.streaming import assign, live


def plain_fold(rows, threshold):
    galleries, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.group_id, r.ts, r.item_id)):
        gallery = galleries.setdefault(r.group_id, [])
        vec = np.asarray(r.vec, dtype=np.float64)
        sims = [round(float(np.dot(g, vec)), 6) for g in gallery]
        if sims and max(sims) >= threshold:
            out[r.item_id] = ("matched", f"person_{int(np.argmax(sims)) + 1:03d}")
        else:
            gallery.append(vec)
            out[r.item_id] = ("new", f"person_{len(gallery):03d}")
    return out


def test_batch_equals_plain_fold(spark, folder):
    rows = queries_online.detections(spark, folder)
    want = plain_fold(rows.collect(), 0.25)
    got = assign.assign_entities(rows, assign.cosine_matcher(0.25)).collect()
    assert {r.item_id: (r.verdict.split(" ")[0], r.assigned_to) for r in got} == want


def test_stream_equals_batch(spark, folder, tmp_path):
    rows = queries_online.detections(spark, folder)
    cutoff = rows.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0]
    early = F.expr(f"unix_micros(ts) <= {cutoff}")
    source = str(tmp_path / "in")
    rows.filter(early).coalesce(1).write.parquet(source)
    rows.filter(~early).coalesce(1).write.mode("append").parquet(source)
    files = sorted(tmp_path.glob("in/*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == 2
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        assign.assign_stream(stream, assign.cosine_matcher(0.25)).writeStream.outputMode("append")
        .format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.processAllAvailable()
    query.stop()
    columns = ["group_id", "item_id", "gallery_size_before", "answer", "verdict", "assigned_to", "late"]
    got = sorted(map(str, spark.table("decided").select(*columns).collect()))
    want = assign.assign_entities(rows, assign.cosine_matcher(0.25)).select(*columns)
    assert got == sorted(map(str, want.collect()))


def test_late_rows_are_assigned_and_marked(spark, tmp_path):
    schema = "group_id long, item_id long, ts timestamp, vec array<double>"
    source = str(tmp_path / "in")
    for item, ts in ((1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:05")):
        spark.createDataFrame([(1, item, ts, [1.0, 0.0])], "group_id long, item_id long, ts string, vec array<double>").withColumn(
            "ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        assign.assign_stream(stream).writeStream.outputMode("append").format("memory")
        .queryName("late_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = {r.item_id: (r.assigned_to, r.late) for r in spark.table("late_rows").collect()}
    assert got == {1: ("person_001", False), 2: ("person_001", True)}


def test_matcher_outcomes(spark):
    answers = iter([None, 5, 2])
    gallery = assign.Gallery()
    match = lambda vec, reps: next(answers)
    verdicts = [gallery.decide(np.ones(2), match)[2] for _ in range(4)]
    assert verdicts == ["new (gallery_empty)", "new (unparsable)", "new (out_of_range)", "matched"]


def test_summary_counts(spark, folder):
    decided = queries_online.decisions(spark, folder)
    total = reports.decision_summary(decided).first()
    assert total.n_items == total.n_new + total.n_matched == decided.count()


def _arrive(spark, folder, rows, schema):
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_crops_are_taken_once_and_late_ones_counted(spark, tmp_path):
    schema = "video string, frame_idx long, x1 int, y1 int, x2 int, y2 int, det_conf double, ts string"
    crop = lambda frame, time, conf=0.9: ("v", frame, 10, 10, 50, 50, conf, f"2024-01-01 {time}")
    source = str(tmp_path / "in")
    batches = [
        [crop(1, "00:00:00"), crop(1, "00:00:00"), crop(2, "00:00:10", 0.1)],
        [crop(1, "00:00:00"), crop(3, "00:05:00")],
        [crop(4, "00:30:00")],
        [crop(5, "00:40:00")],
        [crop(6, "00:01:00"), crop(7, "00:41:00")],
    ]
    kinds = schema.replace("ts string", "ts timestamp")
    query = None
    for rows in batches:
        _arrive(spark, source, rows, schema)
        if query is None:
            stream = spark.readStream.schema(kinds).parquet(source)
            query = live.intake_stream(stream, 0.5, 4, 640, 480).writeStream.outputMode("append").format("memory").queryName(
                "crops").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
    late = live.late_rows(query)
    query.stop()
    assert sorted(r.frame_idx for r in spark.table("crops").collect()) == [1, 3, 4, 5, 7]
    assert late == 1


def test_live_totals_survive_a_batch_that_runs_again(spark, tmp_path):
    schema = "group_id long, verdict string, ts string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    assert live.read_live_summary(spark, out).count() == 0

    def run():
        stream = spark.readStream.schema("group_id long, verdict string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = live.write_live_summary(stream, out, check, delay="1 minute", once=True)
        query.awaitTermination()
        assert query.exception() is None
        return query

    def totals():
        return {r.group_id: (r.n_items, r.n_new, r.n_matched) for r in live.read_live_summary(spark, out).collect()}

    day = "2024-01-01 "
    _arrive(spark, source, [(1, "new (stranger)", day + "00:00:01"), (1, "matched", day + "00:00:02"), (2, "matched", day + "00:00:50")], schema)
    _arrive(spark, source, [(1, "matched", day + "00:10:00")], schema)
    run()
    first = totals()
    assert first == {1: (2, 1, 1), 2: (1, 0, 1)}
    # The last micro-batch is taken for one that did not end, and runs again.
    commits = sorted((tmp_path / "check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    run()
    assert totals() == first
    _arrive(spark, source, [(1, "matched", day + "00:20:00"), (2, "matched", day + "00:00:30")], schema)
    late = live.late_rows(run())
    _arrive(spark, source, [(3, "matched", day + "00:40:00")], schema)
    run()
    assert totals() == {1: (4, 1, 3), 2: (1, 0, 1)} and late == 1
