"""Readers and writers on files."""

import json

import pytest
from pyspark.sql import functions as F

from lineup.operators import models
from lineup.sources import ledger, readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


CASE = {"query": "q.jpg", "gallery": ["a.jpg", "b.jpg"], "label": 2}


def test_cases_in_three_shapes(spark, tmp_path):
    lines = put(tmp_path / "l.jsonl", "\n".join(json.dumps(CASE) for _ in range(2)))
    listed = put(tmp_path / "a.json", json.dumps([CASE, CASE], indent=1))
    whole = put(tmp_path / "e.json", json.dumps({"scenario": "s", "eval_cases": [CASE, CASE]}, indent=1))
    for path, shape in ((lines, "lines"), (listed, "list"), (whole, "envelope")):
        rows = readers.read_cases(spark, path, shape).collect()
        assert [(r.query, r.gallery, r.label, r.answer_letter) for r in rows] == [
            ("q.jpg", ["a.jpg", "b.jpg"], 2, None)] * 2
    with pytest.raises(ValueError, match="unknown case shape"):
        readers.read_cases(spark, lines, "other")


def test_manifest(spark, tmp_path):
    path = put(tmp_path / "m.json", json.dumps({"gallery": ["a", "b"], "queries": {"c": 4}}, indent=2))
    rows = {(r.path, r.role, r.pos) for r in readers.read_manifest(spark, path).collect()}
    assert rows == {("a", "gallery", 0), ("b", "gallery", 1), ("c", "query", 4)}


def test_listing_keeps_jpg_and_reports_the_rest(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.txt"):
        put(tmp_path / name, "x")
    kept, rest = readers.read_item_listing(spark, str(tmp_path))
    assert kept.count() == 2 and rest.count() == 1


def test_videos_sorted_and_limited(spark, tmp_path):
    for name in ("b.mp4", "a.MOV", "c.txt", "d.mkv"):
        put(tmp_path / name, "x")
    rows = [r.path.split("/")[-1] for r in readers.read_video_listing(spark, str(tmp_path)).collect()]
    assert rows == ["a.MOV", "b.mp4", "d.mkv"]
    assert readers.read_video_listing(spark, str(tmp_path), 2).count() == 2


def test_group_index_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 10, 5, "query", "p1"), (1, 10, 5, "gallery", "p2"), (1, 11, 6, "gallery", "p3"), (2, 20, 5, "query", "p4")],
        "group_id long, entity_id long, source_id long, role string, path string",
    )
    folder = str(tmp_path / "index")
    writers.write_group_index(rows, folder, chunk=2)
    back = readers.read_group_index(spark, folder, shape="lines")
    want = rows.select(*[F.col(c).cast("string") for c in rows.columns])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_tuples_of_both_kinds(spark, tmp_path):
    path = put(tmp_path / "t.jsonl", "\n".join([
        json.dumps({"query": {"source": "rstp", "person_id": 3, "img_path": "/old/a.jpg"},
                    "gallery": [{"img_path": "/old/b.jpg"}], "answer": 1}),
        json.dumps({"query": "/old/c.jpg", "gallery": ["/old/d.jpg"], "answer": 1}),
    ]))
    rows = readers.read_tuples(spark, path, rewrite=("/old/", "/new/")).collect()
    assert [(r.query.path, r.gallery[0].path, r.query.entity_id) for r in rows] == [
        ("/new/a.jpg", "/new/b.jpg", "3"), ("/new/c.jpg", "/new/d.jpg", None)]
    assert readers.read_tuples(spark, path, source="rstp").count() == 1


def test_predictions_with_free_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "B", "B", 'He said "B", then\nleft'), (2, "C", None, "")],
        "idx int, label string, prediction string, response string",
    )
    folder = str(tmp_path / "m_result_family_sameclothes_samecamera.csv")
    writers.write_predictions(rows, folder)
    back = readers.read_predictions(spark, folder).orderBy("idx").collect()
    assert back[0].response == 'He said "B", then\nleft' and back[1].prediction is None


def test_prediction_file_name_names_the_scenario(spark, tmp_path):
    path = put(tmp_path / "m_result_family_sameclothes_samecamera.csv", "query_id,label,answer,model_output\n1,B,C,x\n")
    row = readers.read_predictions(spark, path).first()
    assert (row.idx, row.prediction, row.scenario) == (1, "C", "cropped_sameclothes_family_samecamera")


def test_sidecar(spark, tmp_path):
    path = put(tmp_path / "s.json", json.dumps({
        "test_file": "t", "model": "m", "stranger_threshold": 0.5, "n_cases": 1, "accuracy": 100.0,
        "cases": [{"idx": 0, "query": "q", "gallery": ["a"], "similarity": [0.9], "max_sim": 0.9,
                   "argmax_gallery": 1, "label": 1, "prediction": 1, "correct": True}]}, indent=1))
    row = readers.read_sidecar(spark, path).first()
    assert (row.model, row.label, row.prediction, row.correct) == ("m", "1", "1", True)


def test_captions_keep_later_separators(spark, tmp_path):
    path = put(tmp_path / "c.txt", "a/1.jpg: A man: tall\nno separator\n")
    assert [tuple(r) for r in readers.read_captions(spark, path).collect()] == [("a/1.jpg", "A man: tall")]
    listed = put(tmp_path / "c.json", json.dumps([{"img_path": "x", "captions": ["one", "two"]}]))
    assert tuple(readers.read_caption_json(spark, listed).first()) == ("x", "one")


def test_event_mapping_last_row_wins(spark, tmp_path):
    path = put(tmp_path / "m.csv", "EVENT_ID,FILE_PATH\n e1 ,/x/a.mp4\ne2,/x/b.mp4\ne1,/y/c.mp4 \n")
    rows = {tuple(r) for r in readers.read_event_mapping(spark, path).collect()}
    assert rows == {("e1", "c.mp4"), ("e2", "b.mp4")}


def test_file_lists_skip_other_tables(spark, tmp_path):
    one = put(tmp_path / "a.csv", "EVENT_ID,FILE_PATH\ne,f1\n")
    two = put(tmp_path / "b.csv", "OTHER\nx\n")
    three = put(tmp_path / "c.csv", "FILE_PATH\nf2\n")
    assert {r.FILE_PATH for r in readers.read_file_lists(spark, [one, two, three]).collect()} == {"f1", "f2"}


def test_detections(spark, tmp_path):
    line = {"crop_id": 1, "crop_path": "c", "video": "v", "frame_idx": 25, "timestamp_s": 1.0,
            "bbox": [1, 2, 3, 4], "det_conf": 0.9, "detector": "d"}
    path = put(tmp_path / "d.jsonl", json.dumps(line))
    assert readers.read_detections(spark, path).first().asDict() == line


def test_missing_state_reads_as_empty(spark, tmp_path):
    assert writers.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_resumable_write_appends_only_the_rest(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(10).select(F.col("id").alias("group_id"))
    writers.resumable_write(rows.filter("group_id < 4"), "group_id", folder, 3)
    got = writers.resumable_write(rows, "group_id", folder, 3)
    assert sorted(r.group_id for r in got.collect()) == list(range(10))
    assert ledger.read_steps(spark, folder, "group_id long").count() == 10
    assert writers.resumable_write(rows, "group_id", folder, 3).count() == 10


def test_an_interrupted_run_does_only_the_rest(spark, tmp_path):
    """The third bucket fails while it is written; the next run computes it and those after it."""
    folder, calls = str(tmp_path / "out"), []
    rows = spark.range(200).select(F.expr("case when id = 7 then null else id % 40 end").alias("group_id"), "id")

    def step(fail_at):
        def run(part):
            calls.append({r.group_id for r in part.select("group_id").distinct().collect()})
            if len(calls) == fail_at:
                return part.withColumn("x", F.raise_error(F.lit("interrupted")).cast("long"))
            return part.withColumn("x", F.col("id") * 2)
        return run

    with pytest.raises(Exception, match="interrupted"):
        ledger.run_steps(rows, "group_id", step(3), folder, 6)
    assert len(ledger.finished(spark, folder)) == 2
    before = ledger.read_steps(spark, folder, "group_id long, id long, x long")
    assert {r.group_id for r in before.collect()} == calls[0] | calls[1]
    done = calls[0] | calls[1]
    calls.clear()
    got = ledger.run_steps(rows, "group_id", step(99), folder, 6)
    assert not done & set.union(*calls) and len(ledger.finished(spark, folder)) == 6
    assert sorted((r.id, r.x) for r in got.collect()) == [(i, 2 * i) for i in range(200)]
    calls.clear()
    assert ledger.run_steps(rows, "group_id", step(99), folder, 6).count() == 200 and len(calls) == 1  # for the schema
    again = spark.createDataFrame([(3,)], "group_id long")
    twice = ledger.run_steps(rows, "group_id", step(99), folder, 6, again=again)
    assert twice.count() == 205 and twice.filter("group_id = 3").count() == 10


def test_cleaning_resumes_and_asks_failed_batches_again(spark, tmp_path):
    rows = [(i, f"p{i}", "query" if i % 5 == 0 else "gallery", i % 4) for i in range(80)]
    items = spark.createDataFrame(rows, "item_id long, path string, role string, group_id long")
    log = tmp_path / "asked"
    log.write_text("")

    def verdict(paths, down):
        with open(log, "a") as f:
            f.write(" ".join(paths) + "\n")
        if down and "p33" in paths:
            raise ConnectionError("down")
        return "\n".join("NO" if int(p[1:]) % 3 == 0 else "YES" for p in paths)

    folder = str(tmp_path / "clean")
    first = models.clean_items(items, lambda p: verdict(p, True), folder, buckets=3, attempts=2)
    failed = models.failed_items(first).collect()
    assert 33 in {r.item_id for r in failed} and 1 < len(failed) <= 8
    assert {(r.failure, r.attempts, r.keep) for r in failed} == {("ConnectionError", 2, True)}
    log.write_text("")
    same = models.clean_items(items, lambda p: verdict(p, True), folder, buckets=3)
    assert log.read_text() == "" and same.count() == 80
    last = models.clean_items(items, lambda p: verdict(p, False), folder, retry=True, buckets=3)
    got = {r.item_id: r for r in last.collect()}
    assert set(log.read_text().split()) == {f"p{r.item_id}" for r in failed} and len(log.read_text().splitlines()) == 1
    assert len(got) == 80 and all(r.failure is None for r in got.values())
    assert {i for i, r in got.items() if not r.keep} == {i for i in range(80) if i % 3 == 0 and i % 5}


def test_predictions_of_all_headers_in_one_folder(spark, tmp_path):
    put(tmp_path / "m_result_family_sameclothes_samecamera.csv", 'idx,label,prediction,response,query\n1,B,B,"He said ""B"",\nthen left, and",q1\n2,C,,x,q2\n')
    put(tmp_path / "m_result_family_sameclothes_crosscamera.csv", "query_id,label,answer,model_output\n1,B,C,y\n")
    put(tmp_path / "n_result_singleton_crossclothes_samecamera.csv", '\ufeffidx,label,prediction,model_output,query_img\r\n7,A,A,"a, b",q7\r\n')
    put(tmp_path / "o.csv", "query_id,label,answer,model_output\n9,D,D,z\n")
    rows = {(r.file[0], r.idx, r.scenario): r for r in readers.read_predictions(spark, str(tmp_path)).collect()}
    assert len(rows) == 5
    assert rows["m", 1, "cropped_sameclothes_family_samecamera"].response == 'He said "B",\nthen left, and'
    assert rows["m", 1, "cropped_sameclothes_family_crosscamera"].prediction == "C"
    last = rows["n", 7, "cropped_crossclothes_singleton_samecamera"]
    assert (last.response, last.query, last.header) == ("a, b", "q7", "idx,label,prediction,model_output,query_img")
    assert rows["o", 9, None].label == "D"
    put(tmp_path / "p.csv", "idx,label\n1,2\n")
    with pytest.raises(ValueError, match="prediction.*p.csv"):
        readers.read_predictions(spark, str(tmp_path))


def test_colliding_result_names(spark, tmp_path):
    head = "idx,label,prediction\n"
    names = ["m_result_family_sameclothes_samecamera.csv", "predictions_m_cropped_sameclothes_family_samecamera.csv",
             "k_result_family_sameclothes_samecamera.csv", "k_result_other.csv", "plain.csv"]
    for i, name in enumerate(names):
        put(tmp_path / name, head + f"{i},A,A\n")
    files = spark.createDataFrame([("d", n) for n in names] + [("d", "notes.txt"), ("e", names[0])], "folder string, file string")
    got = {(r.folder, r.file): (r.target, r.status, r.rival) for r in readers.normalize_results(files).collect()}
    assert got == {
        ("d", names[0]): (names[1], "taken", names[1]), ("e", names[0]): (names[1], "renamed", None),
        ("d", names[1]): (None, "no result in its name", None),
        ("d", names[2]): ("predictions_k_cropped_sameclothes_family_samecamera.csv", "renamed", None),
        ("d", names[3]): (None, "unexpected suffix", None), ("d", names[4]): (None, "no result in its name", None)}
    prefixed = {r.file: (r.target, r.status, r.rival) for r in readers.normalize_results(
        spark.createDataFrame([("d", n) for n in ("a.csv", "predictions_a.csv", "b.csv")], "folder string, file string"), "prefix").collect()}
    assert prefixed == {"a.csv": ("predictions_a.csv", "taken", "predictions_a.csv"), "predictions_a.csv": (None, "has the prefix", None),
                        "b.csv": ("predictions_b.csv", "renamed", None)}
    rows, rejects = readers.read_results(spark, str(tmp_path))
    assert sorted(r.idx for r in rows.collect()) == [1, 2, 3, 4] and [r.file for r in rejects.collect()] == [names[0]]


def test_file_lists_read_quoted_fields(spark, tmp_path):
    put(tmp_path / "a.csv", 'ID,FILE_PATH\n"1,2","/x/a, b.mp4"\n3,"/x/c\n.mp4"\n')
    put(tmp_path / "b.csv", "FILE_PATH\n/y/d.mp4\n")
    put(tmp_path / "c.csv", "OTHER\nz\n")
    got = readers.read_file_lists(spark, str(tmp_path))
    assert sorted(r.FILE_PATH for r in got.collect()) == ["/x/a, b.mp4", "/x/c\n.mp4", "/y/d.mp4"]
    put(tmp_path / "d.csv", "FILE_PATH,ID\n/y/e.mp4\n")
    with pytest.raises(Exception):
        readers.read_file_lists(spark, str(tmp_path)).collect()


def test_embed_incremental_encodes_only_misses(spark, tmp_path):
    folder = str(tmp_path / "store")
    encode = lambda paths: [[len(p), 1.0] for p in paths]
    first = spark.createDataFrame([("a",), ("bb",)], "path string")
    assert models.embed_incremental(first, encode, "m", folder).count() == 2
    more = spark.createDataFrame([("bb",), ("ccc",)], "path string")
    assert models.cache_misses(more, spark.read.parquet(folder), "m").count() == 1
    assert models.embed_incremental(more, encode, "m", folder).count() == 3


def test_benchmark_and_split_files(spark, tmp_path):
    cases = spark.createDataFrame([("s1", "c1"), ("s2", "c2")], "scenario string, case_id string")
    writers.write_benchmark(cases, cases.groupBy("scenario").count(), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/cases")).filter("scenario = 's1'").count() == 1
    split = spark.createDataFrame([(1, "test"), (2, "train")], "group_id long, split string")
    writers.write_split_manifest(split, str(tmp_path / "split"), seed=7)
    assert spark.read.parquet(str(tmp_path / "split/groups")).filter("split = 'test'").count() == 1
    assert spark.read.json(str(tmp_path / "split/summary")).first().asDict() == {"seed": 7, "n_test": 1, "n_train": 1}


def test_indented_index_is_read_whole(spark, tmp_path):
    index = {"g1": {"g1_a": {"cam1": {"query": ["q1"], "gallery": ["x", "y"]}}}, "g2": {"g2_b": {"cam1": {"query": ["q2"], "gallery": []}}}}
    path = put(tmp_path / "i.json", json.dumps(index, indent=4))
    assert sorted(r.path for r in readers.read_group_index(spark, path).collect()) == ["q1", "q2", "x", "y"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_group_index(spark, put(tmp_path / "bad.json", '{"g1": [')).collect()


def test_flat_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("g", "g_1", "c1", "query", "p1"), ("g", "g_1", "c1", "gallery", "p1"), ("g", "g_1", "c2", "gallery", "p2"),
         ("h", "h_1", "c1", "gallery", "p3")],
        "group_id string, entity_id string, source_id string, role string, path string")
    folder = str(tmp_path / "flat")
    writers.write_group_index(rows, folder, chunk=1, flat=True)
    back = readers.read_group_index(spark, folder, flat=True, shape="lines")
    once = rows.drop("role").distinct()
    want = [(*r, role) for r in once.collect() for role in ("query", "gallery")]
    got = [(r.group_id, r.entity_id, r.source_id, r.path, r.role) for r in back.collect()]
    assert sorted(got) == sorted(want)


def test_results_are_appended_once(spark, tmp_path):
    folder = str(tmp_path / "results")
    rows = spark.createDataFrame([("m", "s1", 0.5), ("m", "s2", 0.6)], "model string, scenario string, accuracy double")
    writers.append_results(rows.limit(1), folder)
    writers.append_results(rows, folder)
    writers.append_results(rows, folder)
    assert spark.read.parquet(folder).count() == 2
    with pytest.raises(ValueError):
        writers.append_results(rows.drop("model"), folder)


def test_plain_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    writers.write_jsonl(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    writers.write_sidecar(rows.limit(1), rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/run")).count() == 1
    assert spark.read.parquet(str(tmp_path / "s/cases")).count() == 2
