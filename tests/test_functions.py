"""Parsing, letters, answers and captions on probe rows."""

import pytest
from pyspark.sql import functions as F

from lineup.functions import answers as A
from lineup.functions import names as N
from lineup.functions import prompts as P
from lineup.functions import text as X
from lineup.functions import vectors as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_path_with_underscore_in_account(spark):
    row = one(spark, *N.parse_path(F.lit("/d/same/10_20_7_CAM1_EV9_000042_003.jpg")))
    assert row.asDict() == {
        "entity_id": "10_20_7", "group_id": "10_20", "cluster_id": "7", "source_id": "CAM1",
        "event_id": "EV9", "frame_no": 42, "clothes_id": "003",
    }


@pytest.mark.parametrize("path", ["a.jpg", "x_y.jpg", "", "1_2_3_4.jpg"])
def test_malformed_names_give_null(spark, path):
    row = one(spark, *N.parse_path(F.lit(path)))
    assert row.entity_id is None and row.group_id is None


def test_frame_that_is_no_number(spark):
    assert one(spark, N.frame_of_path(F.lit("a_0_m_e_xx_1.jpg")).alias("f")).f is None


def test_scenario_parts_refuses_other_suffixes(spark):
    good = one(spark, *N.scenario_parts(F.lit("m_result_family_crossclothes_samecamera.csv")))
    assert good.scenario == "cropped_crossclothes_family_samecamera"
    bad = one(spark, *N.scenario_parts(F.lit("m_result_family_crossclothes.csv")))
    assert bad.scenario is None and bad.prefix is None


def test_longest_input_mode_wins(spark):
    run = "20260401_120000_v1_Qwen2.5-VL-3B-Instruct_person_expert_tok_expert_and_image_attn_adapter_lr_1e-05_bs_4_captions_False"
    row = one(spark, *N.run_name_parts(F.lit(f"runs/{run}/ckpts/connector_best_step_40.pt")))
    assert (row.input_mode, row.expert_feature) == ("expert_and_image_attn_adapter", "tok")
    assert (row.prefix, row.checkpoint_tag, row.run) == ("v1_best_step40", "best_step40", run)


def test_letters_round_trip(spark):
    rows = [(n, s, label) for n in range(1, 10) for s in range(n + 1) for label in [-1, *range(1, n + 1)]]
    frame = spark.createDataFrame(rows, "n int, s int, label int").withColumn(
        "letter", A.answer_letter("label", "s")
    )
    bad = frame.filter(A.letter_to_index("letter", "s") != F.col("label"))
    assert bad.count() == 0


PROBES = [
    ("Answer: B.", "B"), ("answer: c.", None), ("Answer: -1", "-1"), ("ANSWER: 3", "3"),
    ("It does NOT MATCH any of them", "-1"), ("the person in gallery image 4", "4"),
    ("I think B", "I"), ("no idea", None), ("7 maybe", "7"), ("Answer: BC", None), ("", None),
    ("Réponse É B", "B"), ("Answer:\n D", "D"), ("Answer: 99999999999", "99999999999"),
]


@pytest.mark.parametrize("text,want", PROBES)
def test_extract_answer(spark, text, want):
    assert one(spark, A.extract_answer(F.lit(text)).alias("a")).a == want


def test_profiles_differ_where_they_should(spark):
    text = F.lit("the person in gallery image 4, I guess")
    row = one(spark, *[A.extract_answer(text, p).alias(p) for p in ("full", "api", "letter", "strict")])
    assert row.asDict() == {"full": "4", "api": "I", "letter": "I", "strict": "4"}


@pytest.mark.parametrize("cell,want", [
    ("3", 3), (" 4 ", 4), ("5.9", 5), ("-2.5", -2), ("", None), ("B", None), ("nan", None),
    ("inf", None), ("99999999999", None), (None, None),
])
def test_parse_int(spark, cell, want):
    assert one(spark, A.parse_int(F.lit(cell).cast("string")).alias("x")).x == want


def test_verdict_lines_keep_by_default(spark):
    row = one(
        spark, A.parse_verdict_lines(F.lit("yes\n\nperhaps\nNO"), 4).alias("some"),
        A.parse_verdict_lines(F.lit(None).cast("string"), 2).alias("none"),
    )
    assert row.some == [True, False, True, True] and row.none == [True, True]


@pytest.mark.parametrize("text,want", [
    ("A man walks.", "[A man] walks."),
    ("The old tall woman sits.", "[The old tall woman] sits."),
    ("that long-haired girl runs", "[that long-haired girl] runs"),
    ("A long-haired girl runs", "[Person]. A long-haired girl runs"),
    ("A man and the dog", "[A man] and the dog"),
    ("A man meets a lady", "[Person]. [A man] meets [a lady]"),
    ("Nobody here", "[Person]. Nobody here"),
    ("A woman man", "[Person]. [[A woman] man]"),
])
def test_tag_caption(spark, text, want):
    assert one(spark, X.tag_caption(F.lit(text)).alias("t")).t == want


@pytest.mark.parametrize("opening, word", [("a", "word "), ("this", "well-known word ")])
def test_tag_caption_of_a_long_line(spark, opening, word):
    text = f"{opening} {word * 20_000}man. {opening} {word * 20_000}end. The man"
    want = f"[{opening} {word * 20_000}man]. {opening} {word * 20_000}end. [The man]"
    assert one(spark, X.tag_caption(F.lit(text)).alias("t")).t == "[Person]. " + want


@pytest.mark.parametrize("text, want", [
    ("this man-eater man", "[this man]-eater man"),
    ("this -tall man", "[Person]. this -tall man"), ("this a--b man", "[Person]. this a--b man"),
    ("this a-b-c man", "[Person]. this a-b-c man"), ("this a-b c-d man", "[this a-b c-d man]"),
    ("the a-b man", "[Person]. the a-b man"), ("a  man", "[Person]. a  man"), ("a big\t man", "[a big\t man]"),
])
def test_tag_caption_words_between(spark, text, want):
    assert one(spark, X.tag_caption(F.lit(text)).alias("t")).t == want


def test_retag_caption(spark):
    row = one(
        spark, X.retag_caption(F.lit("[A] and [b c]"), F.lit("Pet"), F.lit(2)).alias("two"),
        X.retag_caption(F.lit("nothing"), F.lit("Pet"), F.lit(2)).alias("none"),
    )
    assert (row.two, row.none) == ("[Pet 2] and [Pet 2]", "[Pet 2]")


def test_box_that_leaves_the_frame_is_dropped(spark):
    box = V.pad_clip_box(F.lit(700), F.lit(0), F.lit(720), F.lit(10), 2, 640, 480)
    assert one(spark, box.alias("b")).b is None


def test_unknown_message_kind_fails(spark):
    table = {"person": {"default": "x"}}
    with pytest.raises(Exception, match="unknown message kind"):
        one(spark, P.system_message(F.lit("boat"), F.lit("default"), table).alias("m"))
    assert one(spark, P.system_message(F.lit("person"), F.lit("odd"), table).alias("m")).m == "x"
