"""Schemas of the files read and written."""

MANIFEST = "gallery array<string>, queries map<string,int>"

INDEX_SPLIT = (
    "map<string, map<string, map<string, struct<query: array<string>, gallery: array<string>>>>>"
)
INDEX_FLAT = "map<string, map<string, map<string, array<string>>>>"

CASE = (
    "query string, gallery array<string>, label int, similarity array<double>, "
    "household_id array<string>, identity_id array<string>, query_household_id string, "
    "query_identity_id string, query_status string, stranger_letter_pos int, answer_letter string"
)
_CASE_STRUCT = "struct<" + ", ".join(
    "{0}: {1}".format(*field.split(" ", 1)) for field in CASE.split(", ")
) + ">"

ENVELOPE = (
    "scenario string, n_identities int, n_cases int, "
    "gallery_size_distribution map<string,int>, eval_id_count map<string,string>, "
    f"eval_cases array<{_CASE_STRUCT}>"
)

TUPLE_ITEM = "img_path string, source string, person_id string"

SIDECAR = (
    "test_file string, model string, stranger_threshold double, n_cases int, accuracy double, "
    "cases array<struct<idx: int, query: string, gallery: array<string>, similarity: array<double>, "
    "max_sim: double, argmax_gallery: int, label: string, prediction: string, correct: boolean, "
    "stranger_letter_pos: int, answer_letter: string>>"
)

DETECTION = (
    "crop_id long, crop_path string, video string, frame_idx long, timestamp_s double, "
    "bbox array<int>, det_conf double, detector string"
)
