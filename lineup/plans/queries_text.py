"""Captions and prompts."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import names as N
from ..functions import prompts as P
from ..functions import text as X
from ..operators import cases as K
from ..operators import scoring as S
from . import views
from .oracle import TABLES
from .queries_cases import suite
from .queries_neighbors import pool
from .registry import register

SYSTEM = "Find the option that shows the query."
# The caller's table of system texts.
MESSAGES = {
    "person": {"default": "Match the person.", "caption": "Match and describe the person."},
    "product": {"default": "Match the product."},
}

TABLES["v_captions"] = """
SELECT doc_id, lang, unnest(range(0, len(t))) AS line_no, unnest(t) AS caption
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS t FROM documents)"""


def _tagged_sql() -> str:
    """One replacement per (opening word, noun), nested in order."""
    word = r"[\p{L}\p{N}_]+"
    out = "caption"
    for openers, adjective in ((X.ARTICLES, word), (X.DEMONSTRATIVES, rf"{word}(?:-{word})?")):
        for opener in openers:
            for noun in X.NOUNS:
                out = (
                    rf"regexp_replace({out}, '\b{opener} ((?:{adjective}\s+)*?){noun}\b', "
                    rf"'[{opener} \1{noun}]', 'g')"
                )
    return out


@register("tag_captions", f"""
SELECT doc_id, line_no, CASE WHEN length(t) - length(replace(t, '[', '')) = 1 THEN t ELSE concat('[Person]. ', t) END AS tagged
FROM (SELECT doc_id, line_no, {_tagged_sql()} AS t FROM (
  SELECT doc_id, line_no, concat(caption, CASE WHEN doc_id % 3 = 0 THEN ' A tall man waits.' WHEN doc_id % 3 = 1 THEN ' The boy and this long-haired woman.' ELSE '' END) AS caption FROM v_captions))""")
def tag_captions(spark, folder):
    """Every document line, most with a phrase added, with person phrases bracketed."""
    added = (
        F.when(F.col("doc_id") % 3 == 0, " A tall man waits.")
        .when(F.col("doc_id") % 3 == 1, " The boy and this long-haired woman.").otherwise("")
    )
    return views.captions(spark, folder).select(
        "doc_id", "line_no", X.tag_caption(F.concat("caption", added)).alias("tagged")
    )


@register("retag_captions", r"""
SELECT doc_id, line_no, CASE WHEN regexp_matches(caption, '\[[^\[\]]*?\]') THEN regexp_replace(caption, '\[[^\[\]]*?\]', concat('[Pet ', n, ']'), 'g')
                             ELSE concat('[Pet ', n, ']') END AS retagged, n::INT AS number
FROM (SELECT doc_id, line_no, doc_id % 9 + 1 AS n, CASE WHEN line_no % 2 = 0 THEN concat('[A dog] ', caption, ' [it]') ELSE caption END AS caption FROM v_captions)""")
def retag_captions(spark, folder):
    caption = F.when(
        F.col("line_no") % 2 == 0, F.concat(F.lit("[A dog] "), "caption", F.lit(" [it]"))
    ).otherwise(F.col("caption"))
    rows = views.captions(spark, folder).withColumn("caption", caption).withColumn(
        "n", F.col("doc_id") % 9 + 1
    )
    retagged = X.retag_caption("caption", F.lit("Pet"), "n")
    return rows.select("doc_id", "line_no", retagged.alias("retagged")).withColumn(
        "number", A.extract_answer_caption("retagged")
    )


@register("answer_tails", r"""
SELECT doc_id, line_no, string_split(string_split(r, 'in gallery image ')[-1], '.')[1] AS tail
FROM (SELECT doc_id, line_no, concat(caption, CASE WHEN line_no % 3 = 0 THEN '' ELSE concat(' It is in gallery image ', doc_id % 5, '. ', lang) END) AS r FROM v_captions)""")
def answer_tails(spark, folder):
    sentence = F.when(F.col("line_no") % 3 == 0, "").otherwise(F.concat(
        F.lit(" It is in gallery image "), (F.col("doc_id") % 5).cast("string"), F.lit(". "), F.col("lang")
    ))
    return views.captions(spark, folder).select(
        "doc_id", "line_no",
        A.extract_answer_tail(F.concat("caption", sentence)).alias("tail"),
    )


@register("sanitized_text", "SELECT conv_id, turn, replace(replace(text, ',', ';'), chr(10), ' ') AS clean FROM conversations")
def sanitized_text(spark, folder):
    return views.table(spark, folder, "conversations").select(
        "conv_id", "turn", A.sanitize_text("text").alias("clean")
    )


@register("product_names", """
SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(dir, '_', ' '), ' ')], ' ') AS product,
       concat('[other] is a ', array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(dir, '_', ' '), ' ')], ' ')) AS filled
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE lower(p_type) END AS dir FROM part)""")
def product_names(spark, folder):
    final = F.concat(F.lit("/sop/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_final/1_0.JPG"))
    plain = F.concat(F.lit("/sop/"), F.lower("p_type"), F.lit("/1_0.JPG"))
    path = F.when(F.col("p_size") % 2 == 0, final).otherwise(plain)
    rows = views.table(spark, folder, "part").select(
        "p_partkey", path.alias("path"), F.lit("[other] is a [Product 12]").alias("filled")
    )
    return S.fill_products(rows, ["filled"], "path").select(
        "p_partkey", X.product_name("path").alias("product"), "filled"
    )


@register("verdict_lines", r"""
SELECT conv_id, turn, list_transform((list_concat(list_filter([upper(trim(x)) for x in string_split(r, chr(10))], lambda x: x IN ('YES', 'NO')), ['YES', 'YES', 'YES', 'YES']))[1:4], lambda x: x = 'YES')::VARCHAR AS keep
FROM (SELECT conv_id, turn, concat(CASE conv_id % 3 WHEN 0 THEN 'no' WHEN 1 THEN ' Yes ' ELSE 'maybe' END, chr(10), text, chr(10), 'NO', chr(10), role) AS r FROM conversations)""")
def verdict_lines(spark, folder):
    first = F.when(F.col("conv_id") % 3 == 0, "no").when(F.col("conv_id") % 3 == 1, " Yes ").otherwise("maybe")
    reply = F.concat_ws("\n", first, "text", F.lit("NO"), "role")
    return views.table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("["), F.array_join(F.transform(
            A.parse_verdict_lines(reply, 4), lambda x: x.cast("string")), ", "), F.lit("]")).alias("keep"),
    )


@register("caption_lookup", """
SELECT item_id, concat(array_to_string(string_split(path, '/')[-2:], '/'), '#', coalesce(c.line_no, -1)) AS caption_key, coalesce(c.caption, 'none') AS caption
FROM v_paths LEFT JOIN v_captions c ON c.doc_id = item_id""")
def caption_lookup(spark, folder):
    """Every line of a document captions the item of the same number, by line."""
    lines = views.captions(spark, folder).select(F.col("doc_id").alias("item_id"), "line_no", "caption")
    wanted = views.paths(spark, folder).join(lines, "item_id", "left")
    key = F.concat_ws("#", N.path_suffix_key("path", 2), F.coalesce("line_no", F.lit(-1)).cast("string"))
    captions = wanted.where("line_no is not null").select(key.alias("caption_key"), "caption")
    found = S.attach_captions(wanted.drop("caption"), captions, key)
    return found.select("item_id", "caption_key", F.coalesce("caption", F.lit("none")).alias("caption"))


@register("filter_captioned", "SELECT item_id FROM v_paths WHERE item_id IN (SELECT doc_id FROM documents)")
def filter_captioned(spark, folder):
    paths = views.paths(spark, folder)
    docs = views.table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"))
    captions = paths.join(docs, "item_id").select(N.path_suffix_key("path", 2).alias("caption_key"))
    return S.filter_captioned(paths, captions, N.path_suffix_key("path", 2)).select("item_id")


def _rows(spark, folder):
    """Lettered cases with item ids as image references."""
    slots = suite(spark, folder).select(*K.CASE, "pos", "label", "n_gallery", "item_id")
    rows = K.letter_cases(K.case_rows(slots))
    return rows.select(
        "case_id", "label", "stranger_slot", "answer_letter",
        F.concat(F.lit("img"), F.col("query_id").cast("string")).alias("query"),
        F.transform("gallery", lambda g: F.concat(F.lit("img"), g["item_id"].cast("string"))).alias("gallery"),
    )


def _flat(messages):
    """Role, text and image of every part, in order, as one string."""
    return F.array_join(F.flatten(F.transform(messages, lambda m: F.transform(
        m["content"], lambda p: F.concat_ws("=", m["role"], F.coalesce(p["text"], F.concat(F.lit("<"), p["image"], F.lit(">")))),
    ))), "\n")


TABLES["v_options"] = """
SELECT s.case_id, CASE WHEN pos - 1 < stranger_slot THEN pos - 1 ELSE pos END AS o, s.item_id FROM v_suite s JOIN v_lettered l USING (case_id)
UNION ALL SELECT case_id, stranger_slot, NULL FROM v_lettered"""
TABLES["v_option_text"] = """
SELECT case_id, string_agg(CASE WHEN item_id IS NULL THEN concat('user=', chr((65 + o)::INT), ': (stranger / not in the gallery)')
       ELSE concat('user=', chr((65 + o)::INT), ': ', chr(10), 'user=<img', item_id, '>') END, chr(10) ORDER BY o) AS options
FROM v_options GROUP BY 1"""
_HEAD = f"'system={SYSTEM}', chr(10), 'user=Query: ', chr(10), 'user=<img', query_id, '>', chr(10)"


@register("prompt_messages", f"""
SELECT case_id, concat({_HEAD}, options, chr(10), 'assistant=Answer: ', answer_letter, '.') AS prompt, n_gallery + 1 AS n_images
FROM v_lettered JOIN v_option_text USING (case_id)""")
def prompt_messages(spark, folder):
    prompt = P.build_prompt(F.lit(SYSTEM), "query", "gallery", "stranger_slot", "answer_letter")
    rows = _rows(spark, folder).withColumn("m", prompt)
    return rows.select("case_id", _flat("m").alias("prompt"), F.size(P.message_images("m")).alias("n_images"))


@register("prompt_legacy", f"""
SELECT case_id, concat({_HEAD}, g, chr(10), 'assistant=', CASE WHEN label = -1 THEN 'The person in the query image does not match any person in the gallery. Answer: -1.'
       ELSE concat('The person in the query image matches the person in gallery image ', label, '. Answer: ', label) END) AS prompt
FROM v_heads JOIN (SELECT case_id, string_agg(concat('user=Gallery ', pos, ':', chr(10), 'user=<img', item_id, '>'), chr(10) ORDER BY pos) AS g FROM v_suite GROUP BY 1) USING (case_id)""")
def prompt_legacy(spark, folder):
    prompt = P.build_prompt_legacy(F.lit(SYSTEM), "query", "gallery", "label")
    return _rows(spark, folder).select("case_id", _flat(prompt).alias("prompt"))


TABLES["v_ranking"] = """
SELECT case_id, concat('Expert similarity scores (cosine, higher = more similar to query):', chr(10),
       string_agg(concat('  ', chr((65 + CASE WHEN pos - 1 < stranger_slot THEN pos - 1 ELSE pos END)::INT), ': ', CASE WHEN sim < 0 THEN '-' ELSE '' END, printf('%.4f', abs(round(sim::DECIMAL(18, 6), 4)::DOUBLE)),
                         '  ← rank ', r, CASE WHEN r = 1 THEN ', highest similarity' ELSE '' END), chr(10) ORDER BY r)) AS ranking
FROM (SELECT s.case_id, s.pos, v.sim, l.stranger_slot, row_number() OVER (PARTITION BY s.case_id ORDER BY v.sim DESC, s.pos) AS r
      FROM v_suite s JOIN v_lettered l USING (case_id) JOIN v_items g ON g.item_id = s.item_id JOIN v_items q ON q.item_id = s.query_id
      JOIN v_sims v ON v.a = q.vec_id AND v.b = g.vec_id) GROUP BY 1"""


def _scored_rows(spark, folder):
    slots = K.score(suite(spark, folder), pool(spark, folder).vectors, 6)
    rows = K.letter_cases(K.case_rows(slots.select(*K.CASE, "pos", "label", "n_gallery", "item_id", "sim")))
    return rows.select(
        "case_id", "stranger_slot",
        F.concat(F.lit("img"), F.col("query_id").cast("string")).alias("query"),
        F.transform("gallery", lambda g: F.concat(F.lit("img"), g["item_id"].cast("string"))).alias("gallery"),
        F.transform("gallery", lambda g: g["sim"]).alias("similarity"),
    )


@register("ranking_text", "SELECT * FROM v_ranking")
def ranking_text(spark, folder):
    return _scored_rows(spark, folder).select(
        "case_id", P.ranking_text("similarity", "stranger_slot").alias("ranking")
    )


@register("prompt_with_ranking", f"""
SELECT case_id, concat({_HEAD}, options, chr(10), 'user=', ranking) AS prompt
FROM v_lettered JOIN v_option_text USING (case_id) JOIN v_ranking USING (case_id)""")
def prompt_with_ranking(spark, folder):
    prompt = P.build_prompt_with_ranking(F.lit(SYSTEM), "query", "gallery", "stranger_slot", "similarity")
    return _scored_rows(spark, folder).select("case_id", _flat(prompt).alias("prompt"))


@register("prompt_qa", """
SELECT page_id, concat('system=Answer briefly.', chr(10), 'user=<', url, '>', chr(10), 'user=What is in ', url, '?', chr(10), 'assistant=', html) AS prompt FROM pages""")
def prompt_qa(spark, folder):
    question = F.concat(F.lit("What is in "), "url", F.lit("?"))
    prompt = P.build_prompt_qa(F.lit("Answer briefly."), "url", question, F.array("html", "url"))
    return views.table(spark, folder, "pages").select("page_id", _flat(prompt).alias("prompt"))


@register("system_messages", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Match the product.' WHEN event_type = 'click' THEN 'Match and describe the person.' ELSE 'Match the person.' END AS text
FROM events""")
def system_messages(spark, folder):
    kind = F.when(F.col("user_id") % 2 == 0, "product").otherwise("person")
    variant = F.when(F.col("event_type") == "click", "caption").otherwise("default")
    return views.table(spark, folder, "events").select(
        "event_id", P.system_message(kind, variant, MESSAGES).alias("text")
    )
