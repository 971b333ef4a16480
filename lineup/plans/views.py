"""Views over the test tables, in the library's vocabulary.

``items`` reads every row of ``events``. A block of six users gives groups of
one, two and three entities. In every second block some event types are private
to their user, so groups with and without a shared source both occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source number of an event type.
SOURCES = {"click": 0, "view": 1, "purchase": 2, "signup": 3}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    n_vectors = table(spark, folder, "embeddings").agg(F.count("*")).scalar()
    kind = F.lit(4)
    for name, number in SOURCES.items():
        kind = F.when(F.col("event_type") == name, number).otherwise(kind)
    user, event = F.col("user_id"), F.col("event_id")
    block, seat = F.expr("user_id div 6"), user % 6
    within = F.when(seat == 0, 0).when(seat <= 2, 1).otherwise(2)
    shared = (block % 2 == 1) | ((F.expr("user_id div 2") + kind) % 3 == 0)
    source = F.when(shared, kind).otherwise(seat + 5)
    even = F.expr("event_id div 5") % 2 == 0
    return events.select(
        event.alias("item_id"),
        (block * 3 + within).cast("long").alias("group_id"),
        user.alias("entity_id"),
        source.cast("long").alias("source_id"),
        F.when(event % 5 == 0, "query").otherwise("gallery").alias("role"),
        F.when(even, "same").otherwise("cross").alias("corpus"),
        (event % n_vectors).cast("long").alias("vec_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
    )


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Item paths whose account part holds an underscore on purpose."""
    c = F.col
    name = F.concat(
        F.lit("/data/"), c("corpus"), F.lit("/10"), c("group_id").cast("string"),
        F.lit("_20_"), c("entity_id").cast("string"), F.lit("_CAM"),
        c("source_id").cast("string"), F.lit("_EV"), c("item_id").cast("string"),
        F.lit("_"), F.lpad((c("item_id") % 1000).cast("string"), 6, "0"), F.lit("_000.jpg"),
    )
    return items(spark, folder).select("item_id", "role", "corpus", name.alias("path"))


# Reply texts appended to the conversations in turn.
REPLIES = (
    "Answer: B.", "answer: c.", "Answer: -1", "ANSWER: 3", "It does NOT MATCH any of them",
    "the person in gallery image 4", "I think B", "no idea", "7 maybe", "Answer: BC", "",
)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies: the whole text of a turn, after a short reply.

    ``label`` is an expected answer derived from the key.
    """
    which = F.col("conv_id") + F.col("turn")
    texts = F.array(*[F.lit(r) for r in REPLIES])
    labels = F.array(*[F.lit(x) for x in ("B", "3", "-1", "C")])
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("run_"), (F.col("conv_id") % 3).cast("string"), F.lit(".csv")).alias("file"),
        F.concat(F.get(texts, (which % len(REPLIES)).cast("int")), F.lit(" "),
                 F.col("text")).alias("response"),
        F.get(labels, (which % 4).cast("int")).alias("label"),
    )


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as one caption."""
    return table(spark, folder, "documents").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "caption")
    )
