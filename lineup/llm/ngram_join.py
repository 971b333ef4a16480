"""Jaccard join of documents on word shingles, grouped by equal prefixes.

1. A scan hashes every document's shingles. Half of the hash space, by bucket,
   shows which shingles occur elsewhere. A document that shares too few of them
   for the threshold has no link; the bound is exact.
2. Documents with equal sets are one. The rest's shingles are ordered by
   frequency, rarest first; those that no other set holds only count.
3. Documents with identical prefixes and size are one group. Groups that share
   a prefix entry, within the prefix that their two sizes allow, are candidates;
   surviving group pairs are expanded and their members verified.
4. Only components are asked for, so groups are first tied to the best connected
   group they meet, verified as well; pairs inside a component need no further look.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import store
from .components import components

FLUSH = 2_000_000  # shingles that a task holds before it writes its buckets
TIES = 4  # rounds that tie units to hubs before all remaining pairs are tried

_SEEN = ("bucket int, docs binary, counts binary, prints binary, n binary, half binary, "
         "own binary, h1 binary, h2 binary")
_FACTS = "doc_id long, shared long, n long, half long, h1 long, h2 long"


def shingle_sets(data, offsets, size: int):
    """Distinct shingle hashes of each text, ascending, and the ends of each text's run.

    A text with fewer than ``size`` words has its whole sequence as one shingle.
    """
    data = common.LOWER[data]
    start, end, doc = common.word_spans(data, offsets)
    n_docs = len(offsets) - 1
    words = np.bincount(doc, minlength=n_docs)
    hashed = common.gram_hash(common.span_hash(common.prefix_hash(data), start, end), doc, size)
    first = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(len(doc)) - first[doc]
    short = words[doc] < size
    hashed = np.where(short, common.mix(hashed + (words[doc] + 1).astype(np.uint64)), hashed)
    keep = np.where(short, place == 0, place <= words[doc] - size)
    hashed, doc = hashed[keep], doc[keep]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashed[a:b].sort()
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    hashed, doc = hashed[new], doc[new]
    return hashed, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])


def _run_sums(values, bounds):
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen(size: int, n_buckets: int):
    """Rows for the bucket pass: shingles of half the hash space, and each document's facts.

    A shingle that repeats inside the task is known to be shared: its documents
    are credited here, and its bucket gets two entries without a document.
    """

    def flush(ids, tokens, where, facts):
        ids, tokens, where = np.concatenate(ids), np.concatenate(tokens), np.concatenate(where)
        order = np.argsort(tokens, kind="stable")
        again = np.zeros(len(tokens), bool)
        ranked = tokens[order]
        same = ranked[1:] == ranked[:-1]
        again[order[1:]] |= same
        again[order[:-1]] |= same
        own = np.bincount(where[again], minlength=len(ids)).astype(np.int64)
        known = np.unique(tokens[again])
        left, left_doc = tokens[~again], ids[where[~again]]
        tokens = np.concatenate([known, known, left])
        holder = np.concatenate([np.full(2 * len(known), -1, np.int64), left_doc])
        bucket = ((tokens >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, holder, prints = bucket[order], holder[order], tokens[order].astype(np.uint32)
        out = {k: [] for k in ("bucket", "docs", "counts", "prints", "n", "half", "own", "h1", "h2")}
        if len(bucket):
            change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(holder) != 0)) + 1
            runs = np.concatenate([[0], change])
            counts = np.diff(np.concatenate([runs, [len(bucket)]])).astype(np.int32)
            edges = np.flatnonzero(np.diff(bucket[runs], prepend=-1) != 0)
            for a, b in zip(edges, [*edges[1:], len(runs)]):
                stop = runs[b] if b < len(runs) else len(bucket)
                for k, v in (("bucket", int(bucket[runs[a]])), ("docs", holder[runs[a:b]].tobytes()),
                             ("counts", counts[a:b].tobytes()), ("prints", prints[runs[a] : stop].tobytes())):
                    out[k].append(v)
                for k in ("n", "half", "own", "h1", "h2"):
                    out[k].append(None)
        n, half, h1, h2 = (np.concatenate([f[i] for f in facts]) for i in range(4))
        for a in range(0, len(ids), 512):
            part = slice(a, a + 512)
            row = {"bucket": int(ids[a] % n_buckets), "docs": ids[part].tobytes(), "counts": None, "prints": None,
                   "n": n[part].tobytes(), "half": half[part].tobytes(), "own": own[part].tobytes(),
                   "h1": h1[part].tobytes(), "h2": h2[part].tobytes()}
            for k, v in row.items():
                out[k].append(v)
        kinds = [pa.int32()] + [pa.binary()] * 8
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    def rows(batches):
        ids, tokens, where, facts, held, seen = [], [], [], [], 0, 0
        for batch, a, b, data, offsets in common.text_slices(batches):
            hashed, bounds = shingle_sets(data, offsets, size)
            doc = np.repeat(np.arange(b - a), np.diff(bounds))
            half = hashed < np.uint64(1 << 63)
            ids.append(common.column(batch, "doc_id", a, b))
            tokens.append(hashed[half])
            where.append(doc[half] + seen)
            seen += b - a
            facts.append((np.diff(bounds), np.bincount(doc[half], minlength=b - a).astype(np.int64),
                          _run_sums(common.mix(hashed), bounds).view(np.int64),
                          _run_sums(common.mix(hashed ^ np.uint64(0x5851F42D4C957F2D)), bounds).view(np.int64)))
            held += int(half.sum())
            if held >= FLUSH:
                yield flush(ids, tokens, where, facts)
                ids, tokens, where, facts, held, seen = [], [], [], [], 0, 0
        if ids:
            yield flush(ids, tokens, where, facts)

    return rows


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """How many shingles of a bucket each document shares with any other."""
    parts, info = rows[rows["prints"].notna()], rows[rows["n"].notna()]
    out = []
    if len(parts):
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in parts["docs"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in parts["counts"]])
        prints = np.concatenate([np.frombuffer(x, np.uint32) for x in parts["prints"]])
        order = np.argsort(prints)
        ranked = prints[order]
        again = np.zeros(len(prints), bool)
        same = ranked[1:] == ranked[:-1]
        again[order[1:]] |= same
        again[order[:-1]] |= same
        total = np.concatenate([[0], np.cumsum(again)])
        ends = np.cumsum(counts)
        found = total[ends] - total[ends - counts]
        hit = (found > 0) & (docs >= 0)
        zero = np.zeros(hit.sum(), np.int64)
        out.append(pd.DataFrame({"doc_id": docs[hit], "shared": found[hit], "n": zero, "half": zero,
                                 "h1": zero, "h2": zero}))
    for _, r in info.iterrows():
        get = {k: np.frombuffer(r[k], np.int64) for k in ("docs", "own", "n", "half", "h1", "h2")}
        out.append(pd.DataFrame({"doc_id": get["docs"], "shared": get["own"], "n": get["n"],
                                 "half": get["half"], "h1": get["h1"], "h2": get["h2"]}))
    names = ["doc_id", "shared", "n", "half", "h1", "h2"]
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def _chunks(size: int):
    """Sets of some documents in one row, named by the smallest id among them."""

    def rows(batches):
        for batch, a, b, data, offsets in common.text_slices(batches):
            hashed, bounds = shingle_sets(data, offsets, size)
            ids = common.column(batch, "doc_id", a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids.min())]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, bounds, hashed))],
                ["chunk", "ids", "bounds", "tokens"])

    return rows


def _questions(tokens: np.ndarray, n_buckets: int):
    """Distinct tokens by bucket, their counts, the ends of the buckets, and each token's place."""
    kinds, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    bucket = ((kinds >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return kinds[order], counts[order], np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))]), back[place]


def _ask(n_buckets: int):
    def rows(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(batch.schema.get_field_index("tokens")))
            for i, chunk in enumerate(common.column(batch, "chunk", 0, len(batch))):
                kinds, counts, ends, _ = _questions(data[offsets[i] : offsets[i + 1]].copy().view(np.uint64), n_buckets)
                full = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk)),
                     pa.array([kinds[ends[j] : ends[j + 1]].tobytes() for j in full], pa.binary()),
                     pa.array([counts[ends[j] : ends[j + 1]].astype(np.uint32).tobytes() for j in full], pa.binary())],
                    ["bucket", "chunk", "tokens", "counts"])

    return rows


def _classes(rows: pd.DataFrame) -> pd.DataFrame:
    """The frequency class of each token asked for: 0 for a single holder, then by eighths of an octave."""
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["tokens"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]])
    _, place = np.unique(tokens, return_inverse=True)
    holders = np.bincount(place, weights=counts)
    kind = np.minimum(255, np.round(8 * np.log2(holders))).astype(np.uint8)[place]
    ends = np.cumsum([len(x) // 8 for x in rows["tokens"]])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"],
                         "kinds": [k.tobytes() for k in np.split(kind, ends[:-1])]})


def _ordered(percent: int, n_buckets: int):
    """Sets whose shared shingles suffice for a link, rarest first, without the unshared ones."""

    def rows(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        kinds = np.frombuffer(b"".join(answers["kinds"]), np.uint8)
        out = {k: [] for k in ("doc_id", "n", "p1", "p2", "tokens")}
        for ids, bounds, tokens in zip(chunks["ids"], chunks["bounds"], chunks["tokens"]):
            ids, bounds = np.frombuffer(ids, np.int64), np.frombuffer(bounds, np.int64)
            tokens = np.frombuffer(tokens, np.uint64)
            kind = kinds[_questions(tokens, n_buckets)[3]]
            for doc, a, b in zip(ids, bounds[:-1], bounds[1:]):
                n, k = int(b - a), kind[a:b]
                shared = int(np.count_nonzero(k))
                if 100 * shared < percent * n:
                    continue
                order = np.argsort(k, kind="stable")[n - shared :]
                mine = tokens[a:b][order]
                head = mine[: max(0, n + (-percent * n) // 100 + 1 - (n - shared))]
                own = 0 if shared == n else int(doc) + 1
                marks = [int((common.mix(head ^ np.uint64(s)).sum(dtype=np.uint64) + common.mix(np.array([own], np.uint64))[0]
                              ).view(np.int64)) for s in (1, 2)]
                for c, v in zip(out, (int(doc), n, *marks, mine.tobytes())):
                    out[c].append(v)
        return pd.DataFrame(out)

    return rows


def _entries(percent: int):
    """One row per prefix entry that another set holds too; ``place`` counts the unshared ones before it."""

    def rows(batches):
        for batch in batches:
            data, offsets = common.buffers(batch.column(batch.schema.get_field_index("tokens")))
            doc, n = common.column(batch, "doc_id", 0, len(batch)), common.column(batch, "n", 0, len(batch))
            have = np.diff(offsets) // 8
            for a, b in common.slices(data, offsets, 4 << 20):
                alone = n[a:b] - have[a:b]
                want = np.clip(n[a:b] + (-percent * n[a:b]) // 100 + 1 - alone, 0, have[a:b])
                row = np.repeat(np.arange(a, b), want)
                place = np.arange(len(row)) - np.repeat(np.cumsum(want) - want, want)
                flat = data[offsets[a] : offsets[b]].copy().view(np.int64)
                at = (offsets[row] - offsets[a]) // 8 + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[at]), pa.array(doc[row]), pa.array(n[row]), pa.array(place + alone[row - a])],
                    ["token", "doc_id", "n", "place"])

    return rows


def _overlap(batches):
    """Size of the intersection of two sets in one row."""
    for batch in batches:
        x, xo = common.buffers(batch.column(batch.schema.get_field_index("x")))
        y, yo = common.buffers(batch.column(batch.schema.get_field_index("y")))
        common_size = np.zeros(len(batch), np.int64)
        for i in range(len(batch)):
            both = np.concatenate([x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]]).view(np.uint64)
            both.sort()
            common_size[i] = np.count_nonzero(both[1:] == both[:-1])
        names = ["a", "b", "na", "nb"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(k)) for k in names), pa.array(common_size)],
            [*names, "both"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose whole sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y"))
    wide = pairs.select("a", "b").join(left, "a").join(right, "b")
    sized = wide.mapInArrow(_overlap, "a long, b long, na long, nb long, both long")
    return sized.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    ``docs`` has ``doc_id`` and ``text``; further columns are ignored. Two
    documents link when ``100 * |x & y| >= percent * |x | y|`` on their sets of
    ``size``-word shingles. ``component_id`` is the smallest id that links reach.

    A null or blank text has an empty set and no link. Rows without an id are
    left out; of rows that repeat an id the greatest text counts. Equal sets
    link at once. Long texts are hashed whole. An empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    docs = common.one_row_per_id(docs)
    n_buckets = common.buckets_for(common.text_bytes(docs) / 12)
    facts = store(
        docs.mapInArrow(_seen(size, n_buckets), _SEEN).groupBy("bucket").applyInPandas(_shared, _FACTS)
        .groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("shared", "n", "half", "h1", "h2")]), "facts")

    # Equal sets: the smallest id stands for all.
    full = facts.where("n > 0")
    copies = store(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
                   .where("k > 1").drop("k"), "copies")
    owned = full.join(copies, ["n", "h1", "h2"], "left").select(
        "doc_id", F.coalesce("first", "doc_id").alias("rep"), "n", "half", "shared")
    need = F.expr(f"half - (n + floor(-{percent} * n / 100))")
    chosen = store(owned.where((F.col("doc_id") == F.col("rep")) & (F.col("shared") >= need)).select("doc_id"), "chosen")
    chunks = store(docs.join(chosen.hint("shuffle_hash"), "doc_id").mapInArrow(
        _chunks(size), "chunk long, ids binary, bounds binary, tokens binary"), "chunks")
    answers = chunks.select("chunk", "tokens").mapInArrow(
        _ask(n_buckets), "bucket int, chunk long, tokens binary, counts binary").groupBy("bucket").applyInPandas(
        _classes, "chunk long, bucket int, kinds binary")
    sets = store(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _ordered(percent, n_buckets), "doc_id long, n long, p1 long, p2 long, tokens binary"), "sets")

    groups = _Groups(sets, percent)
    links = found = None
    for _ in range(TIES):
        groups.open(found)
        more = store(_verified(groups.ties(), sets, percent), "links")
        if not more.limit(1).count():
            break
        links = more if links is None else links.union(more)
        found = components(links)
    else:
        groups.open(found)
    more = store(_verified(groups.rest(), sets, percent), "links")
    if links is None or more.limit(1).count():
        found = components(more if links is None else links.union(more))
    final = store(found.where("node <> component"), "found")
    named = owned.select("doc_id", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id"))
    return facts.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


class _Groups:
    """Sets with identical prefixes and size as one group, and the entries of the groups' prefixes."""

    def __init__(self, sets: DataFrame, percent: int):
        self.percent = percent
        slim = sets.select("doc_id", "n", "p1", "p2")
        leads = store(slim.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("lead")), "leads")
        self.grouped = store(slim.join(leads, ["n", "p1", "p2"]).select("doc_id", "lead"), "grouped")
        entries = sets.join(leads.select(F.col("lead").alias("doc_id")).hint("shuffle_hash"), "doc_id").select(
            "doc_id", "n", "tokens").mapInArrow(_entries(percent), "token long, doc_id long, n long, place long")
        entries = store(entries.withColumnRenamed("doc_id", "lead"), "entries")
        held = entries.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
        self.entries = store(entries.join(held.hint("shuffle_hash"), "token"), "entries")
        # An original meets most others on most of its entries; its edited copies on fewer.
        self.fame = store(self.entries.groupBy("lead", "n").agg((F.sum("holders") / F.col("n")).alias("fame"))
                          .select("lead", "fame"), "fame")

    def open(self, found: DataFrame | None) -> None:
        """Entries whose holders are of several components, with the largest of these.

        A unit is a group's part in one component. Entries held by a single
        component can add nothing and are left out.
        """
        members = self.grouped.withColumn("component", F.col("doc_id"))
        if found is not None:
            members = self.grouped.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        self.members = store(members.select("doc_id", "lead", F.coalesce("component", "doc_id").alias("component")), "members")
        units = self.members.groupBy("lead", "component").agg(F.min("doc_id").alias("face"))
        self.units = store(units.join(self.fame, "lead", "left").fillna(0.0, ["fame"]), "units")
        held = store(self.entries.drop("holders").join(self.units, "lead"), "held")
        star = F.struct("fame", -F.col("face"), "component")
        mode = held.groupBy("token", "component").agg(F.count("*").alias("k"), F.max(star).alias("star")).groupBy(
            "token").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "component")).alias("top"), F.max("star").alias("star"))
        mode = store(mode.where("kinds > 1").select(
            "token", F.col("top.component").alias("major"), (-F.col("star.col2")).alias("hub"),
            F.col("star.component").alias("hub_component")), "mode")
        self.held = store(held.join(mode, "token"), "open")

    def ties(self) -> DataFrame:
        """For each unit the most connected face of another component that it meets most often."""
        met = self.held.where("component <> hub_component").groupBy("face", "hub").agg(F.count("*").alias("k"))
        return met.groupBy(F.col("face").alias("a")).agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("b"))

    def rest(self) -> DataFrame:
        """All pairs that may link and lie in different components.

        Entries outside their token's largest component meet all its entries,
        so that component is not paired with itself.
        """
        percent = self.percent
        unit = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("face", "n", "place", "component", "lead")]
        minor = self.held.where("component <> major").select("token", *unit("a"))
        whole = self.held.select("token", "major", *unit("b"))
        need = f"-floor(-{percent} * (n_a + n_b) / {100 + percent})"
        met = minor.join(whole, "token").where(
            f"component_a <> component_b and (component_b = major or face_a < face_b) and lead_a <> lead_b "
            f"and 100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a "
            f"and place_a <= n_a - {need} and place_b <= n_b - {need}")
        pairs = met.select("lead_a", "component_a", "lead_b", "component_b").distinct()
        one, two = (self.members.select(F.col("lead").alias(f"lead_{s}"), F.col("component").alias(f"component_{s}"),
                                        F.col("doc_id").alias(s)) for s in ("a", "b"))
        across = pairs.join(one, ["lead_a", "component_a"]).join(two, ["lead_b", "component_b"]).select("a", "b")
        split = self.units.groupBy("lead").count().where("count > 1").select("lead")
        inner = self.members.join(split, "lead").select("lead", "doc_id", "component")
        within = inner.alias("s").join(inner.alias("t"), "lead").where(
            "s.doc_id < t.doc_id and s.component <> t.component").select(
            F.col("s.doc_id").alias("a"), F.col("t.doc_id").alias("b"))
        return across.union(within).distinct()
