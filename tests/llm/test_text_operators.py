"""Rules, packing, language, toxicity, sampling and mixing."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lineup.llm import importance, language_id as li, mixing, packing, quality_rules as qr, toxicity as tx

LONG = "alpha beta gamma delta " * 20_000


# -- quality rules ---------------------------------------------------------------

def facts_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if times[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


ODD = [(1, None), (2, ""), (3, "\n\n \t"), (4, "a b c a b c"), (5, "x\nx\n x\nx"), (6, "é " * 80), (7, LONG), (8, "#*$ |<> & %" * 30),
       (9, "same line\nsame line\n\n\nother"), (10, "no newline at end"), (11, "a\r\nb\r\na\r\n"), (12, "\x0b\x0c x\x0by")]


def test_facts(make):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in qr.quality_rules(make(ODD)).collect()}
    assert got == {i: facts_of(t) for i, t in ODD}


def test_facts_whole_table(documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in qr.quality_rules(documents).collect()}
    assert got == {r.doc_id: facts_of(r.text) for r in documents.collect()}


def test_host_prior_spares_small_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = good + " #" * 20
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad, "poor") for i in range(200)]
    rows += [(2000, bad, "small")] + [(3000 + i, good, f"h{i}") for i in range(30)] + [(5000, bad, None)]
    out = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept and out[3000].kept and out[5000].kept
    assert not out[1000].kept and not out[1000].base_failed
    rates = {(r.host, r.rule): r for r in qr.host_rates(qr.measure(
        spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert rates["small", "symbols"].rate < 1.0
    assert rates["poor", "symbols"].rate > rates["small", "symbols"].rate


def test_rules_on_no_rows(none):
    assert qr.quality_rules(none).count() == 0


# -- packing ------------------------------------------------------------------------

def test_best_fit_is_tightest():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    places, offsets = packing.best_fit(lengths, 64)
    free = []
    for length, place, offset in zip(lengths, places, offsets):
        fits = [c for c in free if c >= length]
        expect = 64 - min(fits) if fits else 0
        assert offset == expect
        if place == len(free):
            assert not fits
            free.append(64)
        free[place] -= length
    assert min(free) >= 0


def check_pieces(rows, texts, window):
    from tokenizers import Tokenizer

    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_pack_round_trip(make):
    rows = [*ODD, (13, "<|endoftext|> in a <|endoftext|><|endoftext|>text <|endof"), (14, "日本語 😀 naïve"), (15, "a" * 3000)]
    got = packing.pack(make(rows), window=256).collect()
    check_pieces(got, dict(rows), 256)


def test_pack_whole_table(documents):
    packed = packing.pack(documents)
    check_pieces(packed.collect(), {r.doc_id: r.text for r in documents.collect()}, 2048)
    total = packing.padding(packed).first()
    assert total.n_padding < 0.02 * total.n_tokens


def test_pack_repeated_rows_and_none(make, none):
    got = packing.pack(make([(1, "same"), (1, "same"), (None, "x")])).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pack(none).count() == 0


# -- language -----------------------------------------------------------------------

def test_language_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in li.language_id(documents).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_odd_rows(documents, none):
    odd = documents.sparkSession.createDataFrame(
        [(10**6 + i, t, None, "s", 0) for i, t in enumerate([None, "", "123 $$ !!", LONG])],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in li.language_id(documents.select(odd.columns).union(odd).union(odd)).collect()}
    assert [got[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3
    assert got[10**6 + 3].lang_pred != "und"
    assert li.language_id(none).count() == 0
    assert {r.lang_pred for r in li.language_id(odd).collect()} == {"und"}


def test_switched_text_is_labelled_by_spans(documents):
    rows = [r for r in documents.collect() if r.text]
    texts = {lang: [r.text for r in rows if r.lang == lang][:40] for lang in ("en", "fr")}
    model = li.fit_crf(texts["en"] + texts["fr"], ["en"] * len(texts["en"]) + ["fr"] * len(texts["fr"]))
    mixed = " ".join(texts["en"][0].split()[:30] + texts["fr"][0].split()[:30])
    share = model.documents(np.frombuffer(mixed.encode(), np.uint8), np.array([0, len(mixed.encode())]))[0]
    assert 0.25 < share[0] < 0.75


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([4, 2])
    scores, move, begin = rng.normal(size=(6, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, expected = li.forward_backward(scores, lengths, move, begin)
    want, moves = np.zeros((6, k)), np.zeros((k, k))
    for first, n in ((0, 4), (4, 2)):
        paths = list(itertools.product(range(k), repeat=n))
        value = np.array([math.exp(begin[p[0]] + sum(scores[first + t, p[t]] for t in range(n))
                                   + sum(move[p[t], p[t + 1]] for t in range(n - 1))) for p in paths])
        value /= value.sum()
        for p, v in zip(paths, value):
            for t in range(n):
                want[first + t, p[t]] += v
            for t in range(n - 1):
                moves[p[t], p[t + 1]] += v
    assert np.allclose(got, want) and np.allclose(expected, moves)


# -- toxicity -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic_corpus(spark):
    """Plain filler, with abuse in a third of it; some abuse is written to hide."""
    rng = random.Random(4)
    filler = "the river runs past old stone houses where people trade bread and wool in spring".split()
    abuse = ["idiot", "stupid", "moron"]
    hidden = ["1d10t", "st00pid".replace("oo", "u"), "m0r0n", "i d i o t", "s.t.u.p.i.d", "mooooron", "$tupid"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(filler) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            pick = rng.choice(hidden) if i % 2 else rng.choice(abuse)
            w.insert(rng.randrange(40), pick)
            w.insert(rng.randrange(40), rng.choice(abuse) if i % 2 == 0 else rng.choice(hidden))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_hidden_abuse_is_found(toxic_corpus):
    docs, labels = toxic_corpus
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in tx.toxicity(docs, labels).collect() if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    wrong = [r for r in held if r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.1 * len(held)


def test_restore(toxic_corpus):
    model = tx.character_model(toxic_corpus[0].where("doc_id % 2 = 0").select("text"))
    assert tx.restore("1d10t", model) == "idiot"
    assert tx.restore("i d i o t", model) == "idiot"
    assert tx.restore("mooooron", model) == "moron"
    assert tx.restore("s.t.u.p.i.d", model) == "stupid"
    assert tx.restore("a=b", model) == "a=b"


def test_toxicity_odd_rows(make, none, no_labels, toxic_corpus):
    got = tx.toxicity(make([*ODD, (7, "again"), (None, "x")]), toxic_corpus[1]).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 13))
    assert all(0 <= r.score <= 1 for r in got)
    assert tx.toxicity(none, no_labels).count() == 0
    assert all(0 <= r.score <= 1 for r in tx.toxicity(toxic_corpus[0], no_labels).collect())


def test_bytes_and_pattern_agree():
    texts = ["plain words only", "id10t", "a b c d", "sooo", "x@y", "(well", "$$a", "é é é é", "", "end.", "a..b", "7up yes"]
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    may = tx._may_hide(np.frombuffer(b"".join(raw), np.uint8), ends)
    assert all(m or not tx.hidden_words(t) for t, m in zip(texts, may))


HIDDEN = {
    "$tupid": "stupid", "$cum": "scum", "(lown": "clown", "tr4$": "tras", "idi07": "idiot", "1d107": "idiot", "1053r": "loser",
    "scu3": "scue", "i d 1 o t": "idiot", "m o r 0 n": "moron", "i  d  i  o  t": "idiot", "i/d/i/o/t": "idiot", "i,d,i,o,t": "idiot",
    "stuupid": "stupid", "iidiioott": "idiot", "$tup1d": "stupid", "3 m o r o n": "moron", "\"1d107!\"": "idiot"}


def test_every_form_is_decoded_and_found(spark):
    rng = random.Random(8)
    filler = "the river runs past old stone houses where people trade bread and wool in spring".split()
    abuse = sorted(set(HIDDEN.values()))
    docs = [(i, " ".join([*rng.choices(filler, k=20), *([abuse[i // 2 % len(abuse)]] if i % 2 else []), *rng.choices(filler, k=20)]))
            for i in range(1200)]
    docs += [(5000 + i, " ".join([*filler[:8], form, *filler[8:]])) for i, form in enumerate(HIDDEN)]
    docs += [(6000, " ".join(filler)), (6001, "bread, (wool) and stone! In 2023: $5.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1200)], "doc_id long, quality int, toxic int")
    model = tx.fit(frame, labels)
    for form, word in HIDDEN.items():
        assert word in [tx.restore(x, model.characters) for x in tx.hidden_words(f"past {form} old")], form
    score = {r.doc_id: r.score for r in tx.score(frame, model).collect()}
    assert [f for i, f in enumerate(HIDDEN) if score[5000 + i] < 0.3] == []
    assert score[6000] < 0.3 and score[6001] < 0.3


# -- importance ---------------------------------------------------------------------

def test_kth_greatest(spark):
    rng = random.Random(5)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [0, 0, 0, -1, 5, 5] + [2**63 - 1, -(2**63)]
    frame = spark.createDataFrame([(v,) for v in values], "x long")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 150, 153, 308):
        edge, above = importance.kth_greatest(frame, "x", k)
        assert edge == ranked[k - 1] and above == sum(v > edge for v in values)


def test_sample_has_its_size_and_prefers_the_target(make, spark):
    good, junk = "calm clear prose about rivers. ", "!! ## $$ %% "
    rows = [(i, (good if i % 2 else junk) * 30) for i in range(1, 201)] + [(300, None), (301, ""), (302, LONG)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 101)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in importance.resample(make([*rows, rows[0]]), labels, fraction=0.5).collect()}
    assert sum(r.kept for r in out.values()) == math.ceil(0.5 * len(rows)) and len(out) == len(rows)
    assert all(out[i].kept == bool(i % 2) for i in range(1, 201))
    assert out[300].log_weight == out[301].log_weight == 0


def test_sample_of_nothing(none, no_labels, make):
    assert importance.resample(none, no_labels).count() == 0
    got = importance.resample(make([(i, "same text") for i in range(20)]), no_labels, fraction=0.25).collect()
    assert sum(r.kept for r in got) == 5


# -- mixing ---------------------------------------------------------------------------

def test_rates_meet_the_targets(documents, spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = mixing.mix(documents, labels, weights={"good": 0.7, "low": 0.25, "toxic": 0.05}).toPandas()
    p, t = np.stack(got.p), got.n_tokens.to_numpy(float)
    assert np.allclose(p.sum(1), 1) and (got.rate >= 0).all()
    share = (p * (t * got.rate.to_numpy())[:, None]).sum(0) / t.sum()
    names = got.domains.iloc[0].split(",")
    want = np.array([{"good": 0.7, "low": 0.25, "toxic": 0.05}.get(n, 0) for n in names])
    assert np.abs(share - want / want.sum()).max() < 0.02
    assert (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.floor(got.rate) + 1).all()


def test_rates_equal_plain_least_squares(spark):
    """Small problem: the fitted totals are the best that non-negative rates allow."""
    rows = [([0.9, 0.1], 10), ([0.2, 0.8], 30), ([0.5, 0.5], 20)]
    frame = spark.createDataFrame(rows, "p array<double>, n_tokens long")
    _, reached = mixing.fit_rates(frame, [40.0, 20.0])
    assert np.allclose(reached, [40, 20], rtol=1e-3)
    _, capped = mixing.fit_rates(frame, [1000.0, 1000.0], cap=1.0)
    assert np.allclose(capped, [25, 35])


def test_mixing_odd_rows(make, none, no_labels):
    frame = make([*ODD, (4, "a b c a b c"), (None, "words of no one")])
    got = mixing.mix(frame, no_labels).collect()
    assert len(got) == len(ODD) + 2 and all(r.rate >= 0 for r in got)
    assert next(r for r in got if r.doc_id == 1).n_tokens == 0
    assert mixing.mix(none, no_labels).count() == 0


def test_words_tell_domains_on_held_out_labels(toxic_corpus):
    docs, labels = toxic_corpus
    held = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    got = mixing.mix(docs, labels.where(f"not {held}"), keep={"good": 1.0, "toxic": 0.5}, cap=1.0).join(
        labels, "doc_id").where(held).collect()
    good, toxic = ([r.rate for r in got if r.toxic == y] for y in (0, 1))
    assert good and min(good) > 0 and np.mean(good) > 0.95
    assert toxic and np.mean(toxic) < 0.7


def test_tokens_are_runs_of_non_blanks(make, no_labels):
    got = {r.doc_id: r.n_tokens for r in mixing.mix(make(ODD), no_labels).collect()}
    assert got == {i: len(re.findall("[^ \n\t\r]+", t or "")) for i, t in ODD}


def test_mixing_plan_is_native(documents, spark, folder):
    plan = mixing.mix(documents, spark.read.parquet(f"{folder}/labels.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_posteriors_equal_plain_naive_bayes(make, spark):
    """Probabilities worked out text by text, repeated rows and empty texts included."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["Apple", "pear", "plum", "fig", "1", "x-y", "Öl"][i % 3:], k=rng.randint(0, 30)))) for i in range(60)]
    rows += [rows[5], (70, None), (71, ""), (None, "pear plum"), (72, "!!"), (5, "another text")]
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    docs = make(rows)
    model = mixing.fit_domains(docs, labels)
    got = {(r.doc_id, r.n_tokens, r.copies_of): list(r.p) for r in mixing.posteriors(docs, model).collect()}
    frame = mixing.features(docs).collect()
    slots = {r.word: r.slot for r in spark.createDataFrame([(w,) for r in frame for w in r.words], "word string").distinct().select(
        "word", mixing.slot().alias("slot")).collect()}
    copies = collections.Counter((i, t or "") for i, t in rows)
    for r in frame:
        text = r.text or ""
        assert set(r.words) - {""} == {w for w in re.split(r"[^a-zäöüß]+", text.lower()) if w}
        score = []
        for d, size in enumerate(model.sizes):
            v = np.log(size / sum(model.sizes))
            for x, m, var in zip(r.f, model.means[d], np.maximum(model.variances[d], 1e-4)):
                v -= 0.5 * np.log(var) + (x - m) ** 2 / (2 * var)
            score.append(v + sum(model.odds[d][slots[w]] for w in r.words if w))
        want = np.exp(np.array(score) - max(score))
        n = len(re.findall("[^ \n\t\r]+", text))
        assert np.allclose(got[r.doc_id, n, copies[r.doc_id, text]], want / want.sum(), atol=1e-9)


def test_missed_targets_are_reported(make, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make([(1, "good words here"), (2, "low words there")])
    with pytest.warns(UserWarning, match="reached"):
        mixing.mix(docs, labels, keep={"good": 5.0, "low": 5.0}, cap=1.0)


# -- what hashing and letters must tell apart ------------------------------------------

def thue_morse(order, a="a", b="b"):
    """Two texts that agree under every polynomial hash modulo a power of two."""
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


def test_hashes_tell_thue_morse_strings_apart(make):
    from lineup.llm import common
    from lineup.llm.ngram_join import ngram_join

    for order in (10, 13):
        x, y = thue_morse(order)
        for which in (0, 1):
            h = [common.span_hash(common.prefix_hash(np.frombuffer(t.encode(), np.uint8), which), np.array([0]), np.array([len(t)]), which)[0] for t in (x, y)]
            assert h[0] != h[1]
    x, y = thue_morse(10)
    got = {r.doc_id: r for r in qr.quality_rules(make([(1, x + "\n" + y), (2, x + "\n" + x)])).collect()}
    assert [got[i].n_dup_lines for i in (1, 2)] == [0, 1]
    parts = {r.doc_id: r.component_id for r in ngram_join(make([(1, x), (2, y), (4, y)])).collect()}
    assert parts == {1: 1, 2: 2, 4: 2}


def test_hashes_do_not_depend_on_the_place():
    from lineup.llm import common

    rng = np.random.default_rng(2)
    word = rng.integers(0, 256, 40, dtype=np.uint8)
    data = np.concatenate([rng.integers(0, 256, 1000, dtype=np.uint8), word, rng.integers(0, 256, 70, dtype=np.uint8), word])
    prefix = common.prefix_hash(data)
    a, b = common.span_hash(prefix, np.array([1000, 1110]), np.array([1040, 1150]))
    assert a == b
    for size in (1, 2, 12, 24, 40):
        windows = common.rolling_hash(data, size)
        assert len(windows) == len(data) - size + 1 and windows[1000] == windows[1110]
        plain = [sum(int(common.ROLLING_CODES[x]) * pow(0x9E3779B97F4A7C15, size - 1 - j, 1 << 64) for j, x in enumerate(data[i : i + size])) % (1 << 64) for i in (0, 500)]
        assert common.mix(np.array(plain, np.uint64)).tolist() == windows[[0, 500]].tolist()
    assert len(set(windows.tolist())) == len(windows) - 1


def test_span_hashes_are_polynomials_over_the_field():
    from lineup.llm import common

    data = np.random.default_rng(3).integers(0, 256, 5000, dtype=np.uint8)
    data[1000:4000] = 255
    start, end = np.array([0, 10, 999, 4999, 700, 3]), np.array([0, 4000, 4001, 5000, 701, 5000])
    for which, lanes in ((0, 2), (1, 2), (1, 1)):
        got = common.span_hash(common.prefix_hash(data, which, lanes), start, end, which)
        for a, b, h in zip(start, end, got):
            whole = 0
            for lane in range(lanes):
                base, p = int(common.BASES[which][lane]), int(common.P)
                whole = whole << 31 | sum(int(common.BYTE_CODES[which][lane][x]) * pow(base, j, p) for j, x in enumerate(data[a:b])) % p
            assert common.mix(np.array([whole], np.uint64))[0] == h


@pytest.mark.parametrize("text, letters", [
    ("😀 !", ""), ("！？。、×÷", ""), ("١٢٣", ""), ("\u0301", ""), ("ⱥ", "ⱥ"), ("ⴀⴁ", "ⴀⴁ"), ("日本語 9", "日本語"), ("aªº1", "aªº"), ("Ж-ж", "Жж"), ("𐐀x", "𐐀x")])
def test_letters_are_unicode_letters(text, letters):
    data = np.frombuffer(text.encode(), np.uint8)
    assert data[li.letter_bytes(data)].tobytes().decode() == letters


def test_texts_without_letters_are_undetermined(make):
    rows = [(i, "the cat sat on the mat" if i % 2 else "die Katze sitzt auf der Matte") for i in range(1, 40)]
    odd = [(100, "😀"), (101, "！？。"), (102, "١٢٣"), (103, "ⴀⴁ"), (104, "×÷ 12"), (105, "\u0301")]
    got = {r.doc_id: r.lang_pred for r in li.language_id(make(rows + odd)).collect()}
    assert [got[i] for i in (100, 101, 102, 104, 105)] == ["und"] * 5 and got[103] != "und"
