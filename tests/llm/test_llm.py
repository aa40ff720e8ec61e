"""The ten operators against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import ann, chat, fingerprints, licenses, neardup, packing, pieces, pii, quality, queries, warc  # noqa: E402

BPE, PIECES = tokenizers.path("word_bpe_49k.json"), tokenizers.path("piece_bpe_32k.model")
EMPTY = "doc_id long, text string"
ODD = [(1, None, "x"), (2, "", "y"), (3, "one two", None), (3, "one two", None), (None, "Some text here.\nAnd more.", "z"), (5, "a " * 30_000, "w")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id long, text string, length string").withColumns({"rank": F.lit("r"), "score": F.lit("s"), "spans": F.lit(1)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


# --- 1: packing


def packed(df):
    got = packing.pack_documents(df, BPE, 2048).toPandas()
    by = got.sort_values(["sequence_id", "offset"])
    ends = by.offset + by.length
    assert (ends.groupby(by.sequence_id).shift(1).fillna(0) == by.offset).all() and (ends <= 2048).all()
    return got


def test_packing_is_exact_and_tight(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BPE)
    got = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()}
    for doc_id, text in docs:
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            assert rows.pop((doc_id, k // 2048)) == (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert not rows
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    coder, rng = Tokenizer.from_file(BPE), random.Random(3)
    texts = ["It's 'tis ...!!! a_b 12ab ΑΣ İx <|endoftext|>y <|ENDOFTEXT|> \x1f\x85 é", ""] + ["".join(rng.choice("aA'sStT.,_<|>9́Éé ßΣσ\n\t 　ñİ#&") for _ in range(50)) for _ in range(500)]
    marks = "\u0308\u030c\u0331\u030a\u0301"
    texts += ["".join(rng.choice("TtJjHhWwYyEe., ") + rng.choice(["", *marks]) for _ in range(40)) for _ in range(500)]
    ours = packing.WordIds(BPE, entries=200)
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
    left = dict(histogram)
    bins = 0
    for uses, times in packing.plan_packing(histogram, 64):
        assert sum(x * k for x, k in uses) <= 64 and times > 0
        bins += times
        for x, k in uses:
            left[x] -= k * times
    assert not any(left.values())
    ffd: list[int] = []  # first fit decreasing, as a yardstick
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, g in enumerate(ffd) if g >= x), None)
        if at is None:
            ffd.append(64 - x)
        else:
            ffd[at] -= x
    assert bins <= len(ffd) + 1


def test_packing_odd_rows(spark, odd):
    got = packed(odd)
    assert len(got[got.doc_id == 3]) == 2 and got[got.doc_id == 1].length.tolist() == [1]
    assert packing.pack_documents(spark.createDataFrame([], EMPTY), BPE).count() == 0


def test_packing_spreads_repeated_rows(spark):
    df = spark.createDataFrame([(None, "same text") for _ in range(400)] + [(1, "other words")], EMPTY).repartition(2)
    got = packed(df)
    assert len(got) == 401 and not got[["sequence_id", "offset"]].duplicated().any()


# --- 2: fingerprints


def test_fingerprints_against_sets(spark, docs, sf_dir):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    from collections import Counter

    cut = lambda t: set(Counter(re.findall(r"(?:[^\n]{100}[^\n.!?]{0,200}[.!?]*|[^\n]{1,100})\S{0,64}[^\S\n]?\n?|\n", t)).items())
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen: dict[str, set] = {}
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(cut(text), cut(edited))) and r.near_next == pytest.approx(jaccard(cut(text), cut(following)))
        seen.setdefault(text, set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in seen.values()) and len({f for s in seen.values() for f in s}) == len(seen)


def test_peeling_recovers_differences(spark):
    df = spark.createDataFrame([(list(range(40)), list(range(5, 47)))], "a array<long>, b array<long>")
    df = df.withColumns({"ca": F.expr(fingerprints.sketch("a")), "cb": F.expr(fingerprints.sketch("b"))})
    assert df.select(F.expr(fingerprints.difference("a", "ca", "b", "cb"))).first()[0] == 12


def test_likeness_counts_and_insertions(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["some", "words", "that", "stand", "here."]) + str(rng.randint(0, 99)) for _ in range(900)).replace("9 ", "9. ")
    rows = [(1, "a\nb\n"), (2, "a\n\n\nb\na\n"), (3, long), (4, long[:50] + "X" + long[50:])]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got[1].fingerprint != got[2].fingerprint and got[1].near_next < 1 and got[3].near_next > 0.8


def test_successors_over_many_ranges(spark):
    rows = [(k // 3, f"text {k}") for k in range(700)] + [(None, f"none {k}") for k in range(300)] + [(5, "same")] * 50
    df = spark.createDataFrame(rows, EMPTY).repartition(3)
    got = fingerprints.with_next(df, rows=16).select("doc_id", "text", "next_text").collect()
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, ((r.doc_id, r.text, r.next_text) for r in got))) == sorted(map(str, want))


def test_fingerprints_odd_rows(spark, odd):
    got = fingerprints.fingerprint_edits(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], EMPTY)).count() == 0
    assert fingerprints.fingerprint_edits(spark.createDataFrame([(7, "only one")], EMPTY)).first().near_next == 1


# --- 3: pieces


def test_pieces_equal_the_library(docs):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        ours = pieces.PieceTransducer(f.read())
    rng = random.Random(5)
    texts = [t for _, t in docs[:80]] + ["".join(rng.choice("aeinstr ThE.,\n\t12▁é🤖漢　") for _ in range(60)) for _ in range(400)] + [" " * k + "x" + " " * k for k in range(30)]
    for text in texts:
        ids = np.frombuffer(ours.encode(text), "<i4")
        assert ids.tolist() == sp.encode(text)
        assert ours.decode(ids) == sp.decode(ids.tolist())


def test_pieces_unigram_takes_the_best_path():
    def field(number: int, value: bytes) -> bytes:
        return bytes([number << 3 | 2, len(value)]) + value

    model = b""
    for text, score in (("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -3.0), ("▁a", -2.5), ("▁ab", -6.0)):
        model += field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + (b"\x18\x02" if text == "<unk>" else b""))
    model += field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")
    t = pieces.PieceTransducer(model)
    assert t._path("▁ab") == ["▁a", "b"] and t._path("ab") == ["ab"]


def test_character_maps_equal_the_library():
    sp = pytest.importorskip("sentencepiece")
    rng = random.Random(7)
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        theirs = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        ours = pieces.PieceTransducer(theirs.serialized_model_proto())
        chars = "aAeEoO \u0301\u0308\u3000ﬁＡ①½がか\u3099한ᄒ\u1161\u11ab\u200b\u00ad\tß.,漢ÅΩ\u1e9b\u0323"
        for _ in range(1500):
            text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 25)))
            assert ours.normalise(text) == theirs.normalize(text)


def test_symbols_of_the_user_never_merge():
    def field(number: int, value: bytes) -> bytes:
        return bytes([number << 3 | 2, len(value)]) + value

    model = b""
    for text, score, kind in (("<unk>", 0.0, 2), ("a", -4.0, 1), ("b", -5.0, 1), ("▁", -6.0, 1), ("ab", -1.0, 1), ("▁a", -2.0, 1), ("[a]", 0.0, 4), ("[", -7.0, 1), ("]", -8.0, 1)):
        model += field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([0x18, kind]))
    t = pieces.PieceTransducer(model + field(2, b"\x18\x02"))
    got = [t.pieces[i][0] for i in np.frombuffer(t.encode("ab[a]ab[a]"), "<i4")]
    assert got == ["▁", "ab", "[a]", "ab", "[a]"]


def test_pieces_odd_rows(spark, odd):
    got = {r.doc_id: r for r in pieces.encode_texts(odd, PIECES).collect()}
    assert got[1].n_tokens == 0 and got[5].round_trip and pieces.encode_texts(spark.createDataFrame([], EMPTY), PIECES).count() == 0


# --- 4: licences


def test_licenses_odd_rows(spark, odd):
    texts = [(1, "Apache License, apache license!"), (2, "CC-BY-SA MIT LICENSE"), (3, None), (4, "GNU General Public License version 3"), (5, "mit licenses")]
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(texts, EMPTY)).withColumn("labels", licenses.labels_of("hits", 99)).collect()}
    assert [got[k].labels for k in range(1, 6)] == ["apache", "cc-by,cc-by-sa,mit", "", "gpl,gpl-3.0", ""]
    assert sorted(h.start for h in got[1].hits) == [0, 2] and got[2].score == 1 and 0 < got[5].score < 1 and got[3].score == 0
    clash = odd.withColumns({"words": F.lit(1), "rare": F.lit(2), "row": F.lit(3), "places": F.lit(4)})
    assert licenses.find_licenses(clash).columns == [c for c in clash.columns if c != "score"] + ["n_words", "hits", "score"]
    assert licenses.find_licenses(odd).count() == len(ODD) and licenses.find_licenses(spark.createDataFrame([], EMPTY)).count() == 0


def test_many_templates_against_every_place(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    templates = tuple((tuple(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5)))), f"l{k}") for k in range(120))
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + ["", None, "w1"]
    found = licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), EMPTY), templates).collect()
    for r in found:
        w = (r.text or "").split()
        assert sorted((h.template, h.start) for h in r.hits) == sorted((n, i) for n, (p, _) in enumerate(templates) for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p)


# --- 5: quality


def test_quality_separates_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.8
    assert got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels)
    got = quality.score_texts(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.count() == len(ODD)
    none = quality.fit_quality(spark.createDataFrame([], EMPTY), labels)
    assert none is None and quality.score_texts(odd, none).agg(F.max("score")).first()[0] == 0.5


def test_nnpu_recovers_both_classes():
    rng = np.random.default_rng(1)
    draw = lambda n, at: rng.normal(at, 1, (n, 5))
    model = quality.fit_nnpu(draw(2000, 1.5), np.concatenate([draw(2400, 1.5), draw(600, -1.5)]), 0.8)
    assert (model.margin(draw(500, 1.5)) > 0).mean() > 0.95 and (model.margin(draw(500, -1.5)) < 0).mean() > 0.9


def test_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    for true in (0.3, 0.6, 0.9):
        good, bad = rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)
        n = int(2000 * true)
        unlabelled = np.concatenate([good[2000 : 2000 + n], bad[: 2000 - n]])
        assert abs(quality.estimate_prior(good[:2000], unlabelled, np.ones(2000)) - true) < 0.06


def test_cells_count_every_row_whatever_the_layout(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{rng.choice(['Word', 'x', '!!', '12'])}{rng.integers(9)}" for _ in range(rng.integers(1, 60))) for _ in range(900)] + ["copy"] * 300
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], EMPTY)
    found = []
    for parts in (1, 5):
        x = quality.feature_table(df.repartition(parts)).cache()
        n, mean, scale = quality.feature_moments(x)
        assert n == 1200 and np.allclose(mean, np.array([quality.text_features(t) for t in texts]).mean(0), atol=1e-5)
        rows, weight = quality.weighted_cells(x, mean, scale, per_cell=3)
        assert round(weight.sum()) == 1200 and len(rows) < 1200
        found.append((rows.tobytes(), weight.tobytes()))
    assert found[0] == found[1]


def test_fit_lowers_the_risk():
    """The risk written out falls, and its negative part does not go far below zero."""
    rng = np.random.default_rng(6)
    xp, xu = rng.normal(1, 1, (400, 4)), rng.normal(0, 1, (800, 4))
    m = quality.fit_nnpu(xp, xu, 0.4, steps=800)
    soft = lambda z: np.logaddexp(0, z)
    risk = lambda m: 0.4 * soft(-m.margin(xp)).mean() + max(0.0, soft(m.margin(xu)).mean() - 0.4 * soft(m.margin(xp)).mean())
    start = quality.fit_nnpu(xp, xu, 0.4, steps=0)
    assert risk(m) < 0.8 * risk(start) and soft(m.margin(xu)).mean() - 0.4 * soft(m.margin(xp)).mean() > -0.05


# --- 6: near duplicates


def brute_classes(texts: list[str], threshold: float = 0.8, saturation: float = 10.0) -> list[int]:
    """Classes by all pairs, from words, counts and logarithms alone."""
    from collections import Counter
    from math import log

    def grams(text: str) -> Counter:
        w = text.lower().split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    tf = [grams(t) for t in texts]
    distinct = {t: c for t, c in zip(texts, tf, strict=True)}
    df = Counter(g for c in distinct.values() for g in c)
    n = len(distinct)
    sets = [{g: (1 + log(k)) * log(1 + min(n / df[g], saturation)) for g, k in c.items()} for c in tf]

    def alike(a: dict, b: dict) -> float:
        low = sum(min(v, b[g]) for g, v in a.items() if g in b)
        high = sum(a.values()) + sum(b.values()) - low
        return low / high if high else 1.0

    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if top[i] != top[j] and alike(sets[i], sets[j]) >= threshold - 1e-12:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([5, 40, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 6])):
            for k in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words = [*words[:k], f"x{rng.randint(0, 9999)}", *words[k + 1 :]]
            texts.append(" ".join(words))
    texts += ["", "", "two words", "two words", "two  Words"]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY).repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert sum(got[k] != c for k, c in enumerate(want)) <= 1  # a band in ten thousand may be missed at the threshold


def hub_texts() -> list[str]:
    """A group with many pairs just below the threshold and some above it, among unrelated texts."""
    rng, texts = random.Random(3), []
    for _ in range(150):
        words = [f"w{k}" for k in range(60)]
        for k in rng.sample(range(60), rng.choice((1, 2))):
            words[k] = f"x{rng.randint(0, 99999)}"
        texts.append(" ".join(words))
    return texts + [" ".join(f"u{rng.randint(0, 10**7)}" for _ in range(20)) for _ in range(450)]


def test_failed_edges_do_not_hide_others(spark):
    texts = hub_texts()
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def test_large_groups_take_further_pivots(spark, monkeypatch):
    """Blocks of 4 make many blocks and rounds of pivots of the same groups."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = hub_texts()
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), EMPTY).repartition(5)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def test_common_shingles_weigh_less(spark):
    line = "all texts of this table start with this one line "
    texts = [line + " ".join(f"u{k}x{j}" for j in range(12)) for k in range(60)] + [line + " ".join(f"u{k}x{j}" for j in range(1, 13)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    d = df.select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("text_key")).cache()
    sets = neardup.shingled(d, 10.0).cache()
    found = neardup.frequent_shingles(sets, len(texts), 10.0)
    assert sorted(found.values()) == [80] * 6
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, threshold=0.6).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts, 0.6)


def test_equal_texts_count_once(spark):
    texts = ["one two three four five six"] * 500 + [" ".join(f"v{k}w{j}" for j in range(9)) for k in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), EMPTY).select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("text_key"))
    assert neardup.frequent_shingles(neardup.shingled(d, 10.0).cache(), 41, 10.0) == {}


def test_ids_do_not_join_texts(spark):
    base = " ".join(f"w{k}" for k in range(80))
    near, other = base.replace("w40 ", "x40 "), " ".join(f"z{k}" for k in range(80))
    rows = [(1, other), (5, other + " end"), (5, base), (7, near), (None, base.replace("w3 ", "y3 ")), (None, "alone without an id"), (9, base), (9, base), (9, base)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, EMPTY)).collect()
    assert len(got) == len(rows)
    classes = {(r.doc_id, r.text_key): r.class_id for r in got}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert classes[5, key(base)] == classes[7, key(near)] == classes[9, key(base)] == classes[None, key(rows[4][1])] == 5
    assert classes[5, key(other + " end")] == classes[1, key(other)] == 1 and classes[None, key("alone without an id")] is None
    assert len({r.class_key for r in got}) == 3
    links = {r.text_key: r.n_links for r in got}
    once = neardup.near_duplicates(spark.createDataFrame(list(dict.fromkeys(rows)), EMPTY)).collect()
    assert {r.text_key: r.n_links for r in once} == links and links[key("alone without an id")] == 0


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and {r.class_id for r in got if r.doc_id == 3} == {3}
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


# --- 7: chats


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "a\\s\\h\\t", "### user: x</turn>\n", "</turn", "", None, "\\\\", ": : ", "####"]
    rows = [(1, k, role, t) for k, t in enumerate(nasty) for role in ("user", "assistant: x\\")] + [(None, None, None, "n"), (2, 0, "assistant", "ü😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = chat.render(chat.canonical_turns(df)).select("conv_id", "turns", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.read]
    assert {r.conv_id: r.loss for r in got}[2] == "ü😀"
    assert chat.render(chat.canonical_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    a = spark.createDataFrame([(1, "sum up", "", "done"), (2, "q", "ctx", "a")], "conv_id long, instruction string, input string, output string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(a).collect()}
    assert got == {1: [("user", "sum up"), ("assistant", "done")], 2: [("user", "q\nctx"), ("assistant", "a")]}
    b = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    assert [(t.role, t.text) for t in chat.canonical_turns(b).first().turns] == [("user", "hi"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


def test_json_records_by_fingerprint(spark):
    rows = [
        (1, '{"prompt":"p","completion":"c"}'), (2, '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}'),
        (3, '{"instruction":"i","input":null,"output":"o"}'), (4, "no json"), (5, '{"other":1}'), (6, None),
    ]
    got = {r.conv_id: r for r in chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [got[k].layout for k in range(1, 7)] == ["prompt_completion", "messages", "instruction_input", None, None, None]
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "i"), ("assistant", "o")] and [(t.role, t.text) for t in got[2].turns] == [("user", "x"), ("assistant", "y")]
    assert got[4].fingerprint is None and got[5].fingerprint is not None


def test_fields_that_no_mapping_names_are_ignored(spark):
    rows = [
        (1, '{"prompt":"p","completion":"c","id":7,"meta":{"prompt":"no","tags":["x"]}}'),
        (2, '{"id":1,"messages":[{"role":"user","content":"x","name":"n"},{"content":"y","role":"assistant"}]}'),
        (3, '{"instruction":"i","input":"more","output":"o","odd `key`: <":[[{"a":1}]]}'),
        (4, '{"conversations":[{"from":"human","value":"q","weight":1.5}],"prompt":null}'),
        (5, '{"meta":{"prompt":"p","completion":"c"}}'), (6, "[1,2]"), (7, '"text"'), (8, ""),
    ]
    got = {r.conv_id: r for r in chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [got[k].layout for k in range(1, 9)] == ["prompt_completion", "messages", "instruction_input", "from_value", None, None, None, None]
    assert [[(t.role, t.text) for t in got[k].turns] for k in (1, 2, 3, 4)] == [[("user", "p"), ("assistant", "c")], [("user", "x"), ("assistant", "y")], [("user", "i\nmore"), ("assistant", "o")], [("user", "q")]]
    paths = {r.conv_id: r.p for r in spark.createDataFrame(rows, "conv_id long, record string").select("conv_id", chat.record_paths(F.col("record")).alias("p")).collect()}
    assert paths[1] == ["completion", "id", "meta", "meta.prompt", "meta.tags", "prompt"] and paths[3] == sorted(["input", "instruction", "odd `key`: <", "odd `key`: <[][].a", "output"]) and paths[6] == []


def test_long_chats(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"### {k} </turn>" * 20) for k in range(3000)]
    r = chat.render(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select("turns", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.read] and r.loss == "".join(t for _, _, role, t in rows if role == "assistant")


# --- 8: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_spans(text: str) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_pii_against_plain_patterns(spark, docs):
    rng = random.Random(6)
    made = ["".join(rng.choice(["a", "@", ".", "b-c", "1", "+", " ", "255", "4111 1111 1111 1111", "_x", "é", "😀", "0", "(", "\n"]) for _ in range(40)) for _ in range(300)]
    made += ["a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "00255.1.1.1", "256.1.1.1", "+1 (743) 555-3824 ", "4111-1111-1111-1111", "x" * 50_000 + "@", "9" * 50_000, ""]
    rows = [(k, t) for k, t in enumerate([t for _, t in docs] + made)]
    found = pii.scan(spark.createDataFrame(rows, EMPTY)).select("row.doc_id", "spans").collect()
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s.kind in PATTERNS] for r in found}
    secrets = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == "secret"] for r in found}
    for k, t in rows:
        assert got[k] == brute_spans(t)
        long = [m for m in re.finditer("[A-Za-z0-9_]+", t) if len(m[0]) >= 20]
        assert secrets[k] == [m.span() for m in long if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def brute_terms(texts: list[str], threshold: float = 0.9, support: int = 3, evidence: float = 12.0) -> list[list[tuple[int, int]]]:
    """Places of disclosing terms, from sets of words alone."""
    from collections import Counter
    from math import log

    import regex

    words, entities = [], []
    for t in texts:
        spans = brute_spans(t) + [("secret", *m.span()) for m in re.finditer("[A-Za-z0-9_]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        masked = list(t)
        for _, a, b in spans:
            masked[a:b] = " " * (b - a)
        words.append([(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"\p{L}[\p{L}\p{M}'-]{2,}", "".join(masked))])
        entities.append({(k, t[a:b].lower()) for k, a, b in spans if k != "secret"})
    once = list({t: (frozenset(w for w, _, _ in ws), es) for t, ws, es in zip(texts, words, entities, strict=True)}.values())
    n, n_t, n_e = len(once), Counter(w for ws, _ in once for w in ws), Counter(e for _, es in once for e in es)
    n_te = Counter((w, e) for ws, es in once for w in ws for e in es)
    pmi = lambda w, e: log(n * n_te[w, e] / n_t[w] / n_e[e])
    shown = {w for (w, e), k in n_te.items() if k >= support and n_e[e] < n and pmi(w, e) >= threshold * log(n / n_e[e]) and k * pmi(w, e) >= evidence}
    return [[(a, b) for w, a, b in ws if w in shown] for ws in words]


def test_terms_against_sets_of_words(spark, docs):
    rng = random.Random(8)
    names = [f"Name{chr(97 + i)}{chr(97 + j)}" for i in range(3) for j in range(10)]
    made = [f"{names[k % 30]} wrote {rng.choice('ab cd ef gh'.split())}xy to {names[k % 30].lower()}@example.org and {rng.choice(names[:3])}" for k in range(240)]
    texts = [t for _, t in docs] + made + [f"{n} was here alone" for n in names] + made[:50]
    want = brute_terms(texts)
    assert sum(map(bool, want)) > 200
    found = pii.all_spans(spark.createDataFrame(list(enumerate(texts)), EMPTY)).select("row.doc_id", "spans").collect()
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == "term"] for r in found}
    assert [got[k] for k in range(len(texts))] == want


def test_disclosing_terms_and_redaction(spark):
    texts = [f"call ZORBLAX the {w} agent at 10.1.2.3 about {w} and the {x}" for w, x in zip("abc def ghi jkl".split(), "uno dos tres quatro".split(), strict=True)]
    texts += [f"the server {a} runs the job {b} at 10.9.{k}.1 and the queue {c}" for k, (a, b, c) in enumerate([("qq", "rr", "ss"), ("tt", "uu", "vv"), ("ww", "xx", "yy")] * 6)]
    texts += [f"page {k} of a plain report" for k in range(100)] + ["ZORBLAX was here alone", "nothing to hide", None]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY).withColumns({"spans": F.lit(1), "row": F.lit("en"), "_pii_id": F.lit(2), "text_key": F.lit(3), "terms": F.lit(4)})
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert "ZORBLAX" not in got[0] and "<IP>" in got[0] and "10.1.2.3" not in got[0] and got[len(texts) - 2] == "nothing to hide" and got[len(texts) - 1] is None
    assert got[len(texts) - 3] == " was here alone"
    assert " the " in got[5] and "<IP>" in got[5]


def test_terms_are_found_far_from_the_entity(spark):
    fill = lambda k: " ".join(f"filler{chr(97 + k)}{chr(97 + i)}" for i in range(30))
    texts = [f"Mail zorblax@example.org now. {fill(k)}\nYours, ZORBLAX {fill(k)} Zorblax" for k in range(4)]
    texts += [f"Mail a{k}@example.org now. {fill(k)}\nYours, nobody" for k in range(5, 20)] + [f"page {k}" for k in range(100)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    for k in range(4):
        assert "zorblax" not in got[k].lower() and "Yours, " in got[k] and "Mail <EMAIL> now" in got[k] and got[k].count("filler") == 60
    assert "nobody" in got[9]


def test_words_of_clean_texts_are_no_terms(spark):
    texts = [f"The harbour office writes as q{k} from desk@example.org about {w}" for k, w in enumerate(["boats", "nets", "ropes", "masts"])]
    texts += [f"Some people wrote a note to a{k}@example.org" for k in range(8)] + [f"The harbour office opens on day {k}" for k in range(30)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    assert all("The harbour office " in got[k] for k in range(4))


def test_pii_odd_rows(spark, odd):
    assert pii.sanitise(odd).count() == len(ODD) and pii.sanitise(spark.createDataFrame([], EMPTY)).count() == 0


# --- 9: neighbours


def brute_nearest(rows, queries_, k):
    out = []
    for q, v in queries_:
        scored = sorted((-float((np.float64(v) * np.float64(x)).sum()), i) for i, x in rows if i != q)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


def test_neighbours_are_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:300] = x[5]
    x[300:320] *= 10
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [None, 1.0]), (9005, []), (None, [1.0] * 8), (9020, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=128, block_rows=16)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == brute_nearest(rows, rows[::20], 20)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_shards_are_pruned_and_extreme_vectors_found(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 6)) * 5
    x = np.concatenate([middle[k] + 0.05 * rng.normal(size=(60, 6)) for k in range(12)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5, (x[5] + 1).tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=40, block_rows=4).collect()]
    want = [(q, n + 1, s) for q, v in rows if q % 20 == 0 for n, s in enumerate(sorted((float(np.float64(v) @ np.float64(y)) for i, y in rows if i != q), reverse=True)[:20])]
    assert sorted((q, n) for q, n, _ in got) == sorted((q, n) for q, n, _ in want)
    assert np.allclose([s for *_, s in sorted(got)], [s for *_, s in sorted(want)])
    for size in (1e160, 1e-170):
        big = spark.createDataFrame([(k, (v * size).tolist()) for k, v in enumerate(x[:50])], "vec_id long, embedding array<double>")
        assert ann.nearest(big, big.where("vec_id = 0"), 5).count() == 5


def test_relaxed_search_keeps_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    pairs = lambda f: {(r.query_id, r.vec_id) for r in ann.nearest(v, q, 20, factor=f, shard_rows=256).collect()}
    exact = pairs(1.0)
    assert len(exact & pairs(1.3)) >= 0.9 * len(exact)


# --- 10: archives


def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\ny WARC/1.1\r\n", "é😀" * 5000, "\0", "unique", "<p>a</p>"]
    rows = [(k, f"https://www.b{k % 3}.example.org/p?q={k} ü", h) for k, h in enumerate(html)] + [(50, None, "n"), (51, "not a url", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    last = {h or "": max(i for i, _, g in rows if (g or "") == (h or "")) for _, _, h in rows}
    for i, url, h in rows:
        data, keeper = (h or "").encode(), last[h or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == keeper else ("revisit", keeper))
        assert r.html == ((h or "") if i == keeper else None) and r.url == url
    none = {r.page_id: r.record_type for r in warc.round_trip(df, min_bytes=5).collect()}
    assert none[2] == none[3] == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_odd_urls_and_repeated_pages(spark):
    urls = ["http://[abc/x", "", "http://a.org/x%20y", "http://a.org/x y", "urn:page:5", "http://a.org:99999/", "\t\n", "//", "http://", "a\\b"]
    rows = [(k, u, f"text {k}") for k, u in enumerate(urls)] + [(60, "http://r.org/", "one"), (60, "http://r.org/", "two"), (61, "http://s.org/", "same"), (61, "http://s.org/", "same"), (None, "http://t.org/", "lost")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.html) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted(rows, key=str)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 7}.org/{k}", rng.randbytes(rng.choice((10, 3000, 90_000))).hex()) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = warc.write_archives(warc.plan_records(df), file_bytes=100_000)
    found = warc.captures(spark, folder).cache()
    ends = found.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("size"), F.max("length").alias("most")).collect()
    assert len(ends) > 10 and all(r.size < 100_000 + r.most for r in ends)
    assert {(r.page_id, r.html) for r in warc.read_captures(found).collect()} == {(i, h) for i, _, h in rows}


def test_large_members_end_in_zero():
    data = random.Random(0).randbytes(1 << 20) * 17
    out = warc.member(data)
    import gzip

    assert out[-1] == 0 and gzip.decompress(out) == data


@pytest.mark.parametrize("cuts", [4096, 5, 0])
def test_lookup_spans_blocks_and_segments(spark, monkeypatch, cuts):
    monkeypatch.setattr(warc, "TOP_CUTS", cuts)
    rows = [(f"org,a)/{k // 40:03d}", "f", k, 1) for k in range(400)]
    found = spark.createDataFrame(rows, "key string, file string, offset long, length long")
    index = warc.build_index(found, block_lines=7, segment_blocks=2)
    keys = spark.createDataFrame([("org,a)/003",), ("org,a)/009",), ("org,zz",)], "key string")
    got = sorted((r.key, r.offset) for r in warc.lookup(index, keys).collect())
    assert got == [("org,a)/003", k) for k in range(120, 160)] + [("org,a)/009", k) for k in range(360, 400)]


# --- pipeline


def test_pipeline_stages_odd_rows(spark, sf_dir, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = odd.withColumn("source", F.lit("s"))
    kept = d
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns and stage(spark, d.limit(0), sf_dir).count() == 0
        if name == "near_dedup":
            kept = out
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5] and ids.count(None) == 1
    assert pipeline.STAGES[-1][1](spark, kept, sf_dir).count() > 3


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out.cache()
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] > 0
    assert not any(brute_spans(r.text) for r in docs.collect())
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == kept[2]


def test_batches_to_workers_are_bounded_by_bytes(spark):
    from millrace.llm.memory import BATCH_BYTES, BATCH_CONF
    from millrace.llm.packing import token_pieces
    from millrace.llm.quality import score_texts

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    was = spark.conf.get(BATCH_CONF)
    try:
        spark.conf.set(BATCH_CONF, "64m")
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
        assert score_texts(docs, None).count() == 3000  # 12 MB of text, which was one batch
        seen = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in seen) == 3000 and max(r.bytes for r in seen) <= 1.1 * BATCH_BYTES
        spark.conf.set(BATCH_CONF, "100k")  # a smaller limit stays
        token_pieces(docs, "none")
        assert spark.conf.get(BATCH_CONF).startswith("100k") or spark.conf.get(BATCH_CONF).startswith(str(100 << 10))
    finally:
        spark.conf.set(BATCH_CONF, was)
