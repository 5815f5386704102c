"""Tokens, languages, lines, fingerprints and scores against plain versions."""

import collections
import hashlib
import math
import pickle
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gradelake.llm import bpe, fixity, langid, lm_scoring, maxent, site_lines, winnowing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_matches_and_returns(spark, reference):
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(0)
    alphabets = ["ab ", "aaaé ñ \n\t", "thers ing", "中文 x", "😀 12.a'll", "   \n"]
    texts = ["", *("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(60))) for _ in range(1500)), "a" * 30_000, "".join(rng.choices("abcdefgh", k=30_000)), "ab" * 20_000]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t) and codec.decode(ids) == t.encode()
    assert not any(codec.bitmap)
    assert codec.encode(None) == b"" == codec.decode(None)
    frame = spark.createDataFrame([(1, "some text", "x"), (1, "some text", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    tokenizer = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    got = frame.select("doc_id", "text", tokenizer.encode(F.col("text")).alias("n")).withColumn("back", tokenizer.decode(F.col("n"))).select("*", bpe.count(F.col("n")).alias("k")).collect()
    assert all(bytes(r.back) == (r.text or "").encode() and r.k == len(reference.encode_ordinary(r.text or "")) for r in got) and len(got) == 4
    assert frame.limit(0).select(tokenizer.encode(F.col("text"))).count() == 0


def test_bpe_merges_unknown_pieces_together_and_remembers_them(spark, reference, monkeypatch):
    """Pieces in one queue don't meet across their fences, and a worker's next task finds them merged."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh\u00e9", k=rng.randrange(1, 70))) for _ in range(40)) for _ in range(60)] + [None, ""]
    for name, value in (("LOT", 64), ("TOGETHER", 500), ("REMEMBERED", 300)):
        monkeypatch.setattr(bpe, name, value)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == [reference.encode_ordinary(t or "") for t in texts]
    assert not any(codec.bitmap) and max(map(len, codec.young)) <= bpe.REMEMBERED_CHARS
    # A merge that makes a pair of a lower rank comes before the rest of its own rank.
    odd = bpe.Codec({b"a": 0, b"b": 1, b"abca": 2, b"abc": 3, b"ab": 4, b"c": 5}, ".+")
    assert odd.merge([b"abcab", b"abab", b"cab"]) == [np.array(x, "<u4").tobytes() for x in ([2, 1], [4, 4], [5, 4])]
    monkeypatch.undo()
    tokenizer = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(1)
    got = frame.select("text", tokenizer.round_trip(F.col("text")).alias("b")).select("text", "b.*").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "") for r in got)
    sent = pickle.loads(pickle.dumps(codec))
    assert not sent.young and sent.encode_all(texts) == codec.encode_all(texts)


def test_shares_in_blocks_match_plain_softmax(monkeypatch):
    """Shares, also of scores far beyond the range of exponentials, and draws by them."""
    monkeypatch.setattr(maxent, "BLOCK", 7)
    rng = np.random.default_rng(3)
    n = 60
    hashes, cls = rng.integers(0, 2**32, n).astype(np.uint32), rng.integers(0, maxent.CLASSES, n).astype(np.int32)
    member = np.where(cls < maxent.HEAD_CLASSES, rng.integers(0, maxent.MEMBERS, n), -1).astype(np.int32)
    for scale in (1.0, 300.0):
        w = maxent.Tables(*(rng.normal(size=p.shape, scale=scale).astype(np.float32) for p in maxent.Tables.zeros().parts()))
        (_, b), = maxent.batches(hashes, cls, member, np.array([0, 25]))
        z = sum(w.classes[t][b.rows[t]].astype(float) for t in range(maxent.CLASS_TEMPLATES)) + w.class_bias
        share = z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        want = share[np.arange(n), cls]
        at = np.flatnonzero(member >= 0)
        rows = b.member_rows(at)
        z = sum(w.members[t][rows[t]].astype(float) for t in range(maxent.MEMBER_TEMPLATES)) + w.member_bias[cls[at]]
        inner = z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        want[at] += inner[np.arange(len(at)), member[at]]
        shown = want > -80  # beyond single precision a share is zero
        with np.errstate(divide="ignore"):
            assert np.allclose(maxent.log10_shares(w, b)[shown], want[shown] / math.log(10), atol=1e-3 * scale)
    drawn = maxent._drawn(iter([(slice(0, 3), np.array([[0, 1, 0, 1]] * 3, np.float32))]), 3, np.random.default_rng(1))
    assert drawn.tolist() == [1 if x <= 0.5 else 3 for x in np.random.default_rng(1).random(3, dtype=np.float32)]


def test_word_facts_match_plain_loop():
    vocabulary = lm_scoring.Vocabulary(900, 9, 50, {b"the": 1, b"of": 40}, {2: maxent.spread({1: 3, 2: 1})}, {c: 500 + c for c in range(maxent.CLASSES)})
    words = [f"w{i}".encode() for i in range(200)] + [b"the", b"of"]
    counts = np.array([i % 60 for i in range(202)])
    got = vocabulary.info(words, counts)
    assert got[0].tolist() == (maxent.word_hash(b"\n"), 0, 0, 0.0, 50)
    for word, count, row in zip(words, counts.tolist(), got[1:], strict=True):
        cls, member, share = maxent.HEAD_CLASSES + sum(count > x for x in maxent.BANDS) * maxent.ENDINGS + maxent.ending(word), -1, 1.0
        if word in vocabulary.head:
            cls, member = divmod(vocabulary.head[word], maxent.MEMBERS)
        elif count > maxent.BANDS[0]:
            share = count / vocabulary.mass[cls]
        else:
            unknown, known = vocabulary.rare.get(maxent.ending(word)) or maxent.spread({})
            share = known[count] if count else unknown
        assert row.tolist() == (maxent.word_hash(word), cls, member, np.float32(np.log10(share)), count)


def test_windows_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 508, 509, 510, 5000):
        text = "".join(random.Random(n).choices("abc", k=n))
        found = langid.windows(text)
        assert found.shape[1] == langid.WINDOW
        grams = {bytes(w[i:i + 4]) + b"%d" % (k * langid.STEP + i) for k, w in enumerate(found) for i in range(langid.WINDOW - 3)}
        assert all(text[i:i + 4].encode() + b"%d" % i in grams for i in range(n - 3))


def test_language(spark):
    rng = random.Random(3)
    speech = {"xx": "ka ko ti ta no".split(), "yy": "sch ung ein der zu".split()}
    make = lambda lang, n: "".join(rng.choice(speech[lang]) + rng.choice(["", "", " "]) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(3, 400)), lang, "q") for i in range(400) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(900, None, "xx", "q"), (901, "123 !?", "yy", "q"), (902, "", None, "q"), (None, make("xx", 50), None, "q"), (903, make("yy", 30_000), None, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = langid.learn(frame, ~langid.held_out(F.col("doc_id")))
    found = langid.predict(frame, net).select("doc_id", "text", "lang", "score", "language.*", langid.held_out(F.col("doc_id")).alias("held"))
    got = found.toDF("doc_id", "text", "truth", "old", "lang", "p", "held").collect()
    assert {r.lang for r in got if r.doc_id in (900, 901, 902)} == {"und"} and all(0 <= r.p <= 1 for r in got)
    held = [r for r in got if r.held and r.truth and r.text and r.doc_id < 900]
    assert len(held) > 40 and sum(r.lang == r.truth for r in held) >= 0.97 * len(held)
    assert [r.lang for r in got if r.doc_id is None] == ["xx"] and [r.lang for r in got if r.doc_id == 903] == ["yy"]
    block = langid.windows(rows[0][1])
    assert np.allclose(net.log_odds(net.pooled(block)[0]), langid.Predictor(net).windows_log_odds(block), atol=1e-4)
    empty = frame.limit(0)
    assert langid.learn(empty, F.lit(True)).languages == [] and langid.predict(empty, net).count() == 0
    assert {r[0] for r in langid.predict(frame, langid.Network.random([])).select("language.lang").collect()} == {"und"}


def test_site_lines(spark):
    rows = [(i, "s", "top\n\nown %d\ntop\n tail " % i, 1) for i in range(20)] + [(30 + i, "t", "top\nx%d" % i, 1) for i in range(2)]
    rows += [(50, None, "top", 1), (51, "s", None, 1), (52, "s", "", 1), (53, "s", "top", 1), (53, "s", "top", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, common int")
    for spare in (False, True):
        got = site_lines.drop_lines(frame, F.col("source"), site_lines.text_lines(F.col("text")), ratio=0.5, spare_whole=spare).collect()
        assert len(got) == len(rows)
        for r in got:
            lines = (r.text or "").split("\n")
            want = [x for x in lines if x not in ("top", " tail ")] if r.source == "s" else lines
            chars = [sum(len(x.strip(" ")) for x in some) for some in (want, lines)]
            if spare and chars[0] < (1 - site_lines.SPARED) * chars[1]:
                want = lines
            assert r.lines == want and r.lines_dropped == len(lines) - len(want)
    assert site_lines.drop_lines(frame.limit(0), F.col("source"), site_lines.text_lines(F.col("text"))).count() == 0


def plain_marks(text, k=winnowing.GRAM, w=winnowing.WINDOW, hashed=None):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    grams = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    hashes = [hashed[g] for g in grams]
    chosen = []
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[i:i + w]
        best = max(j for j, h in enumerate(window) if h == min(window))
        if (hashes[i + best], i + best) not in chosen:
            chosen.append((hashes[i + best], i + best))
    return chosen


def test_winnowing(spark):
    rng = random.Random(8)
    texts = [None, "", " \n ", "one", "a b c d", "A b C d e"] + [" ".join(rng.choices("ab cd ef".split(), k=n)) for n in (6, 8, 9, 30, 300)]
    k = winnowing.GRAM
    grams = {g for t in texts for words in [(t or "").lower().split()] for g in ([tuple(words[i:i + k]) for i in range(len(words) - k + 1)] or [tuple(words)]) if g}
    frame = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    one = frame.select("g", winnowing.hash_of(F.element_at(winnowing.marks(F.array_join("g", " ")), 1)).alias("h")).collect()
    hashed = {tuple(r.g): r.h for r in one}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.transform(winnowing.marks(F.col("t")), lambda m: F.struct(winnowing.hash_of(m), winnowing.position_of(m))).alias("m")).collect()
    for r in got:
        assert [tuple(x) for x in r.m] == plain_marks(texts[r.i], hashed=hashed)


def test_next_documents(spark):
    rows = [(i * 7 % 101, f"text {i} " * (i % 5), "x") for i in range(60)] + [(None, "no key", None), (3000, None, None), (5, "same key", None), (5, "same key", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = sorted((-1 if r[0] is None else r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order))
    for part in (frame, frame.repartition(7)):
        got = winnowing.with_next(part)
        assert sorted((r.key if r.key is not None else -1, r.text, r.next_text) for r in got.collect()) == want
    alone = spark.createDataFrame([(4, "only one")], "doc_id long, text string")
    assert [(r.text, r.next_text) for r in winnowing.with_next(alone).collect()] == [("only one", "only one")]
    assert winnowing.with_next(frame.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert sorted((r.text, r.next_text) for r in winnowing.with_next(nulls).collect()) == [("a", "b"), ("b", "a")]


def test_likeness_and_edit(spark):
    r = spark.sql("select 'abcdefgh' t, 'XY' u, '' e").select(
        winnowing.edited(F.col("t"), F.col("u")), winnowing.edited(F.col("e"), F.col("u")), winnowing.edited(F.col("u"), F.col("t")),
        winnowing.likeness(winnowing.marks(F.col("t")), winnowing.marks(F.col("t"))), winnowing.likeness(winnowing.marks(F.col("e")), winnowing.marks(F.col("e"))),
        winnowing.likeness(winnowing.marks(F.col("t")), winnowing.marks(F.col("u"))),
    ).first()
    assert tuple(r) == ("abcdefXY", "", "XY", 1.0, 1.0, 0.0)


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SPAN", 64)
    monkeypatch.setattr(fixity, "FAN", 3)
    rows = [(f, 40 * i, 40, hashlib.sha256(b"%d %d" % (f, i)).hexdigest()) for f in range(4) for i in range(50)]
    other = [list(r) for r in rows if r[:2] not in ((1, 400), (2, 0))]
    changed = {(0, 1960), (1, 800), (1, 840)}
    for r in other:
        if tuple(r[:2]) in changed:
            r[3] = "0" * 64
    other += [[2, 5000, 7, "1" * 64], [9, 0, 7, "2" * 64], [9, 0, 7, "2" * 64]]
    schema = "file long, offset long, length long, digest string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    got = sorted((r.file, r.offset, r.state) for r in fixity.audit(a, b).collect())
    assert got == sorted([(f, o, "altered") for f, o in changed] + [(1, 400, "missing"), (2, 0, "missing"), (2, 5000, "extra"), (9, 0, "extra")])
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), b.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a", "é", 0), (2, None, None, 0), (None, "u", "x", 0), (None, "u", "x", 0), (300, "u", "x" * 1000, 0)], "page_id long, url string, html string, offset int")
    laid = fixity.manifest(pages, "page_id", fixity.record(F.col("url"), F.col("html"))).collect()
    assert len(laid) == 5 and [r.offset for r in sorted(laid, key=lambda r: r.page_id or 0) if r.page_id == 2] == [r.length for r in laid if r.page_id == 1]
    assert {r.file for r in laid if r.page_id is None} == {r.file for r in laid if r.file < 0}


def test_scores(spark):
    rng = random.Random(9)
    tongues = [[f"{c}{rng.randrange(400)}" for _ in range(300)] for c in "abc"]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(tongues[i % 3][:10] * 12 + tongues[i % 3], k=rng.randrange(5, 200))), "x") for i in range(240)]
    rows += [(500, None, None), (501, "", None), (502, "a\tb c É", None), (502, "a\tb c É", None), (None, "a1 a2", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm_scoring.score(frame).collect()
    cut = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").replace("\t", " ").split(" ") if w] + ["\n"]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = collections.Counter(w for i, t, _ in rows if not held(i) for w in cut(t))
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter((i, held(i), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in cut(t)), 6)) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    away = [r for r in got if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)
    assert lm_scoring.score(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 40, 200])
def test_scores_of_few_texts_in_many_partitions(spark, parts):
    """Tasks without a text, without one to learn from, and without one of the current step."""
    rows = [(i, "one two three " * (i % 4), 1) for i in range(60)]
    found = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts)).collect()
    assert sorted(r.doc_id for r in found) == list(range(60)) and all(r.score < 0 for r in found)
    assert {r.train_tokens for r in found} == {sum(len(t.split()) + 1 for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2)}


def test_scores_with_held_out_texts_only_or_a_single_one(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    only = lm_scoring.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert len(only) == len(held) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in only)
    one = lm_scoring.score(spark.createDataFrame([(held[0] + 1, "some words")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known) for r in one] == [(3, 3 if not one[0].held_out else 0)]


def test_shares_sum_to_one():
    rng = np.random.default_rng(1)
    w = maxent.Tables(*(rng.normal(size=p.shape).astype(np.float32) for p in maxent.Tables.zeros().parts()))
    hashes = rng.integers(0, 2**32, 6, dtype=np.uint32)
    total = 0.0
    for cls in range(maxent.CLASSES):
        for member in range(maxent.MEMBERS) if cls < maxent.HEAD_CLASSES else (-1,):
            c, m = np.full(6, cls, np.int32), np.full(6, member, np.int32)
            total += 10 ** maxent.log10_shares(w, next(maxent.batches(hashes, c, m, np.array([0])))[1])[5]
    assert abs(total - 1) < 1e-4
    counts = {1: 50, 2: 20, 3: 9, 4: 5}
    unknown, known = maxent.spread(counts)
    assert abs(unknown + sum(known[r] * n for r, n in counts.items()) - 1) < 1e-9
