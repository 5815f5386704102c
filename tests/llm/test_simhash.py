"""SimHash groups against all pairs on small fixtures."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gradelake.llm import near_copies, simhash
from gradelake.llm.components import components


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", None, "One", "a b", "A\tB c\u00a0d", "É è É"] + [" ".join(rng.choices("ab cd EF gh ij".split(), k=n)) for n in (3, 9, 200)]
    for t in texts:
        assert simhash.text_fingerprint(t, 3) == signed(brute_fingerprint(t))
    long = " ".join(rng.choices([f"w{i}" for i in range(50)], k=70_000))
    assert simhash.text_fingerprint(long, 3) == signed(brute_fingerprint(long))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, n) for n in range(200, 260)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    frame = spark.createDataFrame([*pairs, (7, 7), (None, 3), (160, 100)], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    nodes = {n for p in pairs for n in p}
    want = brute_components(pairs, nodes)
    assert {n: want[n] for n in got} == got and all(want[n] == n for n in nodes - set(got))
    assert components(frame.limit(0)).count() == 0


def test_links_with_and_without_crowded_segments(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    codes = set(base)
    for b in base:
        for _ in range(12):
            codes.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.choice((1, 2, 2, 3)))))
    codes = sorted(codes)
    pairs = [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2]
    want = brute_components(pairs, codes)
    frame = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    whole = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(frame, crowded=10**6).collect()}
    assert whole == {tuple(sorted(p)) for p in pairs}
    few = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame, crowded=2).collect()]
    assert brute_components(few, codes) == want and all((a ^ b).bit_count() <= 2 for a, b in few)


def test_groups(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(5, text, "x"), (3, text.upper(), None), (9, text, "y"), (None, text, "z"), (4, None, ""), (8, "", ""), (2, "entirely other words stand in this one here", ""), (2, "entirely other words stand in this one here", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, code string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.groups(frame).collect())
    assert got == [(-1, 3), (2, 2), (2, 2), (3, 3), (4, 4), (5, 3), (8, 4), (9, 3)]
    assert simhash.groups(frame.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.groups(alone).collect()] == [None, None]


def test_near_copies(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(6):
        base, first = fresh(300), 100 * g
        want.add(first)
        rows += [(first, " ".join(base)), (first + 1, " ".join(base).upper().lower())]
        for i in range(2, 40):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(300)] = "changed"
            rows.append((first + i, " ".join(copy)))
    rows += [(5000 + i, " ".join(fresh(120))) for i in range(40)]
    want |= {5000 + i for i in range(40)}
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, "alone here"), (7, rows[0][1]), (0, rows[0][1])]
    want |= {9000}
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, slots string")
    kept = near_copies.keep_one(frame)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame.columns and len(ids) == len(set(ids)) and set(ids) == want | {None}
    assert near_copies.keep_one(frame.limit(0)).count() == 0


def test_only_candidates_are_fingerprinted_again(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([(1, words), (2, words + " more"), (3, "never read")], "key long, text string")
    first = texts.where("key < 3").select(F.col("key").alias("id"), F.col("key").alias("least"), near_copies.coded(F.col("text")).alias("f")).select("id", "least", "f.*")
    pairs = spark.createDataFrame([(1, 2, 1, 2)], "a long, b long, la long, lb long")
    plain = near_copies.coded
    guard = lambda text, *args, **named: plain(F.when(text == "never read", F.raise_error(F.lit("read")).cast("string")).otherwise(text), *args, **named)
    codes = near_copies.staged(first, "codes")
    monkeypatch.setattr(near_copies, "coded", guard)
    assert [tuple(r) for r in near_copies.alike(pairs, codes, texts).collect()] == [(1, 2)]


def test_lookups_find_long_texts_at_the_border_at_any_width(monkeypatch):
    """Of long texts whose sets are similar by 0.8, nearly all meet in a band, however wide the segments are."""
    rng = np.random.default_rng(4)
    for width in (18, 26):
        missed = 0
        for _ in range(150):
            hashes = rng.integers(0, 2**64, 667, dtype=np.uint64)
            slots = []
            for some in (np.sort(hashes[:600]), np.sort(hashes[67:])):
                monkeypatch.setattr(near_copies, "_votes", lambda *_, h=some: (np.zeros(near_copies.WIDTH, np.int64), h))
                slots.append([x for x in near_copies.text_code("x", width=width)[1].tolist() if x < 0])
            missed += not set(slots[0]) & set(slots[1])
        assert missed <= 1
    assert near_copies.segment(200) == 18 and near_copies.segment(10**6) + 3 == near_copies.segment(8 * 10**6)


def test_near_copies_by_exact_similarity(spark):
    """Copies at Jaccard 0.8 are found, also among short texts, and texts below it stay."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(60):
        nine, eight, long, most = fresh(9), fresh(8), fresh(204), fresh(204)
        texts = [nine, nine[:8], eight, eight[:7] + fresh(2), long, long[:169] + fresh(35), most, most[:184] + fresh(20)]
        rows += [(10 * g + i, " ".join(t)) for i, t in enumerate(texts)]
        want |= {10 * g + i for i in (0, 2, 3, 4, 5, 6)}  # 4 of 5, 3 of 6, 165 of 235, 180 of 220 shingles are common
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == want


def test_lookups_that_meet_nothing_carry_nothing(spark):
    """Only lookups that meet another code go on, and of pairs only those whose counts leave the similarity possible."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two = fresh(200), fresh(200)
    texts = [*(" ".join(fresh(200)) for _ in range(100)), " ".join(one), " ".join(one[:-1]), " ".join(two), " ".join(two[:60] + fresh(140))]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    codes = near_copies.staged(rows.select(F.col("key").alias("id"), F.col("key").alias("least"), near_copies.coded(F.col("text")).alias("f")).select("id", "least", "f.*"), "codes")
    met = near_copies.meetings(codes)
    assert met.columns == ["id", "slot", "own", "pivot", "n"] and met.where("id in (100, 101) and id <> pivot and own").count() > 0
    assert met.count() * 10 < codes.select(F.sum(F.size("slots"))).first()[0]
    sets = near_copies.gram_sets(codes.select("id"), codes, rows)
    assert sorted((r.id, r.n) for r in sets.collect()) == [(i, len(t.split()) - 4) for i, t in enumerate(texts)]
    # Without its shingles no pair can be confirmed, so a null list would raise none but lose the link.
    bare = near_copies.staged(sets.withColumn("grams", F.when(F.col("id") < 102, F.col("grams"))), "bare")
    pairs = spark.createDataFrame([(101, 100, 101, 100), (103, 102, 103, 102)], "a long, b long, la long, lb long")
    assert [tuple(r) for r in near_copies.alike(pairs, codes, rows, sets=bare).collect()] == [(101, 100)]


def test_counts_bound_what_two_texts_share():
    rng = np.random.default_rng(6)
    for n in (1, 50, 3000):
        hashes = np.sort(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        a, b = rng.choice(hashes, n, replace=False), rng.choice(hashes, n, replace=False)
        bound = np.minimum(near_copies.spread(a.view(np.int64)), near_copies.spread(b.view(np.int64))).astype(int).sum()
        assert len(np.intersect1d(a, b)) <= bound <= n
    assert near_copies.spread(np.arange(200, dtype=np.int64)) is None
    assert near_copies.spread(np.zeros(0, np.int64)).tolist() == [0] * near_copies.PARTS


def test_short_texts_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """Texts with one passage in common are no candidates of each other, whatever their number; copies among them are found."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(10 * i, passage + fresh(40)) for i in range(80)]
    rows += [(10 * i + 1, rows[i][1][:97]) for i in range(0, 80, 8)] + [(10 * i + 2, rows[i][1] + fresh(20)) for i in range(1, 80, 8)]
    seen, plain = [], near_copies.alike

    def counted(pairs, *args, **named):
        seen.append(pairs.distinct().count())
        return plain(pairs, *args, **named)

    monkeypatch.setattr(near_copies, "alike", counted)
    kept = near_copies.keep_one(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {10 * i for i in range(80)}
    assert sum(seen) < 3 * len(rows)


def test_rarest_shingles_meet_every_similar_pair(spark):
    rng = np.random.default_rng(7)
    common, sets = rng.integers(0, 2**63, 60), []
    for _ in range(60):
        own = np.concatenate([common[: rng.integers(20, 60)], rng.integers(0, 2**63, rng.integers(5, 60))])
        sets += [own, np.concatenate([own[rng.random(len(own)) < 0.93], rng.integers(0, 2**63, 3)])]
    sets = [np.unique(s).tolist() for s in sets]
    met = near_copies.rare_meetings(spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "id long, n int, grams array<long>")).collect()
    slots = {}
    for r in met:
        slots.setdefault(r.slot, []).append(r)
    need = lambda a, b: 0.8 / 1.8 * (a.size + b.size) - 1e-9
    found = {(min(a.id, b.id), max(a.id, b.id)) for rows in slots.values() for a in rows for b in rows if a.own and a.id != b.id and min(a.left, b.left) >= need(a, b)}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if share(sets[i], sets[j]) >= 0.8}
    assert len(want) > 30 and want <= found and len(found) < 10 * len(want)
