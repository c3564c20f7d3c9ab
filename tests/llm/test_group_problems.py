"""Problems 2, 6, 8, 9: operators over groups and pairs, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import dedup, leaks, mixing, splits
from quernstone.operators import skew


# ------------------------------------------------------------------ problem 2
def test_canonical():
    same = lambda a, b: dedup.fingerprint(dedup.canonical(*a)) == dedup.fingerprint(dedup.canonical(*b))
    assert same(("The  Filter,\nkept!", " Benign."), ("the filter kept", "benign"))
    assert same(('{"a": "x y", "n": 12}', "l"), ('{"n":12,"a":"X  Y!"}', "L")) and same(("a: x y; n: 12", "l"), ("n : 12 ;  a : X Y", "l"))
    assert same(("a: x\nb: y", "l"), ('{"b": "y", "a": "x"}', "l"))
    assert not same(("limit 7.5", "l"), ("limit 75", "l")) and not same(("résumé", "l"), ("resume", "l")) and not same(("a b", "l"), ("a b", "k"))
    assert not same(('{"a": "x", "b": "y"}', "l"), ('{"a": "y", "b": "x"}', "l")) and same((None, None), ("", ""))
    assert same(('{"a": {"x": 1, "y": [2, {"p": 3, "q": 4}]}}', "l"), ('{"a": {"y": [2, {"q": 4, "p": 3}], "x": 1}}', "l")) and not same(('{"a": [1, 2]}', "l"), ('{"a": [2, 1]}', "l"))
    assert not same(('{"a": {"x": 1}, "b": {}}', "l"), ('{"a": {}, "b": {"x": 1}}', "l")) and not same(('{"a": {"x": 1}}', "l"), ('{"a x": 1}', "l"))
    assert same(("note: see section: four; a: b", "l"), ("a: b; note: see section: four", "l")) and same((f"{'n' * 60}: x | a: b", "l"), (f"a: b | {'n' * 60}: x", "l"))


def test_copies_hot_group(spark):
    rows = [(f"h{i:05d}", "Hot  text!" if i % 2 else "hot text", "x") for i in range(3000)] + [("z1", "other one", "x"), ("z0", "OTHER ONE.", "x"), ("n1", None, None), ("n2", "", ""), ("u", "single", "x"), ("v", "y" * 500_000, "x")]
    df = spark.createDataFrame(rows, "id string, text string, label string").withColumn("fp", F.lit("clash")).repartition(5)
    got = {tuple(r) for r in dedup.copies(dedup.keyed(df)).collect()}
    assert got == {("h00000", f"h{i:05d}") for i in range(1, 3000)} | {("z0", "z1"), ("n1", "n2")}
    assert dedup.copies(dedup.keyed(df.limit(0))).count() == 0
    pairs = dedup.copies(dedup.keyed(df.union(df)))
    assert {(r.id, r.n_copies) for r in dedup.groups(df, pairs).collect()} == {("h00000", 3000), ("z0", 2), ("n1", 2), ("u", 1), ("v", 1)}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(skew, "ROWS_PER_TASK", 100)
        assert {tuple(r) for r in dedup.copies(dedup.keyed(df)).collect()} == got


# ------------------------------------------------------------------ problem 6
VOCAB = [f"w{i}" for i in range(400)]


def _edit(rng, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[i] = rng.choice(VOCAB)
        elif kind < 0.7:
            del out[i]
        else:
            out.insert(i, rng.choice(VOCAB))
    return out


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = [rng.choice(VOCAB) for _ in range(rng.randrange(6, 70))]
        rows.append((f"t{i}", " ".join(base), "train", "a"))
        rows.append((f"v{i}", " ".join(_edit(rng, base, rng.choice((0, 0.05, 0.1, 0.15, 0.3, 0.6)))).upper() + "!", "val", "b"))
    rows += [("x1", "Look аlike, fulｌ text here now", "train", "a"), ("x2", "look alike full text here NOW", "val", "b"), ("n", None, "val", "b"), ("e", "", "train", "a"), ("o", "other split", "test", None), ("q", "look alike full text here now", None, "a")]
    df = spark.createDataFrame(rows, "example_id string, text string, split_name string, source string").withColumn("cls", F.lit(0))
    w = {i: splits.canonical_words(t) for i, t, s, _ in rows}
    want = {(v, t) for v, _, s, _ in rows if s == "val" for t, _, r, _ in rows if r == "train" and w[v] and w[t] and splits.near(w[v], w[t])}
    got = {(r.val_id, r.train_id) for r in splits.overlaps(df).collect()}
    assert got == want and ("x2", "x1") in got and len(want) > 35
    assert splits.overlaps(df.limit(0)).count() == 0
    assert splits.report(splits.overlaps(df)).agg(F.sum("n_pairs")).first()[0] == len(want)


def test_lcs():
    assert splits.lcs("a b c d".split(), "a x c d".split()) == 3 and splits.lcs([], ["a"]) == 0 and splits.near("a b c d".split(), "a b c".split())


def test_splits_meet_every_near_pair(spark):
    """Words changed at every fourth place or at random, of any length: both routes give what all pairs give."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        n = rng.choice((1, 2, 3, 4, 5, 7, 8, 12, 16, 20, 24, 40, 60))
        w = [rng.choice(VOCAB) + str(rng.randrange(3)) for _ in range(n)]
        x = [f"c{k}" if k % 4 == 3 else v for k, v in enumerate(w)]
        y = list(w)
        for k in rng.sample(range(n), n // 4):
            y[k] = f"d{k}"
        z = [v for k, v in enumerate(w) if k % 8 != 3]
        z.insert(len(z) // 2, "extra")
        rows += [(f"v{i}", " ".join(w), "val", "s")] + [(f"t{i}{a}", " ".join(t), "train", "s") for a, t in (("x", x), ("y", y), ("z", z))]
    df = spark.createDataFrame(rows, "example_id string, text string, split_name string, source string")
    val, train = ([(i, splits.canonical_words(t)) for i, t, s, _ in rows if s == k] for k in ("val", "train"))
    want = {(a, b) for a, v in val for b, t in train if splits.near(v, t)}
    assert {tuple(r) for r in splits.overlaps(df).select("val_id", "train_id").collect()} == want and len(want) > 300
    for n in range(1, 200):
        m = np.arange(-(-3 * n // 4), 4 * n // 3 + 1)
        assert splits.least_over_partners(np.array(n)) == splits.least_common(np.array(n), m).min()
    seen = np.zeros(splits.SLOTS, np.int64)
    hs, own = splits.pieces([t for _, t in train])
    np.add.at(seen, (hs % np.uint64(splits.SLOTS)).astype(np.int64), 1)
    few, all_ = ({}, {})
    for name, rows_ in (("v", val), ("t", train)):
        for into, (h, o) in ((all_, splits.pieces([w for _, w in rows_])), (few, splits.rare([w for _, w in rows_], seen))):
            for x, k in zip(h.tolist(), o.tolist()):
                into.setdefault(rows_[k][0], set()).add(x)
    for a, v in val:
        for b, t in train:
            if splits.near(v, t) and v != t:
                assert len(all_[a] & all_[b]) >= splits.least_common(np.array(len(v)), np.array(len(t))) and few[a] & few[b], (v, t)
    with pytest.MonkeyPatch.context() as m:  # many slices, several blocks of each, hot pieces salted
        m.setattr(splits, "GROUP_WORDS", 300)
        m.setattr(skew, "ROWS_PER_TASK", 2)
        assert {tuple(r) for r in splits.overlaps(df).select("val_id", "train_id").collect()} == want


# ------------------------------------------------------------------ problem 8
def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(8, 40)))) for i in range(20)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        body = [rng.choice(VOCAB) for _ in range(30)]
        words = items[d % 20][1].split()
        n = rng.choice((5, 9, 10, 12, 14, 20))
        a = rng.randrange(max(1, len(words) - n))
        piece = words[a : a + n]
        if rng.random() < 0.5 and len(piece) > 2:
            piece[rng.randrange(len(piece))] = "changed"
        docs.append((d, " ".join(body[:15]) + "\n**" + ", ".join(piece).upper() + "** <b>" + " ".join(body[15:]) + "</b>", "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[0][1], None), (103, ("filler words go on " * 20_000) + (items[1][1] if len(items[1][1].split()) >= 12 else items[3][1]), "x")]

    def hit(dw, iw):
        for q in range(len(iw) - 11):
            for p in range(len(dw) - 10):
                if leaks.myers_within(iw[q : q + 12], dw[p : p + 13], 1):
                    return True
        return False

    df = spark.createDataFrame(docs, "doc_id bigint, text string, piece string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    small = [(d, leaks.words(t)) for d, t, _ in docs if t and d < 103]
    want = {(d, i) for d, dw in small for i, t in items if t for iw in [leaks.words(t)] if hit(dw, iw)}
    got = {tuple(r) for r in leaks.leaks(df, it).collect()}
    assert {x for x in got if x[0] < 103} == want and any(x[0] == 103 for x in got) and len(want) > 10
    # a full bit set lets every piece pass, hot pieces are salted; the rows stay the same
    with pytest.MonkeyPatch.context() as m:
        m.setattr(leaks, "MAX_BITS", 64)
        m.setattr(skew, "ROWS_PER_TASK", 3)
        m.setattr(leaks, "BITS_PER_PIECE", 1)
        assert {tuple(r) for r in leaks.leaks(df.where("doc_id < 103"), it).collect()} == want | {x for x in got if x[0] == 102}
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def test_myers():
    p = [1, 2, 3, 4, 5, 6]
    assert leaks.myers_within(p, [9, 1, 2, 3, 4, 5, 6, 9], 0) and leaks.myers_within(p, [1, 2, 7, 4, 5, 6], 1) and not leaks.myers_within(p, [1, 2, 7, 4, 8, 6], 1)
    assert leaks.myers_within(p, [1, 2, 3, 7, 4, 5, 6], 1) and not leaks.myers_within(p, [], 1)


# ------------------------------------------------------------------ problem 9
def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(5, 60))), "big" if i % 3 else "mid" if i % 2 else "tiny" if i < 120 else "mid") for i in range(1500)]
    docs += [(9000, None, "big"), (9001, "", "mid"), (9002, "no target", "none"), (9003, "null source", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash")).repartition(4)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("ghost", 0.05, 4), ("off", None, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, targets)
    shares = {r.source: r for r in m.shares().collect()}
    for s, t in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15)):
        assert abs(shares[s].actual_share - t / 0.95) < 0.01, shares
    assert shares["ghost"].n_tokens == 0 and all(r.repeats_used <= r.max_repeats for r in shares.values())
    stream = m.stream().orderBy("position").collect()
    total = 0
    for r, n in zip(stream, [*stream[1:], None]):
        total += r.tokens
        assert r.position == total and (n is None or r.finish <= n.finish)
    assert total <= m.budget and m.budget - total < 200
    caps = {"big": 1, "mid": 2, "tiny": 3}
    chosen = m.chosen().collect()
    assert all(1 <= r.repeats <= caps[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    over = {r.source: r for r in mixing.Mix(df, targets, budget=10**9).shares().collect()}
    assert {s for s, r in shares.items() if r.limits_budget} == {min(("big", "mid", "tiny"), key=lambda s: sum(r.tokens for r in m.tokens.where(F.col("source") == s).collect()) * caps[s] / {"big": 0.5, "mid": 0.3, "tiny": 0.15}[s])}
    assert over["tiny"].repeats_used == 3 and over["big"].n_docs == 1000
    assert mixing.Mix(df.limit(0), targets).chosen().count() == 0 and mixing.Mix(df, targets.limit(0)).shares().count() == 0
