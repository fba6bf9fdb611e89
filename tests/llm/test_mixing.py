import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mendwork.llm import mixing
from pyspark.sql import functions as F

RNG = random.Random(2)
TEXTS = [" ".join(RNG.choice(["alpha", "beta", "gamma", "delta", f"rare{RNG.randint(0, 40)}"]) for _ in range(RNG.randint(1, 60))) for _ in range(120)] + [None, "", "", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "e") for i, t in enumerate(TEXTS)] + [(None, "alpha beta", 1, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, word string")


def tokens(t):
    return [*(t or "").lower().split(), ""]


def test_base_scores_and_counts(spark, docs):
    got = {r.doc_id: r for r in mixing.score_texts(docs, F.col("doc_id") % 5 != 1, max_words=3).collect()}
    c = Counter(w for i, t in enumerate(TEXTS) if i % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate([*TEXTS, "alpha beta"]):
        r = got[i if i < len(TEXTS) else None]
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) and r.score < 0
        assert r.n_bytes == len((t or "").encode()) and (r.bits_per_byte is None) == (not t)
    assert mixing.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert all(r.score < 0 for r in mixing.score_texts(docs, F.lit(False)).collect())  # nothing learned


def test_scores_do_not_depend_on_partitions(docs):
    one, other = ({r.doc_id: r.score for r in mixing.score_texts(d, F.col("doc_id") % 5 != 1, max_words=3).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], rel=1e-4) for k in one)


def test_small_shards_score_each_row_once(docs):
    got = mixing.score_texts(docs, F.lit(True), max_words=3, shard=64).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(len(TEXTS))) and len(got) == len(TEXTS) + 1 and all(r.score < 0 for r in got)


def coder_of(spark, max_words=30):
    rows = [(t or "", i % 5 != 1) for i, t in enumerate(TEXTS)]
    counts = mixing.word_counts(spark.createDataFrame(rows, "text string, train boolean")).cache()
    return mixing.Coder(mixing.vocabulary(counts, max_words)), counts


def test_huffman_paths_are_a_complete_code():
    parent = mixing.huffman(np.array([5, 1, 1, 9, 3, 3]))
    offset, length, steps = mixing.paths(parent)
    assert sum(2.0 ** -int(x) for x in length) == 1.0 and len(steps) == length.sum() and set(steps >> 1) == set(range(5))


def test_counts_of_bits_against_brute_force(spark):
    coder, _ = coder_of(spark)
    near, before, s, at, _ = coder.units([tokens(t)[:-1] and [w.encode() for w in tokens(t)[:-1]] for t in TEXTS])
    train = (at % 5 != 1).astype(np.int64)
    path = lambda x: [(int(v) >> 1, int(v) & 1) for v in coder.steps[coder.offset[x] : coder.offset[x] + coder.length[x]]]
    for key in (near, near * (1 << 32) + before):
        rows, size, entry = mixing._level(coder, np.unique(key, return_inverse=True)[1], s, train)
        assert (size[entry] == [int(((key == k) & (s == x) & (train == t)).sum()) for k, x, t in zip(key[:300], s[:300], train[:300])] + list(size[entry][300:])).all()
        seen = defaultdict(lambda: [0, 0])
        for k, x, t in zip(key, s, train):
            for node, bit in path(x):
                seen[k, node][bit] += t
        want = set()
        for e, row in enumerate(rows):
            for node, bit in path(s[row]):
                n = list(seen[key[row], node])
                n[bit] -= train[row]
                if sum(n) > 0:
                    want.add((e, node, bit, n[0], n[1]))
        context = np.unique(key, return_inverse=True)[1][rows]
        bits = mixing.seen_bits(coder, context, s[rows], (size * train[rows]).astype(np.int64), train[rows])
        assert {tuple(map(int, x)) for step in bits for x in zip(*step)} == want


def test_probabilities_of_a_context_sum_to_one(spark):
    coder, _ = coder_of(spark)
    near, before, s, at, _ = coder.units([[w.encode() for w in tokens(t)[:-1]] for t in TEXTS])
    train = at % 5 != 1
    # one held-out unit for every symbol, under a context that was seen and under one that was not
    for a, b in ((int(near[50]), int(before[50])), (1, 1 << 31), (1 << 31, 5)):
        every = np.arange(coder.escape + 1)
        score = mixing.shard_scores(coder, *(np.concatenate(x) for x in ((near, np.full(len(every), a)), (before, np.full(len(every), b)), (s, every), (train, np.zeros(len(every), dtype=bool)))))
        assert (10 ** score[len(s) :]).sum() == pytest.approx(1.0, abs=1e-3)


def test_mixer_learns_what_helps():
    rng = np.random.default_rng(0)
    good, noise = rng.normal(0, 2, 60_000).astype(np.float32), rng.normal(0, 2, 60_000).astype(np.float32)
    bit = (rng.random(60_000) < 1 / (1 + np.exp(-good))).astype(np.int64)
    mixer, gate = mixing.Mixer(), np.full(60_000, mixing.Mixer.gate(0, np.int32(9), np.int32(9)))
    odds = [noise, noise[::-1].copy(), good]
    for k in range(0, 60_000, 1000):
        mixer.learn(gate[k : k + 1000], [x[k : k + 1000] for x in odds], bit[k : k + 1000].astype(np.float32), np.ones(1000, dtype=np.float32))
    mixer.settle()
    ideal = np.log10(np.where(bit == 1, 1 / (1 + np.exp(-good)), 1 / (1 + np.exp(good)))).mean()
    assert mixer.log10(gate, odds, bit).mean() > ideal - 0.02


def test_head_is_exact_at_any_count(spark):
    rows = [(f"w{i:03d}".encode(), (1 << 21) + i // 2, 0) for i in range(60)] + [(f"v{i}".encode(), 5, 0) for i in range(40)] + [(b"once", 1, 0), (b"", 77, 0)]
    counts = spark.createDataFrame(rows, "word binary, n long, held long")
    want = sorted(((w, n) for w, n, _ in rows if n > 1 and w), key=lambda r: (-r[1], r[0]))
    for room in (0, 1, 4, 31, 60, 75, 1000):
        assert mixing.head(counts, room) == want[:room]


def test_shards_follow_the_corpus(spark):
    many = mixing.vocabulary(spark.createDataFrame([(w.encode(), 1 << 33, 0) for w in ("", "a", "b")], "word binary, n long, held long"))
    assert many.shards * mixing.SHARD >= 3 << 33 and many.spread[1] >= 1000
    assert len(np.unique(mixing.Coder(many).shard(np.full(100_000, 1), np.arange(100_000), np.zeros(100_000, np.uint64)))) >= 1000


def test_packed_units_come_back():
    columns = [np.sort(np.random.default_rng(k).integers(0, 1 << 32, 300)) if not k else np.random.default_rng(k).integers(0, 1 << 32, 300) for k in range(4)]
    assert all((a == b).all() for a, b in zip(columns, mixing.unpacked(mixing.packed(columns), 300)))


def test_texts_that_occur_twice_are_known(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(80)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in mixing.score_texts(rows, F.lit(True)).collect()}
    assert max(got[i] for i in range(30)) < min(got[i] for i in range(30, 300))


def test_held_out_texts_move_no_other_score(spark):
    """Altering, adding and removing held-out texts leaves all other scores alone: words beyond the head, letters and shards too."""
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    common = [word(3) for _ in range(40)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.7 else word(rng.randint(4, 9)) for _ in range(rng.randint(1, 60)))
    base = [(i, text(), i % 5 != 1) for i in range(150)]
    other = [(i, t if train else text() + " ÄÖ zzzzqqq" * 30, train) for i, t, train in base]
    fewer = [r for r in base if r[2] or r[0] % 2]
    more = base + [(1000 + i, text() * 3, False) for i in range(40)]

    def scores(rows):
        got = mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3), F.col("train"), max_words=30, shard=700)
        return {r.doc_id: (r.score, r.base_score, r.n_known) for r in got.collect()}

    want = scores(base)
    for rows in (other, fewer, more):
        got = scores(rows)
        same = [i for i, t, train in rows if (i, t, train) in set(base)]
        assert len(same) >= 120
        for i in same:
            assert got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-6), i
    changed = mixing.spellings([b"abc", b"abd", b"zzz", b"\xc3\xa4"], np.array([True, True, False, False]))[:2]
    assert changed == pytest.approx(mixing.spellings([b"abc", b"abd", b"qqqq"], np.array([True, True, False]))[:2])


def test_common_pairs_are_dealt_alike_by_all_senders():
    n = np.array([10, 5_000_000, 4_000_000, 20], np.int64)
    v = mixing.Vocabulary([b"", b"a", b"b", b"c"], n, int(n.sum()), 4, mixing.huffman(np.append(n, 1)), np.append(n, 1), np.maximum(1, -(-4 * np.append(n, [10, 20]) // mixing.SHARD)), np.append(n, [10, 20]), 18, mixing.SHARD)
    coder = mixing.Coder(v)
    owner = np.arange(1000, dtype=np.uint64)
    hot = coder.shard(np.full(1000, 1), np.full(1000, 2), owner)
    assert len(np.unique(hot)) == 2 and (hot == coder.shard(np.full(1000, 1), np.full(1000, 2), owner[::1])).all()
    assert len(np.unique(coder.shard(np.full(1000, 1), np.full(1000, 3), owner))) == 1


def test_mixer_learns_every_bit_of_training_rows(spark, monkeypatch):
    """no context is left out; a bit seen by others is learned once for each training unit and each level that knows it."""
    coder, _ = coder_of(spark)
    near, before, s, at, _ = coder.units([[w.encode() for w in tokens(t)[:-1]] for t in TEXTS])
    train = at % 5 != 1
    want = 0
    for key in (near, near * (1 << 32) + before):
        seen = Counter()
        for k, x in zip(key[train].tolist(), s[train]):
            seen.update((k, int(step) >> 1, int(step) & 1) for step in coder.steps[coder.offset[x] : coder.offset[x] + coder.length[x]])
        want += sum(n for (k, node, bit), n in seen.items() if n + seen[k, node, 1 - bit] > 1)
    got, learn = [], mixing.Mixer.learn
    monkeypatch.setattr(mixing.Mixer, "learn", lambda self, gate, odds, bit, weight: (got.append(float(weight.sum())), learn(self, gate, odds, bit, weight))[1])
    mixing.shard_scores(coder, near, before, s, train)
    assert sum(got) == want > 0


def test_words_are_counted_as_python_splits_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COUNTED", 500)
    rng = random.Random(1)
    texts = [None, "", " ", "\x1c a\x1fb c  x", "\x0b\x0cA\rB\n\tÄÖ a"] + ["".join(rng.choice(" \t\n\r\x0b\x0cABab\x1cÄ\x85 é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(t, rng.random() < 0.7) for t in texts]
    want = {True: Counter(), False: Counter()}
    for t, train in rows:
        want[train].update([*(t or "").encode().lower().split(), b""])
    got = {bytes(r.word): (r.n, r.held) for r in mixing.word_counts(spark.createDataFrame(rows, "text string, train boolean").repartition(2)).collect()}
    assert got == {w: (want[True][w], want[False][w]) for w in {*want[True], *want[False]}}


def test_equal_bits_are_mixed_once(spark, monkeypatch):
    """The work follows distinct (context, node, bit, train), not the entries that share them."""
    coder, _ = coder_of(spark)
    near, before, s, at, _ = coder.units([[w.encode() for w in tokens(t)[:-1]] for t in TEXTS])
    train = at % 5 != 1
    want = 0
    for key in (near, near * (1 << 32) + before):
        seen, distinct = Counter(), set()
        for k, x, t in zip(key.tolist(), s, train.tolist()):
            for step in coder.steps[coder.offset[x] : coder.offset[x] + coder.length[x]].tolist():
                seen[k, step >> 1] += t
                distinct.add((k, step >> 1, step & 1, t))
        want += sum(seen[k, node] > t for k, node, _, t in distinct)
    got, log10 = [], mixing.Mixer.log10
    monkeypatch.setattr(mixing.Mixer, "log10", lambda self, gate, odds, bit: (got.append(len(bit)), log10(self, gate, odds, bit))[1])
    mixing.shard_scores(coder, near, before, s, train)
    assert sum(got) == want > 0


def test_words_of_texts_in_pieces():
    texts = pa.array([" a  B\x0bc ", None, "", "\x1cd\x85", "e f", "Ä"])
    want = [b" a  b\x0bc ".split(), [], [], "\x1cd\x85".encode().split(), [b"e", b"f"], ["Ä".encode()]]
    assert mixing.words_of(texts).to_pylist() == want and mixing.words_of(texts.slice(3, 2)).to_pylist() == want[3:5]
    for size in (1, 4, 1000):
        pieces = list(mixing.in_pieces(texts, size))
        assert [w for _, p in pieces for w in mixing.words_of(p).to_pylist()] == want and [a for a, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)]).tolist()[:-1]
    assert list(mixing.in_pieces(texts.slice(0, 0), 4)) == []
