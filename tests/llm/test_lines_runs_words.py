"""Line dedup, periodic runs and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mendwork.llm import line_runs, periodic, queries, spelling

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines


def plain_lines(rows):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def many_lines(seed, n):
    rng = random.Random(seed)
    pool = [f"This is the common line of number {k} É" for k in range(12)] + ["short", "", "  \t", "x" * 19, "y" * 20, "Ünder twenty letters", " \x0bPADDED line with twenty letters\r"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line of {i} and {rng.random()}" for _ in range(rng.randint(0, 9))]
        lines = [x.upper() if rng.random() < 0.2 else "  " + x + "\t" if rng.random() < 0.2 else x for x in lines]
        rows.append((None if rng.random() < 0.05 else rng.randint(-3, n), "\n".join(lines) if rng.random() > 0.05 else None))
    return rows + rows[:3]


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (4, 3)])
def test_line_dedup_against_plain_python(spark, batches, fan):
    rows = many_lines(batches, 60)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    got = line_runs.without_repeated_lines(docs, batches=batches, fan=fan)
    assert sorted(got.columns) == sorted(["doc_id", "text", "key", "kept_text", "n_lines", "n_dropped"])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == plain_lines(rows)


def test_runs_batch_by_batch(spark):
    """After each batch the lines that stand are those of a dedup of all batches so far; levels are compacted."""
    rows = [(i, t) for i, t in dict(many_lines(9, 80)).items() if i is not None]
    runs = line_runs.LineRuns(spark, fan=2)
    seen = []
    for n in range(5):
        seen += rows[n::5]
        batch = spark.createDataFrame(rows[n::5], "doc_id long, text string")
        runs.add(line_runs.line_keys(batch))
        assert all(len(level) < 2 for level in runs.levels)
        drops = [(bytes(r.key), r.doc) for r in runs.drops().collect()]
        assert len(drops) == len(set(drops))
        lines = line_runs.line_keys(spark.createDataFrame(seen, "doc_id long, text string"))
        held = defaultdict(set)
        for r in lines.collect():
            held[bytes(r.key)].add(r.doc)
        want = {(k, d) for k, ds in held.items() for d in ds if len(ds) >= 3 and d != max(ds)}
        assert set(drops) == want
        assert runs.standing(lines).count() == lines.count() - len(want)
    assert len(runs.runs()) == 2  # five batches are a run of four and one of one
    runs.close()
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, min_docs=4)


def test_line_dedup_of_nothing(spark):
    assert line_runs.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = line_runs.without_repeated_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got} == {(1, 1, 0, ""), (2, 1, 0, "")}
    long = "\n".join(f"a line of a very long text, number {k}" for k in range(20_000))
    rows = spark.createDataFrame([(k, long) for k in range(3)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_runs.without_repeated_lines(rows).collect()} == {0: 20_000, 1: 20_000, 2: 0}


# --- periodic runs


def plain_runs(words, least=6, exponent=4):
    """All maximal stretches of each period, the smallest period of each."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end - i + q
            if length >= max(least, exponent * q):
                found.setdefault((start, length), q)
            i = end
    return sorted((s, length, q) for (s, length), q in found.items())


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 7)):
            part = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 9))]
            words += part * rng.choice((1, 1, 3, 4, 5, 9)) + part[: rng.randint(0, len(part))]
        out.append(words)
    return out + [["a"] * k for k in range(9)] + [list("abababab"), list("abaabaabaaba"), list("aabaabaabaabaab") * 5, []]


def test_runs_against_all_periods():
    for words in texts_with_runs(1, 400):
        symbols = [ord(w) for w in words]
        assert periodic.runs_of(symbols) == plain_runs(words), words
    coded = [[w.encode() for w in words] for words in texts_with_runs(2, 300)]
    assert periodic.find_runs(coded) == [plain_runs(words) for words in coded]
    # exponent 2 is the whole theorem
    for words in texts_with_runs(3, 150):
        assert periodic.runs_of([ord(w) for w in words], 2, 2) == plain_runs(words, 2, 2)


def test_extensions_and_lyndon_words():
    rng = random.Random(4)
    for size in (1, 2, 7, 60):
        text = [rng.randint(1, 3) for _ in range(size)]
        tree = periodic.SuffixTree(text)
        suffixes = [text[i:] for i in range(size + 1)]
        assert tree.rank.tolist() == [sorted(suffixes).index(s) for s in suffixes]
        turned = [[-x for x in s] for s in suffixes]
        assert tree.back_rank.tolist() == [sorted(turned).index(s) for s in turned]
        for i in range(size + 1):
            for j in range(i + 1, size + 1):
                same = next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j])) if x != y), len(suffixes[j]))
                assert tree.lce(periodic.np.array([i]), periodic.np.array([j]))[0] == same


def planted(i, text):
    words = WORDS.findall(text or "")
    if i is None or not words or (h := zlib.crc32(str(i).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def plain_op12(i, text):
    words = planted(i, text)
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (i, len(runs), s, length, q, runs and 1000 * length // q or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_op12_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["Wort", "ünd", "x", "der\n", "\t"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(None, "a " * 20), (3, None), (5, ""), (8, " \n\x0b "), (9, "no break a a a a a a a"), (9, "no break a a a a a a a"), (11, "w " * 30_000)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_op12(*r) for r in rows), key=repr)
    docs = spark.createDataFrame(rows[:5], "doc_id long, collapsed_text string")
    assert periodic.with_runs(docs, "collapsed_text").count() == 5 and periodic.with_runs(docs.limit(0), "collapsed_text").count() == 0


# --- spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [1024, 8])
def test_variants_against_all_pairs(spark, tile):
    rng = random.Random(tile)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))
        words.add(w)
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            words.add(rng.choice((w[:k] + rng.choice("abß") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("ab") + w[k + 1 :])) or "x")
    words |= {"a" * k for k in range(1, 9)} | {"samebeginning" + x + y for x in "abcdefghij" for y in "abcdefghij"}
    counts = {w: rng.choice((5, 5, 30, 150, 800, 5000)) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n int"), tile=tile)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(counts)


def test_op13_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    base = ["Straßen", "straßen", "example", "examples", "exampel", "Éclairs", "résumés", "short", "abcdefg", "abcdefgh"]
    rows = [(k, "".join(rng.choice(base) + rng.choice([" ", ", ", "1", "中", "-"]) for _ in range(rng.randint(0, 80)))) for k in range(400)] + [(None, "example " * 20), (7, None), (7, ""), (7, "example " * 3)]
    spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, cut = Counter(), 0
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 199 == 0:
                w, cut = w[: h % len(w)] + w[h % len(w) + 1 :], cut + 1
            if len(w) >= 6:
                counts[w] += 1
    assert cut > 5
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants({w: n for w, n in counts.items() if n >= 5})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([(1, "abcdef " * 50_000)], "doc_id int, text string"), noise=199).where(F.col("n") == 50_000).count() + cut > 0
