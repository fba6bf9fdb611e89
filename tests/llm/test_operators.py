import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from mendwork.llm import attribution, decontaminate, fixity, gam, language, main_text, packing, quality_rules, simhash
from mendwork.llm.components import connected_components
from mendwork.llm.textstats import NAMES, text_stats
from mendwork.llm.tokens import ByteBpe
from pyspark.sql import functions as F

TEXTS = ["", None, "a", "The quick brown fox jumps over the lazy dog. " * 3, "ünïcödé wörds\nand lines\nand lines\n", "x " * 5000, "日本語 текст العربية", " \n\t ", "one two three four five six seven eight nine ten eleven"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 7) for i, t in enumerate([*TEXTS, *TEXTS])] + [(None, "null id", None, None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, quality_prob int")


def test_stats_against_plain_python():
    words = re.compile("[^\x20\x09-\x0d]+")
    for t in TEXTS:
        w = words.findall(t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words.search(x)]
        got = dict(zip(NAMES, text_stats(t.encode() if t is not None else None)))
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"], got["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))


def test_rules_keep_all_columns_and_learn(spark, docs):
    good = " ".join(f"word{i % 97} and{i % 31} then{i % 57}," for i in range(60)).replace("0", "o")
    clean = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], good) + f" {'xyz'[i % 3]}" for i in range(80)]
    bad = [c.upper().replace(" ", "!! ") for c in clean[:10]] + [c.replace(" ", "### ") for c in clean[:10]]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(clean + bad)], "doc_id long, text string, n_words int")
    model = quality_rules.fit(quality_rules.with_stats(rows))
    kept = quality_rules.keep(rows, model)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == list(range(80))
    assert quality_rules.keep(docs.limit(0), quality_rules.fit(quality_rules.with_stats(docs.limit(0)))).count() == 0
    assert quality_rules.with_posterior(quality_rules.with_stats(docs), model).count() == docs.count()


def test_simhash_components_against_all_pairs(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:60]:
        for _ in range(4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    want = {frozenset(p for p in prints if root(p) == r) for r in map(root, prints)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for options in ({}, {"prefix_bits": 2, "task_variants": 5000}):  # the second one splits every partition into slices
        frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
        roots = {r.node & (2**64 - 1): r.root for r in connected_components(simhash.near_links(frame, 4, **options)).collect()}
        groups = Counter()
        got = {}
        for p in prints:
            got.setdefault(roots.get(p, signed(p)), set()).add(p)
        assert {frozenset(g) for g in got.values()} == want, groups


def test_fingerprints_and_kept_rows(spark, docs):
    def plain(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint & (2**64 - 1) == plain(TEXTS[r.doc_id % len(TEXTS)]) and r.component_id <= r.doc_id % len(TEXTS)
    assert {r.doc_id for r in got if r.is_kept and r.doc_id is not None} == {r.component_id for r in got if r.component_id is not None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_slices_make_every_variant_once():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    near = np.unique(np.concatenate([base, *(base ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in rng.integers(0, 64, (40, 2)))]))
    assert (simhash.linear_hash(near ^ base[0], 5) == simhash.linear_hash(near, 5) ^ simhash.linear_hash(base[:1], 5)[0]).all()
    whole = set(zip(*(x.tolist() for x in simhash.meet(near, 0, 0, 4))))
    parts = [set(zip(*(x.tolist() for x in simhash.meet(near, 0, 0, 4, piece, 3)))) for piece in range(8)]
    linked = lambda pairs: {frozenset(g) for g in _groups_of(near.view(np.int64).tolist(), pairs)}
    assert linked(whole) == linked(set().union(*parts))


def _groups_of(nodes, pairs):
    group = {n: {n} for n in nodes}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    return group.values()


def test_wu_manber_against_scan(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9])))) for i in range(12)] + [(50, None), (51, "!!"), (0, "b b")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (200_000, 4):
        got = {r.doc_id: (sum(e - s for s, e in r.hit_spans), list(r.hit_items)) for r in decontaminate.with_hits(docs, bench, width=4, block_patterns=size).collect()}
        for i, t in enumerate(texts):
            w, hit, found = (t or "").split(), set(), set()
            for item, x in items:
                p = re.findall("[a-z]+", x or "")
                k = min(4, len(p))
                for a in range(len(p) - k + 1 if p else 0):
                    for b in range(len(w) - k + 1):
                        if w[b : b + k] == p[a : a + k]:
                            hit |= set(range(b, b + k))
                            found.add(str(item))
            assert got[i] == (len(hit), sorted(found))
    assert decontaminate.without_hits(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()


def test_tokens_equal_the_tokenizer_and_round_trip():
    bpe = ByteBpe()
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x85", "\u00a0", "word", "It's", "'LL", "12,345", "ñandú", "Ǆ", "Ωμέγα", "слово", "“curly”", "—", "漢字", "नमस्ते", "🙂", "e\u0301", "!?..", "_x_", "ſ", "ˈ", "\u2028"]
    texts = [*filter(None, TEXTS), *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)), *("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 879)])) for _ in range(30)) for _ in range(500))]
    for t in texts:
        assert bpe.ids(t.encode()).tolist() == fresh.encode(t, add_special_tokens=False).ids, t
        assert bpe.lengths[bpe.ids(t.encode())].sum() == len(t.encode())


def test_packing_is_whole_and_within_limits(spark, docs):
    packed = packing.pack(packing.pieces(docs, tokens=64, with_ids=True), packing.Capacity(64, 5, 3000 + 64 * 64), group_size=6).collect()
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc in range(len(TEXTS) * 2):
        own = sorted((r for r in packed if r.doc_id == doc), key=lambda r: r.piece)
        ids = np.append(fresh.encode(TEXTS[doc % len(TEXTS)] or "", add_special_tokens=False).ids, 2).astype("<u4")
        assert b"".join(r.ids for r in own) == ids.tobytes() and all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    for s in {r.sequence_id for r in packed}:
        own = sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 64 and len(own) <= 5
    lengths = np.sort(np.random.default_rng(1).integers(1, 1025, 3000))[::-1]
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(lengths, packing.Capacity(rule=rule))
        assert np.bincount(bins, lengths).max() <= 1024 and bins.max() + 1 <= 1.03 * lengths.sum() / 1024 + 1


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_is_whole(spark, docs, rule):
    got = attribution.token_counts(docs, rule=rule).where("doc_id IS NOT NULL").collect()
    bpe = ByteBpe()
    for i, t in enumerate(TEXTS):
        own = [r for r in got if r.doc_id == i]
        if t is None:
            assert not own
        else:
            assert sum(r.n_tokens for r in own) == pytest.approx(len(bpe.ids(t.encode()))) and len(own) == t.count("\n") + 1


def test_fields_as_sections(spark):
    docs = spark.createDataFrame([(1, "Ünï title", None, "some body text"), (2, None, None, None)], "doc_id long, title string, note string, body string")
    text, sections = attribution.field_sections("title", "note", "body")
    got = attribution.token_counts(docs.select("doc_id", text.alias("text"), sections.alias("s")), sections="s", rule="start").where("doc_id = 1").collect()
    assert {r.name: r.n_tokens for r in got if r.section >= 0}["body"] == len(ByteBpe().ids(b"some body text"))


def test_main_text():
    page = '<html><body><nav><a href=/>Home page</a></nav><div class="ad">Buy this thing now please</div><article><h1>A &amp; B</h1><p><b>Long first paragraph of the article.<br><p>Short.</p><p>And the third one, with enough text to count.</p></article><div id="comments"><p>First! This is a reader comment that is long enough.</p></div><form>Sign up</form><footer>&copy; us</footer><script>var t="</p>"</script></body></html>'
    assert main_text.content_lines(page) == ["A & B", "Long first paragraph of the article.", "Short.", "And the third one, with enough text to count."]
    plain = page.replace("<article>", '<div class="post-body">').replace("</article>", "</div>")
    assert main_text.content_lines(plain) == main_text.content_lines(page)
    assert main_text.content_lines(None) == main_text.content_lines("") == main_text.content_lines("<p></p>") == []


def test_gam_and_language(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.Gam().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in {(i, j) for i, j, _ in model.pairs}
    assert gam.Gam().fit(np.zeros((0, 17)), np.zeros(0)).score(np.zeros((2, 17))) == pytest.approx([0.5, 0.5])
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert gam.with_scores(docs, gam.fit_labels(docs, labels)).where("quality_score BETWEEN 0 AND 1").count() == docs.count()
    en, de = "the cat and the dog with this house ", "der hund und die katze nicht mit dem haus "
    known = spark.createDataFrame([(en * 20, "en"), (de * 20, "de"), (None, "de"), ("x", None)], "text string, lang string")
    model = language.learn(known)
    assert model.infer(en * 3)[0] == ["en"] and set(model.infer(en * 30 + de * 30)[0]) == {"en", "de"} and model.infer("123 !!") == ([], []) == model.infer(None)
    assert language.with_languages(docs, language.learn(known.limit(0))).where("size(languages) = 0").count() == docs.count()


def test_fixity_finds_what_differs(spark):
    rows = [(f"f{i % 3}", (i // 3) * 1000, f"record {i}") for i in range(300)]
    worse = [(f, o, p + "!" if (f, o) == ("f1", 5000) else p) for f, o, p in rows if (f, o) != ("f2", 99000)] + [("f2", 777_000, "new")]
    leaf = lambda data: fixity.leaves(spark.createDataFrame(data, "file string, offset long, payload string"), F.col("file"), F.col("offset"), F.col("payload"))
    roots, damage = fixity.audit(leaf(rows), leaf(worse), range_bytes=4096, fan=4, height=3)
    assert {r.file: r.intact for r in roots.collect()} == {"f0": True, "f1": False, "f2": False}
    assert sorted((r.file, r.offset, r.status) for r in damage.collect()) == [("f1", 5000, "corrupt"), ("f2", 99000, "missing"), ("f2", 777_000, "extra")]


def test_wrappers_and_open_heads_do_not_empty_pages():
    body = "<h1>A title</h1><p>Long first paragraph of the page, with enough text to count here.</p><p>And the second one, also with enough text to count.</p>"
    want = ["A title", "Long first paragraph of the page, with enough text to count here.", "And the second one, also with enough text to count."]
    around = lambda a, b: f"<html><head><title>x</title></head><body>{a}<nav><a href=/>Home</a></nav>{body}<div class=sidebar>Read this too</div>{b}</body></html>"
    for page in (around("<div class='page with-sidebar'>", "</div>"), around("<form>", "</form>"), around("<div id=social-article>", "</div>"), around("<div role=form><form>", "</form></div>")):
        assert main_text.content_lines(page) == want
    for page in (f"<html><head><title>x</title><body>{body}</body></html>", f"<html><head><title>x</title>{body}", f"<head><meta charset=utf-8><title>x</title><div>{body}</div>"):
        assert main_text.content_lines(page) == want
    assert main_text.content_lines(f"<body><div style='display: none'>{body}</div><p>Seen</p>") == ["Seen"]


def test_bare_words_of_any_script():
    stats = lambda t: dict(zip(NAMES, text_stats(t.encode())))
    assert stats("слово, ещё одно слово.")["n_bare_words"] == 4 and stats("ab# 12 naïve été")["n_bare_words"] == 2


LONG_LINE = "This is a long enough sentence about things, with many words in it to count as text."


def test_all_articles_of_a_page_are_kept():
    for page in ("<main><article>{0} One</article><article>{0} {0} Two</article></main>", "<article>{0} {0} {0} One</article><article>{0} Two</article>", "<div><article>{0} One</article><article>{0} Two</article></div>"):
        lines = main_text.content_lines(f"<body><nav><a href=x>menu</a></nav>{page.format(LONG_LINE)}<footer>end</footer></body>")
        assert [x.split()[-1] for x in lines] == ["One", "Two"], page
    teaser = f"<body><article><p>{LONG_LINE}</p><p>{LONG_LINE} {LONG_LINE}</p></article><article><a href=1>{LONG_LINE}</a></article></body>"
    assert len(main_text.content_lines(teaser)) == 2


def test_silent_elements_that_never_end_swallow_nothing():
    for tag in ("button", "video src=x", "select", "canvas"):
        text = "\n".join(main_text.content_lines(f"<body><article><p>{LONG_LINE} <{tag}>go<p>{LONG_LINE} after</p><p>{LONG_LINE} last</p></article></body>"))
        assert "after" in text and "last" in text, tag
    ended = main_text.content_lines(f"<body><article><p>{LONG_LINE}</p><video><p>no video here</p></video><p>{LONG_LINE} {LONG_LINE}</p><button>x</button><script>var a</script></article></body>")
    assert ended == [LONG_LINE, f"{LONG_LINE} {LONG_LINE}"]
    assert "var" not in "".join(main_text.content_lines(f"<body><p>{LONG_LINE}</p><p>{LONG_LINE}</p><script>var x"))


@pytest.mark.parametrize("piece", ["<a href='", "<a href='x' b=\"", "<p class=\"", "</a href='", "<div><span "])
def test_open_quotes_take_linear_time(piece):
    import time

    began = time.process_time()
    lines = main_text.content_lines(f"<body><p>{LONG_LINE}</p><p>{LONG_LINE}</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 4 and lines[:1] == [LONG_LINE]
