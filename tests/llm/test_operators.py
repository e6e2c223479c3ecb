import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlake.llm import common, decontaminate, exact_dedup, html_text, licences, line_dedup, lm_score, near_dedup, quality, registry, sentencepiece_codec, url_filter


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Scoring.


def test_scores_prefer_what_was_trained(spark):
    rng = random.Random(3)
    texts = [" ".join(w for _ in range(60) for w in rng.choice(["the red house", "a blue boat", "old green hill"]).split()) for _ in range(400)]
    train = frame(spark, texts)
    frequent, counts = lm_score.vocabulary(train)
    network = lm_score.train(lm_score.encode(train, frequent), frequent, counts, rounds=4, stride=4)
    words = " ".join(texts[:3]).split()
    rng.shuffle(words)
    rows = {r["doc_id"]: r for r in lm_score.score(frame(spark, [" ".join(texts[:3]), " ".join(words)]), network).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"]
    assert rows[0]["mean_log_likelihood"] > rows[1]["mean_log_likelihood"] + 0.2


def test_gradient():
    rng = np.random.default_rng(0)
    flat = (lm_score.initial(np.ones(lm_score.VOCABULARY)) + rng.normal(0, 0.1, lm_score.SIZE)).astype(np.float64)
    context, target = rng.integers(0, lm_score.VOCABULARY + 1, (5, 4)), np.sort(rng.integers(0, lm_score.VOCABULARY, 5))
    context[1] = context[0]
    g = np.zeros(lm_score.SIZE)
    into = lm_score.parts(g)

    def update(name, rows, value):
        into[name][rows] += value

    lm_score.forward(lm_score.parts(flat), context, target, update)
    for i in np.argsort(-np.abs(g))[:400:20]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = -(lm_score.forward(lm_score.parts(up), context, target).sum() - lm_score.forward(lm_score.parts(down), context, target).sum()) / 2e-5
        assert g[i] == pytest.approx(slope, rel=1e-3)


def test_score_is_the_sum_over_words():
    """Of documents on both sides of the slices' borders, and longer than a slice."""
    rng = np.random.default_rng(1)
    net = lm_score.Network([], lm_score.initial(np.ones(lm_score.VOCABULARY)))
    docs = [rng.integers(0, lm_score.VOCABULARY, n).astype(np.int16) for n in (3, 0, lm_score.SCORE_WORDS - 4, 5, 2 * lm_score.SCORE_WORDS + 7, 1, 0)]
    got = net.score(np.concatenate(docs), np.array([len(x) for x in docs]))
    p = lm_score.parts(net.flat)
    for x, s in zip(docs, got):
        by = np.argsort(x, kind="stable")
        total = lm_score.forward(p, lm_score.windows(x, np.arange(len(x)))[by], x[by]).sum(dtype=float) if len(x) else 0.0
        assert s == pytest.approx(total, abs=1e-3, rel=1e-6)


def test_average_counts_uses():
    a, b = (lm_score.Trainer(lm_score.initial(np.ones(lm_score.VOCABULARY))) for _ in "ab")
    a.add(np.full((4, 4), 5, np.int16), np.full(4, lm_score.PER_CLASS + 5, np.int16))
    a.flush()
    total = a.share().astype(float) + b.share()
    used = lm_score.spread(total[lm_score.SIZE :])
    mean = lm_score.parts(total[: lm_score.SIZE] / np.maximum(used, 1))
    assert np.allclose(mean["e"][5], a.p["e"][5]) and np.allclose(mean["wo"][1], a.p["wo"][1]) and np.allclose(mean["w"], a.p["w"])
    assert not lm_score.parts(used)["e"][6].any() and not lm_score.parts(used)["bo"][0].any()


def test_held_out_words_are_likelier_than_by_their_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    network, _ = lm_score.fit(docs.filter(~held))
    start = lm_score.Network(network.frequent, lm_score.initial(lm_score.vocabulary(docs.filter(~held))[1]))
    mean = lambda n: lm_score.score(docs.filter(held), lm_score.Network(n.frequent, n.flat)).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(network) > mean(start)


def test_every_word_is_predicted_by_its_own_share(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(18_000)]
    texts = [" ".join(words + words[:17_000] + ["often"] * 9)] + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)] + ["w17999 w17999 Twice twice", None, ""]
    docs = frame(spark, texts)
    network, _ = lm_score.fit(docs)
    counts = Counter(w for t in texts if t for w in t.lower().split())
    frequent, bucket = set(network.frequent), lambda w: crc32(w.encode()) % lm_score.BUCKETS
    totals = Counter()
    for w, c in counts.items():
        totals[bucket(w)] += c * (w not in frequent)
    asked = [*texts, "xqzv unheard w17999", "xqzv"]
    got = {r["doc_id"]: r for r in lm_score.score(frame(spark, asked), network).collect()}
    plain = {r["doc_id"]: r for r in lm_score.score(frame(spark, asked), lm_score.Network(network.frequent, network.flat)).collect()}
    for i, t in enumerate(asked):
        ws = [w for w in (t or "").lower().split() if w not in frequent]
        share = sum(np.log(max(1, counts[w]) / (totals[bucket(w)] + 1)) for w in ws)
        assert got[i]["log_likelihood"] == pytest.approx(plain[i]["log_likelihood"] + share, abs=1e-6)
    own = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs).collect()}
    assert len(own) == len(texts) and all(np.isclose(own[i], got[i]["log_likelihood"], rtol=0.01, atol=0.5) for i in own)  # another training, whose rows lie otherwise in partitions


def test_words_are_split_many_texts_at_once_as_one_by_one():
    rng = random.Random(8)
    texts = ["", None, "  ", "a\x0bB\x0c c\t\nd ", " x", "x ", "\u00c4 \u00e4\u2003em\u00a0nb", "A\x1cb \x85 c", "q" * 99, "a\0b \0"]
    texts += ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1c\x1f\x85 \u00e9Z") for _ in range(rng.randrange(30))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(texts)[3:70], pa.array([None, None], pa.string()), pa.array([], pa.string())):
        for most in (1, 50, 2**25):
            seen, known = [], lm_score.Ids(["a", "b"])
            for lo, many, words, which in lm_score.distinct_words(column, most):
                assert lo == len(seen)
                words = lm_score._bytes_of(words)
                assert len(set(words)) == len(words)
                ids, hashes = known.of(words)
                assert [h for w, h in zip(words, hashes) if w not in (b"a", b"b")] == [np.uint64(lm_score._word_hash(w)).astype(np.int64) for w in words if w not in (b"a", b"b")]
                assert ids.tolist() == [{b"a": 0, b"b": 1}.get(w, lm_score.VOCABULARY - lm_score.BUCKETS + crc32(w) % lm_score.BUCKETS) for w in words]
                ends = np.cumsum([0, *many])
                seen += [[words[k] for k in which[a:b]] for a, b in zip(ends, ends[1:])]
            assert seen == [(t or "").encode().lower().split() for t in column.to_pylist()]


def test_rounds_mask_every_position_once():
    rng = np.random.default_rng(5)
    for n in [*range(40), 1000]:
        raw = rng.integers(0, 1024, n).astype(np.int16).tobytes()
        masked = [lm_score.masked(raw, k) for k in range(lm_score.ROUNDS)]
        assert sorted(np.concatenate(masked)) == list(range(n))


def test_many_documents_are_masked_at_once_as_one_by_one():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, lm_score.VOCABULARY, n).astype(np.int16).tobytes() for n in [*range(12), 0, 500, 1, 0]]
    for documents in (docs, docs[:1], docs[5:6], []):
        for k in range(lm_score.ROUNDS):
            context, target = lm_score.all_masked(documents, [lm_score.first_masked(raw, k) for raw in documents])
            own = [(np.frombuffer(raw, np.int16), lm_score.masked(raw, k)) for raw in documents]
            assert target.tolist() == [i for x, at in own for i in x[at]]
            assert context.tolist() == [w for x, at in own for w in lm_score.windows(x, at).tolist()]


def test_scoring_prepares_its_softmaxes_once(monkeypatch):
    """Not for each slice of words anew; what comes out is the same."""
    rng = np.random.default_rng(10)
    net = lm_score.Network([], lm_score.initial(rng.integers(1, 99, lm_score.VOCABULARY).astype(float)))
    ids, sizes = rng.integers(0, lm_score.VOCABULARY, 5000).astype(np.int16), np.array([2500, 0, 2400, 100])
    whole, calls, kept = net.score(ids, sizes), [], lm_score._logits
    monkeypatch.setattr(lm_score, "SCORE_WORDS", 500)
    monkeypatch.setattr(lm_score, "_logits", lambda *a: calls.append(a) or kept(*a))
    assert np.allclose(net.score(ids, sizes), whole, rtol=1e-6) and len(calls) == lm_score.CLASSES + 1


def test_short_documents_train_with_production_values(spark):
    """Every document is shorter than the positions that were once skipped."""
    train = frame(spark, [t for _ in range(1500) for t in ("the red house", "a blue boat", "old green hill")])
    frequent, counts = lm_score.vocabulary(train)
    network = lm_score.train(lm_score.encode(train, frequent), frequent, counts)
    rows = {r["doc_id"]: r for r in lm_score.score(frame(spark, ["the red house", "house the red"]), network).collect()}
    assert rows[0]["mean_log_likelihood"] > rows[1]["mean_log_likelihood"] + 0.2


def test_few_positions_take_several_steps():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 9, 200).astype(np.int16)
    start = lm_score.initial(np.bincount(ids, minlength=lm_score.VOCABULARY).astype(float))
    trainer = lm_score.Trainer(start)
    trainer.add(lm_score.windows(ids, np.arange(200)), ids)
    trainer.flush()
    # A single step of Adagrad moves no weight by more than its rate.
    assert np.abs(trainer.flat - start).max() > 1.5 * lm_score.RATE


def test_weights_are_prepared_once_for_all_blocks(monkeypatch):
    rng, calls = np.random.default_rng(6), []
    ready = lm_score._logits
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    monkeypatch.setattr(lm_score, "_logits", lambda w, bias: calls.append(w.shape) or ready(w, bias))
    ids = np.sort(rng.integers(0, 300, 1000)).astype(np.int16)
    lm_score.forward(lm_score.parts(lm_score.initial(np.ones(lm_score.VOCABULARY))), rng.integers(0, 300, (1000, 2 * lm_score.SIDE)).astype(np.int16), ids)
    assert len(calls) == 3  # the classes, and the words of two of them


def test_blocks_of_softmaxes_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.sort(rng.integers(0, 300, 1000)).astype(np.int16)
    p, context = lm_score.parts(lm_score.initial(np.ones(lm_score.VOCABULARY))), rng.integers(0, 300, (1000, 2 * lm_score.SIDE)).astype(np.int16)
    found = []
    for block in (10_000, 7):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        grads = []
        found.append([lm_score.forward(p, context, ids, lambda name, rows, g, grads=grads: grads.append(g)), *grads])
    assert len(found[0]) == len(found[1])
    for a, b in zip(*found):
        np.testing.assert_allclose(a, b, rtol=1e-3, atol=1e-3)


# Pages.

PAGES = [
    ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>a <b>b</b>c<p>d &amp; e</article><footer>f</footer>", "T a bc d & e"),
    ("<div class='page has-sidebar'><div id=content><p>" + "long text " * 30 + "<p>" + "more text " * 30 + "</div><div class=sidebar>side</div><ul class=menu><li><a href=a>x</a></ul></div>", " ".join((["long", "text"] * 30) + (["more", "text"] * 30))),
    ("<article><script>if(a<b)</script><p>x<!-- c --><br>y<style>p{}</style><form><input>q</form><div class=ad>buy</div><section id=comments>no</section></article>", "x y"),
    ("<article><p>one<td>two<li>three &nbsp; &lt;four&gt; &unknown; <", "one two three <four> &unknown; <"),
    ("<main><p>a</main><p class=cookie-notice>we use cookies</p><aside>b</aside>", "a"),
    ("<body><ul class=menu><li><a href=/>x</a></ul><div class=post-form><h1>Title</h1><p>" + "body text " * 40 + "</div></body>", "Title " + " ".join(["body text"] * 40)),
    ("<body><div class=story-related><p>" + "one two " * 25 + "<p>" + "six ten " * 25 + "</div><p>&copy; 2001 Someone", " ".join(["one two"] * 25 + ["six ten"] * 25)),
    ("<body><div class=rail><p>" + "body text " * 40 + "</div><div class=comments><p>" + "a reader says " * 90 + "</div>", " ".join(["body text"] * 40)),
    ("<body><div class=content><p>" + "long text " * 40 + "<p>" + "more text " * 40 + "</div><div><article><a href=/x>teaser</a></article></div>", " ".join(["long text"] * 40 + ["more text"] * 40)),
    ("<body><div class=widget><p>" + "an aside " * 20 + "</div><div><p>" + "long text " * 40 + "<p>" + "more text " * 40 + "</div>", " ".join(["long text"] * 40 + ["more text"] * 40)),
    ("<p title=it's>Hello world, don't lose me</p><p>tail</p>", "Hello world, don't lose me tail"),
    ("<article><p data-x='a>b' title = \"c > d\" q=\"e>one</p><p>two <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", "one two x=2"),
    ("<body><ul><li><a href=/>Home</a></li></ul><p>" + "plain text " * 30 + "</p><p>Copyright 2001 Someone</p></body>", " ".join(["plain text"] * 30)),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_whole_articles_of_all_pages(spark, sf):
    """The generated pages' articles, taken out by their tags."""
    import html

    for r in registry.QUERIES["op2_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [html.unescape(x) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner))]
        assert r["text"] == " ".join(" ".join(parts).split()) and r["n_chars"] == len(r["text"])


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        for tag in ("div", "span", "b><p", "i></u"):
            assert html_text.main_text(f"<article>{f'<{tag}>' * n}deep{'</div></span>' * n}") == "deep"
        return time.process_time() - began

    took(100)
    assert took(100_000) < 40 * took(10_000) + 1


@given(st.text(alphabet="<>/ab p=\"'!-&;", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_page_parses(page):
    html_text.main_text(page)
    html_text.main_text("<article><p>" + page)


# Urls.


def test_rules_survive_colliding_keys(monkeypatch, tmp_path):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b))
    rules = [("block", "a.com/x"), ("allow", "b.com/x"), ("block", "c.com/y")]
    (tmp_path / "i").write_bytes(url_filter.build_index(rules))
    index = url_filter.DigestIndex(str(tmp_path / "i"))
    found = index.find(["b.com/x", "c.com/y", "d.com/y", "a.com/x"])
    assert [index.rule(int(k)) if k >= 0 else None for k in found] == ["b.com/x", "c.com/y", None, "a.com/x"]


def test_the_five_rules(spark):
    cases = [
        ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://a.b.Example.COM/en/78?x=/es/", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"), ("http://notexample.com/en/7", "com/en/", "block"),
        ("https://com/en/", "com/en/", "block"), ("http://example.com/EN/7", None, "allow"), ("http://example.com/en", None, "allow"), ("http://x.net/de/1", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"), ("http://www.example.net/de/81#a", "example.net/de/8", "block"), ("http://badexample.net/de/8", "net/de/", "allow"), ("http://q.org/es/x", "org/es/", "block"),
        ("http://q.org/x/es/", None, "allow"), ("http://q.org.uk/es/", None, "allow"), ("no scheme", None, "allow"), ("a://b://com/en/", None, "allow"), ("http://q.org?/es/", None, "allow"), (None, None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(cases)], "page_id long, url string")
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert rows == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(cases)}
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules=(), default="block").collect()} == {"block"}


# Tokens.

SP = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
CODEC = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(sentencepiece_codec.MODEL))


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="the in▁ \naerñ", max_size=300)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t, ids in zip(texts, CODEC.encode(texts)):
        assert ids.tolist() == SP.encode(t)
        assert CODEC.decode(ids) == t.replace("▁", " ")


def test_many_letters_and_long_units():
    rng = random.Random(1)
    texts = ["".join(chr(rng.randint(0x3040, 0x9FA5)) for _ in range(2000)), "the" * 400, " " * 500, "".join(rng.choice("abcdef") for _ in range(3000))]
    assert [x.tolist() for x in CODEC.encode(texts)] == [SP.encode(t) for t in texts]


def test_decode_table(spark):
    texts = ["a b", "", "é  \n"]
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, texts))).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == texts


def test_decode_never_fails(spark):
    assert CODEC.decode([CODEC.vocabulary.bytes_[0x80]]) == "\ufffd" == SP.decode([CODEC.vocabulary.bytes_[0x80]])
    cases = [[CODEC.vocabulary.bytes_[0x80], 300], [-1], [10**9], [None, 300], [], None]
    rows = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(spark.createDataFrame(list(enumerate(cases)), "doc_id long, ids array<int>")).collect()}
    one = SP.decode([300])
    assert rows[0] == "\ufffd" + one and rows[1] == rows[2] and "⁇" in rows[1] and rows[3].endswith(one) and rows[4] == "" and rows[5] is None


# Licences.


def test_licences(spark):
    mit = next(t for n, t in licences.known() if n == "MIT")
    texts = ["Copyright (c) 2001 Somebody\n" + mit.upper().replace(",", " ,"), "some text\nReleased under the MIT licence!\nmore", "released under a MIT License", mit + " or not"]
    rows = {r["doc_id"]: r for r in licences.scan(frame(spark, texts)).collect()}
    assert rows[0]["whole_licence"] == "MIT" and rows[1]["licences"] == ["MIT"] and rows[1]["n_notices"] == 1
    assert rows[1]["whole_licence"] is None and rows[2]["licences"] == [] and rows[3]["licences"] == []


def test_spellings_of_whole_licences(spark):
    mit, bsd = (next(t for n, t in licences.known() if n == name) for name in ("MIT", "BSD-3-Clause"))
    mit = mit.partition("\n")[2]
    texts = [
        "Copyright (c) 2020, X\nAll rights reserved.\n\n" + bsd, "BSD 3-Clause License\n\nCopyright (c) 2020, X\n" + bsd, "Copyright 2001 Y\n" + bsd.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * "), bsd.replace("\n", " "),
        "The MIT License (MIT)\n\nCopyright (c) 2001 Z\n\n" + mit, "MIT License\n" + mit.replace("AUTHORS OR ", "AUTHORS OR\n").replace("The above ", "\nThe above\n"), "copyright notice\n" + bsd, "copyright holders\n" + mit,
    ]
    rows = {r["doc_id"]: r["whole_licence"] for r in licences.scan(frame(spark, texts)).collect()}
    assert rows == {0: "BSD-3-Clause", 1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "BSD-3-Clause", 4: "MIT", 5: "MIT", 6: None, 7: None}


@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0")])
def test_whole_licence_texts(spark, name, file):
    text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
    texts = [text, text.replace(" ", "  ").upper(), text[: len(text) // 2], text + "\nand more"]
    rows = {r["doc_id"]: r["whole_licence"] for r in licences.scan(frame(spark, texts)).collect()}
    assert rows == {0: name, 1: name, 2: None, 3: None}


# Leaks.


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


@given(st.text(alphabet="abc", min_size=1, max_size=90), st.text(alphabet="abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_myers(p, t):
    assert decontaminate.Pattern(0, p, 0.1).search(t)[0] == distance(p, t)


def test_leaks_with_edits_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(10, 30))) for _ in range(6)]
    texts = []
    for k in range(60):
        passage = list(items[k % 6])
        for _ in range(rng.randint(0, int(len(passage) * 0.16))):
            passage[rng.randrange(len(passage))] = rng.choice("abcdefgh ")
        texts.append(" ".join(word() for _ in range(20)) + " " + "".join(passage).upper() + "\n" + " ".join(word() for _ in range(20)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(frame(spark, texts), bench, block_chars=300).collect()}
    expected = {}
    for i, t in enumerate(map(decontaminate.normalise, texts)):
        for j, p in enumerate(map(decontaminate.normalise, items)):
            if (d := distance(p, t)) <= int(decontaminate.RATE * len(p)):
                expected[i, j] = d
    assert got == expected and len(expected) > 10
    left = {r["doc_id"] for r in decontaminate.drop_leaks(frame(spark, texts), bench).collect()}
    assert left == set(range(60)) - {i for i, _ in expected}


def test_short_items_are_found_as_they_stand(spark):
    items = [(1, "Seven sharp swords shine in snow, sir."), (2, "yes"), (3, "two words"), (4, "Pack my box")]
    texts = ["it says: seven  sharp swords\nshine in snow, SIR. and more", "xseven sharp swords shine in snow, sir.", "yes and two words", "YES", "unpack my boxes", "(pack my box)"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1), (3, 2), (5, 4)}


# Lines.


def test_repeated_passages_go_and_their_first_stays(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    texts = [" ".join(sentence() for _ in range(10)) for _ in range(12)]
    clean = set(range(12))
    for k in (2, 5, 9):
        texts[k] = texts[k] + "\n" + passage + "\n" + sentence()
        if k > 2:
            clean.discard(k)
    texts[7] = "\n".join([texts[7], texts[7]])  # within one document too
    clean.discard(7)
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert sum(passage in rows[k]["text"] for k in rows) == 1 and passage in rows[2]["text"]
    for k in clean:
        assert rows[k]["text"] == texts[k] and rows[k]["removed"] == 0
    assert rows[7]["removed"] == 10 and rows[5]["removed"] == 8
    lines = lambda t: [x.strip() for x in re.split(r"(?<=\n)|(?<=[.!?][ \t])", t) if x.strip()]
    before, after = ({x for t in ts for x in lines(t)} for ts in (texts, [rows[k]["text"] for k in rows]))
    assert before == after  # nothing is lost


def brute_cuts(texts, run_chars=line_dedup.RUN_CHARS):
    """(document, line) of every line in a run of so many characters that also stands earlier, pair by pair of positions."""
    docs = [[x.strip() for x in re.split(r"(?<=\n)|(?<=[.!?][ \t])", t)] for t in texts]
    cut = set()
    for d, b in enumerate(docs):
        for e, a in enumerate(docs[: d + 1]):
            for shift in range(1 if d == e else 1 - len(a), len(b)):
                run = []
                for i in range(max(0, shift), len(b) + 1):
                    if i < len(b) and i - shift < len(a) and b[i] == a[i - shift]:
                        run.append(i)
                        continue
                    if sum(len(b[k]) for k in run) >= run_chars:
                        cut.update((d, k) for k in run)
                    run = []
    return docs, cut


def check_cuts(spark, texts):
    docs, cut = brute_cuts(texts)
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for d, ls in enumerate(docs):
        kept = [x.strip() for x in re.split(r"(?<=\n)|(?<=[.!?][ \t])", rows[d]["text"])]
        assert rows[d]["removed"] == sum((d, k) in cut for k in range(len(ls)))
        assert [x for x in kept if x] == [x for k, x in enumerate(ls) if x and (d, k) not in cut]
    return cut


def test_runs_of_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(90)]
    texts = []
    for k in range(10):
        lo, n = rng.randrange(30), rng.randint(35, 60)
        texts.append("\n".join([word() for _ in range(rng.randint(0, 30))] + passage[lo : lo + n] + ["", ""] + [word() for _ in range(rng.randint(0, 30))]))
    texts += ["\n".join(["same"] * 150), "\n".join([*["same"] * 40, "", "end"])]
    assert len(check_cuts(spark, texts)) > 200


def test_runs_of_two_lines_and_of_later_first_places_against_brute_force(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    pairs = [(line(rng.randint(55, 115)), line(rng.randint(66, 115))) for _ in range(60)]
    texts = ["\n".join([line(rng.randint(20, 110)), *p, line(rng.randint(20, 110))]) for p in pairs for _ in range(2)]
    # Pairs of lines stand first in runs that are too short, and only then in the run that is repeated.
    a, b, c = line(50), line(50), line(50)
    texts += ["\n".join([line(90), *x, line(90)]) for x in ((a, b), (b, c), (a, b, c), (a, b, c))]
    assert len(check_cuts(spark, texts)) == 2 * len(pairs) + 3


def test_partial_earlier_copies_leave_no_repeat(spark):
    """An earlier document holds the beginning of a passage that two later ones hold whole, and runs overlap themselves."""
    rng = random.Random(10)
    line = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n)) + "."
    texts = []
    for _ in range(60):
        a, b, c = (line(rng.randint(25, 90)) for _ in range(3))
        texts += [" ".join([line(40), a, b, line(50)]), " ".join([line(40), a, b, c, line(50)]), " ".join([line(60), a, b, c, line(30)])]
    texts += [t.replace(" ", "\t") for t in texts[:30]] + [t.replace(". ", ". \x01") for t in texts[:9]]
    texts += ["\n".join(["again and again"] * 40), "\n".join([line(200), *[""] * 30, line(10), line(200)]), "\n".join(f"l{k % 7}" for k in range(400))]
    assert len(check_cuts(spark, texts)) > 100


@pytest.mark.parametrize("hot", [2, 12, 1024])
def test_frequent_fingerprints_are_joined_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = random.Random(12)
    line = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n)) + "."
    shared = [line(rng.randint(30, 150)) for _ in range(12)]
    texts = [" ".join([line(40), *shared[(lo := rng.randrange(9)) : lo + rng.randint(1, 5)], line(50)]) for _ in range(40)]
    assert len(check_cuts(spark, texts)) > 30


# Near duplicates.


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= 75 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("cell", [1_000_000, 400])
def test_components_against_brute_force(spark, sf, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    expected = components({i: shingles(t) for i, t in enumerate(texts)})
    rows = near_dedup.near_groups(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(shingles(t)) for i, t in enumerate(texts)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_links_between_sizes_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 300)
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    # Sets of nested texts, some a link apart only through one text; and the exact border, 3 to 4.
    texts = [" ".join(words[:n]) for n in (24, 30, 38, 49, 64, 83, 84, 109, 110, 111, 144, 190, 250, 330, 400)]
    texts += [" ".join(words[200 : 204 + n]) for n in (60, 80, 107)] + [" ".join(words[:n]) for n in (64, 190)]
    rng.shuffle(texts)
    expected = components({i: shingles(t) for i, t in enumerate(texts)})
    assert 1 < len(set(expected.values())) < len(texts) - 8
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, texts)).collect()} == expected


def test_bucket_links_connect_what_any_pair_connects():
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 40, 120):
        odd = rng.integers(0, 1 << 63, (max(1, m // 3), 8)).astype(np.uint64)[rng.integers(0, max(1, m // 3), m)]
        odd ^= np.packbits(rng.random((m, 512)) < rng.choice([0.02, 0.1, 0.14])).view(np.uint64).reshape(m, 8)
        links = near_dedup.bucket_links(odd)
        bits = np.bitwise_count(odd[:, None] ^ odd[None]).sum(2, dtype=int)
        assert all(bits[i, j] <= near_dedup.MOST_BITS for i, j in links)
        same = [set(components_of(m, x)) for x in (links, [(i, j) for i in range(m) for j in range(i) if bits[i, j] <= near_dedup.MOST_BITS])]
        assert same[0] == same[1]


def components_of(m, links):
    label = list(range(m))
    for i, j in links:
        old, new = label[j], label[i]
        label = [new if x == old else x for x in label]
    return [frozenset(i for i in range(m) if label[i] == x) for x in label]


def test_neighbours_meet_where_the_least_of_their_bucket_is_another(spark):
    """One bucket holds all documents, and the least one is like none of the others."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [" ".join(word() for _ in range(150))]
    for _ in range(4):
        base = [word() for _ in range(150)]
        for k in range(3):
            base[k * 40] = word()
            texts.append(" ".join(base))
    expected = components({i: shingles(t) for i, t in enumerate(texts)})
    got = {}
    signed = [(i, near_dedup.odd_sketch(near_dedup.signature(near_dedup.Shingler()(t))).tolist()) for i, t in enumerate(texts)]
    buckets = spark.createDataFrame([(0, i, o) for i, o in signed], "key long, rep long, odd array<long>")
    links = [(r["a"], r["b"]) for r in near_dedup._propose(buckets).collect()]
    for i, group in enumerate(components_of(len(texts), links)):
        got[i] = min(group)
    assert got == expected and len(set(got.values())) == 5


def test_odd_sketches_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.95, 0.85, 0.75):
        n = 2000
        both = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.r_[x[n - both : n], x[n : 2 * n - both]])
        bits = int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.signature(a)).view(np.uint64) ^ near_dedup.odd_sketch(near_dedup.signature(b)).view(np.uint64)).sum())
        errors.append(abs(near_dedup.similarity_of(bits) - share))
        assert bits <= near_dedup.MOST_BITS
    assert max(errors) < 0.15


# Quality.


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = registry.QUERIES["op9_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(good) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_is_learnt_from_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.dictionaries == b.dictionaries and np.array_equal(a.weights, b.weights)


# Exact duplicates.


@pytest.mark.parametrize("hot", [2000, 2])
def test_block_names_against_grouping(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", 1024 if hot == 2000 else 20)
    rng = random.Random(4)
    kinds = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["a" * 16, "a" * 17, "", "ab" * 16]
    texts = [rng.choice(kinds) for _ in range(300)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    rows = exact_dedup.exact_groups(frame(spark, texts), block_chars=4, hot_rows=hot).collect()
    assert len(rows) == 300
    for r in rows:
        own = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
