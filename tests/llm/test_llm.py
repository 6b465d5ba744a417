"""Each training-data operator against a brute-force version, and on awkward tables."""

import hashlib
import html
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import html_text, imatch, masked_lm, mixing, neardup, packing, quality, sharding, substrings, tokens, vptree, words
from quern.llm import queries as Q

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=60, seed=1):
    """Texts with copies, near copies, shared passages and oddities."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    shared = " ".join(rnd.choices(vocabulary, k=40))
    out = []
    for i in range(n):
        body = rnd.choices(vocabulary, k=rnd.randrange(1, 120))
        if i % 5 == 1 and out:
            body = out[rnd.randrange(len(out))].split()
            if i % 10 == 1 and body:
                body[rnd.randrange(len(body))] = "changed"
        text = rnd.choice([" ", "  ", "\n"]).join(body)
        out.append(f"{text}\n{shared} end" if i % 6 == 0 else text)
    return out


AWKWARD = [None, "", "  \n\t ", "one", "two words", "x" * 50_000, " ".join(f"long{i % 997}" for i in range(60_000)), "tie tie tie", "tie tie tie", "a\x00b é 漢字 😀"]


def documents(spark, bodies, extra=True):
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t) if t is not None else None) for i, t in enumerate(bodies)]
    if extra:
        rows += [(None, "no id here", None, None, None), (3, bodies[3], "en", "src0", 1), (3, bodies[3], "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("block", "part", "score", "shard", "ids", "length", "k", "n", "component", "_h", "_n", "_row", "lead")
    return df.selectExpr("*", *(f"'keep' AS {n}" for n in names)) if extra else df


@pytest.fixture(scope="module")
def mixed_docs(spark):
    return documents(spark, texts() + AWKWARD)


@pytest.fixture(scope="module")
def no_docs(spark):
    return documents(spark, ["", "", "", ""]).limit(0)


def test_word_hashes():
    bodies = [t or "" for t in texts() + AWKWARD]
    data, offsets = words.buffers(pa.array([*bodies, None]))
    w = words.split(data, offsets)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == [x for t in bodies for x in WORD.findall(t)]
    seen = {}
    for x, h in zip((x for t in bodies for x in WORD.findall(t)), w.hashes.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    """A word of n letters and its complement: any polynomial hash modulo a power of two confuses long ones."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate({97: "b", 98: "a"})


def test_long_alike_words_are_told_apart(spark):
    pairs = [thue_morse(n) for n in (64, 1024, 4096)]
    words_ = [x for p in pairs for x in p]
    data, offsets = words.buffers(pa.array([" ".join(words_)]))
    w = words.split(data, offsets)
    assert len(set(w.hashes.tolist())) == 6 and len(set(words.hash_ranges(w.data, w.starts, w.ends, 1).tolist())) == 6
    library = Tokenizer.from_file(VOCABULARY)
    data, offsets = words.buffers(pa.array([f"go {x} on" for x in words_]))
    ids, cut = tokens.encoder(VOCABULARY).many(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [e.ids for e in library.encode_batch([f"go {x} on" for x in words_], add_special_tokens=False)]
    bodies = [" ".join([f"v{i}" for i in range(7)] + [x] + [f"u{i}" for i in range(7)]) for x in words_]
    docs = documents(spark, bodies, extra=False)
    kept = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == list(repeats(list(enumerate(bodies)), 13))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == jaccard_components(list(enumerate(bodies)))
    marks = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints_beside_next(docs).collect()}
    assert len(set(marks.values())) == 6


def test_a_shared_hash_does_not_share_ids(monkeypatch):
    monkeypatch.setattr(words, "hash_ranges", lambda b, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    bodies = [t or "" for t in texts(20)] + [f"go {x} on" for x in thue_morse(64)]
    data, offsets = words.buffers(pa.array(bodies))
    ids, cut = tokens.encoder(VOCABULARY).many(data, offsets)
    library = Tokenizer.from_file(VOCABULARY)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [e.ids for e in library.encode_batch(bodies, add_special_tokens=False)]


# 1


def test_pages_as_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_parts_that_are_not_the_article():
    filler = "Enough words stand in this paragraph that it counts as the main text of a page. " * 3
    page = f"""<html><head><title>t</title></head><body><header>Site</header><div class="cookie-notice">Cookies</div>
    <div id=content><h2>Title &amp; more</h2><p>{filler}</p><p>Short.</p><form><label>Mail</label></form><p>{filler}</p></div>
    <div class="left_sidebar"><p>{filler}</p></div><section class=comments><p>{filler}</p></section><footer>x</footer><script>{filler}"""
    line = " ".join(filler.split())
    assert html_text.extract(page) == "\n".join(["Title & more", line, "Short.", line])
    assert html_text.extract("<article><p>a<br>b&nbsp; c</p><aside>x</aside><p>d</article><p>e") == "a b c\nd"
    assert html_text.extract("") == "" and html_text.extract("<nav>x</nav>") == ""


def test_an_article_element_does_not_hide_higher_text():
    long, other = "The whole story is told in this line. " * 12, "A second part of the story follows here. " * 10
    long, other = long.strip(), other.strip()
    comment = "<div id=thread><article><p>I liked it.</p></article></div>"
    assert html_text.extract(f"<div id=content><p>{long}</p></div>{comment}") == long
    cards = "".join(f"<article class=card><p>Teaser {i}</p></article>" for i in range(5))
    assert html_text.extract(f"<div id=content><p>{long}</p></div><div>{cards}</div>") == long
    # An article with a high candidate is kept whole, others are not; main is never lost.
    assert html_text.extract(f"<article class=post-1><p>{long}</p><aside>x</aside><p>End.</p></article><article class=post-2><p>Hi.</p></article><p>{other}</p>") == f"{long}\nEnd."
    assert html_text.extract(f"<main><p>Brief.</p></main><div id=content><p>{long}</p></div>") == f"Brief.\n{long}"


def test_short_parts_of_the_container_with_the_text():
    long = ("The whole story is told in this line. " * 14).strip()
    assert html_text.extract(f"<div id=content><p>{long}</p><aside>x</aside><p>Short end.</p></div>") == f"{long}\nShort end."
    page = f"<div id=top>Site name</div><nav>x</nav><div id=content><h1>Title</h1><p>Lead.</p><div class=ad>x</div><div><p>{long}</p></div><form>x</form><div><ul><li>Point</ul></div></div><nav>x</nav><div id=end>Imprint</div>"
    assert html_text.extract(page) == f"Title\nLead.\n{long}\nPoint"
    assert html_text.extract(f"<body><p>{long}</p><aside>x</aside><p>End.</p><nav>x</nav><div>Imprint</div></body>") == f"{long}\nEnd."


def test_parts_by_their_names():
    long = ("The whole story is told in this line. " * 14).strip()
    page = lambda part: f"<body><nav>x</nav><article><h1>T</h1><p>{long}</p>{part}<p>End.</p></article><footer>f</footer>"
    assert html_text.extract(page('<p class="advert">Buy now</p>')) == f"T\n{long}\nEnd."
    assert html_text.extract(page('<section class="related-work"><p>Others found this.</p></section>')) == f"T\n{long}\nOthers found this.\nEnd."
    assert html_text.extract(page('<div class="notice-board"><p>A board.</p></div>')) == f"T\n{long}\nA board.\nEnd."
    assert html_text.extract(page('<div class="related-links"><p>See.</p></div><li class=ad-1x>Ad</li><ul id="share_box"><li>Tweet</ul>')) == f"T\n{long}\nEnd."
    teaser = "<article><h2>Another story</h2><p>Read it here.</p></article>"
    assert html_text.extract(f"<body><article><p>{long}</p></article>{teaser}</body>") == long
    other = ("A second post is told as fully as the first one. " * 12).strip()
    assert html_text.extract(f"<body><article><p>{long}</p></article>{teaser}<article><p>{other}</p></article></body>") == f"{long}\n{other}"
    owner = "&copy; 2024 The Site and its many friends. All rights reserved in every country of the whole world."
    assert html_text.extract(f"<body><div id=text><p>{long[:300]}</p></div><div id=end>{owner}</div></body>") == long[:300].strip()


def test_names_lower_a_candidate_and_elements_rule_it_out():
    long = ("The whole story is told in this line. " * 14).strip()
    reader = ("I liked it a lot and want to say so at length. " * 6).strip()
    page = lambda part, after="": f"<body><nav>x</nav><article><h1>T</h1><p>{long}</p>{part}<p>End.</p></article>{after}<footer>f</footer>"
    story = f"T\n{long}\nEnd."
    for part in (
        f'<article class="comment"><p>{reader}</p></article>', f'<article class="sponsored"><p>{reader}</p></article>', '<p><span class="ad">Buy now</span></p>',
        '<p><b class="advert">Buy now</b></p>', '<div class="disclaimer"><p>No advice.</p></div>', '<div role="note"><p>Note.</p></div>',
        f'<div class="responses"><p>{reader}</p></div>', f"<div hidden><p>{reader}</p></div>", f'<p style="color:red; display: none">{reader}</p>', "<p><i hidden>gone</i></p>",
    ):
        assert html_text.extract(page(part)) == story, part
    for part in (f'<article class="comment"><p>{reader}</p></article>', f'<article class="sponsored"><p>{reader}</p></article>', f'<div class="responses"><p>{reader}</p></div>'):
        assert html_text.extract(page("", part)) == story, part
    # The only or by far the highest text is kept whatever its container is called.
    assert html_text.extract(f'<body><nav>x</nav><div class="search"><article><p>{long}</p></article></div></body>') == long
    assert html_text.extract(f'<div class="sidebar"><p>{long}</p></div><div><p>Short.</p></div>') == long
    assert html_text.extract(f'<article><section id="comment"><p>{long}</p><p>{long}</p></section></article>') == f"{long}\n{long}"
    assert html_text.extract(f'<article class="widget"><p>{long}</p></article>') == long
    # What is out by its element, what readers wrote beside an article, and adverts never come back.
    for part in (f"<aside><p>{long}</p></aside>", f'<div class="comments"><p>{long}</p></div>', f'<div class="ad-box"><p>{long}</p></div>', f'<p class="cookie-notice">{long}</p>'):
        assert html_text.extract(part) == "" and html_text.extract(f"{part}<div><p>Short.</p></div>") == "Short."
    assert html_text.extract(f'<article><p>{long} <span class="overflow hidden">seen</span> <em title="a hidden thing">too</em></p></article>') == f"{long} seen too"
    assert html_text.extract(f'<article><p>a <span class="ad">x <span>y</span> z</span> b</p><p><span class=ad>open<p>c</p></article>') == "a b\nc"


def test_long_pages_take_linear_time():
    for page in ("<div>" * 200_000, "<a " * 333_000, '<a "' * 250_000, "<div></p></x></div>" * 50_000, "<!--" * 250_000, "<p class=x>a" * 90_000):
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 4  # two seconds on an idle machine
    assert html_text.lines("a<!-- b > c")[0] == [("a", True, 0, 0)] and html_text.lines("a<script>b > c")[0] == [("a", True, 0, 0)]
    assert html_text.lines("<p>a</p>b <c d")[0][-1][0] == "b <c d"


def test_pages_with_extra_columns_and_repeated_rows(spark):
    rows = [(1, "u", "<p>x</p>")] * 3 + [(2, "v", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'keep' AS text", "7 AS n_chars")
    got = html_text.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(tuple(r) for r in got.collect()) == [(1, "u", "x", 1)] * 3 + [(2, "v", "", 0)]


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 20_000), (None, "u", "<article>" + "x " * 100_000), (3, "u", "<!-- open"), (3, "u", "a <b c='")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["n_chars"] for r in got[:3]] == [0, 0, 0] and got[3]["n_chars"] == 199_999
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op2_compression(spark, sf).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.05
    assert np.mean([(g > bad.score).mean() for g in good.score]) > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_scores_against_brute_force(spark, sf):
    """Dictionaries, features and logistic curve by the definition, for texts of all lengths."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def squeeze(raw, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))

    for r in quality.with_score(docs, model).collect()[::7]:
        raw = (r["text"] or "").encode()
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        good, bad = (sum(squeeze(b, d) for b in blocks) for d in (model.good, model.bad))
        n = len(raw) + 8
        z = np.dot(model.weights, [(bad - good) / n, good / n, squeeze(raw, b"") / n]) + model.bias
        assert r[quality.SCORE] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_quality_sample(spark):
    """Labels without a usable text take no place in the sample, and long samples are used whole."""
    good, bad = "clean words of a text that reads well ", "BUY now!!! 0000 click $$$ "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(60)] + [(100 + i, None) for i in range(500)] + [(2000 + i, "x" * 5000) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic")
    model = quality.train(docs, labels, sample=20, sample_bytes=4000)
    got = {r["doc_id"]: r[quality.SCORE] for r in quality.with_score(docs, model).collect()}
    assert min(got[i] for i in range(60) if i % 2) > max(got[i] for i in range(60) if not i % 2)
    many = [bytes([65 + i % 26]) * 200 + str(i).encode() * 100 for i in range(400)]
    seen = []
    real = zstandard.train_dictionary
    try:
        quality.zstandard.train_dictionary = lambda size, blocks: seen.extend(blocks) or real(size, blocks)
        quality._dictionary(many * 30)
    finally:
        quality.zstandard.train_dictionary = real
    assert sum(map(len, seen)) == sum(map(len, many)) * 30


def test_few_labels_build_no_dictionary_that_they_are_fitted_with(spark, monkeypatch):
    """Below ``FEW`` texts of a class each is fitted with dictionaries of the others, above it one half with those of the other."""
    seen = []
    real = quality._features
    monkeypatch.setattr(quality, "_features", lambda good, bad: lambda text: seen.append((good, bad, text)) or real(good, bad)(text))
    for n in (3, 12, 60):
        seen.clear()
        rows = [(i, f"{'good prose' if i % 2 else 'BUY NOW'} number {i} " * (i + 2)) for i in range(2 * n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))
        assert seen and not any(text in good or text in bad for good, bad, text in seen)


def test_untrained_dictionary_is_taken_evenly():
    texts = [bytes([i]) * 700 for i in range(1, 251)]
    whole = quality._evenly([t[i : i + quality.BLOCK] for t in texts for i in range(0, len(t), quality.BLOCK)])
    assert len(whole) <= quality.DICT_BYTES and {1, 250} <= set(whole) and len(set(whole)) > 60
    assert quality._evenly([b"ab", b"c"]) == b"ab\nc" and quality._evenly([]) == b""


def test_quality_awkward(spark, mixed_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (2, None, 1), (None, 1, 0), (5, 1, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(mixed_docs, labels)
    assert got.count() == mixed_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.classify(mixed_docs, labels.limit(0)).collect()} == {0.5}
    scored = quality.with_score(mixed_docs.withColumn(quality.SCORE, mixed_docs["doc_id"]), quality.train(mixed_docs, labels))
    assert scored.columns == [*mixed_docs.columns, quality.SCORE]


# 3


def test_mixing_bounds_repetition(spark):
    docs = documents(spark, texts(400), extra=False).withColumn("n", mixing.word_count())
    out = mixing.mix_sources(docs, max_repetition=2.0).toPandas()
    assert set(out.doc_id) == set(range(400)) and list(out.columns) == [*docs.columns, "_epoch", "_block_at", "_at"]
    assert out.groupby("doc_id").size().max() <= 2
    once = docs.toPandas()
    rate = out.fillna("-").groupby("source").n.sum() / once.fillna("-").groupby("source").n.sum()
    assert rate.min() >= 1 and rate.max() <= 2.1


def test_mixing_weights(spark):
    tokens_of = {"a": 900, "b": 90, "c": 10}
    for target in (0.2, 0.6, 1.0):
        alpha = mixing.exponent_for_entropy(tokens_of, target)
        assert mixing.entropy(mixing.weights(tokens_of, alpha)) == pytest.approx(target, abs=1e-6)
    w = mixing.weights(tokens_of, mixing.exponent_for_repetition(tokens_of, 4))
    rate = [w[s] / tokens_of[s] for s in w]
    assert max(rate) / min(rate) == pytest.approx(4)
    assert mixing.exponent_for_repetition({"a": 1}, 1) <= 1


def test_mixing_budget_is_a_prefix_of_a_permutation(spark):
    docs = documents(spark, texts(300), extra=False)
    total = sum(max(1, len(WORD.findall(t))) for t in texts(300))
    small = mixing.mix_sources(docs, 1.0, budget=total // 3).toPandas()
    more = mixing.mix_sources(docs, 1.0, budget=total // 2).toPandas()
    assert set(small.doc_id) < set(more.doc_id)
    taken = sum(max(1, len(WORD.findall(t))) for t in small.text)
    assert total // 3 <= taken <= total // 3 + 4 * 200


def test_mixing_against_brute_force(spark, monkeypatch):
    """Shares, whole passes and the cut of the partial pass by the definition, for both limits."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    bodies = texts(300, seed=4) + ["", None, "one"]
    docs = documents(spark, bodies, extra=False)
    n = {i: max(1, len(WORD.findall(t or ""))) for i, t in enumerate(bodies)}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    tokens_of: dict = {}
    for i, s in source.items():
        tokens_of[s] = tokens_of.get(s, 0) + n[i]
    total = sum(tokens_of.values())
    # Two whole passes show the order in which each pass reads a source.
    full = mixing.mix_sources(docs, 1.0, budget=2 * total).toPandas()
    assert len(full) == 2 * len(bodies) and set(full._epoch) == {0, 1}
    for args, budget in (({"max_repetition": 1.0}, int(1.4 * total)), ({"max_repetition": 1.5}, int(1.2 * total)), ({"target_entropy": 1.0}, int(0.6 * total)), ({"target_entropy": 1.3}, total // 2)):
        alpha = mixing.exponent_for_entropy(tokens_of, args["target_entropy"]) if "target_entropy" in args else mixing.exponent_for_repetition(tokens_of, args["max_repetition"])
        p = {s: (x / total) ** alpha for s, x in tokens_of.items()}
        w = {s: x / sum(p.values()) for s, x in p.items()}
        if "target_entropy" in args:
            assert -sum(x * np.log(x) for x in w.values()) <= args["target_entropy"] + 1e-9
        got = mixing.mix_sources(docs, budget=budget, **args).toPandas()
        want = []
        for s in tokens_of:
            reads = budget * w[s] / tokens_of[s]
            assert reads < 2
            for epoch in (0, 1):
                rest = min(1.0, reads - epoch) * tokens_of[s]
                of = full[(full._epoch == epoch) & ((full.source == s) if s is not None else full.source.isna())].sort_values(["_block_at", "_at"])
                before = 0
                for i in of.doc_id:
                    if before < rest - 1e-6:
                        want.append((i, epoch))
                    before += n[i]
        assert sorted(zip(got.doc_id, got._epoch)) == sorted(want)


def test_mixing_awkward(mixed_docs, no_docs):
    out = mixing.mix_sources(mixed_docs)
    assert out.columns[:-3] == mixed_docs.columns and out.where("_h <> 'keep' or _n <> 'keep' or _row <> 'keep'").count() == 0
    assert out.select("doc_id").distinct().count() == mixed_docs.select("doc_id").distinct().count()
    assert mixing.mix_sources(no_docs).count() == 0


# 4


def test_tokens_equal_the_library():
    rnd = random.Random(5)
    odd = [" ", "  ", "\n", "a", "b's", "\xa0", "　", "\x1c", "\x85", "é", "漢字", "123", "...", "<|endoftext|>", "\t", "Z", "😀", "\x00", "'"]
    bodies = [t or "" for t in texts() + AWKWARD[:6] + AWKWARD[7:]] + ["".join(rnd.choices(odd, k=rnd.randrange(14))) for _ in range(3000)]
    bodies += [t.replace("<|endoftext|>", "") for t in bodies[-3000:]]
    library = Tokenizer.from_file(VOCABULARY)
    for part in (bodies[:3000], bodies[3000:], bodies[-3000:]):
        data, offsets = words.buffers(pa.array(part))
        ids, cut = tokens.encoder(VOCABULARY).many(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_fullest_is_the_largest_subset_sum():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        room = rnd.randrange(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        use = packing.fullest(counts, room)
        assert all(k <= counts[x] for x, k in use.items())
        assert sum(x * k for x, k in use.items()) == max(s for s in sums if s <= room)


def test_packing(spark, mixed_docs, no_docs):
    got = packing.pack_documents(mixed_docs, VOCABULARY, 128).toPandas()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in mixed_docs.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        head = (len(ids) - 1) % 128 + 1
        for k, a in enumerate([0, *range(head, len(ids), 128)]):
            part = ids[a : head if k == 0 else a + 128]
            want.append((r["doc_id"], k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    mine = [(None if np.isnan(i) else int(i), *x) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    key = lambda x: (x[0] is None, x)
    assert sorted(mine, key=lambda x: (x[0] or -1, x[1:])) == sorted(want, key=lambda x: (x[0] or -1, x[1:])), key
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 128
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) + 1
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = documents(spark, texts(20), extra=False).select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a null id"), (1, "another row of one"), (1, "another row of one"), (None, None)], "doc_id long, text string"))
    cut = packing.scratch.save(packing.pieces(docs, VOCABULARY, 64), "t")
    placed = packing.pack(cut, 64)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    rows = placed.collect()
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows) and len(rows) == cut.count()
    assert sum(r["doc_id"] is None for r in rows) == 2 and max(map(len, whole.values())) <= 4 * 64


# 5


def repeats(rows, n):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[p : p + n])
                first[k] = min(i, first.get(k, i))
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("block_bytes", [1 << 12, 1 << 24])
def test_repeats(mixed_docs, no_docs, block_bytes):
    got = substrings.remove_repeats(mixed_docs, block_bytes=block_bytes, slice_bits=12)
    rows = [tuple(r) for r in mixed_docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    mine = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=key)
    assert mine == sorted(repeats(rows, 13), key=key)
    assert sum(r[2] for r in mine) > 0
    assert substrings.remove_repeats(no_docs).count() == 0
    same = got.where("n_removed = 0").select("doc_id", "new_text").collect()
    by_id = dict(rows)
    assert all(r["new_text"] == by_id[r["doc_id"]] for r in same)


def test_places_round_trip():
    rng = np.random.default_rng(0)
    for top, n in ((1 << 12, 3000), (1 << 22, 50), (1 << 22, 0), (1 << 30, 5), (300, 1)):
        places = np.sort(rng.integers(0, top, n))
        assert (substrings._unpack(substrings._pack(places)) == places).all()


# 6


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = sum(x[:, j] * x[i, j] for j in range(x.shape[1]))
        s[i] = -np.inf
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


@pytest.mark.parametrize("shard", [64, 8192])
def test_neighbours(spark, shard):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, size=(400, 1))
    x[100:160] = x[7]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] + [1.0] * 7, 0), (1060, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (1080, [float("inf")] * 8, 0)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard, block=8, leaf=8)
    mine = {}
    for r in got.orderBy("query_id", "rank").collect():
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine == exact(np.arange(400), x.astype(np.float64), 20)


def test_neighbours_with_equal_scores(spark):
    # One-hot vectors in a mixed order of ids: all but one of the others score 0.
    ids = list(range(0, 300))
    random.Random(6).shuffle(ids)
    rows = [(i, [float(j == n % 150) for j in range(150)]) for n, i in enumerate(ids)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=8).collect()
    by_id = dict(rows)
    for q in range(0, 300, 20):
        score = {i: float(np.dot(by_id[q], v)) for i, v in rows if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vptree.nearest(df).collect()] == [(0, 1, 1, 0.5)]
    assert vptree.nearest(df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids_and_extra_columns(spark):
    """Ties of a hundred different vectors, a vec_id on equal and on different vectors, columns with the operator's own names."""
    rows = [(20, [1.0, 0.0])] + [(i, [1.0, float(i)]) for i in range(21, 121)] + [(30, [1.0, 30.0])] * 3 + [(200, [0.5, 0.0]), (200, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS cell", "1 AS shard", "2 AS v", "3 AS ids", "4 AS query_id", "5 AS least")
    for shard in (16, 8192):
        got = vptree.nearest(df, shard=shard, block=8, leaf=4).collect()
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == 20), key=lambda r: r["rank"])]
        assert mine == [(i, 1.0) for i in range(21, 41)]
        assert sum(r["query_id"] == 200 for r in got) == 40  # a list for each of its vectors
    far = [(i, [float(i)]) for i in range(5)] + [(40 + i, [1.0, 2.0, 3.0]) for i in range(3)]
    got = vptree.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(40, 1, 41), (40, 2, 42)]


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 100, d)) * 3
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, d)) * 0.1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_queries_ask_only_cells_that_they_meet():
    """Shards that queries are sent to stay as many while shards grow fourfold: rows dealt are linear in the table."""
    asked = {}
    for n in (4000, 16000):
        x = clustered(n, 6, 2)
        space = vptree.Space(float((x**2).sum(axis=1).max()), vptree.Cells(np.zeros((0, 7)), 1))
        cells = vptree.Cells(space.raised(x[:: max(1, n // (16 * n // 250))]), n // 250)
        raised = space.raised(x)
        assert np.bincount(cells.of(raised)).max() < 4 * 250
        q = vptree._stretched(x[::20], space.top)[0]
        d = np.sort(((q[:, None] - raised[None]) ** 2).sum(axis=2), axis=1)[:, 20]
        near = cells.near(q, np.sqrt(d) + 1e-9)
        # No point as near lies in a cell that is left out.
        of = cells.of(raised)
        for i in range(0, len(q), 25):
            inside = ((q[i] - raised) ** 2).sum(axis=1) <= d[i]
            assert set(of[inside]) <= set(near[i].tolist())
        asked[n] = np.mean([len(c) for c in near])
    assert asked[16000] < 2 * asked[4000]


@pytest.mark.parametrize("relax,recall", [(1.0, 1.0), (0.9, 0.95), (0.8, 0.9)])
def test_relaxed_search_keeps_recall(spark, sf, relax, recall):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    want = exact(np.array(list(x)), np.stack(list(x.values())), 20)
    got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(v, relax=relax, shard=32, leaf=16).collect()}
    assert len(got & {(q, i) for q, found in want.items() for i, _ in found}) >= recall * sum(map(len, want.values()))


# 7


def jump(key, n):
    b, j, key = -1, 0, key & ((1 << 64) - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    rnd = random.Random(0)
    keys = [rnd.randrange(-(2**63), 2**63) for _ in range(300)] + [0, 1, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17):
        assert [r[0] for r in df.select(sharding.jump_hash(df["k"], n)).collect()] == [jump(k, n) for k in keys]


def test_shards(mixed_docs, no_docs):
    got = sharding.shard_documents(mixed_docs, 4).toPandas()
    assert len(got) == mixed_docs.count()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    # The key is Spark's own hash of the id, XXH64 with seed 42; that of null is the seed.
    keys = [42 if np.isnan(i) else xxhash.xxh64_intdigest(struct.pack("<q", int(i)), 42) for i in got.doc_id]
    assert got.shard.tolist() == [jump(k, 4) for k in keys] and got.grown_shard.tolist() == [jump(k, 5) for k in keys]
    plain = sharding.shard_documents(mixed_docs, 4, mixed=False).toPandas()
    assert plain.shard.tolist() == [jump(0 if np.isnan(i) else int(i), 4) for i in plain.doc_id]
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 4).all()
    bodies = [(r["text"] or "").encode() for r in mixed_docs.collect()]
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len(b) + 1, zlib.crc32(b)) for b in bodies)
    assert sharding.shard_documents(no_docs).count() == 0


# 8


def test_masked_lm(spark, mixed_docs, no_docs):
    got = masked_lm.score_documents(mixed_docs).toPandas()
    assert sorted(got.n_tokens) == sorted(len(WORD.findall(r["text"] or "")) for r in mixed_docs.collect())
    assert (got.log_prob <= 0).all() and (got[got.n_tokens == 0].log_prob == 0).all()
    assert masked_lm.score_documents(no_docs).count() == 0


def test_masked_lm_rare_words_have_their_own_shares(spark):
    rnd = random.Random(5)
    clean = [f"w{i}" for i in range(masked_lm.VOCABULARY)] * 2
    rnd.shuffle(clean)
    junk = [f"x{rnd.getrandbits(48):012x}" for _ in range(24_000)] + ["again", "again"]
    rows = [(i, " ".join(clean[i * 64 : i * 64 + 64])) for i in range(256)] + [(1000 + i, " ".join(junk[i * 64 : i * 64 + 64])) for i in range(376)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocabulary = masked_lm.count_vocabulary(docs)
    flat = masked_lm.train(docs, vocabulary)
    got = {r["doc_id"]: r["mean_log_prob"] for r in masked_lm._scored(docs, vocabulary, flat).collect()}
    assert len(got) == len(rows)
    # Words that occur once are less likely than words that occur twice, however many share a bucket.
    assert np.mean([v for i, v in got.items() if i < 1000]) > np.mean([v for i, v in got.items() if i >= 1000])
    # Against the model alone, each rare word differs by the logarithm of its own count.
    alone = docs.mapInArrow(masked_lm._scorer(vocabulary, flat), "doc_id long, n_tokens long, log_prob double, mean_log_prob double").collect()
    known = set(clean)
    counts = {r["term"]: r["n"] for r in vocabulary.counts.collect()}
    assert len(counts) == len(known) + len(set(junk))
    ids = set(vocabulary.terms.tolist())
    for r in alone:
        text = dict(rows)[r["doc_id"]]
        h = masked_lm._terms(words.split(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))
        more = sum(np.log(counts[int(x.view(np.int64))] / masked_lm.UNSEEN) for x in h if int(x) not in ids)
        assert got[r["doc_id"]] * len(h) == pytest.approx(r["log_prob"] + more, abs=1e-3)


def test_masked_lm_trains_on_every_word(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two words", None, "", "a b c d e", "f " * 5000])], "doc_id long, text string").repartition(2)
    vocabulary = masked_lm.count_vocabulary(docs)
    seen = docs.select("text").mapInArrow(masked_lm._train(vocabulary, masked_lm.Network.fresh(vocabulary).flat), masked_lm._PIECES).where("piece = 0").collect()
    assert sum(r["words"] for r in seen) == 1 + 2 + 5 + 5000


def test_masked_lm_learns_order(spark):
    rnd = random.Random(4)
    names = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(600):
        a = rnd.randrange(40)
        rows.append((i, " ".join(names[(a + j) % 40] for j in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vocabulary = masked_lm.count_vocabulary(docs)
    flat = masked_lm.train(docs, vocabulary, rounds=2)
    shuffled = spark.createDataFrame([(0, rows[0][1]), (1, " ".join(rnd.sample(rows[0][1].split(), 60)))], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_prob"] for r in shuffled.mapInArrow(masked_lm._scorer(vocabulary, flat), "doc_id long, n_tokens long, log_prob double, mean_log_prob double").collect()}
    assert got[0] > got[1] + 0.5


def test_masked_lm_against_brute_force(spark):
    """Scores of small texts by the definition: a full softmax over all ids from both sides, then the word's share of its bucket."""
    bodies = [*texts(40), None, "", "one", "one", "tie tie tie"] + [" ".join(f"r{i}x{k}" for i in range(200)) for k in range(45)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(3)
    vocabulary = masked_lm.count_vocabulary(docs)
    flat = masked_lm.train(docs, vocabulary)
    e, w1, b1, wg, wm = (p.astype(np.float64) for p in masked_lm.Network(flat).parts)
    # Every id's probability given its neighbours sums to one over all ids.
    counts: dict[str, int] = {}
    for t in bodies:
        for x in WORD.findall(t or ""):
            counts[x] = counts.get(x, 0) + 1
    term = {x: int(masked_lm._terms(words.split(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])))[0]) for x in counts}
    known = dict(zip(vocabulary.terms.tolist(), vocabulary.ids.tolist()))
    low = masked_lm.BUCKETS - 1
    number = {x: known.get(t, masked_lm.VOCABULARY + (t & low)) for x, t in term.items()}
    inside: dict[int, float] = {}
    for x in counts:
        if term[x] not in known:
            inside[term[x] & low] = inside.get(term[x] & low, masked_lm.UNSEEN) + counts[x]
    assert any(n in known for n in term.values()) and inside

    def log_p(ids, i):
        near = [ids[i + s] if 0 <= i + s < len(ids) else masked_lm._N for s in range(-masked_lm.SIDE, masked_lm.SIDE + 1) if s]
        h = np.r_[np.tanh(np.concatenate([e[k] for k in near]) @ w1 + b1), 1]
        a = h @ wg
        b = np.stack([h @ wm[g] for g in range(masked_lm.GROUPS)])
        p = np.exp(a - np.logaddexp.reduce(a))[:, None] * np.exp(b - np.logaddexp.reduce(b, axis=1)[:, None])
        assert p.sum() == pytest.approx(1)
        return np.log(p.reshape(-1)[vocabulary.place[ids[i]]])

    got = {r["doc_id"]: r for r in masked_lm._scored(docs, vocabulary, flat).collect()}
    for i, t in enumerate(bodies[:45]):  # the others only supply rare words
        own = WORD.findall(t or "")
        ids = [number[x] for x in own]
        want = sum(log_p(ids, k) + (np.log(counts[x] / inside[term[x] & low]) if term[x] not in known else 0) for k, x in enumerate(own))
        assert got[i]["n_tokens"] == len(own) and got[i]["log_prob"] == pytest.approx(want, abs=2e-3 * (1 + len(own)))
    assert got[42]["log_prob"] == pytest.approx(got[43]["log_prob"], abs=1e-5)


def test_masked_lm_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, rest = docs.where("doc_id % 5 <> 0").repartition(2), docs.where("doc_id % 5 = 0")
    vocabulary = masked_lm.count_vocabulary(train)
    mean = {}
    for name, flat in (("counts", masked_lm.Network.fresh(vocabulary).flat), ("network", masked_lm.train(train, vocabulary))):
        got = masked_lm._scored(rest, vocabulary, flat).agg({"log_prob": "sum", "n_tokens": "sum"}).first()
        mean[name] = got["sum(log_prob)"] / got["sum(n_tokens)"]
    assert mean["network"] > mean["counts"] + 0.3


# 9


def test_fingerprints(mixed_docs, no_docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in mixed_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
    docs = mixed_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = imatch.fingerprints_beside_next(docs, parts=5).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_chars"]) for r in got] == [(i, len(t)) for i, t in rows]
    following = [t for _, t in rows[1:]] + [rows[0][1]]
    for r, (_, t), f in zip(got, rows, following):
        half = len(t) // 2
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + f[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = {}
    for r, (_, t) in zip(got, rows):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])
    assert imatch.fingerprints_beside_next(mixed_docs).count() == mixed_docs.count()
    assert imatch.fingerprints_beside_next(no_docs).count() == 0


def test_fingerprints_against_brute_force(spark):
    """Every column by the definition, in plain Python integers."""
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    bodies = [t or "" for t in texts(90, seed=8) + AWKWARD[:5] + AWKWARD[7:]]
    docs = documents(spark, bodies, extra=False)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    terms = [sorted({*WORD.findall(lower(t))}) for t in bodies]
    number = {}
    for x in {x for d in terms for x in d}:
        raw = np.frombuffer(x.encode(), np.uint8)
        number[x] = int(words.hash_ranges(raw, np.array([0]), np.array([len(raw)]))[0])
    df = {x: sum(x in d for d in map(set, terms)) for x in number}
    band = {x for x, n in df.items() if max(2, imatch.MIN_SHARE * len(bodies)) <= n <= max(2, imatch.MAX_SHARE * len(bodies))}
    assert band and len(band) < len(df)

    def mark(t):
        every = {*WORD.findall(lower(t))}
        own = [number[x] if x in number else None for x in every if x in band]
        if not own:
            raw = [int(words.hash_ranges(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0]) for x in every]
            first = mix(sum(mix((h + 2) & full) for h in raw) & full) >> 32 | 1 if raw else 0
            return [first] + [0] * ((imatch.LEVELS - 1) * imatch.EACH)
        out = [mix(sum(mix((h + 1) & full) for h in own) & full) >> 32 | 1]
        for level in range(1, imatch.LEVELS):
            for e in range(1, imatch.EACH + 1):
                inside = [d for d in (mix((h + mix(e)) & full) for h in own) if d >> 1 < 1 << (63 - level)]
                out.append(mix((sum(mix((d + 0x632BE59BD9B4E019) & full) for d in inside) + level) & full) >> 32 | 1 if inside else 0)
        return out

    form = lambda m: "".join(f"{x:08x}" for x in m)

    def near(a, b):
        either = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    got = {r["doc_id"]: r for r in imatch.fingerprints_beside_next(docs, parts=4).collect()}
    assert len(got) == len(bodies)
    for i, t in enumerate(bodies):
        following = bodies[(i + 1) % len(bodies)]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = mark(t), mark(changed), mark(following)
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (form(a), form(b), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(a, b)) and r["near_next"] == pytest.approx(near(a, c))


def test_fingerprints_of_shared_ids(spark):
    """A third of the rows without an id, others with one id: they are walked in the order of (id, hash of the text), over many ranges."""
    rows = [(None, f"n{i} a b") for i in range(60)] + [(7, f"s{i} c d") for i in range(60)] + [(100 + i, f"o{i} e f") for i in range(60)] + [(7, "s1 c d")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS k", "2 AS t", "3 AS extra").repartition(3)
    order = [(r["doc_id"], r["text"]) for r in docs.selectExpr("*", "coalesce(doc_id, -9223372036854775808L) AS k2", "xxhash64(text) AS t2").orderBy("k2", "t2").collect()]
    want = []
    for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
        want.append((i or -1, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest()))
    for parts in (1, 7, 40):
        got = imatch.fingerprints_beside_next(docs, parts=parts).collect()
        assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_texts_without_lexicon_terms_are_told_apart():
    a, b = (np.array(x, np.uint64) for x in ([1, 2, 3], [4, 5]))
    for known in (np.zeros(0, np.uint64), np.array([9], np.uint64)):
        x, y, empty = (imatch.signatures(t, known) for t in (a, b, a[:0]))
        assert imatch.likeness(x, y) == 0 and imatch.likeness(x, empty) == 0
        assert imatch.likeness(x, imatch.signatures(a, known)) == 1 and imatch.likeness(empty, empty) == 1


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all rare{i} half{i % 2} Pair{i // 2}") for i in range(20)], "doc_id long, text string")
    assert len(imatch.lexicon(docs, 0.05, 0.6)) == 2 + 10
    assert imatch.likeness(np.array([1, 0, 3]), np.array([1, 0, 4])) == 0.5


# 10


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    changed |= label[a] != low or label[b] != low
                    label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_near_duplicates(mixed_docs, no_docs):
    got = neardup.near_duplicates(mixed_docs).collect()
    want = jaccard_components([(r["doc_id"], r["text"]) for r in mixed_docs.where("doc_id is not null").collect()])
    assert len(got) == mixed_docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("followers", [4, 16, 500])
def test_followers_of_one_leader_are_linked_in_parts(spark, monkeypatch, followers):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    bodies = []
    for i in range(60):
        w = list(base)
        for p in rnd.sample(range(120), rnd.choice([1, 2, 4, 6, 8])):
            w[p] = f"x{i % 9}_{p}"
        bodies.append(" ".join(w))
    monkeypatch.setattr(neardup, "FOLLOWERS", followers)
    if followers == 4:
        monkeypatch.setattr(neardup, "FILTER_BITS", 64)  # texts are joined instead
    docs = documents(spark, bodies, extra=False)
    want = jaccard_components(list(enumerate(bodies)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()} == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = words.mix(np.arange(1200, dtype=np.uint64))
    a, b = pool[:800], pool[200:1000]
    small = pool[:3]
    sig = neardup.superminhash([np.sort(a), np.sort(b), np.sort(small), np.zeros(0, np.uint64)], 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    assert (sig[2] != neardup._NONE).all() and (sig[3] == neardup._NONE).all()
    assert rng is not None


# The pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "substring dedup", "mixing sources", "best-fit packing"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = neardup.scratch.save(stage(spark, seen, sf), "stage")
        assert after.columns == docs.columns
        if name == "minhash near-dedup":
            labels = jaccard_components([(r["doc_id"], r["text"]) for r in seen.collect()])
            assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in labels.items() if i == c}
        if name == "substring dedup":
            want = {i: kept for i, _, _, kept in repeats(sorted((r["doc_id"], r["text"]) for r in seen.collect()), 13)}
            assert {r["doc_id"]: " ".join(WORD.findall(r["text"])) for r in after.collect()} == want
        if name == "mixing sources":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in seen.collect()}
        seen = after
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_on_awkward_documents(spark, tmp_path, mixed_docs):
    spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    rows = {r["doc_id"]: r["text"] for r in mixed_docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, mixed_docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, mixed_docs, str(tmp_path))
        got = out.collect()
        assert out.columns == columns and {r["doc_id"] for r in got} <= set(rows)
        if name == "substring dedup":
            assert len(got) == mixed_docs.count()
            assert all(r["n_chars"] == len(r["text"] or "") for r in got)
        else:
            assert all(r["text"] == rows[r["doc_id"]] for r in got)
        if name == "mixing sources":
            assert {r["doc_id"] for r in got} == set(rows)
        if name == "minhash near-dedup":
            assert None in {r["doc_id"] for r in got} and sum(r["text"] == "tie tie tie" for r in got) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed_docs, str(tmp_path)).toPandas()
    assert len(packed[packed.piece == 0]) == mixed_docs.count() and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.STAGES[-1][1](spark, mixed_docs.limit(0), str(tmp_path)).count() == 0
