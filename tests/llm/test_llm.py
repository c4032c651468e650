"""The corpus operators: SQL twins, brute force on small data, and odd inputs."""

import math
import zlib
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parcelflow import llm
from parcelflow.llm import common, decontaminate, html, packing, quality, quotes, secrets, simhash, tokens, toxicity, urlfilter
from parcelflow.operators import ring
from tests.compare import assert_same

DOCS = "doc_id long, text string, lang string, failure_bits string, rank int"
LONG = "word and other words " * 30_000
ODD = [
    (1, None, "en", "x", 1),
    (2, "", "en", "x", 1),
    (3, " \n\t ", None, "x", 1),
    (4, "one two three four five six", "en", None, None),
    (4, "one two three four five six", "en", None, None),
    (5, "ONE two three four five six", "en", None, None),
    (6, 'token = "abcDEF123456" ünï 😀 ' + "f" * 30, "es", "", 0),
    (7, LONG, "en", "", 0),
    (None, "no id at all", "en", "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", llm.oracle_sql())
def test_against_sql(spark, sf_dir, name):
    assert_same(llm.queries()[name](spark, sf_dir), llm.oracle_sql()[name], sf_dir)


def test_quality_of_odd_rows(odd, none):
    got = quality.ledger(odd)
    assert got.count() == len(ODD) and got.columns[-1] == "failure_bits_"
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["measured"]["n_words"] == 0 and by[1]["failure_bits_"] & 1
    assert by[7]["failure_bits_"] & 2 and by[7]["measured"]["n_repeat_words"] == 120_000
    assert quality.ledger(none).count() == quality.keep(none).count() == 0
    assert quality.keep(odd).columns == odd.columns


def test_ablation_adds_up(odd):
    bits = quality.ledger(odd, bits_col="b")
    got = {r["rule"]: r for r in quality.ablation(bits, bits_col="b").collect()}
    assert got["few_words"]["n_failed"] == 8 and got["few_words"]["n_rows"] == len(ODD)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p>First  paragraph,
with <b>bold</b> text.<p>Second one.<ul><li>item</li></ul></article><section id="comments"><p>A reader says, hello.</p></section>
<form><p>Name</p></form><footer>Contact</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_main_text(spark):
    assert html.main_text(PAGE) == "Head & line\n\nFirst paragraph, with bold text.\n\nSecond one.\n\nitem"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    df = spark.createDataFrame([(1, PAGE, "m"), (1, PAGE, "m"), (2, None, None)], "page_id int, html string, main_text string")
    got = html.extract(df)
    assert got.count() == 3 and got.columns == df.columns and got.where("main_text = ''").count() == 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><div class="content with-sidebar"><h1>T</h1><p>Long text here, yes.</p></div><div class="sidebar">x</div></body>', "T\n\nLong text here, yes."),
        ('<div class="no-sidebar"><p>Long text here, yes.</p></div>', "Long text here, yes."),
        ('<div class="search-results-article post"><p>Long text, here it is.</p></div>', "Long text, here it is."),
        ('<div class="widget"><h1>T</h1><p>All of it, in a node of that name.</p></div>', "T\n\nAll of it, in a node of that name."),
        ("<form><h1>T</h1><p>The page is in a form, of course.</p></form>", "T\n\nThe page is in a form, of course."),
        ('<article><p>One <span class="advert">Buy me</span> two.</p><p hidden>no</p><p style="display: none">no</p><p>three</p></article>', "One two.\n\nthree"),
        ('<article><p>Text, <a href="/?id=comments" data-id="nav">a link</a>.</p></article>', "Text, a link."),
        ('<body><h1>Title</h1><div class="text">A long text is here, and it goes on. Yes.</div><div id="comments"><p>A reader, at length, at length, at length, at length.</p></div></body>', "Title\n\nA long text is here, and it goes on. Yes."),
        ('<body><h1>T</h1><section class="intro"><p>Short.</p></section><section class="body"><p>Long text, long. Long text, long. Long text, long.</p></section></body>', "T\n\nShort.\n\nLong text, long. Long text, long. Long text, long."),
        ('<article><p>Unclosed <b class="x>quote', 'Unclosed <b class="x>quote'),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


LINE = "This is a paragraph of the article, with some words in it, and more of them. It goes on, and on, until it ends here."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Names that share a word with what stands beside an article.
        (f'<article><h1>T</h1><p>{LINE}</p><div class="social-history">A true section.</div><p class="alert-level">The alert level is high.</p><p class="search-algorithm">How search works.</p><div class="share-price">Up by 3.</div><p>{LINE}</p></article>', f"T\n\n{LINE}\n\nA true section.\n\nThe alert level is high.\n\nHow search works.\n\nUp by 3.\n\n{LINE}"),
        # What no tag and no name tells.
        (f'<body><h1>T</h1><div class="text"><p>{LINE}</p><p>{LINE}</p></div><div class="bottom"><p>Copyright.</p></div></body>', f"T\n\n{LINE}\n\n{LINE}"),
        (f'<article><h1>T</h1><p>{LINE}</p><div>Buy it now! Click here.</div><ul><li><a href="/a">One link</a></li><li><a href="/b">Other link</a></li></ul><p>{LINE}</p></article>', f"T\n\n{LINE}\n\n{LINE}"),
        (f'<body><div><a href="/">Home</a> <a href="/b">About</a></div><div><h1>Hello!</h1><p>{LINE}</p><h2>More!</h2><p>{LINE}</p><ul><li>one</li><li>two</li></ul></div><div>All rights reserved.</div></body>', f"Hello!\n\n{LINE}\n\nMore!\n\n{LINE}\n\none\n\ntwo"),
        # Short parts of an article.
        (f'<article><h1>T</h1><p class="lead">What a day!</p><p>{LINE}</p><div><p>x</p></div><figure><figcaption>A cap</figcaption></figure><blockquote>Yes.</blockquote><p>{LINE}</p></article>', f"T\n\nWhat a day!\n\n{LINE}\n\nx\n\nA cap\n\nYes.\n\n{LINE}"),
        (f'<body><div class="x"><p>{LINE}</p></div><div class="y"><p>{LINE}</p></div></body>', f"{LINE}\n\n{LINE}"),
    ],
)
def test_scores_decide(page, text):
    assert html.main_text(page) == text


def test_the_size_around_a_node_changes_nothing():
    """One and the same node, in pages of any size."""
    for n in (1, 2, 5, 40):
        around = f"<p>{LINE}</p>" * n
        got = html.main_text(f'<body><div class="post">{around}<div class="social-history">A true section.</div>{around}</div><div class="ad">Buy our things, they are cheap. They are.</div></body>')
        assert got.split("\n\n") == [LINE] * n + ["A true section."] + [LINE] * n


def test_pages_need_their_path_scores(spark, sf_dir, monkeypatch):
    """Without the scores no page of the table comes out right; tags and names count through them alone. Without an article element all still come out right."""
    pages = [r["html"] for r in common.table(spark, sf_dir, "pages").select("html").collect()]
    want = [html.main_text(x) for x in pages]
    assert [html.main_text(x.replace("<article", "<div").replace("</article", "</div")) for x in pages] == want
    monkeypatch.setattr(html, "path_scores", lambda paths, blocks: {i: 1.0 for i, p in enumerate(paths) if p.blocks})
    assert all(html.main_text(x) != w for x, w in zip(pages, want, strict=True))


def test_path_scores_by_hand():
    """Two paths next to each other, from the docstring's formula."""
    got = html.read("<div><p>Abc, def.</p><p>Ghi, <a>jkl</a>.</p></div><div class='ad'>Now! Yes.</div>")
    p, ad = (next(i for i, x in enumerate(got.paths) if x.tag == t and x.blocks) for t in ("p", "div"))
    assert [(x.blocks, x.chars, x.linked, x.marks, x.loud, x.besides) for x in (got.paths[p], got.paths[ad])] == [(2, 18, 3, 4, 0, 0), (1, 9, 0, 1, 1, 1)]
    scores = html.path_scores(got.paths, [b.path for b in got.blocks])
    # The advert lends the paragraphs nothing; they lend it, three steps away, a quarter each.
    assert math.isclose(scores[p], math.log1p(7.5) + 0.5 * math.log1p(2) + 0.7 - 3 * 3 / 18)
    near = 0.25 * 2
    assert math.isclose(scores[ad], math.log1p((9 + near * 7.5) / (1 + near)) + 0.5 * math.log1p((1 + near * 2) / (1 + near)) - 3 * 0.5 - 4)


def test_main_text_of_made_pages(spark):
    """Pages made of known article blocks and of what stands around and in between them: just the article comes back."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    other = lambda: rng.choice(('<div class="{}">{}</div>', "<aside data-x='{}'><p>{}</p></aside>", '<p hidden class="{}">{}</p>', '<form id="{}"><p>{}</p></form>')).format(rng.choice(("ad", "ad-slot", "site-notice", "cookie_banner", "shareButtons", "related")), say(rng.randint(3, 20)))
    pages = []
    for i in range(300):
        parts, want = [f"<h1>{(h := say(4))}</h1>"], [h]
        for _ in range(rng.randint(2, 8)):
            want.append(t := ", ".join(say(rng.randint(6, 15)) for _ in range(3)))
            parts += [rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>")).format(t)] + [other() for _ in range(rng.random() < 0.3)]
        tag = rng.choice(("article", "main", 'div class="post with-sidebar"', 'div id="page-content"'))
        page = f"<html><head><title>no</title></head><body><nav>{say(5)}</nav>{other()}<{tag}>{''.join(parts)}</{tag.split()[0]}><section class='comments'><p>{say(30)}</p></section><footer>{say(6)}</footer>"
        pages.append((i, page, "\n\n".join(want)))
    got = html.extract(spark.createDataFrame(pages, "page_id int, html string, want string"), text_col="got")
    assert [r["page_id"] for r in got.where("got <> want").collect()] == []


def test_main_text_of_very_long_pages(spark, none):
    import time

    for page in ("<div>text, and more " * 30_000, '<p title="x>' * 50_000, "<p>text, text.</p>" * 30_000, "<b class='ad'>x" * 30_000, "<!--" * 50_000, "</i></p>" * 50_000):
        start = time.monotonic()
        html.main_text(page)
        assert time.monotonic() - start < 20
    assert len(html.main_text("<p>text, text.</p>" * 30_000)) == 30_000 * 11 + 29_999 * 2
    assert html.extract(none.withColumnRenamed("text", "html")).count() == 0


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_simhash_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = {i: (f"{f:016x}", brute_components(prints)[i]) for i, f in prints[:1]}
    parts = brute_components(prints)
    want = {i: (f"{f:016x}", parts[i]) for i, f in prints}
    got = simhash.op3_simhash_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_candidates_that_the_chain_removes(spark):
    """Of the values that meet on a start of the ring, the rest of the chain drops nearly all before their bits are counted; no close pair is lost."""
    import random

    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(6_000)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in values[:200] for k in (1, 2, 3, 4)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long").withColumn("fp", F.col("fp"))
    met = ring.candidates(df, simhash.MOST_BITS, links=1).select("start", F.col("a").bitwiseXOR(F.col("b")).alias("x"))
    two = ring.candidates(df, simhash.MOST_BITS).count()
    passed = met.where(ring.Ring(simhash.MOST_BITS).first_start(F.col("x")) == F.col("start")).count()
    found = simhash.close_fingerprints(df).count()
    assert 800 <= found <= passed <= 2 * found and passed < two and two < met.count() / 5


def test_join_of_a_hot_key(spark):
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.select("k").distinct().withColumn("w", F.col("k") * 2)
    got = common.salted_join(left, right, "k")
    assert got.columns == ["k", "v", "w"] and got.count() == 60_000 and got.where("w <> k * 2").isEmpty()


def test_repeated_ids_name_apart(spark):
    """Rows of one id whose texts are not linked name two components, and each keeps one row."""
    x, y = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, x), (1, y), (2, x), (3, y), (None, x), (None, "no one is like this at all"), (None, "no one is like this at all"), (1, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp", F.lit(0)).withColumn("_kept", F.lit("clash"))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "no one is like this at all"), (1, x), (1, y)]


def test_one_of_each_group(odd, none):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [1, 4, 6, 7]
    assert simhash.one_of_each(none).count() == simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_toxicity_learns_on_the_other_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    assert got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    toxic, other = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))
    assert auc > 0.9 and (toxic >= 0.5).mean() > 0.8 and (other >= 0.5).mean() < 0.03
    assert all(bool(r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_deobfuscation(spark):
    import numpy as np

    texts = ["the idiot is a worthless scum and the people are stupid"] * 40
    counts = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert counts.sum() > 0 and isinstance(counts, np.ndarray)
    d = toxicity.Decoder(toxicity.character_model(counts))
    assert d.decode("1d10t") == "idiot" and d.decode("s.c.u.m") == "scum" and d.decode("idiiiiot") == "idiot"
    # Long runs and long words are decoded whole: no letter is lost at a cut.
    spaced = d.decode(" ".join("idiot") + " ")
    assert spaced.replace(" ", "") == "idiot"
    assert d.decode(" ".join("idiot" * 60)).replace(" ", "") == "idiot" * 60
    assert d.restored(" ".join("idiot." * 20_000)) and d.restored("1d10t" * 20_000)
    assert "idiot" in d.restored("you i d i o t here") and d.restored(None) == set() and d.restored("") == set()


def obfuscated(word, kind):
    """A word in signs, with gaps, or with repeated letters."""
    signs = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
    return {
        "signs": "".join(signs.get(c, c) for c in word),
        "spaces": "  ".join(word),
        "lines": "\n".join(word),
        "dots": ".".join(word),
        "twice": "".join(c * 2 for c in word),
        "long": "".join(c * 4 if i == len(word) // 2 else c for i, c in enumerate(word)),
    }[kind]


def test_obfuscated_held_out_texts_need_the_decoder(spark, monkeypatch):
    """Held-out toxic texts whose telling words are obfuscated keep their scores through the decoder, and lose them without it."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    decoder = toxicity.Decoder(model.letters)
    toxic = [r["text"] for r in rows if r["toxic"] and model.score(decoder, r["text"]) >= 0.5]
    weighed = lambda w: any(f in model.weights for f in toxicity.features({w}))
    strip = lambda w: toxicity._EDGE.sub("", w.lower())
    made = {k: [" ".join(obfuscated(strip(w), k) if weighed(strip(w)) else w for w in t.split()) for t in toxic] for k in ("signs", "spaces", "lines", "dots", "twice", "long")}
    hits = lambda: {k: sum(model.score(d, t) >= 0.5 for t in texts) / len(texts) for d in [toxicity.Decoder(model.letters)] for k, texts in made.items()}
    assert len(toxic) > 50
    with_it = hits()
    assert min(with_it.values()) > 0.85, with_it
    monkeypatch.setattr(toxicity.Decoder, "decode", lambda self, w: w)
    monkeypatch.setattr(toxicity.Decoder, "letters", lambda self, w: w)
    without = hits()
    assert max(without[k] for k in ("spaces", "lines", "dots", "twice")) < 0.1 and without["signs"] < 0.5, without


def test_scores_by_every_path_of_the_lattice(spark):
    """Weights, decoded words and scores of a small table in plain Python, over all paths of each lattice."""
    from itertools import product

    import numpy as np

    toxic = [f"you {w} {'bcdfghjklmnp'[i]}alado time of garden" for i in range(12) for w in ("zubrat", "zub.rat", "zubrat too")]
    clean = [f"the garden covid19 has x86 flowers {'ab'[i % 2]}{'cdefghijkl'[i // 2 % 10]}{'opq'[i // 20]}nty balloon" for i in range(60)]
    texts = toxic + clean + ["2ubr4t", "z u  b\nr a t", "zzuubbrraatt", "covid19", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, docs.where(F.col("doc_id") < len(toxic + clean)).select("doc_id", (F.col("doc_id") < len(toxic)).cast("int").alias("toxic")))
    size = 27
    counts = np.zeros((size,) * 3)
    for t in texts:
        c = [0, 0, *(("abcdefghijklmnopqrstuvwxyz".find(x) + 1) for x in (t or "").lower()), 0] if t else []
        for a, b, x in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, x] += 1
    assert np.allclose(toxicity.character_model(counts.ravel()), model.letters)

    def likeliest(word):
        best = (-math.inf, "")
        for path in product(*toxicity.Decoder.lattice(word)):
            text = "".join(x for x, _ in path)
            ids = [0, 0, *("abcdefghijklmnopqrstuvwxyz".find(x) + 1 for x in text), 0]
            best = max(best, (sum(c for _, c in path) + sum(model.letters[a, b, x] for a, b, x in zip(ids, ids[1:], ids[2:], strict=False)), text))
        return " ".join(best[1].split())

    decoder = toxicity.Decoder(model.letters)
    for w in ("zub.rat", "zuubrat", "2ubr4t", "z u b r a t", "zzuubbrraatt", "covid19", "balloon", "x86"):
        assert (decoder.letters(w) if w.isalpha() else decoder.decode(w)) == likeliest(w), w
    assert {likeliest(w) for w in ("2ubr4t", "z u b r a t", "zzuubbrraatt", "zuubrat")} == {"zubrat"}
    assert {"covid", "has", "flowers", "balloon"} <= decoder.restored(clean[0]) and "covid" in decoder.restored("covid19")
    feats = [toxicity.features(decoder.restored(t)) for t in texts[: len(toxic + clean)]]
    kinds = {(y, frozenset(f)) for y, f in zip([1] * len(toxic) + [0] * len(clean), feats, strict=True)}
    n1, n0 = (sum(y == k for y, _ in kinds) for k in (1, 0))
    assert model.weights and set(model.weights) <= {f for y, fs in kinds if y for f in fs} and "zubrat" in model.weights and "garden" not in model.weights
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        found = sorted((model.weights[f] for f in toxicity.features(decoder.restored(t)) & model.weights.keys()), reverse=True)
        assert abs(got[i] - 1 / (1 + math.exp(-(model.bias + (found[0] + 0.2 * sum(found[1:5]) if found else 0))))) < 1e-9
        assert (got[i] >= 0.5) == (i < len(toxic) or i in range(len(toxic + clean), len(toxic + clean) + 3)), t


def test_different_texts_that_share_a_long_word_vote_apart(spark):
    """Each toxic text has the one long rare word and words of its own: all of them count."""
    letters = lambda i: "".join("bcdfgklmnp"[int(c)] + "a" for c in f"{i:05}")
    texts = [f"unbelievable {letters(i)} {letters(i + 500)} zubrat" for i in range(8)] + [f"market {letters(i + 100)} {letters(i + 900)} window" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") < 8).cast("int").alias("toxic")))
    assert {"zubrat", "unbelievable"} <= set(model.weights)


def test_toxic_text_of_thousands_of_copies(spark):
    letters = lambda i: "".join("bcdfgklmnp"[int(c)] + "a" for c in f"{i:05}")
    clean = [f"garden market window {letters(i)} river" for i in range(400)]
    other = [f"you zubrat and mopkel {letters(i)} river" for i in range(1000, 1012)]
    texts = clean + other + ["you zubrat and mopkel garden unrepeatable river"] * 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") >= len(clean)).cast("int").alias("toxic")))
    assert {"zubrat", "mopkel"} <= set(model.weights) and "unrepeatable" not in model.weights
    got = toxicity.score(docs, model).select("doc_id", (F.col("score") >= 0.5).alias("p")).toPandas()
    assert (got["p"] == (got["doc_id"] >= len(clean))).all()
    once = docs.where(F.col("doc_id") <= len(clean) + len(other))
    alone = toxicity.fit(once, once.select("doc_id", (F.col("doc_id") >= len(clean)).cast("int").alias("toxic")))
    assert alone.weights == model.weights and alone.bias == model.bias


def test_toxicity_of_odd_rows(odd, none):
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(ODD)
    big = odd.select(F.lit(9007199254740993).alias("doc_id"), "text", F.lit("clash").alias("score")).limit(1).unionByName(odd.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("").alias("score")))
    assert 9007199254740993 in {r["doc_id"] for r in toxicity.score(big, model).collect()}
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there, how are you?\nSecond line here."),
        (1, 1, "b", "> Hello there, how are you?\nFine, thanks."),
        (1, 2, "a", "> > Hello there,   HOW are you?\n> Fine, thanks.\nGood."),
        (1, 2, "a", "> > Hello there,   HOW are you?\n> Fine, thanks.\nGood."),
        (2, 0, "a", "> Fine, thanks.\nnot from this talk"),
        (3, None, "a", "> Fine, thanks."),
        (None, 1, "a", None),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("thread", F.lit("clash"))
    got = quotes.unquoted(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["reply_to"] == 0 and by[1, 1]["text"] == "Fine, thanks."
    assert by[1, 2]["reply_to"] == 1 and by[1, 2]["depth"] == 2 and by[1, 2]["thread"] == 0 and by[1, 2]["quote_levels"] == 2
    assert by[2, 0]["reply_to"] is None and by[None, 1]["text"] == "" and by[None, 1]["position"] is None
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3]
    assert quotes.unquoted(df.limit(0)).count() == 0


def brute_conversation(messages):
    """(turn, reply_to, thread, depth) in reply order, for messages (turn, own lines, quoted levels to lines)."""
    origin, reply = {}, {}
    for turn, own, quotes in messages:
        for level in sorted(quotes):
            hits = [(len(lines) > 0, origin[tuple(lines)]) for lines in [quotes[level]] if tuple(lines) in origin]
            if hits:
                reply[turn] = hits[0][1]
                break
        origin.setdefault(tuple(own), turn)
    kids = {}
    for turn, _, _ in messages:
        kids.setdefault(reply.get(turn), []).append(turn)
    out = []

    def visit(turn, thread, depth):
        out.append((turn, reply.get(turn), thread, depth))
        for k in kids.get(turn, ()):
            visit(k, thread, depth + 1)

    for root in kids[None]:
        visit(root, root, 0)
    return out


def test_nested_quotes_of_many_conversations(spark):
    """Made conversations with quotes of up to three levels, one of them a long chain and one with very many replies to one message."""
    import random

    rng = random.Random(9)
    rows, want = [], {}
    sizes = [rng.randint(1, 6) for _ in range(3000)] + [150, 400]
    for conv, size in enumerate(sizes):
        made = []
        for turn in range(size):
            own = [f"line {conv} {turn} {k} says something" for k in range(rng.randint(1, 2))]
            levels, up = {}, None
            if turn and (conv >= 3000 or rng.random() < 0.7):
                up = turn - 1 if conv == 3000 else 0 if conv == 3001 else rng.randrange(turn)
                levels[1] = made[up][1]
                for level in (2, 3):
                    if level - 1 in made[up][2] and rng.random() < 0.8:
                        levels[level] = made[up][2][level - 1]
            made.append((turn, own, levels))
            quoted = [f"{rng.choice(('>' * n, '> ' * n))}{x.upper() if n == 1 else x}" for n in sorted(levels, reverse=True) for x in levels[n]]
            head = ["On Monday somebody wrote:"] if quoted and rng.random() < 0.5 else []
            rows.append((conv, turn, "user", "\n".join(head + quoted + own)))
        want[conv] = brute_conversation(made)
    rng.shuffle(rows)
    got = {}
    for r in quotes.unquoted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect():
        got.setdefault(r["conv_id"], []).append((r["position"], r["turn"], r["reply_to"], r["thread"], r["depth"], r["text"].count("\n") + 1 <= 2 and ">" not in r["text"] and "wrote" not in r["text"]))
    for conv, places in got.items():
        places.sort()
        assert [p[0] for p in places] == list(range(len(places)))
        assert [p[1:5] for p in places] == want[conv], conv
        assert all(p[5] for p in places)


def test_quotes_of_very_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, 0, "a", text), (1, 1, "b", "\n".join(f"> line {i}" for i in range(20_000)) + "\nyes")], "conv_id int, turn int, role string, text string")
    got = {r["turn"]: r for r in quotes.unquoted(df).collect()}
    assert got[1]["reply_to"] == 0 and got[1]["text"] == "yes" and got[1]["position"] == 1 and got[0]["text"] == text


def test_quotes_over_the_whole_table(spark, sf_dir):
    got = quotes.op5_chat_formatting(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert got.where(F.col("text").rlike(r"(?m)^[ \t]*>")).count() == 0
    assert got.where("reply_to >= turn").count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("block", "Example.org", "/a"), ("allow", "example.org", "/a"), ("allow", "org", "/a/b"), ("block", "x.example.org", ""), (None, "org", "/")], "verdict string, host string, path string")
    rows = [("https://example.org/abc?q",), ("http://X.EXAMPLE.org/a",), ("http://other.org/a/b/c",), ("http://example.orgs/a",), (None,), ("/a",), ("",)]
    df = spark.createDataFrame(rows, "url string").withColumn("rule", F.lit("clash"))
    want = [("example.org/a", "block"), ("x.example.org", "block"), ("org/a/b", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    for block in (100, 1):
        got = urlfilter.judge(df, rules, block_rules=block)
        assert sorted(((r["rule"], r["verdict"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert urlfilter.judge(df, rules.limit(0)).where("verdict = 'allow'").count() == len(rows)


def test_urls_against_brute_force(spark):
    """Random rules and URLs, repeated rows, very long ones and clashing names; one block of rules and many give the same."""
    import random

    rng = random.Random(6)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join("".join(rng.choice("xy") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 3)))
    rules = [(rng.choice(("allow", "block")), host(), path()) for _ in range(60)]
    urls = [f"http://{host().upper()}{path()}?q#f" for _ in range(300)] + [None, "", "a/b", "http://a.b/" + "x" * 100_000] * 2

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h, p = (rest.split("?")[0].split("/", 1) + [""])[:2] if "/" in rest else (rest, "")
        h, p = h.lower(), "/" + p if "/" in rest else ""
        fits = [(len(r[1]), len(r[2]), r[0], r[1] + r[2]) for r in rules if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    df = spark.createDataFrame([(u, 1) for u in urls], "url string, path int")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for block in (1_000, 7):
        got = urlfilter.judge(df, table, block_rules=block).collect()
        assert sorted(((r["url"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(((u, *judged(u)) for u in urls), key=str)


def whole_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(whole_ids, "tokenizer"):
        whole_ids.tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return [*whole_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, t in docs:
        ids = whole_ids(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.op7_token_ids(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


ENCODED = ["a  b", "a\n\nb", "x \n y", "don't won't I'll", "price: 12,50!", "äöü ß 😀😀", "tab\there", " lead", "trail ", "'s start", "a.b,c", "<|endoftext|>", "a b", "word,\nnext", "1 2 3", "é,", "\r\nx", "", " ", "\n", "a's b", "...", "x" * 5000, LONG]


def test_words_encode_as_whole_texts():
    enc = tokens.Encoder(tokens.vocabulary_path(), most_words=50)
    for _ in range(2):
        for text, got in zip(ENCODED, enc.encode(ENCODED), strict=True):
            assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == whole_ids(text)[:-1], text[:40]


@pytest.mark.parametrize("mode", tokens.MODES)
def test_planes_round_trip(spark, odd, tmp_path, mode):
    import numpy as np

    for n in (0, 1, 7, 70_000):
        ids = np.random.default_rng(1).integers(0, 2**32, n, dtype="u4")
        payload, counts, sizes = tokens.pack_chunk(ids, 1 << 14, mode)
        assert (tokens.unpack_chunk(payload, counts, sizes, mode) == ids).all()
    tokens.write_ids(odd, f"{tmp_path}/ids", mode=mode, chunk_ids=64, block_ids=32, shards=3)
    got = tokens.read_ids(spark, f"{tmp_path}/ids").collect()
    assert sorted((r["ids"] for r in got)) == sorted(whole_ids(t) for _, t, *_ in ODD)
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    tokens.write_ids(odd.limit(0), f"{tmp_path}/empty")
    assert tokens.read_ids(spark, f"{tmp_path}/empty").count() == 0


def test_contained_items(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "one two three"), (3, None), (4, ""), (1, item)], "item_id int, text string")
    rows = [(1, "x " * 50 + item.upper() + ", end"), (2, item.replace("kappa", "other")), (3, item.replace("epsilon", "other")), (4, "One, two; three!"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("item_id", F.lit(0))
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, 6), (1, 1, 6), (2, 1, 5), (2, 1, 5), (4, 2, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 5, 6]
    for block in (1, 30):
        assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contaminated(docs, bench, block_chars=block).collect()) == got
        assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench, block_chars=block).collect()) == [3, 5, 6]
    long = spark.createDataFrame([(7, f"{LONG} {item} {LONG}"), (8, LONG)], "doc_id int, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(long, bench.limit(1)).collect()] == [7] and [r["doc_id"] for r in decontaminate.decontaminated(long, bench).collect()] == [8]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.decontaminated(odd, bench.limit(0)).count() == len(ODD)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def reduced(lengths, capacity):
    packer = packing._Packer(Counter(lengths), capacity)
    packer.reduce()
    return packer.plan.sequences, [x for x, n in enumerate(packer.left) for _ in range(n)]


def test_packing_fixes_no_pair_that_three_pieces_beat():
    # 14 and 6 fill a sequence; 11, 7, 2 and 8, 4, 3, 3, 2 fill two, which a pair of 11 and 8 would not leave.
    assert reduced([2, 2, 3, 3, 4, 6, 7, 8, 11, 14], 20) == (1, [2, 2, 3, 3, 4, 7, 8, 11])
    # 10, 3, 3, 4 and 9, 8, 3 need two sequences: nothing is fixed.
    assert reduced([10, 9, 8, 3, 3, 3, 4], 20)[0] == 0


def test_packing_fixes_three_pieces():
    # 9, 6, 5 fill the sequence, and nothing that is shorter than 6 and longer than 5 is there.
    assert reduced([9, 6, 5, 5, 6], 20) == (2, [])
    assert reduced([9, 6, 5, 4], 20) == (2, [])


def test_packing(spark, sf_dir, odd, none):
    rows = packing.op9_best_fit_packing(spark, sf_dir).collect()
    n = check_places(rows, 2048)
    # No packing needs fewer than the total length asks for; best fit may need a few more.
    assert n <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 2048)
    docs = {r["doc_id"]: whole_ids(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sum(r["length"] for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        ids = docs[r["doc_id"]]
        assert crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        assert len(ids) > 2048 or r["length"] == len(ids)
    got = packing.pack(odd, capacity=16).collect()
    check_places(got, 16)
    assert sum(r["length"] for r in got) == sum(len(whole_ids(t)) for _, t, *_ in ODD)
    assert packing.pack(none).count() == 0


def test_plan_is_as_good_as_any(spark):
    import random

    rng = random.Random(1)

    def best(lengths, room):
        """The fewest sequences by trying all ways."""
        most, found = sorted(lengths, reverse=True), [len(lengths)]

        def put(i, loads):
            if len(loads) >= found[0]:
                return
            if i == len(most):
                found[0] = len(loads)
                return
            for load in set(loads):
                if load + most[i] <= room:
                    rest = list(loads)
                    rest.remove(load)
                    put(i + 1, [*rest, load + most[i]])
            put(i + 1, [*loads, most[i]])

        put(0, [])
        return found[0]

    worse, three = 0, 0
    for i in range(400):
        capacity, least = (12, 1) if i % 2 else (20, rng.randint(1, 5))
        lengths = [rng.randint(least, capacity if i % 3 else capacity // 2) for _ in range(rng.randint(5, 9))]
        optimum = best(lengths, capacity)
        worse += packing.plan_packing(Counter(lengths), capacity).sequences - optimum
        n, rest = reduced(lengths, capacity)
        three += len(lengths) - len(rest) > 2 * n
        assert n + (best(rest, capacity) if rest else 0) == optimum, (lengths, capacity)
    assert worse <= 20 and three > 0


def test_secrets_of_odd_rows(odd, none):
    got = {r["doc_id"]: secrets_of(r) for r in secrets.scan(odd).collect()}
    assert got[1] == got[2] == got[4] == []
    text = ODD[6][1]
    assert [(k, text[s:e]) for s, k, e in got[6]] == [(0, 'token = "abcDEF123456'), (2, "f" * 30)]
    assert secrets.scan(none).count() == 0
    assert secrets.scan(odd, spans_col="rank").count() == len(ODD)


def secrets_of(r):
    return [(x["s"], x["k"], x["e"]) for x in r["secret_spans"]]


def brute_least(token):
    def bits(w):
        return -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())

    return max(bits(token[i : i + secrets.WINDOW]) for i in range(len(token) - secrets.WINDOW + 1))


def test_window_entropy(spark):
    import random

    rng = random.Random(2)
    toks = ["".join(rng.choice(secrets.ALPHABET[:k]) for _ in range(rng.randint(20, 60))) for k in (2, 8, 30, 67) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in toks], "t string").select("t", secrets._least_sum(F.col("t")).alias("x"))
    for r in df.collect():
        assert abs(math.log2(secrets.WINDOW) - r["x"] / secrets._SCALE / secrets.WINDOW - brute_least(r["t"])) < 1e-4


def test_redaction(spark):
    df = spark.createDataFrame([("a password=hunter22 b",), (None,), ("plain",)], "text string")
    got = [r["x"] for r in df.select(secrets.redacted(F.col("text"), secrets.secret_spans(F.col("text"))).alias("x")).collect()]
    assert got == ["a [SECRET] b", None, "plain"]


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality.keep(docs).collect()}
    ok = {r["doc_id"] for r in quality.op1_quality_rules(spark, sf_dir).where("kept").collect()}
    assert set(kept) == ok
    parts = brute_components([(i, brute_fingerprint(t)) for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if parts[i] == i}
    leaked = {r["doc_id"] for r in decontaminate.op8_benchmark_decontamination(spark, sf_dir).collect()}
    kept = {i: t for i, t in kept.items() if i not in leaked}
    masked = {}
    for r in secrets.scan(docs).collect():
        if r["doc_id"] in kept:
            out, at = [], 0
            for x in r["secret_spans"]:
                if x["s"] >= at:
                    out += [kept[r["doc_id"]][at : x["s"]], "[SECRET]"]
                at = max(at, x["e"])
            masked[r["doc_id"]] = "".join(out) + kept[r["doc_id"]][at:]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_places(rows, 2048)
    want = sorted((i, crc(whole_ids(t)[a : a + 2048])) for i, t in masked.items() for a in [0] if len(whole_ids(t)) <= 2048)
    assert {i for i, _ in want} <= {r["doc_id"] for r in rows} == set(masked)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows if len(whole_ids(masked[r["doc_id"]])) <= 2048) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "best_fit_packing"]


def test_pipeline_on_odd_rows(spark, tmp_path, odd, none):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and empty tables."""
    long = " ".join(f"wörd{i} stands here" for i in range(20_000))
    plain = " ".join(f"tale{i}" for i in range(80))
    rows = [(10, long, None, None, 3), (11, plain, "en", "x", None), (11, plain, "en", "x", None), (None, plain + " tail", "en", "x", 1), (12, plain + " password=hunter22hunter", None, None, 2)]
    clash = odd.unionByName(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit("clash") for c in ("_fp", "_kept", "_items", "_spans", "measured", "n_chars")})
    bench = spark.createDataFrame([(1, "nothing like it at all in here"), (None, None)], "item_id int, text string")
    for name, docs, items in (("odd", clash, bench), ("none", none, bench.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        staged = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, make in corpus_pipeline.STAGES[:-1]:
            staged = make(spark, staged, folder)
            assert staged.columns == docs.columns, stage
            staged.write.parquet(f"{folder}/{stage}")
            staged = spark.read.parquet(f"{folder}/{stage}")
        ids = sorted(r["doc_id"] for r in staged.collect())
        assert ids == ([10, 11] if name == "odd" else [])
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in packed} == set(ids)
        check_places(packed, 2048)


def test_words_of_random_unicode_encode_as_whole_texts():
    import random

    rng = random.Random(12)
    letters = "aBé ñ😀ßЖ中文\u0301\u200d\xa0\u2003\x1f\t\n\r '.,;:!?-_0123459²½٣\u00ad\ufeff"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.8 else chr(rng.choice((rng.randrange(32, 0x2FF), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F300, 0x1F700)))) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    enc = tokens.Encoder(tokens.vocabulary_path(), most_words=500)
    for at in range(0, len(texts), 200):
        for text, got in zip(texts[at : at + 200], enc.encode(texts[at : at + 200]), strict=True):
            assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == whole_ids(text)[:-1], repr(text)
