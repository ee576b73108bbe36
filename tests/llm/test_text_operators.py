"""Operators on single texts, against brute force, the libraries themselves or held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphrecon.llm import bpe, html_text, language, ordinal, quality_rules, secrets, token_counts, wavelet
from graphrecon.llm.queries import QUERIES

ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "ß", "1", "23", "...", "<|endoftext|>", "<|", "中文", "_", "²", "é", "\x1c", "The"]


def texts(count, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 200))) for _ in range(count)] + ["", "x" * 3000, " " * 900, "\n" * 900]


# --- secrets -------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(
        (("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))
    ):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


RANDOM = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYz2q9vTkE0"


@pytest.fixture(scope="module")
def ratios(spark):
    words = "internationalization the_quick_brown_fox getElementsByClassName characteristically responsibilities"
    plain = spark.createDataFrame([(w, False) for w in words.split()] * 20, "run string, random boolean")
    return secrets.transition_ratios(plain.union(secrets.generated_strings(spark, 512)))


def test_secret_base_spans_and_model(documents, ratios):
    rows = [
        'token=abc token = "abcdefgh1" é AKIA' + "Z9" * 8 + " " + "0f" * 20,
        None,
        "",
        'TOKEN:secret:abcdefgh apikey=AKIAABCDEFGHIJKL12 😀 password = 😀 api_key="' + "ab" * 20 + '"',
        "0123456789abcdef0123456789abcdefpi_key= 'longvalue99'",
        f"see {RANDOM} in internationalization_of_responsibilities",
        "deadbeef" * 2000 + " AKIA" + "B" * 5000,
        'token = "11acdfb36bb72224148e6160f674b4be45601bff"' * 40,
    ]
    found = secrets.found_spans(documents(*rows), ratios)
    got = {r["doc_id"]: r for r in found.select("*", secrets.joined(F.col("base_spans")).alias("b"), secrets.joined(F.col("all_spans")).alias("a")).collect()}
    for i, text in enumerate(rows):
        assert got[i]["b"] == base_spans(text)
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["a"].split(","))
    assert got[5]["a"] == f"random:4:{4 + len(RANDOM)}"
    assert secrets.redact(found).where("doc_id = 5").first()["text"] == "see <secret> in internationalization_of_responsibilities"


def test_secret_odd_rows(odd_documents, ratios):
    rows = secrets.found_spans(odd_documents, ratios).collect()
    assert len(rows) == 10 and all(not r["all_spans"] for r in rows)
    assert secrets.found_spans(odd_documents.where("false"), ratios).count() == 0


def test_secret_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_secret_scan"](spark, sf).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(docs[r["doc_id"]]).encode()).hexdigest()


# --- token counts and shards ------------------------------------------------------------------


@pytest.mark.parametrize("chunk, overlap", [(200, 16), (1000, 128)])
def test_chunks_splice_to_the_whole(chunk, overlap):
    tokenizer = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
    for text in texts(300):
        got = list(itertools.chain.from_iterable(token_counts.chunked_ids(text, encode, chunk, overlap, 16)))
        assert got == encode(text).ids


@pytest.mark.parametrize("name, cut, cased", [("byte_bpe_50k.json", bpe.space_pieces, True), ("word_bpe_49k.json", bpe.word_pieces, False)])
def test_pieces_add_up_to_the_whole(name, cut, cased):
    tokenizer = bpe.load(public_tokenizers.path(name))
    pieces = bpe.Pieces(tokenizer, as_ids=True, cased=cased)
    for text in texts(1500, seed=8):
        parts = cut(text)
        if parts is not None:
            pieces.learn(set(parts))
            got = np.frombuffer(b"".join(map(pieces.known.__getitem__, parts)), pieces.kind).tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, cut, cased, as_ids", [("byte_bpe_50k.json", bpe.space_pieces, True, False), ("word_bpe_49k.json", bpe.word_pieces, False, True)])
def test_pieces_are_encoded_when_read(monkeypatch, name, cut, cased, as_ids):
    monkeypatch.setattr(bpe, "PIECES", 200)
    monkeypatch.setattr(bpe, "PARTS", 50)
    tokenizer = bpe.load(public_tokenizers.path(name))
    pieces = bpe.Pieces(tokenizer, as_ids=as_ids, cased=cased)
    for text in texts(400, seed=9):
        parts = cut(text)
        if parts is not None:
            got = list(map(pieces.known.__getitem__, parts))
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(got), pieces.kind).tolist() == ids if as_ids else sum(got) == len(ids)
    assert len(pieces.known) <= 100 and len(pieces.older) <= 100 and len(pieces.parts) <= 50


def test_token_counts(odd_documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = bpe.load(path)
    rows = token_counts.count_tokens(odd_documents, path, keep=("doc_id", "text"), chunk=1000).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(odd_documents.where("false"), path).count() == 0


def test_wavelet_matrix():
    draw = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 5), (7, 2), (513, 300), (5000, 49_000), (4096, 1)):
        ids = draw.integers(0, kinds, n).astype("<u4")
        matrix = wavelet.WaveletMatrix(wavelet.write_matrix(ids, np.array([0, n]), [None]))
        assert (matrix.tokens() == ids).all() and matrix.doc_ids == [None]
        assert [matrix.access(i) for i in range(min(n, 200))] == ids[:200].tolist()
        for token in [*sorted(set(ids.tolist()))[:9], 99_999]:
            places = np.flatnonzero(ids == token)
            assert matrix.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            assert [matrix.find(token, k) for k in range(3)] == [*places[:3].tolist(), -1, -1, -1][:3]


def test_shards_round_trip(spark, odd_documents, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = bpe.load(path)
    wavelet.write_shards(odd_documents, str(tmp_path / "a"), path, 2, shard_tokens=20)
    got = sorted(wavelet.read_shards(str(tmp_path / "a"), spark).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in odd_documents.collect()), key=lambda r: r[:2])
    start = 0
    for r, (absent, doc_id, text) in zip(got, want, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_id"] == (None if absent else doc_id)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    wavelet.write_shards(odd_documents.where("false"), str(tmp_path / "b"), path, 2)
    assert wavelet.read_shards(str(tmp_path / "b"), spark).count() == 0


def test_shard_query(spark, sf):
    tokenizer = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in QUERIES["op4_wavelet_tokens"](spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(ids))
        start += len(ids)


# --- pages --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>x", ""),
        ("<article><p>It.</p><h2>A &amp; B</h2> tail </article>after", "It.\n\nA & B\n\ntail"),
        ("<head><title>t</title></head><article>a<script>var x='</p>';</script>b<!-- c --> d</article>", "ab d"),
        ("<nav>menu</nav><main><header><h1>H</h1></header><p>x<br>y&nbsp;z</p><aside>s</aside><p>w</p></main><footer>f</footer>", "H\n\nx y z\n\nw"),
        ("<article><p>a</p><div class='ad'>b</div><form><p>c</p></form><p>d</p><section id='comments'><p>e</p></section></article>", "a\n\nd"),
        ("<div class=nav>Home</div><div>" + "<p>" + "long text " * 12 + "</p><p>Short.</p></div><ul class=menu><li>" + "m " * 90 + "</ul>", ("long text " * 12).strip() + "\n\nShort."),
        ("<nav>never closed<article><p>kept</p></article>", "kept"),
        ("<a" * 5000 + "<article>" + "w " * 50_000 + "</article>", " ".join(["w"] * 50_000)),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "around",
    [
        '<div class="layout has-sidebar">{}</div>',
        '<div class="content-with-sidebar">{}</div>',
        '<div class="no-comments">{}</div>',
        '<div class="page cookie-accepted">{}</div>',
        '<div class="sidebar"><div id=social>{}</div></div>',
        '<form action="/page.aspx">{}</form>',
        "<title>about &lt;main> <main></title>{}",
        "<nav>menu</nav><main><div class=widget>{}</div></main>",
    ],
)
def test_no_container_of_an_article_is_dropped(around):
    for article in ("<article><h1>A</h1><p>b</p></article>", "<main><h1>A</h1><p>b</p></main>"):
        assert html_text.main_text(around.format(article)) == "A\n\nb"


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<section id="related-work"><p>x</p></section>', True),
        ('<div id="social-history"><p>x</p></div>', True),
        ('<div data-class="ad" data-role="banner" aria-id=menu><p>x</p></div>', True),
        ("<div title='class=\"ad\" id=nav'><p>x</p></div>", True),
        ("<section id=notes><article><p>x</p></article></section>", True),
        ('<div class="box ad"><p>x</p></div>', False),
        ('<div class="ad_slot"><p>x</p></div>', False),
        ('<div class="related-posts wide"><p>x</p></div>', False),
        ("<div ROLE=complementary><p>x</p></div>", False),
        ('<section id="comments"><article class="comment"><p>x</p></article></section>', False),
        ("<template><article>x</article></template>", False),
    ],
)
def test_parts_of_an_article(part, kept):
    want = "a\n\nx\n\nb" if kept else "a\n\nb"
    assert html_text.main_text(f"<article><p>a</p>{part}<p>b</p></article>") == want


P200 = "long text " * 20


@pytest.mark.parametrize(
    "page, want",
    [
        # an advert or form in mid-article, in one container, in several and in none
        (f"<div><p>{P200}</p><div class=ad>Buy</div><p>Short tail.</p></div>", [P200, "Short tail."]),
        (f"<div><div><p>{P200}</p></div><form>f</form><div><h2>Head</h2><p>Tail.</p></div></div>", [P200, "Head", "Tail."]),
        (f"<p>{P200}</p><aside>s</aside><p>Short tail.", [P200, "Short tail."]),
        # paragraphs that are all link, and several of them before a short one
        (f"<div><p>{P200}</p><p><a href=x>All link</a></p><p>{P200}</p></div>", [P200, "All link", P200]),
        (f"<div><p>{P200}</p>" + "<ul>" + "<li><a href=x>l</a>" * 4 + f"</ul><p>{P200}</p></div>", [P200, *"llll", P200]),
        (f"<div><p>{P200}</p>" + "<p><a href=x>l</a></p>" * 4 + "<p>Tail.</p></div>", [P200, *"llll", "Tail."]),
        (f"<div><h1><a href=x>Title</a></h1><p>{P200}</p><p><a href=x>Source</a></p></div>", ["Title", P200, "Source"]),
        # short articles
        ("<div><p>One short note.</p></div>", ["One short note."]),
        ("<body><h1>Title</h1><p>A note of a few words.</p><p>Yes.</p></body>", ["Title", "A note of a few words.", "Yes."]),
        # what isn't the article
        (f"<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div><p>{P200}</p></div><div>" + "<p><a href=x>l</a></p>" * 4 + "</div>", [P200]),
        ("<ul><li><a href=x>Home</a><li><a href=y>News</a></ul>", []),
    ],
)
def test_unmarked_pages(page, want):
    assert html_text.main_text(page) == "\n\n".join(x.strip() for x in want)


def test_pages_query(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub("<[^>]*>", " ", b) for b in re.split("</?(?:p|h1)>", inside)]
        import html

        want = "\n\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))
        assert r["text"] == want and r["n_chars"] == len(want)


# --- languages ----------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op8_language_id"](spark, sf).collect()]
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)


def test_language_odd_rows(odd_documents):
    net = language.train_net(["the of and with that"] * 20 + ["der die und das mit"] * 20, ["en"] * 20 + ["de"] * 20, epochs=3)
    rows = language.predict_language(odd_documents, net, keep=("doc_id", "text")).collect()
    assert len(rows) == 10
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (letters or (r["lang_pred"], r["score"]) == ("und", 0.0))
    empty = language.train_language_net(odd_documents.where("false"))
    assert {r["lang_pred"] for r in language.predict_language(odd_documents, empty).collect()} == {"und"}


def test_every_label_is_learned(spark, documents):
    names = [f"l{i:04}" for i in range(1100)]
    texts = [f"{name} words" for name in names] + ["common words"] * 3000 + [f"common {i}" for i in range(3000)] + ["1", None]
    docs = documents(*texts, lang=[*names, *["l0000"] * 6000, "digits", "empty"])
    rows = language.training_rows(docs, "doc_id", "lang", "text").collect()
    assert {r["label"] for r in rows} == set(names)
    assert len(rows) < 1100 + 100
    net = language.train_language_net(docs, epochs=1, per_text=1)
    assert net.languages == names
    assert {r["lang_pred"] for r in language.predict_language(docs.where("doc_id < 2000"), net).collect()} <= set(names)
    few = language.training_rows(docs.where("lang < 'l0004'"), "doc_id", "lang", "text", most=400).groupBy("label").count()
    counts = dict(few.collect())
    assert len(counts) == 4 and 40 < counts["l0000"] < 180
    copies = docs.withColumn("doc_id", F.lit(None).cast("long")).where("text = 'common words'")
    assert language.training_rows(copies, "doc_id", "lang", "text").count() == 1


# --- rules and classifier ---------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1}
    hit = {i + j for i, g in enumerate(grams) if g in twice for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures():
    draw = random.Random(4)
    some = ["a b c d e " * 3, "a a a a a a", "x\nx\n\n \nx", "é ü 中 #$", None, "", "one"]
    some += [" ".join(draw.choices("ab", k=draw.randint(0, 40))) for _ in range(200)]
    for text in some:
        assert quality_rules.measures(text)[:5] == plain_measures(text), text


def test_exact_binomial_bounds():
    from math import comb

    for n, k, p in ((20, 0, 0.1), (50, 3, 0.1), (200, 5, 0.05), (30, 2, 0.2)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_at_most(k, n, p) == pytest.approx(exact)
    assert not quality_rules.certified(5, 100, 0.05, 0.9) and not quality_rules.certified(0, 0, 0.5, 0.5)


def test_rules_reject_no_more_than_certified(spark):
    good = [(i, "Plain words that nobody would mind at all in any corpus of texts.", "en") for i in range(3000)]
    bad = [(3000 + i, "These### words$$$ have%%% far&&& too*** many### odd$$$ signs%%% in&&& them*** all###", "en") for i in range(500)]
    rare = [(4000, "These### words$$$ have%%% far&&& too*** many### odd$$$ signs%%% in&&& them*** all###", "xx")]
    docs = spark.createDataFrame(good + bad + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad) and kept[4000]


def test_rules_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (0, 0, None)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(odd_documents, labels).collect()
    assert len(rows) == 10 and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules.judge(odd_documents.where("false"), labels).count() == 0


def test_texts_without_letters_words_or_lines(documents):
    texts = [None, "", "1 2 3 4 5 6 7 8 9 10 11 12", "слово " * 5 + "и другие слова тоже здесь есть", " \n ", "漢字 " * 12]
    rows = {r["doc_id"]: r for r in quality_rules.judge(documents(*texts), documents().selectExpr("doc_id", "1 AS quality")).collect()}
    assert len(rows) == 6 and [rows[i]["n_words"] for i in range(6)] == [0, 0, 12, 11, 0, 12]
    assert rows[2]["kept"] and not rows[0]["kept"] and not rows[4]["kept"]


def test_kept_equals_brute_force_cutoffs(spark, sf):
    """The query's verdict from cutoffs chosen by hand: exact bounds over all good rows of each stratum."""
    from math import comb

    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    given = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        given.setdefault(r["doc_id"], []).append(r["quality"])
    good = {d for d, q in given.items() if min((x for x in q if x is not None), default=0) == 1}

    def shares(text):
        words, chars, symbols, dup, repeats, lines, upper, letters, bangs = quality_rules.measures(text)
        share = lambda a, b: a * 1000 // b if b else 0
        failed = words < 10 or 100 * repeats > 20 * words
        return failed, (share(symbols, chars), share(dup, lines), share(repeats, words), share(upper, letters), share(bangs, words))

    judged = {r["doc_id"]: (r["lang"], *shares(r["text"])) for r in docs}
    strata = {lang: [s for d, (g, failed, s) in judged.items() if g == lang and not failed and d in good] for lang in {v[0] for v in judged.values()}}
    held = {lang: rows for lang, rows in strata.items() if rows}
    tests = max(1, len(held)) * 5 * len(quality_rules.CUTOFFS)
    alpha, delta = quality_rules.ALPHA / 5, quality_rules.DELTA / tests
    cutoffs = {}
    for lang, rows in held.items():
        n = len(rows)
        for rule in range(5):
            for c in quality_rules.CUTOFFS:
                k = sum(s[rule] > c for s in rows)
                if k < n * alpha and sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) <= delta:
                    cutoffs[lang, rule] = c
                    break
    want = {d: not failed and all(x <= cutoffs.get((lang, i), 10**9) for i, x in enumerate(s)) for d, (lang, failed, s) in judged.items()}
    assert {r["doc_id"]: r["kept"] for r in QUERIES["op9_quality_rules"](spark, sf).collect()} == want


def test_classifier_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rated = ordinal.label_grades(spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = ordinal.train(docs, rated.where(~held))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = ordinal.grade_texts(docs, model).join(rated.where(held), "doc_id").groupBy("grade").agg(
        F.avg((F.col("p_best") >= 0.5).cast("double")).alias("kept"), F.avg("expected_grade").alias("mean")
    )
    by = {r["grade"]: r for r in rows.collect()}
    assert by[2]["kept"] > 0.97 and by[0]["kept"] < 0.3 and by[1]["kept"] < 0.3
    assert by[0]["mean"] < by[2]["mean"] and by[1]["mean"] < by[2]["mean"]


def test_classifier_odd_rows(spark, odd_documents):
    none = spark.createDataFrame([(None, None)], "doc_id long, grade int")
    model = ordinal.train(odd_documents, none)
    rows = ordinal.grade_texts(odd_documents, model, keep=tuple(odd_documents.columns)).collect()
    assert len(rows) == 10 and all(r["p_best"] > 0.99 for r in rows)
    assert rows[0]["spans"] == "x"
    some = spark.createDataFrame([(0, 2), (3, 0), (6, 1), (6, 0)], "doc_id long, grade int")
    assert ordinal.grade_texts(odd_documents, ordinal.train(odd_documents, some)).count() == 10
    assert ordinal.grade_texts(odd_documents.where("false"), model).count() == 0
