"""Extraction, language, personal data, quality and toxicity."""
import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import html_extract, language_id, pii_crf, quality_gam, queries, toxicity_kn

SF = "/root/testdata/sf0.01"


def cut_cost(unary, edges, side):
    cost = sum(u for u, s in zip(unary, side) if u > 0 and not s) + sum(-u for u, s in zip(unary, side) if u < 0 and s)
    return cost + sum(c for i, j, c in edges if side[i] != side[j])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.floats(0, 2)), max_size=12))
def test_minimum_cut_is_minimal(unary, edges):
    edges = [(i, j, c) for i, j, c in edges if i < len(unary) and j < len(unary) and i != j]
    best = min(cut_cost(unary, edges, s) for s in itertools.product([True, False], repeat=len(unary)))
    assert abs(cut_cost(unary, edges, html_extract.minimum_cut(unary, edges)) - best) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- x --><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Fish &amp;  chips</h1><script>var t="</p>";</script><p><b>First line<br>goes
 on &lt;here&gt;.<p>Second.</p><div class="ad">Buy now!</div><form><label>Mail</label><input></form>
<section id="comments"><p>Great post, thanks for writing all of this down.</p></section></article>
<aside>More reading for you.</aside><footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE) == "Fish & chips\nFirst line goes on <here>.\nSecond."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("<article><p>Cut off &am") == "Cut off &am"
    assert html_extract.main_text("<article><p>Cut off <foot") == "Cut off"
    plain = "<body><div id=menu><a href=1>One</a></div><div><p>" + "A sentence of some words. " * 9 + "</p><p>Short.</p></div></body>"
    assert html_extract.main_text(plain).endswith("words.\nShort.")


LONG = " ".join(["A long sentence of the text says something, with a comma and more words."] * 4)


def test_frame_words_and_tags_are_finite_costs():
    page = "<body><nav><a href=/>Home</a></nav>{}<footer>Copyright me.</footer></body>"
    body = f"<h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
    want = f"Title\n{LONG}\nShort one.\n{LONG}"
    for around in ("<article class='post no-sidebar'>{}</article>", "<main id='comments-open'>{}</main>", "<div class='legal-news'>{}</div>",
                   "<form action=x><div>{}</div></form>", "<div class='entry with-sidebar'>{}</div>", "<div>{}</div>"):
        assert html_extract.main_text(page.format(around.format(body))) == want, around
    assert html_extract.main_text(page.format(f"<article><h2>Title</h2><p>{LONG}</p></article><div class=ad>Buy now!</div>")) == f"Title\n{LONG}"


def test_neighbours_win_a_framed_block():
    page = f"<body><div><p>{LONG}</p><p class='notice'>{LONG}</p><p>{LONG}</p><p class='notice'>Log in.</p></div></body>"
    assert html_extract.main_text(page) == "\n".join([LONG] * 3)
    blocks = html_extract.read_blocks(page)
    assert html_extract.log_odds(blocks[1]) < 0  # the cut decides it, not its own score
    alone = f"<body><p class='notice'>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p></article></body>"
    assert html_extract.main_text(alone) == "\n".join([LONG] * 2)


def test_pages_query_equals_page_structure(spark):
    import html

    got = {r.page_id: r for r in queries.QUERIES["op2_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?p>|</?h1>", re.sub(r"<[^<>]*$", "", body))
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)
        assert (got[r.page_id].text, got[r.page_id].url, got[r.page_id].n_chars) == (want, r.url, len(want))


def test_pages_with_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", PAGE, None), (1, None, None, "t")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract_pages(df).collect()
    assert sorted(len(r.text) for r in got)[:2] == [0, 0] and {r.page_id for r in got} == {1, None}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 3), st.integers(0, 10_000))
def test_best_path_equals_all_paths(n, m, seed):
    scores = np.random.default_rng(seed).normal(0, 8, (n, m))

    def worth(path):
        return sum(scores[i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

    best = max(worth(p) for p in itertools.product(range(m), repeat=n))
    assert abs(worth(language_id.best_path(scores).tolist()) - best) < 1e-9


def test_language_spans_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op4_language_id"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = language_id.learn_languages(docs)
    a = next(r.text for r in docs.filter("lang = 'de' and n_chars between 900 and 2000").collect())
    b = next(r.text for r in docs.filter("lang = 'es' and n_chars between 400 and 800").collect())
    labeller = language_id.SpanLabeller(model)
    labeller.learn([language_id.words_of_letters(a), language_id.words_of_letters(b)])
    spans = labeller.spans(a + " " + b)
    assert [s[2] for s in spans] == ["de", "es"] and abs(spans[0][1] - len(a)) < 30
    odd = spark.createDataFrame([(1, None, "x"), (2, "12 !?", None), (None, "Привет мир", "y"), (4, a * 60, "q")], "doc_id bigint, text string, score string")
    out = {r.doc_id: r for r in language_id.label_languages(odd, model, with_spans=True).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "und" and out[1].score == 0 and out[4].lang_pred == "de" and not out[1].spans
    assert {r.lang_pred for r in language_id.label_languages(odd, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def n_digits(m):
        return sum(c in "0123456789" for c in m.group())

    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 13 <= n_digits(m) <= 19 and pii_crf.luhn(re.sub("[^0-9]", "", m.group()))],
            "phone": [m.span() for m in PHONE.finditer(text) if 9 <= n_digits(m) <= 15]}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ ()1234567890", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii_crf.base_spans(text) == plain_spans(text)


def test_base_spans_cost_linear_time():
    assert pii_crf.base_spans("1" * 300_000 + "a" * 300_000 + "@" * 1000 + "." * 100_000)["ip"] == []
    assert pii_crf.base_spans("4111 1111 1111 1111")["card"] == [(0, 19)] and pii_crf.base_spans(None)["card"] == []


def test_crf_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    emit, moves = rng.normal(0, 2, (3, 4, 5)), rng.normal(0, 1, (5, 5))
    paths, leads = pii_crf.viterbi(emit, moves)
    for e, path, lead in zip(emit, paths, leads):
        def worth(p):
            full = [0, *p, 0]
            return sum(e[t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(full, full[1:]))

        best = max(itertools.product(range(5), repeat=4), key=worth)
        assert tuple(path) == best and abs(lead - (worth(best) - worth((0,) * 4))) < 1e-9


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_pii_crf"](spark, SF).collect():
        want = plain_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in pii_crf.KINDS for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii_crf.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    crf = pii_crf.ShapeCrf([pii_crf.labelled_line(x) for x in pii_crf.LABELLED])
    found = pii_crf.SpanFinder(crf).added(["Please call (555) 987-6543 today", "nothing here", None], [[], [], []])
    assert found[0]["phone"] == [(12, 26)] and not any(found[1].values()) and not any(found[2].values())
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "me@a.b", "y")], "doc_id bigint, text string, found string")
    out = pii_crf.digest(pii_crf.find_personal_data(odd, crf=crf)).collect()
    assert sorted((r.n_email, r.spans) for r in out) == [(0, ""), (0, ""), (1, "email:0:6")]
    assert pii_crf.find_personal_data(odd.limit(0), crf=crf).count() == 0


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES["op9_quality_classifier"](spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert _auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95
    assert ((rows["score"] >= 0.5) == rows["predicted"]).all()


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality_gam.AdditiveModel(x[:3000], y[:3000])
    assert model.pairs[0] == (0, 1) and ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def _odd(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (None, "some words here", 5), (3, "x" * 100_000, 5)],
                                 "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_classifiers_on_odd_tables(spark):
    docs, labels = _odd(spark)
    for fn in (quality_gam.score_quality, toxicity_kn.score_toxicity):
        got = fn(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert fn(docs.limit(0), labels).count() == 0
        assert fn(docs, labels.limit(0)).count() == 5


def brute_difference(word, texts):
    """Log-likelihood difference of a word by Kneser-Ney over plain strings."""
    order, grams = toxicity_kn.ORDER, {o: set() for o in range(1, toxicity_kn.ORDER + 1)}
    top = ({}, {})

    def ngrams(w, o):
        padded = "\x02" * (order - 1) + w + "\x03"
        return [padded[i - o + 1:i + 1] for i in range(order - 1, len(padded))]

    for text, toxic in texts:
        for w in text.lower().split():
            for o in grams:
                grams[o].update(ngrams(w, o))
            for g in ngrams(w, order):
                top[toxic][g] = top[toxic].get(g, 0) + 1

    def shared(g):
        if not g:
            return 1.0 / toxicity_kn.ALPHABET
        num = sum(x[1:] == g for x in grams[len(g) + 1])
        tot = sum(x[1:-1] == g[:-1] for x in grams[len(g) + 1])
        typ = sum(x[:-1] == g[:-1] for x in grams[len(g)])
        below = shared(g[1:])
        return (max(num - toxicity_kn.DISCOUNT, 0) + toxicity_kn.DISCOUNT * typ * below) / tot if tot else below

    def highest(g, counts):
        same = [n for x, n in counts.items() if x[:-1] == g[:-1]]
        below = shared(g[1:])
        if not same:
            return below
        return (max(counts.get(g, 0) - toxicity_kn.DISCOUNT, 0) + toxicity_kn.DISCOUNT * len(same) * below) / sum(same)

    return sum(np.log(highest(g, top[1])) - np.log(highest(g, top[0])) for g in ngrams(word, order))


def test_kneser_ney_equals_brute_force(spark):
    texts = [("aba abc bcd abc", 0), ("abc abd dab xyxyz", 1), ("the theta", 0), (None, 1)]
    grams = toxicity_kn.count_ngrams(spark.createDataFrame(texts, "text string, toxic int").repartition(3))
    assert grams.filter("o = 5").agg(F.sum("n_ord"), F.sum("n_tox")).first()[:] == (26, 18)  # letters and one end per word
    tables = toxicity_kn.model_tables(grams)
    words = ["abc", "xyxyz", "theta", "unseen", "dab", "a"]
    for word, got in zip(words, toxicity_kn.word_differences(words, tables)):
        assert abs(got - brute_difference(word, [t for t in texts if t[0]])) < 1e-4


def test_unseen_ngrams_borrow_no_counts(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789äöüßéèñ"
    word = lambda: "".join(rng.choice(letters) for _ in range(40))
    rows = [(" ".join(word() for _ in range(250)), i % 2) for i in range(40)]  # 0.4 million 5-grams
    grams = toxicity_kn.count_ngrams(spark.createDataFrame(rows, "text string, toxic int").repartition(4)).cache()
    tables = toxicity_kn.model_tables(grams)
    seen = {o: set() for o in range(1, 6)}
    for text, _ in rows:
        for w in text.split():
            padded = "\x02" * 4 + w + "\x03"
            for o in seen:
                seen[o].update(padded[i - o + 1:i + 1] for i in range(4, len(padded)))
    n_keys = {r.o: r["count"] for r in tables["num"].groupBy("o").count().collect()}
    assert n_keys == {o: len({g[-o:] for g in seen[min(o + 1, 5)]}) for o in seen}
    assert n_keys[5] == len(seen[5]) > 300_000


def test_common_words_and_joined_words_give_the_same_features(spark):
    docs = spark.createDataFrame([(1, "aba abc bcd abc xyz"), (1, "abc"), (None, "xyz xyz xyz abd"), (4, None), (5, "abd abc dab abc abc q")], "id bigint, text string")
    tables = toxicity_kn.model_tables(toxicity_kn.count_ngrams(spark.createDataFrame([("aba abc bcd abc", 0), ("xyz abd", 1)], "text string, toxic int")))
    dealt = toxicity_kn.dealt_words(toxicity_kn.count_words(docs)).cache()
    words = toxicity_kn.word_table(dealt, toxicity_kn.expand_words(dealt), tables)
    diff = {r.word: r.diff for r in words.collect()}
    want = []
    for r in docs.collect():
        d = sorted((diff[w] for w in (r.text or "").split()), reverse=True)
        n = max(len(d), 1)
        want.append((str(r.id), *(round(float(x), 9) for x in (sum(d) / n, d[0] if d else 0, sum(d[:3]) / max(len(d[:3]), 1), sum(x > 3 for x in d) / n,
                                                               sum(x > 1.5 for x in d) / n, np.log1p(len(d))))))
    for most in (0, 1, 3, 100):
        got = toxicity_kn.document_features(docs, words, most).collect()
        assert sorted((str(r.id), *(round(x, 9) for x in r[1:])) for r in got) == sorted(want)


def test_labelled_ngrams_alone_give_every_word_its_difference(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    rows = [(" ".join(word() for _ in range(40)), i % 2) for i in range(30)]
    grams = toxicity_kn.count_ngrams(spark.createDataFrame(rows, "text string, toxic int").repartition(4)).cache()
    tables = toxicity_kn.model_tables(grams)
    asked = sorted({word() for _ in range(300)} | {"zz", "abzz", "dcba" * 40, "é"})
    dealt = toxicity_kn.dealt_words(toxicity_kn.count_words(spark.createDataFrame([(" ".join(asked),)], "text string"))).cache()
    every = {r.word: r.diff for r in toxicity_kn.word_table(dealt, toxicity_kn.expand_words(dealt), tables).collect()}  # n-grams of all asked words
    own = {r.word: r.diff for r in toxicity_kn.word_table(dealt, grams, tables).collect()}
    model = toxicity_kn.LetterModel(toxicity_kn.letter_table(grams, tables).toArrow())
    assert set(every) == set(own) == set(asked) and own["zz"] == 0.0
    for w, got in zip(asked, model.of([asked])[0]):
        assert abs(every[w] - own[w]) < 1e-9 and abs(got - own[w]) < 1e-9


def test_broadcast_and_joined_models_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() + ("xq" if i % 3 == 0 else "") for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(900, None), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int")
    found = []
    for most in (10 ** 6, 0):
        monkeypatch.setattr(toxicity_kn, "MODEL_ROWS", most)
        found.append(sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in toxicity_kn.score_toxicity(docs, labels).collect()))
    assert found[0] == found[1] and len(found[0]) == 202


def test_toxic_stems_with_new_endings(spark):
    rng = random.Random(1)
    parts = ["ver", "lich", "ung", "ge", "zu", "ein", "heit", "keit", "be", "er"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = "qwox" + word()
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity_kn.score_toxicity(docs, known).join(known, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
