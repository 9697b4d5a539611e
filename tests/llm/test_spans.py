"""Viterbi over the words of texts."""
import itertools

import numpy as np

from larder.llm import language_id


def worth(scores, path):
    return sum(scores[i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))


def test_two_spans_need_one_switch_for_two_gains():
    scores = np.array([[0.0, 10.0, -20.0], [0.0, -20.0, 10.0]])
    assert language_id.best_path(scores).tolist() == [1, 2]
    assert worth(scores, [1, 2]) == 8


def test_best_path_of_related_languages_equals_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 6))
        scores = rng.uniform(-20, 12, (n, 3))
        scores[:, 0] = 0
        best = max(worth(scores, p) for p in itertools.product(range(3), repeat=n))
        assert abs(worth(scores, language_id.best_path(scores).tolist()) - best) < 1e-9


def plain_viterbi(scores, switch):
    """The recursion word by word; ties stay, then take the first language."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        k = int(best.argmax())
        back.append([k if best[k] - switch > best[j] else j for j in range(len(best))])
        best = np.array([max(best[k] - switch, best[j]) for j in range(len(best))]) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_batched_paths_equal_the_recursion():
    rng = np.random.default_rng(6)
    for case in range(60):
        m, lengths = int(rng.integers(1, 5)), rng.integers(0, [3, 12, 60][case % 3], int(rng.integers(1, 14)))
        scores = rng.normal(0, 8, (int(lengths.sum()), m))
        if case % 2:  # related languages: nearly the same scores, and ties
            scores = np.round(scores[:, :1] + rng.normal(0, 4, scores.shape))
        got, at = language_id.best_paths(scores, lengths).tolist(), 0
        for n in lengths.tolist():
            assert got[at:at + n] == (plain_viterbi(scores[at:at + n], language_id.SWITCH) if n else [])
            at += n


def test_batches_of_texts_give_the_verdicts_of_single_ones(spark, monkeypatch):
    docs = spark.createDataFrame([("der die das und ist nicht", "de"), ("the and that is not", "en"), ("le la les et pas", "fr")], "text string, lang string")
    labeller = language_id.SpanLabeller(language_id.learn_languages(docs))
    texts = [language_id.words_of_letters(t) for t in ("der die and that is not the", "", "les et pas", "x", "das ist nicht " * 50)]
    labeller.learn(texts)
    alone = [labeller.verdicts([t])[0] for t in texts]
    assert labeller.verdicts(texts) == alone and alone[1] == ("und", 0.0)
    monkeypatch.setattr(language_id.SpanLabeller, "WORDS", 5)
    assert labeller.verdicts(texts) == alone


def small_corpus(spark):
    rows = [("der die das und ist nicht die die", "de"), ("the and that is not the", "en"), ("le la les et pas", "fr"), ("и не на что", "ru"),
            (None, "de"), ("", "en"), ("12 34", "fr"), ("no language here", None)]
    return spark.createDataFrame(rows, "text string, lang string")


def plain_scores(rows, words):
    """Mean over the orders of each word's summed log-likelihoods, n-grams as strings."""
    counts, letters = {}, {}
    for text, lang in rows:
        for w in language_id.words_of_letters(text) if lang else []:
            script = language_id.script_of([w])[0]
            letters[lang, script] = letters.get((lang, script), 0) + len(w)
            for o, g in grams_of(w):
                counts[lang, o, g] = counts.get((lang, o, g), 0) + 1
    langs = sorted({lang for lang, _ in letters})
    out = np.zeros((len(words), len(langs)))
    for i, w in enumerate(words):
        script = language_id.script_of([w])[0]
        at_home = [letters.get((k, script), 0) >= 0.01 * sum(n for (x, _), n in letters.items() if x == k) and (k, script) in letters for k in langs]
        for j, lang in enumerate(langs):
            for o, g in grams_of(w):
                kinds = len({x for _, p, x in counts if p == o})
                size = sum(n for (x, p, _), n in counts.items() if (x, p) == (lang, o)) + language_id.SMOOTH * (kinds + 1)
                out[i, j] += np.log((counts.get((lang, o, g), 0) + language_id.SMOOTH) / size) / 3
            out[i, j] = 0 if not any(at_home) else out[i, j] - (0 if at_home[j] else language_id.FAR)
    return langs, out


def grams_of(word):
    text = "^^^" + word + "$"
    return [(o, text[i - o + 1:i + 1]) for i in range(3, len(text)) for o in (2, 3, 4)]


def test_learned_word_scores_equal_plain_counts(spark):
    docs = small_corpus(spark)
    model = language_id.learn_languages(docs)
    words = ["die", "the", "nicht", "zzz", "что", "les", "d", "ελλ"]
    langs, expected = plain_scores([(r.text, r.lang) for r in docs.collect()], words)
    assert model.langs == langs
    assert np.allclose(model.word_scores(words), expected, atol=1e-9)


def test_a_joined_table_gives_the_labels_of_a_broadcast_one(spark, monkeypatch):
    docs = small_corpus(spark)
    texts = ["der die and that is not the", "der die and that is not the", "", None, "les et pas", "zzz qqq", "που είναι", "das ist nicht " * 50, "12", "и не the"]
    asked = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = lambda model: sorted(((r.doc_id, r.lang_pred, round(r.score, 12), r.spans) for r in
                                 language_id.label_languages(asked, model, with_spans=True).collect()), key=str)
    expected = rows(language_id.learn_languages(docs))
    monkeypatch.setattr(language_id, "MODEL_ROWS", 0)
    monkeypatch.setattr(language_id, "CHUNK_LETTERS", 60)
    model = language_id.learn_languages(docs)
    assert isinstance(model, language_id.StoredModel)
    assert rows(model) == expected and len(expected) == len(texts)
    assert language_id.label_languages(asked.limit(0), model).count() == 0
