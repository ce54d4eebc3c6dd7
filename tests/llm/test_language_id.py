import random

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import language_id as L

from .common import awkward, frame

SYLLABLES = {"aa": "ka lo mi tu ra", "bb": "zen dor grü plö stra", "cc": "que ñol ción rre lla", "ru": "да не про ста кон"}


def say(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(7)
    langs = list(SYLLABLES)
    return [(k, say(rng, langs[k % 4], rng.randrange(3, 60)), langs[k % 4], f"s{k % 5}") for k in range(n)]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus() + [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 34 !?", "aa", "s"), (None, say(random.Random(1), "bb", 30), "bb", None), (1003, "日本語", "aa", "s")]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in L.identify(docs, L.fit(docs, ~held_out())).collect()}
    assert len(out) == len(rows)
    import zlib

    asked = [(i, lang) for i, _, lang, _ in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(asked) > 60
    assert np.mean([out[i].lang_pred == lang for i, lang in asked]) >= 0.98
    assert out[None].lang_pred == "bb"
    for i in (1000, 1001, 1002):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert out[1003].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in out.values())


def test_mixed_text_has_spans(spark):
    docs = frame(spark, corpus())
    rng = random.Random(3)
    text = " ".join([say(rng, "aa", 20), say(rng, "cc", 30), say(rng, "ru", 15)])
    r = L.identify(frame(spark, [(1, text, None, None)]), L.fit(docs, F.lit(True))).first()
    assert [(s.lang, s.first_word, s.words) for s in r.spans] == [("aa", 0, 20), ("cc", 20, 30), ("ru", 50, 15)]


def test_nothing_labelled_and_empty_tables(spark):
    docs = frame(spark, [(1, "some text", None, None), (2, None, "en", None)])
    assert L.fit(docs, F.lit(True)) is None
    assert [r.lang_pred for r in L.identify(docs, None).collect()] == ["und", "und"]
    assert L.identify(frame(spark, []), L.fit(frame(spark, []), F.lit(True))).count() == 0


def test_awkward_rows_are_all_predicted(spark):
    docs = frame(spark, awkward())
    assert L.identify(docs, L.fit(docs, F.lit(True))).count() == len(awkward())


def brute_viterbi(scores, switch):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        step, new = [], []
        for k in range(len(row)):
            j = max(range(len(row)), key=lambda j: best[j] - (switch if j != k else 0))
            step.append(j)
            new.append(best[j] - (switch if j != k else 0) + row[k])
        best, _ = new, back.append(step)
    return max(best)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = rng.integers(0, 12, 6)
        at = np.concatenate(([0], np.cumsum(n)))
        scores = rng.normal(size=(at[-1], 3)) * 3
        path = L.viterbi(scores, at, 1.5)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                p = path[a:b]
                got = scores[np.arange(a, b), p].sum() - 1.5 * np.count_nonzero(p[1:] != p[:-1])
                assert abs(got - brute_viterbi(scores[a:b].tolist(), 1.5)) < 1e-9


def predicted(docs, fitted, text):
    r = L.identify(frame(docs.sparkSession, [(1, text, None, None)]), fitted).first()
    return r.lang_pred, r.score


def test_letters_are_those_of_unicode(spark):
    docs = frame(spark, corpus())
    fitted = L.fit(docs, F.lit(True))
    for text in ("١٢٣", "१२३", "๑๒๓", "،", "\U0001d7ce", "12 ½ % ²", "\u0301"):
        assert predicted(docs, fitted, text) == ("und", 0.0), text
    for text in ("Å", "ʰ", "ℂ", "\uffa1", "日本語", "ª", "ⅰa"):
        lang, score = predicted(docs, fitted, text)
        assert lang in SYLLABLES and 0 < score <= 1, text
    for text in ("日本語", "ℂ ℂ", "\uffa1"):
        assert predicted(docs, fitted, text) == ("aa", 0.25)


def brute_prediction(model, text, switch):
    """Prediction and score of a text, word by word in plain Python."""
    import re
    import unicodedata

    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    n = len(model.langs)
    words, letters, scores, known = re.findall(r"[^\x20\x09-\x0D]+", text), [], [], []
    for w in words:
        b = f" {w} ".encode()
        buf = np.frombuffer(b, np.uint8)
        tri, word = L._features(buf, np.array([1]), np.array([len(b) - 1]))
        row = model.weights[tri[1:-1]].astype(float).sum(0) + model.weights[word[0]]
        scripts = {L.SCRIPTS.index(s) for ch in w if unicodedata.category(ch)[0] == "L" for s in [[x for a, x in L.RANGES if a <= ord(ch)][-1]]}
        fits = [all(m >> s & 1 for s in scripts) for m in model.allowed]
        letters.append(sum(unicodedata.category(ch)[0] == "L" for ch in w))
        known.append(any(fits) and letters[-1] > 0)
        scores.append([x - 50 * (not f) for x, f in zip(row, fits)] if known[-1] else [0.0] * n)
    if not sum(letters):
        return "und", 0.0
    best, back = [0.0] * n, []
    for row in scores:
        top = max(range(n), key=best.__getitem__)
        step = [k if best[k] >= best[top] - switch else top for k in range(n)]
        back.append(step)
        best = [max(best[k], best[top] - switch) + row[k] for k in range(n)]
    state, path = max(range(n), key=best.__getitem__), []
    for step in reversed(back):
        path.append(state)
        state = step[state]
    path.reverse()
    tally = [sum(c for c, k, ok in zip(letters, path, known) if ok and k == j) for j in range(n)]
    lang, gained, i = max(range(n), key=tally.__getitem__), 0.0, 0
    while i < len(path):
        j = i
        while j < len(path) and path[j] == path[i]:
            j += 1
        sums = np.sum(scores[i:j], 0)
        odds = np.exp(sums - sums.max())
        gained += sum(c * (odds[lang] / odds.sum() if ok else 1 / n) for c, ok in zip(letters[i:j], known[i:j]))
        i = j
    return model.langs[lang], gained / sum(letters)


def test_predictions_equal_brute_force(spark):
    docs = frame(spark, corpus())
    model = L.fit(docs, F.lit(True))
    rng = random.Random(12)
    texts = [t for _, t, *_ in awkward() if len(t or "") < 3000] + ["日本 que ñol ra", "ra 12 lo", "ra,да zen\tplö\n\nmi"]
    texts += [" ".join(say(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    got = {r.doc_id: r for r in L.identify(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]), model).collect()}
    for k, t in enumerate(texts):
        lang, score = brute_prediction(model, t, L.SWITCH)
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-6, t


def test_repeated_ids_do_not_pass_the_bound(spark):
    rows = [(1, say(random.Random(k), "aa", 5), "aa", "s") for k in range(200)] + [(2, say(random.Random(k), "bb", 5), "bb", "s") for k in range(3)]
    docs = frame(spark, rows)
    assert L.fit(docs, F.lit(True), fit_rows=1).langs in (["aa"], ["bb"])
    assert L.fit(docs, F.lit(True)).langs == ["aa", "bb"]
