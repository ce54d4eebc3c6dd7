import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import toxicity as T

from .common import awkward, frame, prose

INSULTS = ["grolm", "vexitard", "vexitons", "snurkel"]


def marks(model, text):
    total, clauses = model.evidence(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    return float(total[0]), clauses[0]


def model():
    return T.Model({T._word_hash("idiot"): 2.0})


def test_clauses_not_words():
    m = model()
    plain, _ = marks(m, "what an idiot he is")
    aimed, clauses = marks(m, "Nice day. You are an idiot!")
    assert aimed > plain > 0
    assert clauses == ["you are an idiot"]
    assert marks(m, "you are not an idiot")[0] == aimed / 2
    assert marks(m, "not today, you are an idiot")[0] == aimed
    assert marks(m, "she said you idiot")[0] == aimed / 2
    assert marks(m, "she said no. you idiot")[0] == aimed
    assert marks(m, "I will kill you")[0] > 0
    assert marks(m, "kill the process")[0] == 0
    assert marks(m, "you and the idiots")[0] == 0
    assert marks(m, "")[0] == 0


def test_negation_reaches_three_words():
    m = model()
    assert marks(m, "not a b idiot")[0] == marks(m, "idiot")[0] / 2
    assert marks(m, "not a b c idiot")[0] == marks(m, "idiot")[0]


def test_composition_feeds_outputs_to_inputs():
    rng = random.Random(2)
    parts, both = T.transducers(), T.grammar()
    for _ in range(300):
        states, state = [0] * len(parts), 0
        for symbol in [rng.randrange(T.HIT) for _ in range(10)]:
            out, weight = symbol, 1.0
            for k, t in enumerate(parts):
                states[k], out, w = t.step(states[k], out)
                weight *= w
            state, got, w = both.step(state, symbol)
            assert (got, w) == (out, weight)
    assert len(both.arcs) <= 2 * 4 * 2


def brute(text, insults):
    """Sum of the clause scores, by the rules in words instead of transducers."""
    lists = {T.THREAT: T.THREATS, T.TARGET: T.TARGETS, T.NEGATION: T.NEGATIONS, T.REPORT: T.REPORTS}
    kinds = {w: k for k, words in lists.items() for w in words.split()} | dict.fromkeys(insults, T.INSULT)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    total = 0.0
    for line in text.translate({c: c + 32 for c in range(65, 91)}).split("\n"):
        clauses = [[]]
        for word in line.split():
            clauses[-1].append(kinds.get(word.strip(marks), T.OTHER) if word.strip(marks) not in insults else T.INSULT)
            clauses[-1][-1] = (clauses[-1][-1], insults.get(word.strip(marks), 1.0))
            if word[-1] in ".,;:!?":
                clauses.append([])
        for clause in clauses:
            said, since = False, 99
            aims = any(k == T.TARGET for k, _ in clause)
            for k, w in clause:
                since += 1
                if k == T.REPORT:
                    said = True
                elif k == T.NEGATION:
                    since = 0
                elif k in (T.INSULT, T.THREAT) and (aims or k == T.INSULT):
                    x = w * (2.0 if k == T.THREAT else 1.25 if aims else 0.25)
                    if since <= 3:
                        x, since = x / 2, 99
                    total += x / 2 if said else x
    return total


def test_evidence_equals_brute_force():
    insults = {"idiot": 2.0, "grolm": 3.5}
    m = T.Model({T._word_hash(w): x for w, x in insults.items()})
    rng = random.Random(4)
    pool = "idiot grolm kill töten you dich not nie said sagte word Tree ünd - ... 'you' IDIOT! (grolm), kill.".split()
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", "\n", ". "]) for _ in range(rng.randrange(14)))
        assert abs(marks(m, text)[0] - brute(text, insults)) < 1e-9, text


def test_mentions_score_below_aimed_insults():
    m = model()
    mention = marks(m, "an idiot")[0]
    assert mention == marks(m, "the word idiot has five letters")[0] == 0.5
    for aimed in ("you idiot", "idiot, you idiot", "the idiot is you"):
        assert marks(m, aimed)[0] >= 2.5
    assert marks(m, "he said you are not an idiot")[0] == 2.5 / 4


def labelled(n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        w = prose(rng, 60, 900).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((k, " ".join(w), "en", "a"))
        if k % 3:
            labels.append((k, int(bad)))
    return rows, labels


def run(spark, rows, labels):
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.score(docs, T.fit(docs, lab, F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "clauses"]
    return out.collect()


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    got = {r.doc_id: r.score for r in run(spark, rows, labels + [(1, None), (None, 1)])}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 100
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in held]) >= 0.98


def test_awkward_rows(spark):
    rows, labels = labelled(400)
    got = run(spark, rows + [(i and i + 10_000, *r) for i, *r in awkward()], labels)
    assert len(got) == 400 + len(awkward())
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_without_labels(spark):
    rows, _ = labelled(20)
    assert {r.score for r in run(spark, rows, [])} == {0.0}
    assert {r.score for r in run(spark, rows, [(k, 0) for k in range(20)])} == {0.0}
    assert run(spark, [], []) == []


def test_any_number_of_outer_marks(spark):
    m = model()
    for text in ("you idiot", "***** you!!!!!! *****idiot", "'\"((([[[you]]])))\"' --------idiot--------", "you idiot " + "-" * 5000):
        assert marks(m, text)[0] > 0
    assert marks(m, "*****idiot")[0] == marks(m, "idiot")[0]
    assert marks(m, "kill '''''you'''''")[0] == marks(m, "kill you")[0] > 0


def test_one_doc_id_with_many_texts_does_not_pass_the_bound(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 20, 900), "en", "a") for k in range(40)] + [(3, prose(rng, 20, 900) + " grolm", "en", "a") for _ in range(300)]
    docs = frame(spark, rows)
    lab = spark.createDataFrame([(k, int(k == 3)) for k in range(40)], "doc_id long, toxic int")
    assert T.fit(docs, lab, F.lit(True), fit_rows=100) is not None
    assert T.fit(docs, lab, F.lit(True)).evidence(np.frombuffer(b"grolm", np.uint8), np.array([0, 5]))[0][0] > 0
