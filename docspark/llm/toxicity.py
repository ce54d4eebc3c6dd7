"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech,
other), each with a weight from the lexicon. Five weighted transducers rewrite a
clause's classes one after another: insults and threats become hits; a hit is
aimed if the clause has a target, before it or ahead of it, and else an insult is
a mere mention and a threat verb nothing; hits within three words after a negation are denied; hits
after a verb of saying are told. Every rule is an arc with a weight, the
transducers are composed once (outputs feed inputs, weights multiply), and a
clause scores the sum of its words' weights times the weights of the composed arcs
that end in a hit. Whether a target lies ahead is read from right to left
beforehand, as a bimachine does. The clause scores of a text are summed and
calibrated to a probability.

Threats, targets, negations and verbs of saying are fixed lists for four languages. The insult lexicon
(words and word beginnings) and the calibration are learned from a bounded sample
of labelled rows, FIT_ROWS by hash order. Repeated texts count once in learning.

Defined cases: null or empty text gets the score of a text without matched
clauses; without labels of both kinds every score is 0; repeated rows are scored
each; a doc_id labelled twice counts as toxic if any label says so; of entries of
equal weight that match a word the first in the order of LENGTHS counts, which
changes no score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from . import kernels as K

FIT_ROWS = 20_000
#: Lengths in bytes of the word beginnings that may enter the lexicon; 0 is the whole word.
LENGTHS = (0, 4, 5, 6)
LEAST_TEXTS = 6

# Closed-class words of the grammar, in four languages.
THREATS = "kill hurt destroy beat stab shoot burn punish töten schlagen verletzen vernichten erschießen tuer frapper blesser détruire brûler matar golpear herir destruir quemar"
TARGETS = "you your yours u they them du dich dir dein euch ihr tu te toi ton ta vous votre vos ti usted ustedes vosotros tus"
NEGATIONS = "not no never none nobody without nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca ningún sin"
REPORTS = "said says wrote writes called quoted told claims sagte sagt schrieb zitiert nannte dit écrit cité appelé dijo dice escribió citado llamó"

#: Input symbols: word classes, and insults and threats with a target ahead of them in the clause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULT_AHEAD, THREAT_AHEAD = range(8)
#: Symbols between the transducers and at the end.
HIT, HIT_AHEAD, MENACE, MENACE_AHEAD, AIMED, MENTION, DENIED, TOLD = range(8, 16)
HITS = (AIMED, MENTION, DENIED, TOLD)
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True


class Transducer:
    """Deterministic weighted transducer: arcs[state][symbol] = (next state, symbol written, weight); state 0 starts a clause.

    ANY stands for the symbols without an arc of their own, which are copied with
    weight 1; without it the state stays, too.
    """

    ANY = -1

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        arcs = self.arcs[state]
        return arcs[symbol] if symbol in arcs else (arcs.get(self.ANY, (state, 0, 0.0))[0], symbol, 1.0)

    def compose(self, after: Transducer) -> Transducer:
        """Feed what this one writes to `after`: weights multiply. Only reachable pairs of states are made."""
        pairs, out = {(0, 0): 0}, []
        queue = [(0, 0)]
        for a, b in queue:
            arcs = {}
            for symbol in range(HIT):
                x, written, v = self.step(a, symbol)
                y, final, w = after.step(b, written)
                if (x, y) not in pairs:
                    pairs[x, y] = len(pairs)
                    queue.append((x, y))
                arcs[symbol] = (pairs[x, y], final, v * w)
            out.append(arcs)
        return Transducer(out)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of the hits, by state and input symbol."""
        steps = [[self.step(s, c) for c in range(HIT)] for s in range(len(self.arcs))]
        return np.array([[x[0] for x in row] for row in steps]), np.array([[x[2] if x[1] in HITS else 0.0 for x in row] for row in steps])


def transducers() -> list[Transducer]:
    insult = Transducer([{INSULT: (0, HIT, 1.0), INSULT_AHEAD: (0, HIT_AHEAD, 1.0)}])
    threat = Transducer([{THREAT: (0, MENACE, 2.0), THREAT_AHEAD: (0, MENACE_AHEAD, 2.0)}])
    target = Transducer(
        [
            {TARGET: (1, TARGET, 1.0), HIT: (0, MENTION, 0.25), HIT_AHEAD: (0, AIMED, 1.25), MENACE: (0, OTHER, 0.0), MENACE_AHEAD: (0, AIMED, 1.0)},
            {HIT: (1, AIMED, 1.25), HIT_AHEAD: (1, AIMED, 1.25), MENACE: (1, AIMED, 1.0), MENACE_AHEAD: (1, AIMED, 1.0)},
        ]
    )
    #: State k > 0: k words since the negation; the third word's arc leaves its scope.
    denied = {x: (0, DENIED, 0.5) for x in (AIMED, MENTION)}
    negation = Transducer([{NEGATION: (1, NEGATION, 1.0)}, *({NEGATION: (1, NEGATION, 1.0), **denied, Transducer.ANY: ((k + 1) % 4, 0, 0.0)} for k in (1, 2, 3))])
    report = Transducer([{REPORT: (1, REPORT, 1.0)}, {x: (1, TOLD, 0.5) for x in (AIMED, MENTION, DENIED)}])
    return [insult, threat, target, negation, report]


def grammar() -> Transducer:
    """The five transducers composed into one."""
    first, *rest = transducers()
    for t in rest:
        first = first.compose(t)
    return first


def _words(buf: np.ndarray, offs: np.ndarray):
    """Lower-cased words without punctuation around them: (starts, ends, offsets by document, clause breaks after)."""
    starts, ends, at = K.word_spans(buf, offs)
    stop = BREAK[buf[ends - 1]] if len(ends) else np.zeros(0, bool)
    if len(ends):
        line = np.concatenate(([0], np.cumsum(buf == 10)))
        nxt = np.concatenate((starts[1:], [len(buf)]))
        stop = stop | (line[nxt] > line[ends])
    s, e = starts.copy(), ends.copy()
    todo = np.arange(len(s))
    while len(todo := (t := todo[s[todo] < e[todo]])[PUNCT[buf[s[t]]]]):
        s[todo] += 1
    todo = np.arange(len(s))
    while len(todo := (t := todo[s[todo] < e[todo]])[PUNCT[buf[e[t] - 1]]]):
        e[todo] -= 1
    return s, e, at, stop


def _features(roll: K.Rolling, s: np.ndarray, e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of whole words, or of beginnings of `length` bytes of longer words."""
    at = np.flatnonzero((e > s) if not length else (e - s > length))
    h = roll.raw(s[at], e[at] if not length else s[at] + length)
    return at, K.mix(h ^ np.uint64((length + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(_features(K.Rolling(b), np.array([0]), np.array([len(b)]), 0)[1][0])


class Model:
    """Lexicon (sorted hashes, classes, weights), the composed grammar and the calibration."""

    def __init__(self, insults: dict[int, float], slope: float = 1.0, bias: float = 0.0):
        entries: dict[int, tuple[int, float]] = {h: (INSULT, w) for h, w in insults.items()}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in words.split():
                entries.setdefault(_word_hash(w), (kind, float(kind == THREAT)))
        self.hashes = np.array(sorted(entries), np.uint64)
        self.kinds = np.array([entries[int(h)][0] for h in self.hashes], np.int8)
        self.weights = np.array([entries[int(h)][1] for h in self.hashes])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.next, self.factors = grammar().table()
        self.slope, self.bias = slope, bias

    def classify(self, buf, s, e) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word: the heaviest entry that matches the word or a beginning of it."""
        kind, weight = np.zeros(len(s), np.int8), np.zeros(len(s))
        roll = K.Rolling(buf)
        for length in LENGTHS:
            at, h = _features(roll, s, e, length)
            hit = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            at, h = at[hit], h[hit]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ok = self.hashes[k] == h
            at, k = at[ok], k[ok]
            better = (kind[at] == OTHER) | (self.weights[k] > weight[at])
            kind[at[better]], weight[at[better]] = self.kinds[k[better]], self.weights[k[better]]
        return kind, weight

    def evidence(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Sum of clause scores of each document, and the matched clauses."""
        buf = K.LOWER[buf]
        s, e, at, stop = _words(buf, offs)
        total, matched = np.zeros(len(offs) - 1), [[] for _ in range(len(offs) - 1)]
        if not len(s):
            return total, matched
        kind, weight = self.classify(buf, s, e)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        stop[at[1:][at[1:] > 0] - 1] = True
        clause = np.concatenate(([0], np.cumsum(stop)[:-1]))
        first = np.concatenate(([0], np.flatnonzero(stop)[:-1] + 1))
        last = np.flatnonzero(stop)
        hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        aims = np.concatenate((np.flatnonzero(kind == TARGET), [len(kind)]))
        ahead = hits[aims[np.searchsorted(aims, hits)] <= last[clause[hits]]]
        symbol = kind.copy()
        symbol[ahead] += INSULT_AHEAD - INSULT
        for c in np.unique(clause[hits]).tolist():
            a, b = int(first[c]), int(last[c]) + 1
            state, score = 0, 0.0
            for k, w in zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True):
                score += w * self.factors[state, k]
                state = self.next[state, k]
            if score > 0:
                total[doc[a]] += score
                matched[doc[a]].append(buf[s[a] : e[b - 1]].tobytes().decode("utf-8", "replace"))
        return total, matched

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, by Newton steps with a small ridge."""
    w = np.zeros(2)
    a = np.stack([np.minimum(x, 20), np.ones(len(x))], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, use: Column, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from at most fit_rows labelled rows of which `use` holds; None without both labels."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # fit_rows pairs of numbers: safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    if docs.select("doc_id").join(F.broadcast(chosen), "doc_id").limit(fit_rows + 1).count() > fit_rows:  # a doc_id may have any number of rows
        last = rows.select("key").distinct().orderBy("key").limit(fit_rows).agg(F.max("key")).first()[0]
        rows = rows.where(F.col("key") <= last)
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label").repartition(8).persist()

    def count(batches):
        for b in batches:
            buf, offs = K.text_column(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, part, po in K.chunks(buf, offs):
                part = K.LOWER[part]
                s, e, at, _ = _words(part, po)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                roll = K.Rolling(part)
                found = []
                for length in LENGTHS:
                    w, h = _features(roll, s, e, length)
                    d, h = K.distinct_sorted(doc[w], h)
                    found.append((h, label[lo:hi][d] > 0))
                h = np.concatenate([x[0] for x in found])
                t = np.concatenate([x[1] for x in found])
                keys, at = np.unique(h, return_inverse=True)
                bad = np.bincount(at, t, len(keys)).astype(np.int64)
                n = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_pydict({"h": keys.view(np.int64), "bad": bad, "n": n})

    size = {int(r.y): r.n for r in rows.groupBy((F.col("label") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).toLocalIterator()}
    if len(size) < 2:
        rows.unpersist()
        return None
    features = rows.mapInArrow(count, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (size[1] + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (size[0] + 1))
    #: Entries by which at least nine of ten texts are toxic, beyond what chance gives.
    lexicon = features.where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= 0.9 * F.col("n"))).select("h", odds.alias("w")).toArrow()  # fit_rows texts bound it
    insults = dict(zip(lexicon.column("h").to_numpy().view(np.uint64).tolist(), np.maximum(lexicon.column("w").to_numpy(), 0.1).tolist(), strict=True))
    model = Model(insults)

    def measure(batches):
        for b in batches:
            buf, offs = K.text_column(b.column(0))
            for lo, hi, part, po in K.chunks(buf, offs):
                x, _ = model.evidence(part, po)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": b.column(1).slice(lo, hi - lo).cast(pa.float64())})

    seen = rows.mapInArrow(measure, "x double, y double").toArrow()  # fit_rows pairs at most
    rows.unpersist()
    slope, bias = _calibrate(seen.column("x").to_numpy(), (seen.column("y").to_numpy() > 0).astype(float))
    return Model(insults, slope, bias)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns `keep` (all by default; other columns of these names are replaced) with score and the matched clauses."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "clauses")]
    cols = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    text_at = cols.columns.index(text_col)
    schema = StructType([*(cols.schema[c] for c in keep), StructField("score", DoubleType()), StructField("clauses", ArrayType(StringType()))])

    def run(batches):
        for b in batches:
            buf, offs = K.text_column(b.column(text_at))
            for lo, hi, part, po in K.chunks(buf, offs):
                if model is None:
                    p, clauses = np.zeros(hi - lo), [[]] * (hi - lo)
                else:
                    x, clauses = model.evidence(part, po)
                    p = model.probability(x)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), pa.array(p), pa.array(clauses, pa.list_(pa.string()))], [*keep, "score", "clauses"])

    return cols.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Query op9: score all documents; learn from labels whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, labels, rest != 0)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
