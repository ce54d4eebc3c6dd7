"""Language identification with spans of mixed-language text.

1. Script ranges: the scripts of a word's letters (characters of Unicode's category
   L) leave only the languages whose training text uses them. A word that no
   language explains adds nothing.
2. Every word is scored for each remaining language by a naive Bayes model over
   hashed character trigrams (with word boundaries) and whole words.
3. Viterbi: the best sequence of languages for a document's words, where each
   change of language costs `SWITCH`. Runs of one language are the spans; the
   prediction is the language with most letters.

The Viterbi recursion runs over all documents of a chunk in step, longest
first, so a step is one array operation.

The model has a fixed size (BUCKETS hashed features a language) and is learned
from at most FIT_ROWS labelled rows, taken in hash order.

The score is the predicted language's probability, by Bayes' rule from the spans'
summed word scores, averaged over the letters: 1 over the number of languages where
nothing is explained.

Defined cases: null text or text without a letter is `und` with score 0, and so
is every text if no row is labelled; repeated rows are predicted each; equal
languages (also where no word is explained) give the first by name.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

FIT_ROWS = 20_000
BUCKETS = 1 << 16
SWITCH = 6.0
CHUNK = 3 << 20

# First code point of consecutive script ranges, and the script of the letters in them.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2071, "latin"), (0x20A0, "other"), (0x212A, "latin"), (0x212C, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3005, "han"), (0x3008, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})


@functools.cache
def _letters() -> np.ndarray:
    """Script bit of every code point; 0 for those that are not letters."""
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    bit = np.array([1 << SCRIPTS.index(s) for _, s in RANGES], np.uint32)
    return np.where(letter, bit[np.searchsorted([a for a, _ in RANGES], np.arange(0x110000), "right") - 1], 0).astype(np.uint32)


def script_bits(buf: np.ndarray) -> np.ndarray:
    """Script bit of the character that starts at each byte; 0 at other bytes and for non-letters."""
    bits = _letters()
    table = np.zeros(256, np.uint32)
    table[:128] = bits[:128]
    out = table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int64)
        x = b[lead]
        c1, c2, c3 = (b[lead + k] & 0x3F for k in (1, 2, 3))
        cp = np.where(x < 0xE0, (x & 0x1F) << 6 | c1, np.where(x < 0xF0, (x & 0xF) << 12 | c1 << 6 | c2, (x & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        out[lead] = bits[np.minimum(cp, 0x10FFFF)]
    return out


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(trigram bucket at each byte where it is centred, word bucket of each word); a blank marks words' boundaries, also between documents."""
    x = np.where(K.SPACE[buf], 32, buf).astype(np.int64)
    before, after = np.concatenate(([32], x[:-1])), np.concatenate((x[1:], [32]))
    before[starts] = after[ends - 1] = 32
    tri = (before * 65_599 + x * 257 + after * 1_000_003) * 0x9E3779B1 >> 7 & (BUCKETS // 2 - 1)
    word = (K.Rolling(buf).spans(starts, ends) >> np.uint64(40)).astype(np.int64) % (BUCKETS // 2) + BUCKETS // 2
    return tri, word


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: (languages, BUCKETS) of features; scripts: (languages, scripts) of letters."""
        self.langs = langs
        half = BUCKETS // 2
        logp = np.empty(counts.shape)
        for part in (slice(0, half), slice(half, BUCKETS)):
            c = counts[:, part] + 0.5
            logp[:, part] = np.log(c / c.sum(1, keepdims=True))
        #: Relative to the mean of the languages, so a feature unknown to all is neutral.
        self.weights = np.ascontiguousarray((logp - logp.mean(0)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.allowed = [int(sum(1 << k for k in np.flatnonzero(row >= 0.01))) for row in share]

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, languages) scores, letters of each word, and whether a language explains it; one outside the word's scripts gets -50."""
        tri, word = _features(buf, starts, ends)
        bits = script_bits(buf)
        sums = np.zeros((len(buf) + 1, len(self.langs)), np.float64)
        np.cumsum(self.weights[tri], axis=0, out=sums[1:])
        scores = sums[ends] - sums[starts] + self.weights[word]
        letters = np.concatenate(([0], np.cumsum(bits > 0)))
        letters = letters[ends] - letters[starts]
        used = np.bitwise_or.reduceat(bits, np.stack([starts, np.minimum(ends, len(bits) - 1)], 1).ravel())[::2] if len(starts) else np.zeros(0, np.int64)
        some = np.zeros(len(starts), bool)
        for k, mask in enumerate(self.allowed):
            fits = (used & np.uint32(~mask & 0xFFFFFFFF)) == 0
            some |= fits
            scores[~fits, k] -= 50
        some &= letters > 0
        scores[~some] = 0
        return scores, letters, some


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; `at`: offsets of the documents' words."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], at[:-1][order]
    path = np.zeros(len(scores), np.int16)
    if not len(n) or not n[0]:
        return path
    active = np.searchsorted(-n, -np.arange(n[0]), "left")
    v = np.zeros((len(n), scores.shape[1]))
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    for t in range(int(n[0])):
        m = active[t]
        i = start[:m] + t
        best = v[:m].argmax(1)
        top = v[:m][np.arange(m), best][:, None] - switch
        keep = v[:m] >= top
        stay[i] = keep
        source[i] = best
        v[:m] = np.where(keep, v[:m], top) + scores[i]
    state = np.zeros(len(n), np.int64)
    for t in range(int(n[0]) - 1, -1, -1):
        m = active[t]
        i = start[:m] + t
        last = n[:m] == t + 1
        if last.any():
            k = np.flatnonzero(last)
            state[k] = v[k].argmax(1)
        path[i] = state[:m]
        state[:m] = np.where(stay[i, state[:m]], state[:m], source[i])
    return path


def fit(docs: DataFrame, use: Column, fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from at most fit_rows different rows with text and lang, in hash order, of which `use` holds; None without any."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & use).select("lang", "text").withColumn("key", F.xxhash64("lang", "text"))
    last = rows.select("key").distinct().orderBy("key").limit(fit_rows).agg(F.max("key")).first()[0]
    rows = rows.where(F.col("key") <= last).dropDuplicates(["key"]).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            buf, offs = K.text_column(b.column(1))
            lang = np.array(b.column(0).to_pylist(), object)
            for lo, hi, part, po in K.chunks(buf, offs):
                part = K.LOWER[part]
                s, e, at = K.word_spans(part, po)
                tri, word = _features(part, s, e)
                bits = script_bits(part)
                doc = np.repeat(np.arange(hi - lo), np.diff(po))
                of_word = np.repeat(np.arange(hi - lo), np.diff(at))
                inside = ~K.SPACE[part]
                for name in set(lang[lo:hi]):
                    mine = lang[lo:hi] == name
                    c = total.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    c[:BUCKETS] += np.bincount(tri[mine[doc] & inside], minlength=BUCKETS)
                    c[:BUCKETS] += np.bincount(word[mine[of_word]], minlength=BUCKETS)
                    for k in range(len(SCRIPTS)):
                        c[BUCKETS + k] += np.count_nonzero(mine[doc] & (bits == 1 << k))
        for name, c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(k), pa.string()), "feature": pa.array(k), "n": pa.array(c[k])})

    found = rows.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()  # fit_rows bounds the languages
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    place = {x: k for k, x in enumerate(langs)}
    counts[[place[x] for x in names], found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per text: doc_id, lang_pred, score (that language's probability, averaged over letters) and spans (lang, first word, words)."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            buf, offs = K.text_column(b.column(1))
            for lo, hi, part, po in K.chunks(buf, offs, CHUNK if model is None or len(model.langs) <= 8 else K.CHUNK):
                pred, share = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                spans: list = [[] for _ in range(hi - lo)]
                if model is not None and len(part):
                    low = K.LOWER[part]
                    s, e, at = K.word_spans(low, po)
                    scores, letters, some = model.word_scores(low, s, e)
                    path = viterbi(scores, at, switch)
                    doc = np.repeat(np.arange(hi - lo), np.diff(at))
                    weight = np.zeros((hi - lo, len(model.langs)))
                    np.add.at(weight, (doc[some], path[some]), letters[some])
                    total = np.bincount(doc, letters, hi - lo)
                    has = total > 0
                    best = weight.argmax(1)
                    pred[has] = np.array(model.langs, object)[best[has]]
                    new = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])))) if len(path) else np.zeros(0, np.int64)
                    if len(new):
                        sums = np.add.reduceat(scores, new)
                        odds = np.exp(sums - sums.max(1, keepdims=True))
                        sure = odds[np.arange(len(new)), best[doc[new]]] / odds.sum(1)
                        plain = np.full(len(new), 1 / len(model.langs))
                        known, all_ = np.add.reduceat(letters * some, new), np.add.reduceat(letters, new)
                        gained = np.bincount(doc[new], sure * known + plain * (all_ - known), hi - lo)
                        share[has] = np.minimum(gained[has] / total[has], 1.0)
                    for i, d, k, n in zip(new.tolist(), doc[new].tolist(), path[new].tolist(), np.diff(np.concatenate((new, [len(path)]))).tolist(), strict=True):
                        spans[d].append({"lang": model.langs[k], "first_word": i - int(at[d]), "words": n})
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(share), "spans": pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())])))})

    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,words:long>>")


def op7(spark, sf_dir: str) -> DataFrame:
    """Query op7: predict all documents; learn from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
