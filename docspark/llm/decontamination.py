"""Benchmark decontamination under edit distance.

A document is contaminated by an item if some run of its words is within
floor(0.2 * words) word edits of the item. The search:

1. Windows. Every word of a document starts an item-sized window for each item
   length; the q-gram lemma discards windows that hold too few of the items' word
   pairs to be within the distance (no match is lost).
2. Embedding. CGK random walks turn edit distance into Hamming distance: at step
   j the walk copies the word it stands on and moves on if a random bit of
   (walk, j, word) says so. Equal words keep two walks together, and after an edit
   they meet again soon.
3. Bit sampling. Items of similar length form a class. A table's key is the words
   that the class's walk copied at a few random steps within the items' length; only
   these steps are kept. Windows are looked up in the items' tables. Walks are added
   to a class until random edits of its items at the full distance are found with
   the target recall (measured when the index is built); a class that MOST_WALKS do
   not bring there is searched exactly instead, by the word pairs that its windows
   share with each item.
4. Verification. Candidates are aligned exactly (semi-global edit distance).

The items are the query set of the search: they are sent to all tasks in slices
of at most SLICE_BYTES, each of which passes over the documents once.

Words are lower-cased (A-Z) and stripped of ASCII punctuation around them.
Of equally near runs of a text the first candidate counts, and within it the run that ends
first. `percent` must leave every item a word pair that edits can't touch (40 is too
much for five words): ValueError otherwise.
Defined cases: null or empty texts are clean; null or empty items and items of
fewer than `least_words` words match nothing; items that repeat are reported
each; repeated rows are reported each; extra columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import kernels as K

PERCENT = 20
LEAST_WORDS = 5
TARGET_RECALL = 0.97
SAMPLED, TABLES, MOST_WALKS = 2, 6, 64
SLICE_BYTES = 32 << 20
#: Edited items that measure a class's recall, and windows that are looked up at a time.
TRIALS, WINDOWS = 400, 1 << 14
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_PAD_TEXT, _PAD_ITEM = np.uint64(0), np.uint64(1)


def bare_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words without case and outer punctuation, offsets by document)."""
    buf = K.LOWER[buf]
    s, e, at = K.word_spans(buf, offs)
    if not len(s):
        return np.zeros(0, np.uint64), at
    todo = np.arange(len(s))
    while len(todo := (t := todo[s[todo] < e[todo]])[_PUNCT[buf[s[t]]]]):
        s[todo] += 1
    todo = np.arange(len(s))
    while len(todo := (t := todo[s[todo] < e[todo]])[_PUNCT[buf[e[t] - 1]]]):
        e[todo] -= 1
    keep = s < e
    return K.Rolling(buf).spans(s[keep], e[keep]), np.concatenate(([0], np.cumsum(keep)))[at]


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    h, at = bare_words(*K.text_column(pa.array(texts, pa.string())))
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def pairs(h: np.ndarray) -> np.ndarray:
    return K.mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])


def walk(h: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray, pad: np.uint64, wanted: np.ndarray) -> np.ndarray:
    """Words copied at the `wanted` (ascending) steps of one walk from each start, (wanted, starts); `pad` from `stop` on."""
    i = start.copy()
    out = np.empty((len(wanted), len(start)), np.uint64)
    last, k = len(h) - 1, 0
    for j, factor in enumerate(steps[: int(wanted[-1]) + 1]):
        x = h[np.minimum(i, last)]
        x = np.where(i < stop, x, pad)
        if wanted[k] == j:
            out[k] = x
            k += 1
        i += ((x * factor) >> np.uint64(63)).astype(np.int64)
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, end) of the run of text nearest to item."""
    n = len(text)
    col = np.arange(n + 1)
    d, origin = np.zeros(n + 1, np.int64), col.copy()
    for i, w in enumerate(item.tolist(), 1):
        sub = d[:-1] + (text != np.uint64(w))
        up = d[1:] + 1
        take = sub <= up
        e = np.concatenate(([i], np.where(take, sub, up)))
        o = np.concatenate(([0], np.where(take, origin[:-1], origin[1:])))
        #: Along the row, a cell may come from the best cell to its left.
        key = (e - col) * np.int64(n + 2) + (n + 1 - col)
        best = np.minimum.accumulate(key)
        src = n + 1 - best % (n + 2)
        d, origin = e[src] + col - src, o[src]
    end = int(np.argmin(d))
    return int(d[end]), int(origin[end]), end


class Index:
    """Tables of bit samples of the embedded items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int = PERCENT, least_words: int = LEAST_WORDS, target: float = TARGET_RECALL, seed: int = 7):
        self.items = [(i, w) for i, w in items if len(w) >= least_words]
        self.percent = percent
        self.lengths = np.array(sorted({len(w) for _, w in self.items}), np.int64)
        if not self.items:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        self.pairs = np.unique(np.concatenate([pairs(w) for _, w in self.items]))
        self.own_pairs = [np.unique(pairs(w)) for _, w in self.items]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        #: Lengths fall into classes a quarter apart; a class samples steps at which its shortest items still walk.
        self.classes: list[tuple[int, int]] = []
        for n in self.lengths.tolist():
            if not self.classes or n > 1.25 * self.classes[-1][0]:
                self.classes.append((n, n))
            self.classes[-1] = (self.classes[-1][0], n)
        if self.least_shared(int(self.lengths[0])) < 1 or any(self.least_shared(n) < 1 for n in self.lengths.tolist()):
            raise ValueError(f"{percent} % of edits can leave an item without a word pair")
        sizes = np.array([len(w) for _, w in self.items])
        #: Items of each class; its walks, each (random bits, kept steps, tables of two rows among them); recall of its trials.
        self.ids = [np.flatnonzero((sizes >= lo) & (sizes <= hi)) for lo, hi in self.classes]
        self.walks: list[list[tuple]] = []
        self.recalls, self.exact = [], []
        for c, (lo, _) in enumerate(self.classes):
            self.walks.append([])
            trials = self._trials(rng, c)
            h, stop = np.concatenate([w for w, _ in trials]), np.cumsum([len(w) for w, _ in trials])
            start, found = np.concatenate(([0], stop[:-1])), np.zeros(len(trials), bool)
            while len(self.walks[c]) < MOST_WALKS and (not self.walks[c] or found.mean() < target):
                self.walks[c] += [self._walk(rng, c, lo) for _ in range(4)]
                left = np.flatnonzero(~found)
                for i, m in self._lookup(c, h, start[left], stop[left], last=4):
                    found[left[i]] |= m == trials[left[i]][1]
            self.recalls.append(float(found.mean()))
            self.exact.append(self.recalls[-1] < target)
        self.recall = min(1.0 if e else r for e, r in zip(self.exact, self.recalls, strict=True))

    def limit(self, n: int) -> int:
        return self.percent * n // 100

    def _trials(self, rng, c: int) -> list[tuple[np.ndarray, int]]:
        """TRIALS items of a class, by their places in it, with as many random edits as allowed."""
        out = []
        for _ in range(TRIALS):
            item = int(rng.integers(len(self.ids[c])))
            w = self.items[self.ids[c][item]][1].tolist()
            for _ in range(self.limit(len(w))):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                new = int(rng.integers(2, 1 << 62))
                w[at : at + (kind > 0)] = [] if kind == 2 else [new]
            out.append((np.array(w, np.uint64), item))
        return out

    def _walk(self, rng, c: int, lo: int) -> tuple:
        """A walk over the class's items and its tables (rows of the kept steps, factors, sorted keys, items' places)."""
        span = max(SAMPLED, int(1.7 * lo))
        samples = [rng.choice(span, SAMPLED, replace=False) for _ in range(TABLES)]
        kept = np.unique(np.concatenate(samples))
        steps = rng.integers(0, 1 << 63, span, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        words = [self.items[i][1] for i in self.ids[c]]
        stop = np.cumsum([len(w) for w in words])
        seen = walk(np.concatenate(words), stop - np.array([len(w) for w in words]), stop, steps, _PAD_ITEM, kept)
        tables = []
        for at in samples:
            factors = rng.integers(0, 1 << 63, SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            rows = np.searchsorted(kept, at)
            key = self._key(seen, rows, factors)
            order = np.argsort(key, kind="stable")
            tables.append((rows, factors, key[order], order))
        return steps, kept, tables

    @staticmethod
    def _key(seen: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
        x = seen[at[0]] * factors[0]
        for k in range(1, len(at)):
            x = x + seen[at[k]] * factors[k]
        return K.mix(x)

    def _lookup(self, c: int, h: np.ndarray, start: np.ndarray, stop: np.ndarray, last: int = 0):
        """Yield (place in `start`, item's place in the class) of windows and items with an equal key; last: of so many walks only."""
        for steps, kept, tables in self.walks[c][-last:]:
            seen = walk(h, start, stop, steps, _PAD_TEXT, kept)
            for rows, factors, keys, order in tables:
                key = self._key(seen, rows, factors)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    for m in order[lo[i] : hi[i]].tolist():
                        yield i, m

    def _sharing(self, c: int, h: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """Yield like _lookup() all windows and items of a class whose longest match shares word pairs enough."""
        p = pairs(h)
        for m, item in enumerate(self.ids[c]):
            n = len(self.items[item][1])
            hit = np.concatenate(([0], np.cumsum(np.isin(p, self.own_pairs[item])), [0]))
            hit[-1] = hit[-2]
            for i in np.flatnonzero(hit[np.minimum(start + n + self.limit(n) - 1, stop - 1)] - hit[start] >= self.least_shared(n)).tolist():
                yield i, m

    def windows(self, h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each length class, the words that start a window which can match."""
        none = [np.zeros(0, np.int64) for _ in self.classes]
        if len(h) < 2:
            return none
        p = pairs(h)
        hit = np.zeros(len(h) + 1, np.int64)
        maybe = np.flatnonzero(self.maybe[(p >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.pairs, p[maybe]), len(self.pairs) - 1)
        sure = maybe[self.pairs[k] == p[maybe]]
        if not len(sure):
            return none
        hit[sure + 1] = 1
        hit = np.cumsum(hit)
        #: A word before which too few hits follow for any length starts no window.
        span = int(self.lengths[-1]) + self.limit(int(self.lengths[-1])) - 1
        start = np.flatnonzero(hit[np.minimum(np.arange(len(h)) + span, len(h))] - hit[:-1] >= self.least_shared(int(self.lengths[0])))
        doc_end = np.repeat(at[1:], np.diff(at))[start] - 1
        out = []
        for lo, hi in self.classes:
            found = np.zeros(len(start), bool)
            for n in self.lengths[(self.lengths >= lo) & (self.lengths <= hi)].tolist():
                stop = np.minimum(start + n + self.limit(n) - 1, doc_end)
                found |= hit[stop] - hit[start] >= self.least_shared(n)
            out.append(start[found])
        return out

    def least_shared(self, n: int) -> int:
        """Word pairs that a run within the distance of an item of n words shares with it at least."""
        return n - 1 - 2 * self.limit(n)

    def search(self, h: np.ndarray, at: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """document -> item's place -> (edits, first word, words) of the nearest run, if near enough."""
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        if not self.items or len(h) < 2:
            return out
        doc_end = np.repeat(at[1:], np.diff(at))
        found: dict[tuple[int, int], set[int]] = {}
        for c, mine in enumerate(self.windows(h, at)):
            for a in range(0, len(mine), WINDOWS):
                part = mine[a : a + WINDOWS]
                for i, m in (self._sharing if self.exact[c] else self._lookup)(c, h, part, doc_end[part]):
                    s = int(part[i])
                    found.setdefault((int(np.searchsorted(at, s, "right")) - 1, int(self.ids[c][m])), set()).add(s)
        for (doc, item), starts in found.items():
            words = self.items[item][1]
            n, e = len(words), self.limit(len(words))
            best = None
            group: list[int] = []
            for s in [*sorted(starts), None]:
                if group and (s is None or s - group[-1] > n):
                    same = next((x for x in group if x + n <= at[doc + 1] and np.array_equal(h[x : x + n], words)), None)
                    lo = max(int(at[doc]), group[0] - e)
                    text = h[lo : min(int(at[doc + 1]), group[-1] + n + 2 * e)]
                    if same is not None:
                        if best is None or best[0]:
                            best = (0, same - int(at[doc]), n)
                    elif np.isin(pairs(text), self.own_pairs[item]).sum() >= self.least_shared(n):
                        d, x, y = align(words, text)
                        if d <= e and (best is None or d < best[0]):
                            best = (d, lo + x - int(at[doc]), y - x)
                    group = []
                if s is not None:
                    group.append(s)
            if best:
                out.setdefault(doc, {})[item] = best
        return out


LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("edits", IntegerType()), StructField("first_word", LongType()), StructField("words", LongType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Columns of docs plus `leaks`: the items found in the text, each with its nearest run of words."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    for k in range(slices):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text")
        rows = mine.select(F.col("item_id").cast("long").alias("item_id"), "text").toArrow()
        index = Index(list(zip(rows.column("item_id").to_pylist(), text_words(rows.column("text").to_pylist()), strict=True)), percent, least_words)
        out = _search(out, index, text_col)
    return out


def _search(docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    cols = docs.columns
    text_at, leaks_at = cols.index(text_col), cols.index("leaks")

    def run(batches):
        for b in batches:
            buf, offs = K.text_column(b.column(text_at))
            for lo, hi, part, po in K.chunks(buf, offs):
                h, at = bare_words(part, po)
                found = index.search(h, at)
                leaks = b.column(leaks_at).slice(lo, hi - lo)
                if found:
                    leaks = leaks.to_pylist()
                    for d, items in found.items():
                        leaks[d] = leaks[d] + [{"item_id": index.items[i][0], "edits": x[0], "first_word": x[1], "words": x[2]} for i, x in sorted(items.items())]
                    leaks = pa.array(leaks, b.schema.field(leaks_at).type)
                arrays = [leaks if k == leaks_at else c.slice(lo, hi - lo) for k, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Query op3: benchmark items found in all documents; a row for each document and item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.edits", "x.first_word", "x.words")
