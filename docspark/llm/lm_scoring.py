"""Deleted-interpolation language model: train on a corpus, score every text.

p(w | h) mixes three maximum-likelihood estimates: uniform, unigram and bigram; after
a context that was never seen, the first two.
The mixture weights depend on how often the context h was seen (a bucket per
power of two) and are learned by expectation-maximisation on counts of a part of
the training documents that the estimates being mixed have not seen (the deleted
part). The final counts cover all training documents.

Distribution: a block of documents sends each distinct n-gram once, with its
counts in the block, to the owner of its hash range and gets the corpus counts
back in the same order. A frequent word or word pair is thus one entry a block,
whoever owns it. EM reads a histogram over (bucket, ratios of the estimates) of
bounded size, filled from every deleted token: at most BUCKETS times RATIO_BINS
squared cells, of ratios that agree to an eighth of a power of two, each with its
tokens and their mean ratios. Scores use the exact estimates.

Defined cases: null or empty text is one end token; null doc_id is kept; rows
that repeat are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import PACKET, Blocks, Census, answers_of, block_text, exchange, one_row_batches, pack, visit

END = np.uint64(0x51ED270B9F3C1A77)
BEGIN = np.uint64(0xA24BAED4963EE407)
#: Roles of a document: estimates, deleted part, not in training.
ESTIMATE, DELETED, SCORED = 0, 1, 2
BUCKETS = 40
#: Steps of log2 of an estimate's ratio to uniform, for the histogram of EM.
STEP, RATIO_BINS = 0.125, 512
EM_ROUNDS = 60


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end token after each document, context hashes, token offsets)."""
    buf = K.LOWER[buf]
    starts, ends, at = K.word_spans(buf, offs)
    n = len(offs) - 1
    h = np.empty(len(starts) + n, np.uint64)
    off = at + np.arange(n + 1)
    last = off[1:] - 1
    inside = np.ones(len(h), bool)
    inside[last] = False
    h[inside] = K.Rolling(buf).spans(starts, ends)
    h[last] = END
    ctx = np.empty_like(h)
    ctx[1:] = h[:-1]
    ctx[off[:-1]] = BEGIN
    return h, ctx, off


def _pair(ctx: np.ndarray, h: np.ndarray) -> np.ndarray:
    return K.mix(ctx * np.uint64(0xC2B2AE3D27D4EB4F) + h)


def _block_grams(buf: np.ndarray, offs: np.ndarray, tags: np.ndarray) -> tuple[list, int]:
    """Sorted distinct (hash, estimate count, training count) of unigrams and of bigrams; training tokens."""
    uni, bi, role = [], [], []
    for a, b, part, po in K.chunks(buf, offs):
        h, ctx, off = _tokens(part, po)
        r = np.repeat(tags[a:b], np.diff(off)).astype(np.int8)
        uni.append(h)
        bi.append(_pair(ctx, h))
        role.append(r)
    role = np.concatenate(role) if role else np.zeros(0, np.int8)
    docs = [np.count_nonzero(tags == ESTIMATE), np.count_nonzero(tags != SCORED)]
    out = []
    for k, lists in enumerate((uni, bi)):
        h = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        order = np.argsort(h)
        s, r = h[order], role[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        est = np.add.reduceat((r == ESTIMATE).astype(np.int64), first) if len(s) else first
        trn = np.add.reduceat((r != SCORED).astype(np.int64), first) if len(s) else first
        s = s[first]
        if k == 0:
            at = int(np.searchsorted(s, BEGIN))
            s, est, trn = np.insert(s, at, BEGIN), np.insert(est, at, docs[0]), np.insert(trn, at, docs[1])
        out.append((s, est, trn))
    return out, int(np.count_nonzero(role != SCORED))


class GramCensus(Census):
    """Counts in the estimates' part and in all training documents, of unigrams and of bigrams."""

    sections = values = arrays = 2

    def answer(self, section, keys, seconds, sums):
        return sums

    def extra(self, section, keys, sums):
        """Tokens and distinct words of either part of the training documents."""
        if section:
            return None
        words = keys != BEGIN
        return np.array([x for t in sums for x in (t[words].sum(), np.count_nonzero(t[words]))], np.int64).tobytes()


GRAMS = GramCensus()


def _requests(blocks: Blocks) -> DataFrame:
    parts = blocks.parts

    def run(batches):
        for row in one_row_batches(batches):
            buf, offs = block_text(row)
            tables, _ = _block_grams(buf, offs, np.array(row["tags"].as_py(), np.int64))
            yield GRAMS.packets(row["block"].as_py(), [(h, None, [est, trn]) for h, est, trn in tables], parts)

    return blocks.df.select("block", "tags", "offs", "data").mapInArrow(run, PACKET)


def _looked_up(row: dict, parts: int, which: int):
    """Yield (first, last, token offsets, counts of word, context and pair) by chunk; which: 0 estimates, 1 training."""
    buf, offs = block_text(row)
    tables, _ = _block_grams(buf, offs, np.array(row["tags"].as_py(), np.int64))
    got = answers_of(row)
    counts = [[], []]
    cuts = [K.cut_by_part(t[0], parts) for t in tables]
    for p in range(parts):
        sizes = [int(c[p + 1] - c[p]) for c in cuts]
        if any(sizes):
            for k, answer in enumerate(GRAMS.read(got[p], sizes, GRAMS.arrays)):
                counts[k].append(answer[which])
    counts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in counts]
    for a, b, part, po in K.chunks(buf, offs):
        h, ctx, off = _tokens(part, po)
        cw = counts[0][np.searchsorted(tables[0][0], h)]
        cc = np.empty_like(cw)
        cc[1:] = cw[:-1]
        cc[off[:-1]] = counts[0][np.searchsorted(tables[0][0], BEGIN)]
        yield a, b, off, cw, cc, counts[1][np.searchsorted(tables[1][0], _pair(ctx, h))]


def _bucket(context_counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context_counts + 1.0)).astype(np.int64), BUCKETS - 1)


def _estimates(cw, cc, cp, n: int, v: int):
    """Uniform, unigram and bigram estimates; an unseen context has bigram 0."""
    return 1.0 / (v + 1), cw / max(n, 1), cp / np.maximum(cc, 1)


def _bins(p: np.ndarray, p0: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.round(np.log2(p / p0) / STEP) + 1 + RATIO_BINS // 4
    return np.where(p > 0, np.clip(x, 1, RATIO_BINS - 1), 0).astype(np.int64)


def learn_weights(buckets: np.ndarray, tokens: np.ndarray, ratios: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """EM on held-out cells (bucket, tokens, mean ratios of the unigram and the bigram estimate to the uniform one): weights (BUCKETS, 3) of uniform, unigram, bigram.

    A bucket starts from, and if it has few tokens stays near, the weights of
    all buckets together (ten pseudo-tokens). Contexts of bucket 0 are unseen and have
    no bigram estimate: its weight goes to the others.
    """
    b = buckets
    p = np.concatenate((np.ones((len(b), 1)), ratios), axis=1)
    pooled = np.array([0.1, 0.6, 0.3])
    for _ in range(rounds):
        q = p * pooled
        q *= (tokens / np.maximum(q.sum(1), 1e-300))[:, None]
        total = q.sum(0) + 1e-3
        pooled = total / total.sum()
    prior = np.tile(pooled, (BUCKETS, 1))
    prior[0, 2] = 0
    prior[0] /= prior[0].sum()
    out = prior
    for _ in range(rounds):
        q = p * out[b]
        q *= (tokens / np.maximum(q.sum(1), 1e-300))[:, None]
        total = np.zeros((BUCKETS, 3))
        np.add.at(total, b, q)
        total += 10 * prior
        out = total / total.sum(1, keepdims=True)
    return out


def score(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model trained on the documents that are not `held_out`.

    `deleted` marks the training documents on which the weights are learned.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score, both log10 probabilities.
    """
    spark = docs.sparkSession
    role = F.when(held_out, SCORED).when(deleted, DELETED).otherwise(ESTIMATE)
    blocks = pack(docs, id_col, text_col, role, apart=DELETED)
    parts = blocks.parts
    replies = exchange(_requests(blocks), GRAMS, blocks, "counts")

    def sizes(batches):
        for b in batches:
            x = np.array([np.frombuffer(v.as_buffer(), np.int64) for v in b.column(0)]).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict(dict(zip("abcd", x.T.copy(), strict=True)))

    found = replies.where("block = -1").select("data").mapInArrow(sizes, "a long, b long, c long, d long").agg(*(F.sum(c) for c in "abcd")).first()
    n_est, v_est, n_all, v_all = (int(x or 0) for x in found)

    def histogram(batches):
        for row in one_row_batches(batches):
            tags = np.array(row["tags"].as_py(), np.int64)
            if not (tags == DELETED).any():
                continue
            found = []
            for a, b, off, cw, cc, cp in _looked_up(row, parts, 0):
                use = np.repeat(tags[a:b] == DELETED, np.diff(off))
                p0, p1, p2 = _estimates(cw[use], cc[use], cp[use], n_est, v_est)
                found.append(((_bucket(cc[use]) * RATIO_BINS + _bins(p1, p0)) * RATIO_BINS + _bins(p2, p0), p1 / p0, p2 / p0))
            cell, one, two = map(np.concatenate, zip(*found, strict=True))
            cell, at = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"cell": cell, "n": np.bincount(at).astype(float), "one": np.bincount(at, one), "two": np.bincount(at, two)})

    columns = ("block", "ids", "tags", "offs", "data", "answers")
    some = Blocks(blocks.df.where(F.array_contains("tags", DELETED)), blocks.where, 0, 0, parts)
    held = visit(some, replies).select(*columns).mapInArrow(histogram, "cell long, n double, one double, two double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "one", "two"))).orderBy("cell").toArrow()
    tokens = held.column("n").to_numpy()
    ratios = np.stack([held.column(c).to_numpy() / np.maximum(tokens, 1) for c in ("one", "two")], 1)
    weights = learn_weights(held.column("cell").to_numpy() // RATIO_BINS**2, tokens, ratios)
    log10 = 1 / math.log(10)

    def scores(batches):
        for row in one_row_batches(batches):
            ids, tags = pa.array(row["ids"].values), np.array(row["tags"].as_py(), np.int64)
            for a, b, off, cw, cc, cp in _looked_up(row, parts, 1):
                w = weights[_bucket(cc)]
                p0, p1, p2 = _estimates(cw, cc, cp, n_all, v_all)
                model = np.log(w[:, 0] * p0 + w[:, 1] * p1 + w[:, 2] * p2) * log10
                base = np.log((cw + 1.0) / (n_all + v_all + 1.0)) * log10
                first = off[:-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "held_out": pa.array(tags[a:b] == SCORED),
                        "n_tokens": pa.array(np.diff(off)),
                        "n_known": pa.array(np.add.reduceat((cw > 0).astype(np.int64), first)),
                        "train_tokens": pa.array(np.full(b - a, n_all)),
                        "base_score": pa.array(np.add.reduceat(base, first)),
                        "score": pa.array(np.add.reduceat(model, first)),
                    }
                )

    return visit(blocks, replies).select(*columns).mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    """Query op1: crc32(doc_id) mod 7 = 2 is held out; an eighth of the rest learns the weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string"))
    return score(docs, F.coalesce(crc % 7 == 2, F.lit(False)), F.coalesce(F.floor(crc / 7) % 8 == 0, F.lit(False)))
