"""Remove every byte covered by a long string that occurs more than once.

A byte goes if it lies in a string of `length` bytes that also starts anywhere
else in the corpus, the same document included; strings never cross documents.

1. Anchors. Every string of `length` bytes is represented by the position of the
   smallest hashed k-gram among its first `window` positions, which depends on
   its bytes only. Consecutive starts share an anchor, so there are about 2 /
   window anchors a byte. An anchor stands for the starts lo..hi; its suffix is
   the text from the anchor on, and its guard the part of the suffix that every
   represented string holds.
2. Census. The owner of a guard's hash range answers for each anchor whether its
   guard occurs elsewhere (if not, none of its strings repeats), whether its
   whole context lo..hi+length does (then all of its strings repeat), or
   whether it has to be compared. Guard and context are hashed independently.
3. Merge sort. Suffixes to compare are sorted within their block and sent as
   front-coded runs (length of the prefix shared with the predecessor, and the
   rest). The receiver merges the runs with a loser tree that carries the prefix
   each head shares with the last winner: heads that share different lengths
   are ordered without looking at bytes, and equal ones are compared beyond it.
   The shared prefixes of the merged order delimit the groups with one guard; in
   a group, two strings are equal if the prefixes shared right of the anchor and
   left of it say so, byte by byte.
4. The found starts go back to the blocks, which cut the covered bytes.

Hot passages don't gather in one task: a group's identical contexts are sent once
for a block and only if something in the group is undecided; and a guard in more
than HOT_GROUP different contexts is not merged at all: its strings are counted
one by one, by two independent 64-bit hashes, at the owners of their hash ranges.

Shorter passages: with `passage`, strings of that many bytes are looked for first
and counted as `passage_bytes`, without being removed; only anchors at their starts
are then looked at for `length`.

Defined cases: null or empty text has no bytes; repeated rows are documents of
their own (and repeat one another); null ids are kept; other columns ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import PACKET, Blocks, Census, answers_of, block_text, exchange, join_fields, materialize, one_row_batches, own_range, pack, packet_batch, split_fields, visit

GRAM = 16
WINDOW = 185
#: Contexts of a guard that are merged and compared as bytes; more are counted string by string.
HOT_GROUP = 4096
#: Members times distances that are matched at a time.
MATCHED = 1 << 18
#: Bytes of fifty words of four letters and a blank.
PASSAGE = 250
DEAD, WHOLE, COMPARE, WHOLE_SENT, COUNT, COUNT_SENT = range(6)
#: Parts of a block's own rows: lo and hi of whole contexts, strings to count, counted starts, and starts found by part p at FOUND - p; FIRST apart for the first of two lengths.
WHOLE_PART, COUNT_PART, COUNTED, FOUND, FIRST = -1, -2, -3, -4, 1 << 30


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, window: int, gram: int = GRAM):
    """(anchor, lo, hi, guard hash, context hash) of all strings of `length` bytes within documents."""
    empty = np.zeros(0, np.int64)
    room = np.diff(offs) - length + 1
    if not (room > 0).any():
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    roll = K.Rolling(buf)
    n = len(buf) - gram + 1
    at = np.arange(n)
    v = (roll.spans(at, at + gram) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= window:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    if span < window:
        v = np.minimum(v[: len(v) - (window - span)], v[window - span :])
    open_ = np.zeros(len(buf) + 1, np.int8)
    has = room > 0
    np.add.at(open_, offs[:-1][has], 1)
    np.add.at(open_, offs[:-1][has] + room[has], -1)
    p = np.flatnonzero(np.cumsum(open_[:-1], dtype=np.int8))
    s = (v[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    a, lo = s[first], p[first]
    hi = p[np.concatenate((first[1:], [len(p)])) - 1]
    guard = roll.spans(a, a + (length - window + 1))
    context = K.mix(K.Rolling(buf, 1).spans(lo, hi + length) + (a - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return a, lo, hi, guard, context


def _block_anchors(row: dict, length: int, window: int, answers: dict[int, bytes] | None):
    """Anchors of a block in order of their guards' hashes; places count from the block's start.

    answers: of the first length, if there was one: anchors without any start found then are left out.
    """
    buf, offs = block_text(row)
    found = [[], [], [], [], []]
    for a, _, part, po in K.chunks(buf, offs):
        for k, x in enumerate(anchors(part, po, length, window, min(GRAM, length - window + 1))):
            found[k].append(x + offs[a] if k < 3 else x)
    found = [np.concatenate(x) if x else np.zeros(0, np.int64 if k < 3 else np.uint64) for k, x in enumerate(found)]
    if answers is not None:
        before = _counts(repeated_starts(answers, len(buf), FIRST))
        some = before[found[2] + 1] > before[found[1]]
        found = [x[some] for x in found]
    order = np.argsort(found[3], kind="stable")
    return buf, offs, [x[order] for x in found]


def repeated_starts(answers: dict[int, bytes], n: int, shift: int = 0) -> np.ndarray:
    """Which of n places start a repeated string, from the rows of one length."""
    edge = np.zeros(n + 1, np.int32)
    for p, blob in answers.items():
        if p + shift >= 0 or p + shift < -FIRST:
            continue
        if p + shift == WHOLE_PART:
            lo, hi = np.frombuffer(blob, np.int64).reshape(2, -1)
        else:
            lo = hi = np.frombuffer(blob, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _counts(flags: np.ndarray) -> np.ndarray:
    """Flags set before each place; a block is smaller than 2 GB."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Places within `length` bytes of a start at or before them."""
    before = _counts(starts)
    out = before[1:] > 0
    out[length:] = before[length + 1 :] > before[1 : len(before) - length]
    return out


class GuardCensus(Census):
    """What to do with the anchors of each (guard, context); one sender stands for a context that is looked at for others' sake."""

    pairs = True
    first_only = {WHOLE_SENT: WHOLE, COUNT_SENT: WHOLE}

    def __init__(self, most: int):
        self.most = most

    def answer(self, section, keys, seconds, sums):
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group, sums[0]) > 1
        hot = np.bincount(group)[group] > self.most
        single = many[group] & (sums[0] == 1)
        undecided = np.bincount(group, single)[group] > 0
        return [np.select([~many[group], single & hot, single, undecided & hot, undecided], [DEAD, COUNT, COMPARE, COUNT_SENT, WHOLE_SENT], WHOLE)]


class StringCensus(Census):
    """Whether a string occurs more than once."""

    pairs = True

    def answer(self, section, keys, seconds, sums):
        return [sums[0] > 1]


STRINGS = StringCensus()


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be `start` at least."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared lengths, full lengths, rests) of a sorted run."""
    lcp = [0, *(shared_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))][: len(suffixes)]
    return np.array(lcp, np.uint16), np.array([len(s) for s in suffixes], np.uint16), b"".join(s[k:] for s, k in zip(suffixes, lcp, strict=True))


def decoded(lcp: np.ndarray, size: np.ndarray, rest: bytes):
    """Yield (suffix, shared length) of a front-coded run."""
    at, last = 0, b""
    for k, n in zip(lcp.tolist(), size.tolist(), strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last, k


def merge_runs(runs: list):
    """Loser-tree merge of runs of (suffix, length shared with the predecessor in the run, payload).

    Yields (suffix, length shared with the previously yielded suffix, payload).
    Every waiting head knows what it shares with the last winner, so only bytes
    beyond a known equal prefix are ever compared.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    its = [iter(r) for r in runs]
    heads: list = [next(it, None) for it in its] + [None] * (size - len(runs))
    shared = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        k = shared_prefix(x[0], y[0], shared[i])
        if (x[0][k : k + 1], i) <= (y[0][k : k + 1], j):
            shared[j] = k
            return i, j
        shared[i] = k
        return j, i

    losers = [0] * size
    winners = [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        suffix, _, payload = heads[top]
        yield suffix, shared[top], payload
        heads[top] = nxt = next(its[top], None)
        shared[top] = nxt[1] if nxt else 0
        node, w = (size + top) // 2, top
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
        top = w


def match_group(members: list[tuple[bytes, int, int]], rights: list[int], length: int) -> list[np.ndarray]:
    """For members (left, least a, most a) of one guard, in order of their suffixes: which distances a start a repeated string.

    The string at distance a is the last a bytes of `left` and the first
    length - a of the suffix. rights: prefix shared with the suffix before. Places
    where neighbours share less than the bytes in question delimit equal ones, in
    the order of the suffixes and in that of the lefts read backwards.
    """
    m = len(members)
    if m == 2:
        (l0, s0, e0), (l1, s1, e1) = members
        got = np.arange(max(s0, s1, length - rights[1]), min(e0, e1, shared_prefix(l0[::-1], l1[::-1])) + 1)
        return [got, got]
    least, most = np.array([x[1] for x in members]), np.array([x[2] for x in members])
    back = [x[0][::-1] for x in members]
    order = sorted(range(m), key=back.__getitem__)
    lefts = np.array([0, *(shared_prefix(back[i], back[j]) for i, j in zip(order, order[1:], strict=False))])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    right = np.array(rights)
    who, which = [], []
    step = max(1, MATCHED // m)
    for first in range(int(least.min()), int(most.max()) + 1, step):
        a = np.arange(first, min(first + step, int(most.max()) + 1))[:, None]
        key = np.cumsum(right < length - a, axis=1) * (m + 1) + np.cumsum(lefts < a, axis=1)[:, place]
        out = (least > a) | (a > most)
        key[out] = -1 - np.nonzero(out)[1]  # equal to none
        by = np.argsort(key, axis=1)
        key = np.take_along_axis(key, by, 1)
        same = key[:, 1:] == key[:, :-1]
        again = np.zeros(key.shape, bool)
        again[:, 1:] |= same
        again[:, :-1] |= same
        row, k = np.nonzero(again)
        who.append(by[row, k])
        which.append(a[row, 0])
    who, which = np.concatenate(who), np.concatenate(which)
    by = np.argsort(who, kind="stable")
    return np.split(which[by], np.searchsorted(who[by], np.arange(1, m)))


def _merge(length: int, window: int):
    guard = length - window + 1

    def run(part: int, senders: list[int], blobs: list[bytes]):
        found: dict[int, list[np.ndarray]] = {s: [] for s in senders}

        def entries(sender: int, blob: bytes):
            lcp, size, rest, left_size, lefts, place, back, need = split_fields(blob, 8)
            at = 0
            meta = zip(np.frombuffer(left_size, np.uint16).tolist(), np.frombuffer(place, np.int64).tolist(), np.frombuffer(back, np.uint16).tolist(), np.frombuffer(need, np.uint8).tolist(), strict=True)
            for (suffix, k), (n, where, low, undecided) in zip(decoded(np.frombuffer(lcp, np.uint16), np.frombuffer(size, np.uint16), rest), meta, strict=True):
                yield suffix, k, (sender, lefts[at : at + n], where, low, undecided)
                at += n

        def settle(group: list, rights: list[int]):
            if len(group) < 2:
                return
            members = [(left, low, len(left)) for _, (_, left, _, low, _) in group]
            for (_, (sender, _, where, _, undecided)), a in zip(group, match_group(members, rights, length), strict=True):
                if undecided and len(a):
                    found[sender].append(where - a)

        group, rights = [], []
        for suffix, k, payload in merge_runs([entries(s, b) for s, b in zip(senders, blobs, strict=True)]):
            if k < guard and group:
                settle(group, rights)
                group, rights = [], []
            group.append((suffix, payload))
            rights.append(k)
        settle(group, rights)
        for s, starts in found.items():
            if starts:
                yield s, np.sort(np.concatenate(starts)).tobytes()

    return run


def find_repeats(blocks: Blocks, length: int, name: str, first: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Rows (part, block, data) that tell repeated_starts() of each block; first: those of a lesser length, with parts shifted by FIRST.

    The rows are written to the shared folder unless they are read `once` only.
    """
    window = min(WINDOW, length // 2)
    where, parts, guards, again = blocks.where, blocks.parts, GuardCensus(HOT_GROUP), first is not None
    columns = ("block", "offs", "data", "answers")

    def ask(batches):
        for row in one_row_batches(batches):
            _, _, (_, _, _, guard, context) = _block_anchors(row, length, window, answers_of(row) if again else None)
            yield guards.packets(row["block"].as_py(), [(guard, context, [np.ones(len(guard), np.int64)])], parts)

    asked = visit(blocks, first, keep_all=not again).select(*columns).mapInArrow(ask, PACKET)
    codes = exchange(asked, guards, blocks, f"census_{name}", once=True)

    def send(batches):
        for row in one_row_batches(batches):
            got = answers_of(row)
            buf, offs, (at, lo, hi, guard, _) = _block_anchors(row, length, window, got if again else None)
            cut = K.cut_by_part(guard, parts)
            code = np.concatenate([guards.read(got[p], [int(cut[p + 1] - cut[p])])[0][0] for p in range(parts) if cut[p + 1] > cut[p]] or [np.zeros(0, np.int64)])
            whole = (code == WHOLE) | (code == WHOLE_SENT) | (code == COUNT_SENT)
            names, blobs = [WHOLE_PART], [np.stack([lo[whole], hi[whole]]).tobytes()]
            if (code >= COUNT).any():
                names.append(COUNT_PART)
                blobs.append(_strings(buf, offs, lo[code >= COUNT], hi[code >= COUNT], code[code >= COUNT] == COUNT, length))
            raw = buf.tobytes()
            for p in range(parts):
                mine = code[cut[p] : cut[p + 1]]
                k = np.flatnonzero((mine == COMPARE) | (mine == WHOLE_SENT)) + cut[p]
                if not len(k):
                    continue
                run = sorted((raw[at[i] : hi[i] + length], int(i)) for i in k)
                i = np.array([x[1] for x in run])
                lcp, size, rest = front_coded([x[0] for x in run])
                lefts = [raw[lo[j] : at[j]] for j in i]
                names.append(p)
                blobs.append(join_fields(lcp.tobytes(), size.tobytes(), rest, np.array([len(x) for x in lefts], np.uint16).tobytes(), b"".join(lefts), at[i].tobytes(), (at[i] - hi[i]).astype(np.uint16).tobytes(), (code[i] == COMPARE).astype(np.uint8).tobytes()))
            yield packet_batch(row["block"].as_py(), names, blobs)

    with_codes = visit(blocks, codes.unionByName(first) if again else codes, keep_all=False)
    if again:  # blocks without anchors got no codes
        with_codes = with_codes.where(F.exists("answers", lambda x: x["part"] >= 0))
    sent = materialize(with_codes.select(*columns).mapInArrow(send, PACKET), f"runs_{name}", where)
    found = own_range(sent.where("part >= 0"), _merge(length, window))
    found = found if once else materialize(found, f"found_{name}", where)
    out = sent.where(f"part = {WHOLE_PART}").unionByName(found.withColumn("part", (F.lit(FOUND) - F.col("part")).cast("int")))
    hot = sent.where(f"part = {COUNT_PART}")
    return out.unionByName(_counted(hot, blocks, name, once)) if hot.limit(1).count() else out


def _strings(buf: np.ndarray, offs: np.ndarray, lo: np.ndarray, hi: np.ndarray, asks: np.ndarray, length: int) -> bytes:
    """Sorted hashes of the strings that start at lo..hi, second hashes, starts, and whether an answer is needed."""
    found = [[], [], [], []]
    for a, b, part, _ in K.chunks(buf, offs):
        mine = np.flatnonzero((lo >= offs[a]) & (lo < offs[b]))
        if len(mine):
            n = hi[mine] - lo[mine] + 1
            start = np.repeat(lo[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = start - offs[a]
            for x, y in zip(found, (K.Rolling(part).spans(at, at + length), K.Rolling(part, 1).spans(at, at + length), start, np.repeat(asks[mine], n)), strict=True):
                x.append(y)
    one, two, start, asked = map(np.concatenate, found)
    order = np.argsort(one, kind="stable")
    return join_fields(*(x[order].tobytes() for x in (one, two, start, asked)))


def _counted(hot: DataFrame, blocks: Blocks, name: str, once: bool) -> DataFrame:
    """Starts whose string occurs elsewhere, by a count of every string at the owner of its hash range."""
    parts = blocks.parts

    def read(row: dict):
        one, two, start, asks = split_fields(row["data"].as_buffer(), 4)
        return np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), np.frombuffer(start, np.int64), np.frombuffer(asks, bool)

    def ask(batches):
        for row in one_row_batches(batches):
            one, two, _, _ = read(row)
            yield STRINGS.packets(row["block"].as_py(), [(one, two, [np.ones(len(one), np.int64)])], parts)

    answers = exchange(hot.mapInArrow(ask, PACKET), STRINGS, blocks, f"strings_{name}")
    got = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers"))

    def starts(batches):
        for row in one_row_batches(batches):
            one, _, start, asks = read(row)
            cut, found = K.cut_by_part(one, parts), answers_of(row)
            again = np.concatenate([STRINGS.read(found[p], [int(cut[p + 1] - cut[p])])[0][0] for p in range(parts) if cut[p + 1] > cut[p]])
            yield packet_batch(row["block"].as_py(), [COUNTED], [start[(again > 0) & asks].tobytes()])

    out = hot.select("block", "data").join(got, "block").mapInArrow(starts, PACKET)
    return out if once else materialize(out, f"counted_{name}", blocks.where)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, removed (start and end byte offsets of the maximal runs, one after another), kept (binary) and passage_bytes.

    passage_bytes: bytes covered by repeated strings of `passage` bytes, less than `length`; null without `passage`.
    """
    blocks = pack(docs, id_col, text_col)
    shorter = None
    if passage is not None:
        if passage >= length:
            raise ValueError("passages are shorter than what is removed")
        shorter = find_repeats(blocks, passage, "passages").withColumn("part", (F.col("part") - FIRST).cast("int"))
    rows = find_repeats(blocks, length, "repeats", shorter, once=True)

    def cut(batches):
        for row in one_row_batches(batches):
            buf, offs = block_text(row)
            ids = pa.array(row["ids"].values)
            n, got = len(buf), answers_of(row)
            gone = covered(repeated_starts(got, n), length)
            before = _counts(gone)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[offs[:-1][offs[:-1] < n]] = gone[offs[:-1][offs[:-1] < n]]
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            ends = offs[1:][offs[1:] > 0] - 1
            last[ends] = gone[ends]
            starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
            doc = np.searchsorted(offs, starts, "right") - 1
            spans = np.stack([starts - offs[doc], stops - offs[doc]], 1).ravel() if len(starts) else np.zeros(0, np.int64)
            off = np.searchsorted(starts, offs) if len(starts) else np.zeros(len(offs), np.int64)
            kept_at = offs - before[offs]
            kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(kept_at, np.int64)), pa.py_buffer(buf[~gone].tobytes())])
            part = pa.nulls(len(ids), pa.int64())
            if passage is not None:
                within = _counts(covered(repeated_starts(got, n, FIRST), passage))
                part = pa.array(np.diff(within[offs]).astype(np.int64))
            removed = pa.ListArray.from_arrays(pa.array((2 * off).astype(np.int32)), pa.array(spans))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array(np.diff(offs)), "removed": removed, "kept": kept.cast(pa.binary()), "passage_bytes": part})

    both = rows if shorter is None else rows.unionByName(shorter)
    return visit(blocks, both, keep_all=True).select("block", "ids", "offs", "data", "answers").mapInArrow(cut, "doc_id long, n_bytes long, removed array<long>, kept binary, passage_bytes long")


def op4(spark, sf_dir: str) -> DataFrame:
    """Query op4: 400-byte repeats of all documents; n_passage_bytes counts bytes of repeated passages from PASSAGE bytes on."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passage_bytes").alias("n_passage_bytes"))
