"""Benchmark decontamination by the CGK embedding and bit-sampling LSH, with exact edit-distance verification.

A CGK random walk starts at every byte of documents and items: at each step the walk's character is put out and a random
bit of that character decides whether to go on, so near texts soon walk in step and edit distance becomes Hamming
distance. Each repeat has its own walk and samples SAMPLED of its STEPS outputs as a key, so a walk reads some STEPS / 2
bytes: shorter than an item, because within a whole item at LIMIT hardly any walk stays in step. Equal keys are hits. Where
hits of one item add up to SHARE of its length in a window of the item's size, the place is a candidate. A candidate is first
bounded from below: an item's pieces of up to 64 bytes each lie near their place, and the sum of their least edit
distances there is at most that of the item. What remains is verified by the edit distance of the whole item. Of a pool of walks those come first that hit edited copies often and other items rarely; the number of
repeats is set by simulation on every item, so that LIMIT of an item's length in edits, random or evenly spaced, is
found with the target recall.

Items below LONG bytes, and all items of a block whose simulated recall stays below the target, are found without
loss: of k + 1 pieces of an item at most k are edited, so one stands in the place as it is; any such hit is a candidate.

Texts are compared with A-Z lowered and white space runs as one blank. A place matches if its edit distance is at most
LIMIT of the item's length.

Defined cases: null and empty texts and items match nothing; repeated rows give repeated rows; items with equal texts each
match; an empty table on either side gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import LOWER, SPACE, documents, mix, steps, table, text_bytes

LIMIT, RECALL = 0.2, 0.98
#: A walk's decisions and its byte share 32 bits, so STEPS is at most 24.
STEPS, SAMPLED, POOL, MOST_REPEATS, SEED = 24, 11, 32, 12, 5
#: Hits of a candidate as a share of its item's bytes, at least LEAST_HITS; items of fewer than LONG bytes take pieces.
SHARE, LEAST_HITS, LONG = 0.01, 2, 64
#: Pairs of equal keys and candidates that are held at once, and items that walks are ranked on.
PAIRS_AT_ONCE, BOUNDED_AT_ONCE, RANKED_ON = 1 << 22, 1 << 12, 1000
#: Classes of bytes that the lower bound tells apart; bytes of one class count as equal, so the bound holds.
CLASSES = 32
#: Bytes of benchmark text that is sent to all executors at a time; a larger benchmark is taken in blocks.
BLOCK_BYTES = 4 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z lowered, white space runs as one blank and none at the ends; new offsets; each byte's old place."""
    blank = SPACE[data]
    keep = ~blank
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    # a blank stays if a solid byte of the same text stands right before it and some solid byte of it comes after
    last = np.full(len(offsets) - 1, -1, np.int64)
    at = np.flatnonzero(~blank)
    owner = np.searchsorted(offsets, at, "right") - 1
    last[owner] = at
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = np.zeros(len(data), bool)
    inner[1:] = blank[1:] & ~blank[:-1] & ~edge[1:-1]
    keep |= inner & (np.arange(len(data)) < last[doc])
    place = np.flatnonzero(keep)
    out = np.where(blank[place], np.uint8(32), LOWER[data[place]])
    return out, np.searchsorted(place, offsets), place


@dataclass
class Repeat:
    walk: np.ndarray  # (256,) for each byte, whether the walk goes on at each step, above the byte itself
    sample: np.ndarray  # (steps,) whether sampled
    keys: np.ndarray  # of the items, ascending
    items: np.ndarray  # item and
    places: np.ndarray  # offset in it of each key
    table: np.ndarray  # whether a key has these leading bits; it rules most keys out
    shift: np.uint64  # to the leading bits


@dataclass
class Seeds:
    """Repeats whose hits are counted together."""

    repeats: list[Repeat]
    need: np.ndarray  # hits of a candidate, by item


@dataclass
class Parts:
    """Pieces of up to 64 bytes of each item, as bit masks by class of byte; bits before a piece match everything."""

    first: np.ndarray  # first piece of each item, and the end
    start: np.ndarray  # in the item
    size: np.ndarray
    masks: np.ndarray  # (pieces * (CLASSES + 1),), the last class outside of the text


@dataclass
class Index:
    ids: list[list]  # by text
    texts: list[bytes]
    lengths: np.ndarray
    seeds: list[Seeds]
    parts: Parts


def spread(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with n zeros after each, so that no walk of n steps sees another text; each byte's new place and text."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + doc * n
    out = np.zeros(len(data) + (len(offsets) - 1) * n, np.uint8)
    out[at] = data
    return out, at, doc


def packed(bits: np.ndarray) -> np.ndarray:
    """A walk's decisions (steps, 256) as one number for each byte."""
    out = np.arange(256, dtype=np.uint32)
    for t, go in enumerate(bits):
        out |= go.astype(np.uint32) << np.uint32(8 + t)
    return out


def keys_of(data: np.ndarray, starts: np.ndarray, walk: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The key of one walk from each start; starts are taken in blocks that fit the cache."""
    out = np.empty(len(starts), np.uint64)
    size = 1 << 14
    steps_ = walk[data]
    v, go = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(0, len(starts), size):
        at = starts[i : i + size].copy()
        n = len(at)
        a, b, key = v[:n], go[:n], np.zeros(n, np.uint64)
        for t in range(int(np.flatnonzero(sample).max()) + 1):
            steps_.take(at, out=a, mode="clip")
            if sample[t]:
                key *= MULTIPLIER
                np.bitwise_and(a, np.uint32(255), out=b)
                key += b
            np.right_shift(a, np.uint32(8 + t), out=a)
            a &= np.uint32(1)
            at += a
        out[i : i + n] = mix(key)
    return out


def walks_of(repeats: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    walks = rng.integers(0, 2, (repeats, STEPS, 256), dtype=np.uint8)
    walks[:, :, 0] = 0
    return walks, np.stack([np.isin(np.arange(STEPS), rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(repeats)])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def allowed(lengths: np.ndarray) -> np.ndarray:
    return (LIMIT * lengths).astype(np.int64)


def repeat_of(data: np.ndarray, starts: np.ndarray, item: np.ndarray, place: np.ndarray, walk: np.ndarray, sample: np.ndarray) -> Repeat:
    keys = keys_of(data, starts, walk, sample)
    order = np.argsort(keys, kind="stable")
    leading = max(20, len(keys).bit_length() + 3)
    known, shift = np.zeros(1 << leading, bool), np.uint64(64 - leading)
    known[keys >> shift] = True
    return Repeat(walk, sample, keys[order], item[order].astype(np.int32), place[order].astype(np.int32), known, shift)


def pieces(texts: list[bytes], which: np.ndarray) -> list[Seeds]:
    """Seeds that find the given items without loss, by length of piece: walks that always go on and sample each step."""
    data, offsets = joined(texts)
    lengths = np.diff(offsets)
    count = allowed(lengths) + 1
    size = np.minimum(lengths // count, STEPS)
    out = []
    for q in np.unique(size[which]):
        some = which[size[which] == q]
        item = np.repeat(some, count[some])
        place = (np.arange(len(item)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])) * q
        go = packed(np.ones((q, 256), np.uint8))
        wide, at, _ = spread(data, offsets, int(q))
        out.append(Seeds([repeat_of(wide, at[offsets[item] + place], item, place, go, np.ones(q, bool))], np.ones(len(texts), np.int64)))
    return out


def walked(texts: list[bytes], which: np.ndarray, walk: np.ndarray, sample: np.ndarray) -> Repeat:
    """A walk from every byte of the given items that has half a walk of bytes after it."""
    data, offsets = joined(texts)
    wide, at, item = spread(data, offsets, STEPS)
    chosen = np.isin(item, which) & (offsets[1:][item] - np.arange(len(data)) >= STEPS // 2)
    return repeat_of(wide, at[chosen], item[chosen], (np.arange(len(data)) - offsets[item])[chosen], walk, sample)


def ranked(texts: list[bytes], which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pool's walks and samples, those first with many places of edited copies in their item for few pairs by chance."""
    some = [texts[i] for i in which[:: max(1, len(which) // RANKED_ON)]]
    rng = np.random.default_rng(SEED + 1)
    data, offsets = joined([spaced(t, int(LIMIT * len(t)), rng) for t in some])
    wide, starts, doc = spread(data, offsets, STEPS)
    rank = []
    for bits, sample in zip(*walks_of(POOL), strict=True):
        walk = packed(bits)
        r = walked(some, np.arange(len(some)), walk, sample)
        same = np.unique(r.keys, return_counts=True)[1]
        chance = int((same * same).sum()) - len(r.keys)
        # a key and its item as one number, so that a place counts if its own item has its key
        own = np.isin(mix(keys_of(wide, starts, walk, sample) + doc.astype(np.uint64)), mix(r.keys + r.items.astype(np.uint64))).sum()
        rank.append((-own / (chance + len(r.keys) / 16), len(rank), walk, sample))
    return [x[2:] for x in sorted(rank, key=lambda x: x[:2])]


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    out = bytearray(text)
    for _ in range(edits):
        i, kind, c = int(rng.integers(len(out))) if out else 0, rng.integers(3), int(rng.integers(97, 123))
        if kind == 0 and out:
            out[i] = c
        elif kind == 1 and out:
            del out[i]
        else:
            out.insert(i, c)
    return bytes(out)


def spaced(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """The text with that many bytes changed at even distances."""
    out = bytearray(text)
    for i in (np.arange(edits) * len(out) / max(1, edits) + rng.random() * len(out) / max(1, edits)).astype(int):
        out[i] = 97 + (out[i] - 97 + int(rng.integers(1, 26))) % 26
    return bytes(out)


def recall(texts: list[bytes], which: np.ndarray, seeds: list[Seeds], rate: float, even: bool) -> float:
    """Share of the given items that are candidates in copies with that rate of edits."""
    rng = np.random.default_rng(SEED)
    data, offsets = joined([(spaced if even else edited)(texts[i], int(rate * len(texts[i])), rng) for i in which])
    lengths = np.array([len(t) for t in texts])
    found = np.zeros(len(which), bool)
    for i, j in steps(offsets):
        o = offsets[i : j + 1]
        for s in seeds:
            doc, item, _, _ = candidates(s, lengths, data[o[0] : o[-1]], o - o[0])
            found[i + doc[which[i + doc] == item]] = True
    return float(found.mean())


def seeds_of(texts: list[bytes]) -> list[Seeds]:
    """Pieces for short items; for the others the fewest repeats that reach RECALL at LIMIT, or pieces where none do."""
    lengths = np.array([len(t) for t in texts], np.int64)
    short, long = np.flatnonzero((lengths > 0) & (lengths < LONG)), np.flatnonzero(lengths >= LONG)
    if len(long):
        need = np.maximum(LEAST_HITS, np.ceil(SHARE * lengths).astype(np.int64))
        repeats = []
        for walk, sample in ranked(texts, long)[:MOST_REPEATS]:
            repeats.append(walked(texts, long, walk, sample))
            seeds = Seeds(repeats, need)
            if min(recall(texts, long, [seeds], LIMIT, even) for even in (False, True)) >= RECALL:
                return [seeds, *pieces(texts, short)]
        logging.getLogger(__name__).warning("%d repeats don't reach a recall of %s at %s edits a byte: items are found by pieces", MOST_REPEATS, RECALL, LIMIT)
    return pieces(texts, np.flatnonzero(lengths > 0))


def parts_of(texts: list[bytes]) -> Parts:
    lengths = np.array([len(t) for t in texts], np.int64)
    count = -(-lengths // 64)
    first = np.concatenate([[0], np.cumsum(count)])
    masks = np.zeros((int(first[-1]), CLASSES + 1), np.uint64)
    start, size = np.zeros(len(masks), np.int64), np.zeros(len(masks), np.int64)
    for t, a, n in zip(texts, first, count, strict=False):
        cuts = np.linspace(0, len(t), n + 1).astype(np.int64)
        for i in range(n):
            start[a + i], size[a + i] = cuts[i], cuts[i + 1] - cuts[i]
            piece = np.frombuffer(t, np.uint8)[cuts[i] : cuts[i + 1]] % CLASSES
            if len(piece) < 64:
                masks[a + i] = np.uint64((1 << (64 - len(piece))) - 1)
            for j, c in enumerate(piece):
                masks[a + i, c] |= np.uint64(1) << np.uint64(64 - len(piece) + j)
    return Parts(first, start, size, masks.reshape(-1))


def build(ids: list, texts: list[bytes]) -> Index:
    by_text: dict[bytes, list] = {}
    for i, t in zip(ids, texts, strict=True):
        by_text.setdefault(t, []).append(i)
    alone = list(by_text)
    return Index(list(by_text.values()), alone, np.array([len(t) for t in alone], np.int64), seeds_of(alone), parts_of(alone))


def least_distances(masks: np.ndarray, piece: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edit distance of each piece to a substring of data[begin:end], bytes of one class taken as equal: Myers' bit
    vectors, of all pieces at once."""
    order = np.argsort(begin - end, kind="stable")  # longest first, so that those that go on are the first ones
    begin, width, base = begin[order], np.maximum(0, (end - begin)[order]), piece[order] * (CLASSES + 1)
    live = np.searchsorted(-width, -np.arange(width.max(initial=0)), "left")
    at = begin + np.arange(len(live))[:, None]
    text = np.where(at < begin + width, data.take(at, mode="clip") % CLASSES, np.uint8(CLASSES)) if len(data) else np.zeros(at.shape, np.uint8)
    zeros = lambda: np.zeros(len(order), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    pv, mv, eq, xv, xh, ph = ~zeros() << (64 - size[order]).astype(np.uint64), zeros(), zeros(), zeros(), zeros(), zeros()
    score = size[order].astype(np.uint64)
    best = score.copy()
    for j, n in enumerate(live):
        if n < len(pv):
            pv, mv, eq, xv, xh, ph = (x[:n] for x in (pv, mv, eq, xv, xh, ph))
        masks.take(base[:n] + text[j, :n], out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_and(eq, pv, out=xh)
        xh += pv
        xh ^= pv
        xh |= eq
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        xh &= pv
        s = score[:n]
        np.right_shift(ph, top, out=eq)
        s += eq
        np.right_shift(xh, top, out=eq)
        s -= eq
        ph <<= one
        xh <<= one
        np.bitwise_or(xv, ph, out=eq)
        np.invert(eq, out=eq)
        np.bitwise_or(xh, eq, out=pv)
        np.bitwise_and(ph, xv, out=mv)
        np.minimum(best[:n], s, out=best[:n])
    out = np.empty(len(order), np.int64)
    out[order] = best.astype(np.int64)
    return out


def in_reach(x: Index, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each candidate's pieces allow a distance within the limit. A match's diagonals differ by its edits at most, so
    each piece lies within as many bytes of the hits' diagonals."""
    parts, limit = x.parts, allowed(x.lengths)[item]
    total, open_ = np.zeros(len(item), np.int64), np.arange(len(item))
    for i in range(int(np.diff(parts.first)[item].max(initial=0))):
        here = open_[parts.first[item[open_]] + i < parts.first[item[open_] + 1]]
        for k in range(0, len(here), BOUNDED_AT_ONCE):
            some = here[k : k + BOUNDED_AT_ONCE]
            piece = parts.first[item[some]] + i
            base, at = offsets[doc[some]], parts.start[piece]
            begin = np.maximum(base, base + low[some] + at - limit[some])
            end = np.minimum(offsets[doc[some] + 1], base + high[some] + at + parts.size[piece] + limit[some])
            total[some] += least_distances(parts.masks, piece, parts.size[piece], data, begin, end)
        open_ = open_[total[open_] <= limit[open_]]
    return total <= limit


def grouped(key: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By key: sum of n, least low, greatest high."""
    if not len(key):
        return key, n, low, high
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def candidates(seeds: Seeds, lengths: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, least and greatest begin of the places with enough hits. Begins of one place differ by the item's slack at
    most, so one of two bands of twice the slack, half a band apart, has all its hits."""
    n_steps = max((len(r.sample) for r in seeds.repeats), default=0)
    wide, starts, doc = spread(data, offsets, n_steps)
    local = np.arange(len(data)) - offsets[doc]
    slack = np.maximum(1, allowed(lengths))
    bands = int((np.diff(offsets).max(initial=0) + lengths.max(initial=0)) // 2 + 3)
    tallies: list[list[tuple]] = [[], []]
    for r in seeds.repeats:
        key = keys_of(wide, starts, r.walk, r.sample)
        hits = np.flatnonzero(r.table[key >> r.shift])
        first, count = np.searchsorted(r.keys, key[hits], "left"), np.searchsorted(r.keys, key[hits], "right")
        count -= first
        hits, first, count = hits[count > 0], first[count > 0], count[count > 0]
        upto = np.cumsum(count)
        i = 0
        while i < len(hits):
            before = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE, "right")))
            entry = np.arange(upto[j - 1] - before) + np.repeat(first[i:j] - (upto[i:j] - count[i:j] - before), count[i:j])
            at, item = np.repeat(hits[i:j], count[i:j]), r.items[entry].astype(np.int64)
            begin = local[at] - r.places[entry]
            for half in (0, 1):
                band = (begin + lengths[item] + half * slack[item]) // (2 * slack[item])
                tallies[half].append(grouped((doc[at] * len(lengths) + item) * bands + band, np.ones(len(at), np.int64), begin, begin))
            i = j
    found = []
    for parts in tallies:
        if parts:
            key, n, low, high = grouped(*[np.concatenate(x) for x in zip(*parts, strict=True)])
            item = key // bands % len(lengths)
            enough = n >= seeds.need[item]
            found.append((key[enough] // bands // len(lengths), item[enough], low[enough], high[enough]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)


def best_place(item: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """Least edit distance of item to a substring of text, if at most limit, and where that is: Myers' bit vectors for the
    end, and once more from the end backwards for the start."""

    def scan(p: bytes, t: bytes, anywhere: bool) -> tuple[int, int]:
        m = len(p)
        peq: dict[int, int] = {}
        for i, c in enumerate(p):
            peq[c] = peq.get(c, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        best, where = (m, 0)
        for j, c in enumerate(t, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += 1 if ph & top else -1 if mh & top else 0
            ph = (ph << 1) | (0 if anywhere else 1)
            pv, mv = ((mh << 1) | (full & ~(xv | ph))) & full, ph & xv & full
            if score < best:
                best, where = score, j
            if score - len(t) + j > limit and best > limit:  # each byte lowers the score by one at most
                break
        return best, where

    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    distance, end = scan(item, text, True)
    if distance > limit:
        return None
    _, back = scan(item[::-1], text[:end][::-1], False)
    return distance, end - back, end


def all_places(item: bytes, text: bytes, limit: int, base: int = 0) -> Iterator[tuple[int, int, int]]:
    """The best place, and those beside it."""
    got = best_place(item, text, limit) if len(text) >= len(item) - limit else None
    if got and got[2] > got[1]:
        yield got[0], base + got[1], base + got[2]
        yield from all_places(item, text[: got[1]], limit, base)
        yield from all_places(item, text[got[2] :], limit, base + got[2])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, distance, start, end): each place (bytes of the text) where a document has an item, the best of places that overlap."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    id_type, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    found = [_find(spark, docs, key, text, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), id_type, item_type) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.withColumnsRenamed({"key": key, "item": item})


def _find(spark: SparkSession, docs: DataFrame, key: str, text: str, items: DataFrame, id_type: str, item_type: str) -> DataFrame:
    rows = items.orderBy("item", "text").collect()  # BLOCK_BYTES of text or so
    raw = [r["text"].encode() for r in rows]
    data, offsets = joined(raw)
    plain, at, _ = normal(data, offsets)
    texts = [plain[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    index = build([r["item"] for r in rows], texts)
    sent = spark.sparkContext.broadcast(index)
    names = ["key", "item", "distance", "start", "end"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[tuple] = []
            for i, j in steps(offsets):
                o = offsets[i : j + 1]
                out += [(i + d, *rest) for d, *rest in matches(x, data[o[0] : o[-1]], o - o[0])]
            if out:
                row, item, distance, start, end = zip(*((d, i, *rest) for d, k, *rest in out for i in x.ids[k]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(distance, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names)

    schema = f"key {id_type}, item {item_type}, distance long, start long, end long"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(search, schema)


def matches(x: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) of the texts in data."""
    plain, at_doc, place = normal(data, offsets)
    best: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for seeds in x.seeds:
        places = np.unique(np.stack(candidates(seeds, x.lengths, plain, at_doc)), axis=1)
        for d, item, low, high in places[:, in_reach(x, plain, at_doc, *places)].T.tolist():
            t = x.texts[item]
            slack = max(1, int(LIMIT * len(t)))
            base, stop = int(at_doc[d]), int(at_doc[d + 1])
            low, high = max(base, base + low - slack), min(stop, base + high + len(t) + slack)
            found = list(all_places(t, plain[low:high].tobytes(), int(LIMIT * len(t)), low))
            if found:
                best.setdefault((d, item), set()).update(found)
    out = []
    for (d, item), places in best.items():
        kept: list[tuple[int, int, int]] = []
        for distance, a, b in sorted(places):
            if b > a and not any(a < y and s < b for _, s, y in kept):
                kept.append((distance, a, b))
                out.append((d, item, distance, int(place[a] - offsets[d]), int(place[b - 1] + 1 - offsets[d])))
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
