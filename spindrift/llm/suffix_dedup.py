"""Suffix-array dedup: removal of every byte covered by a long string that an earlier document also holds.

Texts are dealt into document shards by id. Each LENGTH-byte string has an anchor, the least hash of the K-byte
strings inside it, so equal strings have equal anchors:

1. Each shard sends its distinct anchors to buckets; a bucket returns those that several documents have.
2. Each shard cuts its text into pieces, runs of strings of one returned anchor, and sends distinct pieces
   with their least document to the bucket of the anchor. (A string that no other document has ends before this,
   so buckets hold little more than the repeated text.)
3. A bucket sorts its pieces in blocks: a suffix array by Larsson-Sadakane refinement, common prefixes by
   Kasai's algorithm in lanes, runs of common prefixes of LENGTH or more; blocks are merged by binary search of one block's
   strings in the other's array. It returns for each piece which strings an earlier document than the piece's has.
4. Each shard marks the covered bytes of its texts.

An anchor of very many shards (a passage that a large share of all documents holds) has its pieces cut into single
strings that are dealt by their own hash, so no bucket grows with it.

Defined cases: null and empty texts have no bytes; matches never cross documents; equal strings within one document,
or in rows with the same id, don't count; rows with a null id are kept whole and match nothing; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import documents, mix, powers, steps, text_bytes

LENGTH, K = 50, 32
#: Bytes of text a shard and of pieces a bucket is meant to have, and bytes of a block with one suffix array.
SHARD, BUCKET, BLOCK = 4 << 20, 1 << 21, 1 << 20
#: Bytes of text that anchors are taken of at a time, so that the arrays stay in the cache.
STEP = 1 << 18
#: An anchor in more shards than this has its strings dealt one by one.
HOT_SHARDS = 128
LOW40 = np.uint64((1 << 40) - 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the string at each position but the last length - 1, and the prefix sums for span_hashes."""
    total = prefix_sums(data)
    n = len(data) - k + 1
    if len(data) < length:
        return np.zeros(0, np.uint64), total
    h = mix((total[k:] - total[:n]) * powers(len(data) + 1)[1][:n])
    span, reach = length - k + 1, 1
    while reach * 2 <= span:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    if span > reach:
        h = np.minimum(h[: len(h) - (span - reach)], h[span - reach :])
    return h, total


class Runs:
    """Runs of strings with one anchor in a step of texts: positions of first and last string, anchor, document row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.anchor, self.total = anchors(data)
        m = len(self.anchor)
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        valid = (owner[:m] == owner[LENGTH - 1 : LENGTH - 1 + m]) if m else np.zeros(0, bool)
        if m:
            fresh = np.ones(m, bool)
            fresh[1:] = (self.anchor[1:] != self.anchor[:-1]) | (owner[1:m] != owner[: m - 1])
            fresh &= valid
            ends = np.ones(m, bool)
            ends[:-1] = fresh[1:] | ~valid[1:]
            ends &= valid
            self.first, self.last = np.flatnonzero(fresh), np.flatnonzero(ends)
        else:
            self.first = self.last = np.zeros(0, np.int64)
        self.row = owner[self.first].astype(np.int64) if m else np.zeros(0, np.int64)
        self.value = self.anchor[self.first] if m else np.zeros(0, np.uint64)

    def pieces(self, repeated: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last string, row, hash and bucket hash of each piece to compare: runs of repeated anchors, hot ones string by string."""
        at = inside(repeated, self.value)
        single = at & inside(hot, self.value)
        first, last, row, value = (x[at & ~single] for x in (self.first, self.last, self.row, self.value))
        if single.any():
            each, owner = ragged(self.first[single], self.last[single] + 1)
            first, last, row = np.concatenate([first, each]), np.concatenate([last, each]), np.concatenate([row, self.row[single][owner]])
            value = np.concatenate([value, span_hashes(self.total, each, each + LENGTH)])
        return first, last, row, span_hashes(self.total, first, last + LENGTH), value


def inside(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def ragged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges start:end, and the range of each."""
    size = end - start
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their first depth bytes or more, and the 8 bytes at each position as a number. Larsson-Sadakane:
    groups of equal prefixes are refined by the ranks of what follows, each round only in groups that aren't single."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + n]
    sa = np.argsort(word, kind="stable").astype(np.int64)
    head = np.concatenate([[True], word[sa[1:]] != word[sa[:-1]]])
    number = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[sa] = number[np.cumsum(head) - 1] + 1
    h = 8
    while h < depth:
        tail = np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~(head & tail))
        if not len(open_):
            break
        at = sa[open_]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n)].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sa[open_], key = at[order], key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_] = fresh
        rank[sa[open_]] = open_[fresh][np.cumsum(fresh) - 1] + 1
        h *= 2
    return sa, word


def common_prefixes(sa: np.ndarray, word: np.ndarray, most: int = 64, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in sa, at most most bytes. Kasai's algorithm, many stretches
    of the text at a time: going on one position loses at most one byte of the common prefix."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    lanes = max(1, min(lanes, n // 64))
    start = np.arange(lanes) * n // lanes
    stop = np.append(start[1:], n)
    length = np.zeros(lanes, np.int64)
    for step in range(int((stop - start).max())):
        at = np.minimum(start + step, stop - 1)
        other = before[at]
        # suffixes equal to the full depth are in no order, and say nothing of the next position
        length = np.where((other >= 0) & (length < most), np.maximum(length - 1, 0), 0)
        live = np.flatnonzero(other >= 0)
        while len(live):
            i, j = at[live] + length[live], other[live] + length[live]
            live = live[inner := (np.maximum(i, j) < n)]
            i, j = i[inner], j[inner]
            x = word[i] ^ word[j]
            more = np.where(x == 0, 8, 7 - np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) // 8)
            more = np.minimum(more, n - np.maximum(i, j))
            length[live] = np.minimum(length[live] + more, most)
            live = live[(x == 0) & (length[live] < most)]
        out[at] = length
    return out[sa]


def sorted_strings(text: np.ndarray, starts: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings at starts (whose documents are earliest): one start of each distinct string in text order, the least
    document of each, and the number of the distinct string of each start."""
    sa, word = suffix_array(text)
    lcp = common_prefixes(sa, word)
    wanted = np.full(len(text), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    fresh = np.cumsum(lcp < LENGTH)  # suffixes of one number have their first LENGTH bytes in common
    index = wanted[sa]
    at = index >= 0
    index, number = index[at], fresh[at]
    head = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
    of = np.empty(len(starts), np.int64)
    of[index] = np.cumsum(head) - 1
    firsts = np.flatnonzero(head)
    return starts[index[firsts]], np.minimum.reduceat(earliest[index], firsts) if len(firsts) else earliest[:0], of


def keys_of(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The strings at starts as fixed-size byte keys that compare in text order (a 0x01 ends each, as numpy drops ending zeros)."""
    rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]
    return np.ascontiguousarray(np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], axis=1)).view(f"S{LENGTH + 1}").ravel()


def earliest_documents(pieces: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For concatenated pieces of the given sizes and least documents: the least document of each string in them."""
    blocks = []
    ends = np.cumsum(size)
    for i, j in steps(np.concatenate([[0], ends]), BLOCK):
        base = ends[i] - size[i]
        text = pieces[base : ends[j - 1]]
        starts, owner = ragged(ends[i:j] - size[i:j] - base, ends[i:j] - LENGTH + 1 - base)
        first, least, of = sorted_strings(text, starts, doc[i:j][owner])
        blocks.append([keys_of(text, first) if len(ends) > j - i else None, least, of])
    # across blocks: each later block's strings are sought in the earlier ones, and both take the lesser document
    for b in range(1, len(blocks)):
        for a in range(b):
            keys, least = blocks[a][0], blocks[a][1]
            at = np.minimum(np.searchsorted(keys, blocks[b][0]), len(keys) - 1)
            hit = keys[at] == blocks[b][0]
            low = np.minimum(least[at[hit]], blocks[b][1][hit])
            least[at[hit]] = low
            blocks[b][1][hit] = low
    for b in range(len(blocks) - 1, 0, -1):  # and back, as a later block may have lowered one that another shares
        for a in range(b):
            keys, least = blocks[a][0], blocks[a][1]
            at = np.minimum(np.searchsorted(keys, blocks[b][0]), len(keys) - 1)
            hit = keys[at] == blocks[b][0]
            blocks[b][1][hit] = np.minimum(least[at[hit]], blocks[b][1][hit])
    return np.concatenate([least[of] for _, least, of in blocks]) if blocks else doc[:0]


# --- the job -------------------------------------------------------------------------------------------------------


def pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x & LOW40).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket starts and ends in it."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return order, cut, np.append(cut[1:], len(b))


RIGHT = "shard long, kind long, one binary, two binary, three binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row; with_text adds kept (the remaining bytes) and spans, the removed ranges."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, volume // SHARD)
    bits = max(4, int(max(1, volume // BUCKET) - 1).bit_length())
    shift = np.uint64(64 - bits)
    mine = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64("text"))), F.lit(shards))).repartition(shards, "shard")

    def ids_and_text(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column("id").combine_chunks()
        known = np.asarray(ids.is_valid())
        data, offsets = text_bytes(table.column("text").combine_chunks())
        return ids, np.asarray(ids.fill_null(0)), known, data, offsets

    def send_anchors(table: pa.Table) -> pa.Table:
        _, ids, known, data, offsets = ids_and_text(table)
        values, owners = [], []
        for i, j in steps(offsets, STEP):
            o = offsets[i : j + 1]
            runs = Runs(data[o[0] : o[-1]], o - o[0])
            ok = known[i:j][runs.row]
            values.append(runs.value[ok])
            owners.append(ids[i:j][runs.row][ok])
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        head = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
        several = np.zeros(len(value), bool)
        several[1:] = ~head[1:] & (owner[1:] != owner[:-1])
        several = np.logical_or.reduceat(several, np.flatnonzero(head)) if len(value) else several
        value = value[head]
        order, cut, end = by_bucket((value >> shift).astype(np.int64))
        value, several = value[order], several[order]
        return pa.table({"shard": pa.array(np.full(len(cut), table.column("shard")[0].as_py()), pa.int64()), "bucket": pa.array((value[cut] >> shift).astype(np.int64)), "anchor": pa.array([pack40(value[a:b]) for a, b in zip(cut, end, strict=True)], pa.binary()), "several": pa.array([several[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())})

    def meet_anchors(table: pa.Table) -> pa.Table:
        shard, blobs = table.column("shard").to_pylist(), [unpack40(x) for x in table.column("anchor").to_pylist()]
        flags = np.frombuffer(b"".join(table.column("several").to_pylist()), bool)
        value, of, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        several = np.zeros(len(value), bool)
        np.logical_or.at(several, of, flags)
        repeated, hot = (several | (count > 1))[of], (count > HOT_SHARDS)[of]
        bucket = [int(table.column("bucket")[0].as_py()).to_bytes(8, "little")] * len(blobs)
        one, two, at = [], [], 0
        for blob in blobs:
            r, t = repeated[at : at + len(blob)], hot[at : at + len(blob)]
            one.append(pack40(blob[r]))
            two.append(pack40(blob[t]))
            at += len(blob)
        return pa.table({"shard": pa.array(shard, pa.int64()), "kind": pa.array([0] * len(shard), pa.int64()), "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary()), "three": pa.array(bucket, pa.binary())})

    # anchors are told apart by their bucket and low 40 bits: a chance agreement only adds a piece to compare
    mask = LOW40 | (np.uint64((1 << bits) - 1) << shift)

    def told(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        kind = np.asarray(right.column("kind").combine_chunks()) == 0 if right.num_rows else np.zeros(0, bool)
        part = right.filter(pa.array(kind, pa.bool_()))
        top = [np.uint64(int.from_bytes(b, "little")) << shift for b in part.column("three").to_pylist()]
        return tuple(np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack40(x) | t for x, t in zip(part.column(c).to_pylist(), top, strict=True))])) for c in ("one", "two"))

    def cut_pieces(data: np.ndarray, o: np.ndarray, repeated: np.ndarray, hot: np.ndarray) -> tuple:
        runs = Runs(data[o[0] : o[-1]], o - o[0])
        runs.value = runs.value & mask
        return runs.pieces(repeated, hot)

    def shard_pieces(left: pa.Table, right: pa.Table):  # noqa: ANN202
        """Of the shard's texts: steps with their pieces, and its distinct pieces: hash, bucket hash, least document, first place."""
        _, ids, known, data, offsets = ids_and_text(left)
        repeated, hot = told(right)
        found = []
        for i, j in steps(offsets, STEP):
            first, last, row, h, bucket = cut_pieces(data, offsets[i : j + 1], repeated, hot)
            ok = known[i:j][row]
            found.append(((first + offsets[i])[ok], (last + offsets[i])[ok], (row + i)[ok], h[ok], bucket[ok]))
        first, last, row, h, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = ids[row]
        order = np.lexsort((doc, h))
        head = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        return ids, known, data, offsets, (first, last, row, h, doc), order[head], bucket

    def send_pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["shard", "bucket", "size", "doc", "bytes"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)})
        _, _, data, _, (first, last, _, _, doc), pick, bucket = shard_pieces(left, right)
        order, cut, end = by_bucket((bucket[pick] >> shift).astype(np.int64))
        pick = pick[order]
        where, owner = ragged(first[pick], last[pick] + LENGTH)
        raw, press = data[where].tobytes(), zstandard.ZstdCompressor(level=3)
        size = (last[pick] + LENGTH - first[pick]).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"shard": pa.array(np.full(len(cut), left.column("shard")[0].as_py()), pa.int64()), "bucket": pa.array((bucket[pick][cut] >> shift).astype(np.int64)), **{n: pa.array([press.compress(x[a:b].tobytes()) for a, b in zip(cut, end, strict=True)], pa.binary()) for n, x in (("size", size), ("doc", doc[pick]))}, "bytes": pa.array([press.compress(raw[upto[a] : upto[b]]) for a, b in zip(cut, end, strict=True)], pa.binary())})

    def meet_pieces(table: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        get = lambda c, kind: [np.frombuffer(unpress.decompress(x), kind) for x in table.column(c).to_pylist()]
        shard, sizes, docs_, raws = table.column("shard").to_pylist(), get("size", np.int32), get("doc", np.int64), get("bytes", np.uint8)
        hashes = []
        for size, raw in zip(sizes, raws, strict=True):
            end = np.cumsum(size.astype(np.int64))
            hashes.append(span_hashes(prefix_sums(raw), end - size, end))
        count = [len(x) for x in sizes]
        h, size, doc, raw = np.concatenate(hashes), np.concatenate(sizes).astype(np.int64), np.concatenate(docs_), np.concatenate(raws)
        order = np.lexsort((doc, h))
        head = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(head) - 1
        pick = order[head]  # one copy of each piece, of its least document
        end = np.cumsum(size)
        where, _ = ragged((end - size)[pick], end[pick])
        least = earliest_documents(raw[where], size[pick], doc[pick])
        width = size[pick] - LENGTH + 1
        base = np.cumsum(width) - width
        bits_, at = [], 0
        for n in count:  # a bit a string of each piece, in the order in which the shard sent them
            mine_ = slice(at, at + n)
            strings, owner = ragged(base[number[mine_]], (base + width)[number[mine_]])
            bits_.append(np.packbits(least[strings] < doc[mine_][owner]).tobytes())
            at += n
        bucket = [int(table.column("bucket")[0].as_py()).to_bytes(8, "little")] * len(shard)
        none = pa.nulls(len(shard), pa.binary())
        return pa.table({"shard": pa.array(shard, pa.int64()), "kind": pa.array([1] * len(shard), pa.int64()), "one": pa.array(bits_, pa.binary()), "two": none, "three": pa.array(bucket, pa.binary())})

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary(), spans_type] if with_text else [])]

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        _, _, data, offsets, (first, last, _, h, doc), pick, bucket = shard_pieces(left, right)
        covered = np.zeros(len(data) + 1, np.int32)
        part = right.filter(pa.array(np.asarray(right.column("kind").combine_chunks()) == 1 if right.num_rows else np.zeros(0, bool), pa.bool_()))
        if len(h):
            number = np.searchsorted(h[pick], h)  # pick is in order of hash
            later = doc > doc[pick][number]
            order, cut, end = by_bucket((bucket[pick] >> shift).astype(np.int64))
            width = (last - first + 1)[pick][order]
            upto = np.concatenate([[0], np.cumsum(width)])
            earlier = np.zeros(upto[-1], np.uint8)
            group = {int(b): (upto[a], upto[e]) for b, a, e in zip((bucket[pick][order] >> shift)[cut], cut, end, strict=True)}
            for packed, name in zip(part.column("one").to_pylist(), part.column("three").to_pylist(), strict=True):
                a, e = group[int.from_bytes(name, "little")]
                earlier[a:e] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(e - a))
            np.add.at(covered, first[later], 1)
            np.add.at(covered, last[later] + LENGTH, -1)
            slot = np.empty(len(pick), np.int64)
            slot[order] = np.arange(len(pick))
            rest = np.flatnonzero(~later)
            at = upto[slot[number[rest]]]
            strings, owner = ragged(at, at + width[slot[number[rest]]])
            start = (strings - at[owner] + first[rest][owner])[earlier[strings] == 1]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + LENGTH, -1)
        gone = np.cumsum(covered[:-1]) > 0
        out: list[list] = [[] for _ in names[1:]]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            g = gone[a:b]
            kept = data[a:b][~g].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            values = [b - a, int(g.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()]
            if with_text:
                values += [kept, [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]]
            for column, v in zip(out, values, strict=True):
                column.append(v)
        return pa.table([left.column("id"), *(pa.array(x, k) for x, k in zip(out, kinds[1:], strict=True))], names=names)

    sent = mine.groupBy("shard").applyInArrow(send_anchors, "shard long, bucket long, anchor binary, several binary")
    repeated = sent.groupBy("bucket").applyInArrow(meet_anchors, RIGHT)
    pieces = mine.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(send_pieces, "shard long, bucket long, size binary, doc binary, bytes binary")
    answers = pieces.groupBy("bucket").applyInArrow(meet_pieces, RIGHT)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * with_text
    return mine.groupBy("shard").cogroup(repeated.unionByName(answers).groupBy("shard")).applyInArrow(mark, schema).withColumnRenamed("id", key)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
