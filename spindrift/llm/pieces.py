"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda of adjacent symbol pairs.

A normalised text starts as one symbol a character. The agenda holds the adjacent pairs whose strings joined are a piece; the pair
of highest score (leftmost among equals) is joined, its new neighbours enter the agenda, and so on until none is left.
No piece of such vocabularies has a space mark behind another character, so no join crosses the start of a word: a text falls into
words whose agendas don't touch, and equal words have equal ids. The distinct words of an Arrow batch run side by side, each a row
of a matrix of pair scores; words longer than LANE characters have a heap. A vocabulary with pieces across words makes each
text one unit. Every distinct unit is checked against the library in its batch, and a document with a unit that differs is marked.
Decoding sets the library's own texts of the pieces end to end; whatever isn't plain pieces between a begin and an end goes to the library.

Defined cases: null text is empty, and empty text has the begin and end ids alone; characters without a piece are bytes where the
vocabulary has them, else runs of them are one unknown id; texts of any length are encoded whole, in steps of STEP bytes or one
text; repeated rows and null keys each give their row; ties between scores go to the left; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import documents, steps, text_bytes

SPACE = "▁"
MARK = tuple(SPACE.encode())
#: Characters of a word that a row of the matrix holds at most; cells of a matrix; bytes of text in a step; words remembered between steps.
LANE, CELLS, STEP, MEMO = 64, 1 << 20, 1 << 22, 1 << 19
WIDTHS = (4, 8, 12, 16, 24, 32, LANE)


class Vocabulary:
    """Symbols are numbers: pieces have their ids, then come characters that only occur within pieces, then all other characters."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("the vocabulary isn't of the merge type")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.n_pieces = len(spec.pieces)
        self.unknown, self.begin, self.end = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        self.bytes = None
        if spec.trainer_spec.byte_fallback:
            self.bytes = np.zeros(256, np.int64)
            for i, p in enumerate(spec.pieces):
                if p.type == kinds.BYTE:
                    self.bytes[int(p.piece[3:5], 16)] = i
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.by_words = not any(b == SPACE != a for p in normal for a, b in pairwise(p)) and self._keeps_words()
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p}):
            symbols.setdefault(char, self.n_pieces + len(symbols) - len(normal))
        self.n_known = self.n_pieces + len(symbols) - len(normal)
        self.of_char = np.arange(self.n_known, self.n_known + 0x110000, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.rare = np.array([ord(s) for s, i in symbols.items() if i >= self.n_pieces], np.int64)  # by symbol, from n_pieces
        # pairs by the code of their two symbols; a piece has as many as it has cuts into two symbols
        pairs = [(symbols[p[:k]] << 32 | symbols[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        score = np.array([p.score for p in spec.pieces], np.float32)
        rank = np.unique(score, return_inverse=True)[1].astype(np.int32)  # equal scores, equal ranks
        self.joined = {code: (int(rank[i]), i) for code, i in pairs}
        pairs = np.array(sorted(pairs) or [(-1, 0)], np.int64)
        # a table of slots: a code lies at its slot or one of the next few
        bits = max(10, int(4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.codes, self.into = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
        self.reach = 1
        for code, slot, i in zip(pairs[:, 0].tolist(), self._slot(pairs[:, 0]).tolist(), pairs[:, 1].tolist(), strict=True):
            at = slot
            while self.codes[at] != -1:
                at += 1
            self.codes[at], self.into[at] = code, i
            self.reach = max(self.reach, at - slot + 1)
        self.rank = rank
        self._surfaces()
        self.forget()

    def forget(self) -> None:
        """The words seen so far, by number: their ids in one array, and whether the library gave the same."""
        self.memo: dict[str, int] = {}
        self.flat, self.ends, self.ok = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def remember(self, words: list[str], flat: np.ndarray, size: np.ndarray, ok: np.ndarray) -> None:
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        self.flat, self.ok = np.concatenate([self.flat, flat]), np.concatenate([self.ok, ok])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])

    def _surfaces(self) -> None:
        """The library's text of each piece behind another and, from n_pieces, at the start of a text. Pieces of single bytes are those bytes."""
        n, some = self.n_pieces, self.library.encode("a")
        later = [t.encode()[1:] for t in self.library.decode([[*some, i] for i in range(n)])] if self.library.decode(some) == "a" else [b""] * n
        first = [t.encode() for t in self.library.decode([[i] for i in range(n)])]
        self.is_byte, self.plain = np.zeros(n, bool), np.zeros(n, bool)
        for value, i in enumerate(self.bytes.tolist() if self.bytes is not None else []):
            later[i] = first[i] = bytes([value])
            self.is_byte[i] = value > 127
        for i in range(n):
            self.plain[i] = bool(later[i]) and not self.library.is_unknown(i) and not self.library.is_control(i)
        self.surface = np.frombuffer(b"".join(later + first), np.uint8)
        self.surface_size = np.array([len(x) for x in later + first], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size

    def _keeps_words(self) -> bool:
        """Whether the library puts a space before a text and keeps every other one, so that a word can be checked alone."""
        return self.library.normalize("a  b ") == f"{SPACE}a{SPACE}{SPACE}b{SPACE}"

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank -1 where they don't join."""
        codes = left.astype(np.int64) << 32 | right
        at = self._slot(codes)
        found = self.codes[at] == codes
        piece = np.where(found, self.into[at], 0)
        todo = np.flatnonzero(~found & (self.codes[at] != -1))
        for k in range(1, self.reach):
            if not len(todo):
                break
            here = at[todo] + k
            hit = self.codes[here] == codes[todo]
            piece[todo[hit]], found[todo[hit]] = self.into[here[hit]], True
            todo = todo[~hit & (self.codes[here] != -1)]
        return np.where(found, self.rank[piece], -1), piece


def agenda(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Joins of one unit by a heap of (rank, place): the symbols that are left."""
    n = len(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (found := v.joined.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(heap, (-found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been joined since
        symbols[i], symbols[j], after[i] = piece, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s in symbols if s >= 0]


def lanes(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Joins of many units at once: a unit a row, filled up with -1. Each round takes the best pair of every row's agenda, the
    leftmost of equal ones; rows without any are done. Symbols that were joined to their left are -1 in the result."""
    symbols = symbols.copy()
    n, width = symbols.shape
    columns = np.arange(width)
    after = np.where(columns + 1 < (symbols >= 0).sum(axis=1)[:, None], columns + 1, -1).astype(np.int32)
    before = np.tile(columns.astype(np.int32) - 1, (n, 1))
    rank, piece = np.full((n, width), -1, np.int32), np.zeros((n, width), np.int32)
    r, c = np.nonzero(after >= 0)
    rank[r, c], piece[r, c] = v.join(symbols[r, c], symbols[r, c + 1])
    rows = np.arange(n)  # rank has a row for each of these
    while len(rows):
        best = rank.argmax(axis=1)
        here = np.flatnonzero(rank[np.arange(len(rows)), best] >= 0)
        if 4 * len(here) < 3 * len(rows):
            rank, rows, best, here = rank[here], rows[here], best[here], np.arange(len(here))
        if not len(here):
            break
        at, best = rows[here], best[here]
        gone = after[at, best]
        then, left = after[at, gone], before[at, best]
        symbols[at, best], symbols[at, gone] = piece[at, best], -1
        rank[here, gone] = -1
        after[at, best] = then
        some = then >= 0
        before[at[some], then[some]] = best[some]
        rank[here[~some], best[~some]] = -1
        rank[here[some], best[some]], piece[at[some], best[some]] = v.join(symbols[at[some], best[some]], symbols[at[some], then[some]])
        some = left >= 0
        rank[here[some], left[some]], piece[at[some], left[some]] = v.join(symbols[at[some], left[some]], symbols[at[some], best[some]])
    return symbols


def ids_of(v: Vocabulary, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their owners of the symbols left: symbols without a piece as bytes, or each run of them in a unit as one unknown id."""
    odd = symbols >= v.n_pieces
    if not odd.any():
        return symbols.astype(np.int32), owner
    if v.bytes is None:
        again = np.concatenate([[False], odd[1:] & odd[:-1] & (owner[1:] == owner[:-1])])
        return np.where(odd, v.unknown, symbols)[~again].astype(np.int32), owner[~again]
    extra = symbols[odd]
    rare = extra < v.n_known
    extra[rare], extra[~rare] = v.rare[extra[rare] - v.n_pieces], extra[~rare] - v.n_known
    size = np.ones(len(symbols), np.int64)
    size[odd] = 1 + (extra > 0x7F) + (extra > 0x7FF) + (extra > 0xFFFF)
    out = np.repeat(symbols, size)
    out[np.repeat(odd, size)] = v.bytes[np.frombuffer("".join(map(chr, extra.tolist())).encode(), np.uint8)]
    return out.astype(np.int32), np.repeat(owner, size)


def merged(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the normalised units, by their agendas, set end to end, and how many each has."""
    size = np.array([len(u) for u in units], np.int64)
    found, owners, low = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for width in WIDTHS:
        some = np.flatnonzero((size > low) & (size <= width))
        low = width
        for part in np.array_split(some, -(-len(some) * width // CELLS)) if len(some) else ():
            chars = np.frombuffer("".join([units[i] for i in part]).encode("utf-32-le"), "<u4")
            grid = np.full((len(part), width), -1, np.int64)
            grid[np.arange(width) < size[part][:, None]] = v.of_char[chars]
            grid = lanes(v, grid)
            ids, owner = ids_of(v, grid[grid >= 0], np.repeat(part, (grid >= 0).sum(axis=1)))
            found.append(ids)
            owners.append(owner)
    for i in np.flatnonzero(size > LANE):
        left = agenda(v, v.of_char[np.frombuffer(units[i].encode("utf-32-le"), "<u4")].tolist())
        ids, owner = ids_of(v, np.array(left, np.int64), np.full(len(left), i))
        found.append(ids)
        owners.append(owner)
    owner = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))


def library_ids(v: Vocabulary, texts: list[str]) -> list[list[int]]:
    return v.library.encode(texts, num_threads=1) if texts else []


def library_words(v: Vocabulary, words: list[str]) -> list[list[int]]:
    """The library's ids of words with their space mark, which the library sets again. A mark alone, as at the end of a text, is
    what remains of a text that ends with it."""
    found = library_ids(v, [w[1:].replace(SPACE, " ") for w in words])
    if SPACE in words:
        short, long = library_ids(v, ["a", "a "])
        found[words.index(SPACE)] = long[len(short) :]
    return found


def by_words(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, their offsets, and whether each text agrees with the library."""
    data, offsets = text_bytes(normal := pa.array(v.library.normalize(texts), pa.large_string()))
    mark = np.zeros(len(data) + 3, bool)
    mark[: max(len(data) - 2, 0)] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    first = mark.copy()
    first[3:] &= ~mark[:-3]  # a run of spaces belongs to the word behind it
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.append(np.flatnonzero(first[: len(data)]), len(data))
    words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), normal.buffers()[2] if len(data) else pa.py_buffer(b"")).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    if len(v.memo) > MEMO:
        v.forget()
    new = [w for w in distinct if w not in v.memo]
    flat, size = merged(v, new)
    v.remember(new, flat, size, equal(flat, size, library_words(v, new)))
    number = np.fromiter((v.memo[w] for w in distinct), np.int64, len(distinct))
    index = number[words.indices.to_numpy()]
    n = v.ends[index + 1] - v.ends[index]
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = v.flat[np.repeat(v.ends[index] - upto[:-1], n) + np.arange(upto[-1])]
    bounds = np.searchsorted(starts[:-1], offsets)  # words before each text
    bad = np.concatenate([[0], np.cumsum(~v.ok[index])])
    return ids, upto[bounds], bad[bounds[1:]] == bad[bounds[:-1]]


def equal(flat: np.ndarray, size: np.ndarray, theirs: list[list[int]]) -> np.ndarray:
    """Whether each unit has the library's ids."""
    other = np.fromiter(itertools.chain.from_iterable(theirs), np.int32)
    ok = size == np.fromiter(map(len, theirs), np.int64, len(theirs))
    if ok.all():
        return np.bincount(np.repeat(np.arange(len(size)), size), flat != other, minlength=len(size)) == 0
    return np.array([a.tolist() == b for a, b in zip(np.split(flat, np.cumsum(size)[:-1]), theirs, strict=True)], bool)


def by_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for vocabularies whose pieces cross words: a text is one unit."""
    flat, size = merged(v, v.library.normalize(texts))
    return flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), equal(flat, size, library_ids(v, texts))


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """One a Python worker."""
    return Vocabulary(model)


def encode_batches(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, ids, agrees), with begin and end ids."""
    v = vocabulary(model)
    ends = [[i] if i >= 0 else [] for i in (v.begin, v.end)]
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for i, j in steps(offsets, STEP):
            texts = batch.column(1).slice(i, j - i).fill_null("").to_pylist()
            ids, at, ok = (by_words if v.by_words else by_texts)(v, texts)
            more = len(ends[0]) + len(ends[1])
            whole = np.zeros(len(ids) + more * len(texts), np.int32)
            upto = at + more * np.arange(len(at))
            place = np.arange(len(ids)) + len(ends[0]) + more * np.repeat(np.arange(len(texts)), np.diff(at))
            whole[place] = ids
            if ends[0]:
                whole[upto[:-1]] = ends[0][0]
            if ends[1]:
                whole[upto[1:] - 1] = ends[1][0]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(whole)), pa.array(ok)], ["key", "ids", "agrees"])


def texts_of(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of lists of ids, by the library's texts of the pieces. Lists with other control or unknown ids than a begin and an end,
    and those whose single bytes aren't whole characters, go to the library as they are."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    known = (ids >= 0) & (ids < v.n_pieces)
    place = np.arange(len(ids))
    ends = ((ids == v.begin) & (place == at[:-1][owner])) | ((ids == v.end) & (place == at[1:][owner] - 1))
    inner = np.flatnonzero(~ends)
    odd = np.bincount(owner[inner], ~(known[inner] & v.plain[np.where(known[inner], ids[inner], 0)]), minlength=n) > 0
    inner = inner[~odd[owner[inner]]]
    kind, mine = ids[inner].astype(np.int64), owner[inner]
    some_bytes = np.bincount(mine, v.is_byte[kind], minlength=n) > 0
    kind += v.n_pieces * np.concatenate([mine[:1] == mine[:1], mine[1:] != mine[:-1]])  # a text's first piece
    size = v.surface_size[kind]
    upto = np.concatenate([[0], np.cumsum(size)])
    data = v.surface[np.repeat(v.surface_at[kind] - upto[:-1], size) + np.arange(upto[-1])]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(mine, size, minlength=n))]).astype(np.int64)
    for i in np.flatnonzero(some_bytes):
        try:
            data[bounds[i] : bounds[i + 1]].tobytes().decode()
        except UnicodeDecodeError:
            odd[i] = True
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(data))
    if not odd.any():
        return texts.cast(pa.string())
    rest = np.flatnonzero(odd)
    theirs = v.library.decode([ids[at[i] : at[i + 1]].tolist() for i in rest], num_threads=1)
    return pc.replace_with_mask(texts.cast(pa.string()), pa.array(odd), pa.array(theirs, pa.string()))


def decode_batches(batches: Iterator[pa.RecordBatch], model: bytes, at: int) -> Iterator[pa.RecordBatch]:
    """Adds the text of the ids in column at."""
    v = vocabulary(model)
    for batch in batches:
        lists = batch.column(at)
        lists = lists.fill_null([]) if lists.null_count else lists
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        texts = texts_of(v, lists.flatten().to_numpy(), ends) if len(batch) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, agrees) of each row; agrees: the library gives the same ids for each of its units."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, sent.value), f"key {kind}, ids array<int>, agrees boolean").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of each row of ids; null ids are none."""
    kind = encoded.schema[key].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode_batches(batches, sent.value, 1):
            yield batch.select(["key", "decoded"])

    return rows.mapInArrow(texts, f"key {kind}, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, agrees): the ids of encode and the texts of decode in one pass, as digests."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode_batches(encode_batches(batches, sent.value), sent.value, 1):
            ids, at = batch.column(1).values.to_numpy().astype("<u4"), batch.column(1).offsets.to_numpy()
            ids_sha = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in pairwise(at)]
            data, cut = text_bytes(batch.column(3))
            decoded_sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), batch.column(2)], ["key", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return rows.mapInArrow(digest, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean").withColumnRenamed("key", key)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return digests(documents(spark, sf_dir).select("doc_id", "text"), model)
