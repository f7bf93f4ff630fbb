"""Suffix-array dedup and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from spindrift.llm import jaccard_join, suffix_dedup
from spindrift.llm.jaccard_join import Join

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def removal(rows):
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect() if r["doc_id"] is not None)


def test_removal_equals_brute_force(spark, documents, odd):
    for df in (documents, odd):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect() if r["doc_id"] is not None]
        assert removed(df) == removal(rows)


def test_rows_without_id_are_kept_whole(odd):
    (r,) = [r for r in suffix_dedup.remove_repeats(odd).collect() if r["doc_id"] is None]
    assert (r["n_removed"], r["n_bytes"]) == (0, 45)


def test_hot_passages_and_small_blocks(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 20) :] + word() * 3 + "ab" * rng.randint(0, 60)) for i in range(60)]
    for name, value in (("SHARD", 1 << 10), ("BUCKET", 1 << 12), ("BLOCK", 1 << 9), ("HOT_SHARDS", 3), ("STEP", 1 << 9)):
        monkeypatch.setattr(suffix_dedup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(df) == removal([(i, t.encode()) for i, t in rows])


def test_outputs_with_text(documents):
    rows = suffix_dedup.remove_repeats(documents.limit(50), with_text=True).collect()
    for r in rows:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    text = np.frombuffer(bytes(rng.choice(list(b"ab"), 700)) + b"ab" * 150, np.uint8)
    sa, word = suffix_dedup.suffix_array(text)
    t = text.tobytes()
    assert sorted(sa) == list(range(len(t)))
    assert all(t[a : a + 64] <= t[b : b + 64] for a, b in zip(sa[:-1], sa[1:], strict=True))

    def common(a, b):
        n = 0
        while n < 64 and a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        return n

    assert suffix_dedup.common_prefixes(sa, word).tolist() == [0] + [common(a, b) for a, b in zip(sa[:-1], sa[1:], strict=True)]


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(UPPER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


def joined(df):
    return sorted((r["id"], r["n"], r["component"]) for r in Join(df).components().collect() if r["id"] is not None)


def test_join_equals_brute_force(spark, documents, odd):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
        assert joined(df) == components(rows)


def test_join_chains_frequent_words_and_salted_rows(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, now = [], list(base)
    for i in range(40):  # a chain of small changes: neighbours link, ends don't
        rows.append((100 - i, " ".join(now)))
        now[rng.randrange(60)] = f"z{i}"
    rows += [(200 + i, " ".join(base[:30] + [f"u{i}_{j}" for j in range(rng.randint(3, 40))])) for i in range(40)]
    rows += [(300 + i, " ".join(base)) for i in range(20)]
    for name, value in (("FREQUENT", 5), ("LOCAL_REPORT", 2), ("BLOCK", 7), ("BUCKET", 64), ("FLUSH", 50), ("LOCAL_BLOCK", 400)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components(rows)


def test_signatures_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 62, rng.integers(0, 300)).astype(np.uint64)]))
        if len(b):
            assert jaccard_join.least_difference(jaccard_join.signature(a), jaccard_join.signature(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, lambda d: Join(d).components()])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


REPEATED = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"), (1, "an entirely different text of the same id with enough words to have shingles", "b"), (1, "one two three four five six seven eight nine ten eleven twelve", "c"),
    (2, "One two three four five six seven eight nine ten eleven twelve", "d"), (3, "an entirely different text of the same id with enough words to have shingles", "e"), (3, "short", "f"), (3, "short", "f"), (3, "", "g"), (3, None, "h"), (3, "", "g"),
    (None, "one two three four five six seven eight nine ten eleven twelve", "i"), (None, "one two three four five six seven eight nine ten eleven twelve", "i"),
]


def test_rows_that_share_an_id(spark):
    """Unlinked texts of one id all stay, of linked and of equal ones the least does, however rows are dealt."""
    from spindrift.llm.jaccard_join import document_components, one_of_each

    df = spark.createDataFrame(REPEATED, "doc_id long, text string, source string")
    kept, found = [], []
    for n in (1, 3, 8):
        kept.append(sorted(map(repr, (tuple(r) for r in one_of_each(df.repartition(n)).collect()))))
        found.append(sorted(map(repr, (tuple(r) for r in document_components(df.repartition(n)).collect()))))
    assert kept[0] == kept[1] == kept[2] and found[0] == found[1] == found[2]
    got = [tuple(r) for r in one_of_each(df).collect()]
    assert sorted((i, t) for i, t, _ in got if i) == sorted([(1, REPEATED[0][1]), (1, REPEATED[1][1]), (3, "short"), *[(3, t) for i, t, _ in got if i == 3 and not t]], key=lambda x: (x[0], x[1] or ""))
    assert sum(i is None for i, _, _ in got) == 2 and sum(i == 3 and not t for i, t, _ in got) == 1
    parts = sorted(((r["id"], r["n"], r["component"]) for r in document_components(df).collect() if r["id"]), key=repr)
    assert parts == sorted([(1, 8, 1), (1, 10, 1), (1, 8, 1), (2, 8, 1), (3, 10, 1), (3, 1, 3), (3, 1, 3), (3, 0, 3), (3, 0, 3), (3, 0, 3)], key=repr)


def test_unique_ids_take_the_plain_way(spark, documents):
    from spindrift.llm.jaccard_join import ids_repeat, one_of_each

    assert not ids_repeat(documents) and ids_repeat(documents.union(documents))
    twice = one_of_each(documents.unionByName(documents))
    assert sorted(r["doc_id"] for r in twice.select("doc_id").collect()) == sorted(r["doc_id"] for r in one_of_each(documents).select("doc_id").collect())


def test_the_pipeline_takes_an_empty_table(spark, empty):
    import corpus_pipeline

    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
