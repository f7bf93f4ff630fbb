"""The Merkle manifest, the fill-in-middle transformation and SentencePiece: plain recomputation, the library, and their defined cases."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import fim, manifest, pieces, queries

P = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cur = duck.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    assert columns == sorted(df.columns)
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


# --- Merkle manifest
def plain_leaf(values) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and of each leaf what stands left and right of its way up."""
    paths, level, at = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % 8 : p - p % 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at[i] = p // 8
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows) -> list[tuple]:
    """rows of (grp, key, leaf, other)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = list(dict.fromkeys(r[0] for r in order))
    trees = {g: plain_tree([r[2] for r in order if r[0] == g]) for g in groups}
    root, over = plain_tree([trees[g][0] for g in groups])
    out, seen = [], dict.fromkeys(groups, 0)
    for g, key, h, other in order:
        path = trees[g][1][seen[g]] + over[groups.index(g)]
        seen[g] += 1
        folded = other
        for a, b in path:
            folded = sha(a, folded, b)
        out.append((key, h, trees[g][0], root, sha(*(a + b for a, b in path)), folded))
    return out


def leaves(df):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = manifest.leaf(*columns[:-1], manifest.lowered(F.col("text")))
    return df.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), manifest.leaf(*columns).alias("h"), F.when(changed, other).otherwise(manifest.leaf(*columns)).alias("other"))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_against_plain_trees(spark, documents, odd, levels):
    for df in (documents, odd):
        found = manifest.proofs(leaves(df), ["key"], levels)
        rows = []
        for r in df.collect():
            values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
            h = plain_leaf(values)
            text = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            rows.append((r["lang"], r["doc_id"], h, plain_leaf([*values[:-1], text]) if changed else h))
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_does_not_depend_on_partitions(spark, odd):
    both = [sorted(map(repr, manifest.proofs(leaves(odd.repartition(n)), ["key"], 1).collect())) for n in (1, 7)]
    assert both[0] == both[1]


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 100])
def test_manifest_of_one_group(spark, n):
    rows = [("g", i, sha(str(i)), sha(str(i))) for i in range(n)]
    found = manifest.proofs(spark.createDataFrame(rows, "grp string, key long, h string, other string"), ["key"], 1)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(plain_manifest(rows))
    assert all(r[5] == r[3] == r[2] for r in got)
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_manifest_of_an_empty_table(spark, empty):
    assert manifest.proofs(leaves(empty), ["key"]).count() == 0


# --- fill in the middle
@pytest.mark.parametrize("text", ["", "a", "äöü", "日本語 and some", "😀" * 300, "x" * 5000, "é" + "a" * 2000 + "😀" * 700])
def test_elias_fano_lists(text):
    data = text.encode()
    packed = fim.elias_fano(fim.boundaries(np.frombuffer(data, np.uint8)), len(data))
    assert fim.length(packed) == len(text)
    assert [fim.select(packed, i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_elias_fano_with_low_bits():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << 30, 2000))
    packed = fim.elias_fano(values, 1 << 30)
    assert [fim.select(packed, i) for i in range(len(values))] == values.tolist()
    assert len(packed) < 2000 * 23 / 8 + 2000


def plain_cut(key, text):
    n, h = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def marked(spark, odd):
    more = [(100 + i, t, "en", "a", 1) for i, t in enumerate(["<P>", "a <S> b", "<M", "<P<P", "S>", "<<<", "日本語テキスト", "😀😀😀 é"] * 20)]
    return odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))


def test_cuts_against_slices(documents, marked):
    for df in (documents, marked):
        want = sorted((repr(r["doc_id"]), *plain_cut(r["doc_id"], r["text"] or ""), r["text"] or "") for r in df.collect())
        got = sorted((repr(r["doc_id"]), *tuple(r)[1:5], bytes(r["output"]).decode(), bytes(r["restored"]).decode()) for r in fim.transform(df).collect())
        assert got == want


def test_digests_are_those_of_the_outputs(documents):
    cuts = sorted((r["doc_id"], sha(bytes(r["output"]).decode())) for r in fim.transform(documents).collect())
    assert cuts == sorted((r["doc_id"], r["output_sha256"]) for r in fim.digests(documents).collect())


def test_texts_of_one_digest_are_told_apart(marked):
    want = sorted(map(repr, fim.transform(marked).collect()))
    assert sorted(map(repr, fim.transform(marked, digest=lambda t: F.encode((F.length(t) % 3).cast("string"), "UTF-8")).collect())) == want


def test_index_has_a_row_a_text(documents):
    twice = documents.union(documents).select(F.lit(0).alias("bucket"), fim.digest(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    index = fim.text_index(twice)
    assert index.count() == documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert index.agg(F.sum("copies")).first()[0] == 2 * documents.count()


def test_hot_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fim, "COPIES", 16)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("one text of many documents")).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    got = sorted((r["doc_id"], *tuple(r)[1:5], bytes(r["output"]).decode()) for r in fim.transform(df).collect())
    assert got == sorted((r["doc_id"], *plain_cut(r["doc_id"], r["text"])) for r in df.collect())


def test_cuts_of_an_empty_table(empty):
    assert fim.transform(empty).count() == 0 and fim.digests(empty).count() == 0


# --- SentencePiece
@pytest.fixture(scope="module")
def model():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    odd = ["", " ", "   a  b ", "▁", "▁x ▁▁", "<s> </s> <unk> <0x41>", "\x00 \x01\t\n", "漢字かな混じり文" * 40, "é😀😀 ́x", "a" * 999, "".join(chr(r.randrange(1, 0x2FF)) for _ in range(3000)), "".join(r.choice("abcdefgh<>/s0x41") for _ in range(9000))]
    return odd + [" ".join("".join(r.choice("eastnoi \n.-_,éàß") for _ in range(r.randrange(1, 90))) for _ in range(30)) for _ in range(60)]


def library(model, texts):
    s = pieces.vocabulary(model).library
    return [s.encode(t, add_bos=True, add_eos=True) for t in texts]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["key", "text"])


def test_ids_are_the_library_s(model, texts):
    found = list(pieces.encode_batches(iter([batch(texts), batch(texts[::-1])]), model))
    got = [x for b in found for x in b.column(1).to_pylist()]
    assert got == library(model, texts) + library(model, texts[::-1])
    assert all(all(b.column(2).to_pylist()) for b in found)


def test_whole_texts_as_units(model, texts):
    ids, at, ok = pieces.by_texts(pieces.vocabulary(model), texts)
    assert ok.all() and [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x[1:-1] for x in library(model, texts)]


def test_heap_and_rows_agree(model, texts):
    v = pieces.vocabulary(model)
    words = sorted({w for t in texts for w in v.library.normalize(t).split(" ") if 0 < len(w) <= pieces.LANE})
    heaps = []
    for w in words:
        left = pieces.agenda(v, v.of_char[np.frombuffer(w.encode("utf-32-le"), "<u4")].tolist())
        heaps.append(pieces.ids_of(v, np.array(left), np.zeros(len(left), np.int64))[0].tolist())
    flat, size = pieces.merged(v, words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == heaps


def test_texts_are_the_library_s(model, texts):
    """Whatever the ids are: encoded texts, cut ones, single bytes, control and unknown ids anywhere."""
    v, r = pieces.vocabulary(model), random.Random(7)
    lists = library(model, texts) + [x[1:-1] for x in library(model, texts)]
    lists += [[r.randrange(0, 32000) for _ in range(r.randrange(0, 9))] for _ in range(3000)] + [[r.randrange(0, 400) for _ in range(r.randrange(0, 9))] for _ in range(3000)]
    lists += [[], [1], [2], [1, 2], [2, 1], [1, 1, 28705], [28705], [1, 28705, 28705, 2], [0], [1, 0, 2]]
    flat = np.array([i for x in lists for i in x], np.int32)
    got = pieces.texts_of(v, flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    assert got.to_pylist() == [v.library.decode(x) for x in lists]


def test_a_wrong_unit_is_marked(model):
    v = pieces.Vocabulary(model)
    v.rank = -v.rank + v.rank.max()  # the worst pair first
    _, _, ok = pieces.by_words(v, ["someone understands everything", "a"])
    assert ok.tolist() == [False, True]


def test_other_models_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    spec.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="merge type"):
        pieces.Vocabulary(spec.SerializeToString())


def test_unknown_characters_without_bytes(model):
    """Without byte pieces, a run of characters that aren't in the vocabulary is one unknown id, as in the library."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    spec.trainer_spec.byte_fallback = False
    for p in spec.pieces:
        if p.type == p.BYTE:
            p.type, p.piece = p.NORMAL, p.piece.replace("<0x", "<byte ")
    small = spec.SerializeToString()
    texts = ["a 😀😀 b", "😀", "plain", "😀x😀😀"]
    v = pieces.Vocabulary(small)
    ids, at, ok = (pieces.by_words if v.by_words else pieces.by_texts)(v, texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == v.library.encode(texts) and ok.all()


def test_encode_decode_and_digests(spark, documents, odd, model):
    for df in (documents, odd):
        encoded = pieces.encode(df, model)
        rows = df.collect()
        want = [(r["doc_id"], ids) for r, ids in zip(rows, library(model, [r["text"] or "" for r in rows]), strict=True)]
        assert sorted(map(repr, [(r["doc_id"], r["ids"]) for r in encoded.collect()])) == sorted(map(repr, want))
        s = pieces.vocabulary(model).library
        assert sorted(map(repr, map(tuple, pieces.decode(encoded, model).collect()))) == sorted(repr((k, s.decode(ids))) for k, ids in want)
        facts = [(k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(s.decode(ids)), True) for k, ids in want]
        assert sorted(map(repr, map(tuple, pieces.digests(df, model).collect()))) == sorted(map(repr, facts))


def test_pieces_of_an_empty_table(empty, model):
    assert pieces.digests(empty, model).count() == 0 and pieces.decode(pieces.encode(empty, model), model).count() == 0
