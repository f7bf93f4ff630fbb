"""The other operators: exact round trips, brute force and held-out accuracy, and their defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat, decontam, langid, lm_score, media, mixing, quality, token_store
from spindrift.llm.common import crc32_text, staged
from spindrift.llm.token_store import Store

P = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


# --- token store
def expected_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in rows]


def test_store_round_trip(spark, documents, odd):
    for df in (documents, odd):
        store = Store.write(df, P.path("word_bpe_49k.json"))
        rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0], r[1] or 0))
        want, at = [], 0
        for (_, i, _), ids in zip(rows, expected_ids([t for _, _, t in rows]), strict=True):
            want.append((i, at, ids))
            at += len(ids)
        got = sorted(((r["doc_id"], r["start"], r["ids"]) for r in store.read().collect()), key=lambda r: r[1])
        assert got == want
        facts = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in store.facts().collect()), key=lambda r: r[1])
        assert facts == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want]
        assert all(r["ok"] for r in store.verify().collect())


def test_equal_chunks_are_stored_once(spark, documents):
    store = Store.write(documents.union(documents.withColumn("doc_id", F.col("doc_id") + 1000)), P.path("word_bpe_49k.json"))
    chunks = store.table("chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    assert chunks.count() < store.table("recipes").select(F.explode("addresses")).count() / 1.9


@pytest.mark.parametrize(
    ("name", "change", "error"),
    [
        ("chunks", lambda df: df.withColumn("ids", F.concat("ids", F.lit(b"\x05\x00"))), "damaged"),
        ("chunks", lambda df: df.limit(0), "missing"),
        ("recipes", lambda df: df.withColumn("addresses", F.reverse("addresses")), "differ"),
        ("recipes", lambda df: df.where("start > 0"), "differ"),
        ("recipes", lambda df: df.withColumn("doc_id", F.col("doc_id") + 1), "differ"),
        ("manifest", lambda df: df.withColumn("root", F.unhex(F.sha2("root", 256))), "differ"),
    ],
)
def test_damage_is_found(spark, odd, name, change, error):
    store = Store.write(odd, P.path("word_bpe_49k.json"))
    broken = Store(spark, store.path + "-bad")
    for table in ("chunks", "recipes", "manifest"):
        broken._put(change(store.table(table)) if table == name else store.table(table), table)
    for read in (broken.facts, broken.read):
        with pytest.raises(Exception, match=error):
            read().collect()


def test_store_of_empty_table(spark, empty):
    store = Store.write(empty, P.path("word_bpe_49k.json"))
    assert store.facts().count() == store.read().count() == store.verify().count() == 0


def test_crc_of_joined_parts():
    rng = random.Random(0)
    parts = [rng.randbytes(rng.randint(0, 50)) for _ in range(8)]
    assert token_store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_words_with_special_strings(spark):
    texts = ["a|b | c", "<|endoftext|> x", "it's 100% fine's", "é   x\x1cy", "| | |", "don't||stop"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["ids"] for r in Store.write(df, P.path("word_bpe_49k.json")).read().orderBy("start").collect()]
    assert got == expected_ids(texts)


# --- media
def test_media_round_trip(odd):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.features(media.store(odd.sparkSession, odd)).collect()}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        got = rows[r["doc_id"], len(raw)]
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got["tail_crc32"] == zlib.crc32(payload[-64:])
        with wave.open(BytesIO(media.to_wav(payload))) as w:
            assert (w.readframes(w.getnframes()), w.getsampwidth()) == (payload, 1)
        assert got["media_bytes"] == len(payload) + 44


def test_fingerprint_of_a_tone():
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    codes = media.fingerprint(tone)
    assert len(codes)
    assert {int(c >> 9 & 127) for c in codes} & {20}
    assert len(media.fingerprint(np.full(500, 128, np.uint8))) == 0


def test_fingerprint_equals_plain_transform():
    """Peaks and pairs by the definition of the discrete Fourier transform, short payloads included."""
    rng = np.random.default_rng(0)
    for size in (64, 256, 320, 704):
        samples = rng.integers(97, 123, size).astype(np.uint8)
        n = 1 + max(0, -(-(size - media.FRAME) // media.HOP))
        tops = []
        for f in range(n):
            frame = [float(samples[i]) - 128 if i < size else 0.0 for i in range(f * media.HOP, f * media.HOP + media.FRAME)]
            x = np.array(frame) * media.WINDOW
            power = [abs(np.sum(x * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME))) ** 2 for k in range(media.FRAME // 2 + 1)]
            maxima = [k for k in range(1, media.FRAME // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1]
            tops.append([*sorted(maxima, key=lambda k: (-power[k], k))[:2], 0, 0][:2])
        want = [(f << 16) | (a << 9) | (b << 2) for f, (a, b) in enumerate(tops) if a and b]
        want += [(f << 16) | (tops[f][k] << 9) | (tops[f + d][0] << 2) | d for d in (1, 2) for f in range(n - d) for k in (0, 1) if tops[f][k] and tops[f + d][0]]
        assert media.fingerprint(samples).tolist() == sorted(want)
        assert want


def test_media_of_empty_table(spark, empty):
    assert media.features(media.store(spark, empty)).count() == 0


# --- quality
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    fold = crc32_text(F.col("doc_id")) % 5
    stats = staged(spark, quality.statistics_of(docs), "t")
    train = stats.join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    scored = quality.score(stats, quality.fit(train.where(fold != 0), fold == 4)).join(labels, "doc_id").where(fold == 0)
    right = scored.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93


def test_quality_defined_cases(odd, empty):
    stats = quality.statistics_of(odd)
    scores = quality.score(stats, None).collect()
    assert len(scores) == odd.count()
    assert {r["score"] for r in scores} == {0.5}
    assert quality.statistics_of(empty).count() == 0
    assert quality.isotonic(np.array([0.5, 0.2, 0.9, 0.8]), np.ones(4)).tolist() == pytest.approx([0.35, 0.35, 0.85, 0.85])


# --- language
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc32_text(F.col("doc_id")) % 4 == 2
    found = langid.predict(docs, langid.fit(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_defined_cases(odd, empty):
    model = langid.fit(odd, F.lit(True))
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(odd, model).collect()]
    assert len(got) == odd.count()
    for i, lang, score, rejected in got:
        assert (lang == "und") == (i in (3, 4, 5, 7))
        assert 0 <= score <= 1
        if lang == "und":
            assert (score, rejected) == (0.0, True)
    kept = langid.keep_accepted(odd, model)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 8, 9, 10, None}
    assert langid.predict(odd, langid.fit(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0


def test_foreign_scripts_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, crc32_text(F.col("doc_id")) % 4 != 2)
    rng = random.Random(5)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400))
    junk = [letters, base64, "это обычный русский текст о погоде и природе, который никто не ждал " * 3, "这是一个关于天气和自然的普通中文文本没有人期待它" * 4]
    clean = [" ".join(r["text"].split()[:n]) for r in docs.where("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(40).collect() for n in (3, 10, 40)]
    df = spark.createDataFrame(list(enumerate(junk + clean)), "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.keep_accepted(df, model).collect()}
    assert not kept & set(range(len(junk)))
    assert len(kept) >= 0.98 * len(clean)


SENTENCES = [
    "a kutya gyorsan fut a nagy erdo mellett es mindenki latja hogy szep az ido ma reggel a hegyek felett", "dzisiaj rano poszedlem do sklepu i kupilem chleb oraz mleko dla calej mojej rodziny ktora czekala w domu",
    "tanaan aamulla kavelin metsassa ja naein monta lintua jotka lauloivat kauniisti puiden oksilla koko paivan", "gallia est omnis divisa in partes tres quarum unam incolunt belgae aliam aquitani tertiam qui ipsorum lingua celtae",
]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_rejection_holds_at_each_size(spark, size):
    """At most a twentieth of each kind of junk is accepted, over 60 seeds a kind and length, no other language, and at most a fiftieth of pieces of held-out documents is rejected."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    held = crc32_text(F.col("doc_id")) % 4 == 2
    model = langid.fit(docs, ~held)
    texts: dict[str, list[str]] = {"foreign": SENTENCES}
    for n in (15, 60, 200):
        rngs = [random.Random(1000 * n + seed) for seed in range(60)]
        texts[f"letters {n}"] = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for r in rngs]
        texts[f"base64 {4 * n}"] = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4 * n)) for r in rngs]
    kept = [r["text"].split() for r in docs.where(held & F.col("text").isNotNull()).orderBy("doc_id").limit(600).collect()]
    texts |= {f"clean {n}": [" ".join(w[:n]) for w in kept if len(w) >= n] for n in (3, 10, 40, 400)}
    rows = [(k, t) for k, some in texts.items() for t in some]
    found = langid.predict(spark.createDataFrame(rows, "kind string, text string"), model, "kind").groupBy("kind").agg(F.avg(F.col("rejected").cast("int")).alias("share"))
    shares = {r["kind"]: r["share"] for r in found.collect()}
    assert all(v <= 0.02 if k.startswith("clean") else v >= 0.95 for k, v in shares.items()), shares


# --- chat
def cheapest(roles):
    """Least cost over all repairs, by exhaustive search."""
    best = {(0, chat.START): 0}
    todo = [(0, 0, chat.START)]
    final = 1 << 30
    while todo:
        cost, at, state = todo.pop()
        if best.get((at, state), 1 << 30) < cost or cost >= final:
            continue
        options = [(cost + chat.INSERT, at, n) for n in chat.NEXT[state]]
        if at < len(roles):
            options += [(cost + chat.RELABEL * (n != roles[at]), at + 1, n) for n in chat.NEXT[state]]
            if roles[at] == state != chat.START:
                options.append((cost + chat.MERGE, at + 1, state))
        elif state in (chat.START, chat.ASSISTANT):
            final = min(final, cost)
        for o in options:
            if o[0] < best.get((o[1], o[2]), 1 << 30):
                best[o[1], o[2]] = o[0]
                todo.append(o)
    return final


def test_repairs_are_cheapest_and_legal():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            for size in (1, 2, 9):
                blocks = [list(roles[i : i + size]) for i in range(0, n, size)]
                path, total = chat.block_states([chat.block_costs(b) for b in blocks])
                assert total == cheapest(roles)
                state, paid = chat.START, 0
                for k, (b, (entry, exit_)) in enumerate(zip(blocks, path, strict=True)):
                    assert entry == state
                    for role, action, _ in chat.repair_block(b, ["t"] * len(b), entry, exit_, k == len(blocks) - 1):
                        to = chat.ROLES.index(role) + 1
                        paid += {"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "insert": chat.INSERT}[action]
                        assert to == state if action == "merge" else to in chat.NEXT[state]
                        state = to
                assert (paid, state) == (total, chat.ASSISTANT)


def test_chats_are_rendered(spark, monkeypatch):
    rows = [("c", 0, "user", "hi"), ("c", 1, "user", "there"), ("c", 2, "bot", "yes"), ("d", None, None, None), (None, 3, "assistant", "x"), ("e", 1, "system", "s"), ("e", 2, "user", "q"), ("e", 3, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    for block in (512, 1):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = chat.format_chats(df).orderBy("block", "index").collect()
        text = lambda c: "".join(r["rendered"] for r in got if r["conv_id"] == c)
        assert text("c") == "<|user|>\nhi\nthere<|end|>\n<|assistant|>\nyes<|end|>\n"
        assert text("e") == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"
        assert text("d") == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
        assert text(None).endswith("<|end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


# --- mixing
def test_mixing_meets_limit_and_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = mixing.mix_sources(docs, max_repeats=2.0).groupBy("source").agg(F.sum("__mix_tokens").alias("t"), F.countDistinct("doc_id").alias("d")).collect()
    have = {r["source"]: (r["t"], r["n"], r["m"]) for r in docs.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t"), F.count("*").alias("n"), F.max(mixing.token_count(F.col("text"))).alias("m")).collect()}
    names = sorted(have)
    total = sum(t for t, _, _ in have.values())
    shares = [have[n][0] / total for n in names]
    times = dict(zip(names, mixing.repeats_at(shares, mixing.bisect_alpha(shares, 2.0)), strict=True))
    assert max(times.values()) == pytest.approx(2.0)
    for r in got:
        t, n, most = have[r["source"]]
        assert r["d"] == n
        assert times[r["source"]] * t - most - 1 <= r["t"] <= times[r["source"]] * t + 1


def test_mixing_to_entropy(spark):
    shares = [0.6, 0.3, 0.1]
    entropy = lambda a: -sum(w * np.log(w) for w in mixing.weights_at(shares, a))
    assert entropy(mixing.bisect_alpha(shares, entropy=1.0)) == pytest.approx(1.0, abs=1e-6)
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    assert entropy(mixing.entropy_alpha(df, 1.0)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.entropy_alpha(df, 2.0) == 0.0
    assert mixing.entropy_alpha(df, 0.1) == 1.0


def test_blocks_are_permuted_one_to_one(spark):
    got = spark.range(mixing.BLOCKS).select(*[mixing.permuted(F.col("id"), F.lit(p), F.lit(s), 7).alias(f"{p}{s}") for p in range(3) for s in ("=a", "=b")]).toPandas()
    orders = [got[c].tolist() for c in got]
    assert all(sorted(o) == list(range(mixing.BLOCKS)) for o in orders)
    assert len({tuple(o) for o in orders}) == len(orders)
    assert all(np.mean(np.diff(o) == 1) < 0.01 for o in orders)


def test_mixing_equals_plain_passes(spark):
    """Whole passes have every row; the partial one is the longest prefix, by block and place, within its budget."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.mix_sources(docs, max_repeats=2.7).collect()
    tokens = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in docs.collect()}
    totals = {}
    for s, n in tokens.values():
        totals[s] = totals.get(s, 0) + n
    names = sorted(totals)
    shares = [totals[s] / sum(totals.values()) for s in names]
    for s, times in zip(names, mixing.repeats_at(shares, mixing.bisect_alpha(shares, 2.7)), strict=True):
        own = [r for r in rows if r["source"] == s]
        whole, docs_of = int(times + 1e-9), {d for d, (x, _) in tokens.items() if x == s}
        for p in range(whole):
            assert sorted(r["doc_id"] for r in own if r["__mix_pass"] == p) == sorted(docs_of)
        last = [r["doc_id"] for r in own if r["__mix_pass"] == whole]
        budget = max(0.0, times - whole) * totals[s]
        assert {r["__mix_pass"] for r in own} <= set(range(whole + 1))
        place = {r["doc_id"]: (r["__mix_block"], r["__mix_place"]) for r in own if r["__mix_pass"] == whole}
        used = sum(tokens[d][1] for d in last)
        assert used <= budget + 1
        if last and set(last) < docs_of:
            # the next document in the order of the pass wouldn't fit
            order = spark.createDataFrame([(d,) for d in sorted(docs_of)], "d long").select("d", mixing.permuted(mixing.block_of(F.col("d"), 7), F.lit(whole), F.lit(f"={s}"), 7).alias("b"), mixing.place(F.col("d"), F.lit(whole), 7).alias("p")).collect()
            order = [r["d"] for r in sorted(order, key=lambda r: (r["b"], r["p"]))]
            assert set(order[: len(last)]) == set(last)
            assert used + tokens[order[len(last)]][1] > budget - 1
            assert all(place[d] <= place[order[len(last) - 1]] for d in last)


def test_mixing_defined_cases(odd, empty):
    out = mixing.mix_sources(odd)
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert set(odd.columns) <= set(out.columns)
    assert mixing.mix_sources(empty).count() == 0
    none = odd.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_sources(none).count() == none.count()


# --- decontamination
def test_leaks_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(14, 50)).capitalize() + ".") for i in range(30)]
    near = lambda t, k: decontam.edited(t.encode(), k, np.random.default_rng(k + len(t))).decode("utf-8", "ignore")
    docs, want, tried = [], set(), set()
    for i in range(240):
        if i % 4 == 0:
            j = rng.randrange(30)
            t = items[j][1]
            k = rng.choice([0, 0, round(0.05 * len(t)), round(0.1 * len(t))])
            docs.append((i, f"{prose(40)}\n{near(t.upper() if i % 8 else t, k)}  {prose(30)}"))
            tried.add((i, j))
        else:
            docs.append((i, prose(80)))
    docs += [(900, None), (901, ""), (902, items[3][1])]
    tried.add((902, 3))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(77, None), (78, "")], "item_id long, text string")
    want = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, bench).collect()}
    assert want <= tried
    assert len(want) >= decontam.RECALL * len(tried)
    assert decontam.find(df, bench.limit(0)).count() == decontam.find(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("kind", ["random", "even", "blanks"])
def test_recall_at_each_rate(share, kind):
    """All edits that verification accepts are found: anywhere, at even distances (in every word), and in place of blanks."""
    rng, edits = random.Random(4), np.random.default_rng(8)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)).encode() for n in rng.choices(range(3, 60), k=80)]
    index = decontam.build(list(range(80)), texts)
    change = {"random": decontam.edited, "even": decontam.spaced, "blanks": lambda t, k, _: t.replace(b" ", b"_", k)}[kind]
    copies = [b" ".join([word().encode(), change(t, int(share * len(t)), edits), word().encode()]) for t in texts]
    found = {(d, i) for d, i, *_ in decontam.matches(index, *decontam.joined(copies))}
    assert sum((i, i) in found for i in range(80)) >= 0.95 * 80


def test_short_items_lose_nothing():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in range(1, decontam.LONG)]
    index = decontam.build(list(range(len(texts))), texts)
    copies = [decontam.spaced(t, int(decontam.LIMIT * len(t)), rng) for t in texts]
    found = {(d, i) for d, i, *_ in decontam.matches(index, *decontam.joined(copies))}
    assert all((i, i) in found for i in range(len(texts)))


def test_bound_is_below_the_distance():
    """The sum of the pieces' least distances never exceeds that of the item, and is it for one piece."""
    rng = random.Random(8)
    for _ in range(60):
        item, text = (bytes(rng.choices(b"abcd ", k=rng.randint(1, n))) for n in (200, 260))
        parts = decontam.parts_of([item])
        n = int(parts.first[1])
        data, zero = np.frombuffer(text, np.uint8), np.zeros(n, np.int64)
        got = decontam.least_distances(parts.masks, np.arange(n), parts.size, data, zero, zero + len(text))
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert got.sum() <= min(row)
        if n == 1:
            assert got.sum() == min(row)


def test_decontamination_defined_cases(spark, odd):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    bench = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "item_id long, text string").withColumn("key", F.lit("own"))
    found = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find(odd, bench).collect()]
    assert sorted(found) == [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0)]
    long = spark.createDataFrame([(5, "some words before it " * 9000 + text)] * 2, "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.find(long, bench.where("item_id = 1")).collect()] == [5, 5]


def test_best_place_equals_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = (bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        got = decontam.best_place(a, b, len(a))
        assert got is not None
        assert got[0] == min(row)


# --- LM scoring
def test_lm_learns_both_sides(spark):
    rng = random.Random(1)
    lines = [" ".join(x for _ in range(40) for x in rng.choice([("red", "car", "goes"), ("old", "man", "sings")])) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(900, "red man goes old car sings " * 30), (901, None), (902, ""), (903, " ")], "doc_id long, text string")
    model = lm_score.fit(df.select("text"))
    got = {r["doc_id"]: r for r in lm_score.score(df, model).collect()}
    usual = np.mean([got[i]["mean_log_prob"] for i in range(50)])
    assert usual > got[900]["mean_log_prob"] + 0.2
    assert usual > np.log(1 / 6) + 0.3
    for i in (901, 902, 903):
        assert (got[i]["n_tokens"], got[i]["log_prob"], got[i]["mean_log_prob"]) == (0, 0.0, None)
    assert lm_score.score(df.limit(0), model).count() == 0


def test_lm_scores_equal_plain_softmax():
    vocabulary = lm_score.Vocabulary.of(np.arange(lm_score.BUCKETS, dtype=float))
    vector = lm_score.initial(vocabulary.prior)
    raw = b"One two three two one four"
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 13, len(raw)])
    got, doc = lm_score.token_scores(data, offsets, vocabulary, vector)
    bucket, _ = lm_score.tokens(data, offsets)
    p = lm_score.unpacked(vector)
    for t in range(len(bucket)):
        h = p["bias"].copy()
        for k, o in enumerate(lm_score.OFFSETS):
            inside = 0 <= t + o < len(bucket) and doc[t + o] == doc[t]
            h = h + p["embed"][vocabulary.row[bucket[t + o]] if inside else lm_score.INPUTS] * p["gate"][k]
        c, slot = divmod(vocabulary.row[bucket[t]], lm_score.SLOTS)
        z = np.exp(np.tanh(h) @ p["out"] + p["out_bias"])
        y = np.exp(np.tanh(h) @ p["inner"][c] + p["inner_bias"][c])
        want = np.log(z / z.sum())[c] + np.log(y / y.sum())[slot] + vocabulary.share[bucket[t]]
        assert got[t] == pytest.approx(want, abs=1e-4)


def chains(n, seed, words=400):
    """Texts of more words than classes, each followed by one of two of its own."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        w = [int(rng.integers(words))]
        while len(w) < 60:
            w.append((w[-1] * 7 + int(rng.integers(2))) % words)
        texts.append(" ".join(f"w{x}" for x in w))
    return texts


def test_lm_tells_words_of_a_class_apart_by_context():
    """Of words dealt to shared classes, the held-out text gains over corpus shares, and a swap of words of a class costs."""
    texts, held = chains(3000, 1), chains(50, 2)

    def read(rows):
        raw = [t.encode() for t in rows]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    bucket, doc = lm_score.tokens(*read(texts))
    v = lm_score.Vocabulary.of(np.bincount(bucket, minlength=lm_score.BUCKETS).astype(float))
    row, vector = v.row[bucket], lm_score.initial(v.prior)
    for r in range(lm_score.ROUNDS):
        at = lm_score.masked_at(bucket, doc, len(texts), r)
        vector = lm_score.train(vector, lm_score.contexts(row, doc, at), row[at], lm_score.RATE / (1 + r))
    held_bucket, _ = lm_score.tokens(*read(held))
    unigram = (v.prior[v.row[held_bucket]] + v.share[held_bucket]).mean()
    assert lm_score.token_scores(*read(held), v, vector)[0].mean() > unigram + 0.3
    # within the class alone
    p, at = lm_score.unpacked(vector), np.arange(len(held_bucket))
    _, of = lm_score.tokens(*read(held))
    h = lm_score.hidden(p, lm_score.contexts(v.row[held_bucket], of, at))
    c, slot = v.row[held_bucket] // lm_score.SLOTS, v.row[held_bucket] % lm_score.SLOTS
    inner = np.array([np.log(lm_score.softmax((x @ p["inner"][k] + p["inner_bias"][k])[None])[0, j]) for x, k, j in zip(h, c, slot, strict=True)])
    alone = np.array([np.log(lm_score.softmax(v.prior.reshape(lm_score.CLASSES, -1)[k][None])[0, j]) for k, j in zip(c, slot, strict=True)])
    assert inner.mean() > alone.mean() + 0.1


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TOKENS_A_SHARD", 4000)
    df = spark.createDataFrame(list(enumerate([*chains(200, 3), "", None])), "doc_id long, text string")
    found = []
    for parts in (1, 5):
        dealt = df.repartition(parts, "text")
        found.append({r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in lm_score.score(dealt, lm_score.fit(dealt, "doc_id")).collect()})
    assert found[0].keys() == found[1].keys()
    for i, (n, total) in found[0].items():
        assert found[1][i][0] == n
        assert found[1][i][1] == pytest.approx(total, abs=1e-3 * max(n, 1))


def test_rounds_mask_other_positions_of_every_text():
    rng = np.random.default_rng(6)
    doc = np.repeat(np.arange(40), rng.integers(0, 80, 40))
    bucket = rng.integers(0, lm_score.BUCKETS, len(doc))
    rounds = [lm_score.masked_at(bucket, doc, 40, r) for r in range(lm_score.ROUNDS)]
    for at in rounds:
        assert set(doc[at]) == set(doc)
        assert len(at) >= len(doc) / 20
    assert len(set(np.concatenate(rounds))) > 2 * max(len(at) for at in rounds)


# --- pipeline
def test_pipeline_stages_keep_columns(spark, odd):
    import corpus_pipeline

    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, DIR), name)
        assert docs.columns == odd.columns
    assert {r["doc_id"] for r in docs.collect()} == {1, 6, 8, 9, 10, None}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert len(last) == docs.count()


def test_pipeline_equals_plain_steps(spark):
    """Each stage's kept ids on the driver tables against plain Python."""
    import re

    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    after = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(spark, stage(spark, after, DIR), name)
        seen.append({r["doc_id"]: r["text"] for r in after.collect()})
    from tests.llm.test_dedup import components

    kept = {i for i, _, c in components(list(seen[0].items())) if i == c}
    assert set(seen[1]) == kept
    items = [r["text"].strip() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    plain = lambda t: re.sub(r"\s+", " ", t)
    assert set(seen[2]) == {i for i, t in seen[1].items() if not any(plain(x) in plain(t) for x in items)}
    assert set(seen[3]) == set(seen[2])


@pytest.mark.parametrize("name", ["op7_chat_formatting", "op9_benchmark_decontamination", "op6_quality_classifier"])
def test_registered_queries_run(spark, name):
    from spindrift.llm.queries import QUERIES

    assert QUERIES[name](spark, DIR).count() > 0
