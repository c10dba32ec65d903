"""Each operator against brute force on tricky rows, and on an empty table."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import common, katz, kneser_ney, minhash, mixing, packing, quality, simhash, sstable, substrings, tokens
from pagemill.llm.components import connected_components

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(200 + k, 201 + k) for k in range(40)] + [(5, 5)]
    pairs = {(a, b) for a, b in edges}
    want = brute.components({x for e in edges for x in e}, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_mixing(tricky, tricky_rows, nothing):
    plan = mixing.mix_plan(tricky).collect()
    again = mixing.mix_plan(tricky).collect()
    assert Counter(plan) == Counter(again) and len(plan) == len(tricky_rows)
    sizes = Counter()
    for r in tricky_rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute.targets(sizes)
    taken = Counter()
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    largest = {s: max(len(brute.words(r[1])) for r in tricky_rows if r[3] == s) for s in sizes}
    # half of a document of its own, and its share of what all sources miss
    miss = sum(largest.values()) / 2 / sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + miss * want[s] + 1
    own = Counter({(r["id"], r["row_key"]): 0 for r in plan})
    for r in plan:
        own[r["id"], r["row_key"]] += r["copies"]
    assert own == brute.mix(plan, sum(sizes.values()))
    stream = mixing.mix(tricky)
    assert stream.columns == tricky.columns and stream.count() >= sum(r["copies"] for r in plan)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_op1_stream_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice("abbbc")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = {r["id"]: r for r in mixing.mix_plan(docs).collect()}
    stream = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert Counter(stream) == Counter({i: r["copies"] for i, r in plan.items() if r["copies"]})
    seen, times = Counter(), []
    for i in stream:
        times.append(plan[i]["finish"] + seen[i] * plan[i]["source_size"] / plan[i]["target"])
        seen[i] += 1
    assert times == sorted(times)
    # at every point the sources stand near their weights
    done, total = Counter(), 0
    for i, t in zip(stream, times, strict=True):
        done[plan[i]["source"]] += plan[i]["size"]
        total += 1
        if total > 100:
            assert all(abs(done[s] - t * next(r["target"] for r in plan.values() if r["source"] == s)) <= 80 for s in "abc")


def test_op2_packing(tricky, tricky_rows, nothing):
    tok = Tokenizer.from_file(WORDS)
    rows = packing.pack(tricky, WORDS, batch_tokens=5000).collect()
    ids = defaultdict(list)
    for r in tricky_rows:
        ids[r[0]].append(np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        own = ids[doc][0]
        assert sum(p["length"] for p in pieces) == len(own) * len(ids[doc])
        for p in pieces:
            assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        if len(ids[doc]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0 and all(p["tier"] == at for p in pieces)
    steps = Counter()
    for key, pieces in by_seq.items():
        steps[pieces[0]["step_group"]] += pieces[0]["tier"]
    assert max(steps.values()) <= 32_768
    assert packing.pack(nothing, WORDS).count() == 0


def test_op3_simhash(tricky, tricky_rows, nothing):
    got = simhash.simhash_components(tricky, shingle=3).collect()
    fps = {(r[0], r[1]): brute.simhash(r[1]) for r in tricky_rows}
    first = {}
    for (i, _), fp in fps.items():
        first[fp] = min(x for x in (first.get(fp), i) if x is not None) if i is not None or fp in first else None
    comp = brute.components([f for f in first if first[f] is not None], lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: 1 << 62)
    for f, c in comp.items():
        least[c] = min(least[c], first[f])
    want = Counter((i, fp, least[comp[fp]]) for (i, t, *_), fp in ((r, fps[r[0], r[1]]) for r in tricky_rows))
    assert Counter((r["id"], r["fp"][0] & (1 << 64) - 1, r["component"]) for r in got) == want
    assert simhash.simhash_components(nothing).count() == 0


def test_op3_multi_index_hashing_finds_all_links(spark):
    import random

    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre}
    for base in [centre] + [rng.getrandbits(64) for _ in range(40)]:
        for _ in range(40 if base == centre else 4):
            f = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << b
            prints.add(f)
    rows = list(enumerate(sorted(prints)))
    want = brute.components([i for i, _ in rows], lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count() <= 3)
    df = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in rows], "id long, fp array<long>")
    got = {r["node"]: r["component"] for r in simhash.link_components(df).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_op4_substrings(tricky, tricky_rows, nothing):
    got = substrings.remove_repeats(tricky)
    assert got.columns == [*tricky.columns, "n_removed", "removed_chars"]
    rows = got.collect()
    assert len(rows) == len(tricky_rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    old = {r[0]: r[1] for r in tricky_rows}
    assert text[0] == old[0] and text[3] == old[3] and text[9] == old[9] and text[5] is None and text[11] == old[11]
    assert text[1] == "" and text[12] == "" and text[None] == ""  # copies of 0 and 3; a null id comes last
    assert 60 <= len(text[2].split()) <= 0.2 * len(old[2].split()) + 60 or len(text[2]) < 0.2 * len(old[2])
    seen = set(zip(*(old[9].split()[k:] for k in range(50)), strict=False))
    assert seen & set(zip(*(old[10].split()[k:] for k in range(50)), strict=False))
    assert not seen & set(zip(*(text[10].split()[k:] for k in range(50)), strict=False))
    for i in range(100, 160):
        assert text[i] == old[i]
    assert substrings.remove_repeats(nothing).count() == 0


def test_op4_passages_without_two_whole_clauses(spark):
    import random

    rng = random.Random(5)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    bare, one = " ".join(new(57)), " ".join(new(20)) + ". " + " ".join(new(20)) + ", " + " ".join(new(17))
    a, b, c, d, loop = (" ".join(new(30)) for _ in range(5))
    texts = [f"{a} {bare} {b}.", f"{c} {bare.title()} {d}.", f"{b} x {one} {c}.", f"{d} y {one} {a}.", f"{loop} " * 4, None, " ".join(new(40)), f"{a} {bare} {b}."]
    rows = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    text = [r["text"] for r in rows]
    assert text[0] == texts[0] and text[2] == texts[2] and text[5] is None and text[6] == texts[6] and text[7] == ""
    assert text[1] == f"{c} {d}." and rows[1]["n_removed"] == 1 and rows[1]["removed_chars"] == len(bare) + 1
    runs = lambda t: set(zip(*(t.replace(".", "").replace(",", "").split()[k:] for k in range(50)), strict=False))
    assert not runs(text[2]) & runs(text[3]) and text[3].startswith(f"{d} y ") and text[3].endswith(f"{a}.")
    assert 50 <= len(text[4].split()) < 120


def test_op5_quality(tricky, tricky_rows, nothing):
    got = quality.quality(tricky)
    rows = got.collect()
    want = Counter((r[0], *brute.base_quality(r[1])) for r in tricky_rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert kept[0] and kept[9] and not (kept[13] or kept[14] or kept[15] or kept[5] or kept[4])
    assert {r["doc_id"] for r in got.where("kept").collect()} == {i for i, k in kept.items() if k}
    clean = {r["doc_id"]: r["clean_text"] for r in rows}
    assert clean[5] is None and clean[14] == ""
    assert quality.quality(nothing).count() == 0


def test_op6_minhash(tricky, tricky_rows, nothing):
    rows = minhash.fingerprints_with_edits(tricky).collect()
    order = sorted(tricky_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    a, b = minhash.permutations(128)
    sign = lambda t: minhash.signature(minhash.shingle_hashes(t), a, b)
    want = Counter()
    for k, r in enumerate(order):
        text, onward = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + onward[:half]
        x, y, z = sign(text), sign(new), sign(onward)
        want[r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), x.tobytes().hex(), y.tobytes().hex(), float(np.mean(x == y)), float(np.mean(x == z))] += 1
    assert Counter(tuple(r) for r in rows) == want
    x, y = (set(brute.shingles(t, 5)) for t in (tricky_rows[0][1], tricky_rows[2][1]))
    assert abs(minhash.likeness(sign(tricky_rows[0][1]), sign(tricky_rows[2][1])) - len(x & y) / len(x | y)) < 0.15
    assert minhash.fingerprints_with_edits(nothing).count() == 0


def test_op6_near_duplicates(tricky, tricky_rows, nothing):
    rows = minhash.minhash_components(tricky).collect()
    sets = {r[0]: frozenset(brute.shingles(r[1], 5)) for r in tricky_rows if r[0] is not None}
    like = lambda a, b: sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    want = brute.components(sets, like)
    assert {r["id"]: r["class_id"] for r in rows if r["id"] is not None} == want and len(rows) == len(tricky_rows)
    assert [r["class_id"] for r in rows if r["id"] is None] == [3]
    assert minhash.minhash_components(nothing).count() == 0


def test_op6_links_inside_a_band_with_unlike_ends(spark):
    import random

    rng = random.Random(9)
    new = lambda k, n: [f"{k}{rng.randrange(10**7)}" for _ in range(n)]
    common, base = new("c", 200), new("b", 60)
    ends = [common + new("e", 120) for _ in range(2)]
    inner = [common + base[:30] + [f"z{k}"] + base[31:] for k in range(4)]
    texts = [" ".join(t) for t in (ends[0], *inner, ends[1])]
    rows = minhash.minhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=128).collect()
    assert {r["id"]: r["class_id"] for r in rows} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_op7_shards(spark, tricky, tricky_rows, nothing, tmp_path):
    folder, shards = sstable.write_shards(tricky, BYTE, f"file://{tmp_path}/out")
    rows = sstable.read_shards(spark, folder, shards).orderBy("start").collect()
    tok = Tokenizer.from_file(BYTE)
    at, want = 0, []
    for r in sorted(tricky_rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    found = sstable.lookup(spark, folder, spark.createDataFrame([(12,), (-3,), (999,), (None,), (12,)], "doc_id long"), shards).collect()
    assert Counter(r["doc_id"] for r in found) == {12: 2, -3: 1, None: 1}
    assert next(r["ids"] for r in found if r["doc_id"] == -3) == [*tok.encode(next(r[1] for r in tricky_rows if r[0] == -3), add_special_tokens=False).ids, 2]
    folder, shards = sstable.write_shards(nothing, BYTE, f"file://{tmp_path}/none")
    assert sstable.read_shards(spark, folder, shards).count() == 0


def test_op7_shard_file():
    writer = sstable.ShardWriter()
    rng = np.random.default_rng(2)
    keys = sorted({int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3000)})
    for k in keys:
        writer.add(sstable.key_of(k), np.full(20, k & 0xFFFF, "<u4").tobytes())
    shard = sstable.Shard(writer.finish())
    assert len(shard.blocks) > 2 and shard.n_keys == len(keys) and shard.n_ids == 20 * len(keys)
    assert [sstable.id_of(k) for k, _, _ in shard.entries()] == keys
    assert all(shard.get(sstable.key_of(k)) for k in keys[::50])
    absent = [k + 1 for k in keys if k + 1 not in set(keys)]
    assert not any(shard.get(sstable.key_of(k)) for k in absent[:200])
    assert sum(shard.may_hold(sstable.key_of(k)) for k in absent) < 0.05 * len(absent)


def test_op8_token_counts(tricky, tricky_rows, nothing):
    tok = Tokenizer.from_file(BYTE)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in tricky_rows)
    assert Counter(tuple(r) for r in tokens.token_counts(tricky, BYTE).collect()) == want
    assert tokens.token_counts(nothing, BYTE).count() == 0


def test_op8_whole_tokens():
    whole = tokens.whole_tokens(BYTE)
    tok = Tokenizer.from_file(BYTE)
    assert len(whole) > 30_000 and all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[::500])


ODD = ["", " ", "a  b", "\n\na\r\nb ", "it's we'LL 'quoted'", "naïve Ünïcode ﬁ ½ ² １２", "日本語 한국어 text", "x y z　\x1cq\x85", "<|endoftext|>a <|startoftext|> b", "é ́ ΑΣ ΑΣ. ΟΔΟΣ", "tab\tsep\x0bvt\x0cff", "😀 emoji👍🏽 zwj👩‍👩‍👧", "3.14e-10,000", "a.b,c;d:e!f?", "word... (x) [y] {z}", "﻿bom", "İstanbul I ı"]


RNG = random.Random(4)
MIXED = ["".join(RNG.choice(["a", "word", "É", "\n", " ", "  ", "\t", "\r\n", ".", ",!", "'s", "9", "-"]) for _ in range(RNG.randrange(1, 14))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_segments_encode_as_whole_texts(path):
    tok, own = Tokenizer.from_file(path), tokens.SegmentEncoder(path)
    for text in [*ODD, " ".join(ODD), "\n".join(ODD), *MIXED]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_pre_tokens_count_as_whole_texts():
    tok, own = Tokenizer.from_file(BYTE), tokens.TokenCounter(BYTE, tokens.whole_tokens(BYTE))
    for text in [*ODD, " ".join(ODD), "\n".join(ODD), *MIXED]:
        assert own.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize(("chunk_bytes", "shard_bytes"), [(3000, 20_000), (1 << 23, 1 << 30)])
def test_op9_katz(tricky, tricky_rows, nothing, chunk_bytes, shard_bytes):
    rows = katz.katz_scores(tricky, chunk_bytes=chunk_bytes, shard_bytes=shard_bytes).collect()
    key = lambda r: (r[0] if r[0] is not None else -99, r[1:4], round(r[5], 6))
    want = sorted(((r[0], *k) for r, k in zip(tricky_rows, brute.katz([r[:2] for r in tricky_rows]), strict=True)), key=key)
    got = sorted((tuple(r) for r in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6)
    assert katz.katz_scores(nothing).count() == 0


def test_op10_kneser_ney(spark, tricky, nothing):
    labels = tricky.where("doc_id between 100 and 160").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = kneser_ney.classify(tricky, labels).collect()
    assert len(rows) == tricky.count()
    score = {r["doc_id"]: r["perplexity"] for r in rows}
    kept = {r["doc_id"]: r["kept"] for r in rows}
    clean = sorted(score[i] for i in range(100, 160))
    assert score[14] > clean[-1] and score[15] > clean[-1] and not kept[14] and not kept[15]
    assert sum(kept[i] for i in range(100, 160)) >= 57 and kept[0]
    assert {r["doc_id"]: r["n_words"] for r in rows}[12] == len(brute.words(next(r["text"] for r in tricky.where("doc_id = 12").collect())))
    assert kneser_ney.classify(nothing, labels).count() == 0
    assert all(r["kept"] and r["threshold"] is None for r in kneser_ney.classify(tricky, labels.limit(0)).collect())


def test_op10_thresholds_cover_long_documents(tricky, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TRAIN_CHARS", 700)
    good = tricky.where("doc_id between 100 and 160 or doc_id = 14")
    labels = good.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    used = (F.length("text") <= 700) & (F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(2)) == 0)
    fitted = {r["doc_id"] for r in good.where(used).collect()}
    rows = kneser_ney.classify(tricky, labels).collect()
    left = [(r["lang"], r["perplexity"]) for r in rows if r["doc_id"] is not None and (100 <= r["doc_id"] <= 160 or r["doc_id"] == 14) and r["doc_id"] not in fitted]
    # fewer than 100 rows have their largest value as the quantile
    for lang in (None, "en"):
        own = [p for x, p in left if x == lang]
        (threshold,) = {r["threshold"] for r in rows if r["lang"] == lang}
        prior = kneser_ney.PRIOR_DOCS
        assert threshold == pytest.approx((len(own) * max(own) + prior * max(p for _, p in left)) / (len(own) + prior) * kneser_ney.ROOM)


def test_op10_is_fitted_on_a_whole_fold(spark, monkeypatch):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 0, F.repeat(F.lit("as long as it may be "), 1000)).otherwise(F.format_string("words of text %d", "id")).alias("text"), F.lit("en").alias("lang"))
    fitted, fit = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda trusted: fitted.append({r["doc_id"] for r in trusted.select("doc_id").collect()}) or fit(trusted))
    kneser_ney.classify(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    fold = docs.where(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(2)) == 0)
    assert fitted == [{r["doc_id"] for r in fold.collect()}] and len(fitted[0]) > 450
    assert fold.where(F.length("text") > 20_000).count() > 0


def test_op10_against_brute_force(spark, tricky, tricky_rows):
    texts = [r[1] for r in tricky_rows if r[0] is not None and 100 <= r[0] <= 130]
    perplexity, p3, vocab, histories = brute.kneser_ney(texts)
    model = kneser_ney.fit(tricky.where("doc_id between 100 and 130"))
    rows = kneser_ney.perplexities(tricky.where("doc_id is not null and doc_id <> 12"), model, ["doc_id"]).collect()
    want = {r[0]: perplexity(r[1]) for r in tricky_rows if r[0] is not None and r[0] != 12}
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        assert r["perplexity"] == pytest.approx(want[r["doc_id"]], rel=1e-6)
    for u, v in histories[::40]:
        assert sum(p3(u, v, w) for w in vocab) == pytest.approx(1, abs=1e-9)


def test_op10_in_parts(spark, tricky, tricky_rows, monkeypatch):
    # a table that is not deleted stays on disk while documents are scored
    labels = tricky.where("doc_id between 100 and 160").select("doc_id", F.lit(1).alias("quality"))
    before = common.n_written(spark)
    whole = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(tricky, labels).collect()}
    assert common.n_written(spark) - before == 2 and len(whole) == len({r[0] for r in tricky_rows})
    for name, value in (("CHUNK_BYTES", 3000), ("SHARD_BYTES", 4000), ("ROUND_BYTES", 20_000), ("ROUNDS", 3)):
        monkeypatch.setattr(kneser_ney, name, value)
    perplexity, *_ = brute.kneser_ney([r[1] for r in tricky_rows if r[0] is not None and 100 <= r[0] <= 130])
    model = kneser_ney.fit(tricky.where("doc_id between 100 and 130"))
    assert model["shards"] > 1 and model["pairs"].count() > 1
    rows = kneser_ney.perplexities(tricky.where("doc_id is not null and doc_id <> 12"), model, ["doc_id"]).collect()
    want = {r[0]: perplexity(r[1]) for r in tricky_rows if r[0] is not None and r[0] != 12}
    assert {r["doc_id"]: r["perplexity"] for r in rows} == pytest.approx(want, rel=1e-6)


def test_op10_discounts_of_any_corpus(spark):
    for counts in ([], [1], [1, 1, 2], [2, 2, 3], [1] * 5 + [2] * 9 + [3] * 20, [1] * 50 + [2] * 20 + [3] * 10 + [4] * 6):
        d = kneser_ney.discounts(spark.createDataFrame([(c,) for c in counts], "c long"))
        assert all(0 < x < r for r, x in enumerate(d, 1))
    for n in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 3, 4, 5, 6, 7, 8], [0, 100, 40, 22, 15, 10, 8]):
        d = katz.discounts(n)[1:]
        assert ((d > 0) & (d < 1)).all()


def test_op4_against_brute_force(spark, tricky, tricky_rows):
    rng = random.Random(12)
    new = lambda n: " ".join(f"v{rng.randrange(10**7)}" for _ in range(n))
    line = lambda: f"{new(rng.randrange(4, 14))}{rng.choice('.!?')} "
    shared, glued, loop = ["".join(line() for _ in range(6)) for _ in range(4)], [new(60) for _ in range(3)], new(30)
    docs = []
    for k in range(40):
        parts = [line() for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([*shared, *glued, shared[0].upper(), loop + " " + loop + " " + loop]))
        docs.append((None if k == 20 else k // 2 if k > 30 else k, "".join(parts)))
    docs = list(dict.fromkeys([*docs, (77, None), (78, ""), (79, "  ")]))
    rows = substrings.remove_repeats(spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, was string").repartition(4)).collect()
    want = brute.without_repeats(docs)
    assert {(r["doc_id"], r["was"]): r["text"] for r in rows} == want
    assert sum(a != b[1] for b, a in want.items()) > 15


CLASHES = ["row", "q", "id", "key", "text_", "kept", "n_words", "clean_text", "n_removed", "_key", "_finish", "_row_key", "_id", "finish", "group", "node", "doc", "d", "k", "touched", "source_size", "copies", "size", "plan_id", "i", "n", "_text", "_ident", "ranges"]


def test_stages_with_clashing_names(spark, tricky):
    import corpus_pipeline as cp

    docs = tricky.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES], name
        docs = docs.cache()
        for r in docs.collect():
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}-{r['doc_id']}") for c in CLASHES), name
    assert cp.STAGES[-1][1](spark, docs, "").count() > 0


def test_near_dedup_keeps_rows_not_ids(spark):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{k}{x}" for x in range(80)) for k in "abc")
    rows = [(1, a), (1, b), (2, a), (None, c), (5, c), (None, a), (None, a), (9, None), (None, ""), (7, b), (7, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, "").collect()) == Counter([(1, a), (1, b), (5, c), (9, None)])


def test_op3_null_ids_link(spark):
    base = "x y z"
    rows = [(5, base), (None, base), (None, None), (None, "p q r s")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3).collect()
    assert Counter((r["id"], r["component"]) for r in got) == Counter([(5, 5), (None, 5), (None, None), (None, None)])


def test_op10_model_is_normalised(spark, tricky):
    texts = tricky.where("doc_id between 100 and 130")
    model = kneser_ney.fit(texts)
    words = model["words"].collect()
    assert sum(r["p"] for r in words if r["w"] != kneser_ney.START) == pytest.approx(1, abs=1e-9)
    first = sum(r["q"] for r in model["pairs"].collect())
    assert first > 0
