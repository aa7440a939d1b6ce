"""Operators on documents: brute force, exact round trips, edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from agora.llm import bpe_chunks, langid, packing, simhash, suffix_dedup, syncmers, tokens
from agora.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import DOCS, PASSAGE


@pytest.fixture(scope="module")
def real():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_path())


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def small(spark):
    df = table(spark, SMALL, "documents")
    return df, [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]


# ---------------------------------------------------------------- op1
def test_language_held_out_accuracy(spark):
    df, rows = small(spark)
    found = {r["doc_id"]: r for r in langid.identified(df).collect()}
    lang = {d: x for d, _, x in rows}
    assert len(found) == len(rows)
    held = [d for d, r in found.items() if r["held_out"]]
    assert set(held) == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(found[d]["lang_pred"] == lang[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert not any(r["rejected"] for r in found.values())


def test_language_edges(docs, no_docs):
    rows = langid.identified(docs).collect()
    assert len(rows) == len(DOCS)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 and by[d]["rejected"] for d in (3, 4, 5, 6))
    assert by[8]["lang_pred"] == "de" and by[7]["lang_pred"] == "en"
    kept = langid.recognised(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r["score"] for r in kept.collect()} == {0.5}
    assert kept.where("doc_id in (3, 4, 5, 6)").count() == 0
    assert langid.identified(no_docs).collect() == []


def test_language_rejects_what_is_far(spark, stored):
    df, rows = small(spark)
    model = langid.fit(df)
    far = stored([(1, "Быстрая коричневая лиса перепрыгнула через ленивую собаку"), (2, rows[0][1])],
                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.classify(far, model).collect()}
    assert got[1]["rejected"] and not got[2]["rejected"]


def test_nothing_learned(spark, docs):
    rows = langid.classify(docs.select("doc_id", "text"), None).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}


# ---------------------------------------------------------------- op2
def test_fingerprints_against_plain_python(spark):
    df, rows = small(spark)
    rows.sort(key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in syncmers.fingerprinted(df).collect()}
    assert len(got) == len(rows)
    prints = {}
    for (d, a, _), (_, b, _) in zip(rows, rows[1:] + rows[:1]):
        k = len(a) // 3
        edited = a[:len(a) - k] + b[:k]
        r = got[d]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == _sha(edited.encode())
        assert prints.setdefault(a, r["fingerprint"]) == r["fingerprint"]
        one, two, nxt = syncmers.anchors([a, edited, b])
        assert r["fingerprint"] == syncmers.written(one)
        assert r["edited_fingerprint"] == syncmers.written(two)
        assert r["near_edited"] == syncmers.likeness(one, two)
        assert r["near_next"] == syncmers.likeness(one, nxt)
    long_ = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > max(0.4, r["near_next"]) for r in long_]) > 0.97


def test_closed_syncmers_by_definition():
    text = "".join(random.Random(5).choice("abcdé 漢.") for _ in range(500))
    small_, big = syncmers._joined_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    width = syncmers.K - syncmers.S + 1
    want = [big[i] for i in range(len(text) - syncmers.K + 1)
            if min(small_[i:i + width]) in (small_[i], small_[i + width - 1])]
    assert syncmers.anchors([text])[0].tolist() == want
    # equal strings hash alike wherever they stand, and long texts are cut without loss
    assert syncmers.anchors(["xyz " + text])[0].tolist()[-len(want) + 5:] == want[5:]


def test_long_text_in_segments(monkeypatch):
    text = " ".join(f"w{i}" for i in range(4000))
    whole = syncmers.anchors([text])[0]
    monkeypatch.setattr(syncmers, "BATCH_CHARS", 1000)
    assert (syncmers.anchors([text])[0] == whole).all()


def test_likeness():
    a = np.array([1, 2, 3, 4, 2], np.uint32)
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, a[:0]) == 0
    assert syncmers.likeness(a[:0], a[:0]) == 1
    assert syncmers.likeness(np.array([1, 2, 3], np.uint32), np.array([3, 1, 2], np.uint32)) == pytest.approx(2 / 3)


def test_fingerprint_edges(docs, no_docs, stored):
    rows = syncmers.fingerprinted(docs).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(d for d, *_ in DOCS)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["fingerprint"] == "" and by[3]["n_chars"] == 0
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != ""
    assert syncmers.fingerprinted(no_docs).collect() == []
    alone = syncmers.fingerprinted(stored([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert alone[0]["edited_sha256"] == _sha(b"abcdab")


# ---------------------------------------------------------------- op3
def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def _plain_components(items, near):
    """items: (id, key); smallest id reachable."""
    label = list(range(len(items)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if near(items[i][1], items[j][1]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(items))]


def _compare_simhash(df, rows):
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"])
                              for r in simhash.near_duplicates(df).collect())
    items = [(d, _plain_fingerprint(t)) for d, t in rows]
    comps = _plain_components(items, lambda a, b: bin(a ^ b).count("1") <= 4)
    want = collections.Counter((d, f"{f:016x}", c) for (d, f), c in zip(items, comps))
    assert got == want


def test_simhash_against_brute_force(spark):
    df, rows = small(spark)
    _compare_simhash(df, [(d, t) for d, t, _ in rows])


def test_simhash_edges(docs, no_docs):
    _compare_simhash(docs, [(d, t) for d, t, _ in DOCS])
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10, 11, 12] and ids.count(None) == 1


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains, dense balls and crowded cells, all against brute force."""
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            x = y if rng.random() < 0.5 else x
            fps.add(y)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << b) for b in range(64)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "PART", 16)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from agora.llm.components import components
    df = spark.createDataFrame(signed, "fp long")
    got = {r["id"]: r["component"] for r in components(simhash.links(df), "a", "b").collect()}
    want = _plain_components([(s[0], f) for s, f in zip(signed, fps)], lambda a, b: bin(a ^ b).count("1") <= 4)
    assert [got.get(s[0], s[0]) for s in signed] == want


# ---------------------------------------------------------------- op4
def _check_pieces(rows, texts, real):
    ids = {d: real.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts}
    want = set()
    for d, x in ids.items():
        first = len(x) if len(x) <= 1024 else len(x) % 1024 or 1024
        edges = [0, *range(first, len(x) + 1, 1024)]
        want |= {(d, i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))
                 for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), -(-sum(map(len, ids.values())) // 1024)


def test_packing_documents(spark, real):
    df, rows = small(spark)
    used, least = _check_pieces(packing.pack_documents(df).collect(), [(d, t) for d, t, _ in rows], real)
    assert used <= least * 1.03 + 2


def test_packing_edges(docs, no_docs, real):
    rows = packing.pack_documents(docs).collect()
    texts = {d: t for d, t, _ in DOCS}
    _check_pieces([r for r in rows], list(texts.items()), real)
    count = collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert count == collections.Counter(d for d, *_ in DOCS)
    assert packing.pack_documents(no_docs).collect() == []


@pytest.mark.parametrize("lengths", [
    [1024] * 5, [600] * 7, [1] * 3000, [512, 512, 1024, 1], [1000, 24, 24, 1000, 3],
    [random.Random(1).randint(1, 1024) for _ in range(5000)],
    [random.Random(2).choice([341, 342, 340, 1, 700]) for _ in range(2000)]])
def test_fillings_hold_exactly_the_pieces(lengths):
    plan = packing.solve(collections.Counter(lengths))
    held = collections.Counter()
    for filling, times in plan:
        assert times > 0 and sum(s * k for s, k in filling) <= 1024
        for s, k in filling:
            held[s] += k * times
    assert held == collections.Counter(lengths)
    best_fit, rooms = 0, []
    for s in sorted(lengths, reverse=True):  # plain best fit, largest first
        fit = min((r for r in range(len(rooms)) if rooms[r] >= s), key=lambda r: rooms[r], default=None)
        if fit is None:
            rooms.append(1024 - s)
        else:
            rooms[fit] -= s
    assert sum(n for _, n in plan) <= len(rooms) * 1.01 + 1


# ---------------------------------------------------------------- op5
def _plain_removed(texts, depth=200):
    seen = collections.Counter(b[i:i + depth] for b in texts for i in range(len(b) - depth + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), runs, _sha(kept)))
    return out


def _compare_repeats(df, rows, **kw):
    got = collections.Counter(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(df, **kw)).collect())
    plain = _plain_removed([(t or "").encode() for _, t in rows], kw.get("depth", 200))
    assert got == collections.Counter((d, *p) for (d, _), p in zip(rows, plain))


def test_repeats_against_brute_force(spark):
    df, rows = small(spark)
    _compare_repeats(df, [(d, t) for d, t, _ in rows])


def test_repeats_edges(docs, no_docs):
    _compare_repeats(docs, [(d, t) for d, t, _ in DOCS])
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_repeats_of_hard_texts(stored, monkeypatch):
    """Runs of one byte, shifted copies, windows repeated at one place only, and segments."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abéc ") for _ in range(n))
    a, b, c = word(900), word(700), word(250)
    texts = ["x" * 600, "x" * 150, "xy" * 300, a, "1" + a[:450] + "2" + a[450:], b[100:350] + c, c[:230] + b[100:340],
             a[200:401], a[100:250] + b[:199], c + c, "z" * 199, "", None, a, word(5000)]
    rows = list(enumerate(texts))
    _compare_repeats(stored(rows, "doc_id long, text string"), rows)
    monkeypatch.setattr(suffix_dedup, "BATCH_CHARS", 333)
    _compare_repeats(stored(rows, "doc_id long, text string"), rows)


def test_repeats_of_great_depth(stored):
    """Stretches of more than 255 windows."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abéc ") for _ in range(n))
    a, b = word(3000), word(1500)
    texts = [a, "1" + a[:1900] + "2" + a[1900:], b[100:1350] + a[50:1200], word(40) + b, "x" * 2500, a[700:2000] + b[:1300], ""]
    rows = list(enumerate(texts))
    for depth in (318, 400, 900):
        _compare_repeats(stored(rows, "doc_id long, text string"), rows, depth=depth)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(stored(rows, "doc_id long, text string"), depth=1 << 17)


def test_without_repeats_keeps_rows_and_characters(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    by = {r["doc_id"]: r for r in out.collect()}
    assert PASSAGE[:180] not in by[10]["text"] and by[10]["text"].startswith("Erster Satz.")
    assert by[3]["text"] is None and by[8]["text"] == dict((d, t) for d, t, _ in DOCS)[8]
    assert all(r["n_chars"] == len(r["text"] or "") and "�" not in (r["text"] or "") for r in by.values())


# ---------------------------------------------------------------- op6
def _check_ids(rows, texts, real):
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = collections.Counter()
    for d, t in texts:
        ids = real.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), _sha(np.array(ids, "<u4").tobytes()),
             _sha(real.decode(ids, skip_special_tokens=False).encode())] += 1
    assert got == want


def test_bpe_against_the_library(spark, real, docs, no_docs):
    df, rows = small(spark)
    _check_ids(bpe_chunks.digests(bpe_chunks.encoded(df)).collect(), [(d, t) for d, t, _ in rows], real)
    _check_ids(bpe_chunks.digests(bpe_chunks.encoded(docs)).collect(), [(d, t) for d, t, _ in DOCS], real)
    assert bpe_chunks.encoded(no_docs).collect() == []


def test_any_cut_is_repaired(real):
    with open(tokens.default_path(), "rb") as f:
        codec = tokens.Codec(f.read())
    rng = random.Random(3)
    parts = ["hello world ", "  \n\n", "<|endoftext|>", "é̀ñ漢字 ", "it's we'll ", "aaaa", " 123 ", "\t", "!!! ", "　",
             "x", "<|endof", "text|>", "a'sb", "🎉"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        ids = real.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == real.decode(ids, skip_special_tokens=False)
        edges = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(20))}) if text else [0]
        known = {i: codec.encode(text[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if i % 2}
        assert bpe_chunks.stitched(text, edges, known, codec.encode) == ids
        # ids that do not agree are found out and encoded again
        wrong = {i: [1, *x] for i, x in known.items()}
        if len(edges) > 2:
            again = bpe_chunks.stitched(text, edges, wrong, codec.encode)
            assert codec.decode(again) is not None


@pytest.mark.parametrize("text", [" " * 70000 + "a", "a" * 100000, "ab " * 60000, "\n" * 3000, "é" * 40000])
def test_very_long_runs(real, text):
    with open(tokens.default_path(), "rb") as f:
        codec = tokens.Codec(f.read())
    ids = real.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert bpe_chunks.stitched(text, bpe_chunks.cuts(text), {}, codec.encode) == ids


def test_chunks_follow_content():
    text = " ".join(f"w{i * i % 1009}" for i in range(5000))
    a, b = bpe_chunks.cuts(text), bpe_chunks.cuts("shifted " + text)
    assert len(set(x + 8 for x in a) & set(b)) > 0.8 * len(a)
