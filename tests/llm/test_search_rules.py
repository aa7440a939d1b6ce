"""Lexical search, spelling variants and quality rules: brute force and edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agora.llm import bloom, lexical, quality_rules, queries, spelling
from agora.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import DOCS

DOC_SCHEMA = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- filter
def test_filter_passes_every_key(spark):
    keys = [(i * 7919 - 5_000_000,) for i in range(3000)] + [(None,)]
    held = bloom.build(spark.createDataFrame(keys, "k long"), bits=20)
    assert bloom.passes(held.value, np.array([k for k, in keys[:-1]])).all()
    assert bloom.passes(held.value, np.arange(10**9, 10**9 + 10_000)).mean() < 0.01
    assert not bloom.passes(bloom.build(spark.createDataFrame([], "k long"), bits=20).value, np.arange(100)).any()


# ---------------------------------------------------------------- op11
def ranks_of(docs, items, top=lexical.TOP):
    """The contract, item by item and document by document."""
    split = lambda t: re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, collections.Counter(split(t))) for d, t in docs if split(t)]
    total = sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * len(own)) // total
            s = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(scores[:top], 1)]
    return out


def found_ranks(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_is_the_contract(docs, stored):
    items = [(1, "The QUICK fox, the lazy dog"), (2, "der Hund über naïve 漢字 a"), (3, None), (4, ""), (5, "zzz"),
             (None, "word1 and1 passage"), (7, "a a a b"), (7, "a a a b")]
    found = lexical.ranked(docs, stored([(i, t, 1) for i, t in items], "item_id long, text string, score int"))
    assert found_ranks(found) == sorted(ranks_of([(d, t) for d, t, _ in DOCS], items), key=str)


def test_search_prunes_without_loss(spark, stored, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i % 150, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice((1, 5, 40)))), "en")
            for i in range(400)] + [(1000 + i, "same words in each copy w3 w3 w9", "en") for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(40)]
    monkeypatch.setattr(lexical, "POSTINGS", 700)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 600)  # several blocks of items
    found = lexical.ranked(stored(docs, DOC_SCHEMA, 3), stored(items, "item_id long, text string", 1))
    assert found_ranks(found) == sorted(ranks_of([(d, t) for d, t, _ in docs], items), key=str)


def test_trie_bounds_skip_documents():
    """Copies of a good document shut out a large branch without scoring its documents."""
    weights = np.array([50, 900, 1000], np.int64)
    vectors = [([0], [1])] * 500 + [([1, 2], [3, 3])] * 20
    trie = lexical.Trie(vectors, np.full(520, 100), np.arange(520), weights)
    scored = []
    trie._score = lambda lo, hi, wants, active, best: (scored.append(hi - lo),
                                                       lexical.Trie._score(trie, lo, hi, wants, active, best))
    best = lexical.Best(1, 10)
    wants = lexical.Wants([collections.Counter({0: 1, 1: 1, 2: 1})], 3)
    best.offer(np.full((10, 1), 10**13), np.arange(1000, 1010))
    trie.search(wants, best)
    assert sum(scored) == 0
    best = lexical.Best(1, 10)
    trie.search(wants, best)
    assert [d for _, d in best.held[0]] == list(range(500, 510))


def test_search_of_empty_tables(docs, no_docs, stored):
    items = stored([(1, "quick")], "item_id long, text string", 1)
    none = stored([], "item_id long, text string", 1)
    assert lexical.ranked(no_docs, items).collect() == [] == lexical.ranked(docs, none).collect()
    assert lexical.ranked(docs, none).columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- op12
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    n = collections.Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def variants_of(n):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n.get(form[w]))
    return sorted(out.values())


def found_variants(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("symbols, crowd", [(8, 64), (2, 3), (4, 1), (1, 2)])
def test_spelling_is_brute_force(stored, symbols, crowd):
    rng = random.Random(symbols)
    base = ["".join(rng.choices("abcdefé", k=rng.choice((7, 8, 12)))) for _ in range(12)]
    docs = []
    for i in range(160):
        words = []
        for _ in range(30):
            w = base[min(11, int(rng.expovariate(0.5)))]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "a"]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words), "en"))
    n = counted([(d, t) for d, t, _ in docs])
    want = variants_of(n)
    assert any(f for _, f, *_ in want) and len(n) > 50
    assert found_variants(spelling.variants(stored(docs, DOC_SCHEMA), symbols, crowd)) == want


def test_spelling_follows_forms_to_the_last(stored):
    chain = [("abcdefgh", 2), ("abcdefgx", 25), ("abcdefyx", 260), ("abcdezyx", 2700)]
    docs = [(None, " ".join([w] * n), "en") for w, n in chain]
    rows = {r["word"]: r for r in spelling.variants(stored(docs, DOC_SCHEMA)).collect()}
    if all(w in rows for w, _ in chain):
        assert {rows[w]["root"] for w, _ in chain} == {"abcdezyx"}
    assert found_variants(spelling.variants(stored(docs, DOC_SCHEMA))) == variants_of(counted([d[:2] for d in docs]))


def test_spelling_edges(docs, no_docs, stored):
    assert found_variants(spelling.variants(docs)) == variants_of(counted([d[:2] for d in DOCS]))
    assert spelling.variants(no_docs).collect() == []
    long_ = "q" * 3000
    rows = [(1, f"{long_} {long_}b", "en"), (2, f"{long_} {long_}b ×÷×÷×÷× ×÷×÷×÷×", "en"), (3, None, None)]
    assert found_variants(spelling.variants(stored(rows, DOC_SCHEMA))) == variants_of(counted([d[:2] for d in rows]))


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", min_size=1, max_size=9))
def test_reduced_neighbours_meet(a, b):
    """Words at one edit meet from exactly one side, whatever the alphabet; others don't (but for chance)."""
    def side(x, y, symbols):
        values = spelling.reduced(spelling.letters([x]), symbols)
        own = [spelling.whole_keys(values), spelling.deletions(values)[1],
               *[k for _, k in spelling.replacements(values, symbols)]]
        keys = np.concatenate(own).tolist()
        assert len(keys) == len(set(keys))
        return int(spelling.whole_keys(spelling.reduced(spelling.letters([y]), symbols))[0]) in keys
    for symbols in (2, 3, 8):
        ra, rb = (tuple(spelling.reduced(spelling.letters([w]), symbols)[0].tolist()) for w in (a, b))
        if a != b and one_edit(a, b):
            assert side(a, b, symbols) + side(b, a, symbols) == (2 if ra == rb else 1)
        elif ra != rb and not one_edit(ra, rb):
            assert not side(a, b, symbols) and not side(b, a, symbols)


# ---------------------------------------------------------------- op13
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(inside))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", "\n", "\x0b", "\x85", " a b a b", "ab c\r\n", "\x1c"]), max_size=60))
def test_counts_are_plain(parts):
    text = " ".join(parts)
    assert quality_rules.counts(text)[:5] == plain_counts(text)


def test_counts_of_real_texts(spark):
    df = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = queries.op13_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.5), (30, 0.05), (200, 0.3)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
            assert quality_rules.tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.tail(0, 10**7, 1e-3) == 0.0 or quality_rules.tail(0, 10**7, 1e-3) < 1e-300
    assert 0.4 < quality_rules.tail(10**4, 10**7, 1e-3) < 0.6


def test_cutoff_is_the_last_certified_gain():
    rng = np.random.default_rng(3)
    score = rng.permutation(101)
    held = np.where(score < 50, 100, rng.integers(0, 2, 101))
    fit_good, fit_bad = np.where(score < 50, 100, 0), np.where(score >= 40, 5, 0)
    got, n, rejected = quality_rules.cutoff(score, held, fit_good, fit_bad, 0.02, 0.01)
    best, gain = None, 0
    for c in range(100, 0, -1):
        k = int(held[score >= c].sum())
        if quality_rules.tail(k, n, 0.02) > 0.01:
            break
        worth = int((fit_bad - quality_rules.WEIGHT * fit_good)[score >= c].sum())
        if worth > gain:
            best, gain = c, worth
    assert got == best == 50 and rejected == held[score >= 50].sum()


def labelled(stored, per, noise=0.0):
    """Documents of two strata; bad ones are full of symbols, and some good ones too."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(per * 2):
        bad = i % 4 == 0
        symbols = bad or rng.random() < noise
        words = [rng.choice("abcdefgh") * rng.randint(3, 6) + str(rng.randrange(10**6)) for _ in range(40)]
        docs.append((i, " ".join(w + ("##" if symbols else "") for w in words), ("en", None)[i // per]))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_risk_is_held_and_bad_documents_go(stored):
    docs, labels = labelled(stored, 3000)
    lab = stored(labels, "doc_id long, quality int")
    rows = quality_rules.judged(stored(docs, DOC_SCHEMA), lab).collect()
    bad = {d for d, q in labels if not q}
    assert {r["doc_id"] for r in rows if not r["kept"]} == bad  # in both strata, the null one too
    assert all("symbols" in r["failed"] for r in rows if r["doc_id"] in bad)


def test_nothing_is_rejected_beyond_the_risk(stored):
    docs, labels = labelled(stored, 1500, noise=0.10)  # the symbols would cost a tenth of the good documents
    rows = quality_rules.judged(stored(docs, DOC_SCHEMA), stored(labels, "doc_id long, quality int")).collect()
    assert not any("symbols" in r["failed"] for r in rows)


def test_few_labels_or_copies_certify_nothing(stored):
    docs, labels = labelled(stored, 20)
    lab = stored(labels, "doc_id long, quality int")
    assert all(r["kept"] for r in quality_rules.judged(stored(docs, DOC_SCHEMA), lab).collect())
    copies = [(i, docs[1][1], "en") for i in range(4000)] + [(9000 + i, docs[0][1], "en") for i in range(2000)]
    lab = stored([(d, 1 if d < 9000 else 0) for d, _, _ in copies], "doc_id long, quality int")
    assert all(r["kept"] for r in quality_rules.judged(stored(copies, DOC_SCHEMA), lab).collect())


def test_rules_on_edges(docs, no_docs, stored):
    lab = stored([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 0, 0), (3, None, None), (99, 1, 0)],
                 "doc_id long, quality int, n_words int")
    rows = quality_rules.judged(docs, lab).collect()
    assert len(rows) == len(DOCS)
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in rows) == sorted(
        (d or -1, plain_counts(t)[0]) for d, t, _ in DOCS)
    assert quality_rules.judged(no_docs, lab).collect() == []
    none = stored([], "doc_id long, quality int", 1)
    assert {(r["doc_id"], r["kept"]) for r in quality_rules.judged(docs, none).collect()} == {
        (r["doc_id"], not r["base_failed"]) for r in rows}
