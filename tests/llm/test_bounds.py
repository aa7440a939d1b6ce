"""What must not depend on size: short texts, hot ids, the bounds on samples, lengths that packing covers."""

import random
import time
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import bpe_chunks, langid, main_text, packing, syncmers
from tests.llm.conftest import DOCS

DOC_SCHEMA = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- op2
def _prose(rng, n):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)]
    return " ".join(words)[:n]


def test_nested_short_texts_are_alike():
    rng = random.Random(7)
    for _ in range(5):
        text = _prose(rng, 120)
        marks = {n: a for n, a in zip(range(80, 121), syncmers.anchors([text[:n] for n in range(80, 121)]))}
        assert min(syncmers.likeness(marks[a], marks[b]) for a in marks for b in marks) > 0.6
        assert syncmers.likeness(*syncmers.anchors([text[:97], text[:95]])) > 0.9


def test_likeness_falls_with_the_share_that_is_common():
    rng = random.Random(8)
    for n in (60, 300, 3000):
        a, b = _prose(rng, n), _prose(rng, n)
        half, = syncmers.anchors([a[:n // 2] + b[n // 2:]])
        whole, other = syncmers.anchors([a, b])
        assert 0.2 < syncmers.likeness(whole, half) < 0.8 and syncmers.likeness(whole, other) < 0.1


def _chain(a, b):
    """Longest common chain of (value, occurrence), by the plain table."""
    def marked(x):
        seen = {}
        out = []
        for v in x:
            seen[v] = seen.get(v, -1) + 1
            out.append((v, seen[v]))
        return out
    a, b = marked(a), marked(b)

    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))
    return best(0, 0)


def test_likeness_is_the_longest_chain():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        got = syncmers.likeness(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == pytest.approx(2 * _chain(a, b) / (len(a) + len(b)))


def test_a_hot_id_fills_no_bucket(spark, stored):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i}", "en") for i in range(3000)]
    ordered = syncmers._ordered(stored(rows, DOC_SCHEMA, 4))
    sizes = [r["count"] for r in ordered.where("NOT extra").groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 3000 / 8
    found = syncmers.fingerprinted(stored(rows, DOC_SCHEMA, 4))
    assert found.count() == 3000


def test_next_documents_cross_buckets(spark, stored):
    rows = [(i // 2, _prose(random.Random(i), 200), "en") for i in range(400)]
    keyed = stored(rows, DOC_SCHEMA, 3)
    got = syncmers.fingerprinted(keyed).collect()
    assert len(got) == 400
    # every document is the next of exactly one: the edited texts end in each document's first third once
    import hashlib
    # rows of an id stand in stored order, which is that of the scan
    order = sorted([(-(r["doc_id"]), r["at"], r["text"]) for r in keyed.withColumn(
        "at", F.monotonically_increasing_id()).collect()])
    want = sorted(hashlib.sha256((t[:len(t) - len(t) // 3] + order[(i + 1) % 400][2][:len(t) // 3]).encode()).hexdigest()
                  for i, (_, _, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in got) == want


# ---------------------------------------------------------------- op1
def test_the_sample_is_bounded_by_texts(spark, stored, monkeypatch):
    taken = []
    real = langid.clustered
    rng = random.Random(1)
    rows = [(None if i % 2 else 5, _prose(rng, 60), "en") for i in range(1500)]
    rows += [(None, "the same text in every copy of it", "en")] * 1500
    monkeypatch.setattr(langid, "clustered", lambda x, *a: (taken.append(len(x)), real(x, *a))[1])
    df = stored(rows, DOC_SCHEMA)
    drawn = []
    held = langid.materialize
    monkeypatch.setattr(langid, "materialize", lambda d, name: (out := held(d, name), drawn.append(out.count()))[0])
    assert langid.fit(df, sample=100) is not None
    assert drawn and 20 <= drawn[0] <= 100


# ---------------------------------------------------------------- op4
@pytest.mark.parametrize("kind", ["uniform", "lognormal", "few"])
def test_the_program_covers_every_length(kind):
    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 256, 8000), "few": rng.choice([3, 100, 130], 500),
               "lognormal": np.clip(rng.lognormal(4, 0.8, 8000).astype(int), 1, 255)}[kind]
    demand = np.bincount(lengths, minlength=257).astype(float)
    x = packing.relaxed(demand, 256)
    covered = np.zeros(257)
    for filling, n in x.items():
        assert sum(s * k for s, k in filling) <= 256 and n > 0
        for s, k in filling:
            covered[s] += n * k
    assert (covered[demand > 0] > 0).all() and (covered <= demand + 1e-6).all()
    assert (covered * np.arange(257)).sum() > (0.1 if kind == "few" else 0.3) * lengths.sum()


# ---------------------------------------------------------------- op6
def test_chunks_shared_by_many_texts(stored):
    """Copies, overlapping passages and a filter that lets much through give the ids of the whole texts."""
    from agora.llm import tokens
    rng = random.Random(3)
    parts = [_prose(rng, 3000) for _ in range(4)]
    rows = [(i, " ".join(rng.sample(parts, rng.randint(1, 3))) + _prose(rng, rng.randint(0, 400)), "en") for i in range(40)]
    rows += [(100 + i, parts[0], "en") for i in range(60)] + [(None, None, None), (900, "", "en")]
    found = {r["doc_id"]: r for r in bpe_chunks.encoded(stored(rows, DOC_SCHEMA)).collect()}
    from tokenizers import Tokenizer
    real = Tokenizer.from_file(tokens.default_path())
    assert len(found) == len(rows)
    for d, text, _ in rows:
        ids = real.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[d]["ids"], "<u4").tolist() == ids
        assert found[d]["decoded"] == real.decode(ids, skip_special_tokens=False)


# ---------------------------------------------------------------- op10
SAID = "{} is a sentence, with commas, and some length to it, as articles have."
PARA = "<p>" + SAID + "</p>"


@pytest.mark.parametrize("source, want", [
    ("<article><p>Before <svg><path/></svg> after it, and on.</p></article>", "Before after it, and on."),
    ("<article><p>Before <svg/>after <script>x()</script>it.</p></article>", "Before after it."),
    ("<article><p>One <math><mi>x</mi></math> two <audio src=a></audio>three <button>Play</button> four "
     "<select><option>a<option>b</select>five.</p></article>", "One two three four five."),
    ("<form action=x><div>" + PARA.format("A") + PARA.format("B") + "</div><input name=v></form>",
     SAID.format("A") + "\n" + SAID.format("B")),
    ("<body><aside><div>" + PARA.format("A") + PARA.format("B") + "</div></aside></body>", SAID.format("A") + "\n" + SAID.format("B")),
    ("<form><div class=sidebar>" + PARA.format("S") + "</div><div class=content>" + PARA.format("A") + PARA.format("B")
     + PARA.format("C") + "</div></form>", "\n".join(map(SAID.format, "ABC"))),
    ("<div class=content>" + PARA.format("A") + PARA.format("B") + "</div><form><p>Write to us, please.</p></form><aside>"
     + PARA.format("S") + "</aside>", SAID.format("A") + "\n" + SAID.format("B")),
    ("<form hidden>" + PARA.format("H") * 5 + "</form><p>Shown here.</p>", "Shown here."),
    ("<article><header><h1>Title</h1><p>" + SAID.format("Standfirst") + "</p><p>By Some One</p><time>1 May</time></header>"
     + PARA.format("A") + "</article>", "Title\n" + SAID.format("Standfirst") + "\n" + SAID.format("A")),
    ("<header><p>" + SAID.format("Site") + "</p></header><article>" + PARA.format("A") + "</article>", SAID.format("A")),
])
def test_inline_controls_wrappers_and_standfirst(source, want):
    assert main_text.main_text(source) == want


def test_unclosed_raw_elements_are_read_in_linear_time():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        main_text.parse("<p>x</p>" + "<iframe><svg>" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_edges_still_have_a_row_each(docs):
    assert syncmers.fingerprinted(docs).count() == len(DOCS)
