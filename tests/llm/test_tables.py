"""Operators on conversations, vectors, pages and archives, the pipeline, and the registry."""

import collections
import hashlib
import importlib.util
import pathlib
import re

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from agora.llm import bpe_chunks, chat, main_text, packing, simhash, suffix_dedup, vector_graph, warc_audit
from agora.llm.common import materialize, table
from agora.llm.components import components
from tests.conftest import SMALL


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- op9
CHATS = [
    (1, 0, "system", "a\\b <s> [INST]"), (1, 1, "user", "x"), (1, 2, "user", "[SEP]<"), (1, 3, "assistant", ""),
    (1, 4, "assistant", "</s>\\"), (2, None, None, None), (2, 1, "tool]", "<<SYS>>\n"), (2, 2, "[TEXT]", "[/ROLE]"),
    (None, 1, "user", "q"), (3, 1, "assistant", "<<s></s>[[/ROLE]"), (3, 1, "assistant", "<<s></s>[[/ROLE]"),
    (4, 5, "user", "late"), (4, 1, "assistant", "early"), (5, 1, "user", "x" * 50_000 + "\\"), (6, 1, "assistant", "é🎉"),
]


def _turns(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def test_chats_read_back(stored):
    df = stored([(*r, 1, "z") for r in CHATS], "conv_id long, turn long, role string, text string, turns int, formatted string")
    formatted = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    want = _turns(CHATS)
    assert {c: [tuple(t) for t in r["turns"]] for c, r in back.items()} == want
    for r in back.values():
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        blocks = [x for x in re.split(r"(?<=</s>)|(?<=\[/INST\])|(?<=<</SYS>>)|(?<=\[/ROLE\])", r["formatted"]) if x]
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want[r["conv_id"]], want[r["conv_id"]][1:]))
        assert len(blocks) == merged
    for r in chat.chat_digests(formatted).collect():
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == _sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == _sha(loss)
        assert r["formatted_chars"] == len(back[r["conv_id"]]["formatted"])


def test_no_chats(stored):
    none = stored([], "conv_id long, turn long, role string, text string", 1)
    assert chat.format_chats(none).collect() == []
    assert [r["conv_id"] for r in chat.chat_digests(chat.format_chats(chat.with_hostile(none))).collect()] == [-1]


def test_chat_plan_is_spark_only(spark):
    df = queries()["op9_chat_format"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- op8
def _plain_links(x, cosine=0.9):
    x = np.array(x, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def _compare_vectors(df, rows):
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                              for r in vector_graph.near_vectors(df).collect())
    near = _plain_links([v for _, v in rows])
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    first = {}
    for i, (d, _) in enumerate(rows):
        first[label[i]] = min(first.get(label[i], d), d)
    want = collections.Counter((d, int(near[i].sum()), first[label[i]], d == first[label[i]])
                               for i, (d, _) in enumerate(rows))
    assert got == want


def test_vectors_against_brute_force(spark, stored, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for k in range(60):
            rows.append((len(rows), (centre + rng.normal(size=16) * (0.05 if c < 2 else 0.35)).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, [2 * v for v in rows[0][1]])]
    rows += [(3000 + i, rng.normal(size=16).tolist()) for i in range(100)]
    for sizes in ({}, {"SHARD": 60, "CROWD": 64, "PART": 32}):
        for k, v in sizes.items():
            monkeypatch.setattr(vector_graph, k, v)
        _compare_vectors(stored(rows, "vec_id long, embedding array<double>"), rows)


def test_vector_recall_and_audit(spark):
    df = table(spark, SMALL, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {r["vec_id"]: r for r in vector_graph.near_vectors(df).collect()}
    near = _plain_links([v for _, v in rows])
    true = {d: int(n) for (d, _), n in zip(rows, near.sum(axis=1))}
    assert all(got[d]["n_links"] <= n for d, n in true.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(true.values())
    asked = {d: r["audit_links"] for d, r in got.items() if r["audit_links"] is not None}
    assert asked and all(true[d] == n for d, n in asked.items())


def test_vector_recall_in_one_large_group(stored, monkeypatch):
    """A third of all rows are different near copies of one vector, over many more centroids than OVERLAP."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    spread = rng.normal(size=(700, 64)) * 0.27 * np.linalg.norm(centre) / 8
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([centre + spread, rng.normal(size=(1400, 64))]))]
    near = _plain_links([v for _, v in rows])
    assert near[:700, :700].mean() > 0.9
    for k, v in {"SHARD": 80, "CROWD": 256, "PART": 96}.items():
        monkeypatch.setattr(vector_graph, k, v)
    got = {r["vec_id"]: r["n_links"] for r in vector_graph.near_vectors(
        stored(rows, "vec_id long, embedding array<double>")).collect()}
    true = near.sum(axis=1)
    assert all(got[i] <= n for i, n in enumerate(true.tolist()))
    assert sum(got.values()) >= 0.95 * true.sum()


def test_vector_edges(stored):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1e300, 1e299]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, []), (11, [-1.0, 0.0])]
    df = stored([(*r, 5, "t", 3) for r in rows], "vec_id long, embedding array<double>, label int, tile string, node int")
    out = vector_graph.near_vectors(df).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] * 2 and by[8] == [(3, 1, False)]
    for alone in (3, 4, 5, 6, 7, 9, 10, 11):
        assert by[alone] == [(0, alone, True)]
    assert by[None] == [(0, None, True)]
    assert vector_graph.near_vectors(stored([], "vec_id long, embedding array<float>", 1)).collect() == []


# ---------------------------------------------------------------- op10
def _template(source):
    """What the small test pages hold, by their own fixed form."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)
    out = []
    import html
    for part in re.split(r"</?(?:p|h1)>", found[1] if found else ""):
        part = " ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", part)).split())
        if part:
            out.append(part)
    return "\n".join(out)


def test_all_pages(spark):
    df = table(spark, SMALL, "pages")
    got = {r["page_id"]: r for r in main_text.extracted(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == _template(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


PARA = "<p>{} is a sentence, with commas, and some length to it, as articles have.</p>"


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b<p>c&nbsp;d", "a & b\nc d"),
    ("<div>a<br>b</div><div>c</div>", "a b\nc"), ("a < b &lt;p&gt; &#233;&#x1F389;", "a < b <p> é🎉"),
    ("<p>one</p><foot", "one"), ("<script>if (a<b) '</p>'</script><style>x{}</style><p>t</p>", "t"),
    ("<p>x <b>bold <i>both</p><p>next", "x bold both\nnext"), ("<!-- no --><p>yes</p><!-- cut", "yes"),
    ("<a title=\"x>y\">l</a><p>text, and more text</p>", "l\ntext, and more text"),
    ("<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>T</h1>" + PARA.format("A") + "</main>"
     "<aside><p>Side, side, side</p></aside><footer>F</footer>",
     "T\nA is a sentence, with commas, and some length to it, as articles have."),
    ("<body><div class='cookie-notice'>We use cookies, many, many.</div><div id=content><h2>Head</h2>" + PARA.format("B")
     + "<ul><li>one</li><li>two</li></ul></div><div class=sidebar>" + PARA.format("S") + "</div><form><label>Mail</label>"
     "</form><div id=comments>" + PARA.format("C") * 9 + "</div></body>",
     "Head\nB is a sentence, with commas, and some length to it, as articles have.\none\ntwo"),
    ("<article><header><h1>Title</h1><p>By me</p></header>" + PARA.format("D") + "<div class='ad'>Buy</div>"
     "<ul><li><a href=1>m1</a><li><a href=2>m2</a></ul><table><tr><td>x<td>y</table></article>",
     "Title\nD is a sentence, with commas, and some length to it, as articles have.\nx\ny"),
    ("<div hidden>h</div><div style='display: none'>h</div><p aria-hidden=true>h</p><p>shown</p>", "shown"),
    ("<div>" * 20_000 + "deep", "deep"), ("<p>" + "long, " * 200_000 + "</p>", ("long, " * 200_000).strip()),
])
def test_pages_of_other_forms(source, want):
    assert main_text.main_text(source) == want


_LINE = "{} is a sentence, with commas, and some length to it, as articles have."
_COMMENTS = "".join(f"<li class=comment><article class=comment-body>{PARA.format(c)}</article></li>" for c in "UVW")


@pytest.mark.parametrize("source, want", [
    ("<div class='post comments-open'><article>" + PARA.format("A") + "</article></div>", "A"),
    ("<div class='post comments-open'><article>" + PARA.format("A") + "</article><div id=comments><ol>" + _COMMENTS
     + "</ol></div></div>", "A"),
    ("<article class='post reviews'>" + PARA.format("A") + "</article>", "A"),
    ("<article>" + PARA.format("A") + "<section id='discussion'>" + PARA.format("B") + PARA.format("C") + "</section></article>",
     "ABC"),
    ("<article>" + PARA.format("A") + PARA.format("B").replace("<p>", "<p class='commentary'>") + "</article>", "AB"),
    ("<article>" + PARA.format("A") + "<section id='related-work'>" + PARA.format("B") + "</section>"
     "<div class='social-history'>" + PARA.format("C") + "</div><section class='header-files'>" + PARA.format("D")
     + "</section></article>", "ABCD"),
    ("<article>" + PARA.format("A") + "<div class='related-posts'><p><a href=1>" + _LINE.format("B") + "</a></p></div>"
     "<div class='share-tools'>Share</div><ol class='comment-list'>" + _COMMENTS + "</ol></article>", "A"),
    ("<article>" + PARA.format("A") + "<ol><li><a href=1>" + _LINE.format("B") + "</a></li></ol></article>", "AB"),
    ("<body><div class='layout sidebar-right'><div class=col>" + PARA.format("A") + PARA.format("B") + "</div>"
     "<div class=sidebar>" + PARA.format("S") + "</div></div></body>", "AB"),
    ("<body><div class='container nav-open'><div class=has-header-fixed>" + PARA.format("A") + PARA.format("B")
     + "</div></div></body>", "AB"),
    ("<div class=content><div class='page comments-enabled'>" + PARA.format("A") + PARA.format("B") + "</div></div>", "AB"),
    ("<div class=content>" + PARA.format("A") + "<div class=comments-area>" + PARA.format("B") * 9 + "</div></div>", "A"),
    ("<body><div class='page comments-enabled'>" + PARA.format("A") + PARA.format("B") + "</div></body>", "AB"),
])
def test_words_alone_drop_no_article(source, want):
    assert main_text.main_text(source) == "\n".join(map(_LINE.format, want))


def test_page_edges(stored):
    df = stored([(1, None, None, "x"), (None, "u", "<p>t</p>", "y"), (None, "u", "<p>t</p>", "y")],
                "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in main_text.extracted(df).collect()) == [
        (0, "t", 1), (0, "t", 1), (1, "", 0)]
    assert main_text.extracted(stored([], "page_id long, url string, html string", 1)).collect() == []


# ---------------------------------------------------------------- op7
def test_archive_records_are_warc(stored, tmp_path):
    df = stored([(1, "http://a/é", "<p>ü</p>", 9), (2, None, None, 9), (1500, "u", "h" * 100_000, 9), (None, "n", "x", 9),
                 (2, None, None, 9)], "page_id long, url string, html string, length long")
    found = sorted(warc_audit.records(df).collect(), key=lambda r: (r["file"], r["start"]))
    assert [r["file"] for r in found] == [0, 1, 1, 1, 2]
    at = collections.Counter()
    for r in found:
        raw = r["record"].encode()
        assert r["start"] == at[r["file"]] and r["length"] == len(raw)
        at[r["file"]] += len(raw)
        head, _, body = raw.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n"
    out = str(tmp_path / "warc")
    warc_audit.write_archive(warc_audit.records(df), out)
    written = b"".join(p.read_bytes() for p in sorted(pathlib.Path(out).glob("part-*")))
    assert sorted(written.split(b"WARC/1.1\r\n")[1:]) == sorted(r["record"].encode().partition(b"WARC/1.1\r\n")[2] for r in found)


def test_audit_finds_all_damage(spark, stored):
    pages = stored([(i, f"http://h/{i}", "x" * (i * 37 % 5000)) for i in range(2500)], "page_id long, url string, html string", 4)
    whole = materialize(warc_audit.records(pages), "t")
    assert warc_audit.audit(whole, whole).collect() == []
    second = whole.where("page_id <> 2100").selectExpr(
        "file", "start + IF(page_id = 900, 1000000, 0) AS start", "length", "page_id",
        "CASE WHEN page_id = 7 THEN replace(record, 'WARC', 'WARD') WHEN page_id = 1700 THEN record || '!' ELSE record END AS record")
    got = {(r["page_id"], r["kind"]) for r in warc_audit.audit(whole, second).collect()}
    assert got == {(7, "altered"), (1700, "resized"), (2100, "missing"), (900, "missing"), (900, "extra")}
    none = whole.where("false")
    assert warc_audit.audit(none, none).collect() == []
    assert {r["kind"] for r in warc_audit.audit(none, whole).collect()} == {"extra"}


# ---------------------------------------------------------------- the rest
def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6000, None)]
    edges += [(b, a) for a, b in [(2000 + i, 2001 + i) for i in range(0, 90, 3)]]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1200)} == {1000}
    assert got[2004] == 2003 and 5000 not in got and 6000 not in got
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


@pytest.mark.parametrize("late", [None, "1", "16"])
def test_rows_stay_the_same_when_cores_come_and_go(spark, stored, late):
    cores, least = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
    passage = " ".join(f"passage{i}" for i in range(40))
    rows = [(i, f"text{i} " * 5 + (passage if i % 3 else " ".join(f"w{i}x{j}" for j in range(40)))) for i in range(300)]
    docs, text = stored(rows, "doc_id long, text string", 12), dict(rows)
    spark.conf.unset(least)
    spark.conf.set(cores, "4")
    try:
        kept, left = simhash.one_of_each(docs), suffix_dedup.remove_repeats(docs)
        ids, marked = bpe_chunks.encoded(docs, None), simhash.near_duplicates(docs)
        spark.conf.set(cores, late or "4")  # the scans of the results come later
        one = {r["component_id"] for r in marked.collect()}
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(one)
        for r in left.collect():
            assert r["n_bytes"] == len(text[r["doc_id"]]) and (r["n_removed"] > 0) == (r["doc_id"] % 3 > 0)
            assert passage not in bytes(r["kept"]).decode()
        assert {r["doc_id"]: r["decoded"] for r in ids.collect()} == text
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(least)


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    rows, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialize(stage(spark, kept, SMALL), f"t-{name}")
        rows[name] = kept.collect()
        if name != names[-1]:
            assert kept.schema == docs.schema
        if name == "near_duplicates":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in rows[name]} == want and len(rows[name]) == len(want)
        if name == "repeated_passages":
            plain = {r["doc_id"]: bytes(r["kept"]).decode(errors="ignore") for r in suffix_dedup.remove_repeats(before).collect()}
            assert {r["doc_id"]: r["text"] for r in rows[name]} == plain
        if name == "packed":
            assert {r["doc_id"] for r in rows[name]} == {r["doc_id"] for r in before.collect()}
    assert len(rows["language"]) == docs.count()  # all of them are clean
    again = corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset")
    assert sorted(again.collect()) == sorted(kept.drop("sequence_id", "offset").collect())


def test_pipeline_on_edges(spark, docs, no_docs):
    for start in (docs.select("doc_id", "text", "lang", "source", "n_chars", "score"), no_docs):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            kept = materialize(stage(spark, kept, SMALL), f"t-{name}")
        assert kept.count() >= (1 if start is not no_docs else 0)


def test_every_operator_has_one_query():
    numbers = sorted(int(m[1]) for n in queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11)) and "pipeline" in queries()
    assert {"op7_warc_audit", "op9_chat_format"} <= set(oracle_sql())


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(importlib.util.find_spec("agora").submodule_search_locations[0])
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "agora.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_packing_uses_sequences_of_many_pieces(spark):
    rows = packing.pack_documents(table(spark, SMALL, "documents")).collect()
    held = collections.Counter(r["sequence_id"] for r in rows)
    assert max(held.values()) > 1
