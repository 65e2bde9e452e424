"""Chat, HTML, packing and search: exact round trips and brute force."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import chat, html_main, neighbours, packing
from cutline.llm.queries import TOKENIZER

NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|<|", "<\\|x\\\\n", "", "a\nb", "ends with <", "|starts", "\\n", "\U0001f600 <|im_start|>user\nhi<|im_end|>\n"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(s,) for s in NASTY], "s string").select("s", chat.unescape(chat.escape(F.col("s"))).alias("t"), chat.unescape_role(chat.escape_role(F.col("s"))).alias("r"), chat.escape(F.col("s")).alias("e"))
    for r in df.collect():
        assert r["s"] == r["t"] == r["r"]
        assert "<|" not in r["e"]


def test_expansion_and_read_back(spark):
    rows = [(1, 0, "system", NASTY[0]), (1, 1, "user", NASTY[1]), (1, 2, "assistant", NASTY[3]), (1, 3, "user", None), (1, 4, "assistant", NASTY[9]), (1, 5, "user", NASTY[6])]
    rows += [(2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, None, None, "x"), (4, 0, "od\nd<|", "t"), (4, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    ex = chat.expand(df)
    got = {r["conv_id"]: r for r in chat.digest(ex).collect()}
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t, r or "", x or ""))
    for c, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = ex.where("conv_id = 1").orderBy("example").collect()
    assert [p["n_turns"] for p in parts] == [3, 5, 6] and [p["loss_start"] is None for p in parts] == [False, False, True]
    assert sum(len(p["text"]) for p in parts) == got[1]["formatted_chars"]
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><{0}><h1>Title {1}</h1><p>First &lt;b&gt; <b>bold</b>   text {1}<p>Second<br>line &eacute;&#33;<script>var x="</p>";</script></p><ul><li>one<li>two</ul>{2}</{3}>
<aside>Side</aside><section class="comments"><p>Great post!</p></section><form><input>Search</form><footer>&copy; {4}</footer></body></html>"""


def page(i, region="article", extra=""):
    return PAGE.format(region, i, extra, region.split()[0], i)


def test_extraction(spark):
    want = "Title {0}\nFirst <b> bold text {0}\nSecond line é!\none\ntwo"
    rows = [(i, f"https://User@A.example.com:80/{i}", page(i)) for i in range(3)] + [(10, "http://b.example.com/x", page(10, 'div class="post-content"')), (11, None, None), (12, "http://c/", ""), (13, "http://c/", "<p>a<p>b</div></p>c & d &amp d <!-- x -->"), (13, "http://c/", "<p>a<p>b</div></p>c & d &amp d <!-- x -->")]
    got = html_main.extract_main(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 10):
        assert by[i]["text"] == want.format(i) and by[i]["n_chars"] == len(by[i]["text"])
    assert (by[11]["text"], by[12]["text"]) == ("", "")
    assert by[13]["text"] == "a\nb\nc & d & d"


def test_constant_slots_are_template_and_copies_are_not(spark):
    share = "<div><p>Read more of our stories</p></div>"
    rows = [(i, "http://h.example.com/", f"<body><div><p>Text number {i} of the page</p></div>{share}</body>") for i in range(12)]
    copies = [(100 + i, "http://h.example.com/", "<body><div><p>The copied story</p></div>" + share + f"<footer>{i}</footer></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {i} of the page" for i in range(12))
    assert all(got[100 + i] == "The copied story" for i in range(30))


def test_tree_match_aligns_in_order():
    shape = lambda t: html_main.skeleton(t, html_main._marks(t), html_main._verdicts(t, html_main._marks(t)))
    a, b = (shape(t) for t in (html_main.parse("<div><p>x</p><ul><li>1</ul></div>"), html_main.parse("<div><h1>new</h1><p>y</p><ul><li>1<li>2</ul></div>")))
    pairs = html_main.tree_match(a, b, 1000)
    assert {(a[0][x], b[0][y]) for x, y in pairs.items()} == {("#root", "#root"), ("div", "div"), ("p", "p"), ("ul", "ul"), ("li", "li")}
    assert html_main.tree_match(a, b, 0)  # too wide for the table: in linear space


@pytest.mark.parametrize("bad", ["<", "<<<>>>", "<p", "<!--", "<script>", "&#xFFFFFF;", "</p></p>", "<a href='", "<" * 2000, "<div>" * 2000 + "x"])
def test_broken_markup(bad):
    tree = html_main.parse(bad)
    html_main._verdicts(tree, html_main._marks(tree))


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_ids_equal_the_tokenizer(plain):
    long = "The quick, brown fox's 12 jumps\n\n  over\tit. " * 40_000
    for s in ["", " ", "\n\n x", "it's 3.14%", "<|endoftext|> a", "中文  x", "a" * 3000, " " * 3000, "\x1c\x1f!", long]:
        assert packing.Encoder(TOKENIZER)(s).tolist() == plain.encode(s, add_special_tokens=False).ids


def test_packing(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "x")], "doc_id long, text string")).withColumn("length", F.lit("clash"))
    cfg = packing.PackConfig(max_tokens=256)
    rows = packing.pack_documents(docs, TOKENIZER, cfg).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    whole, bins = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = [i & 0xFFFFFFFF for i in r["ids"]]
        assert len(ids) == r["length"] <= 256 and zlib.crc32(array("I", ids).tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 256
        whole[r["doc_id"]] += ids
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in texts.items():
        assert whole[k] == t[0] if len(t) == 1 else sum(len(x) for x in t) == len(whole[k])
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 256
    assert len(bins) <= 1.02 * sum(len(x) for t in texts.values() for x in t) / 256 + 1
    assert packing.pack_documents(docs.limit(0), TOKENIZER, cfg).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 3000)
    cfg = packing.PackConfig(max_tokens=100, max_docs=3, max_cost=6000 + 4000, score=score)
    hist = {int(n): int((lengths == n).sum()) for n in np.unique(lengths)}
    places = packing.fit(hist, cfg)
    bins = defaultdict(list)
    for n, c in hist.items():
        own = places[places[:, 0] == n]
        for r in range(c):
            row = own[np.searchsorted(own[:, 1], r, "right") - 1]
            k, j = divmod(r - row[1], row[2])
            bins[row[3] + k].append((row[4] + j * n, n))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.concatenate([[0], np.cumsum([n for _, n in b])[:-1]]).tolist()
        assert sum(n for _, n in b) <= 100 and len(b) <= 3 and sum(n * n for _, n in b) <= 10_000
    assert len(bins) <= 1.1 * max(lengths.sum() / 100, len(lengths) / 3)
    with pytest.raises(ValueError):
        packing.fit({101: 1}, cfg)


def test_search_recall_exact_scores_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = [(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [float("nan")] * 64), (10**6 + 3, [None] * 64), (None, [1.0] * 64), (10**6 + 4, [1.0, 2.0]), (10**6 + 5, [])]
    extra = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    twin = df.where("vec_id = 1").select(F.lit(10**6 + 7).cast("long").alias("vec_id"), "embedding")
    both = df.select("vec_id", "embedding").unionByName(extra).unionByName(twin).unionByName(twin).withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in neighbours.nearest(both, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    p = df.select("vec_id", "embedding").unionByName(twin).toPandas()
    v, ids = np.array(p["embedding"].tolist(), float), p["vec_id"].to_numpy()
    hits = 0
    for q in [i for i in ids if i % 100 == 0 and i < 10**6]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))][:10]
        hits += len(set(best) & {i for _, i, _ in got[q]})
        exact = dict(zip(ids, d, strict=True))
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(exact[i] == s for _, i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (x[2], x[1]))
    assert hits >= 0.9 * 10 * len(got)
    assert neighbours.nearest(both.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_few_candidates_come_from_all_rows(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 0.1 * i]) for i in range(8)]
    cfg = neighbours.CrossPolytopeConfig(tables=1, share=0.01, k=10, block_rows=3)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, cfg).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 4, 5, 6, 7]
    two = neighbours.CrossPolytopeConfig(tables=4, share=0.5)
    assert neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, two).count() == 7
