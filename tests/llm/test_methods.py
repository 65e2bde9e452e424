"""Methods against independent forms: tree matching, FTRL, vector best fit, rolling hashes."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import html_main, packing, quality
from cutline.llm import textops as T
from cutline.llm.queries import TOKENIZER

DATA = "/root/testdata/sf0.001"


def tree(rng, depth):
    """(tag, text, children) of a random tree."""
    kids = [tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return rng.choice("ab"), rng.randrange(3), kids


def flat(t):
    tags, ups, texts = [], [], []

    def walk(node, up):
        tags.append(node[0])
        ups.append(up)
        texts.append(node[1])
        here = len(tags) - 1
        for k in node[2]:
            walk(k, here)

    walk(t, -1)
    return tags, ups, texts, []


def weight(a, b):
    """Simple tree matching by trying every order-preserving choice of children."""
    if a[0] != b[0]:
        return 0.0
    best = 0.0
    for n in range(1, min(len(a[2]), len(b[2])) + 1):
        for xs in combinations(a[2], n):
            for ys in combinations(b[2], n):
                best = max(best, sum(weight(x, y) for x, y in zip(xs, ys, strict=True)))
    return best + (1.5 if a[1] == b[1] else 1.0)


def test_tree_match_equals_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        a, b = tree(rng, 3), tree(rng, 3)
        fa, fb = flat(a), flat(b)
        got = html_main.tree_match(fa, fb, 10**6)
        assert sum(1.5 if fa[2][x] == fb[2][y] else 1.0 for x, y in got.items()) == weight(a, b)
        assert all(fa[0][x] == fb[0][y] and (x == 0 or got[fa[1][x]] == fb[1][y]) for x, y in got.items())


def plain_ftrl(rows, labels, cfg, order, cost):
    """Per-coordinate FTRL-proximal as published, one dictionary entry a weight."""
    z, n = {}, {}

    def w(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= cfg.l1:
            return 0.0
        return -(zi - math.copysign(cfg.l1, zi)) / ((cfg.beta + math.sqrt(n.get(i, 0.0))) / cfg.alpha + cfg.l2)

    for k in order:
        x = rows[k]
        now = {i: w(i) for i in x}
        p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - labels[k]) * v * cost[labels[k]]
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / cfg.alpha * now[i]
            n[i] = old + g * g
    return w


def test_ftrl_equals_the_published_updates():
    cfg = quality.QualityConfig(bits=6, passes=2, l1=0.05)
    rng = np.random.default_rng(1)
    vectors = [(np.sort(rng.choice(65, 9, replace=False)), rng.random(9)) for _ in range(40)]
    labels = (rng.random(40) < 0.3).astype(int)
    got = quality.ftrl(vectors, labels, cfg)
    shuffle = np.random.default_rng(cfg.seed)
    order = [k for _ in range(cfg.passes) for k in shuffle.permutation(40)]
    cost = {1: 40 / (2 * labels.sum()), 0: 40 / (2 * (40 - labels.sum()))}
    w = plain_ftrl([dict(zip(i.tolist(), x.tolist(), strict=True)) for i, x in vectors], labels.tolist(), cfg, order, cost)
    assert got == pytest.approx([w(i) for i in range(65)])
    assert (got == 0).any() and (got != 0).any()


def one_by_one(lengths, cfg):
    """Each piece, longest first, into the open sequence that leaves the least norm; every bin kept."""
    scale = [w / c**2 for w, c in zip(cfg.weights, cfg.room, strict=True)]
    bins = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        fits = [b for b in bins if all(r >= x for r, x in zip(b[0], need, strict=True))]
        if fits:
            b = min(fits, key=lambda b: sum((r - x) ** 2 * s for r, x, s in zip(b[0], need, scale, strict=True)))
        else:
            b = [list(cfg.room), []]
            bins.append(b)
        b[0] = [r - x for r, x in zip(b[0], need, strict=True)]
        b[1].append(n)
    return bins


@pytest.mark.parametrize("docs, cost", [(None, None), (4, None), (None, 4900), (5, 5200)])
def test_fit_equals_piecewise_vector_best_fit(docs, cost):
    cfg = packing.PackConfig(max_tokens=100, max_docs=docs, max_cost=cost)
    rng = random.Random(5)
    lengths = [min(70, 1 + int(rng.expovariate(1 / 18))) for _ in range(700)]
    want = one_by_one(lengths, cfg)
    places = packing.fit(dict(Counter(lengths)), cfg)
    got = {}
    for i, (length, first, each, sequence, _) in enumerate(places):
        end = next((p[1] for p in places[i + 1 :] if p[0] == length), lengths.count(length))
        for rank in range(end - first):
            got.setdefault(int(sequence + rank // each), []).append(int(length))
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(b[1]) for b in want)
    if docs:
        assert any(b[0][1] == 0 and b[0][0] > 0 for b in want)
    if cost:
        assert any(b[0][2] < 49 and b[0][0] >= 7 for b in want)


def test_documents_and_attention_bind_on_the_query_path(spark):
    """The packing that op10 runs, with three documents and an attention cost below what 2048 tokens imply."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2500")
    cfg = packing.PackConfig(max_docs=3, max_cost=2_000_000)
    rows = packing.pack_documents(docs, TOKENIZER, cfg, with_ids=False).collect()
    got = {}
    for r in rows:
        got.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(len(x) <= 3 and sum(x) <= 2048 and sum(n * n for n in x) <= 2_000_000 for x in got.values())
    want = one_by_one([r["length"] for r in rows], cfg)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(b[1]) for b in want)


@pytest.mark.parametrize("short", [False, True])
def test_rolling_hashes_tell_windows_apart(short):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 400)
    hashes = T.mix64(words.astype(np.uint64) + np.uint64(99))
    first = np.array([0, 0, 2, 150, 151, 400])
    for width in (1, 3, 5, 12):
        got, begin = T.windows(hashes, first, width, short)
        want = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = [tuple(words[i : i + width]) for i in range(a, b - width + 1)]
            want.append(own or ([tuple(words[a:b])] if short and b > a else []))
        assert np.diff(begin).tolist() == [len(x) for x in want]
        flat_want = [x for own in want for x in own]
        assert len(set(got.tolist())) == len(set(flat_want)) == len(set(zip(got.tolist(), flat_want, strict=True)))


def test_template_votes_decide_where_markup_tells_nothing(spark):
    """All names, roles and telling tags gone: what is the same on a site's pages still goes, what varies stays."""
    site = '<html><body><div><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div><div><p>Welcome to {h}, a place for readers of all kinds.</p></div><div><h1>Title {i}</h1>{ps}</div><div><p>Copyright {h}, all rights reserved, since long ago.</p></div></body></html>'
    rng = random.Random(2)
    body = lambda i: [f"Paragraph {k} of page {i} says {rng.randrange(10**9)} things at length." for k in range(1 + i % 4)]
    pages, want = [], []
    for h in ("one.example", "two.example"):
        for i in range(12):
            ps = body(i)
            pages.append((len(pages), f"http://{h}/{i}", site.format(h=h, i=i, ps="".join(f"<p>{x}</p>" for x in ps))))
            want.append("\n".join([f"Title {i}", *ps]))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = lambda cfg: [r["text"] for r in sorted(html_main.extract_main(df, cfg).collect(), key=lambda r: r["page_id"])]
    assert text(html_main.WrapperConfig()) == want
    assert all(a != b for a, b in zip(text(html_main.WrapperConfig(least_pages=10**9)), want, strict=True))


def test_extraction_edges(spark):
    page = "<html><body><article><h1>T</h1><p>Body {}</p></article></body></html>"
    rows = [(1, "http://a.example/1", page.format(1), "x"), (1, "http://a.example/1", page.format(1), "x"), (None, None, page.format(2), "y"), (3, "http://a.example/3", None, "z"), (4, "not a url", "", "z"), (5, "http://b.example", "<p>" + "long words " * 200_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["n_chars"], r["text"][:20]) for r in html_main.extract_main(df).collect()))
    assert got == [(0, 8, "T\nBody 2"), (1, 8, "T\nBody 1"), (1, 8, "T\nBody 1"), (3, 0, ""), (4, 0, ""), (5, 2_199_999, "long words long word")]
    assert html_main.extract_main(df.where(F.lit(False))).count() == 0


def test_other_splits_go_through_the_tokenizer(tmp_path):
    """A file with another pre-tokenizer is not taken for the published one."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(TOKENIZER, encoding="utf-8").read())
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    at = tmp_path / "other.json"
    at.write_text(json.dumps(spec), encoding="utf-8")
    own, plain = packing.Encoder(str(at)), Tokenizer.from_file(str(at))
    assert packing.Encoder(TOKENIZER).published and not own.published
    for text in ("plain words here", "", "It's 12 o'clock"):
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids
