"""License scan, lattice scores, byte-level BPE, multi-index, HTML extraction."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from cases import edge_rows, repeated_rows
from pyspark.sql import Row

from leadspark.llm import bpe, html, lattice, licenses, multiindex

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -------------------------------------------------------------------- licenses

def naive_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(text))
    places = [(i, label) for label, phrase in licenses.PHRASES for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("name", ["edge", "repeated", "empty", "documents"])
def test_base_phrases_equal_brute_force(request, name):
    df = request.getfixturevalue(name)
    want = Counter((i, *naive_licenses(t)) for i, t in pairs(df))
    found = licenses.scanned(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in found) == want
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} for r in found)


def test_license_texts_with_gaps(make):
    notices = dict(licenses.TEXTS)
    changed = notices["bsd"].split()
    changed[10:10] = ["some", "words", "put", "in"]
    del changed[30:32]
    rows = [(1, "code " * 50 + notices["mit"].upper() + " more" * 50, "", "", 0, "", "", 0),
            (2, " ".join(changed), "", "", 0, "", "", 0),
            (3, " ".join(notices["isc"].split()[:12]), "", "", 0, "", "", 0),
            (4, "and to the use of software in this list", "", "", 0, "", "", 0)]
    got = {r["doc_id"]: r for r in licenses.scanned(make(rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["score"] == 1.0
    assert got[2]["labels"] == "bsd" and 0.6 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.6
    assert got[4]["labels"] == "" and got[4]["score"] == 0


def test_license_plan_is_native(documents):
    plan = licenses.scanned(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --------------------------------------------------------------------- lattice

def spelled_by_hand(lat, word):
    """log Q by listing every segmentation."""
    text = "▁" + word
    total = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(text[start:i])
                start = i
        parts.append(text[start:])
        options = []
        for p in parts:
            ways = [lat.log[lat.ids[p]]] if p in lat.ids else []
            if len(p) == 1:
                ways.append(sum(lat.log[lat.byte[b]] for b in p.encode()))
            options.append(ways)
        total += [sum(c) for c in itertools.product(*options)]
    top = max(total)
    return top + math.log(sum(math.exp(t - top) for t in total)) + math.log(lattice.STOP / (1 - lattice.STOP))


def test_forward_sums_all_segmentations():
    lat = lattice.Lattice(PIECES)
    words = ["the", "étions", "zq#1", "你好a", "x", "", "tion"]
    for word, got in zip(words, lat.spelled(words)):
        assert abs(got - spelled_by_hand(lat, word)) < 1e-9
    assert math.isfinite(lat.spelled(["ab" * 20_000])[0])
    assert len(lat.spelled([])) == 0


def test_expected_uses():
    lat = lattice.Lattice(PIECES)
    into = np.zeros(len(lat.prior))
    lat.expect(["tion"], into)
    # every segmentation spells the word's five characters
    names = {i: p for p, i in lat.ids.items()}
    assert abs(sum(into[i] * len(names[i]) for i in np.flatnonzero(into) if i in names)
               + sum(into[i] / (3 if i in (lat.byte[0xE2], lat.byte[0x96], lat.byte[0x81]) else 1)
                     for i in lat.byte.values()) - 5) < 1e-6


@pytest.mark.parametrize("name", ["edge", "repeated", "documents"])
def test_scores_equal_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = pairs(df)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, brute.words(brute.ascii_lower(t))) for i, t in rows]
    learnt = Counter(w for i, ws in tokens if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(learnt.values()) + ends, len(learnt) + (ends > 0)
    lat = lattice.Lattice(PIECES)
    into = lattice.PRIOR * lat.prior
    lat.expect([w.decode() for w in learnt], into)
    lat.use(into / into.sum())
    base = lambda c: math.log10((c + 1) / (n + v + 1))

    def model(w):
        q = math.exp(lat.spelled([w.decode()])[0])
        return math.log10((learnt[w] + (1 - lattice.END) * (v + 1) * q) / (n + v + 1)) if learnt[w] or q else None

    got = sorted(lattice.scored(df, PIECES).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"]))
    tokens.sort(key=lambda x: (x[0] is None, x[0], len(x[1])))
    assert len(got) == len(tokens)
    known = {}
    for r, (i, ws) in zip(got, tokens):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (i, held(i), len(ws) + 1, n)
        assert r["n_known"] == sum(learnt[w] > 0 for w in ws) + (ends > 0)
        assert math.isclose(r["base_score"], sum(base(learnt[w]) for w in ws) + base(ends), rel_tol=1e-9)
        if max(map(len, ws), default=0) < 100:
            for w in set(ws) - set(known):
                known[w] = model(w)
            want = sum(known[w] for w in ws) + math.log10((ends + lattice.END * (v + 1)) / (n + v + 1))
            assert math.isclose(r["score"], want, rel_tol=1e-6)
        assert math.isfinite(r["score"])


def test_rare_words_are_joined(documents, monkeypatch):
    want = {r["doc_id"]: r for r in lattice.scored(documents, PIECES).collect()}
    monkeypatch.setattr(lattice, "HOT_WORDS", 20)
    for r in lattice.scored(documents, PIECES).collect():
        assert r["n_known"] == want[r["doc_id"]]["n_known"]
        assert math.isclose(r["score"], want[r["doc_id"]]["score"], rel_tol=1e-9)
        assert math.isclose(r["base_score"], want[r["doc_id"]]["base_score"], rel_tol=1e-9)


def test_lattice_without_training(make, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lattice.scored(make([(held, "a b", "", "", 0, "", "", 0)]), PIECES).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])
    assert lattice.scored(empty, PIECES).count() == 0


# ------------------------------------------------------------------------- BPE

def tiktoken_of(codec):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("name", ["edge", "repeated", "documents", "empty"])
def test_ids_equal_the_library(request, name):
    df = request.getfixturevalue(name)
    library = tiktoken_of(bpe._codec(RANKS, public_tokenizers.PATTERN))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in pairs(df):
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect())) == want


def test_random_texts_equal_the_library():
    codec = bpe._codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken_of(codec)
    rng = random.Random(8)
    parts = ["a", "th", "er", "tion", " ", "  ", "\n", "\t", "\x1c", "\xa0", "1", "'s", "é", "你好", "\U0001f600", "!"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    long = "aeiou" * 40_000
    assert codec.encode(long) == library.encode_ordinary(long)


def test_encoded_ids(edge):
    found = {r["doc_id"]: r for r in bpe.encoded(edge, RANKS, public_tokenizers.PATTERN).collect() if r["doc_id"] is not None}
    assert found[0]["ids"] == [] and found[0]["decoded"] == b""
    assert bytes(found[4]["decoded"]) == b"two words"


# ----------------------------------------------------------------- multi-index

def near_brute(rows):
    """(links, component) per place; rows: (id, vector or None)."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float64)
        return v / np.sqrt((v * v).sum())
    units = [unit(v) for _, v in rows]
    links = [(i, j) for i, a in enumerate(units) for j, b in enumerate(units)
             if i < j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9 - 1e-12]
    root = brute.components(range(len(rows)), links)
    n = Counter(x for p in links for x in p)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(i, low.get(root[k], i))
    return Counter((i, n[k], low.get(root[k])) for k, (i, _) in enumerate(rows))


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(100 + k, (base[k % 60] + 0.15 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(240)]
    rows += [(400 + k, rows[5][1]) for k in range(30)]  # copies
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [math.nan] + [1.0] * 15), (504, [math.inf] + [1.0] * 15),
             (505, [None] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[7][1]), (None, None)]
    rows += rows[3:6]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label="x", h1="clash", cell=1) for i, v in rows],
                               "vec_id long, embedding array<float>, label string, h1 string, cell int").repartition(4)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(df).collect())
    assert got == near_brute(rows)
    found = multiindex.near_duplicates(df).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL", 64)
    monkeypatch.setattr(multiindex, "BLOCK", 50)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(900, 64))
    near = [(b * math.cos(a) + math.sin(a) * np.linalg.norm(b) * (u := rng.normal(size=64)) / np.linalg.norm(u))
            for b in base for a in [rng.uniform(0.2, 0.45)]]
    x = np.concatenate([base, near])
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = int((x @ x.T >= 0.9).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = multiindex.near_duplicates(df).collect()
    assert 0.97 * true <= sum(r["n_links"] for r in found) <= true


def test_dense_groups_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 20)
    rng = np.random.default_rng(12)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.2 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(df).collect())
    assert got == near_brute(rows)
    some = df.selectExpr("vec_id as vid", "embedding as v", "1L as copies")
    sample = multiindex.unit(np.array([v for _, v in rows], dtype=np.float64))
    groups = multiindex.dealt(some, multiindex.Grid(sample, 1)).groupBy("cell", "part", "turn").count().collect()
    assert len(groups) == 15 * 15 and max(r["count"] for r in groups) <= 2 * 20


def test_grid_grows_with_the_vectors():
    assert multiindex.centroids(10 ** 9) == int(math.sqrt(10 ** 9 / multiindex.CELL)) and multiindex.centroids(3) == 1


# ------------------------------------------------------------------------ HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- note --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>One  two<br>three<p>Four &lt; five<ul><li>x<li>y</ul><form>Name</form></article>
<section id="comments"><p>First!</p></section><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    none = frozenset()
    assert html.main_text(PAGE, none) == "A & B\nOne two three\nFour < five\nx\ny"
    assert html.main_text("", none) == ""
    assert html.main_text("just text  here", none) == "just text here"
    assert html.main_text("<p>cut &am", none) == "cut &am"
    assert html.main_text("<article><p>kept</p><p cla", none) == "kept"
    assert html.main_text("<article><p class='notice'>n<p>kept</article>", none) == "kept"
    assert html.main_text("<main><p>m</p></main><p>o</p>", none) == "m"
    assert html.main_text("<div hidden>h</div><div role=navigation>n</div><div>t</div>", none) == "t"


def test_template_text_goes(spark):
    rows = [(i, f"http://a.example/{i}", f"<div>Welcome to our site</div><div>story {i} word {i * 7}</div><div>All rights</div>", 1)
            for i in range(8)]
    rows += [(100 + i, "http://b.example/x", "<article><p>same story</p></article>", 1) for i in range(5)]
    rows += [(200, "http://c.example/", "<div>Welcome to our site</div>", 1), (201, None, None, 1), (202, "bad url", "<p>t", 1),
             (None, "http://a.example/9", "<div>Welcome to our site</div><div>other</div><div>All rights</div>", 1)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    got = Counter(map(tuple, html.extracted(df).collect()))
    want = Counter()
    for i, url, _, _ in rows:
        text = ("other" if i is None else f"story {i} word {i * 7}" if i < 100 else "same story" if i < 200 else
                {200: "Welcome to our site", 201: "", 202: "t"}[i])
        want[i, url, text, len(text)] += 1
    assert got == want
    assert html.extracted(df.limit(0)).count() == 0


def test_classes_nest(spark):
    page = "<html><body><div><p>head</p></div><article><h1>{0}</h1><p>{0}</p></article></body></html>"
    rows = [(i, "http://a.example/", page.format(i)) for i in range(4)]
    found = html.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = [r for r in found if r["is_text"]]
    assert len(texts) == 1 and texts[0]["class"] == texts[0]["parent_class"]  # once a page, like the elements around it


def test_template_text_in_articles_goes(spark):
    def story(i):
        return " ".join(f"w{i}x{k}" for k in range(40))
    page = "<html><body><article><h1>t{0}</h1><p>{1}</p><p>Support our paper</p></article></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i, story(i))) for i in range(8)]
    # near copies on a host of their own, and a passage that three articles quote
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>{story(50)}</p><p>{story(51)}</p><p>on day {i}</p></article>")
             for i in range(6)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>{story(200 + i)}</p>" + "<p>quote one</p><p>quote two</p>" * (i < 3)
              + "</article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html.extracted(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(8):
        assert got[i] == f"t{i}\n{story(i)}"
    for i in range(6):
        assert got[100 + i] == f"{story(50)}\n{story(51)}\non day {i}"
    for i in range(9):
        assert got[200 + i] == story(200 + i) + "\nquote one\nquote two" * (i < 3)


def test_words_inside_articles():
    none = frozenset()
    assert html.main_text("<article><h2 id='related-work'>Related work</h2><section id='social-impact'><p>s</p></section>"
                          "<p class='share-prices'>p</p><div class='share'>x</div></article>", none) == "Related work\ns\np"
    assert html.main_text("<article class='post tag-social'><p>kept <a class='related'>link</a></article>", none) == "kept link"
    assert html.main_text("<main><p>own</p><article>teaser</article><p>more</p></main><p>o</p>", none) == "own\nteaser\nmore"


def test_layouts_under_half_of_a_host(spark):
    rows = [(9 * k + i, f"http://a.example/{k}/{i}",
             f"<html><body><div class='layout{'abc'[k]}'><p>Part {'abc'[k]}</p><div>story {k} {i}</div></div></body></html>")
            for k in range(3) for i in range(4)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["url"][-3:], r["text"]) for r in got} == {(f"{k}/{i}", f"story {k} {i}") for k in range(3) for i in range(4)}


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html.extracted(pages).collect():
        assert r["n_chars"] == len(r["text"])
    from html import unescape
    texts = {r["page_id"]: r["text"] for r in html.extracted(pages).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>"):].split("</article>")[0]
        inner = re.sub(r"<[a-zA-Z/][^>]*\Z", "", inner)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)\b[^>]*>", inner)]
        assert texts[r["page_id"]] == "\n".join(p for p in parts if p)


def test_edge_rows_exist():
    assert len(repeated_rows()) > len(edge_rows())
