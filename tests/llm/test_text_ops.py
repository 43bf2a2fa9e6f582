"""Quality rules, SimHash, substring dedup, packing, classifier."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from cases import edge_rows, repeated_rows

from leadspark.llm import fm, lines, packing, recompression, simhash

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------- substring dedup

@pytest.mark.parametrize("name", ["edge", "repeated", "empty", "documents"])
def test_removals_equal_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = pairs(df)
    want = Counter((i, *x) for (i, _), x in zip(rows, brute.substring_dedup([t for _, t in rows])))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
                  for r in recompression.removals(df).collect())
    assert got == want


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(3)
    core = [str(rng.choice("ab")) for _ in range(60)]
    texts = [[rng.choice("abc").encode() for _ in range(rng.randrange(0, 80))] + [c.encode() for c in core]
             + [rng.choice("abc").encode() for _ in range(rng.randrange(0, 80))] for _ in range(200)]
    h, first = recompression._laid(texts)
    starts, found, _ = recompression.anchors(h, first)
    by_content = defaultdict(set)
    for s, a in zip(starts, found):
        by_content[h[s:s + 35].tobytes()].add(a)
    assert max(map(len, by_content.values())) == 1


def test_deduplicated_keeps_columns(edge, empty):
    out = recompression.deduplicated(edge)
    assert out.schema == edge.schema and out.count() == edge.count()
    rows = {r["doc_id"]: r for r in out.filter("doc_id is not null").collect()}
    assert rows[3]["text"] == "one" and rows[0]["text"] is None and rows[1]["text"] == ""
    doubled = rows[16]
    assert doubled["text"] == "" and doubled["n_chars"] == 0
    assert recompression.deduplicated(empty).count() == 0


# -------------------------------------------------------------------- SimHash

def test_components_equal_brute_force(documents, edge):
    for df in (documents, edge.filter("doc_id is not null")):
        found = simhash.near_duplicates(df).collect()
        got = {(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found}
        assert got == brute.simhash(pairs(df))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4)]
    prints = np.unique(np.concatenate([base, *near]))
    want = {(a, b) for i, a in enumerate(prints.tolist()) for b in prints[i + 1:].tolist() if (a ^ b).bit_count() <= 2}
    tree = simhash.Tree(prints, 40)
    assert tree.shards > 5
    pieces, lived = [], 0
    for _, at, home in tree.route(prints, 2):
        lived += home.sum()
        order = np.argsort(prints[at])
        root = simhash.linked(prints[at][order], home[order], 2)
        pieces += [(int(prints[at][order][i]), int(prints[at][order][r])) for i, r in enumerate(root) if i != r]
    assert lived == len(prints)
    items = prints.tolist()
    assert brute.components(items, pieces) == brute.components(items, want)


def test_simhash_edge_rows(repeated, empty):
    found = simhash.near_duplicates(repeated).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in repeated_rows())
    blank = [r for r in found if r["doc_id"] in (0, 1, 2)]
    assert {(r["fp"], r["component_id"]) for r in blank} == {(0, 0)}
    assert simhash.near_duplicates(empty).count() == 0


def test_first_of_each(repeated, edge, empty):
    out = simhash.first_of_each(repeated)
    assert out.columns == repeated.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[0] == 1 and not ids[1] and not ids[2]
    assert ids[5] == 1 and ids[6] == 1
    assert simhash.first_of_each(empty).count() == 0


def test_first_of_each_without_ids(make):
    def row(i, text):
        return (i, text, "", "", 0, "", "", 0)
    one, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    # the second of each pair differs in case only: an equal fingerprint, another text hash
    rows = [row(None, one), row(None, one.upper()), row(None, other), row(None, other), row(None, other.upper()),
            row(7, "with an id"), row(None, "with an id"), row(None, "With an ID")]
    out = simhash.first_of_each(make(rows)).collect()
    assert Counter(r["text"].lower() for r in out) == {one: 1, other: 1, "with an id": 1}
    assert [r["doc_id"] for r in out if r["text"].lower() == "with an id"] == [7]


# ----------------------------------------------------------------- components

def test_components_of_paths_and_stars(spark):
    from leadspark.llm.common import components
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(5, 5)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert got == want


# -------------------------------------------------------------- quality rules

def naive_repeats(words):
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({p for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)})


def test_measures():
    rng = random.Random(4)
    for _ in range(50):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 60))]
        assert lines.repeat_words(w) == naive_repeats(w)
    assert lines.measure("Ünï #a\n\n#a\t|\n#a\t|\n".encode()) == (6, 11, 5, 1, 0)
    assert lines.measure(b"") == (0, 0, 0, 0, 0)


def test_line_frequency(make):
    rng = random.Random(5)
    fresh = lambda n: " ".join(str(rng.random()) for _ in range(n))
    rows = [(i, f"{fresh(30)}\nSubscribe to our  LETTER every week\n{fresh(30)}", "en", "a", 1, "", "", 0) for i in range(30)]
    rows += [(100 + i, f"{fresh(5)}\nsubscribe to our letter every week\n" * 3 + fresh(14 - 14 % 7), "en", "a", 1, "", "", 0) for i in range(3)]
    rows += [(200, f"subscribe to our letter every week\n{fresh(40)}", "en", "b", 1, "", "", 0)]
    whole = "\n".join(fresh(8) for _ in range(6))
    rows += [(300 + i, whole + f"\n{fresh(6)}", "en", "a", 1, "", "", 0) for i in range(40)]
    found = {r["doc_id"]: r for r in lines.decided(make(rows)).collect()}
    assert found[0]["kept"] and found[0]["n_removed_words"] == 6
    assert found[200]["n_removed_words"] == 0  # not frequent at its host
    assert all(found[300 + i]["kept"] and found[300 + i]["n_removed_words"] == 0 for i in range(40))  # copies
    out = {r["doc_id"]: r for r in lines.applied(make(rows)).collect()}
    assert "LETTER" not in out[0]["text"] and out[0]["text"].count("\n") == 1
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[200]["n_chars"] == 1


def test_depleted_documents_go(make):
    rng = random.Random(6)
    fresh = lambda n: " ".join(str(rng.random()) for _ in range(n))
    menu = [f"entry number {k} of the long menu" for k in range(12)]
    rows = []
    for i in range(60):
        picked = rng.sample(menu, 5)
        rows.append((i, "\n".join(x for m in picked for x in (m, fresh(2))), "en", "a", 1, "", "", 0))
    found = lines.decided(make(rows)).collect()
    assert all(not r["kept"] and not r["base_failed"] for r in found)
    assert lines.applied(make(rows)).count() == 0


def test_quality_edge_rows(repeated, empty):
    found = lines.decided(repeated).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in repeated_rows())
    assert all(r["base_failed"] and not r["kept"] for r in found if r["doc_id"] in (0, 1, 2, 3))
    assert lines.applied(repeated).columns == repeated.columns
    assert lines.decided(empty).count() == 0 and lines.applied(empty).count() == 0


# -------------------------------------------------------------------- packing

@pytest.mark.parametrize("name", ["edge", "repeated", "documents", "empty"])
def test_every_id_is_packed_once(request, name):
    from tokenizers import Tokenizer
    df = request.getfixturevalue(name)
    whole = Tokenizer.from_file(VOCABULARY)
    rows = pairs(df)
    ids = [whole.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    got = packing.packed(df, VOCABULARY, shard_tokens=50_000).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    full = sum(sum(n for _, n in parts) == 4096 for parts in sequences.values())
    assert full >= len(sequences) - len({s >> 32 for s in sequences})
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter((i, len(x)) for (i, _), x in zip(rows, ids))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    if name in ("documents",):
        by_id = {i: x for (i, _), x in zip(rows, ids)}
        held = Counter()
        for r in got:
            part = by_id[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert crc(part) == r["ids_crc32"]
            held[r["doc_id"]] += r["length"]
        assert held == {i: len(x) for i, x in by_id.items()}
    else:
        assert sum(r["length"] for r in got) == sum(map(len, ids))


def test_weights_are_those_of_the_corpus(documents):
    # token 5 is rare here and common in the corpus, token 6 the other way round
    docs = [np.array(d, dtype=np.int64) for d in ([5, 6], [5, 7], [6, 8], [6, 9], [6, 10])]
    corpus = packing.Statistics(1000, 2.0, np.array([0] * 5 + [900, 4] + [1] * 4))
    assert [p[0] for p in packing.arranged(docs, 11, width=4)][:2] == [0, 1]
    assert [p[0] for p in packing.arranged(docs, 11, width=4, corpus=corpus)][:2] == [0, 2]
    e = packing.encoder(VOCABULARY)
    ids = list(e.encode([(r["text"] or "").encode() for r in documents.select("text").collect()]))
    held = [np.frombuffer(x, dtype=e.kind) for x in ids]
    want = np.bincount(np.concatenate([np.unique(v) for v in held]))
    got = packing.statistics(packing.encoded(documents.repartition(4), VOCABULARY), VOCABULARY)
    assert got.n == len(held) and np.array_equal(got.df, want) and abs(got.mean - np.mean([len(v) for v in held])) < 1e-6


def test_neighbours_follow_their_seed():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 300, 400) for k in range(5)]
    docs = [rng.permutation(topics[k % 5])[:200].astype(np.uint16) for k in range(50)]
    pieces = list(packing.arranged(docs, 49408, width=1000))
    by_sequence = defaultdict(list)
    for doc, _, _, sequence, _ in pieces:
        by_sequence[sequence].append(doc % 5)
    assert sum(len(set(x)) == 1 for x in by_sequence.values()) >= 8


# ----------------------------------------------------------------- classifier

def test_interactions_equal_the_double_sum():
    rng = np.random.default_rng(1)
    machine = fm.Machine(rng)
    machine.w = rng.normal(size=machine.w.shape)
    rows = [fm.features(t.encode()) for t in ("a b c d e", "", "x | y | z ### 12")]
    batch = fm.Batch(rows)
    got = machine.score(batch)
    for k, (index, stats) in enumerate(rows):
        n = max(1, len(index))
        x = [(i, n ** -0.5) for i in index] + [(fm.BUCKETS + j, s) for j, s in enumerate(np.clip(stats, -4, 4))]
        y = sum(machine.w[i] * v for i, v in x)
        y += sum(machine.v[i] @ machine.v[j] * v * u for a, (i, v) in enumerate(x) for j, u in x[a + 1:])
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(y, -30, 30)))) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fm.scored(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 80
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_classifier_edge_rows(spark, repeated, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 0), (None, 1, 1), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    found = fm.scored(repeated, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in repeated_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    assert fm.scored(empty, labels).count() == 0
    none = fm.scored(repeated, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert fm.accepted(repeated, labels.limit(0)).count() == len(repeated_rows())
    assert len(edge_rows()) < len(repeated_rows())


# ------------------------------------------------------------------- pipeline

def test_pipeline_stages_pass_their_columns_on(spark, repeated, empty, tmp_path):
    import corpus_pipeline

    labels = [(i, int(i % 3 > 0), 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (repeated, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            docs = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_run_equals_its_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_id = {r["doc_id"]: r for r in lines.decided(docs).collect()}
    assert sum(r["kept"] for r in by_id.values()) > 100
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen = stage(spark, seen, sf)
        if name == "simhash_near_dedup":
            # one document of each component of what came in is left
            prints = brute.simhash(pairs(seen))
            assert all(i == component for i, _, component in prints)
        if name == "substring_dedup":
            kept = brute.substring_dedup([t for _, t in pairs(seen)])
            assert [n for n, _, _ in kept] == [len(brute.words(t)) for _, t in pairs(seen)]
    left = dict(pairs(seen))
    assert set(left) <= set(texts)
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(left)
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(VOCABULARY)
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_boilerplate_blocks_go_whole_and_copies_stay(make):
    """A footer of short and long lines goes from all its documents; near copies of a
    clean text, edited in different places, keep all their words."""
    rng = random.Random(7)
    fresh = lambda n: " ".join(str(rng.random()) for _ in range(n))
    footer = "About us and what we do all day\nRead more\nTerms of use here\nAccept all cookies\nAll rights reserved by the owners"
    rows = [(i, f"{fresh(40)}\n{footer}", "en", "a", 1, "", "", 0) for i in range(60)]
    clean = [fresh(9) for _ in range(20)]
    for i in range(400):
        lines_ = list(clean)
        for k in rng.sample(range(20), 2):
            lines_[k] = fresh(9)
        rows.append((1000 + i, "\n".join(lines_), "en", "a", 1, "", "", 0))
    found = {r["doc_id"]: r for r in lines.decided(make(rows)).collect()}
    words = len(footer.split())
    assert all(found[i]["n_removed_words"] == words and found[i]["kept"] for i in range(60))
    assert all(found[1000 + i]["n_removed_words"] == 0 and found[1000 + i]["kept"] for i in range(400))


def test_columns_of_any_name_pass(make):
    from pyspark.sql import functions as F
    own = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(30))
    docs = make([(i, own(i) + "\nsame footer", "en", "a", 1, "", "", 0) for i in range(30)])
    for name in ("__h", "__id", "__kept", "__removed", "mark", "row", "best", "root", "fp"):
        docs = docs.withColumn(name, F.lit(name))
    assert simhash.first_of_each(docs).columns == docs.columns and simhash.first_of_each(docs).count() == 30
    out = lines.applied(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(i, own(i)) for i in range(30)}
