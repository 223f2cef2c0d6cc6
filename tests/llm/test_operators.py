import hashlib
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterline.llm import chaining, components, cotraining, fingerprints, mixing, near, pieces, quality_rules, similar, simhash, suffixes, token_counts, treescore
from meterline.llm.common import text_chunks
from meterline.llm.registry import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
PARTS = ["ab", "the", "Q.", "zz é", "hello\n", " ", "\t", "###", "don't", "梦", "x"]


def prose(rnd, n):
    return " ".join(rnd.choice(PARTS) + str(rnd.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, short, periodic and long texts, copies, ties and repeated rows; passages shared by documents."""
    rnd = random.Random(3)
    shared = [prose(rnd, 90) for _ in range(4)]
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a" * 401), (6, "b" * 3000), (7, "Is " * 700), (8, shared[0]), (9, shared[0]),
           (9, shared[0]), (10, shared[0][5:]), (None, shared[1]), (None, None), (11, "<|endoftext|> it's we're\n\n a  b")]
    for i in range(20, 60):
        out.append((i, prose(rnd, rnd.randint(0, 60)) + rnd.choice(shared)[rnd.randint(0, 40):rnd.randint(300, 800)] + prose(rnd, rnd.randint(0, 40))))
    for i in range(60, 70):
        t = list(shared[2] + shared[3])
        t[rnd.randrange(len(t))] = "#"
        out.append((i, "".join(t)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, "en" if (d or 0) % 3 else None, None if (d or 0) % 5 == 0 else f"s{(d or 0) % 4}", None, 7, "x", 1) for d, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, component_id int").repartition(5)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)


def chunks(texts):
    for part, text in text_chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), limit=3000):
        yield part.column("text").to_pylist(), text


def test_suffix_dedup(docs, rows, no_docs):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = [tuple(r) for r in suffixes.find_and_cut(docs).select(*names).collect()]
    assert Counter(got) == Counter(brute.suffix_dedup(rows))
    assert suffixes.find_and_cut(no_docs).count() == 0


def test_multikey_order():
    rnd = np.random.default_rng(1)
    keys = [rnd.integers(0, 5, 1000), rnd.integers(0, 5, 1000), rnd.integers(0, 5, 1000)]
    order = suffixes.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))


def test_token_counts_of_every_prefix():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    lib = Tokenizer.from_file(path)
    rnd = random.Random(1)
    alphabet = ["'s", "'re", "'", "''", "l", " ", "  ", "\n", "\n\n", "\t", "a", "ing", " don't", "23", "é", "漢字", "\xa0", "!", "😀", "\x85", "²"]
    texts = ["", None, " ", "  a", "a  b"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    for some, text in chunks(texts):
        counts, where = token_counts.prefix_counts(text, path)
        for i, t in enumerate(some):
            t = t or ""
            want = [len(e.ids) for e in lib.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
            assert counts[where[i]:where[i + 1]].tolist() == want


def test_token_count_query(docs, rows, no_docs):
    lib = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(docs).collect())
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == Counter((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(rows, n))
    table = token_counts.prefix_table(docs).filter("doc_id = 10").select(token_counts.tokens_in_prefix(F.col("counts"), 40).alias("n")).first()
    assert table.n == len(lib.encode(dict(rows)[10][:40], add_special_tokens=False).ids)
    assert token_counts.counted(no_docs).count() == 0


def test_pieces_equal_the_library(docs, rows, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rnd = random.Random(1)
    alphabet = ["'s", "l", " ", "    ", "\n", "the", "ing", "23", "é", "漢字", "<s>", "<0x41>", "😀", "\x85", "▁", "lllll", "-----"]
    texts = ["", None, "  a"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    m = pieces.model(pieces.MODEL)
    for some, text in chunks(texts):
        ids, bounds = pieces.encode_batch(text, m)
        for i, t in enumerate(some):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == lib.encode(t or "")
    for r in pieces.encode(docs).collect():
        assert r.round_trip
    back = {r.doc_id: r.text for r in pieces.decode(pieces.with_pieces(docs)).collect()}
    assert all(back[d] == (t or "") for d, t in rows if d is not None)
    assert pieces.encode(no_docs).count() == 0


def test_quality_rules(docs, rows, no_docs):
    for r in quality_rules.measured(docs.filter("doc_id IS NOT NULL")).collect():
        want = brute.quality_base(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.measured(no_docs).count() == 0
    assert quality_rules.kept(docs).columns == docs.columns


def test_quality_rules_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    long = got[got.n_words >= 50]
    assert long[long.quality == 1].kept.mean() > 0.97 and not got[got.quality == 0].kept.any()


def test_mixing(docs, rows, no_docs):
    got = mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want = brute.mix_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(brute.words(t))) for d, t in rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_WORDS for s in sizes)
    again = mixing.mixed(docs.repartition(3)).select("doc_id", "size", "taken").collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    mix = mixing.taken_texts(docs)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(brute.words(r.text))
    assert words == +taken
    assert mixing.mixed(no_docs).count() == 0


def test_quotas_are_highest_quotients(spark):
    votes = {"a": 530.0, "b": 240.0, "c": 160.0, "d": 70.0, "e": 0.0}
    table = spark.createDataFrame([(k, v, 1000.0) for k, v in votes.items()], "__key string, target double, __total double")
    got = {(r.shard, r["__key"]): r.quota for r in mixing.quotas(table, block_words=20, shards=4).collect()}
    seats = sorted(((v / (2 * k + 1), s) for s, v in votes.items() for k in range(60)), key=lambda x: (-x[0], x[1]))
    for shard in range(1, 5):
        want = Counter(s for _, s in seats[:50 * shard // 4])
        assert {s: sum(got[(j, s)] for j in range(1, shard + 1)) for s in votes} == {s: want[s] for s in votes}


def test_tree_scores(docs, rows, no_docs):
    some = [(d, (t or "")[:600] if t else t) for d, t in rows[:30]]
    table = docs.sparkSession.createDataFrame(some, "doc_id bigint, text string")
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in some]
    train = [t for (_, t), h in zip(some, held) if not h]
    tokens = lambda t: [*brute.words(brute.low(t)), None]
    count = Counter(x for t in train for x in tokens(t))
    total, types = sum(count.values()), len(count)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in treescore.scored(table).collect()]
    want = []
    for (d, t), h, s in zip(some, held, brute.tree_scores(train, [t for _, t in some])):
        k = tokens(t)
        base = sum(math.log10((count[x] + 1) / (total + types + 1)) for x in k)
        want.append((d, h, len(k), sum(count[x] > 0 for x in k), total, base, s))
    in_order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))
    for g, w in zip(in_order(got), in_order(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6)
    assert treescore.scored(no_docs).count() == 0


def test_tree_memory(monkeypatch):
    """Trees are built some grams at a time: the same values, and memory that does not grow with the grams of a task."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 200_000).astype(np.uint64))
    n = rng.integers(0, 5, len(keys))
    one = treescore.deep_levels(keys, n)[-1].parent()
    level = treescore.Level(*one)
    tops = [level, treescore.Level(*level.parent())]
    tracemalloc.start()
    got = treescore.predicted(keys, n, tops)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    monkeypatch.setattr(treescore, "BUNCH", 1 << 40)
    assert (got == treescore.predicted(keys, n, tops)).all()
    monkeypatch.setattr(treescore, "BUNCH", 1000)
    for a, b in zip(treescore.upper_nodes(keys, n), one, strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_tree_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    assert (treescore.Lookup(keys).find(keys[::-1]) == np.arange(len(keys))[::-1]).all()


def test_chaining(spark, docs, no_docs):
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randint(0, 9000)}" for _ in range(n)]
    shared = [fresh(rnd.randint(55, 120)) for _ in range(5)]
    rows, where = [], {}
    for i in range(60):
        w, p = fresh(rnd.randint(20, 150)), rnd.randrange(7)
        if p < 5:
            x = list(shared[p])
            if i % 3 == 0:
                x[len(x) // 2] = "edited"
            at = rnd.randint(0, len(w))
            where[i] = (p, at, len(x))
            w = w[:at] + x + w[at:]
        rows.append((i, " ".join(w)))
    spans = {r["__id"]: [tuple(s) for s in r["__spans"]] for r in chaining.removals(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    first = set()
    for i, (p, at, n) in where.items():
        if p in first:
            assert any(lo <= at + 2 and hi >= at + n - 2 for lo, hi in spans[i])
        else:
            assert i not in spans
        first.add(p)
    assert set(spans) <= set(where)
    assert chaining.dedup(docs).columns == docs.columns and chaining.dedup(no_docs).count() == 0


def test_chaining_past_quotes(spark):
    """Passages in documents a and a + 4, shorter quotes of them in the three between: only the copy loses its passage."""
    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    rows, want = [], {}
    for a in range(0, 300, 5):
        x = fresh(n := rnd.choice((40, 45, 60, 100)))
        for i in range(5):
            at, size = (0, n) if i in (0, 4) else (rnd.randint(0, n - 25), 25)
            w, where = fresh(60), rnd.randint(0, 60)
            rows.append((a + i, " ".join(w[:where] + x[at:at + size] + w[where:])))
        want[a + 4] = [(where, where + n)]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = {r["__id"]: sorted(tuple(s) for s in r["__spans"]) for r in chaining.removals(docs).collect()}
        assert got == want


def test_chain_order_and_gaps():
    p, q = np.array([0, 5, 10, 12, 400]), np.array([100, 105, 110, 3, 500])
    assert [c.tolist() for c in chaining.chains(p, q)] == [[0, 1, 2], [3], [4]]


def test_fingerprints(docs, rows, no_docs):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, follow = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - h] + follow[:h]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = {}
    for r in got:
        if r.doc_id in (8, 9):
            prints.setdefault(r.doc_id, r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[8] == prints[9]
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_fingerprint_sees_order(spark):
    rnd = random.Random(2)
    w = [f"w{i}" for i in range(2000)]
    edit, moved = list(w), list(w)
    edit[1000] = "new"
    rnd.shuffle(moved)
    sig = lambda x: fingerprints.signature(F.lit(" ".join(x)))
    near, far = spark.range(1).select(fingerprints.likeness(sig(w), sig(edit)), fingerprints.likeness(sig(w), sig(moved))).first()
    assert near > 0.9 and far < 0.2


def test_cotraining(spark, docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_cotraining"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 and (~got[got.quality == 0].kept).mean() > 0.8
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert cotraining.kept(docs, none).count() == docs.count() and cotraining.kept(docs, none).columns == docs.columns
    assert cotraining.scored(no_docs, none).count() == 0


def test_cotraining_fits_in_a_task(spark, monkeypatch):
    """The driver gets ids and labels of the sample and the fitted weights, never the features."""
    plain, got = type(spark.range(1)).toArrow, []
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: got.append(self.columns) or plain(self))
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert cotraining.train(read("documents"), read("labels")) is not None
    assert got == [["doc_id", "__quality"]]


def test_cotraining_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 3 != 0")
    got = cotraining.scored(spark.read.parquet(f"{sf}/documents.parquet"), seen).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95


def test_simhash(docs, rows, no_docs):
    prints, classes = simhash.clustered(docs)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in prints.join(classes, "fp").collect())
    want = [(d, brute.simhash(t)) for d, t in rows]
    assert got == Counter((d, f, c) for (d, f), c in zip(want, brute.near_components(want)))
    left = simhash.representatives(docs)
    assert left.columns == docs.columns and left.filter("doc_id IN (8, 9)").count() == 1
    assert simhash.representatives(no_docs).count() == 0


def test_simhash_ball(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    near = [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))) for x in base for _ in range(4)]
    prints = sorted(set(base + near))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    fps = spark.createDataFrame(signed, "fp bigint")
    joined = {r.node & (1 << 64) - 1: r.component for r in components.components(simhash.linked(simhash.with_partner(fps))).collect()}
    groups = {}
    for x in prints:
        groups.setdefault(joined.get(x, x), set()).add(x)
    want = {}
    for x, c in zip(prints, brute.near_components([(i, x) for i, x in enumerate(prints)])):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def _close(have: list[set], i: int, j: int) -> bool:
    return 5 * len(have[i] & have[j]) >= 4 * len(have[i] | have[j])


def test_near_dedup_against_all_pairs(spark, monkeypatch):
    """Copies with a few words changed, in a group whose shingles are frequent; the exact join of similar.py is held to the same."""
    monkeypatch.setattr(similar, "SAMPLE", 1)
    rnd = random.Random(6)
    rows, base = [], [[f"w{rnd.randint(0, 9000)}" for _ in range(rnd.choice((6, 40, 150, 400)))] for _ in range(12)]
    for i in range(240):
        w = list(base[i % 12] if i % 3 else base[0])
        for _ in range(rnd.randint(0, max(1, len(w) // 40))):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9000)}"
        rows.append((i, "license of the common kind and so on " * (i % 2) + " ".join(w)))
    have = [brute.shingles(t) for _, t in rows]
    group, near_pairs = list(range(240)), 0
    for i in range(240):
        for j in range(i):
            if _close(have, i, j):
                near_pairs += have[i] != have[j]
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert near_pairs > 100 and 12 < len(set(group)) < 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    left = simhash.representatives(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(group))
    exact = {}
    for r in similar.grouped(docs, 5).collect():
        exact.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(min, exact.values())) == sorted(set(group))


def test_near_dedup_recall_of_lone_pairs(spark):
    """Pairs of different sets just above the threshold, each a group of its own, so nothing else can join them."""
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        w = [f"p{i}w{rnd.randint(0, 9000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for at in (40, 90, 140, 190)[:rnd.randint(2, 4)]:
            w[at] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    have = [brute.shingles(t) for _, t in rows]
    close = [i for i in range(150) if _close(have, 2 * i, 2 * i + 1)]
    assert len(close) > 100
    left = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left >= {2 * i for i in range(150)}
    assert sum(2 * i + 1 not in left for i in close) >= 0.95 * len(close)
    assert all(2 * i + 1 in left for i in range(150) if i not in close)


def test_near_dedup_links_grow_with_the_rows(spark):
    """Near copies of one text, most pairs below the threshold: links stay in proportion, and no false one is kept."""
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(120)]
    counts = []
    for n in (200, 400):
        rows = []
        for i in range(n):
            w = list(base)
            for at in rnd.sample(range(120), 2):
                w[at] = f"x{i}"
            rows.append((i, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        have = [brute.shingles(t) for _, t in rows]
        each = near.described(docs, 5).withColumn("component", F.col("node"))
        counts.append(near.linked(near.emitted(each, 0), 0).count())
        group = list(range(n))
        for i in range(n):
            for j in range(i):
                if _close(have, i, j):
                    x, y = group[i], group[j]
                    group = [min(x, y) if g in (x, y) else g for g in group]
        left = sorted(r.doc_id for r in simhash.representatives(docs).collect())
        assert set(group) <= set(left) and n - len(left) >= 0.9 * (n - len(set(group)))
    assert counts[1] <= 136 * 400 and counts[1] < 2.6 * counts[0]


def test_near_dedup_candidates_of_a_large_group(spark):
    """Copies of one text that are too unlike to be linked share many buckets, but no set is sent for them; real copies among them are."""
    rnd = random.Random(13)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(120)]
    for n in (200, 400):
        rows = []
        for i in range(n):
            w = list(base)
            for at in rnd.sample(range(120), 4):
                w[at] = f"x{i}"
            rows.append((i, " ".join(w)))
        rows += [(n + i, rows[i][1] + " end") for i in range(0, n, 10)]
        each = near.described(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).withColumn("component", F.col("node"))
        have = {r.node: brute.shingles(rows[r.doc_id if r.doc_id < n else n + (r.doc_id - n) // 10][1]) for r in each.collect()}
        both = [each, each.join(near.shared(each), "node")]
        some, same = ({(r.a, r.b) for r in near.linked(near.emitted(x, 0), 0).collect()} for x in both)
        assert some == same  # variants without another set have no link
        assert n // 10 <= len(some) < 1.5 * n
        assert sum(5 * len(have[a] & have[b]) >= 4 * len(have[a] | have[b]) for a, b in some) >= n // 10


def test_near_dedup_links_across_batches(spark):
    rnd = random.Random(14)
    base = [f"w{rnd.randint(0, 9000)}" for _ in range(700)]
    rows = [(i, " ".join(f"x{i}" if j in some else w for j, w in enumerate(base)))
            for i in range(60) for some in [rnd.sample(range(700), i % 9)]]
    each = near.described(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).withColumn("component", F.pmod("node", F.lit(40)))
    got = []
    for size in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append({(r.a, r.b) for r in near.linked(near.emitted(each, 1), 1).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and len(got[0]) > 50


def test_sketches_rule_out_no_link():
    rnd = np.random.default_rng(15)
    ruled_out = 0
    for n in (1, 4, 5, 9, 100, 500, 512, 513, 560, 1000, 1030, 4000, 16_000, 18_000, 40_000):
        base = rnd.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        for less, more in ((0, n // 4), (n // 5, 0), (n // 10, n // 10), (n // 9, n // 9), (n // 3, n // 3), (n, n)):
            x, y = base[:n], base[less:n + more]
            a, b = (similar.sketches(z, np.array([len(z)]))[0] for z in (x, y))
            union = n + more
            may = near.may_link(len(x), len(y), a, b)
            assert may == near.may_link(len(y), len(x), b, a)
            assert may or 5 * (n - less) < 4 * union
            ruled_out += not may and n >= 100
    assert ruled_out > 15


def test_near_dedup_keeps_one_row(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, "lone words of a text", "u"),
            (1, "another text under the first id", "v"), (None, None, "n"), (4, " ", "e"), (4, "", "e"), (None, "lone words of a text", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    left = simhash.representatives(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "").strip()) for r in left.collect()) == Counter(
        [(1, "a b c d e f"), (1, "another text under the first id"), (None, "lone words of a text"), (4, "")])
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 1 << 63, 60_000).astype(np.uint64)
    some = [base[:n] for n in (0, 3, 500, 513, 900, 1030, 2000, 4100, 30_000, 37_000)] + [base[n:2 * n] for n in (500, 1030, 20_000)]
    bits = similar.Sketches(similar.sketches(np.concatenate(some), np.array([len(x) for x in some])))
    for i, x in enumerate(some):
        apart = bits.apart(i, np.arange(len(some)))
        assert all(a <= len(np.setxor1d(x, y)) for a, y in zip(apart, some))
    assert bits.apart(2, np.array([10]))[0] > 300 / 2 and bits.apart(5, np.array([11]))[0] > 2060 / 4.5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Rounds of the near-duplicates start from stars: links that are stars already are written once and not joined again."""
    made, real = [], components.session.checkpoint
    monkeypatch.setattr(components.session, "checkpoint", lambda df: made.append(1) or real(df))
    links = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(41, 40), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(30)} | {40: 40, 41: 40} and len(made) == 1
    joined = components.components(spark.createDataFrame([(1, 0), (2, 1), (4, 3)], "a bigint, b bigint"))
    stars = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    more = stars.unionByName(spark.createDataFrame([(4, 2), (6, 5)], "a bigint, b bigint"))
    assert {r.node: r.component for r in components.components(more).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}


def test_near_dedup_joins_only_new_links(spark, monkeypatch):
    """Components are sought after a round only if it found links, and each set is made from its text once."""
    rnd = random.Random(16)
    words = [[f"w{rnd.randint(0, 9000)}" for _ in range(80)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:-1] + ["z"]) for w in words[:6]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (100, texts[0]), (100, texts[0])], "doc_id bigint, text string")
    calls, real = [], near.components
    monkeypatch.setattr(near, "components", lambda links: calls.append(1) or real(links))
    assert sorted(r.doc_id for r in near.representatives(docs).collect()) == [*range(12), 99]
    assert len(calls) < 1 + near.ROUNDS


def test_queries_run(spark):
    for name, query in QUERIES.items():
        df = query(spark, SF)
        assert df.count() == 200, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.checkpoint()
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*columns, "pieces"] and 0 < got.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert all(lib.encode(r.text) == r.pieces for r in got.limit(20).collect())
    assert not os.path.exists("spark-warehouse")
