import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meterline.llm import align, runs, toxic_spans
from meterline.llm.common import load, text_chunks
from meterline.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start int, h string, chunk int, count int, held_out int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None, 7, "x", 1, 2, 3, 4) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    unit = [rnd.choice(["ab", "é", "x", "Zz.", "漢字"]) for _ in range(37)]
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, "a b " * 20), (None, None), (5, "a b " * 20), (5, "a b " * 20), (6, "<|endoftext|> <s> ▁ a"),
           (7, " ".join(unit * 4)), (8, "\n".join(unit * 3 + ["q"] + unit * 3)), (9, "lone " + "w " * 23), (10, "w " * 24 + "v"), (11, "\x00 \x85 x")]
    for i in range(12, 90):
        some = [rnd.choice("ab") for _ in range(rnd.randint(1, 30))]
        out.append((i, " ".join(some * rnd.randint(1, 6) + [rnd.choice("abc") for _ in range(rnd.randint(0, 40))])))
    return out


def plain_runs(w, least=24):
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 3 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_direct_search(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            t = []
            while len(t) < rnd.choice([0, 5, 40, 150, 300]):
                unit = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.choice([1, 2, 5, 8, 13, 21, 34, 60]))]
                t += unit * rnd.choice([1, 1, 3, 4, 7]) + unit[:rnd.randint(0, len(unit))]
            texts.append(t)
        least = rnd.choice([1, 24])
        got = runs.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least)
        for i, t in enumerate(texts):
            assert [tuple(x) for x in got[got[:, 0] == i][:, 1:].tolist()] == plain_runs(t, least)


def test_a_shared_hash_does_no_harm(monkeypatch):
    """With hashes of a few bits every proposal is suspect; the check word by word still gives the right runs."""
    real = runs.Rolling.of
    monkeypatch.setattr(runs.Rolling, "of", lambda self, a, b: real(self, a, b) & np.uint64(0xF))
    w = ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 5 + list(range(100, 160))) * 3
    got = runs.runs_of(np.array(w), np.array([len(w)]))
    assert set(map(tuple, got[:, 1:].tolist())) <= set(plain_runs(w)) and len(got)


def test_periodic_runs(spark, rows):
    docs = table(spark, rows).repartition(3)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r) for r in runs.periodic_runs(docs, repeat_by_id=True).select(*columns).collect())
    assert got == Counter(plain_row(d, t) for d, t in rows)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    short = {r.doc_id: r.text for r in runs.collapsed(docs).collect()}
    assert short[5] == "a b" and short[3] == " \n\t " and short[1] is None
    assert runs.collapsed(docs).columns == docs.columns


def test_periodic_runs_of_a_text_over_the_chunk_size(spark):
    unit = [f"w{i}" for i in range(70001)]
    text = " ".join(unit * 4)
    assert len(text) > 1 << 20
    r = runs.periodic_runs(table(spark, [(2, text), (3, "a " * 30)])).filter("doc_id = 2").first()
    assert (r.n_runs, r.start, r.length, r.period, r.n_kept_bytes) == (1, 0, 4 * 70001, 70001, len(" ".join(unit)))


def test_periodic_runs_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in load(spark, sf).select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()) == Counter(plain_row(d, t) for d, t in texts)


# --- token alignment


def plain_alignment(text, a_lib, b_lib, a_names, b_names):
    """A ids, B ids, links and the written groups."""
    a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
    whole = (" " + (text or "")).encode()
    if not text or b"".join(a_names[i] for i in a) != whole or b"".join(b_names[i] for i in b) != whole:
        return [], [], [], ""
    a_ends, b_ends = (list(itertools.accumulate(len(names[i]) for i in ids)) for names, ids in ((a_names, a), (b_names, b)))
    b_at = dict(zip(b_ends, b))
    links = [(x, b_at[e]) for x, e in zip(a, a_ends) if e in b_at]
    groups, i, j = [], 0, 0
    for e in sorted(set(a_ends) & set(b_ends)):
        m, n = a_ends.index(e) + 1, b_ends.index(e) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    return a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.fixture(scope="module")
def libraries():
    a_lib = Tokenizer.from_file(public_tokenizers.path(align.A_VOCABULARY))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_MODEL))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    a_names = {i: bytes(back[c] for c in s) for s, i in a_lib.get_vocab().items() if all(c in back for c in s)}
    b_names = {}
    for i in range(b_lib.get_piece_size()):
        s = b_lib.id_to_piece(i)
        b_names[i] = bytes([int(s[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode()
    return a_lib, b_lib, a_names, b_names


def plain_table(rows, libraries):
    seen = [plain_alignment(t, *libraries) for _, t in rows]
    count = Counter(pair for x in seen for pair in x[2])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, len(a), len(b), len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha)
                   for (d, _), (a, b, links, sha) in zip(rows, seen))


def test_merge_path_pieces():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        a, b = (np.unique(rnd.integers(1, 120, rnd.integers(0, 60))) for _ in "ab")
        n = len(a) + len(b)
        want = sorted([(e, 0, i) for i, e in enumerate(a)] + [(e, 1, i) for i, e in enumerate(b)])
        for piece in (1, 2, 7, 500):
            m = align.Merge(a, b, piece)
            assert [(0, i) if f else (1, j) for f, i, j in zip(m.from_a, m.ia, m.ib)] == [x[1:] for x in want]
            ties = [e for e in b if e in set(a)]
            assert [b[j] for j in m.ib[m.shared]] == ties
            assert m.group.tolist() == [sum(t < e for t in ties) for e, _, _ in want]
            spans = [[(lo, hi) for lo, hi in zip([0, *x], x)] for x in (a, b)]
            pairs = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if max(p, r) < min(q, s)]
            assert sorted(zip(m.ia[m.overlap].tolist(), m.ib[m.overlap].tolist())) == pairs
            assert len(m.ia) == n


def test_token_alignment(spark, rows, libraries):
    docs = table(spark, rows).repartition(3)
    assert Counter(tuple(r) for r in align.linked(docs).collect()) == plain_table(rows, libraries)
    assert align.linked(docs.limit(0)).count() == 0
    assert align.linked(docs.filter("text IS NULL OR text = ''")).filter("n_links = 0 AND groups_sha256 = ''").count() == 3
    for r in align.alignments(docs).collect():
        assert len(r.a_ids) == len(r.a_ends) == len(r.a_groups) and r.a_ends == sorted(r.a_ends)
        if r.a_ids:
            assert r.a_ends[-1] == r.b_ends[-1] and r.a_groups[0] == r.b_groups[0] == 0 and r.a_groups[-1] == r.b_groups[-1]
            assert {o.a for o in r.overlaps} == set(range(len(r.a_ids))) and {o.b for o in r.overlaps} == set(range(len(r.b_ids)))


def test_token_alignment_of_the_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in load(spark, sf).select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_token_alignment"](spark, sf).collect()) == plain_table(texts, libraries)


def test_token_alignment_of_a_text_over_the_chunk_size(libraries):
    text = "naïve tokens, 漢字 " * 90000
    assert len(text.encode()) > align.CHUNK
    (part, data), = text_chunks(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), limit=align.CHUNK)
    x = align.Aligned(part.column("text").to_pylist(), data, align.A_VOCABULARY, align.B_MODEL)
    a_lib, b_lib = libraries[:2]
    assert x.a.tolist() == a_lib.encode(" " + text, add_special_tokens=False).ids and x.b.tolist() == b_lib.encode(text)
    assert len(set(x.a_end.tolist()) & set(x.b_end.tolist())) == len(x.link_a) == x.n_groups[0]


# --- toxic spans


def test_chain_sums_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxic_spans, "PIECE", 3)
    rnd = np.random.default_rng(1)
    for _ in range(30):
        first = np.concatenate([[0], np.cumsum(rnd.integers(0, 9, 4))])
        e = rnd.normal(0, 2, first[-1])
        step = np.array([[1.0, np.exp(rnd.normal())], np.exp(rnd.normal(0, 1, 2))])
        total, p, twice = toxic_spans.Chain(first).sums(e, step)
        for i in range(4):
            x = e[first[i]:first[i + 1]]
            z, m, mm = 0.0, np.zeros(len(x)), np.zeros(len(x))
            for tags in itertools.product([0, 1], repeat=len(x)):
                s = np.prod([step[a, b] * np.exp(x[k] * b) for k, (a, b) in enumerate(zip((0, *tags), tags))])
                z, m = z + s, m + s * np.array(tags)
                mm += s * np.array([a * b for a, b in zip((0, *tags), tags)])
            assert np.isclose(np.log(z), total[i]) and np.allclose(m / z, p[first[i]:first[i + 1]]) and np.allclose(mm / z, twice[first[i]:first[i + 1]])


def area(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = int(label.sum())
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxic_spans_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf), load(spark, sf, "labels")
    model = toxic_spans.train(docs, labels)
    got = toxic_spans.scored(docs, model).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    assert area(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.01
    found = Counter(t[s["start"]:s["end"]].strip(".,").lower() for t, spans in zip(got.text, got.spans) for s in spans)
    assert {"idiot", "moron", "scum"} <= set(w for x in found for w in x.split())
    again = toxic_spans.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.calibration, again.calibration)


def test_toxic_spans_never_read_held_out_labels_or_metadata(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf), load(spark, sf, "labels")
    a = toxic_spans.train(docs, labels)
    b = toxic_spans.train(docs.selectExpr("doc_id", "text", "'zz' AS lang", "doc_id AS source"),
                          labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic"))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.calibration, b.calibration)


def test_toxic_spans_edge_cases(spark, rows):
    docs = table(spark, rows)
    labels = spark.createDataFrame([(d, (d or 0) % 2) for d, _ in rows] + [(None, 1), (4, None), (4, 1)], "doc_id bigint, toxic int")
    sf = "/root/testdata/sf0.01"
    for model in (toxic_spans.train(docs, labels), toxic_spans.train(docs, labels.filter("toxic = 0")), toxic_spans.train(docs.limit(0), labels),
                  toxic_spans.train(docs, labels.limit(0)), toxic_spans.train(load(spark, sf), load(spark, sf, "labels"))):
        got = toxic_spans.scored(docs, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert toxic_spans.scored(docs.limit(0), model).count() == 0


def test_toxic_spans_of_a_text_over_the_chunk_size(spark):
    sf = "/root/testdata/sf0.01"
    model = toxic_spans.train(load(spark, sf), load(spark, sf, "labels"))
    text = "the and of " * 200000 + "idiot scum moron " + "the and of " * 10
    r = toxic_spans.scored(table(spark, [(1, text)]), model).first()
    assert len(text) > 2 << 20 and [text[s.start:s.end] for s in r.spans] == ["idiot scum moron"]
