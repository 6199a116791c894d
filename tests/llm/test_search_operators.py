"""Hard negatives, byte-level BPE and stratified search against plain versions."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from curbflow.llm import byte_bpe, negatives, strata

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r])


# ---- hard negatives ----

VECTORS = "vec_id long, embedding array<float>, label long, anchor boolean, x string, score string, rank string, q string"


def vectors(width=6, n=160, seed=3):
    rng = random.Random(seed)
    middle = {k: [rng.gauss(0, 1) for _ in range(width)] for k in range(4)}
    out = []
    for i in range(n):
        label = rng.randrange(4)
        v = [float(np.float32(m + rng.gauss(0, 0.8))) for m in middle[label]]
        out.append((i, v, label if i % 5 else (label + 1) % 4, i % 8 == 0))
    # one vector many times over, with ids of their own
    out += [(1000 + i, out[8][1], out[8][2] if i % 2 else 3 - out[8][2], i % 10 == 0) for i in range(30)]
    out += [
        (2000, None, 1, True), (2001, [1.0] * width, None, True), (2002, [1.0, None] * (width // 2), 1, True),
        (2003, [1.0, float("nan")] * (width // 2), 1, False), (2004, [float("inf")] * width, 1, False),
        (2005, [], 1, True), (2006, [0.0] * width, 2, True), (2007, [1.5, -0.25], 3, True), (2008, [2.0] * (width + 2), 3, True),
        (None, out[8][1], 2, False), out[16], out[16], out[17],
    ]
    return [(*r, "?", "?", "?", "?") for r in out]


def slow_negatives(rows, low=50, high=95):
    good = []
    for i, v, label, anchor, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(x)) for x in v], label, anchor))
    out = []
    for a, (i, v, label, anchor) in enumerate(good):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, b, m) for b, (j, w, m, _) in enumerate(good) if b != a]
        scored.sort()
        for s, none, j, _, _ in [r for r in scored if r[4] == label][:5]:
            hit = [r for r in scored if r[4] != label and low * -s <= 100 * -r[0] <= high * -s][:3]
            out += [(i, None if none else j, k + 1, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(hit)]
    return out


@pytest.mark.parametrize(("pairs", "references"), [(10**9, 16), (300, 3), (10**9, 0)])
def test_negatives(spark, monkeypatch, pairs, references):
    monkeypatch.setattr(negatives, "CELL_PAIRS", pairs)
    rows = vectors()
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), references=references).collect()
    want = slow_negatives(rows)
    assert len(want) > 100
    assert ordered(got) == ordered(want)


def test_score_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (60, 5)).astype(float)
    v[7] = v[3] * 2
    v[8] = -v[3]
    v[9] = 0
    norm = np.linalg.norm(v, axis=1)
    d = v[:6]
    scale = norm[:, None] * np.linalg.norm(d, axis=1)
    angles = np.arccos(np.clip(np.divide(v @ d.T, scale, out=np.zeros(scale.shape), where=scale > 0), -1, 1))
    angles = angles.astype(np.float32).astype(float)
    lo, hi = negatives.score_bounds(angles, norm, angles, angles, norm, norm)
    assert (lo <= v @ v.T).all() and (v @ v.T <= hi).all()
    # rows that are references themselves are bounded tightly
    assert (hi[:6] - v[:6] @ v.T).max() < 20
    tile = slice(20, 40)
    lo, hi = negatives.score_bounds(
        angles, norm, angles[tile].min(0, keepdims=True), angles[tile].max(0, keepdims=True),
        norm[tile].min(keepdims=True), norm[tile].max(keepdims=True),
    )
    assert (lo <= (v @ v[tile].T).min(axis=1, keepdims=True)).all() and (hi >= (v @ v[tile].T).max(axis=1, keepdims=True)).all()


def test_bounds_spare_scores(spark, monkeypatch):
    """Most pairs of a clustered table are never scored."""
    scored = []
    real = negatives.inner_products
    monkeypatch.setattr(negatives, "inner_products", lambda a, b: scored.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(2)
    label = np.sort(rng.integers(0, 12, 3000))
    q = (rng.normal(size=(12, 32))[label] * 200 + rng.normal(size=(3000, 32)) * 4).astype("<i4")
    import pyarrow as pa

    d = q[::250].astype(float)
    cosine = (q @ d.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1))
    angles = np.arccos(np.clip(cosine, -1, 1)).astype("<f4")
    t = pa.table({"x": np.arange(3000), "vec_id": np.arange(3000), "label": label, "q": [r.tobytes() for r in q], "angles": [r.tobytes() for r in angles]})
    rows = negatives.Rows(t)
    anchors = negatives.Rows(t.take(pa.array(range(0, 3000, 50))))
    floor = np.full((60, 1), int(0.5 * np.median(rows.norm) ** 2))
    negatives.search_cell(anchors, rows, floor, np.full_like(floor, negatives.LAST), 3, same=False)
    assert sum(scored) < 0.2 * 60 * 3000


def table_of(q, label, ids, directions=5):
    import pyarrow as pa

    d = q[:directions].astype(float)
    scale = np.outer(np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(d, axis=1))
    angles = np.arccos(np.clip(np.divide(q @ d.T, scale, out=np.zeros(scale.shape), where=scale > 0), -1, 1)).astype("<f4")
    return pa.table({
        "x": np.arange(len(q)), "vec_id": pa.array(ids, pa.int64()), "label": label,
        "q": [r.astype("<i4").tobytes() for r in q], "angles": [r.tobytes() for r in angles],
    })


def test_bounds_are_for_tiles(monkeypatch):
    """Bounds cost more than scores, so there are none for single pairs, however little they spare."""
    bounded, scored = [], []
    bounds, products = negatives.score_bounds, negatives.inner_products
    monkeypatch.setattr(negatives, "score_bounds", lambda *a: bounded.append(len(a[1]) * len(a[4])) or bounds(*a))
    monkeypatch.setattr(negatives, "inner_products", lambda a, b: scored.append(len(a) * len(b)) or products(a, b))
    rng = np.random.default_rng(4)
    t = table_of(rng.integers(-90, 90, (4000, 24)), rng.integers(0, 4, 4000), np.arange(4000))
    anchors = negatives.Rows(t.slice(0, 80))
    floor = np.full((80, 1), -negatives.LAST)
    negatives.search_cell(anchors, negatives.Rows(t), floor, -floor, 3, same=False)
    assert sum(scored) > 0.5 * 80 * 4000
    assert sum(bounded) < 0.05 * 80 * 4000


def test_scores_between_windows_are_not_kept(monkeypatch):
    """Where the windows of an anchor lie far apart, the scores between them are left alone."""
    kept = []
    real = negatives.Best.add
    monkeypatch.setattr(negatives.Best, "add", lambda self, anchor, *a: kept.append(len(anchor)) or real(self, anchor, *a))
    rng = np.random.default_rng(6)
    t = table_of(rng.integers(-90, 90, (6000, 24)), np.repeat([0, 1], 3000), np.arange(6000))
    cap = np.tile([40_000, 1000], (50, 1))
    search = negatives.Search(negatives.Rows(t.slice(0, 50)), cap - 500, cap, 3, same=False)
    for at in range(0, 6000, 1500):
        search.add(negatives.Rows(t.slice(at, 1500)))
    assert sum(kept) < 0.05 * 50 * 3000


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize(("labels", "size"), [(3, 100), (3, 3000), (3, 2**30), (40, 100), (1, 100)])
def test_search_in_parts(monkeypatch, same, labels, size):
    """Rows come in parts, with many equal vectors and ids, of any size of component."""
    monkeypatch.setattr(negatives, "TILE", 64)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "GROUP", 20)
    rng = np.random.default_rng(labels + size)
    n, keep = 900, 3
    q = rng.integers(-size, size, (n, 6)) // (6 if size > 2**24 else 1)
    q[rng.random(n) < 0.3] = q[5]
    q[rng.random(n) < 0.1] = 0
    label, ids = rng.integers(0, labels, n), [None if i % 97 == 0 else i // 2 for i in rng.permutation(n).tolist()]
    t = table_of(q, label, ids)
    some = np.sort(rng.permutation(n)[:70])
    score = q.astype(object) @ q.astype(object).T
    cap = np.array([sorted((int(v) for v in rng.choice(score[i], 4)), reverse=True) for i in some])
    floor = cap - np.abs(cap) // 2 - 10
    floor[:9, 2], cap[:9, 2] = negatives.LAST, -negatives.LAST
    floor[20:40], cap[20:40, 0] = -negatives.LAST, negatives.LAST
    search = negatives.Search(negatives.Rows(t.take(some)), floor, cap, keep, same)
    for at in range(0, n, 250):
        search.add(negatives.Rows(t.slice(at, 250)))
    got = {r for f in search.found() for r in zip(*(f[c].tolist() for c in ("a", "slot", "id", "x", "score")))}
    want = set()
    for a, i in enumerate(some.tolist()):
        for s in range(4):
            fit = [j for j in range(n) if j != i and (label[j] == label[i]) == same and floor[a, s] <= score[i, j] <= cap[a, s]]
            known = [negatives.LAST if v is None else v for v in ids]
            fit.sort(key=lambda j: (-score[i, j], known[j], j))
            want |= {(i, s, known[j], j, score[i, j]) for j in fit[:keep]}
    assert got == want and (want or labels == 1 and not same)


def test_negatives_in_parts(spark, monkeypatch):
    for name, value in (("PART_BYTES", 500), ("CELL_BYTES", 20_000), ("GROUP", 4), ("CELL_PAIRS", 1000)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(seed=8)
    rows += [(3000 + i, [v * 500 for v in r[1]], r[2], i % 3 == 0, *r[4:]) for i, r in enumerate(rows[:30])]
    assert ordered(negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()) == ordered(slow_negatives(rows))


def test_no_vectors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, True, "", "", "", "")], VECTORS)
    assert negatives.mine(alone).count() == 0


def test_scores_beyond_a_long():
    with pytest.raises(ValueError):
        negatives.inner_products(np.full((1, 4), 2.0**31), np.full((1, 4), 2.0**31))
    exact = negatives.inner_products(np.array([[2.0**28 + 1, 1.0]]), np.array([[2.0**28 + 1, 3.0]]))
    assert exact.tolist() == [[(2**28 + 1) ** 2 + 3]]


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, reference):
    got = byte_bpe.document_digests(docs, VOCABULARY, PATTERN)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        raw = reference.decode_bytes(ids)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert ordered(got.collect()) == ordered(want)


def test_byte_bpe_ids_and_texts(docs, rows, reference):
    ids = byte_bpe.encode_documents(docs, VOCABULARY, PATTERN)
    assert ordered((r["doc_id"], list(r["ids"])) for r in ids.collect()) == ordered((i, reference.encode_ordinary(t or "")) for i, t in rows)
    raw = byte_bpe.decode_documents(ids, VOCABULARY, PATTERN).collect()
    assert ordered((r["doc_id"], bytes(r["raw"]).decode()) for r in raw) == ordered((i, t or "") for i, t in rows)


@pytest.mark.parametrize("widest", [4, 128])
def test_byte_bpe_of_odd_pieces(monkeypatch, reference, widest):
    monkeypatch.setattr(byte_bpe, "WIDEST", widest)
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    monkeypatch.setattr(byte_bpe, "KNOWN_BYTES", 20_000)
    bpe = byte_bpe.ByteBPE(VOCABULARY, PATTERN)
    rng = random.Random(4)
    texts = ["", " ", "\n\n  x", "x" * 3000, "'s't", "\x1c\x85　a", "<|endoftext|>", "\U0001f642́" * 70]
    for n in (1, 2, 3, 17, 127, 128, 129, 400):
        for alphabet in ("ab", "ethanois ", "0123", "éü中\U0001f642x ", "\t\n\r .,!"):
            texts.append("".join(rng.choice(alphabet) for _ in range(n)))
    for text in texts:
        ids = bpe.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert bpe.decode(ids).decode() == text


def test_pair_table_finds_every_pair():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (table.ranks_of(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    other = np.array([p for p in ((a, b) for a in range(300) for b in range(0, 300, 7)) if p not in known])
    assert (table.ranks_of(other[:, 0], other[:, 1]) == byte_bpe.NONE).all()


def test_no_documents_to_encode(no_docs):
    assert byte_bpe.document_digests(no_docs, VOCABULARY, PATTERN).count() == 0
    assert byte_bpe.encode_documents(no_docs, VOCABULARY, PATTERN).count() == 0


# ---- stratified search ----

ITEMS = "item_id long, text string, q string, d string, m string, score string"


def items_of(rows):
    texts = [t for _, t in rows if t]
    out = [(i, " ".join(texts[i].split()[:12])) for i in range(12)]
    out += [(50, None), (51, ""), (52, "..."), (53, "no such term here zzz"), (54, texts[3]), (54, texts[3]), (None, texts[5]), (55, "x and")]
    return [(*r, "?", "?", "?", "?") for r in out]


def slow_search(rows, items, keep=50):
    docs = [(i, Counter(strata.terms_of(t or ""))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    out = []
    for item, text, *_ in items:
        terms = set(strata.terms_of(text or ""))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in docs) + 1))) for t in terms}
        found = []
        for i, counts in docs:
            m = 50 + (50 * counts.total() * n_docs) // n_terms
            score = sum(weights[t] * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in terms if counts[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:keep], 1):
            out.append((item, rank, None if none else i, -score))
    return out


@pytest.mark.parametrize(("postings", "block", "keep"), [(2_000_000, 1 << 24, 50), (40, 500, 3), (300, 1 << 24, 7)])
def test_search(spark, monkeypatch, docs, rows, postings, block, keep):
    monkeypatch.setattr(strata, "PART_POSTINGS", postings)
    monkeypatch.setattr(strata, "BLOCK_BYTES", block)
    items = items_of(rows)
    got = strata.search(docs, spark.createDataFrame(items, ITEMS), keep=keep).collect()
    want = slow_search(rows, items, keep)
    assert len(want) > 40
    assert ordered(got) == ordered(want)


def test_terms():
    assert strata.terms_of("A_b-C9 éİx\x7fy [z]") == ["a", "b", "c9", "éİx", "y", "z"]


def test_bound_stops_the_visit():
    """Strata whose bound lies below the scores found are not scored."""
    big = strata.Stratum(60, np.arange(4), np.arange(4), [np.array([0, 1], "<i4").tobytes()] * 4, [np.array([9, 9], "<i4").tobytes()] * 4)
    small = strata.Stratum(5000, np.array([9]), np.array([9]), [np.array([1], "<i4").tobytes()], [np.array([1], "<i4").tobytes()])
    small.scores = None
    queries = strata.Queries([7], [[0, 1]], np.array([100, 50]))
    assert small.bounds(queries)[0] < big.bounds(queries)[0]
    q, ids, d, score = strata.best_of_part([small, big], queries, keep=2)
    assert np.concatenate(ids).tolist() == [0, 1]


def test_search_empty(spark, docs, no_docs, rows):
    items = spark.createDataFrame(items_of(rows), ITEMS)
    assert strata.search(no_docs, items).count() == 0
    assert strata.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
