"""The text operators against plain, slow versions of their contracts."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from curbflow.llm import (
    chunked_bpe,
    decontamination,
    kneser_ney,
    licenses,
    matching,
    personal_data,
    quality_rules,
    queries,
    repeats,
    revisits,
    simhash,
)

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def result(df, *columns):
    key = lambda r: [(v is None, str(v)) for v in r]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def expected(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r])


# ---- quality rules ----


def test_quality_base(docs, rows):
    want = []
    for i, t in rows:
        w, t = words(t), t or ""
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {j + k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(8)}
        lines = t.split("\n")
        again = sum(bool(words(x)) and x in lines[:n] for n, x in enumerate(lines))
        want.append(
            (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(hit),
             len(w) < 20 or 100 * len(hit) > 30 * len(w))
        )
    got = quality_rules.quality_rules(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert result(got, *columns) == expected(want)
    assert got.where("base_failed and kept").count() == 0


def test_quality_distances(spark, docs):
    """References and distances worked out without numpy or Spark."""
    from conftest_texts import all_texts

    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(docs).collect()}
    limits = quality_rules.Limits()
    by_lang = defaultdict(Counter)
    for _, t, lang in all_texts():
        if t is not None and lang is not None:
            by_lang[lang].update(words(t))
    every = sum(sum(c.values()) for c in by_lang.values())
    checked = 0
    for i, t, lang in all_texts():
        w = words(t)
        counts = by_lang.get(lang)
        if not counts or sum(counts.values()) < every * limits.language_share or len(w) < limits.min_words:
            continue
        total = sum(counts.values())
        common = {x for x, n in counts.items() if n >= total * limits.common_share}
        q = Counter({x: counts[x] for x in common})
        q[None] = total - sum(q.values())
        p = Counter(x if x in common else None for x in w)
        js = 0.0
        for x in q.keys() | p.keys():
            a, b = p[x] / len(w), q[x] / total
            m = (a + b) / 2
            js += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
        assert got[i, len(w)]["word_distance"] == pytest.approx(math.sqrt(max(js, 0)), abs=1e-6)
        checked += 1
    assert checked > 20


def test_quality_rejects_shouting(spark, docs):
    shout = docs.where("doc_id = 113").selectExpr("doc_id", "upper(text) as text", "lang")
    assert not quality_rules.quality_rules(docs.select("doc_id", "text", "lang").unionAll(shout)).where("kept").where(
        "class_distance > 0.5"
    ).count()


# ---- personal data ----


def test_account_numbers_of_all_countries():
    """Examples of the registry, followed by words in capitals."""
    known = (
        "HU42117730161111101800000000", "RO49AAAA1B31007593840000", "BG80BNBG96611020345678", "HR1210010051863000160",
        "SK3112000000198742637541", "SI56263300012039086", "EE382200221020145685", "LV80BANK0000435195001",
        "LT121000011101001000", "CY17002001280000001200527600", "MT84MALT011000012345MTLCAST001S", "TR330006100519786457841326",
    )
    for number in known:
        assert [(s.kind, s.start, s.end) for s in personal_data.find(f"x {number} AND MORE") if s.kind == "iban"] == [("iban", 2, 2 + len(number))]
    digits = "".join(str(int(c, 36)) for c in "1234567890123456ZZ00")
    other = f"ZZ{98 - int(digits) % 97:02d}1234567890123456"  # a country that is in no list
    assert [(s.start, s.end) for s in personal_data.find(f"bank account {other}.") if s.kind == "iban"] == [(13, 13 + len(other))]
    assert not [s for s in personal_data.find(f"part {other}.") if s.kind == "iban"]  # nothing near speaks for it



def plain_spans(t):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                doubled = [int(c) * (2 if n % 2 else 1) for n, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data(docs, rows):
    want = []
    for i, t in rows:
        spans = plain_spans(t)
        n = Counter(s[0] for s in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    got = personal_data.span_digest(docs)
    assert result(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected(want)
    added = got.where("doc_id = 119").first()
    assert (added["n_iban"], added["n_ssn"]) == (1, 2)


@pytest.mark.parametrize("text", ["a@b@c.d", "@x.y", "a@b.c@d.e", "1.2.3", "1.2.3.4.", "+1 2 3 4 5 6 7 8 9-", "0" * 5000, "a" * 5000 + "@"])
def test_personal_data_edges(text):
    base = [(s.kind, s.start, s.end) for s in personal_data.find(text) if s.kind in personal_data.BASE_KINDS]
    assert base == plain_spans(text)


def test_masked_documents_keep_their_columns(docs):
    masked = personal_data.masked_documents(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert "<EMAIL>" in masked.where("doc_id = 117").first()["text"]
    assert masked.where("doc_id = 107").first()["text"] is None


# ---- encoding ----


def test_encoding(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    for mask_bits, word_by_word in ((10, True), (4, True), (4, False)):  # short chunks cut nearly every word
        got = chunked_bpe.encode_documents(docs, queries.tokenizer_path(), mask_bits, word_by_word)
        assert result(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)


# ---- decontamination ----


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))


def test_contamination(spark, docs, rows):
    source = dict(rows)
    first = source[102].split()
    items = [
        (1, " ".join(first[3:40])), (2, "That IT"), (2, "And and"), (10, "no such words anywhere in here at all, is it"),
        (None, " ".join(first[20:31])), (5, None), (6, ""), (7, "?!"), (8, source[112][1400:1700]),
    ]
    frame = spark.createDataFrame(items, "item_id int, text string")
    windows = defaultdict(set)
    for item, t in items:
        w = plain_words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add("" if item is None else str(item))
    want = []
    for i, t in rows:
        w, hit, held = plain_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit |= set(range(j, j + size))
                    held |= windows[tuple(w[j : j + size])]
        want.append((i, len(w), len(hit), len(held), sha(",".join(sorted(held))), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert result(decontamination.contamination(docs, frame), *columns) == expected(want)
    assert result(decontamination.contamination(docs, frame, block_bytes=1500), *columns) == expected(want)
    clean = decontamination.clean_documents(docs, frame)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not w[-1] for w in want)
    none = decontamination.contamination(docs, frame.where("false"))
    assert none.count() == len(rows) and none.where("contaminated").count() == 0


# ---- repeated passages ----


def plain_removal(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = set()
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone.update(range(p, p + length))
        runs = sum(p - 1 not in gone for p in gone)
        out.append((i, len(r), len(gone), runs, sha(bytes(c for p, c in enumerate(r) if p not in gone))))
    return expected(out)


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats(docs, rows, limit):
    got = repeats.remove_repeats(docs, group_limit=limit)
    assert result(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(rows, 200)


def test_maximal_repeats():
    pieces = [b"abcXY", b"abcXZ", b"abdXY", b"bbcXY"]
    left = [p[:3][::-1] for p in pieces]
    right = [p[3:] for p in pieces]
    got = {(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats(left, right, 3)}
    assert (3, 1, (0, 1)) in got and (2, 1, (0, 1, 3)) in got and (2, 2, (0, 3)) in got


# ---- fingerprints ----


def plain_print(t, size=4):
    w = words((t or "").translate(UPPER))
    shingles = [" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [40_000, 2])
def test_near_duplicates(docs, rows, limit):
    prints = [(i, plain_print(t)) for i, t in rows]
    group = {p: {p} for _, p in prints}
    for a in list(group):
        for b in list(group):
            if bin(a ^ b).count("1") <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    least = {p: min((i for i, x in prints if x in group[p] and i is not None), default=None) for p in group}
    want = expected((i, f"{p:016x}", least[p]) for i, p in prints)
    assert result(simhash.near_duplicates(docs, bucket_limit=limit), "doc_id", "fingerprint", "component_id") == want


def test_links_across_signs(spark):
    """Every two numbers within four bits, the sign among them, are connected."""
    base = 0x0123456789ABCDEF
    near = [base, base ^ (1 << 63), base ^ 0b1111, base ^ (0b11 << 62) ^ 0b11, base ^ 0xFFFF]
    frame = spark.createDataFrame([(n - (1 << 64) if n >> 63 else n,) for n in near], "fp long")
    links = simhash.components(simhash.near_links(frame)).groupBy("root").count().collect()
    assert [r["count"] for r in links] == [4]


def test_first_of_each(docs, rows):
    """Against the similarity of the sets of five-word shingles of all pairs."""
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(UPPER))
        sets[i, t or ""] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    copies = {(a, b): similar(a, b) for a in sets for b in sets if a != b}
    gone = {a for a in sets if a[0] not in ids and a[0] is not None}
    assert all(max(v for (x, _), v in copies.items() if x == a) >= 0.75 for a in gone)
    assert not any(v >= 0.85 and a[0] in ids and b[0] in ids and a[0] is not None and b[0] is not None for (a, b), v in copies.items())
    assert ids.count(101) == 0 and ids.count(3) == 1 and len(ids) == len(set(ids))


def shingle_sets(rows):
    return {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [words(t)]}


def roots_of(sets, similarity):
    """The smallest id reachable over all similar pairs."""
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_first_of_each_is_exact(spark):
    """Texts that only share a repeated line stay, and so do pairs just below 0.8."""
    fresh = (f"w{i}" for i in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    line = new(14)
    rows = [(i, " ".join(line * 30 + new(104))) for i in range(12)]
    for i in range(100, 140, 2):  # 79 shingles in common of 100
        core = new(83)
        rows += [(i, " ".join(core + new(10))), (i + 1, " ".join(core + new(11)))]
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} == set(roots_of(shingle_sets(rows), 0.8).values())


def test_large_groups_are_exact(spark):
    """Groups of several parts, with texts that the first one does not reach."""
    base = [f"a{i}" for i in range(204)]
    rows = [(i, " ".join([f"x{i}", *base[1:]])) for i in range(150)]
    rows += [(1000 + i, " ".join([*base[:130], *(f"b{j}" for j in range(73)), f"y{i}"])) for i in range(150)]
    sets = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in rows}
    members = spark.createDataFrame([(0, i, bytearray(s.tobytes())) for i, s in sets.items()], "bucket long, id long, shingles binary")
    found = simhash.components(simhash._exact_links(members, 0.8))
    assert {r["node"]: r["root"] for r in found.collect()} == {i: 0 if i < 1000 else 1000 for i, _ in rows}


def test_first_of_each_misses_nothing(spark):
    """Pairs at 0.8, of many and of few shingles, and copies that repeat a passage."""
    fresh = (f"w{i}" for i in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    rows = []
    for i in range(0, 120, 2):
        n = (8, 40, 200)[i % 3]  # shingles in common
        core = new(n + 4)
        rows += [(i, " ".join(core + new(n // 8))), (i + 1, " ".join(core + new(n // 8)))]
    for i in range(200, 230, 2):
        core = new(204)
        rows += [(i, " ".join(core)), (i + 1, " ".join(core + core[90:114] * 5))]
    found = roots_of(shingle_sets(rows), 0.8)
    assert all(found[i] == i - i % 2 for i in found)
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(found.values())


# ---- language model ----


def test_matching(docs, rows):
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not fold[i] for w in [*words((t or "").translate(UPPER)), None])
    n, v = sum(counts.values()), len(counts)
    order = matching.ORDER
    trie = [defaultdict(Counter) for _ in range(order + 1)]

    def symbols(t):
        return [256] * order + list((t or "").encode()) + [257]

    for i, t in rows:
        s = symbols(t) if not fold[i] else []
        for at in range(order, len(s)):
            for k in range(order + 1):
                trie[k][tuple(s[at - k : at])][s[at]] += 1

    def cost(context, x):
        total, out = 0.0, set()
        for k in range(order, -1, -1):
            left = {s: c for s, c in trie[k].get(context[order - k :], {}).items() if s not in out}
            whole = sum(left.values()) + len(left)
            if x in left:
                return total + math.log10(left[x] / whole)
            if left:
                total += math.log10(len(left) / whole)
            out |= set(left)
        return total - math.log10(257 - len(out))

    got = matching.score_documents(docs, block_bytes=2000)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    exact, base, score = [], [], []
    for i, t in rows:
        w, s = [*words((t or "").translate(UPPER)), None], symbols(t)
        exact.append((i, fold[i], len(w), sum(counts[x] > 0 for x in w), n))
        base.append(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        score.append(sum(cost(tuple(s[at - order : at]), s[at]) for at in range(order, len(s))))
    assert result(got, *columns) == expected(exact)
    found = got.collect()
    assert sorted(r["base_score"] for r in found) == pytest.approx(sorted(base), rel=1e-9)
    assert sorted(r["score"] for r in found) == pytest.approx(sorted(score), rel=1e-9)
    assert [r["score"] for r in matching.score_documents(docs.where("doc_id = 2")).collect()][0] < 0


def test_places_of_numbers():
    rng = np.random.default_rng(13)
    for n in (1, 2, 1000, 50_000):
        kinds = np.unique(rng.integers(0, 1 << 45, n))
        numbers = rng.choice(kinds, 5000)
        assert (matching.Places(kinds).of(numbers) == np.searchsorted(kinds, numbers)).all()
        full = matching.Places(kinds)
        full.slots[:] = 0  # every slot holds another number
        assert (full.of(numbers) == np.searchsorted(kinds, numbers)).all()


# ---- classifier ----


def test_kneser_ney(spark, docs, rows):
    from conftest_texts import all_texts

    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0), (4, 0, 0)], "doc_id int, quality int, toxic int")
    how = kneser_ney.Fit(classes=())
    got = {(r["doc_id"], r["bytes"]): r for r in kneser_ney.judged(docs, labels, how).collect()}
    sampled = {(r["doc_id"], r["lang"]) for r in kneser_ney.fit(docs, labels, how)[1].collect()}
    usable = [i for i, t, lang in all_texts() if i in range(30) and i != 4 and lang == "en" and t and len(t) <= how.max_chars]
    assert 0 < len([i for i in usable if (i, "en") in sampled]) < len(usable)  # the others give the thresholds
    own = [(i, t) for i, t, lang in all_texts() if (i, lang) in sampled and lang == "en" and t and len(t) <= how.max_chars]
    counts = [Counter() for _ in range(6)]
    for _, t in own:
        s = [256] * 4 + list(t.encode()) + [257]
        counts[5].update(tuple(s[j - 4 : j + 1]) for j in range(4, len(s)))
    for m in (4, 3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = {}
    for m in range(1, 6):
        n = [0, *(sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] else 0.5 * k for k in (1, 2, 3)]
        discount[m] = [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]
    following = [defaultdict(list) for _ in range(6)]
    for m in range(1, 6):
        for g, c in counts[m].items():
            following[m][g[:-1]].append(c)

    def probability(g):
        if not g:
            return 1 / 257
        m, below = len(g), probability(g[1:])
        cs = following[m].get(g[:-1])
        if not cs:
            return below
        taken = lambda c: discount[m][min(c, 3) - 1]
        c = counts[m].get(g, 0)
        return ((c - taken(c)) if c else 0) / sum(cs) + sum(map(taken, cs)) / sum(cs) * below

    checked = 0
    for i, t, lang in all_texts():
        if lang == "en" and t and i is not None and len(t) < 3000:
            s = [256] * 4 + list(t.encode()) + [257]
            cost = [math.log10(probability(tuple(s[j - 4 : j + 1]))) for j in range(4, len(s))]
            assert got[i, len(t.encode())]["perplexity"] == pytest.approx(10 ** (-sum(cost) / len(cost)), rel=1e-6)
            checked += 1
    assert checked > 20
    assert not any(r["kept"] for (i, n), r in got.items() if n == 0)
    of_none = got[112, len(dict(rows)[112].encode())]  # its own language has no model
    assert of_none["model"] is None and of_none["kept"]
    assert all(r["threshold"] and r["worst_threshold"] for r in got.values() if r["model"])
    assert not got[110, 3000]["kept"]
    kept = kneser_ney.keep_trusted_like(docs, labels, how)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in kneser_ney.judged(docs, labels, how).collect())
    assert kneser_ney.judged(docs, labels.where("false"), how).where("kept").count() == sum(bool(t) for _, t in rows)


def test_rare_language_is_judged_by_itself(spark):
    """Languages of 40 and of three trusted documents keep clean text and lose the rest."""
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    rows = [(i, text("etaoin"), "en") for i in range(300)] + [(1000 + i, text("uvwxyz"), "fr") for i in range(40)]
    rows += [(2000 + i, text("jkqpbd"), "de") for i in range(5)]
    rows += [(3000 + i, text("#*$%&|<>0123456789"), lang) for i, lang in enumerate(["en", "fr", "de"] * 3)]
    rows += [(4000, text("xyz"), "es")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = [r[0] for r in rows if r[0] < 3000 and r[0] not in (2003, 2004)]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.judged(frame, labels, kneser_ney.Fit(sample=100)).collect()}
    assert all(got[i]["kept"] for i in trusted)
    assert got[2003]["kept"] and got[2004]["kept"] and got[2003]["model"] == "de" and got[2003]["threshold"]
    assert not any(got[3000 + i]["kept"] for i in range(9))
    assert got[4000]["kept"] and got[4000]["threshold"] is None


def test_models_are_bounded_together(spark):
    rows = [(i, f"some text {i} of a language", f"l{i % 20}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    models, chosen = kneser_ney.fit(frame, labels, kneser_ney.Fit(total=40))
    assert len(models) == 20 and 20 <= chosen.count() <= 100


def test_all_trusted_documents_count(spark):
    """With folds a model is that of every trusted text, long ones too; scores are the same by joins,
    and each trusted text meets the thresholds by a model of the other folds."""
    rng = random.Random(10)
    usual = ["".join(rng.choices("etaoin", k=rng.choice((2, 4, 6)))) for _ in range(80)]
    text = lambda n: " ".join(rng.choices(usual, k=n))
    rows = [(i, text(30), "en") for i in range(60)] + [(60, text(30) + " jkqxz" * 900, "en"), (61, text(20), None)]
    rows += [(100 + i, text(10).upper(), "fr") for i in range(2)] + [(200, "only one", "de"), (201, "only one", "de"), (300, "none", "es")]
    rows += [(400 + i, " ".join(rng.choices(["jkqxz", "vvwu"], k=20)), lang) for i, lang in enumerate(["en", "fr", None])] + [(500, None, "en"), (501, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int")
    how = kneser_ney.Fit(folds=3)
    known = [(r["doc_id"], r["lang"], r["fold"]) for r in kneser_ney.in_folds(frame, labels, 3).collect()]
    assert {i for i, *_ in known} == {i for i, *_ in rows if i < 300}
    folds = {i: f for i, _, f in known}
    assert folds[100] != folds[101] and folds[200] == folds[201] == folds[61] == -1 and {folds[i] for i in range(60)} == {0, 1, 2}

    source = {i: t for i, t, _ in rows}
    ids = [i for i in folds if i <= 60]
    every = kneser_ney.collected(kneser_ney.model_tables(kneser_ney._run_counts(frame.where("doc_id <= 60").select("text", "lang"))))["en"]
    by_scan = {r["doc_id"]: r for r in kneser_ney.judged(frame, labels, how).collect()}
    for i in [*ids, 400]:
        assert by_scan[i]["perplexity"] == pytest.approx(10 ** kneser_ney.symbol_costs(every, source[i]).mean(), rel=1e-9)
    by_joins = {r["doc_id"]: r for r in kneser_ney.judged(frame, labels, kneser_ney.Fit(folds=3, carried=0)).collect()}
    for i, r in by_scan.items():
        for c in r.asDict():
            assert by_joins[i][c] == (pytest.approx(r[c], rel=1e-9) if isinstance(r[c], float) else r[c]), (i, c)
    assert not any(by_scan[i]["kept"] for i in (400, 401, 402, 500, 501)) and by_scan[300]["kept"]
    assert by_scan[200]["kept"] and by_scan[200]["threshold"] and by_scan[61]["model"] in ("en", "fr", "de")


def test_thresholds_come_from_the_other_folds(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choices("etaoinshr", k=4)) for _ in range(25)), "en") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    how = kneser_ney.Fit(folds=2, quantile=0.5, grid=1e-6, enough=0, classes=())
    fold = {r["doc_id"]: r["fold"] for r in kneser_ney.in_folds(frame, labels, 2).collect()}
    held = []
    for f in (0, 1):
        others = frame.where(frame.doc_id.isin([i for i in fold if fold[i] != f])).select("text", "lang")
        model = kneser_ney.collected(kneser_ney.model_tables(kneser_ney._run_counts(others)))["en"]
        held += [kneser_ney.symbol_costs(model, t).mean() for i, t, _ in rows if fold[i] == f]
    limits = {r["threshold"] for r in kneser_ney.judged(frame, labels, how).collect()}
    assert len(limits) == 1
    assert abs(sum(c > math.log10(max(limits)) for c in held) - 40) <= 2


def test_bad_stretch_in_a_long_text(spark):
    """The threshold is the quantile itself, and eight odd words show in 200 usual ones."""
    rng = random.Random(9)
    usual = ["".join(rng.choices("etaoin", k=5)) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(usual, k=n))
    odd = " ".join("".join(rng.choices("jkqxzv", k=3)) for _ in range(8))
    rows = [(i, text(200), "en") for i in range(300)] + [(1000 + i, f"{text(100)} {odd} {text(100)}", "en") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    how = kneser_ney.Fit(quantile=0.9, grid=1e-6, enough=0)
    got = {r["doc_id"]: r for r in kneser_ney.judged(frame, labels, how).collect()}
    assert not any(got[i]["kept"] for i in range(1000, 1010))
    sampled = {r["doc_id"] for r in kneser_ney.fit(frame, labels, how)[1].collect()}
    out = [i for i in range(300) if i not in sampled]
    for score, limit in (("perplexity", "threshold"), ("worst", "worst_threshold")):
        # a tenth of those outside the sample, to the grid
        assert abs(sum(got[i][score] > got[i][limit] for i in out) - len(out) / 10) <= 2


def blank_crossing(folder):
    """A tokenizer without words: tokens reach over blanks, up to four words long."""
    from tokenizers import Tokenizer, models

    letters = list("abcdef \n")
    merges = [("a", " "), ("a ", "b"), (" ", "c"), ("d", " c"), ("d c", "a "), ("a b", " c"), ("e", "f"), ("ef", " "), ("ef ", "ef "), ("f", " ")]
    vocabulary = {t: i for i, t in enumerate([*letters, *(x + y for x, y in merges)])}
    path = f"{folder}/crossing.json"
    Tokenizer(models.BPE(vocabulary, merges)).save(path)
    return path


@pytest.mark.parametrize(("crossing", "word_by_word"), [(False, False), (False, True), (True, False)])
def test_joins_are_repaired(folder, crossing, word_by_word):
    """Every single cut, and many at once, give what the whole text gives."""
    path = blank_crossing(folder) if crossing else queries.tokenizer_path()
    whole = chunked_bpe.tokenizer(path)
    library = chunked_bpe.tokenizer(path, word_by_word)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdef  \n") for _ in range(rng.randint(1, 90))) for _ in range(12)]
    texts += ["ef " * 30, "a b c " * 9, "abcdef" * 12, " \n ", ""]
    if not crossing:
        texts += ["Some words, don't\tsplit any-thing \n\u00e9t\u00e9  here.", "e\u0301 a\u00a0b <|endoftext|> c\U0001f642d \u0301x 123"]
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        some = [sorted(rng.sample(range(1, len(text)), min(len(text) - 1, k))) for k in (2, 5, 20)] if len(text) > 1 else []
        for at in [*([c] for c in range(1, len(text))), *some]:
            chunks = [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]
            parts = [chunked_bpe.Tokens.unpacked(t.packed()) for t in chunked_bpe.encoded(chunks, library)]
            found = chunked_bpe.of_chunks(chunks, parts, library)
            assert found.ids.tolist() == want, (text, at)


def test_repair_leaves_most_tokens_alone(monkeypatch):
    library = chunked_bpe.tokenizer(queries.tokenizer_path())
    text = "some plain words that stand in a long line of text " * 40
    chunks = [text[:700], text[700:1300], text[1300:]]
    parts = chunked_bpe.encoded(chunks, library)
    seen = []
    real = chunked_bpe.encoded
    monkeypatch.setattr(chunked_bpe, "encoded", lambda texts, lib: seen.extend(texts) or real(texts, lib))
    found = chunked_bpe.of_chunks(chunks, parts, library)
    assert found.ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(seen) == 2 and all(len(w.split()) == 3 for w in seen)


def test_words_are_joined_without_their_places():
    """Every cut gives the ids of the whole text, and only the words it may split are encoded again."""
    path = queries.tokenizer_path()
    whole = chunked_bpe.tokenizer(path)
    rng = random.Random(12)
    texts = ["Some words, don't\tsplit any-thing \n\u00e9t\u00e9  here.", "e\u0301 a\u00a0b <|endoftext|> c\U0001f642d \u0301x 123", "x" * 40, " \n ", ""]
    texts += ["".join(rng.choice("abcdef  \n") for _ in range(60)) for _ in range(5)]
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        assert chunked_bpe.decoded(want, whole) == whole.decode(want, skip_special_tokens=False)
        some = [sorted(rng.sample(range(1, len(text)), min(len(text) - 1, k))) for k in (2, 5, 20)] if len(text) > 1 else []
        for at in [[], *([c] for c in range(1, len(text))), *some]:
            chunks = [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]
            inner = chunked_bpe.Words(whole).inner(chunks)
            mixed = [p if rng.random() < 0.5 else (c, None) for p, c in zip(inner, chunks)]
            for parts in (inner, mixed):
                words = chunked_bpe.Words(whole)
                [found] = words.joined([parts])
                assert found.tolist() == want, (text, at)
                assert parts is mixed or len(words.known) <= len(chunks) + 1


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "_KNOWN_BYTES", 5000)
    whole = chunked_bpe.tokenizer(queries.tokenizer_path())
    words = chunked_bpe.Words(whole)
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("aeiouxyz\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(3)]
        assert [i.tolist() for i in words.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.known) < 300


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "_GROUP_CHARS", 300)
    library = chunked_bpe.tokenizer(queries.tokenizer_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeioustn") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (3, 400, 0, 90)]
    texts.append("x" * 2000)
    for text, ids in zip(texts, chunked_bpe.encode_texts(texts, library, mask_bits=6)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoded_documents(docs, rows):
    library = chunked_bpe.tokenizer(queries.tokenizer_path())
    got = chunked_bpe.encoded_documents(docs, queries.tokenizer_path(), 6).collect()
    want = [(i, str(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert expected((r["doc_id"], str(list(r["ids"]))) for r in got) == expected(want)


def test_repair_of_cuts_close_together(folder):
    """Windows that overlap, widen and reach back, with a tokenizer whose tokens cross blanks too."""
    rng = random.Random(1)
    path = queries.tokenizer_path()
    libraries = [chunked_bpe.tokenizer(path, word_by_word) for word_by_word in (False, True)]
    libraries.append(chunked_bpe.tokenizer(blank_crossing(folder)))
    for _ in range(150):
        words = ["".join(rng.choices("aeionst\u00e9'1.", k=rng.choice((1, 2, 3, 9)))) for _ in range(rng.choice((1, 5, 60, 300)))]
        text = "".join(w + rng.choice((" ", " ", "\n", "  \t")) for w in words)
        at = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.choice((1, 5, 60)))))
        parts = [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]
        for library in libraries:
            got = chunked_bpe.of_chunks(parts, chunked_bpe.encoded(parts, library), library)
            [want] = chunked_bpe.encoded([text], library)
            assert got.ids.tolist() == want.ids.tolist()


# ---- licenses ----


def test_licenses(docs, rows):
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[120]["licenses"] == "all-rights-reserved,apache-2.0" and found[120]["n_exact"] == 2
    assert found[121]["licenses"] == "apache-2.0" and found[122]["n_notices"] == 0
    assert sum(r["n_notices"] for r in found.values()) == 3


def _licenses(text: str) -> tuple[list[str], list[str]]:
    rules = licenses.Rules()
    found, near = licenses.search(text, licenses.Compressors(rules), rules)
    return [f[0] for f in found], [f[0] for f in near]


@pytest.mark.parametrize(
    "text, names",
    [
        (licenses.TEMPLATES["lgpl-2.1-notice"], ["lgpl-2.1-notice"]),
        ("This program is distributed under the GNU General Public License, version 2.", ["gpl-2.0-name"]),
        ("Licensed under CC BY 3.0.", ["cc-by-3.0"]),
        ("Licensed under CC-BY-SA-4.0.", ["cc-by-sa-4.0"]),
        ("This work is not in the public domain.", []),
        ("It is not licensed under CC BY 4.0.", []),
        ("You may not copy it. Licensed under CC BY 4.0.", ["cc-by-4.0"]),
        ("Licensed under the GNU Affero General Public License v3.0 or later.", ["agpl-3.0-or-later"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["spdx:Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0+", ["spdx:GPL-2.0+"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["spdx:GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: GPL-1.0", []),
        ("All rights" + " " * 25 + "reserved.", ["all-rights-reserved"]),
        ("ALL RIGHTS RESERVED", ["all-rights-reserved"]),
        ("Licenced under the Apache Licence, Version 2.", ["apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Lesser Apache License, Version 2.0.", []),
        ("All rights reserved. All rights reserved.", ["all-rights-reserved"] * 2),
    ],
)
def test_license_names_versions_and_negations(text, names):
    for whole in (text, f"Once upon a time there was a text. {text}\n\nIt went on for long."):
        assert _licenses(whole)[0] == names


def test_license_near_misses():
    assert _licenses("This work is not in the public domain.") == ([], ["public-domain"])
    assert _licenses("Licensed under the Lesser Apache License, Version 2.0.") == ([], ["apache-2.0"])
    assert _licenses("A text without any.") == ([], [])


def test_licenses_against_all_word_windows():
    """As with every word of a template as anchor and no look at word counts."""
    rng, rules = random.Random(11), licenses.Rules()
    tools = licenses.Compressors(rules)
    names = sorted(licenses.TEMPLATES)
    fillers = ["not", "the", "a", "free", "work", "version", "2.0", "license", "under", "public", "\n", "-", ".", "lesser", "3"]
    hits = 0
    for _ in range(25):
        parts = []
        for name in rng.sample(names, 3):
            words = licenses.TEMPLATES[name].split()
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = rng.choices(fillers, k=rng.randint(0, 1))
            parts += [*words, *rng.choices(fillers, k=rng.randint(0, 4))]
        text = " ".join(parts)
        spans = [m.span() for m in re.finditer(licenses._WORD, text)]
        words = [licenses._fold(text[a:b]) for a, b in spans]
        windows = []
        for name in names:
            size, spare = len(tools.words[name]), tools.spare[name]
            at = {i - j for i, w in enumerate(words) for j, own in enumerate(tools.words[name]) if w == own}
            windows += [(name, max(0, i - spare), min(len(words), i + size + spare)) for i in at]
        slow = licenses.judged(text, words, spans, [w for w in windows if w[1] < w[2]], tools, rules)
        fast = licenses.search(text, tools, rules)
        assert [(f[0], *f[1:3], *f[5:]) for f in fast[0]] == [(f[0], *f[1:3], *f[5:]) for f in slow[0]]
        hits += len(fast[0])
    assert hits > 40


def test_license_lost_in_prose():
    """Every verbatim notice in the middle of a long line of ordinary words is found."""
    rng, rules = random.Random(3), licenses.Rules()
    tools = licenses.Compressors(rules)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(5, 9))) for _ in range(n))
    for name, notice in licenses.TEMPLATES.items():
        for n in (100, 300, 3000):
            text = f"{prose(n)} {notice} {prose(n)}"
            start = text.index(notice)
            found = [(f[0], f[1], f[2], f[5], f[6]) for f in licenses.find(text, tools, rules)]
            assert found == [(name, start, start + len(notice.rstrip(".")), 0, 0)]
    line = "word " * 3000 + "Released under the MIT License. " + "word " * 3000
    assert [(f[0], f[5]) for f in licenses.find(line, tools, rules)] == [("mit", 0)]


def test_license_over_lines():
    """Wrapped and commented notices, and several in one line."""
    rules = licenses.Rules()
    tools = licenses.Compressors(rules)
    for name, notice in licenses.TEMPLATES.items():
        for mark in ("", " * ", "# "):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(notice, 24))
            found = licenses.find(f"Some words first.\n\n{wrapped}\n\nAnd more.", tools, rules)
            assert [(f[0], f[5], f[6]) for f in found] == [(name, 0, 0)]
    both = licenses.find("All rights reserved. Licensed under CC BY 4.0.", tools, rules)
    assert [f[0] for f in both] == ["all-rights-reserved", "cc-by-4.0"]
    many = licenses.find(" ".join([*licenses.TEMPLATES.values()] * 3), tools, rules)
    assert Counter(f[0] for f in many) == dict.fromkeys(licenses.TEMPLATES, 3)


# ---- archives ----


def test_archives(spark):
    big, other = "<p>" + "é" * 600, "y" * 1000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://d\r\nX: y", "small"), (5, "e", "small"),
        (6, "f", None), (None, "g", big), (7, "h", other), (8, "i", other), (8, "i", other), (9, "j", ""),
    ]
    frame = spark.createDataFrame([(*p, "?", "?") for p in pages], "page_id int, url string, html string, payload string, copies string")
    want = []
    last = {h: max(i for i, _, x in pages if x == h and i is not None) for h in (big, other)}
    done = set()
    for i, u, h in pages:
        raw = (h or "").encode()
        head = (i, len(raw), hashlib.sha1(raw).hexdigest())
        if len(raw) < 1000 or (last[h] == i and h not in done):
            done.add(h if len(raw) >= 1000 else None)
            want.append((*head, "response", None))
        else:
            want.append((*head, "revisit", last[h]))
    got = revisits.archive_pages(frame.repartition(3))
    assert result(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(want)


# ---- empty tables ----


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        quality_rules.quality_rules(no_docs),
        licenses.scan(no_docs),
        revisits.archive_pages(none),
        decontamination.contamination(no_docs, items),
        chunked_bpe.encode_documents(no_docs, queries.tokenizer_path()),
        repeats.remove_repeats(no_docs),
        personal_data.span_digest(no_docs),
        simhash.near_duplicates(no_docs),
        simhash.first_of_each(no_docs),
        matching.score_documents(no_docs),
        kneser_ney.judged(no_docs, labels),
        kneser_ney.keep_trusted_like(no_docs, labels),
    ):
        assert df.count() == 0
