"""Source divergence, packing and whitening against brute force, on odd cases and sf0.001."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import TO_LOWER
from pyspark.sql import functions as F

from seriesspark.llm import divergence, packing, queries, whitening
from seriesspark.llm.perfect_hash import PerfectHash
from seriesspark.llm import kernel as K

SF = "/root/testdata/sf0.001"


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# --- perfect hash ------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 100, 20000])
def test_perfect_hash(n):
    keys = pa.array([f"k{i}é".encode() for i in range(n)], pa.large_binary())
    ph = PerfectHash.of_row(PerfectHash.build(keys).row())
    assert sorted(ph.slots(keys, K.column_hashes(keys)).tolist()) == list(range(n))
    others = pa.array([f"x{i}".encode() for i in range(500)], pa.large_binary())
    assert (ph.slots(others, K.column_hashes(others)) == -1).all()


def test_perfect_hash_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(K, "column_hashes", lambda c: np.zeros(len(c), np.uint64))
    keys = pa.array([b"a", b"b", b"c"], pa.large_binary())
    ph = PerfectHash.build(keys)
    assert sorted(ph.slots(keys, np.zeros(3, np.uint64)).tolist()) == [0, 1, 2]
    assert ph.slots(pa.array([b"d"], pa.large_binary()), np.zeros(1, np.uint64)).tolist() == [-1]


# --- divergence --------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, min_docs, top):
    rows = [((lang or ""), (source or ""), TERM.findall((text or "").translate(TO_LOWER))) for lang, source, text in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        groups = {s: c for (x, s), c in count.items() if x == lang}
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, x, r) for r, (i, x) in enumerate(items, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, odd_docs, no_docs, monkeypatch, small):
    if small:  # several shards, rounds, chunks and blocks
        for name, value in (("SHARD_TERMS", 8), ("ROUND_BYTES", 200), ("CHUNK", 3), ("BLOCK", 2)):
            monkeypatch.setattr(divergence, name, value)
    for min_docs in (1, 3, 100):
        got = divergence.source_divergence(odd_docs, min_docs=min_docs, top=4)
        rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
        assert multiset(got.collect()) == multiset(brute_divergence(rows, min_docs, 4))
        if small:
            break
    assert divergence.source_divergence(no_docs).count() == 0


def test_shares_of_large_counts(spark):
    n, total, v = 3 * 10 ** 15, 8 * 10 ** 15, 10 ** 6
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.share(F.lit(total), F.lit(total), F.lit(1)).alias("q")).first()
    assert tuple(got) == (1 + 10 ** 9 * (n + 5) // (total + 5 * v), 10 ** 9 + 1)


# --- packing -----------------------------------------------------------------

def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def brute_cost(places, penalties, length):
    places, best = [0, *places], [0]
    for j in range(1, len(places)):
        ways = []
        for i in range(j):
            size = places[j] - places[i]
            if size <= length:
                ways.append(best[i] + (0 if size & (size - 1) == 0 else length - size))
        best.append(min(ways) + penalties[j - 1] + packing.WINDOW_COST)
    return best[-1]


def test_packer_is_optimal():
    rnd = random.Random(1)
    for _ in range(150):
        length, n, p = rnd.choice([16, 20, 64]), rnd.randint(1, 100), 0
        places = []
        for _ in range(n):
            p += rnd.randint(1, min(length, rnd.choice([3, 8, length])))
            places.append(p)
        penalties = [rnd.choice([0, 8, 64]) for _ in places]
        packer, cuts, step = packing.Packer(length), [0], rnd.randint(1, 40)
        for a in range(0, n, step):
            packer.add(places[a:a + step], penalties[a:a + step])
            cuts += packer.settled()[1:]
        cuts += packer.settled(last=True)[1:]
        at = dict(zip(places, penalties))
        cost = sum((0 if (b - a) & (b - a - 1) == 0 else length - b + a) + at[b] + packing.WINDOW_COST for a, b in zip(cuts, cuts[1:]))
        assert cuts[-1] == places[-1] and cost == brute_cost(places, penalties, length)


def check_packed(docs, length):
    path, tok = tokenizer()
    seqs = packing.pack(docs, path, length=length).collect()
    assert sorted(r["sequence_id"] for r in seqs) == list(range(len(seqs)))
    whole = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    place = lambda d: (d is not None, d or 0)
    stream = []
    for r in sorted(seqs, key=lambda r: r["sequence_id"]):
        at = 0
        assert 0 < len(r["ids"]) == r["n_tokens"] <= length and r["padded"] == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else length)
        for p in r["pieces"]:
            assert p["offset"] == at and p["length"] > 0
            stream.append((p["doc_id"], p["start"], p["doc_tokens"], r["ids"][at:at + p["length"]]))
            at += p["length"]
        assert at == r["n_tokens"]
    docs_read = []
    for doc, start, size, ids in stream:
        if start == 0:
            docs_read.append((doc, size, []))
        assert docs_read[-1][0] == doc and docs_read[-1][1] == size and len(docs_read[-1][2]) == start
        docs_read[-1][2].extend(ids)
    assert [d[0] for d in docs_read] == sorted((d[0] for d in docs_read), key=place)
    assert Counter((d, tuple(i)) for d, _, i in docs_read) == Counter((d, tuple(i)) for d, i in whole)
    return sum(r["padded"] - r["n_tokens"] for r in seqs), sum(len(i) for _, i in whole)


def test_packing(spark, odd_docs, no_docs):
    for length in (2048, 64, 7):
        check_packed(odd_docs, length)
    padding, tokens = check_packed(spark.read.parquet(f"{SF}/documents.parquet"), 2048)
    assert padding < 0.03 * tokens
    path, _ = tokenizer()
    assert packing.pack(no_docs, path).count() == 0


def test_packing_cuts_at_sentences_and_long_stretches(spark):
    docs = spark.createDataFrame([(0, "One two three. Four five six! seven eight\nnine \"ten.\" eleven"), (1, "word " * 5000)], "doc_id bigint, text string")
    path, _ = tokenizer()
    cuts = [p["start"] for r in packing.pack(docs, path, length=8).orderBy("sequence_id").collect() for p in r["pieces"] if p["doc_id"] == 0]
    assert set(cuts) <= {0, 4, 8, 10, 14}
    check_packed(docs, 2048)


def test_packing_digests(spark):
    path, tok = tokenizer()
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_pack_windows(spark, SF).collect():
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


# --- whitening ---------------------------------------------------------------

def spectrum_of(X):
    s = whitening.Spectrum(X.shape[1])
    s.add(X)
    return s


def scatter(X):
    C = X - X.mean(axis=0)
    return C.T @ C


@pytest.mark.parametrize("make", [
    lambda g: g.integers(-100, 100, (300, 24)), lambda g: (g.normal(size=(200, 24)) * np.logspace(0, -3, 24) * 3000).astype(int),
    lambda g: g.integers(-2, 3, (300, 8)), lambda g: np.vstack([np.eye(16, dtype=int), -np.eye(16, dtype=int)]), lambda g: np.zeros((5, 4), int),
    lambda g: np.repeat(g.integers(-50, 50, (30, 1)), 12, axis=1), lambda g: g.integers(-5, 5, (1, 6)), lambda g: g.integers(-100, 100, (10, 24))])
def test_rank_one_updates(make):
    X = make(np.random.default_rng(3))
    whole, V = spectrum_of(X), scatter(X.astype(float))
    joined = spectrum_of(X[:len(X) // 3])
    joined.join(whitening.Spectrum.of_row(spectrum_of(X[len(X) // 3:]).row()))
    for s in (whole, joined):
        assert np.abs(s.Q @ np.diag(s.d) @ s.Q.T - V).max() <= 1e-12 * max(1, np.abs(V).max())
        assert np.abs(s.Q.T @ s.Q - np.eye(len(s.d))).max(initial=0) < 1e-12
        assert s.n == len(X) and s.sums == X.sum(axis=0).tolist()


def brute_whiten(rows, k=4):
    """Results by a dense eigendecomposition in exact and double arithmetic."""
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    longest = max(len(x) for _, x in whole)
    whole = [(i, x) for i, x in whole if len(x) == longest]
    fit = np.array(sorted({tuple(x) for _, x in whole}), object)
    n, S = len(fit), fit.sum(axis=0)
    C = ((n * fit - S).astype(float)) / n
    value, axes = np.linalg.eigh(C.T @ C / n)
    value, axes = value[::-1], axes[:, ::-1]
    out = []
    for i, x in whole:
        c = n * np.array(x, object) - S
        for j in range(min(k, longest)):
            out.append((i, j + 1, n, int((c * c).sum()), float((c.astype(float) / n) @ axes[:, j] / math.sqrt(value[j])) if value[j] > 1e-9 * value[0] > 0 else None,
                        value[j] / value.sum() if value.sum() > 0 else None))
    return out


def check_whitened(got, want):
    rows = lambda r: sorted(r, key=lambda x: tuple((v is not None, v or 0) for v in x[:4]))
    got = rows([tuple(r[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained")) for r in got])
    want = rows(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for c in {g[1] for g in got}:
        g, w = ([x for x in r if x[1] == c] for r in (got, want))
        assert [x[4] is None for x in g] == [x[4] is None for x in w]
        a, b = (np.array([x[4] for x in r if x[4] is not None]) for r in (g, w))
        sign = 1.0 if not len(a) or a @ b >= 0 else -1.0
        assert np.allclose(np.sort(a), np.sort(sign * b), rtol=1e-9, atol=1e-9)
        assert all((x[5] is None) == (y[5] is None) and (x[5] is None or x[5] == pytest.approx(y[5], rel=1e-6, abs=1e-12)) for x, y in zip(g, w))


def test_whitening(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op13_whitening(spark, SF).collect()
    check_whitened(got, brute_whiten([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, x string, n string, whitened string"
    make = lambda rows: spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], schema)
    g = np.random.default_rng(5)
    rows = [(i, [float(v) for v in g.normal(size=5)]) for i in range(40)]
    rows += [(50 + i, rows[0][1]) for i in range(400)]            # one frequent vector
    rows += [(None, rows[1][1]), (7, rows[2][1]), (90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5),
             (94, [float("inf")] * 5), (95, [1.0, 2.0]), (96, [-0.0, 0.0, -0.0, 0.0, 0.0])]
    check_whitened(whitening.whiten(make(rows)).collect(), brute_whiten(rows))
    for few in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], [(i, [float(i)] * 6) for i in range(9)]):
        check_whitened(whitening.whiten(make(few)).collect(), brute_whiten(few))
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None)])).count() == 0


def test_large_entries():
    X = np.array([[3 * 10 ** 9, 1], [-3 * 10 ** 9, 5]])
    assert whitening.deviations(X, 2, [0, 6]) == [None, None]
    assert whitening.centred(X, 10 ** 10, [0, 6]).tolist() == [[3e19, 1e10 - 6], [-3e19, 5e10 - 6]]
