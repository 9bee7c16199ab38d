"""The training-data operators against brute force, on a table of odd cases and on sf0.001."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import TO_LOWER, WORDS, sha
from pyspark.sql import functions as F

import corpus_pipeline
from seriesspark.llm import chat, decontam, line_dedup, mixing, near_dup, pii, quality, queries, substring, token_files, warc_zip
from seriesspark.llm.store import Store

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(norm(r[c]) for c in cols) for r in got.collect()) == Counter(tuple(map(norm, r)) for r in want.fetchall())


# --- mixing ------------------------------------------------------------------

def water_fill(sizes, weights, repeat):
    target, total = {}, sum(sizes.values())
    free = dict(weights)
    while True:
        left = total - sum(target.values())
        level = left / sum(free.values()) if free else 0
        over = [s for s in free if level * free[s] > repeat * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = repeat * sizes[s]
            del free[s]


def test_mixing(spark, sf_docs, odd_docs):
    for docs in (sf_docs, odd_docs):
        mix = mixing.pareto_mix(docs, mixing.word_count(F.col("text")), carry=("source",)).collect()
        assert len(mix) == docs.count()
        sizes, taken, biggest = Counter(), Counter(), Counter()
        for r in mix:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            biggest[r["source"]] = max(biggest[r["source"]], r["size"])
            assert r["taken"] <= 3 * r["size"]
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
        for r in mix:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
        again = mixing.pareto_mix(docs.repartition(5), mixing.word_count(F.col("text")), carry=("source",)).collect()
        assert multiset(mix) == multiset(again)


def test_mixing_follows_inclusion_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 2 + 1).alias("p"))
    mix = mixing.pareto_mix(docs, F.lit(1), weights=(1,), propensity=F.col("p"), carry=("p",))
    shares = {r["p"]: r["m"] for r in mix.groupBy("p").agg(F.avg("copies").alias("m")).collect()}
    assert mix.agg(F.sum("copies")).first()[0] == pytest.approx(4000, abs=1)
    assert shares[2] / shares[1] == pytest.approx(2, rel=0.1)


# --- line dedup --------------------------------------------------------------

def brute_lines(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            holders[k].add(i)
    top = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(k) >= 20 and len(holders[k]) >= 3 and top(holders[k]) != i for k in keys(t)]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop) if not d)))
    return out


def test_line_dedup(odd_docs, sf_docs):
    for docs in (odd_docs, sf_docs):
        assert multiset(line_dedup.dedup_lines(docs).collect()) == multiset(brute_lines(rows_of(docs)))


def test_line_bitmaps_across_words(spark):
    shared = [f"a shared line with the number {i:05d}" for i in range(200)]
    docs = spark.createDataFrame([(d, "\n".join(shared)) for d in range(4)], "doc_id bigint, text string")
    maps = {r["doc_id"]: r["words"] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert sorted(maps) == [0, 1, 2] and [w["word"] for w in maps[0]] == [0, 1, 2, 3]
    assert sum(64 - (w["keep"] & (2 ** 64 - 1)).bit_count() for w in maps[0]) == 200


# --- quality -----------------------------------------------------------------

def brute_quality(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {p + k for p in range(len(w) - 2) if tri[w[p], w[p + 1], w[p + 2]] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover))


def test_quality(odd_docs, sf_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (odd_docs, sf_docs):
        rows = quality.apply_policy(quality.ledger(docs.drop("n_words", "kept"), carry=("doc_id", "text"))).collect()
        for r in rows:
            want = brute_quality(r["text"])
            assert tuple(r[n] for n in names) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])


def test_ablations(sf_docs):
    rows = quality.ledger(sf_docs)
    got = {r["rule"]: r for r in quality.ablations(rows, "v1").collect()}
    bits = [r["failures"] & quality.mask(quality.POLICIES["v1"]) for r in rows.collect()]
    for rule in quality.POLICIES["v1"]:
        b = quality.bit(rule)
        assert got[rule]["failing"] == sum(1 for x in bits if x & b)
        assert got[rule]["rejected_alone"] == sum(1 for x in bits if x == b)
        assert got[rule]["kept_without"] == sum(1 for x in bits if not x & ~b)


# --- near duplicates ---------------------------------------------------------

def brute_groups(rows, n, percent=80):
    sets = []
    for i, t in rows:
        w = WORDS.findall((t or "").translate(TO_LOWER))
        sets.append({tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for r, s in enumerate(sets):
        for k in s:
            holders[k].append(r)
    seen = set()
    for rs in holders.values():
        for a in rs:
            for b in rs:
                if a < b and (a, b) not in seen and ids[a] is not None and ids[b] is not None:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(ids[a]), root(ids[b])))
                        parent[y] = x
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in zip(ids, sets)]


def test_near_duplicates(odd_docs, sf_docs):
    for docs, n in ((odd_docs, 4), (sf_docs, 4), (sf_docs, 5)):
        assert multiset(near_dup.near_duplicates(docs, shingle=n).collect()) == multiset(brute_groups(rows_of(docs), n))


def test_near_duplicate_chain_and_large_group(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * k:8 * k + 200]) for k in range(20)]  # neighbours are similar, the ends are not
    texts += [" ".join([f"g{i}" for i in range(120)] + [f"end{k}"]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, shingle=4).collect()}
    want = {i: c for i, _, c, _ in brute_groups(list(enumerate(texts)), 4)}
    assert got == want and len(set(got.values())) < 20


def test_near_copies_around_an_outlier_pivot(spark):
    """2000 copies, each near one base but not near the pivot (smallest id) or, mostly, each other: written pairs follow the members."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(240)]

    def edited(n):
        words = list(base)
        for i in rng.choice(240, n, replace=False):
            words[i] = f"x{rng.integers(10 ** 9)}"
        return " ".join(words)
    texts = [edited(5) for _ in range(2000)] + [" ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    written = []
    real = near_dup.materialize

    def counted(df, name):
        out = real(df, name)
        written.append((name, out.count()))
        return out
    near_dup.materialize, keep = counted, near_dup.materialize
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, shingle=5).collect()}
    finally:
        near_dup.materialize = keep
    assert set(got.values()) == {0}
    links = {n: c for n, c in written if n in ("stars", "hub-stars", "last")}
    assert links["stars"] < 2000 and sum(links.values()) < 6 * len(texts), written


def test_near_duplicate_tiles_skip_a_common_label(spark, odd_docs, sf_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 10)
    # key 1: a component of 1000 and one straggler; key 2: components of 30 and 25 and 12 of 1; key 3: one component
    labels = [(1, 0)] * 1000 + [(1, 5000)] + [(2, 0)] * 30 + [(2, 1)] * 25 + [(2, 6000 + i) for i in range(12)] + [(3, 0)] * 40
    now = spark.createDataFrame([(b, i, lab) for i, (b, lab) in enumerate(labels)], "band bigint, doc_id bigint, label bigint")
    deal = near_dup.tiling(now)
    none = [F.lit(1).alias("n"), F.lit(b"").alias("regs"), F.lit(b"").alias("sig")]
    rows = near_dup.tile_rows(now.join(deal, ["band", "label"]).select("*", *none)).collect()
    assert Counter(r["band"] for r in rows) == {1: 1000 + 101, 2: 30 * 5 + 25 * 5 + 12 * 8}
    assert near_dup.unit_count(deal) == max(near_dup.partitions(spark), -(-len(rows) // 40))
    meet = defaultdict(list)
    for r in rows:
        meet[r["band"], r["i"], r["j"]].append((r["doc_id"], r["label"]))
    met = {(a, b) for v in meet.values() for a, x in v for b, y in v if a < b and x != y}
    want = {(a, b) for a, (k, x) in enumerate(labels) for b, (m, y) in enumerate(labels) if a < b and k == m and x != y}
    assert met == want and max(map(len, meet.values())) < 60
    for docs in (odd_docs, sf_docs):
        assert multiset(near_dup.near_duplicates(docs, shingle=4).collect()) == multiset(brute_groups(rows_of(docs), 4))


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    v = np.unique(draw(4000))
    first = v[v >> np.uint64(64 - near_dup.BAND_BITS) == 0].min()
    reg = near_dup.registers(v, near_dup.BAND_BITS, 62, near_dup.BAND_MANTISSA)[0]
    assert reg >> near_dup.BAND_MANTISSA == 64 - near_dup.BAND_BITS - int(first).bit_length() + 1
    for size in (40, 300, 5000):
        pairs = []
        for _ in range(60):
            common, own = draw(size), draw(size // 8)
            a, b = np.unique(np.concatenate([common, own])), np.unique(np.concatenate([common, draw(size // 8)]))
            pairs.append((a, b, len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        A = np.stack([near_dup.registers(a) for a, _, _ in pairs]).astype(np.uint8)
        B = np.stack([near_dup.registers(b) for _, b, _ in pairs]).astype(np.uint8)
        na, nb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
        true = np.array([p[2] for p in pairs])
        est, _ = near_dup.estimate(A, B, na, nb)
        assert abs((est - true).mean()) < 0.01 and abs(est - true).max() < 0.1
        assert near_dup.plausible(A, B, na, nb, int(true.min() * 100)).all()
        assert not near_dup.plausible(A, np.roll(B, 1, axis=0), na, nb, 50).any()


# --- token files -------------------------------------------------------------

def brute_tokens(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]


def test_token_files_of_control_strings(spark):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|><|endoftext|> c\n<|endoftext|>", "<|endof text|> plain", "é<|endoftext|>ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(token_files.write_tokens(docs, queries.tokenizer_path()), digest=False).collect()}
    want = dict(brute_tokens(list(enumerate(texts))))
    assert got == want and 50256 in want[0]


def test_token_files(spark, odd_docs, sf_docs):
    for docs in (odd_docs, sf_docs):
        want = brute_tokens(rows_of(docs))
        manifest = token_files.write_tokens(docs, queries.tokenizer_path())
        got = token_files.read_tokens(manifest).collect()
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
        got.sort(key=lambda r: r["start"])
        at, last = 0, None
        for r in got:
            assert r["start"] == at and (last is None or r["doc_id"] >= last)
            at, last = at + r["n_tokens"], r["doc_id"]
        full = {r["start"]: r["ids"] for r in token_files.read_tokens(manifest, digest=False).collect()}
        for f in manifest.collect():
            for k in (0, f["n_tokens"] // 2, f["n_tokens"] - 1):
                start = max(s for s in full if s <= f["start"] + k)
                assert token_files.tokens_of(spark, f["path"], k) == [full[start][f["start"] + k - start]]


def test_codes_of_all_widths():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 2 ** b, 3000) for b in (4, 10, 16, 24, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    raw = b"".join(token_files.shard_file([1, None], [len(ids) - 1, 1], ids))
    shard = token_files.Shard(lambda at, n: raw[at:at + n])
    assert shard.ids(0, len(ids)).tolist() == ids.tolist()
    for k in (0, 1, 511, 512, 513, 7777, len(ids) - 1):
        assert shard.ids(k, 1)[0] == ids[k]


# --- chat --------------------------------------------------------------------

def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "a\\\\l<b>\\g", None, "", "</turn>\n<turn:user>x", "\\", "é\U0001f600"]
    turns = [(c, t, ("user", "assistant", None)[(c + t) % 3], nasty[(c * 3 + t) % len(nasty)]) for c in range(5) for t in range(6)]
    turns += [(0, 0, "user", nasty[0]), (None, None, "assistant", "no conversation")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(df, chat.text_part(F.col("text")))
    out = out.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("t"),
                     chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 6
    for r in out:
        want = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in turns if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["t"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant") and r["n_turns"] == len(want)


def test_chat_attachments(spark):
    image = ("image", None, "s3://a/1.png", 1024, 600, None)
    audio = ("audio", None, "b.wav", None, None, 2.5)
    pages = ("document", None, "c.pdf", None, None, 3.0)
    text = lambda x: ("text", x, None, None, None, None)
    df = spark.createDataFrame([(1, 0, "user", [text("see <image:0>"), image, text(" and "), audio]), (1, 1, "assistant", [text("ok"), pages]),
                                (2, 0, "user", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(df, F.col("parts")).collect()}
    r = got[1]
    assert r["formatted"] == "<turn:user>see \\limage:0\\g<image:0> and <audio:1></turn>\n<turn:assistant>ok<document:2></turn>\n"
    assert [(a["turn_index"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, "image", "s3://a/1.png", 85 + 170 * 4), (0, "audio", "b.wav", 63), (1, "document", "c.pdf", 4500)]
    s = r["loss_spans"][0]
    assert r["formatted"][s["start"]:s["start"] + s["length"]] == "ok<document:2>"
    assert got[2]["formatted"] == "<turn:user></turn>\n" and got[2]["attachments"] == [] and got[2]["attachment_tokens"] == 0


# --- archives ----------------------------------------------------------------

def test_archives(spark):
    pages = [(3, "http://b/", "same"), (1, "http://a/ x", "same"), (2, None, None), (5, "http://c/", ""), (None, "u\nv", "own é"), (1, "http://a/ x", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    manifest = warc_zip.write_archives(df)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zip.read_archives(manifest).collect())
    first = {"same": 1, "": 2, "own é": None}
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        own = first[html or ""] == i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]] += 1
    assert got == want


def test_zip_reader_takes_foreign_archives(tmp_path):
    import zipfile
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"alpha")
        z.writestr("b.txt", b"b" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    with Store.reader(str(path)) as source:
        archive = warc_zip.ZipArchive(source)
        assert archive.read("a.txt") == b"alpha"
        with pytest.raises(ValueError):
            archive.read("b.txt")


def test_zip64_archive_opens_elsewhere(tmp_path):
    import zipfile
    parts = list(warc_zip.archive_parts(iter([("k", {"url": "u"}, b"record one"), ("j", {"url": "v"}, b"record two")])))
    path = tmp_path / "y.wacz"
    path.write_bytes(b"".join(parts))
    with zipfile.ZipFile(path) as z:
        assert z.read(warc_zip.WARC_MEMBER) == b"record onerecord two" and z.testzip() is None


# --- substrings --------------------------------------------------------------

def brute_substrings(rows, n):
    least = {}
    order = lambda i: -2 ** 63 if i is None else i
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, w in words:
        drop = [False] * len(w)
        for p in range(len(w) - n + 1):
            if least[tuple(w[p:p + n])] < order(i):
                drop[p:p + n] = [True] * n
        out.append((i, len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)))
    return out


@pytest.mark.parametrize("length", [5, 13])
def test_substrings(odd_docs, sf_docs, length):
    for docs in (odd_docs, sf_docs):
        got = substring.dedup_substrings(docs, length=length).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == Counter(brute_substrings(rows_of(docs), length))
        assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


# --- personal data -----------------------------------------------------------

def test_pii(spark, odd_docs, sf_docs):
    text = ("Mr. John Smith and Mrs. SMITH; Mr. Smith called +1 (209) 555-2713 or +1 209-555-2713, card 4111 1111 1111 1111 and "
            "4111111111111111, a.b@x.org A.B@x.org 10.0.0.1 password=abC12 Госпожа Анна Иванова")
    extra = spark.createDataFrame([(900, text), (901, "again a.b@x.org. Plain 4.0. words"), (902, "nothing here")], "doc_id bigint, text string")
    docs = extra.unionByName(odd_docs.select("doc_id", "text")).unionByName(sf_docs.select("doc_id", "text"))
    before = Counter(docs.select("doc_id").collect())
    rows = pii.replace_pii(docs, "k").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before.elements())
    got = {r["doc_id"]: r for r in rows}
    new = got[900]["text"].split()
    assert got[900]["n_entities"] == 12 and got[902]["text"] == "nothing here"
    family = new[2]
    assert new[5] == family.upper() + ";" and new[7] == family and new[1].split("-")[0] in pii.GIVEN["m_latin"]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    luhn = lambda s: sum(int(x) for i, c in enumerate(reversed(s)) for x in str(int(c) * (1 + i % 2))) % 10
    cards = [digits(" ".join(new[new.index("card") + 1:new.index("card") + 5])), new[new.index("card") + 6].strip(",")]
    assert cards[0] == cards[1] and luhn(cards[0]) == luhn("4111111111111111") and cards[0] != "4111111111111111"
    assert new[-1][0].isupper() and new[-2].split("-")[0] in pii.GIVEN["f_cyrillic"] and new[-1] != "Иванова"
    mail = next(x for x in new if "@" in x)
    assert mail in got[901]["text"] and "Plain 4.0. words" in got[901]["text"]
    assert Counter(r["text"] for r in pii.replace_pii(docs.repartition(3), "k").collect()) == Counter(r["text"] for r in rows)


def test_pii_surrogates_stay_distinct(spark):
    values = spark.range(4000).select(F.lit("family_latin").alias("type"), F.concat(F.lit("Name"), F.col("id")).alias("ident")) \
        .union(spark.range(300).select(F.lit("given_m_latin"), F.concat(F.lit("Given"), F.col("id"))))
    done = pii.assign(values, "k")
    shown = done.select("type", pii.surrogate(F.col("type"), F.col("ident"), F.col("digest"), F.col("attempt")).alias("s"))
    assert done.count() == 4300 and shown.distinct().count() == 4300 and done.where("attempt > 0").count() > 0


def test_pii_secrets_in_quotes_and_capitals(spark):
    low, up = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    leak = ["Xy9-kk2", "k77zz", "two words", "esc\\\"aped", "Qq1", "пароль", "#!$", "Zz8", "open7"]
    rows = [(1, f'TOKEN = "{up}"', 1), (2, f'see {low} token = "{low}"', 2), (3, 'password = "Xy9-kk2", api_key: k77zz', 2),
            (4, "{\"password\": \"two words\", 'pwd' : 'Qq1'}", 2), (5, 'secret = "esc\\"aped" end', 1), (6, "token=пароль pwd=#!$ Token:=Zz8", 3),
            (7, 'token = "open7', 1), (8, "Secret: Mr. John Smith, token: +1 (209) 555-2713 password: 4111 1111 1111 1111", 3),
            (9, "the token ring; password: \n secrets = none; pwd=\"\"", 0), (10, "[0-9] pwd=1 pwd=2 pwd=3 pwd=4 pwd=5 pwd=6 pwd=7 pwd=8 pwd=9 pwd=0 pwd=x", 11)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(docs, "k").collect()}
    assert {i: r["n_entities"] for i, r in got.items()} == {i: n for i, _, n in rows}
    assert not [v for v in [low, up, "Smith", "555-2713", "1111", *leak] if any(v in r["text"] for r in got.values())]
    shown = got[1]["text"].removeprefix('TOKEN = "').removesuffix('"')
    assert len(shown) == 40 and shown == shown.upper() and got[2]["text"] == f'see {shown.lower()} token = "{shown.lower()}"'
    assert got[3]["text"].startswith('password = "') and got[3]["text"][19:31] == '", api_key: ' and got[9]["text"] == rows[8][1]
    assert len(set(got[10]["text"].split()[1:])) == 11


@pytest.mark.parametrize("after", ["190.137.223.204", "4111 1111 1111 1111", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "123abc@x.org"])
def test_pii_phone_ends_before_the_next_entity(spark, after):
    phones = ["+1 (826) 555-4081", "+49 30 1234 5678", "+49 30 1234"]
    docs = spark.createDataFrame([(i, f"call {p} {after} now") for i, p in enumerate(phones)] + [(i + 10, p) for i, p in enumerate([*phones, after])],
                                 "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(docs, "k").collect()}
    for i in range(3):
        assert got[i]["n_entities"] == 2 and got[i]["text"] == f"call {got[10 + i]['text']} {got[13]['text']} now"


def test_pii_phone_ends_before_a_number(spark):
    rows = [(1, "+1 (826) 555-4081 2024 x", " 2024 x"), (2, "+49 30 1234 5678 2024 x", " 2024 x"), (3, "+49 30 1234 12.50 x", " 12.50 x"),
            (4, "+33.612.34.56.78", ""), (5, "+7 (495) 123-45-67", ""), (6, "+49 30 12 34.56", "")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    for r in pii.replace_pii(docs, "k").collect():
        old, tail = next(x[1:] for x in rows if x[0] == r["doc_id"])
        digits = sum(c.isdigit() for c in old.removesuffix(tail))
        assert r["n_entities"] == 1 and r["text"].endswith(tail) and sum(a != b for a, b in zip(old, r["text"])) > digits // 2


# --- decontamination ---------------------------------------------------------

def brute_hits(rows, items, n):
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(TO_LOWER))
    wanted = defaultdict(set)
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            wanted[tuple(w[p:p + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for m in {len(k) for k in wanted}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p:p + m])) in wanted:
                    hit |= set(range(p, p + m))
                    found |= wanted[k]
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found)))))
    return out


@pytest.mark.parametrize("chunk", [500_000, 300])
def test_contamination(spark, odd_docs, sf_docs, chunk):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    few = spark.createDataFrame([(900, "fox jumps over"), (901, None), (902, " .,;"), (903, "WORD"), (900, "fox jumps over")], "item_id bigint, text string")
    items = bench.unionByName(few)
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    for docs in (odd_docs, sf_docs):
        got = decontam.contamination(docs, items, chunk_words=chunk).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter(brute_hits(rows_of(docs), pairs, 10))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta y gamma"), (3, "alpha beta"), (4, "gamma. alpha far far far far beta")],
                                 "doc_id bigint, text string")
    item = spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string")
    hits = lambda slop: {r["doc_id"] for r in decontam.contamination(docs, item, slop=slop).where("n_hit > 0").collect()}
    assert hits(0) == {1} and hits(2) == {1, 2}


# --- empty tables, pipeline --------------------------------------------------

def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    empty = [mixing.pareto_mix(no_docs, mixing.word_count(F.col("text"))), line_dedup.dedup_lines(no_docs), quality.ledger(no_docs),
             near_dup.near_duplicates(no_docs), token_files.read_tokens(token_files.write_tokens(no_docs, queries.tokenizer_path())),
             substring.dedup_substrings(no_docs), pii.replace_pii(no_docs, "k"), decontam.contamination(no_docs, items),
             chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), chat.text_part(F.col("text"))),
             warc_zip.read_archives(warc_zip.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string")))]
    assert [df.count() for df in empty] == [0] * len(empty)


def test_contamination_without_items(spark, odd_docs):
    items = spark.createDataFrame([(1, None)], "item_id bigint, text string")
    got = decontam.contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and all(r["n_hit"] == 0 and r["items"] == [] for r in got)


def brute_pipeline(rows, items):
    def passes(t):
        n, chars, sym, dup, rep = brute_quality(t)
        lines = sum(1 for x in (t or "").split("\n") if WORDS.search(x))
        upper = sum(1 for c in t or "" if c.isupper())
        return not (n < 50 or 100 * rep > 50 * n or 10 * sym > n or 100 * dup > 50 * lines or chars > 12 * n or chars < 2 * n or 2 * upper > chars)
    rows = [r for r in rows if passes(r[1])]
    kept = {i for i, _, c, k in brute_groups([r[:2] for r in rows], 5) if k}
    rows = [r for r in rows if r[0] in kept]
    hit = {i for i, _, n, _ in brute_hits([r[:2] for r in rows], items, 10) if n}
    return [r for r in rows if r[0] not in hit]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0]: r for r in brute_pipeline([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], items)}
    cur = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        cur = stage(spark, cur, SF)
        assert cur.columns == docs.columns
    assert sorted(r["doc_id"] for r in cur.collect()) == sorted(want)
    mixed = corpus_pipeline.source_mix(spark, cur, SF)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(want)
    out = corpus_pipeline.run(spark, SF).collect()
    tokens = dict(brute_tokens([(i, want[i][1]) for i in copies]))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter({(i, len(tokens[i])): n for i, n in copies.items()})
    assert sorted(r["start"] for r in out)[-1] + max(out, key=lambda r: r["start"])["n_tokens"] == sum(len(tokens[i]) * n for i, n in copies.items())


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
    kept = corpus_pipeline.near_dedup(spark, odd_docs, SF)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and ids[0] == 1 and ids[1] == 0 and ids[None] == 1
    assert sha("") == hashlib.sha256(b"").hexdigest()


def test_pipeline_near_dedup_keeps_other_texts_of_an_id(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["a"] + " end"), (2, text["c"]), (0, text["d"]), (3, text["d"]), (None, text["d"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert multiset(kept.collect()) == multiset([(1, text["a"]), (1, text["b"]), (2, text["c"]), (0, text["d"]), (None, text["d"])])


# --- hot payload, clashing columns, very long pages ---------------------------

def test_archives_of_a_hot_payload_and_long_pages(spark):
    hot, long = "<p>same page</p>" * 20, "<p>" + "very long ü " * 60_000 + "</p>"
    rows = [(i, f"http://h/{i}", hot if i % 3 else f"<p>{i}</p>", "x", 7, "y") for i in range(300)] + [(400, None, long, "x", 7, "y"), (401, "u", long, "x", 7, "y"), (402, "u", None, "x", 7, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, record_type int, sha1 string")
    got = {r["page_id"]: r for r in warc_zip.read_archives(warc_zip.write_archives(pages)).collect()}
    first = {}
    for i, _, html, *_ in sorted(rows):
        first.setdefault(html or "", i)
    for i, url, html, *_ in rows:
        body, r = (html or "").encode(), got[i]
        assert r["payload_bytes"] == len(body) and r["url"] == url
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
    assert len(got) == len(rows)


def test_segment_hashes_in_bounded_memory():
    """Words of a segment are hashed in runs of few bytes: temporaries follow the words, not a multiple of the text."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 50_000, 1000))) for _ in range(1400)] + [None, "", "A-b a b"]
    column, size = pa.array(texts), sum(len(t or "") for t in texts)
    tracemalloc.start()
    try:
        h, first = decontam._words(column, 0, len(column))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * size
    assert np.diff(first).tolist() == [1000] * 1400 + [0, 0, 4]
    assert h[-4] == h[-2] and h[-3] == h[-1] and len(np.unique(h)) <= 50_002


def test_postings_are_ascending_positions():
    h = np.array([7, 3, 7, 9, 3, 7], np.uint64)
    terms, limits, at = decontam.postings(h)
    assert terms.tolist() == [3, 7, 9] and limits.tolist() == [0, 2, 5, 6] and at.tolist() == [1, 4, 0, 2, 5, 3]
    assert [x.tolist() for x in decontam.postings(h[:0])] == [[], [0], []]


def test_encoder_makes_each_pre_token_once():
    """Pieces are pre-tokens, so words that meet other signs and lines are not tokenized again; ids are the library's."""
    import pyarrow as pa

    from seriesspark.llm import kernel as K
    enc = token_files.Encoder(queries.tokenizer_path())
    words = ["ab" + chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)]
    texts = [f"{a}.\n{b}, {b}\n{a}!" for a in words for b in words[::7]]
    odd = ["don't a\r\n\n b\n c\n\nd", "x<|endoftext|>y.\nz", "é\nÉ ×÷ 1a2\tb", "a\n \nb  c\n", "\n", None, "", "中\nß. áb c\x1cd"]
    asked, real = [], enc.piece
    enc.piece = lambda raw: asked.append(raw) or real(raw)

    def ids_of(column):
        got, n = enc.encode(*K.utf8(pa.array(column, pa.string())))
        cuts = [0, *np.cumsum(n).tolist()]
        return [got[a:b].tolist() for a, b in zip(cuts, cuts[1:])]

    want = [[enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ts] for ts in (texts, odd, odd[2:])]
    assert ids_of(texts) == want[0]
    assert len(asked) <= 2 * len(words) + 4  # a word with and without its blank, and the signs
    assert ids_of(odd) == want[1] and ids_of(odd[2:]) == want[2]
