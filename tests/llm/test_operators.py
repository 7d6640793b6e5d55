"""The corpus operators against brute force on small tables with nulls, blanks, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, fingerprint, line_dedup, lm, mixing, packing, quality, simhash, suffix_dedup, surrogates, token_files
from tidemark.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, copy_no int, fp string, n_entities string"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", "  \n\t ", "one", "Two words", "ÄÖ ß é\n\nÄÖ"]
    for i in range(40):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 150)))
        texts.append(t + (f"\nShared LINE  \n{passage} {i}" if i % 3 == 0 else "\nshared line"))
    texts += [texts[10], texts[10], texts[12].replace("a", "b", 1), "same " * 300, "x" * 900, texts[20] + " end."]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "b", 1, "f", "n") for i, t in enumerate(texts)]
    return rows + [rows[15], rows[15], (None, "no id here", "en", "s0", 0, "b", 1, "f", "n")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_empty_tables(empty):
    assert fingerprint.fingerprints(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert surrogates.replace(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert lm.fit_and_score(empty).count() == 0
    assert quality.judge(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert token_files.round_trip(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_fingerprints(docs, rows):
    out = fingerprint.fingerprints(docs).collect()
    assert len(out) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    single = {r[0]: r for r in order}
    got = {r.doc_id: r for r in out}
    for a, b in zip(order, [*order[1:], (None, "no id here")], strict=True):
        if a[0] == b[0]:
            continue
        t, nxt = a[1] or "", b[1] or ""
        want = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        mine = [r for r in out if r.doc_id == a[0]]
        assert hashlib.sha256(want.encode()).hexdigest() in {r.edited_sha256 for r in mine}
    same = {i for i, r in single.items() if r[1] == rows[10][1]}
    assert len({got[i].fingerprint for i in same}) == 1 and all(0 <= r.near_next <= 1 for r in out)


def test_prefix_spans():
    a, b = fingerprint.Prefix("xxhello world"), fingerprint.Prefix("hello worms")
    assert a.span_equal(2, b, 0, 9) and not a.span_equal(2, b, 0, 10)
    assert a.extension(2, b, 0) == 9 and a.extension_back(13, b, 11) == 0 and a.extension_back(8, b, 6) == 6


def test_packing(docs, rows):
    enc = Encoder(packing.TOKENIZER)
    out = packing.pack(docs, group=16).collect()
    n = collections.Counter()
    for r in out:
        n[r.sequence_id] += r.length
    assert max(n.values()) <= packing.SIZE
    assert sum(n.values()) == sum(len(enc.encode_all([r[1] or ""])[0]) + 1 for r in rows)
    by = {r[0]: np.append(enc.encode_all([r[1] or ""])[0], 1).astype("<u4") for r in rows}
    assert all(zlib.crc32(by[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in out)
    assert packing.cuts(2048 * 2 + 700) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 188)]


@pytest.mark.parametrize("name", [packing.TOKENIZER, token_files.TOKENIZER])
def test_encoder_equals_tokenizer(name):
    enc = Encoder(name)
    odd = ["a  b", " x", "\n y z ", "é à\n\nb c", "a<|endoftext|> b", "<|ENDOFTEXT|> A", "MIßT ÀÉ µ ÿ", "Ab.\nCd, ef\nÉa", "it's John's 12 3", "a\xa0b", "日本 語", "İ i̇", "", "ΑΣ Σ.", "ABC Ünï! Ÿ", "don't... (ok) a_b c__ d-- e-f", "ab<|cd", "a\u0085b c", "1,000. 2;", "naïve, Straße!!! STRASSE***"]
    for t, ids in zip(odd, enc.encode_all(odd), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_mixing(docs, rows):
    out = mixing.mix(docs, budget=3.0).collect()
    n = collections.Counter(r.doc_id for r in out)
    rate = {r.source: r.rate for r in mixing.rates(docs, budget=3.0).collect()}
    for r in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:n:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        lam, k, p = rate[r[3]], 0, np.exp(-rate[r[3]])
        cdf = p
        while cdf <= u:
            k += 1
            p *= lam / k
            cdf += p
        assert n[r[0]] == k * sum(x[0] == r[0] for x in rows)
    assert mixing.apply(docs).columns == docs.columns


@pytest.mark.parametrize("bucket", [suffix_dedup.BUCKET, 2])
def test_suffix_dedup(docs, rows, bucket):
    data = [(r[1] or "").encode() for r in rows]
    n = collections.Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = collections.Counter()
    for r, x in zip(rows, data, strict=True):
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if n[x[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        want[(r[0], len(x), np.frombuffer(x, np.uint8)[~gone].tobytes())] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(docs, bucket=bucket).collect())
    assert got == want


def test_language_model(docs, rows):
    out = lm.fit_and_score(docs).collect()
    kept = [r for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10]
    c = collections.Counter(w for r in kept for w in [*words(r[1]), None])
    total = sum(c.values())
    base = {r[0]: sum(np.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in [*words(r[1]), None]) for r in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r.base_score == pytest.approx(base[r.doc_id]) and r.train_tokens == total and r.score < 0
    table = lm.log_table((np.ones((lm.K, 2), np.float32), np.eye(2, dtype=np.float32), np.ones((lm.K, 2), np.float32), np.zeros(lm.K, np.float32)))
    assert np.allclose((10.0 ** table[:5]).sum(1), 1, atol=1e-3)


def test_quality(docs, rows):
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert out[0].n_words == 0 and out[0].base_failed and not out[0].kept
    for r in rows:
        w, seen, dup = words(r[1]), set(), 0
        for line in (r[1] or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        g = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        if (r[1] or "").lower() == (r[1] or ""):
            assert out[r[0]].n_repeat_words == len({i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if g[x] > 1 for j in range(3)})
        assert (out[r[0]].n_words, out[r[0]].n_dup_lines) == (len(w), dup)
    assert quality.apply(docs).columns == docs.columns


def test_simhash(docs, rows):
    fps = [simhash.simhash((r[1] or "").encode()) for r in rows]
    for r, f in zip(rows, fps, strict=True):
        w = words(r[1])
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert f == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {k: min((r[0] for r, x in zip(rows, root, strict=True) if x == k and r[0] is not None), default=None) for k in root}
    assert collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == collections.Counter((r[0], least[k]) for r, k in zip(rows, root, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x ^ np.uint64(1 << 5), x[:100] ^ np.uint64(3 << 40)]))
    x = x[np.argsort(simhash.gray_rank(x))]
    q, j = simhash.gray_pairs(x, simhash.gray_index(x), x)
    assert {*zip(q.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(len(x)) for b in range(len(x)) if np.bitwise_count(x[a] ^ x[b]) <= 2}


def test_small_buckets_are_dealt_anew(spark):
    rng = random.Random(5)
    codes = {0} | {1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in range(60)} | {rng.getrandbits(63) for _ in range(60)}
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    pairs = [{(r.node, r.root) for r in simhash.components(simhash.link(df, bucket=b)).collect()} for b in (4, 4096)]
    assert pairs[0] == pairs[1]


def test_token_files(docs, rows):
    enc, start, want = Encoder(token_files.TOKENIZER), 0, []
    known = [np.append(enc.encode_all([r[1] or ""])[0], 1).astype("<u4") for r in rows]
    for k in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        want.append((rows[k][0], start, len(known[k]), known[k].tobytes()))
        start += len(known[k])
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.round_trip(docs, block=300).orderBy("start").collect()]
    assert got == want


def test_line_dedup(docs, rows):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate(str.maketrans(common.UPPER, common.LOWER))
    n = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 10]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = collections.Counter((r.doc_id, r["__tm_lines"], r["__tm_dropped"], r["__tm_kept"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == want and any(w[2] for w in want)
    assert line_dedup.apply(docs).columns == docs.columns


def test_mixing_of_great_rates(spark):
    """A tiny source beside a huge one is drawn in parts; the SQL agrees; more sources than are broadcast give the same copies."""
    import duckdb

    from tidemark.llm import queries

    rows = [(i, "x" * 20_000 if i % 2 else "y" * 3_000, "big", 0) for i in range(60)] + [(100 + i, "t", "tiny", 0) for i in range(3)] + [(200, "t", None, 0), (None, "tt", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    flat = lambda rs: sorted((-1 if i is None else i, n, round(k, 12)) for i, n, k in rs)
    got = flat((r.doc_id, r.copy_no, r.mix_key) for r in mixing.mix(docs).collect())
    assert max(r.rate for r in mixing.rates(docs).collect()) > 2 * mixing.PART
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert got == flat(con.execute("SELECT doc_id, copy_no, mix_key FROM (" + queries.OP3_SQL + ")").fetchall())
    before, mixing.BROADCAST_ROWS = mixing.BROADCAST_ROWS, 1
    try:
        assert flat((r.doc_id, r.copy_no, r.mix_key) for r in mixing.mix(docs).collect()) == got
    finally:
        mixing.BROADCAST_ROWS = before


def test_suffix_dedup_of_periodic_text(spark):
    """A hundred thousand equal bytes are a handful of rows, and go whole; so do longer periods."""
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(50))
    texts = ["x" * 100_000, word * 400, "head " + word * 10 + " tail", "own text " * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert suffix_dedup.anchored(docs).count() < 200
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs).collect()}
    assert got == {0: b"", 1: b"", 2: b"head  tail", 3: ("own text " * 3).encode()}
