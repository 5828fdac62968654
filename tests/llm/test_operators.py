"""The corpus operators against plain versions, on small fixtures with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tracewell.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, quality, secret_scan, sharding, simhash, token_files
from tracewell.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, bucket int"


def sentence(rng, n, words=("the", "cat", "sat", "on", "mats", "über", "straße", "élan", "x9", "green", "hill", "rain", "fell", "slowly", "home")):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1):
    """Rows with nulls in every column, empty, blank and long texts, copies, near copies, repeats, special signs."""
    rng = random.Random(seed)
    texts = [None, "", "   ", "\n\n", "a", "!!!", "12 34", "naïve — café…", "x" * 5000, "don't STOP'll", "<|endoftext|> mid <|startoftext|>", "Σας ΟΔΟΣ", "tab\there", "tab here", "tab \n here"]
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += base + base[:10] + [b.replace(" ", "  ", 3) for b in base[:6]] + [base[0]] * 25
    texts += ["\n".join(sentence(rng, 14) for _ in range(6)) for _ in range(10)]
    shared = sentence(rng, 30)
    texts += [f"{sentence(rng, 9)}\n{shared} {w}\n{sentence(rng, 8)}" for w in ("one", "two", "one", "three")]
    texts += [sentence(rng, 3000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if i % 7 == 0 else 1, "clash", 3) for i, t in enumerate(texts)]
    return rows + [(None, "no id", None, None, None, None, None)] + [rows[20], rows[20]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(it):
    return collections.Counter(map(tuple, it))


# secrets ------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_automaton():
    a = secret_scan.compile_rules()
    assert a.states < a.full_states
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", " ", ":", "=", '"', "'", "abc", "abcdef12", "AKIA", "0123456789abcdef", "ABCDEFGH12345678", "é", "ſecret", "f" * 13, "\n", "-----BEGIN RSA PRIVATE KEY-----"]
    for _ in range(4000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted((s, k, e) for k, s, e in secret_scan.find_spans(a, x) if k < 3) == plain_spans(x), x
    long = "z" * 5000 + " token=abcdefgh " + "q" * 3000
    assert secret_scan.find_spans(a, long) == [(0, 5001, 5015)]
    assert [k for k, _, _ in secret_scan.find_spans(a, "x -----BEGIN RSA PRIVATE KEY----- y")] == [3]


def test_secret_report(spark, none):
    texts = [None, "", "é token=abcdefgh", "AKIA" + "A1" * 9 + " and " + "0a" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_report(df).collect()}
    assert got[2].spans == "assign:2:16" and (got[2].n_assign, got[2].n_access, got[2].n_hex) == (1, 0, 0)
    assert got[3].spans == "access:0:22,hex:27:51" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest() == got[1].base_sha256
    assert got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    assert secret_scan.secret_report(none).count() == 0
    assert {r.text for r in secret_scan.redact(df).collect()} == {None, "", "é [secret]", "[secret] and [secret]"}


# near copies --------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps):
    """The smallest id reachable over links, for a list of (id, fingerprint)."""
    group = list(range(len(fps)))
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(fps, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [least.get(g) for g in group]


def test_simhash(docs, rows, none):
    got = multiset((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_report(docs).collect())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert got == multiset((d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps), strict=True))
    assert simhash.near_report(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(3)
    diffs = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 5, 5000)], np.uint64)
    assert simhash.pigeonring(diffs, 4).all()
    far = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert simhash.pigeonring(far, 4).mean() < 0.01


def test_dense_and_large_buckets(spark, monkeypatch):
    """A bucket beyond the block size is cut into blocks and loses no link."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    seed = rng.getrandbits(63)
    fps = {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = plain_components(list(enumerate(fps)))
    got = collections.defaultdict(set)
    for f, c in zip(signed, want, strict=True):
        got[c].add(roots.get(f, f))
    assert all(len(s) == 1 for s in got.values()) and len({next(iter(s)) for s in got.values()}) == len(got)


# token files --------------------------------------------------------------------------------


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for high in (1, 2, 10, 60, 5000, 50_000, 2**33, 2**62):
        sizes = rng.integers(0, 150, 7).tolist()
        ids = rng.integers(0, high, sum(sizes)).astype(np.uint64)
        ids[rng.random(len(ids)) < 0.05] = 2**61 + 9
        words, escapes, first, _ = token_files.pack(ids, sizes)
        assert (token_files.unpack(words, escapes) == ids).all() and len(first) == len(sizes)
    zeros = np.zeros(480, np.uint64)
    assert len(token_files.pack(zeros, [480])[0]) == 2


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(tokenizer_path())
    return library.t.encode(text or "", add_special_tokens=False).ids


def test_token_files(docs, rows, none, tmp_path):
    got = [tuple(r) for r in token_files.token_file_report(docs, tokenizer_path(), 2).collect()]
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library(text), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_files.token_file_report(none, tokenizer_path(), 2).count() == 0


# sharding -----------------------------------------------------------------------------------


def test_sharding(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)
    got = sharding.shard_documents(docs).collect()
    assert multiset((r.doc_id, r.size, r.text_crc32) for r in got) == multiset((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    counts = [len(per[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shard_documents(none).count() == 0
    big = spark.createDataFrame([(i, f"s{min(i % 3, 1)}") for i in range(3000)], "doc_id long, source string")
    mixed = collections.Counter((r.shard, r.source) for r in sharding.interleave(big, 10).collect())
    assert all(abs(mixed[k, "s1"] - 200) <= 2 and abs(mixed[k, "s0"] - 100) <= 2 for k in range(10))


# quality, language --------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark, none):
    rng = random.Random(6)
    good = [sentence(rng, rng.randint(20, 200)).capitalize() + "." for _ in range(250)]
    bad = ["*** ".join(sentence(rng, rng.randint(20, 200)).split(" ")) + "!!" for _ in range(120)]
    texts = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (1002, "x " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 250)) for i in range(370)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    assert len(got) == 373 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 370]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert sum(r.predicted == int(r.doc_id < 250) for r in held) >= 0.97 * len(held)
    assert quality.quality_report(none, labels).count() == 0
    assert {r.score for r in quality.quality_report(docs, labels.where("false")).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(5)
    bags = [rng.random((n, quality.FEATURES)) for n in (1, 3, 2)]
    x, starts, labels = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.MilModel.fresh(x)
    loss = lambda: -np.mean(np.log(np.where(labels == 1, y := model.forward(x, starts)["y"], 1 - y)))
    grads = model.gradients(model.forward(x, starts), starts, labels)
    for k, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        model.p[k][at] += 1e-5
        up = loss()
        model.p[k][at] -= 2e-5
        down = loss()
        model.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, k


def test_language(spark, none):
    rng = random.Random(7)
    vocab = {"en": ["the", "water", "which", "through", "house"], "de": ["der", "über", "straße", "nicht", "häuser"], "fr": ["le", "été", "où", "garçon", "château"]}
    rows = [(i, sentence(rng, 12, vocab[k]), k) for i, k in enumerate(["en", "de", "fr"] * 120)] + [(900, None, "en"), (901, "12 !!", "en"), (902, "", None), (903, "the water", None)]
    got = {r.doc_id: r for r in language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    held = [r for r in rows[:360] if got[r[0]].held_out]
    assert held and all(got[i].lang_pred == k for i, _, k in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert language_id.language_report(none).count() == 0
    plain = sum(float(x) for x in [got[903].score])
    assert 0.5 <= plain <= 1


# lines, exact copies ------------------------------------------------------------------------


def plain_lines(rows):
    docs = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        docs[doc_id].append(text)
    lines = []
    for doc_id, texts in docs.items():
        for t in texts:
            low = None if t is None else re.sub("[\t\r\x0b\x0c]", " ", t.lower())
            lines += [(doc_id, n, tuple(w for w in x.split(" ") if w)) for n, x in enumerate(low.split("\n"))] if low is not None else [(doc_id, None, ())]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    first = {}
    for x in sorted((x for x in lines if x[2]), key=order):
        first.setdefault(x[2], x)
    tokens = {w: {w[i : i + 5] for i in range(len(w) - 4)} or {w} for w in first}
    links = collections.Counter()
    lost = set()
    ws = list(first)
    for i, a in enumerate(ws):
        for b in ws[:i]:
            common = len(tokens[a] & tokens[b])
            if common * 10 >= 8 * (len(tokens[a]) + len(tokens[b]) - common):
                links[a] += 1
                links[b] += 1
                lost.add(a if order(first[a]) > order(first[b]) else b)
    out = {}
    for d in docs:
        own = [x for x in lines if x[0] == d]
        gone = sorted(x[1] for x in own if x[2] and (first[x[2]][:2] != x[:2] or x[2] in lost))
        out[d] = (sum(x[1] is not None for x in own), len(gone), sum(links[x[2]] for x in own if x[2]), ",".join(map(str, gone)))
    return out


def test_line_dedup(docs, rows, none, spark):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.removed) for r in line_dedup.line_report(docs).collect()}
    want = plain_lines(rows)
    assert got == want and sum(v[2] for v in want.values()) > 0
    assert line_dedup.line_report(none).count() == 0
    small = spark.createDataFrame([(1, "a b c d e f\nkeep"), (2, "A b  c d e f\nnew"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(small).collect()} == {1: "a b c d e f\nkeep", 2: "new", 3: None}


def test_exact_dedup(docs, rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = multiset((r[0], k := min((x for x in groups[norm(r[1])] if x is not None), default=None), len(groups[norm(r[1])]), r[0] == k, hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    for bits in (64, 2):  # two bits: nearly every chain holds different texts
        assert multiset((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, bits).collect()) == want
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.select("doc_id", "text").distinct().count() == len(groups)


def test_directory():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, 256)
    counts[17] = 500
    d = exact_dedup.Directory.grow(counts, 40)
    assert len(d.bucket) == 1 << d.depth and d.entries.sum() == counts.sum() and (np.diff(d.bucket) >= 0).all()
    size = np.bincount(np.repeat(d.bucket, 256 >> d.depth), counts, len(d.entries))
    assert (size == d.entries).all() and sorted(size)[-2] <= 40
    assert (np.diff(d.owners(7)) >= 0).all() and d.owners(7).max() < 7


# BPE, benchmark -----------------------------------------------------------------------------


def test_bpe(docs, rows, none):
    path = tokenizer_path()
    library("")
    want = multiset((r[0], len(i := library(r[1])), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in rows)
    encoded = bpe.encode_documents(docs, path)
    assert multiset(map(tuple, bpe.token_digests(encoded, path).collect())) == want
    assert multiset(map(tuple, bpe.round_trip_digests(docs, path).collect())) == want
    assert bpe.encode_documents(none, path).count() == 0 == bpe.round_trip_digests(none, path).count()
    spaced = {r.doc_id: r.text for r in bpe.decode_documents(encoded, path, spaced=True).collect()}
    assert all(spaced[r[0]] == library.t.decode(library(r[1]), skip_special_tokens=False) for r in rows)


def test_transducer_streams():
    """Long pieces, fed in any portions, give the library's ids from a buffer of fixed size."""
    b = bpe.Bpe(tokenizer_path())
    rng = random.Random(9)
    for letters in ("ab", "aeth", "thin", "a"):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(2000, 4000))).encode()
        one, out, at, most = bpe.PieceTransducer(b.merges, b.sizes), [], 0, 0
        while at < len(word):
            n = rng.randint(1, 300)
            out += one.feed(word[at : at + n])
            most = max(most, len(one.held))
            at += n
        out += one.finish()
        assert out == library(word.decode()) and most <= one.window + bpe.STRIDE


def test_utf8_machine():
    rng = random.Random(10)
    for _ in range(300):
        data = b"".join(rng.choice([b"a", "é".encode(), "日".encode(), "🎉".encode(), b"\x80", b"\xe2\x82", b"\xed\xa0\x80", b"\xf5"]) for _ in range(8))
        m, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            n = rng.randint(1, 4)
            out += m.feed(data[at : at + n])
            at += n
        assert out + m.finish() == data.decode("utf-8", "replace")


def plain_contamination(text, items, window=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws = fold(text)
    hit, found = set(), set()
    for item, t in items:
        iw = fold(t)
        m = min(window, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1 if m else 0):
            if tuple(ws[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("table_bytes", [32 << 20, 200])
def test_decontamination(spark, docs, rows, none, monkeypatch, table_bytes):
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", table_bytes)
    items = [("1", rows[20][1]), ("2", "The CAT, sat"), ("3", "straße"), ("10", rows[-4][1][50:400]), ("5", None), ("6", "??"), ("7", " ".join(rows[30][1].split()[:11]))]
    items += [(None, "cat")]  # hits as any other item does
    bench = spark.createDataFrame([(k and int(k), t) for k, t in items], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination_report(docs, bench).collect()}
    assert got == {r[0]: plain_contamination(r[1], items) for r in rows} and len(got) > 50
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not got[r[0]][4] for r in rows)
    assert decontaminate.contamination_report(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_report(docs, bench.where("false")).collect())
