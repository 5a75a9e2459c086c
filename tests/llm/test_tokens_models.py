"""Encoders, token files, counts and the language model against libraries and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, contexts, pitman_yor, token_counts, tokenbin

PIECES = ["<|endoftext|>", "<|endof", "text|>", "'re", "'ll", "'", " ", "   ", "\n\n", "the", "zzzz", "ab" * 30, "é", "中文", "1234", "!!!", "՘x", "\x1c", " ", " hello", "İ", "ǅ", "­"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def random_texts(n, seed, top=60):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, top))) for _ in range(n))]


@pytest.fixture(scope="module")
def merges():
    return bpe.merges_of(public_tokenizers.path(bpe.TOKENIZER))


def test_encoder_is_the_library(merges):
    lib, rng = library(bpe.TOKENIZER), random.Random(1)
    for x in random_texts(1200, 3):
        want = lib.encode(x, add_special_tokens=False).ids
        got = [k for p in bpe.encode_pieces(bpe.TextEncoder(merges), x, piece=rng.choice([1, 2, 3, 5, 8, 1000])) for k in p]
        assert got == want, repr(x)
        decoder = bpe.TextDecoder(merges)
        assert "".join([*(decoder.feed([k]) for k in got), decoder.finish()]) == lib.decode(want, skip_special_tokens=False)


def test_long_runs_stream(merges, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 256)
    lib, rng = library(bpe.TOKENIZER), random.Random(2)
    for x in ("a" * 30000, " " * 20000 + "x", "".join(rng.choice("etaoin") for _ in range(40000)), "\n" * 3000 + "a" * 3000 + "1" * 3000 + "!" * 3000 + "中" * 3000):
        assert [k for p in bpe.encode_pieces(bpe.TextEncoder(merges), x, piece=256) for k in p] == lib.encode(x, add_special_tokens=False).ids


def test_lookahead_settles_tokens(merges):
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("abcdehimnorst") for _ in range(merges.lookahead + 80)).encode()
        cut = len(word) - rng.randint(1, 40)
        settled = cut - merges.lookahead
        ends = lambda ids: set(np.cumsum([len(merges.token_bytes[k]) for k in ids]).tolist())
        assert {e for e in ends(merges.merge(word)) if e <= settled} == {e for e in ends(merges.merge(word[:cut])) if e <= settled}


def test_every_text_takes_the_transducer(merges, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 64)
    encoder, lib, fed = bpe.TextEncoder(merges), library(bpe.TOKENIZER), []
    feed = encoder.feed
    monkeypatch.setattr(encoder, "feed", lambda x: fed.append(x) or feed(x))
    for x in ["short words", "b" * 5000, *random_texts(200, 9)]:
        fed.clear()
        assert bpe.digest(encoder, x)[0] == len(lib.encode(x, add_special_tokens=False).ids)
        assert "".join(fed) == x and all(len(p) <= 64 for p in fed)
    stream = encoder.stream
    assert set(stream.memo) and stream.fed >= len(stream.memo)
    small = bpe.WordStream(merges, bpe.Memo(2000))
    for k in range(500):
        small.words([f"w{k}"], [])
        assert small.memo.used <= 2000
    assert bpe.sufficient_lookahead([]) == 0


def test_digests(spark, merges):
    rows = [(k, t, "clash") for k, t in enumerate([None, "a long text, " * 40_000, "x" * 100_000, *random_texts(40, 5)])]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = library(bpe.TOKENIZER)
    got = {r.doc_id: r for r in bpe.digests(df).collect()}
    ids_of = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    for k, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert ids_of[k] == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], df.schema)).count() == 0


def test_word_encoder_is_the_library():
    lib, own = library(tokenbin.TOKENIZER), tokenbin.encoder_of(public_tokenizers.path(tokenbin.TOKENIZER))
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x20, 0x180)] + list("'''sSrRtT\n\t  ") + PIECES
    for x in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2500)]:
        assert np.frombuffer(own.encode(x), own.kind).tolist() == lib.encode(x, add_special_tokens=False).ids, repr(x)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "FILE_ROWS", 20)
    rows = [(k * 7 % 101, t) for k, t in enumerate(random_texts(100, 6))] + [(None, "null key"), (3, None), (4, "very long " * 30_000)]
    rows += [(50, f"one key of many rows {k % 40}") for k in range(90)]  # equal keys fill several files
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int").repartition(3)
    path = tokenbin.new_path(spark, "tokens-test")
    files = tokenbin.write_tokens(df, path)
    got = tokenbin.read_tokens(spark, path, files, with_ids=True).collect()
    lib = library(tokenbin.TOKENIZER)
    want = collections.Counter((k, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in rows)
    assert collections.Counter((r.key, tuple(r.ids)) for r in got) == want and len(files) > 2
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.key for r in ordered] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    at = 0
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    with pytest.raises(ValueError, match="dictionary"):
        tokenbin.TokenFile(f"{path}/{files[0][0]}", b"another")
    assert tokenbin.read_tokens(spark, path, tokenbin.write_tokens(df.limit(0), tokenbin.new_path(spark, "tokens-test"))).count() == 0


def test_edits(merges, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    monkeypatch.setattr(token_counts, "REACH", 8)
    count, rng = token_counts.Counter(merges), random.Random(2)
    encoder = bpe.TextEncoder(merges)
    full = lambda t: sum(len(p) for p in bpe.encode_pieces(encoder, t))
    for t in random_texts(300, 8):
        tree = token_counts.CountTree(t, count)
        for _ in range(5):
            a = rng.randint(-1, len(t) + 2)
            b, new = a + rng.choice([0, 0, 1, 3, 10]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 3)))
            low = max(0, min(a, len(t)))
            t = t[:low] + new + t[max(low, min(b, len(t))) :]
            tree.edit(a, b, new)
            assert tree.text == t and tree.total == full(t)


def test_edits_are_local(merges):
    tree = token_counts.CountTree("some words in a row, " * 5000, token_counts.Counter(merges))
    tree.edit(50_000, 50_005, "other")
    assert tree.encoded < 400 < tree.pretokens


def test_counts(spark, merges):
    """The query's columns against the library on whole texts before and after the edits."""
    lib = library(bpe.TOKENIZER)
    texts = [None, "", "hello world", "hello world", "a long text, with words " * 20_000, *random_texts(30, 12)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "no key", "x"), (3, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")

    def after(t, k):
        for start, end, new in token_counts.sample_edits(t, k):
            start = max(0, min(start, len(t)))
            t = t[:start] + new + t[max(start, min(end, len(t))) :]
        return t

    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = collections.Counter((k, n(t or ""), n(after(t or "", k or 0))) for k, t, _ in rows)
    got = token_counts.counted(df.repartition(2)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == want
    assert all(r.n_reencoded < 2000 for r in got) and max(r.n_pretokens for r in got) > 90_000  # edits are local, trees are loaded
    assert token_counts.counted(spark.createDataFrame([], df.schema)).count() == 0


def test_stored_trees(merges):
    count, text = token_counts.Counter(merges), "some words in a row, " * 300
    tree = token_counts.CountTree(text, count)
    again = token_counts.CountTree.load(text, tree.stored(), count)
    assert (again.total, again.pretokens) == (tree.total, tree.pretokens)
    assert all((a == b).all() for a, b in zip(again.blocks, tree.blocks, strict=True))
    again.edit(5, 9, "x")
    tree.edit(5, 9, "x")
    assert again.total == tree.total and 0 < again.encoded < 200
    with pytest.raises(ValueError, match="belong"):
        token_counts.CountTree.load(text + "x", tree.stored(), count)


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"than", b"a", pitman_yor.END] * 3
    triples, starts = pitman_yor.spell(words)
    keys, n = np.unique(triples, return_counts=True)
    model = pitman_yor.Spelling(keys, n)
    for sweep in range(4):
        model.sweep(sweep)
        assert all((t >= 1).all() and (t <= c).all() for c, t in zip(model.c, model.t))
    table = model.table()
    for context in (0x2020, 0x2074, 0x7468, 0x0000):
        assert table.p((context << 8) + np.arange(256)).sum() == pytest.approx(1.0, abs=1e-5)
    assert len(starts) == len(words) and triples[starts[1]] >> 8 == 0x2020
    one = [pitman_yor.spelled([t], words) for t in (table, model.table())]
    assert pitman_yor.spelled([table, model.table()], words) == pytest.approx((one[0] + one[1]) / 2)


@pytest.mark.parametrize("customers", [2, 6, 40])
def test_table_counts_follow_their_distribution(customers):
    n, d, p0 = 6000, 0.5, 0.05
    t = pitman_yor.sample_tables(np.full(n, customers), np.full(n, 10), np.full(n, p0), d, pitman_yor.mix(np.arange(n, dtype=np.uint64)), 3)
    s, weight = pitman_yor.log_stirling(d)[customers], []
    for k in range(1, customers + 1):
        weight.append(math.exp(s[k]) * math.prod(pitman_yor.STRENGTH + d * (10 + j) for j in range(k)) * p0**k)
    want = np.array(weight) / sum(weight)
    assert np.abs(np.bincount(t, minlength=customers + 1)[1:] / n - want).max() < 0.03
    many = pitman_yor.sample_tables(np.full(50, 5000), np.full(50, 10), np.full(50, p0), d, np.arange(50, dtype=np.uint64), 0)
    assert (many >= 1).all() and (many < 5000).all()


def brute_predictions(rows, p1, t3, t2, d2, d3):
    """P(w | u2, u1) of each row by dictionaries over (u1, u2, w) customers and given tables."""
    c3, c2 = collections.Counter(), collections.Counter()
    n3, s3, n2, s2 = (collections.Counter() for _ in range(4))
    for (u1, u2, w, c), t in zip(rows, t3):
        c3[u1, u2, w] += c
        n3[u1, u2] += c
        s3[u1, u2] += t
        c2[u1, w] += t
        n2[u1] += t
    for (u1, w), t in t2.items():
        s2[u1] += t
    theta, out = pitman_yor.STRENGTH, []
    for (u1, u2, w, c), t in zip(rows, t3):
        short = (c2[u1, w] - d2 * t2[u1, w] + (theta + d2 * s2[u1]) * p1[w]) / (theta + n2[u1])
        out.append((c - d3 * t + (theta + d3 * s3[u1, u2]) * short) / (theta + n3[u1, u2]))
    return out


def test_context_restaurants():
    rng = random.Random(11)
    seen = collections.Counter((rng.randrange(3), rng.randrange(4), rng.randrange(6)) for _ in range(400))
    rows = [(a, b, w, seen[a, b, w]) for a in range(3) for b in range(5) for w in range(6)]  # context 4 is never seen
    p1 = np.array([0.3, 0.25, 0.2, 0.15, 0.06, 0.04])
    a, b, w, c = (np.array(x) for x in zip(*rows))
    as_code = lambda x: x.astype(np.uint64)
    rooms = contexts.Rooms(pitman_yor.mix(as_code(a)), as_code(b), as_code(w), c, p1[w])
    for sweep in range(5):
        got = rooms.predict(0.4, 0.6)
        short = {(a[k], w[k]): int(rooms.t2[rooms.up[k]]) for k in range(len(rows))}
        assert got == pytest.approx(brute_predictions(rows, p1, rooms.t3.tolist(), short, 0.4, 0.6))
        assert np.bincount(a * 5 + b, got) == pytest.approx(np.ones(15))  # each context has a distribution
        assert (rooms.t3 <= rooms.c).all() and ((rooms.t3 > 0) == (rooms.c > 0)).all()
        assert (rooms.t2 <= rooms.c2).all() and ((rooms.t2 > 0) == (rooms.c2 > 0)).all()
        rooms.sweep(0.4, 0.6, sweep)
    assert np.bincount(a * 5 + b, rooms.averaged(0.4, 0.6)) == pytest.approx(np.ones(15))


def test_scores(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["w" + "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    new = lambda: "".join(rng.choice("ghijkl") for _ in range(6))
    draw = lambda: new() if rng.random() < 0.12 else vocabulary[min(299, int(rng.expovariate(0.02)))]
    rows = [(k, " ".join(draw() for _ in range(rng.randint(0, 40)))) for k in range(150)]
    rows += [(900, None), (901, " \n"), (902, "Never Seen Before"), (903, "THE É x"), (None, "a null key"), (5, rows[5][1]), (904, "very long " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string")
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mine_of = [(k, [*word.findall((t or "").translate(low)), None]) for k, t in rows]
    held = {k: zlib.crc32(("null" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    counts = collections.Counter(w for k, v in mine_of if not held[k] for w in v)
    n, v = sum(counts.values()), len(counts)
    results = []
    for head, chunk, part, split in ((1 << 19, 1 << 20, 1 << 21, 2), (1 << 19, 300, 5000, 5), (20, 300, 5000, 3)):
        monkeypatch.setattr(pitman_yor, "HEAD_WORDS", head)
        monkeypatch.setattr(contexts, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(contexts, "PART_TOKENS", part)
        got = contexts.score(df.repartition(split)).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = dict(mine_of)[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(mine), sum(counts[w] > 0 for w in mine), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine))
        results.append({r.doc_id: r for r in got})
    assert all(results[0][k].score == pytest.approx(results[1][k].score, rel=1e-5) for k in held)  # whatever the parts
    assert all(results[0][k].score == pytest.approx(results[2][k].score, rel=0.1) for k in held)  # other codes, other draws
    for side in (True, False):
        of = [r for r in results[0].values() if r.held_out == side and r.doc_id != 904]
        assert sum(r.score for r in of) > sum(r.base_score for r in of)


def test_word_order_and_copies_matter(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(30)) for _ in range(140)]
    train = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 != 2]
    rows = [(train[k], t) for k, t in enumerate(texts + texts[:40])]
    out = next(k for k in range(5000, 6000) if zlib.crc32(str(k).encode()) % 7 == 2)
    out2 = next(k for k in range(out + 1, 6000) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows += [(out, texts[50]), (out2, " ".join(reversed(texts[50].split())))]
    monkeypatch.setattr(contexts, "ROOM", 500)  # frequent words have several restaurants
    got = {r.doc_id: r.score for r in contexts.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[out] > got[out2] + 5
    twice, once = [got[train[k]] for k in range(40)], [got[train[k]] for k in range(40, 140)]
    assert min(twice) > max(once)  # documents that occur twice stand apart


def test_scores_do_not_depend_on_frequent_words(spark, monkeypatch):
    """A word before has one restaurant, however many parts seat it."""
    rng = random.Random(5)
    vocabulary = [rng.choice("abcdefghijklm") + rng.choice("aeiou") for _ in range(60)]
    rows = [(k, " ".join(vocabulary[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 60)))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for head in (1 << 19, 25):  # words after frequent ones inside and outside the head
        monkeypatch.setattr(pitman_yor, "HEAD_WORDS", head)
        found = []
        for room, part in ((1 << 19, 1 << 20), (300, 1 << 20), (20, 700)):
            splits = lambda head, room=room: (-(-head.n[head.n > room] // room)).astype(np.uint64)
            monkeypatch.setattr(contexts, "splits_of", splits)  # reaches workers as well, which a changed ROOM does not
            monkeypatch.setattr(contexts, "PART_TOKENS", part)
            found.append({r.doc_id: r.score for r in contexts.score(df).collect()})
        assert found[1] == pytest.approx(found[0], rel=1e-5)
        assert found[2] == pytest.approx(found[0], rel=1e-5)


def test_tokens_of_texts():
    rng = random.Random(5)
    signs = "aBcÉİß日 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2028\0 "
    texts = pa.array([None, "", " \n", "x", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000))])
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for some in (texts, texts.slice(1, 2), texts.slice(700, 900), texts[:0]):
        ids, words, sizes = pitman_yor.tokens(some)
        want = [[*(w.encode() for w in word.findall((t or "").translate(low))), pitman_yor.END] for t in some.to_pylist()]
        assert words.take(pa.array(ids)).to_pylist() == [w for t in want for w in t]
        assert sizes.tolist() == [len(t) for t in want]


def test_scores_without_a_head(spark, monkeypatch):
    """All words are looked up in the join where no words fit the head."""
    df = spark.createDataFrame([(k, "one two three " * k) for k in range(12)], "doc_id long, text string")
    want = {r.doc_id: r for r in contexts.score(df).collect()}
    monkeypatch.setattr(pitman_yor, "HEAD_WORDS", 0)
    got = contexts.score(df).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(want[r.doc_id].n_known, want[r.doc_id].train_tokens) for r in got]
    assert [r.base_score for r in got] == pytest.approx([want[r.doc_id].base_score for r in got])
    assert len(got) == 12


def test_scores_without_training_rows(spark):
    got = contexts.score(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns[0] == "doc_id"
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = contexts.score(spark.createDataFrame([(out, "never trained")], "doc_id long, text string")).first()
    assert only.n_known == 0 and only.train_tokens == 0 and only.score < -20 and only.base_score == 0
