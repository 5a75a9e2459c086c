"""Quality, decontamination, Jaccard join and secrets against brute force."""

import collections
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, jaccard, quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {p for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return (
        len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)),
        sum(w in set(quality.STOP_WORDS) for w in words), len(covered),
    )


def texts(n=300, seed=1):
    rng = random.Random(seed)
    pieces = ["the", "of", "and", "a#b", "é", " x", "word", "\n", "\n\n", "\t", " ", "  ", "$$$", "\x0b", "zz zz zz", "the of and", "\x1c"]
    return [None, "", " \n\t", "a", "a b", "a b c a b c", "x " * 60, *("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 90))) for _ in range(n))]


def test_quality(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, m int")
    got = {r.doc_id: r.m for r in df.select("doc_id", quality.measures(F.col("text")).alias("m")).collect()}
    for k, t in rows:
        assert tuple(got[k]) == brute_measures(t), repr(t)
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} < {k for k, _ in rows}
    assert quality.filter_documents(spark.createDataFrame([], df.schema)).count() == 0


def test_quality_oracle(spark):
    documents = spark.createDataFrame(list(enumerate(texts(80))), "doc_id long, text string").toPandas()  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(quality.ORACLE).fetchall()}
    m = quality.measures(F.col("text")).alias("m")
    df = spark.createDataFrame(documents).select("doc_id", m)
    got = df.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", quality.base_failed(F.col("m")), quality.kept(F.col("m")))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def brute_links(rows, words=3, percent=90):
    sets = {}
    for key, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[key] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(60)) for _ in range(5)]
    rows = []
    for k in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(30))
        odd = rng.choice(["", None, "a", "a b", "A  b", "a b c", " \t"])
        rows.append((k * 3 + 1, " ".join(w[: rng.randint(55, 60)]) if rng.random() < 0.9 else odd))
    return rows


@pytest.mark.parametrize("buckets", [jaccard.BUCKETS, jaccard.CHUNK])
def test_jaccard(spark, monkeypatch, buckets):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 16 * 32)
    monkeypatch.setattr(jaccard, "LEAST_WEIGHT", 32)
    if buckets != jaccard.BUCKETS:  # nearly all shingles are common: their chains are built in parts
        monkeypatch.setattr(jaccard, "BUCKETS", buckets)
        monkeypatch.setattr(jaccard, "FULL", 2)
        monkeypatch.setattr(jaccard, "SALTS", 3)
    rows = near_copies(260, 4)
    df = spark.createDataFrame([(k, t, 0, "p") for k, t in rows] + [(None, rows[0][1], 0, "p"), (None, "only here at all", 0, "p")], "doc_id long, text string, n int, prefix string")
    got = jaccard.near_duplicates(df.repartition(3)).collect()
    want = brute_links(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(["None", str(want[rows[0][0]][1])])
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(c) for c in {c for _, c in want.values()}), "None"])
    assert jaccard.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0


def test_families_hold_candidates_only(spark, monkeypatch):
    """Texts that share a line, but too little for a link, were one family, whose sets met in all pairs of blocks."""
    rng = random.Random(8)
    line = " ".join(f"line{k}" for k in range(9))
    texts = [line + " " + " ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] + f" end{k}" for k, t in enumerate(texts[:20])]
    df = spark.createDataFrame(list(enumerate(texts + near)), "id long, text string")
    for full, part in ((255, 2048), (2, 7)):  # all rare; most common, dealt into parts
        monkeypatch.setattr(jaccard, "FULL", full)
        monkeypatch.setattr(jaccard, "PART_CLASSES", part)
        counts = spark.sparkContext.broadcast(jaccard.shingle_counts(df))
        classes = jaccard.signatures(df, counts, 90).withColumn("cid", F.col("id")).cache()
        assert classes.agg(F.max(F.size("common"))).first()[0] > 0 or full == 255
        edges = {(min(r), max(r)) for r in jaccard.family_edges(classes, 90).collect()}
        assert edges == {(k, 60 + k) for k in range(20)}


def test_candidate_forest_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (9, 30, 80, 300)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > drop], rng.integers(0, 2**63, 2).astype(np.uint64)])) for b in base for drop in (0, 0.01, 0.05, 0.3) for _ in range(6)]
    n, sketches = np.array([len(s) for s in sets]), np.stack([jaccard.sketch(s) for s in sets])
    for percent in (80, 90):
        left = rng.random(len(sets)) < 0.5
        edges = jaccard.candidate_forest(np.arange(len(sets)), n, sketches, left, ~left, percent)
        root = list(range(len(sets)))
        for a, b in edges:
            root = [root[a] if r == root[b] else r for r in root]
        linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert len(linked) > 20 and all(root[a] == root[b] for a, b in linked if left[a] != left[b])
        assert len(edges) < len(sets) and len(set(root)) >= 4


def test_keep_one_decides_by_row(spark):
    a, b, c = ("one two three four five six", "completely other words here now", "nothing like the rest of them")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, a, "y"), (None, a, "x"), (None, c, "x"), (None, c, "x"), (3, None, "x"), (3, " ", "x"), (None, None, "x"), (4, b, "z")]
    rows += [(5, "long text " * 60_000, "x"), (6, "long text " * 60_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string").withColumn("row_a", F.lit(1))
    kept = jaccard.keep_one(df.repartition(3))
    got = collections.Counter((r.doc_id, (r.text or "")[:20]) for r in kept.collect())
    assert kept.columns == df.columns
    assert got == collections.Counter([(1, a[:20]), (1, b[:20]), (None, c[:20]), (3, ""), (3, " "), (None, ""), (5, ("long text " * 2)[:20])])


def test_suffix_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert jaccard._suffix_bound(a, b, 3) <= len(np.setxor1d(a, b))


def brute_contained(docs, items, words=5, percent=80):
    out = set()
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for item, it in items:
        w = WORD.findall((it or "").lower())
        if w:
            n = min(words, len(w))
            want = grams(w, n)
            for key, t in docs:
                have = grams(WORD.findall((t or "").lower()), n)
                if 100 * len(want & have) >= percent * len(want):
                    out.add((key, item, len(want), len(want & have)))
    return out


@pytest.mark.parametrize("limit", [0, 500_000])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SENT_ROWS", limit)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for k in range(25)] + [(90, None), (91, " "), (None, "zz yy xx ww vv uu")]
    docs = []
    for k in range(80):
        body = [word() for _ in range(rng.choice([0, 4, 50, 3000]))]
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            if len(part) > 8 and rng.random() < 0.6:
                part[rng.randrange(len(part))] = "CHANGED"
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() for x in part]
        docs.append((k, " ".join(body)))
    docs += [(None, "zz yy xx ww vv uu tt"), (500, None), (500, None)]
    d = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, h string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert {tuple(r) for r in decontaminate.contained_items(d, i).collect()} == want
    clean = decontaminate.clean_documents(d, i)
    assert clean.columns == d.columns
    dirty = {t for k, t in docs for w in want if w[0] == k and t is not None}
    assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(k) for k, t in docs if t not in dirty)
    assert decontaminate.clean_documents(d, spark.createDataFrame([], i.schema)).count() == len(docs)
    assert decontaminate.contained_items(spark.createDataFrame([], d.schema), i).count() == 0


def test_clean_documents_decides_by_text(spark):
    item = "zz yy xx ww vv uu"
    rows = [(None, item + " tt"), (None, "a clean text"), (None, None), (7, item), (7, "another clean text"), (8, "w " * 200_000 + item)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __leak string").withColumn("leak", F.lit(1))
    clean = decontaminate.clean_documents(df, spark.createDataFrame([(1, item), (1, item)], "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted(str(r.text) for r in clean.collect()) == ["None", "a clean text", "another clean text"]


def test_secret_spans(spark):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def brute(x):
        found = [(*m.span(), "assign") for m in assign.finditer(x) if len(m.group(2)) >= 8]
        found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m.group()) >= 16]
        found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m.group()) >= 32]
        return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))

    rng = random.Random(5)
    parts = ["token", "TOKEN", "ſecret", "api_key", "apikey", " = ", ": ", "'", '"', "AKIA", "AKIAAKIA", "ABCDEF0123456789", "deadbeef" * 4, "x", " ", "é", "==", "password", "passwd", ".", "12345678", "0" * 40]
    for _ in range(4000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert sorted(secret_scan.base_spans(x), key=lambda s: (s[0], secret_scan.KINDS.index(s[2]))) == brute(x)
    rows = [(1, "é token = 'abcd1234efgh' end", 30), (2, None, None), (3, "", 0), (4, "key ghp_a8Fk29dLq0ZtX7vB4nM1cR6yW3eS5uJ2 " * 2, 1)]
    rows += [rows[0], (9, "x " * 200_000 + "token = 'abcd1234efgh'", 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_chars long, spans string")
    every = secret_scan.scan(df).collect()
    got = {r.doc_id: r for r in every}
    assert len(every) == len(rows) and got[9].spans == "assign:400000:400021"
    assert got[1].spans == "assign:2:23" and got[2].spans == "" and got[3].n_hex == 0
    clean = {r.doc_id: r for r in secret_scan.redact_documents(df).collect()}
    assert clean[1].text == "é [REDACTED]' end" and clean[1].n_chars == 17 and clean[2].text is None and clean[2].n_chars is None
    assert secret_scan.scan(spark.createDataFrame([], df.schema)).count() == 0


@pytest.mark.parametrize("run", ["a", "aA", "a1", "-", "_", "key", "key:", "key=a ", "pass\"", "secret ", "://a:b", ":", "=", "0", "f", "AKIA", "é", "\n", "token=abcdefgh "])
def test_long_runs_of_secrets_take_linear_time(run):
    text = run * (1_000_000 // len(run)) + " x:y"
    began = time.process_time()
    secret_scan.base_spans(text)
    found = secret_scan.candidates(text)
    assert time.process_time() - began < 5 and all(0 <= s < e <= len(text) for s, e in found)


def test_candidates_are_the_plain_pattern():
    named = re.compile(r"""(?i)[a-z0-9_-]*(?:key|pass|pwd|secret|token|auth|credential)[a-z0-9_-]*["']?\x20*[:=]\x20*["']?([^\x20\x09-\x0D"',;<>(){}]{8,})""")
    rng = random.Random(9)
    parts = ["key", "pass", "PWD", "a", "_", "-", "0", ":", "=", " ", '"', "'", ";", "value123", "é", "secret", "abcdefgh"]
    for _ in range(4000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert list(secret_scan.named_values(x)) == [m.span(1) for m in named.finditer(x)], x
    spans = lambda t: [t[a:b] for a, b in secret_scan.candidates(t)]
    assert spans("Bearer abcdefghijklmnopqrstuvwxyzABCDEFGH") == ["abcdefghijklmnopqrstuvwxyzABCDEFGH"] and spans("pw: hunter22") == ["hunter22"]


def test_added_spans_meet_no_base_span():
    rng = random.Random(3)
    for _ in range(300):
        base = [(s := rng.randint(0, 60), s + rng.randint(1, 9), "hex") for _ in range(rng.randint(0, 6))]
        covered = secret_scan.Covered(base)
        for start in sorted(rng.randint(0, 70) for _ in range(12)):
            end = start + rng.randint(1, 8)
            assert covered.meets(start, end) == any(s < end and start < e for s, e, _ in base)


def test_network_on_unseen_findings():
    net = secret_scan.default_network()
    found = secret_scan.labelled_findings(1200, seed=77)
    p = net.probabilities([f[:3] for f in found])
    hit = [q >= net.threshold for q in p]
    recall = sum(h for h, f in zip(hit, found) if f[3]) / sum(f[3] for f in found)
    precision = sum(f[3] for h, f in zip(hit, found) if h) / max(1, sum(hit))
    assert recall > 0.93 and precision > 0.93
    net_spans = lambda t: [t[a:b] for a, b, k in secret_scan.find_all([t], net)[0] if k == "net"]
    assert net_spans("our key = correcthorsebatterystaple for now") == ["correcthorsebatterystaple"]
    assert net_spans("see postgres://admin:S3cr3tPassw0rd@db.host.com/x") == ["S3cr3tPassw0rd"]
    plain = "The committee met in 2019, and the key point was: nothing changes. Internationalization2020 is a word. Page http://example.com/a-long-path/to/page-2019"
    assert not net_spans(plain)
    long = "x" * 30 + " " + "A1b2C3d4" * 500 + " end"
    assert 0 <= net.probabilities([(long, 31, 31 + 4000)])[0] <= 1


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    stop = "the of and to in a is that for".split()
    clean = lambda: " ".join(rng.choice(stop) if rng.random() < 0.4 else "w" + str(rng.randrange(5000)) for _ in range(90))
    item = " ".join("q" + str(k) for k in range(30))
    base = clean()
    rows = [(k, clean(), "en", "s", None) for k in range(20)]
    rows += [(30, base, "en", "s", 5), (31, base, "en", "s", 5), (40, clean() + " " + item, "en", "s", 5), (50, "junk ### $$$", "en", "s", 5), (60, None, None, None, None)]
    rows += [(70, clean() + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(20)) | {30, 70}
    assert "[REDACTED]" in got[70].text and "04dbebab" not in got[70].text and got[30].text == base
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(4)
    stop = "the of and to in a is that for".split()
    clean = lambda n=90: " ".join(rng.choice(stop) if rng.random() < 0.4 else "w" + str(rng.randrange(5000)) for _ in range(n))
    one, two, three, long = clean(), clean(), clean(), clean(30_000)
    rows = [(1, one, 1, "k"), (1, one, 1, "k"), (1, two, 2, None), (None, three, 3, "s"), (None, three, 3, "s"), (None, None, 4, None), (5, "", 5, None), (6, long, 6, ""), (7, one, 7, "other")]
    schema = "doc_id long, text string, n long, key string"
    write = lambda data, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    for name, data in (("odd", rows), ("none", [])):
        write(data, name)
        spark.createDataFrame([(1, "q r s"), (2, None), (3, "")] if data else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, three), (6, long)], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/odd").columns == docs.columns


def test_pipeline_drops_near_copies(spark, tmp_path):
    def copies(k):
        """A text of 200 words and its copy with one changed run of 12, 14 or 16 words: 0.80 to 0.85 of 5 words, below 0.9 of 3."""
        w = [f"d{k}w{j}" for j in range(200)]
        changed = list(w)
        n = 12 + k % 3 * 2
        changed[90 : 90 + n] = [f"x{k}y{j}" for j in range(n)]
        return " ".join(w), " ".join(changed)

    rows = [(2 * k + side, text) for k in range(9) for side, text in enumerate(copies(k))]
    w = copies(20)[0].split()
    rows += [(100, " ".join(w)), (101, " ".join(w[:80] + [f"z{j}" for j in range(30)] + w[110:]))]  # below 0.8: both stay
    for a, b in zip(rows[:18:2], rows[1:18:2]):
        sets = [{n: {tuple(t.split()[i : i + n]) for i in range(201 - n)} for n in (3, 5)} for _, t in (a, b)]
        five, three = (len(sets[0][n] & sets[1][n]) / len(sets[0][n] | sets[1][n]) for n in (5, 3))
        assert 0.8 <= five <= 0.85 and three < 0.9
    want = {c for _, c in brute_links(rows, 5, 80).values()}
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df.repartition(3), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == want and len(want) < len(rows)
    assert {100, 101} <= want


def test_prefix_shingles_travel_packed(spark, monkeypatch):
    """Every prefix shingle was a row of a shuffle, though most have one class: only packed ranges are sent now."""
    rng = random.Random(12)
    words = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(3000)]
    texts = [" ".join(words[lo : lo + 60]) for lo in range(0, 2400, 40)] + [" "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(jaccard, "RANGE", 100)
    monkeypatch.setattr(jaccard, "PACK", 150)
    counts = spark.sparkContext.broadcast(jaccard.shingle_counts(df, 2))
    classes = jaccard.signatures(df, counts, 50, 2).withColumn("cid", F.col("id")).repartition(3).cache()
    holders = collections.defaultdict(set)
    for r in classes.collect():
        for h in jaccard.lengthened(bytes(r.prefix)).tolist():
            holders[h].add(r.cid)
    met = jaccard.met_shingles(classes, 50)
    got = collections.Counter((r.h, r.cid) for r in met.collect())
    assert got == collections.Counter((h, c) for h, held in holders.items() if len(held) > 1 for c in held)
    assert 0 < len(got) < sum(map(len, holders.values()))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(h" not in plan
    far = jaccard.met_shingles(classes.where("id < 0"), 50)
    assert far.count() == 0


def test_kept_texts_are_not_shuffled(spark, monkeypatch):
    """All texts were shuffled to meet the marks of kept rows; now only rows that share a bit with one that goes."""
    monkeypatch.setattr(jaccard, "FILTER_BITS", 64 * 16)
    rows = near_copies(120, 9)
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("bits", F.lit(2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = jaccard.keep_one(df)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        got = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted({c for _, c in brute_links(rows).values()}) and kept.columns == df.columns
    assert plan.count("LeftOuter") >= 1 and "getbit" in plan.lower()
