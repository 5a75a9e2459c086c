"""Centroids, phrases and personal data against brute force."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import centroids, phrases, sanitise


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


# --- centroids


def brute_clusters(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance) of (vec_id, vector) rows, in Python integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in start[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((square(v, c), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for n, vs in groups.items():
            middle[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, place(v)[1], place(v)[0]) for i, v in kept), key=str), middle


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in rng.standard_normal(64) * spread] for _ in range(n)]


def test_centroids_are_brute_force(spark):
    rows = list(enumerate(vectors(90, 1))) + [(200, None), (201, [1.0] * 63), (202, [None] + [0.0] * 63), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] * 64)]
    rows += [(300 + k, [0.5] * 64) for k in range(40)]  # copies
    df = spark.createDataFrame([(v, k, "x") for k, v in rows], "embedding array<float>, vec_id long, cluster string").repartition(5)
    want, middle = brute_clusters(rows)
    got = centroids.cluster(df).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    inertia = collections.Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_centroids_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [0.0])], kind)).collect() == []
    few = [(None, [2.0] * 64), (7, [1.0] * 64), (7, [1.0] * 64), (7, [3.0] * 64)]
    got = centroids.cluster(spark.createDataFrame(few, kind)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == brute_clusters(few)[0]
    huge = centroids.cluster(spark.createDataFrame([(k, [(-1.0) ** k * 1e300] * 64) for k in range(9)], kind), rounds=2).collect()
    assert {r.distance for r in huge} == {0}
    # all equal: ties go to the smaller number
    same = centroids.cluster(spark.createDataFrame([(k, [0.25] * 64) for k in range(20)], kind)).collect()
    assert {r.cluster for r in same} == {0}


def test_partial_distances_are_whole_ones():
    rng = np.random.default_rng(5)
    for block in (1, 7, 8, 64):
        v, c = rng.integers(-40, 40, (300, 64)), rng.integers(-40, 40, (9, 64))
        c[4] = c[2]
        whole = ((v[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = centroids.nearest(v, c, block)
        assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()


# --- phrases


def brute_phrases(rows, least, longest=4, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        inside = any(
            g == lang and len(longer) > len(words) and 100 * b >= 80 * a and any(longer[k : k + len(words)] == words for k in range(len(longer) - len(words) + 1))
            for (g, longer), b in found.items()
        )
        if not inside:
            score, k = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, k, *r[1:]) for k, r in enumerate(mine, 1)]
    return sorted(ranked)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "ÉTÉ", "x-ray", "a", "…", "São", "Paulo"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(["new york city hall", "São Paulo", rng.choice(words), rng.choice(words)]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!?", "\x0b"]))
        texts.append((rng.choice(["en", "en", "pt", None, "und"]), "".join(parts)))
    return texts


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_phrases_are_brute_force(spark, size):
    rows = [*corpus(120, 3), ("en", None), (None, ""), ("en", ",,,"), *[("fr", "copie exacte de la ligne")] * 12]
    df = spark.createDataFrame([(t, g, 1) for g, t in rows], "text string, lang string, phrase int").repartition(4)
    for least, top in ((5, 2000),) if size > 40 else ((8, 3),):
        got = phrases.mine(df, least=least, top=top, size=size)
        assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, least, top=top)


def test_phrases_odd_tables(spark):
    kind = "lang string, text string"
    assert phrases.mine(spark.createDataFrame([], kind)).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", None), ("en", "a b c")], kind)).collect() == []
    long = [("en", "word " * 200_000 + "tail, " + "pair of words; " * 50)]  # one piece of 200,000 words
    got = phrases.mine(spark.createDataFrame(long, kind), size=1000)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(long, 30)


def test_scores_pass_64_bits(spark):
    big = 2**62
    row = spark.createDataFrame([(big, [big], [big])], "a long, firsts array<long>, lasts array<long>")
    assert phrases.scored(row, 2).first().score == 1_000_000


# --- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            checks = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(digits))))
            keep = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and checks % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if keep:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


BITS = ["a@b.c", "@", "x.y+z@mail-1.example.com", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8", "4952935900253052", "4952 9359-0025 3052", "4111 1111 1111 1111", " ", "-", "--", "\n", "+1 (017) 555-7713", "+", "+49 30 1234567", "0", "9", "12", "é", "word", "a.b@c.d@e.f", "@x.y", "(", ")"]


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(11)
    for _ in range(6000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        assert sanitise.base_spans(text) == plain_spans(text), repr(text)


@pytest.mark.parametrize("run", ["a", "@", "a@", "a.", "1", "1.", "1 ", "1-", "+", "+1", "+1 ", "a@b", "@a.b", "\n", "("])
def test_long_runs_take_linear_time(run):
    text = run * (1_000_000 // len(run))
    assert all(text[s:e] for s, _, e in sanitise.base_spans(text))


def brute_disclosing(texts, support=3, alpha=0.9):
    """{(entity, term): kind} by counting sets of segments."""
    segments = []
    for text in texts:
        spans = sanitise.base_spans(text)
        at = 0
        for line in text.split("\n"):
            words = [(m.start() + at, m.end() + at) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", line)]
            for lo in range(0, len(words), sanitise.SEGMENT):
                mine = words[lo : lo + sanitise.SEGMENT]
                end = words[lo + sanitise.SEGMENT][0] if lo + sanitise.SEGMENT < len(words) else at + len(line) + 1
                low = lambda w: sanitise.lower(text[slice(*w)])
                # an entity belongs to the segment of its first word
                names = {sanitise.entity(text, s) for s in spans if at <= s[0] < at + len(line) and any(w[1] > s[0] for w in mine) and not any(w[1] > s[0] for w in words[:lo]) and s[0] < end}
                outside = {low(w) for w in mine if not any(s[0] < w[1] and w[0] < s[2] for s in spans)}
                segments.append((names, outside, {low(w) for w in mine}, " ".join(low(w) for w in mine)))
            at += len(line) + 1
    total, out = len(segments), {}
    for name in {n for s in segments for n in s[0]}:
        with_name = [s for s in segments if name in s[0]]
        over = lambda both, stands: math.log2(both / len(with_name) / stands * total) >= alpha * math.log2(total / len(with_name))
        for term in {t for s in with_name for t in s[1]}:
            both = [s for s in with_name if term in s[1]]
            form = sanitise.general(term)
            if len({s[3] for s in both}) >= support and over(len(both), sum(term in s[2] for s in segments)):
                wide = over(sum(any(sanitise.general(t) == form for t in s[1]) for s in with_name), sum(any(sanitise.general(t) == form for t in s[2]) for s in segments))
                out[name, term] = "removed" if wide else "general"
    return out


def personal(seed=2):
    rng = random.Random(seed)
    common = "the of and to in is that for on with as at by from".split()
    some = lambda k: " ".join(rng.choice(common) for _ in range(k))
    texts = [some(rng.randint(1, 90)) for _ in range(60)]
    for k in range(6):
        texts.append(f"{some(3)} Doctor Xavier Quillfeather {k} in Zanzibar0{k % 2}, born 1957: x.q@clinic.example.org {some(4)}\nnext line {some(5)}")
    texts += ["Contact the helpdesk at help@corp.example.com"] * 30  # one wording
    texts += [f"{some(70)} call +49 30 1234567 {some(80)}", "only 192.168.0.1", *["card 4952935900253052 " + some(5) for _ in range(4)]]
    return texts


def test_disclosing_terms_are_brute_force(spark):
    texts = personal()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.entity, r.term): sanitise.KINDS[r.rank] for r in sanitise.disclosing(sanitise.scan(df, "doc_id", "text")).collect()}
    want = brute_disclosing(texts)
    assert got == want
    assert want["email:x.q@clinic.example.org", "quillfeather"] in ("removed", "general") and not any("help" in name for name, _ in want)
    found = by_key(sanitise.findings(df), "doc_id")
    for k, text in enumerate(texts):
        base = ",".join(f"{sanitise.KINDS[r]}:{s}:{e}" for s, r, e in plain_spans(text))
        row = found[k]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in PLAIN] == [base.count(kind + ":") for kind in PLAIN]
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        assert set(base.split(",")) - {""} == {":".join(s) for s in spans if s[0] in PLAIN}
        for kind, start, end in spans:
            if kind not in PLAIN:
                assert any(want.get((sanitise.entity(text, s), sanitise.lower(text[int(start) : int(end)]))) for s in plain_spans(text))
    assert any("removed" in r["spans"] or "general" in r["spans"] for r in found.values())
    clean = by_key(sanitise.sanitised(df.withColumn("row_id", df.doc_id)), "doc_id")
    assert "quillfeather" not in clean[60]["text"].lower() and "[EMAIL]" in clean[60]["text"] and clean[0]["text"] == texts[0]
    assert "helpdesk" in clean[66]["text"]


def test_personal_data_odd_tables(spark):
    kind = "doc_id long, text string, spans string"
    assert sanitise.findings(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, "a@b.cd", "x"), (1, None, "x"), (1, "", "x"), (2, "a@b.cd", None), (2, "a@b.cd", None), (3, "w " * 300_000 + "\n10.0.0.1", None)]
    df = spark.createDataFrame(rows, kind)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in sanitise.findings(df).collect()), key=str)
    assert got == sorted([(None, 1, 0, "email:0:6"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 1, 0, "email:0:6"), (2, 1, 0, "email:0:6"), (3, 0, 1, "ip:600001:600009")], key=str)
    back = sorted((str(tuple(r)) for r in sanitise.sanitised(df.where("doc_id < 3 OR doc_id IS NULL")).collect()))
    assert back == sorted(map(str, [(None, "[EMAIL]", "x"), (1, None, "x"), (1, "", "x"), (2, "[EMAIL]", None), (2, "[EMAIL]", None)]))


# --- queries over a folder of tables


@pytest.mark.parametrize("query, module, key", [("op11_centroids", centroids, ["vec_id"]), ("op12_phrases", phrases, ["lang", "rank"])])
def test_queries_are_their_sql(spark, query, module, key):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = getattr(module, query)(spark, data).toPandas().sort_values(key).reset_index(drop=True)
    want = con.execute(module.ORACLE).df().sort_values(key).reset_index(drop=True)[list(got.columns)]
    assert len(got) > 100 and got.equals(want.astype(got.dtypes.to_dict()))


def test_personal_data_of_the_tables(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in sanitise.op13_pii(spark, data).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
