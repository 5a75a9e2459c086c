"""Secret scans (10): rules, and a character convolutional network over every candidate and its context.

The base finds three kinds of spans (positions in code points, end exclusive; a span is the whole match):
``assign`` (a name of a secret, a sign and a value of 8 characters or more), ``access`` (AKIA and more, 16 or more in
all) and ``hex`` (32 lower-case hexadecimal digits or more). Candidates of the kind ``net`` are runs of 12 or more
characters of tokens and keys that hold both a letter and a digit, runs of 16 or more with capitals amid small letters,
values of 8 characters or more of any make after a name of a secret and a sign or after "Bearer", and passwords within
URLs. Names are looked for first, as literal words; what surrounds them is read once, so the time is linear in the text
whatever runs it holds. The network, in numpy, reads every candidate, however long, with
CONTEXT characters on either side: two convolutions, maxima over the candidate and over its context, a dense layer. It is
trained on labelled findings (text, start, end, label), by default `labelled_findings`: three fifths train it, a fifth
calibrates its logit, and the threshold is the highest that keeps MIN_RECALL of the last fifth. A candidate over the threshold that overlaps no base span is added; base spans always stay.

A null text is the empty one, without spans. A very long text is scanned whole. Repeated rows give the same spans; an
empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ROWS_PER_SLICE, frugal, table

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs in which access, hex and net spans lie.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Runs, values after a name of a secret, and passwords in URLs, which the network judges.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
NAME = re.compile(r"(?i)key|pass|pwd|secret|token|auth|credential|(?<![a-z])pw(?![a-z])|(?<![a-z])bearer(?=\x20)")
#: The rest of a name; then a sign (or, after "Bearer", blanks) and a value.
NAME_REST = re.compile(r"[A-Za-z0-9_-]*+")
VALUE = re.compile(r"[\"']?+\x20*+[:=]\x20*+[\"']?+([^\x20\x09-\x0D\"',;<>(){}]{8,}+)")
BEARER = re.compile(r"\x20++([^\x20\x09-\x0D\"',;<>(){}]{8,}+)")
USERINFO = re.compile(r"://[^\s/@:]*:([^\s/@]{4,})@")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Capitals amid small letters, as in keys without digits.
MIXED = re.compile(r"[a-z][^a-z]*?[A-Z][^A-Z]*?[a-z]")
CONTEXT = 24
#: Longest piece of a candidate that the network reads at once; longer ones are read in pieces that overlap by half.
PIECE = 64
MIN_RECALL = 0.98
FILTERS, WIDTH, HIDDEN, STEPS, BATCH = 16, 5, 24, 600, 96
FINDINGS, SEED = 6000, 20240101
ALPHABET = "\x00abcdefghijklmnopqrstuvwxyz0123456789 \n\"'=:_-/+.@,;()[]{}<>|#$%&!*"
#: Findings in a batch for the network.
NET_BATCH = 1024


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, unsorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for run in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            out += [(*m.span(), kind) for m in pattern.finditer(text, *run.span())]
    return out


def named_values(text: str) -> Iterator[tuple[int, int]]:
    """Values after names of secrets: a name's run of letters and digits is read to its end once."""
    at = 0
    while found := NAME.search(text, at):
        at = NAME_REST.match(text, found.end()).end()
        value = VALUE.match(text, at) or (BEARER.match(text, at) if found.group().lower() == "bearer" and at == found.end() else None)
        if value:
            yield value.span(1)
            at = value.end()


def judged(run: str) -> bool:
    """Whether a run of a token's characters is one that the network reads."""
    if DIGIT.search(run):
        return LETTER.search(run) is not None
    return len(run) >= 16 and MIXED.search(run) is not None


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans for the network, by start; one within another is left out."""
    found = [m.span() for m in TOKEN.finditer(text) if judged(m.group())]
    found += named_values(text)
    if "://" in text:
        found += [m.span(1) for m in USERINFO.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of many makes as positives; ids, versions, names and placeholders as negatives."""
    rng = random.Random(seed)
    syllables = "an the re ing tion er st ou le on en que do mi ra ch ver ge la os co ta lo in al be com pro ter na ti za liz ic al ment ness ful able ist ship ward graph log sch keit ung ci on eur ble str qu ck ph ght w y j x z ew oo ee".split()
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexes, upper, alnum = "0123456789abcdef", b64[:26] + "0123456789", b64[:62]
    positive = (
        lambda: draw(hexes, rng.choice((20, 24, 32, 40, 48, 64))),
        lambda: draw(hexes.upper(), rng.choice((32, 40))),
        lambda: draw(b64, rng.choice((24, 40, 43, 64, 88))) + rng.choice(("", "=", "==")),
        lambda: draw(alnum, rng.randint(20, 48)),
        lambda: "AKIA" + draw(upper, 16),
        lambda: rng.choice(("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "npm_", "pk_live_")) + draw(alnum, rng.randint(20, 40)),
        lambda: "eyJ" + draw(alnum, rng.randint(20, 60)),
        lambda: draw(alnum + "-_", rng.randint(32, 48)),
        lambda: draw(b64[:52], rng.randint(24, 44)),
    )
    # values that are secrets by what stands before them
    spoken = (
        lambda: word() + word() + word(),
        lambda: "".join(word().title() for _ in range(3)) + draw("!#$%&*", 1) + draw("0123456789", 2),
        lambda: draw(alnum + "!#$%^&*", rng.randint(8, 20)),
        lambda: "-".join(word() for _ in range(4)),
    )
    # values after such names that are none
    unspoken = (
        lambda: rng.choice(("required", "optional", "undefined", "changeme", "placeholder", "redacted", "********", "xxxxxxxxxxxx", "example-value", "os.environ", "string|null", "process.env.KEY", "your_password_here", "/etc/passwd", "true/false")),
        lambda: "${" + word().upper() + "_" + word().upper() + "}",
        lambda: "$" + word().upper() + "_SECRET",
        lambda: word() + "." + word() + ".get",
        lambda: "your-" + word() + "-" + rng.choice(("key", "token", "password")),
    )
    negative = (
        lambda: word() + "-" + word() + "-" + word() + str(rng.randint(1, 99)),
        lambda: word() + word() + word() + str(rng.randint(1990, 2030)),
        lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 9))).title() + str(rng.randint(1900, 2030)),
        lambda: word().title() + word() + str(rng.randint(1, 999)) + rng.choice(("", "th", "px", "km", "a")),
        lambda: f"{word()}{rng.randint(1, 9)}-{word()}-{rng.randint(10, 99)}",
        lambda: "_".join(word() for _ in range(4)) + f"_v{rng.randint(1, 9)}",
        lambda: "/".join(word() for _ in range(3)) + f"/{rng.randint(1, 9999)}/" + word(),
        lambda: f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: f"page={rng.randint(1, 999)}" + "/ref=" + word() + word(),
        lambda: f"{draw(hexes, 8)}-{draw(hexes, 4)}-4{draw(hexes, 3)}-a{draw(hexes, 3)}-{draw(hexes, 12)}",
        lambda: draw(rng.choice("xX0"), rng.randint(12, 30)) + rng.choice(("1a", "x1", "0x")),
        lambda: "id" + draw("0123456789", rng.randint(14, 20)),
        lambda: word().upper() + "-" + draw("0123456789", rng.randint(8, 14)) + "-" + word(),
        lambda: "your-" + word() + "-key-here-" + str(rng.randint(1, 9)),
        lambda: "1234567890abcdefghij"[: rng.randint(16, 20)],
        lambda: "-".join(word() for _ in range(5)) + "1",
        lambda: "".join((word() + word()).title() for _ in range(rng.randint(3, 6))),
        lambda: word() + "".join((word() + word()).title() for _ in range(rng.randint(2, 5))),
        lambda: "/".join((word() + word()).title() for _ in range(rng.randint(3, 5))),
    )
    names = ("token", "secret", "api_key", "apikey", "password", "auth", "key", "Authorization: Bearer", "credential", "pw")
    out = []
    for k in range(n):
        label = k % 2
        before = " ".join(word() for _ in range(6))
        if rng.random() < 0.4:  # the name decides, not the make
            url = label and rng.random() < 0.3
            body = rng.choice(spoken if label else unspoken)().replace("'", "")
            body += draw(alnum[:26], max(0, 8 - len(body)))
            name = rng.choice(("password", "passwd", "pwd", "secret_key", "api_key", "auth_token", "key", "credential", "DB_PASS", "client_secret"))
            lead = f"{rng.choice(('postgres', 'https', 'mysql', 'amqp'))}://{word()}:" if url else name + rng.choice((" = ", "=", ": ", ' = "', '": "'))
            before += " " + lead
            after = f"@{word()}.com/{word()}" if url else rng.choice(('" ', " ", ";\n", "\n", ", ")) + " ".join(word() for _ in range(6))
            out.append((before + body + after, len(before), len(before) + len(body), label))
            continue
        body = rng.choice(positive if label else negative)()
        if len(body) < 12:
            body += draw("0123456789", 12 - len(body))
        style = rng.random()
        if style < (0.45 if label else 0.05):
            before += " " + rng.choice(names) + rng.choice((" = ", "=", ": ", ' = "', '":"'))
        elif style < 0.6:
            before += " " + word() + rng.choice((" ", " is ", ": ", " = "))
        else:
            before += " "
        after = rng.choice(('" ', " ", ". ", "\n", ", ")) + " ".join(word() for _ in range(6))
        out.append((before + body + after, len(before), len(before) + len(body), label))
    return out


_CODE = np.full(0x250, len(ALPHABET), np.int64)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k
    _CODE[ord(_c.upper())] = _k
#: Codes: the alphabet, "other", each with a bit for upper case.
VOCAB = 2 * (len(ALPHABET) + 1)
LENGTH = CONTEXT + PIECE + CONTEXT


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    code = _CODE[np.minimum(points, len(_CODE) - 1)]
    code[points >= len(_CODE)] = len(ALPHABET)
    upper = (points >= 65) & (points <= 90)
    return code + upper * (len(ALPHABET) + 1)


def windows(text: str, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, mask of the candidate) of LENGTH for each piece of a candidate."""
    out = []
    for at in range(start, max(start + 1, end - PIECE // 2), PIECE // 2):
        stop = min(end, at + PIECE)
        lead, tail = text[max(0, at - CONTEXT) : at], text[stop : stop + CONTEXT]
        codes, mask = np.zeros(LENGTH, np.int64), np.zeros(LENGTH, bool)
        whole = _codes(lead + text[at:stop] + tail)
        first = CONTEXT - len(lead)
        codes[first : first + len(whole)] = whole
        mask[CONTEXT : CONTEXT + stop - at] = True
        out.append((codes, mask))
        if stop == end:
            break
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """Weights, calibration of the logit and threshold on the calibrated probability."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of a batch."""
        w = self.weights
        n, steps = len(codes), LENGTH - WIDTH + 1
        first = np.zeros((n, steps, FILTERS), np.float32)
        for k in range(WIDTH):
            first += w["embed"][k][codes[:, k : k + steps]]
        first = np.maximum(first + w["b1"], 0)
        steps2 = steps - 2
        stacked = np.concatenate([first[:, k : k + steps2] for k in range(3)], axis=2)
        second = np.maximum(stacked @ w["conv"] + w["b2"], 0)
        inside = mask[:, WIDTH // 2 + 1 : WIDTH // 2 + 1 + steps2, None]
        low = np.float32(-1)
        a, b = np.where(inside, second, low), np.where(inside, low, second)
        pa_, pb_ = a.argmax(1), b.argmax(1)
        size = np.maximum(inside.sum(1), 1)
        pooled = np.concatenate(
            [np.maximum(a.max(1), 0), np.maximum(b.max(1), 0), (second * inside).sum(1) / size, np.log(size) / 4], axis=1
        ).astype(np.float32)
        hidden = np.maximum(pooled @ w["dense"] + w["b3"], 0)
        if keep is not None:
            keep.update(first=first, stacked=stacked, second=second, inside=inside, pa=pa_, pb=pb_, size=size, pooled=pooled, hidden=hidden)
        return hidden @ w["out"] + w["b4"][0]

    def probabilities(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probability of each (text, start, end): the highest of its pieces."""
        owner, codes, mask = [], [], []
        out = np.zeros(len(found))
        def flush() -> None:
            if owner:
                z = self.forward(np.array(codes), np.array(mask))
                np.maximum.at(out, owner, _sigmoid(self.slope * z + self.offset))
                owner.clear(), codes.clear(), mask.clear()
        for k, (text, start, end) in enumerate(found):
            for c, m in windows(text, start, end):
                owner.append(k), codes.append(c), mask.append(m)
                if len(owner) >= NET_BATCH:
                    flush()
        flush()
        return out


def _gradients(net: Network, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    kept: dict[str, np.ndarray] = {}
    w, n, steps = net.weights, len(codes), LENGTH - WIDTH + 1
    z = net.forward(codes, mask, kept)
    dz = (_sigmoid(z) - label) / n
    g = {"out": kept["hidden"].T @ dz, "b4": np.array([dz.sum()])}
    dh = np.outer(dz, w["out"]) * (kept["hidden"] > 0)
    g["dense"], g["b3"] = kept["pooled"].T @ dh, dh.sum(0)
    dp = dh @ w["dense"].T
    d2 = np.zeros_like(kept["second"])
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None]
    np.add.at(d2, (rows, kept["pa"], cols), dp[:, :FILTERS])
    np.add.at(d2, (rows, kept["pb"], cols), dp[:, FILTERS : 2 * FILTERS])
    d2 += kept["inside"] * (dp[:, 2 * FILTERS : 3 * FILTERS] / kept["size"])[:, None]
    d2 *= kept["second"] > 0
    flat = d2.reshape(-1, FILTERS)
    g["conv"], g["b2"] = kept["stacked"].reshape(len(flat), -1).T @ flat, flat.sum(0)
    ds = d2 @ w["conv"].T
    d1 = np.zeros_like(kept["first"])
    for k in range(3):
        d1[:, k : k + steps - 2] += ds[:, :, k * FILTERS : (k + 1) * FILTERS]
    d1 *= kept["first"] > 0
    g["b1"], g["embed"] = d1.sum((0, 1)), np.zeros_like(w["embed"])
    flat = d1.reshape(-1, FILTERS)
    for k in range(WIDTH):
        at = codes[:, k : k + steps].ravel()
        for f in range(FILTERS):
            g["embed"][k][:, f] = np.bincount(at, flat[:, f], VOCAB)
    return g


def train(findings: list[tuple[str, int, int, int]]) -> Network:
    """Adam on three fifths of the findings, calibration on a fifth, the threshold on the last."""
    rng = np.random.default_rng(SEED)
    rows = [(c, m, label, k) for k, (text, start, end, label) in enumerate(findings) for c, m in windows(text, start, end)]
    owner = np.array([r[3] for r in rows])
    fold = rng.permutation(len(findings)) % 5
    test, last = fold[owner] == 3, fold[owner] == 4
    codes, mask, label = (np.array([r[k] for r in rows]) for k in range(3))
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(np.prod(shape[:-1]) if len(shape) < 3 else WIDTH)).astype(np.float32)
    net = Network({
        "embed": scale(WIDTH, VOCAB, FILTERS), "b1": np.zeros(FILTERS, np.float32),
        "conv": scale(3 * FILTERS, FILTERS), "b2": np.zeros(FILTERS, np.float32),
        "dense": scale(3 * FILTERS + 1, HIDDEN), "b3": np.zeros(HIDDEN, np.float32),
        "out": scale(HIDDEN, 1)[:, 0], "b4": np.zeros(1, np.float32),
    })
    pool, first, second = np.flatnonzero(~test & ~last), {}, {}
    for step in range(1, STEPS + 1):
        at = rng.choice(pool, min(BATCH, len(pool)), replace=False)
        for name, g in _gradients(net, codes[at], mask[at], label[at]).items():
            first[name] = 0.9 * first.get(name, 0) + 0.1 * g
            second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            net.weights[name] = (net.weights[name] - 0.01 * move).astype(np.float32)
    z, y = net.forward(codes[test], mask[test]), label[test]
    slope, offset = 1.0, 0.0
    for _ in range(200):  # damped Newton steps of Platt's scaling, with a weak pull to the given logit
        p = _sigmoid(slope * z + offset)
        v = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * z).sum() + (slope - 1), (p - y).sum() + offset * 1e-3])
        hess = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        slope, offset = np.array([slope, offset]) - step * min(1.0, 0.2 / np.abs(step).max())
    net.slope, net.offset = float(slope), float(offset)
    p = _sigmoid(slope * net.forward(codes[last], mask[last]) + offset)
    best = np.zeros(len(findings))
    np.maximum.at(best, owner[last], p)
    known = [k for k in np.unique(owner[last]).tolist() if findings[k][3]]
    mine = np.sort(best[known])
    net.threshold = float(mine[int((1 - MIN_RECALL) * len(mine))]) if known else 0.5
    return net


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(labelled_findings())


class Covered:
    """What spans cover, for questions in the order of their starts."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans, self.at, self.end = sorted(s[:2] for s in spans), 0, -1

    def meets(self, start: int, end: int) -> bool:
        """Whether a span overlaps [start, end); starts never fall from one call to the next."""
        while self.at < len(self.spans) and self.spans[self.at][0] <= start:
            self.end = max(self.end, self.spans[self.at][1])
            self.at += 1
        return self.end > start or self.at < len(self.spans) and self.spans[self.at][0] < end


def find_all(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text by start, then kind."""
    spans, asked, owner = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        spans.append(base)
        for start, end in candidates(text):
            asked.append((text, start, end))
            owner.append(k)
    if asked:
        taken = [Covered(base) for base in spans]
        for k, (_, start, end), p in zip(owner, asked, net.probabilities(asked)):
            if p >= net.threshold and not taken[k].meets(start, end):
                spans[k].append((start, end, "net"))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in spans]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[REDACTED]") -> str:
    """The text with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_assign, n_access, n_hex, base_sha256, spans."""
    net = net or default_network()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(lo, MAX_ROWS_PER_SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = find_all(texts, net)
                base = [[s for s in f if s[2] != "net"] for f in found]
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *counts,
                        pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]),
                        pa.array([_joined(f) for f in found], pa.string()),
                    ],
                    ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("key", key)


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars", net: Network | None = None) -> DataFrame:
    """``docs`` with secrets replaced in the text, and its length in code points beside it; nulls stay null."""
    net = net or default_network()
    names = docs.columns
    at, long = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(lo, MAX_ROWS_PER_SLICE)
                texts = part.column(at).to_pylist()
                found = find_all([t or "" for t in texts], net)
                new = [t if not f else redacted(t, f) for t, f in zip(texts, found)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if long is not None:
                    sizes = [None if t is None else n if not f else len(t) for t, f, n in zip(new, found, part.column(long).to_pylist())]
                    columns[long] = pa.array(sizes, part.schema.field(long).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(frugal(run), docs.schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
