r"""Personal data (13): patterns for what is protected, and corpus co-occurrence for what gives it away.

The base finds four kinds of spans (code points, end exclusive): ``email``, ``ip``, ``card`` and ``phone``. Their values
are the protected entities. Which other terms disclose an entity is estimated from all documents:

* A segment is at most SEGMENT words of one line; words are runs of ASCII letters, digits and all other non-ASCII
  characters, in lower case (A-Z). p(x) is the share of the segments that hold x, over the whole corpus.
* The information of entity e is IC(e) = -log2 p(e). A term t of e's segments reveals PMI(e, t) =
  log2(p(e, t) / (p(e) p(t))) of it, all of it where t never stands without e.
* A term that stands in segments of e of SUPPORT or more different wordings, with PMI(e, t) >= ALPHA * IC(e), exceeds the
  threshold. It is generalised (a number to its magnitude, digits to 0, a word to its first letter) if its general form
  stays below the threshold for e, and removed if not. These are the added spans, ``general`` and ``removed``, in
  segments that hold the entity, and never overlap the base's; base spans always stay.

Copies of a segment are one wording, so boilerplate discloses nothing by being repeated, though every copy counts in the
shares. Pairs of entities and terms are made within a segment only, so there are at most SEGMENT / 2 for a word. Counts
are summed within tasks before they are shuffled; no term list and no entity list is ever sent whole to anyone.

A null text is the empty one: no spans. A very long text is read whole, in time linear in its length. Repeated rows give
equal spans each; a null key is a key like any other. An empty table gives an empty result. Other columns aren't read
(`sanitised` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ROWS_PER_SLICE, fresh, frugal, save, table

KINDS = ("email", "ip", "card", "phone", "general", "removed")
SEGMENT, SUPPORT, ALPHA = 64, 3, 0.9
#: Distinct counted terms that a task holds before it hands them on.
HELD = 1 << 20
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]"}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Stretches in which addresses and cards lie.
DIGITS = re.compile(r"[0-9][0-9\x20.-]{5,}")
#: A match can't start after a digit that no former match holds: it would have started there.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Bytes of words stay, in lower case; line ends stay; everything else is a space.
_BYTES = bytes(b if b >= 0x80 or b == 10 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

SCANNED = (
    "id long, key {0}, spans array<struct<start:int,rank:int,end:int>>, base_sha256 string, entities array<string>,"
    " near array<struct<entity:string,term:string,general:string,wording:long,first:boolean,starts:array<int>,ends:array<int>>>, what string, item string, n long"
)


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @: the local part's run to the left, not into the match before, and a domain to the right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                out.append((start, free))
                at = free - 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    for run in DIGITS.finditer(text):
        if "." in run.group():
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text, *run.span()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        if run.end() - run.start() >= 12:
            for m in CARD.finditer(text, *run.span()):
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value: addresses in lower case, numbers without their punctuation."""
    start, rank, end = span
    value = text[start:end]
    return f"{KINDS[rank]}:{value.lower() if rank < 2 else re.sub('[^0-9]', '', value)}"


def general(term: str) -> str:
    """A less telling form: a number's magnitude, 0 for each digit of a code, a word's first letter."""
    if term.isascii() and term.isdigit():
        return term[0] + "0" * (len(term) - 1)
    masked = re.sub("[0-9]", "0", term)
    return term[0] + "." if masked == term else masked


def lower(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.encode("utf-8", "replace").translate(_LOWER).decode("utf-8")


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def neighbourhoods(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[dict]]:
    """Entities, each once for a segment that holds it, and the terms beside them: one entry for entity, segment and term."""
    entities: list[str] = []
    near: list[dict] = []
    at = 0
    while at < len(spans):
        start, stop = text.rfind("\n", 0, spans[at][0]) + 1, text.find("\n", spans[at][0])
        stop = len(text) if stop < 0 else stop
        mine = []
        while at < len(spans) and spans[at][0] < stop:
            mine.append(spans[at])
            at += 1
        words = [m.span() for m in WORD.finditer(text, start, stop)]
        held: dict[int, dict[str, None]] = {}
        free, word = [True] * len(words), 0
        for span in mine:
            while words[word][1] <= span[0]:
                word += 1
            held.setdefault(word // SEGMENT, {})[entity(text, span)] = None
            inside = word
            while inside < len(words) and words[inside][0] < span[2]:
                free[inside] = False
                inside += 1
        for number, names in held.items():
            here = range(number * SEGMENT, min(len(words), (number + 1) * SEGMENT))
            terms = {k: lower(text[slice(*words[k])]) for k in here}
            wording = int.from_bytes(hashlib.blake2b(" ".join(terms.values()).encode(), digest_size=8).digest(), "big", signed=True)
            places: dict[str, list[int]] = {}
            for k in here:
                if free[k]:
                    places.setdefault(terms[k], []).append(k)
            seen, entries = set(), []
            for term, ks in places.items():
                form = general(term)
                entries.append({"term": term, "general": form, "wording": wording, "first": form not in seen, "starts": [words[k][0] for k in ks], "ends": [words[k][1] for k in ks]})
                seen.add(form)
            entities += names
            near += [{"entity": name, **entry} for name in names for entry in entries]
    return entities, near


class Counts:
    """In how many segments each term and each general form stands."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.held = self.segments = 0

    def add(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))
        _, offsets, data = texts.buffers()
        plain = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(bytes(data or b"").translate(_BYTES))])
        words = pc.split_pattern(pc.split_pattern(plain, "\n").flatten(), " ")
        line = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        flat = words.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        flat, line = flat.filter(real), line[real.to_numpy(zero_copy_only=False)]
        if not len(flat):
            return
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        segment = np.cumsum((place % SEGMENT == 0).astype(np.int64))
        self.segments += int(segment[-1])
        coded = flat.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        forms = pa.array([general(t) for t in terms.to_pylist()]).dictionary_encode()
        for what, known, codes in (("term", terms, code), ("general", forms.dictionary, forms.indices.to_numpy().astype(np.int64)[code])):
            pairs = np.unique(segment * len(known) + codes)
            n = np.bincount(pairs % len(known), minlength=len(known))
            self.parts.append(pa.table({"what": pa.array([what] * len(known)), "item": known, "n": n}))
            self.held += len(known)
        if self.held > 2 * HELD:
            self.shrink()

    def shrink(self) -> None:
        whole = pa.concat_tables(self.parts).group_by(["what", "item"]).aggregate([("n", "sum")]).rename_columns(["what", "item", "n"])
        self.parts, self.held = [whole], whole.num_rows

    def take(self) -> pa.Table:
        """All counts so far, and the number of segments."""
        self.parts.append(pa.table({"what": ["all"], "item": [""], "n": [self.segments]}))
        self.shrink()
        out, self.parts, self.held, self.segments = self.parts[0], [], 0, 0
        return out


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SCANNED, saved: a row per row of ``docs`` (what is null), and rows of counts."""
    kind = docs.schema[key].dataType.simpleString()
    schema = SCANNED.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        counts, types = Counts(), None
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(lo, MAX_ROWS_PER_SLICE)
                types = types or _arrow(part.schema.field(0).type)
                counts.add(part.column(1))
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [base_spans(t) for t in texts]
                beside = [neighbourhoods(t, s) if s else ([], []) for t, s in zip(texts, found, strict=True)]
                n = len(texts)
                columns = [
                    pa.array(np.arange(number, number + n)), part.column(0),
                    pa.array([[{"start": s, "rank": r, "end": e} for s, r, e in f] for f in found], types.field("spans").type),
                    pa.array([hashlib.sha256(",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in f).encode()).hexdigest() for f in found]),
                    pa.array([e for e, _ in beside], types.field("entities").type), pa.array([x for _, x in beside], types.field("near").type),
                ]
                number += n
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, types.field(k).type) for k in ("what", "item", "n"))], schema=types)
                if counts.held > HELD:
                    yield from _counted(counts, types)
        if types and counts.segments:
            yield from _counted(counts, types)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return save(rows.mapInArrow(frugal(run), schema), "sanitise-scan")[0]


def _arrow(key: pa.DataType) -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("entity", pa.string()), ("term", pa.string()), ("general", pa.string()), ("wording", pa.int64()), ("first", pa.bool_()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    return pa.schema([("id", pa.int64()), ("key", key), ("spans", pa.list_(span)), ("base_sha256", pa.string()), ("entities", pa.list_(pa.string())), ("near", pa.list_(near)), ("what", pa.string()), ("item", pa.string()), ("n", pa.int64())])


def _counted(counts: Counts, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in counts.take().to_batches(max_chunksize=1 << 16):
        blank = [pa.nulls(batch.num_rows, f.type) for f in types][:6]
        yield pa.RecordBatch.from_arrays([*blank, *(batch.column(c) for c in ("what", "item", "n"))], schema=types)


def disclosing(scanned: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """entity, term, rank: terms over the threshold for an entity, and whether they are generalised or removed."""
    counts = scanned.where("what IS NOT NULL").groupBy("what", "item").agg(F.sum("n").alias("n"))
    total = scanned.where("what = 'all'").agg(F.sum("n")).first()[0] or 0  # one number
    near = scanned.where("size(near) > 0").select(F.explode("near").alias("x")).select("x.*")
    wordings = near.groupBy("entity", "term", "general", "wording").agg(F.count(F.lit(1)).alias("n"))
    pairs = wordings.groupBy("entity", "term", "general").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("wordings")).where(F.col("wordings") >= support)
    forms = near.where("first").groupBy("entity", "general").agg(F.count(F.lit(1)).alias("both_general"))
    held = scanned.where("size(entities) > 0").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("held"))
    term = counts.where("what = 'term'").select(F.col("item").alias("term"), F.col("n").alias("stands"))
    form = counts.where("what = 'general'").select(F.col("item").alias("general"), F.col("n").alias("stands_general"))

    def exceeds(both: Column, stands: Column) -> Column:
        revealed = F.log2(both / F.col("held") / stands * F.lit(float(total)))
        return revealed >= F.lit(alpha) * F.log2(F.lit(float(total)) / F.col("held"))

    over = pairs.join(held, "entity").join(term, "term").where(exceeds(F.col("both"), F.col("stands")))
    rank = F.when(exceeds(F.col("both_general"), F.col("stands_general")), KINDS.index("removed")).otherwise(KINDS.index("general"))
    return over.join(forms, ["entity", "general"]).join(form, "general").select("entity", "term", rank.alias("rank"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """A row per row of ``docs``: key, spans (start, rank, end) of the base, `all_spans`, base_sha256."""
    scanned = scan(docs, key, text)
    over, _ = save(disclosing(scanned, support, alpha), "sanitise-terms")
    beside = scanned.where("size(near) > 0").select("id", F.explode("near").alias("x")).select("id", "x.entity", "x.term", F.arrays_zip("x.starts", "x.ends").alias("places"))
    places = beside.join(over, ["entity", "term"]).select("id", "rank", F.explode("places").alias("p")).select("id", "rank", F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
    added = places.groupBy("id", "start", "end").agg(F.max("rank").alias("rank")).groupBy("id").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    rows = scanned.where("what IS NULL").select("id", "key", "spans", "base_sha256")
    joined = rows.join(added, "id", "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return joined.select(F.col("key").alias(key), "spans", every.alias("all_spans"), "base_sha256")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")
    return find(docs, key, text).select(key, *[count(rank) for rank in range(4)], "base_sha256", written(F.col("all_spans")).alias("spans"))


def replaced(text: str, spans: list[dict]) -> str:
    """The text with base spans and removed terms as marks, and general forms of generalised terms."""
    out, at = [], 0
    for span in spans:
        start, rank, end = span["start"], span["rank"], span["end"]
        if start >= at:
            out += [text[at:start], general(lower(text[start:end])) if KINDS[rank] == "general" else MARKS[KINDS[rank]]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with protected values and the terms that disclose them generalised or removed; nulls stay null."""
    names, row, spans = docs.columns, fresh(docs, "row_id"), fresh(docs, "all_spans")
    rows, _ = save(docs.withColumn(row, F.monotonically_increasing_id()), "sanitise-rows")
    found = find(rows, row, text).select(F.col(row), F.col("all_spans").alias(spans))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[: len(names)]
            new = [t if t is None else replaced(t, s) for t, s in zip(columns[at].to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(found, row).select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(frugal(run), docs.schema)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms that disclose it."""
    return findings(table(spark, sf_dir, "documents"))
