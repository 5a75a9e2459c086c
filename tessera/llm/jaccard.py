"""N-gram Jaccard join (3): rare-first prefix filtering with length, positional and suffix filters.

Texts are lower-cased (A-Z), cut into words [^\\x20\\x09-\\x0D]+, and become sets of 64-bit hashes of shingles of
WORDS words, or as many as the caller says (the whole sequence for texts of fewer words). Two sets link when
100 * intersection >= PERCENT * union, or the caller's percentage; figures below are for PERCENT.

1. Frequencies: shingles are counted in BUCKETS hash buckets over all documents; the counts (a fixed size) go to all tasks.
2. Classes: documents with equal sets are one class from here on, so copies cost one row each and are never paired.
3. Prefix join: of each class the n - ceil(0.9 n) + 1 rarest shingles are its prefix; linked sets share one of those.
   A pair that shares one is a candidate unless its lengths, its sketches (parities of SKETCH_BITS cells of shingles: sets
   differ in as many shingles at least as their sketches in bits) or the number of prefix shingles shared rule a link out.
   Classes joined by candidates are one *family*: it grows with the copies of a text, not with what texts have in common.
   A shingle whose counter isn't full has fewer than FULL classes, whose pairs are compared by a join. Classes of the others
   are dealt into parts; a task compares two parts and hands on a spanning forest of their candidates, not the pairs.
4. Verification: sets meet by family, in blocks of about BLOCK_SHINGLES shingles (block pairs whose lengths can't link
   don't meet), so a task holds two blocks, or two sets that are longer. Blocks are ranges of lengths, dealt from counts
   by length and, among equal lengths, by hash: no task sorts a family. Within a block pair, the prefix index with length, positional and
   suffix filters yields pairs, each verified once by exact intersection, and not at all if both ends are joined already.
   Links within a block pair are reported as a spanning forest, which keeps the components whole.

Null or blank texts have empty sets, are linked with nothing and are their own component. Rows with a null id take part;
a component of such rows alone has a null id. Repeated rows are copies; rows that repeat an id with another text are
rows of their own. A very long text is one set, held whole by the task that reads it. Other columns aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ROWS_PER_SLICE, SPACE_CHARS, drop, fresh, frugal, pack_piece, row_hashes, save, table, unpack_piece
from tessera.llm.components import components

WORDS, PERCENT = 3, 90
#: Counters for shingles (one byte each where they are used), in chunks; tasks whose counts are merged first.
BUCKETS, CHUNK, MERGE = 1 << 24, 1 << 16, 512
#: Shingles of a block of sets, 8 bytes each; a set counts as LEAST_WEIGHT at least, so a block has 128 sets at most or so.
BLOCK_SHINGLES, LEAST_WEIGHT = 1 << 17, 1 << 10
#: Classes of a part of a common shingle, about, and the most parts into which those are dealt.
PART_CLASSES, SALTS = 1 << 11, 64
FULL = 255
#: Bytes of a rare prefix shingle: the upper ones of its hash, so that a collision adds a candidate and loses none.
SHORT = 6
#: Prefix shingles of a range of hashes, about, and those that a task packs at a time.
RANGE, PACK = 1 << 20, 1 << 20
#: Cells of a sketch, and the columns of 64 that hold them.
SKETCH_BITS = 256
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Bits of the filter that picks the texts of classes with a family; a fixed 4 MB.
FILTER_BITS = 1 << 25
CACHE_WORDS = 60_000
#: Stands for a null id: the largest, so that a known id wins.
NO_ID = 2**63 - 1


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}
        self.factor = [np.uint64(xxhash.xxh64_intdigest(b"shingle", k) | 1) for k in range(words)]

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        digest = xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
        ids, n = self.word_ids(words), len(words) - self.words + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.words):
            h ^= ids[k : k + n] * self.factor[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def required(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection, and least size, of a set that can link with one of n: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - int(required(n, percent)) + 1


def _packed(counts: np.ndarray) -> bytes:
    """Counts, saturated at FULL, compressed."""
    return zlib.compress(np.minimum(counts, FULL).astype(np.uint8).tobytes(), 6)


def _summed(blobs: list[bytes]) -> np.ndarray:
    """Sum of packed arrays of counts."""
    total = np.zeros(CHUNK, np.uint32)
    for blob in blobs:
        total += np.frombuffer(zlib.decompress(blob), np.uint8)
    return total


def shingle_counts(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """Count of shingles, at most 255, in each of BUCKETS buckets over all rows of (id, text).

    Tasks hand on their counts as packed arrays of CHUNK buckets, which are summed by chunk, first within MERGE tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total = Shingler(words), np.zeros(BUCKETS, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                found = [sets(t) for t in batch.column(1).slice(lo, MAX_ROWS_PER_SLICE).to_pylist()]
                at, n = np.unique((np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
                total[at] = np.minimum(total[at] + n, FULL)
        parts = [(k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(BUCKETS // CHUNK)]
        packed = [(k, _packed(x)) for k, x in parts if x.any()]
        lot = TaskContext.get().partitionId() // MERGE
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in packed], pa.int32()), pa.array([lot] * len(packed), pa.int32()), pa.array([b for _, b in packed], pa.binary())],
            ["chunk", "lot", "counts"],
        )

    def merge(group: pa.Table) -> pa.Table:
        packed = _packed(_summed(group["counts"].to_pylist()))
        return pa.table({"chunk": pa.array(group["chunk"][:1].to_pylist(), pa.int32()), "counts": pa.array([packed], pa.binary())})

    lots = rows.select("id", "text").mapInArrow(frugal(run), "chunk int, lot int, counts binary").groupBy("chunk", "lot").applyInArrow(merge, "chunk int, counts binary")
    lots, path = save(lots.groupBy("chunk").applyInArrow(merge, "chunk int, counts binary"), "jaccard-counts", tidy=True)
    out = np.zeros(BUCKETS, np.uint8)
    for chunk, counts in lots.collect():  # one packed row per chunk, BUCKETS / CHUNK in all
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.minimum(_summed([counts]), FULL)
    drop(rows.sparkSession, path)
    return out


def _digests(s: np.ndarray) -> tuple[int, int]:
    data = s.tobytes()
    return xxhash.xxh64_intdigest(data, 1) - 2**63, xxhash.xxh64_intdigest(data, 2) - 2**63


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of SKETCH_BITS cells, as 64-bit numbers."""
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.uint8), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def shortened(s: np.ndarray) -> bytes:
    """The upper SHORT bytes of each hash."""
    return np.ascontiguousarray(s, "<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHORT :].tobytes()


def lengthened(data: bytes) -> np.ndarray:
    """Numbers of SHORT bytes."""
    out = np.zeros((len(data) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(data, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def signatures(rows: DataFrame, counts: object, percent: int, words: int = WORDS) -> DataFrame:
    """(id, d1, d2, n, sketch, prefix, common): digests, size and sketch of each row's set, and its rarest shingles.

    Those whose counter is full are in ``common``, the others, shortened, in ``prefix``. Columns of ``rows`` beyond id and
    text come first.
    """
    extra = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rarity = Shingler(words), counts.value
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_ROWS_PER_SLICE):
                part = batch.slice(lo, MAX_ROWS_PER_SLICE)
                digests, sizes, sketches, prefixes, commons = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    s = sets(t)
                    sizes.append(len(s))
                    digests.append(_digests(s))
                    sketches.append(sketch(s))
                    rare = rarity[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    if len(s):
                        p = prefix_size(len(s), percent)
                        if p < len(s):
                            at = np.argpartition(rare.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), p - 1)[:p]
                            s, rare = s[at], rare[at]
                    prefixes.append(shortened(s[rare < FULL]))
                    commons.append(s[rare == FULL].view(np.int64))
                d1, d2 = zip(*digests)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], part.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(c) for c in np.stack(sketches).T), pa.array(prefixes, pa.binary()), pa.array(commons, longs)],
                    [*extra, "id", "d1", "d2", "n", *SKETCH, "prefix", "common"],
                )

    more = "".join(f"{c} long, " for c in extra)
    parities = "".join(f"{c} long, " for c in SKETCH)
    return rows.mapInArrow(frugal(run), f"{more}id long, d1 long, d2 long, n long, {parities}prefix binary, common array<long>")


def met_shingles(classes: DataFrame, percent: int) -> DataFrame:
    """(h, cid): rare prefix shingles that two classes have at least, with those classes.

    Most have one class. So that those cost little, tasks sort what they hold and send it packed, by ranges of hashes.
    """
    size = F.sum(F.col("n") - F.expr(f"({percent} * n + 99) DIV 100") + 1)
    ranges = max(1, -(-(classes.agg(size).first()[0] or 0) // RANGE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, prefixes, held = [], [], 0

        def packs() -> pa.RecordBatch:
            h = lengthened(b"".join(prefixes))
            cid = np.repeat(np.array(cids, np.int64), [len(x) // SHORT for x in prefixes])
            order = np.argsort(h)
            h, cid = h[order], cid[order]
            part = ((h >> np.uint64(8 * SHORT - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [pack_piece([np.diff(h[lo:hi], prepend=np.uint64(0)), cid[lo:hi]]) for lo, hi in zip(at, [*at[1:], len(h)])]
            return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array(blobs, pa.binary())], ["part", "packed"])

        for batch in batches:
            for cid, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cids.append(cid)
                prefixes.append(prefix)
                held += len(prefix) // SHORT
                if held >= PACK:
                    yield packs()
                    cids, prefixes, held = [], [], 0
        if held:
            yield packs()

    def meet(group: pa.Table) -> pa.Table:
        pieces = [unpack_piece(x, 2) for x in group["packed"].to_pylist()]
        h, cid = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in pieces]), np.concatenate([x for _, x in pieces])
        del pieces
        order = np.argsort(h)
        h, cid = h[order], cid[order]
        same = h[1:] == h[:-1]
        met = np.append(same, False) | np.append(False, same)
        return pa.table({"h": pa.array(h[met].view(np.int64)), "cid": pa.array(cid[met].view(np.int64))})

    return classes.select("cid", "prefix").mapInArrow(frugal(deal), "part long, packed binary").groupBy("part").applyInArrow(meet, "h long, cid long")


def candidate_forest(cids: np.ndarray, n: np.ndarray, sketches: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of a left and a right member (one may be both) whose lengths and sketches allow a link."""
    order = np.lexsort((cids, n))
    cids, n, sketches, left, right = (x[order] for x in (cids, n, sketches, left, right))
    label, found = np.arange(len(n)), []
    first = np.searchsorted(n, required(n, percent))
    for x in range(1, len(n)):
        lo = int(first[x])
        at = lo + np.flatnonzero((label[lo:x] != label[x]) & (left[x] & right[lo:x] | right[x] & left[lo:x]))
        if not len(at):
            continue
        apart = np.bitwise_count((sketches[at] ^ sketches[x]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        both = n[at] + n[x]
        at = at[apart <= both - 2 * -(-percent * both // (100 + percent))]
        labels, one = np.unique(label[at], return_index=True)
        found += [(int(cids[x]), int(cids[y])) for y in at[one].tolist()]
        label[np.isin(label, labels)] = label[x]
    return found


def _rare_edges(classes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(cid, lead): candidates with a prefix shingle in common that fewer than FULL classes have.

    If a pair shares c prefix shingles, the rest of the one whose prefix ends first, at most ceil(percent * n / 100) - 1, is all
    that it can share besides.
    """
    facts = classes.select("cid", "n", F.size("common").alias("q"), *SKETCH)
    met = met.join(facts, "cid")
    a, b = (met.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("cid", "n", "q", *SKETCH))) for side in "ab")
    need = f"(({percent} * (n_a + n_b) + {99 + percent}) DIV {100 + percent})"
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in SKETCH)
    near = F.expr(f"(n_a < n_b OR n_a = n_b AND cid_a < cid_b) AND 100 * n_a >= {percent} * n_b AND {apart} <= n_a + n_b - 2 * {need}")
    shared = a.join(b, "h").where(near).groupBy("cid_a", "cid_b", "n_a", "n_b", "q_a", "q_b").agg(F.count(F.lit(1)).alias("c"))
    enough = F.expr(f"c + least(q_a, q_b) + ({percent} * n_b + 99) DIV 100 - 1 >= {need}")
    return shared.where(enough).select(F.col("cid_b").alias("cid"), F.col("cid_a").alias("lead"))


def _common_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, lead): a spanning forest, by pair of parts, of the candidates with a common prefix shingle."""
    rows = classes.select("cid", "n", *SKETCH, F.explode("common").alias("h"))
    parts = rows.groupBy("h").agg(F.least(F.lit(SALTS), F.ceil(F.count(F.lit(1)) / PART_CLASSES)).cast("int").alias("parts"), F.count(F.lit(1)).alias("k"))
    dealt = rows.join(parts.where("k > 1").drop("k"), "h").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = other.select("cid", "n", *SKETCH, "h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")

    def compare(group: pa.Table) -> pa.Table:
        part, i, j = (group[c].to_numpy() for c in ("part", "i", "j"))
        found = candidate_forest(group["cid"].to_numpy(), group["n"].to_numpy(), np.stack([group[c].to_numpy() for c in SKETCH], axis=1), part == i, part == j, percent)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"cid": pa.array(a, pa.int64()), "lead": pa.array(b, pa.int64())})

    return pairs.groupBy("h", "i", "j").applyInArrow(compare, "cid long, lead long")


def family_edges(classes: DataFrame, percent: int, met: DataFrame | None = None) -> DataFrame:
    """(cid, lead): candidates for a link, enough to join into a family what may be linked; ``met`` is met_shingles()."""
    met = met_shingles(classes, percent) if met is None else met
    return _rare_edges(classes, met, percent).unionByName(_common_edges(classes, percent)).distinct()


def flags(hashes: DataFrame) -> DataFrame:
    """(w, bits): one bit of FILTER_BITS for each hash (the only column), by words of 64; at most FILTER_BITS / 64 rows."""
    at = F.col(hashes.columns[0]).bitwiseAND(F.lit(FILTER_BITS - 1))
    return (
        hashes.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    )


def member_filter(members: DataFrame) -> np.ndarray:
    """Bits of the members' id and digest: a filter of fixed size without false negatives."""
    words = flags(members.select(F.col("d1").bitwiseXOR(F.col("id")).alias("h"))).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def _suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """Lower bound of the symmetric difference of two sorted arrays, by halving at a pivot's place."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    mid = len(b) // 2
    at = int(np.searchsorted(a, b[mid]))
    same = at < len(a) and a[at] == b[mid]
    return (
        _suffix_bound(a[:at], b[:mid], depth - 1) + _suffix_bound(a[at + same :], b[mid + 1 :], depth - 1) + (not same)
    )


def verified_links(names: list[int], sets: list[np.ndarray], left: list[bool], right: list[bool], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between members of the left and of the right block (which may be one)."""
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, df))] = np.arange(len(tokens))
    flat, ends = rank[at], np.cumsum([len(s) for s in sets])
    ranked = [np.sort(x) for x in np.split(flat, ends[:-1])]
    by_size = sorted(range(len(names)), key=lambda k: (len(ranked[k]), names[k]))
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    postings: dict[int, list[tuple[int, int]]] = {}
    links = []
    for x in by_size:
        mine, n = ranked[x], len(ranked[x])
        seen: dict[int, tuple[int, int]] = {}  # candidate -> shared prefix shingles, or -1 once ruled out
        least = int(required(n, percent))
        for i, token in enumerate(mine[: prefix_size(n, percent)].tolist()):
            for y, j in postings.get(token, ()):
                m = len(ranked[y])
                if m < least:
                    continue  # length filter
                shared, _ = seen.get(y, (0, 0))
                if shared < 0:
                    continue
                need = -(-percent * (n + m) // (100 + percent))
                seen[y] = (shared + 1, need) if shared + 1 + min(n - i - 1, m - j - 1) >= need else (-1, 0)  # positional filter
        for y, (shared, need) in seen.items():
            if shared <= 0 or not (left[x] and right[y] or left[y] and right[x]) or root(x) == root(y):
                continue
            theirs = ranked[y]
            if _suffix_bound(theirs, mine, 3) > n + len(theirs) - 2 * need:
                continue  # suffix filter
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * both >= percent * (n + len(theirs) - both):
                links.append((names[y], names[x]))
                parent[root(x)] = root(y)
        for j, token in enumerate(mine[: prefix_size(n, percent)].tolist()):
            postings.setdefault(token, []).append((x, j))
    return links


def member_sets(rows: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, d1, d2, shingles) of the rows that may stand for a member: computed again from the texts, not carried along."""
    wanted = rows.sparkSession.sparkContext.broadcast(member_filter(members))  # a fixed 4 MB

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bits = Shingler(words), wanted.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, found = batch.slice(lo, 64), []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = sets(t)
                    d1, d2 = _digests(s)
                    at = (d1 ^ k) & (FILTER_BITS - 1)
                    if len(s) and int(bits[at >> 6]) >> (at & 63) & 1:
                        found.append((k, d1, d2, s.tobytes()))
                if found:
                    columns = zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["id", "d1", "d2", "shingles"])

    return rows.select("id", "text").mapInArrow(frugal(pick), "id long, d1 long, d2 long, shingles binary")


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(cid, id, d1, d2, left, right, g, i, j): members under the key of each block pair they take part in.

    A member's place in its family is the weight of all shorter members and, among equal lengths, one by hash. Families
    of one block are put together by hash into groups of about a block.
    """
    weight = F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))
    shorter = Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lengths = members.groupBy("family", "n").agg(F.count(F.lit(1)).alias("k"))
    lengths = lengths.withColumn("before", F.coalesce(F.sum(F.col("k") * weight).over(shorter), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("cid"), F.col("k")) * weight
    placed = members.join(lengths, ["family", "n"]).withColumn("block", F.floor(place / BLOCK_SHINGLES).cast("int")).drop("k", "before")
    placed, _ = save(placed, "jaccard-members")
    groups = max(1, -(-(placed.agg(F.sum(weight)).first()[0] or 0) // BLOCK_SHINGLES))
    blocks = placed.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = blocks.alias("l"), blocks.alias("r")
    pairs = left.join(
        right,
        (F.col("l.family") == F.col("r.family"))
        & (F.col("l.block") <= F.col("r.block"))
        & (100 * F.col("l.high") >= percent * F.col("r.low")),
    ).select(F.col("l.family").alias("family"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    alone = placed.groupBy("family").agg(F.max("block").alias("last")).where("last = 0")
    sides = sides.join(alone, "family", "left").withColumn(
        "g", F.when(F.col("last") == 0, -1 - F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(F.col("family"))
    )
    return placed.join(sides, ["family", "block"]).select(
        "cid", "id", "d1", "d2", (F.col("block") == F.col("i")).alias("left"), (F.col("block") == F.col("j")).alias("right"), "g", "i", "j"
    )


def class_links(rows: DataFrame, members: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """(a, b): links between classes of ``members`` (cid, id, d1, d2, n, family), enough to join what is linked."""
    met = member_sets(rows, members, words).join(block_pairs(members, percent), ["id", "d1", "d2"])

    def verify(group: pa.Table) -> pa.Table:
        found = {}  # repeated rows of a document count once
        for cid, left, right, shingles in zip(*(group[c].to_pylist() for c in ("cid", "left", "right", "shingles"))):
            found[cid] = (np.frombuffer(shingles, np.uint64), left, right)
        sets, left, right = zip(*found.values())
        links = verified_links(list(found), list(sets), list(left), list(right), percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("g", "i", "j").applyInArrow(verify, "a long, b long")


def _linked(rows: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (id, text, more): the sets of rows (more, id, d1, d2, n), and (d1, d2, cid, component) of classes.

    ``cid`` names the component, ``component`` is its smallest id.
    """
    spark = rows.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(rows, words))
    full, full_path = save(signatures(rows, counts, percent, words), "jaccard-signatures", tidy=True)
    counts.destroy()
    each, _ = save(full.drop(*SKETCH, "prefix", "common"), "jaccard-documents")
    classes = (
        full.where("n > 0")
        .groupBy("d1", "d2", "n")
        .agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in [*SKETCH, "prefix", "common"]))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    with_prefix, prefix_path = save(classes, "jaccard-prefixes", tidy=True)
    del full, classes
    drop(spark, full_path)
    met, met_path = save(met_shingles(with_prefix, percent), "jaccard-met", tidy=True)  # few of the prefix shingles
    facts, facts_path = save(with_prefix.drop("prefix"), "jaccard-facts", tidy=True)
    classes, _ = save(with_prefix.drop(*SKETCH, "prefix", "common"), "jaccard-classes")
    drop(spark, prefix_path)
    families = components(family_edges(facts, percent, met), "cid", "lead")
    drop(spark, met_path, facts_path)  # their rows are edges now
    members = classes.join(
        families.select(F.col("node").alias("cid"), F.col("root").alias("family")), "cid"
    )
    joined = components(class_links(rows, members, percent, words), "a", "b").withColumnRenamed("node", "cid")
    least = classes.select("cid", "id").join(joined, "cid")
    least = joined.join(least.groupBy("root").agg(F.min("id").alias("component")), "root").select("cid", "root", "component")
    named = (
        classes.select("cid", "d1", "d2", "id")
        .join(least, "cid", "left")
        .select("d1", "d2", F.coalesce("root", "cid").alias("cid"), F.coalesce("component", "id").alias("component"))
    )
    return each, named


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(NO_ID))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    each, named = _linked(rows, percent, words)
    filled = each.where("n > 0").join(named, ["d1", "d2"]).select("id", "n", "component")
    empty = each.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return filled.unionByName(empty).select(_known("id").alias(key), F.col("n").alias("n_shingles"), _known("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key (null last), by a hash of the row among equal keys.

    Rows are told apart by all their columns, so a row that repeats a key, or has none, stays if its text is no near
    copy; of rows equal in every column one stays. Rows with empty sets are linked with nothing and all stay.
    Rows that go, or may be repeated, set a bit each; only rows that meet such a bit are shuffled with their texts.
    """
    spark, (h1, h2) = docs.sparkSession, row_hashes(docs)
    a, b = fresh(docs, "row_a"), fresh(docs, "row_b")
    blank_text = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS)) == ""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"), h1.alias("h1"), h2.alias("h2"))
    each, named = _linked(rows, percent, words)
    counted = each.where("n > 0").join(named.select("d1", "d2", "cid"), ["d1", "d2"]).groupBy("cid", "id", "h1", "h2").count()
    counted, counted_path = save(counted, "jaccard-rows", tidy=True)
    first = counted.groupBy("cid").agg(F.min(F.struct("id", "h1", "h2", "count")).alias("row"))
    kept, _ = save(first.select("cid", F.col("row.id").alias("id"), F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2"), F.col("row.count").alias("times")), "jaccard-kept", tidy=True)
    settled = kept.where("times = 1").select("cid", "id", "h1", "h2")
    doubtful, _ = save(flags(counted.join(settled, ["cid", "id", "h1", "h2"], "left_anti").select("h1")), "jaccard-doubtful", tidy=True)
    drop(spark, counted_path)
    word, bits = fresh(docs, "word"), fresh(docs, "bits")
    named_bits = F.broadcast(doubtful.select(F.col("w").alias(word), F.col("bits").alias(bits)))  # at most FILTER_BITS / 64 rows
    at = h1.bitwiseAND(F.lit(FILTER_BITS - 1))
    flagged = docs.where(~blank_text).join(named_bits, F.shiftright(at, 6) == F.col(word), "left")
    hit = F.coalesce(F.getbit(F.col(bits), at.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    sure, rest = (flagged.where(of).select(*(docs[c] for c in docs.columns)) for of in (~hit, hit))
    marks = kept.select(F.col("h1").alias(a), F.col("h2").alias(b), "times")
    held = lambda of: rest.join(marks.where(of).drop("times"), (h1 == F.col(a)) & (h2 == F.col(b)), "left_semi")
    return sure.unionByName(held("times = 1")).unionByName(held("times > 1").dropDuplicates()).unionByName(docs.where(blank_text))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
