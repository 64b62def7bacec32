"""Near-duplicates by an LSH forest.

A record's signature has one 16-bit min-hash for each of its positions. An order reads DEPTH positions of its own first; records
sorted by it stand beside those with which they share the longest prefix. A region is a run of records whose common prefix
is as deep as the region needs:

1. In every order the runs that share DEPTH hashes are regions. All pairs of a region of at most HOT records are candidates.
2. A larger region is followed deeper by two more positions at a time. One deeper order alone would part similar records, so a
   region goes on in several (BRANCHES at 0.75) that read different positions: a pair of the wanted similarity then stays together in
   some of them with probability SURVIVES however deep they lead. The number of orders is set so that a pair exactly at the
   similarity is lost with probability MISS.
3. A region whose deeper runs would not halve its comparisons is alike throughout; it is compared as it is, block by block.

Candidates are pairs whose 112-bit bitmaps (the parity of the words that fall on each bit) and sizes don't rule the similarity
out. They are checked exactly on their words, which are read again for them alone, so rows of the forest carry no words.
Records with one and the same word set are one class from the start and only one of them goes into the forest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..shipping import ship
from .components import components
from .ranks import join_counted

#: Hashes of 16 bits that an order's first regions share.
DEPTH = 3
#: Most records of a region whose pairs are all compared as they are.
HOT = 4096
#: How often a pair exactly at the similarity may be lost, and the part of them that stays together in deeper orders.
MISS, SURVIVES = 5e-6, 0.95
#: Bits of a bitmap; its size stands in the other 16 bits of two longs.
BITS = 112
#: Words a task remembers with their hashes; results don't depend on it.
KNOWN = 1 << 17

_WORD = re.compile(r"\w+").findall
_SIGNED = "id long, form1 long, form2 long, s1 long, s2 long, sig binary"


def orders_for(similarity: float) -> int:
    """Orders needed for MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - SURVIVES * similarity**DEPTH))


def branches_for(similarity: float) -> int:
    """Deeper orders of two positions each in which a pair goes on; over one of them is expected to keep it together."""
    return math.ceil(2.25 / similarity**2 - 1e-9)


def _words(texts: tuple[str | None, ...]) -> set[str]:
    return set(_WORD(" ".join(t for t in texts if t).lower()))


class _Signer:
    """Signatures, bitmaps and set digests of word sets; hashes of words are remembered from batch to batch."""

    def __init__(self, positions: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, positions, dtype=np.uint64)
        self.positions = positions
        self.known: dict[str, int] = {}
        self.least = np.empty((KNOWN, positions), np.uint32)
        self.mixed = np.empty((KNOWN, 2), np.uint64)
        self.bit = np.empty(KNOWN, np.int64)

    def _learn(self, new: list[str]) -> None:
        at = len(self.known)
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))
        for lo in range(0, len(new), 256):
            x = h[lo : lo + 256, None] * self.odd + self.plus
            x ^= x >> np.uint64(29)
            self.least[at + lo : at + lo + x.shape[0]] = x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
        for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            y = (h ^ h >> np.uint64(31)) * np.uint64(c)
            self.mixed[at : at + len(new), k] = y ^ y >> np.uint64(33)
        self.bit[at : at + len(new)] = h % np.uint64(BITS)
        self.known.update(zip(new, range(at, at + len(new))))

    def _part(self, sets: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """least hashes, digests and bit parities of lists of words, none of them empty."""
        new = list(dict.fromkeys(w for s in sets for w in s if w not in self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = list(dict.fromkeys(w for s in sets for w in s))
        if new:
            self._learn(new)
        known, sizes = self.known, np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.fromiter((known[w] for s in sets for w in s), np.int64, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        cells = np.repeat(np.arange(len(sets)) * BITS, sizes) + self.bit[flat]
        parity = (np.bincount(cells, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(len(sets), BITS)
        return np.minimum.reduceat(self.least[flat], starts), np.add.reduceat(self.mixed[flat], starts), parity

    def sign(self, sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests, bitmaps with sizes, signatures) of word sets, none of them empty; a long one is read in pieces."""
        pieces, owner = [], []
        for i, s in enumerate(sets):
            words = list(s)
            for lo in range(0, len(words), 20_000):
                pieces.append(words[lo : lo + 20_000])
                owner.append(i)
        parts, group, held = [], [], 0
        for p in [*pieces, None]:
            if p is None or held + len(p) > 60_000:
                if group:
                    parts.append(self._part(group))
                group, held = [], 0
            if p is not None:
                group.append(p)
                held += len(p)
        least, mixed, parity = (np.concatenate(x) for x in zip(*parts))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first) < len(owner):
            least, mixed, parity = np.minimum.reduceat(least, first), np.add.reduceat(mixed, first), np.add.reduceat(parity, first) & 1
        size = np.minimum(np.fromiter(map(len, sets), np.int64, len(sets)), 0xFFFF).astype("<u2")
        bitmap = np.concatenate([np.packbits(parity, axis=1), size[:, None].view(np.uint8)], axis=1)
        return mixed.view(np.int64), np.ascontiguousarray(bitmap).view("<i8"), (least & np.uint32(0xFFFF)).astype(">u2")


def _signing(positions: int, seed: int):
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("form1", "form2", "s1", "s2")), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(positions, seed)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                sets = [(k, w) for k, *texts in zip(*(c.to_pylist() for c in part.columns)) if (w := _words(texts))]
                if sets:
                    digest, bitmap, sig = signer.sign([w for _, w in sets])
                    columns = [pa.array([k for k, _ in sets], pa.int64()), *(pa.array(x) for x in (digest[:, 0], digest[:, 1], bitmap[:, 0], bitmap[:, 1])), pa.array([s.tobytes() for s in sig], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _neighbours(similarity: float):
    """Pairs of records of one region whose sizes and bitmaps allow the similarity; rows come sorted by region."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    share = (1 - similarity) / (1 + similarity)  # of the words of both, so many at most are in one set only
    low = np.uint64((1 << 48) - 1)

    def compare(cid: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        size = (s2 >> np.uint64(48)).astype(np.int64)
        open_size = np.where(size >= 0xFFFF, np.int64(1) << 40, size)  # sizes beyond 16 bits rule nothing out
        order = np.argsort(open_size, kind="stable")
        cid, size, s1, s2 = cid[order], open_size[order], s1[order], s2[order] & low
        last = np.searchsorted(size, np.floor(size / similarity + 1e-6), side="right")
        last[size >= 1 << 40] = len(cid)
        if size[-1] >= 1 << 40:
            last[:] = np.where(size / similarity >= 0xFFFF, len(cid), last)
        out = []
        for lo in range(0, len(cid) - 1, 64):
            hi = min(lo + 64, len(cid))
            top = int(last[lo:hi].max())
            for at in range(lo, top, 2048):
                to = min(at + 2048, top)
                most = (size[lo:hi] + size[to - 1]) * share + 1e-6
                if most.max() < 64:
                    i, j = np.nonzero(np.bitwise_count(s1[lo:hi, None] ^ s1[None, at:to]) <= most.astype(np.uint8)[:, None])
                else:
                    i, j = (x.ravel() for x in np.indices((hi - lo, to - at)))
                i, j = i + lo, j + at
                keep = j > i
                i, j = i[keep], j[keep]
                far = np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j]).astype(np.int64)
                fits = (far <= (size[i] + size[j]) * share + 1e-6) & (cid[i] != cid[j])
                out.append(np.stack([cid[i[fits]], cid[j[fits]]], 1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    def beside(region: np.ndarray, cid: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> list[np.ndarray]:
        """The same for many small regions at once: each row with the first, second, third row after it, as far as its region goes."""
        size, bits2 = (s2 >> np.uint64(48)).astype(np.int64), s2 & low
        out, step, live = [], 1, np.arange(len(region))
        while len(live := live[: np.searchsorted(live, len(region) - step)]) and len(live := live[region[live] == region[live + step]]):
            i, j = live, live + step
            most = (size[i] + size[j]) * share + 1e-6
            fits = (np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(bits2[i] ^ bits2[j]) <= most) & (np.abs(size[i] - size[j]) <= most)
            fits |= (size[i] == 0xFFFF) | (size[j] == 0xFFFF)
            fits &= cid[i] != cid[j]
            out.append(np.stack([cid[i[fits]], cid[j[fits]]], 1))
            step += 1
        return out

    def pairs(region: np.ndarray, cid: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(region)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(region)])))
        some = np.repeat((sizes > 1) & (sizes <= 48), sizes)
        found = [compare(cid[a : a + n], s1[a : a + n], s2[a : a + n]) for a, n in zip(starts[sizes > 48], sizes[sizes > 48])]
        found += beside(region[some], cid[some], s1[some], s2[some])
        both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        both = np.unique(np.sort(both, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = [np.asarray(batch.column(i)) for i in range(4)]
            rows[2:] = [x.view(np.uint64) for x in rows[2:]]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            end = int(np.searchsorted(rows[0], rows[0][-1]))  # the last region may go on in the next batch
            if end:
                yield pairs(*(x[:end] for x in rows))
            rest = [x[end:] for x in rows]
        if rest is not None:
            yield pairs(*rest)

    return run


def _hash_at(position: Column) -> Column:
    return F.col("sig").substr(position * 2 + 1, F.lit(2))


def _deeper(rows: DataFrame, reps: DataFrame, branches: int, positions: int) -> DataFrame:
    """(parent, n, region, cid, s1, s2): rows (region, n, cid) of large regions in the regions of their deeper orders."""
    met = rows.withColumnsRenamed({"region": "parent"}).join(reps, "cid")

    def child(branch: Column) -> Column:
        # which positions come next is told by the region and the branch alone, so all records of a region read the same ones
        read = [F.pmod(F.xxhash64("parent", branch, F.lit(k)), F.lit(positions)).cast("int") for k in range(2)]
        return F.xxhash64("parent", branch, _hash_at(read[0]), _hash_at(read[1]))

    return met.select("parent", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(branches - 1)), child)).alias("region"), "cid", "s1", "s2")


def _blocks(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (region, n, cid) dealt into chunks of about HOT records; every two chunks meet in a region of their own."""
    chunks = F.ceil(F.col("n") / HOT).cast("int")
    dealt = rows.select("region", "cid", chunks.alias("chunks"), F.pmod(F.xxhash64("cid", F.lit(3)), chunks).cast("int").alias("mine"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "cid").join(reps.select("cid", "s1", "s2"), "cid").select("region", "cid", "s1", "s2")


def _regions(reps: DataFrame, orders: int, branches: int) -> DataFrame:
    """(region, cid, s1, s2): every record in each region in which its pairs are to be compared, none of them of many more than HOT records."""
    # equal keys are the runs of the sorted order that share its first hashes
    first = F.array(*[F.xxhash64(F.lit(o), F.substring("sig", 1 + 2 * DEPTH * o, 2 * DEPTH)) for o in range(orders)])
    keyed = reps.select(F.explode(first).alias("region"), "cid", "s1", "s2")
    large = cut(keyed.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "large")
    out = keyed.join(large, "region", "left_anti")
    rows = cut(keyed.select("region", "cid").join(large, "region"), "frontier")
    while not rows.isEmpty():
        kids = cut(_deeper(rows, reps, branches, orders * DEPTH), "deeper")
        sizes = cut(kids.groupBy("parent", "n", "region").agg(F.count("*").alias("m")), "sizes")
        work = sizes.groupBy("parent", "n").agg(F.sum(F.col("m") * (F.col("m") - 1.0)).alias("work"))
        alike = cut(work.where(F.col("work") > 0.5 * F.col("n") * (F.col("n") - 1.0)).select("parent"), "alike")
        out = out.unionByName(_blocks(rows.join(alike.withColumnRenamed("parent", "region"), "region", "left_semi"), reps))
        good = kids.join(alike, "parent", "left_anti")
        large = sizes.where(F.col("m") > HOT).join(alike, "parent", "left_anti").select("region", F.col("m").alias("n"))
        out = out.unionByName(good.select("region", "cid", "s1", "s2").join(large, "region", "left_anti"))
        rows = cut(good.select("region", "cid").join(large, "region"), "frontier")
    return out


def _source(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return records.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(columns)]).where("id is not null")


class Classes:
    """Records with the same set of words as one class: members (id, cid) with cid the least id of the class, sizes (cid, n) of the
    classes of several records, and reps (cid, s1, s2, sig). Written; records without words are left out."""

    def __init__(self, records: DataFrame, key: str, columns: list[str], similarity: float, seed: int = 7) -> None:
        ship(records.sparkSession)
        self.similarity, self.source = similarity, _source(records, key, columns)
        self.orders, self.branches = orders_for(similarity), branches_for(similarity)
        signed = cut(self.source.mapInArrow(_signing(self.orders * DEPTH, seed), _SIGNED), "signed")
        forms = signed.groupBy("form1", "form2").agg(F.min("id").alias("cid"), F.count("*").alias("n")).where("n > 1")
        forms = cut(forms, "forms")
        copies = join_counted(signed.select("id", "form1", "form2"), forms, ["form1", "form2"])
        copies = cut(copies.where("id <> cid").select("id", "cid").distinct(), "copies")
        self.sizes = copies.groupBy("cid").agg((F.count("*") + 1).alias("n"))
        self.copies = copies
        others = copies.select("id")
        self.reps = signed.join(others, "id", "left_anti").select(F.col("id").alias("cid"), "s1", "s2", "sig")
        self.members = signed.select("id").join(others, "id", "left_anti").select("id", F.col("id").alias("cid")).unionByName(copies)

    def pairs(self) -> DataFrame:
        """(a, b): pairs of classes whose word sets have the similarity or more, a < b. Written."""
        routed = _regions(self.reps, self.orders, self.branches).repartition("region").sortWithinPartitions("region")
        near = cut(routed.mapInArrow(_neighbours(self.similarity), "a long, b long").distinct(), "candidates")
        wanted = cut(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "wanted")
        words = cut(self.source.join(wanted, "id", "left_semi").mapInArrow(_hashed_words, "id long, words array<long>"), "words")
        left, right = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
        met = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
        exact = met.where(F.col("common") >= self.similarity * (F.size("wa") + F.size("wb") - F.col("common")) - 1e-9)
        return cut(exact.select("a", "b").distinct(), "pairs")


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.int64()))])
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            hashes = [np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in _words(t)], np.uint64).view(np.int64) for t in zip(*(c.to_pylist() for c in part.columns[1:]))]
            offsets = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes)))], schema=schema)


def _expanded(pairs: DataFrame, side: str, sized: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs with side replaced by each member of its class. Classes of several records are met chunk by chunk, so that
    no task gets a whole one."""
    chunks = F.ceil(F.col("n") / HOT).cast("int")
    deal = lambda x: F.pmod(F.xxhash64(x), chunks).cast("int")
    own = sized.select(F.col("cid").alias(side), F.col("id").alias("member"), deal("id").alias("chunk"))
    asked = pairs.join(sizes.select(F.col("cid").alias(side), "n"), side).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n")
    return pairs.unionByName(asked.join(own, [side, "chunk"]).drop(side, "chunk").withColumnRenamed("member", side).select(*pairs.columns))


def near_pairs(records: DataFrame, key: str, columns: list[str], similarity: float = 0.75) -> DataFrame:
    """(id_a, id_b): all pairs of records whose words over the columns have similarity or more, the smaller key first.

    The words (runs of letters, digits and '_', in lower case) of all columns together are one set for each record; null columns count as
    empty, records without any word pair with nothing, records with equal sets pair with each other. Null keys take no part; a
    repeated key stands for each of its rows but never pairs with itself. Whole texts are used. An empty table gives no rows.
    A pair exactly at the similarity is lost with probability MISS, one more similar much more seldom.
    """
    classes = Classes(records, key, columns, similarity)
    sizes, copies = cut(classes.sizes, "class-sizes"), classes.copies
    sized = join_counted(copies, sizes, ["cid"])
    across = _expanded(_expanded(classes.pairs(), "a", sized, sizes), "b", sized, sizes)
    across = across.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    # within a class, its least key with each copy, and every two copies: a star expanded on its middle
    star = copies.select(F.col("cid").alias("a"), F.col("id").alias("b"))
    within = _expanded(star, "a", sized, sizes).where("a < b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return across.unionByName(within).where("id_a < id_b").distinct()


def near_groups(records: DataFrame, key: str, columns: list[str], similarity: float = 0.75) -> DataFrame:
    """(key, class_id, group_id, links): one row for each record with words: the class of records with its very word set, the group of
    classes joined by near pairs (its least key), and the number of other classes near its own."""
    classes = Classes(records, key, columns, similarity)
    pairs = classes.pairs()
    groups = components(pairs, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("g"))
    links = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("links"))
    linked = links.join(groups, "cid")
    # single records have a class of their own, so only copies of records can gather on one key
    own = classes.reps.select("cid").join(linked, "cid", "left").select(F.col("cid").alias("id"), F.col("cid").alias("class_id"), F.coalesce("g", "cid").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    known = own.select(F.col("class_id").alias("cid"), "group_id", "links").join(classes.sizes, "cid")
    met = join_counted(classes.copies, cut(known, "known"), ["cid"]).select("id", F.col("cid").alias("class_id"), "group_id", "links")
    return own.unionByName(met).select(F.col("id").alias(key), "class_id", "group_id", "links")
