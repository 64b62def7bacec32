"""Duplicates hidden by formatting: canonical bytes, recursive radix partitioning, counting tries.

A row's canonical bytes are its statements' words and operators in order, in
lower case, with the items of the outermost SELECT list sorted.

1. Every input partition counts its own rows in a trie of canonical bytes. Its rows go on as pairs of longs, (id, local), and
   each different form once, with its local number, least id and count: copies of a hot form are merged before any shuffle.
2. A bucket with more forms than fit is split by further bytes: those that all its forms have in common, which its least and
   greatest form tell, are put aside, and the next STEP bytes part it. So a common beginning costs one round, not one a byte. The
   plan is a table that meets the forms by their prefix; nothing of it reaches the driver.
3. Each bucket is counted in a trie with terminal counters.
4. Rows meet their form's least id by their local number. It is told apart by input partition, so a hot form is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..plans.lineage import cut
from ..shipping import ship

#: Bytes by which an oversized bucket is split after the ones all its forms share.
STEP = 3
#: Forms of a task's trie that are handed on before it begins a new one.
MOST_KEYS = 200_000

_TOKEN = re.compile(r"\w+|[<>=!+\-*/%|]+|[(),]")
_WORD = re.compile(r"\w")


def canonical_tokens(sql: str) -> list[str]:
    """Words and operators of a statement in lower case; the outermost SELECT list's items in sorted order.

    Items are separated by the commas outside of parentheses; a leading DISTINCT belongs to none. The
    outermost SELECT is the first of the least nested ones; its list ends before its FROM, else with its parenthesis or the text.
    """
    tokens = _TOKEN.findall(sql.lower())
    depth, best, start = 0, None, -1
    for i, token in enumerate(tokens):
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        elif token == "select" and (best is None or depth < best):
            best, start = depth, i
    if start < 0:
        return [t for t in tokens if t not in "(),"]
    head = start + 1
    if head < len(tokens) and tokens[head] == "distinct":
        head += 1
    items: list[list[str]] = [[]]
    depth, end = 0, len(tokens)
    for i in range(head, len(tokens)):
        token = tokens[i]
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
            if depth < 0:
                end = i
                break
        elif token == ",":
            if depth == 0:
                items.append([])
        elif token == "from" and depth == 0:
            end = i
            break
        else:
            items[-1].append(token)
    out = [t for t in tokens[:head] if t not in "(),"]
    for item in sorted(items):
        out += item
    out += [t for t in tokens[end:] if t not in "(),"]
    return out


def form_of(statements: tuple[str | None, ...]) -> bytes | None:
    """The statements' canonical bytes; None if one is null or has no word. Tokens are parted by blanks and statements by 0x1e, which no token holds."""
    parts = []
    for sql in statements:
        if sql is None or not _WORD.search(sql):
            return None
        parts.append(" ".join(canonical_tokens(sql)))
    return "\x1e".join(parts).encode("utf-8", "surrogatepass")


class CountingTrie:
    """Keys of bytes with a least id and a count at each terminal. Edges hold as many bytes as all keys below share; leaves burst
    when they hold over BURST keys."""

    BURST = 256

    def __init__(self) -> None:
        self.root: dict = {}  # {rest: [least, count]} of a leaf
        self.split: dict | None = None  # {next byte: trie} once it has burst
        self.shared = b""
        self.keys = 0

    def add(self, key: bytes, least: int, count: int) -> list[int]:
        """The key's terminal, [least id, count], after adding; it stays the same list for as long as the trie lives."""
        node, at = self, 0
        while node.split is not None and key.startswith(node.shared, at) and len(key) > at + len(node.shared):
            step = key[at + len(node.shared)]
            at += len(node.shared) + 1
            child = node.split.get(step)
            if child is None:
                child = node.split[step] = CountingTrie()
            node = child
        rest = key[at:]
        terminal = node.root.get(rest)
        if terminal is None:
            terminal = node.root[rest] = [least, count]
            self.keys += 1
            if len(node.root) > self.BURST and node.split is None:
                node._burst()
        else:
            terminal[0] = min(terminal[0], least)
            terminal[1] += count
        return terminal

    def _burst(self) -> None:
        low, high = min(self.root), max(self.root)
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        self.shared, self.split = low[:n], {}
        stay = {}
        for rest, terminal in self.root.items():
            if len(rest) == n:
                stay[rest] = terminal
            else:
                self.split.setdefault(rest[n], CountingTrie()).root[rest[n + 1 :]] = terminal
        self.root = stay

    def walk(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self)]
        while stack:
            prefix, node = stack.pop()
            for rest, (least, count) in node.root.items():
                yield prefix + rest, least, count
            for step, child in (node.split or {}).items():
                stack.append((prefix + node.shared + bytes([step]), child))


_ROWS = pa.schema([("id", pa.int64()), ("local", pa.int64()), ("form", pa.binary()), ("copies", pa.int64())])
_MAPPED = pa.schema([("local", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("first", pa.bool_())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, local) of every row that takes part, and (least id, local, form, copies) of every form of this partition's trie."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    forms: dict[bytes, int] = {}
    trie = CountingTrie()

    def flush() -> pa.RecordBatch:
        rows = [(least, forms[form], form, count) for form, least, count in trie.walk()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ROWS.types)], schema=_ROWS)

    for batch in batches:
        ids, locals_ = [], []
        for key, *statements in zip(*(c.to_pylist() for c in batch.columns)):
            form = form_of(statements)
            if form is not None:
                trie.add(form, key, 1)
                at = forms.get(form)
                if at is None:
                    number += 1
                    at = forms[form] = number
                ids.append(key)
                locals_.append(at)
        none = pa.nulls(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(locals_, pa.int64()), none.cast(pa.binary()), none.cast(pa.int64())], schema=_ROWS)
        if trie.keys > MOST_KEYS:
            yield flush()
            forms, trie = {}, CountingTrie()
    if trie.keys:
        yield flush()


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts each bucket's forms in a trie of its own and gives every local number its form's least id and count; the rows come sorted by bucket."""

    def mapped(held: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        seen: set[int] = set()
        first = [id(t) not in seen and not seen.add(id(t)) for _, t in held]
        columns = [[n for n, _ in held], [t[0] for _, t in held], [t[1] for _, t in held], first]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MAPPED.types)], schema=_MAPPED)

    bucket, trie, held = None, CountingTrie(), []
    for batch in batches:
        for at, form, number, least, count in zip(*(c.to_pylist() for c in batch.columns)):
            if at != bucket:
                if held:
                    yield mapped(held)
                bucket, trie, held = at, CountingTrie(), []
            held.append((number, trie.add(form, least, count)))
    if held:
        yield mapped(held)


@F.udf(IntegerType())
def _shared_bytes(low: bytes, high: bytes) -> int:
    """How many leading bytes two texts share; read for buckets only."""
    return next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))


def radix_buckets(forms: DataFrame, bucket_rows: int) -> DataFrame:
    """forms with bucket: the prefix of form by which it is counted; no bucket has more than bucket_rows forms but one that is a single form.

    Every round splits the oversized buckets only. A form that ends within the bytes its bucket is split by is a bucket of its own.
    """
    rest = forms.select("form", F.lit(b"").alias("bucket"))
    plan: list[DataFrame] = []  # a small table for each round
    while True:
        sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("form").alias("low"), F.max("form").alias("high"))
        large = sizes.where((F.col("n") > bucket_rows) & (F.col("low") != F.col("high"))).select("bucket", (_shared_bytes("low", "high") + STEP).alias("length"))
        large = cut(large, "buckets")
        if large.isEmpty():
            break
        plan.append(large)
        rest = rest.join(large, "bucket").select("form", F.substring("form", F.lit(1), F.col("length")).alias("bucket"))
    # one pass over the forms: a bucket that a round didn't split meets nothing in the later ones, as those are about longer beginnings of others
    out = forms.withColumn("bucket", F.lit(b""))
    for large in plan:
        out = out.join(large, "bucket", "left").withColumn("bucket", F.coalesce(F.substring("form", F.lit(1), F.col("length")), "bucket")).drop("length")
    return out


def copy_groups(df: DataFrame, key: str, statements: list[str], bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mapped, members): members has id and local of every row that takes part; mapped has for each local number keep_id, the least key of its
    form, copies, the form's rows (1 and more), and first, which is true once a form.

    Rows with a null key, or with a statement that is null or has no word, take no part. An empty table gives
    empty frames; other columns, of whatever name, are not read.
    """
    ship(df.sparkSession)
    source = df.select(F.col(key).cast("long").alias("id"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(statements)])
    source = source.where(" and ".join(["id is not null", *(f"s{i} is not null" for i in range(len(statements)))]))
    rows = cut(source.mapInArrow(_local, "id long, local long, form binary, copies long"), "rows")
    forms = rows.where("form is not null").select("form", "local", F.col("id").alias("least"), "copies")
    if bucket_rows is None:  # several buckets a task, none beyond what a task's trie holds
        bucket_rows = max(1000, min(MOST_KEYS, forms.count() // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    routed = radix_buckets(forms, bucket_rows).select("bucket", "form", "local", "least", "copies").repartition("bucket").sortWithinPartitions("bucket")
    mapped = cut(routed.mapInArrow(_count_buckets, "local long, keep_id long, copies long, first boolean"), "mapped")
    return mapped, rows.where("form is null").select("id", "local")


def copies_found(df: DataFrame, key: str, statements: list[str], bucket_rows: int | None = None) -> DataFrame:
    """(keep_id, copy_id): the least key of each set of same statements with each other key of the set. A row's key counts once however often it is repeated."""
    mapped, members = copy_groups(df, key, statements, bucket_rows)
    met = members.join(mapped.where("copies > 1").select("local", "keep_id"), "local")
    return met.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()


def collapsed(df: DataFrame, key: str, statements: list[str], bucket_rows: int | None = None) -> DataFrame:
    """(keep_id, n_copies): one row for each set of same statements, single rows included."""
    mapped, _ = copy_groups(df, key, statements, bucket_rows)
    return mapped.where("first").select("keep_id", F.col("copies").alias("n_copies"))
