"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts: the set of word shingles (64-bit hashes), its digest, and ``bands`` times
   ``rows`` minima.  A hash of each band's minima is a bucket; of each minimum the low four bits are
   kept, sixteen to a long.  Rows with equal digests are one node from here on.
2. Candidates come from the buckets.  A pair's similarity is estimated from the number of equal
   four-bit groups (xor and bit counts), corrected for the sixteenth that agree by chance; pairs over
   ``deviations`` standard deviations below the threshold are dropped (infinity: none), the others are
   confirmed on full sets.
3. Only connections are needed, so a pair inside one component is never looked at.  First every node
   meets its buckets' least nodes: the one with the best estimate, then the others; a least node's text
   is sent once for each ``FANS`` nodes that meet it.  Then buckets that still hold several components
   are compared inside, in pairs of blocks of about ``block`` nodes and ``BLOCK_BYTES`` of text: nodes
   of the bucket's largest component against the others, and the others among themselves; by signature
   and, for nodes with a partner left, on full sets.  Only links that join components come out.

A pair at the threshold shares no bucket with probability (1 - t**rows)**bands: 3e-7 at 0.85 and
6e-5 at 0.8.

Null and empty texts have the empty set, no links, and are components of their own.  Repeated rows
are linked (equal sets); component_id is the least id of a component, null only if all its ids are.
Of rows that repeat an id, ``kept`` is true for each: use ``keep_first`` for exactly one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm import words as W
from lethe.plans import components, scratch

BANDS, ROWS, BITS = 32, 6, 4
BLOCK, BLOCK_BYTES, FANS = 256, 8 << 20, 32
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_POWERS = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of n words; A-Z count in lower case."""
    found = W.cut(texts, lower=True)
    flat = found.hashes()
    all_n = W.Windows(flat)(n) if len(flat) >= n else np.zeros(0, np.uint64)
    out, at = [], 0
    for k in found.lengths.tolist():
        if k >= n:
            own = np.sort(all_n[at : at + k - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif k:
            out.append(np.array([xxhash.xxh64_intdigest(flat[at : at + k].tobytes(), seed=k)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a row of ``BANDS``) and packed low bits (a row of longs) of non-empty sets."""
    joined = np.concatenate(sets)
    low = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    minima = np.empty((len(_A), len(sets)), np.uint32)
    for k in range(len(_A)):
        minima[k] = np.minimum.reduceat(low * _A[k] + _B[k], starts)
    wide = minima.astype(np.uint64).reshape(BANDS, ROWS, -1)
    buckets = (wide * _POWERS[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    buckets ^= buckets >> np.uint64(31)
    buckets *= np.uint64(0xBF58476D1CE4E5B9)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    # minima of one linear map have poor low bits, so the ones that are kept are those of a hash
    mixed = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    packed = ((mixed >> np.uint32(28)).astype(np.uint64).reshape(-1, 16, len(sets)) << shifts).sum(axis=1, dtype=np.uint64)
    return buckets.T.copy().view(np.int64), packed.T.copy().view(np.int64)


LONGS = BANDS * ROWS // 16
_ONES = 0x1111111111111111


def corrected(equal: float, of: int = BANDS * ROWS) -> float:
    """Similarity from the number of equal groups."""
    chance = 1 / (1 << BITS)
    return (equal / of - chance) / (1 - chance)


def least_equal(threshold: float, deviations: float = 5.0) -> int:
    """Number of equal groups that a pair at the threshold has but for some standard deviations."""
    n, chance = BANDS * ROWS, 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return max(0, int(max(0.0, n * p - deviations * (n * p * (1 - p)) ** 0.5)))


def equal_groups(one: str, two: str) -> Column:
    """Number of equal groups of two packed signatures, in the JVM."""
    fold = f"aggregate(zip_with({one}, {two}, (x, y) -> x ^ y), 0, (n, z) -> n + bit_count(((z | shiftrightunsigned(z, 1)) | shiftrightunsigned((z | shiftrightunsigned(z, 1)), 2)) & {_ONES}L))"
    return F.lit(BANDS * ROWS) - F.expr(fold)


def _nodes(df: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """row, part, seq, id, size, node, buckets, bits, first; buckets and bits only where the task hasn't seen the set."""
    kind = df.schema[key].dataType
    source = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    at_text, at_key = df.columns.index(text), df.columns.index(key)
    schema = T.StructType().add("row", source.schema["row"].dataType).add("part", "long").add("seq", "long").add("id", kind).add("size", "long")
    schema = schema.add("node", "binary").add("buckets", T.ArrayType(T.LongType())).add("bits", T.ArrayType(T.LongType())).add("first", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        seen: set[bytes] = set()
        for batch in batches:
            for a, b in W.slices(batch.column(0).field(at_text), 1 << 20):
                rows = batch.column(0).slice(a, b - a)
                sets = shingles(rows.field(at_text), n)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                new: dict[bytes, int] = {}
                for i, node in enumerate(nodes):
                    if node is not None and node not in seen and node not in new:
                        new[node] = i
                if len(seen) > 200_000:
                    seen.clear()
                seen |= new.keys()
                firsts = [False] * len(sets)
                buckets: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if new:
                    of_buckets, of_bits = signatures([sets[i] for i in new.values()])
                    for k, i in enumerate(new.values()):
                        firsts[i], buckets[i], bits[i] = True, of_buckets[k], of_bits[k]
                columns = [rows, pa.array([part] * len(sets), pa.int64()), pa.array(range(seq, seq + len(sets)), pa.int64()), rows.field(at_key), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary())]
                seq += len(sets)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(buckets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(firsts, pa.bool_())], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def _confirm(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; many a may have one b.

    The pairs of one b are dealt over groups of ``FANS``; in each, b's row comes first and the others stream past it.
    """
    pairs = scratch.table(pairs.select("a", "b"), "near-pairs")
    groups = scratch.table(pairs.groupBy("b").agg(F.ceil(F.count("*") / FANS).cast("int").alias("groups")), "near-groups")
    fans = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), "groups").cast("int").alias("g"), F.lit(1).alias("side"), F.col("a").alias("node"))
    heads = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("side"), F.col("b").alias("node"))
    rows = fans.unionByName(heads).join(bodies, "node").select("b", "g", "side", "node", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(0, np.uint64)
        for batch in batches:
            for a, b in W.slices(batch.column(4)):
                rows = batch.slice(a, b - a)
                keep = []
                for side, two in zip(rows.column(2).to_pylist(), shingles(rows.column(4), n)):
                    if side == 0:
                        one = two
                        keep.append(False)
                        continue
                    common = np.count_nonzero(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two)
                    keep.append(100 * common >= percent * (len(one) + len(two) - common))
                found = rows.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([found.column(3), found.column(0)], ["a", "b"])

    return rows.repartition("b", "g").sortWithinPartitions("b", "g", "side").mapInArrow(run, "a binary, b binary")


BLOCK_ROWS = "k long, g long, side int, node binary, comp binary, bits array<long>, buckets array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (k, g), which lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(k) != 0) | (np.diff(g) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and (held[-1].column(0)[0] != part.column(0)[0] or held[-1].column(1)[0] != part.column(1)[0]):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _alike(block: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of different components with enough equal groups whose first bucket in common is this block's."""
    side = block.column(2).to_numpy()
    comps = block.column(4).dictionary_encode().indices.to_numpy()
    bits, buckets = (block.column(i).flatten().to_numpy().reshape(block.num_rows, -1) for i in (5, 6))
    bits, key = bits.view(np.uint64), block.column(0)[0].as_py()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(two)
    two = one if alone else two
    found_p, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(one), 64):
        rows = one[i : i + 64]
        equal = np.full((len(rows), len(two)), BANDS * ROWS, np.int16)
        for k in range(LONGS):
            z = bits[rows, k, None] ^ bits[None, two, k]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            equal -= np.bitwise_count(z & np.uint64(_ONES)).astype(np.int16)
        good = (equal >= least) & (comps[rows, None] != comps[None, two])
        if alone:
            good &= rows[:, None] < two[None, :]
        p, q = np.nonzero(good)
        p, q = rows[p], two[q]
        first = (buckets[p] == buckets[q]).argmax(axis=1)
        here = buckets[p, first] == key
        found_p.append(p[here])
        found_q.append(q[here])
    return np.concatenate(found_p), np.concatenate(found_q)


def _suspects(members: DataFrame, least: int) -> DataFrame:
    """The rows of blocks that have a partner to be looked at in full; by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            p, q = _alike(block, least)
            if len(p):
                yield block.take(pa.array(np.unique(np.concatenate([p, q]))))

    return members.mapInArrow(run, BLOCK_ROWS)


def _links_inside(suspects: DataFrame, least: int, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each block; suspects: ``BLOCK_ROWS`` and body.

    Every pair that isn't joined by links found before is compared on full sets; a link is given only
    where it joins two components, so a block of m rows gives fewer than m.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            p, q = _alike(block, least)
            if not len(p):
                continue
            sets = shingles(block.column(7), n)
            sizes = np.array([len(x) for x in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            parent = list(range(block.num_rows))
            comps = block.column(4).dictionary_encode().indices.to_numpy()
            names, links = block.column(3).to_pylist(), []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            flag = np.zeros(len(ids), np.int64)
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            edges = np.searchsorted(p, np.unique(p)).tolist()
            for a, b in zip(edges, [*edges[1:], len(p)]):
                x, mine = int(p[a]), comps[p[a]]
                others = np.array([y for y in q[a:b].tolist() if root(comps[y]) != root(mine)], np.int64)
                if not len(others):
                    continue
                own = ids[starts[x] : starts[x] + sizes[x]]
                flag[own] = 1
                common = np.array([flag[ids[starts[y] : starts[y] + sizes[y]]].sum() for y in others.tolist()])
                flag[own] = 0
                for y in others[100 * common >= percent * (sizes[x] + sizes[others] - common)].tolist():
                    if root(comps[y]) != root(mine):
                        parent[root(comps[y])] = root(mine)
                        links.append((max(names[x], names[y]), min(names[x], names[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return suspects.mapInArrow(run, "a binary, b binary")


class Graph:
    """Components found so far: a table of node and label for nodes whose label isn't themselves."""

    def __init__(self, spark) -> None:
        self.spark = spark
        self.labels: DataFrame | None = None
        self.path: str | None = None

    def label(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        known = self.labels.select(F.col("node").alias(column), F.col("label").alias("__label"))
        return df.join(known, column, "left").withColumn(name, F.coalesce("__label", column)).drop("__label")

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs between different components."""
        if self.labels is None:
            return pairs
        both = self.label(self.label(pairs, "a", "ca"), "b", "cb")
        return both.where("ca <> cb").drop("ca", "cb")

    def add(self, links: DataFrame) -> None:
        both = self.label(self.label(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components.labels(both)
        if self.labels is not None:
            old = self.labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("__new")), "label", "left").select("node", F.coalesce("__new", "label").alias("label"))
            merged = old.union(merged)
        self.labels, self.path = scratch.write(merged, "near-labels")


def _dealt(inside: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """``BLOCK_ROWS`` of the buckets (k, node, comp) with several components, dealt to pairs of blocks.

    Blocks of a bucket's largest component (side 0, g < 0) meet each block of the others; those meet one another.
    """
    parts = inside.join(bits.select("node", "at.bytes"), "node").groupBy("k", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = parts.groupBy("k").agg(F.max_by(F.struct("comp", "n", "bytes"), F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps"))
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("int")
    mixed = whole.where("comps > 1").select("k", F.col("big.comp").alias("big"), blocks(F.col("big.n"), F.col("big.bytes")).alias("bigs"), blocks(F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes")).alias("rest"))
    rows = inside.join(scratch.table(mixed, "near-mixed"), "k").join(bits.select("node", "bits", "buckets"), "node")
    is_big = F.col("comp") == F.col("big")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(is_big, F.col("bigs")).otherwise(F.col("rest"))).cast("long"))
    wide, own = 1 << 31, F.col("own")
    meets = lambda big, other: -1 - (big * wide + other)
    place = lambda g, side: F.struct(g.cast("long").alias("g"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    of_big = F.transform(each("rest"), lambda x: place(meets(own, x), F.lit(0)))
    of_rest = F.concat(F.transform(each("rest"), lambda x: place(F.least(own, x) * wide + F.greatest(own, x), own > x)), F.transform(each("bigs"), lambda x: place(meets(x, own), F.lit(1))))
    rows = rows.select("k", F.explode(F.when(is_big, of_big).otherwise(of_rest)).alias("at"), "node", "comp", "bits", "buckets")
    return rows.select("k", "at.g", "at.side", "node", "comp", "bits", "buckets")


def cluster(df: DataFrame, *, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80, block: int = BLOCK, deviations: float = 5.0) -> DataFrame:
    """row (all columns), part, seq, id, size and label (of its component; null for empty sets)."""
    graph = Graph(df.sparkSession)
    with scratch.scope() as keep:
        records, path = scratch.write(_nodes(df, text, key, n), "near-records")
        keep.append(path)
        _link(graph, records, text, n, percent, block, least_equal(percent / 100, deviations))
        keep += [graph.path] if graph.path else []
    return graph.label(records.select("row", "part", "seq", "id", "size", "node"), "node", "label").drop("node")


def _link(graph: Graph, records: DataFrame, text: str, n: int, percent: int, block: int, least: int) -> None:
    """Put all links between the records' nodes into the graph."""
    place = F.struct("part", "seq", F.octet_length(f"row.`{text}`").alias("bytes"))
    nodes = scratch.table(records.where("first").groupBy("node").agg(F.first("buckets").alias("buckets"), F.first("bits").alias("bits"), F.min(place).alias("at")), "near-nodes")
    members = nodes.select("node", F.explode("buckets").alias("k"))
    # what is counted by key is written before it is joined to that key's rows, so a hot key's rows can be split
    several = scratch.table(members.groupBy("k").agg(F.min("node").alias("leader"), F.count("*").alias("m")).where("m > 1"), "near-several")
    shared = scratch.table(members.join(several, "k"), "near-shared")
    bits = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    bits = scratch.table(bits.select("node", "bits", "buckets", "at"), "near-bits")
    star = shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    star = star.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    star = scratch.table(star.select("a", "b", equal_groups("bits_a", "bits_b").alias("equal")).where(F.col("equal") >= least), "near-star")
    # texts of all nodes that share a bucket, from the first row of each
    wanted = bits.select("node", "at.part", "at.seq")
    bodies = scratch.table(records.select("part", "seq", F.col(f"row.`{text}`").alias("body")).join(wanted, ["part", "seq"]).select("node", "body"), "near-bodies")

    def add(links: DataFrame) -> None:
        found = scratch.table(links, "near-links")
        if not found.isEmpty():
            graph.add(found)

    best = star.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b")).select("a", "b")
    add(_confirm(best, bodies, n, percent))
    add(_confirm(graph.across(star.join(best, ["a", "b"], "left_anti").select("a", "b")), bodies, n, percent))
    rows = _dealt(graph.label(shared.where("m > 2").select("k", "node"), "node", "comp"), bits, block)
    suspects = scratch.table(_suspects(rows.repartition("k", "g").sortWithinPartitions("k", "g"), least), "near-suspects")
    add(_links_inside(suspects.join(bodies, "node").select("k", "g", "side", "node", "comp", "bits", "buckets", "body").repartition("k", "g").sortWithinPartitions("k", "g"), least, n, percent))


def dedup(df: DataFrame, *, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80, deviations: float = 5.0) -> DataFrame:
    """One row for each input row: ``key``, n_shingles, component_id, kept."""
    rows = cluster(df, text=text, key=key, n=n, percent=percent, deviations=deviations).select("id", "size", "label")
    least = scratch.table(rows.where("label is not null").groupBy("label").agg(F.min("id").alias("component")), "near-least")
    out = rows.join(least, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.col("id").isNull() & component.isNull()).alias("kept"))


def keep_first(df: DataFrame, *, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80, deviations: float = 5.0) -> DataFrame:
    """All columns of one row of each component, the one with the least id, and of rows without words."""
    rows = cluster(df, text=text, key=key, n=n, percent=percent, deviations=deviations)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("part"), F.col("seq"))
    least = rows.where("label is not null").groupBy("label").agg(F.min(place).alias("at")).select("at.part", "at.seq")
    alone = rows.where("label is null").select("part", "seq")
    return rows.select("row", "part", "seq").join(least.union(alone), ["part", "seq"], "left_semi").select("row.*")
