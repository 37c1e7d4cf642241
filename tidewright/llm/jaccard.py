"""Exact N-gram Jaccard join by Voronoi regions, triangle-inequality windows and in-region recursion.

Distance is 1 - Jaccard similarity of word-shingle sets, a metric; documents link at distance
1 - threshold or less. Documents with equal sets are one node from the start.

Regions. Unrelated documents all lie at distance 1 from any document, so whole documents make no
useful top-level pivots: every window would hold everything. The pivots of the first level are
therefore single shingles, ordered from rare to frequent. A node belongs to the region of its first
pivot, and the window that replicates it into further regions follows from the bound on what two
linked sets may not share: a set of n shingles misses at most n - ceil(threshold * n) of its own in
any partner, so linked nodes meet in the region of one of their first n - ceil(threshold * n) + 1
pivots. How far along its order a node's pivot stands also bounds the sizes of partners that it can
meet there first (`window`), so members without a possible partner leave the region. The order comes from counts over all documents in a hashed table of fixed size; any order is
exact, a good one keeps frequent shingles (shared passages) out of the windows.

Inside a region the pivots are documents. A pivot's distances to all members are worked out; members
within the link distance form its core (one component, no pairs among them are looked at). By the
triangle inequality two members link only if their distances to the pivot differ by the link
distance at most, so the rest meets only the core's boundary, and falls into parts wherever the
distances leave a wider gap; each part is joined recursively around a new pivot, and at last, where
a pivot no longer divides it, by counting common shingles of all its members at once. Regions that
have the same first pivot document are joined as one.

Regions of more than `region` members are divided in Spark by the same rule, round after round: all
members meet their region's pivot in a join (the pivot's side salted, so no task has a region's
members), the core is linked and left, and what remains is dealt into rings as wide as the link
distance by distance from the pivot, each member into its own ring and the next, so that any two
that may link share a ring. Rings are regions of the next round. Where a round leaves more than half
of a region's members in a ring (many unrelated documents that share frequent passages), the ring
is dealt as pairs of blocks instead, so one task never holds more than `region` members; only links
that join two components are given out.

Shuffles. Node and pivot hashes travel in packed arrays, one row per batch and target partition.
Nodes that share a region with another are first compared by sketches (bitmaps that bound how much
two sets can share, about a thirtieth of a set's size); sets are built from the text and sent only
for nodes that are left, in the regions where they are left. Components
are found by large-star and small-star steps over the links, in Spark, each step written to the
shared folder; nothing that grows with the documents comes to the driver. What is still one task's:
the 22-byte entries of one pivot shingle, distinct sets only, while its region is formed.

Edge cases: null, empty or blank text has an empty set, no links and itself as component; fewer
words than a shingle make one shingle; repeated rows are rows like others (equal texts link); a null
id is the largest: rows without one link like others, and their component is null where no row in it
has an id; ties between pivots of equal rank are broken by hash; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.bitmap import among, bitmap
from tidewright.llm.spark_io import id_and_text, kept
from tidewright.llm.text import SPACED, Words, fold, mix, slices, trim, words

#: Words of a shingle; link at `percent` hundredths of similarity or more.
SHINGLE, PERCENT = 5, 75
#: Counters of the table that orders pivots; entries aimed at per join partition; largest region held at once.
COUNTERS, ENTRIES, REGION = 1 << 22, 700_000, 2048
_PARTS, _UNIT, _SKETCHED, _SALTS = 64, 16384, 128, 16
_PACKED = ("pivots", "nodes", "sizes", "reaches")


def shingle_sets(w: Words, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    n = len(w.hash)
    joined = fold([w.hash[i : n - shingle + 1 + i] for i in range(shingle)]) if n >= shingle else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        if b - a >= shingle:
            s = np.sort(joined[a : b - shingle + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(fold([w.hash[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A hash of the whole set: the sum of its members' mixed hashes, mixed with the size."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def _measure(shingle: int) -> callable:
    """Rows of documents (part -1: doc_id, key, n_shingles, node) and, last, of the task's counter table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.uint32)
        names = ["part", "doc_id", "key", "n_shingles", "node", "counts"]
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(words(part.column("text"), SPACED), shingle)
                every = np.concatenate(sets)
                np.add.at(table, (every >> np.uint64(42)).astype(np.int64), np.uint32(1))  # bincount would make two more tables
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, -1, np.int32)), part.column("doc_id"), part.column("key"), pa.array(np.array(list(map(len, sets)), np.int64)), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.binary())], names
                )
        if table.any():
            blocks = table.reshape(_PARTS, -1)
            none = pa.nulls(_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), none, none, none, none, pa.array([_packed(b) for b in blocks], pa.binary())], names)

    return run


def _packed(block: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs."""
    most = int(block.max())
    return block.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unpacked(data) -> np.ndarray:
    own = np.frombuffer(data, np.uint8)
    return own.view({1: np.uint8, 2: np.uint16, 4: np.uint32}[len(own) * _PARTS // COUNTERS]).astype(np.int64)


def _add_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counter blocks by part, as far as they meet in one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            own = _unpacked(c.as_buffer())
            sums[p] = sums[p] + own if p in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(np.minimum(x, (1 << 32) - 1)) for x in sums.values()], pa.binary())], ["part", "counts"])


def pivot_ranks(counts: np.ndarray) -> np.ndarray:
    """Counters as small ranks: steps of a quarter of a power of two above the mean load, 0 below twice it."""
    load = max(1.0, counts.sum() / len(counts))
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts, 1) / (2 * load))), 0, 255).astype(np.uint8)


def window(s: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first pivots of a set, as many as a linked set may miss and one more, with their reaches.

    Two sets of sizes a and b link only if they share t (a + b) of their shingles, t = p / (1 + p). If
    the i-th pivot of one is the first that they share, they share at most a - i, so the other's
    size is at most (a - i) / t - a: the pivot's reach, given here as a share of a, rounded up.
    """
    n = len(s)
    keep = n - -(-percent * n // 100) + 1
    key = (ranks[(s >> np.uint64(42)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(s) >> np.uint64(8))
    if keep < n:
        inside = key <= np.partition(key, keep - 1)[keep - 1]
        s, key = s[inside], key[inside]
    order = np.argsort(key)
    at = np.searchsorted(key[order], key[order])  # equal keys have the place of the first
    reach = (n - at) * (100 + percent) / percent / n - 1
    return s[order], np.minimum(np.ceil(reach * _UNIT) + 1, 65535).astype(np.uint16)


def _deal(shared, shingle: int, percent: int, parts: int) -> callable:
    """Packed pivots, nodes, sizes and reaches by target partition; a task sends a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        count = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
            target = (columns[0] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            bound = np.searchsorted(target[order], np.arange(parts + 1))
            columns = [x[order] for x in columns]
            some = np.flatnonzero(np.diff(bound))
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *(pa.array([x[bound[p] : bound[p + 1]].tobytes() for p in some], pa.binary()) for x in columns)], ["part", *_PACKED]
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(words(part.column("text"), SPACED), shingle):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) < 200_000:  # a memo against copies; more are sent and found equal later
                            seen.add(node)
                        own, reach = window(s, ranks, percent)
                        held.append((own, np.full(len(own), node, np.int64), np.full(len(own), len(s), np.uint32), reach))
                        count += len(own)
                if count > 500_000:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def _possible(size: np.ndarray, reach: np.ndarray, percent: int) -> np.ndarray:
    """Which members of one region can have a link whose first common pivot is the region's."""
    most = np.minimum(reach, size * 100.0 / percent)
    fits = (size[None, :] <= most[:, None] + 1e-6) & (size[:, None] <= most[None, :] + 1e-6)
    np.fill_diagonal(fits, False)
    return fits.any(1)


def _regions(percent: int) -> callable:
    """Rows (lead, node): members of regions, as far as they can have links there, named by one of them.

    The lead is the node that most tasks sent (copies), then the smallest, so that the many nearly
    equal regions of one group of near copies mostly have the same lead and become one region.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for out, name, kind in zip(parts, _PACKED, (np.uint64, np.int64, np.uint32, np.uint16), strict=True):
                out += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]
        if not parts[0]:
            return
        pivot, node, size, reach = map(np.concatenate, parts)
        del parts
        order = np.argsort(pivot, kind="stable")
        pivot = pivot[order]
        twice = np.zeros(len(pivot), bool)
        twice[1:] = pivot[1:] == pivot[:-1]
        twice[:-1] |= twice[1:]
        pivot, order = pivot[twice], order[twice]
        node, size, reach = node[order], size[order].astype(np.float64), reach[order]
        if not len(pivot):
            return
        order = np.lexsort((node, pivot))
        pivot, node, size, reach = pivot[order], node[order], size[order], reach[order] * size[order] / _UNIT
        at = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (node[1:] != node[:-1])))
        weight = np.diff(np.append(at, len(pivot)))
        pivot, node, size, reach = pivot[at], node[at], size[at], reach[at]
        begin = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
        count = np.diff(np.append(begin, len(pivot)))
        keep = np.zeros(len(pivot), bool)
        two = begin[count == 2]
        most = np.minimum(reach, size * 100.0 / percent) + 1e-6
        fits = (size[two] <= most[two + 1]) & (size[two + 1] <= most[two])
        keep[two[fits]] = keep[two[fits] + 1] = True
        for a, n in zip(begin[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            keep[a : a + n] = _possible(size[a : a + n], reach[a : a + n], percent) if n <= 1024 else True
        pivot, node, weight = pivot[keep], node[keep], weight[keep]
        if not len(pivot):
            return
        begin = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
        count = np.diff(np.append(begin, len(pivot)))
        best = node[np.lexsort((node, -weight, np.repeat(np.arange(len(begin)), count)))[begin]]
        lead = np.repeat(best, count)
        order = np.lexsort((node, lead))
        lead, node = lead[order], node[order]
        first = np.append(True, (lead[1:] != lead[:-1]) | (node[1:] != node[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(lead[first]), pa.array(node[first])], ["lead", "node"])
        del pivot, node, size, reach, order, lead, first
        trim()

    return run


def dealt_blocks(members: DataFrame, region: int) -> DataFrame:
    """lead, i, j, node: regions of more than `region` members as pairs of blocks, the others as one block."""
    large = members.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") > region).select("lead", F.ceil(2 * F.col("n") / region).cast("int").alias("blocks"))
    own = members.join(large, "lead", "left").withColumn("h", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.expr("if(blocks is null, array(struct(0 as i, 0 as j)), transform(filter(sequence(0, blocks - 1), o -> o <> h), o -> struct(least(h, o) as i, greatest(h, o) as j)))")
    return own.select("lead", "node", F.inline(pairs))


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of the set's low hash bits, with two to four bits for each member."""
    size = max(8, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap as one of fewer bytes: halves laid over each other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _texts(shared, shingle: int, whole: bool) -> callable:
    """Node and set (or sketch) of documents whose key may be wanted, by a bitmap; copies mostly once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            own = batch.filter(among(shared.value, batch.column("key")))
            for part in slices(own, "text"):
                sets = shingle_sets(words(part.column("text"), SPACED), shingle)
                named = [(k, node_of(s)) if len(s) else None for k, s in zip(part.column("key").to_pylist(), sets, strict=True)]
                fresh = []
                for i, x in enumerate(named):
                    if x is not None and x not in seen:
                        fresh.append(i)
                        if len(seen) < 200_000:
                            seen.add(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named[i][0] for i in fresh], pa.int64()), pa.array([named[i][1] for i in fresh], pa.int64()), pa.array([sets[i].tobytes() if whole else sketch(sets[i]) for i in fresh], pa.binary())], ["key", "node", "members"]
                )

    return run


def _wanted(source: DataFrame, nodes: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """node, n_shingles and set (or sketch) of the given nodes, built from one document of each."""
    shared = source.sparkSession.sparkContext.broadcast(bitmap(nodes, "key", nodes.count()))
    return source.mapInArrow(_texts(shared, shingle, whole), "key long, node long, members binary").join(nodes, ["node", "key"]).select("node", "n_shingles", "members")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows with equal (lead, i, j), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "i", "j")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = tuple(key[:, a].tolist())
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _distances(percent: int) -> callable:
    """(lead, node, near, d) of members (lead, node, members) that stand beside their region's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("members"), batch.column("pivot"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                union = len(a) + len(b) - common
                near[i], far[i] = 100 * common >= percent * union, 1 - common / union
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("node"), pa.array(near), pa.array(far)], ["lead", "node", "near", "d"])

    return run


def _none(spark: SparkSession, *columns: str) -> DataFrame:
    """No rows of whole numbers; rows made on the driver would start a second set of Python workers on each executor."""
    return spark.range(0).select(*[F.col("id").alias(c) for c in columns])


def divided(members: DataFrame, sets_of, region: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, regions, stubborn): what large regions come to when they are divided around pivots.

    members (lead, node): regions of more than `region` members, each with its lead; sets_of gives
    node, n_shingles and members of the nodes of a frame. regions and stubborn (lead, node) are what is left:
    regions of at most `region` members, and larger ones that pivots don't divide.
    """
    reach, spark = 1 - percent / 100, members.sparkSession
    links, small, stubborn = _none(spark, "a", "b"), _none(spark, "lead", "node"), _none(spark, "lead", "node")
    now, sets = members, kept(sets_of(members.select("node").distinct()).select("node", "members"), "sets")
    while True:
        salted = now.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)))
        pivots = now.groupBy("lead").agg(F.count("*").alias("before")).join(sets.select(F.col("node").alias("lead"), F.col("members").alias("pivot")), "lead")
        beside = salted.join(pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["lead", "salt"])
        seen = kept(beside.select("lead", "node", "members", "pivot").mapInArrow(_distances(percent), "lead long, node long, near boolean, d double"), "distances")
        links = links.unionByName(seen.filter("near and lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")))
        edge = seen.groupBy("lead").agg(F.min(F.when(~F.col("near"), F.col("d"))).alias("first"), F.count("*").alias("before"))
        left = seen.join(edge.filter("first is not null"), "lead").filter((F.col("node") != F.col("lead")) & (~F.col("near") | (F.col("d") >= F.col("first") - reach - 1e-9)))
        ring = F.floor(F.col("d") / (reach + 1e-9))
        rings = left.select("lead", "node", "d", "near", "before", F.explode(F.array(ring, ring + 1)).alias("ring"))
        # A ring's pivot is its member nearest to the ring's middle that isn't in the core, so that it divides.
        named = rings.groupBy("lead", "ring").agg(F.count("*").alias("n"), F.max("before").alias("before"), F.max_by("node", F.struct(~F.col("near"), -F.abs(F.col("d") - F.col("ring") * reach), "node")).alias("next"), F.count_if(~F.col("near")).alias("out")).filter("n > 1 and out > 0")
        dealt = kept(rings.select("lead", "node", "ring").join(named.drop("before").join(edge.select("lead", "before"), "lead"), ["lead", "ring"]).select(F.xxhash64("lead", "ring", "next").alias("id"), "next", "node", "n", "before"), "rings")
        small = small.unionByName(dealt.filter(F.col("n") <= region).select(F.col("id").alias("lead"), "node"))
        stubborn = stubborn.unionByName(dealt.filter((F.col("n") > region) & (2 * F.col("n") > F.col("before"))).select(F.col("id").alias("lead"), "node"))
        # Rings with the same next pivot are joined as one region.
        now = dealt.filter((F.col("n") > region) & (2 * F.col("n") <= F.col("before"))).select(F.col("next").alias("lead"), "node").distinct()
        if now.isEmpty():
            return links, small, stubborn


def _by_region(rows: DataFrame) -> DataFrame:
    return rows.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")


def _prune(percent: int) -> callable:
    """Drops members that, by their sketches, can't link with any other of a small region.

    A bit of x that y lacks stands for a member of x that y lacks: |x and y| <= |x| - such bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            n = table.num_rows
            keep = np.ones(n, bool)
            if n <= _SKETCHED:
                sizes = table.column("n_shingles").to_numpy()
                maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("members")]
                keep[:] = False
                for x in range(n):
                    for y in range(x):
                        if keep[x] and keep[y] or 100 * min(sizes[x], sizes[y]) < percent * max(sizes[x], sizes[y]):
                            continue
                        size = min(len(maps[x]), len(maps[y]))
                        a, b = folded(maps[x], size), folded(maps[y], size)
                        most = min(sizes[x] - np.bitwise_count(a & ~b).sum(dtype=np.int64), sizes[y] - np.bitwise_count(b & ~a).sum(dtype=np.int64))
                        if (100 + percent) * most >= percent * (sizes[x] + sizes[y]):
                            keep[x] = keep[y] = True
            if keep.any():
                yield from table.select(["lead", "i", "j", "node"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def region_links(nodes: np.ndarray, sets: list[np.ndarray], lead: int, percent: int) -> list[tuple[int, int]]:
    """Links (places in nodes) that join whatever is joined by links in this region."""
    n = len(nodes)
    size = np.array(list(map(len, sets)))
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ptr = np.append(0, np.cumsum(size))
    root = np.arange(n)
    links: list[tuple[int, int]] = []
    reach = 1 - percent / 100 + 1e-9

    def unite(a: int, b: int) -> None:
        if root[a] != root[b]:
            links.append((a, b))
            root[root == root[b]] = root[a]

    def tokens(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle numbers of some members and their owners (places in own)."""
        at = np.repeat(ptr[own] - np.append(0, np.cumsum(size[own])[:-1]), size[own]) + np.arange(size[own].sum())
        return inverse[at], np.repeat(np.arange(len(own)), size[own])

    first = np.flatnonzero(nodes == lead)
    todo = [(np.arange(n), int(first[0]) if len(first) else 0)]
    while todo:
        own, pivot = todo.pop()
        if len(own) < 2 or len(np.unique(root[own])) == 1:
            continue
        inside = np.zeros(len(values), bool)
        inside[inverse[ptr[pivot] : ptr[pivot + 1]]] = True
        token, owner = tokens(own)
        common = np.bincount(owner, inside[token], minlength=len(own)).astype(np.int64)
        union = size[own] + size[pivot] - common
        near = 100 * common >= percent * union
        for k in own[near].tolist():
            unite(pivot, k)
        if near.all():
            continue
        d = 1 - common / union
        edge = near & (d >= d[~near].min() - reach) & (own != pivot)
        left = own[edge | ~near]
        order = np.argsort(d[edge | ~near], kind="stable")
        parts = np.split(left[order], np.flatnonzero(np.diff(d[edge | ~near][order]) > reach) + 1)
        for part in parts:
            if len(part) <= len(own) // 2 and len(part) > 32:
                todo.append((part, int(part[-1])))
            elif len(part) > 1:
                for a, b in zip(*_all_near(*tokens(part), size[part], percent), strict=True):
                    unite(int(part[a]), int(part[b]))
    return links


def _all_near(token: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the link distance among a part's members, from counts of common shingles."""
    n = len(size)
    _, token, count = np.unique(token, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    owner, begin = owner[order], np.append(0, np.cumsum(count))
    for c in range(2, 9):  # shingles of few members: their pairs one by one
        at = begin[:-1][count == c]
        for i in range(c):
            for j in range(i):
                np.add.at(common, (owner[at + i], owner[at + j]), 1)
    many = np.flatnonzero(count > 8)
    for lo in range(0, len(many), 2048):  # the others: products of membership matrices
        own = many[lo : lo + 2048]
        m = np.zeros((n, len(own)), np.float32)
        for k, t in enumerate(own.tolist()):
            m[owner[begin[t] : begin[t + 1]], k] = 1
        common += np.tril(m @ m.T, -1)
    common += common.T
    a, b = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1))
    return a, b


def _join(percent: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
            members = table.column("members")
            sets = [np.frombuffer(members[int(i)].as_buffer(), np.uint64) for i in first]
            if found := region_links(nodes, sets, table.column("lead")[0].as_py(), percent):
                yield pa.RecordBatch.from_arrays([pa.array([int(nodes[min(x)]) for x in found], pa.int64()), pa.array([int(nodes[max(x)]) for x in found], pa.int64())], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component, which is its own) for all nodes of links (a, b).

    Large-star and small-star steps until nothing changes; each step is a group-by with map-side
    minima and a join on the grouped node, so a node with very many links is no single task's group.
    """
    spark = links.sparkSession
    edges = kept(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
        edges = kept(large.distinct(), "large")
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = kept(small.distinct(), "small")
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before or n == 0:
            break
        before = (n, total)
    found = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def join(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, region: int = REGION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    # Sets are built again from one row of each node, found by its key: the id, or the text's hash where there is none.
    source = id_and_text(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    measured = kept(source.mapInArrow(_measure(shingle), "part int, doc_id long, key long, n_shingles long, node long, counts binary"), "measured")
    meta = measured.filter("part = -1").select("doc_id", "key", "n_shingles", "node")
    table = np.zeros(COUNTERS, np.int64).reshape(_PARTS, -1)
    for r in measured.filter("part >= 0").select("part", "counts").mapInArrow(_add_tables, "part int, counts binary").repartition("part").mapInArrow(_add_tables, "part int, counts binary").collect():
        table[r.part] += _unpacked(r.counts)
    ranks = spark.sparkContext.broadcast(pivot_ranks(table.reshape(-1)))
    entries = meta.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1)).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // ENTRIES))
    dealt = source.select("text").mapInArrow(_deal(ranks, shingle, percent, parts), "part int, pivots binary, nodes binary, sizes binary, reaches binary").repartition(parts, "part")
    members = kept(dealt.mapInArrow(_regions(percent), "lead long, node long").distinct(), "members")

    nodes = meta.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.min("n_shingles").alias("n_shingles"))
    keyed = nodes.select("node", "key", "n_shingles")
    large = members.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") > region).select("lead")
    sketches = _wanted(source, kept(members.select("node").distinct().join(keyed, "node"), "wanted"), shingle, False)
    links = _none(spark, "a", "b")
    if not large.isEmpty():
        sets_of = lambda some: _wanted(source, kept(some.join(keyed, "node"), "wanted"), shingle, True)
        links, divided_up, stubborn = divided(members.join(large, "lead", "left_semi"), sets_of, region, percent)
        members = members.join(large, "lead", "left_anti").unionByName(divided_up).unionByName(stubborn)
    left = kept(_by_region(dealt_blocks(members, region).join(sketches, "node")).mapInArrow(_prune(percent), "lead long, i int, j int, node long"), "left")
    sets = _wanted(source, kept(left.select("node").distinct().join(keyed, "node"), "wanted"), shingle, True)
    inside = _by_region(left.join(sets, "node").select("lead", "i", "j", "node", "members")).mapInArrow(_join(percent), "a long, b long")
    found = components(links.unionByName(inside))

    # Only linked nodes have a root other than themselves; the roots' side is salted, so a large component is no task's group.
    linked = nodes.select("node", "doc_id").join(found, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)))
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    by_root = linked.join(smallest, ["root", "salt"]).select("node", F.col("component_id").alias("linked_id"))
    by_node = nodes.select("node", F.col("doc_id").alias("same_id")).join(by_root, "node", "left").select("node", F.coalesce("linked_id", "same_id").alias("component_id"))
    # Written, so that both sides of the join are plain shuffles, of which Spark splits the partition of a text with very many copies.
    by_node = kept(by_node, "by_node")
    some = meta.filter("node is not null").join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(meta.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
