"""Files that are one JSON object, read by file blocks and written by tasks: no row or task holds a whole file.

A block may begin anywhere, even inside a string. So a first scan counts, for each block and for both
cases (it begins outside or inside a string), quotes, depth and cuts: the signs between members at the
wanted depth. Sums over the blocks before it then say how each block begins. The second scan cuts the
blocks into members; those that cross the end of a block, at most one for each, are put together by
their number in the file. Blocks end at commas, which Spark's text scan finds for any file system.

Members of one key in one object: the last one counts, with `core.last_wins` by `place`. A malformed
file, one that ends early too, fails the query. Files are known by a 64-bit hash of their path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.core import last_wins
from tidewright.sources.tables import fixed_splits, written

_BLOCK = "file long, block long, inside int, quotes long, delta long, cuts map<long,long>, opens map<long,long>"
_BLOCK_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("inside", pa.int32()), ("quotes", pa.int64()), ("delta", pa.int64()), ("cuts", pa.map_(pa.int64(), pa.int64())), ("opens", pa.map_(pa.int64(), pa.int64()))])
_PIECE = "file long, block long, number long, gap long, entry boolean, whole boolean, text binary"
_QUOTE, _COMMA, _OPEN, _CLOSE = 1, 2, 3, 4
_KIND = np.zeros(256, np.int8)
for _sign, _kind in (('"', _QUOTE), (",", _COMMA), ("{", _OPEN), ("[", _OPEN), ("}", _CLOSE), ("]", _CLOSE)):
    _KIND[ord(_sign)] = _kind
_STEP = np.array([0, 0, 0, 1, -1], np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The bytes of each block in turn, in parts, under (file, block); every text gets its comma back."""
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(file)], strict=True):
            if hi > lo:
                texts = batch.column("value").slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                yield (int(file[lo]), int(block[lo])), b",".join(texts) + b","


def _signs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of the signs that aren't escaped, and the quotes up to each."""
    own = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_KIND[own])
    slash = np.flatnonzero(own == ord("\\"))
    if len(slash):
        apart = np.diff(slash) > 1
        start, end = slash[np.append(True, apart)], slash[np.append(apart, True)]
        at = at[~np.isin(at, end[(end - start) % 2 == 0] + 1)]
    kind = _KIND[own[at]]
    return at, kind, np.cumsum(kind == _QUOTE)


def _structure(kind: np.ndarray, quotes: np.ndarray, inside: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which signs stand outside strings; their steps, and the depth after each."""
    out = (kind != _QUOTE) & ((quotes + inside) % 2 == 0)
    step = _STEP[kind[out]]
    return out, step, level + np.cumsum(step)


def _summaries(depth: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, deltas, cuts, opens = None, 0, [0, 0], [{}, {}], [{}, {}]
        rows = lambda: pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "inside": h, "quotes": seen, "delta": deltas[h], "cuts": list(cuts[h].items()), "opens": list(opens[h].items())} for h in (0, 1)], _BLOCK_SCHEMA)
        for key, data in _runs(batches):
            if now is not None and key != now:
                yield rows()
            if key != now:
                now, seen, deltas, cuts, opens = key, 0, [0, 0], [{}, {}], [{}, {}]
            _, kind, quotes = _signs(data)
            for h in (0, 1):
                _, step, after = _structure(kind, quotes, (h + seen) % 2, deltas[h])
                level = after + (step < 0)
                for found, which in ((cuts[h], level <= depth), (opens[h], (level <= depth) & (step > 0))):
                    for at, n in zip(*np.unique(level[which], return_counts=True), strict=True):
                        found[int(at)] = found.get(int(at), 0) + int(n)
                deltas[h] = int(after[-1]) if len(after) else deltas[h]
            seen += int(quotes[-1]) if len(quotes) else 0
        if now is not None:
            yield rows()

    return run


def _pieces(shared, depth: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(texts: list[bytes], numbers, gaps, entries, wholes) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(numbers, pa.int64()), pa.array(gaps, pa.int64()), pa.array(entries, pa.bool_()), pa.array(wholes, pa.bool_()), pa.array(texts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECE.split(", ")])

        now, rest, inside, level, number, gap, whole = None, [], 0, 0, 0, 0, True
        tail = lambda: batch([b"".join(rest)], [number], [gap + (level < depth)], [level >= depth], [False])
        for key, data in _runs(batches):
            if now is not None and key != now:
                yield tail()
            if key != now:
                if key[1] and key not in shared.value:
                    raise ValueError("files are cut into other blocks than before")
                inside, level, number, gap = shared.value[key] if key[1] else (0, 0, 0, 0)
                now, rest, whole = key, [], key[1] == 0
            at, kind, quotes = _signs(data)
            out, step, after = _structure(kind, quotes, inside, level)
            cut = after + (step < 0) == depth
            ends = at[out][cut].tolist()
            if ends:
                texts = [data[a:b] for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True)]
                texts[0] = b"".join([*rest, texts[0]])
                entry = np.append(level >= depth, after[cut][:-1] >= depth)
                opened = gap + np.cumsum(step[cut] > 0)
                gaps = np.append(gap, opened[:-1]) + ~entry
                wholes = np.ones(len(ends), bool)
                wholes[0] = whole
                for lo in range(0, len(ends), 10_000):
                    part = slice(lo, lo + 10_000)
                    yield batch(texts[part], number + np.arange(len(ends))[part], gaps[part], entry[part], wholes[part])
                rest, whole, number, gap = [data[ends[-1] + 1 :]], True, number + len(ends), int(opened[-1])
            else:
                rest.append(data)
            level = int(after[-1]) if len(after) else level
            inside = (inside + (int(quotes[-1]) if len(quotes) else 0)) % 2
        if now is not None:
            yield tail()

    return run


def _starts(raw: DataFrame, depth: int) -> DataFrame:
    """How each block begins: inside (a string), depth, number (of cuts before it) and gap (members' objects opened before it)."""
    over = lambda *by: Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, *by: F.coalesce(F.sum(c).over(over("file", *by)), F.lit(0))
    found = raw.mapInArrow(_summaries(depth), _BLOCK).withColumn("_state", before("quotes", "inside") % 2).filter("inside = _state").withColumn("depth", before("delta"))
    here = lambda c: F.coalesce(F.try_element_at(c, F.lit(depth) - F.col("depth")), F.lit(0))
    counted = found.withColumn("c", here(F.col("cuts"))).withColumn("o", here(F.col("opens")))
    return counted.select("file", "block", "inside", "depth", before("c").alias("number"), before("o").alias("gap"), "quotes", "delta")


def json_members(spark: SparkSession, path: str, kind: str, *, nested: bool = False, parents: list[str] | None = None, arrays: bool = False) -> DataFrame:
    """key, value of the members of files that are one JSON object; place (file, number) orders them.

    nested reads one level deeper and adds `parent`, the key that the members' object has (the last of
    that name in a file): all of them or only `parents`. arrays: these are arrays; their elements have no
    key. kind is the type of a value.

    Of the blocks' beginnings only those of later blocks of a file go to the driver and are broadcast: one
    of some hundred bytes for each spark.sql.files.maxPartitionBytes of input, whatever the members.
    """
    if arrays and not nested:
        raise ValueError("elements of arrays are nested members")
    depth = 2 if nested else 1
    fixed_splits(spark)
    raw = spark.read.text(path, lineSep=",").select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = written(_starts(raw, depth), "starts")
    if starts.groupBy("file").agg(F.sum("quotes").alias("q"), F.sum("delta").alias("d")).filter("q % 2 <> 0 or d <> 0").limit(1).count():
        raise ValueError(f"not whole JSON objects: {path}")
    later = {(r.file, r.block): (r.inside, r.depth, r.number, r.gap) for r in starts.filter("block > 0").collect()}
    pieces = raw.mapInArrow(_pieces(spark.sparkContext.broadcast(later), depth), _PIECE)
    crossing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))), lambda x: x["text"]), "")
    edges = pieces.filter("not (whole and entry)" if nested else "entry and not whole")
    edges = written(edges.groupBy("file", "number").agg(F.first("gap").alias("gap"), F.first("entry").alias("entry"), crossing.alias("text")), "edges")
    same = ["file", "number", "gap", "text"]
    members = pieces.filter("whole and entry").withColumn("text", F.col("text").cast("string")).select(*same).unionByName(edges.filter("entry").select(*same)).filter(F.trim("text") != "")
    place = F.struct("file", "number").alias("place")
    if nested:
        quoted = F.regexp_extract("text", r'(?s)("(?:[^"\\]++|\\.)*+")\s*:\s*$', 1)
        own = edges.filter("not entry").select("file", "gap", F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), F.lit(0)).alias("parent")).filter("parent is not null")
        own = last_wins(own, ["file", "parent"], "gap")
        members = members.join(own.filter(F.col("parent").isin(parents)) if parents is not None else own, ["file", "gap"])
    kept = ["parent"] if nested else []
    if arrays:
        return members.select(*kept, place, F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<{kind}>", {"mode": "FAILFAST"}), F.lit(0)).alias("value"))
    return members.select(*kept, place, F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{kind}>", {"mode": "FAILFAST"})))


def member(key: Column, value: Column) -> Column:
    """A member as JSON text."""
    whole = F.to_json(F.create_map(key, value))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _written(nested: bool, arrays: bool) -> callable:
    begin, end = ("[", "]") if arrays else ("{", "}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, first = None, True
        for batch in batches:
            lines = []
            names = batch.column("parent").to_pylist() if nested else [None] * len(batch)
            for name, text in zip(names, batch.column("member").to_pylist(), strict=True):
                if first or name != parent:
                    lines.append(("{" if first else f"{end},") + (f"{name}:{begin}" if nested else "") + text)
                else:
                    lines.append("," + text)
                parent, first = name, False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([end + "}" if nested else "}"])], ["value"])

    return run


def write_objects(rows: DataFrame, path: str, *, nested: bool = False, arrays: bool = False) -> None:
    """Column `member` (JSON text of a member, or of an element) as a folder of files, each one JSON object with the rows of a task, written as they come.

    nested: members stand in the object, or array, of their key in column `parent` (no nulls). Without rows there is no object.
    """
    if nested:
        rows = rows.select(F.regexp_extract(F.to_json(F.array("parent")), r"(?s)^\[(.*)\]$", 1).alias("parent"), "member").sortWithinPartitions("parent")
    rows.mapInArrow(_written(nested, arrays), "value string").write.text(path)
