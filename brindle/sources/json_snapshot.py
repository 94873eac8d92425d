"""JSON snapshots of any size: one document, read in byte ranges by many tasks and written in ordered parts.

The text source cuts a file at ``}``, wherever a split begins. A first pass sums up each split for both cases, that it begins inside a string or not; the driver
chains those few sums; a second pass knows in which state each split begins and hands out whole elements, by number. Only an element that two
splits share is put together afterwards. Tasks look at the bytes of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.lenient_json import BadJson, parse
from brindle.functions.text import kind_name
from brindle.model import SNAPSHOT_VERSION
from brindle.sources.log import LogError as SnapshotError
from brindle.sources.shared import Store

_BACKSLASH, _LEFT, _RIGHT = b"\\{}"
#: What a character adds to the depth; those that a scan looks at; those that may stand between elements.
_STEP, _SEEN, _BLANK = np.zeros(256, np.int8), np.zeros(256, bool), np.zeros(256, bool)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_SEEN[list(b'{}[]"')] = _BLANK[list(b" \t\r\n,")] = True
#: Elements are the objects at this depth: in an array (or an object) of the document.
DEPTH = 2
#: Rows of a part, about: parts are read by tasks of their own.
PART_ROWS = 50_000


def _scan(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | bool, np.ndarray]:
    """Positions of quotes and brackets with their steps (quotes: 0), and what tells those inside strings, wherever the text begins: behind each it is
    ``(set | inside) ^ odd``. A quote behind an odd number of backslashes opens a string outside of one and is a character inside: inside it is, either way."""
    at = np.flatnonzero(_SEEN[text])
    step = _STEP[text[at]]
    turns, fixed = step == 0, False
    back = np.flatnonzero(text == _BACKSLASH)
    if back.size:
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        many = np.diff(first, append=back.size)
        escaped = turns & np.isin(at, (back[first] + many)[many % 2 == 1])
        turns &= ~escaped
    odd = np.cumsum(turns)
    if back.size and escaped.any():
        last = np.maximum.accumulate(np.where(escaped, np.arange(at.size), -1))
        fixed = last >= 0
        odd -= np.where(fixed, odd[last], 0)
    return at, step, fixed, odd % 2 == 1


def _outside(scan: tuple, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions and steps of the brackets outside of strings, where the text begins ``inside`` one or not; whether its end is inside."""
    at, step, fixed, odd = scan
    within = (fixed | inside) ^ odd
    kept = (step != 0) & ~within
    return at[kept], step[kept], bool(within[-1]) if at.size else inside


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = {"path": "file_path", "block": "file_block_start", "length": "file_block_length", "size": "file_size"}
    return spark.read.option("lineSep", "}").text(path).select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, int, bool, bool]]:
    """(path and block, bytes of pieces with their braces, size of the file, whether the split ends, whether the file does) for the rows of a split in each batch.
    The last piece of a file has a brace here, too: it may have had none."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        path, (block, length, size) = b.column("path").dictionary_encode(), (b.column(c).to_numpy() for c in ("block", "length", "size"))
        new = np.flatnonzero((np.diff(path.indices.to_numpy()) != 0) | (np.diff(block) != 0)) + 1
        for i, upto in pairwise((0, *new.tolist(), b.num_rows)):
            key = path[i].as_py(), int(block[i])
            if held:
                yield *held[:3], key != held[0], key != held[0] and held[3]
            values = b.column("value").slice(i, upto - i)
            n = pc.sum(pc.binary_length(values)).as_py() + len(values)
            text = np.frombuffer(pc.binary_join_element_wise(values, "}", "").buffers()[2], np.uint8, n)
            held = key, text, int(size[i]), bool(block[i] + length[i] >= size[i])
    if held:
        yield *held[:3], True, held[3]


def _strings(text: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(text))


_ROWS = {"path": pa.string(), "block": pa.int64(), "row": pa.int64(), "nth": pa.int64(), "text": pa.string()}
WHOLE, PART, BETWEEN = 0, 1, 2


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """``(nth, text)`` of all elements of a document (a file, or a folder of parts in order of their names), and the document itself, where a run of elements is
    the number of its first. Top keys hold scalars, objects, or arrays of scalars and objects. Sums of splits and what stands between elements reach the driver, elements do not.
    """

    def sums(batches):
        """Of each split, for both cases: end state, change of depth, and each relative depth behind a closing brace with the number of times it is reached, flat."""
        total = None
        for (path, block), text, size, ended, bare in _runs(batches):
            total, ends, depths, seen = total or (0, [False, True], [0, 0], [{}, {}])
            total += len(text)
            found = _scan(text[: len(text) - bare])
            for k in (0, 1):
                at, step, ends[k] = _outside(found, ends[k])
                depth = depths[k] + np.cumsum(step, dtype=np.int64)
                for d, n in zip(*(x.tolist() for x in np.unique(depth[text[at] == _RIGHT], return_counts=True)), strict=True):
                    seen[k][d] = seen[k].get(d, 0) + n
                depths[k] = int(depth[-1]) if depth.size else depths[k]
            if ended:
                row = {"path": path, "block": block, "bytes": total, "size": size}
                for k in (0, 1):
                    row |= {f"end{k}": ends[k], f"depth{k}": depths[k], f"seen{k}": [x for item in sorted(seen[k].items()) for x in item]}
                yield pa.RecordBatch.from_pylist([row], schema=sums_schema)
                total = None
            else:
                total = total, ends, depths, seen

    sums_schema = pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in ("path", "block", "bytes", "size")] + [(f"{n}{k}", t) for k in (0, 1) for n, t in (("end", pa.bool_()), ("depth", pa.int64()), ("seen", pa.list_(pa.int64())))])
    rows = _pieces(spark, path)
    # a row for each split: sorted here, as a sort in Spark reads its input twice
    splits = sorted(rows.mapInArrow(sums, ", ".join(["path string, block long, bytes long, size long"] + [f"end{k} boolean, depth{k} long, seen{k} array<long>" for k in (0, 1)])).collect(), key=lambda r: (r["path"], r["block"]))
    sizes = {r["path"]: r["size"] for r in splits}
    read: dict[str, int] = {}
    for r in splits:
        read[r["path"]] = read.get(r["path"], 0) + r["bytes"]
    # with a brace for each piece there is one byte too many, if the last piece had none
    braced = {p for p, n in read.items() if n <= sizes[p]}
    begin, inside, depth, total = {}, False, 0, 0
    for r, after in zip(splits, [*splits[1:], None], strict=True):
        begin[r["path"], r["block"]] = (inside, depth, total)
        k = int(inside)
        total += sum(n for at, n in zip(r[f"seen{k}"][::2], r[f"seen{k}"][1::2], strict=True) if at + depth == DEPTH)
        inside, depth = r[f"end{k}"], depth + r[f"depth{k}"]
        if r["path"] in braced and (after is None or after["path"] != r["path"]) and not inside:
            depth -= 1
            total += depth == DEPTH

    def found(batches):
        """(path, block, row, kind, number of the first, texts, their lengths) in order: whole elements many at once, others singly."""
        state = None
        for key, text, _, ended, bare in _runs(batches):
            if state is None:
                within, deep, nth = begin[key]
                here = begun = deep > DEPTH
                held, row = [], 0
            if bare and key[0] not in braced:
                text = text[:-1]
            at, step, within = _outside(_scan(text), within)
            depth = deep + np.cumsum(step, dtype=np.int64)
            deep = int(depth[-1]) if depth.size else deep
            char = text[at]
            opens = (char == _LEFT) & (depth == DEPTH + 1)
            turns = opens | ((char == _RIGHT) & (depth == DEPTH))
            at, opens = at[turns], opens[turns]
            turns = opens != np.concatenate(([here], opens[:-1])) if at.size else opens
            start, stop = at[turns & opens], at[turns & ~opens] + 1
            got, since = [], 0
            if here and stop.size:
                since = int(stop[0])
                got.append((PART if begun else WHOLE, nth, np.concatenate((*held, text[:since]))))
                held, here, begun, nth, stop = [], False, False, nth + 1, stop[1:]
            if here:
                held.append(text)
            else:
                n = len(stop)
                edge = np.zeros(len(text) + 1, np.int8)
                edge[start] += 1
                edge[stop] -= 1
                own = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
                if n:
                    a, z = start[0], stop[-1]
                    yield *key, row, WHOLE, nth, text[a:z][own[a:z]], stop - start[:n]
                other = since + np.flatnonzero(~own[since:] & ~_BLANK[text[since:]])
                if other.size:  # more than the commas of a list or the line end of a part
                    begins, upto = np.concatenate(([since], stop)), [*start.tolist(), len(text)]
                    got += [(BETWEEN, nth + i, text[begins[i] : upto[i]]) for i in np.unique(np.searchsorted(begins, other, "right") - 1).tolist()]
                nth += n
                if len(start) > n:
                    held, here = [text[start[n] :]], True
            if ended and held:
                got.append((PART, nth, np.concatenate(held)))
            for kind, number, own in got:
                yield *key, row, kind, number, own, np.array([len(own)])
                row += 1
            state = None if ended else key

    def whole(batches):
        for _, _, _, kind, nth, text, lengths in found(batches):
            if kind == WHOLE:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(nth, nth + len(lengths))), _strings(text, lengths)], ["nth", "text"])

    def single(wanted):
        def rest(batches):
            for path, block, row, kind, nth, text, _ in found(batches):
                if kind == wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, block, row, nth, text.tobytes().decode()), _ROWS.values(), strict=True)], list(_ROWS))

        return rows.mapInArrow(rest, "path string, block long, row long, nth long, text string")

    between = [(r["nth"], r["text"]) for r in sorted(single(BETWEEN).collect(), key=lambda r: (r["path"], r["block"], r["row"]))]
    after = [n for n, _ in between[1:]] + [total]
    outline = "".join(text + (str(n) if upto > n else "") for (n, text), upto in zip(between, after, strict=True))
    try:
        document = parse(outline)
    except BadJson as e:
        raise SnapshotError(f"no JSON document: {e}") from None
    texts = rows.mapInArrow(whole, "nth long, text string")
    if any(depth > DEPTH for _, depth, _ in begin.values()):  # else no split begins within an element
        shared = single(PART).groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("path", "block", "row", "text"))).alias("p"))
        texts = texts.unionByName(shared.select("nth", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return texts, {"document": document, "elements": total}


def import_json(spark: SparkSession, path: str, rows_key: str = "declarations") -> tuple[DataFrame, DataFrame]:
    """Tables of a JSON snapshot whose declarations are under ``rows_key``. Version 1 has no files. Unknown kinds become functions,
    missing fields '' or 0. The file is read in as many tasks as it has splits."""
    rows, found = elements(spark, path)
    document = found["document"]
    if not isinstance(document, dict) or document.get("version") not in (1, SNAPSHOT_VERSION):
        raise SnapshotError("not a snapshot of version 1 or 2")
    if not isinstance(document.get(rows_key), list):
        raise SnapshotError("the snapshot has no declarations")
    starts = {k: v[0] for k, v in document.items() if isinstance(v, list) and v}

    def section(key: str, schema: str) -> DataFrame:
        if key not in starts:
            return spark.createDataFrame([], f"ord long, {schema}")
        upto = min([x for x in starts.values() if x > starts[key]], default=found["elements"])
        own = rows.where(F.col("nth").between(starts[key], upto - 1)).select((F.col("nth") - starts[key]).alias("ord"), F.from_json("text", schema).alias("s"))
        return own.select("ord", "s.*")

    d, f = section(rows_key, "n string, k string, f string, l long"), section("files", "p string, m long")
    declarations = d.select(F.coalesce("n", F.lit("")).alias("name"), kind_name(F.col("k")).alias("kind"), F.coalesce("f", F.lit("")).alias("file"), F.coalesce("l", F.lit(0)).cast("int").alias("line"), "ord")
    return declarations, f.select(F.coalesce("p", F.lit("")).alias("path"), F.coalesce("m", F.lit(0)).alias("mtime_ns"))


def export_json(folder: str, declarations: DataFrame, records: DataFrame, rows_key: str = "declarations") -> None:
    """Version 2, as a folder of parts: put together in the order of their names they are one document. Ranges of rows are written by as many tasks, whole or not at all."""
    spark = declarations.sparkSession
    row = F.to_json(F.struct(F.col("name").alias("n"), F.col("kind").alias("k"), F.col("file").alias("f"), F.col("line").alias("l")))
    own = F.to_json(F.struct(F.col("path").alias("p"), F.col("mtime_ns").alias("m")))
    # numbered behind the sort: the first row of the first range is 0
    comma = F.when(F.monotonically_increasing_id() == 0, "").otherwise(",")
    ranges = lambda t, c: t.repartitionByRange(1 + t.count() // PART_ROWS, c).sortWithinPartitions(c)
    parts = [(ranges(declarations, "ord"), F.concat(comma, row)), (ranges(records, "path"), F.concat(comma, own))]
    store = Store(spark, folder)
    for k, (rows, text) in enumerate(parts):
        rows.select(text.alias("value")).write.mode("overwrite").text(f"{folder}/_{k}")
    for k, (between, name) in enumerate(((f'{{"version":{SNAPSHOT_VERSION},{_quoted(rows_key)}:[', "_0"), ('],"files":[', "_1"), ("]}", None))):
        store.write(f"{2 * k}-between.json", between)
        there = set(store.files(""))
        for i, found in enumerate(store.files(name) if name else []):
            part = f"{2 * k + 1}-{i:06d}.json"
            store.move(f"{name}/{found}", part, part not in there)
        if name:
            store.delete(name)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of ``export_json`` as one file: bytes are copied from stream to stream, then the file takes its name."""
    store = Store(spark, folder)
    target = Store(spark, path.rpartition("/")[0] or ".")
    out = target.fs.create(target.path(f"{path.rpartition('/')[2]}.part"), True)
    for name in store.files(""):
        stream = store.fs.open(store.path(name))
        store.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.close()
    target.move(f"{path.rpartition('/')[2]}.part", path.rpartition("/")[2])


def _quoted(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)
