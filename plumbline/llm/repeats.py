"""Exact repeats of at least a window's length across and within documents, for any kind of symbol.

What tells the two users apart is a Scheme: which grams of a text are named, and which names a window is looked up by.

1. Equal texts are one class, whose text is kept once. Classes are packed into chunks of about CHUNK_BYTES, in a table that
   the later steps read again.
2. Naming. Each chunk sends the distinct hashes of its grams, packed and dealt out by hash range, and gets back one bit
   for each: whether the corpus holds that name in a second place that matters. So a gram shared by all documents costs one
   entry a chunk, and no task holds more than a range of hashes.
3. Resolving. Windows go with their symbols, in runs, to the repeated names that their scheme picks. There they are sorted by hash, so
   that equal ones stand side by side, and compared symbol by symbol along each run: a hash never decides. Windows at a name with more
   than HOT occurrences go by themselves instead, known by a 128-bit hash of theirs: each chunk settles the equal ones it holds and
   sends the first, so no group holds more than a row a chunk, or HOT runs.

A place is (number of the document, text digest, start). Numbers follow the order of ids: an integer id is its own number, other
ids are numbered by one sort. Everything between steps is in the shared folder or in a shuffle, and deleted when read for the last time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, col, drop, mix, powers, prefix_hash, stash, window_hash

CHUNK_BYTES = 2_000_000
HOT = 4000
NAMES_PER_PART = 1_000_000
RESOLVE_ROWS = 3000
TASK_BYTES = 64_000_000
NULL_ID = -(1 << 63)
_SEGMENT = 1 << 20
_SECOND = 0x6A09E667F3BCC909


class Scheme:
    """Symbols, named grams and runs of windows of one kind of text."""

    window: int
    gram: int
    names_per_byte: float

    def symbols(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of a chunk, and where each document's begin and end among them."""
        raise NotImplementedError

    def values(self, part: np.ndarray) -> np.ndarray:
        """Hash values of symbols."""
        return part

    def names(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, hash and tag (below 16) of every named gram."""
        raise NotImplementedError

    def repeated(self, first: np.ndarray, group: np.ndarray, tags: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which of the entries, sorted by name, matter; first: starts of groups, total: a group's occurrences."""
        raise NotImplementedError

    def runs(self, c: _Chunk, pos: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the repeated names (pos, hashes): index, first window and number of windows of each run, by ascending index."""
        raise NotImplementedError

    def loads(self, c: _Chunk, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The symbols of all windows of each run."""
        raise NotImplementedError

    def unpack(self, load: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of joined loads, which tell them apart, and their hash values."""
        raise NotImplementedError


def gram_hashes(scheme: Scheme, symbols: np.ndarray, pos: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Rolling hashes of the n symbols from each of the ascending positions, a segment at a time; another salt gives independent ones."""
    out = np.empty(len(pos), np.uint64)
    for a in range(0, len(symbols), _SEGMENT):
        lo, hi = np.searchsorted(pos, (a, a + _SEGMENT))
        if lo < hi:
            part = scheme.values(symbols[a : a + _SEGMENT + n])
            part = mix(part ^ np.uint64(salt)) if salt else part
            p, q = prefix_hash(part), pos[lo:hi] - a
            out[lo:hi] = mix((p[q + n] - p[q]) * powers(_SEGMENT)[1][q])
    return out


def _table(columns: dict[str, pa.Array]) -> pa.Table:
    return pa.table(columns)


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x), pa.int64())


def _numbered(df: DataFrame, id_col: str) -> DataFrame:
    """df with id, in whose order the ids stand; null is NULL_ID, before all others."""
    own, kind = col(id_col), df.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint") and df.select(F.min(own)).first()[0] != NULL_ID:
        return df.withColumn("id", F.coalesce(own.cast("long"), F.lit(NULL_ID)))
    ids = df.select(own.alias("of")).filter("of is not null").distinct().repartitionByRange("of").sortWithinPartitions("of")
    ids = stash(ids.select("of", F.monotonically_increasing_id().alias("no")), "numbers")
    return df.join(ids.hint("merge"), own == F.col("of"), "left").withColumn("id", F.coalesce("no", F.lit(NULL_ID))).drop("of", "no")


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (own_id, id, digest), and one row a different text with its least and greatest id."""
    slim = df.select(col(id_col).alias("own_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = _numbered(slim, "own_id").select("own_id", "id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    return rows.drop("text"), rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.first("text").alias("text"))


def _chunks(classes: DataFrame) -> DataFrame:
    """Chunks of whole texts: their size, ids, whether a class has several ids, digests, bounds in bytes and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids, several, digests, texts = zip(*held)
            bounds = np.cumsum([0, *map(len, texts)])
            blobs = [np.array(ids, np.int64).tobytes(), np.array(several, np.uint8).tobytes(), b"".join(digests), bounds.astype(np.int64).tobytes(), pa.compress(b"".join(texts), "zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([_longs([number]), _longs([bounds[-1]]), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "size", "ids", "several", "digests", "bounds", "data"])

        for batch in batches:
            ids, last = batch.column("id").to_pylist(), batch.column("last_id").to_pylist()
            for i, j, d, t in zip(ids, last, binary(batch, "digest"), binary(batch, "text")):
                if held and size + len(t) > CHUNK_BYTES:
                    yield chunk()
                    number += 1
                    held, size = [], 0
                held.append((i, i != j, d, t))
                size += len(t)
        if held:
            yield chunk()

    return classes.mapInArrow(run, "chunk long, size long, ids binary, several binary, digests binary, bounds binary, data binary")


def _text(row: dict) -> tuple[bytes, np.ndarray]:
    """A chunk's bytes, and the bounds of its texts; they travel and rest compressed."""
    bounds = np.frombuffer(row["bounds"], np.int64)
    return pa.decompress(row["data"], int(bounds[-1]), "zstd", asbytes=True), bounds


class _Chunk:
    def __init__(self, scheme: Scheme, row: dict):
        self.data, self.byte_bounds = _text(row)
        self.number: int = row["chunk"]
        self.symbols, self.bounds = scheme.symbols(self.data, self.byte_bounds)


class _Names:
    """A chunk's distinct names: sorted keys of hash, tag and the logarithm of their number; and the way back to places."""

    def __init__(self, scheme: Scheme, c: _Chunk, width: int, parts: int):
        self.pos, self.hashes, tags = scheme.names(c.symbols, c.bounds)
        mask = np.uint64((1 << 64) - (1 << (64 - 8 * width)))
        keys, self.back, counts = np.unique((self.hashes & mask) | (tags.astype(np.uint64) << np.uint64(4)), return_inverse=True, return_counts=True)
        self.part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        self.cuts = np.flatnonzero(np.diff(self.part, prepend=-1))
        keys |= np.minimum(15, np.ceil(np.log2(counts))).astype(np.uint64)
        octets = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
        self.packed = np.concatenate([octets[:, :width], octets[:, 7:]], axis=1)


def _naming(chunks: DataFrame, scheme: Scheme, width: int, parts: int, tasks: int) -> DataFrame:
    """For each (chunk, part) with repeated names: a bit for each name sent, and which are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                c = _Chunk(scheme, row)
                n = _Names(scheme, c, width, parts)
                if len(n.cuts):
                    ends = np.append(n.cuts[1:], len(n.part)) * (width + 1)
                    raw = n.packed.tobytes()
                    blobs = [raw[a:b] for a, b in zip((n.cuts * (width + 1)).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([_longs(n.part[n.cuts]), _longs(np.full(len(blobs), c.number)), pa.array(blobs, pa.binary())], ["part", "chunk", "names"])

    def meet(table: pa.Table) -> pa.Table:
        blobs = binary(table.combine_chunks().to_batches()[0], "names")
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width + 1)
        octets = np.zeros((len(raw), 8), np.uint8)
        octets[:, :width], octets[:, 7] = raw[:, :width], raw[:, width]
        keys = octets.view(">u8").reshape(-1).astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.diff(keys >> np.uint64(8), prepend=~keys[:1] >> np.uint64(8)) != 0
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(np.int64(1) << (keys & np.uint64(15)).astype(np.int64), first)
        good = scheme.repeated(first, group, ((keys >> np.uint64(4)) & np.uint64(15)).astype(np.int64), total)
        hit = np.zeros(len(keys), bool)
        hit[order] = good
        often = np.zeros(len(keys), bool)
        often[order] = good & (total[group] > HOT)
        ends = np.cumsum([len(b) // (width + 1) for b in blobs]).tolist()
        out = []
        for number, a, b in zip(table.column("chunk").to_pylist(), [0, *ends], ends):
            if hit[a:b].any():
                out.append((number, np.packbits(hit[a:b]).tobytes(), np.flatnonzero(often[a:b]).astype(np.int64).tobytes()))
        part = table.column("part")[0].as_py()
        return _table({"chunk": _longs([o[0] for o in out]), "part": _longs([part] * len(out)), "bits": pa.array([o[1] for o in out], pa.binary()), "hot": pa.array([o[2] for o in out], pa.binary())})

    sent = chunks.select("chunk", "bounds", "data").mapInArrow(send, "part long, chunk long, names binary")
    return sent.repartition(tasks, "part").groupBy("part").applyInArrow(meet, "chunk long, part long, bits binary, hot binary")


_RUN = "anchor long, salt long, id long, sub long, chunk long, at long, n long, load binary"
_RUN_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]


def _hot_windows(scheme: Scheme, c: _Chunk, ids: np.ndarray, subs: np.ndarray, doc_of, at: np.ndarray, n: np.ndarray, every: bool) -> tuple[np.ndarray, ...]:
    """Of the windows of some runs: start and both halves of the hash of those to be compared with other chunks, and first and last starts of those known to be repeated."""
    edge = np.zeros(len(c.symbols) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)  # each window once, however many names it has
    key, other = (gram_hashes(scheme, c.symbols, place, scheme.window, salt).view(np.int64) for salt in (0, _SECOND))
    doc = doc_of(place)
    order = np.lexsort((place, subs[doc], ids[doc], other, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(other[order]) != 0)
    again = np.zeros(len(place), bool)
    again[order] = ~new | (np.append(~new[1:], False) if every else False)
    first = order[new]
    edges = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    # Consecutive starts of one document make a span.
    breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(doc) != 0)) + 1
    cut = np.zeros(len(place) + 1, bool)
    cut[breaks] = True
    begin = np.flatnonzero(again & ((edges[:-1] > 0) | cut[:-1]))
    end = np.flatnonzero(again & ((edges[1:] < 0) | cut[1:]))
    return place[first], key[first], other[first], place[begin], place[end]


def _runs(chunks: DataFrame, marks: DataFrame, scheme: Scheme, width: int, parts: int, every: bool) -> DataFrame:
    """Runs of windows, each by the repeated name that it goes to; without a load, a single window by its hash (n is 0), or a run known to be repeated."""
    empty = pa.table({c: pa.array([], pa.binary() if c == "load" else pa.int64()) for c in _RUN_COLUMNS})

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        row = left.to_pylist()[0]
        c = _Chunk(scheme, row)
        names = _Names(scheme, c, width, parts)
        hit, often = np.zeros(len(names.part), bool), np.zeros(len(names.part), bool)
        start = dict(zip(names.part[names.cuts].tolist(), zip(names.cuts.tolist(), np.append(names.cuts[1:], len(names.part)).tolist())))
        for m in right.to_pylist():
            a, b = start[m["part"]]
            hit[a:b] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=b - a).astype(bool)
            often[a + np.frombuffer(m["hot"], np.int64)] = True
        here = np.flatnonzero(hit[names.back])
        pos, hashes, often = names.pos[here], names.hashes[here], often[names.back[here]]
        which, at, n = scheme.runs(c, pos, hashes)
        doc_of = lambda places: np.searchsorted(c.bounds, places, side="right") - 1
        ids = np.frombuffer(row["ids"], np.int64)
        subs = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)[:, :8].copy().view(np.int64).reshape(-1)
        hot = often[which]
        alone, key, other, start, stop = _hot_windows(scheme, c, ids, subs, doc_of, at[hot], n[hot], every)
        at, n, names_at = at[~hot], n[~hot], hashes[which[~hot]].view(np.int64)
        load = [*scheme.loads(c, at, n), *[None] * (len(alone) + len(start))]
        spread = mix(start.astype(np.uint64) + mix(np.full(1, c.number, np.uint64))).view(np.int64)  # settled rows can go anywhere
        place = np.concatenate([at, alone, start])
        doc = doc_of(place)
        anchor = np.concatenate([names_at, key, spread])
        salt = np.concatenate([np.full(len(at), -1), other, np.full(len(start), -1)])
        count = np.concatenate([n, np.zeros(len(alone), np.int64), stop - start + 1])
        columns = (anchor, salt, ids[doc], subs[doc], np.full(len(place), c.number), place, count)
        return _table(dict(zip(_RUN_COLUMNS, [*map(_longs, columns), pa.array(load, pa.binary())])))

    return chunks.select("chunk", "ids", "digests", "bounds", "data").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(fn, _RUN)


def _same(symbols: np.ndarray, window: int, at: np.ndarray, to: np.ndarray, goes_on: np.ndarray) -> bool:
    """Whether the windows that start at each of at and to are equal, symbol by symbol; where goes_on, the pair before is one symbol earlier on both sides."""
    if not np.array_equal(symbols[at[goes_on] + window - 1], symbols[to[goes_on] + window - 1]):
        return False
    whole = np.lib.stride_tricks.sliding_window_view(symbols, window) if len(symbols) >= window else symbols.reshape(0, window)
    a, b = at[~goes_on], to[~goes_on]
    return all(np.array_equal(whole[a[k : k + 50_000]], whole[b[k : k + 50_000]]) for k in range(0, len(a), 50_000))


def _leaders(symbols: np.ndarray, window: int, start: np.ndarray, row: np.ndarray, group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (start among the symbols, row, group): an order in which equal ones of a group stand together, where it begins anew, and the first of its kind for each.

    Equal hashes are checked symbol by symbol; should two different windows ever share one, windows are sorted by their symbols instead.
    """
    own = hashes ^ group
    for again in (False, True):
        order = np.argsort(own, kind="stable")
        new = np.diff(own[order], prepend=~own[order[:1]]) != 0
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        # Along a run whose windows all equal those of another run, only one symbol is new at each step.
        goes_on = np.zeros(len(order), bool)
        goes_on[1:] = (row[1:] == row[:-1]) & (lead[1:] == lead[:-1] + 1) & (row[lead[1:]] == row[lead[:-1]]) & (lead[:-1] != np.arange(len(order) - 1))
        other = np.flatnonzero(lead != np.arange(len(order)))
        if again or (np.array_equal(group[other], group[lead[other]]) and _same(symbols, window, start[other], start[lead[other]], goes_on[other])):
            break
        _, kinds = np.unique(np.lib.stride_tricks.sliding_window_view(symbols, window)[start], axis=0, return_inverse=True)
        _, own = np.unique(np.stack([kinds.reshape(-1).astype(np.uint64), group]), axis=1, return_inverse=True)
        own = own.reshape(-1).astype(np.uint64)
    return order, new, lead


def _resolve(runs: DataFrame, scheme: Scheme, every: bool, tasks: int) -> DataFrame:
    """Spans (chunk, first and last start) of repeated windows: all places of one (every), else all but its first."""

    def spans(chunk, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_longs(x) for x in (chunk, start, stop)], ["chunk", "from", "to"])

    def work(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        light = whole.filter(whole.column("load").is_null())
        if light.num_rows:
            anchor, salt, chunk, start, count = (np.array(light.column(x)) for x in ("anchor", "salt", "chunk", "at", "n"))
            same = (np.diff(anchor) == 0) & (np.diff(salt) == 0) & (count[1:] == 0) & (count[:-1] == 0)
            again = np.append(False, same) | (np.append(same, False) if every else False)
            keep = (count > 0) | again
            yield spans(chunk[keep], start[keep], (start + np.maximum(count - 1, 0))[keep])
        heavy = whole.filter(whole.column("load").is_valid())
        if heavy.num_rows:
            yield compared(heavy)

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, chunk, at, n = (np.array(batch.column(c)) for c in ("anchor", "chunk", "at", "n"))
        total = int(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        local = np.arange(total) - (np.cumsum(n) - n)[row]
        place = at[row] + local
        symbols, values = scheme.unpack(binary(batch, "load"))
        size = n + scheme.window - 1
        start = (np.cumsum(size) - size)[row] + local
        # Windows are told apart by name too: what is first is settled within a group.
        group = mix(anchor.view(np.uint64))[row]
        order, new, lead = _leaders(symbols, scheme.window, start, row, group, window_hash(prefix_hash(values), scheme.window)[start])
        lead = lead[order]

        def differs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (chunk[row[x]] != chunk[row[y]]) | (place[x] != place[y])

        away = np.zeros(total, bool)
        if every:
            tail = np.append(np.flatnonzero(new)[1:], total) - 1
            away[order] = differs(lead, order[tail[np.cumsum(new) - 1]])
        else:
            away[order] = differs(order, lead)
        # Runs of repeated windows, within rows.
        edge = np.flatnonzero(away & np.concatenate([[True], ~away[:-1] | (row[1:] != row[:-1])]))
        stop = np.flatnonzero(away & np.concatenate([~away[1:] | (row[1:] != row[:-1]), [True]]))
        return spans(chunk[row[edge]], place[edge], place[stop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cut = cuts(held)
            if len(cut):  # the last group may go on in the next batch
                yield from done(held.slice(0, cut[-1]), cut)
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from done(held, np.append(cuts(held), held.num_rows))

    def cuts(t: pa.Table) -> np.ndarray:
        a, s = np.array(t.column("anchor")), np.array(t.column("salt"))
        return np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1

    def done(t: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, about RESOLVE_ROWS rows at a time."""
        at = 0
        while at < t.num_rows:
            end = int(ends[min(np.searchsorted(ends, at + RESOLVE_ROWS), len(ends) - 1)])
            yield from work(t.slice(at, end - at).combine_chunks().to_batches()[0])
            at = end

    placed = runs.repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt", "id", "sub", "at")
    return placed.mapInArrow(run, "chunk long, `from` long, `to` long")


def find_repeats(df: DataFrame, scheme: Scheme, every: bool, measure, columns: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (own_id, id, digest), and a row a different text: digest, first_id and the columns that measure makes.

    measure(text, removed, several) gets a text, the mask of its symbols inside repeated windows (None: none), and
    whether documents with several ids hold it.
    """
    spark = df.sparkSession
    rows, classes = _classes(df, id_col, text_col)
    chunks = stash(_chunks(classes), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    names, shuffles = size * scheme.names_per_byte, int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, int(size / TASK_BYTES) + 1)
    parts = max(4 * shuffles, int(names / NAMES_PER_PART) + 1)
    width = min(7, max(4, (int(names).bit_length() + 10 + 7) // 8))
    marks = stash(_naming(chunks, scheme, width, parts, tasks), "marks")
    found = stash(_resolve(_runs(chunks, marks, scheme, width, parts, every), scheme, every, tasks), "repeats")
    drop(marks)
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            row = left.to_pylist()[0]
            data, bytes_at = _text(row)
            removed = bounds = None
            if right.num_rows:
                symbols, bounds = scheme.symbols(data, bytes_at)
                edge = np.zeros(len(symbols) + 1, np.int32)
                np.add.at(edge, np.array(right.column("from")), 1)
                np.add.at(edge, np.array(right.column("to")) + scheme.window, -1)
                removed = np.cumsum(edge[:-1]) > 0
            ids, several = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["several"], np.uint8)
            for k in range(len(ids)):
                mask = removed[bounds[k] : bounds[k + 1]] if removed is not None else None
                made = measure(data[bytes_at[k] : bytes_at[k + 1]], mask if mask is not None and mask.any() else None, bool(several[k]))
                out.append((row["digests"][32 * k : 32 * k + 32], int(ids[k]), *made))
        kinds = [pa.binary(), pa.int64(), *(pa.string() if t == "string" else pa.int64() for _, t in columns)]
        return pa.Table.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], ["digest", "first_id", *(c for c, _ in columns)])

    schema = "digest binary, first_id long, " + ", ".join(f"{c} {t}" for c, t in columns)
    texts = stash(chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(fn, schema), "texts")
    drop(found)
    drop(chunks)
    return rows, texts
