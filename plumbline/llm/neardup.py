"""Near-duplicate groups by one-permutation MinHash.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation hashing splits the hash range into
BINS bins and keeps the least hash of each; an empty bin borrows from one picked by a universal hash of (bin, attempt),
the same for all documents (optimal densification). BANDS bands of ROWS bins give the buckets. Documents
with equal sets are one class, stood for by its smallest id, and only classes go into buckets. Each bucket links its members to its
most central one only (a star), so pairs are bounded by members; pairs are confirmed on full sets.

To confirm, each pair sends the text of one side, and the other side's text goes out once for all pairs that share it (once for
each SPOKES of them, so that a hot one is split); a task reads them sorted and holds one set at a time.

A star can miss a link between two members that are not both linked to its centre. Buckets whose other members still lie in
several components therefore go to an exact join of their classes: shingles ordered by rarity, the prefix that a similarity
of the threshold needs (rarest first), candidates that share a prefix shingle and belong to different
components, confirmed on full sets. Components are closed again over all links.

Cases: ids may be of any type that can be ordered; a text without words (or null) has an empty set, is linked with nothing and is kept; a
text of fewer words than a shingle is one shingle; rows that share a doc_id are one document, linked by all their texts, with the set size
of each row's own text; a null id is linked with nothing, kept, with a null component; a very long text is one set in one task; an empty
table gives an empty table; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, col, drop, map_rows, mix, prefix_hash, slices, stash, window_hash
from .graph import components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
ATTEMPTS = 4096
MEMO = 200_000
SPOKES = 1000

_memo: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of words met before come from a memo of bounded size."""
    import xxhash

    memo = _memo
    if len(memo) + len(words) > MEMO and len(memo) > MEMO // 2:
        memo.clear()
    found = list(map(memo.get, words))
    for k in [k for k, x in enumerate(found) if x is None]:
        x = found[k] = xxhash.xxh3_64_intdigest(words[k])
        if len(memo) < MEMO:
            memo[words[k]] = x
    return np.fromiter(found, np.uint64, len(words))


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words alone, and the words' hashes."""
    import xxhash

    first = dict.fromkeys(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, first), np.uint64, len(first))
    for k, w in enumerate(first):
        first[w] = k
    numbers = np.fromiter(map(first.__getitem__, words), np.int64, len(words))
    return numbers, hashes[numbers] if len(words) else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z lower-cased, words cut at ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    p = prefix_hash(word_hashes(words))
    if len(words) < n:
        return mix(p[-1:] + np.uint64(len(words)))
    return np.unique(window_hash(p, n))


_bits = BINS.bit_length() - 1
_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _bits)
_DONORS = (mix(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(ATTEMPTS, dtype=np.uint64)[None, :]) >> np.uint64(64 - _bits)).astype(np.int64)
_BAND = np.arange(BANDS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty sorted set."""
    at = np.searchsorted(shingles, _BIN_STARTS)
    end = np.append(at[1:], len(shingles))
    full = at < end
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[at[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        usable = full[_DONORS[empty]]
        attempt = usable.argmax(axis=1)
        donor = _DONORS[empty, attempt]
        donor = np.where(full[donor], donor, np.flatnonzero(full)[0])  # no donor in ATTEMPTS draws: practically never
        out[empty] = mix(out[donor] + attempt.astype(np.uint64) + np.uint64(1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    h = mix(_BAND + np.uint64(77))
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


def _schema(df: DataFrame, own: dict[str, str], **more: T.DataType) -> T.StructType:
    """Columns of df's id type by the names that own gives, then more."""
    return T.StructType([*(T.StructField(name, df.schema[of].dataType) for name, of in own.items()), *(T.StructField(name, kind) for name, kind in more.items())])


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    import xxhash

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, digest, rows = [], [], []
        for t in binary(batch, "text"):
            s = shingle_set(t, n)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            rows.append(bands(signature(s)) if len(s) else np.zeros(0, np.int64))
        flat = pa.array(np.concatenate(rows), pa.int64())
        offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["id", "n", "digest", "bands"])

    return map_rows(docs, fn, _schema(docs, {"id": "id"}, n=T.LongType(), digest=T.BinaryType(), bands=T.ArrayType(T.LongType())))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    inter = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter)


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (u, v) among pairs whose sets are similar enough; texts has one row an id. Many pairs may share a u."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SPOKES).alias("salts"))
    dealt = pairs.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).alias("salt"))
    # What each text is needed for: once as a head of (u, salt), and as a spoke of each of its pairs.
    heads = dealt.select("u", "salt").distinct().select(F.col("u").alias("id"), "u", "salt", F.lit(0).alias("spoke"))
    needs = heads.unionByName(dealt.select(F.col("v").alias("id"), "u", "salt", F.lit(1).alias("spoke")))
    sent = texts.filter("id is not null and text is not null").join(needs.hint("merge"), "id").select("u", "salt", "spoke", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint64)
        for batch in (part for whole in batches for part in slices(whole)):
            ok = []
            for u, salt, spoke, text in zip(batch.column("u").to_pylist(), batch.column("salt").to_pylist(), batch.column("spoke").to_pylist(), binary(batch, "text")):
                if not spoke:
                    at, head = (u, salt), shingle_set(text, n)
                ok.append(bool(spoke) and at == (u, salt) and _similar(head, shingle_set(text, n), percent))
            mask = pa.array(ok, pa.bool_())
            if any(ok):
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("id").filter(mask)], ["u", "v"])

    sorted_ = sent.repartition("u", "salt").sortWithinPartitions("u", "salt", "spoke")
    return sorted_.mapInArrow(run, _schema(texts, {"u": "id", "v": "id"}))


def _residual_pairs(left: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidate (u, v) among the classes of left (rep, component) by an exact prefix-filtered join on rare shingles."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, n).view(np.int64) for t in binary(batch, "text")]
        sizes = np.array([len(x) for x in sets])
        row = pa.array(np.repeat(np.arange(len(sets)), sizes))
        return pa.RecordBatch.from_arrays([batch.column("rep").take(row), batch.column("component").take(row), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets), pa.int64())], ["rep", "component", "n", "shingle"])

    held = texts.filter("text is not null").select(F.col("id").alias("rep"), "text")
    rows = map_rows(held.join(left, "rep").select("rep", "component", "text"), fn, _schema(texts, {"rep": "id", "component": "id"}, n=T.LongType(), shingle=T.LongType()))
    rows = stash(rows, "residual-shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    often = often.filter("c1 < c2").select("shingle", "f")
    # Shingles that no other component holds come first in the order; they take room in the prefix but match nothing.
    # The order is (frequency, shingle), so pos counts the unshared ones and the shared ones before.
    shared = rows.join(often, "shingle").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    placed = shared.select("rep", "component", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode("s").alias("k", "x"))
    placed = placed.select("rep", "component", "n", (F.col("alone") + F.col("k")).alias("pos"), F.col("x.shingle").alias("shingle"))
    # Length bound: a partner has percent of n at least, so the first common shingle stands within this prefix.
    prefix = stash(placed.filter(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")), "residual-prefixes")
    drop(rows)
    side = lambda x, y: prefix.select("shingle", *[F.col(c).alias(f"{c}{y}") for c in ("component", "n", "pos")], F.col("rep").alias(x))
    # Positional bound at the first common shingle: what is left on both sides must reach the needed overlap.
    left_over = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    near = (F.col("u") < F.col("v")) & (F.col("component1") != F.col("component2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & ((100 + percent) * left_over >= percent * (F.col("n1") + F.col("n2")))
    pairs = stash(side("u", 1).hint("merge").join(side("v", 2), "shingle").filter(near).select("u", "v").distinct(), "residual-pairs")
    drop(prefix)
    return pairs


def _identified(df: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool, bool]:
    """Sketches of all rows by node, one row (id, text) a node, whether nodes repeat, and whether they are parts of an id; one node has one set."""
    docs = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    sketches = stash(_sketch(docs, shingle), "sketches")
    sets = F.coalesce("digest", F.lit(b""))
    by_id = sketches.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), (F.min(sets) != F.max(sets)).alias("differ"))
    repeats, differ = by_id.agg(F.max("rows"), F.max("differ")).first()
    if differ:  # an id with several sets is several nodes, tied together by links
        drop(sketches)
        docs = docs.select(F.when(F.col("id").isNotNull(), F.struct("id", F.xxhash64("text").alias("part"))).alias("id"), "text")
        sketches = stash(_sketch(docs, shingle), "sketches")
    repeated = (repeats or 1) > 1
    texts = docs.filter("id is not null").groupBy("id").agg(F.first("text").alias("text")) if repeated else docs
    return sketches, texts, repeated, bool(differ)


def _same_id(members: DataFrame) -> DataFrame:
    """Links between the classes of nodes of one id."""
    of = members.select(F.col("id.id").alias("of"), "rep")
    least = of.groupBy("of").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).filter("u < last").select("of", "u")
    return of.join(least, "of").filter("rep <> u").select("u", F.col("rep").alias("v")).distinct()


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every document."""
    sketches, texts, repeated, several_sets = _identified(df, shingle, id_col, text_col)
    linked = sketches.filter("n > 0 and id is not null")
    # Written first, else the join below would stay in the aggregate's partitions, where a hot digest cannot be split.
    classes = stash(linked.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    members = linked.join(classes.hint("merge"), "digest").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands"))
    members = stash(members.distinct() if repeated else members, "members")
    drop(classes)
    cells = members.filter("bands is not null").select("rep", "n", F.explode("bands").alias("cell"))
    several = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    # So are these, for hot buckets; and the joins are merge joins, whose hot keys Spark splits.
    several = stash(several.select("cell", "m"), "several")
    held = stash(cells.join(several.hint("merge"), "cell"), "cells")
    drop(several)
    # The member that meets most others over all its buckets is the most central; stars around it miss least.
    meets = held.groupBy("rep").agg(F.sum("m").alias("meets"))
    centres = stash(held.join(meets, "rep").groupBy("cell").agg(F.max(F.struct("meets", "rep", "n")).alias("c")), "centres")
    sized = 100 * F.least("n", "nc") >= percent * F.greatest("n", "nc")
    spokes = held.join(centres.select("cell", F.col("c.rep").alias("u"), F.col("c.n").alias("nc")).hint("merge"), "cell")
    star = stash(spokes.filter((F.col("rep") != F.col("u")) & sized).select("u", F.col("rep").alias("v")).distinct(), "stars")
    drop(centres)
    links = stash(_confirm(star, texts, shingle, percent), "links")
    drop(star)
    if several_sets:
        links, alone = stash(links.unionByName(_same_id(members)), "links"), links
        drop(alone)
    comps = components(links)
    # Buckets of three or more that still hold several components: links between members other than the centre may be missing.
    rest = held.filter("m > 2").join(comps, F.col("rep") == F.col("node"), "left").select("cell", "rep", F.coalesce("component", "rep").alias("component"))
    several = rest.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("cell")
    several = stash(several, "several")
    left = stash(rest.join(several.hint("merge"), "cell").select("rep", "component").distinct(), "residual")
    drop(several)
    drop(held)
    if not left.isEmpty():
        pairs = _residual_pairs(left, texts, shingle, percent)
        more = stash(_confirm(pairs, texts, shingle, percent), "links")
        drop(pairs)
        if not more.isEmpty():
            drop(comps)
            comps = components(links.unionByName(more))
        drop(more)
    drop(left)
    drop(links)
    known = members.select("id", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("component"))
    if several_sets:  # back from nodes to ids
        known = known.select(F.col("id.id").alias("id"), F.col("component.id").alias("component"))
    known = stash(known.groupBy("id").agg(F.min("component").alias("component")), "known")
    drop(members)
    drop(comps)
    own = F.col("id.id") if several_sets else F.col("id")
    out = sketches.select(own.alias("id"), "n").join(known.withColumnRenamed("id", "known_id").hint("merge"), F.col("id") == F.col("known_id"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
