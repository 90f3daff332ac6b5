r"""Near-duplicate documents by MinHash and an LSH forest (operator 3).

1. Each text becomes the set of its 5-word shingles (64-bit hashes), a MinHash signature of TREES * DEPTH values, an
   8-bit sketch of the same values, and a 128-bit key of the set.  Equal sets are one class from here on, so exact
   copies never meet each other.
2. Each class is put into TREES sorted orders, each by its own DEPTH signature values.  The orders are range-partitioned
   and sorted; in each, a class is paired with the classes next to it, as long as their common prefix has MIN_DEPTH
   values.  Depth adapts by itself: in a sparse region, where fewer than NEAR classes follow with that prefix, all of
   them are neighbours; in a dense one, the next in order are those with the longest common prefix.  What lies on both
   sides of a partition's border is paired in a small pass of its own.
3. The sketches of a pair tell about how near it is; CLOSE is 4 standard deviations below the threshold.  Close pairs are
   confirmed on the full sets: first FIRST_LINKS of each class, then every one that still joins two components.
4. Crowded regions, those of more than NEAR rows, have pairs that were not looked at.  Where such a region holds several
   components, its classes go through an exact prefix join, without any cap: shingles that occur in one component alone
   cannot tie two, so only the others count, rarest first; a class of which these are under 75 % is done; of each other
   class so many of them are posted that a linked pair must share one, and two postings meet only if sizes and the
   shingles behind them leave room for 75 %.  Of each posted shingle the largest component's classes meet the others,
   not each other.  Pages of one template thus meet only where their own parts agree, and the work grows with the pages.

A pair of similarity 0.75 shares MIN_DEPTH values in a given order with probability 0.42, and in none of the 24 with
2e-6; a pair's sketch misses CLOSE with 2e-5 at that similarity, and much less above it.

Defined cases: null and blank texts have no shingles and are linked with nothing; fewer than five words are one
shingle; a null doc_id is never the least of a component that has another; repeated rows each get a row; an empty table
gives no rows; other columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import discard, giving_back, materialise
from .components import connected_components

SHINGLE = 5
PERCENT = 75
TREES, DEPTH, MIN_DEPTH = 24, 6, 3
NEAR, DENSE_NEAR = 8, 1
CLOSE = 0.6
FIRST_LINKS = 3
#: Keys with more rows than this, or than the HOT_SHARE-th part of all, are mapped apart: HOT_SHARE of them at most.
HOT, HOT_SHARE = 1000, 10_000
#: Bytes of text that are scanned at once; pairs of sets that are compared at once.
SCANNED, COMPARED = 1 << 20, 500

SIGNED = "doc_id long, n_shingles long, key binary, sig binary, sketch binary"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    n = TREES * DEPTH
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block: distinct shingle hashes of each text, ascending, and where each text's begin."""
    from . import textvec as tv

    inside = ~tv.SPACE
    for _, raw, offs in tv.blocks(column, SCANNED):
        starts, ends, first = tv.word_spans(inside[raw], offs)
        hashes, at = tv.shingles(tv.span_hashes(tv.LOWER[raw], starts, ends), first, SHINGLE)
        unique = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield np.concatenate([*unique, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, unique)])


def _keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each set, as rows of two words; zero for empty sets."""
    from . import textvec as tv

    with np.errstate(over="ignore"):
        out = np.zeros((len(at) - 1, 2), np.uint64)
        full = at[:-1] < at[1:]
        for k in (0, 1):
            if full.any():
                out[full, k] = tv.mix(np.add.reduceat(tv.mix(values, k + 1), at[:-1][full]) + (at[1:] - at[:-1])[full].astype(np.uint64), k + 3)
    return out


def _binaries(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    width = flat.shape[1] * flat.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
    return fixed if present.all() else pa.array([x if p else None for x, p in zip(fixed.to_pylist(), present, strict=True)], pa.binary())


@giving_back
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = _permutations()
    for batch in batches:
        done = 0
        for values, at in _sets(batch.column("text")):
            n = len(at) - 1
            full = at[:-1] < at[1:]
            sig = np.zeros((n, len(mul)), ">u4")
            if full.any():
                begin = at[:-1][full]
                with np.errstate(over="ignore"):
                    for k in range(len(mul)):
                        sig[full, k] = np.minimum.reduceat((values * mul[k] + add[k]) >> np.uint64(32), begin).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(done, n), pa.array(np.diff(at), pa.int64()), _binaries(_keys(values, at), full),
                    _binaries(sig, full), _binaries((sig & 255).astype(np.uint8), full),
                ],
                names=["doc_id", "n_shingles", "key", "sig", "sketch"],
            )
            done += n


@giving_back
def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for values, at in _sets(batch.column("text")):
            full = at[:-1] < at[1:]
            keys = _binaries(_keys(values, at), full).filter(pa.array(full))
            sets = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1][full], at[1:][full], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, sets], names=["key", "items"])


@giving_back
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 2000):
            part = batch.slice(start, 2000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(part), TREES, DEPTH * 4)
            path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEPTH * 4), len(part) * TREES, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            key = part.column("key").take(pa.array(np.repeat(np.arange(len(part)), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(part))), path, key], names=["tree", "path", "key"])


@giving_back
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted run: pairs (kind 0), the rows of crowded regions (1) and the rows at both borders (2)."""

    def rows(kind: int, tree, path, a, b) -> pa.RecordBatch:
        n = len(a)
        b = pa.nulls(n, pa.binary()) if b is None else b
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), tree, path, a, b], names=["kind", "tree", "path", "a", "b"])

    held: pa.Table | None = None  # rows that still wait for rows behind them, after NEAR rows of context
    context = 0
    begun = False

    def emit(t: pa.Table, context: int, upto: int) -> Iterator[pa.RecordBatch]:
        """Pairs whose first row is in [context, upto); all rows of t may be second rows."""
        t = t.combine_chunks()
        n = t.num_rows
        cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]
        tree, path, key = cols
        prefix = np.frombuffer(b"".join(path.to_pylist()), np.uint32).reshape(n, DEPTH)[:, :MIN_DEPTH]
        tree_np = tree.to_numpy()
        new = np.ones(n, np.int64)
        new[1:] = (tree_np[1:] != tree_np[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)
        region = np.cumsum(new)
        at = np.arange(n)
        ahead = np.minimum(at + NEAR, n - 1)
        dense = (region[ahead] == region) & (at + NEAR < n)
        # a row is in a crowded region if any NEAR + 1 rows in a row that it is one of are of one region
        filled = np.concatenate([[0], np.cumsum(dense)])
        mine = np.arange(context, upto)
        crowded = pa.array(mine[filled[mine + 1] > filled[np.maximum(mine - NEAR, 0)]])
        yield rows(1, tree.take(crowded), path.take(crowded), key.take(crowded), None)
        first, second = [], []
        for j in range(1, NEAR + 1):
            i = np.arange(context, min(upto, n - j))
            ok = (region[i] == region[i + j]) & ((j <= DENSE_NEAR) | ~dense[i])
            first.append(i[ok])
            second.append(i[ok] + j)
        i, k = pa.array(np.concatenate(first)), pa.array(np.concatenate(second))
        yield rows(0, tree.take(i), path.take(i), key.take(i), key.take(k))
    last: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch.select(["tree", "path", "key"])])
        if not t.num_rows:
            continue
        if not begun:
            begun, edge = True, t.slice(0, NEAR).combine_chunks()
            yield rows(2, *[c.chunk(0) for c in edge.columns], None)
        last = (t if last is None else pa.concat_tables([last, t])).slice(max(0, (0 if last is None else last.num_rows) + t.num_rows - NEAR))
        held = t if held is None else pa.concat_tables([held, t])
        upto = held.num_rows - NEAR
        if upto > context:
            yield from emit(held, context, upto)
            cut = max(0, upto - NEAR)
            held, context = held.slice(cut), upto - cut
    if held is not None:
        yield from emit(held, context, held.num_rows)
        edge = last.combine_chunks()
        yield rows(2, *[c.chunk(0) for c in edge.columns], None)


@giving_back
def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), COMPARED):
            part = batch.slice(start, COMPARED)
            a, b = part.column("items_a").to_pylist(), part.column("items_b").to_pylist()
            ok = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (..., TREES * DEPTH)."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), TREES * DEPTH)


def _may_link(near: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return (near >= CLOSE) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b))


@giving_back
def _sketch_agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may be links by sizes and sketches, with the estimate."""
    for batch in batches:
        if not len(batch):
            continue
        near = _agreement(*(_sketches(batch.column(c).to_pylist()) for c in ("sketch_a", "sketch_b")))
        keep = pa.array(_may_link(near, *(batch.column(c).to_numpy() for c in ("n_a", "n_b"))))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(near).filter(keep)], names=["a", "b", "near"])


@giving_back
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, home, item) for each shingle of each set (key, home, items)."""
    for batch in batches:
        items = batch.column("items")
        size = pa.compute.binary_length(items).to_numpy().astype(np.int64) // 8
        stops, first = np.cumsum(size), 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(stops, stops[first] - size[first] + 200_000, "right")))
            flat = np.frombuffer(b"".join(items.slice(first, last - first).to_pylist()), np.int64)
            row = pa.array(np.repeat(np.arange(first, last, dtype=np.int32), size[first:last]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("home").take(row), pa.array(flat)], names=["key", "home", "item"])
            first = last


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, near) of the pairs that may be links."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_sketch_agreement, "a binary, b binary, near double")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the full sets confirm."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("items").alias(f"items_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_overlap, "a binary, b binary")


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, items) of the classes in nodes (key), from the text of one document of each."""
    wanted = classes.join(nodes, "key", "left_semi").select("least_id").distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_shingle_sets, "key binary, items binary")
    return sets.join(nodes, "key", "left_semi").groupBy("key").agg(F.first("items").alias("items"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, near) whose ends are in different components."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where("coalesce(r_a, a) <> coalesce(r_b, b)").select("a", "b", "near")


def _joined(more: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components (node, root) after more links (a, b): each node is tied to its root so far."""
    known = more.select("a", "b") if roots is None else more.select("a", "b").union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return connected_components(known)


def _linked(close: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components (node, root) after every pair of close (a, b, near) that is a link."""
    ends = close.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "near")
    some = W.partitionBy("node").orderBy((F.col("near") < 0.8).cast("int"), F.xxhash64("a", "b"), "a", "b")
    first = ends.withColumn("r", F.row_number().over(some)).where(F.col("r") <= FIRST_LINKS).select("a", "b").distinct()
    known = _joined(_confirmed(first, sets), roots)
    rest = materialise(_confirmed(_crossing(close, known), sets), "links")
    after = known if rest.isEmpty() else _joined(rest, known)
    for old in (rest, roots, known):
        if old is not None and old is not after:
            discard(old)
    return after


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (key, copies, n_shingles, least_id, sketch) and (node, root) of those that were linked or looked at."""
    of_key = [F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("sig").alias("sig")]
    classes = materialise(signed.where("key IS NOT NULL").groupBy("key").agg(*of_key), "classes")
    trees = classes.select("key", "sig").mapInArrow(_trees, "tree int, path binary, key binary")
    runs = trees.repartitionByRange("tree", "path", "key").sortWithinPartitions("tree", "path", "key")
    found = materialise(runs.mapInArrow(_neighbours, "kind int, tree int, path binary, a binary, b binary"), "neighbours")
    prefix = F.substring("path", 1, 4 * MIN_DEPTH)
    region = F.xxhash64("tree", prefix).alias("region")
    borders = found.where("kind = 2").select("tree", "path", "a", region).distinct()
    along = W.partitionBy("region").orderBy("tree", "path", "a")
    behind = borders.select("a", F.array(*[F.lead("a", j).over(along) for j in range(1, NEAR + 1)]).alias("next"))
    across = behind.select("a", F.explode("next").alias("b")).where("b IS NOT NULL")
    pairs = _ordered(found.where("kind = 0").select("a", "b").union(across))
    close = materialise(_estimated(pairs, classes), "close")
    filled = borders.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NEAR)
    crowded = found.where("kind = 1").select(region, F.col("a").alias("key")).union(borders.join(filled, "region", "left_semi").select("region", F.col("a").alias("key"))).distinct()
    crowded = materialise(crowded, "crowded")

    nodes = close.select(F.explode(F.array("a", "b")).alias("key")).union(crowded.select("key")).distinct()
    sets = materialise(_full_sets(docs, classes, nodes), "sets")
    roots = _linked(close, sets, None)
    more = _crowded_pairs(crowded, classes, sets, roots)
    if not more.isEmpty():
        roots = _linked(more, sets, roots)
    for old in (found, close, crowded, more, sets):
        discard(old)
    return classes, roots


def _crowded_pairs(crowded: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Close pairs (a, b, near) of classes of different components, among them all links within the regions of crowded (region, key)."""
    placed = crowded.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    several = placed.join(mixed, "region", "left_semi").select("key", "root").distinct()
    several = materialise(several.join(classes.select("key", F.col("n_shingles").alias("n")), "key"), "several")
    rows = several.select("key", F.xxhash64("root").alias("home")).join(sets, "key").select("key", "home", "items").mapInArrow(_set_rows, "key binary, home long, item long")
    shared = rows.groupBy("item").agg(F.count(F.lit(1)).alias("uses"), F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high")
    shared = materialise(shared.select("item", "uses"), "shared")
    own = rows.select("key", "item").join(shared, "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("uses", "item"))).alias("items"))
    need = F.ceil(F.col("n") * PERCENT / 100).cast("int")
    posted = own.join(several, "key").where(F.size("items") >= need)
    posted = posted.select("key", "root", "n", F.size("items").alias("size"), F.posexplode(F.slice("items", F.lit(1), F.size("items") - need + 1)).alias("i", "x"))
    postings = materialise(posted.select(F.col("x.item").alias("item"), "key", "root", "n", (F.col("size") - F.col("i")).alias("left")), "postings")
    homes = postings.groupBy("item", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("item")
    # written down, so that the joins read plain exchanges, of which Spark splits the parts with hot shingles
    meeting = homes.agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("homes")).where("homes > 1").select("item", "largest")
    meeting = materialise(meeting, "meeting")
    side = lambda x: postings.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "root", "n", "left")])
    one = side("a").join(meeting, "item").where("root_a <> largest").drop("largest")
    sizes = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b) AND {100 + PERCENT} * least(left_a, left_b) >= {PERCENT} * (n_a + n_b)"
    met = one.join(side("b"), "item").where("root_a <> root_b").where(sizes)
    out = materialise(_estimated(_ordered(met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))), classes), "close")
    for old in (several, shared, postings, meeting):
        discard(old)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows of classes with very many copies get their component from a table of HOT_SHARE rows at most, which is broadcast;
    rows without shingles need none; only the others meet their class by a shuffle.
    """
    signed = materialise(docs.select("doc_id", "text").mapInArrow(_sign, SIGNED), "signed")
    classes, roots = links(docs, signed)
    own = roots.join(classes.select(F.col("key").alias("node"), "least_id"), "node")
    of_root = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("key"), "component_id")
    by_key = classes.select("key", "copies", "least_id").join(linked, "key", "left").select("key", "copies", F.coalesce("component_id", "least_id").alias("component_id"))
    by_key = materialise(by_key, "by_key")
    for old in (classes, roots):
        discard(old)
    least = max(HOT, -(-signed.count() // HOT_SHARE))
    hot = F.broadcast(by_key.where(F.col("copies") > least).drop("copies"))
    rows = signed.select("doc_id", "n_shingles", "key")
    full, columns = rows.where("key IS NOT NULL"), ("doc_id", "n_shingles", "component_id")
    each = (
        rows.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        .union(full.join(hot, "key").select(*columns))
        .union(full.join(hot, "key", "left_anti").join(by_key.where(F.col("copies") <= least), "key").select(*columns))
    )
    return each.select(*columns, F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the least doc_id; of its repeated rows, one."""
    stay = near_duplicates(docs).where("kept").select("doc_id").distinct()
    kept = docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
