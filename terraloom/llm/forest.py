"""Near-duplicates by an LSH forest with exact confirmation.

1. Documents become sets of hashed shingles; equal sets are one class from there on, so copies cost one row.
2. A class has SIGNATURE MinHash values. Each of TREES trees is a sorted order of the classes by some of these values;
   the first LEAST_DEPTH must agree for two classes to be candidates, the others (DEEPER, a byte each) refine the order,
   so that in a crowded region a class's neighbours are those with the longest common prefix: depth adapts to the region.
   The orders are range-partitioned, so a crowded region spreads over tasks.
3. Neighbours whose set sizes fit and whose signatures agree in LEAST_AGREED values are candidates. In rounds, each class has its best untested
   candidates of other components confirmed on full sets (64-bit hashes of all shingles), until none is left; so a large
   group of near copies costs about one confirmation for each member, not one for each pair. Each round's links join the
   components of the round before, so its search for components is on these alone.
4. Once groups are known, all classes of a region (equal first values) that are of different components are compared,
   however many there are: a crowded region is cut into blocks, and each pair of blocks is a group of rows that finds the
   candidates by signature, then confirms them on full sets in place. So no row is made for a pair, and a pair that
   several trees bring together is compared in the first of them only.

Two sets with a similarity of 0.75 share the first LEAST_DEPTH = 4 values of a tree with probability 0.32, of none of 36
trees with about 1e-6; step 4 misses no other pair but those that the signatures' filter loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraloom.llm.common import WordHasher, batched, is_small, materialize, mix64, table
from terraloom.llm.graph import components

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
SIGNATURE, TREES, LEAST_DEPTH, DEEPER = 128, 36, 4, 8
#: Neighbours to either side in the first search.
NEAR = 2
#: Classes of a block of a region, and bytes of their sets; both on average.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Signature values of 128 that must agree for a candidate: at 0.75, 96 do on average, fewer than 72 once in 2 million times.
LEAST_AGREED = 72
#: Candidates of a class confirmed in each round; the comparison of whole regions covers the others.
ROUNDS = (1, 6)
BATCH_BYTES = 1 << 20

_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(0, 1 << 32, SIGNATURE, np.uint64) | np.uint64(1)).astype(np.uint32)
_SUMMANDS = _rng.integers(0, 1 << 32, SIGNATURE, np.uint64).astype(np.uint32)
_ORDERS = np.stack([_rng.permutation(SIGNATURE)[: LEAST_DEPTH + DEEPER] for _ in range(TREES)])
_WORD_FACTORS = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(hasher: WordHasher, texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's five-word shingles, or of its whole word sequence if shorter."""
    words, first = hasher.hash(texts)
    n = len(words)
    rolled = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled += words[k : n - WORDS + 1 + k] * _WORD_FACTORS[k] if len(rolled) else rolled
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * _WORD_FACTORS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SIGNATURE, 0xFFFF_FFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (low[at : at + 4096, None] * _FACTORS + _SUMMANDS).min(axis=0), out=out)
    return out


def set_key(shingles: np.ndarray) -> int | None:
    """63 bits that equal sets share: two independent sums of the hashes and the size, folded."""
    if not len(shingles):
        return None
    sums = np.array([shingles.sum(), mix64(shingles ^ np.uint64(0xA5A5)).sum(), len(shingles)], np.uint64)
    return int(mix64(np.array([(sums * np.array([3, 5, 7], np.uint64)).sum()]))[0] >> np.uint64(1))


def describe(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, class (of equal sets; null if empty), signature, mark (hash of the text)."""
    names = ["doc_id", "n_shingles", "class", "signature", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batched([texts], BATCH_BYTES):
                sets = shingle_sets(hasher, texts[a:b])
                keys = [set_key(s) for s in sets]
                signs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.binary()), batch.column(2).slice(a, b - a)], names=names)

    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("mark"))
    return read.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long, signature binary, mark long")


def region_of(values: np.ndarray, tree: int) -> np.ndarray:
    """Hash of a tree's first values, for signatures as rows of 64-bit integers."""
    region = np.full(len(values), tree + 1, np.uint64)
    for k in _ORDERS[tree, :LEAST_DEPTH]:
        region = mix64(region * np.uint64(0x100000001B3) + values[:, k])
    return region


def neighbours(rows: DataFrame, reach: int) -> DataFrame:
    """rows(class, signature) -> a, b, n: pairs within `reach` places of each other in n trees' orders."""
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE).astype(np.uint64)
                for t in range(TREES):
                    deep = np.zeros(len(values), np.uint64)
                    for k in _ORDERS[t, LEAST_DEPTH:]:
                        deep = (deep << np.uint64(8)) | (mix64(values[:, k]) & np.uint64(255))
                    yield pa.RecordBatch.from_arrays([pa.array(region_of(values, t).astype(np.int64)), pa.array(deep.astype(np.int64)), part.column(0)], names=["region", "deep", "class"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            region, own = (np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, (0, 2), strict=True))
            fresh = len(kept[0])
            out_a, out_b = [], []
            for k in range(1, reach + 1):
                left, right = np.arange(max(fresh - k, 0), len(region) - k), np.arange(max(fresh, k), len(region))
                hit = region[left] == region[right]
                out_a.append(np.minimum(own[left[hit]], own[right[hit]]))
                out_b.append(np.maximum(own[left[hit]], own[right[hit]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
            kept = [x[-reach:] for x in (region, own)]

    planted = rows.select("class", "signature").mapInArrow(plant, "region long, deep long, class long")
    ordered = planted.repartitionByRange("region", "deep", "class").sortWithinPartitions("region", "deep", "class")
    return ordered.mapInArrow(look, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))


def ends(pairs: DataFrame) -> DataFrame:
    """class: all that occur in pairs(a, b), once. Each side is made distinct for itself, so that no row is made for an end of a pair."""
    a, b = (pairs.select(F.col(k).alias("class")).distinct() for k in "ab")
    return a.unionByName(b).distinct()


def brief_of(signatures: pa.Array) -> np.ndarray:
    """A byte of each signature value, a row for each signature."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, SIGNATURE)
    return (mix64(values) & np.uint64(255)).astype(np.uint8)


def _sizes_fit() -> Column:
    """Whether sets of size_a and size_b can be similar enough at all: the intersection is at most the smaller, the union at least the larger."""
    return 100 * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs(a, b, n) whose sizes fit and whose signatures agree in LEAST_AGREED values at least."""
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in brief_of(batch.column(1))], pa.binary())], names=["class", "size", "brief"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in (3, 4))
            near = pa.array((left == right).sum(axis=1) >= LEAST_AGREED)
            yield batch.select(["a", "b", "n"]).filter(near)

    short = nodes.select("class", "signature", "size").mapInArrow(shorten, "class long, size long, brief binary")
    left, right = (short.select(F.col("class").alias(k), F.col("size").alias(f"size_{k}"), F.col("brief").alias(f"brief_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_sizes_fit()).select("a", "b", "n", "brief_a", "brief_b").mapInArrow(hold, "a long, b long, n long")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, ca, cb), sets(class, shingles) -> a, b: components ca and cb of the pairs whose whole sets are similar enough."""
    both = pairs.select("a", "b", "ca", "cb", F.explode(F.array("a", "b")).alias("class"))
    if is_small(both, 48):
        both = F.broadcast(both)
    joined = sets.join(both, "class").select("a", "b", "ca", "cb", "shingles")
    joined = joined.repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for a, b, ca, cb, s in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if last is not None and last[:2] == (a, b):
                    both_ = len(np.intersect1d(last[2], s, assume_unique=True))
                    if 100 * both_ >= PERCENT * (len(s) + len(last[2]) - both_):
                        out.append((ca, cb))
                    last = None
                else:
                    last = a, b, s.copy()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b"])

    return materialize(joined.mapInArrow(run, "a long, b long"), "forest-confirmed")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each (region, i, j) of sorted batches, of groups with several components."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            if held and (keys[a] != last).any():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _close(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """A row of a group and the later ones that may be linked to it, for all rows with any."""
    i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
    tree = group.column(4)[0].as_py()
    own, component, size = (group.column(c).to_numpy() for c in (3, 6, 7))
    if component.min() == component.max():
        return
    marks = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint8).reshape(len(own), -1)
    brief, regions = marks[:, :SIGNATURE], np.ascontiguousarray(marks[:, SIGNATURE:]).view(np.uint32)
    for k in range(len(own) - 1):
        hit = component[k + 1 :] != component[k]
        hit &= 100 * np.minimum(size[k], size[k + 1 :]) >= PERCENT * np.maximum(size[k], size[k + 1 :])
        if i != j:
            hit &= own[k + 1 :] != own[k]
        right = k + 1 + np.flatnonzero(hit)
        right = right[(brief[right] == brief[k]).sum(axis=1) >= LEAST_AGREED]
        right = right[~(regions[right, :tree] == regions[k, :tree]).any(axis=1)]  # met in an earlier tree
        if len(right):
            yield k, right


def region_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(class, signature, size, component), sets(class, shingles) -> a, b: links that join all components with a link in some region."""
    def plant(marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    part = batch.slice(at, 2_000)
                    values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE).astype(np.uint64)
                    regions = np.stack([region_of(values, t) for t in range(TREES)], axis=1)
                    marks = [b""] * len(values)
                    if marked:  # a byte of each signature value, 32 bits of each tree's region
                        marks = [m.tobytes() for m in np.hstack([brief_of(part.column(1)), np.ascontiguousarray(regions.astype(np.uint32)).view(np.uint8)])]
                    for t in range(TREES):
                        yield pa.RecordBatch.from_arrays([pa.array(regions[:, t].astype(np.int64)), pa.array(np.full(len(values), t), pa.int32()), part.column(0), part.column(3), part.column(2), pa.array(marks, pa.binary())], names=["region", "tree", "class", "component", "size", "marks"])

        return run

    rows = rows.select("class", "signature", "size", "component")
    kind = "region long, tree int, class long, component long, size long, marks binary"
    regions = rows.mapInArrow(plant(False), kind).groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.min("component").alias("least"), F.max("component").alias("most"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("sizes") * 8 / BLOCK_BYTES)).cast("int")
    regions = materialize(regions.filter("least < most").select("region", parts.alias("parts")), "forest-regions")
    if is_small(regions, 24):
        regions = F.broadcast(regions)
    dealt = rows.mapInArrow(plant(True), kind).join(regions, "region").withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["region", "i", "j"]
    dealt = dealt.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tree", "class", "component", "size", "marks")

    def doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            met = np.zeros(group.num_rows, bool)
            for k, right in _close(group):
                met[k] = met[right] = True
            if met.any():
                yield group.filter(pa.array(met))

    doubtful = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(doubt, dealt.schema), "forest-doubtful")
    few = F.broadcast(doubtful) if is_small(doubtful, 60 + 5 * SIGNATURE) else doubtful
    joined = sets.join(few, "class").select(*doubtful.columns, "shingles").repartition(*keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            component, size = (group.column(c).to_numpy() for c in (6, 7))
            stop = np.cumsum(size)
            number = np.unique(np.frombuffer(b"".join(group.column(9).to_pylist()), np.uint64), return_inverse=True)[1]
            root = np.unique(component, return_inverse=True)[1]
            here = np.zeros(number.max() + 1, np.int64)
            out = []
            for k, right in _close(group):
                right = right[root[right] != root[k]]
                if not len(right):
                    continue
                own = number[stop[k] - size[k] : stop[k]]
                here[own] = 1
                both = np.add.reduceat(here[np.concatenate([number[stop[r] - size[r] : stop[r]] for r in right])], np.cumsum(size[right]) - size[right])
                here[own] = 0
                for r in right[100 * both >= PERCENT * (size[k] + size[right] - both)]:
                    if root[r] != root[k]:
                        root[root == root[r]] = root[k]
                        out.append((component[k], component[r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b"])

    return materialize(joined.mapInArrow(link, "a long, b long"), "forest-linked-regions")


def merge_components(where: DataFrame, links: DataFrame) -> DataFrame:
    """where(class, size, component) after links(a, b) between components: only what is new is searched, on components, not on classes."""
    found = components(links)
    out = where.join(found, where["component"] == found["node"], "left").select("class", "size", F.coalesce(found["component"], where["component"]).alias("component"))
    return materialize(out, "forest-where")


def link_classes(docs: DataFrame, described: DataFrame) -> DataFrame:
    """class, component for every class of at least two that are linked."""
    order = Window.partitionBy("class").orderBy("doc_id", "mark")
    classes = described.filter(F.col("class").isNotNull()).withColumn("r", F.row_number().over(order)).filter("r = 1")
    classes = materialize(classes.select("class", "doc_id", "mark", F.col("n_shingles").alias("size"), "signature"), "forest-classes")
    found = materialize(neighbours(classes, NEAR), "forest-found")
    pairs = materialize(alike(found, classes), "forest-pairs")
    involved = ends(found)
    nodes = materialize(classes.join(involved, "class"), "forest-nodes")
    sets = materialize(_sets(docs, nodes.select("class", "doc_id", "mark")), "forest-sets")
    where = nodes.select("class", "size", F.col("class").alias("component"))
    pairs = pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})

    def between(pairs: DataFrame) -> DataFrame:
        """Pairs of different components whose sizes fit, with their components."""
        left, right = (where.select(F.col("class").alias(k), F.col("component").alias(f"c{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
        return pairs.select("a", "b", "n").join(left, "a").join(right, "b").filter("ca <> cb").filter(_sizes_fit()).drop("size_a", "size_b")

    for most in ROUNDS:
        # best candidates of each class first; the others wait
        sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        ranked = sides.withColumn("r", F.row_number().over(best)).withColumn("own", F.col("a") < F.col("b"))
        place = F.struct("ca", "cb", "n")
        pairs = ranked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.when(F.col("own"), place)).alias("x"), (F.min("r") <= most).alias("now")).select("a", "b", "x.*", "now")
        pairs = materialize(pairs, "forest-todo")
        todo = pairs.filter("now")
        links = confirm(todo, sets)
        if not links.isEmpty():
            where = merge_components(where, links)
        pairs = between(pairs.filter("NOT now"))
    links = region_links(nodes.select("class", "signature").join(where, "class"), sets)
    if not links.isEmpty():
        where = merge_components(where, links)
    where = where.select("class", "component")
    return where.filter("class <> component").unionByName(where.filter("class <> component").select(F.col("component").alias("class"), "component").distinct())


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """class, shingles (sorted 64-bit hashes) of the document that stands for each class.

    It is found by its id and the hash of its text together, as ids may be null or repeat, and its set must have the class's key.
    """
    few = nodes.select(F.col("doc_id").alias("node_id"), F.col("mark").alias("node_mark"), "class")
    if is_small(few, 32):
        few = F.broadcast(few)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    texts = marked.join(few, (marked["mark"] == few["node_mark"]) & marked["doc_id"].eqNullSafe(few["node_id"])).select("class", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts_, classes = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in batched([texts_], BATCH_BYTES):
                own = [(c, s.tobytes()) for c, s in zip(classes[a:b], shingle_sets(hasher, texts_[a:b]), strict=True) if set_key(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["class", "shingles"])

    return texts.mapInArrow(run, "class long, shingles binary").dropDuplicates(["class"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id is component_id).

    Words: ASCII-lower-cased, between ASCII white space. Null texts and texts without words have no shingles and no
    links. Rows of equal id and text are alike: they share component and fate. Null ids take part and are never the
    smallest; a component of null ids only has a null component_id. Empty tables give empty results.
    """
    docs = docs.select("doc_id", "text")
    described = materialize(describe(docs), "forest-docs")
    linked = materialize(link_classes(docs, described), "forest-linked")
    rows = described.select("doc_id", "n_shingles", "class").join(linked, "class", "left")
    rows = rows.withColumn("component", F.coalesce("component", "class"))
    least = rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Component and decision for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, hash(unnest(shingles)) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n_shingles + y.n_shingles - both_have)),
e AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.least FROM reach r JOIN e ON e.x = r.node WHERE r.least < e.y),
c AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON node = doc_id
"""
