"""Source divergence audit: which sources of a language differ from each other, and by which terms.

Terms are counted in Spark by (language, source); a term is kept for a language where enough of its documents have it.
Shares are whole billionths, smoothed by one, so all arithmetic is exact.

Top terms are found by radix selection: distributed histograms over two bytes at a time of a sort key (value descending,
then the UTF-8 bytes of the term) narrow each group's boundary until few rows are open there; no group is ever sorted whole.

Divergences of pairs are sparse. Every pair of sources starts from the value that it would have if neither had any term;
each source's histogram of counts corrects that for the terms that one side has, and the terms that both sides have correct
it once more. So a term costs the square of the sources that have it, added up within a task, never a row for each pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import is_small, materialize, table

#: Shares are counted in this part of one.
UNIT = 1_000_000_000
#: A term is kept by a language if this many of its documents have it.
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Rows that may stay open at a group's boundary when the selection ends; they are ranked together with the k surely in.
OPEN_ROWS = 2_000
#: Distinct (group, term) that a task counts before it hands them on, bytes of text read at a time, pairs made at a time.
HELD_TERMS, TEXT_BYTES, PAIRS = 400_000, 1 << 20, 1 << 20

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _terms(text: bytes) -> Counter:
    """Occurrences of each term of one text; ASCII letters lower-cased. Long texts are read in pieces that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + TEXT_BYTES)
        stop = gap.start() if gap else len(text)
        found.update(TERM.findall(text[at:stop].lower()))
        at = stop
    return found


def count_terms(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> lang, source, term, n (occurrences), d (documents with it). Nulls count as ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n = len(terms)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                numbers = np.array(list(terms.values()), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], names=["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in _terms(text).items():
                    at = terms.get(term)
                    if at is None:
                        terms[term] = [n, 1]
                    else:
                        at[0] += n
                        at[1] += 1
                size += len(terms) - before
                if size > HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), in decimals, so that counts of any size stay exact. Null without kept terms."""
    top = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", top, (total + kept).cast("decimal(20,0)")) + 1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """rows with rank: the k first of each group by value (long, at least 0) descending, then by the item's UTF-8 bytes.

    rows must be a written table, as it is read once a round. Each round counts, for each group that is still open, the next
    two bytes of the sort keys at its boundary; the boundary moves two bytes on, until OPEN_ROWS at most are on it. Rows
    equal in value and item beyond that all stay open and are ranked in one task; keep (keys, item) distinct.
    """
    spark = rows.sparkSession
    order = F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col(value)), 16, "0")), F.col(item).cast("binary"))
    rows = rows.withColumn("_order", order)
    edge = rows.groupBy(*keys).agg(F.count("*").alias("_open")).select(*keys, F.lit(b"").alias("_edge"), F.lit(0).cast("long").alias("_sure"), "_open", F.lit(False).alias("_ended"))
    edge = materialize(edge, "radix-edge")
    depth = 0
    small = is_small(edge, 400)

    def meet(state: DataFrame) -> DataFrame:
        # groups are few or their table is dealt by key and split by AQE where one group is hot
        return rows.join(F.broadcast(state) if small else state.hint("shuffle_hash"), [rows[c].eqNullSafe(state[c]) for c in keys]).drop(*(state[c] for c in keys))

    wide = (F.col("_open") > max(OPEN_ROWS, k)) & ~F.col("_ended")
    while not edge.filter(wide).isEmpty():
        on_edge = meet(edge.filter(wide)).filter(F.substring("_order", 1, depth) == F.col("_edge"))
        # the next two bytes; where the key ends, its end comes first
        bins = on_edge.withColumn("_next", F.substring("_order", depth + 1, 2)).groupBy(*keys, "_edge", "_sure", "_next").agg(F.count("*").alias("_n"))
        running = Window.partitionBy(*keys).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.col("_sure") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        crossed = bins.filter((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k))
        moved = crossed.select(*keys, F.concat("_edge", "_next").alias("_edge"), F.col("_before").alias("_sure"), F.col("_n").alias("_open"), (F.length("_next") < 2).alias("_ended"))
        still = edge.filter(~wide)
        edge = materialize(still.unionByName(moved), "radix-edge")
        depth += 2
    # a key that has ended is one row: longer keys that begin alike come after it
    head = F.substring("_order", F.lit(1), F.length("_edge"))
    near = meet(edge).filter((head < F.col("_edge")) | ((head == F.col("_edge")) & (~F.col("_ended") | (F.col("_order") == F.col("_edge")))))
    best = Window.partitionBy(*keys).orderBy(F.desc(value), item)
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_order", "_edge", "_sure", "_open", "_ended")


def _common(shared: DataFrame) -> DataFrame:
    """shared(g, p, z: arrays by term of group number, share, share of an absent term) -> a, b, part of the divergence: corrections for terms of both."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_, b_, v_ = [], [], []
        waiting = 0

        def merged() -> tuple:
            a, b, v = (np.concatenate(x) for x in (a_, b_, v_))
            at = np.lexsort((b, a))
            a, b, v = a[at], b[at], v[at]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return a[first], b[first], np.add.reduceat(v, first)

        for batch in batches:
            for g, p, z in zip(*(batch.column(i) for i in range(3)), strict=True):
                g, p, z = (x.values.to_numpy(zero_copy_only=False) for x in (g, p, z))
                step = max(1, PAIRS // len(g))
                for at in range(0, len(g), step):
                    pa_, za = p[at : at + step, None], z[at : at + step, None]
                    v = _apart(pa_, p) - _apart(pa_, z) - _apart(za, p) + _apart(za, z)
                    other = np.repeat(g[at : at + step], len(g)), np.tile(g, len(v)), v.ravel()
                    fine = other[0] != other[1]
                    for out, x in zip((a_, b_, v_), other, strict=True):
                        out.append(x[fine])
                    waiting += int(fine.sum())
                    if waiting > PAIRS:
                        one = merged()
                        if len(one[0]) > PAIRS // 2:  # more pairs than a task holds
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in one], names=["a", "b", "value"])
                            one = tuple(x[:0] for x in one)
                        a_, b_, v_ = ([x] for x in one)
                        waiting = len(one[0])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["a", "b", "value"])

    return shared.mapInArrow(add, "a long, b long, value long")


def _one_sided(sides: DataFrame) -> DataFrame:
    """sides(g, z, kept, p, m, others, zs) by group -> a, b, value: the base of each pair from g, and both corrections for g's own terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g, z, kept = (batch.column(i)[r].as_py() for i in range(3))
                p, m, others, zs = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(3, 7))
                there, back = np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
                step = max(1, PAIRS // max(1, len(p)))
                for at in range(0, len(others) if kept else 0, step):
                    q = zs[at : at + step, None]
                    none, none_back = _apart(np.int64(z), q), _apart(q, np.int64(z))
                    there[at : at + step] = kept * none[:, 0] + ((_apart(p[None], q) - none) * m).sum(axis=1)
                    back[at : at + step] = ((_apart(q, p[None]) - none_back) * m).sum(axis=1)
                fine = others != g
                others, there, back = others[fine], there[fine], back[fine]
                own = np.full(len(others), g, np.int64)
                columns = np.concatenate([own, others]), np.concatenate([others, own]), np.concatenate([there, back])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "value"])

    return sides.mapInArrow(add, "a long, b long, value long")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank.

    part `pair`: item is each other source of the language, value its divergence from the row's source. part `term`: the
    `top` terms that the source uses more than its language does. Null text, lang and source count as ''; a repeated row is
    a document as well; sources without terms take part; a language without kept terms has pairs of value 0. Other columns
    are ignored. Empty input gives no rows. A language may keep up to 10**9 terms: beyond that sums could exceed 64 bits.
    """
    spark = docs.sparkSession
    counts = count_terms(docs)
    by_term = Window.partitionBy("lang", "term")
    entries = counts.withColumn("all_n", F.sum("n").over(by_term)).withColumn("all_d", F.sum("d").over(by_term)).filter(F.col("all_d") >= least)
    entries = materialize(entries.select("lang", "source", "term", "n", "all_n"), "divergence-terms")
    kept = entries.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = F.lit(0).cast("long")
    groups = there.join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "all_total", "total"])
    groups = groups.withColumn("z", F.coalesce(_share(zero, F.col("total"), F.col("kept")), zero)).withColumn("g", F.monotonically_increasing_id())
    groups = materialize(groups, "divergence-groups")
    few = is_small(groups, 400)
    known = F.broadcast(groups) if few else groups
    shares = entries.join(known, ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", _share(F.col("all_n"), F.col("all_total"), F.col("kept")))
    shares = materialize(shares.select("g", "lang", "term", "n", "p", "q", "z"), "divergence-shares")

    # terms
    over = shares.filter("p > q").select("g", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = radix_top(materialize(over, "divergence-over"), ["g"], "value", "item", top)

    # pairs
    both = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "z")).alias("e")).filter(F.size("e") > 1)
    common = _common(both.select("e.g", "e.p", "e.z"))
    bars = shares.groupBy("g", "p").agg(F.count("*").alias("m")).groupBy("g").agg(F.collect_list(F.struct("p", "m")).alias("h"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "z")).alias("o"))
    empty = F.array().cast("array<struct<p:bigint,m:bigint>>")
    sides = groups.join(bars, "g", "left").join(peers, "lang").select("g", "z", "kept", F.coalesce("h", empty).alias("h"), "o")
    single = _one_sided(sides.select("g", "z", "kept", "h.p", "h.m", F.col("o.g").alias("others"), F.col("o.z").alias("zs")))
    summed = common.unionByName(single).groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = groups.select(F.col("g").alias("b"), F.col("source").alias("item"))
    pairs = summed.join(F.broadcast(names) if few else names, "b").withColumnRenamed("a", "g")
    place = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place))

    columns = ["g", "part", "item", "value", "rank"]
    found = pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
    own = groups.select("g", "lang", "source")
    return found.join(F.broadcast(own) if few else own, "g").select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of the sources of documents within each language, and the terms that make it."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS kept, sum(all_n)::HUGEINT AS all_total FROM t GROUP BY lang),
g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(all_total), 0) AS all_total, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v ON s.lang = v.lang
  LEFT JOIN (SELECT lang, source, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY lang, source) c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, source, term),
p AS MATERIALIZED (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (total + kept))::HUGEINT AS p, (1 + 1000000000 * (all_n + 1) // (all_total + kept))::HUGEINT AS q
  FROM g JOIN t ON g.lang = t.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM allpairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
