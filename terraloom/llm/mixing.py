"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; the smallest keys of a source are its weighted
sample without replacement. Whole epochs of a source come first, the rest of its budget is filled in key order.

Prefix sums are spread: keys fall into buckets of about BUCKET_ROWS documents (a monotone function of the key), bucket
totals are summed over a table of buckets, and only the bucket at a source's budget is summed row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, table, word_count

BUCKET_ROWS = 2_000
#: Steps of the weight in which a source's law of keys is kept.
WEIGHT_STEPS = 10
#: Passes that fill what is left of a budget with the documents that still fit.
PASSES = 4
MAX_REPEATS = 3


def water_fill(sizes: list[int], weights: list[float], total: int, limit: int = MAX_REPEATS) -> list[float]:
    """Shares of total by weight, none above limit x its size; the excess goes to the others by weight until none is above."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if weights[i] > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > limit * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(limit * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of ASCII lower-case letters and spaces among a text's bytes, a plain measure of prose."""
    raw = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(raw, "[^a-z ]", ""))
    return F.lit(0.1) + F.lit(0.9) * (plain / F.greatest(F.length(raw), F.lit(1)))


def uniform_of(seed: int, *columns: Column) -> Column:
    """In (0, 1), from the md5 of the columns' text: the same in every run and every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def plan_mix(sized: DataFrame, seed: int = 11) -> DataFrame:
    """sized(row columns..., source, size, weight, u) -> the same with source_size, target and copies (times taken).

    One row per source reaches the driver: the number of sources is that of a mix's weights, not of documents.
    """
    spark = sized.sparkSession
    sized = materialize(sized, "mix-sizes")
    step = sized.groupBy("source", F.floor(F.col("weight") * WEIGHT_STEPS).alias("step")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("weight").alias("w"))
    sources = step.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "w")).alias("law")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    if not sources:
        return sized.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.lit(0)})
    sizes = [int(r["source_size"]) for r in sources]
    targets = water_fill(sizes, [1.0 + i % 3 for i in range(len(sources))], sum(sizes))
    plan = []
    for i, r in enumerate(sources):
        epochs = 0 if sizes[i] == 0 else min(int(targets[i] // sizes[i]), MAX_REPEATS)
        budget = math.floor(targets[i] - epochs * sizes[i] + 0.5) if epochs < MAX_REPEATS else 0
        plan.append((i, r["source"], sizes[i], targets[i], epochs, budget, max(1, math.ceil(r["n"] / BUCKET_ROWS)), [(x["n"], x["w"]) for x in r["law"]], r["n"]))
    plan = spark.createDataFrame(plan, "sid int, source string, source_size long, target double, epochs int, budget long, buckets int, law array<struct<n double, w double>>, rows long")
    keyed = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    keyed = keyed.withColumn("key", -F.log(F.col("u")) / F.col("weight")).withColumn("chosen", F.lit(False))
    # buckets follow the keys' own law, so that they are of one size whatever the weights: the mean of 1 - exp(-weight * key) over the source's weights
    below = F.aggregate("law", F.lit(0.0), lambda t, x: t + x["n"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("rows")
    keyed = keyed.withColumn("bucket", F.least((F.col("buckets") * below).cast("int"), F.col("buckets") - 1)).drop("law", "rows")
    for k in range(PASSES):
        keyed = materialize(_fill(keyed), f"mix-pass{k}")
    copies = F.col("epochs") + F.col("chosen").cast("int")
    return keyed.withColumn("copies", copies).drop("sid", "epochs", "budget", "buckets", "key", "chosen", "bucket")


def _fill(keyed: DataFrame) -> DataFrame:
    """Chooses, in key order, the longest run of the open documents that fit the budget; takes their sizes off it."""
    fits = ~F.col("chosen") & (F.col("size") <= F.col("budget")) & (F.col("size") > 0)
    totals = keyed.filter(fits).groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("sid").orderBy("bucket")
    totals = totals.withColumn("before", F.sum("bucket_size").over(upto) - F.col("bucket_size"))
    keyed = keyed.join(totals, ["sid", "bucket"], "left").withColumn("fits", fits)
    at_edge = F.col("fits") & (F.col("before") < F.col("budget")) & (F.col("before") + F.col("bucket_size") > F.col("budget"))
    edge = keyed.filter(at_edge)
    order = Window.partitionBy("sid").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("chosen", F.col("before") + F.sum("size").over(order) <= F.col("budget"))
    whole = keyed.filter(~F.coalesce(at_edge, F.lit(False)))
    whole = whole.withColumn("chosen", F.col("chosen") | F.coalesce(F.col("fits") & (F.col("before") + F.col("bucket_size") <= F.col("budget")), F.lit(False)))
    out = edge.unionByName(whole).withColumn("now", F.col("chosen") & F.col("fits"))
    spent = out.filter("now").groupBy("sid").agg(F.sum("size").alias("spent"))
    columns = [c for c in keyed.columns if c not in ("bucket_size", "before", "fits", "budget")]
    return out.join(F.broadcast(spent), "sid", "left").select(*columns, (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))


def size_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), uniform_of(seed, F.col("doc_id"), F.col("text")).alias("u"))


def mix_sources(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs(doc_id, source, text, ...) mixed: each document as often as the mix takes it (0 to 3 times), columns as they were.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Null texts have size 0: they cost no budget and come
    once for each whole epoch. Documents of equal id, source and text are alike and share one fate, each on its own row.
    Empty tables give empty results; columns beyond the three pass through. Columns named mix_id, mix_u, mix_source, mix_copies or
    mix_turn raise ValueError.
    """
    if {"mix_id", "mix_u", "mix_source", "mix_copies", "mix_turn"} & set(docs.columns):
        raise ValueError("the table has a column named mix_id, mix_u, mix_source, mix_copies or mix_turn")
    mixed = plan_mix(size_documents(docs, seed), seed)
    per_id = mixed.select(F.col("doc_id").alias("mix_id"), F.col("u").alias("mix_u"), F.col("source").alias("mix_source"), F.col("copies").alias("mix_copies")).groupBy("mix_id", "mix_u", "mix_source").agg(F.max("mix_copies").alias("mix_copies"))
    keyed = docs.withColumn("mix_u", uniform_of(seed, docs["doc_id"], docs["text"]))
    joined = keyed.join(per_id, keyed["doc_id"].eqNullSafe(per_id["mix_id"]) & (keyed["mix_u"] == per_id["mix_u"]) & keyed["source"].eqNullSafe(per_id["mix_source"]))
    repeated = joined.withColumn("mix_turn", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))))
    return repeated.select(*(docs[c] for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words that the mix takes of each."""
    mixed = plan_mix(size_documents(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _pass_sql(k: int) -> str:
    return f"""
f{k} AS (SELECT *, CASE WHEN NOT chosen AND size <= budget AND size > 0 THEN 1 ELSE 0 END AS fits FROM p{k}),
g{k} AS (SELECT *, fits = 1 AND sum(CASE WHEN fits = 1 THEN size ELSE 0 END)
    OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS picked FROM f{k}),
p{k + 1} AS (SELECT doc_id, sid, size, source_size, target, epochs, key, chosen OR picked AS chosen,
    budget - coalesce(sum(CASE WHEN picked THEN size END) OVER (PARTITION BY sid), 0) AS budget FROM g{k})"""


OP8_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    0.1::DOUBLE + 0.9::DOUBLE * (length(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS weight,
    ((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS sid FROM sized GROUP BY source),
weighted AS (SELECT *, (1 + sid % 3)::DOUBLE AS w, 3.0 * source_size / (1 + sid % 3) AS ratio FROM sources),
total AS (SELECT sum(source_size)::DOUBLE AS total FROM sources),
ranked AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(w) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM weighted),
level AS (SELECT (total - capped)::DOUBLE AS left_over, open_w::DOUBLE AS open_w FROM ranked, total
  WHERE (total - capped) / open_w <= ratio ORDER BY ratio, sid LIMIT 1),
targets AS (SELECT source, sid, source_size, least(3.0 * source_size, w * left_over / weights.open_w)::DOUBLE AS target FROM weighted, level AS weights),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT AS epochs FROM targets),
p0 AS (SELECT doc_id, sid, size, source_size, target, epochs, -ln(u) / weight AS key, FALSE AS chosen,
    CASE WHEN epochs < 3 THEN floor(target - epochs * source_size + 0.5) ELSE 0 END::BIGINT AS budget
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source),
{",".join(_pass_sql(k) for k in range(PASSES))}
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN chosen THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p{PASSES}
"""
