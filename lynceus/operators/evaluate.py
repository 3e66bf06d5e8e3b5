"""Retrieval, classification and extraction quality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(golden: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row for each query: rank of the expected document, hits, reciprocal rank, nDCG of the largest k.

    ``golden``: ``query_id, expected``; ``ranked``: ``query_id, id, rank``.
    """
    hit = golden.join(ranked, (golden["query_id"] == ranked["query_id"]) & (golden["expected"] == ranked["id"]), "left").groupBy(golden["query_id"], golden["expected"]).agg(F.min("rank").alias("rank"))
    last = max(ks)
    within = F.col("rank") <= last
    return hit.select(
        "query_id",
        "expected",
        "rank",
        *[F.when(F.col("rank") <= k, 1).otherwise(0).alias(f"hit_{k}") for k in ks],
        F.when(within, 1 / F.col("rank")).otherwise(0.0).alias("rr"),
        F.when(within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias(f"ndcg_{last}"),
    )


def retrieval_summary(rows: DataFrame, *by: str) -> DataFrame:
    metrics = [c for c in rows.columns if c.startswith(("hit_", "ndcg_")) or c == "rr"]
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias("mrr" if c == "rr" else c) for c in metrics])


def misses(rows: DataFrame, column: str = "hit_10") -> DataFrame:
    return rows.where(F.col(column) == 0)


def agreement(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: how often the predicted types hold the true one, how often there are any, how many."""
    return rows.agg(
        F.round(F.avg(F.when(F.array_contains(predicted, F.col(truth)), 1.0).otherwise(0.0)), 6).alias("agreement"),
        F.round(F.avg(F.when(F.size(predicted) > 0, 1.0).otherwise(0.0)), 6).alias("coverage"),
        F.round(F.avg(F.size(predicted).cast("double")), 6).alias("average_types"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def running_until(rows: DataFrame, amount: str, target: float, order: str, *partition: str) -> DataFrame:
    """Rows in order until the sum reaches the target; the row that reaches it is kept."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(amount).over(w)).where(F.col("running") - F.col(amount) < target)


def quota_sample(rows: DataFrame, stratum: str, quota: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``quota`` rows of each stratum, chosen by a hash of key and seed: the same ones every time."""
    order = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")), 256)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("_n") <= quota).drop("_n")


def variants(name: str) -> list[str]:
    """``papercut mf/ng`` as ``papercut mf`` and ``papercut ng``; a name without a slash as it is."""
    head, *rest = name.split("/")
    lead = head.rpartition(" ")[0].strip()
    return [head, *(f"{lead} {x.strip()}".strip() for x in rest)]


def same_entity(a: str, b: str) -> bool:
    """Equal but for spaces, or one of at least three letters within the other."""
    a, b = sorted((a.replace(" ", ""), b.replace(" ", "")), key=len)
    return a == b or (len(a) >= 3 and a in b)


def same_relation(a: str, b: str, of: str) -> bool:
    """Equal; using and exploiting a vulnerability or technique is one thing."""
    return a == b or ({a, b} == {"exploits", "uses"} and of.startswith(("cve-", "t1")))


def same_triplet(p: tuple, g: tuple) -> bool:
    objects = variants(g[2])
    return any(same_entity(p[0], x) for x in variants(g[0])) and any(same_entity(p[2], x) for x in objects) and any(same_relation(p[1], g[1], x) for x in objects)


ADVISORIES_AT_ONCE = 1024


def extraction(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``advisory_id, matched, gold, predicted, precision, recall, f1`` by greedy one-to-one matching.

    Gold triplets are taken in order; each takes the first free prediction that
    matches it. The order matters, so this is Python on one advisory at a time.
    """
    kind = gold.schema["advisory_id"].dataType.simpleString()
    wanted = ("advisory_id", "ordinal", "subject", "relation", "object")
    # fresh columns on both sides, which may come from one table
    gold, predicted = (side.select(*[F.concat(c, F.lit("")).alias(c) if kind_ == "string" else (F.col(c) + F.lit(0)).alias(c) for c, kind_ in ((c, side.schema[c].dataType.simpleString()) for c in wanted)]) for side in (gold, predicted))

    def triplets(side: list[dict]) -> list[tuple]:
        return [tuple((t[c] or "").strip().lower() for c in wanted[2:]) for t in side]

    def measures(g: list[dict], p: list[dict]) -> tuple:
        free, matched = triplets(p), 0
        for x in triplets(g):
            at = next((k for k, y in enumerate(free) if same_triplet(y, x)), None)
            if at is not None:
                free.pop(at)
                matched += 1
        precision, recall = matched / len(p) if p else 0.0, matched / len(g) if g else 0.0
        return matched, len(g), len(p), precision, recall, 2 * precision * recall / (precision + recall) if matched else 0.0

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, ADVISORIES_AT_ONCE):
                ids, g, p = batch.slice(start, ADVISORIES_AT_ONCE).columns
                columns = zip(*[measures(*sides) for sides in zip(g.to_pylist(), p.to_pylist())])
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 3)]], names=["advisory_id", "matched", "gold", "predicted", "precision", "recall", "f1"])

    # a side's triplets as one array, in order: a group costs a row and not a call
    per = lambda side, into: side.groupBy("advisory_id").agg(F.array_sort(F.collect_list(F.struct(F.isnull("ordinal").alias("_last"), *wanted[1:]))).alias(into))
    none = F.array()
    g, p = per(gold, "g"), per(predicted, "p").withColumnRenamed("advisory_id", "_id")
    both = g.join(p, F.col("advisory_id").eqNullSafe(F.col("_id")), "full_outer").select(F.coalesce("advisory_id", "_id").alias("advisory_id"), F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    return both.mapInArrow(run, f"advisory_id {kind}, matched int, gold int, predicted int, precision double, recall double, f1 double")


def exact_extraction(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same with exact matches, in plain joins."""
    key = ["advisory_id", "subject", "relation", "object"]
    low = lambda d: d.select("advisory_id", *[F.lower(F.trim(c)).alias(c) for c in key[1:]]).distinct()
    g, p = low(gold).withColumn("g", F.lit(1)), low(predicted).withColumn("p", F.lit(1))
    counts = g.join(p, key, "full_outer").groupBy("advisory_id").agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("matched"), F.count("g").alias("gold"), F.count("p").alias("predicted"))
    return counts.withColumn("precision", F.coalesce(F.try_divide("matched", "predicted"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("matched", "gold"), F.lit(0.0)))


def pair_accuracy(pairs: DataFrame, truth: str = "same", predicted: str = "predicted") -> DataFrame:
    right = F.col(truth) == F.col(predicted)
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 6).alias("accuracy"))


def usable_advisories(triplets: DataFrame, lengths: DataFrame, *, most: int = 40, longest: int = 40_000, technique_share: float = 0.3, vague_share: float = 0.2) -> DataFrame:
    """Advisories fit for evaluation: not too many triplets or characters, few bare technique ids and vague names."""
    from lynceus.operators.filters import vague

    technique = F.col("subject").rlike(r"^T[0-9]{4}") | F.col("object").rlike(r"^T[0-9]{4}")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = triplets.groupBy("advisory_id").agg(F.count("*").alias("n"), share(technique).alias("techniques"), share(vague(F.col("subject")) | vague(F.col("object"))).alias("vague"))
    return per.join(lengths, "advisory_id").where((F.col("n") <= most) & (F.col("n_chars") <= longest) & (F.col("techniques") <= technique_share) & (F.col("vague") <= vague_share)).select("advisory_id", "n")
