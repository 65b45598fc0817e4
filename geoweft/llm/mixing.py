"""Mixing sources to target shares of tokens by Pareto order sampling after whole copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.llm import bpe
from geoweft.session import cut, spread

#: Ranges of the sampling order per level; two levels make about 16 million ranges per source.
RANGES = 4096
#: Rows of (source, number of equal texts) that may come to the driver; more raise an error. It also bounds the broadcasts,
#: which hold one row per source.
MAX_GROUPS = 200_000


def inclusion_factor(groups: list[tuple[int, int]], wanted: float) -> float:
    """The factor f with sum(tokens * min(1, f / copies)) = wanted, for (copies, tokens) of a source's documents."""
    total = sum(t for _, t in groups)
    if wanted <= 0 or total <= 0:
        return 0.0
    if wanted >= total:
        return float(max(c for c, _ in groups))
    certain, parts = 0, sorted(groups)
    for i, (copies, tokens) in enumerate(parts):
        rest = sum(t / c for c, t in parts[i:])
        f = (wanted - certain) / rest
        if f <= copies:
            return f
        certain += tokens
    return float(parts[-1][0])


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry per source of either side: how many whole copies and how many tokens of a sample on top it gives.

    Sources with documents and a target take part; their shares are scaled to 1. The total is total_tokens, or else the
    largest at which every source reaches its share with at most max_repeats uses of a document. With a total beyond that,
    a source that runs out gives all it may (status 'exhausted') and its share stays below the target. The counts that come
    to the driver are one row per source and number of equal texts.
    """
    shares = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    groups: dict[str | None, list] = {}
    documents: dict[str | None, int] = {}
    counted = sizes.groupBy("source", "copies").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(counted) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} sources and numbers of equal texts")
    for r in counted:
        groups.setdefault(r.source, []).append((r.copies, r.tokens))
        documents[r.source] = documents.get(r.source, 0) + r.n
    have = {s: sum(t for _, t in g) for s, g in groups.items()}
    taking = {s: v for s, v in shares.items() if have.get(s, 0) > 0}
    scale = sum(share for share, _ in taking.values())
    feasible = min((reps * have[s] / (share / scale) for s, (share, reps) in taking.items()), default=0.0)
    total = feasible if total_tokens is None else float(total_tokens)
    out = []
    for s in sorted(set(have) | set(shares), key=lambda x: (x is None, x or "")):
        share, reps = shares.get(s, (None, 0))
        entry = {"source": s, "target_share": share, "max_repeats": reps, "documents": documents.get(s, 0), "available": have.get(s, 0), "whole": 0, "wanted": 0.0, "factor": 0.0, "planned": 0.0}
        if s not in taking:
            entry["status"] = "no target" if s not in shares else "no documents"
        else:
            planned = min(total * share / scale, float(reps) * have[s])
            entry["status"] = "mixed" if planned >= total * share / scale * (1 - 1e-9) else "exhausted"
            entry["whole"] = min(reps, int(planned // have[s]))
            entry["wanted"] = max(0.0, planned - entry["whole"] * have[s]) if entry["whole"] < reps else 0.0
            entry["factor"] = inclusion_factor(groups[s], entry["wanted"])
            entry["planned"] = planned
        out.append(entry)
    return out


PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.LongType()), T.StructField("documents", T.LongType()), T.StructField("available", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("wanted", T.DoubleType()), T.StructField("factor", T.DoubleType()), T.StructField("planned", T.DoubleType()), T.StructField("status", T.StringType())])


def document_sizes(documents: DataFrame, folder: str = bpe.TOKENIZER_DIR, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, copies (rows of the source with the same text), written once."""
    base = cut(spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", bpe.token_count(F.col("text"), folder, vocabulary).alias("tokens"), F.xxhash64("text").alias("_h"), F.length("text").alias("_l")))
    counted = base.groupBy("source", "_h", "_l").agg(F.count("*").alias("copies"))
    # most texts are single: only the repeated ones, with their count, take part in the join
    repeated = counted.where("copies > 1").select(F.col("source").alias("_s"), F.col("_h").alias("_rh"), F.col("_l").alias("_rl"), "copies")
    joined = base.join(repeated, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_rh")) & F.col("_l").eqNullSafe(F.col("_rl")), "left")
    return cut(joined.select("doc_id", "source", "tokens", F.coalesce("copies", F.lit(1)).alias("copies")))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, folder: str = bpe.TOKENIZER_DIR, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, tokens, uses, one row per document that is used. report: one row per source.

    Every document of a source is used ``whole`` times for certain. The rest of the source's tokens is a sample with unequal
    probabilities: rows with an equal text share the chance of one document. A document's place in the order is its random
    odds u/(1-u) divided by its inclusion odds; u is a hash of doc_id and seed, so a run can be repeated. In this order
    documents are taken as long as the running sum of tokens, with half of the own ones, is below what is wanted: the size
    of the sample is fixed in tokens, to within a document. Of each source only the range of the order that holds the border
    is ranked exactly; sums per range tell which it is, so no task holds a source.

    Null and empty texts have no tokens and aren't used; a null source has no target; sources without target or documents
    stand in the report alone. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    sizes = document_sizes(documents, folder, vocabulary)
    plan = spark.createDataFrame([tuple(p[f.name] for f in PLAN.fields) for p in plan_mix(sizes, targets, total_tokens)], PLAN)
    rows = sizes.where("tokens > 0").join(F.broadcast(plan.where("planned > 0")), "source")  # one row per source
    chance = F.least(F.lit(1.0), F.col("factor") / F.col("copies"))
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (chance / (1 - chance))
    # a chance of 1 comes first, a chance of 0 last; odds/(1+odds) keeps the order within (0, 1)
    place = F.when(F.col("wanted") <= 0, 1.0).when(chance >= 1, 0.0).otherwise(odds / (1 + odds))
    ranked = rows.withColumn("place", place)
    r1 = F.least(F.floor(F.col("place") * RANGES), F.lit(RANGES - 1))
    ranked = ranked.withColumn("r1", r1).withColumn("r2", F.least(F.floor((F.col("place") * RANGES - F.col("r1")) * RANGES), F.lit(RANGES - 1)))
    sampled = cut(ranked.where("wanted > 0").select("doc_id", "source", "tokens", "whole", "wanted", "place", "r1", "r2"))
    first = _border(sampled.groupBy("source", "r1").agg(F.sum("tokens").alias("t"), F.max("wanted").alias("wanted")), "r1", F.lit(0))
    in_first = sampled.join(F.broadcast(first.select("source", F.col("r1").alias("b1"), F.col("sum_before").alias("s1"))), "source")  # one row per source
    second = in_first.where("r1 = b1").groupBy("source", "r2").agg(F.sum("tokens").alias("t"), F.max("wanted").alias("wanted"), F.max("s1").alias("s1"))
    second = _border(second, "r2", F.col("s1"))
    placed = in_first.join(F.broadcast(second.select("source", F.col("r2").alias("b2"), F.col("sum_before").alias("s2"))), "source", "left")
    sure = placed.where("r1 < b1 or (r1 = b1 and r2 < b2)").select("doc_id", "source", "tokens", "whole", F.lit(1).alias("extra"))
    last = placed.where("r1 = b1 and r2 = b2")
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "doc_id")) + F.col("s2")
    at_border = last.withColumn("running", running).select("doc_id", "source", "tokens", "whole", F.when(F.col("running") - F.col("tokens") / 2 < F.col("wanted"), 1).otherwise(0).alias("extra"))
    beyond = placed.where("r1 > b1 or (r1 = b1 and r2 > b2)").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra"))
    whole_only = ranked.where("wanted <= 0").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra"))
    used = whole_only.unionByName(sure).unionByName(at_border).unionByName(beyond)
    mixed = cut(used.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("long").alias("uses")).where("uses > 0"))
    reached = mixed.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    both = plan.join(F.broadcast(reached.withColumnRenamed("source", "_s")), F.col("source") == F.col("_s"), "left")
    total = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # rows are sources
    report = both.select(
        "source", "status", "target_share", F.when(total > 0, F.coalesce("mixed_tokens", F.lit(0)) / total).alias("reached_share"), "documents", "available", "max_repeats",
        F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), "planned",
    )
    return mixed, report


def _border(sums: DataFrame, key: str, before) -> DataFrame:
    """Per source the range in which the running sum reaches what is wanted, and the sum before it; else the last range.
    sums has at most RANGES rows per source."""
    w = Window.partitionBy("source").orderBy(key)
    run = sums.withColumn("sum_before", F.sum("t").over(w) - F.col("t") + before)
    return run.where(F.col("sum_before") < F.col("wanted")).groupBy("source").agg(F.max_by("sum_before", key).alias("sum_before"), F.max(key).alias(key))
