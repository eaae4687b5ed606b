"""Conversation history within a budget, and per-user memory: recall, merging, near-duplicates, eviction."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.values import memory_score
from corpuslake.operators import vectors
from corpuslake.operators.vectors import classes
from corpuslake.sources.scratch import checkpointed

SIMILAR, TOPIC_CAP, MARGIN = 0.88, 30, 10


def turns(messages: DataFrame, thread: str = "thread_id") -> DataFrame:
    """``messages`` (thread, pos, role, tokens) with ``turn``: pairs by position, a leading message that isn't the user's left out."""
    along = Window.partitionBy(thread).orderBy("pos")
    first = F.first("role").over(along)
    place = F.row_number().over(along) - F.when(first == "user", 1).otherwise(2)
    return messages.withColumn("_p", place).filter("_p >= 0").withColumn("turn", F.floor(F.col("_p") / 2).cast("int")).drop("_p")


def trim_history(messages: DataFrame, budget: int | Column, thread: str = "thread_id") -> DataFrame:
    """The messages of the newest turns of each thread whose tokens fit the budget together; the newest turn always stays. Token
    counts aren't negative, so the running sum from the newest turn stops where the loop over turns would."""
    by_turn = turns(messages, thread)
    newest = Window.partitionBy(thread).orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max("turn").over(Window.partitionBy(thread))
    return by_turn.withColumn("_sum", F.sum("tokens").over(newest)).withColumn("_last", last).filter((F.col("_sum") <= budget) | (F.col("turn") == F.col("_last"))).drop("_sum", "_last")


def trim_sweep(messages: DataFrame, budgets: list[int], referent: str, thread: str = "thread_id") -> DataFrame:
    """thread, budget, kept_tokens, kept_turns, survives: what each budget keeps. ``budgets`` is a short list of settings."""
    newest = Window.partitionBy(thread).orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, 0)
    summed = turns(messages, thread).withColumn("_sum", F.sum("tokens").over(newest)).withColumn("_last", F.max("turn").over(Window.partitionBy(thread)))
    each = summed.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets)))).filter((F.col("_sum") <= F.col("budget")) | (F.col("turn") == F.col("_last")))
    return each.groupBy(thread, "budget").agg(F.sum("tokens").alias("kept_tokens"), F.count_distinct("turn").alias("kept_turns"), F.bool_or(F.col("text").contains(referent)).alias("survives"))


def dedupe_hits(hits: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first hit of each key by ``seq``."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).filter("_n = 1").drop("_n")


def recall_hits(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "key").agg(F.count("*").alias("recall_count"), F.max("at").alias("last_recalled"))


def clusters(items: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """user_id, key, seed: in key order every item that no earlier one has taken is a seed and takes the similar items (cosine at or over the
    threshold) that aren't taken.

    A vector is a seed as soon as all similar ones with lesser keys are known not to be; those that a seed is similar to aren't. Each
    round settles these everywhere at once; a chain of vectors in key order settles two a round."""
    classed = classes(items)
    pairs = checkpointed(vectors.similar_pairs(items, threshold).select("user_id", "a", "b"))
    both = pairs.select("user_id", F.col("a").alias("key"), F.col("b").alias("other")).union(pairs.select("user_id", "b", "a"))
    left, seeds = checkpointed(both), None
    while not left.isEmpty():
        new = left.groupBy("user_id", "key").agg(F.min("other").alias("low")).filter("key < low").select("user_id", "key")
        new = checkpointed(new)
        taken = left.join(new.withColumnRenamed("key", "other"), ["user_id", "other"], "left_semi").select("user_id", "key")
        settled = checkpointed(new.union(taken).distinct())
        # Once all of an item's similar ones are settled it has no rows left; it is a seed then, unless one took it.
        bare = left.join(settled, ["user_id", "key"], "left_anti")
        rest = checkpointed(bare.join(settled.withColumnRenamed("key", "other"), ["user_id", "other"], "left_anti").select("user_id", "key", "other"))
        lone = bare.select("user_id", "key").distinct().join(rest.select("user_id", "key").distinct(), ["user_id", "key"], "left_anti")
        found = new.union(lone)
        seeds = checkpointed(found if seeds is None else seeds.union(found))
        left = rest
    if seeds is None:
        return classed.select("user_id", "key", F.col("rep").alias("seed"))
    near = both.join(seeds.withColumnRenamed("key", "other"), ["user_id", "other"], "left_semi").groupBy("user_id", "key").agg(F.min("other").alias("by"))
    near = near.join(seeds, ["user_id", "key"], "left_anti").withColumnRenamed("key", "rep")
    return classed.join(near, ["user_id", "rep"], "left").select("user_id", "key", F.coalesce("by", "rep").alias("seed"))


def prune(items: DataFrame, now: Column, cap: int = TOPIC_CAP, margin: int = MARGIN, threshold: float = SIMILAR) -> DataFrame:
    """user_id, key, score, outcome: what a pass over each user's memory leaves.

    Users with more than cap + margin items, or with several profiles, have a pass; others keep all. Of several profiles the newest stays, and is
    given the merged content (``merge_profiles``); the others are ``merged``. Of similar topics the one recalled most, then the newest, stays; the others are
    ``duplicate``. Of the topics left the ``cap`` best by recency and recall stay, ties by key; the others are ``evicted``. Profiles are
    never evicted."""
    scored = items.withColumn("score", memory_score(F.col("updated_at"), F.col("recall_count"), now))
    needs = scored.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "profile").alias("profiles"))
    passed = scored.join(needs.filter((F.col("n") > cap + margin) | (F.col("profiles") > 1)).select("user_id"), "user_id", "left_semi")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), "key"))
    canonical = passed.filter("kind = 'profile'").withColumn("_r", newest).filter("_r = 1").select("user_id", "key")
    topics = passed.filter("kind = 'topic'")
    seeded = topics.join(clusters(topics, threshold), ["user_id", "key"])
    order = F.struct(-F.coalesce("recall_count", F.lit(0)), -F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62))), F.col("key"))
    best = seeded.groupBy("user_id", "seed").agg(F.min_by(F.struct("key", "score"), order).alias("b")).select("user_id", "b.key", "b.score")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "key"))
    stays = best.withColumn("_r", rank).filter(F.col("_r") <= cap).select("user_id", "key")
    mark = lambda df, name: df.select("user_id", "key", F.lit(True).alias(name))
    met = scored.join(mark(passed, "_pass"), ["user_id", "key"], "left").join(mark(canonical.union(stays), "_stays"), ["user_id", "key"], "left").join(mark(best, "_best"), ["user_id", "key"], "left")
    gone = F.when(F.col("kind") == "profile", "merged").when(F.col("_best").isNull(), "duplicate").otherwise("evicted")
    open_ = F.col("_pass") & F.col("kind").isin("profile", "topic") & F.col("_stays").isNull()
    return met.select("user_id", "key", "score", F.when(F.coalesce(open_, F.lit(False)), gone).otherwise("kept").alias("outcome"))


def recall(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, key, part, rank: up to ``k`` profiles of the user, newest first, then the ``k`` most similar topics; an item once."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "key"))
    profiles = items.filter("kind = 'profile'").withColumn("rank", newest).filter(F.col("rank") <= k)
    first = profiles.join(queries.select("query_id", "user_id"), "user_id").select("query_id", "key", F.lit(0).alias("part"), "rank")
    best = vectors.nearest(items.filter("kind = 'topic'"), queries, k, "key", ("user_id",)).select("query_id", "key", F.lit(1).alias("part"), "rank")
    return dedupe_hits(first.union(best).withColumn("seq", F.struct("part", "rank")), ["query_id", "key"], "seq").drop("seq")


def merge_profiles(items: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """One profile a user: of each scalar the newest value that isn't empty; of each list the values in the order they are met from the newest profile on, each once."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "key"))
    ranked = items.withColumn("_r", newest)
    base = ranked.groupBy("user_id").agg(F.count("*").alias("profiles"), *(F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.col("_r"))).alias(c) for c in scalars))
    for c in lists:
        seen = ranked.select("user_id", "_r", F.posexplode(c).alias("_p", "value")).groupBy("user_id", "value").agg(F.min(F.struct("_r", "_p")).alias("at"))
        merged = seen.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(c))
        base = base.join(merged, "user_id", "left")
    return base


def pool_embeddings(segments: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, embedding, error: the weighted mean of a key's vectors, made a unit vector; one segment alone stays as it is. Unequal lengths and zero sums are errors, and weights that
    are all zero give null. Each task sums its own vectors of a key, so that a row for each key and task is all that is shuffled."""
    facts = segments.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("widths"))
    own = segments.filter("weight > 0").withColumn("_vector", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    summed = own.groupBy(key, F.size("embedding").alias("_width")).agg(Summarizer.mean(F.col("_vector"), F.col("weight").cast("double")).alias("_mean"))
    means = summed.select(key, vector_to_array("_mean").alias("mean")).groupBy(key).agg(F.first("mean").alias("mean"))
    met = facts.join(means, key, "left").withColumn("size", F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)))
    error = F.when(F.col("widths") > 1, "inconsistent_dimensions").when((F.col("n") > 1) & (F.col("size") == 0), "zero_magnitude")
    unit = F.when(F.col("n") == 1, F.col("mean")).otherwise(F.transform("mean", lambda x: F.try_divide(x, F.col("size"))))
    return met.select(key, F.when(error.isNull(), unit).alias("embedding"), error.alias("error"))
