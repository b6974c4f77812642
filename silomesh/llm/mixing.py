"""Mixing sources to target weights by systematic sampling.

A mix asks each source for a share of all its tokens.  Sources without texts can give nothing, so their share falls to the
others in proportion: what is left is the attainable share of a source.  Unless a total is given, a mix is as large as it
can be with every source at its attainable share and no document used more than ``max_repeats`` times; a source at that
limit is then what the total follows from.  With a given total, a source gives at most ``max_repeats`` times its tokens.

Every document of a source has the same expected number of copies.  They are added up over the documents from the shortest
to the longest, from one random offset, and a document is emitted once for each whole number that the sum crosses.  So no
document is used more often than its expectation rounded up, and as a systematic sample of sizes in order is balanced, the
tokens of a source miss its amount by no more than its longest document for each slice that documents of one length are
cut into (one up to ``ranks.ROWS`` documents for each of ``SIZES`` size ranges).

Documents without a source or without tokens and sources without documents give nothing, targets that are null, negative
or without repeats ask for nothing, repeated texts are documents of their own, empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silomesh.llm.ranks import n_slices, positions

SIZES = 64  # size ranges of a source that are numbered apart


def expected_copies(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_tokens, attainable, amount, copies): expected copies of each
    document of a source, and the share and the tokens it is to give."""
    held = sized.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    asked = targets.filter("target_share > 0 and max_repeats > 0").select("mix_name", "source", "target_share", "max_repeats")
    plan = asked.join(held, "source")
    plan = plan.join(plan.groupBy("mix_name").agg(F.sum("target_share").alias("asked")), "mix_name").withColumn("attainable", F.col("target_share") / F.col("asked"))
    most = F.col("max_repeats") * F.col("source_tokens")
    whole = plan.groupBy("mix_name").agg(F.min(most / F.col("attainable")).alias("whole")) if total is None else plan.select("mix_name", F.lit(float(total)).alias("whole")).distinct()
    amount = F.least(F.col("attainable") * F.col("whole"), most.cast("double"))
    out = plan.join(whole, "mix_name").withColumn("amount", amount)
    return out.select("mix_name", "source", "target_share", "max_repeats", "source_tokens", "attainable", "amount", F.least(F.col("amount") / F.col("source_tokens"), F.col("max_repeats").cast("double")).alias("copies"))


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 5) -> DataFrame:
    """(mix_name, source, doc_id, copy, n_tokens): one row for each time a document is used; ``sized`` is read three times."""
    plan = expected_copies(sized, targets, total)
    used = sized.join(plan.select("source").distinct(), "source", "left_semi")
    bounds = used.groupBy("source").agg(F.percentile_approx("n_tokens", [i / SIZES for i in range(1, SIZES)], 1000).alias("bounds"), F.count("*").alias("held"))
    most = bounds.agg(F.max("held")).first()[0] or 0
    parts = n_slices(most // SIZES)
    slice_of = (F.size(F.filter("bounds", lambda b: b < F.col("n_tokens"))) * parts + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(parts))).cast("int")
    ranked = positions(used.join(bounds, "source"), ["source"], ["n_tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id"], slice_of)
    offset = F.pmod(F.xxhash64("mix_name", "source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    crossed = lambda p: F.floor(F.col("copies") * p + F.col("offset"))
    drawn = ranked.join(plan.withColumn("offset", offset), "source").withColumn("times", (crossed(F.col("pos") + 1) - crossed(F.col("pos"))).cast("int")).filter("times > 0")
    return drawn.select("mix_name", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "n_tokens")


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Target, attainable and actual share of every target, with documents, copies and tokens used and whether repeats were
    the limit."""
    used = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_copies"), F.count_if(F.col("copy") == 1).alias("n_docs"))
    whole = used.groupBy("mix_name").agg(F.sum("n_tokens").alias("mix_tokens"))
    plan = expected_copies(sized, targets, total).select("mix_name", "source", "attainable", (F.col("copies") >= F.col("max_repeats") - 1e-9).alias("at_limit"))
    out = targets.select("mix_name", "source", "target_share", "max_repeats").join(used, ["mix_name", "source"], "left").join(whole, "mix_name", "left").join(plan, ["mix_name", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return out.select("mix_name", "source", "target_share", "max_repeats", share(F.col("attainable"), "attainable_share"), zero("n_docs"), zero("n_copies"), zero("n_tokens"), share(F.col("n_tokens") / F.col("mix_tokens"), "actual_share"), F.coalesce("at_limit", F.lit(True)).alias("at_limit"))
