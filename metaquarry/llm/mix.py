"""Mixing sources to target shares by systematic sampling.

Each source has a number of expected copies per document. Their prefix sums over the source, plus
one random offset, cross integers; a document is emitted once per integer crossed. Documents are
taken in order of size, so the tokens follow the shares closely. The prefix sums are made of
blocks of bounded size, so a source may hold any part of all documents."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.llm.bpe import DEFAULT, TOKENIZERS
from metaquarry.llm.tokens import token_counts
from metaquarry.session import cut, small

BLOCK_DOCS = 100_000
MOST_SOURCES = 10_000


def expected_copies(targets: dict[str, tuple[float, int]], tokens: dict[str, int], total: float) -> dict[str, float]:
    """Copies per document of each source so that the mix has `total` tokens.

    A source gets its share of the total unless max_repeats copies of all its documents are less;
    what such sources lack is spread over the others in proportion to their shares."""
    capacity = {s: float(tokens.get(s, 0)) * max(0, r) for s, (_, r) in targets.items()}
    want = {s: max(0.0, share) for s, (share, _) in targets.items()}
    short: set[str] = set()
    for _ in range(len(targets) + 1):
        rest = total - sum(capacity[s] for s in short)
        weight = sum(want[s] for s in want if s not in short)
        if weight <= 0 or rest <= 0:
            break
        new = {s for s in want if s not in short and want[s] / weight * rest > capacity[s]}
        if not new:
            break
        short |= new
    rest = max(0.0, total - sum(capacity[s] for s in short))
    weight = sum(want[s] for s in want if s not in short)
    out = {}
    for s, (_, most) in targets.items():
        n = tokens.get(s, 0)
        if not n or want[s] <= 0:
            out[s] = 0.0
        elif s in short:
            out[s] = float(max(0, most))
        else:
            out[s] = min(float(most), want[s] / weight * rest / n)
    return out


def _read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """One row per source; the table of targets is bounded, as each is a decision by hand."""
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("r")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {x["source"]: (float(x["s"] or 0), int(x["r"] or 0)) for x in rows}


def mix_plan(docs: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, seed: int = 7, tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: doc_id, source, n_tokens, copy (1, 2, ...), one row per copy. shares:
    source, target_share, max_repeats, n_docs, source_tokens, n_copies, mix_tokens, actual_share,
    one row per target.

    total_tokens is the size of the mix, by default all tokens of the listed sources. Documents of
    other and of null sources take no part. A source without documents or tokens gets no row in
    mix and share 0; documents without tokens are drawn like others and add nothing. The result
    depends only on the data and the seed. Empty tables give an empty mix."""
    spark = docs.sparkSession
    wanted = _read_targets(targets)
    names = small(targets.where("source is not null").select("source").distinct())
    counted = cut(token_counts(docs.select("doc_id", "source", "text").join(names, "source", "left_semi"), "doc_id", "source", tokenizer=tokenizer, folder=folder))
    # One row per target.
    sums = {r["source"]: r for r in counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    tokens = {s: int(r["tokens"] or 0) for s, r in sums.items()}
    total = float(sum(tokens.values())) if total_tokens is None else float(total_tokens)
    copies = expected_copies(wanted, tokens, total)
    rows = [(s, copies[s], random.Random(f"{seed}:{s}").random(), max(1, -(-int(sums[s]["docs"]) // BLOCK_DOCS)) if s in sums else 1) for s in sorted(wanted)]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, x double, u double, salts int"))

    blocked = (
        counted.join(plan, "source")
        .withColumn("size", F.floor(F.log2(F.col("n_tokens") + 1) * 4).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    )
    block = ["source", "size", "salt"]
    counts = blocked.groupBy(*block).agg(F.count("*").alias("n"))
    before = counts.select(*block, (F.sum("n").over(Window.partitionBy("source").orderBy("size", "salt")) - F.col("n")).alias("before"))
    ranked = blocked.withColumn("r", F.row_number().over(Window.partitionBy(*block).orderBy("n_tokens", "doc_id"))).join(small(before), block)
    end = F.col("x") * (F.col("before") + F.col("r")) + F.col("u")
    start = F.col("x") * (F.col("before") + F.col("r") - 1) + F.col("u")
    drawn = ranked.select("doc_id", "source", "n_tokens", (F.floor(end) - F.floor(start)).cast("int").alias("k")).where("k > 0")
    mix = drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))

    got = drawn.groupBy("source").agg(F.sum("k").alias("n_copies"), F.sum(F.col("k") * F.col("n_tokens")).alias("mix_tokens"))
    known = spark.createDataFrame([(s, wanted[s][0], wanted[s][1], int(sums[s]["docs"]) if s in sums else 0, tokens.get(s, 0)) for s in sorted(wanted)], "source string, target_share double, max_repeats int, n_docs long, source_tokens long")
    zero = F.lit(0).cast("long")
    all_tokens = F.sum("mix_tokens").over(Window.partitionBy())  # one row per target
    shares = (
        known.join(got, "source", "left")
        .withColumns({"n_copies": F.coalesce("n_copies", zero), "mix_tokens": F.coalesce("mix_tokens", zero)})
        .withColumn("actual_share", F.when(all_tokens > 0, F.col("mix_tokens") / all_tokens).otherwise(F.lit(0.0)))
    )
    return mix, shares
