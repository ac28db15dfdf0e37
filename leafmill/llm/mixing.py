"""Mix of several sources by target weights, in tokens.

1. Each source's documents are packed, one after the other, into blocks of a fixed number of tokens. A source may be most of the corpus, so that it is
   first cut by hash into lanes of a bounded size; running sums are taken within a lane, and lanes are numbered through.
   A block is a list of (document, first token, number of tokens); tokens themselves are not moved.
2. The total is the largest (or the asked one, if smaller) at which each source has its share without being repeated more often than allowed.
3. For each output shard, multinomial counts of slots by source are drawn from a generator seeded by the shard.
4. The slots of a source, numbered over all shards, run through pseudorandom permutations of its blocks, one for each repetition,
   and are joined with the blocks by number. Repetition r + 1 of a block thus comes only after all blocks were used r times.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import tokens
from leafmill.session import checkpoint

BLOCK_TOKENS = 512
LANE_TOKENS = 1 << 22
SHARD_SLOTS = 1024
SEED = 20


@dataclass
class Plan:
    """What is drawn for each source: its weight among the usable ones, blocks, and slots at most."""

    sources: list[str]
    weights: np.ndarray
    blocks: np.ndarray
    capacity: np.ndarray
    slots: int


def permute(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until it falls within the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") | 1) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in rounds:
            with np.errstate(over="ignore"):
                mixed = (right + np.uint64(1)) * k
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(at.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def token_counts(documents: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """(source, doc_id, n_tokens) of the documents that a target names and that have tokens; the list of targets is broadcast, being a list of sources."""
    wanted = targets.where((F.col("weight") > 0) & (F.col("max_repeats") > 0)).select(F.col("source").alias("_target")).distinct()
    named = documents.select("source", "doc_id", "text").join(F.broadcast(wanted), F.col("source") == F.col("_target"), "left_semi")
    return tokens.encoded(named, ["source", "doc_id"], out="n_tokens", folder=folder, count_only=True).where(F.col("n_tokens") > 0)


def blocks_of(counts: DataFrame, size: int = BLOCK_TOKENS, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """(source, block, n_tokens, pieces): every token of every document is in one block; the last of a lane may be shorter."""
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("_all")).withColumn("_lanes", F.ceil(F.col("_all") / lane_tokens).cast("int"))
    laned = counts.join(F.broadcast(totals), "source").withColumn("_lane", F.pmod(F.xxhash64("doc_id"), F.col("_lanes")).cast("int"))
    order = Window.partitionBy("source", "_lane").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    placed = laned.withColumn("_end", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("n_tokens"))
    one = F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size)))
    parts = placed.select("source", "_lane", "doc_id", "_start", "_end", one.alias("_no")).withColumns(
        {"_from": F.greatest("_start", F.col("_no") * size), "_to": F.least("_end", (F.col("_no") + 1) * size)}
    )
    piece = F.struct(F.col("_from").alias("at"), "doc_id", (F.col("_from") - F.col("_start")).cast("long").alias("first"), (F.col("_to") - F.col("_from")).cast("int").alias("length"))
    packed = parts.groupBy("source", "_lane", "_no").agg(F.sum(F.col("_to") - F.col("_from")).cast("int").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("_pieces"))
    lanes = placed.groupBy("source", "_lane").agg(F.ceil(F.sum("n_tokens") / size).alias("_blocks"))
    before = lanes.withColumn("_before", F.sum("_blocks").over(Window.partitionBy("source").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    pieces = F.transform("_pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["first"].alias("first"), p["length"].alias("length")))
    return packed.join(before.drop("_blocks"), ["source", "_lane"]).select("source", (F.col("_before") + F.col("_no")).cast("long").alias("block"), "n_tokens", pieces.alias("pieces"))


def plan(counts: DataFrame, targets: DataFrame, size: int, lane_tokens: int, total_tokens: int | None) -> Plan:
    """The number of slots and the capacities. Targets without documents take no part, and the weights of the rest add up to 1; of a source
    named twice the weights add up and the smaller cap holds."""
    per_lane = blocks_per_source(counts, size, lane_tokens)
    rows = targets.where((F.col("weight") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.sum("weight").alias("w"), F.min("max_repeats").alias("r"))
    got = sorted((r["source"], r["w"], r["r"], r["blocks"], r["tokens"]) for r in rows.join(per_lane, "source").collect())
    if not got:
        return Plan([], np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0)
    w = np.array([g[1] for g in got], dtype=np.float64)
    w /= w.sum()
    n = np.array([g[3] for g in got], dtype=np.int64)
    cap = n * np.array([g[2] for g in got], dtype=np.int64)
    slots = int(min(math.floor(c / x) for c, x in zip(cap, w, strict=True)))
    while slots > 0 and np.any(slots * w + 3 * np.sqrt(slots * w * (1 - w)) > cap):  # room for the draw
        slots = min(slots - 1, int(slots * 0.995))
    slots = max(slots, 1)  # every source has room for one
    if total_tokens is not None:
        slots = min(slots, total_tokens // size)
    return Plan([g[0] for g in got], w, n, cap, slots)


def blocks_per_source(counts: DataFrame, size: int, lane_tokens: int) -> DataFrame:
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("_all")).withColumn("_lanes", F.ceil(F.col("_all") / lane_tokens).cast("int"))
    laned = counts.join(F.broadcast(totals), "source").withColumn("_lane", F.pmod(F.xxhash64("doc_id"), F.col("_lanes")))
    lanes = laned.groupBy("source", "_lane").agg(F.sum("n_tokens").alias("t"))
    return lanes.groupBy("source").agg(F.sum(F.ceil(F.col("t") / size)).alias("blocks"), F.sum("t").alias("tokens"))


def moves(drawn: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, begin, end, other source, start): slots [begin, end) of a source, which lie beyond its capacity, become those of another from `start` on, the
    one with most room first. Every slot finds a place, as there are no more slots than all capacities together."""
    room = {s: c - n for s, (n, c) in enumerate(zip(drawn, capacity, strict=True)) if n < c}
    used = dict(enumerate(drawn))
    out = []
    for s, (n, c) in enumerate(zip(drawn, capacity, strict=True)):
        at = c
        while at < n and room:
            to = max(room, key=lambda x: (room[x], -x))
            k = min(n - at, room[to])
            out.append((s, at, at + k, to, used[to]))
            used[to] += k
            room[to] -= k
            if not room[to]:
                del room[to]
            at += k
    return out


def slots_of(spark, p: Plan, shard_slots: int, seed: int) -> DataFrame:  # noqa: ANN001
    """(shard, position, source, repeat, block): every slot of the mix."""
    shards = math.ceil(p.slots / shard_slots)
    weights, sources = p.weights, p.sources

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard in b["id"]:
                size = min(shard_slots, p.slots - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, weights)
                out.append(pd.DataFrame({"shard": shard, "s": np.arange(len(sources), dtype=np.int32), "n": counts}))
            if out:
                yield pd.concat(out)

    drawn = spark.range(shards).mapInPandas(draw, "shard long, s int, n long")
    totals = dict(drawn.groupBy("s").agg(F.sum("n")).collect())  # a row for each target
    moved = moves([totals.get(s, 0) for s in range(len(sources))], p.capacity.tolist())
    before = F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.sum("n").over(Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    numbered = drawn.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("inner", F.coalesce(inner, F.lit(0)))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                at = r.before + np.arange(r.n, dtype=np.int64)
                of = np.full(len(at), r.s)
                for s, begin, end, to, start in moved:  # what is beyond the capacity of its source
                    if s == r.s:
                        here = (at >= begin) & (at < end) & (of == s)
                        of[here], at[here] = to, at[here] - begin + start
                repeat = at // p.blocks[of]
                block = np.empty(len(at), dtype=np.int64)
                for s, e in {*zip(of.tolist(), repeat.tolist(), strict=True)}:
                    here, n = (of == s) & (repeat == e), int(p.blocks[s])
                    block[here] = permute(at[here] % n, n, (seed << 20) + int(e) ^ int.from_bytes(hashlib.blake2b(sources[s].encode(), digest_size=6).digest(), "little"))
                place = permute(r.inner + np.arange(len(at), dtype=np.int64), shard_slots, seed * 1_000_003 + int(r.shard))
                yield pd.DataFrame({"shard": r.shard, "position": place.astype(np.int32), "source": pd.Series([sources[s] for s in of], dtype=object), "repeat": (repeat + 1).astype(np.int32), "block": block})

    return numbered.mapInPandas(spread, "shard long, position int, source string, repeat int, block long")


def mix(documents: DataFrame, targets: DataFrame, folder: str = tokens.FOLDER, size: int = BLOCK_TOKENS, lane_tokens: int = LANE_TOKENS, shard_slots: int = SHARD_SLOTS, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(shard, position, source, repeat, block, n_tokens, pieces): the records of the mix, `pieces` being spans of tokens of documents.

    Documents without a source, of sources without a target and without tokens take no part, nor do targets without documents or with a weight or cap
    of zero; an empty table gives no rows. The draw is the same for the same input and seed, whatever the partitioning.
    """
    counts = checkpoint(token_counts(documents, targets, folder))
    p = plan(counts, targets, size, lane_tokens, total_tokens)
    blocks = blocks_of(counts, size, lane_tokens)
    if not p.sources or not p.slots:
        return blocks.select(F.lit(0).cast("long").alias("shard"), F.lit(0).alias("position"), "source", F.lit(0).alias("repeat"), "block", "n_tokens", "pieces").limit(0)
    slots_and_blocks = slots_of(documents.sparkSession, p, shard_slots, seed).hint("shuffle_merge").join(blocks, ["source", "block"])  # its size is not seen in the plan
    return slots_and_blocks.select("shard", "position", "source", "repeat", "block", "n_tokens", "pieces")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, tokens, share, target_share, most_repeats): the report of a mix; targets that had nothing to give have zero tokens."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeat").alias("most_repeats"))
    all_ = targets.groupBy("source").agg(F.sum("weight").alias("weight")).join(got, "source", "left").fillna(0, ["tokens", "most_repeats"])
    whole = Window.partitionBy(F.lit(1))  # a row for each target
    there = F.when(F.col("tokens") > 0, F.col("weight"))
    return all_.select("source", "weight", "tokens", F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)).alias("share"), F.try_divide(there, F.sum(there).over(whole)).alias("target_share"), "most_repeats")


def materialised(mixed: DataFrame, documents: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """(shard, position, source, ids): the mix as token ids, for writing; each document is encoded once and its spans joined."""
    ids = tokens.document_ids(documents, folder)
    spans = mixed.select("shard", "position", "source", F.posexplode("pieces").alias("_no", "_p")).select("*", F.col("_p.doc_id").alias("doc_id"))
    cut = spans.join(ids, "doc_id").select("shard", "position", "source", "_no", F.slice("ids", (F.col("_p.first") + 1).cast("int"), F.col("_p.length")).alias("_ids"))
    return cut.groupBy("shard", "position", "source").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_ids"))), lambda x: x["_ids"])).alias("ids"))
