"""The k most similar vectors of every vector, by multi-index hashing.

1. Rotated binary codes are learned from a bounded sample (iterative quantisation: the rotation that brings the sample nearest to
   the corners of a cube; further independent rotations give further bits).
2. Each code is cut into substrings and each substring indexed. The bits of a substring follow the number of vectors, so that a bucket holds
   about FILL of them at any size; the number of substrings is measured on the sample, so that vectors of cosine `aim` meet with probability GOAL.
3. Each vector is in the bucket of each of its substrings and probes one more: the one with its least certain bit flipped. By the pigeonhole
   principle, codes that differ in fewer bits than there are substrings always meet; others meet the likelier the nearer they are. What meets is compared
   by Hamming distance over 128 bits, and pairs within the radius go out from the first substring that agrees.
4. Floats are brought together once: every pair is judged in the group of the least partner of its smaller member, to which
   both vectors are sent. Mutual neighbours share that group, so that a vector is sent about once. There cosines are exact.

Entries of many vectors travel together, as packed rows. Skew: copies of one vector beyond the first k + 1 take no part in the search, since
their answer is known (the first copies, in the order of ids). Buckets and groups above a cap are cut into blocks, and each pair of blocks is
a unit of its own, so that no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.session import bounded_sample, checkpoint, materialised

#: Vectors in a bucket on average, and least and most bits of a substring.
FILL, LEAST_BITS, MOST_BITS = 512, 8, 28
#: Similarity at which the index is to find pairs, and the share of them that it is to find.
AIM, GOAL = 0.88, 0.94
#: Bits compared, and the standard deviations beyond the expected distance at `aim` up to which pairs are reranked.
WORD, SPREAD = 128, 2.6
#: Most vectors to learn the rotation from.
SAMPLE = 8192
#: Rows of a bucket or a group in one unit at most; hot buckets that the driver may know of.
CAP, HOT = 4096, 200_000
#: Vectors compared at once; vectors packed together; least bits of the key that packed rows are sent by.
BLOCK, GATHER, KEY_BITS = 512, 100_000, 9


class Index(NamedTuple):
    """w: matrix whose signs are the code; bits of each substring, number of substrings; largest distance; bits within a packed row."""

    w: np.ndarray
    bits: int
    tables: int
    radius: int
    low: int


def learn(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Matrix (dimensions x bits) whose signs are the code."""
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    made, have = [], 0
    while have < bits:
        take = min(dim, bits - have)
        w, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        if len(sample) > dim:
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(sample @ w).T @ sample)
                w = (u @ vt).T
        made.append(w[:, rng.permutation(dim)[:take]])
        have += take
    return np.concatenate(made, axis=1).astype(np.float32)


def meeting_share(w: np.ndarray, bits: int, aim: float, seed: int = 11) -> float:
    """Share of random pairs of cosine `aim` that meet in one substring, each probing its least certain bit; measured on the learned rotation."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 8192, w.shape[0]))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = aim * a + math.sqrt(1 - aim * aim) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    met = []
    for t in range(max(1, w.shape[1] // bits)):
        p, q = (x @ w[:, t * bits : (t + 1) * bits] for x in (a, b))
        differ = (p > 0) != (q > 0)
        n = differ.sum(axis=1)
        at = np.arange(len(n))
        met.append(((n == 0) | (n == 1) & (differ[at, np.abs(p).argmin(axis=1)] | differ[at, np.abs(q).argmin(axis=1)])).mean())
    return float(np.mean(met))


def planned(sample: np.ndarray, rows: int, aim: float = AIM, bits: int | None = None) -> Index:
    """The index for `rows` vectors, learned from a sample of them."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / FILL))))
    share = min(0.999, max(1e-4, meeting_share(learn(sample, 2 * bits), bits, aim)))
    tables = max(2, math.ceil(math.log(1 - GOAL) / math.log(1 - share)))
    p = math.acos(aim) / math.pi
    radius = round(WORD * p + SPREAD * math.sqrt(WORD * p * (1 - p)))
    return Index(learn(sample, max(WORD, bits * tables)), bits, tables, radius, max(0, bits - max(KEY_BITS, bits - 6)))


def unit_rows(batch: pa.RecordBatch, node: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of usable rows: neither null, nor of another length, nor with null, infinite or all-zero values."""
    col, ids = batch.column(batch.schema.get_field_index(vec)), batch.column(batch.schema.get_field_index(node))
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dims = np.bincount(sizes).argmax() if len(sizes) and sizes.max() else 0
    if dims == 0:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    ok = (sizes == dims) & ~ids.is_null().to_numpy(zero_copy_only=False)
    kept = col.filter(pa.array(ok))
    x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good] / norm[good, None]


def codes_of(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 128 bits of each code as four words, bucket of each substring, bucket to probe for each substring): buckets are (tables x vectors)."""
    project = x.astype(np.float32) @ index.w
    bits = project > 0
    word = np.packbits(bits[:, :WORD], axis=1, bitorder="little").view(np.uint32)
    weight = 1 << np.arange(index.bits)
    own, probed = np.empty((2, index.tables, len(x)), dtype=np.int64)
    for t in range(index.tables):
        part = slice(t * index.bits, (t + 1) * index.bits)
        own[t] = bits[:, part] @ weight
        probed[t] = own[t] ^ weight[np.abs(project[:, part]).argmin(axis=1)]
    return word, own, probed


def bucket_sizes(vectors: DataFrame, index: Index, node: str, vec: str) -> DataFrame:
    """(bucket, n): how many vectors are in each bucket or probe it, counted within each batch before the shuffle."""
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = unit_rows(b, node, vec)
            if not len(ids) or x.shape[1] != sent.value.w.shape[0]:
                continue
            _, own, probed = codes_of(x, sent.value)
            at = (np.arange(sent.value.tables) << sent.value.bits)[:, None]
            bucket, n = np.unique(np.concatenate([own + at, probed + at]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    return vectors.select(node, vec).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


PACKED = "part long, i int, j int, ids binary, words binary, lows binary"


def index_rows(vectors: DataFrame, index: Index, hot: dict[int, int], node: str, vec: str) -> DataFrame:
    """Packed rows (part, i, j, ids, words, lows): the entries of many vectors in the buckets of one key. `hot` are buckets to be cut into so many
    blocks: each pair of blocks (i, j) is a unit of its own. lows: bucket within the key, whether of block j, whether only probing."""
    sent = vectors.sparkSession.sparkContext.broadcast((index, hot))

    def packed(t: int, ids: np.ndarray, words: np.ndarray, own: np.ndarray, probed: np.ndarray) -> Iterator[tuple]:
        ix, hot_ = sent.value
        bucket = np.concatenate([own, probed])
        at = np.concatenate([np.arange(len(ids))] * 2)
        probe = np.arange(len(bucket)) >= len(ids)
        if hot_:
            full = bucket + (t << ix.bits)
            here = np.isin(full, np.fromiter(hot_, np.int64, len(hot_)))
            for b in np.unique(full[here]):
                rows = np.flatnonzero(full == b)
                n = hot_[int(b)]
                block = ((ids[at[rows]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                for o in range(n):
                    for own_ in np.unique(block):
                        i, j = min(o, int(own_)), max(o, int(own_))
                        k = rows[block == own_]
                        flags = (int(b) & ((1 << ix.low) - 1)) << 2 | (int(i != j and own_ == j) << 1)
                        yield (int(b) >> ix.low) << 1 | 1, i, j, ids[at[k]], words[at[k]], (flags | probe[k]).astype(np.uint16)
            bucket, at, probe = bucket[~here], at[~here], probe[~here]
        order = np.argsort(bucket, kind="stable")
        bucket, at, probe = bucket[order], at[order], probe[order]
        key = bucket >> ix.low
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        lows = ((bucket & ((1 << ix.low) - 1)) << 2 | probe).astype(np.uint16)
        for s, e in zip([0, *cut], [*cut, len(key)], strict=True):
            if e > s:
                yield (int(key[s]) + (t << ix.bits - ix.low)) << 1, 0, 0, ids[at[s:e]], words[at[s:e]], lows[s:e]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value[0]
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, words = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for t in range(ix.tables):
                rows = list(packed(t, ids, words, np.concatenate([h[2][t] for h in held]), np.concatenate([h[3][t] for h in held])))
                part, i, j, a, w, low = zip(*rows, strict=True)
                raw = [pa.array([np.diff(x, prepend=0).tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in w], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *raw], names=["part", "i", "j", "ids", "words", "lows"])

        for b in batches:
            ids, x = unit_rows(b, node, vec)
            if not len(ids) or x.shape[1] != ix.w.shape[0]:
                continue
            held.append((ids, *codes_of(x, ix)))
            if sum(len(h[0]) for h in held) >= GATHER:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return vectors.select(node, vec).mapInArrow(make, PACKED)


def candidate_pairs(packed: DataFrame, index: Index) -> DataFrame:
    """Pairs a < b of different ids whose codes meet in a bucket and differ in at most `radius` of 128 bits. A pair whose code agrees in an earlier
    substring is left out; it may still come from several buckets."""
    rows = packed.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    bits, tables, radius, low = index.bits, index.tables, index.radius, index.low

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:3] != key:
                    if held:
                        yield key, held
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield key, held

    def near(words: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray, ordered: bool, table: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(p), BLOCK):
            a = p[s : s + BLOCK]
            hit = sum(np.bitwise_count(words[a, None, k] ^ words[None, q, k]) for k in range(WORD // 32)) <= radius
            hit &= ids[a, None] < ids[None, q] if ordered else ids[a, None] != ids[None, q]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            d = words[a[i]] ^ words[q[j]]
            first = np.ones(len(i), dtype=bool)
            for earlier in range(min(table, WORD // bits)):
                word, at = divmod(earlier * bits, 32)
                part = d[:, word] >> np.uint32(at)
                if at + bits > 32:
                    part |= d[:, word + 1] << np.uint32(32 - at)
                first &= part & np.uint32((1 << bits) - 1) != 0
            yield ids[a[i[first]]], ids[q[j[first]]]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for (part, gi, gj), rows_ in units(batches):
            ids = np.concatenate([np.cumsum(np.frombuffer(r[0], np.int64)) for r in rows_])
            words = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows_]).reshape(-1, WORD // 32)
            lows = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows_])
            table = (part >> 1) >> (bits - low)
            order = np.argsort(lows >> 2, kind="stable")
            bucket = (lows >> 2)[order]
            cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for s, e in zip([0, *cut], [*cut, len(order)], strict=True):
                at = order[s:e]
                probe, second = (lows[at] & 1).astype(bool), (lows[at] & 2).astype(bool)
                if gi == gj:
                    in_, by = at[~probe], at[probe]
                    jobs = [(in_, in_, True), (by, in_, False)]
                else:
                    jobs = [(at[~probe & ~second], at[~probe & second], False), (at[probe & ~second], at[~probe & second], False), (at[probe & second], at[~probe & ~second], False)]
                for p, q, ordered in jobs:
                    if len(p) and len(q):
                        for a, b in near(words, ids, p, q, ordered, table):
                            out.append((np.minimum(a, b), np.maximum(a, b)))
                            held += len(a)
            if held > 500_000:
                yield once(out)
                out, held = [], 0
        if held:
            yield once(out)

    def once(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        larger, at = np.unique(b, return_index=True)  # the first is the least, as pairs are in order of a
        columns = [np.concatenate([a, larger]), np.concatenate([b, np.full(len(larger), -1)]), np.concatenate([np.full(len(a), -1), a[at]])]
        pair_ = np.arange(len(columns[0])) < len(a)
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=~pair_), pa.array(columns[2], mask=pair_)], names=["n", "p", "less"])

    return rows.mapInArrow(pair, "n long, p long, less long")


def in_blocks(rows: DataFrame, key: str, by: str, cap: int) -> DataFrame:
    """The rows with `_i`, `_j` and `_own`, sent where they meet: rows of one (key, _i, _j) belong together.

    Keys of at most `cap` rows are one block (0, 0). Larger ones are cut by hash into blocks, and each pair of blocks gets a copy of
    both; `_own` is the block of a row. Counting is combined map-side; a key's rows never all meet in one task.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > cap).select(F.col(key).alias("_hot"), F.ceil(F.col("count") / (cap / 2)).cast("int").alias("_n"))
    zero = F.lit(0)
    if hot.isEmpty():
        return rows.withColumns({"_i": zero, "_j": zero, "_own": zero}).repartition(key)
    cold = rows.join(hot, F.col(key) == F.col("_hot"), "left_anti").withColumns({"_i": zero, "_j": zero, "_own": zero})
    cut = rows.join(hot, F.col(key) == F.col("_hot")).withColumn("_own", F.pmod(F.xxhash64(by), F.col("_n")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.withColumns({"_i": F.least("_own", "_o"), "_j": F.greatest("_own", "_o")}).select(*cold.columns)
    return cold.unionByName(cut).repartition(key, "_i", "_j")


def _units(t: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by (key, _i, _j), and begin and end of each unit."""
    k, i, j = (t.column(c).to_numpy() for c in (key, "_i", "_j"))
    order = np.lexsort((j, i, k))
    k, i, j = k[order], i[order], j[order]
    cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    return order, np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])


def meeting_groups(pairs: DataFrame) -> DataFrame:
    """Distinct (node, g): the groups in which a node's pairs are judged. Of a pair, this is the least smaller partner of its smaller member, or else that member."""
    least = F.coalesce(F.min("less").over(Window.partitionBy("n")), F.col("n"))
    judged = pairs.withColumn("g", least).where(F.col("p").isNotNull())
    return judged.select(F.explode(F.array("n", "p")).alias("node"), "g").distinct()


def rerank(vectors: DataFrame, groups: DataFrame, node: str, vec: str, k: int, floor: float, cap: int = CAP) -> DataFrame:
    """(node, other, cosine): up to k best of every node in each of its groups, of at least `floor`; equal cosines by the smaller id."""
    floats = vectors.select(F.col(node).alias("node"), F.col(vec).alias("_vec"))
    rows = in_blocks(groups, "g", "node", cap).join(floats, "node").repartition("g", "_i", "_j")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            keep = pa.table({c: b.column(b.schema.get_field_index(c)) for c in ("node", "g", "_i", "_j", "_own")})
            ids, x = unit_rows(b, "node", "_vec")
            if len(ids) != b.num_rows:
                ok = np.isin(keep.column("node").to_numpy(), ids)
                keep = keep.filter(pa.array(ok))
            parts.append((keep, x.astype(np.float32)))
        if not parts:
            return
        t, x = pa.concat_tables([p for p, _ in parts]), np.concatenate([v for _, v in parts])
        order, begin, end = _units(t, "g")
        node_, own, gi, gj = (t.column(c).to_numpy()[order] for c in ("node", "_own", "_i", "_j"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(begin, end, strict=True):
            ids, at = np.unique(node_[s:e], return_index=True)
            if len(ids) < 2:
                continue
            v = x[order[s:e][at]].astype(np.float64)
            o = own[s:e][at]
            for p in range(0, len(ids), BLOCK):
                sim = np.round(v[p : p + BLOCK] @ v.T, 9)
                r = np.arange(len(sim))
                sim[r, r + p] = -9.0
                if gi[s] != gj[s]:
                    sim[o[p : p + BLOCK, None] == o[None, :]] = -9.0
                if len(ids) > 4 * k:
                    kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
                    sim[sim < kth] = -9.0
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # ids ascend, so equal ones stay in their order
                cos = np.take_along_axis(sim, best, 1)
                i, j = np.nonzero(cos >= floor)
                out.append((ids[i + p], ids[best[i, j]], cos[i, j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "other", "cosine"])

    return rows.mapInArrow(judge, "node long, other long, cosine double")


def has_direction(vec: str) -> Column:
    """Whether a vector has a finite norm beyond zero; null for one with null values."""
    norm = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (norm > 0) & (norm < float("inf"))


def surplus_copies(vectors: DataFrame, node: str, vec: str, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows to search, pairs of surplus copies with their answers or None where no vector has more than k + 1 copies).

    Copies without a direction have no answers; as the search itself leaves them out, only they are tested here. The table of vectors with many
    copies is written first, so that its size is known when it is joined.
    """
    hashed = vectors.select(node, vec, F.xxhash64(vec).alias("_h"))
    many = materialised(hashed.groupBy("_h").count().where(F.col("count") > k + 1).select("_h"))
    if many.isEmpty():
        return vectors, None
    copies = hashed.join(many, "_h", "left_semi").where(has_direction(vec)).select("_h", F.col(node).alias("node")).distinct()
    first = copies.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("node"))).where(F.col("_r") <= k + 1)
    heads = materialised(first.groupBy("_h").agg(F.slice(F.sort_array(F.collect_list("node")), 1, k).alias("_heads"), F.max("node").alias("_last")))
    answers = copies.join(heads, "_h").where(F.col("node") > F.col("_last")).select("node", F.explode("_heads").alias("other"), F.lit(1.0).alias("cosine"))
    searched = hashed.join(heads.select("_h", "_last"), "_h", "left").where(F.col("_last").isNull() | (F.col(node) <= F.col("_last"))).select(node, vec)
    return searched, answers


def most_similar(vectors: DataFrame, k: int = 5, floor: float = -1.0, node: str = "node_id", vec: str = "vec", cap: int = CAP, aim: float = AIM) -> DataFrame:
    """(node, other, cosine): the k most similar vectors of each, as far as they are found and of at least `floor`.

    Pairs of cosine `aim` are found with a probability of GOAL, nearer ones with a higher one, others with a lower one.
    Null, all-zero and non-finite vectors take no part; rows repeated under one id count once; vectors must be of one length.
    Copies of one vector beyond k + 1 answer with the first k copies and are no answer to others. An empty table gives no rows.
    """
    usable = vectors.select(node, vec).where(F.col(node).isNotNull() & F.col(vec).isNotNull())
    rows = usable.count()
    sample = np.array([r[0] for r in bounded_sample(usable, [node], SAMPLE, rows).select(vec).collect() if r[0] and None not in r[0]], dtype=object)
    dims = int(np.bincount([len(s) for s in sample]).argmax()) if len(sample) else 0
    sample = np.array([s for s in sample if len(s) == dims], dtype=np.float64).reshape(-1, max(dims, 1))
    norm = np.sqrt((sample**2).sum(axis=1)) if len(sample) else np.zeros(0)
    sound = np.isfinite(norm) & (norm > 0)
    sample = sample[sound] / norm[sound, None]
    usable = usable.where(F.size(vec) == dims)
    searched, answers = surplus_copies(usable, node, vec, k)
    index = planned(sample, rows, aim)
    while True:
        hot = materialised(bucket_sizes(searched, index, node, vec).where(F.col("n") > 2 * cap))
        if index.bits >= MOST_BITS or hot.count() <= HOT:  # more bits until few buckets are hot
            break
        index = planned(sample, rows, aim, index.bits + 1)
    blocks = {r["bucket"]: math.ceil(r["n"] / cap) for r in hot.collect()}
    groups = checkpoint(meeting_groups(candidate_pairs(index_rows(searched, index, blocks, node, vec), index)))
    ranked = rerank(searched, groups, node, vec, k, floor, cap)
    place = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))  # equal for what comes twice
    best = ranked.withColumn("_r", place).where(F.col("_r") <= k).dropDuplicates(["node", "other"]).drop("_r")
    return best if answers is None else best.unionByName(answers)


def found(vectors: DataFrame, k: int = 5, floor: float = 0.88) -> DataFrame:
    """Distinct (node_a, node_b), node_a < node_b: one of them is among the k most similar of the other, with a cosine of at least `floor`."""
    best = most_similar(vectors, k, floor)
    return best.select(F.least("node", "other").alias("node_a"), F.greatest("node", "other").alias("node_b")).distinct()
