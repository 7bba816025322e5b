"""Near-duplicate records: pigeonhole blocks over fingerprints.

1. Each text becomes the set of its runs of three tokens and that set a fingerprint of
   ``BLOCKS * SLOTS`` slots, each the minimum of one hash over the set. Two texts of
   similarity s agree in a slot with probability s, so the Hamming distance between
   fingerprints (in slots) measures similarity.
2. The fingerprint is split into blocks. Fingerprints that differ in fewer slots than there
   are blocks share a block for certain (pigeonhole), others with probability
   ``1 - (1 - s**SLOTS)**BLOCKS``: 0.98 at s = 0.62, above 0.999 from s = 0.7.
3. Blocks are joined, and pairs are verified by the Hamming distance of compact
   fingerprints (two bits of every slot) inside the JVM.
4. Pairs whose distance leaves the similarity in doubt are compared exactly, by their sets.

Exact copies are reduced to one representative before the join and never paired there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.components import components
from jobweave.sources.scratch import cut, spread

BLOCKS, SLOTS = 40, 5
RUN = 3
BITS = 12  # of a slot, in a block
SEED = 20240607
BLOCKS_PER_LONG = 6  # compact fingerprint: 2 bits * 5 slots * 6 blocks
LONGS = -(-BLOCKS // BLOCKS_PER_LONG)
LOW_BITS = int("01" * (SLOTS * BLOCKS_PER_LONG), 2)
BROADCAST_ROWS = 200_000
COPIES_PER_TASK = 1_000
HOT_BLOCK, SAMPLE = 4_096, 64  # ids from which on a block is dealt over tasks; one of so many ids is looked at to tell

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 2**32, BLOCKS * SLOTS, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_B = _rng.integers(0, 2**32, BLOCKS * SLOTS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every token of lower-cased ``texts``: runs of ASCII letters and digits, single Han characters."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122))
    han = ((codes >= 0x4E00) & (codes <= 0x9FFF)) | ((codes >= 0x3400) & (codes <= 0x4DBF)) | ((codes >= 0x20000) & (codes <= 0x323AF)) | ((codes >= 0xF900) & (codes <= 0xFAFF)) | (codes == 0x3007)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins | han)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kept = word | han
    # Rolling hash of each run: the characters after a token's end count as zero.
    token = np.cumsum(begins | han) - 1
    place = np.arange(len(codes)) - starts[np.maximum(token, 0)]
    powers = np.cumprod(np.full(int(place.max()) + 2, _M1, dtype=np.uint64))
    terms = np.where(kept, codes.astype(np.uint64) * powers[np.maximum(place, 0)], np.uint64(0))
    return _mix(np.add.reduceat(terms, starts)), owner[starts]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of three tokens."""
    token, owner = token_hashes(texts)
    if len(token) < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = owner[: -(RUN - 1)] == owner[RUN - 1 :]
    mixed = _mix(token[:-2] * _M1 + _mix(token[1:-1] * _M2 + _mix(token[2:] * _M3 + np.uint64(1))))
    return mixed[inside], owner[: -(RUN - 1)][inside]


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts with a run of three tokens: number, copy keys (2), block keys, compact fingerprint."""
    h, owner = shingles(texts)
    if not len(h):
        return np.empty(0, np.int64), np.empty((0, 2), np.int64), np.empty((0, BLOCKS), np.int64), np.empty((0, LONGS), np.int64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    copies = np.stack([np.add.reduceat(_mix(h + _M1), starts), np.add.reduceat(_mix(h ^ _M2), starts)], 1)
    short = (h >> np.uint64(32)).astype(np.uint32)
    blocks = np.empty((len(starts), BLOCKS), np.uint64)
    compact = np.zeros((len(starts), LONGS), np.uint64)
    salt = np.arange(1, BLOCKS * SLOTS + 1, dtype=np.uint64) * _M1
    for block in range(BLOCKS):
        key = np.full(len(starts), salt[block], np.uint64)
        low = np.zeros(len(starts), np.uint64)
        for slot in range(SLOTS):
            k = block * SLOTS + slot
            least = _mix(np.minimum.reduceat(short * _A[k] + _B[k], starts).astype(np.uint64) + salt[k])
            key = key * _M2 + (least & np.uint64(2**BITS - 1))
            low = (low << np.uint64(2)) | (least & np.uint64(3))
        blocks[:, block] = _mix(key)
        compact[:, block // BLOCKS_PER_LONG] = (compact[:, block // BLOCKS_PER_LONG] << np.uint64(2 * SLOTS)) | low
    return owner[starts], copies.view(np.int64), blocks.view(np.int64), compact.view(np.int64)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.iloc[at : at + 2000]
            n, copies, blocks, compact = fingerprints(part["text"].tolist())
            yield pd.DataFrame({"id": part["id"].to_numpy()[n], "c1": copies[:, 0], "c2": copies[:, 1], "blocks": list(blocks), "compact": list(compact)})


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact similarity of the sets of ``left[k]`` and ``right[k]``, 0 where one is empty."""
    out = np.zeros(len(left))
    h, owner = shingles(left + right)
    edges = np.searchsorted(owner, np.arange(2 * len(left) + 1))
    sets = [set(h[edges[k] : edges[k + 1]].tolist()) for k in range(2 * len(left))]
    for k in range(len(left)):
        a, b = sets[k], sets[k + len(left)]
        if a and b:
            both = len(a & b)
            out[k] = both / (len(a) + len(b) - both)
    return out


def _estimate(a: str, b: str) -> Column:
    """Similarity from the share of agreeing slots of two compact fingerprints (chance agreement: 1/4)."""
    x = [F.col(a)[k].bitwiseXOR(F.col(b)[k]) for k in range(LONGS)]
    distance = sum((F.bit_count((v.bitwiseOR(F.shiftrightunsigned(v, 1))).bitwiseAND(F.lit(LOW_BITS))) for v in x[1:]), F.bit_count((x[0].bitwiseOR(F.shiftrightunsigned(x[0], 1))).bitwiseAND(F.lit(LOW_BITS))))
    return (1 - distance / F.lit(float(BLOCKS * SLOTS)) - 0.25) / 0.75


def representatives(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(features of one row per different token sequence, (id, rep) of every row with a fingerprint)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length(text_col) >= min_chars))
    features = cut(spread(rows).mapInPandas(_features, "id long, c1 long, c2 long, blocks array<long>, compact array<long>"))
    copies = cut(features.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    few = copies.count() <= BROADCAST_ROWS
    known = features.join(F.broadcast(copies) if few else copies, ["c1", "c2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    return known.where("rep = id").select("id", "blocks", "compact"), known.select("id", "rep").distinct()


def meeting_pairs(posted: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids of ``posted`` (id, block) that share a block, once for every block they share.

    A block that many ids hold (a boilerplate passage) would be one key of the join. Such
    blocks are told by a sample of the ids, and dealt over tasks: each of ``parts`` tasks
    meets a part of their ids with all of them. The sample decides on the dealing only; every
    pair is met whatever it says.
    """
    sampled = posted.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(SAMPLE)) == 0).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sampled.where(F.col("n") * SAMPLE >= HOT_BLOCK).select("block", F.ceil(F.col("n") * SAMPLE / HOT_BLOCK).cast("int").alias("parts")))
    number = hot.count()
    if not number:
        left, right = posted, posted
        keys = ["block"]
    else:
        marked = posted.join(F.broadcast(hot) if number <= BROADCAST_ROWS else hot, "block", "left")
        left = marked.select("id", "block", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))
        right = marked.select("id", "block", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"))
        keys = ["block", "part"]
    other = right.withColumnRenamed("id", "id_b")
    return left.withColumnRenamed("id", "id_a").join(other, keys).where("id_a < id_b").select("id_a", "id_b")


def similar_pairs(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.6,
    min_chars: int = 60,
    doubt: tuple[float, float] = (0.12, 0.12),
) -> tuple[DataFrame, DataFrame]:
    """((id_a, id_b) between representatives, (id, rep) of every row with a fingerprint).

    A pair is reported when the sets of three successive tokens of both texts are alike to at
    least ``threshold``; an estimate within ``doubt`` (below, above) of the threshold is decided
    by the sets themselves. Texts that are null, shorter than ``min_chars`` or hold fewer than
    three tokens take no part; a row id that is null neither. Rows with equal token sequences
    share a representative, their smallest id, and repeated ids count once. An empty table
    gives empty results. Other columns of ``df`` play no part.
    """
    reps, members = representatives(df, id_col, text_col, min_chars)
    met = meeting_pairs(reps.select("id", F.explode("blocks").alias("block"))).distinct()
    compact = reps.select("id", "compact")
    verified = (
        met.join(compact.select(F.col("id").alias("id_a"), F.col("compact").alias("fa")), "id_a")
        .join(compact.select(F.col("id").alias("id_b"), F.col("compact").alias("fb")), "id_b")
        .select("id_a", "id_b", _estimate("fa", "fb").alias("estimate"))
        .where(F.col("estimate") >= threshold - doubt[0])
    )
    verified = cut(verified)
    sure = verified.where(F.col("estimate") > threshold + doubt[1]).select("id_a", "id_b")
    open_ = verified.where(F.col("estimate") <= threshold + doubt[1]).select("id_a", "id_b")
    ids = open_.select(F.col("id_a").alias("id")).unionByName(open_.select(F.col("id_b").alias("id"))).distinct()
    few = open_.count() <= BROADCAST_ROWS
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = cut(texts)
    score = F.pandas_udf(lambda a, b: pd.Series(jaccard(a.tolist(), b.tolist())), "double")
    exact = (
        open_.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("ta")), "id_a")
        .join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("tb")), "id_b")
        .where(score("ta", "tb") >= threshold)
        .select("id_a", "id_b")
    )
    return sure.unionByName(exact), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows that ``pairs`` of representatives and copies stand for.

    Their number is that of the result asked for: a class of n copies stands for n(n-1)/2
    pairs. Large classes are dealt over tasks, ``COPIES_PER_TASK`` rows against the whole class
    each. Where the pairs themselves are not wanted, :func:`similar_groups` says the same in
    one row per row.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / COPIES_PER_TASK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    several = members.join(sizes.where("n > 1").select("rep", "parts"), "rep")
    dealt = several.select("rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    against = several.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = dealt.join(against, ["rep", "part"]).where("x < y").select("x", "y")
    # The copies of one end are dealt in the same way and meet all copies of the other end.
    dealt = pairs.join(members.select(F.col("rep").alias("id_a"), F.col("id").alias("x")), "id_a").join(sizes.select(F.col("rep").alias("id_b"), "parts"), "id_b")
    dealt = dealt.select("x", "id_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    split = members.join(sizes.select("rep", "parts"), "rep").select(F.col("rep").alias("id_b"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    across = dealt.join(split, ["id_b", "part"]).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, copies, links) of every row with a fingerprint.

    ``group_id`` is the smallest id that chains of similar pairs reach, ``copies`` the number
    of rows with the same token sequence, ``links`` the number of other token sequences similar to it.
    """
    grouped = components(pairs, "id_a", "id_b").withColumnRenamed("node", "rep")
    ends = pairs.select(F.col("id_a").alias("rep")).unionByName(pairs.select(F.col("id_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    per_rep = copies.join(grouped, "rep", "left").join(links, "rep", "left")
    return members.join(per_rep, "rep").select("id", F.coalesce("component", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
