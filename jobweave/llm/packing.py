"""Filling fixed-capacity containers with texts counted in tokens.

Bounded-space online best fit: a packer holds a fixed number of open bins in a bitset keyed
by free space. An item goes to the open bin it leaves fullest; if none has room, a new bin
opens, and when too many are open the fullest one closes. Packers are independent: items are
spread over as many as keep each at about ``ITEMS_PER_PACKER``, so that the few bins a packer
ends with half-filled do not count. Only (id, length) pairs are shuffled, never texts.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.sources.scratch import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level tokenizers split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
OPEN_BINS = 128
ITEMS_PER_PACKER = 200_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = TOKENIZER) -> list[int]:
    """Token ids of ``text``; ``path`` is a vocabulary of base64 tokens and ranks."""
    return _encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every row; null and empty texts have no tokens."""

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, tokenizer)) if t else 0 for t in texts], dtype="int64")

    return spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.pandas_udf(count, "long")(text_col).alias("n_tokens"))


class Packer:
    """Open bins of one packer."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f is set when a bin with free space f is open
        self.bins: dict[int, list[int]] = {}
        self.count = self.opened = 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """(bin, place in it) of an item of 1 to ``capacity``."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.opened
            self.opened += 1
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.capacity - space


def best_fit(sizes: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    packer = Packer(capacity, open_bins)
    return [packer.put(s) for s in sizes]


def pack(lengths: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, items_per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """(container_id, place, id, piece, first_token, n_tokens): where every text goes.

    ``lengths`` has (id, n_tokens). ``place`` is the token at which the piece begins in its
    container. A text longer than ``capacity`` is split into full pieces and a rest, others
    are whole; texts without tokens go nowhere. Repeated ids are packed as often as they
    occur, null ids like any other. The result is the same for the same rows, whatever their
    order: packers are chosen by a hash and filled in hash order.
    """
    pieces = lengths.where("n_tokens > 0").select(
        "id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long"))).alias("piece", "first_token"), F.col("n_tokens").alias("all")
    )
    pieces = cut(pieces.select("id", "piece", "first_token", F.least(F.col("all") - F.col("first_token"), F.lit(capacity)).cast("int").alias("n_tokens")))
    packers = max(1, math.ceil(pieces.count() / items_per_packer))
    dealt = pieces.withColumn("h", F.xxhash64("id", "piece")).withColumn("packer", F.pmod("h", F.lit(packers)).cast("int"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packer = None, None
        for batch in batches:
            containers, places = [], []
            for which, size in zip(batch["packer"].tolist(), batch["n_tokens"].tolist(), strict=True):
                if which != now:
                    now, packer = which, Packer(capacity, open_bins)
                number, place = packer.put(size)
                containers.append((which << 40) | number)
                places.append(place)
            yield pd.DataFrame({"container_id": containers, "place": places} | {c: batch[c] for c in ("id", "piece", "first_token", "n_tokens")})

    id_type = lengths.schema["id"].dataType.simpleString()
    # A packer is the number of its partition, so every task gets one of them.
    ordered = dealt.repartitionById(packers, "packer").sortWithinPartitions("packer", "h", "id", "piece")
    return ordered.mapInPandas(fill, f"container_id long, place int, id {id_type}, piece int, first_token long, n_tokens int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, least, tokens, unused_share): one row; ``least`` is the number that no packing can go below."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("used") / capacity).alias("least"),
        F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
