"""Evaluation texts leaking into training text, by an FM-index per shard of documents.

Documents and items are reduced to their tokens (lower-cased runs of Latin letters and
digits, other letters one by one). Each shard of documents gets one FM-index; every phrase of
every item (:mod:`jobweave.llm.phrases`) is searched backwards through it and located. Places
of one item that lie within a passage of one and a half times its length and together cover
``MIN_SEED`` of it are candidates; the share of the item's tokens found in order in such a
passage decides. Shards are independent: nothing but matches leaves them. Items never pass
through the driver: executors write them in blocks of bounded size to the checkpoint folder,
and every executor fetches those files once.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.fm_index import FMIndex
from jobweave.llm.phrases import Group, Phrases, codes_of, ranges
from jobweave.sources.scratch import ensure_checkpoint_dir, spread

MIN_SEED = 0.15
STRETCH = 1.5
NEAR, SLACK = 0.15, 0.05
SHARD_CHARS = 400_000
BLOCK_CHARS = 400_000  # of item texts in a block
BLOCKS_HELD = 8  # by a Python worker at a time
EXPANDED = 4_000_000  # (place, item) rows looked at together
FEW = 16  # items of one document that are compared one by one
_TOKEN = re.compile(r"[a-z0-9]+|[^\W\d_a-z]")


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


@lru_cache(maxsize=65536)
def _alone(char: str) -> bool:
    """Whether ``char`` folds to one character and joins no other."""
    return len(_folded(char)) == 1 and not unicodedata.combining(char) and not "\u1100" <= char <= "\u11ff" and unicodedata.normalize("NFD", char) == char


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(_folded(text))


def token_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its tokens."""
    if all(_alone(c) for c in set(text)):
        return [m.span() for m in _TOKEN.finditer(_folded(text))]
    folded, places = [], []
    # Fold whole clusters: a character with the marks that follow it, as these may compose.
    for m in re.finditer(r".[\u0300-\u036f\u3099\u309a\uff9e\uff9f]*", text, re.S):
        for c in _folded(m.group(0)):
            folded.append(c)
            places.append((m.start(), m.end()))
    return [(places[t.start()][0], places[t.end() - 1][1]) for t in _TOKEN.finditer("".join(folded))]


def common_tokens(item: list[str], passage: list[str], where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit per token of the item; ``where`` are the item's bits, if known."""
    bits = token_bits(item) if where is None else where
    full = (1 << len(item)) - 1
    state = full
    for hit in map(bits.get, passage):
        if hit and (hit := hit & state):
            state = ((state + hit) | (state - hit)) & full
    return len(item) - state.bit_count()


def token_bits(item: list[str]) -> dict[str, int]:
    """Of each token the bits of its places in ``item``."""
    where: dict[str, int] = defaultdict(int)
    for k, t in enumerate(item):
        where[t] |= 1 << k
    return where


class Item:
    """One evaluation text: its tokens, number of letters and the length of its phrases."""

    def __init__(self, phrases: Phrases, k: int):
        self.item_id, self.tokens, self.size, self.phrase = phrases.ids[k], phrases.tokens[k], int(phrases.size[k]), int(phrases.phrase[k])
        self.where = token_bits(self.tokens)


@lru_cache(maxsize=1)
def _letters_of_tokens() -> np.ndarray:
    """Of every code point whether it is a letter or digit of tokens."""
    every = "".join(map(chr, range(0x110000)))
    kept = np.zeros(0x110000, bool)
    for m in _TOKEN.finditer(every):
        kept[m.start() : m.end()] = True
    return kept


class Shard:
    """The letters of some documents, one after another, under one FM-index."""

    def __init__(self, texts: list[str]):
        self.folded = folded = [_folded(t) for t in texts]
        codes = codes_of("".join(folded))
        kept = _letters_of_tokens()[codes]
        edges = np.r_[0, np.cumsum([len(t) for t in folded])]
        before = np.r_[0, np.cumsum(kept)][edges]
        # A code of its own between documents keeps phrases from running across them.
        self.begin = before[:-1] + np.arange(len(texts))
        owner = np.repeat(np.arange(len(texts)), np.diff(before))
        letters = codes[kept]
        seen = np.zeros(0x110000, bool)
        seen[letters] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        symbols = (np.cumsum(seen, dtype=np.int64) - 1)[letters]
        self.index: FMIndex | None = None
        if len(symbols):
            joined = np.full(len(symbols) + len(texts), len(self.alphabet) + 1, np.int64)
            joined[np.arange(len(symbols)) + owner] = symbols + 1
            self.index = FMIndex(joined)

    def seeds(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, place in item, place in document) of the phrases found, whole documents at a time,
        of items of whose letters they cover ``MIN_SEED``; sorted by document, item and place in document."""
        if self.index is None:
            return
        least = MIN_SEED * phrases.size
        for group in phrases.groups:
            number, low, high = group.search(self.index, self.alphabet)
            place = self.index.locate(ranges(low, high - low))
            number = np.repeat(number, high - low)
            document = np.searchsorted(self.begin, place, side="right") - 1
            order = np.argsort(document, kind="stable")
            number, place, document = number[order], (place - self.begin[document])[order], document[order]
            owned = group.owners[number + 1] - group.owners[number]
            edges = np.flatnonzero(np.r_[True, document[1:] != document[:-1], True]) if len(document) else np.zeros(1, int)
            for part in _parts(np.add.reduceat(owned, edges[:-1]) if len(document) else owned):
                whole = slice(edges[part.start], edges[part.stop])
                wanted = None
                if owned[whole].sum() > EXPANDED:
                    # One document full of phrases that many items share: count them before places are written out.
                    wanted = _counts(group, np.unique(number[whole]), len(phrases.ids)) * group.length >= least
                rows = [_owners(group, number[whole][x], place[whole][x], document[whole][x], wanted) for x in _parts(owned[whole])]
                yield _covering(*[np.concatenate(x) for x in zip(*rows, strict=True)], group.length, least)


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of ``sizes`` that stay within ``EXPANDED`` together, or hold a single one beyond it."""
    total = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + EXPANDED, side="right")) - 1)
        yield slice(at, end)
        at = end


def _owners(group: Group, number: np.ndarray, place: np.ndarray, document: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, place in item, place in document): phrases with the items they come from."""
    many = group.owners[number + 1] - group.owners[number]
    rows = ranges(group.owners[number], many)
    kept = slice(None) if wanted is None else wanted[group.item[rows]]
    return np.repeat(document, many)[kept], group.item[rows][kept], group.place[rows][kept], np.repeat(place, many)[kept]


def _counts(group: Group, numbers: np.ndarray, items: int) -> np.ndarray:
    """Of each item how many of its places hold one of the phrases ``numbers``."""
    many = group.owners[numbers + 1] - group.owners[numbers]
    out = np.zeros(items, np.int64)
    for part in _parts(many):
        out += np.bincount(group.item[ranges(group.owners[numbers[part]], many[part])], minlength=items)
    return out


def _covering(document: np.ndarray, item: np.ndarray, q: np.ndarray, p: np.ndarray, length: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of those documents and items where the phrases cover at least ``least`` letters of the item in all."""
    order = np.lexsort((q, item, document))
    d, k, x = document[order], item[order], q[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])][: len(d)]
    gap = np.r_[x[1:] - x[:-1], length][: len(x)]
    gap[np.r_[first[1:], True][: len(x)]] = length
    starts = np.flatnonzero(first)
    covered = np.add.reduceat(np.minimum(gap, length), starts) if len(starts) else gap
    kept = np.repeat(covered >= least[k[starts]], np.diff(np.r_[starts, len(d)]))
    rows = order[kept]
    rows = rows[np.lexsort((p[rows], item[rows], document[rows]))]
    return document[rows], item[rows], q[rows], p[rows]


def common_letters(item: list[str], passage: list[str]) -> float:
    """Letters in the heaviest common subsequence of tokens, as a part of the item's letters."""
    best = [0] * (len(passage) + 1)
    for t in item:
        now = [0]
        for j, other in enumerate(passage):
            now.append(max(best[j] + len(t) if t == other else 0, best[j + 1], now[j]))
        best = now
    return best[-1] / sum(map(len, item))


def _candidates(item: Item, tokens: list[str], starts: list[int], q: np.ndarray, p: np.ndarray, low: int, high: int) -> list[tuple[float, int, int]]:
    """(share of the item, first token, end token) of the passages around the seeds, within tokens ``low`` to ``high``."""
    m = item.size
    size = int(STRETCH * len(item.tokens))
    tried: dict[int, tuple[float, int, int]] = {}
    begins = np.unique(p - q)
    for begin in begins.tolist():
        inside = (p >= begin - m // 10) & (p < begin + STRETCH * m)
        seeds = np.unique(q[inside])
        if item.phrase + np.minimum(seeds[1:] - seeds[:-1], item.phrase).sum() < MIN_SEED * m:
            continue
        first = max(low, bisect_right(starts, max(0, begin)) - 1 - max(2, len(item.tokens) // 10))
        end = min(high, first + size)
        if first in tried or first >= end:
            continue
        tried[first] = (common_tokens(item.tokens, tokens[first:end], item.where) / len(item.tokens), first, end)
    return list(tried.values())


def _uncovered(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The parts of ``low`` to ``high`` outside ``spans``."""
    out = []
    for first, end in sorted(spans):
        if first > low:
            out.append((low, first))
        low = max(low, end)
    return [*out, (low, high)] if low < high else out


def _passages(item: Item, tokens: list[str], starts: list[int], q: np.ndarray, p: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(share of the item, first token, end token) of every passage whose share reaches ``threshold``.

    The best goes first; one that lies by half or more in those taken is the same passage.
    What is left between them is searched again by itself, as a better neighbour hides a
    passage that shares its window.
    """
    taken: list[tuple[float, int, int]] = []

    def rest(low: int, high: int) -> list[tuple[int, int]]:
        return _uncovered([(a, b) for _, a, b in taken], low, high)

    whole = _candidates(item, tokens, starts, q, p, 0, len(tokens))
    for share, first, end in sorted(whole, key=lambda x: (-x[0], x[1])):
        if share < threshold:
            break
        first, end = _tight(item, tokens, first, end)
        if 2 * sum(b - a for a, b in rest(first, end)) > end - first:
            taken.append((share, first, end))
    open_parts = rest(0, len(tokens)) if taken else []
    while open_parts:
        low, high = open_parts.pop()
        if high - low < threshold * len(item.tokens):
            continue
        inside = (p >= starts[low]) & (p < starts[high - 1] + len(tokens[high - 1]))
        best = max(_candidates(item, tokens, starts, q[inside], p[inside], low, high), key=lambda x: (x[0], -x[1]), default=None)
        if best and best[0] >= threshold:
            first, end = _tight(item, tokens, best[1], best[2])
            taken.append((best[0], first, end))
            open_parts += [(a, b) for a, b in ((low, first), (end, high)) if a < b]
    return taken


def _possible(phrases: Phrases, tokens: list[str], starts: list[int], k: np.ndarray, begin: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the items of which some window at their seeds holds enough tokens, whatever their order.

    Many items may share an opening; all whose seeds lead to one place are looked at together.
    """
    out = []
    order = np.lexsort((k, begin))
    k, begin = k[order], begin[order]
    edges = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        items = np.unique(k[a:b])
        longest = int(phrases.count[items].max())
        at = bisect_right(starts, max(0, int(begin[a]))) - 1
        window = tokens[max(0, at - max(2, longest // 10)) : at + int(STRETCH * longest) + 1]
        out.append(items[phrases.known_in(items, window) >= threshold * phrases.count[items]])
    return np.unique(np.concatenate(out))


def shard_leaks(ids: list[int], texts: list[str], blocks: Iterable[Phrases], threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(document id, item id, share, first and end place in the text) of every leak in one shard."""
    shard = Shard(texts)
    out = []

    @lru_cache(maxsize=None)
    def read(d: int) -> tuple[list[str], list[int]]:
        tokens = _TOKEN.findall(shard.folded[d])
        return tokens, np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]].tolist()

    places = lru_cache(maxsize=None)(lambda d: token_places(texts[d]))
    for phrases in blocks:
        known = lru_cache(maxsize=100_000)(partial(Item, phrases))
        for document, k, q, p in shard.seeds(phrases):
            keep = np.ones(len(k), bool)
            new = np.r_[True, document[1:] != document[:-1], True] if len(k) else np.zeros(1, bool)
            for a, b in itertools.pairwise(np.flatnonzero(new).tolist()):
                if len(np.unique(k[a:b])) > FEW:
                    some = _possible(phrases, *read(int(document[a])), k[a:b], p[a:b] - q[a:b], threshold)
                    keep[a:b] = np.isin(k[a:b], some)
            document, k, q, p = document[keep], k[keep], q[keep], p[keep]
            edges = np.flatnonzero(np.r_[True, (document[1:] != document[:-1]) | (k[1:] != k[:-1]), True]) if len(k) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                item, d = known(int(k[a])), int(document[a])
                tokens, starts = read(d)
                for share, first, end in _passages(item, tokens, starts, q[a:b], p[a:b], threshold):
                    # Short words in common order are no half of a text: near the threshold the letters count as well.
                    if share < threshold + NEAR and common_letters(item.tokens, tokens[first:end]) < threshold - SLACK:
                        continue
                    out.append((ids[d], item.item_id, share, places(d)[first][0], places(d)[end - 1][1]))
    return out


def _tight(item: Item, tokens: list[str], first: int, end: int) -> tuple[int, int]:
    """The passage without outer tokens that add nothing to what it holds of the item."""
    whole = common_tokens(item.tokens, tokens[first:end], item.where)
    low = bisect_left(range(first, end), 1, key=lambda x: int(common_tokens(item.tokens, tokens[x:end], item.where) < whole)) - 1 + first
    high = bisect_left(range(low + 1, end + 1), 1, key=lambda x: int(common_tokens(item.tokens, tokens[low:x], item.where) == whole)) + low + 1
    return low, high


def write_blocks(items: DataFrame, item_id: str, item_text: str) -> list[str]:
    """Items in blocks of about ``BLOCK_CHARS`` characters, as files that every executor can fetch; their names.

    Executors write the blocks to the checkpoint folder; the driver learns the sizes and the names of the files only.
    """
    spark = items.sparkSession
    known = items.where(F.length(item_text) > 0).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, math.ceil((known.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS))
    folder = f"{ensure_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"
    placed = known.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int"))
    ordered = placed.repartition(blocks, "b").sortWithinPartitions("b", "i", "t")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[int, int, list[str]]] = []
        for batch in batches:
            for b, i, t in zip(batch["b"].tolist(), batch["i"].tolist(), batch["t"].tolist(), strict=True):
                if rows and rows[0][0] != b:
                    yield packed(rows)
                    rows = []
                tokens = tokens_of(t)
                if tokens:
                    rows.append((b, i, tokens))
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple[int, int, list[str]]]) -> pd.DataFrame:
        return pd.DataFrame({"data": [pickle.dumps(Phrases([i for _, i, _ in rows], [t for _, _, t in rows]), 5)]})

    ordered.mapInPandas(build, "data binary").write.parquet(folder)
    files = sorted(spark.read.schema("data binary").parquet(folder).inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


_held: OrderedDict[str, list[Phrases]] = OrderedDict()


def _blocks(names: list[str]) -> Iterator[Phrases]:
    """The blocks of items, read from the files of this executor; a few of them stay in memory."""
    for name in names:
        if name not in _held:
            _held[name] = [pickle.loads(row) for row in pq.read_table(SparkFiles.get(name), partitioning=None)["data"].to_pylist()]
            while len(_held) > BLOCKS_HELD:
                _held.popitem(last=False)
        _held.move_to_end(name)
        yield from (p.ready() for p in _held[name])


def _search(names: list[str], threshold: float):
    shard_chars = SHARD_CHARS * min(10, max(1, len(names) // BLOCKS_HELD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[str] = []
        held = 0

        def done() -> pd.DataFrame:
            return pd.DataFrame(shard_leaks(ids, texts, _blocks(names), threshold), columns=["doc", "item", "share", "first", "end"])

        for batch in batches:
            for i, t in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= shard_chars:
                    yield done()
                    ids, texts, held = [], [], 0
        if ids:
            yield done()

    return run


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc, item, share, first, end): every document passage that holds an item wholly or in large part.

    ``share`` is the part of the item's tokens that one passage, at most one and a half times
    as long, holds in their order, ``threshold`` or more; below ``threshold + NEAR`` the
    letters of these tokens must reach ``threshold - SLACK`` as well. An item held several
    times gives a row each time. ``first`` and ``end`` bound the passage in the document's text. Documents
    are read and indexed once, whatever the number of items, and never shuffled; items reach
    the executors as files (:func:`write_blocks`). Null or empty texts and items without
    letters give no row, repeated rows give repeated rows, an empty table none. Other columns
    play no part.
    """
    docs = spread(documents.where(F.length(doc_text) > 0).select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text")))
    return docs.mapInPandas(_search(write_blocks(items, item_id, item_text), threshold), "doc long, item long, share double, first long, end long")


def removal_spans(leaks: DataFrame) -> DataFrame:
    """(doc, spans): the passages of each document to take out, overlapping ones merged.

    Passages of one item hardly overlap, so a document has no more of them than its length and
    the items leaked into it allow, and its spans stay small.
    """
    spans = leaks.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"))
    merged = F.expr("""
        aggregate(s, cast(array() as array<struct<first:bigint,end:bigint>>), (acc, x) ->
          case when size(acc) > 0 and acc[size(acc) - 1].end >= x.first
               then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', acc[size(acc) - 1].first, 'end', greatest(acc[size(acc) - 1].end, x.end))))
               else concat(acc, array(x)) end)
    """)
    return spans.select("doc", merged.alias("spans"))
