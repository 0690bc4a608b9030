"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from tokenizers import Tokenizer

from . import bpe
from .common import cut, over_texts, whole

#: Items of one problem; a table is dealt to as many problems as it needs.
BLOCK_ITEMS = 2048
#: Bins filled less than this share are opened again and packed across problems.
WELL_FILLED = 0.99


class Encoder:
    """Ids of whole texts by a .json vocabulary, as the tokenizers library gives them.

    tiktoken's merging by ranks gives the same ids in a fifth of the time where every token's id follows the order of
    merges, which is checked, and every token is what its own text merges to. Where one isn't, tokenizers itself takes all texts; it also takes a text
    whose white space tiktoken's splitting can't.
    """

    def __init__(self, source: bytes):
        spec = bpe.byte_level(source)
        letters, ids = bpe.byte_letters(), spec["model"]["vocab"]
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.library, self.fast = Tokenizer.from_str(source.decode()), None
        self.library.no_truncation()
        self.library.no_padding()
        model = self.library.model
        if merged != sorted(set(merged)) or merged and merged[0] < max(ids[c] for c in letters):
            raise ValueError("ids must follow the order of merges")
        if all([x.id for x in model.tokenize(t)] == [i] for t, i in ids.items() if t not in special):
            ranks = {bytes(letters[c] for c in t): i for t, i in ids.items() if t not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            with suppress(ValueError):  # hundreds of thousands of white space characters in a row
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and one ``end_id``, cut to pieces.

    Only documents over ``capacity`` are cut; then the first piece may be the short one. A null
    text counts as empty and gives one piece with ``end_id`` alone.
    """
    shared = bpe.shared_vocabulary(docs, path)

    def start():
        encoder = bpe.once(("pieces", path), lambda: Encoder(shared.value[1]))
        end = np.array([end_id], "<u4").tobytes()

        def pieces(text: str) -> tuple:
            data = encoder.ids(text).tobytes() + end
            n = len(data) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            size = np.diff(edges).tolist()
            return list(range(len(size))), edges[:-1], size, [zlib.crc32(data[4 * a : 4 * (a + s)]) for a, s in zip(edges, size, strict=False)]

        return lambda texts: list(map(pieces, texts))

    of = over_texts("piece array<int>, start array<long>, length array<long>, crc array<long>", start)
    made = docs.select(F.col(key), of(whole(text)).alias("p"))
    each = F.explode(F.arrays_zip("p.piece", "p.start", "p.length", "p.crc"))
    return made.select(key, each.alias("p")).select(key, "p.piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"))


# -- one problem: bins of a block of items, which are in descending order of size


def best_fit(order, sizes: list[int], bins: np.ndarray, residual: list[int], capacity: int) -> None:
    """Put each item of ``order`` where it leaves the least room; ``bins`` and ``residual`` change."""
    room: dict[int, list[int]] = {}
    levels = 0
    for b, r in enumerate(residual):
        if r > 0:
            room.setdefault(r, []).append(b)
            levels |= 1 << r
    for i in order:
        s = sizes[i]
        if fitting := levels >> s:
            r = s + (fitting & -fitting).bit_length() - 1
            held = room[r]
            b = held.pop()
            if not held:
                levels ^= 1 << r
        else:
            b, r = len(residual), capacity
            residual.append(capacity)
        bins[i] = b
        r -= s
        residual[b] = r
        if r:
            room.setdefault(r, []).append(b)
            levels |= 1 << r


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """(bins, less the mean square of their fill): less is better."""
    fill = np.bincount(bins, weights=sizes)
    return len(fill), -float(np.square(fill / capacity).sum() / max(1, len(fill)))


def cross(into: np.ndarray, source: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``into`` with whole well-filled bins of ``source``.

    Bins of ``into`` that hold an injected item are opened, as are its emptiest ones; what that displaces is best-fitted.
    """
    fill = np.bincount(source, weights=sizes)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(fill >= np.median(fill))
    taken = np.zeros(len(fill), bool)
    taken[rng.choice(good, max(1, len(good) // 8), replace=False)] = True
    injected = taken[source]
    own = np.bincount(into, weights=sizes)
    opened = np.zeros(len(own), bool)
    opened[into[injected]] = True
    opened[np.argsort(own, kind="stable")[: 1 + len(own) // 50]] = True
    kept = ~opened[into] & ~injected
    child = np.full(len(into), -1, np.int32)
    child[injected] = (np.cumsum(taken) - 1)[source[injected]]
    child[kept] = taken.sum() + (np.cumsum(~opened) - 1)[into[kept]]
    placed = child >= 0
    residual = (capacity - np.bincount(child[placed], weights=sizes[placed], minlength=int(taken.sum() + (~opened).sum()))).astype(int).tolist()
    best_fit(np.flatnonzero(~placed).tolist(), sizes.tolist(), child, residual, capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, members: int, children: int) -> list[np.ndarray]:
    """One epoch of one island; the first of the result is the best. Stops early at the lower bound."""
    n, least = len(sizes), -(-int(sizes.sum()) // capacity)
    while len(population) < members:
        noise = rng.uniform(0.9, 1.1, n) if population else np.ones(n)
        bins = np.zeros(n, np.int32)
        best_fit(np.argsort(-sizes * noise, kind="stable").tolist(), sizes.tolist(), bins, [], capacity)
        population.append(bins)
        if bins.max() + 1 == least:
            break
    scored = sorted(((fitness(b, sizes, capacity), b) for b in population), key=lambda x: x[0])
    for _ in range(children):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        a, b = (min(rng.choice(len(scored), 2)) for _ in range(2))
        child = cross(scored[a][1], scored[b if a != b else (a + 1) % len(scored)][1], sizes, capacity, rng)
        if (f := fitness(child, sizes, capacity)) < scored[-1][0]:
            scored = sorted([*scored[:-1], (f, child)], key=lambda x: x[0])
    return [b for _, b in scored]


def solve(blocks: DataFrame, capacity: int, islands: int, epochs: int, members: int, children: int) -> DataFrame:
    """(block, bins array): for each problem (block, sizes array, known array or null) the best packing found.

    Every island is a row with its population and evolves in a task of its own; after each epoch an island gets the
    elite of its neighbour. Random numbers depend on block, island and epoch alone, so that a lost task is done again alike.
    """
    schema = "block long, island int, sizes array<int>, population array<array<int>>, count int, fit double, elite array<int>"

    def epoch(number: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                out = []
                for r in pdf.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    rng = np.random.default_rng([int(r.block) % 2**32, int(r.island), number])
                    population = [np.asarray(x, np.int32) for x in ([] if r.population is None else list(r.population))]
                    if number and r.elite is not None:
                        population = [*population[:-1], np.asarray(r.elite, np.int32)] if len(population) >= members else [*population, np.asarray(r.elite, np.int32)]
                    population = evolve(sizes, population, capacity, rng, members, children)
                    count, fit = fitness(population[0], sizes, capacity)
                    out.append((r.block, r.island, r.sizes, population, count, fit, population[0]))
                yield pd.DataFrame(out, columns=["block", "island", "sizes", "population", "count", "fit", "elite"])

        return run

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.when(F.col("known").isNotNull(), F.array("known")).alias("population"), F.lit(0).alias("count"), F.lit(0.0).alias("fit"), F.lit(None).cast("array<int>").alias("elite"))
    ring = W.Window.partitionBy("block").orderBy("island")
    for number in range(epochs):
        state = state.repartition(tasks, "block", "island").mapInPandas(epoch(number), schema)
        if number < epochs - 1:
            state = state.withColumn("elite", F.coalesce(F.lag("elite").over(ring), F.last("elite").over(ring.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))))
    return state.groupBy("block").agg(F.min_by("elite", F.struct("count", "fit", "island")).alias("bins"))


def pack(items: DataFrame, size: str = "length", capacity: int = 2048, islands: int = 3, epochs: int = 2, members: int = 4, children: int = 12, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences of ``capacity`` as are found.

    Items are dealt evenly to problems of about ``block_items``. Bins less than well filled are then opened and packed again
    across problems, starting from the bins they had. Sizes are from 1 to ``capacity``; other columns are carried along.
    """
    names = items.columns
    rows = cut(items.select(F.monotonically_increasing_id().alias("_row"), F.struct(*names).alias("_item"), F.col(size).cast("int").alias("_size")))

    def one_round(rows: DataFrame, known: str | None) -> DataFrame:
        listed = rows.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct((-F.col("_size")).alias("less"), F.col("_row"), F.col("_item"), *([F.col(known).cast("int").alias("known")] if known else []))), asc=True).alias("items"))
        listed = cut(listed)
        sizes = F.transform("items", lambda x: -x["less"])
        old = F.transform("items", lambda x: x["known"]) if known else F.lit(None).cast("array<int>")
        best = solve(listed.select(F.col("_block").alias("block"), sizes.alias("sizes"), old.alias("known")), capacity, islands, epochs, members, children)
        done = listed.join(best, listed["_block"] == best["block"]).select("_block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
        return done.select("_block", F.col("x.bins").alias("_bin"), (-F.col("x.items.less")).alias("_size"), F.col("x.items._row").alias("_row"), F.col("x.items._item").alias("_item"))

    def filled(rows: DataFrame) -> DataFrame:
        """With the fill of each bin and the place in it; a bin is in one block, so its rows are few."""
        bin_ = W.Window.partitionBy("_block", "_bin")
        order = bin_.orderBy("_row").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        return rows.withColumn("_fill", F.sum("_size").over(bin_)).withColumn("offset", F.sum("_size").over(order) - F.col("_size"))

    n = rows.count()
    blocks = max(1, -(-n // block_items))
    first = cut(filled(one_round(rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))), None)))
    full = first.filter(F.col("_fill") >= WELL_FILLED * capacity)
    rest = first.filter(F.col("_fill") < WELL_FILLED * capacity)
    again = max(1, -(-rest.count() // block_items))
    # a known bin gets its number inside its new block
    bins = rest.select("_block", "_bin").distinct().withColumn("_next", F.pmod(F.xxhash64("_block", "_bin"), F.lit(again)))
    bins = bins.withColumn("_known", F.row_number().over(W.Window.partitionBy("_next").orderBy("_block", "_bin")) - 1)
    rest = rest.join(bins, ["_block", "_bin"]).select("_row", "_item", "_size", F.col("_next").alias("_block"), "_known")
    second = filled(one_round(rest, "_known")).withColumn("_block", F.col("_block") + blocks)
    number = F.col("_block") * F.lit(1 << 20) + F.col("_bin")
    out = [x.select("_item.*", number.cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")) for x in (full, second)]
    return out[0].unionByName(out[1])


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    Rows that repeat a key give pieces of their own. Other columns are ignored; an empty table
    gives no rows.
    """
    return pack(token_pieces(docs, path, key, text, capacity), capacity=capacity)
