"""Hard negatives of embeddings by angular triangle filtering.

Every vector's angles to a few reference directions are stored. Two vectors' angle lies between the difference and the
sum of their angles to any reference, so that stored angles and norms bound an inner product from both sides without
looking at the components. Rows whose bounds miss what is searched are left; the rest are scored in whole numbers.
Anchors in blocks meet rows in tiles; a task streams the tiles past one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, small

#: Reference directions, and the rows that they are chosen from; results don't depend on either.
REFERENCES, REFERENCE_ROWS = 16, 2048
#: Rows of a tile, anchors of a block, tiles of a slice (all that one task reads for one block) at most.
TILE, BLOCK, SLICE = 1000, 4096, 4096
#: Rows that are worth a slice of their own.
LEAST_SLICE = 8000
#: Tiles that a task holds at once, outside Spark's heap.
TILES_AT_ONCE = 16
#: Anchors whose bounds are held at once.
AT_ONCE = 128
#: Rounding of angles (radians) and of products of norms, generously.
ANGLE_SLACK, PRODUCT_SLACK = 1e-6, 1e-9
#: Components are below this after scaling, so that floor() of a double is exact.
LARGEST = 1 << 53

TILES = "label long, tile long, n int, ids binary, labels binary, width int, q binary, angles binary, norms binary"
#: The columns of a tile that a task needs.
PACKED = ["n", "ids", "labels", "q", "angles", "norms"]
FOUND = "anchor_id long, positive int, other_id long, score long"


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, q): the rows that take part, their components as floor(scale * x).

    Rows with a null key, label or vector, or a component that is null or not finite, take no part. Of rows with one key
    that with the least (label, vector) counts.
    """
    x = lambda c: c.cast("double")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    whole = lambda c: F.when(F.abs(x(c)) < LARGEST / scale, F.floor(x(c) * scale)).otherwise(F.raise_error(F.lit("a component is too large to be scored in whole numbers")).cast("long"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    return rows.select("id", F.struct("label", F.transform("v", whole).alias("q")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q")


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(rows), width), "<i8")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def norms_of(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def angles_to(q: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The angle of each row to each reference (unit vectors); that of a zero vector doesn't matter, its products are zero."""
    norm = norms_of(q)
    wide = max(q.shape[1], references.shape[1])
    a, b = np.zeros((len(q), wide)), np.zeros((len(references), wide))
    a[:, : q.shape[1]], b[:, : references.shape[1]] = q, references
    return np.arccos(np.clip((a @ b.T) / np.where(norm == 0, 1, norm)[:, None], -1, 1))


def references_of(rows: DataFrame) -> np.ndarray:
    """Directions of rows that are far from each other, each next one the farthest; from REFERENCE_ROWS rows by a hash."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(REFERENCE_ROWS).select("q").collect()
    q = [r["q"] for r in drawn if any(r["q"])]
    if not q:
        return np.zeros((1, 1))
    x = matrix(q, max(map(len, q))).astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    chosen = [x[0]]
    nearest = np.abs(x @ x[0])
    while len(chosen) < min(REFERENCES, len(x)):
        far = int(nearest.argmin())
        chosen.append(x[far])
        nearest = np.maximum(nearest, np.abs(x @ x[far]))
    return np.array(chosen)


def tiles_of(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows in tiles of one label and of like directions: ids, components, norms and angles as packed arrays."""
    shared = rows.sparkSession.sparkContext.broadcast(references)

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            q = batch.column("q").to_pylist()
            angles = angles_to(matrix(q, max([1, *map(len, q)])), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "q")), pa.array(angles.argmin(1), pa.int32()), pa.array(angles.min(1))], names=["id", "label", "q", "nearest", "angle"])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("label", pa.int64()), ("tile", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("q", pa.binary()), ("angles", pa.binary()), ("norms", pa.binary())])
        for batch in parts:
            labels, ids, vectors = batch.column("label").to_numpy(), batch.column("id").to_numpy(), batch.column("q").to_pylist()
            edges = np.flatnonzero(np.diff(labels)) + 1
            for a, b in zip([0, *edges], [*edges, len(labels)], strict=True):
                for i in range(a, b, TILE):
                    at = np.arange(i, min(b, i + TILE))
                    if len(at):
                        v = [vectors[k] for k in at]
                        q = matrix(v, max([1, *map(len, v)]))
                        data = [ids[at].astype("<i8").tobytes(), labels[at].astype("<i8").tobytes(), q.shape[1], q.tobytes(), angles_to(q, shared.value).tobytes(), norms_of(q).tobytes()]
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, [int(labels[i]), int(ids[i]), len(at), *data], strict=True))], kinds)

    ordered = rows.mapInArrow(near, "id long, label long, q array<long>, nearest int, angle double")
    ordered = ordered.repartitionByRange("label", "nearest", "angle", "id").sortWithinPartitions("label", "nearest", "angle", "id")
    return cut(ordered.select("id", "label", "q").mapInArrow(packed, TILES))


class Held:
    """One block of anchors in a task, and the best rows that have been found for each of its windows."""

    def __init__(self, block: dict, same_label: bool, most: int, references: int):
        self.ids = np.array(block["id"])
        self.labels = np.array(block["label"])
        self.q = matrix(block["q"], max([1, *map(len, block["q"])]))
        self.norms = norms_of(self.q)
        self.angles = np.array(block["angles"], float).reshape(len(self.ids), references)
        windows = max(map(len, block["least"]))
        self.least, self.greatest = np.full((len(self.ids), windows), 1 << 62), np.full((len(self.ids), windows), -1 << 62)  # those that an anchor lacks are empty
        for i, (least, greatest) in enumerate(zip(block["least"], block["greatest"], strict=True)):
            self.least[i, : len(least)], self.greatest[i, : len(least)] = least, greatest
        self.same, self.most = same_label, most
        self.best = np.zeros((3, 0), np.int64)  # window (of all anchors), -score, id
        self.floor = self.least.copy()  # what a window still takes

    def meet(self, tile: dict) -> None:
        n = tile["n"]
        ids, labels = np.frombuffer(tile["ids"], "<i8"), np.frombuffer(tile["labels"], "<i8")
        norms, angles = np.frombuffer(tile["norms"]), np.frombuffer(tile["angles"]).reshape(n, -1)
        low, high = angles.min(0), angles.max(0)
        apart = np.maximum(0, np.maximum(low - self.angles, self.angles - high)).max(1)  # of each anchor from any row here
        most = self.above(self.norms * norms.max() * np.cos(np.clip(apart - ANGLE_SLACK, 0, np.pi)), self.norms * norms.max())
        most = np.where(apart > np.pi / 2, np.maximum(most, 0), most)  # a shorter row of the tile could have more then
        open_ = (most[:, None] >= self.floor).any(1)
        if self.same:
            open_ &= np.isin(self.labels, labels)
        q = np.frombuffer(tile["q"], "<i8").reshape(n, -1)
        found = np.flatnonzero(open_)
        for i in range(0, len(found), AT_ONCE):
            self.score(found[i : i + AT_ONCE], ids, labels, q, norms, angles)

    @staticmethod
    def above(bound: np.ndarray, product: np.ndarray) -> np.ndarray:
        return np.ceil(bound + PRODUCT_SLACK * product + PRODUCT_SLACK)

    def score(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> None:
        mine = self.angles[at]
        apart, within = np.zeros((len(at), len(ids))), np.full((len(at), len(ids)), np.pi)
        for r in range(angles.shape[1]):
            a, x = mine[:, r, None], angles[None, :, r]
            np.maximum(apart, np.abs(a - x), out=apart)
            both = a + x
            np.minimum(within, np.minimum(both, 2 * np.pi - both), out=within)
        product = self.norms[at][:, None] * norms[None]
        most = self.above(product * np.cos(np.maximum(apart - ANGLE_SLACK, 0)), product)
        least = -self.above(-product * np.cos(np.minimum(within + ANGLE_SLACK, np.pi)), product)
        wanted = np.zeros(product.shape, bool)
        for w in range(self.floor.shape[1]):
            wanted |= (most >= self.floor[at, w, None]) & (least <= self.greatest[at, w, None])
        wanted &= (self.labels[at][:, None] == labels[None]) == self.same
        if self.same:
            wanted &= self.ids[at][:, None] != ids[None]
        rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(rows):
            return
        scores = products(self.q[at[rows]], q[columns])
        wanted = wanted[np.ix_(rows, columns)]
        new = []
        for w in range(self.floor.shape[1]):
            i, j = np.nonzero(wanted & (scores >= self.floor[at[rows], w, None]) & (scores <= self.greatest[at[rows], w, None]))
            new.append(np.array([at[rows[i]] * self.floor.shape[1] + w, -scores[i, j], ids[columns[j]]]))
        new = np.concatenate(new, axis=1)
        if new.shape[1]:
            self.keep(new)

    def keep(self, new: np.ndarray) -> None:
        """The first ``most`` of each window, old and new ones together; a full window takes from now on what is as good as its last."""
        touched = np.isin(self.best[0], new[0])
        both = np.concatenate([self.best[:, touched], new], axis=1)
        both = both[:, np.lexsort((both[2], both[1], both[0]))]
        first = np.searchsorted(both[0], both[0])
        place = np.arange(both.shape[1]) - first
        last = both[:, place == self.most - 1]
        self.floor.reshape(-1)[last[0]] = -last[1]
        self.best = np.concatenate([self.best[:, ~touched], both[:, place < self.most]], axis=1)

    def rows(self) -> pa.RecordBatch:
        anchor, window = np.divmod(self.best[0], self.floor.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[anchor]), pa.array(window.astype(np.int32)), pa.array(self.best[2]), pa.array(-self.best[1])], names=["anchor_id", "positive", "other_id", "score"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: in doubles where these are exact, else in longs, else in Python's integers."""
    wide = min(a.shape[1], b.shape[1])  # the rest is zero in one of them
    a, b = a[:, :wide], b[:, :wide]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, wide)
    if bound < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 2**62:
        raise ValueError("a score does not fit a long")
    return exact.astype(np.int64)


def searched(anchors: DataFrame, tiles: DataFrame, same_label: bool, most: int, references: int) -> DataFrame:
    """(anchor_id, positive, other_id, score): the ``most`` best rows of each anchor and window in each (block, slice).

    The ``anchors`` (block, slice, anchor) of a (block, slice) come before its ``tiles``, so that a task holds the anchors of
    one block and few tiles at a time.
    """
    group = ["block", "slice"]
    both = anchors.withColumn("_tile", F.lit(False)).unionByName(tiles.withColumn("_tile", F.lit(True)), allowMissingColumns=True)
    names = ["block", "slice", "_tile", "anchor", *PACKED]

    def streamed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, waiting = None, None, []
        for batch in parts:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in names}
                if key != (row["block"], row["slice"]):
                    if held is not None:
                        yield held.rows()
                    held, key, waiting = None, (row["block"], row["slice"]), []
                if not row["_tile"]:
                    waiting.append(row["anchor"])
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = Held({c: [a[c] for a in waiting] for c in waiting[0]}, same_label, most, references), []
                    held.meet(row)
        if held is not None:
            yield held.rows()

    dealt = both.select(*names).repartition(*group).sortWithinPartitions(*group, "_tile")
    return dealt.mapInArrow(streamed, FOUND)


def slices_for(blocks: int | Column, tiles: int | Column, rows: int | Column, parallel: int) -> Column:
    """Slices of the tiles for each block: so that there are tasks enough, that none reads more than SLICE tiles, and few rows make one slice.

    What slices find is merged, and each may find as many rows as are wanted in the end.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    wanted = F.least(F.ceil(lit(rows) / LEAST_SLICE), F.ceil(F.lit(2.0 * parallel) / lit(blocks)))
    return F.greatest(F.lit(1), F.ceil(lit(tiles) / SLICE), wanted).cast("int")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The best of what the slices found, with rank from 1; ties by the smaller id."""
    order = W.Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are the rows whose key is divisible by ``every``. A score is the inner product of whole components
    floor(scale * x); vectors that are shorter than others end in zeros. An anchor's positives are the ``positives`` best
    other rows of its label, its negatives for each the ``negatives`` best rows of other labels with a score from ``low`` to
    ``high`` hundredths of the positive's. Ties go to the smaller key. An anchor without positives, or without rows in a
    window, gives no rows there; a positive below zero has an empty window. What takes no part, and which of rows with one
    key counts, is in ``scaled``; a score that doesn't fit a long, or a component of 2**53 and more, is refused. Other columns
    are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, key, vector, label, scale))
    references = references_of(rows)
    shared = spark.sparkContext.broadcast(references)
    tiles = tiles_of(rows, references)

    @F.arrow_udf("array<double>")
    def angles(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for q in parts:
            v = q.to_pylist()
            yield pa.array(angles_to(matrix(v, max([1, *map(len, v)])), shared.value).tolist(), pa.list_(pa.float64()))

    anchors = cut(rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("angles", angles("q")))
    parallel, n_anchors = int(spark.conf.get("spark.sql.shuffle.partitions")), anchors.count()
    of_label = cut(tiles.groupBy("label").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("rows")))
    n_tiles, n_rows = (x or 0 for x in of_label.agg(F.sum("tiles"), F.sum("rows")).head())

    def dealt(anchors: DataFrame, sized: DataFrame | None, windows: tuple[Column, Column], same: bool, most: int) -> DataFrame:
        """``sized``: (label, blocks, slices) if anchors meet the tiles of their label alone; else all meet all, in blocks."""
        if sized is None:
            blocks = max(1, -(-n_anchors // BLOCK))
            group, sizes = [], {"blocks": F.lit(blocks), "slices": slices_for(blocks, n_tiles, n_rows, parallel)}
            own, theirs = anchors.withColumns(sizes), tiles.withColumns(sizes)
        else:
            group, own, theirs = ["label"], anchors.join(sized, "label"), tiles.join(sized, "label")
        row = F.struct("id", "label", "q", "angles", windows[0].alias("least"), windows[1].alias("greatest"))
        own = own.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        theirs = theirs.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("slice", F.pmod(F.xxhash64("tile"), F.col("slices")).cast("int"))
        own, theirs = (x.withColumn("block", F.xxhash64(F.lit(0), *group, "b")) for x in (own, theirs))
        return cut(searched(own.select("block", "slice", row.alias("anchor")), theirs.select("block", "slice", *PACKED), same, most, len(references)), TILES_AT_ONCE)

    limit = (1 << 62) - 1
    everything = (F.array(F.lit(-limit).cast("long")), F.array(F.lit(limit).cast("long")))
    blocks = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.join(small(of_label), "label").select("label", "blocks", slices_for(F.col("blocks"), F.col("tiles"), F.col("rows"), parallel).alias("slices"))
    blocks = small(cut(blocks))
    liked = cut(first_of(dealt(anchors, blocks, everything, True, positives), positives))
    listed = liked.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").cast("decimal(38,0)").alias("p")))).alias("ps"))
    with_windows = cut(anchors.join(listed, "id").withColumns({
        "least": F.transform("ps", lambda p: F.ceil(p["p"] * low / 100).cast("long")),
        "greatest": F.transform("ps", lambda p: F.floor(p["p"] * high / 100).cast("long")),
    }).drop("ps"))
    found = first_of(dealt(with_windows, None, (F.col("least"), F.col("greatest")), False, negatives), negatives)
    named = liked.select("anchor_id", (F.col("rank") - 1).cast("int").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    done = found.join(named, ["anchor_id", "positive"])
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    return """
        with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
          from embeddings where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select a.id as anchor_id, x.id as other_id, a.label = x.label as same,
            list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * x.q[i]))::bigint as score
          from v a, v x where a.id % 100 = 0 and a.id <> x.id),
        liked as (select * from pairs where same
          qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
        select p.anchor_id, p.other_id as positive_id,
          row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::integer as rank,
          n.other_id as negative_id, p.score as positive_score, n.score as negative_score
        from liked p join pairs n on n.anchor_id = p.anchor_id and not n.same
          and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
        qualify row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) <= 10"""
