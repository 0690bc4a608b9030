"""Repeated byte strings of a corpus by distributed prefix doubling, after a filter that drops what must be unique.

Every T-byte string contains, within its first half, an anchor: the T/2-byte string of least hash among those it
wholly contains. Equal strings have equal anchors at the same place, so where an anchor's hash is unique in the corpus, so
are all strings that it stands for. Positions that share an anchor form a block. Hashes only ever drop positions;
that strings are equal is found in three ways, none of which trusts such a hash:

- Blocks whose bytes (all that their strings cover) have the same BLAKE2b digest of 128 bits are repeated as a whole. One of each
  set of equal blocks goes on where it shares its anchor with others.
- The blocks that go on are cut to runs of a few positions, at the same places before their anchors. All strings of a
  run share a core of nearly T bytes: a run whose core's hash is unique drops out. Runs of equal digests are repeated as a whole.
- What is left is ranked by prefix doubling. Eight pieces of each run's core are ranked by Spark's sort of their bytes; the pairs of
  ranks one, two and four pieces apart are sorted and ranked again, which names 1/8, 1/4, 1/2 and all of the core's bytes. Ranks
  that occur once drop out in each round. A position's string is the core's rank and the few bytes around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType

from . import fuse
from .common import TEXT_BYTES, columns_of, cut, each_salt, give_back, salt, salts_seen, slices, text_slices, with_rows

THRESHOLD = 200
#: Columns that the operator adds.
NEW = ("kept", "n_bytes", "n_removed", "n_spans")
#: Bytes that are hashed together, and the most of one text at a time.
PIECE, SEGMENT = 1 << 16, 1 << 20
#: Low bits that hold a place among the bytes hashed together.
PLACE_BITS = 22
#: Positions of a run, and pieces of its core that doubling starts from.
RUN, PIECES = 8, 8
_BASE = 6364136223846793005
_BACK = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _digests(data: bytes, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The 128-bit digests of stretches of ``data``, as pairs of longs."""
    made = b"".join(blake2b(data[i : i + n], digest_size=16).digest() for i, n in zip(at.tolist(), length.tolist(), strict=True))
    return np.frombuffer(made, np.int64).reshape(-1, 2)


@dataclass
class Blocks:
    """Blocks of some texts: the text's number, first position, positions, hash of the anchor."""

    text: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    _at: np.ndarray
    _anchor_at: np.ndarray
    _sums: np.ndarray
    _data: bytes

    def digests(self, chosen: np.ndarray, threshold: int) -> np.ndarray:
        return _digests(self._data, self._at[chosen], self.size[chosen] + (threshold - 1))

    def runs(self, threshold: int, chosen: np.ndarray) -> Runs:
        """The chosen blocks in runs of up to RUN positions, cut at the same places before their anchors."""
        at, size, anchor = self._at[chosen], self.size[chosen], self._anchor_at[chosen]
        high, low = (anchor - at) // RUN, (anchor - at - size + 1) // RUN
        n = high - low + 1
        owner, step = np.repeat(chosen, n), _steps(n)
        q = np.repeat(high, n) - step
        anchor, start = np.repeat(anchor, n), np.repeat(at, n)
        first = np.maximum(start, anchor - RUN * q - RUN + 1)
        last = np.minimum(start + np.repeat(size, n) - 1, anchor - RUN * q)
        core, width = anchor - RUN * q, threshold - RUN + 1
        name = _mix((self._sums[core + width] - self._sums[core]) * _powers(1)[1][core] + q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return Runs(self.text[owner], self.first[owner] + first - start, last - first + 1, name, core - first, first, self._data)


@dataclass
class Runs:
    """Runs of positions: as Blocks, with the hash of the core and how far behind the first position it begins."""

    text: np.ndarray
    first: np.ndarray
    size: np.ndarray
    core: np.ndarray
    lead: np.ndarray
    _at: np.ndarray
    _data: bytes

    def digests(self, threshold: int) -> np.ndarray:
        return _digests(self._data, self._at, self.size + (threshold - 1))

    def covered(self, chosen: np.ndarray, threshold: int) -> list[bytes]:
        return [self._data[i : i + n + threshold - 1] for i, n in zip(self._at[chosen].tolist(), self.size[chosen].tolist(), strict=True)]


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def blocks(texts: list[bytes], threshold: int) -> Iterator[Blocks]:
    """The blocks of some texts, a few at a time; texts under ``threshold`` bytes have none."""
    parts = [(i, a, t[a : a + SEGMENT + threshold - 1]) for i, t in enumerate(texts) for a in range(0, len(t) - threshold + 1, SEGMENT)]
    for lo, hi in slices([len(p[2]) for p in parts], PIECE):
        yield _blocks(parts[lo:hi], threshold)


def _blocks(parts: list[tuple[int, int, bytes]], threshold: int) -> Blocks:
    half = -(-threshold // 2)
    width = threshold - half + 1
    joined = b"".join(p[2] for p in parts)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    power, back = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    ranks = (sums[half:] - sums[:-half]) * back[: n - half + 1]
    # order by hash, then place: the low bits hold the place
    bits = np.uint64(PLACE_BITS)
    low = ((_mix(ranks) >> bits) << bits) | np.arange(len(ranks), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    # positions from which a whole string fits into its part
    valid = sizes - threshold + 1
    at = np.repeat(starts, valid) + _steps(valid)
    part = np.repeat(np.arange(len(parts)), valid)
    own = anchor[at]
    edge = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))
    size = np.diff(np.append(edge, len(at)))
    first, of = at[edge], part[edge]
    a = own[edge]
    text, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return Blocks(text[of], first - starts[of] + base[of], size, _mix(ranks[a]), first, a, sums, joined)


def unique_longs(docs: DataFrame, key: str) -> bool:
    """Whether the key is a long that is null nowhere and names one row each."""
    if docs.schema[key].dataType.typeName() != "long":
        return False
    return docs.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty()


def _probe(salt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A long for a place: as ``probe_of`` in Spark."""
    return salt ^ (first.astype(np.int64) << np.int64(32))


def probe_of(uid: str, first: str) -> Column:
    return F.xxhash64(uid).bitwiseXOR(F.call_function("shiftleft", F.col(first).cast("long"), F.lit(32)))


Chosen = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _batch(kinds: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in kinds], schema=kinds)


def at_places(rows: DataFrame, places: DataFrame, threshold: int, work: Callable[[Blocks, Chosen], dict], kinds: pa.Schema) -> DataFrame:
    """What ``work`` makes of the blocks of the texts that have ``places`` (uid, first).

    ``work`` gets blocks and a function that tells which (text's number, first position) are among the places, or may be: filters
    of a bounded size go to the texts, so that these don't move. Beyond that bound texts meet their own places in a join.
    """
    n = places.count()
    schema = from_arrow_schema(kinds)

    def made(uid: np.ndarray, b: Blocks, chosen: Chosen) -> pa.RecordBatch:
        out = work(b, chosen)
        return _batch(kinds, out | {"uid": uid[out["text"]]})

    if not fuse.fits(n):
        listed = places.groupBy("uid").agg(F.collect_list("first").alias("first"))

        def by_list(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(parts):
                uid, first = batch.column("uid").to_numpy(), batch.column("first")
                at = first.flatten().to_numpy()
                own = _probe(np.repeat(np.arange(len(uid)), first.value_lengths().to_numpy()), at)
                for b in blocks(_texts(batch), threshold):
                    yield made(uid, b, lambda text, first: np.isin(_probe(text, first), own))

        return rows.select("uid", "text").join(listed, "uid").mapInArrow(by_list, schema)

    places_filter = fuse.broadcast_filters(places.select(probe_of("uid", "first").alias("probe")), "probe", n)
    texts_filter = fuse.broadcast_filters(places.select(F.xxhash64("uid").alias("salt")).distinct(), "salt", n)

    def by_filter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(parts):
            batch = batch.filter(pa.array(texts_filter.value.contains(batch.column("salt").to_numpy())))
            uid, salt = batch.column("uid").to_numpy(), batch.column("salt").to_numpy()
            for b in blocks(_texts(batch), threshold):
                yield made(uid, b, lambda text, first: places_filter.value.contains(_probe(salt[text], first)))

    return rows.select("uid", F.xxhash64("uid").alias("salt"), "text").mapInArrow(by_filter, schema)


def shared_anchors(rows: DataFrame, threshold: int) -> DataFrame:
    """(uid, first, size, rank, d0, d1): the blocks whose anchor's hash occurs more than once, with their digests."""

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(parts):
            for b in blocks(_texts(batch), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(b.anchor.view(np.int64))], ["rank"])

    ranks = rows.select("text").mapInArrow(anchors, "rank long").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    ranks = cut(ranks.filter("n > 1").select("rank"))
    n = ranks.count()
    known = fuse.broadcast_filters(ranks, "rank", n) if fuse.fits(n) else None
    kinds = pa.schema({"uid": pa.int64(), "first": pa.int32(), "size": pa.int32(), "rank": pa.int64(), "d0": pa.int64(), "d1": pa.int64()})

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(parts):
            uid = batch.column("uid").to_numpy()
            for b in blocks(_texts(batch), threshold):
                x = np.flatnonzero(known.value.contains(b.anchor.view(np.int64))) if known else np.arange(len(b.first))
                d = b.digests(x, threshold)
                yield _batch(kinds, {"uid": uid[b.text[x]], "first": b.first[x], "size": b.size[x], "rank": b.anchor[x].view(np.int64), "d0": d[:, 0], "d1": d[:, 1]})

    made = rows.select("uid", "text").mapInArrow(found, from_arrow_schema(kinds))
    return cut(made if known else made.join(ranks, "rank", "left_semi"))


def classes_of(members: DataFrame, name: str) -> DataFrame:
    """(name, d0, d1, n, uid, first): the sets of equal members, how many they are, and one of them."""
    return members.groupBy(name, "d0", "d1").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"), F.min_by("first", "uid").alias("first"))


def in_mixed(classes: DataFrame, name: str) -> DataFrame:
    """(uid, first): one member of each set that shares its name with others, where one of them at least is alone.

    The sets of a name are dealt to salts, so that those of one name with very many meet it in as many tasks.
    """
    mixed = classes.groupBy(name).agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("n") == 1).alias("single"), salts_seen(salt("d0")).alias("seen"))
    mixed = mixed.filter("sets > 1 and single > 0").select(name, each_salt(F.col("seen")).alias("salt"))
    return classes.withColumn("salt", salt("d0")).join(mixed, [name, "salt"], "left_semi").select("uid", "first")


def repeated_spans(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(uid, first, size): runs of positions whose ``threshold`` bytes start elsewhere too.

    ``rows`` is (uid long, text string not null) with unique uids.
    """
    if threshold < 2 * RUN:
        raise ValueError(f"strings have {2 * RUN} bytes at least")
    found = shared_anchors(rows, threshold)
    classes = cut(classes_of(found, "rank"))
    alike = found.join(classes.filter("n > 1").select("rank", "d0", "d1"), ["rank", "d0", "d1"]).select("uid", "first", "size")

    def cut_to_runs(b: Blocks, chosen: Chosen) -> dict:
        r = b.runs(threshold, np.flatnonzero(chosen(b.text, b.first)))
        d = r.digests(threshold)
        return {"text": r.text, "first": r.first, "size": r.size, "core": r.core.view(np.int64), "d0": d[:, 0], "d1": d[:, 1]}

    wanted = cut(in_mixed(classes, "rank"))
    place = {"uid": pa.int64(), "first": pa.int32(), "size": pa.int32()}
    runs = cut(at_places(rows, wanted, threshold, cut_to_runs, pa.schema(place | {"core": pa.int64(), "d0": pa.int64(), "d1": pa.int64()})))
    sets = cut(classes_of(runs, "core"))
    known = runs.join(sets.filter("n > 1").select("core", "d0", "d1"), ["core", "d0", "d1"]).select("uid", "first", "size")

    def opened(b: Blocks, chosen: Chosen) -> dict:
        r = b.runs(threshold, np.arange(len(b.first)))
        x = np.flatnonzero(chosen(r.text, r.first))
        return {"text": r.text[x], "first": r.first[x], "size": r.size[x], "lead": r.lead[x], "bytes": r.covered(x, threshold)}

    open_ = cut(in_mixed(sets, "core"))
    left = cut(at_places(rows, open_, threshold, opened, pa.schema(place | {"lead": pa.int32(), "bytes": pa.binary()})))
    single = doubled(left, threshold).select("uid", "first", F.lit(1).alias("size"))
    return alike.unionByName(known).unionByName(single)


def ranked(rows: DataFrame, *values: str) -> DataFrame:
    """``rows`` with the place of their values in Spark's sort, as ``rank``; rows whose values occur once go."""
    several = rows.groupBy(*values).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*values)
    order = cut(several.orderBy(*values).withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(order, list(values)).drop(*values)


def doubled(runs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(uid, first): the positions of ``runs`` whose ``threshold`` bytes are those of another position of them.

    ``runs`` is (uid, first, size, lead, bytes): bytes are all that the run's strings cover, ``lead`` is where the core begins in them.
    """
    width = threshold - RUN + 1
    piece = -(-width // PIECES)
    starts = [j * (width - piece) // (PIECES - 1) for j in range(PIECES)]
    part = lambda at, n: F.call_function("substring", "bytes", at + 1, F.lit(n) if isinstance(n, int) else n)
    pieces = runs.select("uid", "first", F.posexplode(F.array(*[part(F.col("lead") + o, piece) for o in starts])).alias("at", "piece"))
    level, step = ranked(pieces, "piece"), 1
    while step < PIECES:  # a rank names twice as many bytes after each round
        place = F.col("at") % (2 * step)
        pairs = level.groupBy("uid", "first", (F.col("at") - place).alias("at")).agg(F.max(F.when(place == 0, F.col("rank"))).alias("here"), F.max(F.when(place == step, F.col("rank"))).alias("ahead"))
        level, step = ranked(cut(pairs.filter("here is not null and ahead is not null")), "here", "ahead"), 2 * step
    cores = level.select("uid", "first", "rank")
    places = runs.join(cores, ["uid", "first"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    before = F.col("lead") - F.col("t")
    around = F.concat(part(F.col("t"), before), part(F.col("lead") + width, F.lit(RUN - 1) - before))
    places = places.select("uid", (F.col("first") + F.col("t")).alias("first"), F.col("rank").alias("core"), before.alias("before"), around.alias("around"))
    return ranked(cut(places), "core", "before", "around").select("uid", "first")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, as_text: bool = False) -> DataFrame:
    """``docs`` with kept binary (string if ``as_text``), n_bytes, n_removed and n_spans (long) as further columns.

    ``kept`` is what is left of the text's UTF-8 bytes when every byte is removed that some ``threshold``-byte
    string covers which also starts anywhere else, in the same text or another. Matches never go
    over the end of a text; overlaps count. As a text ``kept`` lacks characters that a cut halves. n_spans counts the maximal removed runs. A null text
    counts as empty. Equal rows count as different places. Columns of ``docs`` with the names of new ones are replaced. A key that isn't a long, is null
    or repeated doesn't name rows: these are stored then and named by file and place.
    """
    if unique_longs(docs, key):
        named = docs.select(F.col(key).alias("_uid"), F.struct(*columns_of(docs, *NEW)).alias("_row"))
    else:
        stored = cut(docs.select(F.struct(*columns_of(docs, *NEW)).alias("doc")))
        named = with_rows(stored).select(F.col("row").alias("_uid"), F.col("doc").alias("_row"))
    rows = named.select(F.col("_uid").alias("uid"), F.coalesce(F.col("_row")[text], F.lit("")).alias("text"))
    spans = repeated_spans(rows, threshold).groupBy("uid").agg(F.collect_list("first").alias("_first"), F.collect_list("size").alias("_size"))
    returns = f"kept {'string' if as_text else 'binary'}, n_removed long, n_spans long"
    kind = to_arrow_type(DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def without(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, size in parts:
            out = []
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), TEXT_BYTES):
                own = zip(*(x.slice(a, b - a).to_pylist() for x in (texts, first, size)), strict=True)
                out.append(pa.array([cut_out(*x, threshold, as_text) for x in own], kind))
            yield pa.concat_arrays(out) if out else pa.array([], kind)
            give_back()

    joined = named.join(spans.withColumnRenamed("uid", "_uid"), "_uid", "left")
    joined = joined.withColumn("_r", without(F.when(F.col("_first").isNotNull(), F.col("_row")[text]), F.col("_first"), F.col("_size")))
    left = F.coalesce(F.col("_row")[text], F.lit(""))
    return joined.select(
        "_row.*",
        F.coalesce("_r.kept", left if as_text else left.cast("binary")).alias("kept"),
        F.octet_length(left).cast("long").alias("n_bytes"),
        F.coalesce("_r.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_r.n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def cut_out(text: str | None, first, size, threshold: int, as_text: bool) -> tuple[bytes | str | None, int, int]:
    """(what is left, bytes removed, runs removed) of one text; nothing to do for None."""
    if text is None:
        return None, 0, 0
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first = np.asarray(first, np.int64)
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + np.asarray(size, np.int64) - 1 + threshold, -1)
    removed = np.cumsum(depth)[:-1] > 0
    runs = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
    kept = data[~removed].tobytes()
    return kept.decode("utf-8", "ignore") if as_text else kept, int(removed.sum()), runs
