"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, a proof for every row.

Where a row stands among its group's keys is a rank query on a compressed bitmap of the keys, so that nothing is sorted:
words of 64 keys are merged by OR before the shuffle, chunks keep the words that aren't zero under a mask, and
directories of counts say how many rows lie before each word, chunk and range of chunks. Nodes then meet in the slots of
their run's array, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, small

#: Children of a node.
FAN = 16
#: Bits of a key inside its chunk and its word; bits by which the ranges of each directory narrow, and directories. Together they are the bits of a long.
CHUNK_BITS, WORD_BITS, RANGE_BITS, RANGES = 12, 6, 13, 4
#: The chunk of rows without a key, below all others.
NO_CHUNK = -(1 << 52)
#: Copies of a row that are made at once.
COPIES = 1 << 12
STEPS = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length before it; a null is told from every value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def shifted(name: str, value: Column | int, by: Column | int) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.call_function(name, lit(value).cast("long") if isinstance(value, int) else value, lit(by))


def below(bit: Column) -> Column:
    """All bits under ``bit``."""
    return F.bitwise_not(shifted("shiftleft", -1, bit))


def directories(words: DataFrame) -> DataFrame:
    """(g, chunk, mask, words, counts, extras, before, total): each chunk's bitmap, and the rows of the group before it and in all.

    ``words`` (g, chunk, w, word, n, extra): the words that aren't zero, with the rows that they stand for.
    """
    inside = W.Window.partitionBy("g", "chunk").orderBy("w")
    filled = words.withColumn("ahead", F.sum("n").over(inside) - F.col("n"))
    entries = F.sort_array(F.collect_list(F.struct("w", "word", "ahead", "extra")))
    chunks = filled.groupBy("g", "chunk").agg(entries.alias("e"), F.sum("n").alias("n"), F.bit_or(shifted("shiftleft", 1, F.col("w"))).alias("mask"))
    chunks = cut(chunks.select("g", "chunk", "n", "mask", F.col("e.word").alias("words"), F.col("e.ahead").alias("counts"), F.col("e.extra").alias("extras")))
    # ranges of chunks, of ranges and so on up to the group: RANGE_BITS are few enough for a window
    levels = [chunks.select("g", F.col("chunk").alias("k0"), "n")]
    for i in range(1, RANGES + 1):
        levels.append(cut(levels[-1].groupBy("g", shifted("shiftright", F.col(f"k{i - 1}"), RANGE_BITS).alias(f"k{i}")).agg(F.sum("n").alias("n"))))
    top = f"k{RANGES}"  # that of rows without a key, of negative keys and of others: three at most
    w = W.Window.partitionBy("g").orderBy(top)
    known = levels[-1].select("g", top, (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(W.Window.partitionBy("g")).alias("total"))
    for i in reversed(range(RANGES)):
        here, up = f"k{i}", f"k{i + 1}"
        w = W.Window.partitionBy("g", up).orderBy(here)
        inside = levels[i].withColumn(up, shifted("shiftright", F.col(here), RANGE_BITS))
        inside = inside.select("g", up, here, (F.sum("n").over(w) - F.col("n")).alias("ahead"))
        known = inside.join(known, ["g", up]).select("g", here, (F.col("before") + F.col("ahead")).alias("before"), "total")
    return cut(chunks.drop("n").join(known.withColumnRenamed("k0", "chunk"), ["g", "chunk"]))


def rank(key_bits: Column) -> Column:
    """Rows of a group before the key with these bits, from its chunk's directory."""
    w, bit = shifted("shiftright", key_bits, WORD_BITS), key_bits.bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    i = F.bit_count(F.col("mask").bitwiseAND(below(w))).cast("int")
    more = F.aggregate(F.filter(F.col("extras")[i], lambda x: x["bit"] < bit), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    return F.col("before") + F.col("counts")[i] + F.bit_count(F.col("words")[i].bitwiseAND(below(bit))) + more


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, key, leaf, other) with place, from 0 in each group by (key, leaf) with nulls first, and n, the group's rows."""
    bits = F.coalesce(F.col("key").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), F.lit(0).cast("long")).cast("int")
    rows = leaves.withColumns({"chunk": F.coalesce(shifted("shiftright", F.col("key"), CHUNK_BITS), F.lit(NO_CHUNK)), "bits": bits})
    w, bit = shifted("shiftright", F.col("bits"), WORD_BITS).alias("w"), F.col("bits").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    words = cut(rows.groupBy("g", "chunk", w).agg(F.bit_or(shifted("shiftleft", 1, bit)).alias("word"), F.count(F.lit(1)).alias("n")))
    crowded = cut(words.filter(F.col("n") > F.bit_count("word")).select("g", "chunk", "w"))
    none = F.array().cast("array<struct<bit:int,more:long>>")
    if not crowded.head(1):  # every key stands once in its group
        filled = directories(words.withColumn("extra", none))
        return rows.join(filled, ["g", "chunk"]).select("g", "key", "leaf", "other", rank(F.col("bits")).alias("place"), F.col("total").alias("n"))
    some = rows.withColumn("w", w).join(small(crowded), ["g", "chunk", "w"], "left_semi")
    many = cut(some.groupBy("g", "chunk", "w", bit.alias("bit")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    extra = many.groupBy("g", "chunk", "w").agg(F.collect_list(F.struct("bit", (F.col("c") - 1).alias("more"))).alias("extra"))
    filled = directories(words.join(extra, ["g", "chunk", "w"], "left").withColumn("extra", F.coalesce("extra", none)))
    repeated = small(cut(many.select("g", "chunk", (F.col("w") * 64 + F.col("bit")).cast("int").alias("bits"))))
    once = rows.join(repeated, ["g", "chunk", "bits"], "left_anti")
    # repeated keys: by leaf, ranges of which are counted; rows that are equal come back as often as they were
    alike = rows.join(repeated, ["g", "chunk", "bits"], "left_semi").groupBy("g", "chunk", "bits", "key", "leaf", "other").agg(F.count(F.lit(1)).alias("m"))
    alike = cut(alike.withColumn("range", F.substring("leaf", 1, 4)))
    key = ["g", "chunk", "bits"]
    ranges = alike.groupBy(*key, "range").agg(F.sum("m").alias("m"))
    ranges = ranges.select(*key, "range", (F.sum("m").over(W.Window.partitionBy(*key).orderBy("range")) - F.col("m")).alias("earlier"))
    inside = W.Window.partitionBy(*key, "range").orderBy("leaf")
    alike = alike.join(ranges, [*key, "range"]).withColumn("first", F.col("earlier") + F.sum("m").over(inside) - F.col("m"))
    alike = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES)))).repartition(*key, "leaf", "part")
    copies = F.sequence(F.col("part") * COPIES, F.least(F.col("m"), (F.col("part") + 1) * COPIES) - 1)
    alike = alike.withColumn("copy", F.explode(copies)).withColumn("copy", F.col("first") + F.col("copy"))
    both = once.withColumn("copy", F.lit(0).cast("long")).unionByName(alike.select(*once.columns, "copy"))
    return both.join(filled, ["g", "chunk"]).select("g", "key", "leaf", "other", (rank(F.col("bits")) + F.col("copy")).alias("place"), F.col("total").alias("n"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and (g, level, digest) of the roots. ``nodes``: (g, n, place, digest, what).

    A run (g, n, run, slots) has the nodes that become one, in order; ``what`` of the leaves stays in their slots.
    """
    levels, roots, n = [], [nodes.filter("n = 1").select("g", F.lit(0).alias("level"), "digest")], nodes.agg(F.max("n")).head()[0] or 0
    while n > 1:
        slot = F.struct((F.col("place") % FAN).alias("slot"), "digest", *[c for c in nodes.columns if c == "what"])
        runs = nodes.filter("n > 1").groupBy("g", "n", F.floor(F.col("place") / FAN).alias("run")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        levels.append(cut(runs))
        nodes = levels[-1].select("g", F.ceil(F.col("n") / FAN).alias("n"), F.col("run").alias("place"), digest(F.array_join("slots.digest", "")).alias("digest"))
        roots.append(nodes.filter("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest"))
        n = -(-n // FAN)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, cut(out)


def descended(levels: list[DataFrame], roots: DataFrame, carried: list[str]) -> DataFrame:
    """(g, leaf, what, steps, ``carried``) of every leaf that isn't a root itself: the siblings left and right, level by level.

    ``roots`` (g, level, steps, ``carried``): what is to follow after each tree's root.
    """
    above = None
    for level in reversed(range(len(levels))):
        ended = roots.filter(F.col("level") == level + 1).select("g", F.lit(0).cast("long").alias("run"), "steps", *carried)
        above = ended if above is None else above.withColumnRenamed("place", "run").unionByName(ended)
        met = levels[level].join(above, ["g", "run"]).select("*", F.posexplode("slots").alias("i", "node"))
        side = lambda a, b: F.array_join(F.slice(F.col("slots.digest"), a, b), "")
        step = F.array(F.struct(side(F.lit(1), F.col("i")).alias("l"), side(F.col("i") + 2, F.lit(FAN)).alias("r")))
        place = (F.col("run") * FAN + F.col("node.slot")).alias("place")
        last = [F.col("node.digest").alias("leaf"), F.col("node.what").alias("what")] if level == 0 else [place]
        above = met.select("g", *last, F.concat(step, "steps").alias("steps"), *carried)
        if level:
            above = cut(above)
    return above


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """(key, leaf, other, steps, subroot, root) for every row of ``leaves`` (g, key long, leaf, other).

    Of each group g the leaves ascend by (key, leaf), without a key first; FAN consecutive nodes become one until one is
    left, the subroot; the subroots in order of g (bytes of UTF-8) give the root likewise. ``steps`` are the digests left and right of the row's node at each
    level up to the root. Rows equal in all get places of their own. No rows, no root.
    """
    leaves = cut(leaves)
    nodes = placed(leaves).select("g", "n", "place", F.col("leaf").alias("digest"), F.struct("key", "other").alias("what"))
    nodes = cut(nodes)
    levels, subroots = climbed(nodes)
    # the tree over the groups: their order from the sizes of ranges of it
    ranged = cut(subroots.repartitionByRange("g").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.select("part", (F.sum("c").over(W.Window.orderBy("part")) - F.col("c")).alias("before"))  # as many rows as tasks
    place = F.col("before") + F.row_number().over(W.Window.partitionBy("part").orderBy("g")) - 1
    groups = subroots.count()
    tops = ranged.join(F.broadcast(sizes), "part").select(F.lit("").alias("g"), F.lit(groups).cast("long").alias("n"), place.alias("place"), "digest", F.struct("g", "level").alias("what"))
    top_levels, root = climbed(cut(tops))
    end = root.select("g", "level", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    if top_levels:
        ends = descended(top_levels, end, ["root"]).select("what.g", "what.level", "steps", F.col("leaf").alias("subroot"), "root")
    else:  # one group or none: its subroot is the root
        ends = subroots.select("g", "level", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ends = cut(ends)
    lone = nodes.filter("n = 1").select("g", "digest", "what").join(ends.filter("level = 0"), "g").select("what", F.col("digest").alias("leaf"), "steps", "subroot", "root")
    if levels:
        lone = lone.unionByName(descended(levels, ends, ["subroot", "root"]).drop("g"))
    return lone.select("what.key", "leaf", "what.other", "steps", "subroot", "root")


def proof(steps: Column) -> Column:
    """The digest of all siblings in order."""
    return digest(F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["l"], s["r"]))), ""))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda a, s: digest(F.concat(s["l"], a, s["r"])))


def group_key(group: Column) -> Column:
    """A group's name so that null is a group of its own, before all others, and bytes decide the order of the others."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def audited(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    The manifest is that of the rows as they are. Rows ``where`` have columns replaced by ``tampered`` before their leaf is
    folded with its siblings again: a row whose bytes have changed isn't verified. Null fields differ from empty ones, a null
    group is a group, null keys come first; rows that repeat are leaves of their own; other columns are ignored; an empty table gives no rows.
    """
    values = {f: F.col(f) for f in fields}
    leaves = docs.select(group_key(F.col(group)).alias("g"), F.col(key).cast("long").alias("key"), leaf(*values.values()).alias("leaf"), (F.lit(None).cast("string") if where is None else F.when(where, leaf(*(values | (tampered or {})).values()))).alias("other"))
    done = merkle_manifest(leaves).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("steps")))
    return done.select(F.col("key").alias(key), "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(docs: DataFrame) -> DataFrame:
    """``audited`` with A-Z of the texts lowered where 5 divides crc32 of the decimal doc_id."""
    return audited(docs, tampered={"text": F.translate("text", UPPER, LOWER)}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def oracle() -> str:
    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    up = """select lvl + 1, g, ((n + 15) // 16)::bigint, place // 16, sha256(string_agg(digest, '' order by place))
            from {0} where n > 1 group by lvl, g, n, place // 16"""
    sides = """select x.lvl, x.g, x.place, coalesce(string_agg(y.digest, '' order by y.place) filter (where y.place < x.place), '') as l,
              coalesce(string_agg(y.digest, '' order by y.place) filter (where y.place > x.place), '') as r
            from {0} x join {0} y on x.lvl = y.lvl and x.g = y.g and x.place // 16 = y.place // 16 and x.n > 1 group by x.lvl, x.g, x.place"""
    crc = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""
        with recursive leaves as (select doc_id, source, coalesce('=' || source, '-') as g, {leaf_of("text")} as leaf,
            case when doc_id is not null and xor({crc}, 4294967295) % 5 = 0 then {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} else {leaf_of("text")} end as other
          from documents),
        numbered as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as n from leaves),
        tree(lvl, g, n, place, digest) as (select 0, g, n, place, leaf from numbered union all {up.format("tree")}),
        subroots as (select lvl, g, digest, row_number() over (order by encode(g)) - 1 as place, count(*) over () as n from tree where n = 1),
        top(lvl, g, n, place, digest) as (select 0, '', n, place, digest from subroots union all {up.format("top")}),
        tree_sides as ({sides.format("tree")}), top_sides as ({sides.format("top")}),
        climb(i, lvl, here, acc, siblings) as (
          select g || ' ' || place, 0, place, other, '' from numbered
          union all select c.i, c.lvl + 1, c.here // 16, sha256(s.l || c.acc || s.r), c.siblings || s.l || s.r
          from climb c join tree_sides s on s.lvl = c.lvl and s.place = c.here and s.g = left(c.i, length(c.i) - strpos(reverse(c.i), ' '))),
        half as (select i, max_by(acc, lvl) as acc, max_by(siblings, lvl) as siblings from climb group by i),
        rest(i, lvl, here, acc, siblings) as (
          select h.i, 0, s.place, h.acc, h.siblings from half h join subroots s on s.g = left(h.i, length(h.i) - strpos(reverse(h.i), ' '))
          union all select c.i, c.lvl + 1, c.here // 16, sha256(s.l || c.acc || s.r), c.siblings || s.l || s.r
          from rest c join top_sides s on s.lvl = c.lvl and s.place = c.here),
        full_ as (select i, max_by(acc, lvl) as acc, max_by(siblings, lvl) as siblings from rest group by i)
        select n.doc_id, n.leaf, s.digest as subroot, t.digest as root, sha256(f.siblings) as proof_sha256, f.acc as folded_root, f.acc = t.digest as verified
        from numbered n join subroots s on s.g = n.g join full_ f on f.i = n.g || ' ' || n.place, (select digest from top where n = 1) t"""
