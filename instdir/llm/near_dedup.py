"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles is sampled by MinHash. Bands of samples give the buckets in which candidates
meet; the samples are also folded into a parity bitmap (an odd sketch), and the population count of the XOR of two
bitmaps tells whether a candidate can reach the similarity. What passes is confirmed on the full sets.

No bucket's pairs are ever laid out as rows. Equal sets are one class. Round one links each member of a bucket with the
bucket's center alone, the class that meets most others over all its buckets. Round two takes the buckets that still hold
several components. Of each class in them it counts the shingles that no other of these classes has: they are in no
intersection, so most classes turn out too far from anything. In a wide bucket the others meet by rare shingles: two classes
that are similar enough share one of the rarest of their sets (all but so many that the rest can't suffice), so texts of one
template, which share its common shingles alone, never meet. Those outside a bucket's largest component are held
against the rest of it, with that bound, the lengths, the sketch and the parity bitmaps of the full sets (they
count the symmetric difference) as join condition. These pairs are tried, not kept, and those of a large bucket are dealt
out over cells of a fixed size. So every two classes that share a bucket end in one component, or have been compared, or
can't be similar enough. Every join on a bucket or a class deals a frequent key out over parts.

Two unrelated 64-bit hashes stand for a shingle: a class is named by sums over both, and a link needs the similarity under
either, so no single collision joins two texts.

Defined cases: null or wordless text has an empty set and is linked with nothing; a text of fewer than k words is one
shingle; a very long text is read in whole, its set is as large as it is; rows that share a doc_id are one document,
linked with all that any of its texts is linked with; a row without doc_id is never linked, its component_id is null and
kept is true; an empty table gives an empty result; other columns are not looked at. With ``by_row`` each different
(doc_id, text) is a document of its own, those without doc_id too.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DEALT_KEYS, KEY, Dealt, Scratch, join_spread, key_columns, keyed, lookup, map_arrow, quoted
from .text import LOWER, NONSPACE, SECOND, U64, bounds, hash_spans, list_array, mix, pieces, seeds, shingles, words

#: Bits of an odd sketch, kept as 64-bit columns, and the MinHash samples folded into it.
BITS, SAMPLES = 1024, 256
#: Bits of the parity bitmap over a full set, made for the few classes that round two compares.
SET_BITS = 2048
#: Rows of either side of a bucket that round two compares in one group.
CELL = 1000
#: Rows of a bucket outside its largest component beyond which round two lets rows meet by rare shingles, if that tries fewer pairs.
WIDE = 200
#: Graphs of so many edges (16 bytes each) need no dealing out of their hubs: one task could hold them all.
FEW_EDGES = 100_000
_LANES, _SET_LANES = BITS // 64, SET_BITS // 64
_MUL, _ADD = (seeds(1024, s).astype(np.uint32) for s in (41, 43))


def shingle_sets(col: pa.Array, k: int):
    """The distinct shingles of each text, in order, as two arrays: one hash of each, sorted, and the other hash of each."""
    for i, j, buf, off in pieces(col):
        start, end, row, h = words(buf, off, NONSPACE)
        other = hash_spans(LOWER[buf], start, end, seed=SECOND)
        at, every, others = bounds(row, j - i), shingles(h, k), shingles(other, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                items, first = np.unique(every[a : b - k + 1], return_index=True)
                yield items, others[a : b - k + 1][first]
            elif b > a:
                yield shingles(h[a:b], b - a), shingles(other[a:b], b - a)
            else:
                yield np.zeros(0, U64), np.zeros(0, U64)


def set_name(items: np.ndarray, others: np.ndarray) -> tuple:
    """The 128-bit name of a set, from both hashes of its shingles."""
    return mix(items).sum(dtype=U64), mix(others).sum(dtype=U64)


def _minhash(items: np.ndarray, n: int) -> np.ndarray:
    """n samples: the least value of n hash functions over the items."""
    low, best = (items >> U64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, (low[None, i : i + 2048] * (_MUL[:n, None] | np.uint32(1)) + _ADD[:n, None]).min(axis=1), out=best)
    return best


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((hashes % U64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap: each (function, sample) flips one bit."""
    return _parity(mix(samples.astype(U64) + (np.arange(len(samples), dtype=U64) << U64(32))), BITS)


def max_odd_bits(similarity: float, sigmas: float = 5.0) -> int:
    """The most differing bits that a pair of this similarity shows, but for chances beyond ``sigmas``.

    Of the samples, about SAMPLES * (1 - similarity) differ, binomially; d differing ones flip 2 d bits of both sketches.
    """
    differ = SAMPLES * (1 - similarity)
    stay, pair = (1 - 2 / BITS) ** (2 * differ), (1 - 4 / BITS) ** (2 * differ)
    variance = (2 * stay) ** 2 * differ * similarity + (BITS + BITS * (BITS - 1) * pair - (BITS * stay) ** 2) / 4
    return min(BITS, math.ceil(BITS / 2 * (1 - stay) + sigmas * math.sqrt(variance)))


def _may_differ(percent: int, sigmas: float | None) -> Column:
    """Whether the parity bitmaps of two full sets x and y differ in no more bits than those of similar enough sets."""
    if sigmas is None:
        return F.lit(True)
    d = F.floor((100 - percent) * (F.col("x.n_shingles") + F.col("y.n_shingles")) / F.lit(100.0 + percent))
    stay, pair, n = F.pow(F.lit(1 - 2 / SET_BITS), d), F.pow(F.lit(1 - 4 / SET_BITS), d), float(SET_BITS)
    spread = F.sqrt(F.greatest(n + n * (n - 1) * pair - n * n * stay * stay, F.lit(0.0))) / 2
    return _differing("x.", "y.", "p", _SET_LANES) <= n / 2 * (1 - stay) + sigmas * spread + 1


def features(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_h (with it the row's key), n_shingles, the 128-bit name of the set, a hash per band, and the sketch."""
    n, band_seed = max(SAMPLES, bands * rows), seeds(bands, 47)

    def fn(batch):
        size, name, band, sketch = [], [], [], []
        for items, others in shingle_sets(batch.column("text"), k):
            size.append(len(items))
            name.append(set_name(items, others))
            if len(items):
                samples = _minhash(items, n)
                band.append(mix(shingles_by_row(samples[: bands * rows].reshape(bands, rows)) ^ band_seed))
                sketch.append(odd_sketch(samples[:SAMPLES]))
        size = np.array(size, np.int64)
        name = np.array(name, U64).reshape(-1, 2).view(np.int64)
        has = size > 0

        def lists(values, width):
            return list_array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(has * width)]), pa.int64())

        yield pa.Table.from_arrays([batch.column("doc_id"), batch.column("text_h"), pa.array(size), pa.array(name[:, 0]), pa.array(name[:, 1]), lists(band, bands), lists(sketch, _LANES)], ["doc_id", "text_h", "n_shingles", "c1", "c2", "bands", "odd"])

    text = F.col("text").cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_h")), fn, "doc_id long, text_h long, n_shingles long, c1 long, c2 long, bands array<long>, odd array<long>")


def shingles_by_row(samples: np.ndarray) -> np.ndarray:
    out = np.zeros(len(samples), U64)
    for j in range(samples.shape[1]):
        out = mix(out + samples[:, j].astype(U64) + U64(j + 1))
    return out


def _differing(x: str, y: str, of: str = "o", lanes: int = _LANES):
    bits = [F.bit_count(F.col(f"{x}{of}{i}").bitwiseXOR(F.col(f"{y}{of}{i}"))) for i in range(lanes)]
    return reduce(lambda m, n: m + n, bits)


def _can_reach(x: str, y: str, percent: int, sigmas: float | None) -> Column:
    """Length bound and sketch estimate: no pair of this similarity fails the one, and but for chances beyond ``sigmas`` the other."""
    nx, ny = F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")
    long_enough = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return long_enough if sigmas is None else long_enough & (_differing(x, y) <= max_odd_bits(percent / 100, sigmas))


def _named(sketches: DataFrame, prefix: str, node: str) -> DataFrame:
    return sketches.select(F.col("cid").alias(node), *[F.col(c).alias(f"{prefix}_{c}") for c in sketches.columns if c != "cid"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the least node reachable) for each node of edges (a, b): large-star and small-star until nothing moves."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, seen, step = scratch.save(e, f"{name}-0"), None, 0
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, step = now, step + 1
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.filter("v > u")
        star = up.join(least, "u") if now[0] <= FEW_EDGES else join_spread(up, least, "u", scratch, f"{name}-hubs", ["v"])
        large = star.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.save(e, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-hubs")


def dealt_by_bucket(rest: DataFrame, outside: Column, scratch: Scratch, name: str, side: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The rows of a bucket h that are outside and all its rows, each with the cells (__x, __y) in which they meet.

    Each such pair of a bucket shares exactly one cell, and a cell has about ``side`` rows of either kind, however many
    the bucket has; more only in tables of over ``side`` * DEALT_KEYS rows, which bounds the broadcast.
    """
    side = max(side, -(-rest.count() // DEALT_KEYS))
    cells = rest.groupBy("h").agg(F.ceil(F.count_if(outside) / side).cast("int").alias("__xs"), F.ceil(F.count("*") / side).cast("int").alias("__ys"))
    cells = F.broadcast(scratch.save(cells.filter("__ys > 1"), name))
    dealt = rest.join(cells, "h", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("__xs", "__ys")})

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("cid", "o0"), F.col(f"{own}s")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("__xs", "__ys")

    return placed(dealt.filter(outside), "__x", "__y"), placed(dealt, "__y", "__x")


def _rarest(sets: DataFrame, cids: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """cid and item: of each of these classes' sets the rarest shingles, of which it shares one with every set that is similar enough.

    Of n shingles these are n - ceil(n * percent / 100) + 1, in one order for all sets (rarest first, by the counts over these
    sets). Those that no other set has come first and aren't given.
    """
    items = sets.join(cids, "cid", "left_semi").select("cid", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = scratch.save(items.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"), "item-counts")
    known = Dealt(counts, ["item"], scratch, "item-heavy").join(items, counts, ["cid"])
    listed = known.groupBy("cid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("shared"))
    room = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("shared"))
    return listed.select("cid", F.explode(F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("x")).select("cid", "x.item")


def met_by_rare_shingles(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, wide: int = WIDE) -> DataFrame:
    """rest(h, cid, comp, largest, ...) with each bucket of over ``wide`` rows outside its largest component in parts, one for each
    rare shingle that classes of several components share, where these try fewer pairs than the bucket. h and largest are then a
    part's.
    """
    outside = F.col("comp") != F.col("largest")
    tried = F.count_if(outside) * F.count("*")
    crowd = scratch.save(rest.groupBy("h").agg(F.count("*").alias("n"), tried.alias("tried"), F.count_if(outside).alias("out")).filter(F.col("out") > wide), "crowd")
    if crowd.isEmpty():
        return rest
    rows = Dealt(crowd.select("h", "n"), ["h"], scratch, "crowd-heavy")
    inside = scratch.save(rows.join(rest, crowd.select("h", "tried"), ["cid"]), "crowd-rows")
    comp_of = scratch.save(inside.select("cid", "comp").distinct(), "crowd-comps")
    rare = scratch.save(_rarest(sets, comp_of.select("cid"), percent, scratch).join(comp_of, "cid"), "rare")
    several = scratch.save(rare.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi"), "several-comps")
    rare = Dealt(several.select("item", "n"), ["item"], scratch, "several-heavy").join(rare, several.select("item"), ["cid"], "left_semi")
    rare = scratch.save(rare.select("cid", "item"), "rarest")
    parts = join_spread(inside.drop("largest"), rare, "cid", scratch, "rarest-heavy", ["h"])
    parts = scratch.save(parts.withColumn("part", F.xxhash64("h", "item")).drop("item"), "parts")
    comps = parts.groupBy("part", "comp").agg(F.count("*").alias("n")).groupBy("part").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("comps"))
    comps = scratch.save(comps.filter("comps > 1").select("part", F.col("most.comp").alias("largest"), "n"), "part-sizes")
    parts = scratch.save(Dealt(comps.select("part", "n"), ["part"], scratch, "parts-heavy").join(parts, comps.select("part", "largest"), ["cid"]), "split")
    cost = parts.groupBy("h", "part").agg(tried.alias("cost")).groupBy("h").agg(F.sum("cost").alias("cost"))
    worth = scratch.save(crowd.join(cost, "h", "left").filter(F.coalesce("cost", F.lit(0)) < F.col("tried")).select("h", "n"), "worth")
    split = Dealt(worth, ["h"], scratch, "worth-heavy").join(parts, worth.select("h"), ["cid"], "left_semi").withColumn("h", F.col("part"))
    whole = Dealt(worth, ["h"], scratch, "whole-heavy").join(rest, worth.select("h"), ["cid"], "left_anti")
    scratch.drop("crowd-rows", "crowd-comps", "rare", "several-comps", "rarest", "parts", "item-counts")
    return whole.unionByName(split.select(*rest.columns))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, bands: int = 32, rows: int = 4, sigmas: float | None = 5.0, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_h (with doc_id the row's key) for each row of docs(doc_id, text, ...).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets. With 32 bands of
    4 samples a pair of similarity 0.75 meets in no bucket with a chance of 5e-6, one of 0.85 with less than 1e-10. Bitmaps
    refuse pairs beyond ``sigmas`` standard deviations; with None they refuse none. With ``by_row`` the row that is kept of a
    component is the one with the least doc_id (none is last) and hash; rows equal in both are kept or not alike.
    """
    scratch = Scratch(docs.sparkSession, "near")
    feats = scratch.save(features(docs, k, bands, rows), "features")
    named = feats.filter("n_shingles > 0" if by_row else "n_shingles > 0 and doc_id is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_h")
    classes = named.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(order).alias("least"), F.min_by(F.struct("n_shingles", "bands", "odd"), order).alias("x"))
    classes = classes.select("c1", "c2", F.monotonically_increasing_id().alias("cid"), "copies", "least", "x.n_shingles", "x.bands", *[F.col("x.odd")[i].alias(f"o{i}") for i in range(_LANES)])
    classes = scratch.save(classes, "classes")
    ends = [f(c).alias(f"{n}{c}") for n, f in (("lo_", F.min), ("hi_", F.max)) for c in ("c1", "c2")]
    again = scratch.save(named.groupBy("doc_id").agg(F.count("*").alias("n"), *ends).filter("n > 1"), "again")
    repeated = not again.isEmpty()
    sketches = classes.select("cid", "n_shingles", *[f"o{i}" for i in range(_LANES)])
    placed = classes.select("cid", F.explode("bands").alias("h"))
    crowded = scratch.save(placed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    buckets = Dealt(crowded, ["h"], scratch, "wide")
    shared = scratch.save(buckets.join(placed, crowded, ["cid"]), "shared")
    weights = shared.groupBy("cid").agg(F.sum("n").alias("weight"))
    centers = shared.join(weights, "cid").groupBy("h").agg(F.max(F.struct("weight", (-F.col("cid")).alias("least"))).alias("c")).select("h", (-F.col("c.least")).alias("center"))
    shared = scratch.save(buckets.join(shared, centers, ["cid"]), "centered")

    stars = scratch.save(shared.filter("cid <> center").select(F.greatest("cid", "center").alias("a"), F.least("cid", "center").alias("b")).distinct(), "stars")
    ends = {c: Dealt(stars.groupBy(c).agg(F.count("*").alias("n")), [c], scratch, f"stars-{c}") for c in "ab"}
    near = ends["b"].join(ends["a"].join(stars, _named(sketches, "x", "a"), ["b"]), _named(sketches, "y", "b"), ["a"])
    near = scratch.save(near.filter(_can_reach("x_", "y_", percent, sigmas)).select("a", "b").distinct(), "near-1")
    sets = _sets(docs, classes, near.select(F.col("a").alias("cid")).unionAll(near.select("b")), scratch, "sets-1", k, repeated)
    links = _confirmed(near, sets, scratch, "links-1", percent)
    if repeated and not by_row:
        links = links.unionAll(_same_document(named, classes, again, scratch, "several"))
    roots = scratch.save(connected_components(links, scratch, "graph-1"), "roots-1")

    # Buckets that still hold several components: those outside the bucket's largest one, against the others.
    held = shared.filter("n > 2").join(roots, F.col("cid") == F.col("node"), "left").select("h", "cid", "center", F.coalesce("root", "cid").alias("comp"))
    mixed = held.groupBy("h", "comp").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1")
    rest = scratch.save(buckets.join(held, mixed.select("h", F.col("most.comp").alias("largest")), ["cid"]), "mixed")
    sets = _sets(docs, classes, rest.select("cid"), scratch, "sets-2", k, repeated)
    per_item = sets.select("cid", F.explode("items").alias("item")).groupBy("item").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    alone = per_item.filter("lo = hi").groupBy(F.col("lo").alias("cid")).agg(F.count("*").alias("alone"))
    sized = sketches.join(alone, "cid", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    sized = sized.filter(100 * F.col("common") >= percent * F.col("n_shingles")).drop("alone")
    sized = sized.join(sets.select("cid", *[F.col("parity")[i].alias(f"p{i}") for i in range(_SET_LANES)]), "cid")
    rest = scratch.save(rest.filter("cid <> center").join(sized.select("cid"), "cid", "left_semi"), "close")
    rest = scratch.save(met_by_rare_shingles(rest, sets, percent, scratch).join(sized, "cid"), "rest")
    x, y = dealt_by_bucket(rest, F.col("comp") != F.col("largest"), scratch, "cells")
    x, y = x.alias("x"), y.alias("y")
    most_common = F.least("x.common", "y.common")
    bound = 100 * most_common >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles") - most_common)
    cell = reduce(lambda m, n: m & n, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("h", "__x", "__y")])
    met = x.join(y, cell & (F.col("x.comp") != F.col("y.comp")) & bound & _can_reach("x.", "y.", percent, sigmas) & _may_differ(percent, sigmas))
    met = scratch.save(met.select(F.greatest("x.cid", "y.cid").alias("a"), F.least("x.cid", "y.cid").alias("b")).distinct(), "near-2")
    late = _confirmed(met, sets, scratch, "links-2", percent)
    if late.isEmpty():
        root = roots
    else:
        c = roots.select(F.col("node").alias("n1"), F.col("root").alias("r1"))
        d = roots.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        bridges = late.join(c, F.col("a") == F.col("n1"), "left").join(d, F.col("b") == F.col("n2"), "left").select(F.coalesce("r1", "a").alias("a"), F.coalesce("r2", "b").alias("b"))
        over = scratch.save(connected_components(bridges, scratch, "graph-2"), "roots-2")
        o = over.select(F.col("node").alias("root"), F.col("root").alias("r3"))
        root = lookup(roots, o, "root", scratch, "roots-heavy", by=["node"], how="left").select("node", F.coalesce("r3", "root").alias("root"))
        root = root.unionAll(over.join(roots, "node", "left_anti").select("node", "root"))

    moved = classes.select("c1", "c2", "cid", "copies", "least").join(root, F.col("cid") == F.col("node"), "left").filter("copies > 1 or root is not null")
    moved = scratch.save(moved.select("c1", "c2", "least", F.coalesce("root", "cid").alias("root")), "grouped")
    best = scratch.save(moved.groupBy("root").agg(F.min("least").alias("best")), "best")
    moved = lookup(moved, best, "root", scratch, "best-heavy", by=["c1", "c2"])
    moved = scratch.save(moved.select("c1", "c2", F.col("best.doc_id").alias("best_id"), F.col("best.text_h").alias("best_h")), "moved")
    scratch.drop(*[f"{n}-{x}" for n in ("links-1", "links-2") for x in ("heavy-a", "heavy-b")], *[f"sets-{i}-{x}" for i in (1, 2) for x in ("ids", "heavy")], "stars-a", "stars-b", "stars", "wide")
    scratch.drop("crowded", "shared", "centered", "mixed", "close", "rest", "cells", "split", "crowd", "worth", "part-sizes", "several", "near-1", "near-2", "sets-1", "sets-2", "links-1", "links-2", "roots-1", "roots-2", "classes", "again", "grouped", "best")
    out = lookup(feats.select("doc_id", "text_h", "n_shingles", "c1", "c2"), moved, ["c1", "c2"], scratch, "moved-heavy", by=["doc_id", "text_h"], how="left")
    grouped = F.col("best_h").isNotNull() & (F.col("n_shingles") > 0)
    if not by_row:
        grouped &= F.col("doc_id").isNotNull()
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if by_row:
        kept = F.when(grouped, kept & (F.col("text_h") == F.col("best_h"))).otherwise(True)
    out = out.withColumn("component_id", F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_h")


def drop_near_copies(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, without those whose text is a near copy of one that stays; rows are judged one by one.

    Of a component the row with the least doc_id stays (none is last), of rows equal in doc_id and text one. Texts without
    words are nobody's copies and all stay.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    judged = near_duplicates(docs, percent, k, by_row=True)
    keys = judged.select("doc_id", F.col("text_h").alias("h"), "kept", "n_shingles").groupBy("doc_id", "h", "kept").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    keys = scratch.save(keys.filter("not kept or (n > 1 and n_shingles > 0)").select(*key_columns(F.col("doc_id"), F.col("h")), "kept"), "keys")
    rest = lookup(keyed(docs), keys.drop("kept"), KEY, scratch, "heavy-1", by=KEY, how="left_anti", sift=True).select(*quoted(docs.columns))
    one = keys.filter("kept").drop("kept")
    if one.isEmpty():
        return rest
    again = lookup(keyed(docs), one, KEY, scratch, "heavy-2", by=KEY, how="left_semi", sift=True).dropDuplicates(KEY)
    return rest.unionByName(again.select(*quoted(docs.columns)))


def _same_document(named: DataFrame, classes: DataFrame, again: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): the cid of a class and the least cid of the classes that share a doc_id with it."""
    several = scratch.save(again.filter("lo_c1 <> hi_c1 or lo_c2 <> hi_c2").select("doc_id"), name)
    held = lookup(named.select("doc_id", "c1", "c2"), several, "doc_id", scratch, f"{name}-heavy-1", by=["c1", "c2"], how="left_semi").distinct()
    held = scratch.save(held.join(classes.select("c1", "c2", "cid"), ["c1", "c2"]).select("doc_id", "cid"), f"{name}-held")
    least = scratch.save(held.groupBy("doc_id").agg(F.min("cid").alias("b")), f"{name}-least")
    return lookup(held, least, "doc_id", scratch, f"{name}-heavy-2", by=["cid"]).select(F.col("cid").alias("a"), "b")


def _sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, scratch: Scratch, name: str, k: int, repeated: bool) -> DataFrame:
    """cid, items and others (both hashes of the full shingle sets, made again for these classes alone) and their parity bitmaps."""

    def fn(batch):
        sets = list(shingle_sets(batch.column("text"), k))
        off = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])])
        parity = np.concatenate([_parity(mix(x), SET_BITS) for x, _ in sets])
        lists = [list_array(np.concatenate([x[i] for x in sets]).view(np.int64), off, pa.int64()) for i in (0, 1)]
        yield pa.Table.from_arrays([batch.column("cid"), *lists, list_array(parity, np.arange(len(sets) + 1) * _SET_LANES, pa.int64())], ["cid", "items", "others", "parity"])

    ids = cids.distinct().join(classes.select("cid", "least"), "cid")
    ids = scratch.save(ids.select("cid", *key_columns(F.col("least.doc_id"), F.col("least.text_h"))), f"{name}-ids")
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = lookup(texts, ids, KEY, scratch, f"{name}-heavy", by=KEY, sift=True).select("cid", "text")
    texts = texts.dropDuplicates(["cid"]) if repeated else texts
    return scratch.save(map_arrow(texts, fn, "cid long, items array<long>, others array<long>, parity array<long>"), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of cids whose full sets are similar enough under both hashes."""
    ends = {c: Dealt(pairs.groupBy(c).agg(F.count("*").alias("n")), [c], scratch, f"{name}-heavy-{c}") for c in "ab"}
    x, y = (sets.select(F.col("cid").alias(c), F.col("items").alias(f"{c}_items"), F.col("others").alias(f"{c}_others")) for c in "ab")
    both = ends["b"].join(ends["a"].join(pairs, x, ["b"]), y, ["a"])
    common = F.least(F.size(F.array_intersect("a_items", "b_items")), F.size(F.array_intersect("a_others", "b_others")))
    both = both.withColumn("common", common)
    return scratch.save(both.filter(100 * F.col("common") >= percent * (F.size("a_items") + F.size("b_items") - F.col("common"))).select("a", "b").distinct(), name)
