"""Near-duplicate documents: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each document becomes its set of word shingles (64-bit hashes). One hash function splits the sets over
   ``bands * rows`` bins and the least hash of each bin is its value; an empty bin takes the value of
   the first non-empty bin in a probing order of its own (optimal densification). ``rows`` bins make a
   band; documents with the same band values share a bucket.
2. Documents with equal sets form a class, kept as a class: its smallest id stands for it, so copies never
   become pairs.
3. Each bucket links its members to one hub, the smallest id (a star), not to each other. The pairs of all stars are refuted by
   sketches or confirmed on the full sets, and the confirmed links give groups.
4. Buckets that span several groups are open. The pairs of members of an open bucket that lie in different groups are
   compared by their sketches inside of one task, in blocks of at most ``BLOCK`` members a side; only pairs that the sketches do not
   refute leave the task, and they are confirmed on the full sets. Members of a bucket's largest group are not compared
   with each other, so a group of copies with few members outside of it costs a pass over its members.
   So every pair of a bucket is either confirmed, refuted or already connected.
5. Components come from alternating star contraction, with each step written to the shared folder. A written step is removed as
   soon as its successors are written.

A sketch has one bit for each value of some last bits of the hashes: the parity of the number of shingles with that value. A
shingle that only one of two sets has changes one bit, so two sketches differ in no more bits than there are such shingles, and
refuting by them is a proof. A sketch is four to eight bits a shingle wide, and at most ``WIDEST``; a wider one folds to a narrower.

A pair of similarity s shares no bucket with probability (1 - s**rows)**bands if the values of its signatures are
independent: 1.2e-7 at 0.8 with the defaults, and less above. Sets of fewer shingles than bins repeat values, which makes
that more likely. No pair that shares a bucket is lost.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing.
A null id is linked with nothing and has a null component and ``kept`` false. Repeated rows of one id
share that id's component; different texts under one id link it with what each of them is linked with.
An empty table gives an empty result. Texts are shingled whole at any length. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import Scratch, groups_of, map_arrow, pick, utf8
from sylva.llm.shingles import mix, shingle_sets

BANDS, ROWS = 40, 5
#: Bits of the narrowest and the widest sketch.
NARROWEST, WIDEST = 256, 1 << 16
#: Members of a bucket on each side of a comparison inside of one task.
BLOCK = 2048
#: Rows of ids (two at most a row) that are sent to all executors; beyond that, both sides of a join are shuffled.
BROADCAST_ROWS = 500_000
_PROBES = 16


class Sketcher:
    """One-permutation signatures with optimal densification, and the bucket keys of their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        bins = np.arange(self.bins, dtype=np.uint64)
        probe = [mix(mix(bins + np.uint64(seed)) + np.uint64(a)) for a in range(_PROBES)]
        self.probe = [(p % np.uint64(self.bins)).astype(np.int64) for p in probe]
        #: order[j, k]: place of bin k in the rest of the probing order of bin j
        self.order = mix(mix(bins[:, None] + np.uint64(seed + 1)) + bins[None, :])
        self.salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(seed + 2)) | np.uint64(1)
        self.tag = mix(np.arange(bands, dtype=np.uint64) + np.uint64(seed + 3))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Value of each bin, from sorted hashes (at least one)."""
        bin_of = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
        own = bin_of[first].astype(np.int64)
        value = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        value[own], full[own] = hashes[first], True
        empty = np.flatnonzero(~full)
        for probe in self.probe:
            if not len(empty):
                return value
            at = probe[empty]
            hit = full[at]
            value[empty[hit]] = value[at[hit]]
            empty = empty[~hit]
        if len(empty):
            value[empty] = value[own[self.order[empty][:, own].argmin(axis=1)]]
        return value

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """The bucket of each band."""
        bands = signature.reshape(self.bands, self.rows)
        return mix(mix(bands * self.salt).sum(axis=1, dtype=np.uint64) + self.tag).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of hashes with each value of their last bits."""
    width = min(WIDEST, max(NARROWEST, 1 << (4 * len(hashes)).bit_length()))
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray) -> np.ndarray:
    """Rows of sketches (longs) at half their width."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


class Sketches:
    """The sketches of some sets, ready to be compared with one of them."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.width = np.array([len(x) for x in sketches])
        self.rows = {int(w): np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        self.as_wide = {(w, w): np.frombuffer(b"".join(sketches[i] for i in rows), np.uint64).reshape(len(rows), w // 8) for w, rows in self.rows.items()}
        self.place = np.zeros(len(sketches), np.int64)
        for rows in self.rows.values():
            self.place[rows] = np.arange(len(rows))

    def at(self, width: int, wanted: int) -> np.ndarray:
        """The sketches of one width, folded to another one."""
        if (width, wanted) not in self.as_wide:
            self.as_wide[width, wanted] = folded(self.at(width, 2 * wanted))
        return self.as_wide[width, wanted]

    def near(self, one: int, others: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` (a mask) the sketches do not refute as links of ``one``: a link's sets have at most (100 - percent) /
        (100 + percent) of their shingles in one of them only."""
        own, found = int(self.width[one]), []
        for width, rows in self.rows.items():
            rows = rows[others[rows]]
            if len(rows):
                w = min(own, width)
                bits = np.bitwise_count(self.at(width, w)[self.place[rows]] ^ self.at(own, w)[self.place[one]]).sum(axis=1, dtype=np.int64)
                found.append(rows[bits * (100 + percent) <= (n[rows] + n[one]) * (100 - percent)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def close_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different groups that sizes and sketches do not refute: those of the two sides, if there are two, else all."""
    codes = np.unique(comp, return_inverse=True)[1]
    if (codes == codes[0]).all():
        return
    both = Sketches(sketches)
    two = side.any()
    count = np.bincount(codes)
    largest = codes == count.argmax()
    order = np.arange(len(n))
    for a in np.flatnonzero(side == 0) if two else np.flatnonzero(~largest):
        others = (codes != codes[a]) & (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent)
        others &= side == 1 if two else largest | (order > a)
        for b in both.near(a, others, n, percent):
            yield int(a), int(b)


def prints(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, digest of the set (two longs) and bucket keys (null for an empty set)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            texts = utf8(batch.column(1))
            n, d1, d2, keys = [], [], [], []
            for i, j in groups_of(texts):
                for s in shingle_sets(texts[i:j], shingle):
                    n.append(len(s))
                    one, two = _digest(s)
                    d1.append(one)
                    d2.append(two)
                    keys.append(sketcher.keys(sketcher.signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "d1", "d2", "keys"])

    return map_arrow(docs, run, f"id {id_type}, n_shingles long, d1 long, d2 long, keys array<long>")


def _digest(s: np.ndarray) -> tuple[int, int]:
    digest = blake2b(s.tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))


def shingle_table(docs: DataFrame, shingle: int) -> DataFrame:
    """id, size, whole set of shingles, its digest and its sketch, for each document."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in groups_of(texts):
                sets = shingle_sets(texts[i:j], shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(map(len, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())],
                    ["id", "n", "shingles", "digest", "sketch"],
                )

    return map_arrow(docs, run, f"id {id_type}, n long, shingles array<long>, digest long, sketch binary")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table of ids, for a join: sent to all executors if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _facing(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the facts of both (columns of ``facts`` by id, with the ends _a and _b). Of few pairs only the facts
    in question are shuffled, else all."""
    rows = pairs.count()
    names = [c for c in facts.columns if c != "id"]
    left = facts.toDF(*["a" if c == "id" else f"{c}_a" for c in facts.columns]).join(_sent(pairs, rows), "a")
    right = facts.join(_sent(pairs.select(F.col("b").alias("id")).distinct(), rows), "id", "left_semi").toDF(*["b" if c == "id" else f"{c}_b" for c in facts.columns])
    return left.join(right, "b").select("a", "b", *[f"{c}_{end}" for end in "ab" for c in names])


def unrefuted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not refute."""
    met = _facing(pairs, sets.select("id", "n", "sketch")).where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            n, sketches = [batch.column(k).to_numpy() for k in (2, 4)], [batch.column(k).to_pylist() for k in (3, 5)]
            left = [next(close_pairs(np.array([x, y]), np.arange(2), np.zeros(2), [s, t], percent), None) is not None for x, y, s, t in zip(*n, *sketches)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(left, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(met, run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    met = _facing(pairs, sets.select("id", "shingles"))
    return met.where(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): the smallest id of each connected component, for all ids of ``edges`` (a, b).

    Stops as soon as the edges are a forest of stars: every id hangs on one centre, and no centre hangs.
    """
    edges = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _is_star_forest(edges):
        # large star: neighbours above u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.cut(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(edges, least)
        # small star: u and its neighbours below go to the least of them
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        below = large.join(least, "u")
        edges = scratch.cut(below.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(large, least)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each end appears once below and never both below and above."""
    role = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    ends = role.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below > 1 or (below > 0 and above > 0)").isEmpty()


def blocks_of(members: DataFrame, block: int) -> DataFrame:
    """Deals the members (key, id, comp) of open buckets out to comparisons: bucket, blocks i and j, and the side of the member.

    A bucket of at most ``block`` members is one comparison. In a larger one, the members outside of its largest group go to blocks that meet each
    other and those of the largest group; blocks of the largest group do not meet.
    """
    by_group = members.groupBy("key", "comp").agg(F.count("*").alias("k"))
    sizes = by_group.groupBy("key").agg(F.sum("k").alias("m"), F.max("k").alias("most"), F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    met = members.join(sizes.select("key", "m", "most", F.col("main.comp").alias("main")), "key")
    place = F.xxhash64("id")
    inner = F.col("comp") == F.col("main")
    outer_blocks, inner_blocks = (F.greatest(F.lit(1), F.ceil(x / block)).cast("int") for x in (F.col("m") - F.col("most"), F.col("most")))
    own = F.pmod(place, F.when(inner, inner_blocks).otherwise(outer_blocks)).cast("int")
    to = lambda i, j, side: F.struct(F.col("key"), i.alias("i"), j.alias("j"), side.cast("tinyint").alias("side"))
    one, two = F.lit(0), F.lit(1)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    met_by_outer = F.transform(upto(outer_blocks), lambda i: to(i, -1 - own, two))
    meets = F.concat(
        F.transform(upto(outer_blocks), lambda j: to(F.least(own, j), F.greatest(own, j), F.when(own > j, two).otherwise(one))),
        F.transform(upto(inner_blocks), lambda j: to(own, -1 - j, one)),
    )
    dealt = F.when(F.col("m") <= block, F.array(to(one, one, one))).when(inner, met_by_outer).otherwise(meets)
    return met.select("id", "comp", F.explode(dealt).alias("to")).select("to.*", "id", "comp")


def open_pairs(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs of one bucket and different groups that sizes and sketches do not refute, from ``members`` (key, id, comp)."""
    kind = members.schema["id"].dataType.simpleString()
    rows = blocks_of(members, block).join(sets.select("id", "n", "sketch"), "id").select("key", "i", "j", "side", "id", "n", "comp", "sketch")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def groups(batches):
        """Tables of the rows of a comparison; a comparison may go over several batches."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            where = [table.column(k).to_numpy() for k in range(3)]
            ends = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in where])) + 1
            yield table.slice(0, int(ends[-1]) if len(ends) else 0), np.concatenate([[0], ends])
            rest = table.slice(int(ends[-1]) if len(ends) else 0)
        if rest is not None and len(rest):
            yield rest, np.array([0, len(rest)])

    def run(batches):
        for table, ends in groups(batches):
            if not len(table):
                continue
            side, ids, n, comp, sketches = (table.column(k).combine_chunks() for k in range(3, 8))
            side, n, comp, sketches = side.to_numpy(), n.to_numpy(), comp.dictionary_encode().indices.to_numpy(), sketches.to_pylist()
            a, b = [], []
            for s, e in zip(ends[:-1], ends[1:]):
                for x, y in close_pairs(n[s:e], comp[s:e], side[s:e], sketches[s:e], percent):
                    a.append(s + x)
                    b.append(s + y)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])

    found = map_arrow(dealt, run, f"a {kind}, b {kind}")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _grouped(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def link_classes(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(id, comp) of the classes with a link; None if there is none."""
    members = classes.select("id", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min("id").alias("h"), F.max("id").alias("top")).where("h < top").select("key", "h")
    members = scratch.cut(members.join(hubs, "key"))
    wanted = scratch.cut(members.select("id").distinct())
    rows = wanted.count()
    if not rows:
        return None
    sets = scratch.cut(shingle_table(docs.join(_sent(wanted, rows), "id", "left_semi"), shingle))
    if sets.count() > rows:  # some id has several rows
        sets = scratch.replaced(sets, sets.dropDuplicates(["id", "n", "digest"]))
    star = scratch.cut(members.where("id <> h").select(F.col("id").alias("a"), F.col("h").alias("b")).distinct())
    likely = scratch.cut(unrefuted(star, sets, percent))
    links = scratch.cut(confirmed(likely, sets, percent).distinct())
    scratch.drop(star, likely, wanted)
    comp = scratch.cut(components(links, scratch))
    scratch.drop(links)
    own = scratch.cut(_grouped(members.select("key", "id"), comp))
    scratch.drop(members)
    likely = scratch.cut(open_pairs(own, sets, percent))
    links = scratch.cut(confirmed(likely, sets, percent).distinct())
    scratch.drop(own, likely, sets)
    if links.isEmpty():
        return comp
    ends = links
    for end in "ab":
        ends = ends.join(comp.toDF(end, "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    further = components(ends, scratch).toDF("comp", "to")
    moved = further.select(F.col("comp").alias("id"), F.col("to").alias("comp"))  # groups without a link of their own so far
    all_of = comp.unionByName(moved.join(comp, "id", "left_anti"))
    return scratch.cut(all_of.join(further, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` of each row."""
    own = pick(docs, row_id, text).toDF("id", "text")
    scratch = Scratch(docs.sparkSession)
    seen = scratch.cut(prints(own, shingle, bands, rows))
    linked = seen.where("id is not null and n_shingles > 0")
    classes = scratch.cut(linked.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("keys").alias("keys")))
    seen = scratch.replaced(seen, seen.drop("keys"))
    comp = link_classes(classes, own.where("id is not null"), shingle, percent, scratch)
    named = classes.select("d1", "d2", "id")
    named = scratch.cut((_grouped(named, comp) if comp is not None else named.withColumn("comp", F.col("id"))).select("d1", "d2", "comp"))
    scratch.close(seen, named)
    out = seen.join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(row_id), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(row_id) == F.col("component_id"), F.lit(False)))
