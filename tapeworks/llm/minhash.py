"""MinHash near-duplicates: universal hash minima, bands, confirmation on full sets, large-star and small-star.

1. Each text becomes the set of its word shingles (64-bit hashes); `HASHES` universal hashes give its minima; `ROWS`
   minima make a band. Documents of equal sets fall together by a 128-bit digest of the set: from there on each set
   goes by its smallest doc_id.
2. Sets that share a band share a bucket. A bucket's hub is the member that shares most buckets with others; each member
   is compared with its bucket's hub (a star, not all pairs), on the full sets. What is within `NEAR` of its hub leaves the
   bucket; what is left has another such round, `STARS` rounds in all.
3. The confirmed links' components come from alternating large-star and small-star.
4. Members of one hub that stand in different components are compared through it. Each is kept as what it lacks of the
   hub's set and has beyond it; x and y of such differences, with weights w (100 for each lacking shingle, `percent` for each
   one beyond), are linked if and only if w(x) + w(y) <= (100 - percent) * |hub| + (100 + percent) * |what their
   differences share|. A member in the hub's component needs no partner there, so only the others look for some, by an inverted
   index of the differences: exact, and no pair is emitted but one link for each component. By the triangle inequality
   of Jaccard distances, every pair of a bucket of which one has left is found so.
5. Buckets that still hold several members after all rounds, which are hardly alike, give pairs whose signatures agree in
   `LEAST_AGREE` of the places, unless one component has both; these are compared on the full sets too. Members of buckets
   of more than `BLOCK` are not compared by bucket, which would cost the square of a large family that is alike but below the
   threshold (templated text): their shingles are put in order of rarity among them, by `SLOTS` counters, and two sets
   within the threshold share one of their rarest shingles, the first size - ceil(percent * size / 100) + 1 (prefix filter). What a family has in
   common is frequent and stands in no prefix, so only sets that share something rare are compared.

A pair at the threshold of 0.8 is missed with probability (1 - 0.8 ** ROWS) ** BANDS = 5e-8 in the bands; one left for step 5
fails `LEAST_AGREE` with probability 9e-9 besides. The prefix filter is exact. Nothing is capped: a shingle that stands in the
prefixes of more than `BLOCK` sets has these compared block by block over many tasks.
Hot buckets, hubs and shingles are dealt out over several tasks.

Null and empty texts have an empty set and are linked with nothing (component_id is doc_id); a text of fewer words than a
shingle has its whole sequence as the one shingle. doc_id names a text: equal rows have equal results; where rows
of one doc_id have different texts, each is counted and judged by its own, but links of all but one of them may be missed.
An empty table gives an empty table; other columns are ignored. Rows whose doc_id is null take part in no link and come out with their set's size, a null component and kept true.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeworks.llm.common import HOT, Ids, blocks, dealt, each_deal, hot_keys, mixed, narrow, spread, table, texts, written

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: 0.8 less 6.2 standard deviations of the agreement of HASHES minima.
LEAST_AGREE = 0.58
BLOCK = 1024
#: Jaccard distance from the hub within which a member leaves its bucket, and rounds of hubs.
NEAR, STARS = 0.3, 2
SEEKERS, HELD = 1024, 4096
#: Counters of shingles in step 5, twice so many, all of which reach the driver and each task (16 MB).
SLOTS = 1 << 20
MOST_WORDS = 400_000
_rng = np.random.Generator(np.random.PCG64(20240229))
A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
C = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class Shingles:
    """Sets of texts as sorted arrays of 64-bit hashes; hashes of words are kept between texts."""

    def __init__(self, k: int):
        self.k = k
        self._new()

    def _new(self):
        from array import array

        self.ids, self.hash = Ids(), array("Q")

    def __call__(self, raw: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.ids) > MOST_WORDS:
            self._new()
        known = len(self.ids)
        w = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > known:
            self.hash.extend(xxh3_64_intdigest(x) for x in dict.fromkeys(words) if self.ids[x] >= known)
        h = np.frombuffer(self.hash, np.uint64)[w]
        k = min(self.k, len(h))
        key = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            key = (key ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return np.unique(mixed(key))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) == 0 or len(b) == 0 or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id, band keys, and a byte of each minimum."""

    def sign(batches):
        import pyarrow as pa

        shingles = Shingles(k)
        for batch in blocks(batches, 4_000_000):
            sets = [shingles(t) for t in batch.column("text").cast("binary").to_pylist()]
            n = np.array([len(s) for s in sets])
            some = np.flatnonzero(n)
            minima = np.zeros((len(sets), HASHES), np.uint64)
            if len(some):
                flat, begin = np.concatenate([sets[i] for i in some]), (np.cumsum(n) - n)[some]
                for j in range(HASHES):
                    minima[some, j] = np.minimum.reduceat(flat * A[j] + C[j], begin)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
            byte = (mixed(minima) & np.uint64(255)).astype(np.uint8)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digest), pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64).ravel())), pa.array([x.tobytes() for x in byte])],
                names=["doc_id", "n_shingles", "set_id", "bands", "sig"],
            )

    return spread(texts(docs), "doc_id").mapInArrow(sign, "doc_id long, n_shingles long, set_id binary, bands array<long>, sig binary")


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    a, b = (docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.hint("merge").join(b, "b").join(a.hint("merge"), "a")  # texts: neither side has a bound


def _sets(batches, k: int):
    """a, b and their sets, some megabytes of text at a time."""
    shingles, last, held = Shingles(k), None, None
    for batch in blocks(batches, 8_000_000, "tb"):
        for x, y, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), *(batch.column(c).cast("binary").to_pylist() for c in ("ta", "tb"))):
            if x != last:
                last, held = x, shingles(tx)
            yield x, y, held, shingles(ty)


def _batches(rows, names, types, size: int = 2000):
    """Record batches of what an iterator of rows gives."""
    import pyarrow as pa
    from itertools import batched

    for part in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), types)], names=names)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are linked."""
    import pyarrow as pa

    def compare(batches):
        yield from _batches(((x, y) for x, y, s, t in _sets(batches, k) if linked(s, t, percent)), ["a", "b"], [pa.int64()] * 2)

    return _with_texts(pairs, docs).mapInArrow(compare, "a long, b long")


BEYOND = np.uint64(0xA5A5A5A5A5A5A5A5)


def relations(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs of a hub and a member (a, b) that are not too far apart for step 4: the hub's size, whether they are
    linked, whether they are near, and the member's difference with its weight."""
    import pyarrow as pa

    far = NEAR + (100 - percent) / 100

    def related(batches):
        for x, y, s, t in _sets(batches, k):
            both = np.intersect1d(s, t, assume_unique=True)
            union = len(s) + len(t) - len(both)
            if len(both) < (1 - far) * union - 1e-9:
                continue
            lacks, has = np.setdiff1d(s, both, assume_unique=True), np.setdiff1d(t, both, assume_unique=True)
            weight = 100 * len(lacks) + percent * len(has)
            yield x, y, len(s), 100 * len(both) >= percent * union, len(both) >= (1 - NEAR) * union, weight, np.concatenate([lacks, has ^ BEYOND]).tobytes()

    names, types = ["a", "b", "size", "linked", "near", "weight", "diff"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
    return _with_texts(pairs, docs).mapInArrow(lambda it: _batches(related(it), names, types, 500), "a long, b long, size long, linked boolean, near boolean, weight long, diff binary")


def through_hubs(related: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one hub that stand in different components (step 4)."""
    import pyarrow as pa

    comp = lambda node: found.select(F.col("node").alias(node), F.col("component").alias(f"c{node}"))
    size = related.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(narrow(size), "a", HOT)
    hubs = size.select("a").join(comp("a"), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
    # who seeks is settled on ids alone; differences, the bulk, are shuffled once, for the hubs that need them
    flags = dealt(related.select("a", "b").distinct().join(comp("b"), "b", "left"), hot, "a", "b").join(each_deal(hubs, hot, "a"), ["a", "deal"])
    flags = flags.withColumn("cb", F.coalesce("cb", "b")).withColumn("seeks", F.col("ca") != F.col("cb"))
    counts = flags.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if("seeks").alias("u")).where("u > 0 and n > 1")
    flags = narrow(flags.join(each_deal(counts, hot, "a"), ["a", "deal"]).select("a", "b", "cb", "seeks", "n", "u"))
    rows = related.select("a", "b", "size", "weight", "diff").join(flags, ["a", "b"])
    blocks_of = {"mi": F.ceil(F.col("u") / SEEKERS).cast("int"), "mj": F.ceil(F.col("n") / HELD).cast("int")}
    rows = rows.withColumns(blocks_of)
    side = lambda many, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(many)
    own = lambda one, n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int").alias(one)
    keep = ["a", "b", "cb", "size", "weight", "diff"]
    held = rows.select(*keep, own("j", "mj"), side("i", "mi")).withColumn("seeks", F.lit(False))
    seekers = rows.where("seeks").select(*keep, own("i", "mi"), side("j", "mj")).withColumn("seeks", F.lit(True))

    def match(group):
        seeks = group.column("seeks").to_numpy(zero_copy_only=False)
        ids, comps, weight = (group.column(c).to_numpy() for c in ("b", "cb", "weight"))
        diffs = [np.frombuffer(x, np.uint64) for x in group.column("diff").to_pylist()]
        size = group.column("size")[0].as_py()
        rest, at = np.flatnonzero(~seeks), []
        out = set()
        if len(rest):
            element = np.concatenate([diffs[r] for r in rest])
            owner = np.repeat(np.arange(len(rest)), [len(diffs[r]) for r in rest])
            order = np.argsort(element, kind="stable")
            element, owner = element[order], owner[order]
            for r in np.flatnonzero(seeks):
                lo, hi = np.searchsorted(element, diffs[r], "left"), np.searchsorted(element, diffs[r], "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(rest))
                good = (weight[r] + weight[rest] <= (100 - percent) * size + (100 + percent) * shared) & (comps[rest] != comps[r])
                _, first = np.unique(comps[rest][good], return_index=True)
                out |= {(min(x, int(ids[r])), max(x, int(ids[r]))) for x in ids[rest][good][first].tolist()}
        pairs = sorted(out)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    # else Spark would keep the partitions by hub of the joins before
    return held.unionByName(seekers).repartition("a", "i", "j").groupBy("a", "i", "j").applyInArrow(match, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of links (a, b), by alternating large-star and small-star. A node's
    least neighbour is a partial aggregate; no neighbour list is gathered."""
    edges = narrow(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = narrow(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs of members (key, id, component, sig, n of the bucket) in one bucket and different components whose
    signatures agree well enough."""
    cut = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = cut.select("key", "id", "component", "sig", "block", other).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "component", "sig")

    def compare(group):
        import pyarrow as pa

        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        a, b = [], []
        for i in range(len(ids) - 1):
            rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if len(rest):
                rest = rest[(sig[rest] == sig[i]).mean(1) >= LEAST_AGREE]
                a.append(np.full(len(rest), ids[i]))
                b.append(ids[rest])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return pairs.repartition("key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def rare_shingles(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, id: the shingles in the prefixes of members' sets (column id), rarest first among these sets, that stand in the
    prefixes of several. How rare a shingle is goes by the lower of two of `SLOTS` counters each: two shingles may share them, but the
    order is the same for all sets, which is all that an exact filter needs. Only the shingles in prefixes are shuffled one by one, no text."""
    import pyarrow as pa

    def shingled(batches):
        shingles = Shingles(k)
        for batch in blocks(batches, 4_000_000):
            sets = [shingles(t).tobytes() for t in batch.column("text").cast("binary").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    def slots(key):
        return [(key >> np.uint64(32 * i) & np.uint64(SLOTS - 1)).astype(np.int64) + i * SLOTS for i in range(2)]

    def rows(names, *columns):
        for a in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in columns], names=names)

    def count(batches):
        n = np.zeros(2 * SLOTS, np.int64)
        for batch in blocks(batches, 4_000_000, "shingles"):
            for at in slots(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)):
                n += np.bincount(at, minlength=2 * SLOTS)
        slot = np.flatnonzero(n)
        yield from rows(["slot", "n"], slot, n[slot])

    def rarest(batches):
        n = sent.value
        for batch in blocks(batches, 4_000_000, "shingles"):
            ids, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for x, raw in zip(batch.column("id").to_pylist(), batch.column("shingles").to_pylist()):
                key = np.frombuffer(raw, np.uint64)
                many = np.minimum(*(n[at] for at in slots(key)))
                first = np.lexsort((key, many))[: len(key) + percent * len(key) // -100 + 1]
                first = first[many[first] > 1]  # a count of 1: no other set has it
                ids.append(np.full(len(first), x))
                keys.append(key[first])
            yield from rows(["key", "id"], np.concatenate(keys).view(np.int64), np.concatenate(ids))

    texts_of = docs.select(F.col("doc_id").alias("id"), "text").join(members.select("id").distinct().hint("merge"), "id")
    sets = written(texts_of.mapInArrow(shingled, "id long, shingles binary"))
    got = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    prefix = narrow(sets.mapInArrow(rarest, "key long, id long"))
    sent.destroy()
    several = narrow(prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = hot_keys(several, "key", HOT)
    return dealt(prefix, hot, "key", "id").join(each_deal(several, hot, "key"), ["key", "deal"]).select("key", "id", "n")


def shared_buckets(pool: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key, id, n, deal of the buckets (key, id) that hold several members, one of those with the same members; and the hot
    keys among them."""
    several = narrow(pool.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 31))).alias("z")).where("n > 1"))
    hot = hot_keys(several, "key", HOT)
    once = several.groupBy("n", "x", "y", "z").agg(F.min("key").alias("key")).select("key", "n")
    return narrow(dealt(pool, hot, "key", "id").join(each_deal(once, hot, "key"), ["key", "deal"])), hot


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of those reachable by links of `percent` or more), kept."""
    signed = written(signatures(docs, shingle))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    sets = narrow(full.groupBy("set_id").agg(F.min("doc_id").alias("id")))
    unique = full.select(F.col("doc_id").alias("id"), "set_id", "bands", "sig").join(sets, ["id", "set_id"], "left_semi").dropDuplicates(["id", "set_id"])
    pool = unique.select("id", F.explode("bands").alias("key"))
    bodies, related = None, None
    for _ in range(STARS):
        members, hot = shared_buckets(pool)
        if bodies is None:
            bodies = written(texts(docs).join(members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id").withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"]).drop("same"))
        weight = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("weight"))
        weighed, hub = members.join(weight, "id"), F.max_by("id", F.struct("weight", -F.col("id")))
        if hot is None:  # no bucket of more than HOT members: each lies in one task, and its hub needs no join
            starred = weighed.withColumn("a", hub.over(Window.partitionBy("key")))
        else:
            starred = members.join(each_deal(weighed.groupBy("key").agg(hub.alias("a")), hot, "key"), ["key", "deal"])
        stars = narrow(starred.where("id != a").select("key", "a", F.col("id").alias("b")))
        now = written(relations(stars.select("a", "b").distinct(), bodies, shingle, percent))
        related = now if related is None else related.unionByName(now)
        pool = narrow(stars.join(now.where("near").select("a", "b"), ["a", "b"], "left_anti").select("key", F.col("b").alias("id")))
        if pool.isEmpty():
            break
    links = narrow(related.where("linked").select("a", "b"))
    found = components(links)
    more = narrow(through_hubs(related, found, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    rest = shared_buckets(pool)[0].select("key", "id", "n")
    large = rest.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        rest = rest.where(F.col("n") <= BLOCK).unionByName(rare_shingles(large, bodies, shingle, percent))
    of_id = found.select(F.col("node").alias("id"), "component")
    rest = rest.join(of_id, "id", "left").withColumn("component", F.coalesce("component", "id"))
    pairs = written(cross_pairs(rest.join(unique.select("id", "sig"), "id")))
    more = narrow(confirm(pairs, bodies, shingle, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    of_set = sets.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
        .join(of_set, "set_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
