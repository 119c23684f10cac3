"""Exact n-gram Jaccard join over regions of pivot shingles.

Whole-document pivots cannot cut this space: unrelated documents lie at distance 1 from nearly every
pivot, so a triangle window of twice the radius replicates them everywhere.  Pivots here are single shingles,
rarest first.  Taking the first i pivots out of a set of n moves it by i/n; a set that avoids them all is
therefore farther than the radius 1 - t once i > (1 - t) n, so a document is replicated to the regions of its
first n - ceil(t n) + 1 pivots and every link has a region in common.

Any order that all documents share keeps the join exact; rare pivots keep the regions small.  Shingles are
counted over all documents in 2^32 counters, dealt by their first bits; those of the ``HOT`` fullest counters
come last, by quarters of a power of two of their count, and equal ones stand in hash order.

Equal sets are one class first.  Each class is compared with the region's smallest that shares most pivots with it; then
with the smallest of its other regions; then, recursively, only classes that are still in different components
are compared.  The size of a set is its distance from the empty set: sets in reach of each other differ by a
factor of 4/3 at most, so each region is cut into bands of sizes, and a class meets its own and the next
bands only.  Each set has a sketch, the parities of its shingles over ``SKETCH`` places: two sketches differ in
no more places than the sets in shingles, so pairs whose sketches differ too much are no links and go
unread.  Overlaps of the others are counted exactly.

Defined cases: null, empty and blank texts have no shingles and no links; fewer than five words are one
shingle; repeated rows keep their rows; rows without doc_id are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import mix, slices, texts, word_codes
from recengine.session import written

WORDS, PERCENT = 5, 75
# odd factors of a shingle's words: powers of one odd number
FACTORS = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(WORDS)]
# counters: 2^8 ranges of 2^24; hot counters: at most HOT, in a bit array of HOT_BITS
RANGES, HOT, HOT_BITS = 256, 1 << 20, 26
# rows of one comparison group; salts of a region, and the level (4 log2 of the count) from which it has them
GROUP, SALTS, SALT_LEVEL = 1000, 64, 52
# places of a sketch
SKETCH = 1024
# ratio of the size bands: just over 100 / PERCENT, so that rounding moves no set by two bands
BAND = 1.34


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = word_codes(text.encode())
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(len(w), WORDS)):
        h += w[k:k + n] * FACTORS[k]
    h = np.sort(mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _gaps(low: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit gaps; 65535 adds that much and is no number."""
    d = np.diff(low, prepend=0)
    more, at = d // 65535, np.arange(len(d))
    out = np.full(len(d) + int(more.sum()), 65535, np.uint16)
    out[at + np.cumsum(more)] = d % 65535
    return out.tobytes()


def _numbers(gaps: bytes) -> np.ndarray:
    g = np.frombuffer(gaps, np.uint16)
    return np.cumsum(g, dtype=np.int64)[g != 65535]


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _reach() -> str:
    """Condition that sets of sizes na, nb and sketches sa, sb may be links: no link fails it."""
    differ = " + ".join(f"bit_count(sa[{k}] ^ sb[{k}])" for k in range(SKETCH // 64))
    return (f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
            f" and {100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (na + nb)")


def _scan(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, digest, sketch), and rows (part, gaps) with the shingles of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            top = np.sort(np.concatenate(sets) >> np.uint64(32)).astype(np.int64) if sets else np.empty(0, np.int64)
            cut = np.searchsorted(top, np.arange(RANGES + 1) << 24)
            parts = [k for k in range(RANGES) if cut[k] < cut[k + 1]]
            gaps = [_gaps(top[cut[k]:cut[k + 1]] - (k << 24)) for k in parts]
            none, free = [None] * len(sets), [None] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_pylist() + free, pa.int64()), pa.array([len(s) for s in sets] + free, pa.int64()),
                 pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets] + free, pa.string()),
                 pa.array([_sketch(s) for s in sets] + free, pa.list_(pa.int64())),
                 pa.array(none + parts, pa.int32()), pa.array(none + gaps, pa.binary())], ["doc_id", "n", "digest", "sketch", "part", "gaps"])
    return docs.mapInArrow(run, "doc_id long, n long, digest string, sketch array<long>, part int, gaps binary")


def _hot(gaps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots and levels of the fullest counters (at most ``HOT``, whatever the corpus)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, None

        def full() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= 8)
            return pa.RecordBatch.from_arrays([pa.array((part << 24) + at), pa.array((4 * np.log2(counts[at])).astype(np.int32))], ["at", "level"])
        for batch in batches:
            for k, g in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != part:
                    if part is not None:
                        yield full()
                    part, counts = k, np.zeros(1 << 24, np.uint32)
                at, n = np.unique(_numbers(g.as_py()), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if part is not None:
            yield full()
    full = written(gaps.repartition("part").sortWithinPartitions("part").mapInArrow(run, "at long, level int"), "full")
    floor, total = 129, 0
    for level, n in sorted(((r.level, r.n) for r in full.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        total += n
        if total > HOT:
            break
        floor = level
    top = full.where(F.col("level") >= floor).toPandas()  # at most HOT rows
    return (top["at"].to_numpy(np.int64) >> (32 - HOT_BITS)).astype(np.int32), top["level"].to_numpy(np.uint8)


def _regions(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, salt, id) for each document's pivots; only the regions of very frequent pivots are salted."""
    shared, salt_level = docs.sparkSession.sparkContext.broadcast(hot), SALT_LEVEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.zeros(1 << HOT_BITS, np.uint8)
        np.maximum.at(levels, *shared.value)
        for batch in slices(batches, 2 << 20):
            hs, salts, ids = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(t)
                level = levels[(s >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
                take = len(s) - -(-len(s) * PERCENT // 100) + 1
                first = np.argsort(level, kind="stable")[:take]
                hs.append(s[first].view(np.int64))
                salts.append((level[first] >= salt_level) * np.int32(1 + i % SALTS))
                ids.append(np.full(len(hs[-1]), i, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(salts).astype(np.int32)),
                                                  pa.array(np.concatenate(ids))], ["h", "salt", "id"])
    return docs.mapInArrow(run, "h long, salt int, id long")


def _stars(regions: DataFrame) -> DataFrame:
    """(h, a, b): a region's smallest and each other; of a salted region also (h, a, a) for each salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in batches:
            h, salt, i = (batch.column(k).to_numpy() for k in range(3))
            if not len(h):
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            goes_on = last[:2] == (h[0], salt[0])
            head = i.copy()
            if goes_on:
                head[0], new[0] = last[2], False
            starts = np.flatnonzero(np.r_[True, new[1:]])
            head = np.repeat(head[starts], np.diff(np.r_[starts, len(h)]))
            last = (h[-1], salt[-1], head[-1])
            keep = (~new & (head != i)) | (new & (salt > 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(head[keep]), pa.array(i[keep])], ["h", "a", "b"])
    stars = written(regions.repartition("h", "salt").sortWithinPartitions("h", "salt", "id")
                    .mapInArrow(run, "h long, a long, b long"), "stars")
    heads = stars.where("a = b").select("h", "a")
    tops = heads.groupBy("h").agg(F.min("a").alias("top"))
    return stars.where("a != b").unionByName(heads.join(tops, "h").where("a != top").select("h", F.col("top").alias("a"), F.col("a").alias("b")))


def _linked(pairs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.  Each text b travels to its a; many b are dealt to several copies of a."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    asked = pairs.join(groups, "a").select("a", F.expr("pmod(xxhash64(b), salts)").alias("salt"), F.col("b").alias("id"))
    firsts = asked.select("a", "salt", F.col("a").alias("id")).distinct()
    rows = (asked.unionByName(firsts).join(texts_of.withColumnRenamed("doc_id", "id"), "id")
            .select("a", "salt", "id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.expr("id != a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, np.empty(0, np.uint64)
        for batch in slices(batches, 8 << 20):
            out = []
            for a, i, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                s = shingles(t)
                if i == a:
                    own, held = a, s
                    continue
                if own != a:
                    raise ValueError("a comparison group without its first text")
                if 100 * min(len(s), len(held)) >= PERCENT * max(len(s), len(held)):
                    common = len(np.intersect1d(s, held, assume_unique=True))
                    if 100 * common >= PERCENT * (len(s) + len(held) - common):
                        out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    return written(rows.mapInArrow(run, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id reachable (comp), for every id of an edge; labels spread and jump."""
    arcs = written(edges.union(edges.select("b", "a")).distinct(), "arcs")
    at = written(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "comp")
    while True:
        near = arcs.join(at, arcs["b"] == at["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = at.join(near, at["id"] == near["a"]).select("id", F.least("comp", "m").alias("new"), F.col("comp").alias("old"))
        jump = at.select(F.col("id").alias("j"), F.col("comp").alias("jc"))
        new = written(step.join(jump, F.col("new") == F.col("j")).select("id", F.least("new", "jc").alias("comp"), "old"), "comp")
        if new.where("comp < old").isEmpty():
            return new.select("id", "comp")
        at = new.select("id", "comp")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are still in different components."""
    ca, cb = (comp.select(F.col("id").alias(x), F.col("comp").alias("c" + x)) for x in ("a", "b"))
    return written(pairs.join(ca, "a", "left").join(cb, "b", "left")
                   .where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "apart")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row with a doc_id."""
    docs = texts(docs).where("doc_id is not null")
    scan = written(_scan(docs), "scan")
    sets = scan.where("doc_id is not null").select("doc_id", "n", "digest")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    copies = written(sets.join(classes.where("copies > 1").select("digest", "id"), "digest").where("doc_id != id")
                     .groupBy("doc_id").agg(F.min("id").alias("id")), "copies")
    hot = _hot(scan.where("part is not null").select("part", "gaps"))
    stars = _stars(_regions(docs, hot))
    for end in ("a", "b"):
        of = copies.select(F.col("doc_id").alias(end), F.col("id").alias("own"))
        stars = stars.join(of, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    stars = written(stars.where("a != b").select("h", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "class_stars")
    pairs = written(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shapes = scan.where("n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "sketch")).alias("s")).select("doc_id", "s.*")
    shapes = written(shapes.join(ids, "doc_id", "left_semi"), "shapes")
    reps = written(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidates")
    shape_a, shape_b = (shapes.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in ("a", "b"))
    pairs = written(pairs.join(shape_a, "a").join(shape_b, "b").where(_reach()).select("a", "b", "n"), "alike")
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select("m.a", "b")
    links = _linked(best, reps)
    comp = components(links)
    links = links.unionByName(_linked(_apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), comp), reps))
    comp = components(links)
    # what is still apart within a region
    members = (stars.select("h", F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left")
               .select("h", "id", F.coalesce("comp", "id").alias("comp")))
    mixed = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    open_ = written(members.join(mixed, "h", "left_semi").join(shapes.withColumnRenamed("doc_id", "id"), "id"), "open")
    band = F.floor(F.log("n") / float(np.log(BAND)))
    x = open_.select("h", band.alias("band"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = open_.select("h", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("id").alias("b"),
                     F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rest = written(x.join(y, ["h", "band"]).where(f"a < b and ca != cb and {_reach()}").select("a", "b").distinct()
                   .join(pairs, ["a", "b"], "left_anti"), "rest")
    comp = components(links.unionByName(_linked(rest, reps)))
    label = classes.join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("component_id"))
    return (sets.join(label, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
