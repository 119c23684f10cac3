"""Conversation prefixes by a z-fast trie.

A conversation is a string of turn digests; its prefix hashes (16 bytes a depth) are its ``path``.  The compacted
trie stands in a table of edges: an edge reaches from depth ``p`` (exclusive) to ``e`` and is found under its
handle, the prefix hash at the two-fattest number of (p, e].  Strings are inserted in batches of growing size.
A batch locates the exit node of each of its strings by fat binary search, one equi-join with the handles for
every halving, so with the logarithm of the longest conversation in joins; the exit edge's hashes give the exit
depth.  Of the strings of a batch that leave the trie at one place with the same next turn, one (by its hash) is
inserted as an edge and cuts the edge it leaves; the others come again with the next batch, where they exit
deeper.  A string is passed over about as often as the logarithm of their number, as the one inserted is drawn
at random.

Each inserted string keeps its chain: the strings it runs along and the depths where it leaves them.  Members,
leaves and saved bytes are summed at the ends of the chains and then from the bottom of each inserted string to its
top, and the edges are expanded to one row per depth.  Equal conversations are one string with a count.  Hot
prefixes are split: sums go through partial aggregates, and the joins on prefix hashes are sort-merge joins, whose
large partitions Spark splits.

A conversation's own turns (digests and sizes, not texts) are held together in one row; everything else is spread.
Ends are joined from pieces of at most 4,096 conversations and hashed piece by piece.

Defined cases: rows without a conv_id belong to no conversation; null role or text is empty; a null turn stands
first; rows with equal turns stand by the digest of role and text, and repeated rows are further turns; other
columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices
from recengine.session import written

W = 16  # bytes of a prefix hash
# of 64 shares of the distinct conversations, those that are in the trie after each batch
BATCHES = (1, 8, 64)
PIECE_BITS = 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, digests, sizes: the first h turns of the first conversation of its group, then its own after its first h;
    h = crc32 of the id's decimals modulo ``most``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = (conversations.where("conv_id is not null")
             .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.octet_length(text).cast("bigint").alias("size"),
                     F.unhex(F.md5(F.concat(F.md5(role), text))).alias("digest"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns")))
    first = turns.select(F.col("conv_id").alias("base"), F.col("turns").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    both = own.join(first, "base", "left").select("conv_id", F.concat(head, tail).alias("t"))
    return both.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


_PATHS = pa.schema([("conv_id", pa.int64()), ("n", pa.int32()), ("path", pa.binary()), ("tip", pa.binary()), ("sizes", pa.list_(pa.int64()))])


def with_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, n, path (hash of every prefix), tip (the last one; none: empty), sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in slices(batches, 8 << 20):
            paths, tips = [], []
            for digests in batch.column(1).to_pylist():
                h, path = b"", []
                for d in digests:
                    h = md5(h + d).digest()
                    path.append(h)
                paths.append(b"".join(path))
                tips.append(h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) // W for p in paths], pa.int32()), pa.array(paths, pa.binary()),
                 pa.array(tips, pa.binary()), batch.column(2).cast(pa.list_(pa.int64()))], schema=_PATHS)

    return conversations.select("conv_id", "digests", "sizes").mapInArrow(run, "conv_id long, n int, path binary, tip binary, sizes array<long>")


def _at(path: str | Column, depth: Column) -> Column:
    """Prefix hash at ``depth`` (from 1)."""
    return F.substring(path, (depth - 1) * W + 1, F.lit(W))


def fattest(a: Column, b: Column) -> Column:
    """Two-fattest number of (a, b]: the one that a largest power of two divides."""
    top = F.floor(F.log2(a.bitwiseXOR(b) + 0.5)).cast("int")
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1), top))


def edges_of(leaders: DataFrame, cuts: DataFrame) -> DataFrame:
    """The compacted trie: each inserted string's own part, cut at the depths where others leave it or end."""
    at = cuts.groupBy("leader").agg(F.collect_set("at").alias("ats"))
    pieces = (leaders.join(at, F.col("tip") == F.col("leader"), "left")
              .withColumn("ends", F.array_sort(F.array_union(F.coalesce("ats", F.array().cast("array<int>")), F.array("n"))))
              .select("tip", "path", "chain", F.explode(F.arrays_zip(
                  F.concat(F.array("top"), F.slice("ends", 1, F.size("ends") - 1)).alias("p"), F.col("ends").alias("e"))).alias("x"))
              .select(F.col("tip").alias("leader"), "path", "chain", "x.p", "x.e"))
    return pieces.select("leader", "chain", "p", "e", _at("path", F.col("p") + 1).alias("first"),
                         _at("path", fattest(F.col("p"), F.col("e"))).alias("handle"), _at("path", F.col("e")).alias("extent"),
                         F.substring("path", F.col("p") * W + 1, (F.col("e") - F.col("p")) * W).alias("edge"))


def locate(strings: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """tip, n, path, exit (depth where the string leaves the trie), chain (with the place of the exit; empty at the root),
    from strings (tip, n, path, lo) known to run to the node at depth ``lo``."""
    handles = edges.select(F.col("handle").alias("h_key"), F.col("p").alias("h_p"), F.col("e").alias("h_e"), F.col("extent").alias("h_extent"))
    # a key no handle has, spread over the partitions
    nowhere = F.concat(F.col("tip"), F.lit(b"\0"))
    df = strings.select("tip", "n", "path", "lo", F.col("n").alias("hi"))
    for _ in range(steps):
        df = df.withColumn("f", F.when(F.col("lo") < F.col("hi"), fattest(F.col("lo"), F.col("hi"))))
        df = df.withColumn("key", F.coalesce(_at("path", F.col("f")), nowhere)).join(handles, F.col("key") == F.col("h_key"), "left")
        found = F.col("h_e").isNotNull()
        inside = (F.col("h_e") <= F.col("n")) & (_at("path", F.col("h_e")) == F.col("h_extent"))
        df = df.select("tip", "n", "path", F.when(found, F.when(inside, F.col("h_e")).otherwise(F.col("h_p"))).otherwise(F.col("lo")).alias("lo"),
                       F.when(found, F.when(inside, F.col("hi")).otherwise(F.col("h_p")))
                       .otherwise(F.coalesce(F.col("f") - 1, F.col("hi"))).alias("hi"))
    children = edges.select(F.col("first").alias("c_key"), F.col("edge").alias("c_edge"), F.col("leader").alias("c_leader"), F.col("chain").alias("c_chain"))
    df = df.withColumn("key", F.when(F.col("lo") < F.col("n"), _at("path", F.col("lo") + 1)).otherwise(nowhere))
    df = df.join(children, F.col("key") == F.col("c_key"), "left")
    # the exit edge's hashes equal the string's to the exit depth; a node ends where another's edge begins, so one step at least
    both = F.least(F.col("n") - F.col("lo"), (F.octet_length("c_edge") / W).cast("int"))
    shared = F.size(F.filter(F.sequence(F.lit(1), both), lambda k: _at("c_edge", k) == _at("path", F.col("lo") + k)))
    df = df.withColumn("exit", F.col("lo") + F.when(F.col("c_key").isNull(), 0).otherwise(shared))
    nodes = edges.select(F.col("extent").alias("n_key"), F.col("leader").alias("n_leader"), F.col("chain").alias("n_chain"))
    df = df.withColumn("key", F.when(F.col("c_key").isNull() & (F.col("lo") > 0), _at("path", F.col("lo"))).otherwise(nowhere))
    df = df.join(nodes, F.col("key") == F.col("n_key"), "left")
    host, above = F.coalesce("c_leader", "n_leader"), F.coalesce("c_chain", "n_chain")
    here = F.array(F.struct(host.alias("leader"), F.col("exit").alias("at")))
    return df.select("tip", "n", "path", "exit", F.when(host.isNull(), F.array().cast(CHAIN)).otherwise(F.concat(above, here)).alias("chain"))


CHAIN = "array<struct<leader:binary,at:int>>"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def build(strings: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """tip, n, top, chain, inserted of every distinct string (tip, n, path; n > 0): ``inserted`` strings have edges of their own
    below depth ``top``, the others end on an edge or node of the last string of their chain."""
    spark = strings.sparkSession
    size = strings.agg(F.max("n")).first()[0]
    if not size:
        return spark.createDataFrame([], f"tip binary, n int, path binary, top int, chain {CHAIN}, inserted boolean")
    share = F.pmod(F.xxhash64("tip"), F.lit(64))
    remain, placed, cuts = None, [], []
    edges = spark.createDataFrame([], f"leader binary, chain {CHAIN}, p int, e int, first binary, handle binary, extent binary, edge binary")
    left, widest = 0, 0
    bounds = list(zip((0, *batches), batches))
    while bounds or left:
        if bounds:
            a, b = bounds.pop(0)
            fresh = strings.where((share >= a) & (share < b)).select("tip", "n", "path", F.lit(0).alias("lo"))
            remain, widest = (fresh if remain is None else remain.unionByName(fresh)), size
        steps = int(widest).bit_length() if placed else 0
        found = written(locate(remain, edges, steps), "located")
        new = found.where("exit < n")
        drawn = written(new.groupBy(_at("path", F.col("exit") + 1).alias("next")).agg(F.min("tip").alias("drawn")).select("drawn"), "drawn")
        inserted = new.join(drawn, F.col("tip") == F.col("drawn"), "left_semi").withColumn("inserted", F.lit(True))
        ended = found.where("exit = n").withColumn("inserted", F.lit(False))
        placed.append(written(inserted.unionByName(ended).select("tip", "n", "path", F.col("exit").alias("top"), "chain", "inserted"), "placed"))
        remain = written(new.join(drawn, F.col("tip") == F.col("drawn"), "left_anti").select("tip", "n", "path", F.col("exit").alias("lo")), "remain")
        left, widest = remain.agg(F.count(F.lit(1)), F.coalesce(F.max(F.col("lo").bitwiseXOR(F.col("n"))), F.lit(0))).first()
        if bounds or left:
            cuts.append(placed[-1].where("size(chain) > 0").select(F.element_at("chain", -1).alias("x")).select("x.leader", "x.at").distinct())
            edges = written(edges_of(_union(placed).where("inserted"), _union(cuts)), "edges")
    return _union(placed)


def _runs(places: DataFrame, *values: str) -> DataFrame:
    """Per inserted string the places on it, by depth: bounded by its length."""
    return places.groupBy("leader").agg(F.sort_array(F.collect_list(F.struct("at", *values))).alias("places"))


_SUMS = pa.schema([("leader", pa.binary()), ("leaf", pa.int64()), ("saved", pa.int64()), ("firsts", pa.list_(pa.int64()))])


def _own_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each inserted string (leader, top, n, sizes, places by depth): whether it ends in a leaf, the bytes its own nodes save,
    and the smallest member at each of its places."""
    for batch in batches:
        rows = []
        for leader, top, n, sizes, places in zip(*(c.to_pylist() for c in batch.columns)):
            at, convs, first, kids = (np.array([x[k] for x in places], np.int64) for k in ("at", "convs", "first", "kids"))
            members = np.cumsum(convs[::-1])[::-1]
            # depth d has the members of the first place at or below it
            on = np.searchsorted(at, np.arange(top + 1, n + 1))
            saved = int(((members[on] - 1) * np.array(sizes[top:], np.int64)).sum())
            rows.append((leader, int(kids[-1] == 0), saved, np.minimum.accumulate(first[::-1])[::-1].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)


_NODES = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
                   + [("key", pa.binary())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per depth of each inserted string's own part."""
    for batch in slices(batches, 1 << 20):
        parts: list[list] = [[] for _ in _NODES]
        for path, top, n, sizes, leaf, parent, places in zip(*(c.to_pylist() for c in batch.columns)):
            at, convs, first, kids, leaves, saved = (np.array([x[k] for x in places], np.int64) for k in ("at", "convs", "first", "kids", "leaves", "saved"))
            depth = np.arange(top + 1, n + 1)
            on = np.searchsorted(at, depth)
            members, lowest = np.cumsum(convs[::-1])[::-1][on], np.minimum.accumulate(first[::-1])[::-1][on]
            own = np.cumsum(((members - 1) * np.array(sizes[top:], np.int64))[::-1])[::-1]
            values = (lowest, depth, np.concatenate([[parent], lowest[:-1]]), members, np.where(at[on] == depth, kids[on] + (depth < n), 1),
                      np.cumsum(leaves[::-1])[::-1][on] + leaf, own + np.cumsum(saved[::-1])[::-1][on])
            for k, v in enumerate(values):
                parts[k].append(v)
            parts[-1] += [path[W * (d - 1):W * d] for d in range(top + 1, n + 1)]
        if parts[0]:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(p), pa.int64()) for p in parts[:-1]), pa.array(parts[-1], pa.binary())], schema=_NODES)


def end_hashes(members: DataFrame) -> DataFrame:
    """tip, ends_sha256: SHA-256 of the comma-joined ids, in order, of the conversations with each tip."""
    pieces = (members.groupBy("tip", F.shiftright("conv_id", PIECE_BITS).alias("piece"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tip, sha = None, None
        for batch in batches:
            tips, shas = [], []
            for t, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t == tip:
                    sha.update(b"," + ids.encode())
                    continue
                if tip is not None:
                    tips.append(tip)
                    shas.append(sha.hexdigest())
                tip, sha = t, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(tips, pa.binary()), pa.array(shas, pa.string())], ["tip", "ends_sha256"])
        if tip is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tip], pa.binary()), pa.array([sha.hexdigest()])], ["tip", "ends_sha256"])

    return (pieces.repartition("tip").sortWithinPartitions("tip", "piece").select("tip", "ids")
            .mapInArrow(run, "tip binary, ends_sha256 string"))


def prefix_nodes(conversations: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with the textless root: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    members = written(with_paths(rebuilt(conversations)), "paths")
    strings = written(members.groupBy("tip").agg(F.first("n").alias("n"), F.first("path").alias("path"), F.first("sizes").alias("sizes"),
                                                 F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("copies")), "strings")
    trie = build(strings.where("n > 0").select("tip", "n", "path"), batches)
    trie = written(trie.join(strings.select("tip", "sizes", "first", "copies"), "tip"), "trie")

    own = F.when(F.col("inserted"), F.array(F.struct(F.col("tip").alias("leader"), F.col("n").alias("at")))).otherwise(F.array().cast(CHAIN))
    stops = trie.select("copies", "first", "inserted", F.size("chain").alias("last"), F.posexplode(F.concat("chain", own)).alias("k", "x"))
    child = F.col("inserted") & (F.col("k") == F.col("last") - 1)
    places = stops.groupBy("x.leader", "x.at").agg(F.sum("copies").alias("convs"), F.min("first").alias("first"),
                                                   F.sum(child.cast("bigint")).alias("kids"))
    places = written(places, "places")
    inserted = trie.where("inserted").select(F.col("tip").alias("leader"), "path", "top", "n", "sizes", "chain")
    sums = (inserted.select("leader", "top", "n", "sizes").join(_runs(places, "convs", "first", "kids"), "leader")
            .mapInArrow(_own_sums, "leader binary, leaf long, saved long, firsts array<long>"))
    sums = written(sums, "sums")
    below = (inserted.select("leader", "chain").join(sums.select("leader", "leaf", "saved"), "leader")
             .select("leaf", "saved", F.explode("chain").alias("x"))
             .groupBy("x.leader", "x.at").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")))
    zero = F.lit(0).cast("bigint")
    places = (places.join(below, ["leader", "at"], "left")
              .select("leader", "at", "convs", "first", "kids", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved")))
    runs = _runs(places, "convs", "first", "kids", "leaves", "saved")
    # the parent of a string's first own node is a place of the last string of its chain, or the root
    lowest = (runs.join(sums.select("leader", "firsts"), "leader").select("leader", F.explode(F.arrays_zip(F.col("places.at").alias("at"), "firsts")).alias("x"))
              .select(F.col("leader").alias("up"), F.col("x.at").alias("up_at"), F.col("x.firsts").alias("parent")))
    root_id = members.agg(F.min("conv_id")).first()[0]
    root_col = F.lit(root_id).cast("bigint")
    up = F.try_element_at("chain", F.lit(-1))
    tops = inserted.withColumn("up", F.coalesce(up["leader"], F.concat("leader", F.lit(b"\0")))).withColumn("up_at", up["at"])
    tops = tops.join(lowest, ["up", "up_at"], "left").withColumn("parent", F.coalesce("parent", root_col))
    wide = (tops.join(sums.select("leader", "leaf"), "leader").join(runs, "leader")
            .select("path", "top", "n", "sizes", "leaf", "parent", "places"))
    nodes = wide.mapInArrow(_expand, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary")
    total = inserted.select("leader", "top").join(sums.select("leader", "leaf", "saved"), "leader").agg(
        F.coalesce(F.sum((F.col("top") == 0).cast("bigint")), zero).alias("n_children"),
        F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    count = members.count()
    root = (total.where(F.lit(count > 0)).select(root_col.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
                                                 F.lit(count).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(b"").alias("key")))
    ends = end_hashes(members.select("tip", "conv_id"))
    return (nodes.unionByName(root).join(ends, F.col("key") == F.col("tip"), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
