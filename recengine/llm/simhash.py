"""SimHash with permuted block tables; DataFrame functions only.

Terms are five-word shingles (fewer words: the whole sequence); a term's weight is the length of its
middle word, at most 8.  The 64 bits of a term's hash vote with its weight: lane ``j`` of 32 sums
holds bits ``j`` and ``j + 32`` in 32 bits each, which no text under 2 GB can overflow.

Documents are dealt to ranges of doc_id, so that the next document is a window ``lead``; texts are
shuffled once.  For the search, a fingerprint is cut into six blocks; two fingerprints that differ in at
most three bits agree on three of the blocks, so twenty tables keyed by three blocks find them all.

Defined cases: a null or empty text has the fingerprint 0; equal texts have equal fingerprints;
repeated rows are documents of their own, ordered by (doc_id, text); one document is its own next;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.llm.common import texts
from recengine.session import written

SHINGLE, MAX_WEIGHT, RADIUS = 5, 8, 3
DOCS_PER_RANGE, MAX_RANGES = 4096, 10_000
LANES = 32
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def words_of(text: Column) -> Column:
    """The lower-cased words; null for a blank text."""
    found = F.split(F.regexp_replace(F.lower(text), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+")
    return F.when(F.element_at(found, 1) != "", found)


def terms(texts_of: DataFrame, *keys: str) -> DataFrame:
    """``keys``, h and w: one row for every term of the column ``words`` (a blank text: one of weight 0).

    The terms are exploded by place and hashed from the words' column, so that a text is split once."""
    long = F.size("words") >= SHINGLE
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    each = texts_of.select(*keys, "words", F.explode_outer(F.when(F.col("words").isNotNull(), F.sequence(F.lit(0), last))).alias("i"))
    return each.select(
        *keys,
        F.when(long, F.xxhash64(*[F.get("words", F.col("i") + k) for k in range(SHINGLE)]))
         .when(F.col("words").isNotNull(), F.xxhash64("words")).otherwise(0).alias("h"),
        F.when(long, F.least(F.length(F.get("words", F.col("i") + 2)), F.lit(MAX_WEIGHT)))
         .when(F.col("words").isNotNull(), F.lit(1)).otherwise(0).cast("bigint").alias("w"))


def _votes() -> list[Column]:
    lane = F.lit((1 << 32) + 1)
    return [F.sum(F.col("w") * F.shiftrightunsigned("h", j).bitwiseAND(lane)).alias(f"v{j}") for j in range(LANES)]


def _fingerprint() -> Column:
    """The bits whose yes votes outweigh the no votes."""
    out = F.lit(0).cast("bigint")
    for j in range(LANES):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{j}", 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")) * F.lit(1 << j))
        out = out.bitwiseOR(F.shiftleft(F.when(high * 2 > F.col("total"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")), j + 32))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the differing bits estimate, at least 0."""
    bits = F.bit_count(a.bitwiseXOR(b))
    return F.when(bits == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(bits * F.lit(3.141592653589793 / 64))))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _range_of(docs: DataFrame) -> tuple[Column, int]:
    n = docs.count()
    ranges = min(MAX_RANGES, -(-n // DOCS_PER_RANGE) or 1)
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or [])) if ranges > 1 else []
    if not bounds:
        return F.lit(0), 1
    below = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(below, lambda b: b < F.col("doc_id"))), len(bounds) + 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (longs)."""
    docs = texts(docs)
    part, _ = _range_of(docs)
    # a null doc_id comes first
    docs = docs.withColumns({"part": part, "o": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    # one row per range
    firsts = docs.groupBy("part").agg(F.min("o").alias("first_id"))
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.first("first_id").over(ring)).alias("next_id"))
    next_text = (docs.select("o", "text").join(F.broadcast(after.select("next_id").distinct()), F.col("o") == F.col("next_id"))
                 .groupBy("next_id").agg(F.min("text").alias("next_text")))
    heads = after.join(next_text, "next_id").select(F.col("part").alias("p"), "next_text")
    in_part = Window.partitionBy("part").orderBy("o", "text")
    rows = docs.select("*", F.row_number().over(in_part).alias("rn"), F.lead("text").over(in_part).alias("following"))
    rows = rows.join(heads, (F.col("part") == F.col("p")) & F.col("following").isNull(), "left")
    nxt = F.coalesce("following", "next_text", F.lit(""))
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.select("part", "rn", "doc_id", n.cast("bigint").alias("n_chars"), "text",
                       F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(nxt, F.lit(1), k)).alias("edited"))
    both = rows.select("part", "rn", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                                         F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    keys = ["part", "rn", "doc_id", "n_chars", "edited_sha256"]
    split = both.select(*keys, "x.kind", words_of(F.col("x.t")).alias("words"))
    voted = (terms(split, *keys, "kind")
             .groupBy(*keys, "kind").agg(F.sum("w").alias("total"), *_votes())
             .select(*keys, "kind", _fingerprint().alias("fp"))
             .groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
                                 F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")))
    voted = written(voted, "simhash")
    heads = voted.where("rn = 1").select("part", F.col("fp").alias("head"))
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(ring)).alias("head"))
    lead = F.lead("fp").over(Window.partitionBy("part").orderBy("rn"))
    return (voted.withColumn("following", lead).join(F.broadcast(heads), F.col("part") == F.col("p"))
            .select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("following", "head").alias("next_fp")))


def _masks() -> list[int]:
    return [((1 << n) - 1) << at for at, n in BLOCKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (qfp, fp) of distinct fingerprints at most ``radius`` (up to 3) bits apart, each once."""
    if not 0 <= radius <= 3:
        raise ValueError("six blocks, three of them equal, cover a radius of at most 3")
    masks = _masks()
    tables = list(itertools.combinations(range(6), 3))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(sum(1 << i for i in t)).alias("tab"), F.col(name).bitwiseAND(F.lit(_signed(sum(masks[i] for i in t)))).alias("key")) for t in tables]
        return df.select(name, F.explode(F.array(*keys)).alias("k")).select(name, "k.*")

    a, b = keyed(queries.select("qfp").distinct(), "qfp"), keyed(fps.select("fp").distinct(), "fp")
    x = F.col("qfp").bitwiseXOR(F.col("fp"))
    same = sum((F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    one = same.bitwiseAND(-same)
    rest = same - one
    two = rest.bitwiseAND(-rest)
    left = rest - two
    # the first table whose blocks agree reports the pair
    return (a.join(b, (a["tab"] == b["tab"]) & (a["key"] == b["key"]) & (F.bit_count(x) <= radius)
                   & (a["tab"] == one + two + left.bitwiseAND(-left))).select("qfp", "fp"))


def simhash(docs: DataFrame, radius: int = RADIUS, query_every: int = 100) -> DataFrame:
    """Fingerprints, likenesses, and for rows whose doc_id is divisible by ``query_every`` the number of
    other rows within ``radius`` bits (``n_near``; else null)."""
    fps = written(fingerprints(docs), "fingerprints")
    asked = fps.where(F.col("doc_id") % query_every == 0).select(F.col("fp").alias("qfp"))
    counts = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    near = within_radius(asked, fps, radius).join(counts, "fp").groupBy("qfp").agg((F.sum("n") - 1).alias("n_near"))
    out = fps.join(near, F.col("fp") == F.col("qfp"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"),
                      hexed(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
                      F.when(F.col("doc_id") % query_every == 0, F.col("n_near")).alias("n_near"))
