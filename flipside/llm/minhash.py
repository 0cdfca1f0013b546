"""Near-duplicate detection with circulant MinHash and exact confirmation.

Each document's distinct word shingles are hashed; a first permutation scatters the hashes over 32 bits, and
coordinate k of the signature is the least value of a second permutation after a circular shift by k. Rows
of coordinates make bands; documents that share a band are candidates (32 bands of 5 rows miss a pair of
similarity 0.85 once in 10^8). Links are confirmed on full shingle sets.

Groups of any size stay cheap without dropping a link. Equal sets collapse to their smallest id before
banding. Shingles that no other bucketed document has bound what a document can share: texts that have a
passage in common but little else, or copies far from the original, drop out without a comparison. In a bucket every
member is compared with the one that meets the most others, its leader, so that a group of copies costs one
comparison a member; what is then connected is one class. Only members of different classes in a bucket are
compared further, and only where a link is possible by what they share with the leader and beyond it.

Defined cases: a text without words has an empty set and is linked with nothing; one with fewer words than a
shingle has its whole sequence as one; rows that share an id are one document and get a row each; an empty
table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from flipside.llm.common import map_arrow, raw_texts, stored

_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(batch_texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``words`` words; A-Z are lower-cased
    and white space is [\\x20\\x09-\\x0D]."""
    split = [t.lower().split() for t in batch_texts]
    numbers = {w: i for i, w in enumerate(set().union(*split))}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    out = []
    for text in split:
        n = len(text)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        own = hashes[np.fromiter(map(numbers.__getitem__, text), np.int64, n)]
        size = min(words, n)
        rolled = np.full(n - size + 1, size, np.uint64)
        for at in range(size):
            rolled = rolled * _ROLL + own[at:at + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
        out.append(np.unique(rolled * np.uint64(0xBF58476D1CE4E5B9)))
    return out


def _permute(x: np.ndarray, spare: np.ndarray, first: int, second: int) -> np.ndarray:
    """A fixed permutation of the 32-bit integers, in place."""
    for shift, factor in ((16, first), (15, second), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def signatures(sets: list[np.ndarray], coordinates: int, together: int = 1 << 15) -> np.ndarray:
    """A row of ``coordinates`` values for each set, none of them empty."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    parts = [(row, s[at:at + together]) for row, s in enumerate(sets) for at in range(0, len(s), together)]
    start = 0
    while start < len(parts):
        end, size = start, 0
        while end < len(parts) and (end == start or size + len(parts[end][1]) <= together):
            size += len(parts[end][1])
            end += 1
        some = parts[start:end]
        rows = np.array([row for row, _ in some])
        starts = np.cumsum([0] + [len(s) for _, s in some[:-1]])
        joined = np.concatenate([s for _, s in some])
        scattered = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
        spare, shifted = np.empty_like(scattered), np.empty_like(scattered)
        _permute(scattered, spare, 0x21F0AAAD, 0xD35A2D97)
        for k in range(coordinates):
            np.subtract(scattered, np.uint32(k), out=shifted)
            _permute(shifted, spare, 0x7FEB352D, 0x846CA68B)
            np.minimum.at(out[:, k], rows, np.minimum.reduceat(shifted, starts))
        start = end
    return out


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band, its number included."""
    values = found.reshape(len(found), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2]).copy()
    for at in range(rows):
        keys = (keys ^ values[:, :, at]) * np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles, digest_size=16).digest() if len(shingles) else None


def _sign(words: int, bands: int, rows: int):
    def step(batch):
        sets = shingle_sets(raw_texts(batch, "text"), words)
        full = [s for s in sets if len(s)]
        keys = iter(band_keys(signatures(full, bands * rows), bands, rows) if full else ())
        return {"id": batch["id"], "n": [len(s) for s in sets], "digest": [_digest(s) for s in sets],
                "bands": [next(keys) if len(s) else None for s in sets]}

    return step


def _sets(words: int):
    def step(batch):
        sets = shingle_sets(raw_texts(batch, "text"), words)
        return {"digest": [_digest(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    return step


def _lists(column) -> list[np.ndarray]:
    flat = column.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def _count():
    def step(batch):
        shared = []
        for a, b in zip(_lists(batch["one"]), _lists(batch["other"])):
            at = np.searchsorted(a, b)
            shared.append(int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)))
        return {c: batch[c] for c in batch.schema.names if c not in ("one", "other")} | {"shared": shared}

    return step


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the number of shingles that a and b share, counted on full sets. The side with many partners
    joins last, in wide rows, which adaptive skew joins can split."""
    wide = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("other")), "b")
    wide = wide.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("one")), "a")
    schema = StructType([*wide.drop("one", "other").schema.fields]).add("shared", LongType())
    return map_arrow(wide, schema, _count)


def linked(percent: int):
    return 100 * F.col("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))


def covered(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``members`` with m, the number of their shingles that another member has too, without those that can't be
    similar enough to any other for it."""
    alone = sets.select("doc", F.explode("shingles").alias("shingle"))
    alone = alone.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("doc").alias("doc")).where("docs = 1")
    alone = alone.groupBy("doc").agg(F.count("*").alias("alone"))
    out = members.join(alone, "doc", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return out.where(100 * F.col("m") >= percent * F.col("n"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): alternating large and small stars until nothing changes."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.selectExpr("u AS node", "v AS component").union(edges.selectExpr("v", "v").distinct())
        mark = seen
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").where("u <> v").distinct(), "edges")


def _worth(percent: int, most):
    """Whether a pair that shares at most ``most`` shingles can be similar enough."""
    return (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85,
                    bands: int = 32, rows: int = 5) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = stored(map_arrow(docs, f"id {kind}, n long, digest binary, bands array<long>", _sign, words, bands, rows), "signatures")
    sets = signed.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = stored(sets.withColumn("doc", F.xxhash64("digest")), "distinct-sets")

    banded = sets.select("doc", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    met = stored(banded.join(shared, "key"), "met")
    members = sets.select("doc", "id", "n").join(met.select("doc").distinct(), "doc", "left_semi")
    # the ids' side is slim: hashed at any size, so that no text is sorted
    full = map_arrow(docs.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"),
                     "digest binary, shingles array<long>", _sets, words).withColumn("doc", F.xxhash64("digest"))
    full = stored(full.join(members.select("doc"), "doc", "left_semi").dropDuplicates(["doc"]).select("doc", "shingles"), "shingle-sets")

    buckets = stored(met.join(covered(full, members, percent), "doc"), "buckets")
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = buckets.join(shared, "key")

    side = lambda name: [F.col(x).alias(f"{name}_{x}".removesuffix("_doc")) for x in ("doc", "id", "n", "m")]
    popular = buckets.groupBy("doc").agg(F.sum("size").alias("met"))
    leaders = buckets.join(popular, "doc").groupBy("key").agg(F.max(F.struct("met", "doc", "id", "n", "m")).alias("top"))
    leaders = leaders.select("key", "top.*").select("key", *side("a"))
    stars = buckets.join(leaders, "key").where("doc <> a").select("a", "a_id", "a_n", "a_m", *side("b"))
    stars = stars.where(_worth(percent, F.least("a_m", "b_m"))).distinct()
    stars = stored(compared(stars.select("a", "b", "a_id", "b_id", "a_n", "b_n"), full), "stars")
    links = stars.where(linked(percent)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    classes = components(links)

    # what a member shares with its bucket's leader bounds what two members share: in the leader, and beyond it
    placed = buckets.join(leaders.select("key", "a"), "key")
    placed = placed.join(stars.select("a", F.col("b").alias("doc"), "shared"), ["a", "doc"], "left")
    placed = placed.withColumn("s", F.when(F.col("a") == F.col("doc"), F.col("n")).otherwise(F.col("shared")))
    placed = placed.join(classes.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("key", "doc", "id", "n", "m", "s", F.coalesce("component", "id").alias("class"))
    mixed = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    rest = stored(placed.join(mixed, "key"), "mixed")
    one, other = (rest.select("key", *side(x), F.col("s").alias(f"{x}_s"), F.col("class").alias(f"{x}_class")) for x in "ab")
    least = lambda x: F.least(f"a_{x}", f"b_{x}")
    beyond = F.least(F.col("a_m") - F.col("a_s"), F.col("b_m") - F.col("b_s"))
    most = F.coalesce(F.when(F.col("a_s").isNotNull() & F.col("b_s").isNotNull(), least("s") + beyond), least("m"))
    able = (F.col("a_class") < F.col("b_class")) & _worth(percent, least("m")) & _worth(percent, most)
    pairs = one.join(other, (one["key"] == other["key"]) & able).select("a", "b", "a_id", "b_id", "a_n", "b_n").distinct()
    tested = stars.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(tested, ["low", "high"], "left_anti")
    more = stored(compared(pairs.drop("low", "high"), full).where(linked(percent)), "links")
    if not more.isEmpty():
        classes = components(links.union(more.select("a_id", "b_id")))

    named = signed.select("id", "n", "digest").join(sets.select("digest", F.col("id").alias("least")), "digest", "left")
    named = named.join(classes.withColumnRenamed("node", "least"), "least", "left")
    component = F.coalesce("component", "least", "id")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))
