"""N-gram Jaccard join: an exact self-join of documents in the metric space of word shingle sets.

Jaccard distance is a metric, and at a radius ``r = 1 - threshold`` the join keeps to small regions of it:

1. Documents with one shingle set are one point of the space.  Two points within the radius meet in some of the first
   shingles of each, in the common order of their hashes (``first_look``); points that meet others in fewer are linked
   with nothing, and only the others' whole sets are looked at.
2. Every shingle is a pivot (the set that holds it alone).  A point lies in the Voronoi region of its rarest
   shingle, and the window that the radius allows replicates it into the regions of its next rarest ones: two
   points within ``r`` differ in so few shingles that they meet in one of the first ``n - ceil(threshold n) + 1``
   regions of each, in the common order by corpus frequency.  Only shingles that two points share matter, so most
   points have no region with company and drop out.
3. The most central point of a region is its pivot, and the other points are measured against it; those within
   ``r`` are linked to it, and hence to one another.  Of the rest, two points have to be compared only if they are
   not yet connected, if the order of their shingles lets them share enough, and if the triangle inequality does:
   ``|d(x, pivot) - d(y, pivot)| <= r`` for every pivot that both are measured against.  A region with few such
   pairs is joined outright, a larger one goes on with further pivots in the same way.
4. The links' connected components are the classes.

No group of copies is expanded into pairs: exact copies are one point, and near copies are linked as stars.  Shingles
are dealt over buckets by hash, and a bucket is read as a stream against the distinct shingles in it, so that one
which very many documents hold takes no more memory than others.  Sets are compared by 64-bit digests of words'
digests, of which 58 bits are kept: sets are equal, and their sizes right, but for collisions of these.

Nulls and ties: a null text is an empty one.  Empty texts, and texts of white space, have no shingles and link with
nothing; each is its own class.  Rows with a null doc_id count as documents but name no class: they take the class
of their copies, or null.  Repeated rows are returned as often as they come.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WordHash, batches, bucketed_table, free_name, id_and_text, maybe_among, mix, salted_lookup, shingles, small
from ridgeline.operators.components import connected_components
from ridgeline.shared import drop_table, release, shuffle_partitions, stage_table

#: Percentage of a set's shingles, beyond those that a set within the radius may lack, that the first look takes.
LOOK = 15
#: Shingles that one block of the index holds before it is dealt over the buckets.
BLOCK = 1_000_000
#: Regions with at most this many pairs of points in different components are joined outright.
LEAF_PAIRS = 1_000_000
#: Pivots that a larger region takes in each further round.
PIVOTS = 64

_POINTS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])
_INDEX = pa.schema([("bucket", pa.int32()), ("sids", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()), ("grams", pa.binary())])
#: Bits of a shingle's digest beside the six of its frequency's order.
_GRAM_BITS = 58


def _versioned(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("version", F.xxhash64("text"))


def shingle_points(docs: DataFrame, k: int = 5) -> DataFrame:
    """``(doc_id, version, n, sid)``: a hash of the text, and size and digest of its shingle set; sid is null if empty."""
    words = WordHash()

    def points(ids: list, versions: list, texts: list) -> list:
        sizes, sids = [], []
        for text in texts:
            words.trim()
            s = shingles(words.of(text.encode().lower().split()), k)
            sizes.append(len(s))
            sids.append(_sid(s) if len(s) else None)
        return [ids, versions, sizes, sids]

    return _versioned(docs).mapInArrow(batches(points, ["doc_id", "version", "text"], _POINTS), "doc_id long, version long, n long, sid long")


def _sid(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def first_look(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's first shingles are looked at, and how many of them others must have been looked at for, too.

    Two sets within the radius share at least ``ceil(percent n / 100)`` shingles, n being the larger size.  If each
    looks at as many as it may lack of these and ``l`` more, they meet in ``l``: the one whose look ends earlier in
    the order lacks no more than it may.  ``l`` is a share of n, and the smallest set within the radius has the least.
    """
    least = -(-percent * n // 100)
    more = lambda size: 1 + LOOK * size // 100
    return min(n, n - least + more(n)), more(least)


def _index_blocks(k: int, buckets: int, percent: int | None = None):
    """Blocks of distinct sets, dealt over hash buckets: few bytes a shingle instead of a row each.

    With ``percent``, only the first shingles of each set in the order of their hashes, 4 bytes each, which is enough to
    tell where little is shared.  Else whole sets, 8 bytes each.
    """
    width = 8 if percent is None else 4

    def deal(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        sizes = np.fromiter((len(s) for s in sets.values()), dtype=np.uint32, count=len(sets))
        sids = np.fromiter(sets, dtype=np.int64, count=len(sets))
        # The first of sorted hashes are small numbers: dealt by another hash of theirs.
        grams = mix(np.concatenate(list(sets.values())))
        owner = np.repeat(np.arange(len(sets)), sizes)
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order].astype(np.int64), owner[order]
        packed = grams[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        out: list[list] = [[], [], [], [], []]
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                who, held = np.unique(owner[lo:hi], return_counts=True)
                cells = (b, sids[who].tobytes(), sizes[who].tobytes(), held.astype(np.uint32).tobytes(), packed[lo:hi].tobytes())
                for column, cell in zip(out, cells, strict=True):
                    column.append(cell)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _INDEX, strict=True)], schema=_INDEX)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sets, held = WordHash(), {}, 0
        for batch in small(it):
            for text in batch.column(0).to_pylist():
                words.trim()
                s = shingles(words.of(text.encode().lower().split()), k)
                if len(s) and (sid := _sid(s)) not in sets:
                    sets[sid] = s if percent is None else s[: first_look(len(s), percent)[0]]
                    held += len(sets[sid])
                if held >= BLOCK:
                    yield deal(sets)
                    sets, held = {}, 0
        if sets:
            yield deal(sets)

    return run


def _entries(cells: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, set and set size of each entry of a dealt row."""
    held = np.frombuffer(cells["held"], np.uint32)
    each = lambda key, kind: np.repeat(np.frombuffer(cells[key], kind), held)
    return np.frombuffer(cells["grams"], f"<u{width}"), each("sids", np.int64), each("sizes", np.uint32)


class _Bucket:
    """The distinct shingles of a bucket: the first set met with each, and how many sets."""

    def __init__(self) -> None:
        self.grams, self.first, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes entries in; returns the sets of which a shingle is newly known to be in another set, and how many are."""
        old = len(self.grams)
        grams, sids = np.r_[self.grams, grams.astype(np.uint64)], np.r_[self.first, sids]
        many = np.r_[self.df, np.ones(len(grams) - old, np.int64)]
        order = np.lexsort((np.arange(len(grams)) >= old, grams))  # what was met before comes first
        grams, sids, many, fresh = grams[order], sids[order], many[order], order >= old
        start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        lead = np.repeat(start, np.diff(np.r_[start, len(grams)]))
        other = fresh & (sids != sids[lead])  # one set may come from several blocks
        shares = other.copy()
        shares[lead[other]] = True
        shares &= fresh | (many == 1)
        self.grams, self.first = grams[start], sids[start]
        self.df = many[start] + (np.add.reduceat(other, start) if len(start) else 0)
        return np.unique(sids[shares], return_counts=True)


def _streams(width: int, close, step=lambda found: None):
    """A mapInArrow function over rows sorted by bucket; ``close`` makes a batch of a full bucket, ``step`` of what shares."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, waiting, size = None, _Bucket(), [], 0

        def take():
            grams, sids = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            return step(bucket.add(grams, sids))

        for batch in it:
            for i in range(batch.num_rows):
                cells = batch.slice(i, 1).to_pylist()[0]
                if waiting and (cells["bucket"] != now or size >= BLOCK):
                    size = 0
                    if (out := take()) is not None:
                        yield out
                if cells["bucket"] != now:
                    if now is not None and (out := close(now, bucket)) is not None:
                        yield out
                    now, bucket = cells["bucket"], _Bucket()
                waiting.append(_entries(cells, width)[:2])
                size += len(waiting[-1][0])
        if waiting and (out := take()) is not None:
            yield out
        if now is not None and (out := close(now, bucket)) is not None:
            yield out

    return run


def _deals(texts: DataFrame, k: int, percent: int | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(_index_blocks(k, shuffle_partitions(texts.sparkSession), percent), "bucket int, sids binary, sizes binary, held binary, grams binary")


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), "bucket").sortWithinPartitions("bucket")


def possible_texts(docs: DataFrame, points: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """``(text)`` for one document of each set that meets others in as many of its first shingles as it must."""
    found = lambda met: pa.RecordBatch.from_arrays([pa.array(c) for c in met], names=["sid", "met"]) if len(met[0]) else None
    rows = _sorted(_deals(_versioned(docs), k, percent))
    met = rows.mapInArrow(_streams(4, lambda *_: None, found), "sid long, met long").groupBy("sid").agg(F.sum("met").alias("met"))
    one = points.join(met, "sid").where(f"met > div({LOOK} * div({percent} * n + 99, 100), 100)").groupBy("sid").agg(F.min(F.struct("doc_id", "version")).alias("d"))
    one = stage_table(one.select(F.xxhash64("d.doc_id", "d.version").alias("key")), "possible")
    release(docs.sparkSession)
    return maybe_among(_versioned(docs).withColumn("key", F.xxhash64("doc_id", "version")), one, "key").select("text")


def shared_shingles(texts: DataFrame, k: int = 5) -> DataFrame:
    """``(sid, n, gram)``: of each distinct set the shingles that another set holds too.

    Grams sort by the order of magnitude of the number of sets that hold them, then by hash.
    """

    def table(bucket: int, b: _Bucket) -> pa.RecordBatch | None:
        keep = b.df > 1
        if not keep.any():
            return None
        order = np.floor(np.log2(b.df[keep])).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([b.grams[keep].astype("<u8").tobytes()]), pa.array([order.tobytes()])], names=["bucket", "shared", "orders"])

    def look_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it, 1):
            cells = batch.to_pylist()[0]
            grams, sids, sizes = _entries(cells, 8)
            shared, orders = np.frombuffer(cells["shared"], "<u8"), np.frombuffer(cells["orders"], np.uint8)
            at = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)
            hit = np.flatnonzero(shared[at] == grams)
            ids = (orders[at[hit]].astype(np.uint64) << np.uint64(_GRAM_BITS) | grams[hit] >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sids[hit]), pa.array(sizes[hit].astype(np.int64)), pa.array(ids)], names=["sid", "n", "gram"])

    tables = stage_table(_sorted(_deals(texts, k)).mapInArrow(_streams(8, table), "bucket int, shared binary, orders binary"), "shared-shingles")
    release(texts.sparkSession)
    return _deals(texts, k).join(tables, "bucket").mapInArrow(look_up, "sid long, n long, gram long")


def jaccard_links(docs: DataFrame, points: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """``(a, b)``: links between distinct shingle sets that connect every two sets within the radius.

    All pairs are linked directly or through others that are linked; no link joins sets beyond the radius.
    """
    sets = (
        shared_shingles(possible_texts(docs, points, percent, k), k)
        .groupBy("sid", "n")
        .agg(F.array_sort(F.collect_set("gram")).alias("grams"))
        # Shingles that no other set holds come first in the order, and their regions have no company.
        .withColumn("alone", F.expr("n - size(grams)"))
        .withColumn("reach", F.expr(f"cast(n - div({percent} * n + 99, 100) + 1 - alone as int)"))
        .where("reach > 0")
    )
    sets = bucketed_table(sets, "shingle_sets", "sid")
    release(docs.sparkSession)
    held = sets.select("sid", "n", "alone", F.posexplode(F.slice("grams", F.lit(1), F.col("reach"))).alias("i", "rid"))
    regions = held.select("rid", "sid", "n", F.expr("n - alone - i").alias("rest"), F.expr("alone / n").alias("c"))
    # Many shingles have the same points: the first region of each set of points is enough.
    marks = regions.groupBy("rid").agg(F.count("*").alias("cnt"), F.expr("bit_xor(xxhash64(sid))").alias("x"), F.expr("bit_xor(xxhash64(sid, 1))").alias("y"))
    first = marks.where("cnt > 1").groupBy("cnt", "x", "y").agg(F.min("rid").alias("rid")).select("rid")
    members = stage_table(regions.join(first, "rid", "left_semi").select("rid", "sid", "n", "rest", "c"), "regions")

    found = None
    pivots, turns = members.groupBy("rid").agg(F.min(F.struct("c", "sid", "n", "rest")).alias("p")).withColumn("turn", F.lit(0)), 1
    while True:
        # The most central points (few shingles of their own) are pivots: every other point of the region is measured.
        stars = salted_lookup(members, pivots, "rid").where("p is not null and sid <> p.sid")
        stars = stars.where(_within(percent, "n", "rest", "p.n", "p.rest")).select("rid", "sid", F.col("p.sid").alias("pivot"), "turn")
        stars = stage_table(stars, "stars")
        measured = stage_table(_measure(_ordered(stars, "sid", "pivot"), sets), "measured")
        found = _add(found, measured.where(_linked(percent)).select("a", "b"))
        labels = stage_table(connected_components(found), "labels").withColumnRenamed("node", "sid")
        members = members.drop("component").join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        members = stage_table(members.join(pivots.select("rid", F.col("p.sid").alias("sid")), ["rid", "sid"], "left_anti"), "regions")
        # Pairs within a component need no look; of a region's others, how many are there?
        parts = members.groupBy("rid", "component").agg(F.count("*").alias("m"))
        left = stage_table(parts.groupBy("rid").agg(F.sum("m").alias("cnt"), F.expr("cast(sum(double(m) * m) as double)").alias("same")), "left").withColumn("pairs", F.expr("(double(cnt) * cnt - same) / 2")).where("pairs > 0")
        placed = members.join(left.where(f"pairs <= {LEAF_PAIRS}").select("rid"), "rid", "left_semi").join(_near(stars, measured, turns), ["rid", "sid"], "left")
        pairs = _open_pairs(placed, percent)
        leaf = stage_table(_measure(pairs, sets), "measured")
        found = _add(found, leaf.where(_linked(percent)).select("a", "b"))
        large = left.where(f"pairs > {LEAF_PAIRS}").select("rid")
        release(docs.sparkSession)
        if large.isEmpty():
            drop_table(sets)
            return found
        # Larger regions go on with further pivots, taken outside their largest component.
        members = stage_table(members.join(large, "rid", "left_semi"), "regions")
        main = parts.join(large, "rid", "left_semi").groupBy("rid").agg(F.max(F.struct("m", "component")).alias("w")).select("rid", F.col("w.component").alias("main"))
        rest = salted_lookup(members, main, "rid").where("component <> main")
        turn, turns = F.pmod(F.xxhash64("sid"), F.lit(PIVOTS)).cast("int"), PIVOTS
        pivots = stage_table(rest.groupBy("rid", turn.alias("turn")).agg(F.min(F.struct("c", "sid", "n", "rest")).alias("p")), "pivots")


def _near(stars: DataFrame, measured: DataFrame, turns: int) -> DataFrame:
    """``(rid, sid, d)``: a point's distance to each of its region's pivots, by the pivot's turn; null where not measured."""
    d = measured.select(F.expr("1 - common / (na + nb - common)").alias("d"), "a", "b")
    near = stars.withColumn("a", F.least("sid", "pivot")).withColumn("b", F.greatest("sid", "pivot")).join(d, ["a", "b"])
    near = near.groupBy("rid", "sid").agg(F.map_from_entries(F.collect_list(F.struct("turn", "d"))).alias("m"))
    return near.select("rid", "sid", F.expr(f"transform(sequence(0, {turns - 1}), t -> try_element_at(m, t))").alias("d"))


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: the pairs of a region's points in different components that neither sizes nor pivots rule out.

    Two points within the radius differ by no more than it in their distances to one pivot; distances to different
    pivots say nothing.
    """
    l, r = placed.alias("l"), placed.alias("r")
    apart = F.exists(F.zip_with("l.d", "r.d", lambda x, y: F.abs(x - y) > (100 - percent) / 100 + 1e-9), lambda far: far)
    test = (F.col("l.rid") == F.col("r.rid")) & (F.col("l.sid") < F.col("r.sid")) & (F.col("l.component") != F.col("r.component"))
    return l.join(r, test & F.expr(_within(percent, "l.n", "l.rest", "r.n", "r.rest")) & ~F.coalesce(apart, F.lit(False))).select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b")).distinct()


def _within(percent: int, n1: str, r1: str, n2: str, r2: str) -> str:
    """Whether two sets may be within the radius: by size, and by the shingles from the common one on in the order."""
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and {100 + percent} * least({r1}, {r2}) >= {percent} * ({n1} + {n2})"


def _linked(percent: int) -> str:
    return f"100 * common >= {percent} * (na + nb - common)"


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _add(found: DataFrame | None, links: DataFrame) -> DataFrame:
    return links if found is None else found.unionByName(links)


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of two sets and of what they share.  Shingles that one set alone holds can't be shared."""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))


def jaccard_classes(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: a row for each document with the smallest doc_id that links reach."""
    points = stage_table(shingle_points(docs, k), "points")
    labels = connected_components(jaccard_links(docs, points, percent, k))
    lowest = points.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"))
    placed = stage_table(lowest.join(labels.withColumnRenamed("node", "sid"), "sid", "left"), "labels")
    # Most sets are linked with none; a component that holds many of the others is dealt over salts.
    linked = placed.where("component is not null")
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = salted_lookup(linked, least, "component").select("sid", "component_id")
    classes = stage_table(classes.unionByName(placed.where("component is null").select("sid", F.col("low").alias("component_id"))), "classes")
    own = salted_lookup(points, classes, "sid")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each_class(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class: one document of each group stays.

    Rows of one doc_id stay or go together, and rows without a doc_id stay.
    """
    classes = jaccard_classes(docs, percent, k)
    name = free_name(docs, "_stay")
    stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(stay, docs["doc_id"] == stay[name], "left_semi")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
