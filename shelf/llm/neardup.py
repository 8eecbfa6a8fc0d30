"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Equal shingle sets are one class from the start, represented by the smallest doc_id. A
representative's sketch has ``BANDS * ROWS`` coordinates, filled by rounds of hashed bin
placement (Dahlgaard, Knudsen and Thorup): in round i < t every element falls into one of t
bins; round t + j puts all elements into bin j, so each coordinate is filled after 2t rounds
at most; a bin keeps the least value of the first round that reached it.

Links are settled without spelling out the pairs of a bucket. First each representative is
checked against the bucket leaders it shares most bands with, on full sets, and links are
united. Buckets whose members still lie in several components are then examined in blocks
of bounded size: pairs that share enough bands tie their members into clusters, and within
a cluster every pair across components is compared on full sets, again block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, bounded, fresh, join_spread, mix, shingle_set, texts_of
from shelf.llm.graph import components

BANDS, ROWS = 40, 5
#: Accepted chance that a pair right at the threshold shares too few bands.
RISK = 1e-5
#: Bucket leaders that each document is checked against.
LEADERS = 2
#: Members of a bucket or cluster that are compared in one block.
BLOCK = 1024

_T = BANDS * ROWS
_SEEDS = mix(np.arange(1, 2 * _T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, t: int = _T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.zeros(t, np.uint64)
    filled = np.zeros(t, bool)
    low, at = np.uint64(0xFFFFFFFF), 0
    while not filled.all():
        rounds = min(2 * t - at, max(1, 4 * t // len(elements)))
        index = np.arange(at, at + rounds, dtype=np.uint64)[:, None]
        key = mix(elements[None, :] ^ _SEEDS[at : at + rounds, None])
        bins = ((key >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        if at + rounds > t:
            bins = np.where(index >= t, np.maximum(index, np.uint64(t)) - np.uint64(t), bins)
        packed = ((bins << np.uint64(41)) | (index << np.uint64(32)) | (key & low)).ravel()
        packed.sort()
        where = (packed >> np.uint64(41)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        first = first[~filled[where[first]]]
        out[where[first]] = packed[first] & np.uint64((1 << 41) - 1)
        filled[where[first]] = True
        at += rounds
    return out


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    acc = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in coordinates.reshape(BANDS, ROWS).T:
        acc = mix(acc ^ column)
    return acc.view(np.int64)


def least_shared(percent: int) -> int:
    """Bands that a pair at the threshold shares, but for a chance of ``RISK``."""
    p, missed, c = (percent / 100) ** ROWS, 0.0, 0
    while True:
        missed += comb(BANDS, c) * p**c * (1 - p) ** (BANDS - c)
        if missed > RISK:
            return max(c, 1)
        c += 1


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands``: set size, set digest and band hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        for batch in bounded(batches):
            sizes, first, second, bands = [], [], [], []
            for text in texts_of(batch.column(1)):
                found = shingle_set(text, words)
                sizes.append(len(found))
                if not len(found):
                    first.append(None)
                    second.append(None)
                    bands.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(found)
                if digest not in held:
                    if len(held) >= 2000:
                        held.clear()
                    held[digest] = band_hashes(sketch(found))
                a, b = np.frombuffer(digest, np.int64).tolist()
                first.append(a)
                second.append(b)
                bands.append(held[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full shingle sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            key = xxhash.xxh3_128_digest(text)
            if key not in held:
                if len(held) >= 300:
                    held.clear()
                held[key] = shingle_set(text, words)
            return held[key]

        for batch in bounded(batches):
            good = []
            for a, b in zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
                x, y = of(a), of(b)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (small + large - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def leaders(buckets: DataFrame, least: int) -> DataFrame:
    """Pairs of a representative and the leaders of buckets that hold several components.

    The leader of a bucket is drawn by a mask that depends on the bucket. Aggregation
    precedes every join, so a large bucket costs one row for each member and band.
    """
    mask = F.xxhash64("bh")
    drawn = F.col("rep").bitwiseXOR(mask)
    heads = (
        buckets.groupBy("bh")
        .agg(F.min_by("rep", drawn).alias("head"), F.min_by("c", drawn).alias("head_c"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .where("c0 < c1")
    )
    met = buckets.join(heads, "bh").where("c <> head_c").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("rep").orderBy(F.desc("shared"), "head")
    chosen = met.where(F.col("shared") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LEADERS)
    return chosen.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first columns, over batches sorted by these."""
    group: list[tuple] = []
    for batch in bounded(batches):
        columns = [texts_of(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _in_blocks(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Deal each group out as pairs of blocks ``(i, j)`` of about ``BLOCK`` members.

    ``main`` is the component of most members, ``inside`` and ``outside`` count those in it
    and not. Members of the main component are not compared with one another: their blocks
    (negative ``i``) meet each block of the others once, and the others' blocks meet among
    themselves. ``left`` tells the sides of a pair apart. The rows come sorted by group and pair.
    """
    block = lambda size: F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK).cast("int"))
    own = lambda size: F.pmod(F.xxhash64(member), block(size)).cast("int")
    main, rest = rows.where("c = main").withColumn("own", own("inside")), rows.where("c <> main").withColumn("own", own("outside"))
    every = lambda df, size: df.withColumn("other", F.explode(F.sequence(F.lit(0), block(size) - 1)))
    with_main = every(rest, "inside").withColumns({"i": -1 - F.col("other"), "j": F.col("own"), "left": F.lit(True)})
    of_main = every(main, "outside").withColumns({"i": -1 - F.col("own"), "j": F.col("other"), "left": F.lit(False)})
    among = every(rest, "outside").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("left", F.col("own") == F.col("i"))
    return with_main.unionByName(of_main).unionByName(among).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _mains(rows: DataFrame, key: str) -> DataFrame:
    """``key, main, inside, outside`` of groups ``(key, c)`` that lie in several components."""
    each = rows.groupBy(key, "c").agg(F.count(F.lit(1)).alias("k"))
    of = each.groupBy(key).agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("inside"), F.sum("k").alias("m"))
    return of.where("m > inside").select(key, "main", "inside", (F.col("m") - F.col("inside")).alias("outside"))


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join two trees: as many as it takes to connect what is connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def candidate_clusters(ws: Workspace, buckets: DataFrame, marks: DataFrame, least: int, percent: int) -> DataFrame:
    """``node, cluster``: candidates that still need checking, in clusters that hold all of
    a candidate's partners.

    A candidate pair lies in two components, shares a bucket and ``least`` bands, and has
    sizes that allow the threshold. ``buckets``: ``bh, rep, c``; ``marks``: ``rep, n,
    marks`` with 32 bits of every band hash. A bucket yields no more than a spanning forest
    of its pairs.
    """
    mixed = ws.save(_mains(buckets, "bh"), "mixed")
    members = ws.save(buckets.join(mixed, "bh"), "members")
    rows = _in_blocks(members.join(marks, "rep"), "bh", "rep").select("bh", "i", "j", "left", "rep", "n", "c", "marks")

    def pairs_of(group: list[tuple]) -> Iterator[tuple[int, int]]:
        side, rep, n, c = (np.array([g[k] for g in group]) for k in (3, 4, 5, 6))
        seen = np.array([np.frombuffer(g[7], np.uint32) for g in group])
        later = np.arange(len(rep))
        for x in np.flatnonzero(side):
            ok = (later > x if group[0][1] == group[0][2] else ~side) & (c != c[x]) & (rep != rep[x])
            ok &= 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
            at = np.flatnonzero(ok)
            for y in at[(seen[at] == seen[x]).sum(1) >= least]:
                yield rep[x], rep[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            if len(group) > 1 and (found := _forest(pairs_of(group))):
                yield _edges(found)

    edges = ws.save(rows.mapInArrow(run, "a long, b long"), "candidates")
    return components(ws, edges, "a", "b", "clusters").withColumnRenamed("component", "cluster")


def verify_clusters(ws: Workspace, clusters: DataFrame, united: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect what the full sets of each cluster connect.

    Every pair of a cluster that lies in two components is compared on whole sets, block
    against block: shared sizes are products of the blocks' incidence matrices over the
    shingles that occur on both sides. Only a spanning forest of the links is returned.
    """
    state = ws.save(clusters.join(united, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("c")), "clustered")
    mains = ws.save(_mains(state, "cluster"), "mains")
    dealt = _in_blocks(state.join(mains, "cluster"), "cluster", "node").select("cluster", "i", "j", "left", "node", "c")
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "node"), "node").select("cluster", "i", "j", "left", "node", "c", "text")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def links_of(group: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(g[6], words) for g in group]
        node, c, n = np.array([g[4] for g in group]), np.array([g[5] for g in group]), np.array([len(s) for s in sets])
        left = np.array([g[3] for g in group])
        right = ~left if group[0][1] != group[0][2] else left
        token, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        kept = count[index] > 1
        renumber = np.cumsum(count > 1) - 1
        owner, index = owner[kept], renumber[index[kept]]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        for rows_at in range(0, len(a), 256):
            some = a[rows_at : rows_at + 256]
            if (c[some][:, None] == c[b][None, :]).all():
                continue
            both = np.zeros((len(some), len(b)), np.float32)
            for at in range(0, int((count > 1).sum()), 4096):
                inside = (index >= at) & (index < at + 4096)
                cells = np.zeros((len(sets), 4096), np.float32)
                cells[owner[inside], index[inside] - at] = 1.0
                both += cells[some] @ cells[b].T
            union = n[some][:, None] + n[b][None, :] - both
            good = (100 * both >= percent * union) & (c[some][:, None] != c[b][None, :])
            for x, y in zip(*np.nonzero(good), strict=True):
                yield node[some[x]], node[b[y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            if len(group) > 1 and (found := _forest(links_of(group))):
                yield _edges(found)

    return ws.save(dealt.mapInArrow(run, "a long, b long"), "links-clusters")


def repeated_ids(ws: Workspace, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of rows that repeat a doc_id with another text."""
    spans = known.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    members = ws.save(known.join(spans, "doc_id").join(classes.drop("m"), ["d1", "d2"]).select("doc_id", "rep"), "repeated")
    least = members.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return ws.save(members.join(least, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "links-ids")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent``.

    Reads ``doc_id`` and ``text`` of ``docs`` and returns, row for row, ``doc_id,
    n_shingles, component_id, kept``. Null, empty and blank texts have no shingles and are
    linked with nothing; texts of fewer words than ``words`` are one shingle. Rows that
    repeat a doc_id are the same vertex: their texts' links are united. Rows with a null
    doc_id are counted but not linked (null component, kept). Texts are read whole, however
    long: a set holds eight bytes for a word, and blocks bound how many sets a task holds.
    An empty table gives an empty result; columns besides the two are not read.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    least = least_shared(percent)
    rows = ws.save(sketches(docs, words), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = ws.save(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    # the id is a key too, so the copies of a class do not meet
    firsts = classes.withColumn("doc_id", F.col("rep"))
    reps = known.join(firsts, ["d1", "d2", "doc_id"]).dropDuplicates(["d1", "d2"]).select("rep", F.col("n_shingles").alias("n"), "bands")
    reps = ws.save(reps, "reps")

    spread = reps.select("rep", F.explode("bands").alias("bh"))
    shared = spread.groupBy("bh").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bh")
    buckets = ws.save(spread.join(shared, "bh"), "buckets")
    busy = buckets.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    texts = ws.save(texts.join(busy, "doc_id", "left_semi"), "texts")

    links = repeated_ids(ws, known, classes)
    united = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    state = buckets.join(united.withColumnRenamed("node", "rep"), "rep", "left").select("bh", "rep", F.coalesce("component", "rep").alias("c"))
    pairs = ws.save(leaders(state, least), "pairs")
    links = links.unionByName(ws.save(verify(pairs, texts, words, percent), "links-leaders"))
    united = components(ws, links, "a", "b", "leaders")
    state = buckets.join(united.withColumnRenamed("node", "rep"), "rep", "left").select("bh", "rep", F.coalesce("component", "rep").alias("c"))
    bits = F.transform("bands", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    marks = reps.select("rep", "n", F.unhex(F.array_join(bits, "")).alias("marks"))
    clusters = candidate_clusters(ws, state, marks, least, percent)
    links = links.unionByName(verify_clusters(ws, clusters, united, texts, words, percent))
    united = components(ws, links, "a", "b", "all")

    of_class = classes.join(united.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "m", F.coalesce("component", "rep").alias("found"))
    of_class = ws.save(of_class, "found")
    bare = rows.select("doc_id", "n_shingles", "d1", "d2")
    linked = bare.where("n_shingles > 0 and doc_id is not null")
    out = join_spread(linked, of_class, ["d1", "d2"], "m", classes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    alone = bare.where("not (n_shingles > 0 and doc_id is not null)").withColumn("found", F.lit(None).cast("long"))
    out = out.unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    ws.drop("texts", "reps", "buckets", "pairs", "mixed", "members", "candidates", "clustered", "mains")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does.

    Of rows that repeat a doc_id, the one with the least text stays (nulls first). Rows
    with a null doc_id stay.
    """
    ws = Workspace(docs.sparkSession, "deduplicated")
    found = near_duplicates(docs, words, percent)
    gone = ws.save(found.where("not kept").select("doc_id").distinct(), "gone")
    rest = docs.join(gone, "doc_id", "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = ws.save(twice, "twice")
    if twice.isEmpty():
        return rest.select(*docs.columns)
    first, copy = Window.partitionBy("doc_id").orderBy("text"), fresh(docs, "copy")
    one = rest.join(twice, "doc_id", "left_semi").withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1)
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=3, percent=85)
