"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its five-word shingles, words being what blanks part. Documents with equal sets are one node, the smallest
id. A node's sketch is the ``KEPT`` smallest hashes of its set. The ``LISTED`` smallest stand in inverted lists; of two sets at the
threshold each of the smallest hashes of their union is shared with a probability of 0.85, so they miss each other in
all lists with 0.15 ** 8. Within a list, the sketch of the union of two nodes estimates their similarity; pairs whose estimate
allows the threshold (4.5 standard deviations) are candidates, and these are verified on the full sets.

Links only have to name the components, so candidates come in rounds. In the first one the nodes of each list are compared in blocks,
which all hold the list's pivots, and each node gets its best partner of all its lists; verified links join components, and a group of near copies
is one by then. Later only lists that still hold several components are looked at: each node outside its list's largest
component is compared with all nodes of the list, and gets the 4 best partners of other components, then 32, 256, ... until no
node has more. So a large group of near copies stays linear, and a search pair by pair is left to nodes near the threshold
without a link.

Lists of more than ``REFINED`` nodes most of which lie in different components are split by a second such hash, which two sets at the
threshold lack with 1e-5. Where all of these belong to a common passage that does not help, as its documents share them and no more.
These nodes meet by ``TRIES`` paths instead, each of several hashes drawn anew from their whole sketches (see ``depth``), so that a shared
passage alone seldom makes a list. No rows of pairs are made but candidates.

``doc_id`` must be of an integer type, else ValueError. Texts without words, null ones included, have empty sets and link with
nothing. Rows that repeat an id are one document; if their texts differ it has the links of each. Rows without an id are returned
without a component and as kept; a row without words stands for its own id alone. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import UNSPACED, Words, discard, materialize, plain_unions, small_batches, splitmix, text_blocks, word_grams
from tidalgrid.llm.graph import components

SHINGLE, PERCENT = 5, 85
KEPT, LISTED, SPREAD = 256, 8, 4.5
REFINED, BLOCK, WIDE, GUESTS = 256, 256, 16, 4
#: Nodes outside a list's largest component that meet the whole list as one block of guests, so in rows that grow with the list.
STRAYS = GUESTS * BLOCK
#: Paths by which the nodes of scattered pairs meet.
TRIES = 30
#: Ids that are broadcast, 8 bytes each; beyond, they are shuffled.
SMALL = 200_000
#: Hashes of the first look at an estimate.
COARSE = 32


def sets_of(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, buf, offsets in text_blocks(texts):
        words = Words(buf, offsets, UNSPACED)
        for a, b in zip(words.text_start.tolist(), words.text_end.tolist(), strict=True):
            yield np.unique(word_grams(words.hash[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64)


def smallest(percent: int) -> int:
    """The least size of a set that can be linked with a larger one."""
    return next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62


def sketches(docs: DataFrame, kept: int = KEPT, listed: int = LISTED) -> DataFrame:
    """(doc_id, key, size, sketch, low): ``key`` names the set, ``sketch`` packs the upper halves of its smallest hashes, and ``low``
    has the very smallest whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, packed, low = [], [], [], []
            for own in sets_of(b.column(1)):
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest())
                sizes.append(len(own))
                packed.append(np.unique((own[:kept] >> np.uint64(32)).astype(np.uint32)).tobytes())
                low.append(own[:listed].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "key", "size", "sketch", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key string, size long, sketch binary, low array<long>")


def propose(nodes: np.ndarray, roots: np.ndarray, asking: np.ndarray, resident: np.ndarray, own: list[np.ndarray], partners: int, kept: int, percent: int) -> list[tuple[int, int, float]]:
    """(node, partner, estimate) in a block: for each ``asking`` node the best ``partners`` among the ``resident`` ones of other
    components whose estimate allows the threshold. Estimates well above the threshold are as good as each other; of these the
    smallest ids come first, so that a node gets the same partners in lists that are alike."""
    lengths = np.array([len(s) for s in own])
    _, inverse, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    places = np.concatenate([np.arange(1, n + 1, dtype=np.int16) for n in lengths])
    owner = np.repeat(np.arange(len(own)), lengths)
    # hashes of one node alone don't matter
    common = times > 1
    column, keep = np.cumsum(common) - 1, common[inverse]
    columns, places, owner = column[inverse[keep]], places[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(len(own) + 1))
    # ranks by hash and node, so that the rows of a node's hashes are read in one piece
    rank = np.zeros((int(common.sum()), len(own)), np.int16)
    rank[columns, owner] = places
    out, share = [], percent / 100

    def able(i: int, rows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``rows`` whose estimate by the union's ``first`` smallest hashes allows the threshold, and the estimates."""
        mine = places[ends[i] : ends[i + 1]]
        n = int(np.searchsorted(mine, first, "right"))
        there = rank[columns[ends[i] : ends[i] + n]]
        there = there if len(rows) == len(own) else there[:, rows]
        both = (there > 0) & (there <= first)
        shared = np.cumsum(both, axis=0, dtype=np.int16)
        # a shared hash's rank in the union counts it once
        inside = (both & (there + mine[:n, None] - shared <= first)).sum(axis=0)
        union = np.minimum(first, np.minimum(first, lengths[rows]) + min(first, int(lengths[i])) - both.sum(axis=0))
        margin = np.where(union < first, 0, SPREAD * np.sqrt(share * (1 - share) / first))
        good = np.flatnonzero(inside >= union * (share - margin) - 1e-9)
        return rows[good], inside[good] / union[good]

    every = np.arange(len(own))
    for i in np.flatnonzero(asking).tolist():
        other = (roots != roots[i]) & resident
        if not other.any():
            continue
        rows = able(i, np.flatnonzero(other) if 2 * other.sum() < len(own) else every, min(COARSE, kept))[0]
        rows = rows[other[rows]]
        if not len(rows):
            continue
        rows, estimate = able(i, rows, kept)
        estimate = np.minimum(estimate, share + 0.05)
        best = np.lexsort((nodes[rows], -estimate))[:partners]
        out += [(int(nodes[i]), int(nodes[rows[k]]), float(estimate[k])) for k in best.tolist()]
    return out


def inverted(spots: DataFrame) -> DataFrame:
    """The lists of ``spots`` (list, node) with two nodes and more; of lists with the same nodes one."""
    same = spots.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mix"), F.min("node").alias("least")).where("n > 1")
    one = same.groupBy("n", "mix", "least").agg(F.min("list").alias("list")).select("list")
    return materialize(spots.join(one, "list").select("list", "node"), "lists")


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.join(roots, "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))


def _largest(known: DataFrame, root: str = "root") -> DataFrame:
    """(list, n, root, most): the size of each list with several components, and its largest one."""
    counts = known.groupBy("list", F.col(root).alias("root")).agg(F.count("*").alias("k"))
    return counts.groupBy("list").agg(F.sum("k").alias("n"), F.max_by("root", F.struct("k", "root")).alias("root"), F.max("k").alias("most")).where("n > most")


def depth(percent: int, tries: int | None = None) -> int:
    """The most hashes of a path for which two sets at the threshold still meet in one of the tries but for 1e-7."""
    return max([1, *(r for r in range(1, 64) if (1 - (percent / 100) ** r) ** (tries or TRIES) <= 1e-7)])


def paths(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(list, node): for each of ``TRIES`` the list of the nodes whose sketches have the same smallest hashes under ``depth`` new
    functions."""
    r = depth(percent)
    salts = splitmix(np.arange(1, TRIES * r + 1, dtype=np.uint64) << np.uint64(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for sketch in b.column(1):
                own = np.frombuffer(sketch.as_buffer(), np.uint32).astype(np.uint64)
                least = np.array([splitmix(own ^ s).min() for s in salts], np.uint64).reshape(TRIES, r)
                path = np.arange(TRIES, dtype=np.uint64)
                for k in range(r):
                    with np.errstate(over="ignore"):
                        path = splitmix(path + least[:, k])
                found.append(path.view(np.int64))
            if found:
                ids = pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), TRIES), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), ids], names=["list", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "list long, node long").distinct()


def _scattered(lists: DataFrame, roots: DataFrame, refined: int) -> DataFrame:
    """(list): the long lists without a component that has half of their nodes, or with more than ``STRAYS`` nodes outside it."""
    return _largest(_with_roots(lists, roots)).where((F.col("n") > refined) & ((2 * F.col("most") < F.col("n")) | (F.col("n") - F.col("most") > STRAYS))).select("list")


def split(lists: DataFrame, roots: DataFrame, refined: int = REFINED, nodes: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """``lists`` with those that are scattered over components replaced by the lists of pairs of their hashes. The nodes of pairs that
    are scattered even then meet by ``paths`` of their sketches in place of these pairs, if ``nodes`` (node, sketch) are given."""
    found = _scattered(lists, roots, refined)
    scattered = lists.join(found, "list", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("list")).alias("l"))
    # a node has LISTED values at most, so these arrays are small
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    own = materialize(scattered.select(F.explode(pairs).alias("list"), "node"), "pairs")
    if nodes is not None:
        long = materialize(_scattered(own, roots, refined), "long")
        several = own.join(long, "list", "left_semi").select("node").distinct()
        own = materialize(own.join(long, "list", "left_anti").unionByName(paths(nodes.join(several, "node", "left_semi"), percent)), "pairs")
    return materialize(lists.join(found, "list", "left_anti").unionByName(inverted(own)), "lists")


def planned(lists: DataFrame, nodes: DataFrame, roots: DataFrame | None, block: int = BLOCK, askers: DataFrame | None = None, origin: DataFrame | None = None) -> DataFrame:
    """(list, block, guests, node, root, asking, resident, sketch): the blocks of the lists that hold more than one component.

    Without ``roots`` each node is a component, all ask within their block, and the pivots are in every block. With them the nodes
    outside a list's largest component (of ``askers``, if given) are guests, who ask; each block of guests meets each ``WIDE`` blocks
    of the list's nodes. A list of one block meets as a whole. Which component counts as the largest is told by ``origin``, the roots
    of the first such look: were it told anew, nodes that have asked could join the largest component, and the others never ask.
    """
    def dealt(n):
        return F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int")

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    def blocks(n, size=block):
        return F.ceil(F.col(n) / size).cast("int").alias(n)

    yes, no = F.lit(True), F.lit(False)
    if roots is None:
        sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.min("node").alias("p1"), F.max("node").alias("p2"), F.min_by("node", F.xxhash64("node")).alias("p3")).select("list", blocks("n"), "p1", "p2", "p3")
        own = lists.join(sizes, "list").withColumn("block", F.explode(F.when(F.col("node").isin(F.col("p1"), F.col("p2"), F.col("p3")), upto(F.col("n"))).otherwise(F.array(dealt(F.col("n"))))))
        spots = own.select("list", "block", F.lit(0).alias("guests"), "node", F.col("node").alias("root"), yes.alias("asking"), yes.alias("resident"))
    else:
        known = _with_roots(lists, roots)
        several = known.groupBy("list").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("list")
        known = known.join(several, "list", "left_semi")
        known = known.withColumn("first", F.col("root")) if origin is None else known.join(origin.select("node", F.col("root").alias("first")), "node", "left").withColumn("first", F.coalesce("first", "node"))
        sizes = _largest(known, "first").select("list", (F.col("n") <= block).alias("whole"), blocks("n", WIDE * block), F.col("root").alias("giant"))
        own = known.join(sizes, "list").withColumn("guest", F.col("first") != F.col("giant"))
        if askers is not None:
            own = own.join(askers.select("node", yes.alias("asks")), "node", "left").withColumn("guest", F.col("guest") & F.coalesce("asks", no))
        own = own.join(own.where("guest").groupBy("list").agg(F.count("*").alias("m")).select("list", blocks("m", GUESTS * block)), "list")
        place = lambda block_, guests, asks, stays: F.struct(block_.alias("block"), guests.alias("guests"), asks.alias("asking"), stays.alias("resident"))
        once = F.array(place(F.lit(0), F.lit(0), F.col("guest"), yes))
        stay = F.transform(upto(F.col("m")), lambda g: place(dealt(F.col("n")), g, no, yes))
        visit = F.when(F.col("guest"), F.transform(upto(F.col("n")), lambda b: place(b, dealt(F.col("m")), yes, no)))
        spots = own.select("list", "node", "root", F.inline(F.when(F.col("whole"), once).otherwise(F.concat(stay, F.coalesce(visit, F.filter(stay, lambda _: no))))))
    return spots.join(nodes.select("node", "sketch"), "node").select("list", "block", "guests", "node", "root", "asking", "resident", "sketch")


def candidates(plan: DataFrame, partners: int, kept: int = KEPT, percent: int = PERCENT) -> DataFrame:
    """(node, partner, place): for each node that asks its best partners of all lists and blocks, and the next one, if any."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # guests come first, and meet the list's nodes a block at a time
    ordered = plan.repartition(n, "list", "block", "guests").sortWithinPartitions("list", "block", "guests", "resident")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, guests, others, found, out = None, [], [], [], []

        def meet() -> None:
            held = guests + others
            if len(held) > 1:
                columns = [np.array([h[c] for h in held]) for c in range(4)]
                found.extend(propose(*columns, [np.frombuffer(h[4], np.uint32) for h in held], partners + 1, kept, percent))
            others.clear()

        def finish() -> None:
            meet()
            found.sort(key=lambda r: (r[0], -r[2], r[1]))
            before, place = None, 0
            for r in found:
                before, place = (before, place + 1) if r[0] == before else (r[0], 0)
                if place <= partners:
                    out.append(r)
            guests.clear()
            found.clear()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["node", "partner", "estimate"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if at != row[:3]:
                    finish()
                    at = row[:3]
                (others if row[6] else guests).append(row[3:])
                if len(others) == BLOCK and guests:
                    meet()
            if len(out) > 10_000:
                yield batch()
                out.clear()
        finish()
        if out:
            yield batch()

    found = ordered.mapInArrow(run, "node long, partner long, estimate double").groupBy("node", "partner").agg(F.max("estimate").alias("estimate"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("estimate"), "partner"))
    return found.withColumn("place", place).where(F.col("place") <= partners + 1).select("node", "partner", "place")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (a, b) with ``linked``. Only the sets of documents in a pair are made, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    # most sets aren't asked for
    pairs = materialize(pairs, "pairs")
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sets = materialize(full_sets(docs, F.broadcast(ends) if ends.count() <= SMALL else ends), "sets")
    mine = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    judged = materialize(mine.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean"), "judged")
    for read in (pairs, ends, sets):
        discard(read)
    return judged


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own): the sets of the documents named by ``nodes``; a document with several texts has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(b.column(1))], pa.binary())], names=["node", "own"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    made = texts.mapInArrow(run, "node long, own binary").withColumn("size", F.length("own"))
    return made.groupBy("node", F.xxhash64("own").alias("h"), "size").agg(F.first("own").alias("own")).select("node", "own")


def classes(docs: DataFrame, percent: int = PERCENT, kept: int = KEPT, listed: int = LISTED, refined: int = REFINED, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    small_batches(spark)
    plain_unions(spark)
    signed = materialize(sketches(docs, kept, listed), "sketches")
    ids = signed.where("doc_id is not null and size > 0")
    keys = materialize(ids.groupBy("key").agg(F.min("doc_id").alias("node")), "keys")
    nodes = materialize(ids.join(keys, "key").where(F.col("doc_id") == F.col("node")).where(F.col("size") >= smallest(percent)).dropDuplicates(["node", "key"]).select("node", "size", "sketch", "low"), "nodes")
    lists = inverted(nodes.select(F.explode("low").alias("list"), "node"))
    # texts of one id belong together
    links = materialize(ids.join(keys, "key").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("a", "b"), "links")
    tested, roots, origin, partners, askers = links.where("false"), None, None, 1, None
    while True:
        found = materialize(candidates(planned(lists, nodes, roots, block, askers, origin), partners, kept, percent), "candidates")
        pairs = found.where(F.col("place") <= partners).select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()
        judged = verified(pairs.join(tested, ["a", "b"], "left_anti"), docs, percent)
        tested = tested.unionByName(judged.select("a", "b"))
        own = judged.where("linked").select("a", "b")
        if roots is None or not own.isEmpty():
            links = links.unionByName(own)
            roots = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
        if partners == 1:
            lists, origin, partners = split(lists, roots, refined, nodes, percent), roots, 4
        else:
            askers = found.where(F.col("place") > partners).select("node")
            if askers.isEmpty():
                break
            partners *= 8
    named = keys.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    out = signed.select("doc_id", "key", "size").join(named, "key", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))


def op13_sketches(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """Plain comparison of all pairs, for tests: (doc_id, n_shingles, component_id, kept)."""
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * len(x | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i) if s else i, (find(i) if s else i) == i) for (i, _), s in zip(rows, sets, strict=True)]


ORACLE = """
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM dw WHERE len(w) > 0)),
numbered AS (SELECT doc_id, hash(g) AS h, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n, bit_xor(h) AS x, sum(h::HUGEINT) AS s FROM numbered GROUP BY 1),
same AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, x, s) AS node FROM sizes),
own AS (SELECT g.doc_id AS node, g.h, m.n FROM numbered g JOIN same m ON g.doc_id = m.node AND m.doc_id = m.node),
met AS (SELECT a.node AS u, b.node AS v, a.n AS m, b.n AS n, count(*) AS k FROM own a JOIN own b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT u, v FROM met WHERE 100 * k >= 85 * (m + n - k)),
reach AS (SELECT u, v FROM (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) UNION SELECT r.u, l.v FROM reach r JOIN (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l ON r.v = l.u),
roots AS (SELECT u AS node, least(u, min(v)) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.root, s.node, d.doc_id) AS component_id, coalesce(r.root, s.node, d.doc_id) = d.doc_id AS kept
FROM dw d LEFT JOIN same s USING (doc_id) LEFT JOIN roots r ON s.node = r.node
"""
