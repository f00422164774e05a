"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles. Documents with equal sets are one node, the smallest id. Each of the
``TREES`` prefix tries holds the nodes by a path of ``DEPTH`` MinHash values: Spark sorts all paths, so the nodes below any
prefix are neighbours, and one pass notes how many values each path has in common with the one before it.

Matched prefixes are then shortened, from ``DEPTH`` on, until even a link right at the threshold is expected to meet in some trie by
``RECALL``; more alike nodes meet more surely. The length hangs on the threshold alone, not on the data or a sample of it: a
corpus of very near copies doesn't cost the links at the threshold their recall.

Nodes with a common prefix of that length are candidates. Their graph falls into components, and the pairs of a component
whose sizes allow the threshold are compared exactly, in blocks, so a large group is spread over tasks and neither its
members nor its pairs meet in one row set.

``doc_id`` must be of an integer type, else ValueError. Texts of one to four words have one shingle of all words. Texts
without words, null ones included, have equal (empty) sets. Rows without an id are returned with no class and no links. Rows
that repeat an id are one document; if their texts differ it has the links of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import Words, materialize, plain_unions, small_batches, splitmix, text_blocks, word_grams
from tidalgrid.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, SHORTEST, RECALL = 32, 10, 4, 0.9995
#: Documents of a component that one side of a comparison holds; numbers of blocks that a size band may have.
BLOCK, BANDS = 256, 1 << 40


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES):
    """Probability that two sets meet below a prefix of ``depth`` values in some trie."""
    return 1 - (1 - np.asarray(similarity, np.float64) ** depth) ** trees


def prefix_depth(similarities: np.ndarray, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which the expected share of links with these similarities that meet reaches ``recall``; ValueError if
    none does, as for thresholds that ask for more trees."""
    links = similarities[similarities >= threshold] if len(similarities) else similarities
    links = links if len(links) else np.array([threshold])
    while depth > SHORTEST and met(links, depth, trees).mean() < recall:
        depth -= 1
    if met(links, depth, trees).mean() < recall:
        raise ValueError(f"{trees} trees don't reach a recall of {recall} at a threshold of {threshold}")
    return depth


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    return np.unique(word_grams(hashes, min(size, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


class Forest:
    """MinHash paths of 16-bit values, whose byte order is the tries' order."""

    def __init__(self, trees: int, depth: int):
        seeds = splitmix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.xor, self.times = seeds[: trees * depth].astype(np.uint32), (seeds[trees * depth :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.trees, self.depth = trees, depth

    def paths(self, own: np.ndarray) -> list[bytes]:
        with np.errstate(over="ignore"):
            short = (own >> np.uint64(32)).astype(np.uint32)
            least = np.full(len(self.xor), np.iinfo(np.uint32).max, np.uint32)
            for at in range(0, len(short), 256):
                np.minimum(least, ((short[at : at + 256, None] ^ self.xor) * self.times).min(axis=0), out=least)
            mixed = splitmix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32)))
        data = (mixed & np.uint64(0xFFFF)).astype(">u2").tobytes()
        return [data[i : i + 2 * self.depth] for i in range(0, len(data), 2 * self.depth)]


def set_key(own: bytes) -> str:
    return hashlib.blake2b(own, digest_size=16).hexdigest()


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, buf, offsets in text_blocks(texts):
        words = Words(buf, offsets)
        for a, b in zip(words.text_start.tolist(), words.text_end.tolist(), strict=True):
            yield shingles(words.hash[a:b])


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, key, size, paths): ``key`` names the shingle set, ``paths`` has its path in each trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, depth)
        for b in batches:
            keys, sizes, found = [], [], []
            for own in _sets(b.column(1)):
                keys.append(set_key(own.tobytes()))
                sizes.append(len(own))
                found.append(forest.paths(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "key", "size", "paths"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key string, size long, paths array<binary>")


def neighbours(nodes: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(tree, node, other, common): for each node and trie, where it has ``shortest`` values or more in common with the path
    before it in the trie's order, that path's node and the number of values.

    Paths are sorted by ranges, so a prefix that very many nodes have is spread over tasks. Each task's first and last
    path reach the driver, which links the tasks' ends: two rows for each shuffle partition.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spots = nodes.select("node", F.posexplode("paths").alias("tree", "path")).select("tree", "path", "node")
    ordered = spots.repartitionByRange(n, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows: list[tuple] = []
            for tree, path, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if before is None:
                    rows.append((tree, node, None, 0, path))
                elif before[0] == tree and (k := common(before[1], path)) >= shortest:
                    rows.append((tree, node, before[2], k, None))
                before = (tree, path, node)
            yield made(rows)
        if before:
            yield made([(before[0], before[2], None, 1, before[1])])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["tree", "node", "other", "common", "path"])

    found = materialize(ordered.mapInArrow(run, "tree int, node long, other long, common int, path binary"), "neighbours")
    # first rows are marked 0 and last ones 1; in order, a task's last path stands right before the next task's first
    ends = sorted((r["tree"], bytes(r["path"]), r["node"], r["common"]) for r in found.where("path is not null").collect())
    links = []
    for x, y in zip(ends, ends[1:]):  # noqa: B905
        if (x[3], y[3]) == (1, 0) and x[0] == y[0] and (k := common(x[1], y[1])) >= shortest:
            links.append((y[0], y[2], x[2], k))
    inner = found.where("other is not null").select("tree", "node", "other", "common")
    return inner.unionByName(spark.createDataFrame(links, "tree int, node long, other long, common int")) if links else inner


def common(a: bytes, b: bytes) -> int:
    """How many leading 16-bit values two paths have in common."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return (8 * len(a) - x.bit_length()) // 16


def packed_sets(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` (longs), ``key``, which names the shingle set of ``text``, and the set itself, ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s.tobytes() for s in _sets(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([set_key(x) for x in own]), pa.array(own, pa.binary())], names=[*keep, "key", "own"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{c} long" for c in keep), "key string, own binary"]))


def compare(nodes: list[int], copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], same: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(node, linked node, number of linked documents): pairs within one block (``same``) or across two, counted at each end.

    Linked nodes span the group's components; they are not all pairs.
    """
    n = len(nodes)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(inverse, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m @ m.T
    size = np.array([len(s) for s in sets], np.float64)
    inter = both.astype(np.float64)
    links = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    links &= (inter > 0) & ~np.eye(n, dtype=bool)
    if not same:
        links &= sides[:, None] != sides[None, :]
    count = links @ copies
    out = []
    root = np.arange(n)
    seen = np.zeros(n, bool)
    for i in range(n):
        if seen[i] or not links[i].any():
            continue
        todo = [i]
        seen[i] = True
        while todo:
            new = np.flatnonzero(links[todo.pop()] & ~seen)
            seen[new] = True
            root[new] = i
            todo += new.tolist()
    for i in np.flatnonzero(count > 0).tolist():
        out.append((nodes[i], nodes[root[i]], int(count[i])))
    return out


def block_plan(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``nodes`` (root, size, node, ...) with ``mine``, the block of a node in its component, and ``others``, the blocks that
    it is compared with, its own among them.

    Sizes are cut into geometric bands; sets two bands apart can't reach the threshold, so a large component's blocks meet
    those of their own band and of the next ones. A component of one block isn't cut.
    """
    step = -np.log(threshold) if 0 < threshold < 1 else 1e9
    banded = nodes.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(float(step))))
    one = Window.partitionBy("root").orderBy("band")
    sizes = banded.groupBy("root", "band").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n"))
    sizes = sizes.withColumn("whole", F.sum("n").over(Window.partitionBy("root")) <= block)
    sizes = sizes.select("root", "band", "blocks", "whole", *[F.when(step_(F.col("band")) == side("band").over(one), side("blocks").over(one)).alias(name) for name, side, step_ in (("below", F.lag, lambda x: x - 1), ("above", F.lead, lambda x: x + 1))])

    def ids(band, count):
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda x: band * BANDS + x)

    none = F.array().cast("array<long>")
    band = F.col("band")
    others = F.concat(ids(band, F.col("blocks")), F.coalesce(ids(band - 1, F.col("below")), none), F.coalesce(ids(band + 1, F.col("above")), none))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")) + band * BANDS
    zero = F.lit(0).cast("long")
    planned = banded.join(sizes, ["root", "band"]).withColumn("mine", F.when(F.col("whole"), zero).otherwise(mine)).withColumn("others", F.when(F.col("whole"), F.array(zero)).otherwise(others))
    return planned.select(*nodes.columns, "mine", "others")


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links) of the pairs at the threshold within each candidate component; ``sets`` has root, mine, others,
    node, copies and own."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = sets.withColumn("other", F.explode("others")).select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "own")
    ordered = spread.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> list[tuple[int, int, int]]:
            if at is None or len(held) < 2:
                return []
            return compare([h[0] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held]), [h[3] for h in held], at[1] == at[2], threshold)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "other", "links"])

        at, held, out = None, [], []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for root, i, j, mine, node, copies, own in zip(*cols, strict=True):
                if at != (root, i, j):
                    out += finish()
                    at, held = (root, i, j), []
                held.append((node, copies, mine, np.frombuffer(own, np.uint64)))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += finish()
        if out:
            yield batch(out)

    return ordered.mapInArrow(run, "node long, other long, links long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id``, ``class_id`` (the smallest id reached by links) and ``n_links``
    (other documents whose similarity is at least ``threshold``, copies included)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    small_batches(docs.sparkSession)
    plain_unions(docs.sparkSession)
    signed = materialize(signatures(docs, trees, depth), "signatures")
    ids = signed.where("doc_id is not null")
    classes = materialize(ids.groupBy("key").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("copies"), F.min("size").alias("size")), "classes")
    nodes = ids.join(classes.select("key", "node"), "key").where("doc_id = node").select("node", "paths").where(F.size("paths") > 0)
    near = neighbours(nodes, prefix_depth(np.zeros(0), threshold, trees, depth, recall)).where("node != other")
    own = near.select(F.col("node").alias("u"), F.col("other").alias("v"))
    found = components(own, "candidates")
    weights = classes.groupBy("node").agg(F.sum("copies").alias("copies"))
    plan = block_plan(found.join(classes.select("node", "key", "size"), "node").join(weights, "node"), threshold, block)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(found, "node")
    sets = packed_sets(texts, "node").dropDuplicates(["node", "key"]).join(plan, ["node", "key"])
    links = materialize(verified(sets, threshold), "links")
    roots = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")), "classes")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.join(roots, "node", "left").join(degree, "node", "left").select(
        "key", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "key").join(found, "key", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(0).alias("n_links")
    )


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without an id stay."""
    found = jaccard_classes(docs.select("doc_id", "text"))
    others = materialize(found.where("doc_id != class_id").select("doc_id").distinct(), "repeats")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Plain comparison of all pairs, for tests: (doc_id, class_id, n_links)."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    near = {i: [j for j in ids if j != i and (sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))] for i in ids}
    out = []
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out.append((i, min(seen), len(near[i])))
    return out
