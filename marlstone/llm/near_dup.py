"""MinHash near-duplicate detection by a multi-index Hamming join.

Every distinct shingle set gets a signature of 64 MinHash symbols of 16 bits. Two sets of Jaccard similarity 0.75
differ in 16 symbols on average; pairs that differ in up to 31 are searched for (a pair of similarity 0.75 exceeds that
with a probability of about 2 in 100,000). The signature is split into 16 chunks of 4 symbols. By the pigeonhole
principle a pair under the threshold has a chunk with at most one differing symbol, so each chunk is indexed once for
each symbol that may be wrong, with the other three as the key: all pairs under the threshold meet in some bucket.

Buckets are not expanded into pairs. First each member is confirmed, or not, against the nearest of its buckets' smallest
members, and components are contracted. Buckets that still hold several components are then searched in blocks; each
gives only enough pairs under the threshold to connect its components. Those pairs are confirmed and contracted in turn;
components that one of them failed to join form clusters. A cluster's documents are at last compared in blocks on their full sets, nearest signatures first, skipping what is
already connected, until every pair under the threshold that would join two components has been tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, partitions_for, small_side, staged
from ._words import LOWER_TABLE, mix, pieces, short_shingle, shingle_sets, text_bytes, window_hashes, word_hashes

SYMBOLS, CHUNK, DISTANCE = 64, 4, 31
#: Members of one block of a large bucket, texts compared with one copy of a leader's text, texts of a cluster's block.
BLOCK, FAN, CLUSTER_BLOCK = 2000, 256, 256

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(shingles: int):
    """mapInArrow function: (doc_id, text) to (doc_id, n_shingles, two hashes of the set, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.translate(LOWER_TABLE) for x in text_bytes(batch.column("text"))]
            count, one, two = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
            signs = np.zeros((len(texts), SYMBOLS), np.uint16)
            for begin, part in pieces(texts):
                h, first = word_hashes(part)
                rolled = window_hashes(h, shingles)
                sets, at = [], []
                for i in range(len(part)):
                    a, b = int(first[i]), int(first[i + 1])
                    if b > a:
                        sets.append(np.unique(rolled[a : b - shingles + 1]) if b - a >= shingles else short_shingle(h[a:b]))
                        at.append(begin + i)
                if not at:
                    continue
                size = np.array([len(x) for x in sets])
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                every = np.concatenate(sets)
                with np.errstate(over="ignore"):
                    count[at] = size
                    one[at] = np.add.reduceat(mix(every ^ _XOR[0]), start)
                    two[at] = np.bitwise_xor.reduceat(mix(every ^ _XOR[1]), start)
                    for j in range(SYMBOLS):
                        least = np.minimum.reduceat((every ^ _XOR[j]) * _MUL[j], start)
                        signs[at, j] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(count),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array([x.tobytes() for x in signs], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "sign"],
            )

    return run


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sign) to a row (key, rep) for each chunk and each symbol of it that may differ."""
    keep = [[p for p in range(CHUNK) if p != wrong] for wrong in range(CHUNK)]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(n, SYMBOLS).astype(np.uint64)
        out = np.empty((n, SYMBOLS), np.uint64)
        for c in range(SYMBOLS // CHUNK):
            part = signs[:, c * CHUNK : (c + 1) * CHUNK]
            for wrong, (x, y, z) in enumerate(keep):
                place = np.uint64(c * CHUNK + wrong)
                out[:, c * CHUNK + wrong] = place << np.uint64(48) | part[:, x] << np.uint64(32) | part[:, y] << np.uint64(16) | part[:, z]
        rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), SYMBOLS)
        yield pa.record_batch([pa.array(out.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sign_a, sign_b) to (a, b, distance) of the pairs under the threshold."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, SYMBOLS) for c in ("sign_a", "sign_b"))
        apart = (x != y).sum(axis=1)
        ok = apart <= DISTANCE
        pick = np.flatnonzero(ok)
        yield pa.record_batch([batch.column("a").take(pa.array(pick)), batch.column("b").take(pa.array(pick)), pa.array(apart[ok].astype(np.int32))], ["a", "b", "distance"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal `keys` of batches sorted by them, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class _Joined:
    """Which of the given labels have been joined."""

    def __init__(self, labels: np.ndarray):
        self.up = {x: x for x in labels.tolist()}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _candidates(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block in different components that may be similar enough, the nearest signatures first.

    A block (bi, bj) pairs the members whose part is bi with those of part bj; (bi, bi) pairs members with each other.
    Set sizes that rule a link out count as too far.
    """
    n = block.num_rows
    comp, part, size = (block.column(c).to_numpy() for c in ("comp", "part", "n_shingles"))
    signs = np.frombuffer(b"".join(block.column("sign").to_pylist()), np.uint16).reshape(n, SYMBOLS)
    bi, bj = block.column("bi")[0].as_py(), block.column("bj")[0].as_py()
    left, right = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
    found = []
    for at, i in enumerate(left):
        near = right[at + 1 :] if bi == bj else right
        near = near[(comp[near] != comp[i]) & (100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i]))]
        if len(near):
            apart = (signs[near] != signs[i]).sum(axis=1)
            ok = apart <= DISTANCE
            found.append(np.stack([apart[ok], np.full(ok.sum(), i), near[ok]]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    apart, i, j = np.concatenate(found, axis=1)
    order = np.argsort(apart, kind="stable")
    return i[order], j[order]


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bridges(percent: int):
    """mapInArrow function over blocks of buckets: pairs of rows that connect all components under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for block in grouped(batches, ["key", "bi", "bj"]):
            comp, rep = block.column("comp").to_numpy(), block.column("rep").to_numpy()
            joined = _Joined(comp)
            for i, j in zip(*(side.tolist() for side in _candidates(block, percent)), strict=True):
                x, y = int(comp[i]), int(comp[j])
                if joined.root(x) != joined.root(y):
                    joined.join(x, y)
                    a.append(int(min(rep[i], rep[j])))
                    b.append(int(max(rep[i], rep[j])))
            if len(a) > 10_000:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    return run


def _resolve(shingles: int, percent: int):
    """mapInArrow function over blocks of clusters, with texts: pairs of components that a confirmed link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, ["key", "bi", "bj"]):
            comp = block.column("comp").to_numpy()
            sets = list(shingle_sets([x.translate(LOWER_TABLE) for x in text_bytes(block.column("text").combine_chunks())], shingles))
            joined, a, b = _Joined(comp), [], []
            for i, j in zip(*(side.tolist() for side in _candidates(block, percent)), strict=True):
                x, y = int(comp[i]), int(comp[j])
                if joined.root(x) != joined.root(y) and _similar(sets[i], sets[j], percent):
                    joined.join(x, y)
                    a.append(x)
                    b.append(y)
            if a:
                yield _links(a, b)

    return run


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def _confirm(shingles: int, percent: int):
    """mapInArrow function over (lead, salt, role, doc_id, text) sorted by the first three: confirmed (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            a_out, b_out = [], []
            texts = [x.translate(LOWER_TABLE) for x in text_bytes(batch.column("text"))]
            cols = [batch.column(c).to_pylist() for c in ("lead", "salt", "role", "doc_id")]
            for lead, salt, role, doc, own in zip(*cols, shingle_sets(texts, shingles), strict=True):
                if (lead, salt) != key:
                    key, leaders = (lead, salt), []
                if role == 0:
                    leaders.append(own)
                    continue
                if any(_similar(own, other, percent) for other in leaders):
                    a_out.append(lead)
                    b_out.append(doc)
            yield _links(a_out, b_out)

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, shingles: int, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) that hold on full sets. Each text travels once for each leader it meets."""
    fans = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("fans"))
    dealt = (
        pairs.select(F.col("a").alias("lead"), F.col("b").alias("doc_id"))
        .join(fans, "lead")
        .select("doc_id", "lead", F.pmod(F.xxhash64("doc_id"), F.col("fans")).cast("int").alias("salt"), F.lit(1).alias("role"))
    )
    heads = fans.select(F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = staged(dealt.unionByName(heads), "near-wanted")
    n = partitions_for(docs.sparkSession)
    return (
        docs.join(small_side(wanted, 40), "doc_id")
        .select("lead", "salt", "role", "doc_id", "text")
        .repartition(n, "lead", "salt")
        .sortWithinPartitions("lead", "salt", "role", "doc_id")
        .mapInArrow(_confirm(shingles, percent), "a long, b long")
    )


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """labels (id, comp) after the components in moves (id, comp) have become others."""
    return labels.join(moves.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between ids."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(side), F.col("comp").alias("c" + side)), side)
    ends = staged(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-ends")
    return staged(_moved(labels, connected(ends.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ends)), "near-labels")


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, members, rep, ...) dealt to the pairs (bi, bj) of their key's blocks of about `size` rows, and sorted."""
    blocks = F.ceil(F.col("members") / F.lit(size)).cast("int")
    return (
        rows.withColumn("part", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"bi": F.least("part", "other"), "bj": F.greatest("part", "other")})
        .drop("other", "members")
        .repartition(partitions_for(rows.sparkSession), "key", "bi", "bj")
        .sortWithinPartitions("key", "bi", "bj", "rep")
    )


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) of every node: comp is the smallest id that it reaches.

    Each turn hooks every component onto its smallest neighbour, follows those links to their roots, and contracts the
    edges; components at least halve in number, so the turns are logarithmic. All of it stays in written tables.
    """
    labels = nodes.select("id", F.col("id").alias("comp"))
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), "cc-roots")
        while True:
            up = roots.select(F.col("a").alias("root"), F.col("root").alias("top"))
            jumped = staged(roots.join(up, "root").select("a", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-jump")
            roots = jumped.select("a", "root")
            if jumped.where("moved").isEmpty():
                break
        moved = roots.select(F.col("a").alias("comp"), F.col("root").alias("to"))
        labels = staged(labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "cc-labels")
        ra, rb = (roots.select(F.col("a").alias(c), F.col("root").alias("r" + c)) for c in ("a", "b"))
        edges = staged(edges.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "cc-edges")
    return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs` (doc_id long, text string, others ignored).

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct shingles of
    `shingle_words` words, or all its words as one if there are fewer. Documents with
    100 * intersection >= percent * union are linked (percent of at least 75); component_id is the smallest doc_id
    that a document reaches, and kept says that this is its own.

    Null, empty and white-space texts have no shingles and stay alone. Repeated rows give repeated results; rows that
    share a doc_id count as one document and so as linked. A null doc_id gets a null component_id and is kept. An
    empty table gives an empty result.
    """
    if percent < 75:
        raise ValueError("the signature threshold is set for a similarity of 0.75 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(_signatures(shingle_words), "doc_id long, n_shingles long, set_a long, set_b long, sign binary"), "near-signs")
    same = ["n_shingles", "set_a", "set_b"]
    has = signed.where("doc_id is not null and n_shingles > 0")
    reps = staged(has.groupBy(*same).agg(F.min_by("sign", "doc_id").alias("sign"), F.min("doc_id").alias("rep")), "near-reps")
    signs = reps.select("rep", "sign", "n_shingles")

    keys = signs.select("rep", "sign").mapInArrow(_index_keys, "key long, rep long")
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("members")).where("members > 1")
    buckets = staged(keys.join(heads, "key"), "near-buckets")
    stars = buckets.where("rep <> head").groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("shared"))
    ends = [signs.select(F.col("rep").alias(c), F.col("sign").alias("sign_" + c)) for c in ("a", "b")]
    near = stars.join(ends[1], "b").join(ends[0], "a").select("a", "b", "sign_a", "sign_b").mapInArrow(_near, "a long, b long, distance int")
    # one leader for each member now: its nearest; the others take part in the rounds below
    pairs = staged(near.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b"), "near-pairs")

    # rows that share a doc_id are one document: the classes they fall into are linked from the start
    classes = staged(has.join(reps.select(*same, "rep"), same).select("doc_id", "n_shingles", "rep"), "near-classes")
    twice = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    labels = connected(signs.select(F.col("rep").alias("id")).distinct(), classes.join(twice, "doc_id").select("a", F.col("rep").alias("b")))
    labels = _relabelled(labels, staged(_confirmed(docs, pairs, shingle_words, percent), "near-links"))

    placed = buckets.join(labels.select(F.col("id").alias("rep"), "comp"), "rep")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_members = placed.join(open_keys, "key", "left_semi").select("key", "members", "rep", "comp").join(signs, "rep")
    bridges = staged(_blocked(open_members, BLOCK).mapInArrow(_bridges(percent), "a long, b long").distinct(), "near-bridges")
    if not bridges.isEmpty():
        # the pairs found are tried first: what they join needs no further search
        labels = _relabelled(labels, staged(_confirmed(docs, bridges, shingle_words, percent), "near-links"))
        ends = bridges
        for side in ("a", "b"):
            ends = ends.join(labels.select(F.col("id").alias(side), F.col("comp").alias("c" + side)), side)
        bridges = staged(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "near-bridges")
    if not bridges.isEmpty():
        clusters = connected(bridges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), bridges)
        inside = staged(labels.join(clusters.select(F.col("id").alias("comp"), F.col("comp").alias("key")), "comp"), "near-inside")
        counted = staged(inside.join(inside.groupBy("key").agg(F.count("*").alias("members")), "key").join(signs, F.col("id") == F.col("rep")).drop("id"), "near-clusters")
        texts = docs.select(F.col("doc_id").alias("rep"), "text").join(small_side(counted, 200), "rep")
        links = staged(_blocked(texts, CLUSTER_BLOCK).mapInArrow(_resolve(shingle_words, percent), "a long, b long"), "near-links")
        moves = connected(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links)
        labels = staged(_moved(labels, moves), "near-labels")
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = classes.join(labels.select(F.col("id").alias("rep"), "comp"), "rep").select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, with all their columns, without near-duplicates: of each component the smallest doc_id stays.

    Of rows that share a doc_id one stays. Rows without a doc_id all stay, as do those with a null or empty text; columns
    of any name are kept as they are; an empty table gives no rows.
    """
    judged, own = staged(near_duplicates(docs, shingle_words, percent), "near-judged"), fresh(docs, "gone_id")
    gone = staged(judged.where("not kept").select(F.col("doc_id").alias(own)).distinct(), "near-gone")
    kept = docs.join(small_side(gone, 16), F.col("doc_id") == F.col(own), "left_anti")
    twice = staged(judged.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("times")).where("times > 1").select(own), "near-twice")
    if twice.isEmpty():
        return kept
    twice = small_side(twice, 16)
    single = kept.join(twice, F.col("doc_id") == F.col(own), "left_anti")
    return single.unionByName(kept.join(twice, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"]))
