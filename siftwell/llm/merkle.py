"""Merkle manifest of a dataset with a proof for every row.

Rows are range-sorted by group and id. The ends of the sorted partitions tell where in its group each partition begins, so every task builds the complete subtrees that
lie in it by itself. Only the ragged nodes at partition ends, some tens for each partition, are shuffled, by the coordinate (group, level, index) of an ancestor, and finish
the upper levels; the roots of the groups are then the leaves of one more tree. Proofs go down the same way, and each partition gets the upper paths of its own nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FAN = 3
STEP = 4  # levels that one round of the upper tree makes; a group of it has at most FAN ** STEP nodes
PARTITION_ROWS = 50_000  # rows whose digests one task holds

Node = tuple[str, int, int]  # group, level, index
Path = list[tuple[int, str]]  # from a node upwards: its position in its run and the run's other nodes, joined


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Number of nodes of each level of a tree over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of a row's values, each with its length, null as a dash."""
    return F.sha2(F.concat(*(_encoded(v) for v in values)), 256)


def subtrees(leaves: list[str], start: int, sizes: list[int]) -> list[tuple[int, list[str]]]:
    """All nodes that can be made from the leaves start, start + 1 ... of a tree: for each level the first index and the digests."""
    out = [(start, leaves)]
    for k in range(len(sizes) - 1):
        lo, nodes = out[-1]
        hi = lo + len(nodes)
        first, end = -(-lo // FAN), sizes[k + 1] if hi == sizes[k] else hi // FAN
        if end <= first:
            break
        out.append((first, [h("".join(nodes[FAN * i - lo : FAN * i - lo + FAN])) for i in range(first, end)]))
    return out


def ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """Nodes whose parent could not be made here."""
    for k, (lo, nodes) in enumerate(levels):
        first, made = (levels[k + 1][0], len(levels[k + 1][1])) if k + 1 < len(levels) else (0, 0)
        for i, digest in enumerate(nodes, lo):
            if not made or not first <= i // FAN < first + made:
                yield k, i, digest


def run_of(nodes: list[str], lo: int, i: int) -> tuple[int, str]:
    """Position of node i in its run and the run's other nodes."""
    at = FAN * (i // FAN) - lo
    run = nodes[at : at + FAN]
    return i % FAN, "".join((*run[: i % FAN], *run[i % FAN + 1 :]))


def _ends(k: int, groups: Iterator[str]) -> Iterator[tuple[int, str, int, str, int]]:
    """First and last group of a partition and their numbers of rows here."""
    first = last = None
    n_first = n_last = 0
    for group in groups:
        if first is None or group != last:
            first, last, n_last = group if first is None else first, group, 0
        n_last += 1
        n_first += group == first
    if first is not None:
        yield k, first, n_first, last, n_last


def offsets(ends: list[tuple[int, str, int, str, int]]) -> tuple[dict[int, int], dict[str, int]]:
    """Where in its group each partition's first row stands, and the size of every group that a partition begins or ends with."""
    start, size = {}, {}
    for k, first, n_first, last, n_last in sorted(ends):
        start[k] = size.get(first, 0)
        size[first] = start[k] + n_first
        if last != first:
            size[last] = n_last
    return start, size


def segments(known: tuple[dict[int, int], dict[str, int]], k: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, list[int], list[str]]]:
    """The groups of a partition: name, index of the first leaf here, sizes of the levels of the whole tree, leaves."""
    start, size = known
    at = start.get(k, 0)
    for group, leaves in groupby(rows, key=lambda r: r[0]):
        digests = [r[1] for r in leaves]
        yield group, at, level_sizes(size.get(group, len(digests))), digests
        at = 0


class Forest:
    """Trees over the groups of an RDD of (group, digest), sorted by group, whose partitions hold PARTITION_ROWS rows or so and give the same rows whenever they are read."""

    def __init__(self, rows: RDD) -> None:
        self.rows, self.parts = rows, rows.getNumPartitions()
        start, size = offsets(rows.keys().mapPartitionsWithIndex(_ends).collect())  # a row for each partition
        self.known = rows.context.broadcast((start, size))
        self.rounds = -(-(max((len(level_sizes(n)) for n in size.values()), default=1) - 1) // STEP)
        self._lift()

    def _lift(self) -> None:
        """Finishes the trees. self.tops has (group, (size of each level, root)); self.below the paths of each round's nodes to their ancestors."""
        known = self.known

        def local(k: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[Node, tuple]]:
            for group, at, sizes, leaves in segments(known.value, k, rows):
                for level, i, digest in ragged(subtrees(leaves, at, sizes)):
                    yield (group, level, i), (digest, sizes[0], k)

        self.ragged = nodes = self.rows.mapPartitionsWithIndex(local).persist()
        self.below: list[RDD] = []
        for r in range(self.rounds):
            cap = STEP * (r + 1)

            def ancestor(node: tuple[Node, tuple], cap: int = cap) -> tuple[Node, tuple]:
                (group, level, i), (digest, n, _) = node
                top = min(cap, len(level_sizes(n)) - 1)
                return (group, top, i // FAN ** (top - level)), (level, i, digest, n)

            def rises(node: tuple[Node, tuple], cap: int = cap) -> bool:
                (_, level, _), (_, n, _) = node
                return level < min(cap, len(level_sizes(n)) - 1)

            met = nodes.filter(rises).map(ancestor).groupByKey(self.parts).map(lambda x: (x[0], climb(x[0][1], x[1])))
            self.below.append(met.flatMap(lambda x: [(x[0], ((x[0][0], level, i), path)) for level, i, path in x[1][1]]))
            nodes = nodes.filter(lambda x, f=rises: not f(x)).union(met.map(lambda x: (x[0], (x[1][0], x[1][2], None)))).coalesce(self.parts)
        self.tops = nodes.map(lambda x: (x[0][0], (x[1][1], x[1][0])))

    def paths(self, seeds: RDD) -> RDD:
        """(partition, (node, what the seed of its group says, path to the top of it and on)) for each ragged node. seeds: (top node, (what, path onwards))."""
        reached = seeds
        for below in reversed(self.below):
            lower = below.join(reached, self.parts).map(lambda x: (x[1][0][0], (x[1][1][0], x[1][0][1] + x[1][1][1])))
            reached = reached.union(lower).coalesce(self.parts)
        home = self.ragged.map(lambda x: (x[0], x[1][2]))
        return home.join(reached, self.parts).map(lambda x: (x[1][0], (x[0], *x[1][1])))

    def attach(self, seeds: RDD, rows: RDD) -> RDD:
        """(row, what, path) for each of rows, which has the partitions of self.rows and the digest of each row in its place. A row's path leads to the root and beyond, as its group's seed says."""
        known = self.known

        def joined(k: int, pairs: Iterator[tuple[list, list]]) -> Iterator[tuple]:
            for whole, told in pairs:
                upper = {node: (what, path) for _, (node, what, path) in told}
                at = 0
                for group, start, sizes, leaves in segments(known.value, k, ((r[0], r[1]) for r in whole)):
                    levels = subtrees(leaves, start, sizes)
                    for i in range(start, start + len(leaves)):
                        level, path = 0, []
                        while (node := (group, level, i)) not in upper:
                            lo, nodes = levels[level]
                            path.append(run_of(nodes, lo, i))
                            level, i = level + 1, i // FAN
                        what, rest = upper[node]
                        yield whole[at], what, path + rest
                        at += 1

        told, whole = self.paths(seeds).partitionBy(self.parts, int), rows.glom()
        if more := told.getNumPartitions() - self.parts:  # a session may deal keys to more partitions than it is asked for; those at the end are empty
            whole = whole.union(rows.context.parallelize([[]] * more, more))
        return whole.zip(told.glom()).mapPartitionsWithIndex(joined)


def climb(top: int, given: Iterable[tuple[int, int, str, int]]) -> tuple[str, list[tuple[int, int, Path]], int]:
    """From the nodes (level, index, digest, leaves of the tree) below one ancestor, at level top: its digest, each one's path to it, and the number of leaves of the tree."""
    nodes, runs = sorted(given), {}
    made: list[dict[int, str]] = [{} for _ in range(top + 1)]
    for level, i, digest, _ in nodes:
        made[level][i] = digest
    for level in range(nodes[0][0], top):
        for parent, members in groupby(sorted(made[level]), key=lambda i: i // FAN):
            runs[level, parent] = run = [made[level][i] for i in members]
            made[level + 1][parent] = h("".join(run))
    paths = []
    for level, i, _, n in nodes:
        path, at = [], i
        for below in range(level, top):
            path.append(run_of(runs[below, at // FAN], FAN * (at // FAN), at))
            at //= FAN
        paths.append((level, i, path))
    return next(iter(made[top].values())), paths, n


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", presented: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, presented, subroot, root, proof.

    A leaf is the digest of the fields. The leaves of a group ascend by key; three consecutive nodes make one of the next level, the last run may be shorter, until one is left, the
    subroot; the subroots, by group (null first, then by UTF-8 bytes), make the root in the same way. proof goes from the leaf to the root: an array of the position
    in the run and the digests of the run's others, joined. presented is the digest of what stands at the row now; by default that is the leaf.

    A null field has a dash for its value; null keys come first, rows of equal group and key by their digests, so repeated rows have leaves of their own, next to each other. Very
    long texts are digested in the JVM. An empty table gives an empty result. Other columns are not looked at, whatever their names. One group may hold any share of the rows.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PARTITION_ROWS))
    leaf = leaf_digest(*(F.col(f) for f in fields))
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    # The row number only deals out rows that are equal in all else.
    leaves = docs.select(named.alias("g"), leaf.alias("leaf"), F.col(key).cast("long").alias("id"), (F.lit(None).cast("string") if presented is None else presented).alias("now"), F.monotonically_increasing_id().alias("k"))
    ordered = cut(leaves.repartitionByRange(parts, "g", "id", "leaf", "k").sortWithinPartitions("g", "id", "leaf").drop("k")).rdd.map(tuple)
    groups = Forest(ordered.map(lambda r: (r[0], r[1])))

    subroots = spark.createDataFrame(groups.tops.map(lambda x: (x[0], x[1][1], x[1][0])), "g string, digest string, n long", verifySchema=False)
    tops = cut(subroots)
    above = cut(tops.repartitionByRange(-(-max(1, tops.count()) // PARTITION_ROWS), "g").sortWithinPartitions("g")).rdd.map(tuple)
    whole = Forest(above.map(lambda r: ("", r[1])))
    root = whole.tops.map(lambda x: (("", len(level_sizes(x[1][0])) - 1, 0), (x[1][1], [])))
    seeds = whole.attach(root, above.map(lambda r: ("", r[1], r[0], r[2]))).map(lambda x: ((x[0][2], len(level_sizes(x[0][3])) - 1, 0), ((x[0][1], x[1]), x[2])))
    proved = groups.attach(seeds, ordered).map(lambda x: (x[0][2], x[0][1], x[0][3] or x[0][1], *x[1], x[2]))
    return spark.createDataFrame(proved, f"{key} long, leaf string, presented string, subroot string, root string, proof array<struct<position: int, others: string>>", verifySchema=False)


def proof_digest(proof: str | Column) -> Column:
    """SHA-256 of a proof's digests in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


def folded(digest: str | Column, proof: str | Column) -> Column:
    """The root that a digest leads to along a proof."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), 64 * s["position"]), d, F.substring(s["others"], 64 * s["position"] + 1, F.lit(64 * FAN))), 256))
