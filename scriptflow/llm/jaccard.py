"""Self-join of documents on the Jaccard similarity of their word n-grams.

The overlaps of all pairs are the product of the document by n-gram incidence matrix
with its transpose. It is computed block by block, and only where bounds that follow
from the sizes of two sets leave a chance:

1. Documents with equal sets are one node.
2. Two sets of at most ``m`` n-grams that link differ in at most
   ``d = 2m(1-t)/(1+t)`` of them. The n-grams are cut by hash into more than ``d``
   segments, so some segments of two linked sets are equal. Sizes come in classes of
   a factor of ``1/t``; a set is in its own class and in that of the largest set it can
   link with. Segments of the fewest n-grams are left out, as many as there are more
   than ``d + 1``, so those that are compared are seldom alike by chance; a set whose
   empty segments are more than that is also found by the first n-grams of a fixed
   order, of which two linked sets share one. An empty segment is never compared.
3. Sets with an equal segment are held against each other by sketches: bit ``h mod B``
   is the parity of the n-grams with that hash, so sketches of linked sets differ in at
   most ``d`` bits. What passes is a candidate; candidates that hang together are a
   family. So a passage that unrelated documents share does not bring them together.
4. A family is cut into blocks of bounded size, also by set size, as sets of too
   different sizes never link. Each pair of blocks is one sparse product: rows are
   multiplied n-gram by n-gram, the rare ones first, and a pair is dropped as soon as
   its count and what is left of the smaller set stay below the bound of their sizes.

No pair leaves its task: a product gives one row for each node with links, its number
of links and the node it is connected to. Components follow from these rows.

Two sets are equal if 64 bits of hashes are; a false link needs a collision.

Defined cases: a null or empty text has no n-grams and no links; a text of fewer
words than ``n`` is one n-gram; repeated rows link with each other; a null ``doc_id``
names a component only if all its ids are null; no rows give no rows.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..sources.storage import release, stage
from . import words
from .graphs import components, limited

N = 3
#: Similarity from which documents link, as a fraction.
THRESHOLD = (90, 100)
#: Bounds of a block of a family: nodes and n-grams.
BLOCK_NODES = 512
BLOCK_GRAMS = 1_000_000
#: Small families share a task up to so many n-grams.
BUNDLE_GRAMS = 4_000_000
#: Nodes of a block of a group that is held against each other by sketches, of which none
#: has more than 8 KB, and what a sketch counts as, in n-grams, where groups share a task.
GROUP_NODES = 2048
SKETCH_WEIGHT = 128
#: Groups of so many nodes are compared pair by pair, all at once.
SMALL_GROUP = 24
#: Steps in which the columns of a product are added; pairs are dropped after each.
STEPS = 4


def _differences(largest: int, threshold: tuple[int, int]) -> int:
    """How many n-grams two linked sets of at most ``largest`` can differ in."""
    num, den = threshold
    return (den - num) * 2 * largest // (den + num)


def _classes(size: int, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """The size classes that a set is in, each with its largest size."""
    num, den = threshold
    out, k, largest = [], 0, 1
    while True:
        if largest >= size:
            out.append((k, largest))
            if largest * num >= size * den:  # no set beyond can link
                return out
        k, largest = k + 1, max(largest + 1, largest * den // num)


def node_of(grams: np.ndarray) -> np.uint64:
    """The name of a set."""
    total = words.mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return words.mixed(np.array([total + np.uint64(len(grams))]))[0]


def signatures(grams: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Hashes of the segments of a sorted set, for each class that it is in."""
    num, den = threshold
    size = len(grams)
    if not size or num == den:  # only equal sets link
        return grams[:0]
    values = words.mixed(grams + np.uint64(0x9E3779B97F4A7C15))
    out, prefix = [], False
    for k, largest in _classes(size, threshold):
        differ = _differences(largest, threshold)
        if not differ:
            continue
        spare = max(2, differ * 2 // 5)
        n = differ + 1 + spare
        # The hashes are sorted, so segments of their range lie one after the other.
        segment = ((grams >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)
        counts = np.bincount(segment, minlength=n)
        # At least n - differ > spare segments are equal. Each set leaves out those of
        # fewer n-grams than ``least``; the higher of two such limits leaves one of the
        # equal segments in both.
        least = int(np.partition(counts, spare)[spare])
        prefix |= not least
        kept = np.flatnonzero(counts >= max(least, 1))
        first = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        sums = sums[first[kept + 1]] - sums[first[kept]]
        names = kept.astype(np.uint64) + np.uint64(k << 40)
        out.append(words.mixed(sums + words.mixed(names)))
    if prefix:
        shared = size - -(-num * size // den) + 1
        out.append(words.mixed(grams[:shared] ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.unique(np.concatenate(out)) if out else grams[:0]


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the number of n-grams for each of as many bits as there are n-grams,
    rounded up to a power of two from 64 to 65536."""
    n_bits = 1 << min(max((len(grams) - 1).bit_length(), 6), 16)
    place = words.mixed(grams ^ np.uint64(0xD1B54A32D192ED03)) & np.uint64(n_bits - 1)
    odd = np.bincount(place.astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits, of the same set."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sets(text, n: int = N) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in words.blocks(text):
        out += words.shingle_hashes(*words.word_hashes(data, offsets), n)
    return out


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _rows(threshold, n):
    def rows(batches):
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            step = 1000
            for at in range(0, batch.num_rows, step):
                sets = _sets(text.slice(at, step), n)
                found = [signatures(s, threshold) for s in sets]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id.slice(at, step),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _signed([node_of(s) for s in sets]),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), _signed(np.concatenate(found))
                        ),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "signatures", "sketch"],
                )

    return rows


def _with_grams(n):
    def with_grams(batches):
        """The n-grams of the documents whose set is the node that is asked for."""
        for batch in batches:
            node, text = batch.column(0), batch.column(1)
            wanted = node.to_numpy(zero_copy_only=False)
            step = 1000
            for at in range(0, batch.num_rows, step):
                sets = _sets(text.slice(at, step), n)
                have = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                same = np.flatnonzero(have == wanted[at : at + step])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(have[same]),
                        pa.array([sets[k].tobytes() for k in same], pa.binary()),
                    ],
                    names=["node", "grams"],
                )

    return with_grams


def _columns(sets: list[np.ndarray]):
    """The incidence matrix of the n-grams that two sets have, equal columns as one:
    for each column its number of rows, its weight and where its rows begin, and the rows.
    Columns of few rows come first."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")  # rows ascend within a column
    row, ends = row[order], np.cumsum(count)
    names = np.random.default_rng(1).integers(0, 2**63, (2, len(sets)), dtype=np.uint64)
    sums = [np.add.reduceat(name[row], ends - count) for name in names]
    found = np.lexsort((*sums, count))
    found = found[count[found] > 1]
    if not len(found):
        return np.zeros((3, 0), np.int64), row
    same = (sums[0][found[1:]] == sums[0][found[:-1]]) & (sums[1][found[1:]] == sums[1][found[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    weight = np.diff(np.append(first, len(found)))
    kept = found[first]
    return np.stack([count[kept], weight, (ends - count)[kept]]), row


def linked_rows(sets: list[np.ndarray], threshold, side=None):
    """For each of the sets those after it that it links with: rows of the sparse product
    of the incidence matrix with its transpose, without what falls below the bounds."""
    num, den = threshold
    size = np.array([len(s) for s in sets])
    (count, weight, start), rows = _columns(sets)
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    member = rows[at]
    of = np.repeat(np.arange(len(count)), count)
    by_row = np.argsort(member, kind="stable")
    columns, bounds = of[by_row], np.searchsorted(member[by_row], np.arange(len(sets) + 1))
    begin = np.cumsum(count) - count
    for k in range(len(sets) - 1):
        own = columns[bounds[k] : bounds[k + 1]]
        # den * shared >= num * (both sizes - shared)
        need = -(-num * (size[k] + size) // (num + den))
        alive = np.minimum(size[k], size) >= need
        alive[: k + 1] = False
        if side is not None:
            alive &= side != side[k]
        total = np.zeros(len(sets), np.int64)
        left = int(weight[own].sum())
        for part in np.array_split(own, STEPS):
            if not alive.any():
                break
            n = count[part]
            places = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            other = member[places]
            here = alive[other]
            total += np.bincount(
                other[here], np.repeat(weight[part], n)[here], minlength=len(sets)
            ).astype(np.int64)
            left -= int(weight[part].sum())
            alive &= total + left >= need
        yield k, np.flatnonzero(alive)


def _links(sets, side, threshold) -> np.ndarray:
    """Which of the sets link: a symmetric matrix. If there are sides, only sets of
    different sides are held against each other."""
    linked = np.zeros((len(sets), len(sets)), bool)
    for k, others in linked_rows(sets, threshold, side):
        linked[k, others] = linked[others, k] = True
    return linked


class _Sketches:
    """The sketches of some nodes, by their number; compared at the smaller size of two."""

    def __init__(self, sketches, size: np.ndarray, threshold):
        self.threshold, self.size = threshold, size
        bits = [np.frombuffer(s.as_buffer(), np.uint64) for s in sketches]
        self.words = np.array([len(b) for b in bits])
        self.tables = {}
        for n in np.unique(self.words).tolist():
            table = np.zeros((len(bits), n), np.uint64)
            for k in np.flatnonzero(self.words >= n):
                table[k] = _folded(bits[k], n)
            self.tables[n] = table

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of nodes whether sketches and sizes let them link."""
        num, den = self.threshold
        both = self.size[a] + self.size[b]
        low = np.minimum(self.size[a], self.size[b])
        passed = den * low >= num * (both - low)
        words = np.minimum(self.words[a], self.words[b])
        for n, table in self.tables.items():
            own = np.flatnonzero(passed & (words == n))
            step = max(1, 2_000_000 // n)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                apart = np.bitwise_count(table[a[some]] ^ table[b[some]]).sum(axis=1, dtype=np.int64)
                passed[some] = (den + num) * apart <= (den - num) * both[some]
        return passed


def _near(threshold):
    def near(table: pa.Table) -> pa.Table:
        """Edges between the nodes of each group whose sketches let them link; of a large
        group no more than it takes to connect them."""
        node, first, number = np.unique(
            table["node"].to_numpy(), return_index=True, return_inverse=True
        )
        if not len(node):
            return pa.table({"a": node, "b": node})
        chosen = table["sketch"].combine_chunks().take(pa.array(first))
        sketches = _Sketches(chosen, table["n_shingles"].to_numpy()[first], threshold)
        family = table["family"].to_numpy()
        order = np.lexsort((number, family))
        family, number = family[order], number[order]
        new = np.concatenate([[True], (family[1:] != family[:-1]) | (number[1:] != number[:-1])])
        family, number = family[new], number[new]
        starts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
        counts = np.diff(np.append(starts, len(family)))
        small = np.repeat(counts <= SMALL_GROUP, counts)
        pairs = [np.zeros(0, np.int64)]
        for apart in range(1, SMALL_GROUP):
            at = np.flatnonzero((family[:-apart] == family[apart:]) & small[:-apart])
            pairs.append(number[at] * len(node) + number[at + apart])
        # Near copies are in many groups together.
        pairs = np.unique(np.concatenate(pairs))
        pairs = np.divmod(pairs, len(node))
        passed = sketches.near(*pairs)
        out = [pairs[0][passed]], [pairs[1][passed]]
        for start, count in zip(starts[counts > SMALL_GROUP], counts[counts > SMALL_GROUP]):
            rows = number[start : start + count]
            label = np.arange(count)
            for k in range(count - 1):
                rest = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
                if not len(rest):
                    continue
                passed = sketches.near(np.full(len(rest), rows[k]), rows[rest])
                joined = np.unique(np.append(label[rest[passed]], label[k]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
            moved = label != np.arange(count)
            out[0].append(rows[label[moved]])
            out[1].append(rows[moved])
        return pa.table({"a": node[np.concatenate(out[0])], "b": node[np.concatenate(out[1])]})

    return near


def _joined(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each node the smallest node that it is connected to."""
    order = np.argsort(nodes)
    linked = linked[np.ix_(order, order)]
    label = np.arange(len(nodes))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(nodes)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            out = np.empty_like(nodes)
            out[order] = nodes[order][label]
            return out
        label = new


_UNIT = ["unit_family", "unit_bucket", "unit_left", "unit_right"]
_LINKED = "node long, root long, links long"


def _product(threshold):
    def product(table: pa.Table) -> pa.Table:
        family = table["family"].to_numpy()
        node = table["node"].to_numpy()
        copies = table["copies"].to_numpy()
        # One of two blocks may be empty here: its number tells, not the rows.
        two = table["unit_left"][0] != table["unit_right"][0]
        side = table["side"].to_numpy() if two else None
        grams = table["grams"]
        out: list[list[np.ndarray]] = [[], [], []]
        order = np.lexsort((node, family))
        order = order[np.concatenate([[True], np.diff(node[order]) != 0])] if len(order) else order
        for rows in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in rows]
            linked = _links(sets, side[rows] if two else None, threshold)
            some = linked.any(axis=1)
            out[0].append(node[rows][some])
            out[1].append(_joined(linked, node[rows])[some])
            out[2].append((linked @ copies[rows])[some])
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("node", "root", "links"), columns)))

    return product


def _units(
    families: DataFrame,
    threshold: tuple[int, int],
    weight: Column,
    nodes: int,
    weights: int = sys.maxsize,
) -> tuple[DataFrame, list[DataFrame]]:
    """The products that each node takes part in, ``family, node, copies, side`` and
    the columns of ``_UNIT``, and the staged tables that they are read from. ``families`` has ``family, node, copies, n_shingles`` and
    perhaps ``family_nodes, family_weight``; a block has at most so many ``nodes`` and
    so much ``weight``."""
    num, den = threshold
    sized, staged = families, []
    if "family_nodes" not in families.columns:
        totals = families.groupBy("family").agg(
            F.count("*").alias("family_nodes"), F.sum(weight).alias("family_weight")
        )
        sized = stage(families.join(totals, "family"), "jaccard_families")
        staged.append(sized)
    fits = (F.col("family_nodes") <= nodes) & (F.col("family_weight") <= weights)

    small = sized.filter(fits)
    total = small.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bundles = math.ceil(total / BUNDLE_GRAMS) or 1
    alone = small.select(
        "family",
        "node",
        "copies",
        F.lit(0).alias("side"),
        F.pmod(F.xxhash64("family"), F.lit(bundles)).alias("unit_family"),
        *[F.lit(-1).alias(c) for c in _UNIT[1:]],
    )

    # Sets of two buckets that are not neighbours differ too much in size.
    bucket = F.floor(F.log("n_shingles") / (math.log(den / num) * 1.001 or 1e-9)).cast("int")
    large = sized.filter(~fits).withColumn("bucket", bucket)
    cut = large.groupBy("family", "bucket").agg(
        F.greatest(
            F.ceil(F.count("*") / nodes), F.ceil(F.sum(weight) / weights)
        ).cast("int").alias("blocks")
    )
    cut = stage(cut, "jaccard_blocks")
    at = lambda step, name: cut.select(
        "family", (F.col("bucket") + step).alias("bucket"), F.col("blocks").alias(name)
    )
    large = (
        large.join(at(0, "own"), ["family", "bucket"])
        .join(at(1, "below"), ["family", "bucket"], "left")
        .join(at(-1, "above"), ["family", "bucket"], "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    )
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))

    def unit(side, bucket, left, right):
        return F.struct(
            side.cast("int").alias("side"),
            F.col("family").alias("unit_family"),
            bucket.cast("int").alias("unit_bucket"),
            left.cast("int").alias("unit_left"),
            right.cast("int").alias("unit_right"),
        )

    block, b = F.col("block"), F.col("bucket")
    none = F.array().cast(
        "array<struct<side:int,unit_family:bigint,unit_bucket:int,unit_left:int,unit_right:int>>"
    )
    # Within a bucket a unit is a pair of blocks; between two, it is numbered after
    # the lower one, and its right side lies behind the blocks of that.
    units = F.concat(
        F.transform(
            numbers("own"),
            lambda k: unit(block > k, b, F.least(block, k), F.greatest(block, k)),
        ),
        F.coalesce(
            F.transform(numbers("above"), lambda k: unit(F.lit(0), b, block, F.col("own") + k)),
            none,
        ),
        F.coalesce(
            F.transform(numbers("below"), lambda k: unit(F.lit(1), b - 1, k, F.col("below") + block)),
            none,
        ),
    )
    large = large.select("family", "node", "copies", F.explode(units).alias("u"))
    return alone.unionByName(large.select("family", "node", "copies", "u.*")), [*staged, cut]


def _groups(rows: DataFrame) -> DataFrame:
    """``family, node, family_nodes``: the nodes with an equal signature. Near copies have
    many signatures in common; groups of the same nodes are one."""
    # One exchange of the signatures, of which most are of one node.
    same = Window.partitionBy("signature")
    return (
        rows.select("node", F.explode("signatures").alias("signature"))
        .select(
            "node",
            F.min("node").over(same).alias("low"),
            F.max("node").over(same).alias("high"),
            F.count("*").over(same).alias("family_nodes"),
            F.try_sum(F.shiftright(F.xxhash64("node"), 20)).over(same).alias("members"),
        )
        .filter("low < high")
        .select(
            F.xxhash64("low", "high", "family_nodes", "members").alias("family"),
            "node",
            "family_nodes",
        )
        .distinct()
    )


def similar(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, n: int = N
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document, by its ``n``-grams.

    ``component_id`` is the smallest id that links lead to, ``n_links`` the number of
    documents linked with directly.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [
            slim.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("signatures", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    found_rows = stage(slim.mapInArrow(_rows(threshold, n), schema), "jaccard_signatures")
    rows = stage(found_rows.select("doc_id", "n_shingles", "node"), "jaccard_rows")
    nodes = stage(
        found_rows.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.max("n_shingles").alias("n_shingles"),
            F.count("*").alias("copies"),
            F.max("sketch").alias("sketch"),
        ),
        "jaccard_nodes",
    )

    groups = stage(_groups(found_rows), "jaccard_groups")
    release(found_rows)
    # Set sizes matter only where a group is cut.
    fits = F.col("family_nodes") <= GROUP_NODES
    sized = groups.filter(fits).withColumn("n_shingles", F.lit(0).cast("long"))
    cut = groups.filter(~fits).join(nodes.select("node", "n_shingles"), "node")
    sized = sized.unionByName(cut).withColumns(
        {"copies": F.lit(1).cast("long"), "family_weight": F.col("family_nodes") * SKETCH_WEIGHT}
    )
    sketches = nodes.select("node", "n_shingles", "sketch")
    units, parts = _units(sized, threshold, F.lit(SKETCH_WEIGHT), GROUP_NODES)
    candidates = (
        units.join(sketches, "node")
        .groupBy(*_UNIT)
        .applyInArrow(_near(threshold), "a long, b long")
    )
    families = components(candidates).withColumnRenamed("component", "family")
    families = stage(families.join(nodes.drop("sketch"), "node"), "jaccard_candidates")
    release(groups, *parts)

    asked = limited(families.select("node", F.col("first_id").alias("id")), 40)
    texts = slim.join(asked, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    grams = stage(texts.mapInArrow(_with_grams(n), "node long, grams binary"), "jaccard_grams")
    units, parts = _units(
        families.drop("first_id"), threshold, F.col("n_shingles"), BLOCK_NODES, BLOCK_GRAMS
    )
    linked = stage(
        units.join(grams, "node")
        .groupBy(*_UNIT)
        .applyInArrow(_product(threshold), _LINKED),
        "jaccard_links",
    )
    release(grams, families, *parts)
    named = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))

    found = nodes.join(named, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = stage(
        found.join(least, "component")
        .join(links, "node", "left")
        .select(
            "node",
            "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "jaccard_found",
    )
    release(nodes, linked)
    filled = F.col("n_shingles") > 0
    return rows.join(found, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(filled, F.col("n_links")).otherwise(0).alias("n_links"),
    )


def keep_one(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, n: int = N
) -> DataFrame:
    """The document with the smallest id of each component, with its columns."""
    kept = (
        similar(docs, threshold, n)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("_kept"))
        .distinct()
    )
    return docs.join(limited(kept, 16), docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Documents with the same set are one node, named after the smallest of them.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+'
         ) AS w
  FROM documents
), sets AS (
  SELECT doc_id,
         list_sort(list_distinct(CASE
           WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
           WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
         END)) AS g
  FROM d
), nodes AS MATERIALIZED (
  SELECT min(doc_id) AS node, g, len(g) AS n, count(*) AS copies FROM sets WHERE len(g) > 0 GROUP BY g
), items AS (
  SELECT node, n, unnest(g) AS s FROM nodes
), pairs AS (
  SELECT a.node AS x, b.node AS y, a.n + b.n AS both_sizes, count(*) AS c
  FROM items a JOIN items b ON a.s = b.s AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n
), links AS MATERIALIZED (
  SELECT x, y FROM pairs WHERE 100 * c >= 90 * (both_sizes - c)
  UNION ALL
  SELECT y, x FROM pairs WHERE 100 * c >= 90 * (both_sizes - c)
), reach AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT reach.node, links.y FROM reach JOIN links ON reach.other = links.x
), components AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), linked AS (
  SELECT links.x AS node, sum(nodes.copies) AS others
  FROM links JOIN nodes ON links.y = nodes.node
  GROUP BY links.x
)
SELECT sets.doc_id, len(sets.g) AS n_shingles,
       coalesce(components.component_id, sets.doc_id) AS component_id,
       CAST(coalesce(nodes.copies - 1, 0) + coalesce(linked.others, 0) AS BIGINT) AS n_links
FROM sets
LEFT JOIN nodes ON sets.g = nodes.g
LEFT JOIN components ON nodes.node = components.node
LEFT JOIN linked ON nodes.node = linked.node
"""
