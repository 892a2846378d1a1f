"""Near copies through a Gray-order index: five-word SimHash fingerprints, searched widely, then checked by Jaccard similarity.

A similarity of 0.8 leaves about 15 of 100 fingerprint bits different, too many for one 64-bit
radius, so a fingerprint has ``WORDS`` times 64 bits. Each of a number of tables picks some of the
bits, and texts that agree on a table's bits share a cell. Bits per table grow with the logarithm of
the number of texts, so that a cell holds a few unrelated texts at any size, and the number of tables
follows from them: ``MISSED`` of the pairs at exactly 0.8 share no cell. Within a cell the first 64
bits are sorted by Gray rank, runs of them form nodes with the mask of the bits that their members
share, and a search drops a node once the differences on shared bits pass ``DISTANCE``. Each text is
linked to its nearest predecessor in the cell. Links count only if the whole shingle sets are similar:
first each text's nearest one is checked, then those that still lead to another group. Last, all
near texts of a cell that are of different groups are compared, in the task that holds them.

The index misses pairs, the check accepts none that is not similar. Equal sets are one text from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, texts_of, tidy
from docweave.llm.components import components
from docweave.llm.near_copies import DENOMINATOR, NUMERATOR, shingles
from docweave.llm.simhash import gray_rank
from docweave.session import bounded, cut_lineage, fresh_path

WORDS = 8
DISTANCE = 17
#: Share of a fingerprint's bits that differ at similarity 0.8: the angle between sets that share 8 of 9 parts, over pi.
APART = math.acos(2 * NUMERATOR / (NUMERATOR + DENOMINATOR)) / math.pi
MISSED = 0.03
LEAST_BITS, MOST_BITS = 8, 31
#: Texts of a cell searched together; a larger one is cut into parts, and each two parts are searched together.
MOST = 1 << 13
#: Texts of the sample that tell of a cell that it has ``MOST``.
TOLD = 64
FAN = 8
BLOCK = 1 << 14
PAIRS = 1 << 17
#: Shingles of a block of a cell whose sets one task compares, and bytes of sets taken together.
BLOCK_SHINGLES = 1 << 21
HELD = 1 << 23
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bits set in over half of the hashes, each spread over ``words`` times 64 bits. No hashes give zeros.

    """
    votes = sum((_votes(hashes[at : at + BLOCK], words) for at in range(0, len(hashes), BLOCK)), np.zeros(64 * words, "i8"))
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


def _votes(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes have each bit, counted bit by bit: three rows of one weight make one of it and one of twice that."""
    mixed = hashes[:, None] + np.arange(1, words + 1, dtype="u8") * np.uint64(_STEPS[0])
    for shift, step in ((30, _STEPS[2]), (27, _STEPS[3]), (31, _STEPS[1])):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(step)
    mixed ^= mixed >> np.uint64(32)
    votes = np.zeros(64 * words, "i8")
    weight, rows = 1, mixed
    while len(rows):
        carried = []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            either = a ^ b
            carried.append((a & b) | (either & c))
            rows = np.concatenate([either ^ c, rows[3 * third :]])
        bits = np.unpackbits(np.ascontiguousarray(rows).view("u1").reshape(len(rows), -1), axis=1, bitorder="little")
        votes += weight * bits.sum(axis=0, dtype="i8")
        rows = np.concatenate(carried) if carried else rows[:0]
        weight *= 2
    return votes


def fingerprints(texts: DataFrame) -> DataFrame:
    """``node, n, same, bits`` per row of ``node, text``: size and hash of its shingle set, and its fingerprint. A task answers a node once."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            nodes, sizes, same, bits = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                part = shingles(text)
                nodes.append(node)
                sizes.append(len(part))
                same.append(xxhash.xxh64_intdigest(part.tobytes()))
                bits.append(fingerprint(part).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(same, "u8").view("i8")), pa.array(bits, pa.binary())],
                names=["node", "n", "same", "bits"],
            )

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, n int, same long, bits binary")


def tables_for(texts: int) -> tuple[int, int]:
    """Bits per table, and tables, for so many texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, texts))) - 2))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** bits)))


def _cells(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """``cell, node, n, first, root`` per text and table; ``first`` are the first 64 bits."""
    rng = np.random.default_rng(7)
    picks = np.stack([rng.choice(64 * WORDS, bits, replace=False) for _ in range(tables)])
    place = np.int64(1) << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=2048):
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), "u1").reshape(batch.num_rows, -1)
            each = np.unpackbits(raw, axis=1, bitorder="little")
            keys = np.concatenate([(np.int64(t) << MOST_BITS) | (each[:, pick] @ place) for t, pick in enumerate(picks)])
            first = np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0]
            nodes, sizes, roots = (np.tile(batch.column(i).to_numpy(), tables) for i in (0, 1, 3))
            columns = [keys, nodes, sizes, np.tile(first, tables), roots]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["cell", "node", "n", "first", "root"])

    return distinct.select("node", "n", "bits", "root").mapInArrow(tidy(run), "cell long, node long, n int, first long, root long")


def _before(
    cell: np.ndarray, bits: np.ndarray, size: np.ndarray, distance: int, fan: int, group: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, predecessors in the same cell, and the bits between them, some rows at a time.

    Rows are sorted by cell and Gray rank. Only rows within ``distance`` whose sets could be similar
    by their sizes are met and, given groups, only those of another group.
    """
    runs = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    members = np.diff(np.r_[runs, len(cell)])
    levels, owner, low, high = [], cell, bits, bits
    least, most = (group, group) if group is not None else (cell, cell)
    while True:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        first = np.flatnonzero(within % fan == 0)
        if len(first) == len(owner):
            break
        low, high, owner = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), owner[first]
        least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
        levels.append((first, np.r_[first[1:], len(within)], low, ~(low ^ high), least, most))
    askers = np.flatnonzero(np.repeat(members > 1, members))
    cell_of = np.repeat(np.arange(len(runs)), members)  # its node on the top level
    reach = np.cumsum(members[cell_of[askers]])
    cuts = np.unique(np.r_[0, np.searchsorted(reach, np.arange(0, int(reach[-1]) if len(reach) else 0, PAIRS), "right"), len(askers)])
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        who = askers[start:stop]
        node = cell_of[who]
        for first, end, low, mask, least, most in reversed(levels):
            keep = np.bitwise_count((bits[who] ^ low[node]) & mask[node]) <= distance
            if group is not None:
                keep &= (least[node] != group[who]) | (most[node] != group[who])
            who, node = who[keep], node[keep]
            counts = end[node] - first[node]
            who = np.repeat(who, counts)
            node = np.repeat(first[node] - np.r_[0, np.cumsum(counts)[:-1]][: len(counts)], counts) + np.arange(len(who))
        less, more = np.minimum(size[who], size[node]), np.maximum(size[who], size[node])
        apart = np.bitwise_count(bits[who] ^ bits[node]).astype("i8")
        keep = (node < who) & (apart <= distance) & (DENOMINATOR * less >= NUMERATOR * more)
        if group is not None:
            keep &= group[who] != group[node]
        yield who[keep], node[keep], apart[keep]


def nearest_before(
    cell: np.ndarray, bits: np.ndarray, size: np.ndarray, distance: int = DISTANCE, fan: int = FAN
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of :func:`_before` each row's nearest predecessor; of equally near ones the latest counts."""
    for who, node, apart in _before(cell, bits, size, distance, fan):
        order = np.lexsort((-node, apart, who))
        who, node, apart = who[order], node[order], apart[order]
        nearest = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
        yield who[nearest], node[nearest], apart[nearest]


def _dealt(distinct: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``cell, salt, node, n, first, root`` of texts (``node, n, bits``), the rows of a cell and salt in one task.

    A crowded cell is cut into parts, and a salt names two of them, so that any two texts of a cell
    meet under one salt, and each text stands once for each other part.
    ``roots`` (``node, root``) name their groups; a text without one is its own.
    """
    rows = distinct.count()
    tables = tables_for(rows)
    if roots is None:
        distinct = distinct.withColumn("root", F.col("node"))
    else:
        distinct = distinct.join(bounded(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = _cells(distinct, *tables).withColumn("salt", F.lit(0).cast("long"))
    if rows > MOST:
        # a cell's size is told by one text in so many; it settles the dealing, not what a cell is
        every = max(1, MOST // TOLD)
        told = _cells(distinct.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0), *tables)
        large = told.groupBy("cell").agg((F.count("*") * every).alias("about")).filter(F.col("about") > MOST)
        large = cut_lineage(large.select("cell", F.ceil(F.col("about") / MOST).cast("int").alias("parts")))
        if not large.isEmpty():
            own = F.pmod(F.xxhash64("node", "cell"), F.col("parts")).cast("int")
            others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: other != own)
            pairs = F.transform(others, lambda other: F.least(own, other) * F.col("parts").cast("long") + F.greatest(own, other))
            salts = F.coalesce(pairs, F.array(F.lit(0).cast("long")))
            cells = cells.drop("salt").join(bounded(large), "cell", "left").withColumn("salt", F.explode(salts)).drop("parts")
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    carried = ["cell", "salt", "node", "n", "first"] + ["root"] * (roots is not None)
    return cells.select(*carried).repartition(n, "cell", "salt").sortWithinPartitions("cell", "salt")


def _by_cell(
    batches: Iterator[pa.RecordBatch], solved: Callable[[list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """``solved`` over whole cells of rows as :func:`_dealt` deals them: columns in Gray order, and the number of each row's cell."""

    def of(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((held[2], gray_rank(held[4].view("u8")), held[1], held[0]))
        columns = [x[order] for x in held]
        cell, salt = columns[:2]
        yield from solved(columns, np.cumsum(np.r_[False, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])]))

    held: list[np.ndarray] | None = None
    for batch in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
        if len(held[0]) > 1 << 16:
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])  # the last group may go on
            whole = len(same) - int(same.sum())
            if whole:
                yield from of([x[:whole] for x in held])
                held = [x[whole:] for x in held]
    if held is not None and len(held[0]):
        yield from of(held)


def candidates(distinct: DataFrame) -> DataFrame:
    """``a, b, apart``: each text (``node, n, bits``) and its nearest predecessor in each cell, if that is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(columns: list[np.ndarray], group: np.ndarray) -> Iterator[pa.RecordBatch]:
            node, size, first = columns[2:5]
            for who, near, apart in nearest_before(group, first.view("u8"), size.astype("i8")):
                ends = np.maximum(node[who], node[near]), np.minimum(node[who], node[near])
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(apart.astype("i4"))], names=["a", "b", "apart"])

        return _by_cell(batches, solved)

    links = _dealt(distinct).mapInArrow(tidy(run), "a long, b long, apart int")
    return links.filter("a <> b").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _meetings(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """``cell, salt, low, high, node, first, root``: the texts of a cell that are near one of another group.

    A cell is cut into blocks of about ``BLOCK_SHINGLES``, and a text stands in a pair of blocks
    (``low, high``) if it is near a text of the other one, so rows grow with the texts of a cell and
    not with their pairs.
    """
    n_blocks = np.int64(1) << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(columns: list[np.ndarray], group: np.ndarray) -> Iterator[pa.RecordBatch]:
            cell, salt, node, size, first, root = columns
            size = size.astype("i8")
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            before = np.cumsum(size) - size
            block = (before - before[starts][group]) // BLOCK_SHINGLES
            met = np.empty((0, 2), "i8")  # pairs of blocks, and rows in them
            for who, near, _ in _before(group, first.view("u8"), size, DISTANCE, FAN, root):
                both = np.minimum(block[who], block[near]) * n_blocks + np.maximum(block[who], block[near])
                rows = np.concatenate([who, near])
                met = np.unique(np.concatenate([met, np.stack([np.r_[both, both], rows], 1)]), axis=0)
            both, rows = met.T
            columns = [cell[rows], salt[rows], (both // n_blocks).astype("i4"), (both % n_blocks).astype("i4"), node[rows], first[rows], root[rows]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["cell", "salt", "low", "high", "node", "first", "root"])

        return _by_cell(batches, solved)

    return _dealt(distinct, roots).mapInArrow(tidy(run), "cell long, salt long, low int, high int, node long, first long, root long")


def _links_between(
    cell: np.ndarray, bits: np.ndarray, root: np.ndarray, parts: list[np.ndarray]
) -> Iterator[tuple[int, int]]:
    """Pairs of near rows whose sets are similar, as many as join the groups of a cell. Rows are sorted by cell and Gray rank."""
    size = np.array([len(p) for p in parts], "i8")
    names, at = np.unique(np.concatenate([*parts, np.empty(0, "i8")]), return_inverse=True)
    ends = np.cumsum(size)
    lists = [at[end - n : end] for end, n in zip(ends, size, strict=True)]
    marked = np.zeros(len(names), bool)
    above: dict[tuple[int, int], tuple[int, int]] = {}

    def top(of: tuple[int, int]) -> tuple[int, int]:
        while (up := above.get(of, of)) != of:
            above[of] = above.get(up, up)
            of = up
        return of

    for who, near, _ in _before(cell, bits, size, DISTANCE, FAN, root):
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
        for row, others in zip(who[starts].tolist(), np.split(near, starts[1:]), strict=False):
            marked[lists[row]] = True
            met = np.concatenate([lists[k] for k in others.tolist()])
            both = np.add.reduceat(marked[met], np.cumsum(size[others]) - size[others], dtype="i8")
            marked[lists[row]] = False
            similar = others[both * DENOMINATOR >= NUMERATOR * (size[row] + size[others] - both)]
            for k in np.unique(root[similar], return_index=True)[1].tolist():
                other = int(similar[k])
                mine, its = top((int(cell[row]), int(root[row]))), top((int(cell[other]), int(root[other])))
                if mine != its:
                    above[mine] = its
                    yield row, other


def _hidden(distinct: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links of similar texts that meet in some cell and are of different groups, enough to join these.

    All near pairs are compared by whole sets, within the task that holds a pair of blocks of a cell.
    """
    met = cut_lineage(_meetings(distinct, roots))
    keys = ["cell", "salt", "low", "high"]
    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = cut_lineage(_sets(texts, met.select("node").distinct()))
    dealt = met.join(sets, "node").select(*keys, "node", "first", "root", "part").repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: pa.Table) -> Iterator[pa.RecordBatch]:
            *key, node, first, root = (held.column(i).to_numpy() for i in range(7))
            order = np.lexsort((node, gray_rank(first.view("u8")), *reversed(key)))
            key, node, root = [k[order] for k in key], node[order], root[order]
            cell = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in key], axis=0)])
            flat = [p for chunk in held.column(7).chunks for p in np.split(chunk.values.to_numpy(), chunk.offsets.to_numpy()[1:-1])]
            found = list(_links_between(cell, first.view("u8")[order], root, [flat[k] for k in order.tolist()]))
            ends = node[np.array(found, "i8").reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            for part in slices(iter([batch]), rows=4096):
                new = pa.Table.from_batches([part])
                held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows and held.nbytes > HELD:
                    same = np.logical_and.reduce([(k := held.column(i).to_numpy()) == k[-1] for i in range(4)])  # the last may go on
                    whole = len(same) - int(same.sum())
                    if whole:
                        yield from solved(held.slice(0, whole))
                        held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from solved(held)

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, part``: the shingle sets of some of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            found = {}
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if node not in seen:
                    seen.add(node)
                    found[node] = shingles(text)
            offsets = pa.array(np.cumsum([0, *map(len, found.values())]), pa.int32())
            values = pa.array(np.concatenate([*found.values(), np.empty(0, "u8")]).view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["node", "part"])

    wanted = texts.select("node", "text").join(bounded(nodes), "node")
    return wanted.mapInArrow(tidy(run), "node long, part array<long>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(c), F.col("part").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
    return met.filter(F.col("both") * DENOMINATOR >= NUMERATOR * (F.col("all") - F.col("both"))).select("a", "b")


def groups(texts: DataFrame) -> DataFrame:
    """``node, root`` of the texts (``node``, ``text``; a node names one text) found similar to another, over any number of links.

    Shingles are five words, A-Z in lower case; a text of fewer words is one shingle, texts without
    words (null and empty ones too) are equal. Repeated nodes count once; long texts are read whole;
    an empty table gives an empty one; other columns are not read.
    """
    spark = texts.sparkSession
    path = fresh_path(spark, "fingerprints")
    fingerprints(texts).dropDuplicates(["node"]).write.parquet(path)
    marked = spark.read.parquet(path)
    classes = marked.groupBy("same").agg(F.min("node").alias("node"), F.count("*").alias("members"))
    distinct = marked.join(classes.select("node"), "node", "left_semi").filter("n > 0")
    found = cut_lineage(candidates(distinct))
    sets = cut_lineage(_sets(texts, found.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    ends = found.select(F.col("a").alias("node"), F.struct("apart", F.col("b").alias("other")).alias("to"))
    ends = ends.union(found.select(F.col("b").alias("node"), F.struct("apart", F.col("a").alias("other")).alias("to")))
    nearest = ends.groupBy("node").agg(F.min("to").alias("to"))
    first = nearest.select(F.greatest("node", "to.other").alias("a"), F.least("node", "to.other").alias("b")).distinct()
    links = cut_lineage(_similar(first, sets))
    roots = cut_lineage(components(links))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = found.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = cut_lineage(links.union(_similar(rest, sets)))
    # what a nearer text hid, between the groups that there are now
    links = links.union(cut_lineage(_hidden(distinct, cut_lineage(components(links)), texts)))
    copies = marked.join(classes.filter("members > 1").withColumnRenamed("node", "other"), "same").filter("node <> other")
    return components(links.union(copies.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))))
