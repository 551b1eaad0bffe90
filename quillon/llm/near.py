"""Links between similar sets, and the components that they make, at any size of bucket or component.

Candidates share a bucket (a band of their signatures). Each task packs its pairs of bucket and id into one binary row
for each slot of the buckets' range, with two members of a bucket at most: the others are known to share it, and link
to the smallest id of that task. So a bucket that holds a third of all rows is dealt out evenly, and one shuffle of 16
bytes a pair finds all candidates. Every member is verified against the smallest id of its bucket, which is linear in
the members and joins most copies. Members of one bucket that are still in different components are then compared with
each other, a hot bucket in blocks, and verified on their full sets inside the block: of a block only as many links
come out as it takes to connect what it has found, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bucketed, drop, release, table

#: Characters or elements of contents that are hashed together in a block.
TOGETHER = 1 << 16
#: Members of each side of a block.
BLOCK = 512
#: Members of a bucket of which all pairs with signatures that agree may come out: at most seven for a member.
SMALL = 16
#: Pairs that a task holds before it hands them on.
HELD = 1_000_000
#: Slots of the buckets' range for each shuffle partition.
SLOTS = 8
PACKED = "slot int, kind int, data binary"
#: Kinds of packed rows: pairs of bucket and id, members with their link, and rows of the caller that travel along.
PAIRS, LINKS, EXTRA = 0, 1, 2
#: Gives the hashed elements of some contents, and the one that each is of, which does not fall; elements may repeat.
Elements = Callable[[list], tuple[np.ndarray, np.ndarray]]


def roots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (x, y), in order, and the smallest node that each reaches by these edges alone."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)  # every root but the least of its neighbours goes, so few turns are needed
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b): the smallest node that can be reached.

    Small-star and large-star steps in turn until every node hangs on one that hangs on nothing. Before and after edges
    are dealt by their larger node, each task puts its own stretch of them together, so a node has one edge a task at
    most, whatever its neighbours. Smaller nodes are found by a join of written rows as they are, one for each node, so
    that adaptive execution splits a hub's edges.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of a task as stars. ``open`` is kept, and set where a node has several smaller neighbours. ``own`` tells
        those of nodes that came as larger ones: once dealt, a node has one such edge. Others come of several neighbours only."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        hi, lo, still = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        several = (hi[1:] == hi[:-1]) & (lo[1:] != lo[:-1])
        node, root = roots(hi, lo)
        leaf = node != root
        mark = np.zeros(int(leaf.sum()), bool)
        mark[0] = still.any() or several.any()
        own = np.isin(node[leaf], hi)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[leaf], root[leaf], mark, own)], ["hi", "lo", "open", "own"])

    def put_together(found: DataFrame) -> DataFrame:
        kinds = "hi long, lo long, open boolean, own boolean"
        return table(found.mapInArrow(stars, kinds).repartition("hi").mapInArrow(stars, kinds), "edges")

    now = put_together(edges.selectExpr("greatest(a, b) as hi", "least(a, b) as lo", "false as open").where("lo < hi"))
    while True:
        # Each edge goes on to what its smaller node hangs on: that keeps what is connected, by induction on the nodes.
        low = now.where("own").select(F.col("hi").alias("u"), F.col("lo").alias("m"))
        moved = now.join(low.hint("merge"), F.col("lo") == F.col("u"), "left").select("hi", F.coalesce("m", "lo").alias("lo"), (F.col("m").isNotNull() | ~F.col("own")).alias("open"))
        then = put_together(moved)
        drop(now)
        now = then
        if now.where("open").isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo").distinct())


def slots_of(df: DataFrame) -> int:
    """Slots of the buckets' range; a reading task holds one at a time."""
    return SLOTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(signed: Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch | None]], slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from (ids, a row of buckets for each, rows of the caller's own).

    Rows of one id have the same buckets. ``seed`` deals out what belongs to no slot.
    """
    ids, keys, held = [], [], 0
    slot, kind, data = [], [], []

    def add(at: int, of: int, raw: bytes) -> None:
        slot.append(at % slots)
        kind.append(of)
        data.append(raw)

    def deal() -> None:
        own, first = np.unique(np.concatenate(ids), return_index=True)
        bands = np.concatenate(keys)[first]
        bucket, node = bands.view(np.uint64).ravel(), np.repeat(own, bands.shape[1])
        order = np.argsort(bucket)
        bucket, node = bucket[order], node[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        begin, large = np.repeat(starts, sizes), np.flatnonzero(np.repeat(sizes > 2, sizes))
        node[large] = node[large[np.lexsort((node[large], bucket[large]))]]  # ids ascend in the larger buckets
        more = np.arange(len(bucket)) - begin >= 2
        if more.any():
            found = [x[more] for x in (bucket, node, node[begin])]
            for at in range(0, len(found[0]), 65_536):
                add(seed * 7919 + at, LINKS, b"".join(x[at : at + 65_536].tobytes() for x in found))
        bucket, node = bucket[~more], node[~more]
        place = ((bucket >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)], strict=True):
            add(int(place[a]), PAIRS, bucket[a:b].tobytes() + node[a:b].tobytes())

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["slot", "kind", "data"])
        slot.clear()
        kind.clear()
        data.clear()
        return out

    for own, bands, extra in signed:
        if extra is not None and extra.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, extra.schema) as to:
                to.write_batch(extra)
            add(seed := seed * 31 + 7 & 0xFFFF_FFFF, EXTRA, sink.getvalue().to_pybytes())
        if len(own) and bands.shape[1]:
            ids.append(own)
            keys.append(bands)
            held += bands.size
        if held >= HELD:
            deal()
            yield rows()
            ids, keys, held = [], [], 0
    if held:
        deal()
    if slot:
        yield rows()


def travelled(shared: DataFrame, schema: str) -> DataFrame:
    """The caller's own rows that ``pack`` took along, out of what ``shared_buckets`` gives."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for found in pa.ipc.open_stream(data.as_py()).read_all().select(wanted.names).to_batches():
                    yield found

    return shared.where("extra is not null").select("extra").mapInArrow(run, schema)


def shared_buckets(packed: DataFrame) -> DataFrame:
    """bucket, id, hub of the members of buckets with two ids or more; hubs are members, and lead to the smallest id.
    Rows with extra hold what travelled along."""

    def members(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in data]
        bucket, node = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(bucket)
        bucket, node = bucket[order], node[order]
        same = bucket[1:] == bucket[:-1]
        some = np.r_[False, same] | np.r_[same, False]
        bucket, node = bucket[some], node[some]
        if not len(bucket):
            return bucket, node, node
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])]
        bucket, node = bucket[new], node[new]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        keep, hub = np.repeat(sizes > 1, sizes), np.repeat(node[starts], sizes)
        return bucket[keep], node[keep], hub[keep]

    def batch_of(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(cols[0]), pa.binary())], ["bucket", "id", "hub", "extra"])

    def extra(data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(data), pa.int64()) for _ in range(3)), pa.array(data, pa.binary())], ["bucket", "id", "hub", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            along = []
            for slot, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == LINKS:
                    yield batch_of(tuple(np.frombuffer(data, np.int64).reshape(3, -1)))
                    continue
                if kind == EXTRA:
                    along.append(data)
                    continue
                if slot != current:
                    if held:
                        yield batch_of(members(held))
                    held, current = [], slot
                held.append(data)
            if along:
                yield extra(along)
        if held:
            yield batch_of(members(held))

    return packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "bucket long, id long, hub long, extra binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct elements have 100 * intersection >= percent * union."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(both) - n)


def may_be_similar(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """False for those of some sets that can't be ``similar`` to x: the elements that have 16 bits in common with one of
    x are at least as many as the intersection. They are looked up, not sorted."""
    mark = np.zeros(1 << 16, np.uint8)
    mark[x.astype(np.uint16)] = 1
    sizes = np.array([len(y) for y in others], np.int64)
    total = np.r_[0, np.cumsum(mark[np.concatenate(others).astype(np.uint16)], dtype=np.int64)]
    ends = np.cumsum(sizes)
    most = np.minimum(total[ends] - total[ends - sizes], len(x))
    return 100 * most >= percent * (len(x) + sizes - most)


def agreeing(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids and la, lb of labels, different ones, of small buckets whose signatures agree in ``least`` of
    their bytes or more. ``rows`` has bucket, id, hub, label, sig. A member has met its hub in the first round."""

    def pairs(held: list[tuple]) -> list[tuple[int, int, int, int]]:
        ids, hubs, labels = (np.array([r[k] for r in held], np.int64) for k in range(3))
        sig = np.frombuffer(b"".join([r[3] for r in held]), np.uint8).reshape(len(held), -1)
        agree = np.count_nonzero(sig[:, None] == sig[None], axis=2)
        new = (labels[:, None] != labels[None]) & (ids[:, None] < ids[None]) & (hubs[:, None] != ids[None]) & (ids[:, None] != hubs[None])
        i, j = np.nonzero(new & (agree >= least * sig.shape[1]))
        return list(zip(ids[i].tolist(), ids[j].tolist(), labels[i].tolist(), labels[j].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current, out = None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["a", "b", "la", "lb"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current:
                    out += pairs(held) if held else []
                    held, current = [], row[0]
                held.append(row[1:])
            if len(out) > 20_000:
                yield batch_of()
                out = []
        out += pairs(held) if held else []
        yield batch_of()

    dealt = rows.select("bucket", "id", "hub", "label", "sig").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, la long, lb long").distinct()


def agreement(columns: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The share of coordinates in which signatures, one in each column, agree with one. Whole rows of bytes are compared
    and added, which is several times faster than the mean of each signature's few."""
    same = (columns == own[:, None]).view(np.uint8)
    return same.sum(0, dtype=np.uint8 if len(own) < 256 else np.uint32) / len(own)


def alike(blocks: DataFrame, percent: int, least: float, elements: Elements) -> DataFrame:
    """Pairs (a, b) of labels whose members are linked, as many as connect what a block has found.

    ``blocks`` has block, side, across, id, label, sig, content. Of members with different labels (and sides, where
    across), those whose signatures agree in ``least`` of their bytes or more are verified on their full sets.
    """

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[2]: r for r in rows}.values())
        across, side = rows[0][1], np.array([r[0] for r in rows])
        labels, comp = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
        if len(labels) < 2 or across and len(set(side.tolist())) < 2:
            return []
        sig = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8).reshape(len(rows), -1)
        columns = np.ascontiguousarray(sig.T)
        sets: dict[int, np.ndarray] = {}
        out, root = [], np.arange(len(labels))

        def elements_of(i: int) -> np.ndarray:
            if i not in sets:  # rows that follow are likely to be asked for too, and many short ones cost little more than one
                ends = np.cumsum([len(r[5]) for r in rows[i : i + BLOCK]])
                some = range(i, i + max(1, int(np.searchsorted(ends, TOGETHER, "right"))))
                x, owner = elements([rows[k][5] for k in some])
                cuts = np.searchsorted(owner, np.arange(len(some) + 1))
                for k, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.sort(x[a:b])
                    sets[k] = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
            return sets[i]

        for i in range(1, len(rows)):
            own = root[comp]
            other = np.flatnonzero((own[:i] != own[i]) & ((side[:i] != side[i]) | (not across)))
            if not len(other):
                continue
            agree = agreement(sig[other].T if 8 * len(other) < i else columns[:, :i], sig[i])
            agree = agree if 8 * len(other) < i else agree[other]
            near = np.flatnonzero(agree >= least)
            near = other[near[np.argsort(-agree[near], kind="stable")]]
            if len(near) > 1:
                near = near[may_be_similar(elements_of(i), [elements_of(j) for j in near.tolist()], percent)]
            for j in near.tolist():
                x, y = int(root[comp[i]]), int(root[comp[j]])
                if x != y and similar(elements_of(i), elements_of(j), percent):
                    out.append((int(labels[comp[i]]), int(labels[comp[j]])))
                    root[root == x] = y
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current, out = None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        def contents(column: pa.Array) -> list:
            lists = pa.types.is_list(column.type)
            return [x.values.to_numpy(zero_copy_only=False) for x in column] if lists else column.to_pylist()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), contents(batch.column(6)), strict=True):
                if row[0] != current:
                    out += links(held) if held else []
                    held, current = [], row[0]
                held.append(row[1:])
            if len(out) > 20_000:
                yield batch_of()
                out = []
        out += links(held) if held else []
        yield batch_of()

    dealt = blocks.select("block", "side", "across", "id", "label", "sig", "content").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def mixed_buckets(member: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, id, hub, label of the members, and bucket, main, apart, rest, all of the buckets with several labels: the
    commonest one, and the members that have another, and that one. Two members alone have met in the first round; of
    buckets with the same members one is looked at, since similar sets share several."""
    once = member.groupBy("bucket", "id").agg(F.min("hub").alias("hub"))
    labelled = once.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("bucket", "id", "hub", F.coalesce("label", "id").alias("label"))
    labelled = table(labelled, "labelled")
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("own"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"), F.bit_xor("own").alias("own"))
    mixed = mixed.where("labels > 1 and all > 2").groupBy("own", "all").agg(F.min(F.struct("bucket", "most")).alias("x")).select("x.*", "all")
    mixed = mixed.select("bucket", F.col("most.label").alias("main"), (F.col("all") - F.col("most.n")).alias("apart"), F.col("most.n").alias("rest"), "all")
    return labelled, table(mixed, "mixed")


def meetings(labelled: DataFrame, mixed: DataFrame) -> DataFrame:
    """block, side, across, id, label: the members of a bucket that are not in its largest component meet each other
    and all the rest, in blocks of BLOCK members a side."""
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(n)
    rows = labelled.join(mixed.select("bucket", "main", parts("apart"), parts("rest")), "bucket").withColumn("other", F.col("label") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("apart")).otherwise(F.col("rest"))).cast("int"))
    apart = F.sequence(F.lit(0), F.col("apart") - 1)
    met = lambda x, y, across, side: F.struct(F.xxhash64("bucket", x, y, across).alias("block"), side.alias("side"), (across | (x != y)).alias("across"))
    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    among = F.transform(apart, lambda q: met(F.least(own, q), F.greatest(own, q), no, own))
    beside = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda q: met(own, q, yes, F.lit(0)))
    of_rest = F.transform(apart, lambda q: met(q, own, yes, F.lit(1)))
    return rows.select("id", "label", F.explode(F.when(F.col("other"), F.concat(among, beside)).otherwise(of_rest)).alias("m")).select("m.*", "id", "label")


def similar_components(shared: DataFrame, contents_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], elements: Elements, percent: int, slack: float) -> DataFrame:
    """id, label of the sets in a component of two sets or more; label is the smallest id.

    ``shared``: a written table of ``shared_buckets``. ``contents_of`` gives id, sig (a byte of each coordinate), content
    for the ids of a table; ``verify`` the pairs (a, b) that are linked on their full contents. Of what the first round
    leaves, pairs whose signatures agree in less than ``percent`` / 100 - ``slack`` of the bytes are not verified; slack
    is four deviations or more of what the threshold makes likely.
    """
    member = shared.where("bucket is not null").select("bucket", "id", "hub")
    # Four joins by id read the contents: in buckets by id they are shuffled once.
    contents, forget = bucketed(contents_of(member.select("id").distinct()), "contents", "id")
    pairs = member.where("id <> hub").selectExpr("least(id, hub) as a", "greatest(id, hub) as b").distinct()
    links = table(verify(pairs, contents), "links")
    found = table(components(links), "components")
    drop(links)
    release(shared.sparkSession)
    # These tables grow with the corpus: their joins are shuffled at every size, never broadcast.
    least = percent / 100 - slack
    labelled, mixed = mixed_buckets(member, found)
    few = labelled.join(mixed.where(F.col("all") <= SMALL).select("bucket"), "bucket").join(contents.select("id", "sig").hint("merge"), "id")
    near = table(agreeing(few, least), "near")
    checked = near.join(verify(near.select("a", "b"), contents), ["a", "b"]).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    blocks = meetings(labelled, mixed.where(F.col("all") > SMALL)).join(contents.select("id", "sig", "content").hint("merge"), "id")
    more = table(checked.union(alike(blocks, percent, least, elements)).distinct(), "links")
    drop(labelled, mixed, near)
    forget()
    if more.isEmpty():
        return found.select(F.col("node").alias("id"), "label")
    merged = table(components(more), "components")
    label = found.join(merged.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    alone = merged.join(found, "node", "left_anti").select("node", "label")
    return table(label.union(alone), "components").select(F.col("node").alias("id"), "label")
