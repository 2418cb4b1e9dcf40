r"""MinHash near-dedup over an LSH forest.

Documents are linked if the Jaccard similarity of their sets of word shingles is at least
`percent`/100, confirmed on full sets. Words are `[^\x20\x09-\x0D]+` of the text with A-Z
lower-cased; a text with fewer words than a shingle has is one shingle, a text without words has an
empty set and is linked with nothing.

1. Sketch. One pass makes, per document, the size of its set, a 128-bit digest of the set, and a
   signature of `TREES * DEPTH + 4` minimum hashes. Documents with equal sets are one class from
   here on, reduced on the map side, so a group of exact copies is one row.
2. Forest. Every tree has its own order of the signature's columns and sorts the classes by it.
   The order is cut where neighbours share fewer than DEPTH columns; what lies between is a region,
   sorted and walked as a whole. Neighbours, whose common prefixes are the longest, are compared
   first and form runs; then members of different runs are, until all are joined or compared:
   estimates of `loose` or more, about five standard deviations under the threshold. Depth adapts:
   a region of more than `region` classes is cut at ever longer common prefixes, each cut's smallest
   member staying in the region above, so cuts stay joined. Members of cut regions that this leaves
   in several components are sorted by EXTRA further orders. The steps' components are candidate
   groups: every true link that shares a region lies inside one.
3. Confirmation. The texts of candidate groups, and only those, are read again, and a walk over
   exact intersections (postings of shingles, members not yet reached only) gives their true
   components. A group of more than `block` members is cut into blocks that are walked apart;
   then every member outside its group's largest component meets all other members of the group,
   block by block, so no link is lost and no task holds the whole group.
4. A document's component is the smallest doc_id among all documents of all linked classes.

At a similarity of 0.8, a pair shares a region in one of 20 trees of depth 3 with probability
1 - (1 - 0.512)^20 = 0.9999994. A region is cut only inside crowds of over `region` different texts
that are alike, but not near-copies (half of their words, say); for pairs in those the README gives
the recall as measured.

Null text has no words. Null doc_ids link like others but never become a component's id unless all
of it are null, in which case one class of them is kept. Repeated rows are kept alike (they share
the doc_id); `dedup_near` leaves one of them. An
empty table is fine. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plexigraph.llm._common import cache_of, if_small, parts, stash, table, trim
from plexigraph.llm.components import components

TREES, DEPTH = 20, 3
#: Further orders for members of cut regions.
EXTRA = 16
#: Longer prefixes that a round of cutting looks at.
LEVELS = 4
COLUMNS = TREES * DEPTH + 4
#: Counted rows (ids and hashes) up to which a side is broadcast rather than exchanged with the texts.
BROADCAST_ROWS = 500_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_FACTORS = np.random.default_rng(20).integers(0, 2**63, COLUMNS, dtype=np.uint64) * U(2) + U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if len(_POWERS[0]) < n:
        size = -(-n // 65536) * 65536
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, b, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted 64-bit shingle hashes of each text, all texts of a batch at once in numpy."""
    raw = [b"" if t is None else t.encode("utf-8").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text_at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    sums = np.concatenate([[U(0)], np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], dtype=U)])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(starts, text_at)
    n = max(0, len(word) - words + 1)
    rolled = np.zeros(n, U)
    for k in range(words):
        rolled = _mix(rolled * U(0xA0761D6478BD642F) + word[k : k + n])
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            x = np.zeros(1, U)
            for k in range(lo, hi):
                x = _mix(x * U(0xA0761D6478BD642F) + word[k : k + 1])
            out.append(x + U(hi - lo))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """COLUMNS minimum hashes, 32 bits each, of a set that isn't empty."""
    best = np.full(COLUMNS, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        best = np.minimum(best, ((shingles[at : at + 2048, None] * _FACTORS) >> U(32)).min(axis=0))
    return best.astype(np.uint32)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, n_shingles, digest, sig, keys): digest, sig and keys are null for empty sets."""

    def run(batches):
        cache_of("near_dedup")
        for part in parts(batches, 2, size=1 << 18):
            sets = shingle_sets(part.column(2).to_pylist(), words)
            sigs = [signature(s) if len(s) else None for s in sets]
            full = [s for s in sigs if s is not None]
            if full:
                m = np.stack(full)[:, : TREES * DEPTH].reshape(len(full), TREES, DEPTH).astype(U)
                keys = np.zeros((len(full), TREES), U) + np.arange(1, TREES + 1, dtype=U)
                for k in range(DEPTH):
                    keys = _mix(keys * U(0xA0761D6478BD642F) + m[:, :, k])
                rows = iter(keys.astype(np.int64).tolist())
            lists = [None if s is None else next(rows) for s in sigs]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "digest", "sig", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    return plain.mapInArrow(run, f"doc_id {kind}, h long, n_shingles long, digest binary, sig binary, keys array<long>")


def runs_of(batches, process, schema: pa.Schema):
    """process(table) for each run of rows with an equal first column, from batches sorted by it."""
    held = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != key[0].item():
            yield from process(pa.Table.from_batches(held))
            held = []
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            done = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
            k = done.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield from process(done.slice(lo, hi - lo))
        held.append(batch.slice(last))
    if held:
        yield from process(pa.Table.from_batches(held))


def walk_order(sigs: np.ndarray, loose: float) -> list[tuple[int, int]]:
    """Steps (from, to) that join what estimates of `loose` or more join, for a region in its tree's order.

    Neighbours in the order, which share the longest prefixes, are compared first and make runs. From
    the first run on, a walk then compares each member reached with the members of runs not reached
    yet, so a pair that is joined already costs nothing; members that are near to none cost the region.
    """
    near = (sigs[1:] == sigs[:-1]).mean(axis=1) >= loose
    steps = [(int(i), int(i) + 1) for i in np.flatnonzero(near)]
    run = np.concatenate([[0], np.cumsum(~near)])
    left = np.arange(len(sigs))
    while len(left):
        front = left[run[left] == run[left[0]]].tolist()
        left = left[run[left] != run[left[0]]]
        while front and len(left):
            x = front.pop()
            hit = left[(sigs[left] == sigs[x]).mean(axis=1) >= loose]
            if len(hit):
                runs, at = np.unique(run[hit], return_index=True)
                steps += [(x, int(y)) for y in hit[at]]
                new = np.isin(run[left], runs)
                front += left[new].tolist()
                left = left[~new]
    return steps


def walk_sets(sets: list[np.ndarray], percent: int, group: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join what is linked, by exact intersections.

    `group` labels members that are known to be joined; only links between different labels are
    looked for. Walks start from `seeds`, and members are compared with all not yet reached.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    order = np.argsort(value, kind="stable")
    owner, ids = owner[order], np.cumsum(np.concatenate([[False], value[order][1:] != value[order][:-1]])) if len(value) else order
    place = np.empty(len(order), np.int64)
    place[order] = ids
    first = np.searchsorted(ids, np.arange(int(ids[-1]) + 2)) if len(value) else np.zeros(1, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    label, links = group.copy(), []

    def near(i: int) -> np.ndarray:
        own = place[at[i] : at[i + 1]]
        a, b = first[own], first[own + 1]
        flat = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
        both = np.bincount(owner[flat], minlength=len(sets))
        return 100 * both >= percent * (size[i] + size - both)

    open_, seed = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    open_[:] = True
    seed[seeds] = True
    for s in seeds:
        if not open_[s]:
            continue
        front = [int(s)]
        open_[s] = False
        while front:
            x = front.pop()
            if not (label != label[x]).any():
                return links
            new = near(x) & (label != label[x])
            for y in np.flatnonzero(new):
                if label[y] != label[x]:
                    links.append((x, int(y)))
                    old = label[y]
                    label[label == old] = label[x]
            more = np.flatnonzero(new & open_ & seed)
            open_[more] = False
            front += more.tolist()
    return links


def _rotated() -> Column:
    """The signature in the order of the row's tree: from the tree's first column on, and round."""
    return F.expr(f"concat(substring(sig, tree * {4 * DEPTH} + 1), substring(sig, 1, tree * {4 * DEPTH}))")


def _cut_regions(large: DataFrame, region: int) -> DataFrame:
    """(key, rid, ordered): members of regions over the bound, dealt to the longer prefixes that bring them under it.

    A round counts the LEVELS next prefixes of every member at once. What is over the bound is few: at most
    a prefix and level for every `region` members.
    """
    large, ready, same = stash(large.select("key", "rid", "ordered", F.lit(DEPTH).alias("depth")), "large"), [], []
    path = ["key", *(f"p{k}" for k in range(LEVELS))]
    while large.limit(1).count():
        same.append(large.filter(F.col("depth") >= COLUMNS))
        large = large.filter(F.col("depth") < COLUMNS)
        paths = large
        for k in range(LEVELS):
            paths = paths.withColumn(path[k + 1], F.xxhash64(path[k], F.expr(f"substring(ordered, 4 * (depth + {k}) + 1, 4)")))
        cut = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(path[k]).alias("parent"), F.col(path[k + 1]).alias("child")) for k in range(LEVELS)]))
        nodes = paths.select("key", "rid", "depth", cut.alias("x")).groupBy("key", "depth", "x.level", "x.parent", "x.child")
        nodes = stash(nodes.agg(F.count("*").alias("n"), F.min("rid").alias("top")), "nodes")
        over = if_small(stash(nodes.filter(F.col("n") > region).select("child"), "over"), BROADCAST_ROWS)
        # A member goes down to its first prefix that isn't over the bound.
        key, more = F.col(path[LEVELS]), F.lit(True)
        for k in reversed(range(LEVELS)):
            paths = paths.join(over.select(F.col("child").alias(path[k + 1]), F.lit(True).alias(f"over{k}")), path[k + 1], "left")
            here = F.col(f"over{k}").isNull()
            key, more = F.when(here, F.col(path[k + 1])).otherwise(key), F.when(here, F.lit(False)).otherwise(more)
        inner = paths.select(key.alias("key"), "rid", "ordered", (F.col("depth") + LEVELS).alias("depth"), more.alias("more"))
        # The smallest member of every cut stays in the region above.
        tops = nodes.join(over.select(F.col("child").alias("parent"), F.lit(True).alias("split")), "parent", "left").filter("level = 0 or split")
        wide = stash(tops.groupBy("parent").count().filter(F.col("count") > region).select("parent", F.lit(True).alias("more")), "wide")
        tops = tops.join(if_small(wide, BROADCAST_ROWS), "parent", "left")
        tops = stash(tops.select("key", F.col("top").alias("rid"), F.xxhash64("parent", F.lit("tops")).alias("above"), (F.col("depth") + F.col("level") + 1).alias("next"), F.coalesce("more", F.lit(False)).alias("more")), "tops")
        tops = large.join(if_small(tops, BROADCAST_ROWS), ["key", "rid"]).select(F.col("above").alias("key"), "rid", "ordered", F.col("next").alias("depth"), "more")
        both = stash(inner.unionByName(tops), "cut")
        ready.append(both.filter("not more"))
        large = both.filter("more").drop("more")
    every = ready[0]
    for x in ready[1:]:
        every = every.unionByName(x)
    every = every.select("key", "rid", "ordered")
    # What no prefix parts has signatures that agree everywhere: dealt out, with one shared member.
    for large in same:
        if large.limit(1).count():
            large = large.join(large.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "rid", "ordered", "n")
            dealt = large.withColumn("part", F.expr(f"pmod(xxhash64(rid), cast(ceil(n / {region}) as int))"))
            shared = large.groupBy("key").agg(F.min(F.struct("rid", "ordered", "n")).alias("m")).select("key", "m.*").withColumn("part", F.explode(F.expr(f"sequence(0, cast(ceil(n / {region}) as int) - 1)")))
            parted = dealt.unionByName(shared.select(dealt.columns)).dropDuplicates(["key", "part", "rid"])
            every = every.unionByName(parted.select(F.xxhash64("key", "part").alias("key"), "rid", "ordered"))
    return every


def _walk(members: DataFrame, region: int, loose: float, crowded: bool) -> DataFrame:
    """(a, b): steps of the walks through members(key, rid, ordered, n), every region in its tree's order; stored.

    `crowded`: some n is over `region`.
    """
    if crowded:
        small = members.filter(F.col("n") <= region).select("key", "rid", "ordered")
        members = small.unionByName(_cut_regions(members.filter(F.col("n") > region), region))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def walk(t: pa.Table):
            ids = t.column(1).to_numpy()
            sigs = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint32).reshape(len(ids), COLUMNS)
            if steps := walk_order(sigs, loose):
                s = np.array(steps)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s[:, 0]]), pa.array(ids[s[:, 1]])], schema=schema)

        buffer, size = [], 0
        for x in runs_of(batches, walk, schema):
            buffer.append(x)
            size += x.num_rows
            if size > 50_000:
                yield pa.Table.from_batches(buffer).combine_chunks().to_batches()[0]
                buffer, size = [], 0
        if buffer:
            yield pa.Table.from_batches(buffer).combine_chunks().to_batches()[0]

    walked = members.select("key", "rid", "ordered").repartition("key").sortWithinPartitions("key", "ordered").mapInArrow(run, "a long, b long")
    return stash(walked, "steps")  # a next Python step in the same tasks would take a second worker for each core


def _shared(each: DataFrame) -> DataFrame:
    """each(key, rid, ...) with n, the members of its region, where there are two or more; stored."""
    return stash(each.join(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "regions")


def _more_orders(crowd: DataFrame) -> DataFrame:
    """(key, rid, ordered) of crowd(rid, sig) in EXTRA further orders: permutations of the columns."""
    orders = [np.random.default_rng([20, t]).permutation(COLUMNS) for t in range(EXTRA)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COLUMNS)
                for t, order in enumerate(orders):
                    own = np.ascontiguousarray(sigs[:, order])
                    keys = np.full(len(own), TREES + 1 + t, U)
                    for k in range(DEPTH):
                        keys = _mix(keys * U(0xA0761D6478BD642F) + own[:, k].astype(U))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), part.column(0), pa.array([r.tobytes() for r in own], pa.binary())], ["key", "rid", "ordered"])

    return crowd.select("rid", "sig").mapInArrow(run, "key long, rid long, ordered binary")


def forest_edges(classes: DataFrame, region: int, loose: float) -> DataFrame:
    """(a, b) between classes (rid, sig, keys): steps of the walks in all regions of all trees."""
    narrow = _shared(classes.select("rid", F.posexplode("keys").alias("tree", "key")))
    members = narrow.join(classes.select("rid", "sig"), "rid").select("key", "rid", _rotated().alias("ordered"), "n")
    crowded = narrow.filter(F.col("n") > region)
    any_ = crowded.limit(1).count() > 0
    steps = _walk(members, region, loose, any_)
    if not any_:
        return steps
    # Cut regions: a pair may have parted in every tree. What isn't joined yet meets in further orders.
    joined = crowded.join(components(steps).withColumnRenamed("id", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("component"))
    open_ = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    crowd = stash(classes.select("rid", "sig").join(joined.join(open_, "key", "left_semi").select("rid").distinct(), "rid", "left_semi"), "crowd")
    if not crowd.limit(1).count():
        return steps
    further = _shared(_more_orders(crowd))
    return steps.unionByName(_walk(further, region, loose, further.filter(F.col("n") > region).limit(1).count() > 0))


def _confirm(tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) confirmed links from tasks(task, rid, label, seed, text)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def walk(t: pa.Table):
            rid, keep = np.unique(t.column(1).to_numpy(), return_index=True)
            t = t.take(keep)
            label, seed = t.column(2).to_numpy(), t.column(3).to_numpy(zero_copy_only=False)
            texts, sets = t.column(4).to_pylist(), []
            for at in range(0, len(texts), 256):
                sets += shingle_sets(texts[at : at + 256], words)
            if links := walk_sets(sets, percent, label, np.flatnonzero(seed)):
                s = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(rid[s[:, 0]]), pa.array(rid[s[:, 1]])], schema=schema)

        yield from runs_of(batches, walk, schema)
        trim()

    return tasks.select("task", "rid", "label", "seed", "text").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int, block: int, block_shingles: int = 2_000_000) -> DataFrame:
    """(a, b): links that join what is linked inside the candidate groups(id, component)."""
    found = groups.select(F.col("id").alias("rid"), "component").join(classes.select("rid", "rep", "n_shingles"), "rid")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    pieces = F.ceil(F.greatest(F.col("n") / block, F.col("s") / block_shingles)).cast("int")
    found = stash(found.join(sizes.select("component", pieces.alias("parts")), "component").select("rid", "component", "parts", F.col("rep.doc_id").alias("rd"), F.col("rep.h").alias("rh")), "candidates")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    texts = keyed.join(if_small(found, BROADCAST_ROWS), keyed["doc_id"].eqNullSafe(found["rd"]) & (keyed["h"] == found["rh"])).select("rid", "component", "parts", "text")
    large = found.filter("parts > 1").limit(1).count() > 0
    texts = stash(texts, "candidate-texts") if large else texts
    own = texts.withColumn("task", F.xxhash64("component", F.expr("pmod(xxhash64(rid), parts)"))).select("task", "rid", F.col("rid").alias("label"), F.lit(True).alias("seed"), "text")
    links = stash(_confirm(own, words, percent), "links")
    if not large:
        return links

    # Groups of several blocks: first the joined part of each block meets the others' by one member each.
    big = texts.filter("parts > 1")
    for _ in range(2):
        labels = components(links).withColumnRenamed("id", "rid").withColumnRenamed("component", "label")
        now = stash(big.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "labelled")
        counts = now.groupBy("component", "label").agg(F.count("*").alias("m"), F.min("rid").alias("top"))
        main = counts.groupBy("component").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("component", "k", F.col("x.label").alias("main"))
        if _ == 0:
            tops = now.join(counts.select("component", "label", F.col("top").alias("rid")), ["component", "label", "rid"], "left_semi").join(main, "component")
            deal = tops.withColumn("task", F.xxhash64("component", F.expr(f"pmod(xxhash64(rid), cast(ceil(k / {block}) as int))"), F.lit("tops")))
            links = stash(links.unionByName(_confirm(deal.select("task", "rid", "label", F.lit(True).alias("seed"), "text"), words, percent)), "links")
    # Then whatever isn't in its group's largest part meets the rest of the group, block by block.
    rest = now.join(main, "component").withColumn("in_main", F.col("label") == F.col("main"))
    n = rest.groupBy("component").agg(F.count_if("in_main").alias("nm"), F.count_if(~F.col("in_main")).alias("nr"))
    rest = rest.join(n, "component").withColumn("pm", F.expr(f"cast(ceil(nm / {block}) as int)")).withColumn("pr", F.expr(f"cast(ceil(nr / {block}) as int)"))
    rest = rest.withColumn("own", F.when(F.col("in_main"), F.expr("pmod(xxhash64(rid), pm)")).otherwise(F.expr("pmod(xxhash64(rid), pr)")).cast("int"))
    pairs = F.expr("""case when in_main then transform(sequence(0, pr - 1), r -> named_struct('r', r, 'o', own, 'm', true))
        else concat(transform(sequence(0, pm - 1), o -> named_struct('r', own, 'o', o, 'm', true)),
                    transform(sequence(0, pr - 1), o -> named_struct('r', least(own, o), 'o', greatest(own, o), 'm', false))) end""")
    dealt = rest.withColumn("pair", F.explode(F.array_distinct(pairs))).withColumn("task", F.xxhash64("component", "pair.r", "pair.o", "pair.m"))
    return links.unionByName(stash(_confirm(dealt.select("task", "rid", "label", (~F.col("in_main")).alias("seed"), "text"), words, percent), "links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, region: int = 1000, block: int = 1500) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept): one row per document."""
    rows = stash(sketch(docs, words), "sketch")
    full = rows.filter("n_shingles > 0")
    grouped = full.groupBy("digest").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = stash(grouped.withColumn("rid", F.monotonically_increasing_id()), "classes")
    spread = (percent * (100 - percent)) ** 0.5 / 100 / COLUMNS**0.5
    groups = components(forest_edges(classes, region, percent / 100 - 5 * spread))
    joined = components(confirmed_links(docs, classes, groups, words, percent, block))
    named = classes.select("digest", "rid", "low").join(joined.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("component", "rid"))
    lows = named.filter(F.col("component").isNotNull()).groupBy("root").agg(F.min("low").alias("least"))
    ids = named.join(lows, "root", "left").select("digest", F.coalesce("least", "low").alias("component_id"), (F.col("rid") == F.col("root")).alias("is_root"))
    # Documents without words stay out of the join: all of them would share its null key.
    wordless = rows.filter("digest is null").select("digest", "doc_id", "h", "n_shingles", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("component_id"), F.lit(None).cast("boolean").alias("is_root"))
    out = rows.filter("digest is not null").select("doc_id", "h", "n_shingles", "digest").join(ids, "digest", "left").select(wordless.columns).unionByName(wordless)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component) & (F.col("doc_id").isNotNull() | F.coalesce("is_root", F.lit(True)))
    return out.select("doc_id", F.col("h").alias("text_hash"), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def dedup_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns as they were.

    Of repeated rows (equal id and text) one stays.
    """
    flags = stash(near_duplicates(docs, words, percent), "near")
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__h"))
    gone = stash(flags.filter("not kept").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct(), "gone")
    left = docs.join(if_small(gone, BROADCAST_ROWS), same, "left_anti")
    if flags.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        left = left.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return left


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
