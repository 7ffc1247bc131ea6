"""SimHash near-duplicates by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corroborate.llm.common import mix, query, table, with_guess
from corroborate.session import stage

#: Bits of a fingerprint, and the parts by which an error budget is spread.
BITS, PARTS = 64, 4
_PART = BITS // PARTS
_FRONTIER = 1 << 17
_SHINGLES = 1 << 16
_COLUMNS = 1 << 11
#: Reps of a block's largest group, by which blocks are joined.
_REPS = 64


def fingerprint(text: str | None, width: int = 3) -> tuple[int, int]:
    """SimHash of the text, and a second one of rehashed shingles, as signed 64-bit numbers: a bit is set if over half of the hashes set it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, 0
    width = min(width, len(words))
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    ones = np.zeros(2 * BITS, dtype=np.int64)
    for start in range(0, n, _SHINGLES):
        size = min(_SHINGLES, n - start)
        hashes = np.fromiter(map(xxh64_intdigest, islice(shingles, size), repeat(42)), dtype=np.uint64, count=size)
        both = np.stack([hashes, mix(hashes)], axis=1).astype(">u8").view(np.uint8)
        ones += np.unpackbits(both.reshape(size, -1), axis=1).sum(axis=0, dtype=np.int64)
    first, second = np.packbits(2 * ones > n).view(">i8")
    return int(first), int(second)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, text_hash, fingerprint, second)`` per row of ``docs``; a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py(), width) for text in batch.column(2)], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=[id_col, "text_hash", "fingerprint", "second"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_hash long, fingerprint long, second long")


def schedule(budget: int) -> np.ndarray:
    """Errors allowed by the time a bit (63 first) is compared.

    Among the four turns of a pair's fingerprints by a part each, there is one
    in which the first i parts hold at most i quarters of the errors, for every
    i (the cycle lemma). So walking all four turns under this schedule finds
    every pair within the budget.
    """
    return np.array([budget * (PARTS - bit // _PART) // PARTS for bit in range(BITS)])


def _split(ones: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high - (ones[high] - ones[low])


def trie_pairs(left: np.ndarray, right: np.ndarray | None, first_bit: int, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted keys whose differing bits stay within ``allowed`` (see :func:`schedule`).

    The tries of both sides are walked together, a pair of nodes at a time:
    a step goes one bit down, adds one for children on different sides and
    drops pairs over the budget. ``right`` None joins ``left`` with itself.
    Bits above ``first_bit`` may differ between the sides, but not within one.
    """
    itself = right is None
    other = left if itself else right
    if not len(left) or not len(other):
        return
    begun = 0 if itself else int(np.bitwise_count((left[0] ^ other[0]) >> np.uint64(first_bit + 1))) if first_bit < 63 else 0
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ones(bit: int) -> tuple[np.ndarray, np.ndarray]:
        if bit not in sums:
            each = [np.concatenate([[0], np.cumsum((side >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) for side in ([left] if itself else [left, other])]
            sums[bit] = (each[0], each[-1])
        return sums[bit]

    stack = [(first_bit, np.array([[0], [len(left)], [0], [len(other)], [begun]], dtype=np.int64))]
    while stack:
        bit, nodes = stack.pop()
        nodes = nodes[:, nodes[4] <= allowed[min(bit + 1, BITS - 1)]]
        a, b, c, d, e = nodes
        few = ((b - a) * (d - c) <= 8) | (bit < 0)
        if few.any():
            a0, b0, c0, d0 = (x[few] for x in (a, b, c, d))
            sizes = (b0 - a0) * (d0 - c0)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wide = np.repeat(d0 - c0, sizes)
            i, j = np.repeat(a0, sizes) + place // wide, np.repeat(c0, sizes) + place % wide
            differ = left[i] ^ other[j]
            good = i < j if itself else np.ones(len(i), dtype=bool)
            for shift in range(0, BITS, _PART):
                good &= np.bitwise_count(differ >> np.uint64(shift)) <= allowed[shift]
            if good.any():
                yield i[good], j[good]
            nodes = nodes[:, ~few]
            a, b, c, d, e = nodes
        if not nodes.shape[1]:
            continue
        if nodes.shape[1] > _FRONTIER:
            middle = nodes.shape[1] // 2
            stack += [(bit, nodes[:, :middle]), (bit, nodes[:, middle:])]
            continue
        of_left, of_right = ones(bit)
        m, n = _split(of_left, a, b), _split(of_right, c, d)
        same = (a == c) & (b == d) if itself else np.zeros(len(a), dtype=bool)
        children = [
            np.stack([a, m, c, n, e]),
            np.stack([m, b, n, d, e]),
            np.stack([a, m, n, d, e + 1]),
            np.stack([m, b, c, n, e + 1])[:, ~same],
        ]
        children = np.concatenate(children, axis=1)
        stack.append((bit - 1, children[:, (children[1] > children[0]) & (children[3] > children[2])]))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of ``n``."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _turn(key: np.ndarray, bits: int) -> np.ndarray:
    return (key << np.uint64(bits)) | (key >> np.uint64(BITS - bits)) if bits else key


def links(prints: DataFrame, budget: int = 2, both: int | None = None, leaf: int = 4096) -> DataFrame:
    """Links ``(u, v)`` that join all values of ``prints.fingerprint`` within ``budget`` differing bits.

    The trie is walked once for each of four turns, under :func:`schedule`.
    Subtries below about ``leaf`` keys are the unit of work; a subtrie also
    goes to those whose path differs in no more bits than the first part's
    share. With ``both``, two fingerprints are linked only if they and their
    second ones differ in at most that many of all 128 bits, and pairs are also
    looked for by the second ones. Each unit gives a star per group it finds,
    not all pairs.
    """
    keys = prints.where("fingerprint is not null").groupBy(F.col("fingerprint").alias("key")).agg(F.min("second").alias("second"))
    keys = stage(keys, "simhash-keys")
    n = keys.count()
    depth = max(0, min(_PART, math.ceil(math.log2(n / leaf)))) if n > leaf else 0
    allowed = schedule(budget)
    share = int(allowed[-1])
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << depth) if m.bit_count() <= share))
    schema = "u long, v long"

    def walk(bits: int, name: str) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            node = group.column("node")[0].as_py()
            key = _turn(group.column("walked").to_numpy().view(np.uint64), bits)
            order = np.argsort(key, kind="stable")
            key, second, names = key[order], group.column("other").to_numpy().view(np.uint64)[order], group.column(name).to_numpy()[order]
            at = (key >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(key), dtype=np.int64)
            home = np.flatnonzero(at == node)
            own = key[home]

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for guest in np.unique(at) if len(home) else []:
                    there = np.flatnonzero(at == guest)
                    for i, j in trie_pairs(own, None if guest == node else key[there], BITS - 1 - depth, allowed):
                        i, j = home[i], there[j]
                        if both is not None:
                            near = np.bitwise_count(key[i] ^ key[j]) + np.bitwise_count(second[i] ^ second[j]) <= both
                            i, j = i[near], j[near]
                        yield i, j

            root = _forest(len(key), pairs())
            tied = np.flatnonzero(root != np.arange(len(key)))
            return pa.table({"u": names[tied], "v": names[root[tied]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

        return run

    out = None
    for walked, other in [("key", "second"), ("second", "key")][: 1 if both is None else 2]:
        rows = keys.select(F.col(walked).alias("walked"), F.col(other).alias("other"))
        for bits in range(0, BITS, _PART):
            turned = F.shiftleft("walked", bits).bitwiseOR(F.shiftrightunsigned("walked", BITS - bits)) if bits else F.col("walked")
            own = rows.withColumn("own", F.shiftrightunsigned(turned, BITS - depth) if depth else F.lit(0).cast("long"))
            # a node also goes to nodes near it of a smaller path, so that each two meet once
            nodes = F.filter(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m)), lambda x: x <= F.col("own"))
            units = own.select("walked", "other", F.explode(nodes).alias("node"))
            found = units.groupBy("node").applyInArrow(walk(bits, "walked" if walked == "key" else "other"), schema)
            out = found if out is None else out.unionByName(found)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` but the roots, the smallest nodes of their components.

    Large-star and small-star rounds: minima by aggregation with map-side
    combine and a join back, so no node's neighbours are gathered. Only a row
    count and a checksum of each round reach the driver.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, both: int | None = None, leaf: int = 4096) -> DataFrame:
    """``(id, text_hash, fingerprint, root)`` per row: ``root`` is the fingerprint that names the row's group.

    Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows stay repeated; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    tied = components(links(prints, budget, both, leaf))
    roots = tied.withColumnsRenamed({"node": "fingerprint"})
    return prints.join(roots, "fingerprint", "left").select(id_col, "text_hash", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, leaf: int = 4096) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row, the component named by its smallest id (null if it has none)."""
    found = stage(groups(docs, id_col, text_col, width, budget, None, leaf), "simhash-groups")
    names = found.groupBy("root").agg(F.min(id_col).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.join(names, "root").select(id_col, hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles; the whole text is one if it has fewer than ``width`` words."""
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64))


def sketch(hashes: np.ndarray, prints: int) -> list[int]:
    """``prints`` SimHash fingerprints of a shingle set, each from its own rehash, as signed 64-bit numbers."""
    ones = np.zeros(prints * BITS, dtype=np.int64)
    salts = np.arange(prints, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(hashes), _SHINGLES):
        each = mix(hashes[start : start + _SHINGLES, None] + salts).astype(">u8")
        ones += np.unpackbits(each.view(np.uint8).reshape(len(each), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">i8").tolist()


def least_hashes(hashes: np.ndarray, similarity: float, most: int = 32) -> np.ndarray:
    """The least of a set's hashes: at most ``most``, and so many that a set of at least ``similarity`` has one of them in common."""
    return hashes[: min(most, len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1)]


def outlines(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """``(id, text_hash, node, least)`` per row: ``node`` names the text's shingle set, ``least`` are its least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, least = [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), width)
                nodes.append(int(np.uint64(xxh64_intdigest(hashes.tobytes(), seed=42)).astype(np.int64)))
                least.append(least_hashes(hashes, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=[id_col, "text_hash", "node", "least"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_hash long, node long, least array<long>")


def held_elsewhere(nodes: DataFrame, share: float = 0.2) -> DataFrame:
    """``(node)`` of the sets of which others hold a ``share`` of the least hashes, one at least.

    A set that shares 0.8 of its hashes with another holds about as large a
    part of its least ones in common; with none in common it has no near copy.
    """
    each = nodes.select("node", F.size("least").alias("size"), F.explode("least").alias("h"))
    shared = each.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h")
    found = each.join(shared, "h").groupBy("node", "size").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= F.greatest(F.lit(1.0), F.col("size") * share)).select("node")


def drawn_sets(texts: DataFrame, width: int, prints: int) -> DataFrame:
    """``(node, hashes, f0, f1, ...)`` per row of ``texts(node, text)``: the shingle set and its fingerprints."""
    names = [f"f{k}" for k in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            columns = np.array([sketch(hashes, prints) for hashes in sets], dtype=np.int64).reshape(-1, prints).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), *map(pa.array, columns)], names=["node", "hashes", *names])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>, " + ", ".join(f"{name} long" for name in names))


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose Jaccard similarity is at least ``similarity``; ``right`` None compares ``left`` with itself."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, held = np.repeat(np.arange(len(sets)), sizes), counts[column] > 1
    row, column = row[held], (np.cumsum(counts > 1) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    first, other = slice(0, len(left)), slice(0 if right is None else len(left), len(sets))
    shared = np.zeros((len(left), len(sets) - other.start))
    for start in range(0, int((counts > 1).sum()), _COLUMNS):
        low, high = np.searchsorted(column, [start, start + _COLUMNS])
        present = np.zeros((len(sets), int(column[high - 1]) - start + 1), dtype=np.float32)
        present[row[low:high], column[low:high] - start] = 1
        shared += present[first] @ present[other].T
    union = sizes[first, None] + sizes[None, other] - shared
    near = (shared >= similarity * union - 1e-9) & (union > 0)
    return np.nonzero(np.triu(near, 1) if right is None else near)


def thinned(found: DataFrame) -> DataFrame:
    """``found(u, v)`` with as many links as join the same values: each key's links go to its least neighbour.

    ``v`` names a group that a unit found, so a key has as many links as units
    found it, and few names have many keys: what is left is a link per key and
    one per two names that share a key.
    """
    held = found.groupBy("u").agg(F.collect_set("v").alias("vs"))
    ends = F.explode(F.concat(F.array("u"), "vs"))
    return held.select(ends.alias("u"), F.least("u", F.array_min("vs")).alias("v")).where("u <> v").distinct()


def candidates(nodes: DataFrame, prints: int, budget: int, both: int, leaf: int = 16384) -> DataFrame:
    """``(node, root)``: components of the sets that any pair of fingerprints finds near (see :func:`links`)."""
    edges = None
    for k in range(0, prints, 2):
        pair = nodes.select("node", F.col(f"f{k}").alias("fingerprint"), F.col(f"f{k + 1}").alias("second"))
        named = stage(pair.groupBy("fingerprint").agg(F.min("node").alias("rep")), "near-names")
        found = stage(thinned(links(pair, budget, both, leaf)), "near-links")
        found = found.join(named.withColumnsRenamed({"fingerprint": "u", "rep": "a"}), "u").join(named.withColumnsRenamed({"fingerprint": "v", "rep": "b"}), "v")
        equal = pair.join(named, "fingerprint").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
        found = found.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(equal)
        edges = found if edges is None else edges.unionByName(found)
    return components(edges)


def _near(hashes: list[np.ndarray], similarity: float, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near sets, compared tile by tile."""
    for a in range(0, len(hashes), tile):
        for b in range(a, len(hashes), tile):
            i, j = similar(hashes[a : a + tile], None if a == b else hashes[b : b + tile], similarity)
            yield i + a, j + b


def _sets(group: pa.Table) -> list[np.ndarray]:
    return [np.asarray(h.values).view(np.uint64) for h in group.column("hashes")]


def _within(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """``(root, node, label, rep, size)`` for a block: its sets by group, and a few of the largest group to stand for it."""

    def run(group: pa.Table) -> pa.Table:
        names = group.column("node").to_numpy()
        root = _forest(len(names), _near(_sets(group), similarity))
        sizes = np.bincount(root, minlength=len(names))
        rep = np.zeros(len(names), dtype=bool)
        rep[np.flatnonzero(root == sizes.argmax())[:_REPS]] = True
        return pa.table({"root": group.column("root"), "node": names, "label": names[root], "rep": rep, "size": sizes[root]})

    return run


def _joined(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """``(root, label, merged, main)`` for the blocks of a component: which of their largest groups are one, and whether it is the largest of all."""

    def run(group: pa.Table) -> pa.Table:
        names, first = np.unique(group.column("label").to_numpy(), return_index=True)
        own = np.searchsorted(names, group.column("label").to_numpy())
        pairs = ((own[i], own[j]) for i, j in _near(_sets(group), similarity))
        root = _forest(len(names), pairs)
        total = np.bincount(root, weights=group.column("size").to_numpy()[first], minlength=len(names))
        return pa.table({"root": np.full(len(names), group.column("root")[0].as_py()), "label": names, "merged": names[root], "main": root == total.argmax()})

    return run


def _across(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Links ``(u, v)`` between a block's sets and sets of other blocks that visit it."""

    def run(group: pa.Table) -> pa.Table:
        names, guest, sets = group.column("node").to_numpy(), group.column("guest").to_numpy(zero_copy_only=False), _sets(group)
        hosts, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        if not len(hosts) or not len(guests):
            return out.empty_table()
        i, j = similar([sets[x] for x in hosts], [sets[x] for x in guests], similarity)
        root = _forest(len(names), iter([(hosts[i], guests[j])]))
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"u": names[tied], "v": names[root[tied]]}, schema=out)

    return run


def verified(sets: DataFrame, similarity: float, block: int = 1024, size: int = 1 << 21) -> DataFrame:
    """Links ``(u, v)`` that join all of ``sets(root, node, hashes)`` of one root whose exact Jaccard similarity is at least ``similarity``.

    A root's sets are dealt to blocks by their hash, of about ``block`` sets
    and ``size`` hashes; a block's sets are compared in one task, which ends
    most roots. Of a root with more blocks, a few sets of each block's largest
    group are compared next, which finds the group that most of the root's sets
    are in. Two of its members need no comparison: only sets outside it visit
    the other blocks. So a large group of near copies costs a link a member,
    and the square is that of the sets outside it.
    """
    shape = "u long, v long"
    count = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("hashes")) / size))
    blocks = sets.groupBy("root").agg(count.alias("m"))
    dealt = stage(sets.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), "m")), "near-blocks")
    own = dealt.select("root", "own", "node", "hashes").groupBy("root", "own").applyInArrow(_within(similarity), "root long, node long, label long, rep boolean, size long")
    labels = stage(own, "near-labels")
    found = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    large = dealt.where("m > 1")
    if large.isEmpty():
        return found

    held = stage(large.join(labels, ["root", "node"]), "near-large")
    joined = stage(held.where("rep").select("root", "label", "size", "hashes").groupBy("root").applyInArrow(_joined(similarity), "root long, label long, merged long, main boolean"), "near-joined")
    found = found.unionByName(joined.where("label <> merged").select(F.col("label").alias("u"), F.col("merged").alias("v")))
    marked = held.join(joined.where("main").select("root", "label", "main"), ["root", "label"], "left").select("root", "node", "hashes", "own", "m", F.col("main").isNull().alias("apart"))
    chunks = marked.where("apart").groupBy("root").agg(count.alias("c"))
    marked = stage(marked.join(chunks, "root"), "near-apart")
    at = F.sequence(F.lit(0).cast("long"), F.col("c") - 1)
    hosts = marked.select("root", "node", "hashes", F.lit(False).alias("guest"), F.col("own").alias("at"), F.explode(at).alias("chunk"))
    there = F.filter(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda x: x != F.col("own"))
    guests = marked.where("apart").select("root", "node", "hashes", F.lit(True).alias("guest"), F.explode(there).alias("at"), F.pmod(F.xxhash64("node", F.lit(1)), "c").alias("chunk"))
    return found.unionByName(hosts.unionByName(guests).groupBy("root", "at", "chunk").applyInArrow(_across(similarity), shape))


def near_groups(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, prints: int, budget: int, both: int) -> DataFrame:
    """``(id, text_hash, root)`` per row: single linkage of texts whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Sets of which no other holds enough of the least hashes have no near copy
    and end there. Of the others fingerprints are drawn, which only look for
    candidates; within a component of candidates the sets are compared. Texts
    without words are one group.
    """
    drawn = stage(outlines(docs, id_col, text_col, width, similarity), "simhash")
    nodes = stage(drawn.dropDuplicates(["node"]), "simhash-nodes")
    asked = stage(nodes.join(held_elsewhere(nodes), "node").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), "node"), "near-asked")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    # most texts are not asked for, and not shuffled; the key's partitions also bring rows that repeat together
    key = F.xxhash64("id", "hash").alias("key")
    guessed = with_guess(texts, asked, ["id", "hash"]).where("guess").select(key, "id", "hash", "text")
    wanted = asked.select(key, F.col("id").alias("_id"), F.col("hash").alias("_hash"), "node")
    texts = guessed.join(wanted, "key").where(F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    texts = texts.select("key", "node", "text").dropDuplicates(["key", "node"]).select("node", "text")
    sets = stage(drawn_sets(texts, width, prints), "near-sets")
    tied = stage(candidates(sets.drop("hashes"), prints, budget, both), "near-candidates")
    tied = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    roots = components(verified(sets.select("node", "hashes").join(tied, "node").select("root", "node", "hashes"), similarity))
    return drawn.select(id_col, "text_hash", "node").join(roots, "node", "left").select(id_col, "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, prints: int = 6, budget: int = 11, both: int = 34) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one of the smallest id, null ids last; repeated rows once.

    Two texts are linked if the Jaccard similarity of their sets of different
    shingles (64-bit hashes) is at least ``similarity``. Two texts that share
    0.8 of their shingles differ in 0.15 of a fingerprint's bits on average:
    candidates share some least hashes with others, and lie within ``budget`` of 64 bits by one of ``prints``
    fingerprints, and within ``both`` of 128 with the fingerprint beside it.
    """
    found = stage(near_groups(docs, id_col, text_col, width, similarity, prints, budget, both), "simhash-groups")
    best = F.min(F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col("text_hash"))).alias("best")
    first = found.groupBy("root").agg(best).select("root", F.col("best.id").alias("_id"), F.col("best.text_hash").alias("_hash"))
    stays = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    told = stage(found.join(first, "root").groupBy(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), stays.alias("stays")).agg(F.count("*").alias("n")), "simhash-kept")
    gone = told.where("not stays").select("id", "hash")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row"))
    # rows that no guess names stay where they are
    guessed = with_guess(rows, gone, ["id", "hash"])
    lost = gone.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    named = guessed.where("guess").join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti")
    kept = guessed.where("not guess").unionByName(named)
    if not told.where("stays and n > 1").isEmpty():  # rows repeated whole; else the texts need no second look
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select("row.*")


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
