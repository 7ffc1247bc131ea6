"""Exact duplicates: Patricia tries of whole texts in partitions by length and content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import stage

#: Bytes that a trie may hold in a task, and what a node and a row count for besides their bytes.
BUDGET = 64 << 20
_NODE, _ROW = 400, 120
_SLICE, _OUT = 1000, 8 << 20


class Trie:
    """A Patricia trie of byte strings with an entry at each one's end.

    A node is ``[label, children by first byte, entry, gone]``. A subtree that
    was evicted leaves a node marked as gone; strings below it are refused.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, False]
        self.held = 0

    def place(self, data: bytes) -> list | None:
        """The node at which ``data`` ends, made if needed; None if it lies in an evicted subtree."""
        node, at, size = self.root, 0, len(data)
        while at < size and not node[3]:
            child = node[1].get(data[at])
            if child is None:
                child = [data[at:], {}, None, False]
                node[1][data[at]] = child
                self.held += size - at + _NODE
                return child
            label = child[0]
            if not data.startswith(label, at):
                shared = _shared(label, data, at)
                upper = [label[:shared], {label[shared]: child}, None, False]
                child[0] = label[shared:]
                node[1][data[at]] = upper
                self.held += _NODE
                node, at = upper, at + shared
            else:
                node, at = child, at + len(label)
        return None if node[3] else node

    def evict(self) -> list[tuple[bytes, object]]:
        """Cut off the heaviest subtree that is not all of the trie and return its strings with their entries; nothing if there is but one string."""
        node, prefix = self.root, b""
        while node[2] is None and len(node[1]) == 1:
            (node,) = node[1].values()
            prefix += node[0]
        live = [child for child in node[1].values() if not child[3]]
        if not live or (len(node[1]) == 1 and node[2] is None):
            return []
        sizes = [sum(len(n[0]) + _NODE for n, _ in _nodes(child, b"")) for child in live]
        weight, child = max(zip(sizes, live, strict=True), key=lambda x: x[0])
        out = list(entries(child, prefix))
        child[1], child[2], child[3] = {}, None, True
        self.held -= weight
        return out


def _shared(label: bytes, data: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``data`` from ``at``, by bisection over comparisons of slices."""
    low, high = 0, min(len(label), len(data) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if data.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _nodes(node: list, prefix: bytes) -> Iterator[tuple[list, bytes]]:
    stack = [(node, prefix)]
    while stack:
        now, above = stack.pop()
        whole = above + now[0]
        yield now, whole
        stack += [(child, whole) for child in now[1].values()]


def entries(node: list, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
    """The strings that end in a subtree, with their entries."""
    return ((whole, now[2]) for now, whole in _nodes(node, prefix) if now[2] is not None)


def _before(a, b, largest: bool) -> bool:
    """Whether id ``a`` stays rather than ``b``; a null id only if there is no other."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


def _local(rows: DataFrame, kind: str, largest: bool, budget: int) -> DataFrame:
    """``(id, class, n, size, text)`` per row: equal texts of a task have one class, and its row that may stay carries text, bytes and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        id_type = None
        trie, ids, classes, serial = Trie(), [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            owners = {entry[1]: (data, entry[2]) for data, entry in entries(trie.root)}
            at = 0
            while at < len(ids):
                texts, counts, sizes, held, end = [], [], [], 0, at
                while end < len(ids) and held < _OUT and end - at < 10 * _SLICE:
                    data, n = owners.pop(end, (None, None))
                    texts.append(data)
                    counts.append(n)
                    sizes.append(None if data is None else len(data))
                    held += len(data or b"")
                    end += 1
                columns = [pa.array(ids[at:end], id_type), pa.array(classes[at:end], pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "n", "size", "text"])
                at = end

        for whole in batches:
            id_type = whole.column(0).type
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    node = trie.place(text.as_py())
                    if node[2] is None:
                        node[2] = [base | serial, len(ids), 0, key]
                        serial += 1
                    entry = node[2]
                    if _before(key, entry[3], largest):
                        entry[1], entry[3] = len(ids), key
                    entry[2] += 1
                    ids.append(key)
                    classes.append(entry[0])
                    if trie.held + _ROW * len(ids) > budget:
                        yield from emit()
                        trie, ids, classes = Trie(), [], []
        yield from emit()

    return rows.mapInArrow(run, f"id {kind}, class long, n long, size long, text binary")


def _resolve(owners: DataFrame, kind: str, largest: bool, budget: int) -> DataFrame:
    """Insert ``(text, id, class, n, members)`` into one trie per task.

    A row without text is a finished one: the id and class that stay, the
    number of rows, all classes of the text and its digest. A row with text
    was cut off with its subtree, to be inserted again in another round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = Trie(), None

        def table_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            at = 0
            while at < len(rows):
                end, held = at, 0
                while end < len(rows) and held < _OUT and end - at < _SLICE:
                    held += len(rows[end][0] or b"") + 8 * len(rows[end][4])
                    end += 1
                columns = list(zip(*rows[at:end], strict=True))
                kinds = [pa.binary(), id_type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "id", "class", "n", "members", "digest"])
                at = end

        for whole in batches:
            id_type = whole.column(1).type
            for start in range(0, whole.num_rows, _SLICE):
                refused = []
                for text, *rest in zip(*whole.slice(start, _SLICE).columns, strict=True):
                    data = text.as_py()
                    key, label, n, members = (x.as_py() for x in rest)
                    node = trie.place(data)
                    if node is None:
                        refused.append((data, key, label, n, members, None))
                        continue
                    trie.held += 8 * len(members)
                    if node[2] is None:
                        node[2] = [key, label, n, members]
                        continue
                    entry = node[2]
                    if _before(key, entry[0], largest) or (key == entry[0] and label < entry[1]):
                        entry[0], entry[1] = key, label
                    entry[2] += n
                    entry[3] += members
                while trie.held > budget and (cut := trie.evict()):
                    refused += [(data, *entry, None) for data, entry in cut]
                    trie.held -= 8 * sum(len(entry[3]) for _, entry in cut)
                yield from table_of(refused)
        yield from table_of([(None, *entry, hashlib.sha256(data).digest()) for data, entry in entries(trie.root)])

    return owners.mapInArrow(run, f"text binary, id {kind}, class long, n long, members array<long>, digest binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256, text)`` per row of ``docs``; ``text`` is null where the row goes.

    Texts are equal if their bytes are. Of equal ones the row of the largest
    (``keep="smallest"``: smallest) id stays, of repeated rows one. A null text
    is empty. A null id stays only where all ids of the text are null
    (``keep_id`` is then null). An empty table gives no rows.

    Each task first puts its own rows into a trie, so that of a text which
    most rows share every task sends one copy. Those are dealt by length and
    content hash, so equal ones meet, and put into a trie per task, whose
    terminal nodes keep the id that stays. A trie over ``budget`` bytes cuts
    off its heaviest subtree: its strings, and all later ones below it, are
    written to the shared folder and inserted in a further round. Rows get
    their result by their class, so the hash decides where texts meet and
    never whether they are equal.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest, kind = keep == "largest", docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stage(_local(texts, kind, largest, budget), "exact-rows")
    waiting = rows.where("n is not null").select("text", "id", "class", "n", F.array("class").alias("members"))
    weight = rows.agg(F.sum(F.col("size") + _NODE)).first()[0] or 0
    found, turn = None, 0
    while weight:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * weight / budget))
        dealt = waiting.repartition(tasks, F.length("text"), F.xxhash64("text"), F.lit(turn))
        done = stage(_resolve(dealt, kind, largest, budget), "exact-owners")
        found = done.where("text is null") if found is None else found.unionByName(done.where("text is null"))
        waiting, turn = done.where("text is not null").drop("digest"), turn + 1
        weight = waiting.agg(F.sum(F.length("text") + F.lit(_NODE))).first()[0] or 0
    if found is None:
        found = spark.createDataFrame([], f"text binary, id {kind}, class long, n long, members array<long>, digest binary")
    owners = found.select(F.explode("members").alias("class"), F.col("id").alias("keep_id"), F.col("class").alias("owner"), F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    stays = F.col("n").isNotNull() & (F.col("class") == F.col("owner"))
    out = rows.join(owners, "class")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "text_sha256", F.when(stays, F.col("text").cast("string")).alias("text"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``(id, text)`` of the rows that stay."""
    return exact_groups(docs, id_col, text_col, keep).where("kept").select(id_col, F.col("text").alias(text_col))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


@query("op12_exact", EXACT_SQL)
def op12_exact(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).drop("text")
