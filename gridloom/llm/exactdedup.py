"""Exact duplicates by Patricia tries that hold whole byte strings.

A text counts without white space (as null or empty if nothing is left). Scan tasks first merge equal texts of their own block, so that
copies don't travel. What remains is dealt by length and a hash of the content; each part inserts full byte strings into
one compressed radix trie, whose terminal nodes keep the row that stays. No two texts are taken as equal by a hash.

Frequent texts (many blocks hold them) are merged in two steps: by block groups first, then together. A trie that outgrows its
memory gives its heaviest subtrees back as rows, which form the next round, dealt over as many parts as their bytes need.
Intermediate tables lie in the shared folder, so that a lost executor costs only its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_schema, shared_dir, texts_of, written

#: ASCII white space, which doesn't count.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Rows and distinct bytes of a block, bytes of a part, bytes of a trie, blocks that make a text frequent, and bytes that a node costs.
BLOCK_ROWS, BLOCK_BYTES, PART_BYTES, TRIE_BYTES, FREQUENT, NODE = 65536, 16 << 20, 64 << 20, 192 << 20, 64, 400
#: Bytes that an Arrow batch of rows may hold.
BATCH_BYTES = 8 << 20

LOCAL = "block long, k int, size long, hash long, content binary, points long, keep_id long, keep_block long, keep_at int, n long, ids array<long>, places array<int>"
REP = ("block", "k", "size", "hash", "content", "points", "keep_id", "keep_block", "keep_at", "n")
#: With ``content``, a text that still needs a place; without, the answer for one of a block.
FOUND = "block long, k int, size long, hash long, content binary, points long, keep_id long, keep_block long, keep_at int, n long, owner_block long, owner_k int, text_sha256 string"


class Node:
    """``label`` leads to it; ``children`` by first byte, None once the subtree has been given back; ``held`` is set where a string ends."""

    __slots__ = ("children", "held", "label")

    def __init__(self, label: bytes):
        self.label, self.children, self.held = label, {}, None


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``label`` follow in ``key`` from ``at``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie of byte strings; any string may be a prefix of another, the empty one included."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes) -> Node | None:
        """The node where ``key`` ends; None if its subtree was given back."""
        node, at = self.root, 0
        while node.children is not None:
            if at == len(key):
                if node.held is None:
                    node.held = []
                return node
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                child.held = []
                self.size += NODE + len(child.label)
                return child
            if not key.startswith(child.label, at):
                n = shared_prefix(child.label, key, at)
                middle = node.children[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                self.size += NODE
                child = middle
            node, at = child, at + len(child.label)
        return None

    @staticmethod
    def below(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """All strings below a node, whose own path ends with ``prefix``, and the nodes where they end."""
        todo = [(node, prefix)]
        while todo:
            node, path = todo.pop()
            if node.held is not None:
                yield path, node
            if node.children:
                todo += [(c, path + c.label) for c in node.children.values()]

    @staticmethod
    def weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += NODE * (1 + len(node.held or ())) + len(node.label)
            todo += (node.children or {}).values()
        return total

    def give_back(self, limit: int) -> Iterator[tuple[bytes, list]]:
        """Cut heaviest subtrees off until half the limit is free, and yield their strings with what they held. At least one string stays."""
        while self.size > limit // 2:
            node, path = self.root, b""
            live = [c for c in node.children.values() if c.children is not None]
            while len(live) == 1 and node.held is None:
                node, path = live[0], path + live[0].label
                live = [c for c in node.children.values() if c.children is not None]
            weights = {id(c): self.weight(c) for c in live}
            live.sort(key=lambda c: -weights[id(c)])
            if len(live) + (node.held is not None) < 2:
                return
            for key, end in self.below(live[0], path + live[0].label):
                yield key, end.held
            self.size -= weights[id(live[0])]
            live[0].children, live[0].held = None, None


def order(points: int, doc_id: int | None, block: int, at: int) -> tuple:
    """The row that stays has the least of these: most code points, smallest id (null last), first place."""
    return -points, doc_id is None, doc_id or 0, block, at


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def blocks(block_rows: int, block_bytes: int) -> Callable:
    """For mapInArrow over ``doc_id, text``: a row per distinct text of a block, with its members."""
    schema = arrow_schema(LOCAL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows, size = TaskContext.get().partitionId() << 32, {}, 0, 0

        def full() -> Iterator[pa.RecordBatch]:
            out, weight = [], 0
            for k, (content, members) in enumerate(held.items()):
                points, doc_id, at = min(members, key=lambda m: order(m[0], m[1], block, m[2]))
                out.append((block, k, len(content), xxhash.xxh3_64_intdigest(content) - (1 << 63), content, points, doc_id, block, at, len(members), [m[1] for m in members], [m[2] for m in members]))
                weight += len(content) + 16 * len(members)
                if weight >= BATCH_BYTES:
                    yield _emit(out, schema)
                    out, weight = [], 0
            if out:
                yield _emit(out, schema)

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for doc_id, raw, points in zip(batch.column(0).to_pylist(), texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist(), strict=True):
                content = raw.as_py().translate(None, SPACE)
                members = held.get(content)
                if members is None:
                    members = held[content] = []
                    size += len(content)
                members.append((points, doc_id, rows))
                rows += 1
                if rows >= block_rows or size >= block_bytes:
                    yield from full()
                    block, held, rows, size = block + 1, {}, 0, 0
        if held:
            yield from full()

    return run


def owners(limit: int, merge: bool) -> Callable:
    """For mapInArrow over the rows REP of a part: one trie, whose terminals answer for their texts.

    With ``merge`` each text goes on once, in the name of its first block, and its blocks learn that name; else they learn the row that stays.
    """
    schema = arrow_schema(FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, weight, most = Trie(), [], 0, limit

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out, weight
            if out and weight >= least:
                yield _emit(out, schema)
                out, weight = [], 0

        def goes_on(row: tuple, content: bytes) -> None:
            nonlocal weight
            out.append((*row[:4], content, *row[4:], None, None, None))
            weight += len(content) + 100

        for batch in batches:
            for *row, content in zip(*(batch.column(c).to_pylist() for c in REP if c != "content"), batch.column("content"), strict=True):
                content = content.as_py()
                if (end := trie.insert(content)) is None:
                    goes_on(tuple(row), content)
                    yield from ready(BATCH_BYTES)
                    continue
                end.held.append(tuple(row))
                trie.size += NODE
                if trie.size > most:
                    for key, held in trie.give_back(limit):
                        for one in held:
                            goes_on(one, key)
                        yield from ready(BATCH_BYTES)
                    most = max(limit, 2 * trie.size)  # one string alone stays, however large
        for key, end in Trie.below(trie.root, b""):
            held = end.held
            best = min(held, key=lambda r: order(*r[4:8]))
            name, n = min(r[:2] for r in held), sum(r[8] for r in held)
            if merge:
                goes_on((*name, *best[2:8], n), key)
                out += [(*r[:4], None, *r[4:], *name, None) for r in held]
            else:
                digest = hashlib.sha256(key).hexdigest()
                out += [(*r[:4], None, *best[4:8], n, None, None, digest) for r in held]
            weight += 160 * len(held)
            yield from ready(BATCH_BYTES)
        yield from ready(0)

    return run


def dedup(docs: DataFrame, root: str | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, trie_bytes: int = TRIE_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of texts that are equal without ASCII white space, the row with the most code points stays, then the smallest
    ``doc_id``; a null id comes last, and of rows that repeat an id exactly one stays. ``keep_id`` is null only if no
    row of the group that could stay has an id. Null texts are empty, and all empty ones are one group. Other columns don't matter.
    """
    spark, root = docs.sparkSession, root or shared_dir(docs.sparkSession) + "/exact"
    own = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    local = written(own.mapInArrow(blocks(block_rows, block_bytes), LOCAL), "local", root)
    reps = local.select(*REP)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda total: max(least, -(-(total or 0) // part_bytes))
    total = reps.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    parts = of(total.bytes)
    # a text of more than `often` blocks: at most 4 * parts of them, so their table may be broadcast
    often = max(frequent, total.n // (4 * parts) + 1)
    hot = written(reps.groupBy("size", "hash").agg(F.count("*").alias("m")).filter(F.col("m") >= often), "hot", root)
    refs, some = None, not hot.isEmpty()
    if some:
        dealt = reps.join(F.broadcast(hot), ["size", "hash"]).withColumn("salt", F.pmod(F.xxhash64("block"), F.ceil(F.sqrt("m"))))
        merged = written(dealt.repartition(parts, "size", "hash", "salt").select(*REP).mapInArrow(owners(trie_bytes, merge=True), FOUND), "merged", root)
        refs = merged.filter("content is null").select("block", "k", "owner_block", "owner_k")
        reps = reps.join(F.broadcast(hot), ["size", "hash"], "left_anti").select(*REP).unionByName(merged.filter("content is not null").select(*REP))
    answers, round_ = None, 0
    while parts:
        found = written(reps.repartition(parts, "size", "hash").mapInArrow(owners(trie_bytes, merge=False), FOUND), f"round{round_}", root)
        done = found.filter("content is null").select("block", "k", "keep_id", "keep_block", "keep_at", F.col("n").alias("group_size"), "text_sha256")
        answers = done if answers is None else answers.unionByName(done)
        reps, round_ = found.filter("content is not null").select(*REP), round_ + 1
        left = reps.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
        parts = left.n and of(left.bytes)
    if refs is not None:
        named = answers.withColumnsRenamed({"block": "owner_block", "k": "owner_k"})
        answers = answers.join(refs.select("block", "k"), ["block", "k"], "left_anti").unionByName(refs.join(named, ["owner_block", "owner_k"]).drop("owner_block", "owner_k"))
    members = local.select("block", "k", "ids", "places").join(answers, ["block", "k"])
    rows = members.select("block", "keep_id", "keep_block", "keep_at", "group_size", "text_sha256", F.explode(F.arrays_zip("ids", "places")).alias("m"))
    kept = (F.col("block") == F.col("keep_block")) & (F.col("m.places") == F.col("keep_at"))
    return rows.select(F.col("m.ids").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
