"""A Merkle manifest of a dataset, with a proof for every row, by time-forward processing.

Every row is a leaf, the lowercase hex SHA-256 of its columns, each written as ``-`` if NULL and
else as its UTF-8 byte count, ``:`` and its value.  The leaves of a language stand in the
order of their ids; two in a row become the digest of both (the last one may be alone, and
is digested alone) until one node is left, the language's subroot.  The subroots, in the
order of the languages, become the root in the same way.

Nodes are labelled by the last leaf below them and their height, so a child always comes
before its parent.  A sweep in the order of labels takes the messages that are due from a
priority queue, digests them, and sends the result to the parent's label; a second sweep, in
the reverse order, sends each child the siblings on its way to the root.  At any time the queue
holds one message per height.  A task sweeps aligned blocks of ``2 ** BLOCK_BITS`` nodes; the
messages that leave a block are written as a table, which Spark's sort delivers to the blocks
above (and, backwards, below), so the queue is external between blocks and its labels are
``(tree, block, position)``.  No task holds more than a block, whatever a language's share.

NULL languages and NULL ids come first.  Rows that repeat an id stand in the order of their
digests; equal rows are leaves of their own.  Empty texts have a byte count of 0.  An empty
table has no leaves and gives no rows.  Columns other than those of ``FIELDS`` are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rankflow.scratch import hint_broadcast, is_small, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block has up to this power of two of nodes.
BLOCK_BITS = 12
#: One id in so many is tampered with by the self-check.
TAMPER = 7

#: A step of a path is a side and the sibling's digest: the sibling stands left, right, or
#: there is none.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
STEP = 65
_NONE = ALONE + b" " * (STEP - 1)


# --- one block -------------------------------------------------------------------------


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def _label(index: int, height: int, leaves: int) -> tuple[int, int]:
    """The last leaf below a node, and its height."""
    return min((index + 1) << height, leaves) - 1, height


def sweep_up(leaves: Sequence[bytes], levels: int) -> tuple[bytes, list[tuple]]:
    """The node ``levels`` above the leaves, and ``(label, index, children)`` of all parents.

    The parents come in the order of their labels.  ``levels`` must reach a single node.
    """
    queue: list[tuple] = []
    parents: list[tuple] = []

    def send(index: int, height: int, value: bytes) -> None:
        heapq.heappush(queue, (*_label(index >> 1, height + 1, len(leaves)), index, value))

    if not levels:
        (top,) = leaves
        return top, parents
    for at, leaf in enumerate(leaves):
        send(at, 0, leaf)
        while queue and queue[0][0] == at:
            last, height, index, value = heapq.heappop(queue)
            children = [value]
            if queue and queue[0][:2] == (last, height):
                children.append(heapq.heappop(queue)[3])
            parents.append(((last, height), index >> 1, children))
            value = digest(*children)
            if height == levels:
                return value, parents
            send(index >> 1, height, value)
    raise ValueError(f"{len(leaves)} leaves do not meet within {levels} levels")


def sweep_down(count: int, parents: list[tuple], path: bytes) -> list[bytes]:
    """The path of each leaf: its siblings up to the top, and then ``path``, the top's own."""
    paths = [path] * count
    if not parents:
        return paths
    last, height = parents[-1][0]
    queue = [(-last, -height, path)]
    for (last, height), index, children in reversed(parents):
        above = heapq.heappop(queue)
        assert above[:2] == (-last, -height)
        for n, _ in enumerate(children):
            if len(children) == 1:
                own = _NONE + above[2]
            else:
                own = (RIGHT if n == 0 else LEFT) + children[1 - n] + above[2]
            child = 2 * index + n
            if height == 1:
                paths[child] = own
            else:
                last_below, _ = _label(child, height - 1, count)
                heapq.heappush(queue, (-last_below, 1 - height, own))
    return paths


def siblings(path: bytes) -> bytes:
    """All sibling digests of a path, leaf first."""
    return b"".join(path[k + 1:k + STEP] for k in range(0, len(path), STEP)
                    if path[k:k + 1] != ALONE)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for k in range(0, len(path), STEP):
        side, other = path[k:k + 1], path[k + 1:k + STEP]
        leaf = digest(other, leaf) if side == LEFT else (
            digest(leaf, other) if side == RIGHT else digest(leaf))
    return leaf


def _levels(size: int) -> int:
    """Levels that a block of a tree with ``size`` nodes climbs."""
    return min(BLOCK_BITS, (size - 1).bit_length())


# --- blocks as tables ------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[tuple]:
    """``(key, rows)`` of sorted rows whose first columns are the key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _in_blocks(rows: DataFrame, *rest: str) -> DataFrame:
    """``tree, block`` and ``rest`` of the rows, a block's rows together in the order of ``rest``."""
    placed = rows.withColumn("block", F.shiftright("pos", BLOCK_BITS))
    return _sorted(placed, *rest)


def _sorted(placed: DataFrame, *rest: str) -> DataFrame:
    key = ["tree", "block"]
    return placed.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, rest[0])


def climb(nodes: DataFrame) -> DataFrame:
    """``tree, pos, digest, size`` of nodes -> the same of the tops of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _blocks(batches):
            size = rows[0][2]
            top, _ = sweep_up([value.encode() for _, value, _ in rows], _levels(size))
            above = -(-size >> BLOCK_BITS)
            yield pa.RecordBatch.from_pydict(
                {"tree": [tree], "pos": [block], "digest": [top.decode()], "size": [above]})

    return stage(_in_blocks(nodes, "pos", "digest", "size").mapInArrow(
        run, "tree string, pos bigint, digest string, size bigint"), "tops")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of those ... until each tree has one."""
    found = [nodes]
    while (found[-1].agg(F.max("size")).first()[0] or 0) > 1:
        found.append(climb(found[-1]))
    return found


def descend(nodes: DataFrame, paths: DataFrame, columns: Sequence[str], schema: StructType,
            deliver: Callable[[list[tuple], list[bytes], bytes], dict]) -> DataFrame:
    """Send the paths of blocks to the nodes in them.

    ``paths`` has ``tree, pos, path, note`` of every block's top (``pos`` numbers the blocks).
    ``deliver(rows, paths, note)`` gives the result of a block's nodes, whose ``columns`` (after
    the digest and the position) are the rows.
    """
    nothing = lambda c: F.lit(None).cast(nodes.schema[c].dataType).alias(c)
    placed = nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS))
    body = placed.select("tree", "block", "pos", "digest", "size", *columns,
                         F.lit(None).cast("binary").alias("path"), F.lit("").alias("note"))
    # Position -1 comes first: the message of the block.
    heads = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                         nothing("digest"), nothing("size"), *[nothing(c) for c in columns],
                         "path", "note")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), (head, *rows) in _blocks(batches):
            path, note = head[-2], head[-1]
            _, parents = sweep_up([row[1].encode() for row in rows], _levels(rows[0][2]))
            own = sweep_down(len(rows), parents, path)
            out = deliver([(tree, *row[:2], *row[3:-2]) for row in rows], own, note)
            yield pa.RecordBatch.from_pydict(out, schema=wanted)

    wanted = to_arrow_schema(schema)
    both = body.unionByName(heads)
    return _sorted(both, "pos", "digest", "size", *columns, "path", "note").mapInArrow(run, schema)


_PATHS = StructType([StructField("tree", StringType()), StructField("pos", LongType()),
                     StructField("path", BinaryType()), StructField("note", StringType())])


def _as_paths(rows: list[tuple], paths: list[bytes], note: str) -> dict:
    return {"tree": [r[0] for r in rows], "pos": [r[1] for r in rows], "path": paths,
            "note": [note] * len(rows)}


def paths_down(levels: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the blocks of ``levels[0]`` out of those of the nodes of ``levels[-1]``."""
    for nodes in reversed(levels[1:-1]):
        paths = stage(descend(nodes, paths, [], _PATHS, _as_paths), "paths")
    return paths


def placed_in_order(rows: DataFrame, order: Sequence[str], tree: str = "tree") -> DataFrame:
    """Rows with their place (``pos``, from 0) in their tree and its ``size``.

    A range sort by tree and ``order``; a count per tree and partition tells where each
    partition's rows begin, so that no task sees a whole tree.
    """
    spread = rows.withColumn("_n", F.monotonically_increasing_id())
    by = [tree, *order, "_n"]
    inside = stage(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_n").withColumn(
        "_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = inside.groupBy(tree, part).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    group = Window.partitionBy(tree)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select(
        F.col(tree).alias("_tree"), "_part", "_first", F.sum("_c").over(group).alias("size"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")), "starts")
    here = (F.col(tree) == F.col("_tree")) & (F.shiftright("_at", 33) == F.col("_part"))
    joined = inside.join(hint_broadcast(starts, is_small(starts)), here)
    return joined.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).select(
        *rows.columns, "pos", "size")


# --- documents -------------------------------------------------------------------------


def leaf_digest(columns: Sequence[Column]) -> Column:
    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, altered``: altered is the leaf after tampering, NULL if the same."""
    fields = {c: F.col(c) for c in FIELDS}
    more = {**fields, "n_chars": fields["n_chars"].cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    # "" is the tree of the NULL language, and sorts before all others.
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), "doc_id",
        leaf_digest(list(fields.values())).alias("digest"),
        F.when(hit, leaf_digest(list(more.values()))).alias("altered"))


_PROOFS = [*[StructField(c, StringType()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")], StructField("verified", BooleanType())]


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    rows = stage(placed_in_order(leaves(docs), ["doc_id", "digest"]), "leaves")
    levels = rounds(rows.select("tree", "pos", "digest", "size"))
    langs = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    langs = stage(placed_in_order(langs, ["lang"]), "subroots")
    above = rounds(langs.select("tree", "pos", "digest", "size"))
    top = above[-1].first()
    root = top["digest"] if top else ""
    start = above[-1].select("tree", "pos", F.lit(b"").alias("path"), F.lit("").alias("note"))
    # Each subroot's path, through the rounds over the subroots; the note is the subroot.
    of_langs = descend(above[0], paths_down(above, start), [], _PATHS, _as_paths)
    tops = stage(langs.join(of_langs.select("pos", "path"), "pos").select(
        F.col("lang").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path",
        F.col("digest").alias("note")), "paths")

    def proofs(rows: list[tuple], paths: list[bytes], subroot: str) -> dict:
        original = [value for _, _, value, _, _ in rows]
        shown = [(altered or value).encode() for _, _, value, _, altered in rows]
        folded = [fold(leaf, path).decode() for leaf, path in zip(shown, paths)]
        return {"doc_id": [r[3] for r in rows], "leaf": original, "subroot": [subroot] * len(rows),
                "root": [root] * len(rows), "proof_sha256": [digest(siblings(p)).decode() for p in paths],
                "folded_root": folded, "verified": [f == root for f in folded]}

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *_PROOFS])
    return descend(rows, paths_down(levels, tops), ["doc_id", "altered"], schema, proofs)


# --- the same in SQL -------------------------------------------------------------------


def manifest_sql() -> str:
    def leaf(extra: int) -> str:
        fields = [f"(n_chars + {extra})" if c == "n_chars" else c for c in FIELDS]
        return "sha256(" + " || ".join(
            f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"

    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]),
      lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"""
    climb = """
      SELECT tree, h + 1, pos // 2, sha256(digest || coalesce(beside, '')), digest, beside
      FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY pos) AS beside,
                   count(*) OVER (PARTITION BY tree) AS n FROM {0})
      WHERE n > 1 AND pos % 2 = 0"""
    return f"""
WITH RECURSIVE placed AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, {leaf(0)} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {crc} % {TAMPER} = 0 THEN {leaf(1)} END AS altered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
           FROM placed),
nodes(tree, h, pos, digest, l, r) AS (
  SELECT tree, 0, pos, leaf, NULL::VARCHAR, NULL::VARCHAR FROM leaves
  UNION ALL {climb.format('nodes')}),
subroots AS (SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, h AS height
             FROM (SELECT *, max(h) OVER (PARTITION BY tree) AS most FROM nodes) WHERE h = most),
above(tree, h, pos, digest, l, r) AS (
  SELECT '', 0, pos, digest, NULL::VARCHAR, NULL::VARCHAR FROM subroots
  UNION ALL {climb.format('above')}),
root AS (SELECT digest AS root FROM above ORDER BY h DESC LIMIT 1),
steps AS (
  SELECT doc_id, leaf, altered, s.lang, leaves.pos, s.digest AS subroot, n.h,
         CASE WHEN (leaves.pos >> (n.h - 1)) % 2 = 0 THEN coalesce(n.r, '') ELSE n.l END AS other,
         (leaves.pos >> (n.h - 1)) % 2 = 1 AS is_left
  FROM leaves JOIN subroots s ON s.lang = leaves.tree
  JOIN nodes n ON n.tree = leaves.tree AND n.h > 0 AND n.pos = leaves.pos >> n.h
  UNION ALL
  SELECT doc_id, leaf, altered, s.lang, leaves.pos, s.digest, s.height + a.h,
         CASE WHEN (s.pos >> (a.h - 1)) % 2 = 0 THEN coalesce(a.r, '') ELSE a.l END,
         (s.pos >> (a.h - 1)) % 2 = 1
  FROM leaves JOIN subroots s ON s.lang = leaves.tree
  JOIN above a ON a.h > 0 AND a.pos = s.pos >> a.h),
ways AS (
  SELECT leaves.doc_id, leaves.leaf, leaves.altered, s.digest AS subroot,
         coalesce(list(steps.other ORDER BY steps.h) FILTER (steps.h IS NOT NULL), []) AS others,
         coalesce(list(steps.is_left ORDER BY steps.h) FILTER (steps.h IS NOT NULL), []) AS sides
  FROM leaves JOIN subroots s ON s.lang = leaves.tree
  LEFT JOIN steps ON steps.lang = leaves.tree AND steps.pos = leaves.pos GROUP BY ALL),
folded(doc_id, leaf, subroot, others, sides, k, digest) AS (
  SELECT doc_id, leaf, subroot, others, sides, 0, coalesce(altered, leaf) FROM ways
  UNION ALL
  SELECT doc_id, leaf, subroot, others, sides, k + 1,
         sha256(CASE WHEN sides[k + 1] THEN others[k + 1] || digest ELSE digest || others[k + 1] END)
  FROM folded WHERE k < len(others))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(others, '')) AS proof_sha256,
       digest AS folded_root, digest = root AS verified
FROM folded, root WHERE k = len(others)"""
