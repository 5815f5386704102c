"""Prefix trie of conversations, by adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is a 128-bit number, the first half of a SHA-256 of role and text, so equal turns have equal ids without a join.
Conversations are cut into blocks of :data:`BLOCK` turns. A block's key is its number, the digest of all turns before it, and
its turns' ids: keys of one block share a prefix if, and only if, the conversations do. Keys are sorted by ranges, tasks
build trees over stretches of them, and the nodes at turn-aligned byte depths come out with sums over the keys below. A node
that ranges share is summed up by its digest. So neither a long conversation nor a turn that many begin with meets in one task.

A node belongs to its smallest member, and what a member owns is the end of its path. Sums over a node's subtree are
therefore sums over its members of what they own, less what the owner owns above the node: a second run of the trees,
and no step per level.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.radix_tree import Tree
from gradelake.operators import ordered
from gradelake.session import staged, unstaged

WIDTH = 16
BLOCK = 64
#: Bytes before a key's first turn id: the block's number and the digest of what comes before it.
HEAD = 8 + WIDTH
#: Conversations that share their beginnings, the most turns they can share, and blocks of which digests are combined at once.
FAMILY, SHARED = 5, 9
BLOCKS_TOGETHER = 4096
#: Bytes of keys in a tree, and conversation numbers in a piece of a node's member list.
TREE_BYTES = 16 << 20
PIECE = 4096
NOTHING = bytes(WIDTH)


def _turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, id, size``; rows without a conversation go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.substring(F.sha2(written.cast("binary"), 256), 1, 2 * WIDTH).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )


def _positions(turns: DataFrame) -> DataFrame:
    """``part, conv_id, local, id, size``: rows in order by ranges, numbered within each range's part of a conversation."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    # Equal rows are dealt by a number, else they would be one range.
    rows = turns.withColumn("dealt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    rows = rows.repartitionByRange(*order, F.col("dealt")).sortWithinPartitions(*order).select("conv_id", "id", "size")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, local = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for conv in batch.column(0).to_pylist():
                local = local + 1 if conv == last else 0
                last = conv
                numbers.append(local)
            columns = [pa.array([part] * len(numbers), pa.int32()), batch.column(0), pa.array(numbers, pa.int64()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "conv_id", "local", "id", "size"])

    return rows.mapInArrow(number, "part int, conv_id long, local long, id string, size long")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def first_of_family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _rebuilt(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth, id, size``, and ``conv_id, length`` of every conversation, turnless ones too."""
    pieces = positions.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))  # a row per range that holds some of it
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("wanted", shared_turns(F.col("conv_id")))
    convs = convs.withColumn("base", first_of_family(F.col("conv_id")))
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("wanted", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "wanted", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("wanted"), F.lit(0))).alias("length")), "convs")
    # Pieces of a conversation are bounded by a range, so joining by both keys spreads a long one.
    known = pieces.select("conv_id", "part", "before").join(convs.select("conv_id", "wanted", "taken"), "conv_id")
    rows = positions.join(known, ["conv_id", "part"]).withColumn("position", F.col("before") + F.col("local"))
    own = rows.where("position >= wanted").select("conv_id", (F.col("taken") + F.col("position") - F.col("wanted") + 1).alias("depth"), "id", "size")
    heads = positions.where((F.col("conv_id") % FAMILY == 0) & (F.col("local") < SHARED)).join(pieces.select("conv_id", "part", "before"), ["conv_id", "part"])
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("before") + F.col("local")).alias("position"), "id", "size").where(F.col("position") < SHARED)
    taken = heads.join(convs, "base").where("position < wanted").select("conv_id", (F.col("position") + 1).alias("depth"), "id", "size")
    return own.unionByName(taken), convs.select("conv_id", "length")


def _half(digest: Column, first: bool) -> Column:
    return F.conv(F.substring(digest, 1 if first else 17, 16), 16, -10).cast("long")


def _digest(high: Column, low: Column) -> Column:
    return F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0"))


def _pieces(lengths: DataFrame, block: int, *columns: str) -> DataFrame:
    """A row for every :data:`BLOCKS_TOGETHER` blocks of a conversation, so that what is joined to a long one's blocks spreads."""
    last = F.floor(F.col("length") / (block * BLOCKS_TOGETHER)).cast("long")
    return lengths.select("conv_id", *columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("together"))


def _blocks(rebuilt: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """``conv_id, block, before, after, ids, sizes`` with digests (hexadecimal) of all turns before and up to a block's end, and ``ends`` for a conversation's last.

    Digests of blocks combine by exclusive or, so those before a block are a running total, taken in two levels.
    """
    turns = F.sort_array(F.collect_list(F.struct("depth", "id", "size")))  # at most a block
    blocks = rebuilt.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).cast("long").alias("block")).agg(turns.alias("turns"))
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    blocks = blocks.select("conv_id", "block", ids.alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    whole = F.md5(F.unhex(F.concat(F.lpad(F.hex("block"), 16, "0"), "ids")))
    blocks = blocks.withColumn("whole", whole).withColumn("together", F.floor(F.col("block") / BLOCKS_TOGETHER).cast("long"))
    blocks = blocks.select("*", _half(F.col("whole"), True).alias("high"), _half(F.col("whole"), False).alias("low"))
    groups = blocks.groupBy("conv_id", "together").agg(F.expr("bit_xor(high)").alias("high"), F.expr("bit_xor(low)").alias("low"))
    earlier = Window.partitionBy("conv_id").orderBy("together").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("conv_id", "together", *(F.coalesce(F.expr(f"bit_xor({h})").over(earlier), F.lit(0)).alias(f"far_{h}") for h in ("high", "low")))
    near = Window.partitionBy("conv_id", "together").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select("*", *(F.expr(f"bit_xor({h})").over(near).alias(f"near_{h}") for h in ("high", "low"))).join(groups, ["conv_id", "together"])
    after = {h: F.col(f"far_{h}").bitwiseXOR(F.col(f"near_{h}")) for h in ("high", "low")}
    blocks = blocks.join(_pieces(lengths, block, "length"), ["conv_id", "together"])
    return blocks.select(
        "conv_id", "block", "together", "ids", "sizes", _digest(after["high"].bitwiseXOR(F.col("high")), after["low"].bitwiseXOR(F.col("low"))).alias("before"),
        _digest(after["high"], after["low"]).alias("after"), (F.col("block") * block + F.size("sizes") == F.col("length")).alias("ends"),
    )


def _keys(blocks: DataFrame, *values: Column) -> DataFrame:
    """Distinct keys in byte order by ranges, with their turns' sizes and values."""
    key = F.unhex(F.concat(F.lpad(F.hex("block"), 16, "0"), "before", "ids"))
    keys = blocks.groupBy(key.alias("key")).agg(F.first("sizes").alias("sizes"), *values)
    return keys.repartitionByRange("key").sortWithinPartitions("key")


def _node(number: bytes, before: bytes, ids: bytes, block: int) -> bytes:
    """Digest of all turns up to a node; the last one of a full block is what the next block's keys start with."""
    if len(ids) < block * WIDTH:
        return hashlib.md5(before + ids, usedforsecurity=False).digest()
    whole = hashlib.md5(number + ids, usedforsecurity=False).digest()
    return (int.from_bytes(before) ^ int.from_bytes(whole)).to_bytes(WIDTH)


def _nodes(keys: DataFrame, names: tuple[str, ...], add: tuple, shape: bool, block: int) -> DataFrame:
    """Nodes of the trees over stretches of the keys: ``node`` with values combined, and with ``depth, parent, size`` if ``shape`` is set."""

    def emitted(tree: Tree) -> Iterator[tuple]:
        for key, start, end, values in tree.spans():
            first, last = max(-(-(start + 1 - HEAD) // WIDTH), 1), (end - HEAD) // WIDTH
            if first > last:
                continue
            number, before, ids = key[:8], key[8:HEAD], key[HEAD:]
            above = _node(number, before, ids[: (first - 1) * WIDTH], block) if first > 1 else before
            sizes = tree.sizes[key]
            for turn in range(first, last + 1):
                node = _node(number, before, ids[: turn * WIDTH], block)
                if shape:
                    yield (node, int.from_bytes(number) * block + turn, above, sizes[turn - 1], *values)
                else:
                    yield (node, *values)
                above = node

    columns = [("node", pa.binary())] + ([("depth", pa.int64()), ("parent", pa.binary()), ("size", pa.int64())] if shape else []) + [(n, pa.int64()) for n in names]

    def written(tree: Tree) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in emitted(tree):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size = _sized(add), 0
        for batch in batches:
            for key, sizes, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if size and size + len(key) > TREE_BYTES:
                    yield from written(tree)
                    tree, size = _sized(add), 0
                tree.insert(key, values)
                tree.sizes[key] = sizes
                size += len(key)
        yield from written(tree)

    schema = "node binary, " + ("depth long, parent binary, size long, " if shape else "") + ", ".join(f"{n} long" for n in names)
    return keys.select("key", "sizes", *names).mapInArrow(grow, schema)


def _sized(add: tuple) -> Tree:
    tree = Tree(add)
    tree.sizes = {}
    return tree


def _ends(blocks: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """``node, ends_sha256`` of nodes at which conversations end.

    Lists are put together by ranges of conversation numbers; a task then passes a node's pieces through the hash in order
    and holds only one at a time.
    """
    part = F.md5(F.unhex(F.concat("before", "ids")))
    node = F.unhex(F.when(F.size("sizes") < block, part).otherwise(F.col("after")))
    ends = blocks.where("ends").select(node.alias("node"), "conv_id").unionByName(lengths.where("length = 0").select(F.lit(NOTHING).alias("node"), "conv_id"))
    pieces = ends.groupBy("node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    pieces = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running, names, found = None, None, ["node", "ends_sha256"], []
        for batch in batches:
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here == node:
                    running.update(b"," + ids.encode())
                else:
                    if running is not None:
                        found.append((node, running.hexdigest()))
                    node, running = here, hashlib.sha256(ids.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)
                found = []
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names)

    return pieces.mapInArrow(digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of rebuilt conversations, from the root (depth 0) on.

    ``rows`` has ``conv_id, turn, role, text``; a conversation is its rows by turn, null first, equal turns by the digest of
    role and text; repeated rows are turns like any other. Null role and text are empty. Rows without a conversation go, other
    columns are not looked at. A conversation is rebuilt from the first turns of its family's first member and its own later ones
    (:func:`shared_turns`). No conversations give no nodes, not even a root.

    Returns, as longs but for the last: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` over the subtree, ``ends_sha256``.
    """
    positions = staged(_positions(_turns(rows)), "turns")
    rebuilt, lengths = _rebuilt(positions)
    blocks = staged(_blocks(rebuilt, lengths, block), "blocks")
    unstaged(positions)

    counted = _keys(blocks, F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    nodes = _nodes(counted, ("n", "least"), (operator.add, min), True, block)
    nodes = nodes.groupBy("node").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("size").alias("size")
    )
    root = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).where("n > 0")
    root = root.select(F.lit(NOTHING).alias("node"), "n", "least", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    nodes = nodes.unionByName(root)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    nodes = staged(nodes.join(children, "node", "left").withColumn("children", F.coalesce("children", F.lit(0))), "nodes")

    saved = (F.col("n") - 1) * F.col("size")
    owned = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.sum((F.col("children") == 0).cast("long")).alias("leaves"), F.sum(saved).alias("saved"), F.min(F.struct("depth", "parent"))["parent"].alias("node")
    )
    owned = staged(owned, "owned")
    above = owned.where("node is not null").select("conv_id", "node").join(nodes.select("node", F.col("least").alias("parent_conv_id")), "node").drop("node")

    weighed = blocks.join(_pieces(lengths.join(owned, "conv_id"), block, "leaves", "saved"), ["conv_id", "together"], "left")
    totals = [F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in ("leaves", "saved")]
    below = _nodes(_keys(weighed, *totals), ("leaves", "saved"), (operator.add, operator.add), False, block)
    below = below.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = below.unionByName(owned.groupBy().agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(F.lit(NOTHING).alias("node"), "leaves", "saved"))

    common = nodes.where("n > 1").select("node", F.col("least").alias("owner"), "depth", saved.alias("here")).withColumn("stretch", ordered.block_of(F.col("depth")))
    common = ordered.running_total(common, ["owner"], "stretch", [F.col("depth")], F.col("here"), "upto")
    common = common.select("node", (F.col("upto") - F.col("here")).alias("owners"))

    first = nodes.join(below, "node").join(common, "node", "left").join(_ends(blocks, lengths, block), "node", "left")
    starts = nodes.groupBy("least").agg(F.min("depth").alias("depth")).withColumnRenamed("least", "conv_id").join(above, "conv_id")
    first = first.withColumnRenamed("least", "conv_id").join(starts, ["conv_id", "depth"], "left")
    return first.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("saved") - F.coalesce("owners", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


#: The same nodes in SQL: rebuilt turns, whole prefixes as text, and a join of every node with its ancestors.
TRIE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as p
  from conversations where conv_id is not null),
ids as (
  select conv_id, conv_id - conv_id % 5 as base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b:
             list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 9 as h
  from (select distinct conv_id from t)),
own as (
  select i.conv_id, 1 as later, t.p, role, text from ids i join t using (conv_id) where t.p >= i.h
  union all
  select i.conv_id, 0 as later, t.p, role, text from ids i join t on t.conv_id = i.base where t.p < i.h),
turns as (
  select conv_id, row_number() over (partition by conv_id order by later, p) as depth, octet_length(encode(text)) as size,
         md5(octet_length(encode(role)) || ':' || role || text) as id from own),
paths as (
  select conv_id, depth, size, string_agg(id, '') over (partition by conv_id order by depth) as path from turns
  union all select conv_id, 0, 0, '' from ids),
lengths as (select conv_id, max(depth) as length from paths group by conv_id),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n, any_value(size) as size,
         coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where l.length = p.depth), '') as ends
  from paths p join lengths l using (conv_id) group by path, depth),
children as (select left(path, length(path) - 32) as path, count(*) as k from nodes where depth > 0 group by 1),
full_nodes as (select n.*, coalesce(k, 0) as k from nodes n left join children using (path)),
below as (
  select a.path, sum((b.k = 0)::bigint) as leaves, sum((b.n - 1) * b.size) as saved
  from full_nodes b join paths p on p.conv_id = b.conv_id and p.depth <= b.depth join full_nodes a on a.path = p.path group by a.path)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n as n_convs, n.k as n_children,
       b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join below b using (path)
left join full_nodes u on n.depth > 0 and u.path = left(n.path, length(n.path) - 32)"""
