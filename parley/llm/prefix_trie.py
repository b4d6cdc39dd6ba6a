"""Conversation prefix trie from ternary search trees.

Turns (role, text) are dictionary-encoded: the distinct turns are sorted over
all tasks and numbered, so that ids compare as (role, text) do.  A conversation
is the sequence of its turn ids.  Equal sequences become one row with a count,
and the distinct ones are sorted into range shards.

A shard inserts its sequences into a ternary search tree, the median first and
then the medians of both halves, which keeps the tree of every level balanced.
An iterative traversal lists the nodes in order and adds up members, leaves and
savings from the last node to the first.  Only the leftmost and the rightmost
path of a shard can have a part in another shard.  Every other node is finished
there; the two paths go, with what their finished children add up to, to a merge
of ``fan`` neighbouring shards, whose outer paths go on to the next round.

Defined cases: a null role or text is empty; turns are ordered by ``turn``
(null first), then role, then text, so that ties and repeated rows have one
result; rows with a null ``conv_id`` belong to no conversation; an empty table
has no node; other columns are not read.  A conversation is one row (12 bytes a
turn); a shard is bounded in turns, unless one conversation is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.skew import join_unique
from parley.session import materialize

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends string, key binary, parent_key binary, open boolean, shard long, pos long, id long, chars long")
FIELDS = [f.split()[0] for f in NODE.split(", ")]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# -- encoding -----------------------------------------------------------------------

def encode(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, ids, chars), one row per conversation, and the number of turns."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    words = turns.groupBy("role", "text").agg(F.count(F.lit(1)).alias("n"))
    words = words.repartitionByRange(partitions(turns), "role", "text").sortWithinPartitions("role", "text")
    hashes = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2")]
    words = materialize(words.select(*hashes, F.monotonically_increasing_id().alias("id"), F.char_length("text").alias("chars"), "n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    coded = join_unique(turns.select("conv_id", "turn", *hashes), words, ["k1", "k2"], "n", total)
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("s"))
    return own.select("conv_id", F.col("s.id").alias("ids"), F.col("s.chars").alias("chars")), total


def regraft(own: DataFrame, every: int, most: int) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of the
    conversation c - c % ``every``, where h = crc32(decimal c) % ``most``.
    At most ``2 * every`` conversations share one such conversation."""
    roots = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("root"), *[F.slice(c, 1, max(most - 1, 1)).alias(f"root_{c}") for c in ("ids", "chars")])
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    rows = own.withColumn("h", h).withColumn("root", F.col("conv_id") - F.col("conv_id") % every).join(roots, "root", "left")

    def graft(c):
        tail = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.when(F.col(f"root_{c}").isNull(), tail).otherwise(F.concat(F.slice(f"root_{c}", F.lit(1), F.col("h")), tail)).alias(c)

    return rows.select("conv_id", graft("ids"), graft("chars"))


# -- hashes of the members that end at a node ---------------------------------------

def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s1, s2, conv_id) to the text of consecutive members, 1 MB at most."""
    rows, key, first, text, held = [], None, 0, bytearray(), 0

    def out():
        t = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(t[0], pa.int64()), pa.array(t[1], pa.int64()), pa.array(t[2], pa.int64()),
                                           pa.array(t[3], pa.binary())], names=["s1", "s2", "first", "members"])

    for b in batches:
        for s1, s2, c in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (s1, s2) == key and len(text) < 1 << 20:
                text += b",%d" % c
                continue
            if key is not None:
                rows.append((*key, first, bytes(text)))
                held += len(text) + 64
            if held > 8 << 20:
                yield out()
                held = 0
            key, first, text = (s1, s2), c, bytearray(b"%d" % c)
    if key is not None:
        rows.append((*key, first, bytes(text)))
        yield out()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to the SHA-256 of each key's whole list, one chunk at a time."""
    key, digest = None, None
    for b in batches:
        done = []
        for s1, s2, members in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            if (s1, s2) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (s1, s2), hashlib.sha256(members)
            else:
                digest.update(b"," + members)
        if done:
            yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["s1", "s2", "ends"])


def member_hashes(members: DataFrame) -> DataFrame:
    """(s1, s2, ends): SHA-256 of each key's ascending conv_ids, comma-joined.

    The members of a key may span tasks, which write them as text; a task that
    hashes a key's texts in order holds one of them at a time.
    """
    n, key = partitions(members), ["s1", "s2"]
    sorted_members = members.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = sorted_members.mapInArrow(_chunks, "s1 long, s2 long, first long, members binary")
    return chunks.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "s1 long, s2 long, ends string")


# -- the tree of a shard ------------------------------------------------------------

class SearchTree:
    """A ternary search tree of sorted, distinct sequences.

    ``split``, ``lo``, ``eq``, ``hi`` are the tree; a node of it is the node of
    the trie that the sequence up to its id leads to, ``up`` its parent there.
    """

    def __init__(self, sequences: list[list[int]]):
        self.split, self.lo, self.eq, self.hi, self.up, self.depth, self.end = [None], [-1], [-1], [-1], [-1], [0], {}
        todo = [(0, len(sequences))]
        while todo:  # the median first, then the medians of both halves
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                self.end[self._insert(sequences[m])] = m
                todo += [(m + 1, b), (a, m)]

    def _new(self, x: int, up: int) -> int:
        for column, value in ((self.split, x), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.up, up), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.split) - 1

    def _insert(self, sequence: list[int]) -> int:
        node, split = 0, self.split
        for x in sequence:
            link, at = self.eq, node
            while (child := link[at]) >= 0 and split[child] != x:
                link, at = (self.lo if x < split[child] else self.hi), child
            if child < 0:
                child = link[at] = self._new(x, node)
            node = child
        return node

    def in_order(self) -> list[int]:
        """The trie's nodes, parents first and siblings by id, without recursion."""
        out, todo = [0], [(self.eq[0], False)]
        while todo:
            x, passed = todo.pop()
            if x < 0:
                continue
            if passed:
                out.append(x)
                todo.append((self.eq[x], False))
            else:
                todo += [(self.hi[x], False), (x, True), (self.lo[x], False)]
        return out


class Sums:
    """Totals of nodes listed parents first: own values in, subtree values out."""

    def __init__(self, up: list[int], chars: list[int], members: list[int], least: list[int], ends: list,
                 children: list[int] | None = None, leaves: list[int] | None = None, saved: list[int] | None = None,
                 whole: bool = False):
        n = len(up)
        self.up, self.chars, self.members, self.least, self.ends = up, chars, members, least, ends
        self.children = children or [0] * n
        self.leaves = leaves or [0] * n
        self.saved = saved or [0] * n
        for i in range(n - 1, -1, -1):
            self.saved[i] += (members[i] - 1) * chars[i]
            if not self.children[i]:
                self.leaves[i] = 1
            p = up[i]
            if p >= 0:
                if not whole:  # members of a merge are whole already
                    members[p] += members[i]
                least[p] = min(least[p], least[i])
                self.children[p] += 1
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]


def outer_paths(up: list[int], depth: list[int]) -> set[int]:
    """The leftmost and the rightmost path of nodes listed in order."""
    out, i = set(), 0
    while i < len(up) and depth[i] == i:
        out.add(i)
        i += 1
    i = len(up) - 1
    while i >= 0:
        out.add(i)
        i = up[i]
    return out


def _next_key(parent: bytes, x: int) -> bytes:
    return hashlib.blake2b(parent + x.to_bytes(8, "little", signed=True), digest_size=16).digest()


def emit(t: Sums, depth: list[int], ids: list, keys: dict[int, bytes], open_nodes: set[int], shard: int) -> list[dict]:
    """Rows of the finished nodes, and of the open ones without what their open
    children add.  ``keys`` has the open nodes and those that once were."""
    own = {i: [t.children[i], t.leaves[i], t.saved[i] - (t.members[i] - 1) * t.chars[i]] for i in open_nodes}
    for i in open_nodes:
        if not t.children[i]:
            own[i][1] = 0  # a leaf here need not be one in the end
        if (p := t.up[i]) >= 0:
            own[p][0] -= 1
            own[p][1] -= t.leaves[i]
            own[p][2] -= t.saved[i]
    rows = []
    for i, p in enumerate(t.up):
        row = {"conv_id": t.least[i], "depth": depth[i], "n_convs": t.members[i], "ends": t.ends[i], "key": keys.get(i), "open": i in open_nodes}
        if row["open"]:
            c, leaves, saved = own[i]
            row |= {"n_children": c, "n_leaves": leaves, "saved_tokens": saved, "shard": shard, "pos": i, "id": ids[i], "chars": t.chars[i]}
        else:
            row |= {"n_children": t.children[i], "n_leaves": t.leaves[i], "saved_tokens": t.saved[i]}
            if p in open_nodes:
                row["parent_key"] = keys[p]
            elif p >= 0:
                row["parent_conv_id"] = t.least[p]
        rows.append(row)
    return rows


def table_of(rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (f.split() for f in NODE.split(", "))})


def shard_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range shard of sorted sequences (ids, chars, n, least, ends)."""
    ids, chars, n, least, ends = [], [], [], [], []
    for b in batches:
        for column, values in zip((ids, chars, n, least, ends), b.columns):
            column += values.to_pylist()
    if not ids:
        return
    tree = SearchTree(ids)
    order = tree.in_order()
    at = {x: i for i, x in enumerate(order)}
    size = len(order)
    members, low, ended = [0] * size, [2**63 - 1] * size, [None] * size
    last = [0] * size
    for node, s in tree.end.items():
        i = at[node]
        members[i], low[i], ended[i] = n[s], least[s], ends[s]
        d = len(ids[s])
        while i > 0 and not last[i]:  # the code points of the nodes on its path
            last[i] = chars[s][d - 1] + 1
            i, d = at[tree.up[order[i]]], d - 1
    up = [at.get(tree.up[x], -1) for x in order]
    depth = [tree.depth[x] for x in order]
    t = Sums(up, [max(c - 1, 0) for c in last], members, low, ended)
    open_nodes = outer_paths(up, depth)
    keys = {}
    for i in sorted(open_nodes):
        keys[i] = _next_key(keys[up[i]], tree.split[order[i]]) if i else b""
    shard = TaskContext.get().partitionId()
    rows = emit(t, depth, [tree.split[x] for x in order], keys, open_nodes, shard)
    for a in range(0, len(rows), 50_000):
        yield from table_of(rows[a:a + 50_000]).to_batches()


def merge_shards(shards: list[list[dict]], group: int, last_round: bool) -> list[dict]:
    """The open nodes of neighbouring shards, in order, as one tree.

    A node of the next shard can only be one on the rightmost path so far.
    """
    nodes, path = [], []  # path: the nodes on the rightmost path, by depth
    for row in (r for s in shards for r in s):
        d = row["depth"]
        if d < len(path) and nodes[path[d]]["id"] == row["id"] and path[d - 1:d] == [nodes[path[d]]["up"]] * (d > 0):
            x = nodes[path[d]]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                x[c] += row[c]
            x["conv_id"] = min(x["conv_id"], row["conv_id"])
            x["ends"] = x["ends"] if row["ends"] is None else row["ends"]
        else:
            nodes.append(dict(row, up=path[d - 1] if d else -1))
            path = path[:d] + [len(nodes) - 1]
    col = lambda c: [x[c] for x in nodes]
    up, depth = col("up"), col("depth")
    t = Sums(up, col("chars"), col("n_convs"), col("conv_id"), col("ends"), col("n_children"), col("n_leaves"), col("saved_tokens"), whole=True)
    open_nodes = set() if last_round else outer_paths(up, depth)
    return emit(t, depth, col("id"), dict(enumerate(col("key"))), open_nodes, group)


def merge_round(rows: DataFrame, fan: int, last_round: bool) -> DataFrame:
    def one(key, table):
        table = table.sort_by([("shard", "ascending"), ("pos", "ascending")])
        shards: dict[int, list[dict]] = {}
        for r in table.select(FIELDS).to_pylist():
            shards.setdefault(r["shard"], []).append(r)
        return table_of(merge_shards(list(shards.values()), key[0].as_py(), last_round))

    return rows.withColumn("group", F.floor(F.col("shard") / fan).cast("long")).groupBy("group").applyInArrow(one, NODE)


# -- the whole ----------------------------------------------------------------------

def prefix_trie(sequences: DataFrame, n_turns: int, shard_turns: int = 200_000, fan: int = 32) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, ids, chars).

    ``conv_id`` is a node's smallest member, ``saved_tokens`` what its subtree
    would save if every shared text were kept once, ``ends_sha256`` the hash of
    the members that end at the node.
    """
    keyed = sequences.select("conv_id", "ids", "chars", F.xxhash64("ids").alias("s1"), F.xxhash64(F.lit(1), "ids").alias("s2"))
    keyed = materialize(keyed)
    ends = member_hashes(keyed.select("s1", "s2", "conv_id"))
    distinct = keyed.groupBy("s1", "s2").agg(
        F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = distinct.join(ends, ["s1", "s2"]).select("ids", "chars", "n", "least", "ends")
    n_shards = max(partitions(sequences), -(-n_turns // shard_turns))
    shards = distinct.repartitionByRange(n_shards, "ids").sortWithinPartitions("ids")
    level = materialize(shards.mapInArrow(shard_nodes, NODE))
    done = level.where(~F.col("open"))
    while True:
        last_round = n_shards <= fan
        level = materialize(merge_round(level.where("open"), fan, last_round))
        done = done.unionByName(level.where(~F.col("open")))
        if last_round:
            break
        n_shards = -(-n_shards // fan)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    waiting = done.where(F.col("parent_key").isNotNull()).drop("parent_conv_id")
    parents = done.where(F.col("key").isNotNull()).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    placed = join_unique(waiting, parents.withColumnRenamed("n_children", "weight"), ["parent_key"], "weight", waiting.count())
    nodes = done.where(F.col("parent_key").isNull()).select(*columns).unionByName(placed.select(*columns))
    return nodes.select(*columns[:-1], F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
