"""Prefix trie of conversations: who shares which first turns, and how many words a shared prefix saves.

Conversations are sorted by their sequence of turns. A node of the trie (a distinct prefix) is then an interval of neighbours whose longest
common prefixes (LCP) are at least its depth. A sparse table answers the least LCP of any range at once; every candidate prefix searches its
left and its right end by halving steps on its own, so that no stack runs over the rows and a block's candidates are searched together.

The sort is a range partitioning. A block is one range: what lies inside it is finished there; a node that goes on beyond an end of its
block (few for each block: at most the turns of its first and of its last conversation) leaves sums that add up over the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, ship

TOKEN = 16      # bytes of a turn's fingerprint
GROUP = 20      # conversations that share the head of the first of them
HEADS = 4       # a conversation takes 0 to HEADS - 1 turns of it
WHOLE, PART, END = 0, 1, 2
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = ("kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
           + ", ".join(f"{c} long" for c in SUMS) + ", ends_sha256 string")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns (array of token, words), one row for each conversation given as rows (conv_id, turn, role, text).

    Turns stand by turn (null first), then role and fingerprint; a null role or text is empty; repeated rows are turns of their own. Rows
    without conv_id name no conversation and take no part. A turn's fingerprint are 16 bytes of the SHA-256 of role and text, so that
    texts of any length cost the same; a conversation's fingerprints have to fit into one row (2 GB: about 70 million turns).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    token = F.unhex(F.substring(F.sha2(named, 256), 1, 2 * TOKEN))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    one = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), token.alias("token"), words.alias("words")).alias("_one"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("_one")).alias("_all")).select(
        "conv_id", F.transform("_all", lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % group (as many as there are), then goes on with its own turns
    after the first h; h = crc32(c as text) % heads. Conversations may end up without a turn."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head"))
    both = own.withColumn("_h", h).withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).join(first, "_first", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


# ---------------------------------------------------------------- one block
def common(a: bytes, b: bytes) -> int:
    """How many turns two keys share at their start."""
    n = min(len(a), len(b)) // TOKEN
    same = (np.frombuffer(a, np.uint64, 2 * n) == np.frombuffer(b, np.uint64, 2 * n)).reshape(-1, 2).all(axis=1)
    return n if same.all() else int(same.argmin())


def neighbour_lcp(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of each row with the one before it (the first: -1). data: fingerprints as pairs of 64 bits; rows start there and have so many."""
    out = np.full(len(length), -1, np.int64)
    if len(length) < 2:
        return out
    alive, depth = np.arange(1, len(length)), 0
    least = np.minimum(length[1:], length[:-1])
    out[1:] = least
    while len(alive):
        ended = least[alive - 1] <= depth
        alive = alive[~ended]
        same = (data[start[alive] + depth] == data[start[alive - 1] + depth]).all(axis=1)
        out[alive[~same]] = depth
        alive, depth = alive[same], depth + 1
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the least of the 2**k values that start at each place."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return levels


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row around each row with an LCP of at least depth all the way. levels: of the rows' LCPs with the one before."""
    n = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, table = 1 << k, levels[k]
        free = left - step >= 0
        left -= step * (free & (table[np.where(free, left - step + 1, 0)] >= depth))
        free = right + step <= n - 1
        right += step * (free & (table[np.where(free, right + 1, 0)] >= depth))
    return left, right


def range_least(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    k = np.log2(right - left + 1).astype(np.int64)
    out = np.empty(len(left), np.int64)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << level) + 1])
    return out


class Occurrences:
    """How often a value stands in a range of rows."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, n: int):
        self.n = n + 1
        self.keys = np.sort((values + 1) * self.n + rows)

    def between(self, value: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        base = (value + 1) * self.n
        return np.searchsorted(self.keys, base + right, "right") - np.searchsorted(self.keys, base + left, "left")


def prefix_digests(keys: list[bytes], row: np.ndarray, depth: np.ndarray) -> list[bytes]:
    """SHA-256 of the first depth turns of each row; a row's depths are hashed in one go."""
    out: list[bytes] = [b""] * len(row)
    held, at, done = None, -1, 0
    for j in np.lexsort((depth, row)):
        if row[j] != at:
            held, at, done = hashlib.sha256(), row[j], 0
        held.update(keys[at][done * TOKEN:depth[j] * TOKEN])
        done = depth[j]
        out[j] = held.digest()
    return out


def block_nodes(conv: np.ndarray, keys: list[bytes], words: np.ndarray, before: bytes | None, after: bytes | None) -> dict[str, list]:
    """Nodes of one block of sorted conversations (ids, keys, and the words of all their turns side by side), as columns of _SCHEMA.

    before and after: the keys next to the block, None at the table's ends. A node that goes on there is a PART: its sums cover the block's
    members, and whatever is counted once for a node is counted in the block where the node starts. END rows hold the ids of a PART's
    conversations that end there.
    """
    n = len(keys)
    length = np.array([len(k) // TOKEN for k in keys], np.int64)
    start = np.concatenate(([0], np.cumsum(length)))
    data = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    inside = neighbour_lcp(data, start, length)
    lcp = np.concatenate((inside, [-1 if after is None else common(keys[-1], after)]))
    lcp[0] = -1 if before is None else common(before, keys[0])

    # the candidates: every prefix at the first row of the block that has it
    shallow = np.concatenate(([0], inside[1:] + 1))
    count = length + 1 - shallow
    row = np.repeat(np.arange(n), count)
    depth = shallow[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    table, least_conv = sparse_table(inside), sparse_table(conv)
    left, right = extents(table, row, depth)
    goes_on = lambda lo, hi, d: ((lo == 0) & (lcp[0] >= d)) | ((hi == n - 1) & (lcp[n] >= d))
    part = goes_on(left, right, depth)
    older = (left == 0) & (lcp[0] >= depth)   # the node starts in an earlier block

    upto = np.concatenate(([0], np.cumsum(words)))
    head = lambda i, d: upto[start[i] + np.maximum(d, 0)] - upto[start[i]]  # noqa: E731  words of the first d turns
    total = head(np.arange(n), length)
    born = total - head(np.arange(n), lcp[:n])                # words of the prefixes that a row is the first to have
    members = right - left + 1
    all_total, all_born = (np.concatenate(([0], np.cumsum(x))) for x in (total, born))
    above = head(left, depth - 1)
    said = all_total[right + 1] - all_total[left] - members * above
    first_born = np.where(older, born[left], total[left] - above)
    once = all_born[right + 1] - all_born[left + 1] + first_born
    leaf = np.concatenate(([0], np.cumsum(lcp[1:] < length)))
    longer = np.arange(n)
    branching = Occurrences(lcp[:n], longer, n)               # rows that leave the row before at this depth ...
    ending = Occurrences(length, longer, n)
    same = np.flatnonzero(lcp[:n] == length)                  # ... but not those that end there
    ends_there = Occurrences(lcp[same], same, n)
    begin = np.where(older, left, left + 1)
    children = (branching.between(depth, begin, right) - ends_there.between(depth, begin, right)
                + np.where(older, 0, length[left] > depth))
    up_left, up_right = extents(table, row, np.maximum(depth - 1, 0))
    up_part = goes_on(up_left, up_right, depth - 1) & (depth > 0)
    up_conv = range_least(least_conv, up_left, up_right)
    ends = ending.between(depth, left, right)

    keyed = np.flatnonzero(part)
    key = dict(zip(keyed.tolist(), prefix_digests(keys, row[keyed], depth[keyed]), strict=True))
    under = np.flatnonzero(up_part)
    up_key = dict(zip(under.tolist(), prefix_digests(keys, row[under], depth[under] - 1), strict=True))
    ids = [str(c) for c in conv.tolist()]
    nothing = hashlib.sha256(b"").hexdigest()
    hashed = [nothing if not m else hashlib.sha256(",".join(ids[a:a + m]).encode()).hexdigest() for a, m in zip(left.tolist(), np.where(part, 0, ends).tolist(), strict=True)]
    out = {"kind": np.where(part, PART, WHOLE).tolist(), "key": [key.get(j) for j in range(len(row))], "parent_key": [up_key.get(j) for j in range(len(row))],
           "conv_id": range_least(least_conv, left, right).tolist(), "depth": depth.tolist(),
           "parent_conv_id": [None if d == 0 or p else c for d, p, c in zip(depth.tolist(), up_part.tolist(), up_conv.tolist(), strict=True)],
           "n_convs": members.tolist(), "n_children": children.tolist(), "n_leaves": (leaf[right + 1] - leaf[left]).tolist(), "saved_tokens": (said - once).tolist(), "ends_sha256": hashed}
    for j in keyed[ends[keyed] > 0].tolist():
        here = conv[left[j]:left[j] + ends[j]].tolist()
        for c, values in out.items():
            values += here if c == "conv_id" else [{"kind": END, "key": key[j]}.get(c)] * len(here)
    return out


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = left.sort_by([("key", "ascending"), ("conv_id", "ascending")]).combine_chunks()
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                        *[(c, pa.int64()) for c in SUMS], ("ends_sha256", pa.string())])
    if not rows.num_rows:
        return schema.empty_table()
    words = pa.concat_arrays([c for c in rows["words"].chunks]).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = block_nodes(rows["conv_id"].to_numpy(), rows["key"].to_pylist(), words, right["before"][0].as_py(), right["after"][0].as_py())
    return pa.table({c: pa.array(found[c], schema.field(c).type) for c in schema.names}, schema)


# ---------------------------------------------------------------- all blocks
def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order -> one row a key with the digest of its ids; one state at a time is held."""
    last, state = None, None
    row = lambda: pa.RecordBatch.from_pydict({"key": pa.array([last], pa.binary()), "ends": pa.array([state.hexdigest()], pa.string())})
    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != last:
                if state is not None:
                    yield row()
                last, state = key, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
    if state is not None:
        yield row()


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, of conversations given as in ``sequences``, each conv_id once.

    saved_tokens: over the node's subtree, the words of each node's last turn times the members that needn't repeat them. An empty table has
    no node, not even the root; conversations without turns are members of the root alone. A hot prefix spans as many blocks as its
    conversations fill; only the digest of the ids that end at one node is sequential by nature (8 bytes an id, streamed). A conversation's
    fingerprints are compared as a whole in its block.
    """
    spark = conversations.sparkSession
    ship(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["token"])), ""))
    flat = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ranged = saved(flat.repartitionByRange("key", "conv_id").withColumn("block", F.spark_partition_id()), "trie-rows")
    edges = spark.createDataFrame(_edges(ranged), "block int, before binary, after binary")
    nodes = saved(ranged.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_block, _SCHEMA), "trie-nodes")
    parts = nodes.where(F.col("kind") == PART).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in SUMS])
    ends = (nodes.where(F.col("kind") == END).select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_digest_ends, "key binary, ends string"))
    parts = saved(parts.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))), "trie-parts")
    up = parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    joined = parts.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumnRenamed("ends", "ends_sha256").select(*columns, "parent_key")
    whole = nodes.where(F.col("kind") == WHOLE).select(*columns, "parent_key")
    both = whole.unionByName(joined)
    known = both.where("parent_key IS NULL").select(*columns)
    asked = both.where("parent_key IS NOT NULL").join(up, "parent_key", "left").withColumn("parent_conv_id", F.col("_up")).select(*columns)
    return known.unionByName(asked)


def _edges(ranged: DataFrame) -> list[tuple[int, bytes | None, bytes | None]]:
    """The keys before and after each block; the driver sees two keys a block."""
    found = sorted(ranged.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: r["block"])
    low, high = [bytes(r["low"]) for r in found], [bytes(r["high"]) for r in found]
    return [(r["block"], high[i - 1] if i else None, low[i + 1] if i + 1 < len(found) else None) for i, r in enumerate(found)]


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(saved(sequences(turns), "conversations")))


#: CRC-32 is the reflected polynomial 0xEDB88320, byte by byte. Paths are the turns' SHA-256 digits, 64 a turn.
SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, encode(conv_id::VARCHAR) AS b FROM t GROUP BY conv_id),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::INT + 1, 2))::BIGINT)),
                                      lambda x, y: xor(x // 256, t[(xor(x, y) % 256)::INT + 1])), 4294967295) % 4 AS h FROM ids, crc_table),
r AS (SELECT c.conv_id, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND n <= h
      UNION ALL SELECT c.conv_id, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, sha256(length(role)::VARCHAR || ':' || role || text) AS token,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, depth, words, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT path, depth, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path, depth),
kids AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
stop AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
below AS (SELECT substr(node.path, 1, 64 * up) AS path, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((n_convs - 1) * words) AS saved
          FROM (SELECT *, unnest(range(depth + 1)) AS up FROM node) node LEFT JOIN kids ON kids.path = node.path GROUP BY 1)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(stop.digest, sha256('')) AS ends_sha256
FROM node LEFT JOIN kids ON kids.path = node.path JOIN below ON below.path = node.path LEFT JOIN stop ON stop.path = node.path
LEFT JOIN node up ON node.depth > 0 AND up.path = substr(node.path, 1, 64 * (node.depth - 1))
"""
