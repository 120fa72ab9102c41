"""Merkle dataset manifest: one digest for a table, one for each part of it, and a proof of inclusion for each row.

Every row is a leaf, hashed by Spark's own functions. The leaves of a part, in order of the identifier, form a tree;
the roots of the parts, in order of the part, form one more. Rows are dealt to ranges of (part, identifier), so that a
range holds a run of leaves whose places in their trees follow from counts by range alone.

Trees grow as fragments of a sparse forest, a monoid. A fragment is a set of unresolved nodes, keyed by tree, level and
index. Two fragments are united, and whenever all siblings of a run are there, whose number the tree's size tells,
they give way to their parent; the order of the unions does not matter. A fragment of a run of leaves keeps some two
nodes a level, so a tree reduction in rounds of 32 neighbouring ranges moves a few kilobytes a range, and its last
fragment is the root. (RDD.treeReduce deals fragments by their number modulo some count: neighbours would meet in the
driver only, which would then hold the unresolved nodes of all ranges. Rounds by neighbours resolve nodes where they
are, and no fragment reaches the driver.)

The rounds are stored, and walked back: each hands its members the siblings that lie above their unresolved nodes, and
the ranges then write the proof of every leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.llm.common import materialise, running_sums, shuffle_width

ARITY = 2
#: Leaves of a range, of which a task holds one at a time; ranges merged into one fragment.
RANGE_ROWS, FAN_IN = 1 << 17, 32
#: The tree of the parts' roots; the others are numbered from 0 in order of their parts.
TOP = -1
HEX = 64

Key = tuple[int, int, int]  # tree, level, index
#: Siblings up to the root, bytes that say how many of them lie before and after at each level, subroot, root.
Path = tuple[str, bytes, str | None, str]
NODE = "tree long, size long, level int, index long, digest string"
PATH = "tree long, level int, index long, siblings string, shape binary, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in lowercase hex of the fields, each `-` if null, else its UTF-8 length, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(first: int, leaves: list[str], size: int, arity: int) -> list[tuple[int, list[str]]]:
    """The nodes, by level, that a run of leaves from `first` of a tree of `size` leaves resolves: (first index, digests)."""
    levels, width = [(first, leaves)], size
    while width > 1:
        start, now = levels[-1]
        low, high = -(-start // arity), (start + len(now)) // arity if start + len(now) < width else -(-width // arity)
        if high <= low:
            break
        levels.append((low, [joined(now[max(0, n * arity - start) : (n + 1) * arity - start]) for n in range(low, high)]))
        width = -(-width // arity)
    return levels


class Forest:
    """A fragment: unresolved nodes, (size of the tree, digest) by key; `links` says how resolved ones hang on parents."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.trees, self.arity = trees, arity
        self.nodes: dict[Key, tuple[int, str]] = {}
        self.links: dict[Key, tuple[Key, list[str], list[str], str]] = {}

    def add(self, nodes: dict[Key, tuple[int, str]]) -> Forest:
        """Unites this fragment with more nodes and resolves every run that is complete by then."""
        self.nodes |= nodes
        left = sorted(nodes, reverse=True)
        while left:
            key = left.pop()
            if key not in self.nodes:
                continue
            tree, level, index = key
            size, digest = self.nodes[key]
            width = -(-size // self.arity**level)
            if width > 1:
                low = index // self.arity * self.arity
                run = [(tree, level, n) for n in range(low, min(low + self.arity, width))]
                if not all(k in self.nodes for k in run):
                    continue
                digests = [self.nodes.pop(k)[1] for k in run]
                parent, value = (tree, level + 1, index // self.arity), (size, joined(digests))
                self.links |= {k: (parent, digests[:n], digests[n + 1 :], digests[n]) for n, k in enumerate(run)}
            elif tree != TOP:  # a part's root is a leaf of the tree of parts
                parent, value = (TOP, 0, tree), (self.trees, self.nodes.pop(key)[1])
                self.links[key] = (parent, [], [], digest)
            else:
                continue
            self.nodes[parent] = value
            left.append(parent)
        return self

    def path(self, key: Key, known: dict[Key, Path]) -> Path:
        """From a node to the root, where the paths of unresolved nodes are known; what is found is known afterwards."""
        if key not in known:
            parent, before, after, digest = self.links[key]
            siblings, shape, subroot, root = self.path(parent, known)
            if key[0] != parent[0]:
                known[key] = (siblings, shape, digest, root)
            else:
                known[key] = ("".join(before + after) + siblings, bytes([len(before), len(after)]) + shape, subroot, root)
        return known[key]


def fold(leaf: str, siblings: str, shape: bytes) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for before, after in zip(shape[::2], shape[1::2], strict=True):
        a, z = at + before * HEX, at + (before + after) * HEX
        leaf = hashlib.sha256(f"{siblings[at:a]}{leaf}{siblings[a:z]}".encode()).hexdigest()
        at = z
    return leaf


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[pa.RecordBatch]]]]:
    """From rows in order of their first two columns, a group and a kind: each group with its rows by kind."""
    at, held = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        group, kind = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
        cuts = np.nonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if group[a] != at:
                if at is not None:
                    yield int(at), held
                at, held = group[a], {}
            held.setdefault(int(kind[a]), []).append(batch.slice(a, z - a))
    if at is not None:
        yield int(at), held


def rows_of(batches: list[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def local_trees(held: dict[int, list[pa.RecordBatch]], trees: int, arity: int) -> tuple[list, Forest]:
    """From a range's segments (kind 0) and leaves (kind 2): (tree, size, levels) of each segment, and their forest."""
    leaves = [x for (x,) in rows_of(held.get(2, []), "leaf")]
    grown, at = [], 0
    for tree, size, first, n in rows_of(held.get(0, []), "tree", "size", "first", "n"):
        grown.append((tree, size, levels_of(first, leaves[at : at + n], size, arity)))
        at += n
    return grown, Forest(trees, arity).add({k: v for g in grown for k, v in loose(*g, arity).items()})


def loose(tree: int, size: int, levels: list[tuple[int, list[str]]], arity: int) -> dict[Key, tuple[int, str]]:
    """The nodes of a segment that have no parent in it."""
    found = {}
    for level, (start, now) in enumerate(levels):
        low, high = (levels[level + 1][0], levels[level + 1][0] + len(levels[level + 1][1])) if level + 1 < len(levels) else (0, 0)
        found |= {(tree, level, start + n): (size, x) for n, x in enumerate(now) if not low <= (start + n) // arity < high}
    return found


def proofs(tree: int, levels: list[tuple[int, list[str]]], forest: Forest, known: dict[Key, Path], arity: int) -> Iterator[Path]:
    """The path of every leaf of a segment; what neighbours share is put together once."""
    last: list[tuple[int, Path] | None] = [None] * len(levels)

    def path(level: int, index: int) -> Path:
        kept = last[level]
        if kept is None or kept[0] != index:
            up = index // arity
            if level + 1 < len(levels) and levels[level + 1][0] <= up < levels[level + 1][0] + len(levels[level + 1][1]):
                start, now = levels[level]
                before, after = now[up * arity - start : index - start], now[index + 1 - start : (up + 1) * arity - start]
                siblings, shape, subroot, root = path(level + 1, up)
                kept = (index, ("".join(before + after) + siblings, bytes([len(before), len(after)]) + shape, subroot, root))
            else:
                kept = (index, forest.path((tree, level, index), known))
            last[level] = kept
        return kept[1]

    start, leaves = levels[0]
    return (path(0, start + n) for n in range(len(leaves)))


def dealt(parts: list[DataFrame], group: str, *order: str) -> DataFrame:
    """Rows of several kinds by group, in order of kind and then of the columns given."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (group, "kind")]
    return rows.repartition(group).sortWithinPartitions(group, "kind", *order).select(group, "kind", *others)


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(schema)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in T.StructType.fromDDL(ddl)])


def merkle_manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", part_col: str = "lang", carry: dict[str, Column] | None = None, arity: int = ARITY, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each input row: doc_id, part, leaf, siblings, shape, subroot, root and the columns of `carry`.

    `siblings` are the digests from the leaf's level to the root, put together; `shape` has two bytes a level, the
    number of siblings before and after the node (none for a node that is alone at the end of its level). Null parts
    come first. Rows of one identifier are leaves of their own, in order of their digests; null identifiers come first.
    An empty table gives an empty result. Other columns are not read, clashing names included.
    """
    spark, carry = docs.sparkSession, carry or {}
    part = F.struct(F.col(part_col).isNotNull().alias("known"), F.col(part_col).alias("value"))
    named = [c.alias(f"_carry_{n}") for n, c in enumerate(carry.values())]
    # twin parts rows that are equal in all else, so that no group of repeats is one range
    leaves = docs.select(part.alias("part"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), *named).withColumn("twin", F.xxhash64(F.monotonically_increasing_id()))
    leaves = materialise(leaves, "leaves")
    order = [F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("twin")]
    n_ranges = max(shuffle_width(spark), -(-leaves.count() // range_rows))
    ranged = materialise(leaves.repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id()), "ranged")

    segments = materialise(ranged.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n")), "segments")
    sizes = running_sums(segments.groupBy("part").agg(F.sum("n").alias("size")), [F.col("part")], {"tree": F.lit(1).cast("long"), "base": F.col("size")})
    sizes = materialise(sizes, "sizes")
    trees = sizes.count()
    places = running_sums(segments, [F.col("part"), F.col("range")], {"before": F.col("n")}).join(sizes, "part")
    places = materialise(places.select("range", F.lit(0).cast("byte").alias("kind"), "tree", "size", (F.col("before") - F.col("base")).alias("first"), "n"), "places")
    rows = ranged.withColumn("kind", F.lit(2).cast("byte"))

    # up: fragments of ranges, then of 32 neighbours each, until one is left
    node_schema = arrow("group int, " + NODE)

    def sprout(batches):
        for group, held in groups_of(batches):
            forest = local_trees(held, trees, arity)[1]
            yield table([(group, k[0], size, k[1], k[2], x) for k, (size, x) in forest.nodes.items()], node_schema)

    def merged(held) -> Forest:
        return Forest(trees, arity).add({(t, lv, n): (size, x) for t, size, lv, n, x in rows_of(held.get(1, []), "tree", "size", "level", "index", "digest")})

    def grow(batches):
        for group, held in groups_of(batches):
            yield table([(group, k[0], size, k[1], k[2], x) for k, (size, x) in merged(held).nodes.items()], node_schema)

    up = dealt([places, rows.select("range", "kind", "part", "doc_id", "leaf", "twin")], "range", "tree", "part", "doc_id", "leaf", "twin")
    rounds = [materialise(up.drop("part", "doc_id", "twin").mapInArrow(sprout, "group int, " + NODE), "fragments-0")]
    left = n_ranges
    while left > 1 or len(rounds) == 1:
        left = -(-left // fan_in)
        nodes = rounds[-1].withColumns({"group": F.floor(F.col("group") / fan_in).cast("int"), "kind": F.lit(1).cast("byte")})
        rounds.append(materialise(dealt([nodes], "group").mapInArrow(grow, "group int, " + NODE), f"fragments-{len(rounds)}"))

    # down: the paths of each fragment's unresolved nodes, then of its members'
    path_schema = arrow("group int, " + PATH)

    def hand_down(batches):
        for _, held in groups_of(batches):
            known, forest = paths(held, 0), merged(held)
            members = rows_of(held.get(1, []), "member", "tree", "level", "index")
            yield table([(m, t, lv, n, *forest.path((t, lv, n), known)) for m, t, lv, n in members], path_schema)

    above = rounds[-1].select("group", "tree", "level", "index", F.lit("").alias("siblings"), F.unhex(F.lit("")).alias("shape"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for level in range(len(rounds) - 2, -1, -1):
        members = rounds[level].withColumns({"member": F.col("group"), "group": F.floor(F.col("group") / fan_in).cast("int"), "kind": F.lit(1).cast("byte")})
        above = materialise(dealt([above.withColumn("kind", F.lit(0).cast("byte")), members], "group").mapInArrow(hand_down, "group int, " + PATH), f"paths-{level}")

    out = [ranged.schema["doc_id"], T.StructField("part", docs.schema[part_col].dataType), ranged.schema["leaf"]]
    out += T.StructType.fromDDL("siblings string, shape binary, subroot string, root string").fields
    out = T.StructType(out + [T.StructField(name, ranged.schema[f"_carry_{n}"].dataType) for n, name in enumerate(carry)])
    names, carried = out.names, [f"_carry_{n}" for n in range(len(carry))]

    def prove(batches):
        for _, held in groups_of(batches):
            known, (grown, forest) = paths(held, 1), local_trees(held, trees, arity)
            found = (p for tree, _, levels in grown for p in proofs(tree, levels, forest, known, arity))
            for batch in held.get(2, []):
                for at in range(0, batch.num_rows, 4096):
                    now = batch.slice(at, 4096)
                    own = [next(found) for _ in range(now.num_rows)]
                    kept = [now.column(c) for c in ("doc_id", "part", "leaf")]
                    columns = [pa.array([p[n] for p in own], kind) for n, kind in enumerate((pa.string(), pa.binary(), pa.string(), pa.string()))]
                    extra = [now.column(c) for c in carried]
                    yield pa.RecordBatch.from_arrays([kept[0], pc.struct_field(kept[1], "value"), kept[2], *columns, *extra], names)

    paths_in = above.withColumn("kind", F.lit(1).cast("byte")).withColumnRenamed("group", "range")
    return dealt([places, paths_in, rows], "range", "tree", "part", "doc_id", "leaf", "twin").mapInArrow(prove, out)


def paths(held: dict[int, list[pa.RecordBatch]], kind: int) -> dict[Key, Path]:
    names = ("tree", "level", "index", "siblings", "shape", "subroot", "root")
    return {(tree, level, index): (siblings, shape, subroot, root) for tree, level, index, siblings, shape, subroot, root in rows_of(held.get(kind, []), *names)}


def folded(manifest: DataFrame, leaf: str, name: str) -> DataFrame:
    """manifest and, under a name, the root that a column of leaves gives with the row's siblings."""

    def work(batches):
        for batch in batches:
            roots = [fold(*row) for row in rows_of([batch], leaf, "siblings", "shape")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, name])

    return manifest.mapInArrow(work, T.StructType([*manifest.schema.fields, T.StructField(name, T.StringType())]))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def leaf(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = merkle_manifest(docs, leaf(F.col("n_chars")), carry={"tampered": F.when(tampered, leaf(F.col("n_chars") + 1))})
    found = folded(found.withColumn("shown", F.coalesce("tampered", "leaf")), "shown", "folded_root")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) % 7 = 0 AS tampered
  FROM documents
), l AS (
  SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other
  FROM d
), nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h, w FROM l
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (w + 1) // 2 FROM nodes WHERE w > 1 GROUP BY lang, level, i // 2, w
), subroots AS (
  SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM nodes WHERE w = 1
), tops AS (
  SELECT 0 AS level, i, subroot AS h, w FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (w + 1) // 2 FROM tops WHERE w > 1 GROUP BY level, i // 2, w
), steps AS (
  SELECT l.doc_id, v.level, (l.i >> v.level) & 1 AS side, n.h FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range(0, 64) v(level)
    LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = v.level AND n.i = xor(l.i >> v.level, 1) WHERE v.level < s.height
  UNION ALL
  SELECT l.doc_id, s.height + v.level, (s.i >> v.level) & 1, n.h FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range(0, 64) v(level)
    LEFT JOIN tops n ON n.level = v.level AND n.i = xor(s.i >> v.level, 1) WHERE v.level < (SELECT max(level) FROM tops)
), p AS (
  SELECT doc_id, list(CASE WHEN h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS steps, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256
  FROM steps GROUP BY doc_id
), f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM tops WHERE w = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN l.tampered THEN l.other ELSE l.leaf END, coalesce(p.steps, [])),
      lambda a, x: CASE x[1] WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
  FROM l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN p USING (doc_id)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
