"""The Merkle manifest against trees built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from startline.llm import op12_merkle as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    """The root, and for each node its siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, i in enumerate(at):
            low = i // arity * arity
            run = nodes[low : low + arity]
            paths[n].append((run[: i - low], run[i - low + 1 :]))
        at = [i // arity for i in at]
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows, arity):
    leaves = [(r, plain_leaf([r[0], r[3], r[2], r[4], r[1]])) for r in rows]
    parts = sorted({r[2] for r in rows}, key=lambda p: (p is not None, (p or "").encode()))
    trees = []
    for p in parts:
        own = sorted(((r, x) for r, x in leaves if r[2] == p), key=lambda v: (v[0][0] is not None, v[0][0] or 0, v[1]))
        trees.append((own, *climb([x for _, x in own], arity)))
    root, tops = climb([t[1] for t in trees], arity)
    found = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for (row, leaf), path in zip(own, paths, strict=True):
            steps = path + top
            found.append((row[0], leaf, "".join("".join(a + b) for a, b in steps), bytes(x for a, b in steps for x in (len(a), len(b))), subroot, root))
    return found


def manifest(df, **options):
    leaf = op.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return op.merkle_manifest(df, leaf, **options)


@pytest.mark.parametrize(("arity", "range_rows", "fan_in"), [(2, 1 << 17, 32), (2, 20, 2), (3, 7, 3)])
def test_trees_over_ranges_and_rounds(spark, arity, range_rows, fan_in):
    rnd = random.Random(arity + range_rows)
    rows = [(d, f"text {d % 9}", rnd.choice(["a", "é", "zz", None, "one"]), None if d % 5 == 0 else "s", d) for d in rnd.sample(range(-99, 999), 230)]
    rows += [(7777, "x", f"part {n}", None, None) for n in range(12)] + [(None, None, "a", None, None)] * 3 + [rows[0]] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = manifest(df, arity=arity, range_rows=range_rows, fan_in=fan_in).select("doc_id", "leaf", "siblings", "shape", "subroot", "root").collect()
    text = lambda r: tuple(str(bytes(v) if isinstance(v, bytearray) else v) for v in r)
    assert sorted(map(text, got)) == sorted(map(text, plain_manifest(rows, arity)))
    assert all(op.fold(r["leaf"], r["siblings"], bytes(r["shape"])) == r["root"] for r in got)


def test_fragments_unite_in_any_order():
    rnd = random.Random(4)
    sizes = [1, 9, 16, 5, 30]
    nodes = [((t, 0, n), (size, h(str(t), str(n)))) for t, size in enumerate(sizes) for n in range(size)]
    want = op.Forest(len(sizes)).add(dict(nodes)).nodes
    assert len(want) == 1
    for _ in range(20):
        rnd.shuffle(nodes)
        cuts = sorted(rnd.sample(range(len(nodes)), 4))
        parts = [op.Forest(len(sizes)).add(dict(nodes[a:z])) for a, z in zip([0, *cuts], [*cuts, len(nodes)], strict=True)]
        while len(parts) > 1:
            a, b = parts.pop(rnd.randrange(len(parts))), parts.pop(rnd.randrange(len(parts)))
            parts.append(op.Forest(len(sizes)).add(a.nodes).add(b.nodes))
        assert parts[0].nodes == want


def test_tampered_rows_only_fail(spark, data):
    got = op.op12_merkle(spark, data).collect()
    assert len(got) == 200
    for r in got:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(3, "t", None, None, None)], SCHEMA)
    r = manifest(one).first()
    assert (r["siblings"], bytes(r["shape"]), r["subroot"], r["root"]) == ("", b"", r["leaf"], r["leaf"])
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "w " * 2_000_000, "en", "a", 1), (2, "", "en", "a", None), (2, "", "en", "a", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "part", "range", "kind", "tree", "twin", "root", "siblings", "n", "_carry_0")})
    got = manifest(df, carry={"kept": F.col("text")}).collect()
    assert sorted(r["leaf"] for r in got) == sorted(plain_leaf([r[0], r[3], r[2], r[4], r[1]]) for r in rows)
    assert sorted(len(r["kept"]) for r in got) == [0, 0, 4_000_000]
