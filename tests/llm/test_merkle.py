"""The manifest against a tree that is built level by level."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle as m

SCHEMA = "doc_id long, lang string, text string, tree string, row string, root string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, lang, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, lang, text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def proof(tree, i):
    out = []
    for level in tree[:-1]:
        if (i ^ 1) < len(level):
            out.append(level[i ^ 1])
        i //= 2
    return out


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[1], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        order = sorted((r[0] is not None, r[0] or 0, plain_leaf(*r)) for r in by_lang[g])
        trees[g] = [(x[1] if x[0] else None, x[2]) for x in order]
    built = {g: levels([leaf for _, leaf in x]) for g, x in trees.items()}
    top = levels([built[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (doc_id, leaf) in enumerate(trees[g]):
            out.append((str(doc_id), leaf, built[g][-1][0], top[-1][0], "".join(proof(built[g], i) + proof(top, k))))
    return sorted(out)


def run(spark, rows, bits):
    df = spark.createDataFrame([(*r, "t", "r", "x") for r in rows], SCHEMA)
    leaves = df.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), m.leaf_digest("doc_id", "lang", "text").alias("leaf"), F.struct("doc_id").alias("row"))
    return m.manifest(leaves, bits)


@pytest.mark.parametrize("bits", [1, 2, 5, 12])
def test_witnesses_equal_those_of_a_plain_tree(spark, bits):
    rows = [(i, "en", f"text {i}") for i in range(37)]
    rows += [(i, "de", "ß" * i) for i in range(8)] + [(1, None, None), (9, "", "x"), (None, "en", "no id"), (3, "en", "again"), (3, "en", "again")]
    out = m.folded(run(spark, rows, bits), "leaf").collect()
    got = sorted((str(r["row"]["doc_id"]), r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["siblings"].hex()) for r in out)
    assert got == plain(rows)
    assert all(r["folded_root"] == r["root"] for r in out)


def test_a_changed_leaf_or_witness_leads_elsewhere(spark):
    rows = [(i, "en", f"text {i}") for i in range(11)]
    for r in run(spark, rows, 2).collect():
        assert m.climb(r["leaf"], r["way"], r["siblings"]) == r["root"]
        assert m.climb(b"\0" * 32, r["way"], r["siblings"]) != r["root"]
        assert m.climb(r["leaf"], r["way"], bytes([r["siblings"][0] ^ 1]) + r["siblings"][1:]) != r["root"]


@pytest.mark.parametrize("n", range(1, 18))
def test_witnesses_grow_as_leaves_are_appended(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    tree = m.OpenTree(n)
    for k, d in enumerate(leaves, 1):
        tree.append(d)
        # The open subtrees are the binary digits of the number of leaves.
        assert [height for height, _, _ in tree.open] == [b for b in range(5, -1, -1) if k >> b & 1]
    root = tree.close()
    assert root.hex() == levels([d.hex() for d in leaves])[-1][0]
    for d, way, siblings in zip(leaves, *tree.witnesses()):
        assert m.climb(d, way, siblings) == root


def test_one_row_and_no_row(spark):
    (only,) = run(spark, [(1, "en", "a")], 12).collect()
    assert only["way"] == "" and only["siblings"] == b"" and only["leaf"] == only["root"] == only["subroot"]
    assert run(spark, [], 12).count() == 0
