"""The Merkle manifest against a plain tree over the same rows."""

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from fieldloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root, and for every node the siblings and places up to it."""
    owner, trail = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        up, above = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i:i + 16]
            for k in range(len(run)):
                for o in owner[i + k]:
                    trail[o].append((k, run[:k] + run[k + 1:]))
            up.append(h(*run))
            above.append(sum(owner[i:i + 16], []))
        nodes, owner = up, above
    return nodes[0], trail


def expected(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = ordered, *climb([leaf(r, r[1]) for r in ordered])
    root, tops = climb([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        ordered, subroot, trails = trees[s]
        for r, trail in zip(ordered, trails):
            steps = trail + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            small = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            node = leaf(r, small if tampered else r[1])
            for place, others in steps:
                node = h(*others[:place], node, *others[place:])
            out.append((r[0], leaf(r, r[1]), subroot, root, h(*[d for _, others in steps for d in others]), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_trees(spark):
    big = [(i, f"Text {i} ÄB" if i % 3 else None, "en", "big", i) for i in range(600)]  # over two stored levels, last run of one
    odd = [(7, "Same", None, None, 1), (7, "Same", None, None, 1), (7, "other", None, None, 1), (None, "no id", "de", None, None), (8, "", "", "", 0), (9, "x" * 200_000 + "Q", "fr", "lone", 3)]
    many = [(1000 + i, "AbC", "en", f"s{i:03d}é", 3) for i in range(40)]  # a tree of sources with two levels
    rows = [(*r, "a", "b", 1) for r in big + odd + many]
    got = mm.tamper_check(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert rows_of(got) == expected(rows)


def test_one_row_one_source_and_empty_table(spark):
    rows = [(10, "ONE", "en", "s", 3, None, None, None)]
    assert rows_of(mm.tamper_check(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    assert rows_of(mm.tamper_check(spark.createDataFrame([], SCHEMA))) == []


def test_levels_between_do_not_change_the_tree(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", i, None, None, None) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, three = (rows_of(mm.manifest(docs, levels=k).select("doc_id", "root", F.to_json("steps"))) for k in (1, 3))
    assert one == three


def test_a_changed_proof_or_leaf_is_found_out(spark):
    rows = [(i, f"t{i}", "en", "s", i, None, None, None) for i in range(40)]
    found = mm.manifest(spark.createDataFrame(rows, SCHEMA))
    ok = found.select((mm.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("good"), (mm.fold(F.sha2("leaf", 256), F.col("steps")) == F.col("root")).alias("bad"))
    assert {tuple(r) for r in ok.collect()} == {(True, False)}
