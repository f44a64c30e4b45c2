"""A Merkle manifest of a table: a tree of hashes per source, a tree over the sources' roots, and a proof for every row.

Every node is the SHA-256 of its (up to ``FANOUT``) children's digests as hex text. Rows of a source are leaves in order of id; while a level has several nodes,
each run of ``FANOUT`` consecutive ones (the last may be shorter, even one) becomes a node. The last node is the source's root; those, ordered by source, are
the leaves of one more tree.

Checkpoint-and-recompute: only every ``LEVELS``-th level is stored, as aligned subtrees (a row holds up to FANOUT ** LEVELS consecutive nodes). Going up, a task
rebuilds the levels between from the stored nodes and passes on the top one. Going down, a task rebuilds them again from the same row, emits every stored node's siblings
level by level in front of the siblings further up, and forgets them. A subtree is at most 256 nodes, so a source with a third of all rows is many small groups;
places in a source come from a range sort and one offset a source and range, never from a window over its rows.

Defined cases: nulls are written as ``-`` (a null differs from an empty text); rows without source form a source of their own, the first; rows without id come first in their source;
rows that share an id are ordered by leaf, and repeated rows are leaves of their own; a source of one row has its leaf as root; an empty table has no rows
and no root; columns that are not named in ``fields`` are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import held_out
from fieldloom.session import materialise

FANOUT, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<place:int,siblings:string>>"  # the node's place in its run, and the others' digests one after another


def leaf_of(**fields: Column) -> Column:
    """Digest of a row: every field as ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def small_letters(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([sha256("".join(below[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return rows


def paths(nodes: list[str], levels: int) -> list[list[tuple[int, str]]]:
    """For every node its place and siblings on each of the next ``levels`` levels."""
    steps = []
    for row in climb(nodes, levels)[:levels]:
        runs = [row[i:i + FANOUT] for i in range(0, len(row), FANOUT)]
        steps.append([(k, "".join(run[:k] + run[k + 1:])) for run in runs for k in range(len(run))])
    return [[steps[j][i // FANOUT ** j] for j in range(levels)] for i in range(len(nodes))]


def in_order(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place in its tree from 0, and ``n``, the tree's size."""
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("seq", F.monotonically_increasing_id())
    spread = materialise(spread.withColumn("part", F.shiftright("seq", 33)), "ordered")
    parts = spread.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("here"))
    upto = Window.partitionBy("tree").orderBy("part")  # one row per tree and range
    offsets = parts.select("tree", "part", (F.sum("here").over(upto) - F.col("here") - F.col("first")).alias("shift"),
                           F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    return spread.join(offsets, ["tree", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


def subtrees(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, n, block, items: the nodes (tree, n, pos, digest, ...) in aligned subtrees, each in order."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos", "digest")]
    item = F.struct("pos", "digest", *rest)
    return (nodes.withColumn("block", F.floor(F.col("pos") / FANOUT ** levels)).groupBy("tree", "n", "block")
            .agg(F.array_sort(F.collect_list(item)).alias("items")))


def tops(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, n, pos, digest of the nodes that stand ``levels`` levels above the stored ones."""
    def rise(batches):
        for batch in batches:
            out = [climb([d.hex() for d in digests], min(levels, height(n)))[-1][0] for n, digests in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            fewer = [-(-n // FANOUT ** levels) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fewer, pa.int64()), batch.column(2), pa.array(map(bytes.fromhex, out), pa.binary())], ["tree", "n", "pos", "digest"])

    return blocks.select("tree", "n", "block", "items.digest").mapInArrow(rise, "tree string, n long, pos long, digest binary")


def stored_levels(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Subtrees of the leaves, of the nodes ``levels`` above, and so on; the last are the roots alone."""
    stored = [materialise(subtrees(nodes, levels), "subtrees")]
    while not (more := stored[-1].where("n > 1")).isEmpty():
        stored.append(materialise(subtrees(tops(more, levels), levels), "subtrees"))
    return stored


def roots(stored: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's root."""
    ends = [level.where("n = 1").select("tree", F.col("items")[0]["digest"].alias("digest")) for level in stored]
    out = ends[0]
    for end in ends[1:]:
        out = out.union(end)
    return out


def proofs(stored: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, pos, digest, root, steps and the other columns of every leaf. ``above`` (tree, root, steps) holds what stands over each tree's root."""
    below = None
    for depth in reversed(range(len(stored))):
        blocks = stored[depth]
        whole = blocks.where("n = 1").join(above, "tree")  # trees that end at this level
        if below is not None:
            parts = blocks.where("n > 1").join(below.select("tree", F.col("pos").alias("block"), "root", "steps"), ["tree", "block"])
            whole = whole.unionByName(parts)
        names = [f.name for f in blocks.schema["items"].dataType.elementType.fields]
        rest = [n for n in names if n not in ("pos", "digest")]
        kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["items"].dataType.elementType.fields}
        schema = ", ".join(["tree string", "pos long", "digest binary", "root binary", f"steps {STEPS}", *[f"`{n}` {kinds[n]}" for n in rest]])
        below = whole.select("tree", "n", "root", "steps", *[F.col("items")[n].alias(n) for n in names]).mapInArrow(regenerate(levels, rest), schema)
        if depth:
            below = materialise(below, "proofs")
    return below


def regenerate(levels: int, rest: list[str]):
    """A batch function: from each subtree's nodes, the levels between, and from those every node's steps to the top."""
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))

    def emit(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # a subtree at a time: at most FANOUT ** LEVELS proofs are held
                part = {name: batch.column(name)[row].as_py() for name in ("tree", "n", "root", "steps")}
                inner = {name: batch.column(name)[row].values for name in ("pos", "digest", *rest)}
                nodes = [d.hex() for d in inner["digest"].to_pylist()]
                upper = [(s["place"], s["siblings"]) for s in part["steps"]]
                steps = [own + upper for own in paths(nodes, min(levels, height(part["n"])))]
                size = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part["tree"]] * size, pa.string()), inner["pos"], inner["digest"], pa.array([part["root"]] * size, pa.binary()), pa.array(steps, kind),
                     *[inner[name] for name in rest]], ["tree", "pos", "digest", "root", "steps", *rest])

    return emit


def fold(node: Column, steps: Column) -> Column:
    """The root that a node and its steps lead to."""
    def up(digest, step):
        cut = step["place"] * 64
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), cut), digest, F.substring(step["siblings"], cut + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(steps, node, up)


def manifest(docs: DataFrame, fields=FIELDS, tree_col: str = "source", id_col: str = "doc_id", altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root and steps (the proof) for every row of ``docs``; ``altered``, a digest computed beside the leaf, is handed through."""
    leaf = F.unhex(leaf_of(**{name: F.col(name) for name in fields}))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"),
                       F.unhex(altered if altered is not None else F.lit(None).cast("string")).alias("altered"))
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "leaves")  # hashed once; ``at`` lets ranges split repeated rows
    stored = stored_levels(in_order(rows, ["doc_id", "digest", "at"]).drop("at"), levels)
    heads = materialise(roots(stored), "subroots")
    one_tree = heads.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = stored_levels(in_order(one_tree, ["name"]), levels)
    root = materialise(roots(top), "root")
    nothing = F.array().cast(STEPS)
    above = proofs(top, root.select("tree", F.col("digest").alias("root"), nothing.alias("steps")), levels)
    above = materialise(above.select(F.col("name").alias("tree"), F.col("digest").alias("root"), "steps", F.col("root").alias("top")), "above")
    found = proofs(stored, above.select("tree", "root", "steps"), levels)
    total = root.first()
    hex_of = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", hex_of("digest").alias("leaf"), hex_of("root").alias("subroot"), F.lit(bytes(total["digest"]).hex() if total else "").alias("root"), "steps",
                        hex_of("altered").alias("altered"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof digest; and, for every fifth id by crc32, whether a text put in small letters still folds to the root."""
    chosen = held_out("doc_id")
    changed = leaf_of(**{name: small_letters(F.col(name)) if name == "text" else F.col(name) for name in FIELDS})
    rows = manifest(docs, altered=F.when(chosen, changed))
    siblings = F.array_join(F.transform("steps", lambda s: s["siblings"]), "")
    return (rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("steps")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _levels_sql(name: str, first: str, depth: int) -> str:
    """Nodes of ``depth`` levels above table ``first`` (tree, pos, n, digest), and on each level what stands before and after a node in its run."""
    out = []
    for k in range(depth):
        here = first if k == 0 else f"{name}{k}"
        out.append(f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY t.pos)) AS digest FROM {here} t WHERE n > 1 GROUP BY tree, t.pos // 16, n)")
        out.append(f"{name}s{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, "
                   f"coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after FROM {here} a JOIN {here} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 "
                   f"WHERE a.n > 1 GROUP BY a.tree, a.pos)")
    ends = " UNION ALL ".join(f"SELECT tree, digest FROM {first if k == 0 else f'{name}{k}'} WHERE n = 1" for k in range(depth + 1))
    return ", ".join([*out, f"{name}r AS ({ends})"])


def _sql(deep: int = 6, wide: int = 4) -> str:
    """The whole contract in SQL, for up to 16 ** ``deep`` rows a source and 16 ** ``wide`` sources."""
    def written(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    fields = " || ".join(written(c) for c in FIELDS[:-1])
    changed = f"translate(text, '{CAPITALS}', '{SMALL}')"
    # crc32 by its definition: 0..255 brings a byte in, 256 is one shift
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: 256::BIGINT))))), "
           "lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)")
    joins, before, folded = [], [], "altered"
    for name, depth, place, tree in (("d", deep, "l.pos", "l.tree"), ("t", wide, "s.pos", "''")):
        for k in range(depth):
            joins.append(f"LEFT JOIN {name}s{k} ON {name}s{k}.tree = {tree} AND {name}s{k}.pos = {place} // {16 ** k}")
            before.append(f"coalesce({name}s{k}.before || {name}s{k}.after, '')")
    steps = [(f"d{k}", f"ds{k}") for k in range(deep)] + [(f"t{k}", f"ts{k}") for k in range(wide)]
    chain, last = [], "f0"
    sides = ", ".join(f"{s}.before AS {n}b, {s}.after AS {n}a" for n, s in steps)
    chain.append(f"f0 AS (SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM tr) AS root, sha256({' || '.join(before)}) AS proof_sha256, l.altered AS node, {sides} "
                 f"FROM leaves l JOIN tops s ON s.name = l.tree {' '.join(joins)})")
    for i, (n, _) in enumerate(steps):
        chain.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {n}b IS NULL THEN node ELSE sha256({n}b || node || {n}a) END AS node) FROM f{i})")
        last = f"f{i + 1}"
    return f"""
WITH hashed AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({fields} || {written('text')}) AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN sha256({fields} || {written(changed)}) END AS changed FROM documents),
leaves AS (
    SELECT doc_id, tree, leaf, coalesce(changed, leaf) AS altered, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{_levels_sql("d", "leaves", deep)},
tops AS (SELECT '' AS tree, tree AS name, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS pos FROM dr),
{_levels_sql("t", "tops", wide)},
{', '.join(chain)}
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {last}
"""


SQL = _sql()
