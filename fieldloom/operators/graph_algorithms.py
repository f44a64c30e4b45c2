"""Iterative graph operators. The driver keeps only loop counters; every round is a table."""

import itertools

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldloom.operators.graph import both_ways, endpoints
from fieldloom.session import Rounds, bucketed, materialise, side

SOURCES_PER_BATCH = 20_000
ALIKE_TARGETS = 64
LEAST_RISE, DRAWS = 1e-12, 1 << 40  # gain of a move, as a share of the node's weight, that is more than rounding; places in a drawn order


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out degree) / (n - 1); 1 for a lone node, as for a complete graph of one."""
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    total = nodes.count()
    scale = 1.0 / (total - 1) if total > 1 else None
    score = F.lit(1.0) if scale is None else F.coalesce("degree", F.lit(0)) * F.lit(scale)
    return nodes.select("id").join(degrees, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"), score.alias("score"))


def top_nodes(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components (id, component = smallest id).

    Each round hooks every node to its smallest neighbour, flattens those pointers, and shrinks the
    edges to the ones between different trees, so the work falls from round to round.
    """
    labels = nodes.select("id", F.col("id").alias("component"))
    links = materialise(edges.where("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    while not links.isEmpty():
        pointers = links.select(F.inline(F.array(
            F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
            F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))).groupBy("v").agg(F.min("w").alias("w"))
        roots = materialise(pointers.select("v", F.least("v", "w").alias("root")), "roots")
        while True:
            up = roots.select(F.col("v").alias("root"), F.col("root").alias("above"))
            jumped = roots.join(side(up, roots), "root", "left").select(
                "v", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
            jumped = materialise(jumped, "roots")
            roots = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = materialise(labels.join(side(roots.withColumnRenamed("v", "component"), roots), "component", "left").select(
            "id", F.coalesce("root", "component").alias("component")), "labels")
        a = roots.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        links = materialise(links.join(side(a, roots), "a").join(side(b, roots), "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels


def is_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: does the graph (not empty) form a single weak component?"""
    return components(nodes, edges).agg((F.count_distinct("component") == 1).alias("is_connected"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping=0.85, max_iter=None, tol=1e-6, iterations=None) -> DataFrame:
    """Weighted PageRank with dangling mass spread evenly.

    Stops when the summed change falls below n * tol, which the damping brings about; a ``max_iter`` that is reached
    before raises. ``iterations`` asks for a fixed number of rounds instead. The edges are stored once, in buckets by source, so
    a round shuffles ranks and what flows into nodes, not the edges; the dangling mass of a round is observed while its ranks are written.
    """
    total = nodes.count()
    if total == 0:
        return nodes.select("id", F.lit(0.0).alias("score"))
    links, forget = bucketed(edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")), "src", "shares")
    out = links.groupBy("src").agg(F.sum("weight").alias("_out")).where("_out > 0")
    rounds = Rounds(nodes.sparkSession, "ranks")
    state = rounds.keep(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left")
                        .select("id", "_out", F.lit(1.0 / total).alias("score"), F.lit(0.0).alias("_old")))
    dangling = state.where("_out IS NULL").count() / total
    for turn in itertools.count():
        if turn == iterations:
            break
        if iterations is None and turn == max_iter:
            forget()
            raise RuntimeError(f"PageRank has not settled within {max_iter} rounds")
        flow = links.join(state.where("_out IS NOT NULL").select(F.col("id").alias("src"), "_out", "score"), "src").groupBy("dst").agg(
            F.sum(F.col("weight") / F.col("_out") * F.col("score")).alias("flow"))
        base = (1.0 - damping) / total + damping * dangling / total
        new = state.join(flow, state["id"] == flow["dst"], "left").select(
            "id", "_out", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("score"),
            F.col("score").alias("_old"))
        seen = Observation("round")
        state = rounds.keep(new.observe(
            seen, F.sum(F.abs(F.col("score") - F.col("_old"))).alias("change"),
            F.coalesce(F.sum(F.when(F.col("_out").isNull(), F.col("score"))), F.lit(0.0)).alias("dangling")))
        dangling = seen.get["dangling"]
        if iterations is None and seen.get["change"] < total * tol:
            break
    forget()
    return state.select("id", "score")


def simple_paths(edges: DataFrame, source, target, max_length: int = 5) -> DataFrame:
    """All simple undirected paths of at most ``max_length`` edges (path ARRAY, hops).

    A breadth-first pass from the target first finds how far each node is from it; the forward pass
    then extends a path only to nodes from which the target is still within reach.
    """
    stored = materialise(edges.where("src <> dst").select("src", "dst"), "links")
    id_type = dict(edges.dtypes)["src"]
    one = edges.sparkSession.range(1)  # a one-row table whose size the planner knows
    # the moving side is small and of known size, so a step is one scan of the edges, not their shuffle
    links = both_ways(stored)
    far = one.select(F.lit(target).cast(id_type).alias("id"), F.lit(0).alias("hops"))
    border = far
    for hop in range(1, max_length):
        step = links.join(border, links["a"] == border["id"]).select(F.col("b").alias("id")).distinct()
        border = materialise(step.join(far.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "reach")
        if border.isEmpty():
            break
        far = far.unionByName(border)
    far = materialise(far, "reach")
    start = F.lit(source).cast(id_type)
    paths = one.select(start.alias("here"), F.array(start).alias("path"))
    found = None
    for length in range(1, max_length + 1):
        grown = links.join(paths, F.col("a") == F.col("here")).where(~F.array_contains("path", F.col("b")))
        near = far.where(F.col("hops") <= max_length - length).select(F.col("id").alias("b"))
        grown = grown.join(near, "b", "left_semi").select(
            F.col("b").alias("here"), F.array_append("path", F.col("b")).alias("path")).distinct()
        grown = materialise(grown, "paths")
        done = grown.where(F.col("here") == target).select("path", F.lit(length).alias("hops"))
        found = done if found is None else found.unionByName(done)
        paths = grown.where(F.col("here") != target)
        if paths.isEmpty():
            break
    return found if source != target else found.where(F.lit(False))


def betweenness(nodes: DataFrame, edges: DataFrame, source_batches: int | None = None) -> DataFrame:
    """Directed, unweighted betweenness, normalised by (n-1)(n-2), over all sources.

    Shortest-path counts are level tables keyed (source, node); the dependencies are then summed
    back level by level. Sources are worked off in ``source_batches`` hash batches to bound the
    table of one round (by default about 20,000 sources each). Sources that nothing leads to and that lead to the same nodes (at most
    ``ALIKE_TARGETS``) lie on no path and add the same to every other node, so one of them stands for all.
    """
    total = nodes.count()
    links = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    sources = materialise(_alike_sources(links), "sources")
    if source_batches is None:
        source_batches = max(1, -(-sources.count() // SOURCES_PER_BATCH))
    scale = 1.0 / ((total - 1) * (total - 2)) if total > 2 else 1.0
    sums = None
    for batch in range(source_batches):
        # a node without outgoing edges reaches nothing
        roots = sources.where(F.pmod(F.xxhash64("src"), F.lit(source_batches)) == batch)
        level = materialise(roots.select(F.col("src").alias("s"), F.col("src").alias("v"), F.lit(1.0).alias("paths")), "level")
        levels, seen = [level], level.select("s", "v")
        while True:
            step = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths"))
            step = step.select("s", F.col("dst").alias("v"), "paths").join(seen, ["s", "v"], "left_anti")
            step = materialise(step, "level")
            if step.isEmpty():
                break
            levels.append(step)
            seen = seen.unionByName(step.select("s", "v"))
        below = levels[-1].withColumn("dep", F.lit(0.0))
        for depth in range(len(levels) - 2, -1, -1):
            here = levels[depth]
            gain = here.select("s", F.col("v").alias("u"), F.col("paths").alias("pu")).join(
                links, F.col("u") == F.col("src")).join(
                below.select("s", F.col("v").alias("dst"), F.col("paths").alias("pw"), "dep"), ["s", "dst"])
            gain = gain.groupBy("s", F.col("u").alias("v")).agg(
                F.sum(F.col("pu") / F.col("pw") * (1.0 + F.col("dep"))).alias("dep"))
            below = materialise(here.join(gain, ["s", "v"], "left").select(
                "s", "v", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")), "deps")
            if depth > 0:
                part = below.join(sources.select(F.col("src").alias("s"), "times"), "s").groupBy("v").agg(F.sum(F.col("dep") * F.col("times")).alias("dep"))
                sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    scores = sums.groupBy(F.col("v").alias("id")).agg((F.sum("dep") * scale).alias("score"))
    return nodes.select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _alike_sources(links: DataFrame) -> DataFrame:
    """src and times: the sources to start from, and how many sources each stands for, itself included."""
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    alone = out.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").where(F.col("n") <= ALIKE_TARGETS).select("src")
    sets = links.join(alone, "src", "left_semi").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to"))
    alike = sets.groupBy("to").agg(F.min("src").alias("src"), F.count("*").alias("times")).select("src", "times")
    return alike.unionByName(out.select("src").join(alone, "src", "left_anti").withColumn("times", F.lit(1).cast("long")))


def label_propagation(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Communities by neighbour majority (id, community).

    A node keeps its label while that is among the most frequent around it, else it wants the
    smallest of those. Two neighbours that change at once could swap labels forever, so of two that
    want to change only the one with the larger hash, drawn anew each round, does. Done when no node
    wants to change, which every move brings nearer (fewer edges join different labels); a ``max_rounds`` reached before raises.
    """
    links = materialise(both_ways(edges.where("src <> dst")).distinct(), "links")
    kept, wishes = Rounds(nodes.sparkSession, "labels"), Rounds(nodes.sparkSession, "moves")
    labels = kept.keep(nodes.select("id", F.col("id").alias("label")))
    for turn in itertools.count():
        if turn == max_rounds:
            raise RuntimeError(f"labels have not settled within {max_rounds} rounds")
        votes = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        own = labels.select(F.col("id").alias("a"), F.col("label").alias("own"))
        best = votes.join(own, "a").groupBy("a").agg(
            F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("choice"), F.max("n").alias("most"),
            F.max(F.when(F.col("label") == F.col("own"), F.col("n"))).alias("own_n"))
        wish = wishes.keep(best.where("own_n is null or own_n < most").select(
            F.col("a").alias("id"), "choice", F.xxhash64("a", F.lit(turn)).alias("draw")))
        if wish.isEmpty():
            break
        rival = links.join(wish.select(F.col("id").alias("a"), F.col("draw").alias("mine")), "a").join(
            wish.select(F.col("id").alias("b"), F.col("draw").alias("theirs")), "b").where("theirs > mine")
        moves = wish.join(rival.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        labels = kept.keep(labels.join(moves.select("id", "choice"), "id", "left").select("id", F.coalesce("choice", "label").alias("label")))
    return _smallest_id(labels, "label")


def _smallest_id(labels, column):
    """Name each community after its smallest id."""
    names = labels.groupBy(column).agg(F.min("id").alias("community"))
    return labels.join(side(names, labels), column).select("id", "community")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Weighted modularity of communities (id, community) on the undirected graph."""
    weight = F.coalesce("weight", F.lit(1.0))
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    placed = edges.join(side(a, labels), "src").join(side(b, labels), "dst").select(weight.alias("w"), "ca", "cb")
    per = placed.select(F.inline(F.array(
        F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside"), F.col("w").alias("ends")),
        F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside"), F.col("w").alias("ends")))))
    sums = per.groupBy("c").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))
    row = sums.agg(F.sum("inside").alias("i"), F.sum("ends").alias("e"), F.sum(F.col("ends") * F.col("ends")).alias("q")).first()
    if not row["e"]:
        return 0.0
    return row["i"] / (row["e"] / 2.0) - row["q"] / (row["e"] ** 2)


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities by modularity: local moves until no node gains by one, then contraction, until no node moves at all.

    Each level has fewer nodes than the one before, so there is no other bound. Weights must not be negative. Node tables that are not small meet by shuffles,
    so the rounds send nothing that grows to the driver.
    """
    weight = F.coalesce("weight", F.lit(1.0))
    undirected = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(weight).alias("weight"))
    graph = materialise(undirected, "graph")
    total = graph.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.min("weight").alias("least")).first()
    if (total["least"] or 0.0) < 0.0:
        raise ValueError("weights must not be negative")
    mappings, graphs = Rounds(nodes.sparkSession, "communities"), Rounds(nodes.sparkSession, "graph")
    rounds = {name: Rounds(nodes.sparkSession, name) for name in ("degree", "links", "placed", "wishes")}
    mapping = mappings.keep(nodes.select("id", F.col("id").alias("community")))
    while total["weight"] > 0.0:
        placed, moved = _local_moves(graph, 2.0 * total["weight"], rounds)
        if not moved:
            break
        mapping = mappings.keep(mapping.join(side(placed.select(F.col("id").alias("community"), F.col("community").alias("_new")), placed), "community", "left")
                                .select("id", F.coalesce("_new", "community").alias("community")))
        a = placed.select(F.col("id").alias("src"), F.col("community").alias("ca"))
        b = placed.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
        graph = graphs.keep(graph.join(side(a, placed), "src").join(side(b, placed), "dst").groupBy(
            F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight")))
    return _smallest_id(mapping.withColumnRenamed("community", "label"), "label")


def _local_moves(graph: DataFrame, twice: float, rounds: dict):
    """Communities (id, community) of one level, where no node gains by moving to another one, and whether any node moved.

    Every node starts alone. In a round all nodes that gain wish to move to the community where they gain most; the wishes are put in an
    order drawn anew. A community only takes or only gives nodes in a round, as the first wish at it says. A wish is granted if it
    gains even after all earlier ones at its two communities, their links not counted, which would only add to the gain. So every move that is made
    gains, as if the nodes moved one by one, and the first of all wishes is granted. Earlier ones are summed by ``level``, each
    with half as many wishes as the one before.
    """
    placed = rounds["placed"].keep(endpoints(graph).select("id", F.col("id").alias("community")))
    loops = both_ways(graph, F.col("weight"))
    degree = rounds["degree"].keep(loops.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")).where("k > 0"))
    links = rounds["links"].keep(loops.where("a <> b"))
    for turn in itertools.count():
        strength = placed.join(side(degree), "id").groupBy("community").agg(F.sum("k").alias("total"))
        towards = links.join(side(placed.select(F.col("id").alias("b"), "community"), placed), "b").groupBy(
            F.col("a").alias("id"), "community").agg(F.sum("weight").alias("w"))
        here = placed.select("id", F.col("community").alias("own")).join(side(degree), "id")
        # staying is a candidate too, with no link inside the own community if none is listed
        options = towards.join(side(here, placed), "id").unionByName(
            here.select("id", F.col("own").alias("community"), F.lit(0.0).alias("w"), "own", "k"))
        options = options.groupBy("id", "community", "own", "k").agg(F.sum("w").alias("w")).join(side(strength, placed), "community")
        stays = F.col("community") == F.col("own")
        others = F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)
        scored = options.withColumn("gain", F.round(F.col("w") / F.col("k") - others / twice, 12))
        best = scored.groupBy("id", "own", "k").agg(
            F.min_by("community", F.struct(-F.col("gain"), F.when(stays, 0).otherwise(1), F.col("community"))).alias("choice"),
            (F.max("gain") - F.max(F.when(stays, F.col("gain")))).alias("rise"))
        wish = best.where(F.col("rise") > LEAST_RISE).withColumn("draw", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(DRAWS)))
        wish = rounds["wishes"].keep(wish.withColumn("level", F.floor(F.log2(F.lit(DRAWS) / (F.col("draw") + 1))).cast("int")))
        if wish.isEmpty():
            return placed, turn > 0
        ends = wish.select("id", "k", "draw", "level", F.inline(F.array(
            F.struct(F.col("own").alias("community"), F.lit(False).alias("takes")),
            F.struct(F.col("choice").alias("community"), F.lit(True).alias("takes")))))
        per = ends.groupBy("community", "takes", "level").agg(F.sum("k").alias("k"), F.min(F.struct("draw", "id", "takes")).alias("first"))
        queue = per.select("community", "takes", "level", F.sum("k").over(Window.partitionBy("community", "takes").orderBy(F.desc("level"))).alias("ahead"),
                           F.min("first").over(Window.partitionBy("community")).alias("first"))
        gives = queue.where("not takes and not first.takes").select(
            F.col("community").alias("own"), "level", F.col("ahead").alias("leaving"), F.col("first.id").alias("first_out"))
        takes = queue.where("takes and first.takes").select(
            F.col("community").alias("choice"), "level", F.col("ahead").alias("coming"), F.col("first.id").alias("first_in"))
        earlier = F.when(F.col("first_out") == F.col("id"), 0.0).otherwise(F.col("leaving") - F.col("k")) + \
            F.when(F.col("first_in") == F.col("id"), 0.0).otherwise(F.col("coming") - F.col("k"))
        granted = wish.join(side(gives, placed), ["own", "level"]).join(side(takes, placed), ["choice", "level"]).where(
            F.col("rise") - earlier / twice > LEAST_RISE).select("id", "choice")
        placed = rounds["placed"].keep(placed.join(side(granted, placed), "id", "left").select("id", F.coalesce("choice", "community").alias("community")))


def cluster(nodes: DataFrame, edges: DataFrame, algorithm: str = "louvain") -> DataFrame:
    if algorithm == "louvain":
        return louvain(nodes, edges)
    if algorithm == "label_propagation":
        return label_propagation(nodes, edges)
    raise ValueError(f"unknown clustering algorithm {algorithm!r}")


def central_nodes(nodes: DataFrame, edges: DataFrame, kind: str = "betweenness", k: int = 10) -> DataFrame:
    found = {"betweenness": betweenness, "degree": degree_centrality, "pagerank": pagerank}.get(kind)
    if found is None:
        raise ValueError(f"unknown centrality {kind!r}")
    return top_nodes(found(nodes, edges).select("id", "score"), k)
