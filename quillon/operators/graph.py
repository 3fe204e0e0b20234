"""Iterative and small-graph operators over edge tables (a, b, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import checkpointed

#: Nodes of one graph that may be solved inside one task.
SMALL_GRAPH = 4096
#: Rounds of shortest paths whose moved vertices stay tables of their own.
ROUNDS_KEPT = 8


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, loops dropped, repeated pairs by their largest weight."""
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = clean.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    return pairs.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(v, label) after ``rounds`` synchronous rounds: the heaviest label of the neighbours and the own one, ties to the lowest.

    All vertices move at once, as tables do; an asynchronous order gives other labels on some graphs.
    """
    both = checkpointed(undirected(edges))
    labels = both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("v").alias("b"), "label"), "b").select(F.col("a").alias("v"), "label", "w")
        heard = heard.unionByName(labels.withColumn("w", F.lit(1e-6)))
        weighed = heard.groupBy("v", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = checkpointed(weighed.groupBy("v").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")))
    return labels


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, distance) from the nearest source over weights >= 0: Bellman-Ford over the vertices that changed, until none does."""
    both = checkpointed(undirected(edges))
    if not both.filter("w < 0").isEmpty():
        raise ValueError("shortest paths need weights >= 0")
    best = moved = checkpointed(sources.select("v").distinct().withColumn("distance", F.lit(0.0)))
    rounds = 0
    while True:
        step = both.join(moved.select(F.col("v").alias("a"), "distance"), "a").groupBy(F.col("b").alias("v")).agg(F.min(F.col("distance") + F.col("w")).alias("reach"))
        # only what is known of the vertices just reached is looked up; the table of all is put together now and then
        known = best.join(step.select("v"), "v", "left_semi").groupBy("v").agg(F.min("distance").alias("distance"))
        closer = F.col("distance").isNull() | (F.col("reach") < F.col("distance") - 1e-12)
        moved = checkpointed(step.join(known, "v", "left").filter(closer).select("v", F.col("reach").alias("distance")))
        rounds += 1
        if moved.isEmpty():
            return best.groupBy("v").agg(F.min("distance").alias("distance"))
        best = best.unionByName(moved)
        if rounds % ROUNDS_KEPT == 0:
            best = checkpointed(best.groupBy("v").agg(F.min("distance").alias("distance")))


def small_paths(edges: DataFrame, graph: str, sources: DataFrame) -> DataFrame:
    """(graph, v, distance, previous) from the nearest of ``sources(graph, v)`` of many small graphs, one task per graph.

    ``previous`` is the neighbour of the smallest id on a shortest path, null at a source.  Vertices that no source reaches
    have no row.  Weights are not negative; a graph of more than SMALL_GRAPH nodes is refused, use ``shortest_paths`` for it.
    """
    kinds = dict(edges.dtypes)

    def solve(key, rows, starts):
        import heapq

        import pandas as pd

        near: dict[int, dict[int, float]] = {}
        for a, b, w in zip(rows["a"], rows["b"], rows["w"]):
            if a != b:
                if w < 0:
                    raise ValueError("shortest paths need weights >= 0")
                near.setdefault(a, {})[b] = max(near.get(a, {}).get(b, 0.0), float(w))
                near.setdefault(b, {})[a] = near[a][b]
        if len(near) > SMALL_GRAPH:
            raise ValueError(f"graph {key[0]} has {len(near)} nodes; at most {SMALL_GRAPH} are solved in one task")
        found, waiting = {}, [(0.0, int(v)) for v in set(starts["v"])]
        heapq.heapify(waiting)
        while waiting:
            d, v = heapq.heappop(waiting)
            if v not in found:
                found[v] = d
                for other, w in near.get(v, {}).items():
                    if other not in found:
                        heapq.heappush(waiting, (d + w, other))
        begun = set(starts["v"])
        back = {v: min((u for u, w in near.get(v, {}).items() if u in found and abs(found[u] + w - d) <= 1e-9 and found[u] < d), default=None) for v, d in found.items() if v not in begun}
        out = pd.DataFrame({graph: [key[0]] * len(found), "v": list(found), "distance": list(found.values()), "previous": [back.get(v) for v in found]})
        return out.astype({"previous": "Int64"})

    starts = sources.select(F.col(graph).alias("_graph"), "v")  # another name, as both sides may come from one table
    both = edges.select(graph, "a", "b", "w").groupBy(graph).cogroup(starts.groupBy("_graph"))
    return both.applyInPandas(solve, f"{graph} {kinds[graph]}, v bigint, distance double, previous bigint")


def small_routes(paths: DataFrame, graph: str, targets: DataFrame) -> DataFrame:
    """(target, place, v): the way back from each of ``targets(graph, v)`` over ``small_paths``, place 0 being the target."""

    def walk(key, rows, ends):
        import pandas as pd

        back, known, out = {int(v): p for v, p in zip(rows["v"], rows["previous"])}, set(rows["v"]), []
        for target in sorted(set(ends["v"]) & known):
            v, place = int(target), 0
            while True:
                out.append((int(target), place, v))
                if pd.isna(back[v]):
                    break
                v, place = int(back[v]), place + 1
        return pd.DataFrame(out, columns=["target", "place", "v"])

    ends = targets.select(F.col(graph).alias("_graph"), "v")
    return paths.groupBy(graph).cogroup(ends.groupBy("_graph")).applyInPandas(walk, "target bigint, place int, v bigint")


def _moved(near: list[dict[int, float]], loops, passes: int = 50):
    """Communities of a graph's nodes after greedy moves to the neighbouring community of most modularity gain."""
    import numpy as np

    degree = np.array([sum(x.values()) for x in near]) + 2 * loops
    twice, own, weight = degree.sum(), np.arange(len(near)), degree.copy()
    for _ in range(passes if twice > 0 else 0):
        moved = False
        for i, links_of in enumerate(near):
            old, links = own[i], {}
            for j, w in links_of.items():
                links[own[j]] = links.get(own[j], 0.0) + w
            weight[old] -= degree[i]
            gain = {c: links.get(c, 0.0) - degree[i] * weight[c] / twice for c in {*links, old}}
            new = min(gain, key=lambda c: (-round(gain[c], 12), c != old, c))
            weight[new] += degree[i]
            own[i] = new
            moved = moved or new != old
        if not moved:
            break
    return own


def modularity_communities(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, v, community) of many small graphs, by modularity: nodes are moved, each community becomes one node of a
    smaller graph, and so on until no level moves any.

    One task per graph; a graph of more than SMALL_GRAPH nodes is refused, use ``label_propagation`` for it.
    """
    kind = dict(edges.dtypes)[graph]

    def solve(rows):
        import numpy as np
        import pandas as pd

        names = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]))
        if len(names) > SMALL_GRAPH:
            raise ValueError(f"graph {rows[graph].iloc[0]} has {len(names)} nodes; at most {SMALL_GRAPH} are solved in one task")
        place = {v: i for i, v in enumerate(names)}
        near: list[dict[int, float]] = [{} for _ in names]
        for a, b, w in zip(rows["a"], rows["b"], rows["w"]):
            i, j = place[a], place[b]
            if i != j and w > 0:
                near[i][j] = near[j][i] = max(near[i].get(j, 0.0), float(w))
        label, loops = np.arange(len(names)), np.zeros(len(names))
        while True:
            own = _moved(near, loops)
            kept, own = np.unique(own, return_inverse=True)
            label = own[label]
            if len(kept) == len(near):
                break
            higher, inside = [{} for _ in kept], np.bincount(own, loops, minlength=len(kept))
            for i, links_of in enumerate(near):
                for j, w in links_of.items():
                    p, q = int(own[i]), int(own[j])
                    if p == q:
                        inside[p] += w / 2
                    else:
                        higher[p][q] = higher[p].get(q, 0.0) + w
            near, loops = higher, inside
        order: dict[int, int] = {}
        for c in label:
            order.setdefault(int(c), len(order))
        return pd.DataFrame({graph: rows[graph].iloc[0], "v": names, "community": [order[int(c)] for c in label]})

    return edges.groupBy(graph).applyInPandas(solve, f"{graph} {kind}, v bigint, community bigint")


def modularity(edges: DataFrame, labels: DataFrame, graph: str) -> DataFrame:
    """(graph, q): the share of weight inside communities less that expected from the degrees; each edge once, w > 0."""
    of = labels.select(graph, "v", "community")
    both = edges.join(of.select(graph, F.col("v").alias("a"), F.col("community").alias("ca")), [graph, "a"]).join(of.select(graph, F.col("v").alias("b"), F.col("community").alias("cb")), [graph, "b"])
    inside = both.groupBy(graph).agg(F.sum("w").alias("_m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("_in"))
    degree = both.select(graph, F.inline(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w")))).groupBy(graph, "c").agg(F.sum("w").alias("_d"))
    squares = degree.groupBy(graph).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"))
    return inside.join(squares, graph).select(graph, (F.col("_in") / F.col("_m") - F.col("_s") / (4 * F.col("_m") * F.col("_m"))).alias("q"))


def routes(edges: DataFrame, sources: DataFrame, targets: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(target, place, v): a shortest path from the nearest source to each target, place 0 being the target.

    Each vertex is reached from the neighbour on a shortest path of the smallest id; all targets are walked back at once,
    a step in each round.  Targets that no source reaches have no path.
    """
    reached = checkpointed(shortest_paths(edges, sources))
    near = undirected(edges).join(reached.select(F.col("v").alias("a"), F.col("distance").alias("before")), "a").join(reached.select(F.col("v").alias("b"), "distance"), "b")
    back = near.filter((F.col("distance") > 0) & (F.abs(F.col("before") + F.col("w") - F.col("distance")) <= slack) & (F.col("before") < F.col("distance")))
    back = checkpointed(back.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("previous")))
    at = checkpointed(targets.select(F.col("v").alias("target"), "v").distinct().join(reached.select("v"), "v", "left_semi").select("target", F.lit(0).alias("place"), "v"))
    found = at
    while True:
        step = at.join(back, "v").select("target", (F.col("place") + 1).alias("place"), F.col("previous").alias("v"))
        at = checkpointed(step)
        if at.isEmpty():
            return found
        found = found.unionByName(at)


def compact(labels: DataFrame, graph: str, node: str, label: str) -> DataFrame:
    """(graph, node, community): labels renumbered from 0 by their smallest node in each graph; nodes without one are left out."""
    from .ordered import first_seen_labels

    names = first_seen_labels(labels, [graph], label, node)
    return labels.join(names, [graph, label]).select(graph, node, F.col("canonical").alias("community"))


def chosen_communities(nodes: DataFrame, edges: DataFrame, graph: str, node: str, published: str, place: str, rounds: int = 8) -> DataFrame:
    """(graph, node, community, source): the best signal each graph has.

    Its published labels if there are three or more; else those of label propagation if they are 3 to 20; else ``place``,
    a number by position.  Nodes without edges are their own in propagation.  Labels are compacted.
    """
    heard = label_propagation(edges, rounds).withColumnRenamed("v", node).withColumnRenamed("label", "_heard")
    all_ = checkpointed(nodes.select(graph, node, published, place).join(heard, node, "left").withColumn("_heard", F.coalesce("_heard", F.col(node))))
    counts = all_.groupBy(graph).agg(F.countDistinct(published).alias("_p"), F.countDistinct("_heard").alias("_h"))
    source = F.when(F.col("_p") >= 3, "graph").when(F.col("_h").between(3, 20), "label-propagation").otherwise("spatial")
    picked = all_.join(counts.select(graph, source.alias("source")), graph)
    label = F.when(F.col("source") == "graph", F.coalesce(F.col(published).cast("bigint"), F.lit(-1))).when(F.col("source") == "spatial", F.col(place).cast("bigint")).otherwise(F.col("_heard"))
    picked = picked.select(graph, node, "source", label.alias("_label"))
    return compact(picked, graph, node, "_label").join(picked.select(graph, node, "source"), [graph, node])


def anchors(members: DataFrame, graph: str, community: str, row: str, col: str, grid: int, spread: float = 2.1) -> DataFrame:
    """(graph, community, x, y): the mean place of a community's patches on [-1, 1], pushed out by ``spread``; the centre if it has none."""
    centre = lambda c: F.avg((F.col(c) + 0.5) / grid * 2 - 1)
    mean = members.groupBy(graph, community).agg(centre(col).alias("_x"), centre(row).alias("_y"))
    gain = F.when(F.hypot("_x", "_y") > 1e-6, F.lit(spread)).otherwise(F.lit(0.0))
    out = lambda c: F.coalesce(F.col(c) * gain, F.lit(0.0))
    return mean.select(graph, community, out("_x").alias("x"), out("_y").alias("y"))


def plurality(members: DataFrame, group: list[str], feature: str) -> DataFrame:
    """(group, feature, n): the most frequent feature of a group if more than one member has it, ties to the smaller; else null."""
    counted = members.groupBy(*group, feature).agg(F.count(F.col(feature)).alias("_n"))
    best = counted.groupBy(*group).agg(F.max(F.struct("_n", (-F.col(feature)).alias("_f"))).alias("_m"))
    return best.select(*group, F.when(F.col("_m._n") > 1, -F.col("_m._f")).alias(feature), F.col("_m._n").alias("n"))
