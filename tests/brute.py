"""Slow, plain versions of the graph operators for tiny inputs."""

from __future__ import annotations

import numpy as np


def distance_matrix(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)


def nearest(d, k):
    n = len(d)
    return {i: [j for _, j in sorted((d[i, j], j) for j in range(n) if j != i)[:k]] for i in range(n)}


def reachability(d, ms):
    core = np.array([sorted(np.delete(d[i], i))[ms - 1] for i in range(len(d))])
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    np.fill_diagonal(m, 0)
    return m


def kruskal(edges):
    """Spanning forest of (w, u, v) by sorted union."""
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    out = []
    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            out.append((w, u, v))
    return out


def merge_list(edges):
    """{edge: (parent edge or None, size)} and {node: first edge} of a forest's (w, u, v), merged one by one."""
    part, size, made, tree, least = {}, {}, {}, {}, {}
    for e in sorted(edges):
        _, u, v = e
        for x in (u, v):
            least.setdefault(x, e)
            part.setdefault(x, x)
            size.setdefault(x, 1)
        a, b = part[u], part[v]
        for side in (a, b):
            if side in made:
                tree[made[side]] = (e, tree[made[side]][1])
        size[a] += size.pop(b)
        part = {x: a if c == b else c for x, c in part.items()}
        made.pop(b, None)
        made[a] = e
        tree[e] = (None, size[a])
    return tree, least


def merge_tree_clusters(tree, n, mcs, selection):
    """Clusters from the full merge tree, one edge at a time; −1 is noise."""
    comp = {i: i for i in range(n)}
    members = {i: [i] for i in range(n)}
    node = {}  # component -> cluster-tree node
    nodes = []  # dict(points: {id: weight at which it leaves}, kids, birth)
    for w, u, v in sorted(tree):
        a, b = comp[u], comp[v]
        big_a, big_b = a in node, b in node
        both = members[a] + members[b]
        if big_a and big_b:
            for side in (node[a], node[b]):
                nodes[side]["birth"] = w
            nodes.append({"points": {p: w for p in both}, "kids": [node[a], node[b]], "birth": None})
            node[a] = len(nodes) - 1
        elif big_a or big_b:
            owner = node[a] if big_a else node.pop(b)
            for p in members[b] if big_a else members[a]:
                nodes[owner]["points"][p] = w
            node[a] = owner
        elif len(both) >= mcs:
            nodes.append({"points": {p: w for p in both}, "kids": [], "birth": None})
            node[a] = len(nodes) - 1
        node.pop(b, None)
        for p in members[b]:
            comp[p] = a
        members[a] = both
        del members[b]
    roots = set(node.values())
    chosen = set()
    if selection == "leaf":
        chosen = {i for i, c in enumerate(nodes) if not c["kids"] and i not in roots}
    else:
        best = {}
        for i, c in enumerate(nodes):  # children come first
            if i in roots:
                continue
            own = sum(1 / max(w, 1e-12) - 1 / c["birth"] for w in c["points"].values())
            kids = sum(best[k] for k in c["kids"])
            best[i] = max(own, kids)
            if own >= kids:
                stack = list(c["kids"])
                while stack:
                    k = stack.pop()
                    chosen.discard(k)
                    stack += nodes[k]["kids"]
                chosen.add(i)
    labels = np.full(n, -1)
    for i in chosen:
        for p in nodes[i]["points"]:
            labels[p] = i
    order = {}
    for i in range(n):
        if labels[i] >= 0:
            order.setdefault(labels[i], len(order))
    return np.array([order.get(x, -1) for x in labels])


def dbcv(x, labels):
    keep = labels >= 0
    x, labels = x[keep], labels[keep]
    dim, total = x.shape[1], len(x)
    info = {}
    for c in sorted(set(labels)):
        p = x[labels == c]
        d = distance_matrix(p)
        inv = np.zeros_like(d)
        inv[d > 0] = (1 / d[d > 0]) ** dim
        s = inv.sum(1) / (len(p) - 1)
        core = np.where(s > 0, np.where(s > 0, s, 1) ** (-1 / dim), 0)
        m = np.maximum(np.maximum(core[:, None], core[None]), d)
        tree = kruskal([(m[i, j], i, j) for i in range(len(p)) for j in range(i + 1, len(p))])
        deg = np.bincount([e for _, u, v in tree for e in (u, v)], minlength=len(p))
        inner = np.flatnonzero(deg > 1)
        if not len(inner):
            inner = np.array([0])
        edges = [w for w, u, v in tree if u in inner and v in inner] or [w for w, _, _ in tree]
        info[c] = (p[inner], core[inner], max(edges), len(p))
    out = 0.0
    for c, (p, core, sparse, n) in info.items():
        sep = min(
            np.maximum(np.maximum(core[:, None], oc[None]), np.sqrt(((p[:, None] - op[None]) ** 2).sum(2))).min()
            for o, (op, oc, _, _) in info.items()
            if o != c
        )
        out += n / total * (sep - sparse) / max(sep, sparse)
    return out


def is_greedy_merge(leader, cents, threshold):
    """A leader has no smaller linked leader; every other id goes to its smallest linked leader."""
    ids = np.array(sorted(cents))
    x = np.array([cents[i] for i in ids])
    linked = x @ x.T >= threshold
    leads = np.array([leader[i] == i for i in ids])
    smaller = np.tril(linked, -1) & leads[None, :]
    if (smaller.any(1) == leads).any():
        return False
    return all(leads[k] or leader[i] == ids[smaller[k].argmax()] for k, i in enumerate(ids))
