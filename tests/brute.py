"""Small in-memory definitions that the distributed operators are checked against."""

from __future__ import annotations

import math
import re

import numpy as np


def tfidf(texts: list[str]) -> np.ndarray:
    docs = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    vocabulary = sorted({w for d in docs for w in d})
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(docs), len(vocabulary)))
    for row, words in enumerate(docs):
        for w in words:
            x[row, at[w]] += 1
    idf = np.log((1 + len(docs)) / (1 + (x > 0).sum(0))) + 1
    x *= idf
    norm = np.linalg.norm(x, axis=1)
    norm[norm == 0] = 1
    return x / norm[:, None]


def distances(x: np.ndarray) -> np.ndarray:
    g = x @ x.T
    sq = np.diag(g)
    d = np.sqrt(np.maximum(0, sq[:, None] + sq[None, :] - 2 * g))
    d[d < 1e-7] = 0
    np.fill_diagonal(d, 0)
    return d


def partition(labels) -> set[frozenset[int]]:
    groups: dict[int, set[int]] = {}
    for i, label in enumerate(labels):
        if label >= 0:
            groups.setdefault(int(label), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def dbscan(d: np.ndarray, eps: float, min_samples: int) -> list[int]:
    near = d <= eps + 1e-9
    core = near.sum(1) >= min_samples
    labels = [-1] * len(d)
    label = 0
    for i in range(len(d)):
        if not core[i] or labels[i] != -1:
            continue
        queue = [i]
        labels[i] = label
        while queue:
            p = queue.pop()
            for j in np.flatnonzero(near[p]):
                if labels[j] == -1:
                    labels[j] = label
                    if core[j]:
                        queue.append(j)
        label += 1
    return labels


def hdbscan(d: np.ndarray, min_samples: int, min_cluster_size: int) -> list[int]:
    """Condensed tree by explicit recursion over single-linkage merges of the mutual reachability graph."""
    n = len(d)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    owner = {i: i for i in range(n)}

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    node = {i: i for i in range(n)}
    kids, height, members = {}, {}, {i: [i] for i in range(n)}
    fresh = n
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a == b:
            continue
        kids[fresh], height[fresh] = (node[a], node[b]), w
        members[fresh] = members[node[a]] + members[node[b]]
        owner[b] = a
        node[a] = fresh
        fresh += 1
    stable, births, chosen = {}, {}, {}

    def grow(top, birth):
        """(best mass, clusters) of the cluster that starts at ``top``."""
        own, at, inner = 0.0, top, []
        while at >= n:
            lam = 1 / height[at] if height[at] > 0 else math.inf
            a, b = kids[at]
            big = [k for k in (a, b) if len(members[k]) >= min_cluster_size]
            if len(big) == 2 and height[at] > 0:
                own += len(members[at]) * (lam - birth)
                inner = [grow(a, lam), grow(b, lam)]
                break
            if len(big) == 1:
                own += (len(members[at]) - len(members[big[0]])) * (lam - birth)
                at = big[0]
                continue
            own += len(members[at]) * (lam - birth)
            break
        below = sum(m for m, _ in inner)
        if top != fresh - 1 and own >= below:
            return own, [members[top]]
        return max(own, below), [c for _, cs in inner for c in cs]

    _, clusters = grow(fresh - 1, 0.0)
    labels = [-1] * n
    for k, rows in enumerate(sorted(clusters, key=min)):
        for i in rows:
            labels[i] = k
    return labels
