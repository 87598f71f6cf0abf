"""An M-tree over integer vectors: paged metric nodes with covering radii and parent distances.

Largest inner products are nearest neighbours once every vector x has one more component,
sqrt(top - |x|^2), and the query 0 there: all vectors then have the length sqrt(top), and the squared
distance of a query q is |q|^2 + top - 2 q.x. The tree knows that metric only; scores stay exact
integers in double precision, and bounds have a margin for rounding, so that no tie is lost.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Entries of a leaf, and children of a node, at most.
PAGE, FANOUT = 512, 64
#: Sums of products below it are exact in double precision.
EXACT = float(1 << 53)


@dataclass
class Node:
    """A page: entries are vectors (leaf) or the centres of the nodes in children."""

    vectors: np.ndarray
    #: Distance of each entry to the centre of this node.
    parent: np.ndarray
    #: Covering radius of each child; empty in a leaf.
    radii: np.ndarray
    children: np.ndarray
    #: Ids of the entries of a leaf.
    ids: np.ndarray


@dataclass
class Tree:
    """Nodes in order of making, the root first. top: the largest squared length of all vectors, everywhere."""

    top: float
    centre: np.ndarray
    radius: float
    nodes: list[Node] = field(default_factory=list)


def lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """The further component that gives all vectors one length."""
    return np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vectors, vectors), 0.0))


def distances(vectors: np.ndarray, lifts: np.ndarray, centre: np.ndarray, centre_lift: float) -> np.ndarray:
    difference = vectors - centre
    return np.sqrt(np.einsum("ij,ij->i", difference, difference) + (lifts - centre_lift) ** 2)


def build(ids: np.ndarray, vectors: np.ndarray, top: float) -> Tree:
    """Bulk loading from the top: a node's entries go to the nearest of up to FANOUT centres among them."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    lifts = lift(vectors, top)
    tree = Tree(top, vectors[0], 0.0)

    def node(own: np.ndarray, centre: int) -> int:
        """Make the node of these rows; its place in the list."""
        place = len(tree.nodes)
        far = distances(vectors[own], lifts[own], vectors[centre], lifts[centre])
        tree.nodes.append(None)
        none = np.zeros(0, np.int64)
        if len(own) <= PAGE:
            tree.nodes[place] = Node(vectors[own], far, np.zeros(0), none, ids[own])
            return place
        centres = own[np.linspace(0, len(own) - 1, min(FANOUT, -(-len(own) // PAGE))).astype(np.int64)]
        kept = np.sort(np.unique(np.column_stack([vectors[centres], lifts[centres]]), axis=0, return_index=True)[1])
        centres = centres[kept]
        if len(centres) == 1:  # equal vectors, or nearly so: by id
            parts = np.array_split(own, min(FANOUT, -(-len(own) // PAGE)))
            centres = np.repeat(centres, len(parts))
        else:
            nearest = np.full(len(own), np.inf)
            part = np.zeros(len(own), np.int64)
            for k, c in enumerate(centres):
                to = distances(vectors[own], lifts[own], vectors[c], lifts[c])
                part[to < nearest] = k
                np.minimum(nearest, to, out=nearest)
            parts = [own[part == k] for k in range(len(centres))]
            held = [k for k, p in enumerate(parts) if len(p)]
            parts, centres = [parts[k] for k in held], centres[held]
        radii = [float(distances(vectors[p], lifts[p], vectors[c], lifts[c]).max()) for p, c in zip(parts, centres)]
        to_parent = distances(vectors[centres], lifts[centres], vectors[centre], lifts[centre])
        children = [node(p, c) for p, c in zip(parts, centres)]
        tree.nodes[place] = Node(vectors[centres], to_parent, np.array(radii), np.array(children, np.int64), none)
        return place

    node(np.arange(len(ids)), 0)
    tree.radius = float(distances(vectors, lifts, vectors[0], lifts[0]).max())
    return tree


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers: in double precision where all sums stay exact, else one by one."""
    if exact:
        return vectors @ query
    whole = [int(v) for v in query]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in vectors], object)


@dataclass
class Found:
    """The best of a search, and how many distances it took (of them, the leaf entries)."""

    scores: list[int]
    ids: list[int]
    computed: int


def search(tree: Tree, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> Found:
    """Best-first: the k best (score, id) other than id own; ties go to the smaller id.

    floor: k others are known with this score or more elsewhere; what is below it is left out.
    Nodes wait in a heap by the least distance that their radius allows; an entry whose distance
    to its node's centre shows that it is too far is passed over without computing its own.
    """
    length = float(query @ query)
    base = length + tree.top
    exact = tree.top < EXACT and length < EXACT
    margin = 1e-7 * np.sqrt(base + 1.0)
    best_scores, best_ids = np.zeros(0, object), np.zeros(0, np.int64)
    least = floor

    def reach() -> float:
        """Distance beyond which nothing counts."""
        return np.inf if least == -np.inf else float(np.sqrt(max(base - 2.0 * float(least), 0.0))) + margin

    def to(vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(base - 2.0 * (vectors @ query), 0.0))

    start = float(to(tree.centre[None])[0])
    heap = [(max(start - tree.radius, 0.0), 0, start)]
    limit, computed = reach(), 1
    while heap:
        bound, place, middle = heapq.heappop(heap)
        if bound > limit:
            break
        node = tree.nodes[place]
        gap = np.abs(middle - node.parent)
        if len(node.children):
            near = np.flatnonzero(gap - node.radii <= limit)
            if not len(near):
                continue
            far = to(node.vectors[near])
            computed += len(near)
            for d, child, low in zip(far.tolist(), node.children[near].tolist(), (far - node.radii[near]).tolist()):
                if low <= limit:
                    heapq.heappush(heap, (max(low, 0.0), child, d))
            continue
        near = (gap <= limit) & (node.ids != own)
        taken = np.count_nonzero(near)
        if not taken:
            continue
        # copying most of a page costs more than computing the few entries that could be passed over
        whole = taken * 4 > 3 * len(near)
        scores = products(node.vectors if whole else node.vectors[near], query, exact)
        computed += len(scores)
        held = near if whole else np.ones(taken, bool)
        if least != -np.inf:
            held = held & (scores >= least)
            if not held.any():
                continue
        best_scores = np.concatenate([best_scores, scores[held].astype(object)])
        best_ids = np.concatenate([best_ids, (node.ids if whole else node.ids[near])[held]])
        order = sorted(range(len(best_ids)), key=lambda i: (-best_scores[i], best_ids[i]))[:k]
        best_scores, best_ids = best_scores[order], best_ids[order]
        if len(best_ids) == k and best_scores[-1] > least:
            least = best_scores[-1]
            limit = reach()
    return Found([int(s) for s in best_scores], best_ids.tolist(), computed)
