"""The scopes of many small graphs at once, in the task that the graphs are dealt to.

Rows may belong to several tables of their graph at once, as the bits of ``_is`` say: attributes (``attr_id, parent_attr_id``), nodes (``node_id, attr_id``),
places (``scope_id, node_id, ord`` and more) and edges (``node_id`` to ``to_id``, and to ``to_id_2`` if there is such a column). Any row may list
containers, ``box_ids`` and ``box_parent_ids``. A row costs some microseconds on its way to Python, and each column its part of these.
Graphs that lack an id, list something twice, or contain each other in a circle are left to joins, as are large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stepweave.graph import whole

#: What a row is; then what is true of it, and what is not known to be true or false.
ATTR, NODE, PLACE, EDGE = 1, 2, 4, 8
BOX, GROUPABLE, UNCLEAR, PLAIN, OTHER, USABLE = 16, 32, 64, 128, 256, 512
FATES = pa.array(["stays", "absorbed", "dropped"])
#: Rows worked on at a time, if graphs are small.
GATHERED = 50_000


class Odd(Exception):
    """Graphs (by number) that are left to joins."""


def _whole_numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy().astype(np.int64)


def _valid(column: pa.ChunkedArray) -> np.ndarray:
    return column.is_valid().to_numpy()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal numbers."""
    order = np.argsort(right, kind="stable")
    near = right[order]
    low = np.searchsorted(near, left, "left")
    n = np.searchsorted(near, left, "right") - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(left)), n), order[at]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(sorted_keys) else np.zeros(0, bool)


def _twice(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[1:][keys[1:] == keys[:-1]]


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the smallest one that it reaches over the links ``a``, ``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        for end in (a, b):
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        root = root[root]


def made_at(ids: whole.Ids, attr: np.ndarray, parent: np.ndarray, is_node: np.ndarray, numbered: np.ndarray, node_id: np.ndarray, boxes: np.ndarray,
            up: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Containers without a node that hold something alive: (their rows, depths, new ids, whether a new id is known).

    ``boxes`` marks the rows of containers, ``up`` the closure: nodes and what is above them.
    """
    node, above = up
    with_node = np.unique(attr[is_node])
    alive = above[np.isin(node, with_node) & ids.known(node)]
    top_id = np.full(len(ids.graph_names), np.iinfo(np.int64).min)
    np.maximum.at(top_id, ids.graph[numbered], node_id[numbered])
    with_rows = np.bincount(ids.graph[is_node], minlength=len(top_id)) > 0
    at = np.flatnonzero(boxes & ids.known(attr) & ~np.isin(attr, with_node) & np.isin(attr, alive) & with_rows[ids.graph])
    inner, depth = np.unique(node, return_counts=True)
    place = np.searchsorted(inner, attr[at])
    found = np.append(inner, -1)[place] == attr[at]
    depth = np.where(found, np.append(depth, 0)[place], 0)
    rank = np.empty(len(ids.names), np.int64)
    rank[pc.array_sort_indices(ids.names).to_numpy()] = np.arange(len(ids.names))
    order = np.lexsort((rank[attr[at] % ids.width - 1], -depth, ids.graph[at]))
    at, depth = at[order], depth[order]
    graph = ids.graph[at]
    return at, depth, top_id[graph] + np.arange(len(at)) - np.searchsorted(graph, graph) + 1, top_id[graph] != np.iinfo(np.int64).min


class Scopes:
    """Containers, fates, lists and groups of whole graphs (see ``containers.NormalizedGraph``); nodes and scopes go by number here.

    Numbers of nodes rise with (graph, node id), so the smallest number of some is that of the smallest id.
    """

    def __init__(self, table: pa.Table):
        self.table = table
        ids = self.ids = whole.Ids(table, "attr_id", "parent_attr_id")
        bits = self.bits = table["_is"].to_numpy()
        kind = bits & (ATTR | NODE | PLACE | EDGE)
        is_attr, is_node, is_place = (kind & ATTR) > 0, (kind & NODE) > 0, (kind & PLACE) > 0
        attr, parent, node_id, numbered = ids.of["attr_id"], ids.of["parent_attr_id"], _whole_numbers(table["node_id"]), _valid(table["node_id"])
        ends = [c for c in table.column_names if c.startswith("to_id")]
        with_end = [np.flatnonzero(_valid(table[c]) & ((kind & EDGE) > 0)) for c in ends]
        src, dst = np.concatenate(with_end), np.concatenate([_whole_numbers(table[c])[at] for c, at in zip(ends, with_end)])
        no_end = ((kind & EDGE) > 0) & (~numbered | (node_id < 0))
        no_end |= (kind == EDGE) & ~_valid(table["to_id"])  # an edge that leads nowhere
        no_end[src[dst < 0]] = True
        unclear = ((bits & UNCLEAR) > 0) | ~_valid(table["scope_id"]) | ~_valid(table["ord"])
        self._reject(ids.graph[no_end | ((is_node | is_place) & (~numbered | (node_id < 0))) | ((is_attr | is_node) & ~ids.known(attr)) | (is_place & unclear)])

        boxed = is_attr & ((bits & BOX) > 0)
        held = np.flatnonzero(is_attr & ids.known(parent))
        below, above, dist = ids.closed(attr[held], parent[held])
        self._reject(below[below == above] // ids.width)
        at, _, new, _ = made_at(ids, attr, parent, is_node, is_node, node_id, boxed, (below, above))

        # nodes by number
        nodes, places = np.flatnonzero(is_node), np.flatnonzero(is_place)
        graph = np.concatenate([ids.graph[nodes], ids.graph[at], ids.graph[places], ids.graph[src], ids.graph[src]])
        value = np.concatenate([node_id[nodes], new, node_id[places], node_id[src], dst])
        names, code = (None, value) if not len(value) or (int(value.max()) + 1) * (len(ids.graph_names) + 1) < 2 ** 62 else np.unique(value, return_inverse=True)
        width = int(code.max()) + 1 if len(code) else 1
        keys, number = np.unique(graph * width + code, return_inverse=True)
        self.n, self.graph = len(keys), keys // width
        self.node_id = keys % width if names is None else names[keys % width]
        every, place, src, dst = np.split(number, np.cumsum([len(nodes) + len(at), len(places), len(src)]))
        pair = np.unique(np.concatenate([src * self.n + dst, dst * self.n + src]))
        self.edge = src, dst
        self.near = pair // max(self.n, 1), pair % max(self.n, 1)
        self._reject(self.graph[_twice(every[:len(nodes)])], self.graph[_twice(place)])
        every_attr = attr[np.concatenate([nodes, at])]
        is_owner = np.isin(every_attr, attr[boxed])
        owner, owner_attr = every[is_owner], every_attr[is_owner]
        self.is_box = np.zeros(self.n, bool)
        self.is_box[owner] = True
        h, e = ids.matches(attr[held], every_attr)
        inner = every[e]
        h, o = ids.matches(parent[held][h], owner_attr)
        member, box = whole.distinct_pairs(inner[h], owner[o])
        self._reject(self.graph[_twice(member)])
        self.held = np.full(self.n, -1)
        self.held[member] = box
        i, j = ids.matches(below, owner_attr)
        inner, above, dist = owner[j], above[i], dist[i]
        i, j = ids.matches(above, owner_attr)
        self.inner, self.outer, self.dist = inner[i], owner[j], dist[i]

        # scopes by number
        code, self.scope_names = whole.encoded(table["scope_id"])
        width = len(self.scope_names) + 1
        keys, scope = np.unique(ids.graph[places] * width + code[places], return_inverse=True)
        self.scope_graph, self.scope_name = keys // width, keys % width
        self.rows, self.place, self.scope = places, place, scope
        self.ord = _whole_numbers(table["ord"])[places]
        self.scope_of = np.full(self.n, -1)
        self.scope_of[place] = scope
        self._join_scopes()

    def _reject(self, *graphs: np.ndarray) -> None:
        odd = np.unique(np.concatenate(graphs))
        if len(odd):
            raise Odd(odd)

    def _key(self, scope: np.ndarray, node: np.ndarray) -> np.ndarray:
        return scope * self.n + node

    def _join_scopes(self) -> None:
        """The containers of a scope: those around its nodes, those around these, and those it lists anyway."""
        box = self.held[self.place]
        on = box >= 0
        key, first = self._key(self.scope[on], box[on]), self.ord[on]
        order = np.lexsort((first, key))
        key, first = key[order], first[order]
        on = _starts(key)
        key, first = key[on], first[on]
        i, j = _matches(key % max(self.n, 1), self.inner)
        key = np.concatenate([key, self._key(key[i] // max(self.n, 1), self.outer[j])])
        first, dist = np.concatenate([first, first[i]]), np.concatenate([np.zeros(len(first), np.int64), self.dist[j]])
        order = np.lexsort((dist, first, key))
        order = order[_starts(key[order])]
        key, first, dist = key[order], first[order], dist[order]
        scope, node = key // max(self.n, 1), key % max(self.n, 1)
        on = self.scope_of[node] != scope
        self.joined = scope[on], node[on], first[on], dist[on]
        listed = self.is_box[self.place]
        self.boxes = np.sort(np.concatenate([key[on], self._key(self.scope[listed], self.place[listed])]))

    def _home(self, scope: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The container of the scope that a node is in, or -1."""
        box = self.held[node]
        return np.where((box >= 0) & _among(self._key(scope, box), self.boxes), box, -1)

    @cached_property
    def _is_free(self) -> np.ndarray:
        return self._home(self.scope, self.place) < 0

    def _fates(self, scope: np.ndarray, home: Callable) -> tuple[np.ndarray, ...]:
        """(scope, node, component, fate, container or -1) of nodes that float in a ``scope`` (-1: they do not); see ``grouping.scope_fates``."""
        node, peer = self.near
        on = scope[node] >= 0
        node, peer = node[on], peer[on]
        floats = scope[peer] == scope[node]
        root = smallest_reached(self.n, node[floats], peer[floats])
        node, peer = node[~floats], peer[~floats]
        box, met = home(scope[node], peer), root[node]
        loose, low, high = np.zeros(self.n, bool), np.full(self.n, self.n), np.full(self.n, -1)
        loose[met[box < 0]] = True
        np.minimum.at(low, met[box >= 0], box[box >= 0])
        np.maximum.at(high, met[box >= 0], box[box >= 0])
        node = np.flatnonzero(scope >= 0)
        to = root[node]
        absorbed = ~loose[to] & (low[to] == high[to])
        return scope[node], node, to, np.where(loose[to], 2, np.where(absorbed, 1, 0)), np.where(absorbed, low[to], -1)

    @cached_property
    def first_fates(self) -> tuple[np.ndarray, ...]:
        scope = np.full(self.n, -1)
        on = self._is_free & ~self.is_box[self.place]
        scope[self.place[on]] = self.scope[on]
        return self._fates(scope, self._home)

    @cached_property
    def _inside(self) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Fates in the containers, outer ones first, and the container that each node ends in (or -1)."""
        held = self.held.copy()
        _, node, _, _, to = self.first_fates
        held[node[to >= 0]] = to[to >= 0]
        depth = np.zeros(self.n, np.int64)
        np.maximum.at(depth, self.inner, self.dist)
        is_outer = np.zeros(self.n, bool)
        is_outer[self.outer] = True
        around, parts = np.sort(self._key(self.outer, self.inner)), []
        home = lambda scope, node: np.where((held[node] >= 0) & _among(self._key(scope, held[node]), around), held[node], -1)
        for d in np.unique(depth[is_outer]):
            now = np.append(is_outer & (depth == d), False)  # the last stands for no container
            scope = np.where(now[held] & ~self.is_box, held, -1)
            parts.append(self._fates(scope, home))
            _, node, _, _, to = parts[-1]
            held[node[to >= 0]] = to[to >= 0]
        return parts, held

    # ------------------------------------------------------------ results, as columns

    def _graph(self, numbers: np.ndarray) -> pa.Array:
        return self.ids.graph_names.take(pa.array(numbers))

    def _scope(self, numbers: np.ndarray) -> pa.Array:
        return self.scope_names.take(pa.array(self.scope_name[numbers]))

    def _node(self, numbers: np.ndarray) -> pa.Array:
        return pa.array(np.append(self.node_id, 0)[numbers], mask=numbers < 0)

    def fates(self) -> dict:
        named = self._scope(self.first_fates[0])
        later, _ = self._inside
        boxes = np.concatenate([p[0] for p in later] or [np.zeros(0, np.int64)])
        inner = pc.binary_join_element_wise(pa.scalar("container:"), pc.cast(self._node(boxes), pa.string()), "")
        _, node, to, fate, box = (np.concatenate(c) for c in zip(self.first_fates, *later))
        return {"graph_id": self._graph(self.graph[node]), "scope_id": pa.concat_arrays([named, inner.cast(named.type)]), "node_id": self._node(node),
                "component": self._node(to), "fate": FATES.take(pa.array(fate)), "container_id": self._node(box)}

    def content(self) -> dict:
        held = self._inside[1]
        node = np.flatnonzero(held >= 0)
        return {"graph_id": self._graph(self.graph[node]), "container_id": self._node(held[node]), "node_id": self._node(node)}

    @cached_property
    def _listed(self) -> tuple[np.ndarray, ...]:
        """(scope, node, ord, row of the place or -1, groupable, position in its list), by scope and position."""
        _, node, _, _, to = self.first_fates
        gone = np.zeros(self.n, bool)
        gone[node[to >= 0]] = True
        on = self._is_free & ~gone[self.place]
        scope, node, first, dist = self.joined
        out = self._home(scope, node) < 0
        scope, node, first, dist = scope[out], node[out], first[out], dist[out]
        order = np.lexsort((node, dist, first, scope))
        scope, node = scope[order], node[order]
        last = np.full(len(self.scope_graph), np.iinfo(np.int64).min)
        np.maximum.at(last, self.scope, self.ord)
        groupable, every = (self.bits & GROUPABLE)[self.rows] > 0, np.ones(len(last), bool)
        every[self.scope[~groupable]] = False
        behind = last[scope] + np.arange(len(scope)) - np.searchsorted(scope, scope) + 1
        columns = [np.concatenate(c) for c in ((self.scope[on], scope), (self.place[on], node), (self.ord[on], behind),
                                               (self.rows[on], np.full(len(scope), -1)), (groupable[on], every[scope]))]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        columns = [c[order] for c in columns]
        return *columns, np.arange(len(order)) - np.searchsorted(columns[0], columns[0]) + 1

    def lists(self, carried: list[str]) -> dict:
        scope, node, ord_, row, groupable, place = self._listed
        take = lambda c: _one(self.table[c]).take(pa.array(row, mask=row < 0))
        if_box = lambda c, v: pc.if_else(pa.array(row < 0), pa.scalar(v, self.table[c].type), take(c))
        return {"graph_id": self._graph(self.scope_graph[scope]), "scope_id": self._scope(scope), "node_id": self._node(node), "ord": pa.array(ord_),
                "groupable": pa.array(groupable), "place": pa.array(place), "attr_kind": if_box("attr_kind", "container"),
                "is_native": if_box("is_native", True), **{c: take(c) for c in carried}}

    def groups(self, located: bool) -> dict:
        """Helper groups and call-site runs (``is_run``) of the lists that may be grouped, see ``grouping``."""
        scope, node, ord_, row, groupable, _ = self._listed
        scope, node, ord_, row = scope[groupable], node[groupable], ord_[groupable], row[groupable]
        of = lambda c, none: np.append(c, none)[row]  # noqa: E731 - row -1: a container
        plain = of(np.where(self.bits & PLAIN, 1, np.where(self.bits & OTHER, 0, -1)), 1)
        named, names = whole.encoded(self.table["_helper"])
        named = of(named, -1)

        # helper groups; rows come by scope and position
        key = np.where(named >= 0, scope * (len(names) + 1) + named, -1)
        order = np.flatnonzero(key >= 0)
        order = order[np.lexsort((ord_[order], key[order]))]
        start = np.flatnonzero(_starts(key[order]))
        head, size = order[start], np.diff(np.append(start, len(order)))
        worst = np.minimum.reduceat(np.where(plain[order] < 0, 1, plain[order]), start) if len(start) else np.zeros(0, np.int8)
        known = np.maximum.reduceat(plain[order], start) if len(start) else np.zeros(0, np.int8)
        kept = (worst > 0) & (known > 0)
        head, size = head[kept], size[kept]

        # what is left, with the helpers in their places
        rest = np.flatnonzero(~((key >= 0) & _among(key, np.sort(key[head]))))
        self._reject(self.graph[_twice(node[rest])])  # in two lists
        member = np.full(self.n, -1)
        member[node[rest]] = scope[rest]
        src, dst = self.edge
        on = (member[src] >= 0) & (member[src] == member[dst]) & (src != dst)
        rank = self._ranks(*whole.distinct_pairs(src[on], dst[on]))
        s, at = np.concatenate([scope[rest], scope[head]]), np.concatenate([rest, np.full(len(head), -1)])
        o, p, level = np.concatenate([ord_[rest], ord_[head]]), np.append(plain, 0)[at], np.append(rank[node], 0)[at]
        of_plain, of_other = np.zeros(len(self.scope_graph), bool), np.zeros(len(self.scope_graph), bool)
        of_plain[s[p == 1]] = True
        of_other[s[p == 0]] = True
        level = np.where((of_plain & of_other)[s], level, 0)
        new_id = np.concatenate([self.node_id[node[rest]], -self.node_id[node[head]] - 1])
        order = np.lexsort((new_id, o, level, s))
        s, at, new_id = s[order], at[order], new_id[order]
        place = np.arange(len(s)) - np.searchsorted(s, s) + 1

        # runs of one call site
        file, line = whole.encoded(self.table["_site_file"])[0], self.table["_line"]
        func, func_names = whole.encoded(self.table["_site_func"])
        r = np.append(row, -1)[at]
        usable = np.append((self.bits & USABLE) > 0, False)[r]
        site = (np.append(file, -1)[r] + 1) * (len(func_names) + 1) + np.append(func, -1)[r] + 1
        site = np.where(usable, site, -1)
        first = np.append(True, ~((s[1:] == s[:-1]) & (site[1:] == site[:-1]) & usable[1:]))[:len(s)]
        start = np.flatnonzero(first)
        n = np.diff(np.append(start, len(s)))
        in_scope = np.bincount(s, minlength=len(self.scope_graph))
        good = usable[start] & (n >= 2) & (n < in_scope[s[start]]) if len(start) else np.zeros(0, bool)
        with_line, lines = np.append(_valid(line), False)[r], np.append(_whole_numbers(line), 0)[r]
        top = np.iinfo(np.int64)
        low = np.minimum.reduceat(np.where(with_line, lines, top.max), start)[good] if len(start) else np.zeros(0, np.int64)
        high = np.maximum.reduceat(np.where(with_line, lines, top.min), start)[good] if len(start) else np.zeros(0, np.int64)
        start, n = start[good], n[good]
        f = np.append(func, -1)[r][start]
        nothing = lambda t, m: pa.nulls(m, t)
        taken = lambda c: pa.concat_arrays([_one(self.table[c]).take(pa.array(row[head])), pa.nulls(count, self.table[c].type)])
        both = lambda a, b: pa.concat_arrays([a, b.cast(a.type)])
        owner, count = np.concatenate([scope[head], s[start]]), len(start)
        return {"graph_id": self._graph(self.scope_graph[owner]), "scope_id": self._scope(owner), "is_run": pa.array(np.arange(len(owner)) >= len(head)),
                "name": both(names.take(pa.array(named[head])), func_names.take(pa.array(f, mask=f < 0))), "n_members": pa.array(np.concatenate([size, n])),
                "first_id": pa.array(np.concatenate([self.node_id[node[head]], new_id[start]])), "ord": pa.array(np.concatenate([ord_[head], place[start]])),
                "last_ord": both(nothing(pa.int64(), len(head)), pa.array(place[start] + n - 1)),
                "low": both(nothing(pa.int64(), len(head)), pa.array(low, mask=low == top.max)), "high": both(nothing(pa.int64(), len(head)), pa.array(high, mask=high == top.min)),
                **({"file": taken("_helper_file"), "line": taken("_helper_line")} if located else {})}

    def _ranks(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Longest path that leads to each node; graphs with a cycle are left to joins."""
        rank, most = np.zeros(self.n, np.int64), int(np.bincount(self.graph).max()) if self.n else 0
        on = np.arange(len(src))
        for _ in range(most):
            on = on[rank[dst[on]] <= rank[src[on]]]
            if not len(on):
                return rank
            before = rank.copy()
            np.maximum.at(rank, dst[on], before[src[on]] + 1)
            moved = rank > before
            on = np.flatnonzero(moved[src])
        self._reject(self.graph[dst[on[rank[dst[on]] <= rank[src[on]]]]])
        return rank


def runner(result: Callable[[Scopes], dict], most: int):
    """For ``mapInArrow``: the columns of ``result``, and graphs left over with ``_left``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: list[bool] = []
        for table, left in whole.whole_graphs(_with_graph(batches, lost), most):
            out, odd = _solved(_with_boxes(table), result, most)
            yield from _flagged(out, pa.concat_arrays([left, *odd]))
        if lost:  # rows without a graph
            out, _ = _solved(_with_boxes(pa.Table.from_batches([], schema=lost[0])), result, most)
            yield from _flagged(out, pa.nulls(1, out["graph_id"].type))
    return run


def _with_graph(batches: Iterator[pa.RecordBatch], lost: list) -> Iterator[pa.RecordBatch]:
    """Rows that have a graph, in larger batches; ``lost`` gets the schema if some have none."""
    held, n = [], 0
    for batch in batches:
        if batch.column(batch.schema.get_field_index("graph_id")).null_count:
            lost[:] = [batch.schema]
            batch = batch.filter(pc.is_valid(batch.column(batch.schema.get_field_index("graph_id"))))
        held, n = [*held, batch], n + batch.num_rows
        if n >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _with_boxes(table: pa.Table) -> pa.Table:
    """``table`` with a row for each container that its rows list."""
    if "box_ids" not in table.column_names:
        return table
    listed, above = _one(table["box_ids"]), _one(table["box_parent_ids"])
    at = pc.list_parent_indices(listed)
    boxes = pa.table({"graph_id": _one(table["graph_id"]).take(at), "attr_id": pc.list_flatten(listed), "parent_attr_id": pc.list_flatten(above),
                      "_is": pa.array(np.full(len(at), ATTR | BOX), table["_is"].type)})
    return pa.concat_tables([table.drop_columns(["box_ids", "box_parent_ids"]), boxes], promote_options="default")


def _solved(table: pa.Table, result: Callable[[Scopes], dict], most: int) -> tuple[dict, list[pa.Array]]:
    odd = []
    while True:
        graph, names = whole.graphs(table)
        try:
            many = np.flatnonzero(np.bincount(graph, minlength=len(names)) > most)
            if len(many):
                raise Odd(many)
            return result(Scopes(table)), odd
        except Odd as e:
            odd.append(names.take(pa.array(e.args[0])))
            table = table.filter(pa.array(~np.isin(graph, e.args[0])))


def _flagged(out: dict, left: pa.Array) -> Iterator[pa.RecordBatch]:
    flag = np.arange(len(out["graph_id"]) + len(left)) >= len(out["graph_id"])
    more = lambda c, v: left.cast(v.type) if c == "graph_id" else pa.nulls(len(left), v.type)
    return pa.table({**{c: pa.concat_arrays([v, more(c, v)]) for c, v in out.items()}, "_left": pa.array(flag)}).to_batches()
