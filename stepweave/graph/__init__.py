"""Tables of model data-flow graphs, all keyed by ``graph_id``.

nodes    graph_id, node_id, ...            members  graph_id, parent_id, child_id, ord
edges    graph_id, src_id, dst_id, ...     scoped   graph_id, scope_id, node_id, ord, ...
"""
