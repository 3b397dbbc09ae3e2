"""Reading a store sends no table through the driver, however small its files look."""

from papergraph.sources import store


def test_reading_graphs_broadcasts_nothing(spark, tmp_path, capsys):
    path = str(tmp_path)
    nodes = spark.range(500).selectExpr("id as doc_id", "0L as node_ord", "'a' as kind")
    edges = spark.range(500).selectExpr("id as doc_id", "'x' as target_anchor")
    store.write_graph(nodes, edges, path)
    store.write_graph(nodes.where("doc_id % 2 = 0"), edges.where("doc_id % 2 = 0"), path)
    store.delete_from_graph(nodes.where("doc_id < 10"), path)
    graph = store.read_graph(spark, path)
    for rows, n in ((graph.nodes, 490), (graph.edges, 490), (graph.documents, 490)):
        assert rows.count() == n
        rows.explain()
    assert "Broadcast" not in capsys.readouterr().out
