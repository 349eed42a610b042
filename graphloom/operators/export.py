"""Bounded subgraphs as Cytoscape and D3 JSON, Mermaid, GraphML and one HTML page."""

from __future__ import annotations

import colorsys
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.build import Graph
from graphloom.operators.similar import neighborhood


def colour(text: str) -> str:
    """A stable colour for a name."""
    h = 0
    for ch in text:
        h = (31 * h + ord(ch)) % 2**32
    r, g, b = colorsys.hls_to_rgb(h % 360 / 360, 0.55, 0.6)
    return f"#{round(r * 255):02x}{round(g * 255):02x}{round(b * 255):02x}"


def subgraph(g: Graph, max_nodes: int = 300, focus: str | None = None, hops: int = 2, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around `focus`, or the records of highest degree with their neighbours: records first, then by degree and order."""
    degree = g.adjacency().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = g.nodes.join(degree, "id", "left").fillna(0, ["degree"])
    if focus:
        chosen = nodes.join(neighborhood(g, focus, hops), "id")
    else:
        top = nodes.filter("is_record").orderBy(F.desc("degree"), "ord").limit(max(1, max_nodes // 2)).select("id")
        ids = top.unionByName(g.adjacency().join(top, F.col("src") == top.id, "left_semi").select(F.col("dst").alias("id"))).distinct()
        chosen = nodes.join(ids, "id", "left_semi")
    if types:
        chosen = chosen.filter(F.col("type").isin(types) | F.col("is_record"))
    kept = chosen.orderBy(F.desc("is_record"), F.desc("degree"), "ord", "id").limit(max_nodes).select("id", "type", "label", "degree", "is_record")
    e = g.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, e.select("src", "dst", "etype", "weight")


def top_degree(g: Graph, k: int = 10) -> DataFrame:
    degree = g.adjacency().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    d = g.nodes.filter("is_record").join(degree, "id").orderBy(F.desc("degree"), "ord").limit(k)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "ord"))).select("id", "degree", "rank")


def to_cytoscape(g: Graph, **options) -> dict:
    nodes, edges = subgraph(g, **options)
    n = [{"data": r.asDict() | {"color": colour(r["type"])}} for r in nodes.orderBy("id").collect()]
    e = [{"data": {"source": r["src"], "target": r["dst"], "type": r["etype"], "weight": r["weight"]}} for r in edges.orderBy("src", "dst", "etype").collect()]
    kinds = sorted({x["data"]["type"] for x in n})
    return {"elements": {"nodes": n, "edges": e}, "metadata": {"node_count": len(n), "edge_count": len(e)}, "legend": [{"type": k, "color": colour(k)} for k in kinds]}


def to_d3(g: Graph, **options) -> dict:
    c = to_cytoscape(g, **options)
    return {"nodes": [x["data"] for x in c["elements"]["nodes"]], "links": [x["data"] for x in c["elements"]["edges"]]}


def to_mermaid(g: Graph, **options) -> str:
    d = to_d3(g, **options)
    ids = {x["id"]: f"n{i}" for i, x in enumerate(d["nodes"])}
    lines = ["flowchart LR", *(f'  {ids[x["id"]]}["{x["label"]}"]:::{x["type"]}' for x in d["nodes"]), *(f'  {ids[x["source"]]} -->|{x["type"]}| {ids[x["target"]]}' for x in d["links"])]
    return "\n".join([*lines, *(f"  classDef {k} fill:{colour(k)}" for k in sorted({x["type"] for x in d["nodes"]}))])


def to_graphml(g: Graph, **options) -> str:
    d = to_d3(g, **options)
    n = "".join(f"<node id={quoteattr(x['id'])}><data key=\"label\">{escape(x['label'] or '')}</data><data key=\"type\">{escape(x['type'])}</data></node>" for x in d["nodes"])
    e = "".join(f"<edge source={quoteattr(x['source'])} target={quoteattr(x['target'])}><data key=\"etype\">{escape(x['type'])}</data></edge>" for x in d["links"])
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("label", "node"), ("type", "node"), ("etype", "edge")))
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">{n}{e}</graph></graphml>'


def to_html(g: Graph, title: str = "graph", **options) -> str:
    data = json.dumps(to_d3(g, **options)).replace("</", "<\\/")
    script = "const d=JSON.parse(document.getElementById('d').textContent);document.getElementById('n').innerHTML=d.nodes.map(n=>`<li style=\"color:${n.color}\">${n.label} (${n.degree})</li>`).join('')"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><ul id=n></ul><script id=d type=application/json>{data}</script><script>{script}</script>"


class KnowledgeGraph:
    """A graph with its exports as methods."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def to_cytoscape(self, **options) -> dict:
        return to_cytoscape(self.graph, **options)

    def to_d3_json(self, **options) -> str:
        return json.dumps(to_d3(self.graph, **options))

    def to_mermaid(self, **options) -> str:
        return to_mermaid(self.graph, **options)

    def to_graphml(self, **options) -> str:
        return to_graphml(self.graph, **options)

    def render_html(self, path: str | None = None, **options) -> str:
        page = to_html(self.graph, **options)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(page)
        return page
