"""Exports (K1-K12, K15, K16): text rows in order, written by Spark or collected where the output is one small document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import location, mermaid_label, xml_text

#: Names of graph formats and their extensions.
FORMATS = {"mermaid": "mermaid", "mmd": "mermaid", "graphml": "graphml", "graph-ml": "graphml", "gexf": "gexf"}
EXTENSIONS = {"mermaid": ".mmd", "graphml": ".graphml", "gexf": ".gexf"}
GRAPHML_NODE_KEYS = ("label", "kind", "file", "purl", "external")
GRAPHML_EDGE_KEYS = ("callType", "sourcePurl", "targetPurl", "location")


def graph_format(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown graph format: {name}")
    return FORMATS[name.lower()]


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with a number in the order of their ids (a graph that is drawn is small)."""
    return nodes.withColumn("n", F.row_number().over(Window.orderBy("id")))


def mermaid(nodes: DataFrame, edges: DataFrame, shape: Column | None = None) -> DataFrame:
    """K2, K5: (part, ord, text) of a flow chart; edges with an unknown end are left out.

    ``shape``: source, sink or another role, for the brackets of a data-flow node.
    """
    own = numbered(nodes)
    label = F.concat(F.lit('"'), mermaid_label(F.coalesce("label", "id")), F.lit('"'))
    role = shape if shape is not None else F.lit("node")
    box = F.when(role == "source", F.concat(F.lit("(["), label, F.lit("])"))).when(role == "sink", F.concat(F.lit("[["), label, F.lit("]]"))).otherwise(
        F.concat(F.lit("["), label, F.lit("]")))
    head = nodes.sparkSession.createDataFrame([(0, "", "flowchart LR")], "part int, ord string, text string")
    boxes = own.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit("    n"), F.col("n").cast("string"), box).alias("text"))
    end = lambda c, n: own.select(F.col("id").alias(c), F.col("n").alias(n))
    arrows = edges.join(end("source_id", "a"), "source_id").join(end("target_id", "b"), "target_id").select(
        F.lit(2).alias("part"), F.concat_ws("\x1f", "source_id", "target_id", "label").alias("ord"),
        F.concat(F.lit("    n"), F.col("a").cast("string"), F.lit(' -->|"'), mermaid_label(F.coalesce("label", F.lit(""))), F.lit('"| n'), F.col("b").cast("string")).alias("text"))
    return head.unionByName(boxes).unionByName(arrows)


def _data(key: str, value: Column, indent: int = 6) -> Column:
    return F.coalesce(F.concat(F.lit(" " * indent + f'<data key="{key}">'), xml_text(value), F.lit("</data>\n")), F.lit("")) if key else F.lit("")


def graphml(nodes: DataFrame, edges: DataFrame, node_keys: tuple[str, ...] = GRAPHML_NODE_KEYS, edge_keys: tuple[str, ...] = GRAPHML_EDGE_KEYS, graph_id: str = "callgraph") -> DataFrame:
    """K3, K6: (part, ord, text) of a GraphML document; null values are left out, edges aren't filtered."""
    spark = nodes.sparkSession
    keys = "".join(f'  <key id="{k}" for="{kind}" attr.name="{k}" attr.type="{"boolean" if k == "external" else "string"}" />\n' for kind, names in (("node", node_keys), ("edge", edge_keys)) for k in names)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}  <graph id="{graph_id}" edgedefault="directed">'
    frame = spark.createDataFrame([(0, "", head), (3, "", "  </graph>\n</graphml>")], "part int, ord string, text string")
    optional = lambda k, df: F.when(F.col(k).isNotNull(), _data(k, F.col(k).cast("string"))).otherwise(F.lit("")) if k in df.columns else F.lit("")
    body = lambda names, df: F.concat(F.lit(""), *[optional(k, df) for k in names])
    node = F.concat(F.lit('    <node id="'), xml_text(F.col("id")), F.lit('">\n'), body(node_keys, nodes), F.lit("    </node>"))
    ranked = edges.withColumn("_n", F.row_number().over(Window.orderBy("source_id", "target_id", *[k for k in edge_keys if k in edges.columns])))
    edge = F.concat(F.lit('    <edge id="e'), F.col("_n").cast("string"), F.lit('" source="'), xml_text(F.col("source_id")), F.lit('" target="'), xml_text(F.col("target_id")),
                    F.lit('">\n'), body(edge_keys, edges), F.lit("    </edge>"))
    rows = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), node.alias("text"))
    return frame.unionByName(rows).unionByName(ranked.select(F.lit(2).alias("part"), F.format_string("%012d", "_n").alias("ord"), edge.alias("text")))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K4, K7: (part, ord, text) of a GEXF 1.3 document."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n  <graph mode="static" defaultedgetype="directed">\n    <nodes>'
    frame = spark.createDataFrame([(0, "", head), (2, "", "    </nodes>\n    <edges>"), (4, "", "    </edges>\n  </graph>\n</gexf>")], "part int, ord string, text string")
    node = F.concat(F.lit('      <node id="'), xml_text(F.col("id")), F.lit('" label="'), xml_text(F.coalesce("label", "id")), F.lit('" />'))
    ranked = edges.withColumn("_n", F.row_number().over(Window.orderBy("source_id", "target_id", "label")))
    edge = F.concat(F.lit('      <edge id="e'), F.col("_n").cast("string"), F.lit('" source="'), xml_text(F.col("source_id")), F.lit('" target="'), xml_text(F.col("target_id")),
                    F.lit('" label="'), xml_text(F.col("label")), F.lit('" />'))
    rows = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), node.alias("text"))
    return frame.unionByName(rows).unionByName(ranked.select(F.lit(3).alias("part"), F.format_string("%012d", "_n").alias("ord"), edge.alias("text")))


def document(rows: DataFrame) -> str:
    """A graph's text on the driver: graphs are exported to be drawn."""
    return "\n".join(r.text for r in rows.orderBy("part", "ord").toLocalIterator()) + "\n"


def json_document(tables: dict[str, DataFrame], keep_nulls: bool = False) -> DataFrame:
    """One row with all tables as lists; for documents that one task can hold."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    out = None
    for name, df in tables.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), options).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    joined = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("name"), F.lit('":'), F.col("rows")))), ",")
    return out.agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("json"))


def crypto_bom(assets: DataFrame) -> DataFrame:
    """K8: a component row per asset; blank properties are dropped."""
    names = [c for c in assets.columns if c not in ("id", "algorithm")]
    properties = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names]), lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != "")
    return assets.select("id", F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), F.col("id").alias("bom-ref"), F.col("algorithm").alias("name"), properties.alias("properties"))).alias("component"))


def traces(slices: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slice_id, pos, frame, via): each path's nodes and the edge label to the next; unknown nodes are named so."""
    w = Window.partitionBy("slice_id").orderBy("pos")
    long = slices.select("slice_id", F.posexplode("node_ids").alias("pos", "id")).withColumn("_next", F.lead("id").over(w))
    out = long.join(nodes.select("id", "name", "file_name", "line", "column"), "id", "left").join(
        edges.groupBy(F.col("source_id").alias("id"), F.col("target_id").alias("_next")).agg(F.min("label").alias("via")), ["id", "_next"], "left")
    frame = F.when(F.col("name").isNull(), "<missing node>").otherwise(F.concat_ws(" ", "name", location(F.col("file_name"), F.col("line"), F.col("column"))))
    return out.select("slice_id", "pos", frame.alias("frame"), "via")


def source_sink_rows(nodes: DataFrame) -> DataFrame:
    """Tab-separated rows of sources and sinks."""
    rows = nodes.filter("is_source").select(F.lit("SOURCE").alias("role"), "*").unionByName(nodes.filter("is_sink").select(F.lit("SINK").alias("role"), "*"))
    return rows.select("role", "id", F.concat_ws("\t", "role", "category", "name", location(F.col("file_name"), F.col("line"), F.col("column"))).alias("text"))


def markdown(statistics: dict[str, int], weaknesses: DataFrame, most: int = 50) -> str:
    """A report with the counts and the first weaknesses; the limit is the report's."""
    out = ["# Analysis Report", "", *[f"- {k}: {v}" for k, v in statistics.items()], "", "## High-priority weakness candidates", ""]
    for r in weaknesses.orderBy("slice_id").limit(most).collect():
        out += [f"### {r.slice_id}: {r.kind}", "", f"- Confidence: {r.confidence}", *([f"- CWE: {r.cwe}"] if r.cwe else []), f"- Source: {r.source_location}", f"- Sink: {r.sink_location}", ""]
    return "\n".join(out)


def agent_context(weaknesses: DataFrame, entries: DataFrame, packages: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Bounded excerpts in order; the limits are the bundle's."""
    from factloom.operators.rules import high_risk

    risky = weaknesses.filter(high_risk(F.col("confidence"), F.col("sink_category"))).orderBy("slice_id").limit(25)
    return {
        "highRiskWeaknesses": risky, "highRiskSlices": risky.select("slice_id").distinct().limit(25), "entryPoints": entries.orderBy("ord").limit(50),
        "reachablePackages": packages.orderBy("purl").limit(50), "relevantFiles": nodes.select("file_name").distinct().orderBy("file_name").limit(100)}
