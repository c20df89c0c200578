"""Queries that exercise the operators over the star-schema tables, with SQL that must agree.

The tables hold no source code, so each operator's semantics run on a table of the right shape: events for paths and
as-of joins, the region-nation-customer-order hierarchy as a graph, documents as texts. Parsing is tested by fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars, text
from factloom.operators import aggregates, crypto, exports, graph, joins, rules
from factloom.plans import dsl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dsl(name: str, expression: str, columns: list[str], sql: str) -> None:
    table = dsl.parse(expression).collection

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dsl.query({table: t(spark, sf_dir, table)}, expression).select(*columns)


_dsl("dsl_numeric_and_contains", "orders[o_totalprice>=100000 && o_orderpriority~=urgent]", ["o_orderkey", "o_orderpriority"],
     "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice >= 100000 AND contains(lower(o_orderpriority), 'urgent')")
_dsl("dsl_not_equal_ci", "customer[c_mktsegment!=building]", ["c_custkey", "c_mktsegment"],
     "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) <> 'building'")
_dsl("dsl_nested_json", "events[props.k>=50]", ["event_id"], "SELECT event_id FROM events WHERE (props->>'k')::DOUBLE >= 50")
_dsl("dsl_array_any", "embeddings[embedding>0.35]", ["vec_id"], "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.35)) > 0")
_dsl("dsl_case_insensitive_path", "part[P_BRAND='Brand#13' && p_size<10]", ["p_partkey"], "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13' AND p_size < 10")
_dsl("dsl_range", "lineitem[l_quantity>10 && l_quantity<=12 && l_returnflag=r]", ["l_orderkey", "l_linenumber", "l_partkey"],
     "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 12 AND lower(l_returnflag) = 'r'")

PART_RULES = [(0, "Type", "Contains", "BRASS", "metal"), (1, "Type", "Prefix", "promo", "promotion"), (2, "Type", "Suffix", "tin", "tin"),
              (3, "Brand", "Exact", "brand#11", "first"), (4, "Name", "Regex", "^[a-m]", "early")]


@register("rule_match_modes", """
WITH r(ord, kind, match, pattern) AS (VALUES (0, 'Type', 'Contains', 'brass'), (1, 'Type', 'Prefix', 'promo'), (2, 'Type', 'Suffix', 'tin'),
  (3, 'Brand', 'Exact', 'brand#11'), (4, 'Name', 'Regex', '^[a-m]')),
p AS (SELECT p_partkey, CASE kind WHEN 'Type' THEN p_type WHEN 'Brand' THEN p_brand ELSE p_name END AS v, r.* FROM part CROSS JOIN r)
SELECT p_partkey, ord FROM p WHERE CASE match WHEN 'Contains' THEN contains(lower(v), pattern) WHEN 'Prefix' THEN starts_with(lower(v), pattern)
  WHEN 'Suffix' THEN ends_with(lower(v), pattern) WHEN 'Exact' THEN lower(v) = pattern ELSE regexp_matches(v, pattern) END
""")
def rule_match_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(PART_RULES, "ord int, kind string, match string, pattern string, category string")
    return rules.matched(t(spark, sf_dir, "part"), {"Type": "p_type", "Brand": "p_brand", "Name": "p_name"}, table).select("p_partkey", "ord")


LINE_TOKENS = ("the", "and", "que", "der", "los")


@register("rule_first_match", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, CASE WHEN contains(lower(code), 'the') THEN 'the' WHEN contains(lower(code), 'and') THEN 'and' WHEN contains(lower(code), 'que') THEN 'que'
  WHEN contains(lower(code), 'der') THEN 'der' WHEN contains(lower(code), 'los') THEN 'los' END AS token FROM l
""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(t(spark, sf_dir, "documents"), keep=["doc_id"])
    table = spark.createDataFrame([(i, "Code", "Contains", x, x) for i, x in enumerate(LINE_TOKENS)], "ord int, kind string, match string, pattern string, category string")
    return rules.first_match(rows, ["doc_id", "line"], {"Code": "code"}, table).select("doc_id", "line", F.col("rule.pattern").alias("token"))


@register("lines_explode", """
SELECT doc_id, line, length(code) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS code,
  generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
""")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(t(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", F.col("line").cast("long").alias("line"), F.length("code").cast("long").alias("n"))


@register("secret_literals", r"""
WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '"((?:[A-Za-z0-9+/]{32,}={0,2}|[A-Fa-f0-9]{32,}))"', 1))) AS v FROM documents)
SELECT doc_id, substr(v, 1, 4) || '***' || right(v, 4) AS redacted, 'sha256:' || sha256(v) AS fingerprint FROM v
""")
def secret_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(text.QUOTED_SECRET), F.lit(1))))
    rows = t(spark, sf_dir, "documents").filter(F.contains("text", F.lit('"'))).select("doc_id", found.alias("v"))
    return rows.select("doc_id", scalars.redacted(F.col("v")).alias("redacted"), scalars.fingerprint(F.col("v")).alias("fingerprint"))


@register("url_extract", r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '(?i)https?://[^\s"''<>]+'))) AS found FROM pages""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.explode(text.urls(F.col("url"))).alias("found"))


@register("carry_forward_context", """
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_error FROM events
""")
def carry_forward_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("event_type") == "error", F.col("event_id"))
    return aggregates.carried(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], errors, "last_error").select("event_id", F.coalesce("last_error", F.lit(-1)).alias("last_error"))


@register("asof_backward", """
SELECT p.event_id, coalesce(s.event_id, -1) AS prior_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts
""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    pick = lambda k: e.filter(F.col("event_type") == k).select("event_id", "user_id", "ts")
    return joins.as_of(pick("purchase"), pick("signup"), ["user_id"], "ts", ["event_id"]).select("event_id", F.coalesce("prior_event_id", F.lit(-1)).alias("prior_event_id"))


WINDOWS = [("all", "1990-01-01", "2010-01-01"), ("mid", "1994-01-01", "1997-01-01"), ("y95", "1995-01-01", "1996-01-01"), ("q3", "1995-07-01", "1995-10-01")]


@register("interval_smallest", """
WITH w(name, a, b) AS (VALUES ('all', TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01'), ('mid', TIMESTAMP '1994-01-01', TIMESTAMP '1997-01-01'),
  ('y95', TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01'), ('q3', TIMESTAMP '1995-07-01', TIMESTAMP '1995-10-01'))
SELECT o_orderkey, arg_min(name, epoch(b) - epoch(a)) AS name FROM orders LEFT JOIN w ON o_orderdate >= a AND o_orderdate < b GROUP BY o_orderkey
""")
def interval_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame(WINDOWS, "name string, a string, b string").select("name", F.unix_timestamp(F.to_timestamp("a")).alias("a"), F.unix_timestamp(F.to_timestamp("b")).alias("b"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("at"))
    return joins.smallest_interval(orders, w, [], F.col("at"), "a", "b", "o_orderkey", "name").select("o_orderkey", "name")


@register("band_join", """
SELECT a.l_orderkey, a.l_partkey AS part_a, b.l_partkey AS part_b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND abs(a.l_linenumber - b.l_linenumber) <= 1 AND a.l_partkey < b.l_partkey GROUP BY ALL
""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda n: t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias(f"part_{n}"), F.col("l_linenumber").alias(f"line_{n}"))
    pairs = joins.band(side("a"), side("b"), ["l_orderkey"], "line_a", "line_b", 1).filter("part_a < part_b")
    return pairs.groupBy("l_orderkey", "part_a", "part_b").agg(F.count("*").alias("n"))


@register("first_match_theta", """
SELECT c_custkey, coalesce(arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_totalprice > 200000 OR o_orderstatus = 'F'), -1) AS first_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def first_match_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus", F.col("o_orderkey").alias("first_order"))
    fits = (F.col("o_totalprice") > 200000) | (F.col("o_orderstatus") == "F")
    return joins.first_in_order(t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], fits, "c_custkey", "first_order", ["first_order"]).withColumn("first_order", F.coalesce("first_order", F.lit(-1)))


@register("longest_prefix", """
WITH h AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages),
n AS (SELECT page_id, list_aggregate(list_reverse(string_split(host, '.')), 'string_agg', '.') AS name FROM h),
p(prefix, label) AS (VALUES ('com', 'c'), ('com.example', 'ce'), ('net', 'n'), ('org.example', 'oe'), ('com.example.www', 'cew'))
SELECT n.page_id, arg_max(p.prefix, length(p.prefix)) AS prefix, arg_max(label, length(p.prefix)) AS label FROM n
LEFT JOIN p ON name = p.prefix OR starts_with(name, p.prefix || '.') GROUP BY n.page_id
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    rows = t(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.", -1)), ".").alias("name"))
    table = spark.createDataFrame([("com", "c"), ("com.example", "ce"), ("net", "n"), ("org.example", "oe"), ("com.example.www", "cew")], "prefix string, label string")
    return joins.longest_prefix(rows, "name", table, "prefix", row_id="page_id").select("page_id", "prefix", "label")


@register("lookup_cascade", """
WITH k(key, value) AS (VALUES ('Brand#11', 'b11'), ('Brand#22', 'b22'), ('10', 's10'), ('11', 's11'))
SELECT p_partkey, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 0 WHEN b.value IS NOT NULL THEN 1 ELSE -1 END AS rank
FROM part LEFT JOIN k a ON a.key = p_brand LEFT JOIN k b ON b.key = p_size::VARCHAR
""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("Brand#11", "b11"), ("Brand#22", "b22"), ("10", "s10"), ("11", "s11")], "key string, value string")
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return joins.cascade(rows, "p_partkey", [F.col("p_brand"), F.col("p_size")], table, "key", "value").select("p_partkey", "value", F.coalesce("rank", F.lit(-1)).alias("rank"))


@register("unique_candidate_match", """
WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) < 100 AS t0, abs(s_acctbal - c_acctbal) < 200 AND c_mktsegment = 'BUILDING' AS t1
  FROM supplier JOIN customer ON s_nationkey = c_nationkey),
c AS (SELECT *, sum(t0::INT) OVER (PARTITION BY s_suppkey) AS c0, sum(t1::INT) OVER (PARTITION BY s_suppkey) AS c1 FROM p)
SELECT s_suppkey, c_custkey, CASE WHEN c0 = 1 THEN 0 ELSE 1 END AS tier FROM c WHERE (c0 = 1 AND t0) OR (c0 <> 1 AND c1 = 1 AND t1)
""")
def unique_candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("nation"))
    gap = F.abs(F.col("s_acctbal") - F.col("c_acctbal"))
    return joins.unique_candidate(s, c, ["nation"], [gap < 100, (gap < 200) & (F.col("c_mktsegment") == "BUILDING")], "s_suppkey", "c_custkey")


@register("anti_integrity", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without_match(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), ["doc_id"])


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order -> part, a line's edge as often as it occurs."""
    edge = lambda df, a, pa, b, pb: df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("source_id"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("target_id"))
    parts = [
        edge(t(spark, sf_dir, "nation"), "n_regionkey", "r", "n_nationkey", "n"), edge(t(spark, sf_dir, "customer"), "c_nationkey", "n", "c_custkey", "c"),
        edge(t(spark, sf_dir, "orders"), "o_custkey", "c", "o_orderkey", "o"), edge(t(spark, sf_dir, "lineitem"), "l_orderkey", "o", "l_partkey", "p")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_edges(spark, sf_dir).distinct()


EDGES_SQL = """e AS (SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""


@register("graph_edges", f"WITH {EDGES_SQL} SELECT * FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_edges(spark, sf_dir).withColumns({"kind": F.lit("key"), "label": F.lit(None).cast("string")})
    return graph.distinct_edges(rows, [F.col("source_id")]).select("source_id", "target_id")


@register("dangling_edges", f"""WITH {EDGES_SQL}, n AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 40)
SELECT * FROM e WHERE source_id NOT IN (SELECT id FROM n) OR target_id NOT IN (SELECT id FROM n)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df, prefix, key: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))
    nodes = named(t(spark, sf_dir, "region"), "r", "r_regionkey").unionByName(named(t(spark, sf_dir, "nation"), "n", "n_nationkey")).unionByName(named(t(spark, sf_dir, "customer"), "c", "c_custkey"))
    nodes = nodes.unionByName(named(t(spark, sf_dir, "orders").filter("o_totalprice > 100000"), "o", "o_orderkey")).unionByName(named(t(spark, sf_dir, "part").filter("p_size < 40"), "p", "p_partkey"))
    return joins.dangling_edges(all_edges(spark, sf_dir), nodes).select("source_id", "target_id")


@register("graph_bfs", f"WITH RECURSIVE {EDGES_SQL}, x(id, depth) AS (SELECT 'r0', 0 UNION SELECT target_id, depth + 1 FROM x JOIN e ON source_id = id) SELECT id, min(depth) AS depth FROM x GROUP BY id")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(order_edges(spark, sf_dir), spark.createDataFrame([("r0",)], "id string")).select("id", "depth")


@register("graph_reverse_k", f"""WITH RECURSIVE {EDGES_SQL}, x(id, depth) AS (SELECT 'p1', 0 UNION SELECT source_id, depth + 1 FROM x JOIN e ON target_id = id)
SELECT id, min(depth) AS depth FROM x GROUP BY id ORDER BY depth, id LIMIT 64""")
def graph_reverse_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(graph.reach(order_edges(spark, sf_dir), spark.createDataFrame([("p1",)], "id string"), back=True)).select("id", "depth")


@register("entry_tagging", f"""WITH RECURSIVE {EDGES_SQL}, x(entry_id, id) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT entry_id, target_id FROM x JOIN e ON source_id = id)
SELECT id, string_agg(entry_id, ',' ORDER BY entry_id) AS entries FROM x GROUP BY id""")
def entry_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")).withColumn("entry_id", F.col("id"))
    return graph.entry_tags(order_edges(spark, sf_dir), starts).select("id", F.array_join("entry_ids", ",").alias("entries"))


@register("semi_both_ends", f"WITH {EDGES_SQL}, n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT e.* FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def semi_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    b = t(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return joins.both_ends_among(order_edges(spark, sf_dir), a.unionByName(b)).select("source_id", "target_id")


@register("semi_high_risk", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.among(t(spark, sf_dir, "orders"), "o_custkey", t(spark, sf_dir, "customer").filter("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@register("collect_contributions", """
SELECT 'Brand' || l_partkey % 50 AS purl, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1
""")
def collect_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("Brand"), (F.col("l_partkey") % 50).cast("string")).alias("purl"), F.col("l_orderkey").alias("ord"),
                                               F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"), F.lit("x").alias("evidence"))
    return aggregates.reachability(rows).select("purl", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))


@register("priority_score", """
SELECT o_custkey, CASE WHEN max(s) >= 3 THEN 'High' WHEN max(s) >= 2 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS s FROM orders) GROUP BY o_custkey
""")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = scalars.case(F.col("o_orderpriority"), {"1-URGENT": "SourceRoslynDirect", "2-HIGH": "FrameworkModel", "3-MEDIUM": "LanguageFrontend"}, "Unknown")
    facts = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(evidence).alias("evidence")).withColumn("slice_ids", F.array().cast("array<string>"))
    return aggregates.confidence(facts).select("o_custkey", "confidence")


@register("merge_first_nonblank", """
SELECT c_nationkey, arg_min(c_name, c_custkey) FILTER (WHERE c_custkey % 3 <> 0) AS name, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_custkey % 2 = 0) AS segment,
  bool_and(c_acctbal > -900) AS solvent FROM customer GROUP BY c_nationkey
""")
def merge_first_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") > -900).alias("solvent"))
    return aggregates.merge_first_non_blank(rows, ["c_nationkey"], ["name", "segment"], "c_custkey", ("solvent",))


@register("stats_counts", """
SELECT 'errors' AS name, count(*) FILTER (WHERE event_type = 'error') AS n FROM events UNION ALL SELECT 'large', count(*) FILTER (WHERE o_totalprice > 200000) FROM orders
""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counts({"errors": (t(spark, sf_dir, "events"), F.col("event_type") == "error"), "large": (t(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000)})


@register("surrogate_ids", "SELECT o_orderkey, 'e' || row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.surrogate_ids(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "e").select("o_orderkey", "id")


@register("path_pairs", "SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")
def path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.path_pairs(t(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn")


@register("topk_per_key", "SELECT o_custkey, o_orderkey, n AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 16")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_per_key(t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 16).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@register("topk_global", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


KEYS_SQL = "SELECT DISTINCT coalesce(o_orderstatus, '') || '->' || coalesce(o_orderpriority, '') || ':' || (o_custkey % 700) AS key FROM orders WHERE o_orderkey % 2 = "


@register("slice_diff", f"WITH a AS ({KEYS_SQL}0), b AS ({KEYS_SQL}1) SELECT 'added' AS change, key FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', key FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def slice_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source_category"), F.col("o_orderpriority").alias("sink_category"), (F.col("o_custkey") % 700).cast("string").alias("sink_argument"))
    return aggregates.difference(*[aggregates.slice_keys(rows.filter(F.col("o_orderkey") % 2 == k)) for k in (0, 1)])


@register("union_dedupe", "SELECT key, arg_min(origin, prio) AS origin FROM (SELECT c_name AS key, 'customer' AS origin, 1 AS prio FROM customer UNION ALL SELECT s_name, 'supplier', 2 FROM supplier) GROUP BY key")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.lit("customer").alias("origin"), F.lit(1).alias("prio"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.lit("supplier").alias("origin"), F.lit(2).alias("prio"))
    return aggregates.first_per_key(c.unionByName(s), ["key"], ["prio"]).select("key", "origin")


SLICES_SQL = """s AS (SELECT p.event_id AS sink_id, s.event_id AS source_id, p.user_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts > s.ts)"""


def event_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sign-up before each purchase of a user, as source and sink."""
    e = t(spark, sf_dir, "events")
    pick = lambda k: e.filter(F.col("event_type") == k).select("event_id", "user_id", "ts")
    rows = joins.as_of(pick("purchase"), pick("signup"), ["user_id"], "ts", ["event_id"], strict=True).filter("prior_event_id is not null")
    return rows.select(F.col("event_id").alias("sink_id"), F.col("prior_event_id").alias("source_id"), "user_id")


@register("line_taint", f"WITH {SLICES_SQL} SELECT * FROM s")
def line_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_slices(spark, sf_dir)


CATEGORIES = ["command", "file", "sql", "network", "redirect", "deserialization", "reflection", "rpc", "other"]


@register("weakness_facts", f"""WITH {SLICES_SQL}, c AS (SELECT sink_id, CASE user_id % 9 WHEN 0 THEN 'command' WHEN 1 THEN 'file' WHEN 2 THEN 'sql' WHEN 3 THEN 'network' WHEN 4 THEN 'redirect'
  WHEN 5 THEN 'deserialization' WHEN 6 THEN 'reflection' WHEN 7 THEN 'rpc' ELSE 'other' END AS category FROM s)
SELECT 'ws' || sink_id AS slice_id, CASE category WHEN 'command' THEN 'CommandInjectionCandidate' WHEN 'file' THEN 'PathTraversalOrFileAccessCandidate' WHEN 'sql' THEN 'SqlInjectionCandidate'
  WHEN 'network' THEN 'SsrfCandidate' WHEN 'redirect' THEN 'OpenRedirectCandidate' WHEN 'deserialization' THEN 'UnsafeDeserializationCandidate' WHEN 'reflection' THEN 'UnsafeReflectionCandidate'
  WHEN 'rpc' THEN 'RpcDispatchReachabilityCandidate' ELSE 'DangerousDataFlowCandidate' END AS kind,
  CASE category WHEN 'command' THEN 'CWE-78' WHEN 'file' THEN 'CWE-22' WHEN 'sql' THEN 'CWE-89' WHEN 'network' THEN 'CWE-918' WHEN 'redirect' THEN 'CWE-601' WHEN 'deserialization' THEN 'CWE-502'
  WHEN 'reflection' THEN 'CWE-470' END AS cwe, 'Medium' AS confidence FROM c""")
def weakness_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("user_id") % 9).cast("int"))
    own = event_slices(spark, sf_dir).select(F.concat(F.lit("ws"), F.col("sink_id").cast("string")).alias("slice_id"), F.col("source_id").cast("string").alias("source_id"),
                                             F.col("sink_id").cast("string").alias("sink_id"), F.lit("input").alias("source_category"), category.alias("sink_category"))
    e = t(spark, sf_dir, "events")
    nodes = e.select(F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "signup").alias("is_source"), (F.col("event_type") == "purchase").alias("is_sink"),
                     F.col("event_type").alias("category"), F.col("event_type").alias("name"), F.lit("e").alias("file_name"), F.lit("m").alias("method"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    return graph.weaknesses(own, nodes).select("slice_id", "kind", "cwe", "confidence")


@register("dangerous_facts", f"""WITH {SLICES_SQL} SELECT e.event_id, coalesce(string_agg(s.source_id::VARCHAR, ',' ORDER BY s.source_id::VARCHAR), '') AS slices
FROM (SELECT event_id FROM events WHERE event_type = 'purchase') e LEFT JOIN s ON s.sink_id = e.event_id GROUP BY e.event_id""")
def dangerous_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks = t(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id")
    groups = event_slices(spark, sf_dir).select(F.col("sink_id").alias("event_id"), F.col("source_id").cast("string").alias("s"))
    return joins.members(sinks, groups, "event_id", "s", "ids").select("event_id", F.array_join("ids", ",").alias("slices"))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, n = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    nodes = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label")).unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label")))
    edges = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target_id"), F.lit("has").alias("label"))
    return nodes, edges


NODES_SQL = "n AS (SELECT 'r' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM n)"


@register("export_mermaid", f"""WITH {NODES_SQL} SELECT 'flowchart LR' AS text UNION ALL SELECT '    n' || n || '["' || label || '"]' FROM k
UNION ALL SELECT '    n' || a.n || ' -->|"has"| n' || b.n FROM nation JOIN k a ON a.id = 'r' || n_regionkey JOIN k b ON b.id = 'n' || n_nationkey""")
def export_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.mermaid(*nation_graph(spark, sf_dir)).select("text")


@register("export_graphml", f"""WITH {NODES_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY s, t) AS n FROM (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation))
SELECT '    <node id="' || id || '">' || chr(10) || '      <data key="label">' || label || '</data>' || chr(10) || '    </node>' AS text FROM k
UNION ALL SELECT '    <edge id="e' || n || '" source="' || s || '" target="' || t || '">' || chr(10) || '      <data key="callType">has</data>' || chr(10) || '    </edge>' FROM e
UNION ALL SELECT '  </graph>' || chr(10) || '</graphml>'
UNION ALL SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || string_agg('  <key id="' || k || '" for="' || f || '" attr.name="' || k
  || '" attr.type="' || CASE k WHEN 'external' THEN 'boolean' ELSE 'string' END || '" />' || chr(10), '' ORDER BY o) || '  <graph id="callgraph" edgedefault="directed">'
  FROM (VALUES {', '.join(f"({o}, '{f}', '{k}')" for o, (f, k) in enumerate([*(('node', k) for k in exports.GRAPHML_NODE_KEYS), *(('edge', k) for k in exports.GRAPHML_EDGE_KEYS)]))}) x(o, f, k)""")
def export_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nation_graph(spark, sf_dir)
    return exports.graphml(nodes, edges.withColumnRenamed("label", "callType")).select("text")


@register("cbom_dependencies", """SELECT 'op' || o.o_custkey AS operation_id, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS depends_on
FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def cbom_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = t(spark, sf_dir, "orders").groupBy(F.concat(F.lit("op"), F.col("o_custkey").cast("string")).alias("operation_id")).agg(F.collect_set("o_orderkey").alias("slice_ids"))
    parts = t(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("material_id")).agg(F.collect_set("l_orderkey").alias("slice_ids"))
    return crypto.dependencies(ops, parts).select("operation_id", F.array_join("depends_on", ",").alias("depends_on"))


@register("identifier_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS n FROM documents")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).cast("long").alias("n"))


@register("crypto_classes", """
WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA1' WHEN 2 THEN 'System.Security.Cryptography.TripleDES' WHEN 3 THEN 'AesGcm.Encrypt' WHEN 4 THEN 'RSA' ELSE 'Desk' END AS symbol FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA-1' WHEN 2 THEN '3DES' WHEN 3 THEN 'AES-GCM' ELSE 'RSA' END AS algorithm,
  CASE WHEN p_partkey % 6 < 3 THEN 'weak' WHEN p_partkey % 6 = 3 THEN 'strong' ELSE 'acceptable' END AS strength FROM s WHERE symbol <> 'Desk'
""")
def crypto_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = F.array(*map(F.lit, ["MD5", "SHA1", "System.Security.Cryptography.TripleDES", "AesGcm.Encrypt", "RSA", "Desk"]))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.get(symbols, (F.col("p_partkey") % 6).cast("int")).alias("symbol"), F.lit("").alias("code"))
    return crypto.classify(rows).select("p_partkey", "algorithm", "strength")


@register("package_urls", "SELECT s_suppkey, 'pkg:nuget/' || replace(s_name, '#', '%23') || '@1.' || s_suppkey AS purl FROM supplier")
def package_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").select("s_suppkey", scalars.package_url(F.col("s_name"), F.concat(F.lit("1."), F.col("s_suppkey").cast("string"))).alias("purl"))
