"""The engine's operators over relational tables, each with SQL that gives the same rows.

Orders that use parts through line items stand for files that import files, nations in regions for files in domains,
documents and pages for bodies, events for change logs, conversations for ordered steps, benchmark items for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bounds, certify, delta, joins, traverse
from ..schema import RISKS, name_of
from ..session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return registered


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- lookup and extraction


@query("""
WITH hit AS (SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND p_size = 7), lim AS (
  SELECT *, row_number() OVER (ORDER BY p_partkey) AS position, count(*) OVER () AS observed FROM hit)
SELECT p_partkey, p_name, position::INT AS position, observed, least(observed, 4) AS shown, observed - least(observed, 4) AS hidden, count(l_partkey) AS uses
FROM lim LEFT JOIN lineitem ON l_partkey = p_partkey WHERE position <= 4 GROUP BY ALL
""")
def q_where_exact(spark, d):
    """Exact lookup: bounded before anything is joined."""
    t = Tables(spark, d)
    hit = t.part.filter("p_brand = 'Brand#13' AND p_size = 7").select("p_partkey", "p_name").withColumn("g", F.lit(1))
    some = bounds.top_k(hit, ["g"], [F.col("p_partkey")], 4).drop("g")
    uses = t.lineitem.join(F.broadcast(some.select("p_partkey")), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey").count()
    return some.join(uses, some["p_partkey"] == uses["l_partkey"], "left").select("p_partkey", "p_name", "position", "observed", "shown", "hidden", F.coalesce("count", F.lit(0)).alias("uses"))


@query("""
SELECT lower(p_type) AS name, min(p_partkey) AS first_key, count(*) AS n FROM part WHERE contains(lower(p_type), 'a') GROUP BY 1 ORDER BY 1 LIMIT 10
""")
def q_where_suggest(spark, d):
    """Suggestions for a name that is not there: those that contain it, first ten by name."""
    t = Tables(spark, d)
    return t.part.filter(F.lower("p_type").contains("a")).groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n")).orderBy("name").limit(10)


@query("""
SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::INT AS line_count, n_chars FROM documents
""")
def q_content_hash(spark, d):
    """Content hash and line count of each body."""
    return Tables(spark, d).documents.select("doc_id", T.short_hash(F.col("text")).alias("content_hash"), T.line_count(F.col("text")).alias("line_count"), "n_chars")


@query("""
SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def q_exact_duplicates(spark, d):
    """Bodies that occur more than once, by hash."""
    return Tables(spark, d).documents.groupBy(T.short_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query(r"""
SELECT page_id, len(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(url, '[/\-_.]', ' ', 'g')), '[^a-z0-9_]+'), lambda x: length(x) >= 2)))::INT AS n_tokens,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(url, '[/\-_.]', ' ', 'g')), '[^a-z0-9_]+'), lambda x: length(x) >= 2))), ' ') AS tokens FROM pages
""")
def q_path_tokens(spark, d):
    """Tokens of a path."""
    tokens = T.path_tokens(F.col("url"))
    return Tables(spark, d).pages.select("page_id", F.size(tokens).alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("""
SELECT token, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents) GROUP BY 1
""")
def q_identifier_refs(spark, d):
    """In how many bodies each identifier occurs."""
    return Tables(spark, d).documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("documents"))


@query("""
SELECT doc_id, min(i)::INT AS first_line, count(*) AS n FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(line, 'the ') GROUP BY 1
""")
def q_line_facts(spark, d):
    """The first line, and the number of lines, that hold a token. No array is exploded unless its text holds it."""
    rows = Tables(spark, d).documents.filter(F.col("text").contains("the ")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.filter(F.col("line").contains("the ")).groupBy("doc_id").agg((F.min("i") + 1).alias("first_line"), F.count("*").alias("n"))


@query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS spec FROM pages
""")
def q_link_imports(spark, d):
    """What a body imports: one row for each reference."""
    return Tables(spark, d).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("spec"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', ''), '\.html$', '') AS path FROM pages
""")
def q_url_normalize(spark, d):
    """Paths without scheme, query, fragment, trailing slashes and extension."""
    c = F.col("url")
    for pattern in (r"^[a-z]+://", r"[?#].*$", r"/+$", r"\.html$"):
        c = F.regexp_replace(c, pattern, "")
    return Tables(spark, d).pages.select("page_id", c.alias("path"))


@query(r"""
WITH links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS spec FROM pages),
known AS (SELECT DISTINCT regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, spec FROM links WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.path = links.spec)
""")
def q_unresolved_links(spark, d):
    """References that resolve to nothing."""
    pages = Tables(spark, d).pages
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).alias("spec"))
    known = pages.select(F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("spec")).distinct()
    return links.join(known, "spec", "left_anti").select("page_id", "spec")


@query("""
SELECT page_id, unnest(map_keys(m)) AS tag, unnest(map_values(m))::BIGINT AS n FROM (SELECT page_id, histogram(tag) AS m FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1)
""")
def q_markup_tags(spark, d):
    """Tags of a body, with counts."""
    return Tables(spark, d).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag")).groupBy("page_id", "tag").agg(F.expr("count(*)").alias("n"))


@query("""
SELECT event_type, count(k) AS n, min(k) AS least, max(k) AS greatest, sum(k)::BIGINT AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
""")
def q_env_like_kv(spark, d):
    """Keyed facts inside semi-structured bodies."""
    k = F.get_json_object("props", "$.k").cast("long")
    return Tables(spark, d).events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("greatest"), F.sum("k").alias("total"))


# ---- links between files


@query("SELECT l_partkey AS target, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY 1")
def q_reverse_index(spark, d):
    """Reverse imports: of each target, how many sources use it."""
    return Tables(spark, d).lineitem.select("l_partkey", "l_orderkey").distinct().groupBy(F.col("l_partkey").alias("target")).agg(F.count("*").alias("sources"))


@query("""
SELECT DISTINCT l_partkey AS target, l_orderkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'
""")
def q_direct_consumers(spark, d):
    """Consumers of each target that have no excluded role."""
    t = Tables(spark, d)
    uses = t.lineitem.select("l_partkey", "l_orderkey").distinct()
    return uses.join(t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("source"))


_CROSSINGS = """
SELECT l_orderkey, l_linenumber, s.n_name AS supplier_nation, c.n_name AS customer_nation, s.n_regionkey AS supplier_region, c.n_regionkey AS customer_region, o_orderstatus
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey
"""


def _crossings(t: Tables) -> DataFrame:
    nation = joins.small(t.nation)
    c = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"), F.col("n_regionkey").alias("customer_region"))
    s = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("supplier_region"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"SELECT l_orderkey, l_linenumber, supplier_nation, customer_nation FROM ({_CROSSINGS}) WHERE supplier_nation IS DISTINCT FROM customer_nation")
def q_cross_boundary(spark, d):
    """Edges whose ends lie in different domains, null-safe."""
    return _crossings(Tables(spark, d)).filter(~F.col("supplier_nation").eqNullSafe(F.col("customer_nation"))).select("l_orderkey", "l_linenumber", "supplier_nation", "customer_nation")


@query(f"""
SELECT supplier_region, customer_region, count(*) FILTER (o_orderstatus = 'F') AS test_crossings, count(*) FILTER (o_orderstatus <> 'F') AS other_crossings
FROM ({_CROSSINGS}) WHERE supplier_region <> customer_region GROUP BY ALL
""")
def q_cross_region_split(spark, d):
    """Crossings of each pair of domains, split by role."""
    rows = _crossings(Tables(spark, d)).filter("supplier_region <> customer_region")
    return rows.groupBy("supplier_region", "customer_region").agg(F.count_if(F.col("o_orderstatus") == "F").alias("test_crossings"), F.count_if(F.col("o_orderstatus") != "F").alias("other_crossings"))


@query(r"""
WITH paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages),
prefixes AS (SELECT DISTINCT regexp_extract(path, '^([^/]+(?:/[^/]+)?)', 1) AS prefix FROM paths UNION SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) FROM paths)
SELECT page_id, path, max_by(prefix, length(prefix)) AS prefix FROM paths LEFT JOIN prefixes ON path = prefix OR starts_with(path, prefix || '/') GROUP BY ALL
""")
def q_longest_prefix(spark, d):
    """The package of a file: the longest known prefix that is one of its ancestors."""
    paths = Tables(spark, d).pages.select("page_id", F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), r"/+$", "").alias("path"))
    prefixes = paths.select(F.explode(F.array(F.regexp_extract("path", r"^([^/]+(?:/[^/]+)?)", 1), F.regexp_extract("path", r"^([^/]+)", 1))).alias("prefix"))
    return joins.longest_prefix(paths, "path", ["page_id"], prefixes, "prefix").select("page_id", "path", "prefix")


@query("""
WITH rules(rule, pattern) AS (VALUES ('r1', '^Brand#1[^/]*/.*STEEL$'), ('r2', '^[^/]*/PROMO.*$'), ('r3', '^Brand#5[^/]*/[^/]*$'))
SELECT rule, count(*) AS findings, min(p_partkey) AS first_key FROM part JOIN rules ON regexp_matches(p_brand || '/' || p_type, pattern) GROUP BY 1
""")
def q_glob_findings(spark, d):
    """Boundary rules: globs against paths."""
    rules = spark.createDataFrame([("r1", "Brand#1*/**STEEL"), ("r2", "*/PROMO**"), ("r3", "Brand#5*/*")], "rule string, glob string")
    paths = Tables(spark, d).part.select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("path"))
    return joins.glob_join(paths, "path", rules, "glob").groupBy("rule").agg(F.count("*").alias("findings"), F.min("p_partkey").alias("first_key"))


# ---- traversal


def _node(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


_KINDS = ("region", "nation", "customer", "order", "part", "supplier")


def node_id(kind: str, key: str):
    """A node as one number, as graphs of numbers are sorted and shuffled for less than those of names."""
    return F.col(key).cast("long") * len(_KINDS) + _KINDS.index(kind)


def node_name(node):
    """kind:key of a node."""
    kind = F.pmod(node, F.lit(len(_KINDS)).cast("long"))
    named = F.element_at(F.array(*map(F.lit, _KINDS)), (kind + 1).cast("int"))
    return F.concat(named, F.lit(":"), F.call_function("div", node - kind, F.lit(len(_KINDS)).cast("long")).cast("string"))


def _edges(t: Tables) -> DataFrame:
    """region > nation > customer > order > part > supplier"""
    parts = [
        t.nation.select(node_id("region", "n_regionkey").alias("src"), node_id("nation", "n_nationkey").alias("dst")),
        t.customer.select(node_id("nation", "c_nationkey").alias("src"), node_id("customer", "c_custkey").alias("dst")),
        t.orders.select(node_id("customer", "o_custkey").alias("src"), node_id("order", "o_orderkey").alias("dst")),
        t.lineitem.select(node_id("order", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst")),
        t.lineitem.select(node_id("part", "l_partkey").alias("src"), node_id("supplier", "l_suppkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EDGES_SQL = """edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION
  SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION
  SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION
  SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
)"""
_BFS_SQL = f"""WITH RECURSIVE {_EDGES_SQL}, walk(node, depth) AS (
  SELECT 'region:' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA'
  UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 4
), depths AS (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1)"""


def _seeds(t: Tables) -> DataFrame:
    return t.region.filter("r_name = 'ASIA'").select(node_id("region", "r_regionkey").alias("node"))


@query(_BFS_SQL + " SELECT node, depth FROM depths")
def q_bfs_depths(spark, d):
    """The cone of an anchor: every node within four steps, with its least depth."""
    t = Tables(spark, d)
    return traverse.bfs_depths(_edges(t), _seeds(t), 4).select(node_name(F.col("node")).alias("node"), "depth")


@query(_BFS_SQL + """ SELECT depth, CASE WHEN depth = 0 THEN 'high' ELSE 'medium' END AS strength, CASE WHEN depth = 0 THEN 'direct' ELSE 'via depth ' || depth END AS evidence, count(*) AS edges
FROM edges JOIN depths ON src = node WHERE depth < 4 GROUP BY ALL""")
def q_cone_edges(spark, d):
    """Edges of a cone, their strength falling with depth."""
    t = Tables(spark, d)
    edges = cut(_edges(t).distinct())
    depths = traverse.depths(edges, _seeds(t), 3)  # what is further away leads to no edge of the cone
    return traverse.cone_edges(edges, depths).groupBy("depth", "strength", "evidence").agg(F.count("*").alias("edges"))


def _trade(t: Tables) -> DataFrame:
    """Which nations of a region supply which others of it."""
    return _crossings(t).filter("supplier_region = customer_region AND supplier_nation <> customer_nation").select(F.col("supplier_nation").alias("src"), F.col("customer_nation").alias("dst")).distinct()


_TRADE_SQL = f"""trade AS (SELECT DISTINCT supplier_nation AS src, customer_nation AS dst FROM ({_CROSSINGS}) WHERE supplier_region = customer_region AND supplier_nation <> customer_nation)"""


@query(f"""WITH RECURSIVE {_TRADE_SQL}, walk(path) AS (
  SELECT [src, dst] FROM trade UNION ALL SELECT list_append(path, dst) FROM walk JOIN trade ON src = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, dst)
) SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM walk""")
def q_simple_paths(spark, d):
    """Paths of up to four edges that repeat no node."""
    paths = traverse.simple_paths(cut(_trade(Tables(spark, d))), 4)
    return paths.select(F.array_join("path", ">").alias("path"), "length")


@query(f"""WITH RECURSIVE {_TRADE_SQL}, walk(src, dst, n) AS (
  SELECT src, dst, 1 FROM trade UNION SELECT w.src, t.dst, n + 1 FROM walk w JOIN trade t ON t.src = w.dst WHERE n < 8
) SELECT DISTINCT src, dst FROM walk""")
def q_reachability(spark, d):
    """What a chain of up to eight re-exports reaches."""
    return traverse.reachable(cut(_trade(Tables(spark, d))), 8)


@query("""
WITH supply AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT a.s AS supplier, b.s AS partner, count(*) AS shared_parts FROM supply a JOIN supply b USING (p) WHERE a.s < b.s GROUP BY ALL
""")
def q_two_hop(spark, d):
    """Pairs two hops apart, with the number of nodes between."""
    supply = Tables(spark, d).lineitem.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return traverse.shared_between(supply, "p", "s").select(F.col("a").alias("supplier"), F.col("b").alias("partner"), F.col("shared").alias("shared_parts"))


@query(f"""WITH {_TRADE_SQL}, degrees AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1),
top AS (SELECT node FROM degrees ORDER BY n DESC, node LIMIT 12)
SELECT src, dst FROM trade WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)""")
def q_induced_subgraph(spark, d):
    """Edges among the twelve nodes of the highest degree."""
    edges = cut(_trade(Tables(spark, d)))
    top = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count().orderBy(F.desc("count"), "node").limit(12)
    return traverse.induced(edges, top).select("src", "dst")


@query(f"WITH {_TRADE_SQL} SELECT src, 'graph: ' || string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY dst) AS text FROM trade GROUP BY src")
def q_mermaid(spark, d):
    """Edges as the lines of a diagram."""
    rows = _trade(Tables(spark, d)).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    return rows.select("src", F.concat(F.lit("graph: "), F.array_join(F.transform("to", lambda x: F.concat(F.lit("  "), F.col("src"), F.lit(" --> "), x)), "\n")).alias("text"))


# ---- ranking and limits


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_linenumber, l_shipdate) AS k FROM lineitem) WHERE k = 1
""")
def q_precedence_dedupe(spark, d):
    """For each pair of ends, the edge of the highest precedence; first wins ties."""
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", rank.alias("rank"))
    return bounds.precedence_dedupe(rows, ["l_orderkey", "l_partkey"], [F.col("rank")], ["l_linenumber", "l_shipdate"]).drop("rank")


@query("""
SELECT "from", "to", type, evidence, min(priority)::INT AS priority FROM (SELECT 'user:' || user_id AS "from", 'type:' || event_type AS "to", event_type AS type, CASE WHEN value >= 50 THEN 'strong' ELSE 'weak' END AS evidence,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority FROM events) GROUP BY ALL
""")
def q_canonical_sort_dedupe(spark, d):
    """Edges once for each identity, with their canonical priority."""
    e = Tables(spark, d).events
    edges = e.select(_node("user", "user_id").alias("from"), F.concat(F.lit("type:"), "event_type").alias("to"), F.col("event_type").alias("type"), F.when(F.col("value") >= 50, "strong").otherwise("weak").alias("evidence"))
    priority = F.when(F.col("type") == "purchase", 0).when(F.col("type") == "signup", 1).when(F.col("type") == "click", 2).otherwise(3)
    return bounds.canonical_edges(edges, priority)


@query("""
SELECT o_custkey, o_orderkey, position::INT AS position, observed, least(observed, 3) AS shown, observed - least(observed, 3) AS hidden FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS observed FROM orders) WHERE position <= 3
""")
def q_topk_hidden(spark, d):
    """The first three of each group; shown and hidden add up to observed."""
    rows = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return bounds.top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM orders)
SELECT o_orderkey, o_orderpriority, turn::INT AS turn FROM r ORDER BY turn, f LIMIT 12
""")
def q_round_robin(spark, d):
    """A balanced limit: one of each bucket in turn."""
    rows = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority")
    return bounds.round_robin(rows, ["o_orderpriority"], [F.col("o_orderkey")], 12)


@query("""
WITH s AS (SELECT l_partkey, l_orderkey, max(CASE WHEN l_quantity >= 45 AND l_returnflag = 'R' THEN 80 WHEN l_quantity >= 40 THEN 70 WHEN l_returnflag = 'R' THEN 55 WHEN l_discount > 0.05 THEN 48 ELSE 42 END) AS score FROM lineitem GROUP BY ALL),
f AS (SELECT *, max(score) OVER (PARTITION BY l_partkey) AS best FROM s)
SELECT l_partkey, l_orderkey, score FROM f WHERE best < 70 OR score >= 70
""")
def q_score_ladder(spark, d):
    """First match of a ladder gives a score; if any is high, the others of the group go."""
    c = F.col
    score = F.when((c("l_quantity") >= 45) & (c("l_returnflag") == "R"), 80).when(c("l_quantity") >= 40, 70).when(c("l_returnflag") == "R", 55).when(c("l_discount") > 0.05, 48).otherwise(42)
    scored = Tables(spark, d).lineitem.groupBy("l_partkey", "l_orderkey").agg(F.max(score).alias("score"))
    return scored.withColumn("best", F.max("score").over(Window.partitionBy("l_partkey"))).filter("best < 70 OR score >= 70").drop("best")


@query("""
WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM documents)
SELECT item_id, doc_id, count(*) AS shared FROM b JOIN t USING (token) GROUP BY ALL HAVING count(*) >= 12
""")
def q_set_overlap(spark, d):
    """Pairs that share at least twelve terms."""
    t = Tables(spark, d)
    terms = lambda df, key: df.select(key, F.explode(F.array_distinct(T.words(F.col("text")))).alias("token"))
    return terms(t.documents, "doc_id").join(joins.small(terms(t.benchmark, "item_id")), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).filter("shared >= 12")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_phrase_containment(spark, d):
    """Phrases that a body holds whole. A word of each phrase is joined by equality before any text is compared."""
    t = Tables(spark, d)
    phrases = t.benchmark.select("item_id", F.col("text").alias("phrase"))
    # the longest word inside, so neither the first nor the last one, which a body may hold as a part of another word
    inner = F.slice(F.split("phrase", " "), F.lit(2), F.greatest(F.size(F.split("phrase", " ")) - 2, F.lit(0)))
    keyed = phrases.withColumn("word", F.array_max(F.transform(F.filter(inner, lambda w: ~w.contains("\n")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    docs = t.documents.select("doc_id", "text")
    hits = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(joins.small(keyed.filter("word IS NOT NULL")), "word").select("doc_id", "item_id", "phrase")
    found = hits.join(docs, "doc_id").filter(F.col("text").contains(F.col("phrase"))).select("item_id", "doc_id")
    rest = joins.small(keyed.filter("word IS NULL").drop("word"), 1000)
    return found.unionByName(docs.join(rest, F.col("text").contains(F.col("phrase"))).select("item_id", "doc_id"))


@query("""
SELECT source, count(*) AS count, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') AS examples, greatest(count(*) - 5, 0) AS hidden FROM documents GROUP BY 1
""")
def q_group_examples(spark, d):
    """Siblings: count, first five examples and how many more."""
    rows = bounds.group_examples(Tables(spark, d).documents.select("source", "doc_id"), ["source"], "doc_id")
    return rows.select("source", "count", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), "hidden")


@query("""
SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS present FROM events GROUP BY 1 HAVING present >= 2
""")
def q_triplets(spark, d):
    """Groups in which at least two of three roles occur."""
    has = [F.max(F.when(F.col("event_type") == x, 1).otherwise(0)) for x in ("view", "click", "purchase")]
    return Tables(spark, d).events.groupBy("user_id").agg((has[0] + has[1] + has[2]).alias("present")).filter("present >= 2")


# ---- classification and certainty


@query("""
SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 4 END)::INT AS class_rank FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def q_coverage_classes(spark, d):
    """The best class of evidence of each item; 4 if there is none."""
    t = Tables(spark, d)
    q, x = F.col("quality"), F.col("toxic")
    rank = F.when((q == 1) & (x == 0), 0).when(q == 1, 1).when(q == 0, 2).otherwise(4)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy("doc_id").agg(F.min(rank).alias("class_rank"))


@query("""
SELECT source, CASE WHEN n > 0 THEN 'counted' WHEN eligible = visited THEN 'proven_zero' ELSE 'unknown' END AS status, CASE WHEN n > 0 OR eligible = visited THEN n END AS value, n AS lower_bound FROM (
  SELECT source, count(*) AS eligible, count(quality) AS visited, count(*) FILTER (toxic = 1) AS n FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) USING (doc_id) GROUP BY 1)
""")
def q_three_valued_count(spark, d):
    """Counts that tell none from not known."""
    t = Tables(spark, d)
    seen = t.documents.select("doc_id", "source").join(t.labels.distinct(), "doc_id", "left")
    sums = seen.groupBy("source").agg(F.count("*").alias("eligible"), F.count("quality").alias("visited"), F.count_if(F.col("toxic") == 1).alias("n"))
    return sums.select("source", *certify.count_fact(F.col("n"), F.col("eligible"), F.col("visited")))


@query("""
SELECT source, eligible, visited, eligible - visited AS excluded, CASE WHEN eligible = visited THEN 'closed' ELSE 'open' END AS closure, CASE WHEN eligible = visited THEN '' ELSE 'unread_body' END AS reasons FROM (
  SELECT source, count(*) AS eligible, count(quality) AS visited FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY 1)
""")
def q_certificate(spark, d):
    """What was visited of what was eligible, and whether that closes the question."""
    t = Tables(spark, d)
    seen = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality").distinct(), "doc_id", "left")
    sums = seen.groupBy("source").agg(F.count("*").alias("eligible"), F.count("quality").alias("visited"))
    closed = certify.closure(F.col("eligible") == F.col("visited"), F.when(F.col("eligible") > F.col("visited"), F.array(F.lit("unread_body"))).otherwise(F.array().cast("array<string>")))
    return sums.withColumn("excluded", F.col("eligible") - F.col("visited")).withColumn("c", closed).select("source", "eligible", "visited", "excluded", F.col("c.closure").alias("closure"), F.array_join("c.reasons", ",").alias("reasons"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' END, CASE WHEN lang = 'en' THEN 'english' END], lambda x: x IS NOT NULL), ',') AS roles FROM documents
""")
def q_role_flags(spark, d):
    """Roles add up."""
    return Tables(spark, d).documents.select("doc_id", F.array_join(_roles(), ",").alias("roles"))


def _roles():
    c = F.col
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in {"long": c("n_chars") > 5000, "short": c("n_chars") < 200, "table": c("text").contains("|"), "symbols": c("text").rlike("[#$%&*]{3}"), "english": c("lang") == "en"}.items()]))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN contains(text, '|') THEN 'table' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE lang END AS kind FROM documents
""")
def q_kind_priority(spark, d):
    """The first role of a priority list names the kind; a fallback names the rest."""
    kind = F.coalesce(*[F.when(F.array_contains("roles", r), r) for r in ("symbols", "table", "short", "long")], F.col("lang"))
    return Tables(spark, d).documents.select("doc_id", "lang", _roles().alias("roles")).select("doc_id", kind.alias("kind"))


@query("""
SELECT l_partkey, list_extract(['low', 'medium', 'medium-high', 'high', 'critical'], greatest(CASE WHEN n > 40 THEN 2 ELSE 0 END, CASE WHEN suppliers > 20 THEN 3 ELSE 0 END, CASE WHEN returned > 10 THEN 4 ELSE 0 END, CASE WHEN n > 20 THEN 1 ELSE 0 END) + 1) AS level,
  array_to_string(list_sort(list_filter([CASE WHEN n > 20 THEN 'used' END, CASE WHEN n > 40 THEN 'widely used' END, CASE WHEN suppliers > 20 THEN 'many suppliers' END, CASE WHEN returned > 10 THEN 'often returned' END], lambda x: x IS NOT NULL)), '; ') AS reasons
FROM (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
""")
def q_impact_level(spark, d):
    """The highest of several rules' levels, with all reasons."""
    sums = Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rules = [("used", F.col("n") > 20, 1), ("widely used", F.col("n") > 40, 2), ("many suppliers", F.col("suppliers") > 20, 3), ("often returned", F.col("returned") > 10, 4)]
    level = F.greatest(*[F.when(c, r).otherwise(0) for _, c, r in rules])
    return sums.select("l_partkey", name_of(level, RISKS).alias("level"), F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c, _ in rules]))), "; ").alias("reasons"))


# ---- differences


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Of each user, a fingerprint of the events in each half of the log's time."""
    e = t.events.select("user_id", "event_id", "event_type", "ts")
    middle = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("cut"))
    e = e.crossJoin(F.broadcast(middle))  # one row
    sides = []
    for cond in (F.col("ts") < F.col("cut"), F.col("ts") >= F.col("cut")):
        sides.append(e.filter(cond).groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("print")))
    return sides[0], sides[1]


_SNAP_SQL = """cut AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS c FROM events),
a AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS print FROM events, cut WHERE ts < c GROUP BY 1),
b AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS print FROM events, cut WHERE ts >= c GROUP BY 1)"""


@query(f"""WITH {_SNAP_SQL} SELECT user_id, CASE WHEN a.print IS NULL THEN 'added' WHEN b.print IS NULL THEN 'removed' WHEN a.print = b.print THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b USING (user_id)""")
def q_snapshot_diff(spark, d):
    """Fingerprints before and after: added, removed, modified, unchanged."""
    before, after = _snapshots(Tables(spark, d))
    return delta.fingerprint_diff(before, after, "user_id", "print").select("user_id", "status")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS h, doc_id % 2 AS side FROM documents), u AS (SELECT h, side, min(doc_id) AS doc_id FROM h GROUP BY ALL HAVING count(*) = 1)
SELECT a.doc_id AS old_doc, b.doc_id AS new_doc FROM u a JOIN u b USING (h) WHERE a.side = 0 AND b.side = 1
""")
def q_rename_detect(spark, d):
    """The same content under another key: renames, if it is unique on both sides (even ids before, odd after)."""
    rows = Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return delta.renames(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), "doc_id", "h").select(F.col("old").alias("old_doc"), F.col("new").alias("new_doc"))


@query("""WITH cut AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS c FROM events),
e AS (SELECT user_id AS target, event_type || '@' || hour(ts) AS source, ts FROM events), a AS (SELECT DISTINCT target, source FROM e, cut WHERE ts < c), b AS (SELECT DISTINCT target, source FROM e, cut WHERE ts >= c)
SELECT target, count(*) FILTER (a.source IS NULL) AS added, count(*) FILTER (b.source IS NULL) AS removed FROM a FULL JOIN b USING (target, source) GROUP BY 1 HAVING added + removed > 0""")
def q_incremental_index(spark, d):
    """Targets whose set of sources changed, so that only their rows of the reverse index are rebuilt."""
    e = Tables(spark, d).events.select(F.col("user_id").alias("target"), F.concat_ws("@", "event_type", F.hour("ts").cast("string")).alias("source"), "ts")
    middle = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("cut"))
    e = e.crossJoin(F.broadcast(middle))  # one row
    side = lambda c: e.filter(c).select("target", "source").distinct()
    return delta.affected_targets(side("ts < cut"), side("ts >= cut"))


@query("""
SELECT DISTINCT l_orderkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'A')
""")
def q_pair_coupling(spark, d):
    """Changes whose counterpart did not change."""
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_returnflag")
    return rows.filter("l_returnflag = 'R'").select("l_orderkey").distinct().join(rows.filter("l_returnflag = 'A'").select("l_orderkey"), "l_orderkey", "left_anti")


@query("""
SELECT kind, n FROM (SELECT count(*) FILTER (l_discount > 0.08) AS deep_discount, count(*) FILTER (l_quantity > 49) AS bulk, count(*) FILTER (l_tax > 0.99) AS overtaxed, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS open_return FROM lineitem)
UNPIVOT (n FOR kind IN (deep_discount, bulk, overtaxed, open_return)) WHERE n > 0
""")
def q_conditional_risks(spark, d):
    """Kinds of risk with counts, those that occur; one pass."""
    c = F.col
    conds = {"deep_discount": c("l_discount") > 0.08, "bulk": c("l_quantity") > 49, "overtaxed": c("l_tax") > 0.99, "open_return": (c("l_returnflag") == "R") & (c("l_linestatus") == "O")}
    sums = Tables(spark, d).lineitem.agg(*[F.count_if(v).alias(k) for k, v in conds.items()])
    return sums.unpivot([], list(conds), "kind", "n").filter("n > 0")


# ---- order


@query("""
SELECT conv_id, turn, (row_number() OVER w - 1)::INT AS step, lag(role) OVER w AS before, role, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def q_flow_steps(spark, d):
    """Ordered steps, with what comes before and after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return Tables(spark, d).conversations.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("step"), F.lag("role").over(w).alias("before"), "role", F.lead("role").over(w).alias("after"))


@query("""
SELECT conv_id, turn AS line_start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS line_end FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE role = 'user'
""")
def q_symbol_ranges(spark, d):
    """Ranges from one start to before the next."""
    rows = Tables(spark, d).conversations.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).filter("role = 'user'")
    return rows.select("conv_id", F.col("turn").alias("line_start"), F.coalesce(F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - 1, F.col("last")).alias("line_end"))


@query("""
WITH r AS (SELECT conv_id, turn AS line_start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS line_end FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE role = 'user')
SELECT c.conv_id, c.turn, r.line_start FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.turn BETWEEN r.line_start AND r.line_end
""")
def q_range_join(spark, d):
    """Which range holds each line."""
    t = Tables(spark, d)
    ranges = q_symbol_ranges(spark, d)
    return joins.range_join(t.conversations.select("conv_id", "turn"), F.col("turn"), ranges, F.col("line_start"), F.col("line_end"), 16, on=["conv_id"]).select("conv_id", "turn", "line_start")


@query(r"""
WITH routes(route, pattern, specificity) AS (VALUES ('/:lang/:page', '^/[^/]+/[^/]+$', 0), ('/en/:page', '^/en/[^/]+$', 1), ('/:lang/:page.html', '^/[^/]+/[^/]+\.html$', 2)),
p AS (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages), m AS (SELECT page_id, path, route, row_number() OVER (PARTITION BY page_id ORDER BY specificity DESC) AS k FROM p LEFT JOIN routes ON regexp_matches(path, pattern))
SELECT page_id, path, route FROM m WHERE k = 1
""")
def q_route_match(spark, d):
    """The most specific route pattern that a path fits."""
    routes = [("/:lang/:page.html", r"^/[^/]+/[^/]+\.html$"), ("/en/:page", r"^/en/[^/]+$"), ("/:lang/:page", r"^/[^/]+/[^/]+$")]  # most specific first
    path = F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)
    return Tables(spark, d).pages.select("page_id", path.alias("path")).withColumn("route", F.coalesce(*[F.when(F.col("path").rlike(p), r) for r, p in routes]))


@query("""
SELECT 'user:' || user_id AS reader, 'table:' || CASE WHEN event_type IN ('view', 'click') THEN 'catalog' ELSE 'ledger' END AS target, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'reads' ELSE 'writes' END AS type, count(*) AS n FROM events GROUP BY ALL
""")
def q_sql_lineage_like(spark, d):
    """Reads and writes as typed edges to pseudo-nodes."""
    kind = F.col("event_type")
    target = F.concat(F.lit("table:"), F.when(kind.isin("view", "click"), "catalog").otherwise("ledger"))
    return Tables(spark, d).events.groupBy(_node("user", "user_id").alias("reader"), target.alias("target"), F.when(kind.isin("view", "click", "error"), "reads").otherwise("writes").alias("type")).agg(F.count("*").alias("n"))


@query()
def q_line_diff(spark, d):
    """Added and removed lines between documents of one source that begin alike (least and greatest id of each pair of
    source and first line). SQL has no longest common subsequence; tests compare with a plain one."""
    docs = Tables(spark, d).documents.select("doc_id", "source", "text", F.substring_index("text", "\n", 1).alias("head"))
    ends = docs.groupBy("source", "head").agg(F.min_by("text", "doc_id").alias("before"), F.max_by("text", "doc_id").alias("after"), F.min("doc_id").alias("old"), F.max("doc_id").alias("new")).filter("old <> new")
    return delta.line_deltas(ends.select(F.concat_ws(">", "old", "new").alias("rel"), "before", "after"))


# ---- beyond the catalogue: grouping sets, sessions and approximate counts


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def q_rollup(spark, d):
    t = Tables(spark, d)
    return t.customer.join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s
""")
def q_sessions(spark, d):
    """Runs of events of a user without a gap of over an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = Tables(spark, d).events.select("user_id", "event_id", "ts")
    fresh = F.when(F.lag("ts").over(w) >= F.col("ts") - F.expr("INTERVAL 1 HOUR"), 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "s").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("s")
