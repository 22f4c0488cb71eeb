"""Graphs derived from all rows of the business tables, as SQL that both engines read alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.components import checkpoint_folder
from spandrel.operators.graph import Graph
from spandrel.operators.tables import written
from spandrel.sources import tree

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations", "documents")

CATALOG_NODES = """
select concat('r', r_regionkey) as id, r_name as name, 'module' as kind, concat('geo/r', r_regionkey, '.tbl') as file,
       cast(1 as bigint) as line, false as is_external, cast(null as string) as docstring from region
union all
select concat('r', n_regionkey, '.n', n_nationkey), n_name, 'class', concat('geo/r', n_regionkey, '.tbl'),
       cast(n_nationkey + 2 as bigint), false, n_name from nation
union all
select concat('r', n_regionkey, '.n', n_nationkey, '.c', c_custkey), c_mktsegment, 'function',
       concat('geo/r', n_regionkey, '/n', n_nationkey, '.tbl'), c_custkey, false, cast(null as string)
from customer join nation on c_nationkey = n_nationkey
union all
select concat('r', n_regionkey, '.n', n_nationkey, '.s', s_suppkey), s_name, 'method',
       concat('geo/r', n_regionkey, '/n', n_nationkey, '.tbl'), s_suppkey, false, cast(null as string)
from supplier join nation on s_nationkey = n_nationkey
union all
select distinct concat('b.', p_brand), p_brand, 'struct', concat('parts/', p_brand, '.tbl'),
       cast(1 as bigint), false, cast(null as string) from part
union all
select concat('__ext__.p', p_partkey), p_name, 'constant', '', cast(0 as bigint), true, cast(null as string) from part
"""

CATALOG_EDGES = """
with n as (select n_nationkey as k, concat('r', n_regionkey, '.n', n_nationkey) as nid, n_regionkey as rk from nation),
     big as (select l_orderkey, l_partkey, l_suppkey from lineitem)
select concat('r', rk) as source, nid as target, 'contains' as kind from n
union all select nid, concat(nid, '.c', c_custkey), 'contains' from customer join n on c_nationkey = k
union all select nid, concat(nid, '.s', s_suppkey), 'contains' from supplier join n on s_nationkey = k
union all select concat('b.', p_brand), concat('__ext__.p', p_partkey), 'contains' from part
union all select distinct concat(nid, '.s', s_suppkey), concat('__ext__.p', l_partkey), 'uses_type'
          from big join supplier on s_suppkey = l_suppkey join n on s_nationkey = k
union all select distinct concat(nid, '.c', c_custkey), concat('__ext__.p', l_partkey), 'external_dep'
          from big join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join n on c_nationkey = k
"""

# The same edges for Spark: keys are made distinct before they become text, so customers' need no exchange after their join. Not equal
# where a nation has no region: then ids are null, and different keys one edge.
KEYED_EDGES = """
with n as (select n_nationkey as k, concat('r', n_regionkey, '.n', n_nationkey) as nid, n_regionkey as rk from nation),
     used as (select distinct nid, s_suppkey, l_partkey from lineitem join supplier on s_suppkey = l_suppkey join n on s_nationkey = k),
     bought as (select distinct nid, c_custkey, l_partkey from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join n on c_nationkey = k)
select concat('r', rk) as source, nid as target, 'contains' as kind from n
union all select nid, concat(nid, '.c', c_custkey), 'contains' from customer join n on c_nationkey = k
union all select nid, concat(nid, '.s', s_suppkey), 'contains' from supplier join n on s_nationkey = k
union all select concat('b.', p_brand), concat('__ext__.p', p_partkey), 'contains' from part
union all select concat(nid, '.s', s_suppkey), concat('__ext__.p', l_partkey), 'uses_type' from used
union all select concat(nid, '.c', c_custkey), concat('__ext__.p', l_partkey), 'external_dep' from bought
"""

TRADE = """
select distinct concat('n', s_nationkey) as source, concat('n', c_nationkey) as target, 'calls' as kind
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
"""

COPURCHASE = """
select distinct concat('c', o_custkey) as source, concat('p', l_partkey) as target, 'uses_type' as kind
from lineitem join orders on l_orderkey = o_orderkey
"""

REPLIES = """
select concat('c', a.conv_id, '.t', a.turn) as source, concat('c', b.conv_id, '.t', b.turn) as target, 'inherits' as kind
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1
"""

TRANSITIONS = """
select s as source, t as target, 'calls' as kind from (
  select user_id, event_type as s, lead(event_type) over (partition by user_id order by ts, event_id) as t from events) x
where t is not null
"""

# Every user's moves between kinds of events: many small graphs of several cycles.
USER_MOVES = """
select distinct concat('u', user_id, '.', s) as source, concat('u', user_id, '.', t) as target, 'calls' as kind from (
  select user_id, event_type as s, lead(event_type) over (partition by user_id order by ts, event_id) as t from events) x
where t is not null
"""

# Turns inherit from the turn before; in every other conversation the first inherits from the last (a ring), in some it
# inherits from itself; a conversation inherits from all its turns.
CYCLIC_TURNS = """
with t as (select conv_id, concat('c', conv_id, '.t', turn) as id, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n from conversations)
select a.id as source, b.id as target, 'inherits' as kind from t a join t b on a.conv_id = b.conv_id and b.k = a.k - 1
union all select a.id, b.id, 'inherits' from t a join t b on a.conv_id = b.conv_id and a.k = 1 and b.k = b.n where a.conv_id % 2 = 0
union all select id, id, 'inherits' from t where k = 1 and conv_id % 6 = 1
union all select concat('conv', conv_id), id, 'inherits' from t
"""

SNAP = """
select distinct concat('s', l_suppkey) as source, concat('p', l_partkey) as target, 'uses_type' as kind
from lineitem where l_shipdate {when}
"""
SNAP_OLD = SNAP.format(when="< timestamp '1998-06-01 00:00:00'")
SNAP_NEW = SNAP.format(when=">= timestamp '1997-06-01 00:00:00'")

REFS = """
select o_orderkey as ref_id, concat('r', n_regionkey, '.n', n_nationkey) as module_id,
       case o_orderkey % 4 when 0 then c_mktsegment when 1 then s_name when 2 then concat('crate::', s_name)
            else o_orderpriority end as name
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
     join supplier on s_suppkey = o_custkey % 10 + 1
"""


def endpoints(edges: str) -> str:
    """The node set of an edge block."""
    return f"select distinct id from (select source as id from ({edges}) e1 union all select target from ({edges}) e2) ends"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a block over the tables of ``sf_dir`` that it names."""
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def plain_nodes(ids: DataFrame) -> DataFrame:
    """Bare ids as nodes."""
    return ids.select(
        "id", F.col("id").alias("name"), F.lit("function").alias("kind"), F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), F.lit(False).alias("is_external"), F.lit(None).cast("string").alias("docstring")
    )


def catalog(spark: SparkSession, sf_dir: str) -> Graph:
    placed = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey is null").isEmpty()
    return Graph(sql(spark, sf_dir, CATALOG_NODES), sql(spark, sf_dir, KEYED_EDGES if placed else CATALOG_EDGES))


def of_edges(spark: SparkSession, sf_dir: str, edges: str, more: str = "") -> Graph:
    """A graph on an edge block's ends, and on the ids of another block. The block runs once: its edges are written, its ends read from there."""
    rows = written(sql(spark, sf_dir, edges))
    ids = rows.select(F.explode(F.array("source", "target")).alias("id"))
    if more:
        ids = ids.unionByName(sql(spark, sf_dir, more))
    return Graph(plain_nodes(ids.distinct()), rows)


ALL_CUSTOMERS = "select concat('c', c_custkey) as id from customer"
TURNS = "select concat('c', conv_id, '.t', turn) as id from conversations"


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    return of_edges(spark, sf_dir, COPURCHASE, ALL_CUSTOMERS)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    return of_edges(spark, sf_dir, TRADE)


def replies(spark: SparkSession, sf_dir: str) -> Graph:
    return of_edges(spark, sf_dir, REPLIES, TURNS)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    return of_edges(spark, sf_dir, SNAP_OLD), of_edges(spark, sf_dir, SNAP_NEW)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_id, local, path, seq): the links of every page as its imports."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("seq", "h"))
    path = F.regexp_replace("h", "^/", "")
    return rows.select(F.concat(F.lit("page"), "page_id").alias("module_id"), path.alias("local"), path.alias("path"), F.format_string("%020d|%020d", F.col("page_id"), F.col("seq").cast("long")).alias("seq"))


# Pages as source files: a page is a node named by the first word of its title, it imports what it links to and calls it.
# Of the older version, pages whose URL has a fragment were not there yet, and those whose URL has a query were still empty.
PAGE_FACTS = """
with p as (select page_id, coalesce(url, '') as url, {html} as html from pages {where}),
     f as (select page_id, concat('page', page_id) as m, sha2(html, 256) as hash, html from p),
     l as (select page_id, m, hash, posexplode(regexp_extract_all(html, 'href="([^"]+)"', 1)) as (k, h) from f),
     r as (select page_id, m, hash, k, regexp_replace(h, '^/', '') as w from l)
select page_id as file_seq, cast(0 as bigint) as seq, m as module_id, m as file, 'html' as lang, hash, 'node' as fact, m as a, regexp_extract(html, '<title>([^ <]*)', 1) as b, 'module' as c, cast(null as string) as d, cast(1 as bigint) as line from f
union all select page_id, cast(2 * k + 1 as bigint), m, m, 'html', hash, 'import', w, w, null, null, null from r
union all select page_id, cast(2 * k + 2 as bigint), m, m, 'html', hash, 'call', m, w, null, null, null from r
"""


def page_facts(spark: SparkSession, sf_dir: str, older: bool = False) -> DataFrame:
    html = "case when coalesce(url, '') like '%?%' then '' else coalesce(html, '') end" if older else "coalesce(html, '')"
    return sql(spark, sf_dir, PAGE_FACTS.format(html=html, where="where coalesce(url, '') not like '%#%'" if older else ""))


# Every document as a source file in its source's folder, with its text; and as a Python module whose class extends that of the document before it in its source.
TEXT_FILES = """
select concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id, case lang when 'en' then '.py' when 'de' then '.rs' when 'fr' then '.ts' when 'es' then '.hpp' else '.txt' end) as rel, coalesce(text, '') as content
from documents
"""
# An older version of these files: the last language hadn't come yet, texts of even sources and odd numbers were others, and one folder has gone since.
OLDER_FILES = """
select concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id, case lang when 'en' then '.py' when 'de' then '.rs' when 'fr' then '.ts' when 'es' then '.hpp' else '.txt' end) as rel,
       case when doc_id % 2 = 1 and length(coalesce(source, '')) % 2 = 0 then concat('older ', coalesce(text, '')) else coalesce(text, '') end as content
from documents where coalesce(lang, '') <> 'es'
union all select concat('gone/', coalesce(source, 'none'), '/', doc_id, '.py'), coalesce(text, '') from documents where lang = 'en'
"""
LINKED = """
select d, coalesce(s, 'none') as s, lag(d) over (partition by s order by d) as p, row_number() over (partition by s order by d) as k from (select distinct doc_id as d, coalesce(source, 'none') as s from documents) x
"""
MODULE_FILES = f"""
select concat(s, '/d', d, '.py') as rel, concat(case when p is null then '' else concat('from ', s, '.d', p, ' import C', p, '\n\n\n') end, 'class C', d, case when p is null then '' else concat('(C', p, ')') end, ':\n    def m', d, '(self):\n        pass\n') as content
from ({LINKED}) l
"""


def file_tree(spark: SparkSession, sf_dir: str, files: str) -> str:
    """A folder in the shared one that holds the files (rel, content) of a block."""
    root = f"{checkpoint_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree.write_tree(sql(spark, sf_dir, files), root)
    return root
