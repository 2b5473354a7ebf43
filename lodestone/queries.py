"""The operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import all_of, strip
from lodestone.operators import analyze, chunk, components, diffs, evaluate, graph, lookup, many, parse, patterns, roles, search, vcs
from lodestone.operators.cells import CellIndex
from lodestone.operators.substring import SubstringIndex
from lodestone.plans.store import settled, work_dir
from lodestone.plans.versions import VersionedCatalog

TERMS = "the tion und eau"
Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dag(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """region -> nation -> supplier -> part as (src, dst); each edge ``once``, or as often as the tables have it."""
    sold = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge(table(spark, d, "nation"), "R", "n_regionkey", "N", "n_nationkey").unionByName(edge(table(spark, d, "supplier"), "N", "s_nationkey", "S", "s_suppkey")).unionByName(
        edge(sold.distinct() if once else sold, "S", "l_suppkey", "P", "l_partkey")
    )


DAG = """edges AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
 UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Which event type follows which for some user: a graph with cycles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where(F.col("dst").isNotNull()).distinct()


CYCLE = """edges AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("function_name"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("table_name"), F.col("l_returnflag").alias("operation"), F.lit("").alias("raw_sql"), F.col("l_orderkey").alias("ord"))


USAGE = "usage AS (SELECT 'S' || l_suppkey AS function_name, 'P' || l_partkey AS table_name, l_returnflag AS operation FROM lineitem)"


# Search

PAGES = "pg AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, html FROM pages)"
SCORE = " + ".join(f"3 * CAST(contains(title, '{t}') AS INT) + CAST(contains(html, '{t}') AS INT)" for t in TERMS.split())


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "html")


@query("keyword_scores", f"WITH {PAGES} SELECT page_id, CAST({SCORE} AS INTEGER) AS score FROM pg WHERE {SCORE} > 0")
def keyword_scores(spark, d):
    return search.keyword_search(_pages(spark, d), TERMS, {"title": 3, "html": 1}, "page_id", None).select("page_id", "score")


@query("keyword_topk", f"WITH {PAGES} SELECT page_id, title, CAST({SCORE} AS INTEGER) AS score FROM pg WHERE {SCORE} > 0 ORDER BY score DESC, page_id LIMIT 3")
def keyword_topk(spark, d):
    return search.keyword_search(_pages(spark, d), TERMS, {"title": 3, "html": 1}, "page_id").select("page_id", "title", "score")


@query("keyword_scores_indexed", SQL["keyword_scores"])
def keyword_scores_indexed(spark, d):
    """Through a substring index of all pages; terms of two characters and more."""
    index = SubstringIndex.build(_pages(spark, d), ("title", "html"), work_dir(spark))
    return index.keyword_search(TERMS, {"title": 3, "html": 1}, "page_id", None).select("page_id", "score")


RARE = "zu eau quantum Mond"


@query("substring_documents", "SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(text, '{t}') AS INT)" for t in RARE.split()) + " AS INTEGER) AS score FROM documents WHERE score > 0")
def substring_documents(spark, d):
    index = SubstringIndex.build(table(spark, d, "documents").select("doc_id", "text"), ("text",), work_dir(spark))
    return index.keyword_search(RARE, {"text": 1}, "doc_id", None).select("doc_id", "score")


@query(
    "keyword_search_many",
    """WITH q AS (SELECT DISTINCT text AS query FROM conversations WHERE conv_id % 20 = 0 AND turn = 0),
 t AS (SELECT query, unnest(list_filter(string_split_regex(query, '\\s+'), lambda x: len(x) >= 2)) AS term FROM q),
 u AS (SELECT DISTINCT term FROM t),
 m AS (SELECT u.term, doc_id FROM u JOIN documents ON contains(text, u.term)),
 s AS (SELECT query, doc_id, count(*) AS score FROM t JOIN m USING (term) GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
 SELECT query, doc_id, score, rank FROM r WHERE rank <= 3""",
)
def keyword_search_many(spark, d):
    """The 3 best documents for the first turn of every 20th conversation, in one pass over all documents."""
    asked = table(spark, d, "conversations").where("conv_id % 20 = 0 AND turn = 0").select(F.col("text").alias("query"))
    return many.keyword_search_many(table(spark, d, "documents"), asked, {"text": 1}, "doc_id", "doc_id")


L2 = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE))))"


def _vector(e: DataFrame, vec_id: int) -> list[float]:
    """The vector of one id; empty where there is none, which is near to nothing in particular."""
    row = e.where(F.col("vec_id") == vec_id).select("embedding").first()
    return row["embedding"] if row and row["embedding"] else []


@query("vector_topk", f"SELECT v.vec_id, round(1.0::DOUBLE / (1 + {L2}), 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {L2}, v.vec_id LIMIT 7")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return search.vector_search(e, _vector(e, 0), "vec_id", k=7).select("vec_id", "score")


@query(
    "vector_topk_batch",
    f"""WITH p AS (SELECT q.vec_id AS query_key, v.vec_id, {L2} AS d FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY d, vec_id) AS INTEGER) AS rank FROM p)
 SELECT query_key, vec_id, rank, round(1.0::DOUBLE / (1 + d), 4) AS score FROM r WHERE rank <= 5""",
)
def vector_topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    return search.vector_search_batch(e, e.where("vec_id % 20 = 0"), "vec_id").select("query_key", "vec_id", "rank", "score")


@query("vector_topk_cells", SQL["vector_topk_batch"])
def vector_topk_cells(spark, d):
    """Through cells of which only those are read that can hold a neighbour."""
    e = table(spark, d, "embeddings")
    index = CellIndex.build(e, "vec_id", "embedding", work_dir(spark))
    return index.search_batch(e.where("vec_id % 20 = 0"), "vec_id").select("query_key", "vec_id", "rank", "score")


DOC_SCORE = " + ".join(f"CAST(contains(text, '{t}') AS INT)" for t in TERMS.split())


@query("name_candidates", f"SELECT name, CAST(max(score) AS INTEGER) AS score FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1)) AS name, {DOC_SCORE} AS score FROM documents) GROUP BY name")
def name_candidates(spark, d):
    docs = table(spark, d, "documents").withColumn("score", search.keyword_score(TERMS, {"text": 1}))
    return search.name_candidates(docs, pattern="([A-Z][a-z]{3,})", stop=()).select("name", "score")


@query(
    "hybrid_topk",
    f"""WITH n AS (SELECT v.vec_id, round(1.0::DOUBLE / (1 + {L2}), 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {L2}, v.vec_id LIMIT 5),
 c AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1)) AS name, score FROM n JOIN documents ON doc_id = vec_id)
 SELECT name, max(score) AS score FROM c GROUP BY name ORDER BY score DESC, name LIMIT 5""",
)
def hybrid_topk(spark, d):
    e = table(spark, d, "embeddings")
    near = search.vector_search(e, _vector(e, 0), "vec_id", k=5)
    chunks = near.join(table(spark, d, "documents"), F.col("doc_id") == F.col("vec_id")).select("text", "score")
    return search.name_candidates(chunks, pattern="([A-Z][a-z]{3,})", stop=()).select("name", "score").orderBy(F.desc("score"), "name").limit(5)


# Chunks

@query(
    "fixed_chunks",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
 w AS (SELECT doc_id, i, l[i + 1:i + 6] AS part, len(l) AS n FROM l, unnest(range(0, len(l), 4)) AS t(i))
 SELECT 'd' || doc_id || ':' || (i + 1) || '-' || least(i + 6, n) AS id, CAST(i + 1 AS INTEGER) AS start_line, CAST(least(i + 6, n) AS INTEGER) AS end_line, array_to_string(part, chr(10)) AS text
 FROM w WHERE len(list_filter(part, lambda x: regexp_matches(x, '\S'))) > 0""",
)
def fixed_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.lit("txt").alias("ext"), "text")
    return chunk.chunk_fixed(docs).select("id", "start_line", "end_line", "text")


# Graphs

@query("call_graph_direct", f"WITH {DAG} SELECT name, CAST(sum(o) AS BIGINT) AS n_calls, CAST(sum(i) AS BIGINT) AS n_callers FROM (SELECT src AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY name")
def call_graph_direct(spark, d):
    return graph.degrees(dag(spark, d))


@query("neighbours_of", f"WITH {DAG} SELECT 'N1' AS entry, array_to_string((SELECT list(DISTINCT dst ORDER BY dst) FROM edges WHERE src = 'N1'), ',') AS calls, array_to_string((SELECT list(DISTINCT src ORDER BY src) FROM edges WHERE dst = 'N1'), ',') AS called_by")
def neighbours_of(spark, d):
    return graph.neighbours(dag(spark, d), "N1").select("entry", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query("links_of", f"WITH {DAG} SELECT DISTINCT dst AS name, 'calls' AS direction FROM edges WHERE src = 'N1' UNION ALL SELECT DISTINCT src, 'called_by' FROM edges WHERE dst = 'N1'")
def links_of(spark, d):
    return graph.links(dag(spark, d), "N1")


TREE = """, t(src, dst, depth) AS (SELECT src, dst, 1 FROM edges WHERE src = '{0}' UNION ALL SELECT e.src, e.dst, t.depth + 1 FROM edges e JOIN t ON e.src = t.dst WHERE t.depth < {1})"""


@query("call_tree", f"WITH RECURSIVE {DAG}{TREE.format('R1', 3)} SELECT src, dst, depth FROM t")
def call_tree(spark, d):
    return graph.tree(settled(dag(spark, d)), "R1", 3)


@query(
    "paths_page",
    f"""WITH RECURSIVE {DAG}, t(path, name, depth) AS (SELECT ['R1'], 'R1', 0 UNION ALL SELECT list_append(t.path, e.dst), e.dst, t.depth + 1 FROM edges e JOIN t ON e.src = t.name WHERE t.depth < 3),
 r AS (SELECT array_to_string(path, '>') AS path, depth, row_number() OVER (ORDER BY path) - 1 AS rank FROM t WHERE depth > 0) SELECT path, depth, rank FROM r WHERE rank BETWEEN 40 AND 299""",
)
def paths_page(spark, d):
    """The paths of ranks 40 to 299 of a call tree, without laying out the tree."""
    page = graph.paths_page(graph.path_sizes(dag(spark, d), "R1", 3), "R1", 40, 260)
    return page.select(F.array_join("path", ">").alias("path"), "depth", F.col("rank").cast("long").alias("rank"))


@query("call_tree_cyclic", f"WITH RECURSIVE {CYCLE}{TREE.format('click', 4)} SELECT src, dst, depth FROM t")
def call_tree_cyclic(spark, d):
    return graph.tree(settled(transitions(spark, d)), "click", 4)


@query("transitive_callees", f"WITH RECURSIVE {DAG}{TREE.format('R1', 3)} SELECT dst AS name, min(depth) AS depth FROM t GROUP BY dst")
def transitive_callees(spark, d):
    return graph.transitive_callees(settled(dag(spark, d)), "R1", 3)


BACK = """, t(name, depth) AS (SELECT src, 1 FROM edges WHERE dst = '{0}' UNION ALL SELECT e.src, t.depth + 1 FROM edges e JOIN t ON e.dst = t.name WHERE t.depth < {1})"""


@query("impact_function", f"WITH RECURSIVE {DAG}{BACK.format('P1', 5)} SELECT DISTINCT name, depth FROM t")
def impact_function(spark, d):
    return graph.function_impact(settled(dag(spark, d)), "P1")


@query("affected_counts")
def affected_counts(spark, d):
    """Of every node; estimates, so there is no SQL: a test holds them against exact counts."""
    return graph.affected_counts(dag(spark, d), 3)


@query(
    "components_affected",
    f"""WITH RECURSIVE {DAG.replace("edges AS", "dag AS", 1)}, {CYCLE.replace("edges AS", "cycle AS", 1)}, edges AS (SELECT * FROM dag UNION SELECT * FROM cycle),
 t(a, b) AS (SELECT src, dst FROM edges UNION SELECT t.a, e.dst FROM t JOIN edges e ON e.src = t.b),
 n AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges), m AS (SELECT x.a AS name, min(x.b) AS other FROM t x JOIN t y ON x.a = y.b AND x.b = y.a GROUP BY 1),
 k AS (SELECT b AS name, count(*) AS affected FROM t GROUP BY 1)
 SELECT name, least(name, coalesce(other, name)) AS component, CAST(coalesce(affected, 0) AS BIGINT) AS affected FROM n LEFT JOIN m USING (name) LEFT JOIN k USING (name)""",
)
def components_affected(spark, d):
    """Of every node of both graphs its component and how many nodes reach it at any depth."""
    return components.affected_exactly(dag(spark, d, once=False).unionByName(transitions(spark, d)))


@query("impact_cyclic", f"WITH RECURSIVE {CYCLE}{BACK.format('purchase', 4)} SELECT DISTINCT name, depth FROM t")
def impact_cyclic(spark, d):
    return graph.function_impact(settled(transitions(spark, d)), "purchase", 4)


@query(
    "impact_table",
    f"""WITH RECURSIVE {DAG}, {USAGE}, u AS (SELECT function_name AS usr, min(operation) AS operation FROM usage WHERE table_name = 'P1' GROUP BY 1),
 t(usr, name, depth) AS (SELECT usr, src, 1 FROM u JOIN edges ON dst = usr UNION ALL SELECT t.usr, e.src, t.depth + 1 FROM edges e JOIN t ON e.dst = t.name WHERE t.depth < 5),
 x AS (SELECT usr, 0 AS kind, 0 AS depth, usr AS name, operation FROM u UNION ALL SELECT DISTINCT usr, 1, depth, name, 'indirect' FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY usr, kind, depth, operation) AS k FROM x)
 SELECT name, operation, depth, usr AS via FROM r WHERE k = 1""",
)
def impact_table(spark, d):
    return graph.table_impact(settled(dag(spark, d)), usage(spark, d), "P1").select("name", "operation", "depth", "via")


@query(
    "business_flow",
    f"""WITH RECURSIVE {CYCLE}, k AS (SELECT * FROM edges WHERE dst <> 'error'),
 t(name, depth, path) AS (SELECT 'view', 0, 'view' UNION ALL SELECT k.dst, t.depth + 1, t.path || '>' || k.dst FROM k JOIN t ON k.src = t.name WHERE t.depth < 3),
 o AS (SELECT event_type AS name, string_agg(DISTINCT 'T' || (user_id % 3) || ':READ', ',' ORDER BY 'T' || (user_id % 3) || ':READ') AS sql_operations FROM events GROUP BY 1)
 SELECT path, name, depth, coalesce(sql_operations, '') AS sql_operations FROM t LEFT JOIN o USING (name)""",
)
def business_flow(spark, d):
    ops = table(spark, d, "events").select(F.col("event_type").alias("function_name"), F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")).alias("table_name"), F.lit("READ").alias("operation"))
    f = graph.flow(settled(transitions(spark, d)), ops, "view", 3, ("error",))
    return f.select(F.array_join("path", ">").alias("path"), "name", "depth", F.array_join(F.transform("sql_operations", lambda o: F.concat_ws(":", o["table_name"], o["operation"])), ",").alias("sql_operations"))


# Lookups

@query("functions_by_table", f"WITH {USAGE} SELECT function_name, operation FROM usage WHERE table_name = 'P1'")
def functions_by_table(spark, d):
    return lookup.functions_by_table(usage(spark, d), "P1").select("function_name", "operation")


def _relations(spark, d):
    """Suppliers and nations as functions, regions as tables; each supplier 'uses' its nation's region."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    code = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    fields = lambda name, file, tables: [name.alias("name"), F.array(name).alias("ord"), file.alias("file_path"), F.lit("").alias("description"), F.lit("").alias("body"), F.array().cast("array<string>").alias("params"), tables.alias("tables_used"), F.array(F.lit("proframe.h"), F.lower(name)).alias("includes")]
    none = F.array().cast("array<string>")
    fs = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(*fields(code("S", "s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pc")), F.array(code("R", "n_regionkey"), F.lit("TB_NONE"))))
    return {
        "functions": fs.unionByName(n.select(*fields(code("N", "n_nationkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".pc")), none))),
        "function_calls": s.select(code("S", "s_suppkey").alias("caller"), code("N", "s_nationkey").alias("callee")),
        "tables_ddl": table(spark, d, "region").select(code("R", "r_regionkey").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".sql")).alias("file_path")),
        "structs": table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("_str.h")).alias("file_path")),
    }


@query(
    "function_detail",
    """SELECT 'S' || s_suppkey AS name, 's' || s_suppkey || '.pc' AS file_path, 'N' || s_nationkey AS calls, '' AS called_by, 's' || s_suppkey AS struct_files, 'n' || s_nationkey || '.pc' AS dependency_files, 'r' || n_regionkey || '.sql' AS ddl_files
 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
 SELECT 'N' || n_nationkey, 'n' || n_nationkey || '.pc', '', coalesce(string_agg('S' || s_suppkey, ',' ORDER BY 'S' || s_suppkey), ''), 'n' || n_nationkey, '', '' FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def function_detail(spark, d):
    lists = ("calls", "called_by", "struct_files", "dependency_files", "ddl_files")
    return lookup.function_detail(_relations(spark, d)).select("name", "file_path", *[F.array_join(c, ",").alias(c) for c in lists])


@query("domain_search", "SELECT 'function' AS kind, 'N' || n_nationkey AS name FROM nation UNION ALL SELECT 'struct', p_name FROM part WHERE lower(replace(p_type, ' ', '_')) || '_str.h' ILIKE 'n_%' UNION ALL SELECT 'function', 'S' || s_suppkey FROM supplier WHERE false")
def domain_search(spark, d):
    return lookup.by_domain(_relations(spark, d), "n").select("kind", "name")


@query(
    "error_code_context",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, 'token')),
 p AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: contains(x, 'token')), true) AS n FROM l)
 SELECT doc_id, CAST(n AS INTEGER) AS line_no, array_to_string(l[greatest(n - 2, 1):n + 3], chr(10)) AS context,
 coalesce(regexp_extract(list_filter(l[n:n + 4], lambda x: contains(x, 'token'))[1], '"([^"]+)"', 1), '') AS error_message FROM p WHERE n > 0""",
)
def error_code_context(spark, d):
    return lookup.hits_with_context(table(spark, d, "documents"), "doc_id", "text", "token", message="token")


@query("list_services", "SELECT s_name AS name, 's' || s_suppkey AS file_path, CAST(s_nationkey AS VARCHAR) AS description FROM supplier ORDER BY name")
def list_services(spark, d):
    return lookup.services(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"), F.col("s_nationkey").cast("string").alias("description")))


@query("index_counts", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "part", "events", "documents")))
def index_counts(spark, d):
    return lookup.counts({t: table(spark, d, t) for t in ("orders", "lineitem", "part", "events", "documents")})


# Parsing

BODY = """'{ EXEC SQL BEGIN DECLARE SECTION; char v[2]; EXEC SQL END DECLARE SECTION; ' ||
 CASE p_partkey % 6 WHEN 0 THEN 'EXEC SQL SELECT a.P_NAME, P_SIZE INTO :x, :y FROM TB_' || replace(upper(p_brand), '#', '_') || ' a, TB_PART b WHERE a.K = b.K;'
 WHEN 1 THEN 'exec sql insert into TB_PART_' || p_size || ' VALUES (1);' WHEN 2 THEN 'EXEC SQL UPDATE TB_STOCK SET N = ' || p_size || ';'
 WHEN 3 THEN 'EXEC SQL DELETE FROM TB_OLD WHERE K = 1;' WHEN 4 THEN 'EXEC SQL DECLARE c CURSOR FOR SELECT X FROM TB_CUR JOIN TB_JOINED ON 1 = 1; EXEC SQL OPEN c; EXEC SQL FETCH c INTO :x;'
 ELSE 'EXEC SQL OPEN TB_CURSOR_' || p_size || ';' END || ' CM_LOG_' || (p_partkey % 4) || '(1); PT_SIZE_' || p_size || ' (in->k); NVL(x); if (SUM(y)) return; }'"""


def _bodies(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{BODY} AS body")


STMT = rf"""b AS (SELECT p_partkey, {BODY} AS body FROM part),
 s AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(body, '(?is)EXEC\s+SQL\s+(.*?);', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '(?i)^(BEGIN\s+DECLARE|END\s+DECLARE|INCLUDE)')) AS ss FROM b),
 e AS (SELECT p_partkey, i AS pos, ss[i + 1] AS s FROM s, unnest(range(0, len(ss))) AS t(i)),
 o AS (SELECT *, CASE WHEN regexp_matches(s, '(?is)\bSELECT\b.*?\bFROM\s+\w+') THEN 'SELECT' WHEN regexp_matches(s, '(?i)\bINSERT\s+INTO\s+\w+') THEN 'INSERT' WHEN regexp_matches(s, '(?i)\bUPDATE\s+\w+') THEN 'UPDATE'
  WHEN regexp_matches(s, '(?i)\bDELETE\s+FROM\s+\w+') THEN 'DELETE' WHEN regexp_matches(s, '(?i)\bDECLARE\b') THEN 'DECLARE' WHEN regexp_matches(s, '(?i)\bOPEN\b') THEN 'CURSOR' ELSE 'OTHER' END AS operation FROM e)"""


@query("sql_statements", f"WITH {STMT} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, operation, 'EXEC SQL ' || s || ';' AS raw_sql FROM o")
def sql_statements(spark, d):
    return _bodies(spark, d).select("p_partkey", F.posexplode(parse.statements(F.col("body"))).alias("pos", "s")).select("p_partkey", "pos", "s.operation", "s.raw_sql")


@query(
    "sql_tables",
    rf"""WITH {STMT}, n AS (SELECT *, CASE operation WHEN 'SELECT' THEN regexp_extract_all(s, '(?i)\b(TB_\w+|SQ_\w+)\b', 1) WHEN 'INSERT' THEN regexp_extract_all(s, '(?i)\bINSERT\s+INTO\s+(\w+)', 1)
  WHEN 'UPDATE' THEN regexp_extract_all(s, '(?i)\bUPDATE\s+(\w+)', 1) WHEN 'DELETE' THEN regexp_extract_all(s, '(?i)\bDELETE\s+FROM\s+(\w+)', 1) WHEN 'CURSOR' THEN regexp_extract_all(s, '\b(TB_\w+)\b', 1) ELSE [] END AS t FROM o)
 SELECT p_partkey, CAST(pos AS INTEGER) AS pos, array_to_string(t, ',') AS tables FROM n""",
)
def sql_tables(spark, d):
    return _bodies(spark, d).select("p_partkey", F.posexplode(parse.statements(F.col("body"))).alias("pos", "s")).select("p_partkey", "pos", F.array_join("s.tables", ",").alias("tables"))


@query(
    "sql_columns",
    rf"""WITH {STMT} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE WHEN operation = 'SELECT' THEN array_to_string(list_filter(list_transform(string_split(regexp_extract(s, '(?is)\bSELECT\s+(.*?)\s+INTO\b', 1), ','),
 lambda c: regexp_replace(regexp_extract(trim(c), '([^.]*)$', 1), '^:+', '')), lambda c: c <> '' AND c <> '*'), ',') ELSE '' END AS columns FROM o""",
)
def sql_columns(spark, d):
    return _bodies(spark, d).select("p_partkey", F.posexplode(parse.statements(F.col("body"))).alias("pos", "s")).select("p_partkey", "pos", F.array_join("s.columns", ",").alias("columns"))


NO_CALL = ", ".join(f"'{w}'" for w in patterns.NOT_CALLS)


@query(
    "call_names",
    rf"""WITH b AS (SELECT p_partkey, {BODY} AS body FROM part),
 c AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(body, '(?is)EXEC\s+SQL\s+(.*?);', '', 'g'), '\b([A-Z][A-Z0-9_]{{2,}})\s*\(', 1), lambda x: NOT list_contains([{NO_CALL}], x) AND x <> 'CM_LOG_1' AND NOT starts_with(x, 'TB_') AND NOT starts_with(x, 'SQ_')))) AS c FROM b)
 SELECT p_partkey, array_to_string(c, ',') AS calls FROM c""",
)
def call_names(spark, d):
    return _bodies(spark, d).select("p_partkey", F.array_join(parse.calls(F.col("body"), F.lit("CM_LOG_1")), ",").alias("calls"))


#: The text of a C file; line ends and quotes are escaped as Spark writes them.
FILE = (
    r"'/* supplier ' || s_suppkey || ' */\n#include \"proframe.h\"\n#include \"n' || s_nationkey || '_str.h\"\n\nint SP_GET_' || s_suppkey || '(sp_in_t *in, sp_out_t *out)\n{\n    /* read */\n    EXEC SQL SELECT BAL INTO :v FROM TB_SUPPLIER;\n    if (SQLCA.sqlcode != 0) {\n        strcpy(out->err_cd, \"E10\");\n        return FAIL;\n    }\n    NT_GET_' || s_nationkey || '(in, out);\n    return SUCCESS;\n}\n'"
)


def _plain(text: str) -> str:
    """The same expression as DuckDB writes it."""
    return text.replace(r"\n", "' || chr(10) || '").replace(r"\"", '"')


def _files(spark, d):
    """A C file for each supplier, a header and a definition for each nation."""
    s = table(spark, d, "supplier").selectExpr(
        "array('c', lpad(s_suppkey, 9, '0')) AS ord", "'s' || s_suppkey || '.pc' AS file", "'pc' AS ext",
        FILE + " AS text",
    )
    n = table(spark, d, "nation")
    h = n.selectExpr("array('h', lpad(n_nationkey, 9, '0')) AS ord", "'n' || n_nationkey || '_str.h' AS file", "'h' AS ext", r"'/* nation ' || n_nationkey || ' */\ntypedef struct {\n    char name[' || (n_nationkey + 2) || '];    /* its name */\n    long region;\n} n' || n_nationkey || '_in_t;\n' AS text")
    t = n.selectExpr("array('s', lpad(n_nationkey, 9, '0')) AS ord", "'TB_N' || n_nationkey || '.sql' AS file", "'sql' AS ext", r"'CREATE TABLE TB_N' || n_nationkey || ' (\n    ID VARCHAR2(' || (n_nationkey + 1) || ') NOT NULL,\n    BAL NUMBER(15,2) DEFAULT 0,\n    D DATE,\n    CONSTRAINT PK_N PRIMARY KEY (ID, D)\n);\nCOMMENT ON TABLE TB_N' || n_nationkey || ' IS ''nation ' || n_nationkey || ''';\n' AS text")
    return s.unionByName(h).unionByName(t)


@query(
    "parse_functions",
    """SELECT 'SP_GET_' || s_suppkey AS name, 's' || s_suppkey || '.pc' AS file_path, 'supplier ' || s_suppkey AS description, 'sp_in_t *in|sp_out_t *out' AS params, 'TB_SUPPLIER' AS tables_used,
 'NT_GET_' || s_nationkey AS calls, 'proframe.h|n' || s_nationkey || '_str.h' AS includes FROM supplier""",
)
def parse_functions(spark, d):
    f = parse.parse_functions(_files(spark, d))
    return f.select("name", "file_path", "description", *[F.array_join(c, "|").alias(c) for c in ("params", "tables_used", "calls", "includes")])


@query(
    "table_access",
    """SELECT 'NT_SET_' || n_nationkey AS name, 0 AS pos, 'UPDATE' AS operation, 'TB_N' || n_nationkey AS table_name, 'write' AS role, 0 AS part, 0 AS level FROM nation
 UNION ALL SELECT 'NT_SET_' || n_nationkey, 0, 'UPDATE', 'TB_R' || n_regionkey, 'read', 1, 1 FROM nation UNION ALL SELECT 'NT_SET_' || n_nationkey, 0, 'UPDATE', 'TB_ALL', 'read', 2, 2 FROM nation
 UNION ALL SELECT 'NT_SET_' || n_nationkey, 1, 'INSERT', 'TB_LOG', 'write', 0, 0 FROM nation UNION ALL SELECT 'NT_SET_' || n_nationkey, 1, 'INSERT', 'TB_N' || n_nationkey, 'read', 0, 0 FROM nation""",
)
def table_access(spark, d):
    """Tables read and written by statements with subqueries."""
    n = table(spark, d, "nation").selectExpr(
        "array('t', lpad(n_nationkey, 9, '0')) AS ord", "'nt' || n_nationkey || '.pc' AS file", "'pc' AS ext",
        r"'int NT_SET_' || n_nationkey || '(in_t *in)\n{\n    EXEC SQL UPDATE TB_N' || n_nationkey || ' SET B = 1 WHERE K IN (SELECT K FROM TB_R' || n_regionkey || ' WHERE C > (SELECT MIN(C) FROM TB_ALL));\n    EXEC SQL INSERT INTO TB_LOG SELECT K FROM TB_N' || n_nationkey || ';\n}\n' AS text",
    )
    return roles.table_access(parse.parse_functions(n))


@query("function_bodies", f"""SELECT 'SP_GET_' || s_suppkey AS name, regexp_extract({_plain(FILE)}, '(?s)[{{].*[}}]') AS body FROM supplier""")
def function_bodies(spark, d):
    return parse.parse_functions(_files(spark, d)).select("name", "body")


@query("relation_edges", "SELECT DISTINCT 'SP_GET_' || s_suppkey AS caller, 'NT_GET_' || s_nationkey AS callee FROM supplier")
def relation_edges(spark, d):
    return parse.relations(_files(spark, d))["function_calls"]


@query("relation_usage", "SELECT 'SP_GET_' || s_suppkey AS function_name, 'TB_SUPPLIER' AS table_name, 'SELECT' AS operation, 'EXEC SQL SELECT BAL INTO :v FROM TB_SUPPLIER;' AS raw_sql FROM supplier")
def relation_usage(spark, d):
    return parse.relations(_files(spark, d))["sql_usage"].drop("ord")


@query(
    "rendered_definitions",
    """SELECT 'n' || n_nationkey || '_in_t' AS name, '/* nation ' || n_nationkey || ' */' || chr(10) || 'typedef struct {' || chr(10) || '    char name[' || (n_nationkey + 2) || '];    /* its name */' || chr(10) || '    long region;' || chr(10) || '} n' || n_nationkey || '_in_t;' AS content FROM nation
 UNION ALL SELECT 'TB_N' || n_nationkey, 'CREATE TABLE TB_N' || n_nationkey || ' (' || chr(10) || '    ID  VARCHAR2(' || (n_nationkey + 1) || ')  NOT NULL,' || chr(10) || '    BAL  NUMBER(15,2),' || chr(10) || '    D  DATE,' || chr(10) || '    PRIMARY KEY (ID, D)' || chr(10) || ');' || chr(10) || '-- nation ' || n_nationkey FROM nation""",
)
def rendered_definitions(spark, d):
    files = _files(spark, d)
    return parse.parse_structs(files).select("name", search.rendered_struct().alias("content")).unionByName(parse.parse_tables(files).select("name", search.rendered_table().alias("content")))


@query(
    "function_context",
    """SELECT 1 AS section, 's1.pc' AS filename, 'entry' AS role, 'direct' AS relevance FROM supplier WHERE s_suppkey = 1 UNION ALL
 SELECT 2, 'n' || s_nationkey || '_str.h', 'struct', 'direct' FROM supplier WHERE s_suppkey = 1""",
)
def function_context(spark, d):
    return search.context(parse.relations(_files(spark, d)), "SP_GET_1").select("section", "filename", "role", "relevance")


@query(
    "context_of_all",
    """WITH s AS (SELECT 'SP_GET_' || s_suppkey AS entry, s_suppkey AS k, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)
 SELECT entry, 1 AS section, 's' || k || '.pc' AS filename, 'entry' AS role FROM s UNION ALL SELECT entry, 2, 'n' || n || '_str.h', 'struct' FROM s
 UNION ALL SELECT entry, 3, 'nt' || n || '.pc', 'callee (NT_GET_' || n || ')' FROM s UNION ALL SELECT entry, 3, 'rg' || r || '.pc', 'callee (RG_GET_' || r || ')' FROM s
 UNION ALL SELECT entry, 4, 'TB_N' || n || '.sql', 'table (TB_N' || n || ')' FROM s""",
)
def context_of_all(spark, d):
    """Contexts of all suppliers' functions at once: callees two steps away and the definitions of their tables among them."""
    n = table(spark, d, "nation").selectExpr("array('t', lpad(n_nationkey, 9, '0')) AS ord", "'nt' || n_nationkey || '.pc' AS file", "'pc' AS ext", r"'int NT_GET_' || n_nationkey || '(in_t *in)\n{\n    EXEC SQL SELECT ID INTO :v FROM TB_N' || n_nationkey || ';\n    RG_GET_' || n_regionkey || '(in);\n}\n' AS text")
    r = table(spark, d, "region").selectExpr("array('r', lpad(r_regionkey, 9, '0')) AS ord", "'rg' || r_regionkey || '.pc' AS file", "'pc' AS ext", r"'int RG_GET_' || r_regionkey || '(in_t *in)\n{\n    return 0;\n}\n' AS text")
    rel = parse.relations(_files(spark, d).unionByName(n).unionByName(r))
    return search.context_many(rel, rel["functions"].where(F.col("name").startswith("SP_GET_")).select("name")).select("entry", "section", "filename", "role")


@query("parse_structs", "SELECT 'n' || n_nationkey || '_in_t' AS name, 'nation ' || n_nationkey AS description, 'char name[' || (n_nationkey + 2) || '] its name;long region[] ' AS fields FROM nation")
def parse_structs(spark, d):
    text = F.array_join(F.transform("fields", lambda f: F.concat(f["c_type"], F.lit(" "), f["name"], F.lit("["), F.coalesce(f["size"], F.lit("")), F.lit("] "), F.coalesce(f["comment"], F.lit("")))), ";")
    return parse.parse_structs(_files(spark, d)).select("name", "description", text.alias("fields"))


@query("parse_tables", "SELECT 'TB_N' || n_nationkey AS name, 'nation ' || n_nationkey AS comment, 'ID,D' AS primary_key, 'ID VARCHAR2(' || (n_nationkey + 1) || ') false ;BAL NUMBER(15,2) true 0,;D DATE true ' AS columns FROM nation")
def parse_tables(spark, d):
    text = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["data_type"], c["nullable"].cast("string"), F.coalesce(c["default"], F.lit("")))), ";")
    return parse.parse_tables(_files(spark, d)).select("name", "comment", F.array_join("primary_key", ",").alias("primary_key"), text.alias("columns"))


@query(
    "semantic_chunks",
    """SELECT 's' || s_suppkey || '.pc:SP_GET_' || s_suppkey AS id, 'pc' AS file_type, 5 AS start_line, 15 AS end_line, true AS has_sql FROM supplier
 UNION ALL SELECT 'n' || n_nationkey || '_str.h:full', 'h', 1, 6, false FROM nation UNION ALL SELECT 'TB_N' || n_nationkey || '.sql:full', 'sql', 1, 8, true FROM nation""",
)
def semantic_chunks(spark, d):
    return chunk.chunk_semantic(_files(spark, d)).select("id", "file_type", "start_line", "end_line", "has_sql")


@query(
    "chunk_texts",
    rf"""WITH t AS (SELECT s_suppkey, {_plain(FILE)} AS text FROM supplier)
 SELECT 's' || s_suppkey || '.pc:SP_GET_' || s_suppkey AS id, substr(text, strpos(text, 'int SP_GET_'), length(text) - strpos(text, 'int SP_GET_')) AS text FROM t""",
)
def chunk_texts(spark, d):
    return chunk.chunk_semantic(_files(spark, d)).where("file_type = 'pc'").select("id", "text")


@query("include_links", """SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' ') AS links FROM pages""")
def include_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(all_of(F.col("html"), 'href="([^"]+)"'), " ").alias("links"))


@query("title_or_heading", "SELECT page_id, trim(coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), ''), '')) AS description FROM pages")
def title_or_heading(spark, d):
    first = lambda tag: F.try_element_at(F.filter(all_of(F.col("html"), f"(?s)<{tag}>(.*?)</{tag}>"), lambda x: x != ""), F.lit(1))
    return table(spark, d, "pages").select("page_id", strip(F.coalesce(first("title"), first("h1"), F.lit(""))).alias("description"))


@query("upsert_last_wins", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, d):
    return parse.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("edge_dedup", f"WITH {CYCLE} SELECT src, dst FROM edges")
def edge_dedup(spark, d):
    return transitions(spark, d)


# Evaluation: per language and strategy, documents with a term against those of good quality.

STRATEGIES = (("first", "the"), ("second", "und"))
EVAL = """r AS (SELECT lang AS query, s AS strategy, list(CAST(doc_id AS VARCHAR)) AS returned FROM documents, (VALUES ('first', 'the'), ('second', 'und')) v(s, term) WHERE contains(text, term) GROUP BY ALL),
 g AS (SELECT lang AS query, list(CAST(doc_id AS VARCHAR)) FILTER (quality = 1) AS required, list(CAST(doc_id AS VARCHAR)) FILTER (toxic = 1) AS noise FROM documents JOIN labels USING (doc_id) GROUP BY 1),
 m AS (SELECT query, strategy, len(returned) AS n, len(list_intersect(returned, coalesce(required, []))) AS hit, len(coalesce(required, [])) AS req, len(list_intersect(returned, coalesce(noise, []))) AS bad FROM r LEFT JOIN g USING (query)),
 e AS (SELECT query, strategy, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(hit::DOUBLE / n, 3) END AS precision, CASE WHEN req = 0 THEN 0.0::DOUBLE ELSE round(hit::DOUBLE / req, 3) END AS recall, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(bad::DOUBLE / n, 3) END AS noise_ratio FROM m)"""


def _evaluated(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    ident = F.col("doc_id").cast("string")
    found = docs.select("lang", "doc_id", F.explode(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(s)) for s, t in STRATEGIES])).alias("strategy")).where(F.col("strategy").isNotNull())
    told = docs.select("doc_id", F.col("lang").alias("query")).join(labels, "doc_id").select("query", ident.alias("file"), F.explode(F.array(F.when(F.col("quality") == 1, "required"), F.when(F.col("toxic") == 1, "noise"))).alias("kind"))
    return evaluate.evaluate_rows(found.select(F.col("lang").alias("query"), "strategy", ident.alias("file")), told.where(F.col("kind").isNotNull()))


@query("retrieval_metrics", f"WITH {EVAL} SELECT query, strategy, precision, recall, noise_ratio FROM e")
def retrieval_metrics(spark, d):
    return _evaluated(spark, d).select("query", "strategy", "precision", "recall", "noise_ratio")


@query("strategy_averages", f"WITH {EVAL} SELECT strategy, count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(noise_ratio), 6) AS noise_ratio FROM e GROUP BY strategy")
def strategy_averages(spark, d):
    m = evaluate.strategy_averages(_evaluated(spark, d))
    return m.select("strategy", "n_queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "noise_ratio")])


@query(
    "retrieval_completeness",
    """WITH p AS (SELECT p_partkey // 40 AS k, 'f' || p_size AS f, 's' || p_partkey % 7 AS g FROM part),
 r AS (SELECT k, list(f) AS returned FROM p GROUP BY k), t AS (SELECT k, list(DISTINCT f) FILTER (f < 'f3') AS fb, list(DISTINCT g) FILTER (g = 's1') AS st FROM p GROUP BY k)
 SELECT CAST(k AS VARCHAR) AS query, (coalesce(list_has_any(returned, coalesce(fb, [])), false)) AS has_function_body, (len(coalesce(st, [])) = 0 OR list_has_any(returned, coalesce(st, []))) AS has_structs, true AS has_called_functions, true AS has_table_ddl,
 round((2 + CAST(list_has_any(returned, coalesce(fb, [])) AS INT) + CAST(len(coalesce(st, [])) = 0 OR list_has_any(returned, coalesce(st, [])) AS INT)) / 4.0::DOUBLE, 3) AS context_completeness FROM r JOIN t USING (k)""",
)
def retrieval_completeness(spark, d):
    p = table(spark, d, "part").selectExpr("CAST(p_partkey DIV 40 AS STRING) AS query", "'f' || p_size AS f", "'s' || (p_partkey % 7) AS g")
    results = p.groupBy("query").agg(F.collect_list("f").alias("returned_files")).withColumn("strategy", F.lit("s"))
    none = F.array().cast("array<string>")
    truth = p.groupBy("query").agg(F.collect_set(F.when(F.col("f") < "f3", F.col("f"))).alias("fb"), F.collect_set(F.when(F.col("g") == "s1", F.col("g"))).alias("st"))
    truth = truth.select("query", none.alias("required_files"), none.alias("noise_files"), F.struct(F.col("fb").alias("function_body"), F.col("st").alias("structs"), none.alias("called_functions"), none.alias("table_ddl")).alias("context_categories"))
    return evaluate.evaluate(results, truth).select("query", *[f"has_{c}" for c in evaluate.CATEGORIES], "context_completeness")


# Version control

@query("blame_parse", "SELECT o_orderkey, CAST(1 AS INTEGER) AS line, CAST(o_orderkey AS VARCHAR) AS revision, 'u' || o_custkey AS author, 'int a = ' || o_orderkey || ';' AS content FROM orders UNION ALL SELECT o_orderkey, 2, '7', 'me', '' FROM orders")
def blame_parse(spark, d):
    raw = table(spark, d, "orders").selectExpr("o_orderkey", r"'  ' || o_orderkey || '   u' || o_custkey || '    int a = ' || o_orderkey || ';\n 7 me\n' AS raw")
    return vcs.blame_lines(raw, "raw", "o_orderkey")


@query("status_parse", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN '?' WHEN 2 THEN 'A' ELSE 'Z' END AS code, CASE c_custkey % 4 WHEN 0 THEN 'Modified' WHEN 1 THEN 'Untracked' WHEN 2 THEN 'Added' ELSE 'Z' END AS label, 'src/' || c_custkey || '.pc' AS path FROM customer")
def status_parse(spark, d):
    raw = table(spark, d, "customer").selectExpr("c_custkey", r"CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN '?' WHEN 2 THEN 'A' ELSE 'Z' END || '       src/' || c_custkey || '.pc\n\n' AS raw")
    return vcs.status_lines(raw, "raw", "c_custkey")


def _history(spark, d):
    """Two revisions of a file for each order: three lines, then one of them changed and one more."""
    head = lambda r: f"'Index: o' || o_orderkey || '.pc\\n===\\n--- o' || o_orderkey || '.pc\\t(revision {r - 1})\\n+++ o' || o_orderkey || '.pc\\t(revision {r})\\n'"
    first = head(1) + "|| '@@ -0,0 +1,3 @@\\n+int a;\\n+-- k = ' || o_custkey || ';\\n+return;\\n'"
    second = head(2) + "|| '@@ -1,3 +1,4 @@\\n int a;\\n--- k = ' || o_custkey || ';\\n+++ k = ' || (o_custkey + 1) || ';\\n+int b;\\n return;\\n'"
    o = table(spark, d, "orders")
    return o.selectExpr("1L AS revision", f"{first} AS raw").unionByName(o.selectExpr("2L AS revision", f"{second} AS raw"))


DIFF = """l AS (SELECT 'o' || o_orderkey || '.pc' AS file, o_custkey AS k FROM orders)"""


@query(
    "diff_lines",
    f"""WITH {DIFF} SELECT file, 1::BIGINT AS revision, 'insert' AS kind, NULL::INTEGER AS old_line, 1 AS new_line, 'int a;' AS content FROM l UNION ALL SELECT file, 1, 'insert', NULL, 2, '-- k = ' || k || ';' FROM l UNION ALL SELECT file, 1, 'insert', NULL, 3, 'return;' FROM l
 UNION ALL SELECT file, 2, 'context', 1, 1, 'int a;' FROM l UNION ALL SELECT file, 2, 'delete', 2, NULL, '-- k = ' || k || ';' FROM l UNION ALL SELECT file, 2, 'insert', NULL, 2, '++ k = ' || (k + 1) || ';' FROM l
 UNION ALL SELECT file, 2, 'insert', NULL, 3, 'int b;' FROM l UNION ALL SELECT file, 2, 'context', 3, 4, 'return;' FROM l""",
)
def diff_lines(spark, d):
    return diffs.diff_lines(_history(spark, d), "raw", "revision").select("file", "revision", "kind", "old_line", "new_line", "content")


@query(
    "blame_from_diffs",
    f"""WITH {DIFF} SELECT file, 1 AS line, 1::BIGINT AS revision, 'int a;' AS content FROM l UNION ALL SELECT file, 2, 2, '++ k = ' || (k + 1) || ';' FROM l UNION ALL SELECT file, 3, 2, 'int b;' FROM l UNION ALL SELECT file, 4, 1, 'return;' FROM l""",
)
def blame_from_diffs(spark, d):
    return diffs.blame_texts(_history(spark, d), "raw", "revision")


@query("versioned_functions", "SELECT 1 AS version, 'SP_GET_' || s_suppkey AS name, 's' || s_suppkey || '.pc' AS file_path FROM supplier UNION ALL SELECT 2, CASE WHEN s_suppkey % 5 = 0 THEN 'SP_NEW_' ELSE 'SP_GET_' END || s_suppkey, 's' || s_suppkey || '.pc' FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 <> 0")
def versioned_functions(spark, d):
    """Functions of two versions of a catalog: the second has changed every fifth file and dropped every seventh."""
    files = _files(spark, d).withColumn("file_path", F.array_join(F.concat("ord", F.array("file")), "/"))
    key = F.regexp_extract("file", "^s([0-9]+)", 1).try_cast("int")
    stored = VersionedCatalog(spark, work_dir(spark))
    stored.commit(files)
    changed = files.where((F.col("ext") == "pc") & (key % 5 == 0)).withColumn("text", F.replace("text", F.lit("SP_GET_"), F.lit("SP_NEW_")))
    stored.commit(changed, files.where((F.col("ext") == "pc") & (key % 7 == 0)).select("file_path"))
    of = lambda v: stored.relation("functions", v).select(F.lit(v).alias("version"), "name", "file_path")
    return of(1).unionByName(of(2))


@query("log_parse", "SELECT c_custkey, 'r' || c_custkey AS revision, 'u' || c_nationkey AS author, '2024-01-15 10:30:00 +0900' AS date, 'fix ' || c_mktsegment AS message, 'M /a.pc|A /b' || c_custkey || '.pc' AS changed FROM customer UNION ALL SELECT c_custkey, 'r0', 'me', '2023-01-01', 'first', '' FROM customer")
def log_parse(spark, d):
    rule = vcs.RULE
    raw = table(spark, d, "customer").selectExpr(
        "c_custkey",
        rf"'{rule}\nr' || c_custkey || ' | u' || c_nationkey || ' | 2024-01-15 10:30:00 +0900 (Mon, 15 Jan) | 1 line\nChanged paths:\n   M /a.pc\n   A /b' || c_custkey || '.pc\n\nfix ' || c_mktsegment || '\n{rule}\nr0 | me | 2023-01-01 | 1 line\n\nfirst\n{rule}\n' AS raw",
    )
    return vcs.log_entries(raw, "raw", "c_custkey").select("c_custkey", "revision", "author", "date", "message", F.array_join("changed", "|").alias("changed"))


# Body analysis

@query("analyzer_io_fields", "SELECT 'S' || s_suppkey AS name, 'a,k' || s_nationkey AS input_fields, 'err_cd,v' || (s_suppkey % 7) AS output_fields FROM supplier")
def analyzer_io_fields(spark, d):
    f = table(spark, d, "supplier").selectExpr("'S' || s_suppkey AS name", "'' AS description", "'{ x = in->k' || s_nationkey || ' + in->a + in->a; out->v' || (s_suppkey % 7) || ' = 1; out->err_cd = 0; }' AS body")
    return analyze.summary(f).select("name", F.array_join("input_fields", ",").alias("input_fields"), F.array_join("output_fields", ",").alias("output_fields"))


def _analyzed(spark, d):
    return _files(spark, d).where("ext = 'pc'").select(F.regexp_extract("file", r"s(\d+)\.pc", 1).cast("long").alias("name"), F.col("text").alias("body"))


@query("analyzer_errors", """SELECT s_suppkey AS name, 9 AS line_no, 'if (SQLCA.sqlcode != 0) {' AS condition, 'strcpy(out->err_cd, "E10"); | return FAIL;' AS action FROM supplier""")
def analyzer_errors(spark, d):
    return analyze.error_handlers(_analyzed(spark, d))


@query("analyzer_calls", "SELECT s_suppkey AS name, 5 AS line_no, 'SP_GET_' || s_suppkey AS callee, 'sp_in_t *in, sp_out_t *out' AS args, '' AS comment FROM supplier UNION ALL SELECT s_suppkey, 13, 'NT_GET_' || s_nationkey, 'in, out', '' FROM supplier")
def analyzer_calls(spark, d):
    return analyze.service_calls(_analyzed(spark, d)).select("name", "line_no", "callee", "args", "comment")


@query("analyzer_sql", "SELECT s_suppkey AS name, 8 AS line_no, 'SELECT' AS operation, 'EXEC SQL SELECT BAL INTO :v FROM TB_SUPPLIER;' AS raw_sql, 'TB_SUPPLIER' AS tables, 'v' AS into_vars, 'read' AS comment, '' AS condition FROM supplier")
def analyzer_sql(spark, d):
    s = analyze.sql_statements(_analyzed(spark, d))
    return s.select("name", "line_no", "operation", "raw_sql", F.array_join("tables", ",").alias("tables"), F.array_join("into_vars", ",").alias("into_vars"), "comment", "condition")


#: Bodies with a condition above a statement for every third part, a comment for every second, and two declared variables.
SHAPED = r"""'{\n    EXEC SQL BEGIN DECLARE SECTION;\n    char v_' || p_size || '[4];\n    long n_row;\n    EXEC SQL END DECLARE SECTION;\n' ||
 CASE WHEN p_partkey % 3 = 0 THEN '    if (x > ' || p_size || ')\n    {\n' ELSE '    a = 1;\n' END || CASE WHEN p_partkey % 2 = 0 THEN '    /* part ' || p_partkey || ' */\n' ELSE '' END ||
 '    EXEC SQL DELETE FROM TB_P' || p_size || '\n        WHERE K = :v;\n}\n'"""


def _shaped(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS name", "'' AS description", f"{SHAPED} AS body")


@query(
    "analyzer_conditions",
    """SELECT p_partkey AS name, 7 + CAST(p_partkey % 3 = 0 AS INT) + CAST(p_partkey % 2 = 0 AS INT) AS line_no, 'EXEC SQL DELETE FROM TB_P' || p_size || ' WHERE K = :v;' AS raw_sql,
 CASE WHEN p_partkey % 2 = 0 THEN 'part ' || p_partkey ELSE '' END AS comment, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'if (x > ' || p_size || ')' ELSE '' END AS condition FROM part""",
)
def analyzer_conditions(spark, d):
    return analyze.sql_statements(_shaped(spark, d)).where("operation = 'DELETE'").select("name", "line_no", "raw_sql", "comment", "condition")


@query("analyzer_host_variables", "SELECT p_partkey AS name, 'v_' || p_size || ',n_row' AS host_variables FROM part")
def analyzer_host_variables(spark, d):
    return analyze.summary(_shaped(spark, d)).select("name", F.array_join("host_variables", ",").alias("host_variables"))


@query("tables_touched", f"WITH {USAGE} SELECT DISTINCT table_name, operation FROM usage WHERE function_name = 'S1'")
def tables_touched(spark, d):
    return graph.tables_used(usage(spark, d), "S1")
