"""Named queries over the tables of a directory, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commstream.config import Mode, RunConfig
from commstream.operators import aggregate, graph, hierarchy, movement, refine
from commstream.operators.components import connected_components
from commstream.plans import dynamic, engine, gate, quality, validate
from commstream.sources import edges as reading
from commstream.sources import fixtures as fx
from commstream.sources import sinks
from commstream.storage import materialize, shared_dir
from commstream.streaming import maintain as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, *parts: str):
    """Register a function as a query; parts name the fixtures that its SQL reads."""

    def put(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            needed = [fx.SQL[p] for p in parts]
            recursive = "RECURSIVE " if "UNION" in sql and "walk" in sql else ""
            own = sql.strip()
            if own.startswith("WITH "):
                own = ", " + own[5:] if needed else own
            ORACLES[f"q_{f.__name__}"] = (f"WITH {recursive}" + ", ".join(needed) + " " + own) if needed else own
        return f

    return put


def _identity(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", F.col("v").alias("c"))


# --- sources and graph tables ---------------------------------------------------------------------------------------


@_query("SELECT src, dst, w FROM nation_e", "nation")
def edges_canonical(spark: SparkSession, d: str) -> DataFrame:
    return fx.nation_edges(spark, d)


@_query("SELECT src, dst, w FROM user_e", "arcs", "user")
def edges_user(spark, d):
    return fx.user_edges(spark, d)


@_query("SELECT src, dst, w FROM doc_e", "doc")
def edges_doc(spark, d):
    return fx.doc_edges(spark, d)


@_query("SELECT v, u, CAST(sum(w) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n FROM (SELECT src AS v, dst AS u, w FROM nation_e UNION ALL SELECT dst, src, w FROM nation_e) AS a GROUP BY 1, 2", "nation")
def adjacency_symmetric(spark, d):
    return graph.symmetric(fx.nation_edges(spark, d)).groupBy("v", "u").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


@_query("SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM arcs WHERE src <= dst GROUP BY 1, 2", "arcs")
def half_arc_filter(spark, d):
    return graph.half_arcs(fx.user_arcs(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("SELECT src, dst, CAST(CASE WHEN w % 2 = 0 THEN w ELSE 1 END AS BIGINT) AS w FROM user_e", "arcs", "user")
def edge_list_parse(spark, d):
    text = fx.user_edges(spark, d).select(F.when(F.col("w") % 2 == 0, F.concat_ws("\t ", "src", "dst", "w")).otherwise(F.concat_ws("  ", "src", "dst")).alias("value"))
    return graph.weighted(reading.parsed(text).where("ok"))


@_query("""WITH names AS (SELECT DISTINCT name FROM (SELECT 'c' || o_custkey AS name FROM orders UNION ALL SELECT 's' || o_orderpriority FROM orders) AS n),
  ids AS (SELECT name, CAST(row_number() OVER (ORDER BY md5(name), name) - 1 AS BIGINT) AS v FROM names)
  SELECT a.v AS src, b.v AS dst, CAST(count(*) AS BIGINT) AS n, CAST(max(t.n_ids) AS BIGINT) AS n_ids FROM orders JOIN ids a ON a.name = 'c' || o_custkey JOIN ids b ON b.name = 's' || o_orderpriority, (SELECT count(*) AS n_ids FROM ids) AS t GROUP BY 1, 2""")
def projection_dense_ids(spark, d):
    o = fx.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "o_orderpriority").alias("b"))
    found, ids = reading.project(o, "a", "b")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ids.agg(F.count("*").alias("n_ids"))))


@_query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def invalid_endpoints(spark, d):
    e = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("src"), F.col("o_custkey").cast("long").alias("dst"))
    return graph.unknown_endpoints(e, fx.table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("long").alias("v")))


_DEG = "WITH deg AS (SELECT v, CAST(sum(w) AS BIGINT) AS d FROM (SELECT src AS v, w FROM nation_e UNION ALL SELECT dst, w FROM nation_e) AS a GROUP BY v), m AS (SELECT CAST(2 * sum(w) AS BIGINT) AS m2 FROM nation_e)"


@_query(_DEG + " SELECT v, coalesce(d, 0) AS d FROM regions LEFT JOIN deg USING (v)", "nation", "regions")
def degree(spark, d):
    return graph.degrees(fx.nation_edges(spark, d), fx.nations(spark, d))


@_query("SELECT r.v, CAST(count(a.v) AS BIGINT) AS n FROM regions r LEFT JOIN (SELECT src AS v FROM nation_e UNION ALL SELECT dst FROM nation_e) AS a ON a.v = r.v GROUP BY r.v", "nation", "regions")
def row_length(spark, d):
    return graph.row_lengths(fx.nation_edges(spark, d), fx.nations(spark, d))


@_query("SELECT CAST(2 * sum(w) AS BIGINT) AS m2 FROM user_e", "arcs", "user")
def total_weight(spark, d):
    return graph.total_weight(fx.user_edges(spark, d))


@_query(_DEG + " SELECT c, CAST(sum(d) AS BIGINT) AS dc FROM regions JOIN deg USING (v) GROUP BY c", "nation", "regions")
def community_degree(spark, d):
    return graph.community_degrees(graph.degrees(fx.nation_edges(spark, d)), fx.regions(spark, d))


@_query("""SELECT CAST(count(*) AS BIGINT) AS n_edges, CAST(sum(w) AS BIGINT) AS sum_w, CAST(sum((src * 1000003 + dst * 10007 + w * 101) % 2147483647) AS BIGINT) AS mixed FROM user_e""", "arcs", "user")
def checksum(spark, d):
    return graph.checksum(fx.user_edges(spark, d))


_DELTA = "WITH delta AS (SELECT src, dst, CASE WHEN (src + dst) % 5 = 0 THEN -w ELSE w END AS w FROM user_e WHERE (src * 31 + dst) % 4 = 0)"


def _delta(spark, d):
    e = fx.user_edges(spark, d).where("(src * 31 + dst) % 4 = 0")
    return e.select("src", "dst", F.when((F.col("src") + F.col("dst")) % 5 == 0, -F.col("w")).otherwise(F.col("w")).alias("w"))


_AFTER = _DELTA + ", after_e AS (SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM user_e UNION ALL SELECT * FROM delta) AS x GROUP BY src, dst HAVING sum(w) <> 0)"


@_query(_AFTER + " SELECT src, dst, w FROM after_e", "arcs", "user")
def graph_apply_delta(spark, d):
    return graph.apply_delta(fx.user_edges(spark, d), _delta(spark, d))


@_query(_AFTER + " SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CAST(coalesce(a.w, 0) - coalesce(b.w, 0) AS BIGINT) AS w FROM after_e a FULL JOIN user_e b ON a.src = b.src AND a.dst = b.dst WHERE coalesce(a.w, 0) <> coalesce(b.w, 0)", "arcs", "user")
def graph_diff(spark, d):
    before = fx.user_edges(spark, d)
    return graph.difference(before, graph.apply_delta(before, _delta(spark, d)))


# --- movement -------------------------------------------------------------------------------------------------------

_NEAR = """WITH adj AS (SELECT src AS v, dst AS u, w FROM {e} WHERE src <> dst UNION ALL SELECT dst, src, w FROM {e} WHERE src <> dst),
 deg AS (SELECT v, CAST(sum(w) AS BIGINT) AS d FROM (SELECT src AS v, w FROM {e} UNION ALL SELECT dst, w FROM {e}) AS a GROUP BY v), m AS (SELECT CAST(2 * sum(w) AS BIGINT) AS m2 FROM {e}),
 f AS ({f}), nw AS (SELECT adj.v, f.c AS cand, CAST(sum(w) AS BIGINT) AS w FROM adj JOIN f ON f.v = adj.u GROUP BY 1, 2), dcs AS (SELECT c, CAST(sum(d) AS BIGINT) AS dc FROM f JOIN deg USING (v) GROUP BY c),
 gains AS (SELECT n.v, f.c AS cur, n.cand, CAST(m2 * (n.w - coalesce(i.w, 0)) + d * (a.dc - d - b.dc) AS BIGINT) AS gain
  FROM nw n JOIN f ON f.v = n.v JOIN deg ON deg.v = n.v JOIN dcs a ON a.c = f.c JOIN dcs b ON b.c = n.cand LEFT JOIN nw i ON i.v = n.v AND i.cand = f.c CROSS JOIN m WHERE n.cand <> f.c),
 best AS (SELECT v, cur, cand, gain FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, cand) AS r FROM gains WHERE gain > 0) AS x WHERE r = 1),
 touch AS (SELECT cur AS c, v, gain FROM best UNION ALL SELECT cand, v, gain FROM best), firsts AS (SELECT c, v FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY gain DESC, v) AS r FROM touch) AS x WHERE r = 1),
 accepted AS (SELECT best.* FROM best JOIN firsts a ON a.c = best.cur AND a.v = best.v JOIN firsts b ON b.c = best.cand AND b.v = best.v)"""
_REGION = _NEAR.format(e="nation_e", f="SELECT v, c FROM regions")
_DOC = _NEAR.format(e="doc_e", f="SELECT doc_id AS v, doc_id AS c FROM documents")


@_query(_REGION + " SELECT v, cand, w FROM nw", "nation", "regions")
def neighbor_comm_weight(spark, d):
    return movement.neighbour_weights(graph.neighbours(fx.nation_edges(spark, d)), fx.regions(spark, d))


def _doc(spark, d):
    e = materialize(fx.doc_edges(spark, d))
    return e, graph.neighbours(e), graph.degrees(e), _identity(fx.docs(spark, d)), graph.twice_total(e)


@_query(_REGION + " SELECT v, cur, cand, gain FROM gains", "nation", "regions")
def gain_candidates(spark, d):
    e = materialize(fx.nation_edges(spark, d))
    return movement.candidates(graph.neighbours(e), fx.regions(spark, d), graph.degrees(e), graph.twice_total(e))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """First-round best moves of documents by shared lines."""
    e, adj, deg, f, m2 = _doc(spark, d)
    return movement.best_moves(movement.candidates(adj, f, deg, m2))


@_query(_DOC + " SELECT v, cur, cand, gain FROM best", "doc")
def best_move_round1(spark, d):
    return flagship(spark, d)


@_query(_DOC + " SELECT v, cur, cand, gain FROM accepted", "doc")
def accept_round1(spark, d):
    return movement.accept_disjoint(materialize(flagship(spark, d)))


@_query(_DOC + """, role AS (SELECT c, side FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY gain DESC, v, side) AS r FROM (SELECT cur AS c, v, gain, 0 AS side FROM best UNION ALL SELECT cand, v, gain, 1 FROM best) AS t) AS x WHERE r = 1)
 SELECT best.v, best.cur, best.cand, best.gain FROM best JOIN role a ON a.c = best.cur AND a.side = 0 JOIN role b ON b.c = best.cand AND b.side = 1""", "doc")
def accept_roles_round1(spark, d):
    return movement.accept_roles(materialize(flagship(spark, d)))


@_query(_DOC + " SELECT c, CAST(sum(d) AS BIGINT) AS change FROM (SELECT cur AS c, -d AS d FROM accepted JOIN deg USING (v) UNION ALL SELECT cand, d FROM accepted JOIN deg USING (v)) AS x GROUP BY c HAVING sum(d) <> 0", "doc")
def degree_delta(spark, d):
    e, adj, deg, f, m2 = _doc(spark, d)
    return movement.degree_changes(movement.accept_disjoint(materialize(flagship(spark, d))), deg)


@_query(_DOC + """, f2 AS (SELECT f.v, coalesce(a.cand, f.c) AS c FROM f LEFT JOIN accepted a ON a.v = f.v)
 SELECT DISTINCT adj.u AS v FROM accepted a JOIN adj ON adj.v = a.v JOIN f2 ON f2.v = adj.u WHERE f2.c <> a.cand""", "doc")
def frontier_next(spark, d):
    e, adj, deg, f, m2 = _doc(spark, d)
    moves = materialize(movement.accept_disjoint(materialize(flagship(spark, d))))
    return movement.next_frontier(adj, movement.applied(f, moves), moves)


_ROUND = """, f{i} AS (SELECT f.v, coalesce(a.cand, f.c) AS c FROM f{p} f LEFT JOIN accepted{p} a ON a.v = f.v), nw{i} AS (SELECT adj.v, f.c AS cand, CAST(sum(w) AS BIGINT) AS w FROM adj JOIN f{i} f ON f.v = adj.u GROUP BY 1, 2),
 dcs{i} AS (SELECT c, CAST(sum(d) AS BIGINT) AS dc FROM f{i} JOIN deg USING (v) GROUP BY c), gains{i} AS (SELECT n.v, f.c AS cur, n.cand, CAST(m2 * (n.w - coalesce(i.w, 0)) + d * (a.dc - d - b.dc) AS BIGINT) AS gain
  FROM nw{i} n JOIN f{i} f ON f.v = n.v JOIN deg ON deg.v = n.v JOIN dcs{i} a ON a.c = f.c JOIN dcs{i} b ON b.c = n.cand LEFT JOIN nw{i} i ON i.v = n.v AND i.cand = f.c CROSS JOIN m WHERE n.cand <> f.c),
 best{i} AS (SELECT v, cur, cand, gain FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY gain DESC, cand) AS r FROM gains{i} WHERE gain > 0) AS x WHERE r = 1),
 touch{i} AS (SELECT cur AS c, v, gain FROM best{i} UNION ALL SELECT cand, v, gain FROM best{i}), firsts{i} AS (SELECT c, v FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY gain DESC, v) AS r FROM touch{i}) AS x WHERE r = 1),
 accepted{i} AS (SELECT b.* FROM best{i} b JOIN firsts{i} x ON x.c = b.cur AND x.v = b.v JOIN firsts{i} y ON y.c = b.cand AND y.v = b.v)"""


@_query(_DOC + _ROUND.format(i=1, p="") + _ROUND.format(i=2, p=1) + " SELECT f.v, coalesce(a.cand, f.c) AS c FROM f2 f LEFT JOIN accepted2 a ON a.v = f.v", "doc")
def move_rounds_3(spark, d):
    e, adj, deg, f, m2 = _doc(spark, d)
    return movement.move(e, adj, deg, f, m2, rounds=3, full=True)[0]


_SOUND = "SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_vertices, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_mapped"


@_query(_SOUND + ", CAST(0 AS BIGINT) AS n_stray, 1 AS ok, 1 AS raised")
def movement_fixpoint(spark, d):
    """Movement until no move is left at the frontier: a sound partition of higher quality than that of lone vertices."""
    e, adj, deg, f, m2 = _doc(spark, d)
    deg, adj = materialize(graph.degrees(e, fx.docs(spark, d))), materialize(adj)
    after = materialize(movement.move(e, adj, deg, f, m2, mode=Mode.THROUGHPUT)[0])
    raised = movement.quality_numerator(e, deg, after, m2) > movement.quality_numerator(e, deg, f, m2)
    return validate.partition_invariants(fx.docs(spark, d), after).select("n_vertices", "n_mapped", "n_stray", "ok", F.lit(int(raised)).alias("raised"))


@_query(_DELTA + " SELECT DISTINCT unnest([d.src, d.dst]) AS v FROM delta d JOIN segments a ON a.v = d.src JOIN segments b ON b.v = d.dst WHERE (d.w > 0 AND a.c <> b.c) OR (d.w < 0 AND a.c = b.c)", "arcs", "user", "segments")
def activation_delta(spark, d):
    return movement.activated(_delta(spark, d), fx.segments(spark, d))


@_query(_DELTA + " SELECT DISTINCT unnest([d.src, d.dst]) AS v FROM delta d JOIN segments a ON a.v = d.src JOIN segments b ON b.v = d.dst WHERE d.w < 0 AND a.c = b.c", "arcs", "user", "segments")
def affected_subcomm(spark, d):
    return movement.affected(_delta(spark, d), fx.segments(spark, d).select("v", F.col("c").alias("s")))


# --- quality and validation -----------------------------------------------------------------------------------------

_Q = "(SELECT round(sum(i / m2 - dc * dc / (m2 * m2)), 6) FROM (SELECT dc, coalesce(ins, 0.0) AS i FROM (SELECT c, CAST(sum(d) AS DOUBLE) AS dc FROM {f} JOIN deg USING (v) GROUP BY c) AS a LEFT JOIN (SELECT a.c, CAST(2 * sum(w) AS DOUBLE) AS ins FROM nation_e e JOIN {f} a ON a.v = e.src JOIN {f} b ON b.v = e.dst WHERE a.c = b.c GROUP BY a.c) AS b USING (c)) AS t, (SELECT CAST(m2 AS DOUBLE) AS m2 FROM m) AS mm)"


@_query(_DEG + f" SELECT {_Q.format(f='regions')} AS q, CAST((SELECT count(DISTINCT c) FROM regions) AS BIGINT) AS n_communities", "nation", "regions")
def modularity(spark, d):
    return quality.modularity(fx.nation_edges(spark, d), fx.regions(spark, d)).select(F.round("q", 6).alias("q"), "n_communities")


@_query("""SELECT round(sum(coalesce(ins, 0.0) - n * (n - 1) / 2.0), 6) AS cpm FROM (SELECT c, CAST(count(*) AS DOUBLE) AS n FROM regions GROUP BY c) AS s
  LEFT JOIN (SELECT a.c, CAST(sum(w) AS DOUBLE) AS ins FROM nation_e e JOIN regions a ON a.v = e.src JOIN regions b ON b.v = e.dst WHERE a.c = b.c GROUP BY a.c) AS i USING (c)""", "nation", "regions")
def cpm_quality(spark, d):
    return quality.constant_potts(fx.nation_edges(spark, d), fx.regions(spark, d)).select(F.round("cpm", 6).alias("cpm"))


@_query(_REGION + " SELECT v, cur, cand, gain FROM best", "nation", "regions")
def vertex_optimality_violations(spark, d):
    e = materialize(fx.nation_edges(spark, d))
    return quality.open_moves(e, graph.neighbours(e), fx.regions(spark, d))


@_query("SELECT CAST((SELECT count(*) FROM nation) AS BIGINT) AS n_vertices, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT v) AS BIGINT) AS n_mapped, CAST(0 AS BIGINT) AS n_stray, 1 AS ok FROM regions", "regions")
def partition_invariants(spark, d):
    return validate.partition_invariants(fx.nations(spark, d), fx.regions(spark, d))


@_query("SELECT a.v, a.c AS x, b.c AS y FROM regions a JOIN shifted b USING (v) WHERE a.c <> b.c", "regions", "shifted")
def partition_identity(spark, d):
    return validate.identity_violations(fx.regions(spark, d), fx.shifted(spark, d))


@_query("SELECT b.c AS s, CAST(count(DISTINCT a.c) AS BIGINT) AS n FROM regions a JOIN shifted b USING (v) GROUP BY b.c HAVING count(DISTINCT a.c) > 1", "regions", "shifted")
def nesting_violations(spark, d):
    return validate.nesting_violations(fx.shifted(spark, d).select("v", F.col("c").alias("s")), fx.regions(spark, d))


@_query(_DEG + f", qs AS (SELECT {_Q.format(f='regions')} AS a, {_Q.format(f='shifted')} AS b) SELECT a AS q_reference, b AS q_candidate, CAST(3 AS BIGINT) AS n_differ, CASE WHEN abs(b - a) <= 0.001 THEN 1 ELSE 0 END AS equivalent FROM qs", "nation", "regions", "shifted")
def equivalence_quality(spark, d):
    row = validate.equivalence(fx.nation_edges(spark, d), fx.nations(spark, d), fx.regions(spark, d), fx.shifted(spark, d), Mode.THROUGHPUT)
    return row.select(F.round("q_reference", 6).alias("q_reference"), F.round("q_candidate", 6).alias("q_candidate"), "n_differ", "equivalent")


# --- components and refinement --------------------------------------------------------------------------------------


@_query("""WITH both_e AS (SELECT src, dst FROM doc_e UNION ALL SELECT dst, src FROM doc_e), walk AS (SELECT src AS v, src AS r FROM both_e UNION SELECT e.dst, w.r FROM walk w JOIN both_e e ON e.src = w.v)
 SELECT v, min(r) AS component FROM walk GROUP BY v""", "doc")
def components(spark, d):
    return connected_components(fx.doc_edges(spark, d), "src", "dst")


_SRC = "WITH subs AS (SELECT doc_id AS v, min(doc_id) OVER (PARTITION BY source) AS s FROM documents)"


@_query(_SRC + " SELECT e.src, e.dst, e.w FROM doc_e e JOIN subs a ON a.v = e.src JOIN subs b ON b.v = e.dst WHERE a.s = b.s", "doc")
def intra_sub_edges(spark, d):
    s = fx.sources(spark, d)
    return refine.inside_edges(fx.doc_edges(spark, d), s, s.select("v", F.col("s").alias("c")))


_PIECES = _SRC + """, both_e AS (SELECT e.src, e.dst FROM doc_e e JOIN subs a ON a.v = e.src JOIN subs b ON b.v = e.dst WHERE a.s = b.s UNION ALL SELECT e.dst, e.src FROM doc_e e JOIN subs a ON a.v = e.src JOIN subs b ON b.v = e.dst WHERE a.s = b.s),
 walk AS (SELECT v, v AS r FROM subs UNION SELECT e.dst, w.r FROM walk w JOIN both_e e ON e.src = w.v), piece_of AS (SELECT v, min(r) AS piece FROM walk GROUP BY v), sized AS (SELECT s, piece, count(*) AS n FROM subs JOIN piece_of USING (v) GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, piece) AS r FROM sized)"""


def _pieces(spark, d):
    s = fx.sources(spark, d)
    return materialize(refine.pieces(fx.doc_edges(spark, d), s, s.select("v", F.col("s").alias("c")), fx.docs(spark, d)))


@_query(_PIECES + " SELECT s, piece FROM ranked WHERE r = 1", "doc")
def component_largest(spark, d):
    return refine.largest_pieces(_pieces(spark, d))


@_query(_PIECES + " SELECT piece, CAST(1000000 + row_number() OVER (ORDER BY piece) AS BIGINT) AS id FROM ranked WHERE r > 1", "doc")
def new_sub_ids(spark, d):
    return refine.new_ids(_pieces(spark, d), 1000000)


@_query("SELECT v, v AS s FROM regions WHERE v % 3 = 0", "regions")
def singletons(spark, d):
    return refine.singletons(fx.nations(spark, d).select("v", F.when(F.col("v") % 3 == 0, F.col("v")).otherwise(100 + F.col("v") % 2).alias("s")))


@_query(_PIECES + " SELECT s, CAST(count(*) AS BIGINT) AS pieces FROM sized GROUP BY s HAVING count(*) > 1", "doc")
def disconnected_subs(spark, d):
    s = fx.sources(spark, d)
    return validate.disconnected_subs(fx.doc_edges(spark, d), s, s.select("v", F.col("s").alias("c")))


@_query(_DEG + " SELECT c AS s, CAST(sum(d) AS BIGINT) AS ds FROM shifted JOIN deg USING (v) GROUP BY c", "nation", "shifted")
def sub_degree(spark, d):
    return refine.sub_degrees(graph.degrees(fx.nation_edges(spark, d)), fx.shifted(spark, d).select("v", F.col("c").alias("s")))


@_query(_DOC.replace("SELECT doc_id AS v, doc_id AS c FROM documents", "SELECT doc_id AS v, min(doc_id) OVER (PARTITION BY lang) AS c FROM documents") + """,
 inn AS (SELECT adj.* FROM adj JOIN f a ON a.v = adj.v JOIN f b ON b.v = adj.u WHERE a.c = b.c), cut AS (SELECT v AS s, CAST(sum(w) AS BIGINT) AS cut FROM inn GROUP BY v),
 tied AS (SELECT f.v AS s, d AS ds FROM f JOIN deg ON deg.v = f.v JOIN dcs ON dcs.c = f.c LEFT JOIN cut ON cut.s = f.v CROSS JOIN m WHERE m2 * coalesce(cut, 0) >= d * (dc - d))
 SELECT inn.v, inn.v AS cur, inn.u AS cand, CAST(m2 * sum(w) - deg.d * ds AS BIGINT) AS gain FROM inn JOIN deg ON deg.v = inn.v JOIN tied ON tied.s = inn.u CROSS JOIN m GROUP BY inn.v, inn.u, m2, deg.d, ds""", "doc")
def refine_candidates_round1(spark, d):
    e, adj, deg, f, m2 = _doc(spark, d)
    t = fx.table(spark, d, "documents")
    c = t.join(t.groupBy("lang").agg(F.min("doc_id").alias("c")), "lang").select(F.col("doc_id").alias("v"), "c")
    return refine.merge_moves(adj, f.select("v", F.col("v").alias("s")), c, graph.degrees(e, fx.docs(spark, d)), m2)


@_query(_DOC + " SELECT v, d, CAST(row_number() OVER (ORDER BY d, v) AS BIGINT) AS position FROM deg", "doc")
def degree_order(spark, d):
    return refine.degree_order(graph.degrees(fx.doc_edges(spark, d)))


# --- aggregation and hierarchy --------------------------------------------------------------------------------------

_SUPER = "SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, CAST(sum(w) AS BIGINT) AS w FROM {e} e JOIN {f} a ON a.v = e.src JOIN {f} b ON b.v = e.dst GROUP BY 1, 2"


@_query(_SUPER.format(e="nation_e", f="regions"), "nation", "regions")
def supergraph(spark, d):
    return aggregate.supergraph(fx.nation_edges(spark, d), fx.regions(spark, d).select("v", F.col("c").alias("s")))


@_query(f"WITH x AS ({_SUPER.format(e='nation_e', f='regions')}), y AS ({_SUPER.format(e='nation_e', f='shifted')}) SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, CAST(coalesce(y.w, 0) - coalesce(x.w, 0) AS BIGINT) AS w FROM x FULL JOIN y ON x.src = y.src AND x.dst = y.dst WHERE coalesce(x.w, 0) <> coalesce(y.w, 0)", "nation", "regions", "shifted")
def delta_superedges(spark, d):
    e = materialize(fx.nation_edges(spark, d))
    s = lambda f: f(spark, d).select("v", F.col("c").alias("s"))
    return aggregate.delta_superedges(e, e.limit(0), s(fx.regions), s(fx.shifted))


@_query(f"WITH x AS ({_SUPER.format(e='nation_e', f='regions')}), y AS ({_SUPER.format(e='nation_e', f='shifted')}) SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, CAST(coalesce(y.w, 0) - coalesce(x.w, 0) AS BIGINT) AS w FROM x FULL JOIN y ON x.src = y.src AND x.dst = y.dst WHERE coalesce(x.w, 0) <> coalesce(y.w, 0)", "nation", "regions", "shifted")
def supergraph_conservation(spark, d):
    e = materialize(fx.nation_edges(spark, d))
    s = lambda f: f(spark, d).select("v", F.col("c").alias("s"))
    return validate.conservation_violations(e, s(fx.regions), aggregate.supergraph(e, s(fx.shifted)))


@_query("SELECT v, c % 2 AS c FROM regions", "regions")
def def_update(spark, d):
    subs = fx.regions(spark, d).select("v", F.col("c").alias("s"))
    top = subs.select(F.col("s").alias("v"), (F.col("s") % 2).alias("c")).distinct()
    return hierarchy.push_down([subs], top)[0]


@_query("SELECT v, c AS l1, c % 2 AS l2 FROM regions", "regions")
def hierarchy_paths(spark, d):
    subs = fx.regions(spark, d).select("v", F.col("c").alias("s"))
    return hierarchy.paths([subs, subs.select(F.col("s").alias("v"), (F.col("s") % 2).alias("s")).distinct()])


# --- engine ---------------------------------------------------------------------------------------------------------

_FAST = RunConfig(mode=Mode.THROUGHPUT)


_SPLIT_DOC = """, doc_placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || src || ':' || dst), src, dst) - 1 AS position, count(*) OVER () AS total FROM doc_e),
 doc_parts AS (SELECT *, CAST(floor(total * 0.8) AS BIGINT) AS first FROM doc_placed), doc_before AS (SELECT sum(w) AS w FROM doc_parts WHERE position < first), doc_after AS (SELECT sum(w) AS w FROM doc_parts)"""


def _checks(state, vertices: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: vertices and mapped ones, weight of the lowest and of the highest level, and numbers of violations."""
    bottom, top = state.levels[0], state.levels[-1]
    found = [validate.conservation_violations(a.edges, a.subs, b.edges) for a, b in zip(state.levels, state.levels[1:], strict=False)]
    superedges = sum(x.count() for x in found)
    sums = validate.partition_invariants(vertices, partition).select("n_vertices", "n_mapped")
    for name, level in (("w_bottom", bottom), ("w_top", top)):
        sums = sums.crossJoin(level.edges.agg(F.sum("w").alias(name)))
    for name, rows in (("n_nesting", validate.nesting_violations(bottom.subs, bottom.mapping)), ("n_disconnected", validate.disconnected_subs(bottom.edges, bottom.subs, bottom.mapping))):
        sums = sums.crossJoin(rows.agg(F.count("*").alias(name)))
    return sums.withColumn("n_superedges", F.lit(superedges).cast("long"))


_SOUND_STATE = _SOUND + ", CAST((SELECT w FROM {w}) AS BIGINT) AS w_bottom, CAST((SELECT w FROM {w}) AS BIGINT) AS w_top, CAST(0 AS BIGINT) AS n_nesting, CAST(0 AS BIGINT) AS n_disconnected, CAST(0 AS BIGINT) AS n_superedges"


@_query("WITH doc_whole AS (SELECT sum(w) AS w FROM doc_e) " + _SOUND_STATE.format(w="doc_whole"), "doc")
def leiden_levels(spark, d):
    """All levels of a run from scratch, checked: every vertex placed, weight kept from level to level, no violation."""
    out = engine.run(fx.doc_edges(spark, d), fx.docs(spark, d), _FAST)
    return _checks(out.state, fx.docs(spark, d), out.partition())


@_query(_SOUND + ", CAST(0 AS BIGINT) AS n_unconnected", "doc")
def refined_communities(spark, d):
    """The refined sub-communities, checked: every vertex in one, none that its own edges do not connect."""
    level = engine.run(fx.doc_edges(spark, d), fx.docs(spark, d), _FAST).state.levels[0]
    own = level.subs.select("v", F.col("s").alias("c"))
    loose = validate.disconnected_subs(level.edges, level.subs, own).agg(F.count("*").alias("n_unconnected"))
    return validate.partition_invariants(fx.docs(spark, d), own).select("n_vertices", "n_mapped").crossJoin(loose)


def _changed(spark, d):
    """A run on the first 80 % of the edges, and the state after all others came as one batch."""
    edges = materialize(fx.doc_edges(spark, d))
    first = int(edges.count() * 0.8)
    parts = materialize(dynamic.shuffled(edges).select("src", "dst", "w", "position"))
    before = engine.run(parts.where(F.col("position") < first).drop("position"), fx.docs(spark, d), _FAST)
    return before, engine.maintain(before.state, parts.where(F.col("position") >= first).drop("position"), 0, _FAST), edges


@_query("WITH doc_whole AS (SELECT sum(w) AS w FROM doc_e) " + _SOUND_STATE.format(w="doc_whole") + ", 1 AS near_scratch", "doc")
def incremental_maintain(spark, d):
    """The state after a batch of a fifth of all edges, checked, its quality within 0.05 of a run from scratch."""
    _, after, edges = _changed(spark, d)
    scratch = engine.run(edges, fx.docs(spark, d), _FAST)
    return _checks(after.state, fx.docs(spark, d), after.partition()).withColumn("near_scratch", F.lit(int(abs(after.quality - scratch.quality) <= 0.05)))


@_query(_SOUND + ", CAST(0 AS BIGINT) AS n_differ, CAST(0 AS BIGINT) AS n_idle")
def change_feed(spark, d):
    """The feed of a batch, replayed: the old partition with the feed applied is the new one, and no row changes nothing."""
    before, after, _ = _changed(spark, d)
    feed = materialize(engine.changes(before.partition(), after.partition(), 0))
    applied = before.partition().join(feed.select("v", "new"), "v", "full_outer").select("v", F.coalesce("new", "c").alias("c"))
    sums = validate.partition_invariants(fx.docs(spark, d), applied).select("n_vertices", "n_mapped")
    for name, rows in (("n_differ", validate.identity_violations(applied, after.partition())), ("n_idle", feed.where(F.col("old").eqNullSafe(F.col("new"))))):
        sums = sums.crossJoin(rows.agg(F.count("*").alias(name)))
    return sums


@_query("""WITH own AS (SELECT src, dst, w FROM nation_e WHERE src <> dst), inner_e AS (SELECT src AS v, w FROM own JOIN regions a ON a.v = src JOIN regions b ON b.v = dst WHERE a.c = b.c UNION ALL SELECT dst, w FROM own JOIN regions a ON a.v = src JOIN regions b ON b.v = dst WHERE a.c = b.c),
 tie AS (SELECT v, sum(w) AS tie FROM inner_e GROUP BY v), dg AS (SELECT v, CAST(sum(w) AS BIGINT) AS d FROM (SELECT src AS v, w FROM nation_e UNION ALL SELECT dst, w FROM nation_e) AS a GROUP BY v), m AS (SELECT CAST(2 * sum(w) AS BIGINT) AS m2 FROM nation_e),
 dc AS (SELECT c, sum(d) AS dc FROM regions JOIN dg USING (v) GROUP BY c), loose AS (SELECT c, max(CASE WHEN m2 * coalesce(tie, 0) < d * (dc - d) THEN 1 ELSE 0 END) AS loose FROM regions JOIN dg USING (v) JOIN dc USING (c) LEFT JOIN tie USING (v) CROSS JOIN m GROUP BY c)
 SELECT round(avg(1 - loose), 6) AS dense_share FROM loose""", "nation", "regions")
def dense_share(spark, d):
    return quality.dense_share(materialize(fx.nation_edges(spark, d)), fx.regions(spark, d)).select(F.round("dense_share", 6).alias("dense_share"))


# --- changing graphs, metrics, gate ---------------------------------------------------------------------------------

_SPLIT = """WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || src || ':' || dst), src, dst) - 1 AS position, count(*) OVER () AS total FROM user_e),
 cut AS (SELECT *, CAST(floor(total * 0.8) AS BIGINT) AS first FROM placed), batched AS (SELECT src, dst, w, CAST(position AS BIGINT) AS position, CAST(CASE WHEN position < first THEN -1 ELSE (position - first) // 50 END AS BIGINT) AS batch_id, least(9, (total - first) // 50) AS eff FROM cut),
 parts AS (SELECT src, dst, w, position, batch_id FROM batched WHERE batch_id < eff), sizes AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS n_edges FROM parts GROUP BY 1), totals AS (SELECT batch_id, n_edges, CAST(sum(n_edges) OVER (ORDER BY batch_id) AS BIGINT) AS total_edges FROM sizes)"""


def _parts(spark, d):
    return dynamic.split(materialize(fx.user_edges(spark, d)), 0.8, 50, 9)


@_query(_SPLIT + " SELECT src, dst, w, position, batch_id FROM parts", "arcs", "user")
def shuffle_split(spark, d):
    return _parts(spark, d)


@_query(_SPLIT + " SELECT batch_id, n_edges, total_edges FROM totals", "arcs", "user")
def cumulative_batches(spark, d):
    return dynamic.batch_totals(_parts(spark, d))


@_query(_SPLIT + " SELECT batch_id, total_edges, CAST(greatest(total_edges - lag(total_edges, 1, 0) OVER (ORDER BY batch_id), 0) AS BIGINT) AS edges_added FROM totals", "arcs", "user")
def edges_added_lag(spark, d):
    return dynamic.edges_added(dynamic.batch_totals(_parts(spark, d)))


@_query(_SPLIT + """, last AS (SELECT max(batch_id) AS b FROM parts) SELECT batch_id, src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT batch_id, src, dst, w FROM parts UNION ALL SELECT batch_id + 3, src, dst, -w FROM parts, last WHERE batch_id + 3 <= b) AS x GROUP BY 1, 2, 3 HAVING sum(w) <> 0""", "arcs", "user")
def sliding_edge_window(spark, d):
    return dynamic.sliding_delta(materialize(_parts(spark, d)), 3)


_METRICS = """, metrics AS (SELECT batch_id AS batch_idx, total_edges, n_edges, n_edges / 8.0 AS a, total_edges / 4.0 AS b FROM totals)"""


def _metrics(spark, d):
    t = dynamic.batch_totals(_parts(spark, d))
    a, b = F.col("n_edges") / 8.0, F.col("total_edges") / 4.0
    return t.select(F.col("batch_id").alias("batch_idx"), F.col("n_edges").alias("edges_added"), "total_edges", a.alias("incremental_ms"), b.alias("scratch_ms"), (b / a).alias("speedup"))


@_query(_SPLIT + _METRICS + " SELECT CAST(sum(a) AS DOUBLE) AS incremental_ms, CAST(sum(b) AS DOUBLE) AS scratch_ms, round(CAST(avg(CAST(b AS DOUBLE) / CAST(a AS DOUBLE)) AS DOUBLE), 6) AS mean_speedup, round(CAST(sum(b) AS DOUBLE) / CAST(sum(a) AS DOUBLE), 6) AS total_speedup, round(CAST(median(CAST(b AS DOUBLE) / CAST(a AS DOUBLE)) AS DOUBLE), 6) AS median_speedup FROM metrics", "arcs", "user")
def benchmark_summary(spark, d):
    s = dynamic.summary(_metrics(spark, d))
    return s.select("incremental_ms", "scratch_ms", *[F.round(c, 6).alias(c) for c in ("mean_speedup", "total_speedup", "median_speedup")])


@_query(_SPLIT + _METRICS + ", heads AS (SELECT CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(n_edges) AS BIGINT) AS edges_added_all FROM totals) SELECT n_batches, edges_added_all, batch_idx, n_edges AS edges_added, total_edges, CAST(a AS DOUBLE) AS incremental_ms, CAST(b AS DOUBLE) AS scratch_ms FROM metrics, heads", "arcs", "user")
def batch_metrics_json(spark, d):
    """The JSON report, read back."""
    told = sinks.metrics_json(_metrics(spark, d), "user", {"ratio": "0.8", "batch": "50"})
    kind = "struct<dataset:string,setup:map<string,string>,summary:struct<n_batches:bigint,edges_added:bigint>,batches:array<struct<batch_idx:bigint,edges_added:bigint,total_edges:bigint,incremental_ms:double,scratch_ms:double>>>"
    read = told.select(F.from_json("value", kind).alias("r"))
    return read.select("r.summary.n_batches", F.col("r.summary.edges_added").alias("edges_added_all"), F.inline("r.batches"))


@_query(_SPLIT + ", users AS (SELECT count(DISTINCT user_id) AS n FROM events), sums AS (SELECT batch_id, total_edges, CAST(sum(w) AS BIGINT) AS w FROM parts JOIN totals USING (batch_id) GROUP BY 1, 2) SELECT batch_id AS batch_idx, n_edges AS edges_added, total_edges, CAST((SELECT n FROM users) AS BIGINT) AS nodes_in_graph, 1 AS sound FROM totals WHERE batch_id >= 0", "arcs", "user")
def replay(spark, d):
    """The replay of batches; times are left out, sound where the quality is one and both sides took time."""
    rows = dynamic.replay(_parts(spark, d), fx.users(spark, d), _FAST, together=min(4, spark.sparkContext.defaultParallelism))
    sound = F.col("modularity").between(-0.5, 1) & (F.col("incremental_ms") > 0) & (F.col("scratch_ms") > 0) & (F.abs(F.col("speedup") - F.col("scratch_ms") / F.col("incremental_ms")) < 1e-6)
    return rows.select("batch_idx", "edges_added", "total_edges", "nodes_in_graph", sound.cast("int").alias("sound"))


@_query(_SPLIT + _METRICS + " SELECT round(CAST(median(CAST(b AS DOUBLE) / CAST(a AS DOUBLE)) AS DOUBLE), 6) AS median_gain, CAST(count(*) AS BIGINT) AS n_batches, CASE WHEN median(CAST(b AS DOUBLE) / CAST(a AS DOUBLE)) >= 2 THEN 1 ELSE 0 END AS reaches, 0 AS eligible, 'LIVE_QUERY_SOURCE_INELIGIBLE_FOR_RELEASE_GATE' AS reason FROM metrics", "arcs", "user")
def compare_baseline(spark, d):
    m = materialize(_metrics(spark, d))
    row = gate.compare_baseline(m.select("batch_idx", F.col("scratch_ms").alias("seconds")), m.select("batch_idx", F.col("incremental_ms").alias("seconds")), "p1", True, "live")
    return row.select(F.round("median_gain", 6).alias("median_gain"), "n_batches", "reaches", "eligible", "reason")


def _streamed(stream: DataFrame) -> DataFrame:
    """All rows of an aggregated stream once its input is read."""
    spark, name = stream.sparkSession, f"counts_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def _deltas(spark, d):
    """Events as a stream of edge changes from each user to a type, some with weight."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"), F.length("event_type").cast("long").alias("dst"), (F.col("event_id") % 3).alias("w"))


@_query("SELECT CAST(user_id AS BIGINT) AS src, CAST(length(event_type) AS BIGINT) AS dst, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id % 3) AS BIGINT) AS w FROM events GROUP BY 1, 2")
def stream_edge_counts(spark, d):
    return _streamed(_deltas(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("w")))


@_query("SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, CAST(sum(event_id % 3) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_windows(spark, d):
    return _streamed(stream.windowed_counts(_deltas(spark, d), "6 hours")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "w", "n")


@_query("SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, CAST(sum(w) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 3 HOURS, ts) - to_hours(3 * k) AS s, event_id % 3 AS w FROM events, (VALUES (0), (1)) AS t(k)) AS x GROUP BY 1")
def stream_sliding_windows(spark, d):
    return _streamed(stream.windowed_counts(_deltas(spark, d), "6 hours", slide="3 hours")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "w", "n")


@_query("""SELECT profile_id, pinned, source, CASE WHEN NOT pinned THEN 0 WHEN source = 'live' THEN 0 ELSE 1 END AS eligible, CASE WHEN NOT pinned THEN 'UNPINNED_HARDWARE_PROFILE' WHEN source = 'live' THEN 'LIVE_QUERY_SOURCE_INELIGIBLE_FOR_RELEASE_GATE' END AS reason
 FROM (VALUES ('p1', true, 'file'), ('p1', true, 'live'), ('p2', false, 'live'), ('p2', false, 'snapshot'), ('p1', true, 'snapshot')) AS t(profile_id, pinned, source)""")
def release_gate(spark, d):
    rows = [("p1", True, "file"), ("p1", True, "live"), ("p2", False, "live"), ("p2", False, "snapshot"), ("p1", True, "snapshot")]
    return gate.eligible(spark.createDataFrame(rows, "profile_id string, pinned boolean, source string"))
