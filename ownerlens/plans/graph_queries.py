"""Graph and linkage operators as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S
from ownerlens.operators import graph as G, links as L
from ownerlens.plans import sqltext as Q
from ownerlens.plans.extract_queries import MENTIONS_SQL, mentions
from ownerlens.plans.feed_queries import REPORT_WINDOW_SQL, report_articles
from ownerlens.plans.registry import query

c = F.col


def graph_inputs(t):
    people = t.relations_v.filter("predicate = 'appointed'").select(
        "seq", c("person").alias("name"), c("company").alias("organization"),
        F.when(c("seq") % 2 == 0, "Director").alias("position"))
    companies = t.orders.select(
        c("o_orderkey").alias("seq"),
        F.when(c("o_orderkey") % 5 == 0, F.upper(F.concat(F.lit("Company "), (c("o_orderkey") % 60).cast("string"))))
        .otherwise(F.concat(F.lit(" Company "), (c("o_orderkey") % 60).cast("string"))).alias("company"),
        F.element_at(F.array(*[F.lit(x) for x in V.RISK_LEVELS]), (c("o_orderkey") % 4 + 1).cast("int")).alias("risk_level"))
    return companies, t.procurement_v, people, t.psc_v, t.procurement_v


def graph(t):
    companies, agencies, people, holdings, deals = graph_inputs(t)
    return G.vertices(companies, agencies, people, holdings, deals), G.edges(people, holdings, deals)


def _id(x):
    return f"left(md5(lower(trim({x}))), 12)"


GRAPH_SQL = f"""
 people_v AS (SELECT seq, person AS name, company AS organization, CASE WHEN seq % 2 = 0 THEN 'Director' END AS position FROM relations_v WHERE predicate = 'appointed'),
 comp_v AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN upper(concat('Company ', CAST(o_orderkey % 60 AS STRING))) ELSE concat(' Company ', CAST(o_orderkey % 60 AS STRING)) END AS company,
   ['Low', 'Medium', 'High', 'Critical'][o_orderkey % 4 + 1] AS risk_level FROM orders),
 cand_v AS (SELECT trim(company) AS label, 'company' AS type, risk_level AS risk, 0 AS p, seq FROM comp_v
  UNION ALL SELECT agency, 'agency', 'Low', 1, seq FROM procurement_v
  UNION ALL SELECT name, 'person', 'Low', 2, seq FROM people_v UNION ALL SELECT organization, 'company', 'Low', 2, seq FROM people_v
  UNION ALL SELECT trim(person_name), 'psc', 'High', 3, seq FROM psc_v UNION ALL SELECT company, 'company', 'Medium', 3, seq FROM psc_v
  UNION ALL SELECT agency, 'agency', 'Low', 4, seq FROM procurement_v UNION ALL SELECT contractor, 'company', 'Low', 4, seq FROM procurement_v),
 node_v AS (SELECT {_id('label')} AS id, label, type, risk FROM cand_v QUALIFY row_number() OVER (PARTITION BY {_id('label')} ORDER BY p, seq, type, label) = 1),
 ecand_v AS (SELECT concat(name, '-', organization, '-works') AS k, name AS s, organization AS d, concat('Appointed as ', coalesce(position, 'Executive')) AS label, 0 AS p, seq FROM people_v
  UNION ALL SELECT concat(trim(person_name), '-', company, '-psc'), trim(person_name), company, CASE WHEN percentage <> '' THEN concat('PSC: ', percentage) ELSE nature_of_control END, 1, seq FROM psc_v
  UNION ALL SELECT concat(contractor, '-', agency, '-contract'), contractor, agency, 'Contract Awardee', 2, seq FROM procurement_v),
 edge_v AS (SELECT {_id('k')} AS id, {_id('s')} AS src, {_id('d')} AS dst, label FROM ecand_v QUALIFY row_number() OVER (PARTITION BY {_id('k')} ORDER BY p, seq, label) = 1)"""


@query("gr01_vertices", f"WITH {GRAPH_SQL} SELECT id, label, type, risk FROM node_v")
def gr01(t):
    return graph(t)[0]


@query("gr02_edges", f"WITH {GRAPH_SQL} SELECT id, src, dst, label FROM edge_v")
def gr02(t):
    return graph(t)[1]


_VALID = """ok_v AS (SELECT * FROM edge_v WHERE src IN (SELECT id FROM node_v) AND dst IN (SELECT id FROM node_v)),
 deg_v AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ok_v UNION ALL SELECT dst FROM ok_v) e GROUP BY id)"""


@query("gr03_degree", f"""WITH {GRAPH_SQL}, {_VALID} SELECT id, coalesce(degree, 0) AS degree, 12 + least(coalesce(degree, 0) * 3, 16) AS size FROM node_v LEFT JOIN deg_v USING (id)""")
def gr03(t):
    nodes, edge_rows = graph(t)
    return G.degrees(edge_rows, nodes).select("id", "degree", "size")


@query("agg13_degree_histogram", f"""WITH {GRAPH_SQL}, {_VALID} SELECT coalesce(degree, 0) AS degree, count(*) AS n FROM node_v LEFT JOIN deg_v USING (id) GROUP BY 1""")
def agg13(t):
    nodes, edge_rows = graph(t)
    return G.degrees(edge_rows, nodes).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_valid_edges", f"""WITH {GRAPH_SQL}, {_VALID} SELECT 'edge' AS kind, id FROM ok_v
  UNION ALL SELECT 'neighbour', id FROM (SELECT dst AS id FROM ok_v WHERE src = {_id("'Company 7'")} UNION SELECT src FROM ok_v WHERE dst = {_id("'Company 7'")}) n""")
def jn13(t):
    from ownerlens.functions import text as T

    nodes, edge_rows = graph(t)
    ok = G.valid_edges(edge_rows, nodes)
    near = G.neighbours(ok, T.node_id(F.lit("Company 7")))
    return ok.select(F.lit("edge").alias("kind"), "id").unionAll(near.select(F.lit("neighbour").alias("kind"), "id"))


_STATE = """ev_v AS (SELECT seq, person, company, predicate FROM relations_v WHERE predicate IN ('appointed', 'resigned from')),
 exec_v AS (SELECT company, person FROM (SELECT *, row_number() OVER (PARTITION BY company, person ORDER BY seq DESC) AS rn FROM ev_v) x WHERE rn = 1 AND predicate = 'appointed'),
 hist_v AS (SELECT person, company, min(seq) AS seq FROM ev_v WHERE predicate = 'appointed' GROUP BY 1, 2),
 pos_v AS (SELECT person, seq, concat('Executive at ', company) AS position FROM hist_v UNION ALL SELECT person, seq, concat('Former Executive at ', company) FROM ev_v WHERE predicate = 'resigned from')"""


@query("gr05_employment_state", f"""WITH {_STATE} SELECT 'executive' AS kind, company AS a, person AS b FROM exec_v
  UNION ALL SELECT 'history', person, company FROM hist_v
  UNION ALL SELECT 'position', person, arg_max(position, seq) FROM pos_v GROUP BY person""")
def gr05(t):
    r = t.relations_v

    def rows(kind, df, a, b):
        return df.select(F.lit(kind).alias("kind"), c(a).alias("a"), c(b).alias("b"))

    return (
        rows("executive", G.executives(r), "company", "person")
        .unionAll(rows("history", G.career_history(r), "person", "company"))
        .unionAll(rows("position", G.current_position(r), "person", "position"))
    )


# ------------------------------------------------------------------ links

# Ends of relations in several spellings; some subjects are known to nobody.
_REL = """rel_v AS (SELECT seq, article_id, predicate, CASE predicate WHEN 'resigned from' THEN person WHEN 'investigating' THEN concat('Agency ', CAST(seq % 12 AS STRING)) ELSE company END AS subject,
   CASE predicate WHEN 'appointed' THEN person WHEN 'acquired' THEN concat('Company ', CAST(seq % 31 AS STRING)) WHEN 'partnered with' THEN concat('Company ', CAST(seq % 31 AS STRING)) ELSE company END AS object FROM relations_v),
 typed_v AS (SELECT *, CASE predicate WHEN 'resigned from' THEN 'person' WHEN 'investigating' THEN 'agency' ELSE 'company' END AS st,
   CASE WHEN predicate = 'appointed' THEN 'person' ELSE 'company' END AS ot FROM rel_v),
 dim_v AS (SELECT type, name, min(seq) AS entity_id FROM (SELECT st AS type, subject AS name, seq FROM typed_v UNION ALL SELECT ot, object, seq FROM typed_v) d GROUP BY 1, 2),
 spelt_v AS (SELECT seq, article_id, predicate, st, ot, CASE WHEN seq % 400 = 7 THEN md5(CAST(seq % 2800 AS STRING)) WHEN seq % 4 = 1 THEN upper(subject) WHEN seq % 4 = 2 THEN concat('The ', subject) WHEN seq % 4 = 3 THEN concat(' ', subject, ' ') ELSE subject END AS subject,
   CASE seq % 3 WHEN 1 THEN lower(object) WHEN 2 THEN concat('THE ', object) ELSE object END AS object FROM typed_v),
 one_v AS (SELECT * FROM spelt_v QUALIFY row_number() OVER (PARTITION BY article_id, subject, predicate, object ORDER BY seq) = 1)"""


def relation_rows(t):
    k, p = c("seq"), c("predicate")
    other = F.concat(F.lit("Company "), (k % 31).cast("string"))
    return t.relations_v.select(
        "seq", "article_id", "predicate",
        F.when(p == "resigned from", c("person")).when(p == "investigating", F.concat(F.lit("Agency "), (k % 12).cast("string"))).otherwise(c("company")).alias("subject"),
        F.when(p == "appointed", c("person")).when(p.isin("acquired", "partnered with"), other).otherwise(c("company")).alias("object"))


def spelt_relations(t):
    k = c("seq")
    subject = (F.when(k % 400 == 7, F.md5((k % 2800).cast("string"))).when(k % 4 == 1, F.upper("subject"))
               .when(k % 4 == 2, F.concat(F.lit("The "), c("subject"))).when(k % 4 == 3, F.concat(F.lit(" "), c("subject"), F.lit(" "))).otherwise(c("subject")))
    obj = F.when(k % 3 == 1, F.lower("object")).when(k % 3 == 2, F.concat(F.lit("THE "), c("object"))).otherwise(c("object"))
    return relation_rows(t).withColumns({"subject": subject, "object": obj})


def entity_dim(t):
    s, o = L.endpoint_types(c("predicate"))
    rows = relation_rows(t)
    ends = rows.select(s.alias("type"), c("subject").alias("name"), "seq").unionAll(rows.select(o.alias("type"), c("object").alias("name"), "seq"))
    return ends.groupBy("type", "name").agg(F.min("seq").alias("entity_id")).withColumn("aliases", F.array("name", F.concat(F.lit("The "), c("name"))))


@query("jn05_relation_endpoints", f"""WITH {_REL}, alias_v AS (SELECT type, lower(name) AS key, min(entity_id) AS entity_id FROM (SELECT type, name, entity_id FROM dim_v UNION ALL SELECT type, concat('The ', name), entity_id FROM dim_v) a GROUP BY 1, 2),
 end_v AS (SELECT st AS type, trim(subject) AS name, seq FROM one_v UNION ALL SELECT ot, trim(object), seq FROM one_v),
 new_v AS (SELECT type, name, (SELECT max(entity_id) FROM dim_v) + row_number() OVER (ORDER BY min(seq), type, name) AS entity_id
   FROM end_v e WHERE NOT EXISTS (SELECT 1 FROM alias_v a WHERE a.type = e.type AND a.key = lower(e.name)) GROUP BY 1, 2),
 all_v AS (SELECT e.type, e.name, coalesce(d.entity_id, a.entity_id, n.entity_id) AS entity_id, CASE WHEN d.entity_id IS NOT NULL THEN 'exact' WHEN a.entity_id IS NOT NULL THEN 'alias' ELSE 'new' END AS stage
   FROM (SELECT DISTINCT type, name FROM end_v) e LEFT JOIN dim_v d ON d.type = e.type AND d.name = e.name LEFT JOIN alias_v a ON a.type = e.type AND a.key = lower(e.name) LEFT JOIN new_v n ON n.type = e.type AND n.name = e.name)
 SELECT o.seq, o.subject, o.predicate, o.object, s.entity_id AS subject_id, s.stage AS subject_stage, b.entity_id AS object_id, b.stage AS object_stage FROM one_v o
  LEFT JOIN all_v s ON s.type = o.st AND s.name = trim(o.subject) LEFT JOIN all_v b ON b.type = o.ot AND b.name = trim(o.object)""")
def jn05(t):
    return L.resolved_relations(spelt_relations(t), entity_dim(t)).select("seq", "subject", "predicate", "object", "subject_id", "subject_stage", "object_id", "object_stage")


@query("jn06_event_bridge", f"WITH {MENTIONS_SQL} SELECT seq AS event_id, entity_seq AS entity_id, type, CAST(0.9 AS DOUBLE) AS confidence FROM mention_v")
def jn06(t):
    return L.event_bridge(mentions(t))


LINKED_SQL = f"""{MENTIONS_SQL}, win_v AS ({REPORT_WINDOW_SQL}),
 linked_v AS (SELECT m.seq AS event_id, m.entity_seq AS entity_id, m.type, m.name FROM mention_v m WHERE m.seq IN (SELECT seq FROM win_v))"""


def linked(t):
    rows = report_articles(t)  # the window first: mentions are looked for in its articles only
    return L.entities_of(rows, L.event_bridge(mentions(t, rows=rows)), t.dictionary_v)


@query("jn07_entities_of_articles", f"WITH {LINKED_SQL} SELECT event_id, entity_id, type, name FROM linked_v")
def jn07(t):
    return linked(t).select("event_id", "entity_id", "type", "name")


@query("agg11_trending", f"""WITH {LINKED_SQL}, n AS (SELECT type, name, count(*) AS n FROM linked_v GROUP BY 1, 2),
 kw AS (SELECT name, count(*) AS n FROM (SELECT category AS name FROM win_v WHERE category IS NOT NULL UNION ALL
   SELECT concat({Q.case_floor('risk_score', V.RISK_FLOORS, 'Low')}, ' Risk') FROM win_v) k GROUP BY 1)
 SELECT type, name, n FROM n QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, name) <= 5
 UNION ALL SELECT 'keyword', name, n FROM (SELECT * FROM kw ORDER BY n DESC, name LIMIT 5) k""")
def agg11(t):
    words = L.trending_keywords(report_articles(t).withColumn("risk_level", S.risk_bucket(c("risk_score"))))
    return L.trending(linked(t)).select("type", "name", "n").unionAll(words.select(F.lit("keyword").alias("type"), "name", "n"))


@query("agg12_new_entities", f"""WITH {LINKED_SQL} SELECT count(DISTINCT entity_id) FILTER (type = 'company') AS new_companies,
  count(DISTINCT entity_id) FILTER (type = 'agency') AS new_agencies FROM linked_v""")
def agg12(t):
    return L.new_entities(linked(t))
