"""Derived views over the driver tables: the same SQL text runs in both engines."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
#: Most characters of a document's text that its title in ``articles_v`` takes.
TITLE_CHARS = 180

VIEWS["articles_v"] = """
SELECT d.doc_id AS seq,
       concat('https://src', CAST((d.doc_id - d.doc_id % 2) % 7 AS STRING), '.example.ng/', CAST(d.doc_id - d.doc_id % 2 AS STRING)) AS url,
       CASE WHEN d.doc_id % 12 = 7 THEN 'Home' ELSE concat(CASE d.doc_id % 12
         WHEN 0 THEN 'Holding company acquires 60% stake in football club'
         WHEN 1 THEN 'Striker scores twice as Lagoon FC beat Hill FC 3-1'
         WHEN 2 THEN 'Actress and musician announce star-studded wedding'
         WHEN 3 THEN 'Federal ministry appoints new Permanent Secretary'
         WHEN 4 THEN 'Regulator opens investigation into fraud and bribery'
         WHEN 5 THEN 'Board approves merger and record profit for the quarter'
         WHEN 6 THEN 'Agency publishes tender and contract award notice'
         WHEN 8 THEN 'Director faces lawsuit and sanction after compliance issue'
         WHEN 9 THEN 'Pursuing the acquisition of a football team in Nigeria'
         WHEN 10 THEN 'Company announces layoffs, office closure and decline'
         ELSE 'Routine notice' END, ' ', replace(substr(d.text, 1, CAST(20 + (d.doc_id % 5) * 40 AS INT)), chr(10), ' ')) END AS title,
       d.text AS raw_text, d.lang, d.source, e.ts AS published_at,
       (d.doc_id * 13) % 101 AS risk_score,
       CASE d.doc_id % 5 WHEN 0 THEN 'Government' WHEN 1 THEN 'Company' WHEN 2 THEN 'Legal' WHEN 3 THEN 'Other' END AS category
FROM {documents} d JOIN {events} e ON d.doc_id = e.event_id
"""

VIEWS["psc_v"] = """
SELECT seq,
       CASE WHEN seq % 9 = 0 THEN upper(concat(' Holder ', CAST(k % 1100 AS STRING), ' ')) ELSE concat('Holder ', CAST(k % 1100 AS STRING)) END AS person_name,
       concat('Company ', CAST(k % 150 AS STRING)) AS company,
       CASE WHEN k % 13 = 0 THEN '' ELSE 'Ownership of shares' END AS nature_of_control,
       CASE WHEN k % 11 = 0 THEN '' WHEN k % 17 = 0 THEN 'N/A'
            ELSE concat(CAST(CAST((p - p % 10) / 10 AS BIGINT) AS STRING), '.', CAST(p % 10 AS STRING), '%') END AS percentage,
       CASE WHEN k % 4 = 0 THEN '11.0%' ELSE '' END AS direct_pct,
       CASE WHEN k % 4 = 0 THEN '12.5%' ELSE '' END AS indirect_pct,
       CASE WHEN k % 6 = 0 THEN '88.0%' WHEN k % 6 = 1 THEN '24.0%' ELSE '' END AS voting_pct,
       CASE k % 5 WHEN 0 THEN 'Direct Holding' WHEN 1 THEN 'Meridian Trust (Mauritius) Limited'
            WHEN 2 THEN 'Plain Industries Limited' WHEN 3 THEN 'Coastal Nominees Limited' ELSE '' END AS vehicle,
       CASE WHEN k % 7 = 0 THEN 'Earlier Holder' ELSE '' END AS previous_holder,
       CASE WHEN k % 3 = 0 THEN 'Increased Control' ELSE 'Disclosed' END AS change_type,
       CASE WHEN k % 10 = 0 THEN 'Yes - exposed' ELSE 'No' END AS pep_status,
       CASE WHEN k % 2 = 0 THEN concat('REF/', CAST(k AS STRING)) ELSE '' END AS filing_ref,
       concat('2024-', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '-01') AS date,
       CASE WHEN k % 97 = 0 THEN 'seed' ELSE 'extracted' END AS source
FROM (SELECT seq, k, CASE WHEN k % 19 < 3 THEN 35 + k % 15 WHEN k % 19 < 11 THEN (k * 31) % 250 ELSE (k * 7919) % 1000 END AS p
      FROM (SELECT c_custkey AS seq,
                   CASE WHEN c_custkey % 9 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END AS k
            FROM {customer}) u) t
"""

VIEWS["relations_v"] = """
SELECT event_id AS seq, event_id % 1000 AS article_id, ts,
       concat('Person ', CAST(user_id AS STRING)) AS person,
       concat('Company ', CAST((event_id * 7 + user_id) % 40 AS STRING)) AS company,
       CASE event_type WHEN 'signup' THEN 'appointed' WHEN 'error' THEN 'resigned from'
            WHEN 'purchase' THEN 'acquired' WHEN 'view' THEN 'partnered with' ELSE 'investigating' END AS predicate
FROM {events}
"""

VIEWS["procurement_v"] = """
SELECT o_orderkey AS seq, concat('Agency ', CAST(o_custkey % 25 AS STRING)) AS agency,
       concat('Company ', CAST(o_orderkey % 150 AS STRING)) AS contractor,
       o_totalprice AS amount, o_orderdate AS awarded_at
FROM {orders}
"""

VIEWS["gold_pred_v"] = """
SELECT l.doc_id AS seq, l.quality = 1 AS gold_relevant,
       CASE WHEN l.doc_id % 8 = 0 THEN l.quality <> 1 ELSE l.quality = 1 END AS pred_relevant,
       CASE l.doc_id % 3 WHEN 0 THEN 'Company' WHEN 1 THEN 'Legal' ELSE 'Other' END AS gold_category,
       CASE l.doc_id % 4 WHEN 0 THEN 'Company' WHEN 1 THEN 'Legal' ELSE 'Other' END AS pred_category,
       (l.doc_id * 13) % 101 AS gold_risk, (l.doc_id * 17) % 101 AS pred_risk,
       CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE 'reviewer' END AS verified_by
FROM {labels} l
"""

# Entity dictionary: every capitalised long word, numbered by the document it is met in first and its place among that document's new ones.
VIEWS["dictionary_v"] = """
SELECT doc * 1048576 + r AS entity_seq, name, CASE (doc + r) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'agency' END AS type
FROM (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY name) AS r
  FROM (SELECT min(doc_id) AS doc, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]{{6,}})', 1)) AS name FROM {documents}) n GROUP BY name) m) k
"""

# Entity names as they come out of extraction: outlets, furniture, agencies, plain names.
VIEWS["names_v"] = """
SELECT s_suppkey AS seq,
       CASE s_suppkey % 14 WHEN 0 THEN 'The Guardian Nigeria' WHEN 1 THEN ' Archives ' WHEN 2 THEN concat('Ministry of Works ', s_name)
            WHEN 3 THEN concat(s_name, ' Punch Bowl Ltd') WHEN 4 THEN '' WHEN 5 THEN 'Latest  News'
            WHEN 6 THEN concat('CEO ', s_name) WHEN 7 THEN concat('Chief Executive Officer Managing Director ', s_name)
            WHEN 8 THEN 'Judge Al' WHEN 9 THEN concat('Federal Board ', s_name) WHEN 10 THEN concat('Premier League ', s_name)
            WHEN 11 THEN concat('Securities Commission ', s_name) WHEN 12 THEN concat('Board of Trade ', s_name) ELSE s_name END AS name
FROM {supplier}
"""

# Publication dates as feeds write them.
VIEWS["dates_v"] = """
SELECT event_id AS seq, ts,
       CASE event_id % 12
         WHEN 0 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8))
         WHEN 1 THEN substr(CAST(ts AS STRING), 1, 19)
         WHEN 2 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), 'Z')
         WHEN 3 THEN concat(substr(CAST(ts AS STRING), 1, 19), '.250')
         WHEN 4 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), '.250+01:00')
         WHEN 5 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), '+01:00')
         WHEN 6 THEN concat('Mon, ', substr(CAST(ts AS STRING), 9, 2), ' Jan ', substr(CAST(ts AS STRING), 1, 4), ' ', substr(CAST(ts AS STRING), 12, 8), ' GMT')
         WHEN 7 THEN concat(substr(CAST(ts AS STRING), 9, 2), ' Jan ', substr(CAST(ts AS STRING), 1, 4), ' ', substr(CAST(ts AS STRING), 12, 8), ' +0100')
         WHEN 8 THEN concat(substr(CAST(ts AS STRING), 9, 2), '/01/', substr(CAST(ts AS STRING), 1, 4))
         WHEN 9 THEN 'yesterday evening'
         WHEN 10 THEN ''
         ELSE NULL END AS published
FROM {events}
"""

_WORD = {name: re.compile(rf"\b{name}\b") for name in VIEWS}


def with_views(sql: str) -> str:
    """Check SQL with the derived views it uses put in front as CTEs."""
    used = [n for n, pat in _WORD.items() if pat.search(sql)]
    names = {t: t for t in BASE_TABLES}
    ctes = [f"{n} AS ({VIEWS[n].strip().format(**names)})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """The driver's parquet tables and the derived views, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str, **instead: DataFrame) -> DataFrame:
        # One of the few words that the two engines do not share.
        text = VIEWS[name].replace("unnest(", "explode(")
        used = {t: instead.get(t, self.base(t)) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text.replace("{{", "{").replace("}}", "}") if not used else text, **used)

    def headlines(self) -> DataFrame:
        """``articles_v`` without ``raw_text``: only the leading characters that a title takes go through the join."""
        leads = self.documents.withColumn("text", F.left("text", F.lit(TITLE_CHARS)))
        return self.view("articles_v", documents=leads).drop("raw_text")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
