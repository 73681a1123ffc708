"""A whole run as a registered query."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.operators import extract as X, gates, run
from ownerlens.plans import sqltext as Q
from ownerlens.plans.extract_queries import _STORY_SCORES, stories
from ownerlens.plans.feed_queries import _FUNNEL
from ownerlens.plans.registry import query
from ownerlens.plans.text_queries import AS_OF, COUNTRY_SQL, FURNITURE_SQL
from ownerlens.session import scratch_path

c = F.col
_NAME = f"lower({Q.squeeze('name')})"


@query("run01_end_to_end", f"""WITH {_FUNNEL}, {_STORY_SCORES},
 gate_v AS (SELECT seq, url, NOT {Q.stub('nt', 'ns')} AND {COUNTRY_SQL.format(low='low', fold='folded')} AS ok FROM f),
 stored_v AS (SELECT url FROM articles_v WHERE seq % 9 = 4),
 new_v AS (SELECT g.seq FROM gate_v g JOIN f USING (seq) WHERE ok AND pub >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS AND g.url NOT IN (SELECT url FROM stored_v)
   QUALIFY row_number() OVER (PARTITION BY g.url ORDER BY g.seq) = 1),
 {Q.off_topic_ctes('imp_v', 'seq, low, people, orgs', 'title', 'text').strip()},
 ex_v AS (SELECT seq, people, orgs, NOT {Q.has_any('low', V.VIOLENCE_STEMS)} AND topic IS NULL AS relevant FROM topic_v JOIN new_v USING (seq)),
 org_v AS (SELECT seq, name, CASE WHEN {Q.has_any('lower(name)', V.AGENCY_WORDS_FALLBACK)} THEN 'agency' ELSE 'company' END AS type
   FROM (SELECT seq, unnest(orgs) AS name FROM ex_v WHERE relevant) o WHERE NOT {FURNITURE_SQL.format(n=_NAME)})
 SELECT 'stage' AS part, name, n FROM (UNPIVOT (SELECT count(*) AS "raw", count(*) FILTER (NOT live) AS stubs, count(*) FILTER (live AND is_local) AS country,
    count(*) FILTER (live AND is_local AND pub IS NULL) AS undated, count(*) FILTER (live AND is_local AND pub >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS) AS fresh FROM g)
    ON COLUMNS(*) INTO NAME name VALUE n)
 UNION ALL SELECT 'stage', 'new', count(*) FROM ex_v UNION ALL SELECT 'stage', 'relevant', count(*) FILTER (relevant) FROM ex_v
 UNION ALL SELECT 'companies', arg_min(name, seq), count(*) FROM org_v WHERE type = 'company' GROUP BY lower(name)
 UNION ALL SELECT 'agencies', name, count(*) FROM org_v WHERE type = 'agency' GROUP BY name
 UNION ALL SELECT 'people', name, count(*) FROM (SELECT unnest(people) AS name FROM ex_v WHERE relevant) p GROUP BY name""")
def run01(t):
    """Collected articles to register counts; every ninth article's URL is stored already."""
    rows = stories(t).withColumn("published_at", F.when(F.col("seq") % 10 != 0, F.col("published_at")))
    tables = run.daily_run(rows, t.articles_v.filter("seq % 9 = 4"), AS_OF)
    return run.summary(gates.funnel(rows, AS_OF), tables)


def told(rows):
    """The reply of a model for every fourth article, as JSON in a sentence, read back."""
    k = c("seq")
    text = lambda prefix, m: F.concat(F.lit(prefix), (k % m).cast("string"))
    reply = F.to_json(F.struct(
        (k % 8 == 0).alias("relevant"), F.lit("Company").alias("category"), F.lit("Merger").alias("event_type"), F.lit(40).alias("risk_score"), F.lit("High").alias("risk_level"),
        F.lit("As told.").alias("summary"), F.array(F.struct(text("Told Company ", 9).alias("name"), F.lit("company").alias("type"))).alias("organizations"),
        F.array(F.struct(text("Holder ", 30).alias("name"), text("Told Company ", 9).alias("organization"), text("3", 10).alias("percentage"))).alias("significant_control")))
    answered = X.from_replies(rows.withColumn("reply", F.when(k % 4 == 0, F.concat(F.lit("Here you are: "), reply))))
    return answered.withColumnRenamed("extraction", "told").drop("reply")


@query("run02_complete", f"""WITH {_FUNNEL}, {_STORY_SCORES},
 new_v AS (SELECT f.seq, f.url FROM f WHERE NOT {Q.stub('nt', 'ns')} AND {COUNTRY_SQL.format(low='low', fold='folded')} AND pub >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS
   QUALIFY row_number() OVER (PARTITION BY f.url ORDER BY f.seq) = 1),
 {Q.off_topic_ctes('imp_v', 'seq, low, people, orgs', 'title', 'text').strip()},
 ex_v AS (SELECT seq, people, orgs, seq % 4 = 0 AS told, CASE WHEN seq % 4 = 0 THEN seq % 8 = 0 ELSE NOT {Q.has_any('low', V.VIOLENCE_STEMS)} AND topic IS NULL END AS relevant FROM topic_v JOIN new_v USING (seq)),
 org_v AS (SELECT seq, name, CASE WHEN told THEN 'company' WHEN {Q.has_any('lower(name)', V.AGENCY_WORDS_FALLBACK)} THEN 'agency' ELSE 'company' END AS type
   FROM (SELECT seq, told, unnest(CASE WHEN told THEN [concat('Told Company ', CAST(seq % 9 AS STRING))] ELSE orgs END) AS name FROM ex_v WHERE relevant) o WHERE NOT {FURNITURE_SQL.format(n=_NAME)}),
 hold_v AS (SELECT DISTINCT seq % 30 AS p, seq % 9 AS o, seq % 10 AS s FROM ex_v WHERE relevant AND told)
 SELECT 'status' AS part, CASE WHEN relevant THEN 'Published' ELSE 'Filtered' END AS name, count(*) AS n FROM ex_v GROUP BY 2
 UNION ALL SELECT 'companies', arg_min(name, seq), count(*) FROM org_v WHERE type = 'company' GROUP BY lower(name)
 UNION ALL SELECT 'agencies', name, count(*) FROM org_v WHERE type = 'agency' GROUP BY name
 UNION ALL SELECT 'people', name, count(*) FROM (SELECT unnest(people) AS name FROM ex_v WHERE relevant AND NOT told) p GROUP BY name
 UNION ALL SELECT 'holdings', concat('Holder ', CAST(p AS STRING)), count(*) FROM hold_v GROUP BY 2
 UNION ALL SELECT 'brief', '- **Total Articles Processed:** ' || count(*) FILTER (relevant), 1 FROM ex_v""")
def run02(t):
    """A run whose models all fail, then one in which they answer; the second tries all that the first left."""
    root = scratch_path(t.spark, "runs")
    rows = stories(t).withColumn("published_at", F.when(c("seq") % 10 != 0, c("published_at")))
    silent = lambda todo: told(todo).withColumn("told", F.when(F.lit(False), c("told")))
    if set(run.complete_run(rows, root, 1, AS_OF, silent, text="")) != {"health"}:
        raise AssertionError("a failed run must not be shown")
    # Nothing new arrives: all there is to do are the dead letters.
    out = run.complete_run(rows.limit(0), root, 2, AS_OF, told)
    count = lambda part, df, name: df.groupBy(c(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    parts = [
        count("status", out["articles"], "status"), out["companies"].select(F.lit("companies").alias("part"), c("company").alias("name"), c("mention_count").alias("n")),
        count("agencies", out["agencies"], "agency"), count("people", out["people"], "name"), count("holdings", out["significant_control"], "person_name"),
        count("brief", out["brief"].filter("section = 0 AND part = 3"), "line"),
    ]
    return reduce(DataFrame.unionAll, parts)
