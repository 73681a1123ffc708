"""Knowledge graph: vertices, edges, degrees, neighbourhoods, employment state."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerlens.functions import text as T
from ownerlens.operators.keys import first_per_key, latest_per_key

c = F.col


def _name(name: str) -> Column:
    return T.strip(F.coalesce(c(name), F.lit("")))


def _nodes(df: DataFrame, name: str, kind: str, risk, priority: int) -> DataFrame:
    risk = F.lit(risk) if isinstance(risk, str) else risk
    return df.select(
        _name(name).alias("label"), F.lit(kind).alias("type"), risk.alias("risk"),
        F.lit(priority).alias("priority"), c("seq").cast("bigint").alias("seq"),
    ).filter(c("label") != "")


def vertices(companies: DataFrame, agencies: DataFrame, people: DataFrame, holdings: DataFrame,
             procurement: DataFrame) -> DataFrame:
    """One vertex per id; the first source that names it decides type and risk."""
    both = holdings.filter((_name("person_name") != "") & (_name("company") != ""))
    deals = procurement.filter((_name("agency") != "") & (_name("contractor") != ""))
    members = people.filter(_name("name") != "")
    rows = _nodes(companies, "company", "company", F.coalesce(c("risk_level"), F.lit("Low")), 0)
    for part in (
        _nodes(agencies, "agency", "agency", "Low", 1),
        _nodes(members, "name", "person", "Low", 2),
        _nodes(members, "organization", "company", "Low", 2),
        _nodes(both, "person_name", "psc", "High", 3),
        _nodes(both, "company", "company", "Medium", 3),
        _nodes(deals, "agency", "agency", "Low", 4),
        _nodes(deals, "contractor", "company", "Low", 4),
    ):
        rows = rows.unionByName(part)
    return first_per_key(rows.withColumn("id", T.node_id(c("label"))), ["id"], ("priority", "seq", "type", "label")).select(
        "id", "label", "type", "risk")


def _edges(df: DataFrame, src: str, dst: str, kind: str, label: Column, priority: int) -> DataFrame:
    return df.filter((_name(src) != "") & (_name(dst) != "")).select(
        T.node_id(F.concat_ws("-", _name(src), _name(dst), F.lit(kind))).alias("id"),
        T.node_id(_name(src)).alias("src"), T.node_id(_name(dst)).alias("dst"), label.alias("label"),
        F.lit(priority).alias("priority"), c("seq").cast("bigint").alias("seq"),
    )


def edges(people: DataFrame, holdings: DataFrame, procurement: DataFrame) -> DataFrame:
    """Works, control and contract edges, the first of each kept."""
    stake = F.when(F.coalesce(c("percentage"), F.lit("")) != "", F.concat(F.lit("PSC: "), c("percentage"))).otherwise(
        c("nature_of_control"))
    rows = (
        _edges(people, "name", "organization", "works", F.concat(F.lit("Appointed as "), F.coalesce(c("position"), F.lit("Executive"))), 0)
        .unionByName(_edges(holdings, "person_name", "company", "psc", stake, 1))
        .unionByName(_edges(procurement, "contractor", "agency", "contract", F.lit("Contract Awardee"), 2))
    )
    return first_per_key(rows, ["id"], ("priority", "seq", "label")).select("id", "src", "dst", "label")


def _ends(edge_rows: DataFrame) -> DataFrame:
    """Each edge once per different end, and how many different ends it has."""
    both = F.array_distinct(F.array("src", "dst"))
    return edge_rows.select(c("id").alias("edge"), "src", "dst", c("label").alias("edge_label"), F.size(both).alias("needed"), F.explode(both).alias("end"))


def valid_edges(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are all nodes; ends meet the nodes in one join, so nodes are worked out once."""
    met = _ends(edge_rows).join(nodes.select(c("id").alias("end")), "end")
    whole = met.groupBy("edge", "src", "dst", "edge_label", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n = needed")
    return whole.select(c("edge").alias("id"), "src", "dst", c("edge_label").alias("label"))


def degrees(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree over valid edges and the display size.

    Nodes are joined with the ends of edges once; an edge counts where all its ends
    have been met, which its one or two rows tell each other.
    """
    met = nodes.join(_ends(edge_rows).drop("src", "dst", "edge_label"), c("id") == c("end"), "left")
    # Nodes without an edge stand by themselves.
    edge = Window.partitionBy(F.coalesce("edge", "id"))
    met = met.withColumn("n", F.count("end").over(edge))
    # A loop has both its ends at one node.
    weight = F.when(c("n") == c("needed"), F.when(c("needed") == 1, 2).otherwise(1)).otherwise(0)
    counted = met.groupBy(*nodes.columns).agg(F.sum(weight).cast("bigint").alias("degree"))
    return counted.withColumn("size", F.lit(12) + F.least(c("degree") * 3, F.lit(16)))


def neighbours(edge_rows: DataFrame, node: Column) -> DataFrame:
    """Ids one step away from ``node``, in either direction."""
    out = edge_rows.filter(c("src") == node).select(c("dst").alias("id"))
    back = edge_rows.filter(c("dst") == node).select(c("src").alias("id"))
    return out.unionAll(back).distinct()


def executives(relations: DataFrame) -> DataFrame:
    """(company, person) pairs whose latest appointment or resignation is an appointment."""
    rows = relations.filter(c("predicate").isin("appointed", "resigned from"))
    return latest_per_key(rows, ["company", "person"]).filter("predicate = 'appointed'").select("company", "person", "seq")


def career_history(relations: DataFrame) -> DataFrame:
    """First appointment of a person at each company."""
    return first_per_key(relations.filter("predicate = 'appointed'"), ["person", "company"]).select("person", "company", "seq")


def current_position(relations: DataFrame) -> DataFrame:
    """A new employer or any resignation sets the position; being named again at a
    company already in the history does not."""
    gained = career_history(relations).select("person", "seq", F.concat(F.lit("Executive at "), c("company")).alias("position"))
    left = relations.filter("predicate = 'resigned from'").select(
        "person", "seq", F.concat(F.lit("Former Executive at "), c("company")).alias("position"))
    return latest_per_key(gained.unionByName(left), ["person"]).select("person", "position")
