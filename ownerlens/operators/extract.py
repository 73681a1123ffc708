"""Text to structured rows: mentions, relations, extraction records, enrichment."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import schemas, vocab as V
from ownerlens.functions import holdings as H, scoring as S, text as T
from ownerlens.operators.keys import first_per_key, top_per_key
from ownerlens.session import materialise

c = F.col

# ------------------------------------------------------------- mentions

#: Fewest letters of a name that is looked for.
LEAST_NAME = 4
#: What stands between words; a run of other characters in a key lies inside one run of a text that contains the key.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Characters of a key's word that are looked up; a key with a longer one is held against the text.
WINDOW = 32
#: Characters of a piece of text, and of a strip of a long word; pieces and strips overlap so that each looked-up word lies inside one.
PIECE = 16384
STRIP = 32
#: Leading characters that join a looked-up word with the places of a word: the most of these that it has.
ANCHORS = (1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 24)
#: So many keys at most are held against each text directly.
FEW = 16


def looked_up(key: Column) -> Column:
    """The distinct words of a key, each cut to ``WINDOW`` characters."""
    return F.array_distinct(F.transform(F.filter(F.split(key, BETWEEN), lambda w: w != ""), lambda w: F.left(w, F.lit(WINDOW))))


def _cut(of: Column, size: int) -> Column:
    """A text in overlapping parts."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(of) - 1) / size).cast("int")), lambda k: F.substr(of, k * size + 1, F.lit(size + WINDOW - 1)))


def words_of(texts: DataFrame, least: int, *keep: str) -> DataFrame:
    """``(*keep, word)``: the words of ``texts(hay)`` with ``least`` characters or more, once for each piece of text, long ones in strips."""
    whole = F.length("hay") <= PIECE
    pieces = texts.select(*keep, F.explode(F.when(whole, F.array("hay")).otherwise(_cut(c("hay"), PIECE))).alias("piece"))
    words = F.filter(F.array_distinct(F.split("piece", BETWEEN)), lambda w: F.length(w) >= least)
    long = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= STRIP + WINDOW), lambda w: _cut(w, STRIP)))
    return pieces.select(*keep, F.explode(F.concat(F.filter(words, lambda w: F.length(w) < STRIP + WINDOW), long)).alias("word"))


def pieces_in(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(word, piece)`` of every piece contained in a word; ``vocabulary(word)`` and ``pieces(piece)`` hold each once.

    Every place of a word is joined with the pieces on their leading characters.  The
    work is that of the different words, however often texts repeat them.
    """
    size = F.lit(ANCHORS[0])
    for n in ANCHORS[1:]:
        size = F.when(F.length("piece") >= n, n).otherwise(size)
    pieces = pieces.withColumn("anchor", F.left("piece", size))
    # At most one number for each of ANCHORS.
    sizes = pieces.agg(F.sort_array(F.collect_set(F.length("anchor")))).first()[0]
    sized = vocabulary.select("word", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("n")).filter(F.length("word") >= c("n"))
    places = sized.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - c("n") + 1)).alias("at"))
    places = places.select("word", "at", F.substr("word", c("at"), c("n")).alias("start"))
    met = places.join(pieces, c("start") == c("anchor")).filter(F.substr("word", c("at"), F.length("piece")) == c("piece"))
    return met.select("word", "piece").distinct()


class Keys:
    """Keys ``(id, key)``, each non-empty one once, written once and parted by how they are looked up."""

    def __init__(self, keys: DataFrame):
        self.all = materialise(keys.filter(c("key") != "").select("id", "key", looked_up(c("key")).alias("pieces")), "keys")
        one = (F.size("pieces") == 1) & (F.get("pieces", F.lit(0)) == c("key"))
        kind = F.when(one, "word").when(F.size("pieces") == 0, "none").otherwise("words")
        # Four numbers.
        known = self.all.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(kind == "words").alias("words"), F.count_if(kind == "none").alias("none"),
            F.min(F.array_min(F.transform("pieces", lambda p: F.length(p)))).alias("least")).first()
        self.few, self.some_words, self.some_none = known["n"] <= FEW, known["words"] > 0, known["none"] > 0
        #: Letters of the shortest word that is looked up: no shorter word of a text contains one.
        self.least = known["least"] or 1
        self.word, self.words, self.none = (self.all.filter(kind == k) for k in ("word", "words", "none"))

    def pieces(self) -> DataFrame:
        return self.all.select(F.explode("pieces").alias("piece")).distinct()


def contained_keys(articles: DataFrame, hay: Column, keys: DataFrame, first: int | None = None) -> DataFrame:
    """``(seq, id)`` of the keys contained in each text, or only a text's ``first`` ids; ``keys(id, key)`` holds each non-empty key once.

    Texts are taken apart into their distinct words.  Keys are looked up in the different
    words of all texts (``pieces_in``), and what is found is joined back to the texts that have the
    word.  A key of several words is looked up by all of them, and held against the texts that have its
    rarest.  A few keys, and keys without a word, are held against every text.
    """
    keys = Keys(keys)
    texts = articles.select(c("seq").cast("bigint").alias("seq"), hay.alias("hay")).filter(c("hay") != "")
    if keys.few:
        held = [F.when(F.contains("hay", F.lit(k["key"])), F.lit(k["id"])) for k in keys.all.select("id", "key").collect()]
        found = texts.select("seq", F.explode_outer(F.array(*held).cast("array<bigint>")).alias("id")).filter("id IS NOT NULL").distinct()
        return found if first is None else top_per_key(found, ["seq"], [c("id")], first)
    held = materialise(words_of(texts, keys.least, "seq"), "words")
    vocabulary = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    met = pieces_in(vocabulary.select("word"), keys.pieces())
    if keys.some_words:
        met, vocabulary = materialise(met, "met"), materialise(vocabulary, "vocabulary")
    of_word = met.join(keys.word.select("id", c("key").alias("piece")), "piece").select("word", "id")
    if first is not None:
        # A text's first ids are among the first of each of its words.
        of_word = top_per_key(of_word, ["word"], [c("id")], first)
    found = held.join(of_word, "word").select("seq", "id")
    if keys.some_words:
        found = found.unionByName(_of_words(texts, held, vocabulary, met, keys.words))
    if keys.some_none:
        found = found.unionByName(texts.join(keys.none.select("id", "key"), F.contains("hay", "key")).select("seq", "id"))
    found = found.distinct()
    return found if first is None else top_per_key(found, ["seq"], [c("id")], first)


def _of_words(texts: DataFrame, held: DataFrame, vocabulary: DataFrame, met: DataFrame, keys: DataFrame) -> DataFrame:
    """``(seq, id)`` of keys of several words: texts that have a key's rarest word, held against the key."""
    reach = met.join(vocabulary, "word").groupBy("piece").agg(F.sum("n").alias("n"))
    parts = keys.select("id", "key", F.explode("pieces").alias("piece")).join(reach, "piece", "left")
    rarest = first_per_key(parts.withColumn("n", F.coalesce("n", F.lit(0))), ["id"], ("n", "piece")).select("piece", "id", "key")
    asked = held.join(met.join(rarest, "piece").select("word", "id", "key"), "word").select("seq", "id", "key").distinct()
    return asked.join(texts, "seq").filter(F.contains("hay", "key")).select("seq", "id")


def match_entities(articles: DataFrame, dictionary: DataFrame, text: Column, limit: int | None = 10) -> DataFrame:
    """Known names (four characters or more, first spelling wins) contained in each article's text, the first ``limit`` in dictionary order."""
    names = dictionary.select(c("entity_seq").cast("bigint").alias("entity_seq"), F.trim("name").alias("name"), "type", F.lower(F.trim("name")).alias("key"))
    names = materialise(first_per_key(names.filter(F.length("key") >= LEAST_NAME), ["key"], ("entity_seq",)), "names")
    hits = contained_keys(articles, F.lower(text), names.select(c("entity_seq").alias("id"), "key"), limit)
    return hits.join(names.drop("key"), c("id") == c("entity_seq")).select("seq", "entity_seq", "name", "type")


# Names as written: capitalised runs ending in an organisation word, capitalised
# runs after a job title, and capitalised runs after a place preposition.
ORGANISATION_WORDS = ["Limited", "Ltd", "Plc", "PLC", "Inc", "Corporation", "Holdings", "Group", "Bank", "Company",
                      "Commission", "Ministry", "Agency", "Authority", "Bureau", "Department", "Board", "Council"]
ORGANISATION_PATTERN = rf"\b((?:[A-Z][A-Za-z&'-]* (?:of |and |for |the )?)+(?:{'|'.join(ORGANISATION_WORDS)}))\b"
PERSON_PATTERN = rf"\b(?:{'|'.join(sorted(V.JOB_TITLES, key=lambda t: (-len(t), t)))}) ([A-Z][a-z'-]+(?: [A-Z][a-z'-]+)+)\b"
LOCATION_PATTERN = r"\b(?:in|at|near) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"


def entity_parts(text: Column, low: Column | None = None) -> dict[str, Column]:
    """The fields of ``named_entities``, each an expression of its own; ``low`` is the text lower-cased, where the caller has it."""

    def found(pattern: str, hint: list[str], first: str = "[A-Z]") -> Column:
        # Most texts hold none of the anchoring words, and a literal search is
        # far cheaper than the pattern; its first letter is looked at before a word boundary.
        hit = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?={first}){pattern}"), F.lit(1)))
        return F.when(T.has_any(text, hint), hit).otherwise(F.array().cast("array<string>"))

    people = F.filter(F.transform(found(PERSON_PATTERN, V.JOB_TITLES), T.strip_job_titles), lambda p: p.isNotNull())
    return {
        "people": people, "organizations": found(ORGANISATION_PATTERN, ORGANISATION_WORDS),
        "locations": found(LOCATION_PATTERN, ["in ", "at ", "near "], "[ian]"), "positions": T.job_titles(text) if low is None else T.job_titles_in(low),
    }


def named_entities(text: Column) -> Column:
    """STRUCT<people, organizations, locations, positions> by written patterns.

    Stands in for a trained entity model; ``mapInPandas`` is the way to plug one in.
    """
    return F.struct(*[part.alias(name) for name, part in entity_parts(text).items()])


PARTS = ("_people", "_organizations", "_locations", "_positions")


def with_entities(rows: DataFrame, text: str, low: str) -> DataFrame:
    """Rows with ``entities``, the struct of ``named_entities``, and its fields (``PARTS``); what nobody reads is not looked for."""
    parts = entity_parts(c(text), c(low))
    found = rows.withColumns({f"_{name}": part for name, part in parts.items()})
    return found.withColumn("entities", F.struct(*[c(f"_{name}").alias(name) for name in parts]))


# ------------------------------------------------------------- relations


def first_verb(sentence: Column) -> Column:
    """The first stem of the list that starts a word; most sentences have none, which one pattern tells."""
    verb = F.coalesce(*[
        F.when(F.rlike(sentence, F.lit(rf"(?iU)\b{stem}\w*\b")), stem) for stem in V.RELATION_STEMS
    ])
    first = "".join(sorted({stem[0] for stem in V.RELATION_STEMS}))
    return F.when(F.rlike(sentence, F.lit(rf"(?iU)(?=[{first}])\b{T.any_of(V.RELATION_STEMS)}")), verb)


def relations(rows: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Subject–predicate–object rows, at most one per sentence.

    ``dismiss`` and ``suspend`` are recognised as the sentence's verb but yield
    no relation.
    """
    s = rows.select("seq", c(entities).alias("e"), F.posexplode(S.sentences(c(text))).alias("sentence_no", "sentence"))
    s = s.withColumn("verb", first_verb(c("sentence"))).filter("verb IS NOT NULL")

    def inside(name: str) -> Column:
        return F.filter(c(f"e.{name}"), lambda x: F.contains(c("sentence"), x))

    s = s.withColumns({"people": inside("people"), "orgs": inside("organizations"), "pos": inside("positions")})
    person, org, org2, pos = F.get("people", F.lit(0)), F.get("orgs", F.lit(0)), F.get("orgs", F.lit(1)), F.get("pos", F.lit(0))

    def triple(subject, predicate, obj, confidence):
        return F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"),
                        F.lit(confidence).alias("confidence"))

    agency = F.coalesce(org, F.lit("Regulatory Body"))
    target = F.coalesce(org2, person, F.lit("Company"))
    found = (
        F.when(c("verb").isin("appoint", "hire"), triple(
            F.coalesce(org, F.lit("Government")), "appointed", F.coalesce(person, pos, F.lit("Unknown Person")), 0.8))
        .when(c("verb").isin("resign", "retire"), triple(
            F.coalesce(person, F.lit("Executive")), "resigned from", F.coalesce(org, F.lit("Company")), 0.85))
        .when(c("verb").isin("acquire", "buy") & org2.isNotNull(), triple(org, "acquired", org2, 0.9))
        .when((c("verb") == "partner") & org2.isNotNull(), triple(org, "partnered with", org2, 0.85))
        .when(c("verb") == "investigate", triple(agency, "investigating", target, 0.75))
        .when(c("verb") == "sue", triple(agency, "suing", target, 0.75))
    )
    return s.select("seq", "sentence_no", found.alias("r")).filter("r IS NOT NULL").select("seq", "sentence_no", "r.*")


def first_relation(rels: DataFrame) -> DataFrame:
    return first_per_key(rels, ["seq"], ("sentence_no",))


def event_type(rels: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with an event type: the first relation's predicate, else a default."""
    first = first_relation(rels).select("seq", "predicate")
    p = c("predicate")
    capital = F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1000)))
    return articles.join(first, "seq", "left").withColumn(
        "event_type", F.coalesce(capital, F.lit("Policy announcement"))).drop("predicate")


# ------------------------------------------------------------- extraction records


def from_replies(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """Parsed extraction of every model reply; NULL where there is no valid JSON."""
    block = T.json_block(c(raw))
    parsed = F.when(F.try_parse_json(block).isNotNull(), F.from_json(block, schemas.EXTRACTION))
    return replies.withColumn("extraction", parsed)


def with_defaults(extraction: Column) -> Column:
    """Every field present.  A reply that does not answer relevance is not relevant.  The record is evaluated once."""
    return T.let(extraction, _with_defaults)


def _with_defaults(e: Column) -> Column:
    types = {f.name: f.dataType for f in schemas.EXTRACTION.fields}

    def dflt(name: str, value) -> Column:
        return F.coalesce(e[name], F.lit(value).cast(types[name])).alias(name)

    def empty(name: str) -> Column:
        return F.coalesce(e[name], F.array().cast(types[name])).alias(name)

    return F.when(e.isNotNull(), F.struct(
        dflt("relevant", False), dflt("category", "Other"), dflt("event_type", "Other"), dflt("risk_score", 10),
        dflt("risk_level", "Low"), dflt("importance_score", 50), dflt("summary", ""),
        empty("organizations"), empty("people"), empty("significant_control"), e["procurement"].alias("procurement"),
    ))


def cascade(rows: DataFrame, providers: Sequence[str], fallback: str | None = None) -> DataFrame:
    """First provider column with a result wins; ``engine`` says which.

    Rows no provider answered keep a NULL extraction: a dead letter to retry.
    """
    order = [*providers, *([fallback] if fallback else [])]
    return rows.withColumn("extraction", F.coalesce(*[c(p) for p in order])).withColumn(
        "engine", F.coalesce(*[F.when(c(p).isNotNull(), p) for p in order]))


def dead_letters(rows: DataFrame) -> DataFrame:
    return rows.filter(c("extraction").isNull())


def run_health(rows: DataFrame) -> DataFrame:
    """One row: how many extractions were tried and failed, and the verdict."""
    counts = rows.agg(F.count(F.lit(1)).alias("tried"), F.count_if(c("extraction").isNull()).alias("failed"))
    return counts.withColumn(
        "verdict",
        F.when(c("failed") == 0, "ok").when(c("failed") == c("tried"), "nothing published").otherwise("degraded"))


class ExtractionFailed(RuntimeError):
    """Raised so that a degraded run is seen as failed."""


def require_health(rows: DataFrame) -> None:
    verdict = run_health(rows).first()
    if verdict["failed"]:
        raise ExtractionFailed(f"{verdict['failed']} of {verdict['tried']} extractions failed: {verdict['verdict']}")


def fallback_extraction(title: Column, text: Column, entities: Column) -> Column:
    """The extraction record from vocabularies alone."""
    body = F.coalesce(T.non_empty(text), title)
    low = F.lower(body)
    cat = S.category(body)

    def build(p: Column) -> Column:
        orgs, people = p["e"]["organizations"], p["e"]["people"]
        low, cat = p["low"], p["cat"]
        score = S.importance(p["body"], p["e"]["positions"], F.size(people), F.size(orgs), cat)
        position = (
            F.when(T.has_any(low, ["ceo", "chief executive"]), "CEO")
            .when(T.has_any(low, ["managing director", "md"]), "Managing Director")
            .when(F.contains(low, F.lit("minister")), "Minister")
            .when(F.contains(low, F.lit("secretary")), "Permanent Secretary")
            .otherwise("Officer")
        )
        appoint = F.contains(low, F.lit("appoint"))
        first_org, second_org = F.get(orgs, F.lit(0)), F.get(orgs, F.lit(1))
        null_holdings = F.array().cast("array<" + schemas.HOLDING.simpleString() + ">")
        return F.struct(
            (~is_violent_text(low) & ~S.is_off_topic(p["title"], p["body"])).alias("relevant"),
            cat.alias("category"),
            F.when(cat == "Government", F.when(appoint, "Appointment").otherwise("Policy"))
            .when(cat == "Company", F.when(F.contains(low, F.lit("merger")), "Merger").otherwise("Earnings"))
            .otherwise("Other").alias("event_type"),
            F.floor(score * 0.8).cast("int").alias("risk_score"),
            p["risk"].alias("risk_level"),
            F.floor(score).cast("int").alias("importance_score"),
            p["summary"].alias("summary"),
            F.transform(orgs, lambda o: F.struct(
                o.alias("name"), T.organisation_type(o, V.AGENCY_WORDS_FALLBACK).alias("type"))).alias("organizations"),
            F.transform(people, lambda x: F.struct(
                x.alias("name"), position.alias("position"), F.coalesce(first_org, F.lit("N/A")).alias("organization"),
                F.when(appoint, "appointment").otherwise("other").alias("event"))).alias("people"),
            null_holdings.alias("significant_control"),
            F.when(T.has_any(low, ["tender", "procurement", "contract"]), F.struct(
                F.coalesce(first_org, F.lit("Federal Government")).alias("agency"),
                F.coalesce(second_org, F.lit("Tracked Contractor")).alias("contractor"),
                F.lit("TBD (Local Pipeline)").alias("amount"), p["title"].alias("project"))).alias("procurement"),
        )

    return T.let(F.struct(
        title.alias("title"), body.alias("body"), low.alias("low"), cat.alias("cat"), entities.alias("e"),
        S.risk_level(body).alias("risk"), S.summaries(title, body, "executive")["executive"].alias("summary"),
    ), build)


def is_violent_text(low: Column) -> Column:
    return T.has_any(low, V.VIOLENCE_STEMS)


# ------------------------------------------------------------- fan-out


def _or(col: Column, default: str) -> Column:
    return F.coalesce(T.non_empty(col), F.lit(default))


def _seen(ex: DataFrame) -> Column:
    """When the article appeared, as the registers store it."""
    return c("published_at") if "published_at" in ex.columns else F.lit(None).cast("string")


def organisations(ex: DataFrame) -> DataFrame:
    rows = ex.select("seq", "title", _seen(ex).alias("seen_at"), "extraction", F.posexplode("extraction.organizations").alias("pos", "o"))
    return rows.select(
        "seq", "pos", "title", "seen_at", c("o.name").alias("name"), F.coalesce(c("o.type"), F.lit("company")).alias("type"),
        F.coalesce(c("extraction.risk_level"), F.lit("Low")).alias("risk_level"),
        F.coalesce(c("extraction.event_type"), F.lit("Directive")).alias("event_type"),
    ).filter(~T.is_publication_or_furniture(c("name")))


def company_rows(ex: DataFrame) -> DataFrame:
    return organisations(ex).filter("type = 'company'").select(
        "seq", "pos", c("name").alias("company"), "seen_at", F.lit("General").alias("industry"), "risk_level")


def agency_rows(ex: DataFrame) -> DataFrame:
    return organisations(ex).filter("type = 'agency'").select(
        "seq", "pos", c("name").alias("agency"), c("event_type").alias("event"), c("title").alias("article"), c("seen_at").alias("date"))


def people_rows(ex: DataFrame) -> DataFrame:
    rows = ex.select("seq", _seen(ex).alias("date"), F.posexplode("extraction.people").alias("pos", "p"))
    return rows.select(
        "seq", "pos", c("p.name").alias("name"), F.coalesce("p.position", F.lit("Director")).alias("position"),
        F.coalesce("p.organization", F.lit("N/A")).alias("organization"), F.coalesce("p.event", F.lit("appointment")).alias("event"), "date")


def procurement_rows(ex: DataFrame) -> DataFrame:
    p = "extraction.procurement."
    return ex.filter(T.non_empty(c(p + "agency")).isNotNull()).select(
        "seq", c(p + "agency").alias("agency"), F.coalesce(c(p + "contractor"), F.lit("TBD")).alias("contractor"),
        F.coalesce(c(p + "amount"), F.lit("N/A")).alias("amount"), F.coalesce(c(p + "project"), c("title")).alias("project"), "source")


def _holding_fields(h: Column, as_of: str) -> dict[str, Column]:
    """Register columns of a disclosed holding; NULL and '' both take the default."""
    return {
        "person_name": _or(h["name"], ""), "company": _or(h["organization"], ""), "nature_of_control": _or(h["nature_of_control"], ""),
        "board_role": _or(h["board_role"], ""), "percentage": _or(h["percentage"], ""), "direct_pct": _or(h["direct_percentage"], ""),
        "indirect_pct": _or(h["indirect_percentage"], ""), "voting_pct": _or(h["voting_rights_percentage"], ""),
        "share_band": H.share_band(h["percentage"]), "vehicle": _or(h["intermediate_entities"], "Direct Holding"),
        "pep_status": _or(h["pep_status"], "Not assessed"), "risk_level": _or(h["risk_level"], "Standard"),
        "filing_ref": _or(h["regulatory_filing_ref"], ""), "verification_status": F.lit("Extracted from news reporting"),
        "change_type": _or(h["change_type"], "disclosed"), "previous_holder": _or(h["previous_holder"], ""),
        "date": F.lit(as_of[:10]), "source": F.lit("extracted"),
    }


def holding_rows(ex: DataFrame, as_of: str) -> DataFrame:
    """Register rows of every disclosed holding."""
    rows = ex.select("seq", F.posexplode("extraction.significant_control").alias("pos", "h"))
    return rows.select("seq", "pos", *[value.alias(name) for name, value in _holding_fields(c("h"), as_of).items()])


#: Registers that one extraction fans out to.
REGISTERS = ("companies", "agencies", "people", "procurement", "significant_control")


def fan_out(ex: DataFrame, as_of: str) -> DataFrame:
    """``(register, seq, pos, fields)``: the rows of all registers in one pass over the extractions.

    Each extraction becomes one array of tagged rows, exploded once; ``fields`` maps a
    register's column names to text.  ``register_rows`` reads one register back.
    """
    e, title = c("extraction"), c("title")
    seen = _seen(ex).cast("string")
    text = lambda col: col.cast("string")

    def row(register: str, pos: Column, fields: dict[str, Column]) -> Column:
        pairs = [x for name, value in fields.items() for x in (F.lit(name), text(value))]
        return F.struct(F.lit(register).alias("register"), pos.cast("int").alias("pos"), F.create_map(*pairs).alias("fields"))

    def organisation(o: Column, pos: Column) -> Column:
        kind = F.coalesce(o["type"], F.lit("company"))
        company = row("companies", pos, {"company": o["name"], "seen_at": seen, "industry": F.lit("General"), "risk_level": F.coalesce(e["risk_level"], F.lit("Low"))})
        agency = row("agencies", pos, {"agency": o["name"], "event": F.coalesce(e["event_type"], F.lit("Directive")), "article": title, "date": seen})
        return F.when(~T.is_publication_or_furniture(o["name"]), F.when(kind == "company", company).when(kind == "agency", agency))

    def person(p: Column, pos: Column) -> Column:
        return row("people", pos, {"name": p["name"], "position": F.coalesce(p["position"], F.lit("Director")), "organization": F.coalesce(p["organization"], F.lit("N/A")),
                                   "event": F.coalesce(p["event"], F.lit("appointment")), "date": seen})

    def holding(h: Column, pos: Column) -> Column:
        return row("significant_control", pos, _holding_fields(h, as_of))

    p = e["procurement"]
    bought = F.when(T.non_empty(p["agency"]).isNotNull(), F.array(row("procurement", F.lit(0), {
        "agency": p["agency"], "contractor": F.coalesce(p["contractor"], F.lit("TBD")), "amount": F.coalesce(p["amount"], F.lit("N/A")),
        "project": F.coalesce(p["project"], title), "source": c("source")})))
    rows = [F.transform(e["organizations"], organisation), F.transform(e["people"], person), bought, F.transform(e["significant_control"], holding)]
    none = F.array().cast("array<struct<register: string, pos: int, fields: map<string, string>>>")
    rows = [F.coalesce(r, none) for r in rows]
    return ex.select(c("seq"), F.explode(F.concat(*rows)).alias("r")).filter("r IS NOT NULL").select("r.register", "seq", "r.pos", "r.fields")


def register_rows(fanned: DataFrame, register: str, *columns: str) -> DataFrame:
    """One register of a fan-out, with its columns; on a table partitioned by register only that part is read."""
    return fanned.filter(c("register") == register).select("seq", "pos", *[c("fields")[name].alias(name) for name in columns])


def write_fan_out(fanned: DataFrame, path: str) -> None:
    """All registers of a run in one write, a folder each."""
    fanned.write.mode("overwrite").partitionBy("register").parquet(path)


# ------------------------------------------------------------- enrichment


def enrich(articles: DataFrame, text: str = "raw_text", english_only: bool = True) -> DataFrame:
    """One chained projection from raw article to scored article: no shuffle, no Python."""
    rows = articles.withColumn("text", F.coalesce(T.non_empty(T.clean_html(F.coalesce(T.non_empty(c(text)), c("title")))), c("title")))
    # Lower-cased once; Spark keeps an expensive column that is used several times.
    rows = rows.withColumn("_low", S.lowered(c("text"))).withColumn("language", S.language_in(c("_low")))
    if english_only:
        rows = rows.filter("language = 'en'")
    low = c("_low")
    rows = with_entities(rows, "text", "_low").withColumns({
        "sentiment": S.sentiment_in(low), "risk_level": S.risk_in(low),
        "category": S.category_in(low), "summaries": S.summaries(c("title"), c("text")),
    })
    return rows.withColumn("importance", S.importance_in(
        low, c("_positions"), F.size("_people"), F.size("_organizations"), c("category"))).drop("_low", *PARTS)


def hashed_embedding(rows: DataFrame, key: str, text: str = "text", dims: int = 64) -> DataFrame:
    """``(key, embedding)``: L2-normalised hashed term counts of the whole text as ARRAY<DOUBLE>.

    A word falls into the bucket its MD5 digest names.  Counts are partial aggregates per
    key and bucket, so no text travels; a text without words is all zeros.  Stands in for
    a trained encoder; ``mapInPandas`` is the way to plug one in.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    terms = rows.select(c(key).alias("key"), F.explode_outer(words).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % dims
    counts = terms.groupBy("key", bucket.alias("bucket")).agg(F.count("word").cast("double").alias("n"))
    held = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.when(c("bucket").isNotNull(), F.struct("bucket", "n")))).alias("held"), F.sqrt(F.sum(c("n") * c("n"))).alias("norm"))
    value = lambda i: F.coalesce(F.element_at("held", i) / F.nullif(c("norm"), F.lit(0.0)), F.lit(0.0))
    return held.select(c("key").alias(key), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), value).alias("embedding"))
