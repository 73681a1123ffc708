"""Spelling variants by a relational trie: words one edit apart, and the common form of each.

Words stand in two tries, one over their letters and one over them reversed. States
(word, position, node, edits) are joined with the edge table level by level; a word
that ends where an edited state has used up its letters is a neighbour. Of two words
one edit apart, the edit lies in the second half of one of the two readings, so a
state starts at the node of half its word, without an edit, and no state ever stands
at the crowded nodes near the root. Both tries together find every pair, from both
of its words.

Nodes are hashes of prefixes. Nodes with one way on that end no word and start no
state are passed over: an edge bears the letters between two nodes that are kept, so
levels follow branchings and not letters. A node has at most one edge per letter, so
many words at one node do not multiply, and edges tell the next letters and the least
and most letters of what lies below, so states without hope are never written. Pairs are held against the words themselves,
so equal hashes of two prefixes add nothing. Words are counted by partial aggregates
before any shuffle; levels are written to the shared folder.

Defined cases: a null or empty text has no words; a null id counts as empty text
where runs are garbled; repeated rows count each; an empty table gives an empty
result; extra columns are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ownerlens.session import materialise

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is this many times as frequent as the word.
RATIO = 10
#: Runs whose check sum this divides lose a letter; 0 leaves all runs as they are.
GARBLE = 31
#: Letters a node knows of what follows it.
AHEAD = 4
#: States (of twenty letters) up to which they are sent to the edges instead of being dealt with them.
FEW = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, text: str = "text", garble: int = GARBLE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of ``min_length`` letters or more that occur ``min_count`` times or more."""
    # Begun at its first letter and greedy, each match is a maximal run; shorter runs give no word.
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![A-Za-zÀ-ÿ])[A-Za-zÀ-ÿ]{{{min_length},}}+"), 0)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if garble:
        found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % garble == 0, less).otherwise(F.col("run"))
    found = found.select(word.alias("word"))
    if garble:
        found = found.filter(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _readings(vocabulary: DataFrame) -> DataFrame:
    """(way, t, size): every word forwards (0) and backwards (1)."""
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("t")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("t")))
    return vocabulary.select(F.explode(ways).alias("r")).select("r.way", "r.t", F.length("r.t").alias("size"))


def _node(way: Column, t: Column, depth: Column) -> Column:
    return F.xxhash64(way, F.substr(t, F.lit(1), depth))


def _ahead(t: Column, depth: Column) -> Column:
    """The next letters after ``depth``, filled up with full stops beyond the end."""
    return F.rpad(F.substr(t, depth + 1, F.lit(AHEAD)), AHEAD, ".")


def edge_table(readings: DataFrame) -> DataFrame:
    """(node, child, label, ahead, lo, hi): edges between kept nodes, and what follows the child.

    ``ahead`` lists the next letters of the words below the child, between commas;
    ``lo`` and ``hi`` are the least and most letters these words still have.
    """
    depths = F.explode(F.sequence(_half(F.col("size") - 1), F.col("size")))
    steps = readings.select("way", "t", "size", depths.alias("depth"))
    steps = steps.withColumn("node", _node(F.col("way"), F.col("t"), F.col("depth")))
    next_, left = F.substr("t", F.col("depth") + 1, F.lit(1)), F.col("size") - F.col("depth")
    kept = steps.groupBy(F.col("node").alias("_n")).agg(
        F.min(next_).alias("a"), F.max(next_).alias("z"), F.max((left == 0) | (F.col("depth") == _half(F.col("size")))).alias("stop"),
        F.min(left).alias("lo"), F.max(left).alias("hi"), F.collect_set(_ahead(F.col("t"), F.col("depth"))).alias("ahead"))
    kept = kept.filter((F.col("a") != F.col("z")) | F.col("stop")).select("_n", "lo", "hi", F.concat(F.lit(","), F.array_join("ahead", ","), F.lit(",")).alias("ahead"))
    kept = materialise(kept, "trie-nodes")
    chain = steps.join(kept, F.col("node") == F.col("_n"), "left_semi").groupBy("way", "t", "size").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("at"))
    pairs = F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("a"), F.slice("at", F.lit(2), F.size("at")).alias("b"))
    pairs = chain.filter(F.size("at") > 1).select("t", "size", F.explode(pairs).alias("e")).select("t", "size", "e.a", "e.b")
    label = F.substr("t", F.col("a.depth") + 1, F.col("b.depth") - F.col("a.depth"))
    edges = pairs.select(F.col("a.node").alias("node"), F.col("b.node").alias("child"), label.alias("label")).distinct()
    return edges.join(kept, F.col("child") == F.col("_n")).drop("_n")


def _moves() -> Column:
    """States (pos, edits) that follow from a state and an edge: the label read as it is, or with one edit in or before it; null where none does."""
    t, pos, label = F.col("t"), F.col("pos"), F.col("label")
    size = F.length(label)

    def piece(k: int) -> Column:
        return F.substr(t, pos + 1, size + k)

    def hopeful(at: Column, edits: Column) -> Column:
        """Whether a word below the child can still be met."""
        left, free = F.col("size") - at, 1 - edits
        fits = (left >= F.col("lo") - free) & (left <= F.col("hi") + free)
        reads = F.contains(F.col("ahead"), F.concat(F.lit(","), _ahead(t, at), F.lit(",")))
        return fits & F.when(edits == 1, reads).otherwise(F.col("hi") > 0)

    def edited(k: int) -> Column:
        near = (F.length(piece(k)) == size + k) & (F.levenshtein(piece(k), label, 1) == 1)
        at = pos + size + k
        return F.when((F.col("edits") == 0) & hopeful(at, F.lit(1)) & near, F.struct(at.alias("pos"), F.lit(1).alias("edits")))

    same = F.when((piece(0) == label) & hopeful(pos + size, F.col("edits")), F.struct((pos + size).alias("pos"), F.col("edits").alias("edits")))
    return F.array(same, edited(0), edited(-1), edited(1))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near): every ordered pair of words that differ by one inserted, deleted or replaced letter."""
    readings = _readings(vocabulary)
    edges = materialise(edge_table(readings), "trie-edges")
    half = _half(F.col("size"))
    states = readings.select("way", "t", "size", half.alias("pos"), _node(F.col("way"), F.col("t"), half).alias("node"), F.lit(0).alias("edits"), F.substr("t", F.lit(1), half).alias("read"))
    met = []
    while True:
        size = states.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t") + F.length("read")).alias("letters")).first()
        if not size["n"]:
            break
        here = states.withColumnRenamed("node", "_n")
        if size["n"] <= FEW and size["letters"] <= 20 * FEW:
            here = F.broadcast(here)
        steps = here.join(edges, F.col("_n") == F.col("node"))
        steps = steps.select("way", "t", "size", F.concat("read", "label").alias("read"), F.col("child").alias("node"), F.explode(_moves()).alias("m"))
        steps = steps.filter("m IS NOT NULL").select("way", "t", "size", "read", "node", "m.pos", "m.edits")
        # An edited state without letters left is hopeful only where a word ends.
        done = (F.col("edits") == 1) & (F.col("pos") == F.col("size"))
        on = ~done
        level = materialise(steps, "trie-level")
        met.append(level.filter(done).select("way", "t", "read"))
        states = level.filter(on).select("way", "t", "size", "pos", "node", "edits", "read")
    word = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    if not met:
        return states.select(word("t").alias("word"), word("read").alias("near"))
    return reduce(DataFrame.unionByName, met).select(word("t").alias("word"), word("read").alias("near")).distinct()


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent neighbour, of equal ones the smallest, if ``ratio`` times as frequent."""
    known = vocabulary.select(F.col("word").alias("_v"), F.col("n").alias("_m"))
    near = pairs.join(known, F.col("near") == F.col("_v")).groupBy(F.col("word").alias("_w")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_m")).alias("m"), F.col("_v").alias("v"))).alias("best"))
    met = vocabulary.join(near, F.col("word") == F.col("_w"), "left")
    high = -F.col("best.m") >= ratio * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(high, F.col("best.v")).alias("form"), F.when(high, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(_w, root) for words with a form: the last of their chain. Chains halve every round and, as counts multiply along them, are short."""
    links = materialise(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = links.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
        moved = materialise(moved, "forms")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links.select(F.col("word").alias("_w"), "root")


def variants(docs: DataFrame, text: str = "text", garble: int = GARBLE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    vocabulary = materialise(words(docs, text, garble, min_length, min_count), "words")
    found = materialise(forms(vocabulary, neighbours(vocabulary), ratio), "word-forms")
    met = found.join(roots(found), F.col("word") == F.col("_w"), "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
