"""Spelling variants against a plain comparison of all words."""
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ownerlens.llm import spelling

SCHEMA = "doc_id bigint, text string"


def plain_words(rows, garble=31, least=7, often=2):
    count = Counter()
    for doc_id, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= often}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, **options):
    count = plain_words(rows, **options)
    near = {w: [v for v in count if one_apart(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v.encode()), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def variants(spark, rows, **options):
    return sorted((tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=lambda r: r[0])


def test_random_words_of_a_small_alphabet(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abÀé") for _ in range(rnd.randint(7, 12))) for _ in range(60)]

    def edit(w):
        i, c = rnd.randrange(len(w) + 1), rnd.choice("abÀé")
        return rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])

    rows = [(i, " ".join(rnd.choice([s, s, edit(s), s.upper()]) for s in rnd.choices(stems, k=40))) for i in range(60)]
    want = plain(rows)
    assert variants(spark, rows) == want and sum(r[4] for r in want) > 100


def test_every_place_of_an_edit(spark):
    base = "abcdefghi"
    near = {base[:i] + x + base[j:] for i in range(10) for j in (i, i + 1) for x in ("", "z", base[i - 1 : i]) if j <= 9} | {base}
    rows = [(1, " ".join(sorted(w for w in near if len(w) >= 7)) + " ")] * 2
    assert variants(spark, rows, garble=0) == plain(rows, garble=0)


def test_forms_follow_to_the_last_and_ties_go_to_the_smallest(spark):
    text = ["letters"] * 2000 + ["lettersx"] * 200 + ["lettersxy"] * 20 + ["lettersxyz"] * 2 + ["between"] * 30 + ["betweeN"] * 30 + ["abetween"] * 2
    text += ["zebraas"] * 40 + ["cebraas"] * 40 + ["xebraas"] * 3
    rows = [(1, " ".join(text))]
    got = variants(spark, rows, garble=0)
    assert got == plain(rows, garble=0)
    by = {r[0]: r for r in got}
    assert by["lettersxyz"][1:3] == ("lettersxy", "letters") and by["xebraas"][1] == "cebraas" and by["between"][1:4] == (None, "between", 60)


def test_runs_families_of_lengths_and_a_very_long_word(spark):
    long = "".join(random.Random(2).choices("abc", k=30_000))
    rows = [(1, " ".join("a" * k for k in range(7, 40)) + " 7 " + long + "_" + long + "b"), (2, " ".join("A" * k for k in range(7, 40)) + f"\n{long}\t{long}b.")]
    assert variants(spark, rows, garble=0) == plain(rows, garble=0)


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(None, "oneword Oneword"), (None, "onewords"), (3, "onewords×÷ onewords×÷")], [(5, "Straße STRASSE straße straẞe")] * 3])
def test_nulls_repeats_and_letters_outside_ascii(spark, rows):
    assert variants(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    rows = [(i, "lantern lanterns lantarn Lantern") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert spelling.variants(docs.limit(0)).collect() == []
    names = ("word", "run", "id", "h", "n", "t", "way", "size", "_w", "_v", "_m", "_n", "_r", "node", "form", "root")
    got = sorted((tuple(r) for r in spelling.variants(docs.withColumns({n: F.lit("x") for n in names})).collect()), key=lambda r: r[0])
    assert got == plain(rows)
