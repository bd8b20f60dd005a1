"""Entity build: names, overrides, former tickers, and aliases that the corpus uses as words."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import entities as E

COMPANIES = "entity string, name string, sector string"


@pytest.mark.parametrize(
    "name, short",
    [
        ("Acme Inc", "Acme"),
        ("Acme, Inc.", "Acme"),
        ("The Acme Company", "Acme"),
        ("the  Acme GROUP HOLDINGS plc", "Acme"),
        ("Acme Group Holdings Co Inc", "Acme Group"),
        ("Acme & Co.", "Acme"),
        ("Acme Group.", "Acme Group."),
        ("Inc", "Inc"),
        ("Group Inc", "Group"),
        ("Theory Incorporated", "Theory"),
        ("Incorporated Wool Mills", "Incorporated Wool Mills"),
        ("  Acme Ltd ", "Acme"),
        ("", ""),
        (None, None),
    ],
)
def test_short_names(spark, name, short):
    assert spark.createDataFrame([(name,)], "name string").select(E.short_name(F.col("name"))).first()[0] == short


def test_entities_with_overrides_and_former_tickers(spark):
    x = spark.createDataFrame([("AC", "The Acme Group, Inc.", "tools"), ("BOLT", "Bolt Corp", None), ("CAT", "Ab Co", "tools"), ("DOG", None, "pets")], COMPANIES)
    over = spark.createDataFrame([("BOLT", ["Bolt", "Bolty", "Bo", None], ["ThunderBolt"], ["Nut and BOLT"], "bolt stock"), ("NONE", None, None, None, None)], "entity string, short_names array<string>, products array<string>, exclusions array<string>, search_term string")
    former = spark.createDataFrame([("BOLT", "NUT"), ("BOLT", "BLT"), ("BOLT", "NUT"), ("BOLT", "BOLT"), ("BOLT", None), (None, "X")], "entity string, ticker string")
    got = {r.entity: r for r in E.entities(x, over, former, ("CAT",)).collect()}
    assert set(got) == {"AC", "BOLT", "CAT", "DOG"}
    a, b, c, d = (got[k] for k in ("AC", "BOLT", "CAT", "DOG"))
    assert (a.short_names, a.cashtag, a.official_name, a.ambiguous_ticker, a.previous, a.search_term, a.sector) == (["Acme"], "$AC", "The Acme Group, Inc.", True, [], "Acme", "tools")
    assert (b.short_names, b.products, b.exclusions, b.previous, b.search_term, b.ambiguous_ticker, b.sector) == (["Bolt", "Bolty"], ["ThunderBolt"], ["nut and bolt"], ["BLT", "NUT"], "bolt stock", False, None)
    assert (c.short_names, c.ambiguous_ticker, d.short_names, d.search_term) == ([], True, [], None)
    assert [(e.ticker, e.names, e.previous_tickers, e.ambiguous_ticker) for e in E.resolvable(E.entities(x, over, former))] == [("AC", ("Acme",), (), True), ("BOLT", ("Bolt", "Bolty"), ("BLT", "NUT"), False), ("CAT", (), (), False), ("DOG", (), (), False)]
    assert E.entities(x.limit(0)).count() == 0


TEXTS = ["Apple sells apples and an apple", "the apple fell", "APPLE rose", None, "", "Cold Steel, cold  steel; cold-steel!", "Cold steel " * 3000, "straße Straße", "Apple sells apples and an apple"]


def plain_count(aliases, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    keys = {" ".join(w.lower() for w in word.findall(a)) for a in aliases if a}
    out = {}
    for key in keys - {""}:
        n, seen = len(key.split(" ")), []
        for t in texts:
            words = word.findall(t or "")
            runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            seen.append({r == key for r in runs if r.lower() == key})
        plain, cased = sum(True in s for s in seen), sum(False in s for s in seen)
        out[key] = (plain, cased, plain > 0 and plain * 100 >= (plain + cased) * 50)
    return out


@pytest.mark.parametrize("sent", [E.SENT, 2])
def test_alias_use_against_a_plain_count(spark, sent):
    names = ["Apple", "APPLE", "cold steel", "Cold Steel", "Straße", "nothing of it", "the apple fell", "!", "", None]
    got = E.alias_use(spark.createDataFrame([(n,) for n in names], "alias string"), spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3), sent=sent)
    wanted = plain_count(names, TEXTS)
    assert {r.alias: (r.plain, r.cased, r.ambiguous) for r in got.collect()} == wanted
    assert wanted["apple"] == (3, 3, True) and wanted["cold steel"] == (1, 2, False) and wanted["nothing of it"] == (0, 0, False)
    assert E.alias_use(spark.createDataFrame([], "alias string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_ambiguous_aliases_reach_the_entities(spark):
    x = E.entities(spark.createDataFrame([("APL", "Apple Inc", "s"), ("CST", "Cold Steel Ltd", "s")], COMPANIES))
    use = E.alias_use(E.aliases(x), spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    got = {r.entity: r.ambiguous_aliases for r in E.with_ambiguous(x, use).collect()}
    assert got == {"APL": ["Apple"], "CST": []} and E.with_ambiguous(x, use).columns == x.columns
