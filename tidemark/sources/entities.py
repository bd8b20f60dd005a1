"""Names of companies to what texts may call them (N12, J19), and aliases that are words of the language besides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resolve import Entity
from tidemark.sources.shared import cut

# Legal forms that end a company's name; those that may carry a full stop; how many are taken off; the
# shortest short name, and the longest ticker that is ambiguous by its length.
FORMS = ("Incorporated", "Corporation", "Company", "plc", "Holdings", "Group")
ABBREVIATED = ("Inc", "Corp", "Co", "Ltd", "& Co")
FORMS_TAKEN, SHORTEST, AMBIGUOUS_LENGTH = 3, 3, 2
#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII; what lies between them.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Aliases that are sent to all tasks, and bytes that they may have on average.
SENT, SENT_BYTES = 1 << 18, 64


def short_name(name: Column, forms: tuple[str, ...] = FORMS, abbreviated: tuple[str, ...] = ABBREVIATED) -> Column:
    """A name without a leading The and up to three closing legal forms, in any case; one that is a form alone stays."""
    form = "|".join([*map(re.escape, forms), *[re.escape(a) + r"\.?" for a in abbreviated]])
    bare = F.regexp_replace(F.trim(name), r"(?i)^The\s+", "")
    return F.trim(F.regexp_replace(bare, rf"(?i)(?:,?\s+(?:{form})){{1,{FORMS_TAKEN}}}$", ""))


LISTS = ("short_names", "products", "subsidiaries", "misspellings", "exclusions", "ambiguous_aliases")


def entities(companies: DataFrame, overrides: DataFrame | None = None, former: DataFrame | None = None, ambiguous_tickers: tuple[str, ...] = ()) -> DataFrame:
    """(entity, cashtag, official_name, the ``LISTS``, ambiguous_ticker, previous, search_term, sector) of companies (entity, name, sector).

    ``overrides`` (entity, some of ``LISTS`` as arrays, maybe search_term) add to what the name gives; ``former``
    (entity, ticker) are tickers that an entity had. Short names are those given, then the derived one, each once
    and of three characters at least; exclusions are lower-cased; a ticker of one or two characters is ambiguous,
    and so are those named. Nulls in lists are left out; a null name gives no short name; an entity has one row
    in ``companies`` and in ``overrides``.
    """
    x = companies.select("entity", "name", "sector").withColumn("derived", short_name(F.col("name")))
    given = set() if overrides is None else set(overrides.columns)
    if overrides is not None:
        x = x.join(overrides.select("entity", *[F.col(c).alias(f"given_{c}") for c in (*LISTS, "search_term") if c in given]), "entity", "left")
    empty = F.array().cast("array<string>")
    said = {c: F.array_compact(F.coalesce(F.col(f"given_{c}"), empty)) if c in given else empty for c in LISTS}
    said["short_names"] = F.filter(F.array_distinct(F.array_compact(F.concat(said["short_names"], F.array("derived")))), lambda s: F.char_length(s) >= SHORTEST)
    said["exclusions"] = F.transform(said["exclusions"], F.lower)
    if former is not None:  # tickers of an entity are a handful
        own = former.where(F.col("ticker").isNotNull() & ~F.col("ticker").eqNullSafe(F.col("entity"))).groupBy("entity").agg(F.array_sort(F.collect_set("ticker")).alias("previous"))
        x = x.join(own, "entity", "left")
    return x.select(
        "entity",
        F.concat(F.lit("$"), "entity").alias("cashtag"),
        F.col("name").alias("official_name"),
        *[said[c].alias(c) for c in LISTS],
        (F.col("entity").isin(*ambiguous_tickers) | (F.char_length("entity") <= AMBIGUOUS_LENGTH)).alias("ambiguous_ticker"),
        (F.coalesce("previous", empty) if former is not None else empty).alias("previous"),
        (F.coalesce("given_search_term", "derived") if "search_term" in given else F.col("derived")).alias("search_term"),
        "sector",
    )


def aliases(rows: DataFrame) -> DataFrame:
    """(entity, alias, kind): one row for each alias of each entity."""
    kinds = ("short_names", "products", "subsidiaries", "misspellings")
    listed = F.flatten(F.array(*[F.transform(c, lambda a, c=c: F.struct(a.alias("alias"), F.lit(c).alias("kind"))) for c in kinds]))
    return rows.select("entity", F.explode(listed).alias("x")).select("entity", "x.*").distinct()


def _runs(words: str, longest: int) -> Column:
    """Runs of up to ``longest`` words of the array column ``words``, joined by blanks. Arrays are shifted and zipped whole,
    as taking a slice at each place would copy the array each time."""
    runs, out = F.col(words), [F.col(words)]
    for n in range(2, longest + 1):
        # null where the shifted array has ended
        runs = F.array_compact(F.zip_with(runs, F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda run, word: F.concat(run, F.lit(" "), word)))
        out.append(runs)
    return F.flatten(F.array(*out))


def alias_use(names: DataFrame, docs: DataFrame, share: int = 50, sent: int = SENT) -> DataFrame:
    """(alias, plain, cased, ambiguous): how documents (text) write each different alias of ``names``, lower-cased.

    ``plain`` counts the documents that write it all in lower case somewhere, ``cased`` those that write it
    otherwise somewhere; an alias is ambiguous, being a word of the language, where plain uses are ``share`` per cent
    of both at least. An alias is the words in it; one without words is left out. A null text has none;
    aliases that no document holds have zeros. Whole texts are read once, and a document counts a run of words once. Up
    to ``sent`` aliases go to all tasks, so that only runs that are aliases are shuffled, pre-aggregated; of more
    aliases all runs are counted, pre-aggregated too, before they meet them.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    wanted = names.select(F.array_join(F.transform(words(F.col("alias")), F.lower), " ").alias("alias")).where("alias <> ''").distinct()
    wanted = docs.sparkSession.read.schema(wanted.schema).parquet(cut(wanted, "aliases"))  # read three times
    n, size, longest = wanted.agg(F.count("*"), F.sum(F.octet_length("alias")), F.max(F.size(F.split("alias", " ")))).first()
    found = docs.select(words(F.col("text")).alias("words"))
    # one mark of one character and the run in lower case: strings are told apart by hashing, structs only one by one
    marked = F.transform(F.array_distinct(_runs("words", longest or 1)), lambda r: F.when(r == F.lower(r), F.concat(F.lit("+"), r)).otherwise(F.concat(F.lit("-"), F.lower(r))))
    used = found.select(F.explode(F.array_distinct(marked)).alias("use")).select(F.substring("use", 2, 1 << 30).alias("alias"), F.startswith("use", F.lit("+")).alias("plain"))
    count = lambda x: x.groupBy("alias").agg(F.count_if("plain").alias("plain"), F.count_if(~F.col("plain")).alias("cased"))
    if n <= sent and (size or 0) <= sent * SENT_BYTES:
        counts = count(used.join(F.broadcast(wanted), "alias", "left_semi"))
    else:
        counts = count(used).join(wanted, "alias", "left_semi")
    out = wanted.join(counts, "alias", "left").select("alias", F.coalesce("plain", F.lit(0)).cast("long").alias("plain"), F.coalesce("cased", F.lit(0)).cast("long").alias("cased"))
    return out.withColumn("ambiguous", (F.col("plain") > 0) & (F.col("plain") * 100 >= (F.col("plain") + F.col("cased")) * share))


def with_ambiguous(rows: DataFrame, use: DataFrame) -> DataFrame:
    """``rows`` of ``entities`` whose ambiguous_aliases also name those of their aliases that ``use`` calls ambiguous."""
    words = F.array_join(F.transform(F.regexp_extract_all("alias", F.lit(WORD), F.lit(0)), F.lower), " ")
    hit = aliases(rows).withColumn("key", words).join(use.where("ambiguous").select(F.col("alias").alias("key")), "key", "left_semi")
    more = hit.groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("more"))
    joined = rows.join(more, "entity", "left").withColumn("ambiguous_aliases", F.array_distinct(F.concat("ambiguous_aliases", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(*rows.columns)


def resolvable(rows: DataFrame) -> list[Entity]:
    """The entities as the resolver takes them; it holds all of them in one automaton, whose bound is checked there."""
    return [
        Entity(r.entity, r.official_name or "", tuple(r.short_names), tuple(r.products), tuple(r.subsidiaries), tuple(r.misspellings), tuple(r.previous), tuple(r.exclusions), tuple(r.ambiguous_aliases), r.ambiguous_ticker)
        for r in rows.orderBy("entity").collect()
    ]
