"""Text operators as Column expressions: cleaning, URLs, language, tokens, SimHash, author hash."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities that are decoded, tracking parameters (matched as prefixes), host prefixes. The stop words are
# common function words of English and of German, French and Spanish, chosen here.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "#x27": "'"}
TRACKING = ("utm_", "ref", "fbclid", "gclid", "share", "si=")
HOSTS = ("www.", "m.", "old.", "amp.")
ENGLISH = "the and of to in is that for it with was on are this have from by be not they which you".split()
OTHER = "der die das und ist nicht ein eine les des est que une dans pour pas los las con para del por una como el la de".split()
MAX_CLEAN = 4000


def _one_pass(text: Column, table: dict[str, str]) -> Column:
    """Decode entities in a single pass, so that what a decoded one makes is not decoded again: split at entities, map, join."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(text, "&(" + "|".join(table) + ");", f"{mark}$1{mark}"), mark)
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    # what stands between marks has an odd place
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(known[p], p)).otherwise(p)), "")


def clean_text(text: Column, most: int = MAX_CLEAN) -> Column:
    """Drops script and style blocks and markup, decodes entities once, strips zero-width and control characters, joins white space, cuts at ``most`` characters."""
    x = F.regexp_replace(text, "\u0001", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    x = _one_pass(x, ENTITIES)
    x = F.regexp_replace(x, "[​-‍﻿]", "")
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, most)


def canonical_url(url: Column) -> Column:
    """Lower-case host without common prefixes, no fragment, no tracking parameters, no trailing slash; null if it isn't a URL."""
    ok = url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+")
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"://([^/?]+)", 1)), "^(" + "|".join(h.replace(".", r"\.") for h in HOSTS) + ")", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"://[^/?]+([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~reduce(lambda a, b: a | b, [F.lower(p).startswith(t) for t in TRACKING]))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(ok, F.concat(scheme, F.lit("://"), host, path, query))


def extract_urls(text: Column) -> Column:
    """N3."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')]+)"), F.lit(1))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^\s<>\"')]+", " ")


def preview(text: Column, most: int) -> Column:
    """N4."""
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def language(text: Column) -> Column:
    """Struct of language (en, other, unknown) and confidence from scripts and stop words.

    Each count is one pass over the text; a word is a longest run of a to z and apostrophes.
    """
    word = lambda words: F.lit("(?<![a-z'])(?:" + "|".join(words) + ")(?![a-z'])")
    low = F.lower(text)
    kept = lambda what: F.char_length(F.regexp_replace(text, f"[^{what}]+", ""))
    counts = F.struct(kept(r"\p{L}").alias("letters"), kept("A-Za-z").alias("latin"), F.regexp_count(low, F.lit("[a-z']+")).alias("n"), F.regexp_count(low, word(ENGLISH)).alias("en"), F.regexp_count(low, word(OTHER)).alias("other"))
    answer = lambda lang, conf: F.struct(F.lit(lang).alias("lang"), conf.cast("double").alias("confidence"))

    def decide(c: Column) -> Column:
        return (
            F.when((c.letters > 20) & (c.latin / c.letters < 0.6), answer("other", F.lit(0.9)))
            .when(c.n < 4, answer("unknown", F.lit(0.3)))
            .when((c.other > c.en) & (c.other >= 2), answer("other", F.least(F.lit(0.95), 0.5 + c.other / c.n)))
            .when((c.en == 0) & (c.n >= 8), answer("unknown", F.lit(0.4)))
            .otherwise(answer("en", F.least(F.lit(0.99), 0.6 + c.en / c.n)))
        )

    # bound to a name, so that the counts are made once
    return F.transform(F.array(counts), decide)[0]


def normalised(text: Column) -> Column:
    """For exact comparison: lower case, no URLs, letters, digits and $ only."""
    x = F.regexp_replace(F.lower(text), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9$ ]", " "), " +", " "))


def simhash(text: Column) -> Column:
    """64-bit SimHash over word bigrams of the normalised text, as a long (N7). 0 without words.

    Per-bit sums are vectorised in an Arrow UDF; as higher-order functions they take some hundred times as long.
    """

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            words = (t or "").split()
            pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words
            if pairs:
                h = np.array([xxhash.xxh64_intdigest(p) for p in pairs], np.uint64)
                ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
        return pd.Series(out.view(np.int64))

    return of(normalised(text))


def hamming(a: Column, b: Column) -> Column:
    """N8."""
    return F.bit_count(a.bitwiseXOR(b))


def tokens(text: Column) -> Column:
    """Words with inner & ' + . -, an optional leading $, and + at the end."""
    return F.regexp_extract_all(text, F.lit(r"\$?[A-Za-z0-9](?:[A-Za-z0-9&'’+.\-]*[A-Za-z0-9+])?"), F.lit(0))


def author_hash(salt: Column, source: Column, handle: Column) -> Column:
    """N17."""
    return F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws(":", salt, source, handle), 256), 1, 16))
