"""Text functions that don't depend on the rest of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_each(text: Column) -> Column:
    """Lower case character by character: a capital sigma becomes the plain small one anywhere."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """The distinct alphanumeric tokens of a text, lower-cased."""
    return F.array_distinct(F.filter(F.split(lower_each(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""))


def segments(name: Column) -> Column:
    """A camel-case or punctuated name as lower-case words, joined by spaces."""
    spaced = F.regexp_replace(name, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.array_join(F.filter(F.split(lower_each(spaced), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""), " ")


def local_name(iri: Column) -> Column:
    """What follows the last #, / or : of an identifier."""
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def search_key(text: Column) -> Column:
    """ASCII letters and digits alone, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def sha256(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def percent_encoded(text: Column) -> Column:
    """A text as part of an IRI: all but letters, digits and ``-._~`` of ASCII as percent-encoded UTF-8."""
    out = F.url_encode(text)  # which follows forms: a plus for a space, ``*`` as it is, ``~`` encoded
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
