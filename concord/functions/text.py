"""Tokens, keys and comparisons of names, companies, titles and places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a title.
TITLE_STOPWORDS = (
    "a", "an", "and", "the", "of", "for", "with", "to", "in", "on", "at", "call",
    "meeting", "session", "sync", "review", "update", "prep", "discussion", "check",
    "annual", "quarterly", "q1", "q2", "q3", "q4", "year", "end",
)
#: Parts of a location that stand for a call, not a place.
VIRTUAL_MARKERS = ("zoom", "teams", "meet", "webex", "virtual", "http", "dial")
#: Words that tell no place from another.
LOCATION_STOPWORDS = ("the", "office", "room", "floor", "at", "in", "-")
#: Clients that stand for nobody in particular.
PLACEHOLDER_CLIENTS = ("multiple", "various", "n/a", "tbd", "unknown")
#: A meeting's life, least advanced first.
LIFECYCLE = ("tentative", "scheduled", "confirmed", "completed")

LONG = 4


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def email_key(email: Column) -> Column:
    return name_key(F.substring_index(email, "@", 1))


def identity_key(value: Column) -> Column:
    """A person by name or address: what stands before an @, letters and digits only."""
    return email_key(value)


def domain_root(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", 1))


def company_parts(company: Column) -> tuple[Column, Column]:
    """A company's first word, null if it is short, and its initials, null without words."""
    words = tokens(company)
    first = F.get(words, F.lit(0))
    initials = F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), ""))
    return F.when(F.length(first) >= LONG, first), initials


def root_is_of(root: Column, first: Column, initials: Column) -> Column:
    """The root starts with the company's first long word or the other way round, or is its initials."""
    near = F.startswith(root, first) | F.startswith(first, root)
    return (root != "") & (F.coalesce(near, F.lit(False)) | F.coalesce(root == initials, F.lit(False)))


def company_matches_domain(company: Column, domain: Column) -> Column:
    return F.coalesce(root_is_of(domain_root(domain), *company_parts(company)), F.lit(False))


def company_cells(first: Column, initials: Column) -> Column:
    """Keys of which a company shares one at least with every root that is its own (:func:`root_cells`)."""
    short = [F.concat(F.lit("r"), F.substring(first, 1, n)) for n in range(1, LONG)]
    return F.array_compact(F.array(F.concat(F.lit("p"), F.substring(first, 1, LONG)), *short, F.concat(F.lit("i"), initials)))


def root_cells(roots: Column) -> Column:
    whole = F.transform(roots, lambda r: F.array(F.when(F.length(r) >= LONG, F.concat(F.lit("p"), F.substring(r, 1, LONG))).otherwise(F.concat(F.lit("r"), r)), F.concat(F.lit("i"), r)))
    return F.array_distinct(F.flatten(whole))


def content_tokens(*parts: Column) -> Column:
    """Distinct words of several texts that are longer than two letters and say something."""
    useful = F.filter(F.flatten(F.array(*[tokens(p) for p in parts])), lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(useful), _words(TITLE_STOPWORDS))


def acronyms(ordered: Column) -> Column:
    """Initials of every run of two to four tokens; tokens of up to two letters stay whole."""
    short = F.transform(ordered, lambda t: F.when(F.length(t) <= 2, t).otherwise(F.substring(t, 1, 1)))
    none = F.array().cast("array<string>")

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(short) - n + 1, F.lit(1)))
        return F.when(F.size(short) >= n, F.transform(starts, lambda i: F.array_join(F.slice(short, i, n), ""))).otherwise(none)

    runs = [runs_of(n) for n in (2, 3, 4)]
    return F.array_distinct(F.concat(*runs))


def looks_virtual(location: Column) -> Column:
    return F.lower(location).rlike("|".join(VIRTUAL_MARKERS))


def long_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= LONG))


def place_tokens(text: Column) -> Column:
    return F.array_except(long_tokens(text), _words(LOCATION_STOPWORDS))


def more_specific(one: Column, other: Column) -> Column:
    a, b = F.lower(one), F.lower(other)
    return F.contains(a, b) & (a != b)


def meeting_id(ids: Column) -> Column:
    return F.lower(F.array_join(ids, "-"))


def lifecycle_rank(status: Column) -> Column:
    """Place in the life of a meeting; -1 for a status outside it."""
    return F.array_position(_words(LIFECYCLE), status) - 1
