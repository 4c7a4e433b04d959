"""Column helpers: vocabulary terms, roles, natural order, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: vocabulary terms of the data model; "local" stands for the installation's own vocabulary.
IS_PART_OF, TITLE, TYPE, SUBJECT = "dcterms:isPartOf", "dcterms:title", "dcterms:type", "dcterms:subject"
LANGUAGE, FORMAT, SPATIAL, PROVENANCE = "dcterms:language", "dcterms:format", "dcterms:spatial", "dcterms:provenance"
CREATOR, CONTRIBUTOR, PUBLISHER = "dcterms:creator", "dcterms:contributor", "dcterms:publisher"
FUNDER, TEMPORAL, ABSTRACT = "frapo:isFundedBy", "dcterms:temporal", "dcterms:abstract"
AUTHORS, EDITORS, MEMBER, SERIES = "bibo:authorList", "bibo:editorList", "foaf:member", "local:series"
RELATED = (
    "dcterms:hasFormat", "dcterms:hasPart", "dcterms:hasVersion", "dcterms:isReplacedBy", "dcterms:isVersionOf", "dcterms:relation", "dcterms:replaces",
)
LATITUDE, LONGITUDE = "geo:lat", "geo:long"
DATE_RANKS = {"dcterms:issued": 1, "dcterms:created": 2, "dcterms:date": 3, "local:hasDateCollected": 4}
LITERAL_TERMS = (
    "bibo:authorList", "bibo:doi", "bibo:editorList", "bibo:pages", "dcterms:abstract", "dcterms:description", "dcterms:extent",
    "dcterms:identifier", "dcterms:publisher", "dcterms:spatial", "dcterms:subject", "local:id", "bibo:abstract",
)
ORGANISATION, PERSON, PROJECT, LOCATION, GROUP, JOURNAL, BOOK_SERIES = (
    "foaf:Organization", "foaf:Person", "foaf:Project", "dcterms:Location", "frapo:ResearchGroup", "bibo:Journal", "bibo:Series",
)
#: marcrel codes that name a place, not an agent.
PLACE_ROLES = ("marcrel:dbp", "marcrel:evp", "marcrel:mfp", "marcrel:prp", "marcrel:pup", "marcrel:uvp")
# --- End of fixed values.

CREDITS = (CREATOR, CONTRIBUTOR, AUTHORS, EDITORS)


def is_place_role(term: Column) -> Column:
    return term.isin(*PLACE_ROLES)


def is_agent_role(term: Column) -> Column:
    return term.startswith("marcrel:") & ~is_place_role(term)


def is_credit(term: Column) -> Column:
    return term.isin(*CREDITS) | is_agent_role(term)


def is_institution_credit(term: Column) -> Column:
    return term.isin(FUNDER, PROVENANCE, PUBLISHER, AUTHORS, EDITORS) | is_agent_role(term)


def role_label(term: Column) -> Column:
    """The local name of a credit; the two bibo lists are author and editor."""
    return (
        F.when(term == AUTHORS, "author").when(term == EDITORS, "editor").otherwise(F.substring_index(term, ":", -1))
    )


def natural_key(text: Column) -> Column:
    """Sorts as people count: case folded, "item 2" before "item 10"."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def iso_seconds(text: Column) -> Column:
    """Seconds of PT#H#M#S in any case; 0 for anything else."""
    pattern = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long"), F.lit(0))
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(text.rlike(pattern), seconds).otherwise(F.lit(0)).cast("long")


def minus_months(day: Column, months: int) -> Column:
    """Day of month is kept and overflows: 31 May less 3 months is 31 February, that is 3 March."""
    first = F.add_months(F.trunc(day, "month"), -months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def first_year(text: Column) -> Column:
    """The first four digits in a row, or null."""
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit(""))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")
