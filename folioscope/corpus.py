"""The dataset that every operator reads: items, links and literals as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import LITERAL_TERMS

#: Columns of each table.
SCHEMAS = {
    "items": "item_id long, title string, template_id int, class_term string, created date, year int",
    "links": "src long, term string, dst long, ord long",
    "literals": "item_id long, term string, value string, ord long",
    "memberships": "set_id long, item_id long",
    "geo": "item_id long, lat double, lon double",
    "temporal": "item_id long, start string, end string",
}


@dataclass(frozen=True)
class Corpus:
    """``records`` are the items that answers are about; all others are entities that they link to.

    ``ord`` is a statement's place in reading order: every "first wins" rule
    goes by it.
    """

    items: DataFrame
    links: DataFrame
    literals: DataFrame
    memberships: DataFrame
    geo: DataFrame
    temporal: DataFrame
    records: DataFrame

    def titles(self) -> DataFrame:
        """(dst, title) of items with a title."""
        return self.items.where("title is not null and title != ''").select(F.col("item_id").alias("dst"), "title")

    def values(self, *terms: str) -> DataFrame:
        """Literals of some terms. Only those of LITERAL_TERMS are ever read from a source: any other is a mistake of the caller's, not an empty answer."""
        unknown = sorted(set(terms) - set(LITERAL_TERMS))
        if unknown:
            raise KeyError(f"literals of {', '.join(unknown)} aren't read")
        return self.literals.where(F.col("term").isin(*terms))

    def of_class(self, *classes: str) -> DataFrame:
        return self.items.where(F.col("class_term").isin(*classes)).select("item_id")

    def of_template(self, template_id: int) -> DataFrame:
        return self.items.where(F.col("template_id") == template_id).select("item_id")

    def linking_to(self, *terms: str) -> DataFrame:
        """(entity, item_id): items that link to each entity by any of the terms, once each (B2 for all entities at once)."""
        links = self.links.where(F.col("term").isin(*terms)) if terms else self.links
        return links.select(F.col("dst").alias("entity"), F.col("src").alias("item_id")).distinct()

    def scoped(self, members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """Links of the records in scope, and the columns that every answer is grouped by.

        ``members`` (entity, item_id) asks the question once per entity, in
        one pass for all of them; without it there is one answer for all
        records.
        """
        if members is None:
            return self.links.join(self.records, F.col("src") == F.col("item_id"), "left_semi"), []
        return self.links.join(members, F.col("src") == F.col("item_id")).drop("item_id"), ["entity"]

    def scoped_items(self, members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        if members is None:
            return self.items.join(self.records, "item_id", "left_semi"), []
        return self.items.join(members, "item_id"), ["entity"]

    def validate(self) -> dict[str, int]:
        """Counts of rows that break a rule; all 0 in a sound corpus (A11)."""
        known = self.items.select("item_id")
        bad = {
            "items_twice": self.items.groupBy("item_id").count().where("count > 1").count(),
            "links_from_nowhere": self.links.join(known, F.col("src") == F.col("item_id"), "left_anti").count(),
            "links_to_nowhere": self.links.join(known, F.col("dst") == F.col("item_id"), "left_anti").count(),
            "links_twice": self.links.groupBy("src", "term", "dst").count().where("count > 1").count(),
            "literals_of_nothing": self.literals.join(known, "item_id", "left_anti").count(),
            "bad_coordinates": self.geo.where("not (lat between -90 and 90 and lon between -180 and 180)").count(),
        }
        return bad
