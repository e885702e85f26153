"""Prompt messages as arrays of (role, content), built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsontext import LISTING
from ..policy import by_relation

MESSAGES = "array<struct<role: string, content: string>>"
# What each relation asks for, and what distinguishes a subject.
DEFINITIONS = {
    "awardWonBy": "every person or organisation that has received the award",
    "companyTradesAtStockExchange": "every exchange that lists the company's own shares; none for private companies and subsidiaries without a listing",
    "countryLandBordersCountry": "every sovereign state that shares a boundary on land with the country; none for islands without one",
    "hasArea": "the total area in square kilometres, as one plain number",
    "hasCapacity": "the number of people that the venue holds, as one plain number",
    "personHasCityOfDeath": "the city or town where the person died; none for living persons and where it is not known",
}
IDENTITIES = {
    "awardWonBy": "who gives the award, in what field, since when",
    "companyTradesAtStockExchange": "country, industry, legal form and parent of the company",
    "countryLandBordersCountry": "the state's territory, with overseas parts",
    "hasArea": "the kind of place and what it belongs to",
    "hasCapacity": "the venue, its city and what it is used for",
    "personHasCityOfDeath": "profession, country and years of life",
}
# Samples of a relation look at its question from these sides in turn.
FOCI = {
    "awardWonBy": ("winners of the early years", "recent winners", "winners outside the best-known country", "organisations, pairs and groups"),
    "companyTradesAtStockExchange": ("the first listing", "second listings abroad", "whether the company is listed at all"),
    "countryLandBordersCountry": ("all compass directions in turn", "short or remote boundaries", "exclaves and overseas parts"),
    "hasArea": ("the official figure", "a figure in another unit, converted"),
    "hasCapacity": ("seats in the present state", "the figure most often published"),
    "personHasCityOfDeath": ("whether the person is still alive", "the place named in obituaries", "the city rather than the region"),
}
CLOSED_BOOK = "Answer from what you have learnt alone; do not browse, call tools or ask for documents."


def message(role: str, content: Column) -> Column:
    """One message."""
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def form(strict: bool, reasoned: bool, relation: Column) -> Column:
    """The sentence that asks for an answer's form; ``strict`` if the request carries a schema."""
    lead = "Return only the constrained object" if strict else "Return only JSON"
    why = "`rationale` and " if reasoned else ""
    listing = F.lit(f"{lead} with {why}`candidates`, each with `recipient`, `work` and `year`; a work never stands for its recipient.")
    return F.when(relation.isin(*LISTING), listing).otherwise(F.lit(f"{lead} with {why}`answers`, a list of strings."))


def _asks(relation: Column) -> Column:
    return F.concat(F.lit("\nRelation: "), relation, F.lit("\nDefinition: "), by_relation(DEFINITIONS, relation))


def anchor_lead(strict: bool) -> str:
    """How a question of identity begins."""
    lead = "Return only the constrained object" if strict else "Return only JSON"
    return f"{CLOSED_BOOK} Say briefly which subject is meant and admit what is uncertain. {lead} with `description` and `identity_checks`."


def anchor_messages(subject: Column, relation: Column, strict: bool) -> Column:
    """Asks who or what exactly the subject is."""
    system = F.concat(
        F.lit(anchor_lead(strict)),
        _asks(relation),
        F.lit("\nTell apart by: "),
        by_relation(IDENTITIES, relation),
    )
    return F.array(message("system", system), message("user", F.concat(F.lit("Subject: "), subject))).cast(MESSAGES)


def answer_json(relation: Column, objects: Column, rationale: Column) -> Column:
    """An example's answer in the form that is asked for."""
    given = F.when(F.coalesce(rationale.rlike(r"\S"), F.lit(False)), rationale).otherwise(F.lit("A checked training example."))
    none = F.lit(None)
    listed = F.transform(objects, lambda o: F.struct(o.alias("recipient"), none.cast("string").alias("work"), none.cast("int").alias("year")))
    whole = {"ignoreNullFields": "false"}
    listing = F.to_json(F.struct(given.alias("rationale"), listed.alias("candidates")), whole)
    return F.when(relation.isin(*LISTING), listing).otherwise(F.to_json(F.struct(given.alias("rationale"), objects.alias("answers")), whole))


def candidate_messages(subject: Column, relation: Column, focus: Column, anchor: Column, shots: Column, strict: bool) -> Column:
    """Asks for the objects; ``shots`` are the examples' messages."""
    system = F.concat(
        F.lit(f"{CLOSED_BOOK} The world is as of 1 July 2026. "),
        form(strict, True, relation),
        _asks(relation),
        F.lit("\nLook at: "),
        focus,
        F.lit("\nA first guess who is meant, which may be wrong: "),
        anchor,
    )
    return F.concat(F.array(message("system", system)), shots, F.array(message("user", F.concat(F.lit("Subject: "), subject)))).cast(MESSAGES)


def completion_messages(subject: Column, relation: Column, found: Column, anchor: Column, strict: bool) -> Column:
    """Asks what a set lacks."""
    system = F.concat(F.lit(f"{CLOSED_BOOK} Name only what is missing from the set. "), form(strict, False, relation), _asks(relation), F.lit("\nA first guess who is meant: "), anchor)
    return F.array(message("system", system), message("user", F.concat(F.lit("Subject: "), subject, F.lit("\nSet: "), F.to_json(found)))).cast(MESSAGES)


def verification_messages(subject: Column, relation: Column, found: Column, strict: bool) -> Column:
    """Asks which of the candidates hold."""
    said = F.lit(f"{CLOSED_BOOK} Keep every candidate that holds and reject clear errors only; copy the strings as they are. ")
    system = F.concat(said, form(strict, False, relation), _asks(relation))
    return F.array(message("system", system), message("user", F.concat(F.lit("Subject: "), subject, F.lit("\nCandidates: "), F.to_json(found)))).cast(MESSAGES)
