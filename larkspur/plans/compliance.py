"""Screening of contacts against sanctions lists, with risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.fixed_values import COMPLEX_PRODUCTS, CUSTOMER_TYPES, DERIVATIVE_PRODUCTS
from larkspur.functions import risk, text
from larkspur.functions.numbers import bound
from larkspur.operators import joins, selection

WEALTH = "array<struct<sourceType:string>>"
EXPERIENCE = "array<struct<assetClass:string>>"
REGULATORY = "array<struct<status:string,code:string,detail:string,details:string>>"


def list_hits(contacts: DataFrame, ofac: DataFrame, uk: DataFrame, un: DataFrame) -> DataFrame:
    """(id, ofac, uk, un): hits of each contact's normalised name; a list's entry once, whichever of its names matched."""
    name = [text.normalized_name(F.col("name"))]
    uk_names = F.array(*[text.normalized_name(F.col(f"`Name {i}`")) for i in range(1, 7)], text.normalized_name(F.concat_ws(" ", *[f"`Name {i}`" for i in (1, 2, 3, 4, 5, 6)])))
    un_names = F.concat(F.array(text.normalized_name(F.col("name"))), F.transform(F.split(F.coalesce("aliases", F.lit("")), "\\|"), lambda a: text.normalized_name(a)))
    hits = [
        joins.name_hits(contacts, "id", name, ofac, "entity_number", F.array(text.normalized_name(F.col("name"))), "ofac"),
        joins.name_hits(contacts, "id", name, uk, "`Unique ID`", uk_names, "uk"),
        joins.name_hits(contacts, "id", name, un, "id", un_names, "un"),
    ]
    out = contacts.select("id")
    for table, source in zip(hits, ("ofac", "uk", "un"), strict=True):
        out = out.join(table.select("id", F.col("hits").alias(source)), "id", "left")
    return out


def risk_columns(application: Column, advisor: Column) -> dict[str, Column]:
    """Risk parts of an application (variant): kind, country, customer, jurisdiction, product, introducer."""
    kind = risk.customer_type([F.try_variant_get(application, "$.customer.type", "string")])
    country = risk.application_country(application, kind)
    get = lambda path, schema: F.try_variant_get(application, path, schema)
    by_kind = lambda tail, schema: F.when(kind == "INDIVIDUAL", get(f"$.customer.accountHolder.{tail}", schema)).when(kind == "JOINT", get(f"$.customer.jointHolders.{tail}", schema)).otherwise(get(f"$.customer.organization.{tail}", schema))
    holder = lambda tail, schema: F.when(kind == "INDIVIDUAL", get(f"{risk.HOLDER['INDIVIDUAL']}.{tail}", schema)).when(kind == "JOINT", get(f"{risk.HOLDER['JOINT']}.{tail}", schema)).otherwise(get(f"{risk.HOLDER['ORG']}.{tail}", schema))
    accounts = risk.application_accounts(application)
    products, countries = risk.permitted(accounts, "product"), risk.permitted(accounts, "country")
    wealth, experience = by_kind("financialInformation[0].sourcesOfWealth", WEALTH), by_kind("financialInformation[0].investmentExperience", EXPERIENCE)
    regulatory = F.when(kind == "JOINT", F.lit(None).cast(REGULATORY)).otherwise(by_kind("regulatoryInformation[0].regulatoryDetails", REGULATORY))
    individuals = get("$.customer.organization.associatedEntities.associatedIndividuals", "array<variant>")
    entities = get("$.customer.organization.associatedEntities.associatedEntities", "array<variant>")
    customer = risk.customer_risk(
        kind,
        risk.adverse_signals(holder("isPEP", "boolean"), regulatory),
        (F.coalesce(F.size(entities), F.lit(0)) > 0) | (F.coalesce(F.size(individuals), F.lit(0)) > 2),
        F.exists(countries, lambda c: c != risk.upper(country)),
        F.exists(experience, lambda e: risk.upper(e["assetClass"]).isin(*COMPLEX_PRODUCTS, *DERIVATIVE_PRODUCTS)),
        F.size(wealth),
        F.exists(wealth, lambda w: F.upper(w["sourceType"]).contains("OTHER")),
        (risk.upper(holder("employmentType", "string")) == "SELFEMPLOYED") | (F.coalesce(holder("employmentDetails.businessDescription", "string"), F.lit("")) != ""),
    )
    return {
        "kind": kind, "country": country, "customer": customer, "jurisdiction": risk.jurisdiction_risk(country),
        "product": risk.product_risk(F.size(accounts), products, F.get(accounts, F.lit(0))["margin"]), "introducer": risk.introducer_risk(advisor),
    }


def screenings(contacts: DataFrame, links: DataFrame, accounts: DataFrame, ofac: DataFrame, uk: DataFrame, un: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Per contact not yet done (contact_id): hits, FATF status, risk parts and score; `error` where no account or no valid customer type is linked."""
    todo = contacts if done is None else contacts.join(done.select(F.col("contact_id").alias("id")).distinct(), "id", "left_anti")
    newest = selection.latest(links, ["contact_id"], [F.coalesce("updated", "created", F.lit("")).desc(), F.col("account_id")]).select(F.col("contact_id").alias("id"), "account_id")
    owned = todo.join(newest, "id", "left").join(accounts.select(F.col("id").alias("account_id"), "advisor_code", F.try_parse_json("application_json").alias("application")), "account_id", "left")
    scored = owned.withColumns(risk_columns(F.col("application"), F.col("advisor_code"))).join(list_hits(todo, ofac, uk, un), "id", "left")
    listed = F.coalesce(F.size("ofac"), F.lit(0)) + F.coalesce(F.size("uk"), F.lit(0)) + F.coalesce(F.size("un"), F.lit(0)) > 0
    error = F.when(F.col("account_id").isNull(), F.lit("linked account not found")).when(~F.col("kind").isin(*CUSTOMER_TYPES), F.concat(F.lit("invalid customer type: "), F.when(F.col("kind") == "", "missing").otherwise(F.col("kind"))))
    score = risk.weighted_risk(F.col("customer"), F.col("jurisdiction"), F.col("product"), F.col("introducer"), listed=listed)
    return scored.withColumn("error", error).select(F.col("id").alias("contact_id"), "ofac", "uk", "un", risk.fatf_status(F.col("country")).alias("fatf_status"), "kind", "country", F.when(F.col("error").isNull(), score).alias("risk_score"), "error")


#: Where an application lists people, by customer type, and whether the first alone counts.
PEOPLE = (
    ("INDIVIDUAL", "$.customer.accountHolder.accountHolderDetails", True),
    ("JOINT", "$.customer.jointHolders.firstHolderDetails", True),
    ("JOINT", "$.customer.jointHolders.secondHolderDetails", True),
    ("ORG", "$.customer.organization.associatedEntities.associatedIndividuals", False),
)


def applicant_names(accounts: DataFrame, application: Column) -> DataFrame:
    """(id, name): the normalised names of the holders, joint holders or associates that an application (a variant) lists, each once. Lists of any length: one row a person."""
    kind = risk.customer_type([F.try_variant_get(application, "$.customer.type", "string")])
    lists = F.array(*[F.struct((kind == k).alias("fits"), F.try_variant_get(application, path, "variant").alias("people"), F.lit(first).alias("first")) for k, path, first in PEOPLE])
    listed = accounts.select("id", F.explode(lists).alias("l")).where("l.fits").select("id", F.col("l.people").alias("people"), F.col("l.first").alias("first"))
    persons = listed.lateralJoin(listed.sparkSession.tvf.variant_explode(F.col("people").outer())).where((F.col("pos") == 0) | ~F.col("first"))
    part = lambda which: F.trim(F.coalesce(F.try_variant_get("value", f"$.name.{which}", "string"), F.lit("")))
    return persons.select("id", text.normalized_name(F.concat_ws(" ", part("first"), part("last"))).alias("name")).where("name <> ''").distinct()


def matched_person(people: Column, first: Column, middle: Column, last: Column, email: Column) -> Column:
    """The first of the people (struct(firstName, middleName, lastName, email)) with the contact's name or e-mail; else the first."""
    own = F.struct(F.array(text.normalized_name(F.concat_ws(" ", first, last)), text.normalized_name(F.concat_ws(" ", first, middle, last))).alias("names"), F.lower(F.trim(email)).alias("mail"))
    spelled = lambda p, *parts: text.normalized_name(F.concat_ws(" ", *[p[x] for x in parts]))
    same_name = lambda o, p: F.array_contains(o["names"], spelled(p, "firstName", "lastName")) | F.array_contains(o["names"], spelled(p, "firstName", "middleName", "lastName"))
    same_mail = lambda o, p: (F.lower(F.trim(p["email"])) == o["mail"]) & (o["mail"] != "")
    hits = bound(own, lambda o: F.filter(people, lambda p: F.coalesce(same_name(o, p), F.lit(False)) | F.coalesce(same_mail(o, p), F.lit(False))))  # the contact's own names are folded once
    return bound(hits, lambda h: F.coalesce(F.get(h, F.lit(0)), F.get(people, F.lit(0))))


def to_screen(links: DataFrame, screened: DataFrame, today: Column, comparisons: list[DataFrame]) -> DataFrame:
    """(contact_id) to screen: linked contacts not screened today; none if every list's comparison (one row each) finds it unchanged."""
    unchanged = bool(comparisons) and all((row := c.first()) is not None and row["has_new"] and row["has_old"] and bool(row["is_same"]) for c in comparisons)
    done = screened.where(F.try_to_timestamp(F.substring("created", 1, 8), F.lit("yyyyMMdd")).cast("date") == today).select("contact_id").distinct()
    wanted = links.where("account_id is not null and contact_id is not null").select("contact_id").distinct().join(done, "contact_id", "left_anti")
    return wanted.limit(0) if unchanged else wanted
