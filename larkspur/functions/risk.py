"""Customer risk: rule tables over text and arrays, weighted and clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.fixed_values import (
    ADVERSE_WORDS, COMPLEX_PRODUCTS, CUSTOMER_TYPES, DERIVATIVE_PRODUCTS, FATF_CODES, FATF_NAMES, HIGH_RISK, LOW_RISK, RISK_WEIGHTS, RISKY_PRODUCT_WORDS, SANCTIONED, SIMPLE_PRODUCTS, WELL_REGULATED,
)
from larkspur.functions.numbers import clamp
from larkspur.functions.text import normalized_country


def upper(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def fatf_status(c: Column) -> Column:
    """'Listed' for a listed country code or name; else null."""
    return F.when(upper(c).isin(*FATF_CODES) | normalized_country(c).isin(*FATF_NAMES), F.lit("Listed"))


def jurisdiction_risk(country: Column) -> Column:
    c = upper(country)
    return F.when(c == "", 5).when(c.isin(*SANCTIONED), 9).when(c.isin(*HIGH_RISK), 7).when(c.isin(*LOW_RISK), 1).when(c.isin(*WELL_REGULATED), 3).otherwise(5)


def product_risk(accounts: Column, products: Column, margin: Column) -> Column:
    """accounts: their number; products: upper-case names, as often as permitted; margin: of the first account."""
    has = lambda names: F.exists(products, lambda p: p.isin(*names))
    on_margin, derivatives = upper(margin) == "MARGIN", has(DERIVATIVE_PRODUCTS)
    return (
        F.when(F.coalesce(accounts, F.lit(0)) == 0, 3)
        .when(F.exists(products, lambda p: p.rlike(RISKY_PRODUCT_WORDS)), 9)
        .when(has(COMPLEX_PRODUCTS), 7)
        .when((F.size(products) >= 5) | (on_margin & derivatives), 5)
        .when(on_margin | derivatives, 3)
        .when((F.size(products) > 0) & F.forall(products, lambda p: p.isin(*SIMPLE_PRODUCTS)), 1)
        .otherwise(3)
    )


def adverse_signals(is_pep: Column, regulatory: Column) -> Column:
    """regulatory: array of struct(status, code, detail, details), texts; an empty status does not count."""
    counts = lambda r: (F.coalesce(r["status"], F.lit("")) != "") & ~F.lower(r["status"]).isin("false", "0")
    told = lambda r: F.upper(F.concat_ws(" ", r["code"], r["detail"], r["details"]))
    listed = F.exists(F.coalesce(regulatory, F.array().cast("array<struct<status:string,code:string,detail:string,details:string>>")), lambda r: counts(r) & told(r).rlike(ADVERSE_WORDS))
    return F.coalesce(is_pep, F.lit(False)) | F.coalesce(listed, F.lit(False))


def customer_risk(kind: Column, adverse: Column, complex_structure: Column, cross_border: Column, complex_experience: Column, wealth_sources: Column, other_source: Column, owner: Column) -> Column:
    many = F.coalesce(wealth_sources, F.lit(0)) >= 3
    flag = lambda c: F.coalesce(c, F.lit(False))
    organisation = F.when(flag(complex_structure) | flag(cross_border) | flag(complex_experience) | many, 7).otherwise(5)
    person = F.when(flag(owner) | flag(complex_experience) | many | flag(other_source), 3).otherwise(1)
    return F.when(flag(adverse), 9).when(kind == "ORG", organisation).when(kind == "JOINT", 3).otherwise(person)


def introducer_risk(advisor: Column) -> Column:
    return F.when(F.coalesce(advisor.cast("string"), F.lit("")).isin("", "0"), 1).otherwise(3)


def weighted_risk(customer: Column, jurisdiction: Column, product: Column, introducer: Column, delivery: Column | None = None, listed: Column | None = None) -> Column:
    """Weighted sum within 1 to 10; 9 at least with a hit on any list."""
    w = RISK_WEIGHTS
    delivery = F.lit(5) if delivery is None else delivery
    score = clamp(customer * w["customer"] + jurisdiction * w["jurisdiction"] + product * w["product"] + delivery * w["delivery"] + introducer * w["introducer"], 1.0, 10.0)
    return score if listed is None else F.when(listed, F.greatest(score, F.lit(9.0))).otherwise(score)


def customer_type(candidates: list[Column]) -> Column:
    """The first valid type of the candidates; else the first that is not blank; else ''."""
    plain = [F.when(upper(c) == "ORGANIZATION", F.lit("ORG")).otherwise(upper(c)) for c in candidates]
    valid = [F.when(c.isin(*CUSTOMER_TYPES), c) for c in plain]
    return F.coalesce(*valid, *[F.nullif(c, F.lit("")) for c in plain], F.lit(""))


def json_text(c: Column, *paths: str) -> Column:
    """The first path of a variant that holds a value that is not empty, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(c, p, "string"), F.lit("")) for p in paths])


#: Where an application's JSON holds a holder's country, by customer type.
HOLDER = {"INDIVIDUAL": "$.customer.accountHolder.accountHolderDetails[0]", "JOINT": "$.customer.jointHolders.firstHolderDetails[0]", "ORG": "$.customer.organization.associatedEntities.associatedIndividuals[0]"}
COUNTRY_PATHS = (".residence.country", ".countryOfLegalResidence", ".legalResidence.country")


def application_country(application: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, holder in HOLDER.items():
        out = F.when(kind == name, json_text(application, *[holder + p for p in COUNTRY_PATHS])).otherwise(out)
    return F.coalesce(out, F.lit(""))


PERMISSIONS = "array<struct<margin:string,tradingPermissions:array<struct<product:string,country:string>>>>"


def application_accounts(application: Column) -> Column:
    return F.try_variant_get(application, "$.accounts", PERMISSIONS)


def permitted(accounts: Column, what: str) -> Column:
    """Upper-case products or countries of all trading permissions, blanks left out."""
    each = F.transform(F.coalesce(accounts, F.array().cast(PERMISSIONS)), lambda a: F.coalesce(a["tradingPermissions"], F.array().cast("array<struct<product:string,country:string>>")))
    return F.filter(F.transform(F.flatten(each), lambda p: upper(p[what])), lambda p: p != "")
