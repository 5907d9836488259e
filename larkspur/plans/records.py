"""Record keeping: missing details, responses merged into requests, keyed caches, population counts, requests checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.fixed_values import RECIPIENT_SOURCES, REQUEST_FIELDS, REQUEST_KEYS, REQUEST_LANGUAGES
from larkspur.functions.numbers import is_blank
from larkspur.functions.text import normalized_name
from larkspur.operators import selection
from larkspur.plans.compliance import applicant_names


def missing_details(accounts: DataFrame, details: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Accounts with a number, without details and not skipped; `fault` where no master account is known, so nothing can be fetched."""
    number = F.trim(F.col("ibkr_account_number").cast("string"))
    asked = accounts.withColumn("_n", number).where(~is_blank(F.col("_n")) & ~F.col("_n").isin(*skip)) if skip else accounts.withColumn("_n", number).where(~is_blank(F.col("_n")))
    have = details.select(F.trim(F.col("account_id").cast("string")).alias("_n")).distinct()
    return asked.join(have, "_n", "left_anti").drop("_n").withColumn("fault", F.when(F.col("master_account").isNull(), F.lit("missing master account")))


def merged_responses(prepared: DataFrame, responses: DataFrame, request: tuple[str, ...] = ()) -> DataFrame:
    """Prepared rows (form, status, message) with the response of the same form number, digits and letters alone; skipped rows stay. Where no form of a request (its columns; none: the whole table is one) is answered, its prepared ones are accepted."""
    plain = lambda c: F.upper(F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9]", ""))
    last = responses.withColumn("_f", plain("form")).where("_f <> ''").groupBy(*request, "_f").agg(F.max(F.struct("n", "status", "message")).alias("_r"))
    joined = prepared.withColumn("_f", plain("form")).join(last, [*request, "_f"], "left")
    answered = F.col("_r").isNotNull() & (F.col("status") != "Skipped")
    out = joined.withColumn("status", F.when(answered, F.coalesce("_r.status", F.lit("Submitted"))).otherwise(F.col("status"))).withColumn("message", F.when(answered, F.col("_r.message")).otherwise(F.col("message")))
    answers = out.groupBy(*request).agg(F.max((~F.col("status").isin("Prepared", "Skipped")).cast("int")).alias("_any"))
    beside = out.join(answers, list(request)) if request else out.crossJoin(F.broadcast(answers))  # one row
    return beside.withColumn("status", F.when((F.col("_any") == 0) & (F.col("status") == "Prepared"), F.lit("Accepted")).otherwise(F.col("status"))).drop("_f", "_r", "_any")


def cache_key(content: Column, settings: str) -> Column:
    """Of a content under settings: digests of both."""
    return F.concat_ws("-", F.sha2(content, 256), F.sha2(F.lit(settings), 256))


def cached(wanted: DataFrame, content: str, settings: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the cached result, rows that have to be worked on, one per content)."""
    keyed = wanted.withColumn("key", cache_key(F.col(content), settings))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti").dropDuplicates(["key"])


def population(documents: DataFrame, processing: DataFrame) -> DataFrame:
    """One row: documents in all, distinct, processed, failed for good, and to do."""
    state = processing.groupBy("document_id").agg(F.bool_or(F.col("status") == "completed").alias("done"), F.bool_or(F.col("status") == "failed").alias("failed"))
    joined = documents.join(state, "document_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("document_id").alias("documents"), F.count_if("done").alias("done"), F.count_if(F.col("failed") & ~F.coalesce("done", F.lit(False))).alias("failed"), F.count_if(~F.coalesce("done", F.lit(False))).alias("to_do"))


def _mail(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def account_by_contact(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(contact id, account id): the newest account whose e-mail or one of whose names (an array) is the contact's."""
    names = accounts.select("id", F.explode(F.transform("names", normalized_name)).alias("name")).where("name <> ''")
    return _newest_account(contacts, accounts.withColumn("mail", _mail(F.col("email"))), names)


def account_by_application(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(contact id, account id): the newest account whose application (application_json, as text) has the contact's e-mail, or lists a holder or associate of the contact's name."""
    parsed = accounts.withColumn("_application", F.try_parse_json("application_json"))
    mails = parsed.withColumn("mail", _mail(F.try_variant_get("_application", "$.customer.email", "string")))
    return _newest_account(contacts, mails, applicant_names(parsed, F.col("_application")))


def _newest_account(contacts: DataFrame, accounts: DataFrame, names: DataFrame) -> DataFrame:
    """Two equi-joins, no OR. Of the accounts of a mail or of a name only the newest can be a contact's, so it is found before the join: a name that many share costs a row a contact, never all pairs."""
    stamp = F.coalesce("updated", "created", F.lit(""))
    rows = accounts.select(F.col("id").alias("account_id"), stamp.alias("stamp"), "mail")
    people = contacts.select(F.col("id").alias("contact_id"), _mail(F.col("email")).alias("mail"), normalized_name(F.col("name")).alias("name"))
    named = names.withColumnRenamed("id", "account_id").join(rows.select("account_id", "stamp"), "account_id")
    by_mail = people.where("mail <> ''").join(_newest_of(rows.where("mail <> ''"), "mail"), "mail").select("contact_id", "account_id", "stamp")
    by_name = people.where("name <> ''").join(_newest_of(named, "name"), "name").select("contact_id", "account_id", "stamp")
    return _newest_of(by_mail.unionByName(by_name), "contact_id").select("contact_id", "account_id")


def _newest_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, account_id, stamp): each key's account of the latest stamp, of several the least id. Sums in two steps, so that a key with most of the rows is no hot spot."""
    least = rows.groupBy(key, "stamp").agg(F.min(F.struct("account_id")).alias("_a"))
    return least.groupBy(key).agg(F.max(F.struct("stamp")).alias("_s"), F.max_by("_a", "stamp").alias("_a")).select(key, F.col("_a.account_id").alias("account_id"), F.col("_s.stamp").alias("stamp"))


def request_faults(requests: DataFrame, allowed_keys: tuple[str, ...] = REQUEST_KEYS) -> DataFrame:
    """Requests with their distinct lower-case keys and the first `fault` of their checks (null: none)."""
    keys = F.array_distinct(F.transform(F.coalesce("missing_document_keys", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))))
    lost = F.array_compact(F.array(*[F.when(is_blank(F.col(f)) if f != "content" else F.col(f).isNull(), F.lit(f)) for f in REQUEST_FIELDS]))
    company = F.coalesce(F.col("content.is_company_contact"), F.lit(False))
    has = lambda k: F.array_contains("keys", k)
    fault = (
        F.when(F.size(lost) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(lost, ", ")))
        .when(~F.col("recipient_source").isin(*RECIPIENT_SOURCES), F.lit("recipient_source must be contact, ibkr, or testing"))
        .when(~F.col("language").isin(*REQUEST_LANGUAGES), F.lit("language must be en or es"))
        .when(F.size("keys") == 0, F.lit("missing_document_keys must be a non-empty array"))
        .when(F.size(F.array_except("keys", F.array(*[F.lit(k) for k in allowed_keys]))) > 0, F.lit("missing_document_keys contains an unsupported document key"))
        .when(has("poi") & has("poe"), F.lit("A review email cannot request both POI and POE"))
        .when(F.coalesce(F.size("content.missing_documents"), F.lit(0)) <= 0, F.lit("content.missing_documents is required"))
        .when(company & has("poi"), F.lit("Company review emails cannot request POI"))
        .when(~company & has("poe"), F.lit("Natural-person review emails cannot request POE"))
    )
    return requests.withColumn("keys", keys).withColumn("fault", fault)


def status_report(steps: DataFrame) -> DataFrame:
    """(pipeline, success, failed, skipped, status) of step rows (pipeline, status)."""
    kind = F.col("status")
    counted = steps.groupBy("pipeline").agg(F.count_if(kind == "success").alias("success"), F.count_if(kind == "failed").alias("failed"), F.count_if(kind == "skipped").alias("skipped"))
    return counted.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("success") > 0, "partial").otherwise("failed"))


def backup_moves(files: DataFrame, reports: DataFrame, day: Column) -> DataFrame:
    """(path, target, replaced): each landed file's backup place by exact report prefix, and how many backups of the same day it replaces. files: folder 'batch' or a report's backup folder."""
    batch = files.where("folder = 'batch'").withColumn("prefix", F.regexp_extract("name", r"^([A-Za-z_]*[A-Za-z])", 1))
    placed = batch.join(F.broadcast(reports.select("prefix", "backup_folder", "backup_name")), "prefix")  # a row per report
    same_day = files.where((F.col("folder") != "batch") & (F.col("modified").cast("date") == day)).groupBy(F.col("folder").alias("backup_folder")).agg(F.count(F.lit(1)).alias("replaced"))
    return placed.join(same_day, "backup_folder", "left").select("path", F.concat_ws("/", "backup_folder", "backup_name").alias("target"), F.coalesce("replaced", F.lit(0)).alias("replaced"))


def chosen_input(files: DataFrame, exact: str, prefix: str) -> str:
    """Path of the newest file with the exact name, else with the prefix; none raises."""
    rank = F.when(F.col("name") == exact, 2).when(F.col("name").startswith(prefix), 1)
    row = files.withColumn("_r", rank).where("_r is not null").agg(F.max_by("path", F.struct("_r", "modified", "name")).alias("path")).first()
    if row["path"] is None:
        raise ValueError(f"no file {exact!r} and none that begins with {prefix!r}")
    return row["path"]


def backup_of_day(files: DataFrame, prefix: str, day: Column) -> DataFrame:
    """The last backup by name of a list (name begins with the prefix and the day as yyyyMMdd), with `day`; no row where there is none."""
    wanted = files.where(F.col("name").startswith(F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"))))
    return wanted.orderBy(F.desc("name")).limit(1).withColumn("day", F.date_format(day, "yyyy-MM-dd"))
