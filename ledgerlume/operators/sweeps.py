"""Scheduled sweeps over worker documents and subscriptions; `now` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Reminders and how many days before the expiry they are due.
MILESTONES = (("2M", 60), ("1M", 30), ("15D", 15), ("3D", 3), ("0D", 0))

# Subscription period, trial, reminder lead.
PERIOD_DAYS, TRIAL_DAYS, REMINDER_DAYS = 30, 7, 3


def milestones_due(docs: DataFrame, now: str) -> DataFrame:
    """(doc, milestone) of every passed milestone.

    The five milestones stand in one array literal per row, so no join is needed.
    """
    days = S.days_left(F.col("expires"), F.lit(now).cast("timestamp"))
    marks = F.array(*[F.struct(F.lit(m).alias("milestone"), F.lit(d).alias("lead")) for m, d in MILESTONES])
    rows = docs.withColumn("days", days).filter(F.col("days") <= MILESTONES[0][1])
    return rows.select("*", F.explode(F.filter(marks, lambda m: F.col("days") <= m["lead"])).alias("m")).select("doc_id", "worker_id", "kind", "days", F.col("m.milestone").alias("milestone"))


def notifications(docs: DataFrame, workers: DataFrame, users: DataFrame, sent: DataFrame, now: str) -> DataFrame:
    """Due milestones that were not sent, with whom to tell."""
    due = milestones_due(docs, now).join(sent.select("doc_id", "milestone"), ["doc_id", "milestone"], "left_anti")
    return due.join(workers, "worker_id", "left").join(users, "user_id", "left").select("doc_id", "milestone", "days", F.col("name").alias("worker"), "user_name")


def still_sent(sent: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Sent milestones that stay valid: those of documents whose expiry did not change."""
    old = before.select("doc_id", F.col("expires").alias("old"))
    changed = after.join(old, "doc_id").filter(~F.col("expires").eqNullSafe(F.col("old"))).select("doc_id")
    return sent.join(changed, "doc_id", "left_anti")


def active(now: Column) -> Column:
    """A subscription runs while its trial or its period ends strictly later."""
    return F.coalesce(F.col("trial_end") > now, F.lit(False)) | F.coalesce(F.col("period_end") > now, F.lit(False))


# The plan that new charges are for.
PLAN_CURRENCY, PRICE_TOLERANCE = "BRL", 0.01


def subscription_states(subs: DataFrame, now: str) -> DataFrame:
    """Whether a subscription runs, the reason why not (null while it does), whether there is something to cancel, its end if extended now.

    Only a recurring contract that isn't cancelled and whose period still runs can be cancelled.
    """
    at = F.lit(now).cast("timestamp")
    runs = active(at)
    reason = F.when(~runs, F.when(F.col("period_end").isNull(), "trial_expirado").otherwise("assinatura_vencida"))
    can_cancel = F.col("contract").isNotNull() & F.col("cancelled").isNull() & F.coalesce(F.col("period_end") > at, F.lit(False))
    extended = F.greatest(at, F.coalesce("period_end", at)) + F.make_interval(days=F.lit(PERIOD_DAYS))
    return subs.select("sub_id", runs.alias("active"), reason.alias("reason"), can_cancel.alias("can_cancel"), extended.alias("extended"))


def cancel_decision(subs: DataFrame, now: str) -> DataFrame:
    """Whether a subscription can be cancelled, the first reason against it, and until when access stays."""
    at = F.lit(now).cast("timestamp")
    reason = (
        F.when(F.col("cancelled").isNotNull(), "ja_cancelada").when(~F.coalesce(F.col("period_end") > at, F.lit(False)), "sem_periodo_vigente")
        .when(F.col("contract").isNull(), "sem_assinatura_recorrente")
    )
    return subs.select("sub_id", reason.isNull().alias("can_cancel"), reason.alias("reason"), F.when(reason.isNull() | (reason == "ja_cancelada"), F.col("period_end")).alias("access_until"))


def missing_charges(invoices: DataFrame, subs: DataFrame, charges: DataFrame) -> DataFrame:
    """Charges to insert for recurring invoices of known contracts that have none yet, at the contract's own price."""
    known = invoices.join(subs.select("contract", "sub_id", "price"), "contract").join(charges.select("charge_id"), "charge_id", "left_anti")
    return known.select("charge_id", "sub_id", F.col("price").alias("amount"), F.lit(PLAN_CURRENCY).alias("currency"), F.lit("PROCESSANDO").alias("charge_status"), F.concat(F.lit("fatura:"), F.col("charge_id")).alias("once_key")).dropDuplicates(["charge_id"])


def renewal_reminders(subs: DataFrame, now: str) -> DataFrame:
    """Periods that end within the lead and were not reminded of."""
    at = F.lit(now).cast("timestamp")
    soon = (F.col("period_end") > at) & (F.col("period_end") <= at + F.make_interval(days=F.lit(REMINDER_DAYS)))
    return subs.filter(soon & F.col("reminded").isNull() & F.col("cancelled").isNull()).select("sub_id", "user_id", "period_end")


def latest_charge(charges: DataFrame) -> DataFrame:
    """The last approved charge of each subscription."""
    return charges.filter("charge_status = 'APROVADA'").groupBy("sub_id").agg(F.max_by("charge_id", F.struct("handled", "charge_id")).alias("charge_id"), F.max("handled").alias("handled"))


def charge_decision(payments: DataFrame, charges: DataFrame, production: bool = True) -> DataFrame:
    """First reason that speaks against applying a payment to its charge, else APLICAR.

    The amount may be larger than charged, not smaller by more than PRICE_TOLERANCE; the currency is the
    charge's own; a charge that is settled isn't applied again. Losing a race is the store's matter, not a query's.
    """
    charge = charges.select("charge_id", F.col("amount").alias("charged"), F.col("currency").alias("charged_in"), "charge_status")
    rows = payments.join(charge, "charge_id", "left")
    reason = (
        F.when(~F.col("status").eqNullSafe("approved"), "status_nao_aprovado").when(F.lit(production) & ~F.coalesce("live", F.lit(False)), "ambiente_divergente")
        .when(F.col("charge_status").isNull(), "cobranca_nao_encontrada").when(F.col("amount") < F.col("charged") - PRICE_TOLERANCE, "valor_divergente")
        .when(~F.col("currency").eqNullSafe(F.col("charged_in")), "moeda_divergente").when(~F.col("charge_status").isin("PENDENTE", "PROCESSANDO"), "ja_processada").otherwise("APLICAR")
    )
    return rows.select("payment_id", reason.alias("decision"))


def in_flight_guard(charges: DataFrame, now: str, minutes: int) -> DataFrame:
    """Subscriptions with a charge under way within the trailing window."""
    late = F.col("handled") >= F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    return charges.filter((F.col("charge_status") == "PROCESSANDO") & late).select("sub_id").distinct()


def missing_subscriptions(users: DataFrame, subs: DataFrame, user: str, now: str) -> DataFrame:
    """Trial rows for users without a subscription."""
    left = users.join(subs.select(F.col("user_id").alias(user)), user, "left_anti")
    return left.select(user, (F.lit(now).cast("timestamp") + F.make_interval(days=F.lit(TRIAL_DAYS))).alias("trial_end"))
