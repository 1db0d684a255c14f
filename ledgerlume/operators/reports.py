"""Reporting over invoices, taxes, expenses, services, workers: filters, joins, totals, rankings.

Money stays double in the tables and is summed as decimal(18,2), so that totals don't depend on the
order of addition. Time is UTC. `now` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

NO_NAME = "Não informado"


def money_sum(column: Column | str) -> Column:
    """Sum with null and NaN as 0; 0 for no rows."""
    c = F.col(column) if isinstance(column, str) else column
    clean = F.when(~F.isnan(c), c)
    return F.coalesce(F.sum(clean.cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)")).cast("double")


def in_period(start: str | None, end: str | None, *days: str) -> Column:
    """Rows whose first known day lies in [start, end], the end's whole day included."""
    day = F.coalesce(*[F.col(d) for d in days])
    kept = F.lit(True)
    if start:
        kept = kept & (day >= F.lit(start).cast("timestamp"))
    if end:
        kept = kept & (day < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return kept


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; parameters that are None or empty don't filter."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def containing(df: DataFrame, part: str, *columns: str) -> DataFrame:
    """Rows where any column contains `part`, case-sensitively."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.col(c), F.lit(part)), F.lit(False))
    return df.filter(found)


def customer_label() -> Column:
    return F.coalesce(S.nonempty(F.col("legal_name"), F.col("trade_name")), F.lit(NO_NAME))


def with_customer(invoices: DataFrame, parties: DataFrame) -> DataFrame:
    """Left join to the customer; the dimension is broadcast by Spark when its size allows."""
    return invoices.join(parties.withColumnRenamed("party_id", "customer_id"), "customer_id", "left")


def report_totals(invoices: DataFrame) -> DataFrame:
    return invoices.agg(
        F.count(F.lit(1)).alias("invoices"), money_sum("gross").alias("gross"), money_sum("net").alias("net"), money_sum("iss").alias("iss"),
        money_sum("withheld").alias("withheld"), money_sum("anticipated").alias("anticipated"),
    )


def by_status(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"))


def by_customer(invoices: DataFrame, parties: DataFrame) -> DataFrame:
    """Sum and count by the customer's label, not its id.

    Invoices are summed by id first, so the join carries one row per customer.
    """
    small = invoices.groupBy("customer_id").agg(F.sum(F.col("gross").cast("decimal(18,2)")).alias("g"), F.count(F.lit(1)).alias("n"))
    named = with_customer(small, parties).withColumn("label", customer_label())
    return named.groupBy("label").agg(F.coalesce(F.sum("g"), F.lit(0)).cast("double").alias("gross"), F.sum("n").alias("invoices"))


def by_month(invoices: DataFrame) -> DataFrame:
    month = F.date_format(F.coalesce("issued", "created"), "yyyy-MM")
    return invoices.groupBy(month.alias("month")).agg(money_sum("gross").alias("gross"), F.count(F.lit(1)).alias("invoices"))


def month_summary(invoices: DataFrame, now: str) -> DataFrame:
    """This month against all time, in one pass; here NaN stays NaN."""
    this = F.date_trunc("month", F.col("issued")) == F.date_trunc("month", F.lit(now).cast("timestamp"))
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")
    return invoices.agg(
        F.count_if(this).alias("month_invoices"), total(F.when(this, F.col("gross"))).alias("month_gross"),
        F.count(F.lit(1)).alias("all_invoices"), total(F.col("gross")).alias("all_gross"),
        F.count_if(F.col("status") == "CANCELADA").alias("cancelled"),
    )


def tax_totals(taxes: DataFrame) -> DataFrame:
    """Totals by status side by side."""
    part = lambda s: money_sum(F.when(F.col("status") == s, F.col("amount"))).alias(s.lower())
    return taxes.groupBy("kind").agg(part("PENDENTE"), part("PAGO"), part("VENCIDO"), money_sum("amount").alias("total"))


def service_profit(services: DataFrame, expenses: DataFrame) -> DataFrame:
    """Spent, number of expenses, profit and share of the contract that is used up."""
    spent = expenses.groupBy("service_id").agg(F.sum(F.col("spent").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = services.join(spent, "service_id", "left")
    total = F.coalesce(F.col("s"), F.lit(0)).cast("decimal(18,2)")
    return rows.select(
        "service_id", "name", total.cast("double").alias("spent"), F.coalesce("n", F.lit(0)).cast("long").alias("expenses"),
        (F.col("contract").cast("decimal(18,2)") - total).cast("double").alias("profit"),
        S.js_round(total.cast("double") / F.nullif(F.col("contract"), F.lit(0.0)) * 100, 1).alias("used_percent"),
    )


def rollup_expenses(expenses: DataFrame, key: Column, name: str) -> DataFrame:
    return expenses.groupBy(key.alias(name)).agg(money_sum("spent").alias("spent"), F.count(F.lit(1)).alias("expenses"))


def monthly_evolution(invoices: DataFrame, expenses: DataFrame, first: str, months: int) -> DataFrame:
    """Revenue, expense and profit of every month of a calendar, months without rows included."""
    spark = invoices.sparkSession
    calendar = spark.range(months).select(F.date_format(F.expr(f"add_months(DATE'{first}', CAST(id AS INT))"), "yyyy-MM").alias("month"))
    end = f"add_months(DATE'{first}', {months})"
    inside = lambda c: (F.col(c) >= F.lit(first).cast("timestamp")) & (F.col(c) < F.expr(end).cast("timestamp"))
    revenue = invoices.filter(inside("issued")).groupBy(F.date_format("issued", "yyyy-MM").alias("month")).agg(F.sum(F.col("gross").cast("decimal(18,2)")).alias("r"))
    spent = expenses.filter(inside("spent_on")).groupBy(F.date_format("spent_on", "yyyy-MM").alias("month")).agg(F.sum(F.col("spent").cast("decimal(18,2)")).alias("e"))
    r, e = (F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)") for c in "re")
    return calendar.join(revenue, "month", "left").join(spent, "month", "left").select(
        "month", r.cast("double").alias("revenue"), e.cast("double").alias("expense"), (r - e).cast("double").alias("profit")
    )


def invoice_detail(invoices: DataFrame, taxes: DataFrame, history: DataFrame, most: int = 50) -> DataFrame:
    """Every invoice with all its taxes, and its latest `most` history entries, as nested lists.

    History is cut by rank before it is gathered; an invoice's taxes are as many as it has.
    """
    listed = F.sort_array(F.collect_list(F.struct("tax_id", "kind", "amount")))
    all_taxes = taxes.groupBy("invoice_id").agg(listed.alias("taxes"))
    latest = Window.partitionBy("invoice_id").orderBy(F.desc("seq"))
    some = history.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= most)
    entries = some.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("n", "seq"))).alias("entries"))
    rows = invoices.join(all_taxes, invoices["id"] == all_taxes["invoice_id"], "left").drop("invoice_id").join(entries, F.col("id") == entries["invoice_id"], "left")
    shown = lambda c, one: F.coalesce(F.array_join(F.transform(c, one), ","), F.lit(""))
    return rows.select(
        "id", "number", shown("taxes", lambda t: F.concat_ws(":", t["kind"], t["amount"].cast("decimal(18,2)"))).alias("taxes"), shown("entries", lambda e: e["seq"].cast("string")).alias("history")
    )


#: Columns that a listing may be sorted by; any other asks for the first.
SORTABLE = ("created", "issued", "gross", "net", "number", "status")


def sorted_listing(df: DataFrame, column: str, descending: bool, key: str = "id") -> list[Column]:
    """A total order by a column of the allow-list, unknown ones falling back to its first."""
    name = column if column in SORTABLE else SORTABLE[0]
    return [F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last(), F.col(key)]


def searched(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows that hold the term, in any case, in at least one of the columns: one filter over one scan."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return df.filter(found)


def shown(text: Column, most: int) -> Column:
    """A text cut for display, a dash for none."""
    cut = F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("—"))


def substitutions(invoices: DataFrame) -> DataFrame:
    """Invoices with the one they replace."""
    old = invoices.select(F.col("id").alias("old_id"), F.col("gross").alias("old_gross"))
    new = invoices.filter("substitute_id IS NOT NULL").select("id", "substitute_id", "gross")
    return new.join(old, new["substitute_id"] == old["old_id"], "left").select("id", "substitute_id", "gross", "old_gross")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a listing; the order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))


def latest_per(df: DataFrame, parent: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of every parent under a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter(F.col("rank") <= most)


def recent_activity(sources: list[tuple[str, DataFrame, str, str]], most: int) -> DataFrame:
    """The latest rows over several tables (label, frame, id, time): the latest of each, then of all."""
    parts = [
        df.select(F.lit(label).alias("source"), F.col(key).cast("long").alias("ref"), F.col(at).alias("at")).orderBy(F.desc_nulls_last("at"), "ref").limit(most)
        for label, df, key, at in sources
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.orderBy(F.desc_nulls_last("at"), "source", "ref").limit(most)


def early_payment(invoices: DataFrame, rate: float, now: str) -> DataFrame:
    """Fee and net of an early payment at a monthly rate; begun days until the due time, at least one, 30 without one."""
    base = F.coalesce("net", "gross", F.lit(0.0))
    seconds = F.unix_timestamp(F.col("due").cast("timestamp")) - F.unix_timestamp(F.lit(now).cast("timestamp"))
    days = F.coalesce(F.greatest(F.lit(1), F.ceil(seconds / 86400)), F.lit(30))
    fee = base * F.lit(rate) / 100 * days / 30
    return invoices.select("id", days.alias("days"), S.js_round(fee, 2).alias("fee"), S.js_round(F.greatest(F.lit(0.0), base - fee), 2).alias("paid_out"))


def early_payment_for(invoices: DataFrame, fee: Column) -> DataFrame:
    """The same for a fee stated directly (null: none); below nothing or above the base it is invalid and nothing is paid out."""
    base, fee = F.coalesce("net", "gross", F.lit(0.0)), F.coalesce(fee, F.lit(0.0))
    valid = (fee >= 0) & (fee <= base)
    return invoices.select("id", valid.alias("valid"), F.when(valid, S.js_round(fee, 2)).alias("fee"), F.when(valid, S.js_round(F.greatest(F.lit(0.0), base - fee), 2)).alias("paid_out"))


#: Months before the current one in which a period begins; a year begins in January, everything in 2000.
MONTHS_BACK = {"mes": 0, "6meses": 5}


def period_of(name: str, now: str) -> tuple[Column, Column]:
    """First moment of a named period, and the first one after it: all end with the current month."""
    at = F.lit(now).cast("timestamp")
    month = F.date_trunc("month", at)
    begins = {n: month - F.make_ym_interval(months=F.lit(back)) for n, back in MONTHS_BACK.items()}
    begins |= {"ano": F.date_trunc("year", at), "total": F.lit("2000-01-01").cast("timestamp")}
    if name not in begins:
        raise ValueError(f"no period {name}: {', '.join(begins)}")
    return begins[name], month + F.make_ym_interval(months=F.lit(1))


def worker_summary(docs: DataFrame, workers: DataFrame, now: str, near: int = 30) -> DataFrame:
    """Workers by their worst document: up to date, close to an expiry, overdue."""
    state = worker_status(docs, workers, now, near)
    kind = F.when(F.col("overdue") > 0, "VENCIDO").when(F.col("near") > 0, "PROXIMO").otherwise("EM_DIA")
    return state.groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("workers"))


def change_log(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old, new) of tracked columns that differ, both sides as text."""
    text = lambda df, tag: df.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{tag}_{c}") for c in columns])
    both = text(old, "old").join(text(new, "new"), key)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")) for c in columns]))
    return both.select(key, rows.alias("c")).select(key, "c.*").filter("old <> new")


def duplicates(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows whose whole key, without nulls, an earlier row has: (row, duplicate_of)."""
    known = df.dropna(subset=keys)
    first = known.groupBy(*keys).agg(F.min(row).alias("duplicate_of"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return known.join(first, keys).filter(F.col(row) > F.col("duplicate_of")).select(row, "duplicate_of")


def allowed(df: DataFrame, wanted: list[str], columns: list[str]) -> DataFrame:
    """The wanted columns that are on the list, in the order asked for; all of the list if none is."""
    kept = [c for c in wanted if c in columns]
    return df.select(*(kept or columns))


def without_heavy(df: DataFrame, heavy: str, flag: str) -> DataFrame:
    """All rows without a heavy column, and whether it held anything."""
    return df.withColumn(flag, F.coalesce(F.length(heavy) > 0, F.lit(False))).drop(heavy)


def zero_filled(counts: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts of a closed domain, 0 where nothing was counted."""
    known = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return known.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# How one overdue document of a kind is named.
OVERDUE_LABELS = (("INTEGRACAO", "Integração vencida"), ("ASO", "ASO vencido"))


def worker_status(docs: DataFrame, workers: DataFrame, now: str, near: int = 30) -> DataFrame:
    """Worst state of every worker's documents, with its label."""
    days = S.days_left(F.col("expires"), F.lit(now).cast("timestamp"))
    state = docs.groupBy("worker_id").agg(F.count_if(days < 0).alias("overdue"), F.count_if((days >= 0) & (days <= near)).alias("near"), F.min(F.when(days < 0, F.col("kind"))).alias("one"))
    rows = workers.join(state, "worker_id", "left")
    overdue, soon = F.coalesce("overdue", F.lit(0)), F.coalesce("near", F.lit(0))
    label = (
        F.when(overdue >= 2, "Integração e ASO vencidos").when(overdue == 1, F.coalesce(*[F.when(F.col("one") == kind, told) for kind, told in OVERDUE_LABELS], F.concat("one", F.lit(" vencido")))).when(soon > 0, "Próximo do vencimento").otherwise("Em dia")
    )
    return rows.select("worker_id", overdue.cast("long").alias("overdue"), soon.cast("long").alias("near"), label.alias("label"))
