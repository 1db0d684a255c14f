"""The processing queue as tables: selection, next states, monitoring, alerts, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Job states, and per job type: timeout (s), attempts, first and largest delay (s).
STATES = ("PENDENTE", "PROCESSANDO", "CONCLUIDO", "FALHA", "DEAD_LETTER", "CANCELADO")
JOB_CONFIG = (
    ("UPLOAD", 30, 3, 5, 60),
    ("PRE_PROCESSAMENTO", 60, 3, 10, 120),
    ("OCR_LEITURA", 180, 5, 30, 600),
    ("EXTRACAO", 90, 3, 15, 180),
    ("VALIDACAO", 30, 2, 10, 60),
    ("CONFIANCA_CONFLITO", 30, 2, 10, 60),
    ("CORRECAO_REPROCESSAMENTO", 120, 3, 30, 300),
    ("AUDITORIA", 30, 5, 5, 60),
    ("EXPORTACAO", 90, 3, 15, 180),
    ("LIMPEZA", 300, 1, 300, 3600),
)

# Alert rules over the queue report.
ALERT_RULES = (
    ("fila_acumulando", "AVISO", "pending > 100"),
    ("fila_critica", "CRITICO", "pending > 500"),
    ("worker_parado", "CRITICO", "workers = 0 AND pending > 0"),
    ("taxa_erro_alta", "CRITICO", "error_rate > 15"),
    ("dead_letter_aviso", "AVISO", "dead_letter > 20 AND dead_letter <= 100"),
    ("dead_letter_critica", "EMERGENCIA", "dead_letter > 100"),
    ("latencia_alta", "AVISO", "latency_ms > 300000"),
    ("throughput_zero", "CRITICO", "throughput = 0 AND pending > 10"),
)


def job_config(jobs: DataFrame) -> DataFrame:
    """Jobs with their type's settings; ten rows of settings are broadcast."""
    config = jobs.sparkSession.createDataFrame(list(JOB_CONFIG), "kind string, timeout_s int, max_attempts int, base_s int, cap_s int")
    return jobs.join(F.broadcast(config), "kind", "left")


def next_job(jobs: DataFrame) -> DataFrame:
    """The pending job that would be claimed: best priority, then oldest."""
    return jobs.filter("status = 'PENDENTE'").orderBy("priority", "created", "job_id").limit(1)


def dependencies(jobs: DataFrame) -> DataFrame:
    """(job, needed job) pairs of pending jobs whose needed job isn't done; null state: it doesn't exist."""
    needs = jobs.filter("status = 'PENDENTE'").select("job_id", F.explode("after_ids").alias("after_id"))
    other = jobs.select(F.col("job_id").alias("other_id"), F.col("status").alias("other_status"))
    met = needs.join(other, needs["after_id"] == other["other_id"], "left")
    return met.filter("other_status IS NULL OR other_status <> 'CONCLUIDO'").select("job_id", "after_id", "other_status")


def ready(jobs: DataFrame) -> DataFrame:
    """Pending jobs all of whose needed jobs exist and are done."""
    return jobs.filter("status = 'PENDENTE'").join(dependencies(jobs).select("job_id"), "job_id", "left_anti")


def after_failure(jobs: DataFrame) -> DataFrame:
    """Next state of failed attempts: retried with a delay, or dead letter once attempts run out."""
    rows = job_config(jobs.filter("status = 'FALHA'"))
    again = F.col("attempts") < F.col("max_attempts")
    return rows.select(
        "job_id",
        S.failure_kind(F.col("message")).alias("failure"),
        F.when(again, "PENDENTE").otherwise("DEAD_LETTER").alias("next_status"),
        F.when(again, S.backoff_seconds(F.greatest(F.col("attempts"), F.lit(1)), F.col("base_s"), F.col("cap_s"))).alias("delay_s"),
    )


def transition_allowed(status: Column, action: Column) -> Column:
    """Cancelling takes waiting or failed jobs; retrying takes failed, dead or cancelled ones."""
    return F.when(action == "cancel", status.isin("PENDENTE", "FALHA")).when(action == "retry", status.isin("FALHA", "DEAD_LETTER", "CANCELADO")).otherwise(False)


def stuck(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs idle for more than twice their timeout, and what recovery does with them."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("started")
    rows = job_config(jobs.filter("status = 'PROCESSANDO'")).filter(age > 2 * F.col("timeout_s"))
    return rows.select("job_id", "kind", age.alias("idle_s"), F.when(F.col("attempts") < F.col("max_attempts"), "REENFILEIRAR").otherwise("DEAD_LETTER").alias("action"))


def blocked(jobs: DataFrame) -> DataFrame:
    """Pending jobs that need a cancelled or dead one, with those they need in order: recovery cancels them."""
    needed = jobs.filter("status = 'PENDENTE'").select("job_id", "kind", F.explode("after_ids").alias("needs"))
    over = jobs.filter(F.col("status").isin("CANCELADO", "DEAD_LETTER")).select(F.col("job_id").alias("needs"))
    return needed.join(over, "needs").groupBy("job_id", "kind").agg(F.sort_array(F.collect_set("needs")).alias("over"))


def status_by_kind(jobs: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return jobs.groupBy("kind").agg(*[count(s) for s in STATES])


def queue_report(jobs: DataFrame, now: str) -> DataFrame:
    """One pass over the jobs: states, error rate and throughput of the last hour, latency, live workers."""
    at = F.lit(now).cast("timestamp")
    hour = at - F.expr("INTERVAL 1 HOUR")
    done = (F.col("finished") >= hour) & (F.col("status") == "CONCLUIDO")
    lost = (F.col("updated") >= hour) & F.col("status").isin("FALHA", "DEAD_LETTER")
    row = jobs.agg(
        F.count_if(F.col("status") == "PENDENTE").alias("pending"),
        F.count_if(F.col("status") == "DEAD_LETTER").alias("dead_letter"),
        F.count_if(done).alias("throughput"),
        F.count_if(lost).alias("lost"),
        F.count_distinct(F.when(F.col("started") >= at - F.expr("INTERVAL 60 SECOND"), F.col("worker"))).alias("workers"),
        F.avg(F.when(F.col("status") == "CONCLUIDO", (F.unix_millis("finished") - F.unix_millis("started")).cast("double"))).alias("mean"),
    )
    rate = F.when(F.col("throughput") + F.col("lost") > 0, S.js_round(F.col("lost") / (F.col("throughput") + F.col("lost")) * 100, 1)).otherwise(0.0)
    return row.select("pending", "dead_letter", "throughput", "workers", rate.alias("error_rate"), F.coalesce(S.js_round(F.col("mean")), F.lit(0.0)).alias("latency_ms"))


def metric_log(jobs: DataFrame) -> DataFrame:
    """The metrics that jobs append as they end, fail, die or are tried again: job_id, name, value, unit, kind, detail.

    The detail of a failure is its category, of a repeated attempt its number.
    """
    one, ended = F.lit(1.0), F.col("status") == "CONCLUIDO"
    took = (F.unix_millis("finished") - F.unix_millis("started")).cast("double")
    entry = lambda name, value, unit, detail=None: F.struct(
        F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), F.col("kind"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )
    made = F.array(
        F.when(ended, entry("job.concluido.total", one, "jobs")), F.when(ended, entry("job.latencia.ms", took, "ms")),
        F.when(F.col("status") == "FALHA", entry("job.falha.total", one, "jobs", S.failure_kind(F.col("message")))), F.when(F.col("status") == "DEAD_LETTER", entry("job.dead_letter.total", one, "jobs")),
        F.when(F.col("attempts") > 0, entry("job.retry.total", one, "jobs", F.col("attempts"))),
    )
    return jobs.select("job_id", F.inline(F.filter(made, lambda m: m.isNotNull())))


def metric_rows(report: DataFrame) -> DataFrame:
    """The report as (metric, value) rows."""
    names = ["pending", "dead_letter", "throughput", "workers", "error_rate", "latency_ms"]
    wide = report.select(*[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "metric", "value")


def active_alerts(report: DataFrame) -> DataFrame:
    """Alert rules that hold, by severity as text."""
    rows = [report.filter(rule).select(F.lit(name).alias("alert"), F.lit(severity).alias("severity")) for name, severity, rule in ALERT_RULES]
    return reduce(DataFrame.unionByName, rows)


def alert_changes(active: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """What to do with each alert: open it, keep it, resolve it."""
    now = active.select("alert", F.lit(True).alias("holds"))
    held = open_alerts.select("alert", F.lit(True).alias("open"))
    action = F.when(F.col("open").isNull(), "ABRIR").when(F.col("holds").isNull(), "RESOLVER").otherwise("MANTER")
    return now.join(held, "alert", "full_outer").select("alert", action.alias("action"))


def repeated_uploads(jobs: DataFrame, hours: int = 24) -> DataFrame:
    """Jobs whose file was sent before within the window, with the newest such job that wasn't cancelled or given up."""
    before = Window.partitionBy("file_hash").orderBy("created", "job_id").rowsBetween(Window.unboundedPreceding, -1)
    live = ~F.col("status").isin("CANCELADO", "DEAD_LETTER")
    newest = F.last(F.when(live, F.struct("job_id", "created")), ignorenulls=True).over(before)
    rows = jobs.select("job_id", "file_hash", "created", newest.alias("sent"))
    return rows.filter(F.col("sent.created") >= F.col("created") - F.make_interval(hours=F.lit(hours))).select("job_id", F.col("sent.job_id").alias("first_id"), "file_hash")


def in_flight(jobs: DataFrame) -> DataFrame:
    """Job types and files with a job under way, and the newest such job."""
    live = jobs.filter(F.col("status").isin("PENDENTE", "PROCESSANDO"))
    return live.groupBy("kind", "file_hash").agg(F.count(F.lit(1)).alias("live"), F.max_by("job_id", F.struct("created", "job_id")).alias("newest"))


def file_states(jobs: DataFrame) -> DataFrame:
    """Per file: its newest job that wasn't cancelled or given up, and whether its audit is done."""
    live = ~F.col("status").isin("CANCELADO", "DEAD_LETTER")
    newest = F.max(F.when(live, F.struct("created", "job_id", "status"))).alias("x")
    done = F.max((F.col("kind") == "AUDITORIA") & (F.col("status") == "CONCLUIDO")).alias("audited")
    return jobs.groupBy("file_hash").agg(newest, done).select("file_hash", F.col("x.job_id").alias("newest"), F.col("x.status").alias("status"), "audited")


def recovery_summary(jobs: DataFrame, now: str) -> DataFrame:
    """What a recovery cycle does with stuck jobs and with jobs that wait for a cancelled or dead one: by job type, and in all (kind null)."""
    found = stuck(jobs, now).select("kind", "action", "idle_s").unionByName(blocked(jobs).select("kind", F.lit("CANCELAR").alias("action"), F.lit(0).cast("long").alias("idle_s")))
    return found.groupingSets([[F.col("kind"), F.col("action")], [F.col("action")]], "kind", "action").agg(F.count(F.lit(1)).alias("jobs"), F.max("idle_s").alias("longest_s"))


def alert_history(alerts: DataFrame, most: int = 50) -> DataFrame:
    """The latest alerts with their state and when they were resolved; of one time the larger id first."""
    latest = alerts.orderBy(F.desc("created"), F.desc("alert_id")).limit(most)
    return latest.select("alert_id", "kind", "severity", "resolved", "created", "resolved_at")


def latest_failures(jobs: DataFrame, most: int) -> DataFrame:
    """The latest failures of each type, as many as asked for: (kind, job_id, failure, rank)."""
    latest = Window.partitionBy("kind").orderBy(F.desc("updated"), "job_id")
    rows = jobs.filter(F.col("status").isin("FALHA", "DEAD_LETTER")).withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= most)
    return rows.select("kind", "job_id", S.failure_kind(F.col("message")).alias("failure"), "rank")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts of each severity, 0 where there is none."""
    known = alerts.sparkSession.createDataFrame([("AVISO",), ("CRITICO",), ("EMERGENCIA",)], "severity string")
    return known.join(alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("alerts"))


def purged(rows: DataFrame, at: str, now: str, days: int, states: tuple[str, ...] = ()) -> DataFrame:
    """What a purge removes: finished rows older than so many days, in given states."""
    old = F.col(at) < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return rows.filter(old & F.col("status").isin(*states) if states else old)


def metric_window(events: DataFrame, now: str, hours: int) -> DataFrame:
    """Sum and mean of every metric over the trailing window."""
    inside = F.col("ts").cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    total = F.sum(F.col("value").cast("decimal(18,4)"))
    return events.filter(inside).groupBy("event_type").agg(total.cast("double").alias("total"), (total.cast("double") / F.count("value")).alias("mean"))
