"""Audit trail, field history, versions and lineage as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _history(key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy("seq")


def field_history(audit: DataFrame) -> DataFrame:
    """Every entry of a field with its number, what it replaced, and whether it is the last."""
    w = _history(["document", "field"])
    back = Window.partitionBy("document", "field").orderBy(F.desc("seq"))
    return audit.select(
        "document", "field", "seq", "entry", F.row_number().over(w).alias("version"), F.lag("entry").over(w).alias("previous"), (F.row_number().over(back) == 1).alias("is_final")
    )


def human_edits(audit: DataFrame) -> DataFrame:
    """Entries by people that changed a value, with the value before."""
    rows = audit.withColumn("previous", F.lag("entry").over(_history(["document", "field"])))
    return rows.filter((F.col("actor") == "HUMANO") & ~F.col("entry").eqNullSafe(F.col("previous"))).select("document", "field", "seq", "previous", "entry")


def instability(audit: DataFrame) -> DataFrame:
    """How often a field's value changed from one entry to the next."""
    w = _history(["document", "field"])
    changed = F.lag("seq").over(w).isNotNull() & ~F.col("entry").eqNullSafe(F.lag("entry").over(w))
    return audit.withColumn("changed", changed).groupBy("document", "field").agg(F.count(F.lit(1)).alias("entries"), F.count_if("changed").alias("changes"))


def gaps(audit: DataFrame, minutes: int = 60, long_minutes: int = 480) -> DataFrame:
    """Pauses between a document's events in the order they came in."""
    before = F.lag("at").over(_history(["document"]))
    pause = (F.unix_timestamp("at") - F.unix_timestamp(before)) / 60
    rows = audit.select("document", "seq", pause.alias("minutes")).filter(F.col("minutes") > minutes)
    return rows.select("document", "seq", F.floor("minutes").cast("long").alias("minutes"), F.when(F.col("minutes") > long_minutes, "LONGA").otherwise("CURTA").alias("kind"))


def latest_values(audit: DataFrame) -> DataFrame:
    return audit.groupBy("document", "field").agg(F.max_by("entry", "seq").alias("entry"), F.max("seq").alias("seq"))


def snapshot_diff(audit: DataFrame, at: int, later: int) -> DataFrame:
    """Fields that differ between the whole states at two sequence numbers, nulls included."""
    state = lambda seq, name: latest_values(audit.filter(F.col("seq") <= seq)).select("document", "field", F.col("entry").alias(name))
    return state(at, "old").join(state(later, "new"), ["document", "field"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def version_changes(audit: DataFrame) -> DataFrame:
    """Every version of a document against the one before: how many fields it adds and changes.

    A version is one event; the state before it is what each field held, so a field's own previous entry tells.
    """
    w = _history(["document", "field"])
    before = F.lag(F.struct("entry")).over(w)
    rows = audit.select("document", "seq", "entry", before.alias("before"))
    kind = F.when(F.col("before").isNull(), "NOVO").when(~F.col("entry").eqNullSafe(F.col("before.entry")), "ALTERADO").otherwise("IGUAL")
    return rows.select("document", F.row_number().over(Window.partitionBy("document").orderBy("seq")).alias("version"), "seq", kind.alias("change"), F.col("before.entry").alias("old"), F.col("entry").alias("new"))


def latest_with_label(audit: DataFrame, severity: str) -> DataFrame:
    """The latest version of every document that bears a label."""
    rows = audit.filter(F.col("severity") == severity)
    return rows.groupBy("document").agg(F.max_by(F.struct("seq", "field", "entry"), "seq").alias("x")).select("document", "x.*")


def version_span(audit: DataFrame) -> DataFrame:
    return audit.groupBy("document").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("events"))


def canonical(*columns: str) -> Column:
    """A row's columns as JSON with sorted keys, nulls included, for sealing: different rows have different texts."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sealed(audit: DataFrame) -> DataFrame:
    """Events with their seal."""
    return audit.select("event_id", S.djb2(canonical("actor", "document", "entry", "event_id", "field", "seq", "severity")).alias("seal"))


def integrity(audit: DataFrame, seals: DataFrame) -> DataFrame:
    """Total, intact, broken and unsealed events."""
    now = sealed(audit).withColumnRenamed("seal", "fresh")
    both = now.join(seals, "event_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("seal") == F.col("fresh")).alias("intact"),
        F.count_if(F.col("seal") != F.col("fresh")).alias("broken"), F.count_if(F.col("seal").isNull()).alias("unsealed"),
    )


def search(audit: DataFrame, offset: int, most: int, since: str | None = None, until: str | None = None, **wanted) -> DataFrame:
    """Equality filters, a range of time and a page in order of arrival."""
    for name, value in wanted.items():
        audit = audit.filter(F.col(name) == value)
    if since:
        audit = audit.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    if until:
        audit = audit.filter(F.col("at") <= F.lit(until).cast("timestamp"))
    return audit.orderBy("seq").offset(offset).limit(most)


def traces(audit: DataFrame) -> DataFrame:
    """Every field's entries in order as one text: 'seq=entry -> ...'."""
    steps = F.sort_array(F.collect_list(F.struct("seq", "entry")))
    told = F.transform(steps, lambda x: F.concat(x["seq"].cast("string"), F.lit("="), x["entry"]))
    return audit.groupBy("document", "field").agg(F.array_join(told, " -> ").alias("trace"))


def sensitivity(category: Column, subcategory: Column, field: Column) -> Column:
    """How sensitive an event is; the first rule that holds decides."""
    return (
        F.when(subcategory.isin("EXPORTACAO", "VISUALIZACAO_SENSIVEL"), "critica")
        .when(subcategory.isin("LOGIN", "FALHA_LOGIN", "FALHA_AUTORIZACAO"), "alta")
        .when(category == "CONFIGURACAO", "alta")
        .when((category == "CORRECAO") & F.coalesce(field.rlike("cpf_cnpj|cnpj|cpfCnpj"), F.lit(False)), "critica")
        .when(category == "CORRECAO", "alta")
        .when(category.isin("VALIDACAO", "CONFLITO"), "media")
        .when(subcategory.isin("REMOCAO", "SUBSTITUICAO"), "alta")
        .otherwise("baixa")
    )


def lineage(compared: DataFrame) -> DataFrame:
    """Steps of every compared field: each reading that exists, then the decision."""
    steps = F.array(
        F.when(F.col("value_a").isNotNull(), F.struct(F.lit(1).alias("step"), F.lit("METODO_A").alias("origin"), F.col("value_a").alias("value"))),
        F.when(F.col("value_b").isNotNull(), F.struct(F.lit(2).alias("step"), F.lit("METODO_B").alias("origin"), F.col("value_b").alias("value"))),
        F.struct(F.lit(3).alias("step"), F.lit("DECISAO").alias("origin"), F.col("value").alias("value")),
    )
    return compared.select("doc_id", "field", F.explode(F.array_compact(steps)).alias("s")).select("doc_id", "field", "s.*")
