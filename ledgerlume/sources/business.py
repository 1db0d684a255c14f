"""Business tables: the fiscal schema, derived from the star-schema tables by projections.

`frame(spark, sf_dir, name)` gives a lazy DataFrame; `SQL[name]` is the same projection for the SQL
oracle. Only the columns a query selects reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role of each event type as a job type.
JOB_TYPES = "CASE event_type WHEN 'signup' THEN 'UPLOAD' WHEN 'purchase' THEN 'EXTRACAO' WHEN 'view' THEN 'OCR_LEITURA' WHEN 'click' THEN 'VALIDACAO' ELSE 'AUDITORIA' END"
JOB_STATUS = (
    "CASE WHEN event_id % 20 < 11 THEN 'CONCLUIDO' WHEN event_id % 20 < 14 THEN 'PENDENTE' WHEN event_id % 20 < 16 THEN 'PROCESSANDO'"
    " WHEN event_id % 20 < 18 THEN 'DEAD_LETTER' WHEN event_id % 20 = 18 THEN 'CANCELADO' ELSE 'FALHA' END"
)
TAX_KINDS = "CASE l_linenumber % 5 WHEN 0 THEN 'ISS' WHEN 1 THEN 'IR' WHEN 2 THEN 'PIS' WHEN 3 THEN 'COFINS' ELSE 'INSS' END"

_FIELD = "CASE event_type WHEN 'signup' THEN 'numero_nota' WHEN 'purchase' THEN 'valor_iss' WHEN 'view' THEN 'tomador.cpf_cnpj' WHEN 'click' THEN 'valor_servico_fin' ELSE 'servico.descricao' END"
_CORRECTED = (
    "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_type IN ('purchase', 'click') THEN CASE WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN '20,50' ELSE '1.010,00' END"
    " WHEN event_type = 'view' THEN CASE WHEN event_id % 29 = 0 THEN '22.222.222/0001-91' ELSE '11.111.111/0001-91' END"
    " WHEN event_type = 'signup' THEN CASE WHEN event_id % 29 = 0 THEN '2001' ELSE '1005' END ELSE CASE WHEN event_id % 29 = 0 THEN 'Limpeza' ELSE 'Manutenção geral' END END"
)
_EXTRACTED = (
    f"CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN {_CORRECTED} WHEN event_id % 5 = 1 THEN 'lOO5' WHEN event_id % 5 = 2 THEN '1010,00' WHEN event_id % 5 = 3 THEN 'Data de emissão' ELSE 'outro' END"
)

#: name: (table, column expressions valid in both engines)
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "invoices": (
        "orders",
        {
            "id": "o_orderkey",
            "number": "CAST(o_orderkey AS {text})",
            "series_number": "CAST(o_orderkey % 200 AS {text})",
            "customer_id": "o_custkey",
            "supplier_id": "o_orderkey % 100 + 1",
            "substitute_id": "CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 1 END",
            "gross": "o_totalprice",
            "net": "CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice * 95 + 0.5) / 100 END",
            "iss": "floor(o_totalprice * 5 + 0.5) / 100",
            "rate": "CAST(o_orderkey % 8 AS {double})",
            "issued": "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS {ts}) END",
            "created": "CAST(o_orderdate AS {ts}) + INTERVAL 3 DAY",
            "due": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL 28 DAY END",
            "withheld": "floor(o_totalprice * 1.5 + 0.5) / 100",
            "anticipated": "CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice * 90 + 0.5) / 100 END",
            "description": "concat('Serviço ', o_orderkey % 97)",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'ATIVA' WHEN 'F' THEN 'PAGA' ELSE 'CANCELADA' END",
            "tenant": "o_custkey % 7",
        },
    ),
    "parties": (
        "customer",
        {
            "party_id": "c_custkey",
            "legal_name": "CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END",
            "trade_name": "CASE WHEN c_custkey % 15 <> 0 THEN concat('Loja ', c_custkey % 40, ' Ltda') END",
            "tax_id": "lpad(CAST(c_custkey * 104729 AS {text}), 14, '0')",
            "segment": "c_mktsegment",
            "nation_id": "c_nationkey",
        },
    ),
    "taxes": (
        "lineitem",
        {
            "tax_id": "l_orderkey * 10 + l_linenumber",
            "invoice_id": "l_orderkey",
            "kind": TAX_KINDS,
            "status": "CASE WHEN l_linestatus = 'O' THEN 'PENDENTE' WHEN l_returnflag = 'R' THEN 'VENCIDO' ELSE 'PAGO' END",
            "due": "CAST(l_shipdate AS {ts})",
            "month": "CASE WHEN l_linenumber % 3 = 0 THEN '2024-01' ELSE '1996-05' END",
            "amount": "floor(l_extendedprice * l_tax * 100 + 0.5) / 100",
        },
    ),
    "expenses": (
        "lineitem",
        {
            "expense_id": "l_orderkey * 10 + l_linenumber",
            "service_id": "l_partkey",
            "supplier": "concat('Fornecedor ', l_suppkey)",
            "category": "CASE l_returnflag WHEN 'R' THEN 'MATERIAL' WHEN 'A' THEN 'TRANSPORTE' ELSE 'SERVICO' END",
            "description": "concat('Compra ', l_linenumber, ' do pedido ', l_orderkey)",
            "quantity": "l_quantity",
            "spent": "floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100",
            "spent_on": "CAST(l_shipdate AS {ts})",
        },
    ),
    "services": (
        "part",
        {"service_id": "p_partkey", "name": "p_name", "contract": "floor(p_retailprice * 60000 + 0.5) / 100", "status": "CASE WHEN p_size > 25 THEN 'ABERTO' ELSE 'CONCLUIDO' END"},
    ),
    "worker_docs": (
        "orders",
        {
            "doc_id": "o_orderkey",
            "worker_id": "o_custkey",
            "kind": "CASE WHEN o_orderkey % 2 = 0 THEN 'INTEGRACAO' ELSE 'ASO' END",
            "expires": "CAST(o_orderdate AS {ts})",
        },
    ),
    "workers": ("customer", {"worker_id": "c_custkey", "name": "c_name", "user_id": "c_nationkey"}),
    "users": ("nation", {"user_id": "n_nationkey", "user_name": "n_name"}),
    "jobs": (
        "events",
        {
            "job_id": "event_id",
            "kind": JOB_TYPES,
            "status": JOB_STATUS,
            "priority": "CAST(event_id % 3 AS {int})",
            "attempts": "CAST(event_id % 4 AS {int})",
            "document_id": "user_id",
            "file_hash": "concat('h', user_id, '-', event_id % 3)",
            "worker": "concat('w', event_id % 6)",
            "created": "CAST(ts AS {ts})",
            "started": "CASE WHEN event_id % 20 < 16 AND event_id % 20 NOT BETWEEN 11 AND 13 THEN CAST(ts AS {ts}) + INTERVAL 5 SECOND END",
            "finished": "CASE WHEN event_id % 20 < 11 OR event_id % 20 IN (16, 17, 19) THEN CAST(ts AS {ts}) + INTERVAL 65 SECOND END",
            "updated": "CASE WHEN event_id % 20 < 11 OR event_id % 20 IN (16, 17, 19) THEN CAST(ts AS {ts}) + INTERVAL 65 SECOND ELSE CAST(ts AS {ts}) + INTERVAL 5 SECOND END",
            "after_ids": "CASE event_id % 5 WHEN 1 THEN {array}(CASE WHEN event_id % 60 < 20 THEN event_id + 5 WHEN event_id % 60 < 40 THEN event_id + 7 ELSE event_id - 9 END, event_id - 2) WHEN 2 THEN {array}(CASE WHEN event_id % 40 < 20 THEN event_id - 8 ELSE event_id + 2 END) WHEN 3 THEN {array}(event_id - 3, event_id + 1000000000) END",
            "message": "CASE event_id % 6 WHEN 0 THEN 'Connection timed out' WHEN 1 THEN 'OCR engine lost' WHEN 2 THEN 'Prisma lock' WHEN 3 THEN 'ENOENT' WHEN 4 THEN 'parsing failed' ELSE 'unknown' END",
        },
    ),
    "audit": (
        "events",
        {
            "event_id": "event_id",
            "document": "CAST(user_id AS {text})",
            "field": "event_type",
            "seq": "event_id",
            "at": "CAST(ts AS {ts})",
            "actor": "CASE WHEN event_id % 4 = 0 THEN 'HUMANO' ELSE 'EXTRATOR' END",
            "severity": "CASE event_id % 5 WHEN 0 THEN 'CRITICO' WHEN 1 THEN 'INFO' WHEN 2 THEN 'AVISO' ELSE 'INFO' END",
            "entry": "CAST(CAST(floor(value) AS {int}) % 4 AS {text})",
        },
    ),
    "corrections": (
        "events",
        {
            "correction_id": "event_id",
            "tenant": "user_id",
            "seq": "event_id",
            "field": _FIELD,
            "section": "CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 6 = 0 THEN 'prestador' ELSE 'tomador' END ELSE 'financeiro' END",
            "extracted": _EXTRACTED,
            "corrected": _CORRECTED,
            "human": "event_id % 3 <> 0",
            "note": "CASE WHEN event_id % 4 <> 0 THEN 'conferido' END",
            "agreement": "CASE event_id % 9 WHEN 0 THEN 'CONCORDANCIA_TOTAL' WHEN 1 THEN 'DIVERGENCIA_CRITICA' ELSE 'DIVERGENCIA_LEVE' END",
            "winner": "CASE event_id % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'AMBOS' END",
            "confidence": "CAST(event_id % 100 AS {int})",
        },
    ),
    "payments": (
        "lineitem",
        {
            "payment_id": "l_orderkey * 10 + l_linenumber",
            "charge_id": "CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE l_orderkey * 10 + l_linenumber END",
            "status": "CASE WHEN l_partkey % 7 = 0 THEN 'pending' ELSE 'approved' END",
            "live": "l_partkey % 11 <> 0",
            "amount": "floor(l_extendedprice * 100 + 0.5) / 100 - CASE l_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 0.005 ELSE 0 END",
            "currency": "CASE WHEN l_partkey % 17 = 0 THEN 'USD' ELSE 'BRL' END",
        },
    ),
    "alerts": (
        "events",
        {
            "alert_id": "event_id",
            "kind": "CASE event_id % 3 WHEN 0 THEN 'fila_acumulando' WHEN 1 THEN 'latencia_alta' ELSE 'taxa_erro_alta' END",
            "severity": "CASE event_id % 4 WHEN 0 THEN 'EMERGENCIA' WHEN 1 THEN 'CRITICO' ELSE 'AVISO' END",
            "resolved": "event_id % 5 <> 0",
            "created": "CAST(ts AS {ts})",
            "resolved_at": "CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS {ts}) + INTERVAL 1 HOUR END",
        },
    ),
    "subscriptions": (
        "orders",
        {
            "sub_id": "o_orderkey",
            "user_id": "o_custkey",
            "trial_end": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL 7 DAY END",
            "period_end": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL 30 DAY END",
            "reminded": "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS {ts}) END",
            "cancelled": "CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_orderdate AS {ts}) END",
            "contract": "CASE WHEN o_orderkey % 5 <> 0 THEN concat('c', o_orderkey) END",
            "price": "CAST(29.9 + o_orderkey % 3 * 10 AS {double})",
        },
    ),
    "charges": (
        "lineitem",
        {
            "charge_id": "l_orderkey * 10 + l_linenumber",
            "sub_id": "l_orderkey",
            "charge_status": "CASE WHEN l_returnflag = 'R' THEN 'RECUSADA' WHEN l_linestatus = 'O' THEN 'PROCESSANDO' ELSE 'APROVADA' END",
            "amount": "floor(l_extendedprice * 100 + 0.5) / 100",
            "currency": "'BRL'",
            "handled": "CAST(l_shipdate AS {ts})",
        },
    ),
}

SPARK_TYPES = {"array": "array", "text": "string", "ts": "timestamp", "double": "double", "int": "int"}
DUCK_TYPES = {"array": "list_value", "text": "VARCHAR", "ts": "TIMESTAMP", "double": "DOUBLE", "int": "INTEGER"}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A business table as a lazy projection of its source table."""
    table, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e.format(**SPARK_TYPES)} AS {c}" for c, e in columns.items()])


def _sql(name: str) -> str:
    table, columns = TABLES[name]
    return "SELECT " + ", ".join(f'{e.format(**DUCK_TYPES)} AS "{c}"' for c, e in columns.items()) + f" FROM {table}"


SQL = {name: _sql(name) for name in TABLES}


def with_tables(sql: str, *names: str) -> str:
    """An oracle statement over business tables; `sql` may begin with further common tables, each ended by a comma before SELECT."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
