"""The claims schema mapped from star-schema tables (orders, lineitem, customer, ...).

The mapping is written once as SQL expressions. `claims_base_sql` renders it as a
query, `claims_base` as a DataFrame. Only adding days to a timestamp differs
between SQL dialects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.rules import APPEAL_PRIOR, DENIAL_REASONS
from claimloom.storage import materialize, spread

# Code lists.
PROCEDURE_CODES = ["99213", "99214", "99215", "93000", "36415", "80053", "71046", "97110", "20610", "45378"]
DIAGNOSIS_CODES = ["I10", "E11.9", "M54.5", "J06.9", "K21.9", "R51", "F41.1", "M25.50", "N39.0", "Z00.00"]
SPECIALTIES = ["internal_medicine", "cardiology", "orthopedics", "family_practice", "radiology"]
PAYER_TYPES = ["commercial", "medicare_advantage", "medicaid"]
PLACES = ["11", "21", "22", "23"]
SUBMISSION_LAGS = [1, 2, 3, 5, 7, 10, 14, 21, 30, 45, 60]

AS_OF = "2001-10-01 00:00:00"


def pick(index: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def spark_add_days(ts: str, days: str) -> str:
    return f"timestampadd(DAY, cast({days} AS int), {ts})"


def duck_add_days(ts: str, days: str) -> str:
    return f"({ts} + to_days(cast({days} AS int)))"


AddDays = Callable[[str, str], str]


def mapping_layers(add_days: AddDays) -> list[list[tuple[str, str]]]:
    """Successive projections: each layer may use the names of the layers before it."""
    key = "claim_id"
    prior = "CASE denial_reason_code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in APPEAL_PRIOR.items()) + " END"
    return [
        [
            (key, "o_orderkey"),
            ("payer_id", "cast(c_nationkey AS bigint)"),
            ("provider_id", "cast(o_custkey % 40 AS bigint)"),
            ("patient_ref", "concat('PT-', cast(o_custkey AS string))"),
            ("claim_amount", "o_totalprice / cast(20 AS double)"),
            ("service_date", "cast(o_orderdate AS timestamp)"),
            ("order_status", "o_orderstatus"),
        ],
        [
            ("claim_number", f"concat('CLM-', cast({key} AS string))"),
            ("claim_type", pick(f"{key} % 2", ["professional", "institutional"])),
            ("place_of_service", pick(f"{key} % 4", PLACES)),
            (
                "submission_date",
                f"CASE WHEN {key} % 97 = 0 THEN NULL ELSE "
                f"{add_days('service_date', pick(f'{key} % 11', SUBMISSION_LAGS))} END",
            ),
            (
                "timely_filing_deadline",
                f"CASE WHEN {key} % 13 = 0 THEN NULL ELSE {add_days('service_date', '40')} END",
            ),
            ("authorization_status", f"CASE WHEN ({key} * 7 + 3) % 50 < 9 THEN 'MISSING' ELSE 'PRESENT' END"),
            ("eligibility_status", f"CASE WHEN ({key} * 11 + 5) % 10 = 0 THEN 'FAIL' ELSE 'VERIFIED' END"),
            (
                "documentation_completeness",
                f"cast(40 AS double) + cast(({key} * 37) % 6001 AS double) / cast(100 AS double)",
            ),
        ],
        [
            (
                "denial_reason_code",
                "CASE WHEN order_status <> 'F' OR submission_date IS NULL THEN NULL "
                "WHEN authorization_status = 'MISSING' THEN 'MISSING_AUTHORIZATION' "
                "WHEN eligibility_status = 'FAIL' THEN 'ELIGIBILITY_ISSUE' "
                "WHEN documentation_completeness < 70 THEN 'MISSING_DOCUMENTATION' "
                f"WHEN {key} % 11 = 10 THEN 'TIMELY_FILING' "
                f"ELSE {pick(f'{key} % 8', DENIAL_REASONS)} END",
            ),
            ("denial_date", add_days("submission_date", f"(5 + {key} % 16)")),
        ],
        [
            (
                "outcome",
                f"CASE WHEN denial_reason_code IS NULL OR {key} % 100 >= 55 THEN NULL "
                f"WHEN ({key} * 13) % 100 < cast(100 AS double) * "
                f"(cast({prior} AS double) * documentation_completeness / cast(100 AS double) "
                "* cast(0.9 AS double) + cast(0.05 AS double)) THEN 'WON' ELSE 'LOST' END",
            ),
            ("appeal_date", add_days("denial_date", f"(3 + {key} % 13)")),
            ("decision_date", add_days("denial_date", f"(20 + {key} % 41)")),
        ],
        [
            (
                "status",
                "CASE WHEN submission_date IS NULL THEN 'DRAFT' WHEN outcome = 'WON' THEN 'RECOVERED' "
                "WHEN denial_reason_code IS NOT NULL THEN 'DENIED' ELSE 'PAID' END",
            ),
        ],
    ]


LINE_COLUMNS = [
    ("claim_id", "l_orderkey"),
    ("procedure_code", pick("l_partkey % 10", PROCEDURE_CODES)),
    ("diagnosis_code", pick("l_suppkey % 10", DIAGNOSIS_CODES)),
    ("modifiers", "CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN '25' WHEN 'R' THEN '59' END"),
    ("line_amount", "l_extendedprice / cast(20 AS double)"),
    ("units", "cast(l_quantity AS int)"),
]
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

CLAIM_COLUMNS = [
    "claim_id",
    "claim_number",
    "payer_id",
    "provider_id",
    "patient_ref",
    "claim_amount",
    "claim_type",
    "place_of_service",
    "service_date",
    "submission_date",
    "timely_filing_deadline",
    "authorization_status",
    "eligibility_status",
    "documentation_completeness",
    "status",
]


def claims_base_sql(add_days: AddDays) -> str:
    """The mapping as one nested query over `orders` and `customer`."""
    source = "orders JOIN customer ON o_custkey = c_custkey"
    for depth, layer in enumerate(mapping_layers(add_days)):
        columns = ", ".join(f"{expr} AS {name}" for name, expr in layer)
        keep = "" if depth == 0 else "*, "
        source = f"(SELECT {keep}{columns} FROM {source}) AS t{depth}"
    return f"SELECT * FROM {source}"


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


@dataclass(frozen=True)
class Tables:
    """Mapped tables of one data folder; every property is a lazy DataFrame."""

    spark: SparkSession
    folder: str

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw(self, name: str) -> DataFrame:
        return spread(self.scan(name))

    @property
    def base(self) -> DataFrame:
        """The mapped claim rows, staged once per application and folder.

        Operators get a stored claims table to scan, as they would in production, and
        every later filter and column choice reaches that scan.
        """
        return self._staged("claims", self.mapped)

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STAGED:
            _STAGED[key] = materialize(build(), name)
        return _STAGED[key]

    def mapped(self) -> DataFrame:
        orders, customer = self.raw("orders"), self.scan("customer")
        df = orders.join(customer, orders.o_custkey == customer.c_custkey)
        for depth, layer in enumerate(mapping_layers(spark_add_days)):
            keep = [] if depth == 0 else ["*"]
            df = df.selectExpr(*keep, *[f"{expr} AS {name}" for name, expr in layer])
        return df

    @property
    def claims(self) -> DataFrame:
        return self.base.select(*CLAIM_COLUMNS)

    @property
    def denials(self) -> DataFrame:
        return self.base.filter(F.col("denial_reason_code").isNotNull()).select(
            F.col("claim_id").alias("denial_id"), "claim_id", "denial_reason_code", "denial_date"
        )

    @property
    def appeals(self) -> DataFrame:
        return self.base.filter(F.col("outcome").isNotNull()).select(
            F.col("claim_id").alias("appeal_id"),
            F.col("claim_id").alias("denial_event_id"),
            "appeal_date",
            "outcome",
            F.when(F.col("outcome") == "WON", F.col("claim_amount")).otherwise(0.0).alias("recovered_amount"),
            "decision_date",
        )

    @property
    def lines(self) -> DataFrame:
        columns = [f"{expr} AS {name}" for name, expr in LINE_COLUMNS]
        key = f"struct({', '.join(LINE_ORDER)}) AS line_key"
        return self._staged("lines", lambda: self.raw("lineitem").selectExpr(*columns, key))

    @property
    def payers(self) -> DataFrame:
        return self.scan("nation").selectExpr(
            "cast(n_nationkey AS bigint) AS payer_id",
            "n_name AS name",
            f"{pick('n_nationkey % 3', PAYER_TYPES)} AS payer_type",
        )

    @property
    def providers(self) -> DataFrame:
        return self.scan("supplier").selectExpr(
            "s_suppkey AS provider_id",
            "cast(1000000000 + s_suppkey AS string) AS npi",
            "s_name AS name",
            f"{pick('s_nationkey % 5', SPECIALTIES)} AS specialty",
        )

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS document_id",
            "concat(source, '-', cast(doc_id AS string)) AS title",
            "'payer_policy' AS source_type",
            "'1.0' AS version",
            "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 25 END AS payer_id",
            "text",
        )

    @property
    def audit_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "cast(ts AS timestamp) AS created_at",
            "user_id AS entity_id",
            "'user' AS actor_type",
            "event_type",
            "props AS payload",
        )
