"""Stand-in inputs derived from the driver tables.

``participants``: one row per lineitem (key ``id``), the wide participant
table of the original task with its column names; measurements are simple
functions of lineitem / part columns chosen so that every cleaning rule,
every division-by-zero and every age group is exercised. Missing values are
punched by key. The same column list renders the Spark frame and the DuckDB
CTE, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.plans.tables import table

_ZONE_NULL_MOD = [(5, 1), (6, 2), (7, 3), (8, 4), (9, 5), (10, 6), (11, 7)]
_SEASONS = ["Spring", "Summer", "Fall", "Winter"]


def _season(src: str, shift: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SEASONS))
    return f"CASE ({src} + {shift}) % 5 {cases} ELSE NULL END"


# unique row key: (orderkey, linenumber) alone repeats in the generated lineitem
ID_EXPR = "(l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey)"

PARTICIPANT_COLUMNS: list[tuple[str, str]] = [
    ("id", ID_EXPR),
    ("split", "CASE WHEN l_orderkey % 2 = 0 THEN 'train' ELSE 'test' END"),
    ("Basic_Demos-Age", "CAST(p_size AS DOUBLE) / 2.0"),
    ("Physical-BMI", "CASE WHEN " + ID_EXPR + " % 7 = 0 THEN NULL ELSE l_quantity END"),
    ("Physical-Weight", "l_extendedprice / 1000.0"),
    ("Physical-Height", "p_retailprice / 10.0"),
    ("Physical-HeartRate", "l_quantity + p_size"),
    ("PreInt_EduHx-computerinternet_hoursday", "CAST(l_linenumber % 4 AS DOUBLE)"),
    ("BIA-BIA_Fat", "l_discount * 700.0"),
    ("BIA-BIA_BMI", "CASE WHEN " + ID_EXPR + " % 11 = 0 THEN NULL ELSE l_tax * 100.0 + 10.0 END"),
    ("BIA-BIA_FFMI", "l_quantity / 2.0"),
    ("BIA-BIA_FMI", "l_discount * 50.0 - 1.0"),
    ("BIA-BIA_LST", "l_extendedprice / 300.0"),
    ("BIA-BIA_TBW", "l_extendedprice / 330.0"),
    ("BIA-BIA_BMR", "l_extendedprice / 20.0"),
    ("BIA-BIA_DEE", "l_extendedprice / 10.0"),
    ("BIA-BIA_SMM", "l_quantity * 7.0"),
    ("BIA-BIA_ICW", "l_tax * 1000.0"),
    ("BIA-BIA_ECW", "l_quantity * 2.5"),
    ("BIA-BIA_BMC", "l_tax * 150.0 - 1.0"),
    ("BIA-BIA_FFM", "l_extendedprice / 250.0 - 10.0"),
    ("BIA-BIA_LDM", "l_quantity * 2.2"),
    ("BIA-BIA_Frame_num", "CAST(l_linenumber AS DOUBLE)"),
    ("FGC-FGC_CU", "CAST(p_size % 30 AS DOUBLE)"),
    ("FGC-FGC_PU", "CAST(p_size % 20 AS DOUBLE)"),
    ("FGC-FGC_TL", "CAST(p_size % 12 AS DOUBLE)"),
    ("FGC-FGC_SRL", "l_quantity / 3.0"),
    ("FGC-FGC_SRR", "CASE WHEN " + ID_EXPR + " % 5 = 0 THEN NULL ELSE l_quantity / 4.0 END"),
    ("FGC-FGC_GSND", "l_quantity * 1.5"),
    ("FGC-FGC_GSD", "CASE WHEN " + ID_EXPR + " % 3 = 0 THEN NULL ELSE l_quantity * 1.3 END"),
] + [
    (z, "CASE WHEN " + ID_EXPR + f" % {m} = {r} THEN NULL "
        f"ELSE CAST((l_linenumber + {i}) % 3 AS DOUBLE) END")
    for i, (z, (m, r)) in enumerate(zip(K.ZONE_COLUMNS, _ZONE_NULL_MOD))
] + [
    ("PAQ_A-PAQ_A_Total", "l_discount * 50.0"),
    ("Fitness_Endurance-Time_Sec", "CAST(l_partkey % 300 AS DOUBLE)"),
] + [
    (s, _season("l_linenumber" if i % 2 == 0 else "p_size", i)) for i, s in enumerate(K.SEASON_COLUMNS)
] + [
    (f"PCIAT-PCIAT_{i:02d}", f"CAST((CAST(l_quantity AS BIGINT) + {i}) % 5 AS DOUBLE)") for i in range(1, 21)
] + [
    ("PCIAT-Season", _season("p_size", 3)),
    (K.SII, "CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_quantity <= 12 THEN 0.0 "
            "WHEN l_quantity <= 25 THEN 1.0 WHEN l_quantity <= 37 THEN 2.0 ELSE 3.0 END"),
    (K.PCIAT_TOTAL, "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity * 1.6 END"),
]

NUMERIC_PARTICIPANT_COLUMNS = [n for n, e in PARTICIPANT_COLUMNS
                               if n not in ("id", "split", "PCIAT-Season", *K.SEASON_COLUMNS)]
# every measurement is DOUBLE in both engines (a bare 0.0 literal is DECIMAL in Spark)
PARTICIPANT_COLUMNS = [(n, f"CAST({e} AS DOUBLE)" if n in NUMERIC_PARTICIPANT_COLUMNS else e)
                       for n, e in PARTICIPANT_COLUMNS]


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    return j.select(*[F.expr(e).alias(n) for n, e in PARTICIPANT_COLUMNS])


def participants_cte(name: str = "participants") -> str:
    cols = ",\n  ".join(f'{e} AS "{n}"' for n, e in PARTICIPANT_COLUMNS)
    return (f"{name} AS (SELECT\n  {cols}\nFROM lineitem JOIN part ON l_partkey = p_partkey)")


def q(name: str) -> str:
    """DuckDB identifier quoting."""
    return f'"{name}"'
