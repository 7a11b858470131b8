"""Query understanding: intent, table affinity, expansion."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent patterns, first match wins, and table signals.
INTENTS = {
    "lookup": r"what is|who is|when did|where is|define|meaning of|what does",
    "comparison": r"compare|difference|versus|vs[.]?|better|worse|differ",
    "procedural": r"how to|steps to|process of|guide|tutorial|implement",
    "analytical": r"why|explain|reason|cause|effect|impact|relationship|how does",
}
TABLE_SIGNALS = (
    r"\p{Nd}",
    r"how many|how much|count|total|sum",
    r"compare|versus|vs[.]?|differ",
    r"list|which|highest|lowest|best|worst|most|least|top|bottom",
    r"average|mean|rate|percent|ratio|score",
)
EXPANDED_INTENTS = ("analytical", "general")
SIGNAL_STEP, SIGNAL_CAP = 0.12, 1.5


def classify_intent(query: Column) -> Column:
    lowered = F.lower(query)
    branches = F
    for name, pattern in INTENTS.items():
        branches = branches.when(lowered.rlike(pattern), name)
    return branches.otherwise("general")


def table_query_weight(query: Column) -> Column:
    lowered = F.lower(query)
    hits = reduce(lambda a, b: a + b, [lowered.rlike(p).cast("int") for p in TABLE_SIGNALS])
    return F.least(F.lit(1.0) + hits * F.lit(SIGNAL_STEP), F.lit(SIGNAL_CAP))


def needs_expansion(query: Column, enabled: bool = True) -> Column:
    return F.lit(enabled) & classify_intent(query).isin(*EXPANDED_INTENTS)


def apply_expansion(query: Column, passage: Column) -> Column:
    """``query passage``; the bare query when there is no passage or the passage is a bracketed failure notice."""
    lowered = F.lower(passage)
    failed = passage.startswith("[") & (lowered.contains("error") | lowered.contains("not set"))
    return F.when(passage.isNull() | failed, query).otherwise(F.concat(query, F.lit(" "), passage))


def adaptive_k(modality: Column, query: Column, base_k: dict) -> Column:
    """Base k of a modality; for tables scaled by the table weight and truncated."""
    cases = F
    for name, k in base_k.items():
        value = (F.lit(k) * table_query_weight(query)).cast("int") if name == "table" else F.lit(k)
        cases = cases.when(modality == name, value)
    return cases.otherwise(F.lit(max(base_k.values())))
