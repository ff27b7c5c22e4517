"""Which implementation answers which request: families, conventions, soundness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Implementation, input type, family, threshold side, empty-set rule, sound on all audited runs.
# The side of DefMe is recorded as floor but contradicted by run tables, so it is marked unverified.
IMPLEMENTATIONS = [
    ("DefMe", "transactional", "minimal_generator", "unverified", "always", True),
    ("Gr_growth", "transactional", "minimal_generator", "round", "always", True),
    ("Talky_G", "transactional", "minimal_generator", "ceil", "no_full_support_item", False),
    ("Talky_G_diffset", "transactional", "minimal_generator", "ceil", "no_full_support_item", False),
    ("Pascal", "transactional", "minimal_generator", "ceil", "never", True),
    ("Zart", "transactional", "generator_closure_pairs", "ceil", "some_item_frequent", True),
    ("Apriori_Gen_Borgelt", "transactional", "minimal_generator", "ceil", "never", True),
    ("Eclat_Gen_Borgelt", "transactional", "minimal_generator", "ceil", "never", True),
    ("FPgrowth_Gen_Borgelt", "transactional", "minimal_generator", "ceil", "never", True),
    ("FEAT", "sequential", "sequential_generator", "floor", "never", True),
    ("FSGP", "sequential", "sequential_generator", "floor", "never", True),
    ("VGEN", "sequential", "sequential_generator", "ceil", "always", True),
    ("HUG_Miner", "utility", "high_utility_generator", "absolute", "never", True),
    ("GHUI_Miner", "utility", "ghui", "absolute", "never", True),
    ("HUCI_Gen", "utility", "utility_minimal", "absolute", "never", False),
    ("FGC_Stream", "transactional", "generator_closure_pairs", "round", "always", True),
    ("AprioriRare", "transactional", "minimal_rare_itemset", "indistinguishable", "never", True),
]
# Emitted family, requested family, how it is satisfied.
SATISFIES = [
    *((f, f, "exact") for f in ("minimal_generator", "sequential_generator", "generator_closure_pairs", "high_utility_generator", "ghui", "utility_minimal", "minimal_rare_itemset")),
    ("generator_closure_pairs", "minimal_generator", "post_filter"),
    ("generator_closure_pairs", "closed_itemset", "post_filter"),
    ("minimal_generator", "disjunction_free", "post_filter"),
    ("ghui", "high_utility_generator", "post_filter"),
]
FAMILIES = ["minimal_generator", "disjunction_free", "sequential_generator", "generator_closure_pairs", "closed_itemset", "high_utility_generator", "ghui", "utility_minimal", "minimal_rare_itemset"]
DATA_TYPES = ["transactional", "sequential", "utility"]


@dataclass(frozen=True)
class MiningTask:
    """A request; data_type and family come from closed lists, None means no demand."""

    data_type: str
    family: str
    boundary: str | None = None
    include_empty: bool | None = None
    trust: str = "sound"
    allow_post_filter: bool = True

    def __post_init__(self) -> None:
        if self.data_type not in DATA_TYPES or self.family not in FAMILIES or self.trust not in ("sound", "any"):
            raise ValueError(f"unknown request {self}")


def implementations(spark: SparkSession) -> DataFrame:
    """The capability table; its size is fixed."""
    return spark.createDataFrame(IMPLEMENTATIONS, "algorithm string, input_type string, emits string, boundary string, empty_rule string, sound boolean")


def satisfies(spark: SparkSession) -> DataFrame:
    """The family relation; its size is fixed."""
    return spark.createDataFrame(SATISFIES, "emits string, requested string, how string")


def capable(spark: SparkSession, task: MiningTask) -> DataFrame:
    """(algorithm, how, warning): implementations that answer the task; integral thresholds are boundary-neutral, so only fixed sides are compared."""
    j = implementations(spark).join(satisfies(spark), "emits").where((F.col("requested") == task.family) & (F.col("input_type") == task.data_type))
    if not task.allow_post_filter:
        j = j.where("how = 'exact'")
    if task.trust == "sound":
        j = j.where("sound")
    if task.boundary:
        j = j.where((F.col("boundary") == task.boundary) | ~F.col("boundary").isin("floor", "ceil", "round"))
    if task.include_empty is not None:
        j = j.where(F.col("empty_rule") != ("never" if task.include_empty else "always"))
    warn = F.concat_ws("; ", F.when(F.col("boundary") == "unverified", "threshold side not verified"), F.when(~F.col("sound"), "known unsound rows"), F.when(F.col("empty_rule").isin("no_full_support_item", "some_item_frequent"), "empty set depends on the data"))
    return j.select("algorithm", "how", warn.alias("warning"))


def all_requests(spark: SparkSession) -> DataFrame:
    """(family, algorithm, how): the relation of all requested families to implementations that answer them soundly."""
    return implementations(spark).where("sound").join(satisfies(spark), "emits").select(F.col("requested").alias("family"), "algorithm", "how")
