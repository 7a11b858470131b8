"""All registered queries."""
from plumbline.workload import ingestion, operations, retrieval  # noqa: F401  (importing registers)
from plumbline.workload.registry import ENTRIES

__all__ = ["ENTRIES"]
