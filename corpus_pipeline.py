"""The corpus pipeline: quality, language, near copies, mixing and packing, in that order.

The stages are those of `groundline.llm.stages`; without that subpackage this module can't be imported.
"""

from groundline.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
