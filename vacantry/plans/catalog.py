"""All registered queries."""

from vacantry.plans import (contract_queries, field_queries, page_queries, report_queries, role_queries,  # noqa: F401
                            salary_queries, selection_queries, source_queries, state_queries,
                            stream_queries)
from vacantry.plans.registry import ORACLES, QUERIES  # noqa: F401
