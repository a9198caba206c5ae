"""All registered queries: importing the modules registers theirs."""

from docengine.plans import catalog_checks, catalog_more, catalog_retrieval, catalog_text  # noqa: F401
from docengine.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
