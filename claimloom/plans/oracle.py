"""SQL counterpart of every query that SQL can express."""

from claimloom.plans.oracle_claims import ORACLE as _CLAIMS
from claimloom.plans.oracle_documents import ORACLE as _DOCUMENTS
from claimloom.plans.oracle_stored import ORACLE as _STORED
from claimloom.plans.oracle_streams import ORACLE as _STREAMS

ORACLE_SQL: dict[str, str] = {**_CLAIMS, **_DOCUMENTS, **_STORED, **_STREAMS}
