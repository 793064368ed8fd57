"""Every query of the retrieval engine by name, with the SQL it is compared with."""

from __future__ import annotations

from . import analytics_queries as _a
from . import binary_queries as _b
from . import index_queries as _i
from . import operation_queries as _o
from . import retrieval_queries as _r

QUERIES = {**_r.QUERIES, **_a.QUERIES, **_o.QUERIES, **_i.QUERIES, **_b.QUERIES}
ORACLE_SQL = {**_r.ORACLE_SQL, **_a.ORACLE_SQL, **_o.ORACLE_SQL, **_i.ORACLE_SQL, **_b.ORACLE_SQL}
