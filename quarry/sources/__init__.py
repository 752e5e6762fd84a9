from quarry.sources.tables import TABLES, load_table  # noqa: F401
from quarry.sources.incidents import incidents, incidents_sql  # noqa: F401
