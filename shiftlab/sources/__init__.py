from shiftlab.sources.tables import TABLES, TABLE_KEYS, load_table, register_tables  # noqa: F401
