from respondo.sources.tables import TABLES, fits, load, sized_broadcast

__all__ = ["TABLES", "fits", "load", "sized_broadcast"]
