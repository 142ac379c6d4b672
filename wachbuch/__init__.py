"""wachbuch: incident analytics and corpus preparation as Spark plans."""
