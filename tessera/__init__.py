"""tessera: a relational analytics engine on PySpark."""
