"""A batch analytics engine on PySpark: tables, operators, functions and plans."""
