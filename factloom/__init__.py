"""factloom: tables in web pages as typed, queryable facts, on PySpark."""
