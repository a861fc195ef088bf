"""sparkloom: analytics and corpus processing written directly on PySpark."""
