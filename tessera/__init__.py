"""Panel analytics, record scoring and text preparation on PySpark."""
