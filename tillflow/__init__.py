"""tillflow: retail analytics as composable Spark DataFrame operators."""
