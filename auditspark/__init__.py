"""Decision audits and corpus preparation as Spark DataFrame operators."""
