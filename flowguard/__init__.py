"""Network-flow cleaning, triage and anomaly detection as Spark DataFrame operators."""
