"""End-to-end jobs: classifier training, anomaly training, live monitoring."""
