"""Hospital-visit (patient-flow) analytics as Spark DataFrames."""
