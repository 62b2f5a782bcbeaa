"""dossier: document-compliance analytics as Spark DataFrame operators."""
