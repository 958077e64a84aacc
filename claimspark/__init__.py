"""claimspark: evidence-grounded claim verification as Spark DataFrame operators."""
