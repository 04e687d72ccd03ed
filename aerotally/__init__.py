"""Survey-imagery and annotation analytics as plain PySpark DataFrame operators."""
