"""Column expressions shared by every operator (all evaluated inside the JVM)."""
